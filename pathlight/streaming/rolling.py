"""Measurements as a stream: least delays in windows of event time, and solving anew as batches come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from pathlight.plans.lineage import cut


def least_by_window(points: DataFrame, window: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """src, dst, start, n and least_ns of points (src, dst, ts, rtt_ns) in tumbling windows. Of a stream, points later than `late` are dropped."""
    if late and points.isStreaming:
        points = points.withWatermark("ts", late)
    out = points.groupBy(F.window("ts", window).alias("_w"), "src", "dst").agg(F.count("*").alias("n"), F.min("rtt_ns").alias("least_ns"))
    return out.select("src", "dst", F.col("_w.start").alias("start"), "n", "least_ns")


def trace_stream(spark: SparkSession, folder: str, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Measurements of trace files as they arrive in a folder."""
    return parse(spark.readStream.option("wholetext", "true").text(folder))


def solve_each_batch(measurements: DataFrame, solve: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Appends the solution of every micro-batch to a table, under its number."""

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            solve(cut(batch)).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return measurements.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
