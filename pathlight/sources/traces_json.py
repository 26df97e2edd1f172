"""Trace files: three JSON layouts into measurements with hops. Parsing is by declared types and built-in functions.

A text is one document: what doesn't parse raises, records of another type give no rows,
and missing numbers and strings read as 0 and empty.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pathlight import schemas
from pathlight.functions import scalar

MEASURED = ["src", "dst", "hops", "rtts_ns", "ts", "weight"]


def _s(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _n(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _hop(ip: Column, rtt_ns: Column, ttl: Column, anonymous: Column, mpls: Column) -> Column:
    return F.struct(ip.alias("ip"), rtt_ns.cast("bigint").alias("rtt_ns"), ttl.cast("int").alias("ttl"), anonymous.alias("anonymous"), mpls.alias("mpls"))


def parsed(text: Column, kind: str) -> Column:
    """from_json, but a document that does not parse raises."""
    out = F.from_json(text, kind, {"mode": "PERMISSIVE"})
    ok = F.try_parse_json(text).isNotNull()
    return F.when(~ok, F.raise_error(F.lit("not a JSON document")).cast(kind)).otherwise(out)


def ripe_hops(results: Column) -> tuple[Column, Column]:
    """Hops, each by its first reply that answers, and the samples of the last hop in ns."""
    answers = lambda r: (_s(r["x"]) != "*") & (_s(r["from"]) != "")

    def hop(h: Column) -> Column:
        first = F.get(F.filter(h["result"], answers), F.lit(0))
        labels = F.exists(F.coalesce(first["icmpext"]["obj"], _empty("array<struct<mpls:array<struct<label:int>>>>")), lambda o: F.coalesce(F.size(o["mpls"]) > 0, F.lit(False)))
        return _hop(_s(first["from"]), F.coalesce(scalar.ms_to_ns(first["rtt"]), F.lit(0)), F.coalesce(h["hop"], F.lit(0)), first.isNull(), F.coalesce(labels, F.lit(False)))

    hops = F.coalesce(F.transform(results, hop), _empty(f"array<{schemas.HOP}>"))
    last = F.when(F.coalesce(F.size(results), F.lit(0)) > 0, F.get(results, F.size(results) - 1)["result"])
    samples = F.transform(F.filter(last, lambda r: (_s(r["x"]) != "*") & (_n(r["rtt"]) > 0)), lambda r: scalar.ms_to_ns(r["rtt"]))
    return hops, F.coalesce(samples, _empty("array<bigint>"))


def ripe(texts: DataFrame, column: str = "value") -> DataFrame:
    """Measurements of documents that list traceroute results."""
    rows = texts.withColumn("_r", F.explode(parsed(F.col(column), schemas.RIPE))).filter("_r.type = 'traceroute'")
    hops, samples = ripe_hops(F.col("_r.result"))
    return rows.select("*", _s(F.col("_r.src_addr")).alias("src"), _s(F.col("_r.dst_addr")).alias("dst"), hops.alias("hops"), samples.alias("rtts_ns"), F.timestamp_seconds(F.coalesce("_r.timestamp", F.lit(0))).alias("ts"), F.lit(1.0).alias("weight")).drop("_r", column)


def scamper(texts: DataFrame, column: str = "value") -> DataFrame:
    """Measurements of documents that list traces or are one. Every reply is a hop; samples are those at the last reply's ttl."""
    many = F.when(F.ltrim(F.col(column)).startswith("["), parsed(F.col(column), f"array<{schemas.SCAMPER}>")).otherwise(F.array(parsed(F.col(column), schemas.SCAMPER)))
    rows = texts.withColumn("_r", F.explode(many)).filter("_r.type IN ('trace', 'traceroute')")
    silent = lambda h: _s(h["addr"]).isin("", "0.0.0.0")
    mpls = lambda h: F.coalesce(F.size(h["icmpext"]["mpls"]) > 0, F.lit(False))
    replies = F.col("_r.hops")
    hops = F.coalesce(F.transform(replies, lambda h: _hop(_s(h["addr"]), F.coalesce(scalar.us_to_ns(h["rtt"]), F.lit(0)), F.coalesce(h["probe_ttl"], F.lit(0)), silent(h), mpls(h))), _empty(f"array<{schemas.HOP}>"))
    last = F.when(F.coalesce(F.size(replies), F.lit(0)) > 0, F.get(replies, F.size(replies) - 1)["probe_ttl"])
    samples = F.transform(F.filter(replies, lambda h: (F.coalesce(h["probe_ttl"], F.lit(0)) == F.coalesce(last, F.lit(0))) & (_s(h["addr"]) != "")), lambda h: F.coalesce(scalar.us_to_ns(h["rtt"]), F.lit(0)))
    return rows.select("*", _s(F.col("_r.src")).alias("src"), _s(F.col("_r.dst")).alias("dst"), hops.alias("hops"), F.coalesce(samples, _empty("array<bigint>")).alias("rtts_ns"), F.timestamp_seconds(F.coalesce("_r.start.sec", F.lit(0))).alias("ts"), F.lit(1.0).alias("weight")).drop("_r", column)


def mtr(texts: DataFrame, column: str = "value") -> DataFrame:
    """The measurement of each report; its hops' ttl is their place, their delay the best, the samples best, average and worst of the last."""
    rows = texts.withColumn("_r", parsed(F.col(column), schemas.MTR)["report"]).filter("_r IS NOT NULL")
    hubs = F.coalesce(F.col("_r.hubs"), _empty("array<struct<count:int,host:string,Avg:double,Best:double,Wrst:double>>"))
    hops = F.transform(hubs, lambda h, i: _hop(F.when(_s(h["host"]) == "???", "").otherwise(_s(h["host"])), scalar.ms_to_ns(_n(h["Best"])), i + 1, _s(h["host"]).isin("", "???"), F.lit(False)))
    last = F.get(hubs, F.size(hubs) - 1)
    samples = F.when(F.size(hubs) > 0, F.transform(F.array(last["Best"], last["Avg"], last["Wrst"]), lambda v: scalar.ms_to_ns(_n(v)))).otherwise(_empty("array<bigint>"))
    return rows.select("*", _s(F.col("_r.mtr.src")).alias("src"), _s(F.col("_r.mtr.dst")).alias("dst"), hops.alias("hops"), samples.alias("rtts_ns"), F.current_timestamp().alias("ts"), F.lit(1.0).alias("weight")).drop("_r", column)


def detect(spark: SparkSession, path: str) -> DataFrame:
    """Measurements of trace files: list results as RIPE's; a document that gives none that way is read as scamper's."""
    texts = spark.read.text(path, wholetext=True)
    first = F.try_element_at(F.from_json("value", schemas.RIPE), F.lit(1))["type"]
    is_ripe = F.coalesce(first == "traceroute", F.lit(False)) & F.contains("value", F.lit('"result"'))
    return ripe(texts.filter(is_ripe)).unionByName(scamper(texts.filter(~is_ripe)))


def esmond_points(texts: DataFrame, src: str, dst: str, column: str = "value") -> DataFrame:
    """Measurements without hops, one for each point of a latency archive."""
    rows = texts.select(F.explode(parsed(F.col(column), schemas.ESMOND_POINTS)).alias("_p"))
    return rows.select(F.lit(src).alias("src"), F.lit(dst).alias("dst"), _empty(f"array<{schemas.HOP}>").alias("hops"), F.array(scalar.ms_to_ns(_n(F.col("_p.val")))).alias("rtts_ns"), F.timestamp_seconds(F.coalesce("_p.ts", F.lit(0))).alias("ts"), F.lit(1.0).alias("weight"))


def exploded_hops(measurements: DataFrame) -> DataFrame:
    """A row per hop, as inference reads it. measurements: with meas_idx."""
    rows = measurements.select("meas_idx", F.posexplode("hops").alias("pos", "_h"))
    return rows.select("meas_idx", F.col("pos").cast("bigint").alias("pos"), F.col("_h.ttl").cast("bigint").alias("ttl"), F.col("_h.ip").alias("ip"), F.col("_h.rtt_ns").alias("rtt_ns"), F.col("_h.anonymous").alias("anonymous"), F.col("_h.mpls").alias("mpls"))


def least_rtt(rtts_ns: Column) -> Column:
    """The least sample in ns; 0 where there is none."""
    return F.coalesce(F.array_min(rtts_ns), F.lit(0).cast("bigint"))


class Collector:
    """Measurements one at a time, a partition in memory at once. After `close` there are no more; `error` holds what ended it early."""

    def __init__(self, measurements: DataFrame):
        self.measurements, self.closed, self.error = measurements, False, None

    def __iter__(self) -> Iterator[Row]:
        try:
            for row in self.measurements.toLocalIterator():
                if self.closed:
                    return
                yield row
        except Exception as e:
            self.error = e
            raise
        finally:
            self.closed = True

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> Collector:
        return self

    def __exit__(self, *_) -> None:
        self.close()
