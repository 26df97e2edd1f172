"""Report formats: CSV, JSON and graph drawings, as lines of text that any writer takes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlight.functions import scalar

CSV_HEADER = "link_id,src,dst,delay_ms,confidence_ms,identifiable"


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _places(c: Column, n: int) -> Column:
    return F.format_string(f"%.{n}f", F.coalesce(c, F.lit(0.0)))


def csv_lines(rows: DataFrame) -> DataFrame:
    """link_id and line; a missing estimate or confidence writes 0, a missing mask false."""
    mask = F.coalesce("identifiable", F.lit(False)).cast("string")
    return rows.select("link_id", F.concat_ws(",", _text("link_id"), _text("src"), _text("dst"), _places(F.col("x"), 3), _places(F.col("confidence"), 3), mask).alias("line"))


def dot_edges(rows: DataFrame) -> DataFrame:
    """link_id and line of an undirected drawing; dashed where the estimate is not identifiable."""
    dashed = F.when(F.coalesce("identifiable", F.lit(False)), "").otherwise(", style=dashed")
    line = F.concat(F.lit('  "'), _text("src"), F.lit('" -- "'), _text("dst"), F.lit('" [label="'), _places(F.col("x"), 1), F.lit('ms", color="'), scalar.delay_band(F.col("x")), F.lit('"'), dashed, F.lit("];"))
    return rows.select("link_id", line.alias("line"))


def dot_document(rows: DataFrame) -> DataFrame:
    """One row: the whole drawing. Drawings are for networks that a person can look at."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("link_id", "line"))), lambda x: x["line"]), "\n")
    return dot_edges(rows).agg(F.concat(F.lit("graph network {\n"), lines, F.lit("\n}\n")).alias("text"))


def finite(c: Column) -> Column:
    """JSON has no infinities: null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def json_document(rows: DataFrame, method: str, residual: float, quality: dict[str, float], duration_ms: float = 0.0) -> DataFrame:
    """One row: method, duration, residual, matrix quality and the links in order."""
    link = F.struct("link_id", "src", "dst", finite(F.col("x")).alias("delay_ms"), finite(F.col("confidence")).alias("confidence_ms"), "identifiable")
    head = F.struct(F.lit(method).alias("method"), F.lit(duration_ms).alias("duration_ms"), finite(F.lit(float(residual))).alias("residual"), F.struct(*[finite(F.lit(float(v))).alias(k) for k, v in quality.items()]).alias("matrix_quality"))
    return rows.agg(F.array_sort(F.collect_list(link)).alias("links")).select(F.to_json(F.struct(head["method"].alias("method"), head["duration_ms"].alias("duration_ms"), head["residual"].alias("residual"), head["matrix_quality"].alias("matrix_quality"), "links"), {"pretty": "true"}).alias("text"))


def csv_document(rows: DataFrame) -> DataFrame:
    """The header, then the lines in order."""
    head = rows.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("link_id"), F.lit(CSV_HEADER).alias("line"))
    return head.unionByName(csv_lines(rows)).orderBy("link_id").select("line")


FORMATS: dict[str, Callable[..., DataFrame]] = {"csv": csv_document, "json": json_document, "dot": dot_document}


def get(name: str) -> Callable[..., DataFrame] | None:
    return FORMATS.get(name)
