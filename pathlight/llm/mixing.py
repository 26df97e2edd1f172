"""Mixing sources to target weights (operator 10).

Each source's share of all words follows its weight, held to three times its own size.
A document is taken floor(target / size) times, and once more if its hash lies below its
source's threshold. The threshold comes from histograms: words by source and hash bucket
give the bucket where the budget ends, and only that bucket is split further, ten bits at
a time, until one hash is left. Nothing is sorted, and the decision for a document needs
its source's row and its own hash alone.

Null texts have size 0; null sources form a source of their own, last in order. Rows that
repeat share a hash and are taken together. An empty table gives an empty result. Columns
of other names pass through `mix` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathlight.llm.common import documents, materialize

#: Bits that each histogram resolves, and the number of histograms.
BITS, LEVELS = 10, 5
HASH_BITS = BITS * LEVELS
#: Weights by place in the order of sources, repeating.
WEIGHTS = (1, 2, 3)
#: A target is at most so many times its source's size.
MOST_COPIES = 3


def size_of(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """HASH_BITS bits of the md5 of the id."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.shiftright(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"), 52 - HASH_BITS)


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size and target: the level at which targets stop is found by running sums over the sources in the order in which they reach it."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(place, F.lit(len(WEIGHTS))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(float(MOST_COPIES)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("_capped"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("_left"),
        F.sum("source_size").over(whole).cast("double").alias("_total"),
    )
    level = (F.col("_total") - F.col("_capped")) / F.col("_left")
    per = per.withColumn("_level", F.when(F.col("cap") > F.col("weight") * level, level))
    per = per.withColumn("_level", F.max("_level").over(whole))  # levels rise up to the right one and fall after it
    return per.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("_level")), F.col("cap")).alias("target"))


def thresholds(sized: DataFrame) -> DataFrame:
    """source, source_size, target, copies and below: a document is taken `copies` times, and once more if its hash is less than `below`. sized: source, size, h."""
    goal = targets(sized)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = materialize(goal.withColumn("copies", copies).withColumn("_rest", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("_at", F.lit(0).cast("long")).withColumn("_last", F.lit(0).cast("long")))
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - BITS * level
        of = state.select(F.col("source").alias("_s"), F.col("_at").alias("_p"))
        here = sized.join(of, sized["source"].eqNullSafe(of["_s"]) & (F.shiftright("h", shift + BITS) == F.col("_p")))
        bars = here.groupBy("source", F.shiftright("h", shift).alias("_bar")).agg(F.sum("size").alias("_size"))
        upto = F.sum("_size").over(Window.partitionBy("source").orderBy("_bar"))
        bars = bars.withColumn("_upto", upto).withColumnRenamed("source", "_s")
        over = bars.join(state.select(F.col("source").alias("_t"), F.col("_rest").alias("_r")), F.col("_s").eqNullSafe(F.col("_t"))).filter(F.col("_upto") > F.col("_r"))
        edge = over.groupBy("_s").agg(F.min(F.struct("_bar", "_upto", "_size")).alias("_e"))
        state = state.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left")
        before = F.col("_e._upto") - F.col("_e._size")
        state = materialize(
            state.select(
                "source", "source_size", "target", "copies",
                (F.col("_rest") - F.coalesce(before, F.lit(0))).alias("_rest"),
                F.coalesce(F.col("_e._bar"), F.lit((1 << HASH_BITS >> shift) - 1)).alias("_at"),
                F.coalesce(F.col("_e._size"), F.lit(0)).alias("_last"),
            )
        )
    below = F.col("_at") + F.when(2 * F.col("_rest") >= F.col("_last"), 1).otherwise(0)
    return materialize(state.select("source", "source_size", "target", "copies", below.alias("below")))


def sized_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("source"), size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("h"))


def times(h: Column) -> Column:
    return (F.col("copies") + (h < F.col("below")).cast("long")).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as its source's target asks, with their columns."""
    plan = thresholds(materialize(sized_rows(docs)))
    plan = plan.select(F.col("source").alias("_src"), "copies", "below").withColumnsRenamed({"copies": "_copies", "below": "_below"})
    n = F.col("_copies") + (hash_of(F.col("doc_id")) < F.col("_below")).cast("long")
    out = docs.join(plan, docs["source"].eqNullSafe(F.col("_src"))).withColumn("_n", n).filter("_n > 0")
    return out.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(sized_rows(documents(spark, sf_dir)))
    plan = thresholds(sized).withColumnRenamed("source", "_src")
    out = sized.join(plan, sized["source"].eqNullSafe(F.col("_src")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times(F.col("h"))).alias("taken"))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) >> {52 - HASH_BITS} AS h FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, {MOST_COPIES}.0::DOUBLE * source_size AS cap FROM p),
a AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS capped,
             sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS rest,
             CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM w),
l AS (SELECT *, max(CASE WHEN cap > weight * ((total - capped) / rest) THEN (total - capped) / rest END) OVER () AS level FROM a),
t AS (SELECT source, source_size, coalesce(least(cap, weight * level), cap) AS target FROM l),
c AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS copies FROM t),
h AS (SELECT source, h, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
x AS (SELECT c.source, c.source_size, c.target, c.copies, h.h, CASE WHEN 2 * (c.target - c.copies * c.source_size - (h.upto - h.size)) >= h.size THEN 1 ELSE 0 END AS extra
      FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source)
SELECT d.doc_id, d.size, x.source_size, x.target, CAST(d.size * (x.copies + x.extra) AS BIGINT) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
"""
