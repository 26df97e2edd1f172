"""Numbers 0, 1, 2, ... for rows in a global order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlight.plans.lineage import cut


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rows' numbers in this order, which must be total for equal results on each run.

    Rows are dealt by ranges of the order and counted by partition; only the counts, a row for each
    partition, are added up in one place.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_of_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_in_part")))
    before, offsets = 0, []
    for p, n in sorted(tuple(r) for r in ranged.groupBy("_of_part").agg(F.count("*")).collect()):
        offsets.append((p, before))
        before += n
    starts = F.create_map(*[F.lit(x) for pair in offsets for x in pair]) if offsets else F.lit(None).cast("map<int,bigint>")
    return ranged.withColumn(name, (F.element_at(starts, F.col("_of_part")) + F.col("_in_part")).cast("bigint")).drop("_of_part", "_in_part")
