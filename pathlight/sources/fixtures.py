"""The star-schema tables seen as measurement data: an order is a trace, a line item a hop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meas_idx, pos, ttl, ip, suppkey, rtt_ns, anonymous, mpls: a row per hop, in a total order within its trace."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("bigint").alias("meas_idx"),
        (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1).cast("bigint").alias("pos"),
        F.col("l_linenumber").cast("bigint").alias("ttl"),
        F.concat(F.lit("10.0."), F.floor(F.col("l_suppkey") / 256).cast("string"), F.lit("."), (F.col("l_suppkey") % 256).cast("string")).alias("ip"),
        F.col("l_suppkey").cast("bigint").alias("suppkey"),
        (F.col("l_quantity") * 1000000).cast("bigint").alias("rtt_ns"),
        (F.col("l_returnflag") == "R").alias("anonymous"),
        (F.col("l_discount") >= 0.10).alias("mpls"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meas_idx, src and dst of every order: all of them, with hops or without."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").cast("bigint").alias("meas_idx"), F.col("o_custkey").cast("string").alias("src"), F.col("o_orderpriority").alias("dst"), F.col("o_orderdate").alias("ts"))


def ip_asn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppkey and asn; 0 stands for an address that does not resolve."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("suppkey"), F.col("s_nationkey").cast("bigint").alias("asn"))


def nation_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node label, lat and lon of the AS network; one nation stands at (0, 0), that is nowhere."""
    k = F.col("n_nationkey").cast("bigint")
    return table(spark, sf_dir, "nation").select(k.alias("label"), F.when(k == 7, 0.0).otherwise(k * 5.0 - 60.0).alias("lat"), F.when(k == 7, 0.0).otherwise(k * 11.0 - 130.0).alias("lon"))


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, ts and rtt_ns of latency points."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("src"), F.col("event_type").alias("dst"), "ts", (F.col("value") * 1e6).cast("bigint").alias("rtt_ns"))
