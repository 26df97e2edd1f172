"""Synthetic topologies: preferential attachment, and links whose chance falls with distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NODES = "topo string, node_id int, label string, lat double, lon double"
EDGES = "topo string, i bigint, src bigint, dst bigint"


def preferential_edges(n: int, m: int, seed: int) -> list[tuple[int, int]]:
    """A clique of m + 1 nodes; each further node ties to m others, chosen by degree, in ascending order."""
    rng = np.random.default_rng(seed)
    edges = [(a, b) for a in range(m + 1) for b in range(a + 1, m + 1)]
    ends = [v for e in edges for v in e]
    for v in range(m + 1, n):
        chosen: set[int] = set()
        while len(chosen) < m:
            chosen.add(int(ends[rng.integers(len(ends))]) if ends else int(rng.integers(v)))
        for t in sorted(chosen):
            edges.append((v, t))
            ends += [v, t]
    return edges


def barabasi_albert(spark: SparkSession, graphs: list[tuple[str, int, int, int]]) -> DataFrame:
    """Edges (topo, i, src, dst) of many graphs (name, n, m, seed), each grown in a task of its own."""

    def grow(batches):
        for df in batches:
            for r in df.itertuples():
                e = preferential_edges(r.n, r.m, r.seed)
                yield pd.DataFrame({"topo": r.topo, "i": range(len(e)), "src": [a for a, _ in e], "dst": [b for _, b in e]})

    spec = spark.createDataFrame(graphs, "topo string, n int, m int, seed bigint")
    return spec.repartition(len(graphs), "topo").mapInPandas(grow, EDGES)


def waxman_pairs(nodes: DataFrame, alpha: float, beta: float) -> DataFrame:
    """i, j and the chance p of a link: beta exp(-d / (alpha L)), L the largest distance; alpha of 0 or less counts 0.01."""
    alpha = alpha if alpha > 0 else 0.01
    end = lambda s, i: nodes.select(F.col("node_id").alias(i), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
    both = end(1, "i").join(end(2, "j"), F.col("i") < F.col("j"))
    d = F.sqrt(F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2))
    both = both.withColumn("d", d).withColumn("_l", F.max("d").over(Window.partitionBy()))
    scale = F.when(F.col("_l") > 0, F.col("_l")).otherwise(1.0)
    return both.select("i", "j", (beta * F.exp(-F.col("d") / (alpha * scale))).alias("p"))


def draw(seed: int, *keys: Column | str) -> Column:
    """52 bits of the md5 of seed and keys: the same at any partitioning, and in any engine."""
    text = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *text)), 1, 13), 16, 10).cast("bigint")


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone."""
    return draw(seed, *keys) / float(1 << 52)


def waxman(spark: SparkSession, n: int, alpha: float, beta: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, x, y) in the unit square and edges (i, src, dst): drawn links, then one link (v - 1, v) for each v that they leave apart from node 0."""
    nodes = spark.range(n).select(F.col("id").alias("node_id"), uniform(seed, F.lit("x"), "id").alias("x"), uniform(seed, F.lit("y"), "id").alias("y"))
    drawn = waxman_pairs(nodes, alpha, beta).filter(uniform(seed, F.lit("e"), "i", "j") < F.col("p")).select("i", "j")
    drawn = drawn.select((F.col("i") * n + F.col("j")).alias("i"), F.col("i").alias("src"), F.col("j").alias("dst"))

    def repair(df: pd.DataFrame) -> pd.DataFrame:
        root = list(range(n))

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        df = df[df["src"] >= 0].sort_values("i")
        for a, b in zip(df["src"], df["dst"], strict=True):
            root[find(a)] = find(b)
        more = []
        for v in range(1, n):
            if find(v) != find(0):
                more.append((n * n + v, v - 1, v))
                root[find(v)] = find(v - 1)
        return pd.concat([df, pd.DataFrame(more, columns=["i", "src", "dst"])])

    # a topology is one graph of a size that a task holds, as everything that is solved densely
    seedling = spark.range(1).select(F.lit(-1).cast("bigint").alias("i"), F.lit(-1).cast("bigint").alias("src"), F.lit(-1).cast("bigint").alias("dst"))
    return nodes, drawn.unionByName(seedling).groupBy().applyInPandas(repair, "i bigint, src bigint, dst bigint")
