"""Solving over Spark: tall matrices shrink to triangles, and every (topology, method) is a task.

The routing matrix stays in coordinates. Paths are dealt over tasks; each densifies blocks
of them, keeps one triangle of [A | b], and triangles merge in two rounds, so a task never
holds more than a block of paths and n squared numbers. Networks of more than MOST_LINKS
links are for the sparse estimators (expectation maximisation, gravity prior), which stay
relational. Expectation maximisation runs on the driver only where the distinct paths hold
MOST_ENTRIES links at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlight.operators import estimate as E
from pathlight.operators import graph as G
from pathlight.operators.infer import Network
from pathlight.plans import solvers
from pathlight.plans.lineage import cut, discard

MOST_LINKS = 2_000
#: Entries of distinct paths that may come to the driver.
MOST_ENTRIES = 200_000
#: Paths that a task densifies at once.
BLOCK = 4_096
#: Groups in which triangles first merge.
MERGERS = 32


def rows_of(routing: DataFrame, observed: DataFrame) -> DataFrame:
    """path_id, b and the path's links as an array; paths without links have an empty one."""
    listed = routing.groupBy("path_id").agg(F.array_sort(F.collect_set(F.col("link_id").cast("int"))).alias("links"))
    return observed.select("path_id", "b").join(listed, "path_id", "left").select("path_id", "b", F.coalesce("links", F.array().cast("array<int>")).alias("links"))


def dense(df: pd.DataFrame, n: int) -> np.ndarray:
    """[A | b] of some paths."""
    a = np.zeros((len(df), n + 1))
    lens = df["links"].map(len).to_numpy()
    if lens.sum():
        a[np.repeat(np.arange(len(df)), lens), np.concatenate(df["links"].to_numpy())] = 1
    a[:, n] = df["b"]
    return a


PIECE = "m bigint, r binary, hits binary, shares binary"


class Piece:
    """What some paths come to, whose size is that of the links squared: how many there are, the triangle of [A | b], and for each link its paths and the sum of their delays by length."""

    def __init__(self, n: int):
        self.n, self.m, self.r, self.hits, self.shares = n, 0, np.zeros((0, n + 1)), np.zeros(n), np.zeros(n)

    def add(self, df: pd.DataFrame) -> None:
        for at in range(0, len(df), BLOCK):
            a = dense(df.iloc[at : at + BLOCK], self.n)
            ones, b = a[:, : self.n], a[:, self.n]
            self.hits += ones.sum(0)
            self.shares += (b / np.maximum(ones.sum(1), 1)) @ ones
            self.r, self.m = np.linalg.qr(np.vstack([self.r, a]), "r"), self.m + len(a)

    def merge(self, df: pd.DataFrame) -> Piece:
        for m, r, hits, shares in df[["m", "r", "hits", "shares"]].itertuples(index=False):
            self.m += m
            self.r = np.linalg.qr(np.vstack([self.r, np.frombuffer(r).reshape(-1, self.n + 1)]), "r")
            self.hits, self.shares = self.hits + np.frombuffer(hits), self.shares + np.frombuffer(shares)
        return self

    def row(self) -> dict[str, list]:
        return {"m": [self.m], "r": [self.r.astype(float).tobytes()], "hits": [self.hits.tobytes()], "shares": [self.shares.tobytes()]}

    def system(self, near: list[tuple[int, int]] | None) -> solvers.System:
        return from_triangle(self.r, self.m, self.hits.astype(int), near)

    def prior(self) -> np.ndarray:
        return self.shares / np.maximum(self.hits, 1)


def check_size(n: int) -> None:
    if n > MOST_LINKS:
        raise ValueError(f"{n} links are too many for a dense triangle; use vardi-em or the gravity prior")


def piece_of(rows: DataFrame, n: int) -> Piece:
    """All paths as one piece: by task, then in MERGERS groups, then on the driver."""
    check_size(n)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = Piece(n)
        for df in batches:
            out.add(df)
        if out.m:
            yield pd.DataFrame({"g": [int(out.m * 2654435761 + out.hits.sum()) % MERGERS], **out.row()})

    def merge(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": df["g"][:1], **Piece(n).merge(df).row()})

    kind = f"g int, {PIECE}"
    once = rows.select("b", "links").mapInPandas(reduce, kind).groupBy("g").applyInPandas(merge, kind)
    return Piece(n).merge(once.toPandas())  # MERGERS rows of n squared numbers at most


def triangles(rows: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """The triangle of [A | b] and how many paths there are."""
    out = piece_of(rows, n)
    return out.r, out.m


def system_of(net: Network, with_neighbors: bool = True) -> solvers.System:
    """The small system that stands for all paths of a network. Its size is that of the links squared."""
    covered = sorted((int(r["link_id"]), int(r["coverage"])) for r in E.coverage(net.links, net.routing).collect())
    n = len(covered)
    t, m = triangles(rows_of(net.routing, net.observed), n)
    near = [(int(r["a"]), int(r["b"])) for r in G.link_adjacency(net.links).collect()] if with_neighbors else None
    return from_triangle(t, m, np.array([c for _, c in covered]), near)


def from_triangle(t: np.ndarray, m: int, coverage: np.ndarray, near: list[tuple[int, int]] | None) -> solvers.System:
    n = t.shape[1] - 1
    k = min(len(t), n)
    return solvers.System(t[:k, :n], t[:k, n], float((t[k:, n] ** 2).sum()), m, coverage, near)


def guard(net: Network) -> None:
    """Raises where there is no problem to solve: no paths, no links, or a matrix that names links that there are not."""
    if net.paths.isEmpty():
        raise ValueError("there are no paths")
    if net.links.isEmpty():
        raise ValueError("there are no links")
    if not net.routing.join(net.links.select("link_id"), "link_id", "left_anti").isEmpty():
        raise ValueError("a path takes a link that is not in the network")


def settled(net: Network) -> Network:
    """What solvers read, written once."""
    return Network(lambda: net.nodes, *(cut(x) for x in (net.links, net.paths, net.routing, net.observed)))


def solve(net: Network, method: str) -> tuple[solvers.Solution, solvers.System | None]:
    """One method on one network."""
    method = solvers.solver_name(method)
    guard(net)
    if method == "vardi-em":
        ones = distinct_paths(net)
        if (ones.agg(F.sum(F.size("links"))).collect()[0][0] or 0) > MOST_ENTRIES:
            found = em_over_spark(net)
            left = E.residual(net.routing, net.observed, found).collect()[0][0]
            return solvers.Solution(found.orderBy("link_id").toPandas()["x"].to_numpy(), method, left, {}), None  # a number for each link
        rows = ones.orderBy("path_id").toPandas()
        out = solvers.em(list(rows["links"]), rows["b"].to_numpy(), net.links.count(), rows["paths"].to_numpy())
        # paths that share their links differ from their mean whatever the estimate
        out.residual = float(np.sqrt(out.residual**2 + rows["spread"].sum()))
        return out, None
    s = system_of(net, method == "laplacian")
    if method == "tomogravity":
        prior = E.gravity_prior(net.links, net.routing, net.observed).orderBy("link_id").toPandas()["x"].to_numpy()
        if net.paths.join(net.routing, "path_id", "left_anti").count():
            raise solvers.SolveError("a path without links has no gravity share")
        return solvers.gravity(s, prior), s
    return solvers.SOLVERS[method](s), s


def distinct_paths(net: Network) -> DataFrame:
    """path_id (the first), links, paths, the mean b and the squares around it, of the paths that take the same links: to a multiplicative update they are one row that weighs as many."""
    return distinct(rows_of(net.routing, net.observed))


def distinct(rows: DataFrame) -> DataFrame:
    spread = (F.var_pop("b") * F.count("*")).alias("spread")
    return rows.groupBy("links").agg(F.min("path_id").alias("path_id"), F.avg("b").alias("b"), F.count("*").alias("paths"), spread)


def solution_rows(net: Network, method: str) -> DataFrame:
    """link_id, x, identifiable and method. Beyond MOST_LINKS links expectation maximisation stays relational and nothing is said about identifiability (null)."""
    spark = net.links.sparkSession
    n = net.links.count()
    if n > MOST_LINKS and solvers.solver_name(method) == "vardi-em":
        guard(net)
        return em_over_spark(net).select("link_id", "x", F.lit(None).cast("boolean").alias("identifiable"), F.lit("vardi-em").alias("method"))
    found, s = solve(net, method)
    lost = set(solvers.audit(s.r, s.m).unidentifiable) if s is not None else set(solvers.audit((t := system_of(net, False)).r, t.m).unidentifiable)
    rows = [(i, float(v), i not in lost, found.method) for i, v in enumerate(found.x)]
    return spark.createDataFrame(rows, "link_id bigint, x double, identifiable boolean, method string")


def em_over_spark(net: Network, rounds: int = 500, every: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """link_id and x by relational rounds over distinct paths, for networks of any size; every few rounds are one step whose result is written, and the table before it goes."""
    ones = cut(distinct_paths(net).filter(F.size("links") > 0).select("path_id", "links", "b", "paths"))
    entries = cut(ones.select("path_id", "paths", F.explode(F.col("links").cast("array<bigint>")).alias("link_id")))
    weight = cut(entries.groupBy("link_id").agg(F.sum("paths").alias("_w")))
    x = cut(net.links.select("link_id").join(weight, "link_id", "left").select("link_id", F.coalesce("_w", F.lit(0)).alias("_w"), F.lit(1.0).alias("x")))
    for _ in range(0, rounds, every):
        new = x
        for _ in range(every):
            fit = entries.join(new.select("link_id", "x"), "link_id").groupBy("path_id").agg(F.sum("x").alias("_f")).filter("_f > 0")
            ratio = ones.join(fit, "path_id").select("path_id", (F.col("paths") * F.col("b") / F.col("_f")).alias("_r"))
            gain = entries.join(ratio, "path_id").groupBy("link_id").agg(F.sum("_r").alias("_g"))
            new = new.join(gain, "link_id", "left").select("link_id", "_w", (F.col("x") * F.coalesce(F.col("_g") / F.col("_w"), F.lit(0.0))).alias("x"))
        new = cut(new)
        moved = new.join(x.select("link_id", F.col("x").alias("_o")), "link_id").filter("x > 0").agg(F.max(F.abs(F.col("x") - F.col("_o")) / F.col("x"))).collect()[0][0]
        discard(x)
        x = new
        if moved is None or moved < tolerance * every:
            break
    discard(ones, entries, weight)
    return x.select("link_id", "x")
