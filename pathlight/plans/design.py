"""Which paths to probe next, and benchmarks of solvers."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlight.plans import solve, solvers, uncertainty


#: Candidates that a task looks at.
GROUP = 20_000


class Basis:
    """Orthonormal vectors that span what is known."""

    def __init__(self, n: int, known: np.ndarray | None = None):
        self.n, self.known = n, np.zeros((n, 0)) if known is None else known

    def add(self, links: list[int]) -> bool:
        """Whether a path says something new, which is then known."""
        v = np.zeros(self.n)
        v[list(links)] = 1
        size = np.linalg.norm(v)
        for _ in range(2):
            v -= self.known @ (self.known.T @ v)
        if not size or np.linalg.norm(v) <= 1e-9 * size:
            return False
        self.known = np.column_stack([self.known, v / np.linalg.norm(v)])
        return True


def spanned(existing: DataFrame, n: int) -> np.ndarray:
    """An orthonormal basis of the existing paths, by their triangle."""
    r = solve.piece_of(existing.withColumn("b", F.lit(0.0)), n).r[:, :n]
    if not len(r):
        return np.zeros((n, 0))
    _, d, vt = np.linalg.svd(r, full_matrices=False)
    return vt[d > 1e-9 * max(d.max(initial=0), 1)].T


def recommend(existing: DataFrame, candidates: DataFrame, n: int, budget: int) -> DataFrame:
    """step, path_id, rank_gain and rank: candidates, in the order of path_id, that add to the rank, up to a budget.

    A path adds 1 or nothing, and one that adds nothing to some of the paths before it adds nothing to all
    of them. So groups of candidates drop theirs first, which leaves n of each at most, and one task looks at
    those. Both: path_id, links.
    """
    solve.check_size(n)
    known = spanned(existing, n)

    def first(df: pd.DataFrame) -> pd.DataFrame:
        df, basis = df.sort_values("path_id"), Basis(n, known)
        return df[[basis.add(p) for p in df["links"]]]

    def last(df: pd.DataFrame) -> pd.DataFrame:
        basis, out = Basis(n, known), []
        for path, links in df.sort_values("path_id")[["path_id", "links"]].itertuples(index=False):
            if len(out) < budget and basis.add(links):
                out.append((len(out) + 1, path, 1, basis.known.shape[1]))
        return pd.DataFrame(out, columns=["step", "path_id", "rank_gain", "rank"])

    groups = max(1, -(-candidates.count() // GROUP))
    some = candidates.select("path_id", "links", F.pmod(F.xxhash64("path_id"), F.lit(groups)).alias("_g"))
    left = some.groupBy("_g").applyInPandas(first, "path_id bigint, links array<int>, _g bigint")
    return left.groupBy().applyInPandas(last, "step bigint, path_id bigint, rank_gain bigint, rank bigint")


def rank(rows: DataFrame, n: int) -> int:
    """The rank of the routing matrix of some paths."""
    return spanned(rows, n).shape[1]


RESULT = "method string, n_links bigint, n_paths bigint, rank bigint, condition double, residual double, rmse double, mae double, max_rel_err double, identifiable_share double, detection_rate double, duration_ms double"


def judge(x: np.ndarray, truth: np.ndarray, ok: np.ndarray) -> tuple[float, float, float, float]:
    """Root mean square, mean and largest relative error, and detection rate, over identifiable links."""
    d, t = np.abs(x - truth)[ok], truth[ok]
    if not len(d):
        return 0.0, 0.0, 0.0, 0.0
    rel = d[t > 0.001] / t[t > 0.001]
    k = max(1, min(3, len(d) // 4))
    top = lambda v: {int(i) for i in np.lexsort((np.arange(len(v)), -v))[:k]}
    return float(np.sqrt((d**2).mean())), float(d.mean()), float(rel.max(initial=0.0)), len(top(t) & top(x[ok])) / k


def benchmark(rows: DataFrame, truth: DataFrame, n: int, methods: tuple[str, ...] = solvers.METHODS, near: list[tuple[int, int]] | None = None) -> DataFrame:
    """A row per method, each a task of its own, all on the same observations. rows: path_id, b, links; truth: link_id, truth.

    Paths come down to their triangle first; for expectation maximisation the distinct ones go to its task.
    """
    spark = rows.sparkSession
    known = truth.orderBy("link_id").toPandas()["truth"].to_numpy()  # a number for each link
    piece = solve.piece_of(rows, n)
    s = piece.system(near)
    quality = solvers.audit(s.r, s.m)
    ok = np.ones(n, bool)
    ok[quality.unidentifiable] = False

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        began = time.perf_counter()
        x = uncertainty.solved(piece, key[0], near, df if key[0] == "vardi-em" else None)
        ms = (time.perf_counter() - began) * 1e3
        rmse, mae, worst, detected = judge(x, known, ok)
        return pd.DataFrame([(key[0], n, s.m, quality.rank, quality.condition, s.residual(x), rmse, mae, worst, quality.identifiable_share, detected, ms)], columns=[c.split()[0] for c in RESULT.split(", ")])

    names = [solvers.solver_name(m) for m in methods]
    kind = "method string, links array<int>, b double, paths bigint"
    each = spark.createDataFrame([(m, [], 0.0, 0) for m in names if m != "vardi-em"], kind)
    if "vardi-em" in names:
        each = each.unionByName(solve.distinct(rows).select(F.lit("vardi-em").alias("method"), F.col("links").cast("array<int>").alias("links"), "b", "paths"))
    return each.groupBy("method").applyInPandas(run, RESULT)


def table(results: DataFrame) -> DataFrame:
    """method and line: results as a report prints them; what is not finite reads N/A."""
    text = lambda c, f: F.when(F.isnan(c) | (F.abs(c) == float("inf")), "N/A").otherwise(F.format_string(f, F.col(c)))
    band = F.when(F.col("rmse") < 5, "green").when(F.col("rmse") <= 20, "yellow").otherwise("red")
    return results.select("method", F.concat_ws(" ", F.rpad("method", 12, " "), text("condition", "%.1f"), text("rmse", "%.3f"), text("mae", "%.3f"), F.format_string("%.0f%%", F.col("identifiable_share") * 100)).alias("line"), band.alias("band"))


def running_rank(plan: DataFrame) -> DataFrame:
    """The plan with the rank gained so far."""
    from pyspark.sql.window import Window

    return plan.withColumn("gained", F.sum("rank_gain").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))


