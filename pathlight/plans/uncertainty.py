"""Intervals around estimates: resampled paths, and residuals of paths held back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlight.operators import estimate as E
from pathlight.plans import solve, solvers
from pathlight.plans.numbering import numbered
from pathlight.sources.synthetic import draw


def resampled(rows: DataFrame, replicates: int, seed: int) -> DataFrame:
    """rows under `replicate`: each draws as many rows as there are, with replacement, by hash. rows: path_id, b, links."""
    placed = numbered(rows, [F.col("path_id")], "_i")
    n = placed.count()
    draws = rows.sparkSession.range(replicates * n).select((F.col("id") / max(n, 1)).cast("int").alias("replicate"), (F.col("id") % max(n, 1)).alias("_k"))
    drawn = draws.select("replicate", (draw(seed, "replicate", "_k") % max(n, 1)).alias("_i"))
    return drawn.join(placed, "_i").drop("_i")


#: Drawn paths that a task reduces to a triangle.
SHARD = 50_000


def solved(piece: solve.Piece, method: str, near: list[tuple[int, int]] | None, paths: pd.DataFrame | None = None) -> np.ndarray:
    """One method on a piece; expectation maximisation needs the distinct paths (links, b, paths) themselves."""
    method = solvers.solver_name(method)
    if method == "vardi-em":
        return solvers.em(list(paths["links"]), paths["b"].to_numpy(), piece.n, paths["paths"].to_numpy()).x
    if method == "tomogravity":
        return solvers.gravity(piece.system(near), piece.prior()).x
    return solvers.SOLVERS[method](piece.system(near)).x


def bootstrap(rows: DataFrame, n: int, method: str, replicates: int = 100, alpha: float = 0.05, seed: int = 42, near: list[tuple[int, int]] | None = None) -> DataFrame:
    """link_id, n_samples and half_width over resampled paths. Replicates may fail, but not more than half of them.

    A replicate's draws are dealt over tasks, which keep triangles; one task solves what they merge to. For
    expectation maximisation they are added up by distinct links instead.
    """
    solve.check_size(n)
    method = solvers.solver_name(method)
    drawn = resampled(rows, replicates, seed)

    def reduce(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        out = solve.Piece(n)
        out.add(df)
        return pd.DataFrame({"replicate": [key[0]], **out.row()})

    def run(df: pd.DataFrame) -> pd.DataFrame:
        try:
            x = solved(solve.Piece(n), method, near, df) if method == "vardi-em" else solved(solve.Piece(n).merge(df), method, near)
        except (solvers.SolveError, np.linalg.LinAlgError):
            return pd.DataFrame({"link_id": [-1], "x": [0.0]})
        return pd.DataFrame({"link_id": range(n), "x": x})

    if method == "vardi-em":
        parts = drawn.groupBy("replicate", "links").agg(F.avg("b").alias("b"), F.count("*").alias("paths"))
    else:
        shards = max(1, -(-rows.count() // SHARD))
        parts = drawn.withColumn("_s", F.pmod(F.xxhash64("path_id"), F.lit(shards))).groupBy("replicate", "_s").applyInPandas(reduce, f"replicate int, {solve.PIECE}")
    found = parts.groupBy("replicate").applyInPandas(run, "link_id bigint, x double")
    width = E.half_width(found, ["link_id"], "x", alpha)
    failed = width.filter("link_id = -1").agg(F.coalesce(F.max("n_samples"), F.lit(0)).alias("_failed"))
    ok = F.when(F.col("_failed") * 2 > replicates, F.raise_error(F.lit("more than half of the replicates failed")).cast("double")).otherwise(F.col("half_width"))
    return width.filter("link_id >= 0").crossJoin(failed).select("link_id", "n_samples", ok.alias("half_width"))


def conformal(rows: DataFrame, n: int, method: str, held: float = 0.2, alpha: float = 0.05, seed: int = 42, near: list[tuple[int, int]] | None = None) -> DataFrame:
    """link_id, x and confidence: an order statistic of the residuals of paths held back; infinite for links that none of these takes, and for fewer than two paths.

    The paths with the smallest hashes are held back. Both systems are triangles, residuals stay with their
    paths, and only the order statistic is looked up.
    """

    def fit(of: DataFrame) -> np.ndarray:
        paths = solve.distinct(of).toPandas() if solvers.solver_name(method) == "vardi-em" else None
        return solved(solve.Piece(n) if paths is not None else solve.piece_of(of, n), method, near, paths)

    placed = numbered(rows.withColumn("_h", draw(seed, "path_id")), [F.col("_h"), F.col("path_id")], "_k")
    count = placed.count()
    x, width, seen = fit(rows), np.inf, None
    if count >= 2:
        m = max(1, int(np.floor(count * held + 0.5)))
        guess = fit(placed.filter(F.col("_k") >= m))

        def miss(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                yield pd.DataFrame({"path_id": df["path_id"], "r": [abs(b - guess[np.asarray(p, int)].sum()) for p, b in zip(df["links"], df["b"], strict=True)]})

        kept = placed.filter(F.col("_k") < m).select("path_id", "links", "b")
        width = E.conformal_quantile(kept.mapInPandas(miss, "path_id bigint, r double"), alpha).collect()[0]["q"]
        seen = kept.select(F.explode(F.col("links").cast("array<bigint>")).alias("link_id")).distinct().withColumn("_w", F.lit(float(width)))
    out = rows.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "link_id bigint, x double")
    if seen is None:
        return out.withColumn("confidence", F.lit(float("inf")))
    return out.join(seen, "link_id", "left").select("link_id", "x", F.coalesce("_w", F.lit(float("inf"))).alias("confidence"))
