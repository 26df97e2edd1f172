"""Estimates over the routing matrix in coordinate form, and how to judge them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathlight.functions import scalar
from pathlight.plans.numbering import numbered

CONGESTED_MS = 20.0


def coverage(links: DataFrame, routing: DataFrame) -> DataFrame:
    """link_id and how many paths take it, 0 included."""
    n = routing.groupBy("link_id").agg(F.count("*").cast("bigint").alias("coverage"))
    return links.select("link_id").join(n, "link_id", "left").select("link_id", F.coalesce("coverage", F.lit(0)).cast("bigint").alias("coverage"))


def path_lengths(routing: DataFrame) -> DataFrame:
    return routing.groupBy("path_id").agg(F.count("*").cast("bigint").alias("n_links"))


def gravity_prior(links: DataFrame, routing: DataFrame, observed: DataFrame) -> DataFrame:
    """link_id and x: the mean over a link's paths of delay by length, 0 for a link that none takes."""
    share = observed.join(path_lengths(routing), "path_id").select("path_id", (F.col("b_ns") / F.col("n_links") / 1e6).alias("_s"))
    mean = routing.join(share, "path_id").groupBy("link_id").agg(F.avg("_s").alias("x"))
    return links.select("link_id").join(mean, "link_id", "left").select("link_id", F.coalesce("x", F.lit(0.0)).alias("x"))


def worst(estimate: DataFrame, n: int = 10) -> DataFrame:
    """The n largest estimates, ties by link_id; all for n = 0."""
    out = estimate.orderBy(F.desc("x"), "link_id")
    return out.limit(n) if n else out


def path_sums(routing: DataFrame, delays: DataFrame) -> DataFrame:
    """path_id and the sum of x over its links."""
    return routing.join(delays.select("link_id", "x"), "link_id").groupBy("path_id").agg(F.sum("x").alias("total"))


def gram(routing: DataFrame) -> DataFrame:
    """i, j and how many paths take both links: the Gram matrix, as a self-join on path."""
    other = routing.select("path_id", F.col("link_id").alias("j"))
    return routing.select("path_id", F.col("link_id").alias("i")).join(other, "path_id").groupBy("i", "j").agg(F.count("*").cast("bigint").alias("n"))


def projected(routing: DataFrame, observed: DataFrame) -> DataFrame:
    """link_id and the sum of its paths' delays in ns."""
    return routing.join(observed, "path_id").groupBy("link_id").agg(F.sum("b_ns").cast("bigint").alias("atb_ns"))


def residual(routing: DataFrame, observed: DataFrame, estimate: DataFrame) -> DataFrame:
    """One row: the Euclidean norm of Ax - b over all observed paths."""
    sums = observed.join(path_sums(routing, estimate), "path_id", "left")
    return sums.agg(F.sqrt(F.sum(F.pow(F.coalesce("total", F.lit(0.0)) - F.col("b"), 2))).alias("residual"))


def accuracy(judged: DataFrame) -> DataFrame:
    """rmse, mae, max_rel_err of x against truth, over identifiable links; relative errors only where truth exceeds 0.001."""
    d, ok = F.col("x") - F.col("truth"), F.col("identifiable")
    rel = F.when(ok & (F.col("truth") > 0.001), F.abs(d) / F.col("truth"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return judged.agg(zero(F.sqrt(F.avg(F.when(ok, d * d)))).alias("rmse"), zero(F.avg(F.when(ok, F.abs(d)))).alias("mae"), zero(F.max(rel)).alias("max_rel_err"))


def detection_rate(judged: DataFrame) -> DataFrame:
    """One row: which share of the k truly largest links is among the k largest estimates; k is a quarter of the identifiable links, 1 to 3."""
    ok = judged.filter("identifiable")
    best = lambda c, out: ok.orderBy(F.desc(c), "link_id").limit(3).select("link_id", F.row_number().over(Window.orderBy(F.desc(c), "link_id")).alias(out))
    k = ok.agg(F.when(F.count("*") > 0, F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.count("*") / 4)))).cast("bigint").alias("k"))
    hits = best("truth", "_t").join(best("x", "_e"), "link_id").join(k, (F.col("_t") <= F.col("k")) & (F.col("_e") <= F.col("k"))).agg(F.count("*").alias("_h"))
    return k.crossJoin(hits).select("k", F.coalesce(F.col("_h") / F.col("k"), F.lit(0.0)).alias("detection_rate"))


def half_width(samples: DataFrame, by: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """Half the width of the central interval of each group's samples by linear interpolation; 0 for fewer than two."""
    q = lambda p: F.percentile(F.col(value), F.lit(p))
    width = F.when(F.count(value) >= 2, (q(1 - alpha / 2) - q(alpha / 2)) / 2).otherwise(0.0)
    return samples.groupBy(*by).agg(F.count(value).cast("bigint").alias("n_samples"), width.alias("half_width"))


def conformal_rank(n: Column, alpha: float) -> Column:
    """Which order statistic of n residuals covers 1 - alpha, from 1."""
    return F.least(F.ceil((n + 1) * F.lit(1 - alpha)), n).cast("bigint")


def conformal_quantile(residuals: DataFrame, alpha: float = 0.1) -> DataFrame:
    """One row: n and the order statistic of the absolute residuals in column r."""
    ranked = numbered(residuals.select("r", "path_id"), [F.col("r"), F.col("path_id")], "_k")
    n = ranked.agg(F.count("*").cast("bigint").alias("n"))
    return ranked.join(n, F.col("_k") + 1 == conformal_rank(F.col("n"), alpha)).select("n", F.col("r").alias("q"))


def node_groups(links: DataFrame, estimate: DataFrame, covered: DataFrame) -> DataFrame:
    """Links by their source node: first link, how many, largest delay (0 at least), coverage."""
    all_ = links.join(estimate, "link_id").join(covered, "link_id")
    return all_.groupBy("src").agg(F.min("link_id").cast("bigint").alias("first_link"), F.count("*").cast("bigint").alias("n_links"), F.greatest(F.lit(0.0), F.max("x")).alias("max_delay"), F.sum("coverage").cast("bigint").alias("coverage"))


#: The orders that groups can be listed in.
GROUP_ORDERS = {
    "default": ["first_link"],
    "delay_desc": [F.desc, "max_delay"],
    "delay_asc": ["max_delay"],
    "name": ["src"],
    "coverage_desc": [F.desc, "coverage"],
}


def ordered_groups(groups: DataFrame, mode: str = "default") -> DataFrame:
    """Groups with their place in one of five orders; equals go by first link."""
    keys = GROUP_ORDERS[mode]
    first = keys[0](keys[1]) if len(keys) == 2 else F.col(keys[0])
    return numbered(groups, [first, F.col("first_link")], "place").withColumn("place", F.col("place") + 1)


def z_scores(estimate: DataFrame) -> DataFrame:
    """link_id, x and its distance from the mean in population deviations, 0 where there is no deviation."""
    whole = estimate.agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_sd"))
    return estimate.crossJoin(F.broadcast(whole)).select("link_id", "x", F.when(F.col("_sd") > 0, (F.col("x") - F.col("_m")) / F.col("_sd")).otherwise(0.0).alias("z"))


def top_statistics(judged: DataFrame, n: int) -> DataFrame:
    """Mean and population deviation of the identifiable links among the n largest."""
    return worst(judged, n).filter("identifiable").agg(F.count("*").cast("bigint").alias("n_links"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


def counts(judged: DataFrame) -> DataFrame:
    """Links, identifiable links, their share, congested ones (with and without regard to that) and negative estimates."""
    n = lambda c: F.count_if(c).cast("bigint")
    big, ok = F.col("x") > CONGESTED_MS, F.col("identifiable")
    share = F.coalesce(F.avg(ok.cast("double")), F.lit(0.0))
    return judged.agg(F.count("*").cast("bigint").alias("n_links"), n(ok).alias("n_identifiable"), share.alias("identifiable_share"), n(big & ok).alias("n_congested"), n(big).alias("n_congested_all"), n(F.col("x") < 0).alias("n_negative"))


def speed_violations(estimate: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """link_id, x, lower_bound and km of estimates below what light needs; negative ones violate a bound of 0, links with an unknown end are skipped."""
    end = lambda s: nodes.select(F.col("label").alias(f"_{s}"), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"))
    placed = estimate.join(links, "link_id").join(end("a"), F.col("src") == F.col("_a"), "left").join(end("b"), F.col("dst") == F.col("_b"), "left")
    known = lambda s: (F.coalesce(f"lat_{s}", F.lit(0.0)) != 0) | (F.coalesce(f"lon_{s}", F.lit(0.0)) != 0)
    km = scalar.great_circle_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    below = known("a") & known("b") & (F.col("x") < scalar.MS_PER_KM * km)
    negative = F.col("x") < 0
    out = placed.filter(negative | below)
    return out.select("link_id", "x", F.when(negative, 0.0).otherwise(scalar.MS_PER_KM * km).alias("lower_bound"), F.when(negative, 0.0).otherwise(km).alias("km"))


def em_steps(routing: DataFrame, observed: DataFrame, links: DataFrame, steps: int) -> DataFrame:
    """link_id and x after some steps of the multiplicative update, each two joins and two sums over the coordinates."""
    x = links.select("link_id", F.lit(1.0).alias("x"))
    for _ in range(steps):
        fit = routing.join(x, "link_id").groupBy("path_id").agg(F.sum("x").alias("_f")).filter("_f > 0")
        ratio = observed.join(fit, "path_id").select("path_id", (F.col("b") / F.col("_f")).alias("_r"))
        gain = routing.join(ratio, "path_id").groupBy("link_id").agg(F.avg("_r").alias("_g"))
        x = x.join(gain, "link_id", "left").select("link_id", (F.col("x") * F.coalesce("_g", F.lit(0.0))).alias("x"))
    return x


def same_link_set(paths: DataFrame) -> DataFrame:
    """path_id and its distinct links in order: what decides whether two paths are the same measurement."""
    return paths.groupBy("path_id").agg(F.array_sort(F.collect_set("link_id")).alias("links"))


def new_candidates(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose link set no existing path has."""
    return same_link_set(candidates).join(same_link_set(existing).select("links").distinct(), "links", "left_anti").select("path_id", F.size("links").cast("bigint").alias("n_links"))


def hash_sample(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows by the md5 of seed and key: the same at any partitioning."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(k)


