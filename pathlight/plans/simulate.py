"""Simulated delays: propagation, congestion and noise, each draw a hash of seed and key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlight.functions import scalar
from pathlight.plans.lineage import cut
from pathlight.sources.synthetic import draw, uniform


#: A path's number is that of its first node times this, and its last node.
PAIR = 1_000_000


@dataclass(frozen=True)
class SimConfig:
    noise_scale: float = 0.1
    noise_model: str = "lognormal"
    congested_links: int = 2
    congestion_factor: float = 5.0
    samples: int = 3
    seed: int = 42
    path_fraction: float = 1.0

    def __post_init__(self):
        if self.noise_scale < 0 or not 0 < self.path_fraction <= 1 or self.congestion_factor <= 0 or self.samples < 1:
            raise ValueError("noise must be 0 or more, the path fraction in (0, 1], the congestion factor above 0, samples 1 or more")


def propagation(links: DataFrame, places: DataFrame, otherwise: Column) -> DataFrame:
    """links (i, j) with truth: 0.005 ms per km between places, `otherwise` where that is not above 0."""
    end = lambda s, c: places.select(F.col("label").alias(c), F.col("lat").alias(f"_lat{s}"), F.col("lon").alias(f"_lon{s}"))
    km = scalar.great_circle_km(F.col("_lat1"), F.col("_lon1"), F.col("_lat2"), F.col("_lon2"))
    ms = scalar.MS_PER_KM * km
    good = F.coalesce((ms > 0) & ~F.isnan(ms), F.lit(False))
    return links.join(end(1, "i"), "i").join(end(2, "j"), "j").withColumn("truth", F.when(good, ms).otherwise(otherwise)).drop("_lat1", "_lon1", "_lat2", "_lon2")


def congest(truth: DataFrame, cfg: SimConfig) -> DataFrame:
    """link_id, x: some links, chosen by hash, are slower by the factor. Only for a factor above 1."""
    if cfg.congested_links <= 0 or cfg.congestion_factor <= 1:
        return truth
    chosen = truth.orderBy(draw(cfg.seed, F.lit("congested"), "link_id"), "link_id").limit(cfg.congested_links).select(F.col("link_id").alias("_c"))
    return truth.join(F.broadcast(chosen), F.col("link_id") == F.col("_c"), "left").withColumn("x", F.when(F.col("_c").isNotNull(), F.col("x") * cfg.congestion_factor).otherwise(F.col("x"))).drop("_c")


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal draw from two hashed uniforms."""
    u = F.greatest(uniform(seed, F.lit("u"), *keys), F.lit(2.0**-53))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * uniform(seed, F.lit("v"), *keys))


def noisy(value: Column, z: Column, scale: float, model: str) -> Column:
    if scale <= 0:
        return value
    if model == "gaussian":
        return F.greatest(F.lit(0.0), value + z * scale * value)
    return value * F.exp(z * scale)


def samples(sums: DataFrame, cfg: SimConfig) -> DataFrame:
    """path_id, k and b: noisy samples of each path's noise-free total."""
    draws = sums.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(cfg.samples))))
    return draws.select("path_id", "k", noisy(F.col("total"), normal(cfg.seed, "path_id", "k"), cfg.noise_scale, cfg.noise_model).alias("b"))


def observe(sums: DataFrame, cfg: SimConfig) -> DataFrame:
    """path_id and b: the least of each path's samples; a fraction of the paths, chosen by hash."""
    out = samples(sums, cfg).groupBy("path_id").agg(F.min("b").alias("b"))
    if cfg.path_fraction < 1:
        out = out.filter(uniform(cfg.seed, F.lit("path"), "path_id") < cfg.path_fraction)
    return out


@dataclass(frozen=True)
class Simulated:
    """A simulated measurement: the network's links and routing, the true delays and what would be seen of them."""

    nodes: DataFrame
    links: DataFrame
    routing: DataFrame
    truth: DataFrame
    observed: DataFrame


def simulate(nodes: DataFrame, edges: DataFrame, cfg: SimConfig | None = None) -> Simulated:
    """Delays on a topology: propagation where places are known (else 1 to 10 ms by hash), congestion, all shortest paths, noise.

    nodes: node_id, label, lat, lon; edges: i, src, dst. Paths are numbered by their ends. Tables are written once.
    """
    from pathlight.operators import estimate, graph

    cfg = cfg or SimConfig()
    links = cut(graph.build(edges.select("i", "src", "dst")))
    legs = graph.path_links(graph.all_pairs(links), links)
    routing = cut(legs.select((F.col("src") * PAIR + F.col("dst")).alias("path_id"), "link_id"))
    places = nodes.select(F.col("node_id").alias("label"), "lat", "lon")
    ends = links.select("link_id", F.col("src").alias("i"), F.col("dst").alias("j"))
    plain = propagation(ends, places, 1 + 9 * uniform(cfg.seed, F.lit("delay"), "link_id")).select("link_id", F.col("truth").alias("x"))
    truth = cut(congest(plain, cfg))
    return Simulated(nodes, links, routing, truth, cut(observe(estimate.path_sums(routing, truth), cfg)))
