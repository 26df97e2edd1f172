"""From hops to a network: acceptance, visible hops, links in first-seen order, paths.

Everything that concerns one trace runs in windows over its hops, so one exchange by
trace serves the filters, the pairing and the paths. Global numbering happens only over
distinct nodes and links.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathlight.plans.numbering import numbered

#: Traces with a larger share of hops that did not answer are rejected.
MAX_ANONYMOUS = 0.3


def _trace(*extra: str):
    return Window.partitionBy("meas_idx").orderBy("pos", *extra)


def accepted(hops: DataFrame, most: float = MAX_ANONYMOUS) -> DataFrame:
    """Hops of the traces whose anonymous share is at most `most`, among all their hops."""
    share = F.avg(F.col("anonymous").cast("double")).over(Window.partitionBy("meas_idx"))
    return hops.withColumn("_share", share).filter(F.col("_share") <= most).drop("_share")


def accepted_traces(hops: DataFrame, most: float = MAX_ANONYMOUS) -> DataFrame:
    """meas_idx, n_hops and n_anonymous of the accepted traces."""
    n = F.count("*").cast("bigint").alias("n_hops")
    out = hops.groupBy("meas_idx").agg(n, F.sum(F.col("anonymous").cast("bigint")).alias("n_anonymous"))
    return out.filter(F.col("n_anonymous") / F.col("n_hops") <= most)


def visible(hops: DataFrame) -> DataFrame:
    """Without anonymous and MPLS hops; their neighbours become adjacent."""
    return hops.filter(~F.col("anonymous") & ~F.col("mpls"))


def pairs(seen: DataFrame, label: str = "ip") -> DataFrame:
    """meas_idx, pos, src and dst of consecutive visible hops that differ."""
    follower = F.lead(label).over(_trace())
    return seen.select("meas_idx", "pos", F.col(label).alias("src"), follower.alias("dst")).filter(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))


def nodes(seen: DataFrame, label: str = "ip") -> DataFrame:
    """node_id and label of every label of an accepted trace, in first-seen order."""
    first = seen.groupBy(F.col(label).alias("label")).agg(F.min(F.struct("meas_idx", "pos")).alias("_f"))
    return numbered(first.select("label", "_f.meas_idx", "_f.pos"), [F.col("meas_idx"), F.col("pos")], "node_id").select("node_id", "label")


def links(paired: DataFrame) -> DataFrame:
    """link_id, src, dst (labels as first seen) and the unordered pair lo, hi."""
    lo, hi = F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")
    first = paired.groupBy(lo, hi).agg(F.min(F.struct("meas_idx", "pos", "src", "dst")).alias("_f"))
    return numbered(first.select("lo", "hi", "_f.*"), [F.col("meas_idx"), F.col("pos")], "link_id").select("link_id", "src", "dst", "lo", "hi")


def paths(seen: DataFrame) -> DataFrame:
    """path_id of the traces with two visible hops or more; a path of one address has no links."""
    return seen.groupBy(F.col("meas_idx").alias("path_id")).agg(F.count("*").cast("bigint").alias("n_visible")).filter("n_visible >= 2")


def routing(paired: DataFrame, known: DataFrame) -> DataFrame:
    """path_id and link_id of the routing matrix's ones; a link counts once in a path."""
    keyed = paired.select(F.col("meas_idx").alias("path_id"), F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    return keyed.distinct().join(known.select("lo", "hi", "link_id"), ["lo", "hi"]).select("path_id", "link_id")


def observations(hops: DataFrame, drop_unanswered: bool = False) -> DataFrame:
    """path_id, b_ns and b (ms): the least sample at the last ttl; no sample counts 0 unless such traces are dropped."""
    last = F.max("ttl").over(Window.partitionBy("meas_idx"))
    sample = hops.withColumn("_last", last)
    at_end = (F.col("ttl") == F.col("_last")) & F.col("rtt_ns").isNotNull()
    out = sample.groupBy(F.col("meas_idx").alias("path_id")).agg(F.min(F.when(at_end, F.col("rtt_ns"))).alias("_m"))
    if drop_unanswered:
        out = out.filter("_m IS NOT NULL")
    ns = F.coalesce("_m", F.lit(0)).cast("bigint")
    return out.select("path_id", ns.alias("b_ns"), (ns / 1e6).alias("b"))


class Network:
    """What inference gives: nodes, links, the accepted paths, the routing matrix and what was observed.

    Each part is a table or a function that makes it; numbers are given out when a part is first asked for.
    """

    def __init__(self, nodes, links, paths, routing, observed):
        self._made: tuple[DataFrame | Callable[[], DataFrame], ...] = (nodes, links, paths, routing, observed)

    def _part(self, k: int) -> DataFrame:
        part = self._made[k]
        return part() if callable(part) else part

    nodes = cached_property(lambda self: self._part(0))
    links = cached_property(lambda self: self._part(1))
    paths = cached_property(lambda self: self._part(2))
    routing = cached_property(lambda self: self._part(3))
    observed = cached_property(lambda self: self._part(4))


def collapsed(seen: DataFrame, label: Column) -> DataFrame:
    """Visible hops under another label: hops without one go, runs of one label stand once."""
    out = seen.withColumn("label", label).filter("label IS NOT NULL")
    before = F.lag("label").over(_trace())
    return out.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.col("label"))).drop("_b")


def infer(hops: DataFrame, label: Column | None = None, most: float = MAX_ANONYMOUS) -> Network:
    """The network of hops under their addresses, or under another label with runs collapsed."""
    seen = visible(accepted(hops, most))
    name = "ip"
    if label is not None:
        seen, name = collapsed(seen, label), "label"
    paired = pairs(seen, name)
    chosen = paths(seen)
    seen_at = observations(hops).join(chosen.select("path_id"), "path_id", "left_semi")
    net = Network(lambda: nodes(seen, name), lambda: links(paired), chosen, lambda: routing(paired, net.links), seen_at)
    return net


def distinct_sequences(hops: DataFrame, traces: DataFrame) -> DataFrame:
    """meas_idx, src, dst, seq (answering addresses joined by |) and how many hops did not answer."""
    said = F.sort_array(F.collect_list(F.when(~F.col("anonymous"), F.struct("pos", "ip"))))
    per = hops.groupBy("meas_idx").agg(said.alias("_s"), F.sum(F.col("anonymous").cast("bigint")).alias("n_anonymous"))
    seq = F.array_join(F.transform("_s", lambda x: x["ip"]), "|")
    return traces.join(per.select("meas_idx", seq.alias("seq"), "n_anonymous"), "meas_idx")


def multipath(sequences: DataFrame) -> DataFrame:
    """src, dst, n_paths and the hop sequences of the pairs that take more than one."""
    out = sequences.groupBy("src", "dst").agg(F.array_sort(F.collect_set("seq")).alias("sequences"))
    return out.select("src", "dst", F.size("sequences").cast("bigint").alias("n_paths"), "sequences").filter("n_paths > 1")


def one_per_pair(sequences: DataFrame) -> DataFrame:
    """The trace of each pair with the fewest anonymous hops, the first of equals."""
    best = F.min(F.struct("n_anonymous", "meas_idx")).alias("_b")
    return sequences.groupBy("src", "dst").agg(best).select("src", "dst", F.col("_b.meas_idx").alias("meas_idx"), F.col("_b.n_anonymous").alias("n_anonymous"))
