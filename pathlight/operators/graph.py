"""Graphs as tables of nodes and links: neighbours, paths, aliases, Laplacian."""

from __future__ import annotations

from itertools import count, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlight.functions import scalar
from pathlight.operators import infer
from pathlight.plans.lineage import cut
from pathlight.plans.numbering import numbered


def build(edges: DataFrame) -> DataFrame:
    """link_id, src, dst of an undirected simple graph: (i, src, dst) rows in order i, the first of a pair stays, self-loops go."""
    first = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(F.min(F.struct("i", "src", "dst")).alias("_f"))
    return numbered(first.select("lo", "hi", "_f.*"), [F.col("i")], "link_id").select("link_id", "src", "dst")


def both_ways(links: DataFrame) -> DataFrame:
    """node, neighbor and link_id in either direction."""
    there = links.select(F.col("src").alias("node"), F.col("dst").alias("neighbor"), "link_id")
    return there.unionByName(links.select(F.col("dst").alias("node"), F.col("src").alias("neighbor"), "link_id"))


def neighbors(links: DataFrame) -> DataFrame:
    return both_ways(links).groupBy("node").agg(F.array_sort(F.collect_set("neighbor")).alias("neighbors"))


def shortest_paths(links: DataFrame, sources: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """src, dst, hops and path of every reachable pair: fewest hops, and of equals the path whose nodes come first in order.

    Frontiers of all sources grow a hop at a time by joins until none does, or for `most` hops. That tie
    rule is what a breadth-first search that visits neighbours in ascending order gives.
    sources: rows of `node`; all nodes if left out.
    """
    step = cut(both_ways(links).select("node", "neighbor").distinct())
    start = sources.select("node") if sources is not None else step.select("node").distinct()
    front = cut(start.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.array("node").alias("path")))
    reached = front
    for _ in islice(count(), most):
        grown = front.join(step, F.col("dst") == F.col("node")).select("src", F.col("neighbor").alias("dst"), F.concat("path", F.array("neighbor")).alias("path"))
        grown = grown.groupBy("src", "dst").agg(F.min("path").alias("path")).join(reached.select("src", "dst"), ["src", "dst"], "left_anti")
        front = cut(grown)
        if front.isEmpty():
            break
        reached = cut(reached.unionByName(front))
    return reached.filter("src <> dst").select("src", "dst", (F.size("path") - 1).cast("bigint").alias("hops"), "path")


def all_pairs(links: DataFrame, most: int | None = None) -> DataFrame:
    """The shortest path of each unordered pair, from its smaller node."""
    return shortest_paths(links, most=most).filter("src < dst")


def path_links(found: DataFrame, links: DataFrame) -> DataFrame:
    """src, dst, step and link_id along shortest paths."""
    legs = found.select("src", "dst", F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"))).alias("step", "_e"))
    legs = legs.select("src", "dst", F.col("step").cast("bigint").alias("step"), F.least("_e.a", "_e.b").alias("lo"), F.greatest("_e.a", "_e.b").alias("hi"))
    return legs.join(links.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "link_id"), ["lo", "hi"]).select("src", "dst", "step", "link_id")


def alias_candidates(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (i, j), i before j, of labels in one /30 but not one /31 that no link joins. links: labels src and dst."""
    known = nodes.withColumn("_n", scalar.ipv4_number(F.col("label"))).filter("_n IS NOT NULL")
    one = known.select(F.col("node_id").alias("i"), F.col("label").alias("li"), F.col("_n").alias("ni"), scalar.slash30(F.col("_n")).alias("_k"))
    two = known.select(F.col("node_id").alias("j"), F.col("label").alias("lj"), F.col("_n").alias("nj"), scalar.slash30(F.col("_n")).alias("_k"))
    both = one.join(two, "_k").filter((F.col("i") < F.col("j")) & (scalar.slash31(F.col("ni")) != scalar.slash31(F.col("nj"))))
    joined = links.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    return both.withColumns({"lo": F.least("li", "lj"), "hi": F.greatest("li", "lj")}).join(joined, ["lo", "hi"], "left_anti").select("i", "j")


def aliases(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """label and rep: the representative of each label. A node points to its last candidate before it; at most four addresses share a /30, so three steps reach the end."""
    parent = alias_candidates(nodes, links).groupBy(F.col("j").alias("node_id")).agg(F.max("i").alias("parent"))
    out = nodes.join(parent, "node_id", "left").withColumn("root", F.coalesce("parent", "node_id"))
    up = parent.select(F.col("node_id").alias("_n"), F.col("parent").alias("_p"))
    for _ in range(3):
        out = out.join(up, F.col("root") == F.col("_n"), "left").withColumn("root", F.coalesce("_p", "root")).drop("_n", "_p")
    named = nodes.select(F.col("node_id").alias("root"), F.col("label").alias("rep"))
    return out.join(named, "root").select("node_id", "label", "rep")


def merged_links(links: DataFrame, named: DataFrame) -> DataFrame:
    """Links between representatives, numbered anew in the order of the old numbers."""
    a = named.select(F.col("label").alias("src"), F.col("rep").alias("_s"))
    b = named.select(F.col("label").alias("dst"), F.col("rep").alias("_d"))
    return build(links.join(a, "src").join(b, "dst").select(F.col("link_id").alias("i"), F.col("_s").alias("src"), F.col("_d").alias("dst")))


def link_adjacency(links: DataFrame) -> DataFrame:
    """a and b: links that share an endpoint."""
    ends = links.select("link_id", F.explode(F.array("src", "dst")).alias("_e"))
    other = ends.select(F.col("link_id").alias("b"), "_e")
    return ends.select(F.col("link_id").alias("a"), "_e").join(other, "_e").filter("a <> b").select("a", "b").distinct()


def link_degrees(links: DataFrame) -> DataFrame:
    """link_id and degree: how many links each one touches. Two links share one end at most, so the degrees of a link's ends say it, without pairs of links."""
    at = links.select(F.explode(F.array("src", "dst")).alias("_e")).groupBy("_e").agg(F.count("*").alias("_d"))
    end = lambda s: links.select("link_id", F.col(s).alias("_e")).join(at, "_e").select("link_id", "_d")
    return end("src").unionByName(end("dst")).groupBy("link_id").agg((F.sum("_d") - 2).cast("bigint").alias("degree"))


def laplacian(links: DataFrame) -> DataFrame:
    """i, j and value of degree minus adjacency of the link graph. A link that touches none has a zero row: no entry but 0 on the diagonal."""
    off = link_adjacency(links).select(F.col("a").alias("i"), F.col("b").alias("j"), F.lit(-1).cast("bigint").alias("value"))
    return off.unionByName(link_degrees(links).select(F.col("link_id").alias("i"), F.col("link_id").alias("j"), F.col("degree").alias("value")))


def pairs_in_order(nodes: DataFrame) -> DataFrame:
    """All pairs i < j of node_id: a stated theta join over nodes, never over data rows."""
    return nodes.select(F.col("node_id").alias("i")).join(nodes.select(F.col("node_id").alias("j")), F.col("i") < F.col("j"))


def infer_network(hops: DataFrame, traces: DataFrame | None = None, most: float | None = None, one_per_pair: bool = False, merge_aliases: bool = False) -> infer.Network:
    """Inference with its options. most: None stands for the default. one_per_pair keeps, of the traces of a pair, the one with the fewest anonymous hops; merge_aliases names each hop by its alias's representative, so that links and paths agree."""
    most = infer.MAX_ANONYMOUS if most is None else most
    if not 0 <= most <= 1:
        raise ValueError("the share of anonymous hops must be between 0 and 1")
    if one_per_pair:
        if traces is None:
            raise ValueError("choosing one trace per pair needs the traces' ends")
        hops = hops.join(infer.one_per_pair(infer.distinct_sequences(hops, traces)).select("meas_idx"), "meas_idx", "left_semi")
    found = infer.infer(hops, most=most)
    if not merge_aliases:
        return found
    named = aliases(found.nodes, found.links).select(F.col("label").alias("_ip"), "rep")
    rows = hops.join(named, hops["ip"] == named["_ip"], "left").drop("_ip")
    return infer.infer(rows, F.coalesce("rep", "ip"), most)
