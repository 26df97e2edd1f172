import pytest
from pyspark.sql import functions as F

from pathlight.functions import scalar
from pathlight.operators import estimate as E
from pathlight.operators import graph as G
from pathlight.operators import infer as I

HOP = "meas_idx bigint, pos bigint, ttl bigint, ip string, rtt_ns bigint, anonymous boolean, mpls boolean"


def hops(spark, *traces):
    """Each trace lists labels; * is anonymous, a trailing ! marks MPLS."""
    rows = []
    for i, t in enumerate(traces):
        for p, ip in enumerate(t):
            rows.append((i, p, p + 1, ip.rstrip("!") if ip != "*" else "", (p + 1) * 1_000_000, ip == "*", ip.endswith("!")))
    return spark.createDataFrame(rows, HOP)


def shape(net):
    return net.nodes.count(), net.links.count(), net.paths.count()


def test_bridges(spark):
    assert shape(I.infer(hops(spark, ["A", "*", "C"]), most=0.5)) == (2, 1, 1)
    assert shape(I.infer(hops(spark, ["A", "B!", "C"]))) == (2, 1, 1)
    assert shape(I.infer(hops(spark, ["A", "*", "C"]))) == (0, 0, 0)
    assert shape(I.infer(hops(spark, ["A", "*", "*", "*"], ["X", "Y"]))) == (2, 1, 1)


def test_first_seen_order_and_orientation(spark):
    net = I.infer(hops(spark, ["B", "A"], ["A", "B", "C"]))
    assert [tuple(r) for r in net.nodes.orderBy("node_id").collect()] == [(0, "B"), (1, "A"), (2, "C")]
    assert [tuple(r)[:3] for r in net.links.orderBy("link_id").collect()] == [(0, "B", "A"), (1, "B", "C")]


def test_paths_without_links_and_single_hops(spark):
    net = I.infer(hops(spark, ["A", "A"], ["B"]))
    assert shape(net) == (2, 0, 1)


def test_empty_input(spark):
    net = I.infer(spark.createDataFrame([], HOP))
    assert shape(net) == (0, 0, 0)


def test_observation_is_least_sample_at_the_end(spark):
    rows = [(1, 0, 1, "A", 5_000_000, False, False), (1, 1, 2, "B", 9_000_000, False, False), (1, 2, 2, "C", 8_000_000, False, False), (2, 0, 1, "A", None, False, False)]
    got = {r.path_id: r.b for r in I.observations(spark.createDataFrame(rows, HOP)).collect()}
    assert got == {1: 8.0, 2: 0.0}
    assert I.observations(spark.createDataFrame(rows, HOP), True).count() == 1


def nodes(spark, *labels):
    return spark.createDataFrame(list(enumerate(labels)), "node_id bigint, label string")


def links(spark, *pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "link_id bigint, src string, dst string")


def test_alias_chain_and_pair(spark):
    ip = lambda k: f"10.0.0.{k}"
    n = nodes(spark, ip(0), ip(1), ip(5), ip(3), ip(2), ip(9))
    chain = links(spark, (ip(0), ip(1)), (ip(1), ip(5)), (ip(3), ip(2)), (ip(2), ip(9)))
    assert G.aliases(n, chain).select("rep").distinct().count() == 4
    pair = G.aliases(nodes(spark, ip(0), ip(3)), links(spark).limit(0))
    assert pair.select("rep").distinct().count() == 1
    assert G.aliases(nodes(spark, "::1", "host"), links(spark).limit(0)).select("rep").distinct().count() == 2


def graph(spark, *pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "link_id bigint, src bigint, dst bigint")


def test_shortest_paths(spark):
    got = {(r.src, r.dst): r.path for r in G.all_pairs(graph(spark, (0, 2), (2, 3), (0, 1), (1, 3), (5, 6))).collect()}
    assert got[0, 3] == [0, 1, 3] and got[1, 2] == [1, 0, 2]
    assert (0, 5) not in got and (5, 6) in got
    legs = G.path_links(G.all_pairs(graph(spark, (0, 1), (1, 2))), graph(spark, (0, 1), (1, 2)))
    assert [r.link_id for r in legs.filter("src = 0 AND dst = 2").orderBy("step").collect()] == [0, 1]


def test_build_drops_loops_and_repeats(spark):
    e = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 1, 2), (3, 0, 2)], "i bigint, src bigint, dst bigint")
    assert [tuple(r) for r in G.build(e).orderBy("link_id").collect()] == [(0, 2, 1), (1, 0, 2)]


def test_laplacian_rows_sum_to_zero(spark):
    rows = G.laplacian(graph(spark, (0, 1), (1, 2), (7, 8))).groupBy("i").agg(F.sum("value").alias("s")).collect()
    assert len(rows) == 3 and all(r.s == 0 for r in rows)


def test_speed_of_light(spark):
    places = spark.createDataFrame([(0, 47.37, 8.54), (1, 51.51, -0.13), (2, 0.0, 0.0)], "label bigint, lat double, lon double")
    net = graph(spark, (0, 1), (1, 2))
    for x, n in (((10.0, 5.0), 0), ((-1.0, 5.0), 1), ((0.5, 5.0), 1)):
        est = spark.createDataFrame(list(enumerate(x)), "link_id bigint, x double")
        assert E.speed_violations(est, net, places).count() == n
    km = spark.range(1).select(scalar.great_circle_km(F.lit(47.37), F.lit(8.54), F.lit(51.51), F.lit(-0.13))).collect()[0][0]
    assert abs(km - 779) < 3


def test_multipath_choice(spark):
    h = hops(spark, ["A", "*", "C"], ["A", "B", "C"], ["A", "D", "C"])
    t = spark.createDataFrame([(0, "s", "d"), (1, "s", "d"), (2, "s", "d")], "meas_idx bigint, src string, dst string")
    seq = I.distinct_sequences(h, t)
    assert I.multipath(seq).collect()[0].n_paths == 3
    assert I.one_per_pair(seq).collect()[0].meas_idx == 1


def test_collapsing_skips_unresolved_hops(spark):
    h = hops(spark, ["a", "b", "c", "d"]).withColumn("asn", F.expr("CASE pos WHEN 0 THEN 7 WHEN 1 THEN NULL WHEN 2 THEN 7 ELSE 9 END"))
    assert [r.label for r in I.collapsed(I.visible(h), F.col("asn")).orderBy("pos").collect()] == [7, 9]


@pytest.mark.parametrize("header, seconds", [("3", 3.0), ("-1", 5.0), ("x", 5.0), (None, 5.0), ("0", 0.1)])
def test_retry_header(spark, header, seconds):
    c = F.lit(header).cast("string")
    assert spark.range(1).select(scalar.retry_after_seconds(c)).collect()[0][0] == seconds


def test_inference_options(spark):
    h = hops(spark, ["10.0.0.0", "*", "10.0.0.9"], ["10.0.0.0", "10.0.0.5", "10.0.0.9"], ["10.0.0.3", "10.0.0.17"])
    t = spark.createDataFrame([(0, "s", "d"), (1, "s", "d"), (2, "q", "d")], "meas_idx bigint, src string, dst string")
    assert shape(G.infer_network(h, most=0.5)) == (5, 4, 3)
    assert shape(G.infer_network(h, t, 0.5, one_per_pair=True)) == (5, 3, 2)
    merged = G.infer_network(h, t, 0.5, one_per_pair=True, merge_aliases=True)
    assert shape(merged) == (4, 3, 2) and merged.routing.count() == 3
    with pytest.raises(ValueError):
        G.infer_network(h, most=1.5)


def test_guards(spark):
    from pathlight.plans import solve

    with pytest.raises(ValueError, match="paths"):
        solve.guard(I.infer(hops(spark, ["A"])))
    with pytest.raises(ValueError, match="links"):
        solve.guard(I.infer(hops(spark, ["A", "A"])))
