"""What networks beyond a dense triangle use, held against the small forms."""

import numpy as np
from pyspark.sql import functions as F

from pathlight.operators import estimate as E
from pathlight.operators.infer import Network
from pathlight.plans import design, solve, solvers, uncertainty
from pathlight.plans.numbering import numbered
from pathlight.sources.synthetic import draw


def problem(spark, m=60, n=7, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.random((m, n)) < 0.4
    a[np.arange(n), np.arange(n)] = True
    b = a @ rng.uniform(1, 9, n) + rng.normal(0, 0.1, m)
    routing = spark.createDataFrame([(i, int(j)) for i in range(m) for j in np.flatnonzero(a[i])], "path_id bigint, link_id bigint")
    seen = spark.createDataFrame([(i, float(v), int(v * 1e6)) for i, v in enumerate(b)], "path_id bigint, b double, b_ns bigint")
    links = spark.createDataFrame([(j, f"a{j}", f"b{j}", f"a{j}", f"b{j}") for j in range(n)], "link_id bigint, src string, dst string, lo string, hi string")
    return a, b, Network(lambda: None, links, seen.select("path_id"), routing, seen)


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select(F.xxhash64("id").alias("h"), F.col("id").alias("_p"), F.lit(1).alias("_k")).repartition(7)
    got = numbered(rows, [F.desc("h")], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1000)) and [r.h for r in got] == sorted((r.h for r in got), reverse=True)
    assert numbered(rows.limit(0), [F.col("h")], "n").count() == 0


def test_relational_expectation_maximisation(spark, monkeypatch):
    a, b, net = problem(spark, 24, 4)
    want = solvers.em([np.flatnonzero(r) for r in a], b, 4, rounds=10, tolerance=0).x
    got = [r.x for r in solve.em_over_spark(net, 10, 5, 0).orderBy("link_id").collect()]
    assert np.allclose(got, want)
    small = solve.solve(net, "vardi-em")[0]
    assert np.isclose(small.residual, np.linalg.norm(a @ small.x - b))
    monkeypatch.setattr(solve, "em_over_spark", lambda net: spark.createDataFrame([(i, float(v)) for i, v in enumerate(want)], "link_id bigint, x double"))
    monkeypatch.setattr(solve, "MOST_ENTRIES", 3)
    assert np.allclose(solve.solve(net, "vardi-em")[0].x, want)
    monkeypatch.setattr(solve, "MOST_LINKS", 3)
    rows = solve.solution_rows(net, "em").collect()
    assert len(rows) == 4 and all(r.identifiable is None and r.method == "vardi-em" for r in rows)


def test_pieces_add_up(spark):
    a, b, net = problem(spark)
    rows = solve.rows_of(net.routing, net.observed).repartition(5)
    piece = solve.piece_of(rows, 7)
    x = np.linalg.lstsq(a.astype(float), b, rcond=None)[0]
    assert piece.m == 60 and np.allclose(solvers.truncated(piece.system(None)).x, x) and piece.hits.tolist() == a.sum(0).tolist()
    gravity = [r.x for r in E.gravity_prior(net.links, net.routing, net.observed).orderBy("link_id").collect()]
    assert np.allclose(piece.prior(), gravity, atol=1e-4)


def test_replicates_are_dealt_over_tasks(spark, monkeypatch):
    _, _, net = problem(spark)
    rows = solve.rows_of(net.routing, net.observed)
    whole = {r.link_id: r.half_width for r in uncertainty.bootstrap(rows, 7, "tsvd", 8).collect()}
    monkeypatch.setattr(uncertainty, "SHARD", 11)
    parts = {r.link_id: r.half_width for r in uncertainty.bootstrap(rows, 7, "tsvd", 8).collect()}
    assert len(parts) == 7 and all(np.isclose(parts[k], whole[k]) for k in whole) and min(whole.values()) > 0
    for method in ("vardi-em", "tomogravity"):
        assert uncertainty.bootstrap(rows, 7, method, 4).count() == 7


def test_conformal_against_one_table(spark):
    a, b, net = problem(spark)
    rows = solve.rows_of(net.routing, net.observed)
    order = [r.path_id for r in rows.orderBy(draw(42, "path_id"), "path_id").collect()]
    held, train = order[:12], order[12:]
    fit = np.linalg.lstsq(a[train].astype(float), b[train], rcond=None)[0]
    miss = np.sort(np.abs(a[held] @ fit - b[held]))
    k = min(int(np.ceil(13 * 0.95)), 12)
    got = uncertainty.conformal(rows, 7, "tsvd").orderBy("link_id").collect()
    assert all(np.isclose(r.confidence, miss[k - 1]) for r in got) and np.allclose([r.x for r in got], np.linalg.lstsq(a.astype(float), b, rcond=None)[0])


def test_joint_coverage_of_conformal_intervals(spark):
    """As the share of trials in which every residual of new paths lies within the interval's order."""
    rng = np.random.default_rng(8)
    truth, hit, trials = rng.uniform(1, 9, 5), 0, 12
    for t in range(trials):
        a = rng.random((80, 5)) < 0.5
        b = a @ truth + rng.normal(0, 0.5, 80)
        rows = spark.createDataFrame([(i, float(v), [int(j) for j in np.flatnonzero(r)]) for i, (r, v) in enumerate(zip(a, b, strict=True))], "path_id bigint, b double, links array<int>").coalesce(1)
        got = uncertainty.conformal(rows, 5, "nnls", alpha=0.1, seed=t).collect()
        hit += all(abs(r.x - truth[r.link_id]) <= r.confidence for r in got)
    assert hit >= 0.7 * trials


def test_plan_by_groups_is_the_plan_of_one_task(spark, monkeypatch):
    a, _, net = problem(spark)
    rows = solve.rows_of(net.routing, net.observed)
    known, new = rows.filter("path_id % 20 = 7"), rows.filter("path_id % 20 <> 7")
    monkeypatch.setattr(design, "GROUP", 9)
    got = [(r.step, r.path_id, r["rank"]) for r in design.recommend(known, new, 7, 10).orderBy("step").collect()]
    have = [a[i].astype(float) for i in range(60) if i % 20 == 7]
    want = []
    for i in range(60):
        if i % 20 != 7 and np.linalg.matrix_rank(np.array([*have, a[i]])) > np.linalg.matrix_rank(np.array(have)):
            have.append(a[i].astype(float))
            want.append((len(want) + 1, i, int(np.linalg.matrix_rank(np.array(have)))))
    assert got == want and design.rank(rows, 7) == np.linalg.matrix_rank(a)
