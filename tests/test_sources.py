import json

import pytest
from pyspark.sql import functions as F

from pathlight.plans import design, solve, uncertainty
from pathlight.sources import graphml, http, sinks, synthetic
from pathlight.sources import traces_json as J
from pathlight.streaming import rolling

RIPE = [
    {"type": "traceroute", "src_addr": "s", "dst_addr": "d", "timestamp": 10, "result": [
        {"hop": 1, "result": [{"x": "*"}, {"from": "a", "rtt": 1.5}]},
        {"hop": 2, "result": [{"x": "*"}, {"x": "*"}]},
        {"hop": 3, "result": [{"from": "m", "rtt": 2.0, "icmpext": {"obj": [{"mpls": [{"label": 3}]}]}}]},
        {"hop": 4, "result": [{"from": "d", "rtt": 31.5}, {"from": "d", "rtt": 30.25}, {"x": "*"}, {"from": "d", "rtt": 0}]}]},
    {"type": "ping"},
]


def one(spark, parse, doc):
    text = doc if isinstance(doc, str) else json.dumps(doc)
    return parse(spark.createDataFrame([(text,)], "value string")).collect()


def test_ripe(spark):
    (m,) = one(spark, J.ripe, RIPE)
    assert [(h.ip, h.anonymous, h.mpls) for h in m.hops] == [("a", False, False), ("", True, False), ("m", False, True), ("d", False, False)]
    assert m.rtts_ns == [31_500_000, 30_250_000] and m.src == "s"
    (m,) = one(spark, J.ripe, [{"type": "traceroute", "result": None}])
    assert m.hops == [] and m.rtts_ns == []


@pytest.mark.parametrize("parse", [J.ripe, J.scamper, J.mtr])
def test_truncated_documents_raise(spark, parse):
    with pytest.raises(Exception, match="JSON"):
        one(spark, parse, '[{"type": "trace')


def test_scamper(spark):
    trace = {"type": "trace", "src": "s", "dst": "d", "hops": [{"addr": "a", "probe_ttl": 1, "rtt": 1.5}, {"addr": "0.0.0.0", "probe_ttl": 2, "rtt": 2}, {"addr": "d", "probe_ttl": 2, "rtt": 3, "icmpext": {"mpls": [{"label": 1}]}}]}
    for doc in (trace, [trace, {"type": "other"}]):
        (m,) = one(spark, J.scamper, doc)
        assert [h.anonymous for h in m.hops] == [False, True, False] and m.hops[2].mpls
        assert m.rtts_ns == [2000, 3000]
    assert one(spark, J.scamper, {"type": "nothing"}) == []
    (m,) = one(spark, J.scamper, {"type": "trace", "hops": None})
    assert m.hops == []


def test_mtr(spark):
    (m,) = one(spark, J.mtr, {"report": {"mtr": {"src": "s", "dst": "d"}, "hubs": [{"host": "???", "Best": 0}, {"host": "d", "Best": 1.0, "Avg": 2.0, "Wrst": 3.0}]}})
    assert [h.anonymous for h in m.hops] == [True, False] and m.rtts_ns == [1_000_000, 2_000_000, 3_000_000]


def test_detection(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RIPE))
    (tmp_path / "b.json").write_text(json.dumps({"type": "trace", "src": "q", "hops": []}))
    assert sorted(r.src for r in J.detect(spark, str(tmp_path)).collect()) == ["q", "s"]


def test_esmond(spark):
    got = J.esmond_points(spark.createDataFrame([('[{"ts": 5, "val": 1.5}, {"ts": 6}]',)], "value string"), "a", "b").collect()
    assert [r.rtts_ns for r in got] == [[1_500_000], [0]] and got[0].hops == []


GRAPHML = """<graphml xmlns="http://graphml.graphdrawing.org/xmlns" xmlns:y="http://www.yworks.com/xml/graphml">
<key id="d0" for="node" attr.name="label" attr.type="string"/><key id="d1" for="node" attr.name="Latitude" attr.type="double"/><key id="d2" for="node" attr.name="Longitude" attr.type="double"/><key id="d3" for="node"/>
<graph><node id="a"><data key="d0">One</data><data key="d1">1.5</data><data key="d2">2.5</data></node>
<node id="b"><data key="d3"><y:ShapeNode><y:Geometry x="30.0" y="40.0"/><y:NodeLabel>Two</y:NodeLabel></y:ShapeNode></data></node><node id="c"/>
<edge source="a" target="b"/><edge source="b" target="a"/><edge source="b" target="zz"/><edge source="c" target="c"/></graph></graphml>"""


def test_graphml(spark, tmp_path):
    nodes, edges = graphml.parse(GRAPHML.encode())
    assert nodes == [("One", 1.5, 2.5), ("Two", 40.0, 30.0), ("n2", 0.0, 0.0)] and edges == [(0, 1), (1, 0), (2, 2)]
    (tmp_path / "t.graphml").write_text(GRAPHML)
    n, e = graphml.load(spark, str(tmp_path))
    assert n.count() == 3 and e.count() == 3 and n.collect()[0].topo == "t"
    with pytest.raises(ValueError):
        graphml.parse(b'<!DOCTYPE x [<!ENTITY a "b">]><graphml/>')


def test_http_retries_pages_and_waits(tmp_path):
    answers = iter([(429, {"Retry-After": "2"}, ""), (200, {}, "ok")])
    slept = []
    assert http.get("u", lambda _: next(answers), slept.append) == "ok" and slept == [2]
    with pytest.raises(http.HttpError, match=r"^status 500: x{200}\.\.\.$"):
        http.get("u", lambda _: (500, {}, "x" * 999))
    pages = {"b/measurements/?type=t": {"results": [{"id": 1}], "next": "n"}, "n": {"results": [{"id": 2}], "next": None}}
    service = http.MeasurementService("b", lambda u: (200, {}, json.dumps(pages[u])))
    assert [m["id"] for m in service.search("t")] == [1, 2]
    states = iter([1, 1, 4])
    slept = []
    service = http.MeasurementService("b", lambda u: (200, {}, "[]" if "results" in u else json.dumps({"status": {"id": next(states)}})), slept.append, http.Cache(str(tmp_path)))
    assert service.wait(7, 100) == "[]" and slept == [5, 10]
    assert service.cache.has(http.Cache.key(7, 0, 0)) and service.results(7) == "[]"
    assert http.resolve_uri("https://h/x/y", "/z") == "https://h/z"
    meta = json.dumps([{"event-types": [{"event-type": "packet-trace", "base-uri": "/p"}]}])
    assert http.latency_text("https://h/m", "a", "b", 60, lambda u: (200, {}, "[1]" if u.endswith("/p") else meta)) == "[1]"
    assert http.AsnResolver("r", lambda u: (200, {}, '{"data": {"asns": ["64500"]}}')).resolve("1.1.1.1") == 64500
    assert http.AsnResolver("r", lambda u: (404, {}, "")).resolve("1.1.1.1") == 0
    assert http.load_dotenv("# c\nA='x y'\nB=2\n", {"B": "1"}) == {"A": "x y", "B": "1"}


def test_sinks(spark):
    rows = spark.createDataFrame([(1, "a", "b", 1.25, None, True), (0, "b", "c", 12.0, float("inf"), False)], "link_id bigint, src string, dst string, x double, confidence double, identifiable boolean")
    lines = [r.line for r in sinks.csv_document(rows.withColumn("confidence", sinks.finite(F.col("confidence")))).collect()]
    assert lines == [sinks.CSV_HEADER, "0,b,c,12.000,0.000,false", "1,a,b,1.250,0.000,true"]
    doc = json.loads(sinks.json_document(rows, "nnls", 0.5, {"rank": 2, "condition_number": float("inf")}).collect()[0].text)
    assert [x["link_id"] for x in doc["links"]] == [0, 1] and "condition_number" not in doc["matrix_quality"]
    assert "style=dashed" in sinks.dot_document(rows).collect()[0].text and sinks.get("nothing") is None


def test_synthetic(spark):
    e = synthetic.barabasi_albert(spark, [("g", 20, 2, 1)]).collect()
    assert len(e) == 3 + 17 * 2 and all(r.src != r.dst for r in e)
    _, links = synthetic.waxman(spark, 30, 0.2, 0.1, 3)
    root = list(range(30))
    find = lambda v: v if root[v] == v else find(root[v])
    for r in links.collect():
        root[find(r.src)] = find(r.dst)
    assert len({find(v) for v in range(30)}) == 1


def rows(spark):
    truth = [5.0, 3.0, 7.0]
    paths = [[0], [1], [2], [0, 1], [1, 2], [0, 2], [0, 1, 2], []]
    return spark.createDataFrame([(i, float(sum(truth[k] for k in p)), p) for i, p in enumerate(paths)], "path_id bigint, b double, links array<int>")


def test_triangles_and_solutions(spark):
    import numpy as np

    from pathlight.plans import solvers

    t, m = solve.triangles(rows(spark).repartition(3), 3)
    s = solve.from_triangle(t, m, np.ones(3), None)
    assert m == 8 and np.allclose(solvers.nnls(s).x, [5, 3, 7])
    with pytest.raises(ValueError):
        solve.triangles(rows(spark), 5000)


def test_uncertainty_and_plans(spark):
    w = uncertainty.bootstrap(rows(spark), 3, "nnls", 10).collect()
    assert len(w) == 3 and all(r.half_width >= 0 for r in w)
    c = uncertainty.conformal(rows(spark), 3, "nnls").collect()
    assert len(c) == 3 and all(r.confidence >= 0 for r in c)
    alone = uncertainty.conformal(rows(spark).filter("path_id = 0"), 3, "nnls").collect()
    assert all(r.confidence == float("inf") for r in alone)
    plan = design.recommend(rows(spark).limit(0), rows(spark), 3, 10).orderBy("step").collect()
    assert [r.path_id for r in plan] == [0, 1, 2] and plan[-1]["rank"] == 3
    truth = spark.createDataFrame([(0, 5.0), (1, 3.0), (2, 7.0)], "link_id bigint, truth double")
    b = design.benchmark(rows(spark).filter("size(links) > 0"), truth, 3, ("nnls", "vardi"))
    assert all(r.rmse < 0.01 for r in b.filter("method = 'nnls'").collect()) and design.table(b).count() == 2


def test_streaming_windows(spark, tmp_path):
    pts = spark.createDataFrame([("a", "b", "2024-01-01 00:10:00", 5), ("a", "b", "2024-01-01 00:20:00", 3), ("a", "b", "2024-01-01 01:20:00", 9)], "src string, dst string, ts string, rtt_ns bigint").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.least_ns for r in rolling.least_by_window(pts).collect()) == [3, 9]
    pts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in"))
    q = rolling.solve_each_batch(stream, lambda df: rolling.least_by_window(df), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = rolling.least_by_window(stream).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT count(*) FROM w").collect()[0][0] >= 1


def test_collector_closes_and_keeps_errors(spark):
    rows = spark.range(5)
    with J.Collector(rows) as c:
        assert next(iter(c)).id == 0
    assert c.closed and list(c) == [] and c.error is None
    assert [r.id for r in J.Collector(rows)] == [0, 1, 2, 3, 4]
    bad = J.Collector(rows.select(F.raise_error(F.lit("broken")).alias("x")))
    with pytest.raises(Exception, match="broken"):
        list(bad)
    assert "broken" in str(bad.error) and bad.closed
