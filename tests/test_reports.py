import json

import numpy as np
import pytest

from pathlight import cli, report
from pathlight.plans import design, simulate, solvers
from pathlight.sources import graphml

#: A well-known backbone of eleven cities.
CITIES = ["Seattle", "Sunnyvale", "Los Angeles", "Denver", "Kansas City", "Houston", "Atlanta", "Indianapolis", "Chicago", "Washington", "New York"]
LINES = [(0, 1), (0, 3), (1, 2), (1, 3), (2, 5), (3, 4), (4, 5), (4, 7), (5, 6), (6, 7), (6, 9), (7, 8), (8, 10), (9, 10)]


def document(cities=CITIES, lines=LINES):
    nodes = "".join(f'<node id="{i}"><data key="l">{c}</data></node>' for i, c in enumerate(cities))
    edges = "".join(f'<edge source="{a}" target="{b}"/>' for a, b in lines)
    return f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="l" for="node" attr.name="label"/><graph>{nodes}{edges}</graph></graphml>'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("graphs")
    (at / "backbone.graphml").write_text(document())
    (at / "broken.graphml").write_text("<graphml")
    return at


def test_style_and_padding():
    on, off = report.Style(True), report.Style(False)
    assert on("red", "x") == "\x1b[31mx\x1b[0m" and off("red", "x") == "x"
    assert report.pad(on("bold", "ab"), 4) == "\x1b[1mab\x1b[0m  " and report.pad("abcdef", 3) == "abcdef"
    assert not report.Style.detect(open("/dev/null")).on  # noqa: SIM115
    assert report.number(float("inf"), 1) == report.number(None, 1) == "N/A" and report.number(1.25, 1) == "1.2"
    assert [report.band(x) for x in (-1, 0, 4.9, 5, 19.9, 20)] == ["red", "green", "green", "yellow", "yellow", "red"]


def test_scan_report():
    rows = [{"link_id": 4, "src": "a", "dst": "b", "x": 31.0, "identifiable": True}, {"link_id": 2, "src": "c", "dst": "d", "x": 2.0, "identifiable": False}]
    quality = solvers.audit(np.eye(2), 2)
    args = (rows, {"n_links": 2, "n_identifiable": 1, "identifiable_share": 0.5, "n_congested": 1}, {"mean": 31.0, "sd": 0.0}, "nnls", 0.5, quality, report.Style(False))
    whole, quiet = report.scan_lines(*args, top=1), report.scan_lines(*args, quiet=True)
    assert "nnls: 2 links, 1 identifiable (50.0%)" in whole[0] and "1 more" in whole and "congested: 1" in whole and whole[-1] == "mean 31.000 ms ± 0.000"
    assert len(quiet) == 3 and quiet[-1].endswith("NO")


def test_accuracy_on_the_backbone(spark, folder):
    nodes, edges = graphml.load(spark, str(folder / "backbone.graphml"))
    clean = simulate.SimConfig(noise_scale=0.0, congested_links=0, samples=1)
    sim, table = cli.benched(spark, nodes, edges, clean, ("tsvd", "tikhonov", "nnls"))
    rows = table.collect()
    assert sim.links.count() == 14 and {(r["n_links"], r["n_paths"], r["rank"]) for r in rows} == {(14, 55, 14)}
    assert all(r["rmse"] <= 0.01 and r["identifiable_share"] == 1 and 3.5 < r["condition"] < 5 for r in rows)
    noisy = cli.benched(spark, nodes, edges, simulate.SimConfig(), solvers.METHODS)[1].collect()
    assert len(noisy) == 8 and all(0 < r["rmse"] < 25 for r in noisy if r["method"] in ("nnls", "vardi-em", "laplacian", "tikhonov"))


def test_commands(spark, folder, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["plan", str(folder / "backbone.graphml"), "--budget", "3"]) == 0
    out = capsys.readouterr().out
    assert out.count("+1") == 3 and "Seattle" in out and "11 of 14 links stay unidentifiable" in out
    assert cli.main(["benchmark", str(folder), "--methods", "tsvd,vardi"]) == 0
    got = capsys.readouterr()
    assert got.out.count("backbone") == 2 and "broken" in got.err and got.out.split("\n")[0].split()[:3] == ["topology", "solver", "nodes"]
    assert cli.main(["simulate", str(folder / "backbone.graphml")]) == 0
    out = capsys.readouterr().out
    assert "RMSE" in out and "Denver" in out and out.count("\n") >= 18
    hops = lambda *ips: [{"hop": i + 1, "result": [{"from": ip, "rtt": 3.0 * (i + 1)}]} for i, ip in enumerate(ips)]
    traces = [{"type": "traceroute", "src_addr": "s", "dst_addr": ips[-1], "timestamp": k, "result": hops(*ips)} for k, ips in enumerate((("10.0.0.1", "10.0.0.5"), ("10.0.0.1", "10.0.0.5", "10.0.0.9"), ("10.0.0.5", "10.0.0.9")))]
    (folder / "traces.json").write_text(json.dumps(traces))
    assert cli.main(["scan", str(folder / "traces.json"), "--format", "table", "--top", "1"]) == 0
    out = capsys.readouterr().out
    assert "nnls: 2 links" in out and "1 more" in out and "congested: 0" in out
    assert cli.main(["scan", str(folder / "traces.json")]) == 0
    assert json.loads(capsys.readouterr().out)["matrix_quality"]["rank"] == 2
    assert cli.main(["scan"]) == 2 and cli.main(["plan", "x", "--budget", "-1"]) == 2


def test_scan_by_measurement(spark, capsys, monkeypatch, tmp_path):
    from pathlight.sources import http

    monkeypatch.setattr(cli, "session", lambda: spark)
    asked = []
    body = json.dumps([{"type": "traceroute", "src_addr": "s", "dst_addr": "d", "timestamp": 1, "result": [{"hop": 1, "result": [{"from": "a", "rtt": 1.0}]}, {"hop": 2, "result": [{"from": "b", "rtt": 2.0}]}]}])

    def results(self, measurement, start=0, stop=0):
        asked.append((self.base, measurement, start, stop, self.cache is not None))
        return body

    monkeypatch.setattr(http.MeasurementService, "results", results)
    assert cli.main(["scan", "--measurement", "7", "--service", "http://x/", "--start", "5", "--cache", str(tmp_path), "--format", "csv", "--method", "tsvd"]) == 0
    assert asked == [("http://x", 7, 5, 0, True)] and capsys.readouterr().out.split("\n")[1].startswith("0,a,b,2.000")


def test_rank_by_triangle(spark):
    rows = spark.createDataFrame([(i, 0.0, p) for i, p in enumerate(([0], [1], [0, 1], [2, 3]))], "path_id bigint, b double, links array<int>")
    assert design.rank(rows, 4) == 3
