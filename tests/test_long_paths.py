from collections import deque

import pytest

from pathlight import catalogue
from pathlight.operators import graph as G


def brute(pairs, start):
    """Paths of a breadth-first search that visits neighbours in ascending order."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    paths, queue = {start: [start]}, deque([start])
    while queue:
        for n in sorted(near[(x := queue.popleft())]):
            if n not in paths:
                paths[n] = [*paths[x], n]
                queue.append(n)
    return {n: p for n, p in paths.items() if n != start}


def test_paths_longer_than_64_hops(spark):
    pairs = [(i, i + 1) for i in range(68)] + [(0, 100), (100, 2), (30, 101), (101, 32), (200, 201)]
    links = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "link_id bigint, src bigint, dst bigint")
    one = spark.createDataFrame([(0,)], "node bigint")
    got = {r.dst: r.path for r in G.shortest_paths(links, one).collect()}
    assert got == brute(pairs, 0) and len(got[68]) == 69


@pytest.mark.parametrize("name", ["g04_shortest_path_all_links", "g05_apsp_all_links"])
def test_queries_run_over_all_links(spark, monkeypatch, name):
    pairs = [(i, i + 1) for i in range(1, 8)]
    links = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "link_id bigint, src bigint, dst bigint")
    monkeypatch.setattr(catalogue, "network", lambda *_: type("Net", (), {"links": links}))
    got = {(r.src, r.dst): r.hops for r in catalogue.QUERIES[name](spark, "").collect()}
    assert got == {(a, b): b - a for a in (range(1, 9) if "apsp" in name else [1]) for b in range(a + 1, 9)}
