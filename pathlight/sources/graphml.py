"""GraphML topologies: one file is one graph, parsed in a task of its own."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

NODES = "topo string, kind string, i bigint, label string, lat double, lon double, src bigint, dst bigint"
_LABEL = re.compile(r"<(?:\w+:)?NodeLabel[^>]*>([^<]*)<")
_PLACE = re.compile(r"<(?:\w+:)?Geometry\b([^>]*)>")
_ATTRIBUTE = re.compile(r"\b([xy])\s*=\s*\"([^\"]*)\"")


def drawn_label(xml: str) -> str:
    """The text of the first node label of a drawing, as it stands."""
    m = _LABEL.search(xml)
    return m[1].strip() if m else ""


def drawn_place(xml: str) -> tuple[float, float] | None:
    """(y, x) of the first geometry that has both as numbers: pixels that stand in for degrees."""
    for m in _PLACE.finditer(xml):
        at = dict(_ATTRIBUTE.findall(m[1]))
        try:
            return float(at["y"]), float(at["x"])
        except (KeyError, ValueError):
            continue
    return None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parse(data: bytes) -> tuple[list[tuple[str, float, float]], list[tuple[int, int]]]:
    """Nodes (label, lat, lon) in document order and edges between their places. Edges with an unknown end are left out."""
    if b"<!ENTITY" in data:
        raise ValueError("entities are not allowed")
    root = ET.fromstring(data)
    names = {k.get("id"): (k.get("attr.name") or "").lower() for k in root.iter() if _local(k.tag) == "key"}
    nodes, place, edges = [], {}, []
    elements = [e for e in root.iter() if _local(e.tag) in ("node", "edge")]
    for e in (e for e in elements if _local(e.tag) == "node"):
        label, drawn, lat, lon, pixels = "", "", None, None, None
        for d in (d for d in e if _local(d.tag) == "data"):
            name, text = names.get(d.get("key"), ""), (d.text or "").strip()
            xml = "".join(ET.tostring(c, encoding="unicode") for c in d)
            if name == "label" and text:
                label = text
            elif name in ("latitude", "longitude"):
                try:
                    lat, lon = (float(text), lon) if name == "latitude" else (lat, float(text))
                except ValueError:
                    pass
            drawn = drawn or drawn_label(xml)
            pixels = pixels or drawn_place(xml)
        if lat is None and lon is None and pixels:
            lat, lon = pixels
        place[e.get("id")] = len(nodes)
        nodes.append((label or drawn or f"n{len(nodes)}", lat or 0.0, lon or 0.0))
    for e in (e for e in elements if _local(e.tag) == "edge"):
        a, b = place.get(e.get("source")), place.get(e.get("target"))
        if a is not None and b is not None:
            edges.append((a, b))
    return nodes, edges


def parsed(files: DataFrame) -> DataFrame:
    """The nodes and edges, by kind, of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for name, content in zip(df["path"], df["content"], strict=True):
                topo = name.rpartition("/")[2].removesuffix(".graphml")
                nodes, edges = parse(bytes(content))
                rows = [(topo, "node", i, a, x, y, None, None) for i, (a, x, y) in enumerate(nodes)] + [(topo, "edge", i, None, None, None, a, b) for i, (a, b) in enumerate(edges)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")]).astype({"i": "Int64", "src": "Int64", "dst": "Int64"})

    return files.select("path", "content").mapInPandas(run, NODES)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (topo, node_id, label, lat, lon) and edges (topo, i, src, dst) of the files; `graph.build` makes links of the latter."""
    both = parsed(spark.read.format("binaryFile").load(path))
    nodes = both.filter("kind = 'node'").selectExpr("topo", "i AS node_id", "label", "lat", "lon")
    return nodes, both.filter("kind = 'edge'").select("topo", "i", "src", "dst")
