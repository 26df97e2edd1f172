"""Command line: scan, simulate, benchmark, plan, version."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "0.1.0"


def session() -> SparkSession:
    return SparkSession.builder.appName("pathlight").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def check(args: argparse.Namespace) -> None:
    """Ranges of what was asked for."""
    if not 0 <= getattr(args, "max_anonymous", 0) <= 1:
        raise ValueError("--max-anonymous must be between 0 and 1")
    if getattr(args, "command", "") == "scan" and (args.file is None) == (args.measurement is None):
        raise ValueError("scan wants a trace file or --measurement")
    if getattr(args, "top", 0) < 0 or getattr(args, "budget", 0) < 0:
        raise ValueError("--top and --budget must not be negative")


def traces(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Measurements of a file, or of a measurement service by number, whose answers are kept in a folder."""
    from pathlight.sources import http, traces_json

    if args.file:
        return traces_json.detect(spark, args.file)
    cache = http.Cache(args.cache) if args.cache else None
    service = http.MeasurementService(args.service, cache=cache)
    text = service.wait(args.measurement, args.wait) if args.wait else service.results(args.measurement, args.start, args.stop)
    return traces_json.ripe(spark.createDataFrame([(text,)], "value string"))


def scan(args: argparse.Namespace) -> None:
    from pathlight import report
    from pathlight.operators import estimate, infer
    from pathlight.plans import solve, solvers
    from pathlight.plans.numbering import numbered
    from pathlight.sources import sinks, traces_json

    spark, style = session(), report.Style.detect()
    found = numbered(traces(spark, args), [F.col("ts"), F.col("src"), F.col("dst")], "meas_idx")
    net = solve.settled(infer.infer(traces_json.exploded_hops(found), most=args.max_anonymous))
    answer, s = solve.solve(net, args.method)
    s = s or solve.system_of(net, False)
    q = solvers.audit(s.r, s.m)
    lost = set(q.unidentifiable)
    estimates = spark.createDataFrame([(i, float(v), i not in lost) for i, v in enumerate(answer.x)], "link_id bigint, x double, identifiable boolean")
    rows = estimates.join(net.links, "link_id").select("link_id", "src", "dst", "x", F.lit(None).cast("double").alias("confidence"), "identifiable")
    negative = int((answer.x < 0).sum())
    if negative and answer.method != "nnls":
        print(f"{negative} links have negative estimates", file=sys.stderr)
    quality = {"rank": q.rank, "num_links": q.n, "condition_number": q.condition, "identifiable_pct": 100 * q.identifiable_share}
    form = args.format or ("table" if sys.stdout.isatty() else "json")
    if form == "json":
        print(sinks.json_document(rows, answer.method, answer.residual, quality).collect()[0][0])
    elif form == "dot":
        print(sinks.dot_document(rows).collect()[0][0])
    elif form == "csv":
        print("\n".join(r[0] for r in sinks.csv_document(rows).collect()))
    else:
        counts, stats = estimate.counts(rows).collect()[0].asDict(), estimate.top_statistics(rows, args.top).collect()[0].asDict()
        print("\n".join(report.scan_lines(estimate.worst(rows, 0).collect(), counts, stats, answer.method, answer.residual, q, style, args.top, args.quiet)))


def configured(args: argparse.Namespace):
    from pathlight.plans.simulate import SimConfig

    return SimConfig(args.noise, args.noise_model, args.congested, args.congestion_factor, args.samples, args.seed, args.path_fraction)


def benched(spark: SparkSession, nodes: DataFrame, edges: DataFrame, cfg, methods: tuple[str, ...]):
    """(what was simulated, benchmark rows by method) of one topology."""
    from pathlight.operators import graph
    from pathlight.plans import design, simulate, solve

    sim = simulate.simulate(nodes, edges, cfg)
    near = [(int(r["a"]), int(r["b"])) for r in graph.link_adjacency(sim.links).collect()]  # dense solvers bound the links
    rows = solve.rows_of(sim.routing, sim.observed)
    return sim, design.benchmark(rows, sim.truth.select("link_id", F.col("x").alias("truth")), sim.links.count(), methods, near)


def simulate_command(args: argparse.Namespace) -> None:
    from pathlight import report
    from pathlight.operators.infer import Network
    from pathlight.plans import solve
    from pathlight.sources import graphml

    spark = session()
    nodes, edges = graphml.load(spark, args.topology)
    sim, table = benched(spark, nodes, edges, configured(args), (args.method,))
    net = Network(lambda: sim.nodes, sim.links, sim.observed.select("path_id"), sim.routing, sim.observed.withColumn("b_ns", (F.col("b") * 1e6).cast("bigint")))
    name = nodes.select(F.col("node_id").alias("_n"), "label")
    rows = solve.solution_rows(net, args.method).join(sim.truth.select("link_id", F.col("x").alias("truth")), "link_id").join(sim.links, "link_id")
    for end in ("src", "dst"):
        rows = rows.join(name, F.col(end) == F.col("_n")).drop("_n", end).withColumnRenamed("label", end)
    print("\n".join(report.simulation_lines(rows.orderBy("link_id").collect(), table.collect()[0].asDict(), report.Style.detect())))


def topologies(spark: SparkSession, args: argparse.Namespace):
    """(name, nodes, edges) of GraphML files in a folder or under a name, or of the synthetic set."""
    from pathlight.sources import graphml, synthetic

    if args.topology == "synthetic":
        for n, m in ((30, 2), (50, 3), (100, 3)):
            edges = synthetic.barabasi_albert(spark, [(f"ba-{n}", n, m, args.seed)])
            yield f"ba-{n}", spark.range(n).select(F.col("id").alias("node_id"), F.col("id").cast("string").alias("label"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")), edges
        for n in (30, 50):
            places, edges = synthetic.waxman(spark, n, 0.4, 0.3, args.seed)
            yield f"waxman-{n}", places.select("node_id", F.col("node_id").cast("string").alias("label"), F.col("y").alias("lat"), F.col("x").alias("lon")), edges
        return
    at = f"{args.topology.rstrip('/')}/*.graphml" if not args.topology.endswith(".graphml") else args.topology
    for f in sorted(r["path"] for r in spark.read.format("binaryFile").load(at).select("path").collect()):
        nodes, edges = graphml.load(spark, f)
        yield f.rpartition("/")[2].removesuffix(".graphml"), nodes, edges


def benchmark_command(args: argparse.Namespace) -> None:
    from pathlight import report
    from pathlight.plans import solvers

    spark, out = session(), []
    methods = tuple(args.methods.split(",")) if args.methods else solvers.METHODS
    for name, nodes, edges in topologies(spark, args):
        try:
            found = benched(spark, nodes, edges, configured(args), methods)[1].orderBy("method").collect()
            count = nodes.count()
        except Exception as e:  # noqa: BLE001  one topology that fails leaves the others
            print(f"{name}: {str(e).splitlines()[0][:200]}", file=sys.stderr)
            continue
        out += [r.asDict() | {"topology": name, "n_nodes": count} for r in found]
    print("\n".join(report.benchmark_lines(out, report.Style.detect())))


def plan(args: argparse.Namespace) -> None:
    from pathlight import report
    from pathlight.operators import graph
    from pathlight.plans import design
    from pathlight.plans.simulate import PAIR
    from pathlight.sources import graphml

    spark = session()
    nodes, edges = graphml.load(spark, args.topology)
    links = graph.build(edges.select("i", "src", "dst"))
    legs = graph.path_links(graph.all_pairs(links), links)
    listed = legs.groupBy((F.col("src") * PAIR + F.col("dst")).alias("path_id")).agg(F.array_sort(F.collect_set(F.col("link_id").cast("int"))).alias("links"))
    n = links.count()
    found = design.running_rank(design.recommend(listed.limit(0), listed, n, args.budget))
    name = {r["node_id"]: r["label"] for r in nodes.collect()}
    rows = [r.asDict() | {"src": name[r["path_id"] // PAIR], "dst": name[r["path_id"] % PAIR]} for r in found.orderBy("step").collect()]
    print("\n".join(report.plan_lines(rows, n, report.Style.detect())))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("pathlight")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan", help="link delays from a trace file or a measurement service")
    s.add_argument("file", nargs="?")
    s.add_argument("--measurement", type=int)
    s.add_argument("--service", default="http://localhost:8080/api/v2")
    s.add_argument("--cache", help="a folder for answers of the service")
    s.add_argument("--start", type=int, default=0)
    s.add_argument("--stop", type=int, default=0)
    s.add_argument("--wait", type=float, default=0, help="seconds to wait for results")
    s.add_argument("--method", default="nnls")
    s.add_argument("--format", choices=["table", "json", "csv", "dot"])
    s.add_argument("--top", type=int, default=0)
    s.add_argument("--quiet", action="store_true")
    s.add_argument("--max-anonymous", type=float, default=0.3)
    s.set_defaults(run=scan)
    for name, run in (("simulate", simulate_command), ("benchmark", benchmark_command)):
        s = sub.add_parser(name, help="estimates on simulated delays of GraphML topologies")
        s.add_argument("topology", help="a GraphML file" + ", a folder of them, or `synthetic`" * (name == "benchmark"))
        s.add_argument("--method", default="tikhonov")
        s.add_argument("--methods", default="", help="of a benchmark, separated by commas; all if left out")
        s.add_argument("--noise", type=float, default=0.1)
        s.add_argument("--noise-model", default="lognormal")
        s.add_argument("--congested", type=int, default=2)
        s.add_argument("--congestion-factor", type=float, default=5.0)
        s.add_argument("--samples", type=int, default=3)
        s.add_argument("--seed", type=int, default=42)
        s.add_argument("--path-fraction", type=float, default=1.0)
        s.set_defaults(run=run)
    s = sub.add_parser("plan", help="which pairs to probe")
    s.add_argument("topology")
    s.add_argument("--budget", type=int, default=10)
    s.set_defaults(run=plan)
    sub.add_parser("version").set_defaults(run=lambda _: print(VERSION))
    return p


def main(argv: list[str] | None = None) -> int:
    from pathlight.sources.http import load_dotenv

    if os.path.exists(".env"):
        with open(".env", encoding="utf-8") as f:
            load_dotenv(f.read(), os.environ)
    args = parser().parse_args(argv)
    try:
        check(args)
        args.run(args)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
