"""Every query of the tomography engine and, where SQL can say the same, its SQL.

Three networks come from the same traces: of addresses, of nations (AS level) and of five
regions. Values that come from sums of floating-point numbers are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlight.functions import scalar
from pathlight.operators import estimate as E
from pathlight.operators import graph as G
from pathlight.operators import infer as I
from pathlight.sources import fixtures as S

FLAGSHIP = "o01_worst_links"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, level: str | None = None):
    """Registers a function under its name, with its SQL after the network's common tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"{network_sql(level)}\n{sql}" if level else sql
        return f

    return add


def label(level: str) -> Column | None:
    """What a hop is called in a network; the unresolved number 0 has no name."""
    asn = F.col("asn") if level != "ip" else None
    return None if asn is None else F.when(asn != 0, asn if level == "as" else asn % 5)


def hops_at(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    rows = S.hops(spark, sf_dir)
    return rows if level == "ip" else rows.join(S.ip_asn(spark, sf_dir), "suppkey")


def network(spark: SparkSession, sf_dir: str, level: str) -> I.Network:
    return I.infer(hops_at(spark, sf_dir, level), label(level))


HOPS_SQL = """hops AS (SELECT l_orderkey AS meas_idx,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos,
  l_linenumber AS ttl, '10.0.' || CAST(CAST(floor(l_suppkey / 256.0) AS INT) AS VARCHAR) || '.' || CAST(l_suppkey % 256 AS VARCHAR) AS ip,
  l_suppkey, CAST(l_quantity * 1000000 AS BIGINT) AS rtt_ns, l_returnflag = 'R' AS anonymous, l_discount >= 0.10 AS mpls FROM lineitem),
acc AS (SELECT meas_idx, count(*) AS n_hops, count(*) FILTER (WHERE anonymous) AS n_anonymous FROM hops GROUP BY meas_idx
        HAVING count(*) FILTER (WHERE anonymous) / CAST(count(*) AS DOUBLE) <= 0.3),
vis AS (SELECT h.meas_idx, h.pos, h.ip, CAST(s_nationkey AS BIGINT) AS asn FROM hops h JOIN acc USING (meas_idx) JOIN supplier ON s_suppkey = l_suppkey WHERE NOT anonymous AND NOT mpls)"""


def network_sql(level: str) -> str:
    label = {"ip": "ip", "as": "CASE WHEN asn <> 0 THEN asn END", "region": "CASE WHEN asn <> 0 THEN asn % 5 END"}[level]
    runs = "TRUE" if level == "ip" else "prev IS NULL OR prev <> label"
    return f"""WITH {HOPS_SQL},
lab AS (SELECT meas_idx, pos, label, lag(label) OVER (PARTITION BY meas_idx ORDER BY pos) AS prev FROM (SELECT meas_idx, pos, {label} AS label FROM vis) WHERE label IS NOT NULL),
seen AS (SELECT meas_idx, pos, label FROM lab WHERE {runs}),
paired AS (SELECT meas_idx, pos, src, dst, least(src, dst) AS lo, greatest(src, dst) AS hi, meas_idx * 1000 + pos AS k
  FROM (SELECT meas_idx, pos, label AS src, lead(label) OVER (PARTITION BY meas_idx ORDER BY pos) AS dst FROM seen) WHERE dst IS NOT NULL AND src <> dst),
nodes AS (SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS node_id, label FROM (SELECT label, min(meas_idx * 1000 + pos) AS k FROM seen GROUP BY label)),
links AS (SELECT CAST(row_number() OVER (ORDER BY f.k) - 1 AS BIGINT) AS link_id, p.src, p.dst, p.lo, p.hi FROM (SELECT min(k) AS k FROM paired GROUP BY lo, hi) f JOIN paired p ON p.k = f.k),
paths AS (SELECT meas_idx AS path_id, count(*) AS n_visible FROM seen GROUP BY meas_idx HAVING count(*) >= 2),
coo AS (SELECT DISTINCT meas_idx AS path_id, link_id FROM paired JOIN links USING (lo, hi)),
obs AS (SELECT h.meas_idx AS path_id, CAST(min(h.rtt_ns) AS BIGINT) AS b_ns, min(h.rtt_ns) / 1e6 AS b FROM hops h
  JOIN (SELECT meas_idx, max(ttl) AS t FROM hops GROUP BY meas_idx) m ON m.meas_idx = h.meas_idx AND h.ttl = m.t
  JOIN paths p ON p.path_id = h.meas_idx GROUP BY h.meas_idx),
len AS (SELECT path_id, count(*) AS n_links FROM coo GROUP BY path_id),
cov AS (SELECT link_id, CAST(count(c.path_id) AS BIGINT) AS coverage FROM links LEFT JOIN coo c USING (link_id) GROUP BY link_id),
prior AS (SELECT link_id, coalesce(avg(b_ns / CAST(n_links AS DOUBLE) / 1e6), 0.0) AS x FROM links LEFT JOIN coo USING (link_id) LEFT JOIN obs USING (path_id) LEFT JOIN len USING (path_id) GROUP BY link_id),
judged AS (SELECT link_id, x, 1 + ((src * 7 + dst * 13) % 20) / 2.0::DOUBLE AS truth, link_id % 7 <> 3 AS identifiable FROM prior JOIN links USING (link_id))""".replace(
        "src * 7 + dst * 13", "0" if level == "ip" else "lo * 7 + hi * 13"
    )


def prior_of(net: I.Network) -> DataFrame:
    return E.gravity_prior(net.links, net.routing, net.observed)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prior of the AS network beside a made-up truth and mask, which stand in for a known case."""
    net = network(spark, sf_dir, "as")
    truth = 1 + ((F.col("lo") * 7 + F.col("hi") * 13) % 20) / 2.0
    return prior_of(net).join(net.links, "link_id").select("link_id", "x", truth.alias("truth"), (F.col("link_id") % 7 != 3).alias("identifiable"), "src", "dst", "lo", "hi")


# --- filters and inference


@query(f"WITH {HOPS_SQL} SELECT meas_idx, CAST(n_hops AS BIGINT) AS n_hops, CAST(n_anonymous AS BIGINT) AS n_anonymous FROM acc")
def f03_accepted_traces(spark, d):
    return I.accepted_traces(S.hops(spark, d))


@query("SELECT o_orderkey AS meas_idx FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def f02_traces_with_hops(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("meas_idx"))
    return o.join(S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("meas_idx")), "meas_idx", "left_semi")


@query(f"WITH {HOPS_SQL} SELECT meas_idx, pos, ip FROM vis")
def f04_visible_hops(spark, d):
    return I.visible(I.accepted(S.hops(spark, d))).select("meas_idx", "pos", "ip")


@query("SELECT path_id, n_visible FROM paths WHERE path_id NOT IN (SELECT path_id FROM coo)", "ip")
def f05_zero_link_paths(spark, d):
    net = network(spark, d, "ip")
    return net.paths.join(net.routing, "path_id", "left_anti")


@query("SELECT link_id, src AS src_ip, dst AS dst_ip FROM links", "ip")
def w01_inferred_links(spark, d):
    return network(spark, d, "ip").links.select("link_id", F.col("src").alias("src_ip"), F.col("dst").alias("dst_ip"))


@query("SELECT node_id, label FROM nodes", "ip")
def w02_inferred_nodes(spark, d):
    return network(spark, d, "ip").nodes


@query("SELECT path_id, link_id FROM coo", "ip")
def m01_routing_coo(spark, d):
    return network(spark, d, "ip").routing


@query("SELECT path_id, CAST(n_links AS BIGINT) AS n_links FROM len", "ip")
def a04_path_length(spark, d):
    return E.path_lengths(network(spark, d, "ip").routing)


@query("SELECT path_id, b_ns, b FROM obs", "ip")
def a02_observations(spark, d):
    return network(spark, d, "ip").observed


@query("SELECT link_id, coverage FROM cov", "ip")
def a03_coverage(spark, d):
    net = network(spark, d, "ip")
    return E.coverage(net.links, net.routing)


@query("SELECT link_id, round(x, 6) AS x FROM prior", "as")
def a05_gravity_prior(spark, d):
    return prior_of(network(spark, d, "as")).select("link_id", F.round("x", 6).alias("x"))


@query("SELECT link_id, src, dst, round(x, 6) AS x FROM prior JOIN links USING (link_id) ORDER BY round(x, 6) DESC, link_id LIMIT 10", "as")
def o01_worst_links(spark, d):
    net = network(spark, d, "as")
    x = prior_of(net).select("link_id", F.round("x", 6).alias("x"))
    return E.worst(x.join(net.links.select("link_id", "src", "dst"), "link_id"), 10).select("link_id", "src", "dst", "x")


@query("SELECT path_id, round(sum(1 + ((lo * 7 + hi * 13) % 20) / 2.0::DOUBLE), 6) AS total FROM coo JOIN links USING (link_id) GROUP BY path_id", "as")
def a06_noise_free_sums(spark, d):
    net = network(spark, d, "as")
    truth = net.links.select("link_id", (1 + ((F.col("lo") * 7 + F.col("hi") * 13) % 20) / 2.0).alias("x"))
    return E.path_sums(net.routing, truth).select("path_id", F.round("total", 6).alias("total"))


@query("SELECT a.link_id AS i, b.link_id AS j, CAST(count(*) AS BIGINT) AS n FROM coo a JOIN coo b USING (path_id) GROUP BY 1, 2", "as")
def a08_gram(spark, d):
    return E.gram(network(spark, d, "as").routing)


@query("SELECT link_id, CAST(sum(b_ns) AS BIGINT) AS atb_ns FROM coo JOIN obs USING (path_id) GROUP BY link_id", "region")
def a08_atb(spark, d):
    net = network(spark, d, "region")
    return E.projected(net.routing, net.observed)


@query("SELECT round(sqrt(sum(pow(coalesce(t, 0) - b, 2))), 4) AS residual FROM obs LEFT JOIN (SELECT path_id, sum(x) AS t FROM coo JOIN prior USING (link_id) GROUP BY path_id) USING (path_id)", "as")
def a09_residual_prior(spark, d):
    net = network(spark, d, "as")
    return E.residual(net.routing, net.observed, prior_of(net)).select(F.round("residual", 4).alias("residual"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_links, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM (SELECT * FROM judged ORDER BY round(x, 6) DESC, link_id LIMIT 20) WHERE identifiable", "as")
def a10_report_stats(spark, d):
    j = judged(spark, d).withColumn("x", F.round("x", 6))
    return E.top_statistics(j, 20).select("n_links", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("""SELECT round(sqrt(avg((x - truth) * (x - truth))), 6) AS rmse, round(avg(abs(x - truth)), 6) AS mae, round(max(abs(x - truth) / truth), 6) AS max_rel_err FROM judged WHERE identifiable""", "as")
def a11_accuracy(spark, d):
    return E.accuracy(judged(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("rmse", "mae", "max_rel_err")])


@query("""SELECT CAST(max(k) AS BIGINT) AS k, sum(CASE WHEN t <= k AND e <= k THEN 1 ELSE 0 END) / CAST(max(k) AS DOUBLE) AS detection_rate FROM
(SELECT row_number() OVER (ORDER BY truth DESC, link_id) AS t, row_number() OVER (ORDER BY round(x, 6) DESC, link_id) AS e,
 greatest(1, least(3, floor(count(*) OVER () / 4.0))) AS k FROM judged WHERE identifiable)""", "as")
def a12_detection(spark, d):
    return E.detection_rate(judged(spark, d).withColumn("x", F.round("x", 6)))


@query("SELECT event_type AS dst, CAST(count(v) AS BIGINT) AS n_samples, round((quantile_cont(v, 0.975) - quantile_cont(v, 0.025)) / 2, 3) AS half_width FROM (SELECT event_type, CAST(CAST(value * 1e6 AS DOUBLE) AS BIGINT) / 1e6 AS v FROM events) GROUP BY event_type")
def a13_percentile_halfwidth(spark, d):
    rows = S.latencies(spark, d).select("dst", F.round(F.col("rtt_ns") / 1e6, 3).alias("v"))
    return E.half_width(rows, ["dst"], "v").select("dst", "n_samples", F.round("half_width", 3).alias("half_width"))


ORACLE_SQL["a13_percentile_halfwidth"] = "SELECT event_type AS dst, CAST(count(v) AS BIGINT) AS n_samples, round((quantile_cont(v, 0.975) - quantile_cont(v, 0.025)) / 2, 3) AS half_width FROM (SELECT event_type, round(value, 3) AS v FROM events) GROUP BY event_type"


@query("""SELECT n, r AS q FROM (SELECT r, row_number() OVER (ORDER BY r, path_id) AS k, CAST(count(*) OVER () AS BIGINT) AS n FROM
 (SELECT path_id, round(abs(b - coalesce(t, 0)), 6) AS r FROM obs LEFT JOIN (SELECT path_id, sum(x) AS t FROM coo JOIN prior USING (link_id) GROUP BY path_id) USING (path_id)
  WHERE substr(md5(CAST(path_id AS VARCHAR)), 1, 1) < '3')) WHERE k = least(ceil((n + 1) * 0.9::DOUBLE), n)""", "as")
def a15_conformal_quantile(spark, d):
    net = network(spark, d, "as")
    fit = net.observed.join(E.path_sums(net.routing, prior_of(net)), "path_id", "left")
    held = fit.filter(F.substring(F.md5(F.col("path_id").cast("string")), 1, 1) < "3")
    return E.conformal_quantile(held.select("path_id", F.round(F.abs(F.col("b") - F.coalesce("total", F.lit(0.0))), 6).alias("r")), 0.1)


SEQ_SQL = f"""WITH {HOPS_SQL}, seq AS (SELECT o_orderkey AS meas_idx, CAST(o_custkey AS VARCHAR) AS src, o_orderpriority AS dst, coalesce(s, '') AS seq, n_anonymous FROM orders JOIN customer ON c_custkey = o_custkey
 JOIN (SELECT meas_idx, string_agg(CASE WHEN NOT anonymous THEN ip END, '|' ORDER BY pos) AS s, CAST(count(*) FILTER (WHERE anonymous) AS BIGINT) AS n_anonymous FROM hops GROUP BY meas_idx) ON meas_idx = o_orderkey)"""


@query(f"{SEQ_SQL} SELECT src, dst, CAST(count(DISTINCT seq) AS BIGINT) AS n_paths, array_to_string(list_sort(list(DISTINCT seq)), ';') AS sequences FROM seq GROUP BY src, dst HAVING count(DISTINCT seq) > 1")
def a16_ecmp_groups(spark, d):
    return I.multipath(I.distinct_sequences(S.hops(spark, d), S.traces(spark, d))).withColumn("sequences", F.array_join("sequences", ";"))


@query(f"{SEQ_SQL} SELECT src, dst, meas_idx, n_anonymous FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY n_anonymous, meas_idx) AS k FROM seq) WHERE k = 1")
def a17_ecmp_dedup(spark, d):
    return I.one_per_pair(I.distinct_sequences(S.hops(spark, d), S.traces(spark, d)))


GROUPS_SQL = "SELECT src, CAST(min(link_id) AS BIGINT) AS first_link, CAST(count(*) AS BIGINT) AS n_links, greatest(0, max(round(x, 6))) AS max_delay, CAST(sum(coverage) AS BIGINT) AS coverage FROM links JOIN prior USING (link_id) JOIN cov USING (link_id) GROUP BY src"


def groups(spark, d):
    net = network(spark, d, "as")
    return E.node_groups(net.links, prior_of(net).withColumn("x", F.round("x", 6)), E.coverage(net.links, net.routing))


@query(GROUPS_SQL, "as")
def a18_node_groups(spark, d):
    return groups(spark, d)


@query(f"SELECT *, CAST(row_number() OVER (ORDER BY coverage DESC, first_link) AS BIGINT) AS place FROM ({GROUPS_SQL})", "as")
def o02_groups_by_coverage(spark, d):
    return E.ordered_groups(groups(spark, d), "coverage_desc")


@query(f"SELECT *, CAST(row_number() OVER (ORDER BY max_delay, first_link) AS BIGINT) AS place FROM ({GROUPS_SQL})", "as")
def o02_groups_by_delay(spark, d):
    return E.ordered_groups(groups(spark, d), "delay_asc")


@query("SELECT link_id, round(x, 6) AS x, round(CASE WHEN sd > 0 THEN (x - m) / sd ELSE 0 END, 6) AS z FROM (SELECT link_id, x, avg(x) OVER () AS m, stddev_pop(x) OVER () AS sd FROM prior)", "as")
def w06_zscore(spark, d):
    return E.z_scores(prior_of(network(spark, d, "as"))).select("link_id", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"))


@query("SELECT link_id, coverage, CAST(sum(coverage) OVER (ORDER BY link_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM cov", "as")
def w05_running_sum(spark, d):
    from pyspark.sql.window import Window

    net = network(spark, d, "as")
    w = Window.orderBy("link_id").rowsBetween(Window.unboundedPreceding, 0)
    return E.coverage(net.links, net.routing).withColumn("running", F.sum("coverage").over(w).cast("bigint"))


@query("""SELECT CAST(count(*) AS BIGINT) AS n_links, CAST(count(*) FILTER (WHERE identifiable) AS BIGINT) AS n_identifiable, round(avg(CASE WHEN identifiable THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS identifiable_share,
CAST(count(*) FILTER (WHERE round(x, 6) > 20 AND identifiable) AS BIGINT) AS n_congested, CAST(count(*) FILTER (WHERE round(x, 6) > 20) AS BIGINT) AS n_congested_all, CAST(count(*) FILTER (WHERE x < 0) AS BIGINT) AS n_negative FROM judged""", "as")
def a23_report_counts(spark, d):
    return E.counts(judged(spark, d).withColumn("x", F.round("x", 6))).withColumn("identifiable_share", F.round("identifiable_share", 6))


# --- graphs

@query("SELECT node, array_to_string(list_sort(list(DISTINCT nb)), ',') AS neighbors FROM (SELECT src AS node, dst AS nb FROM links UNION ALL SELECT dst, src FROM links) GROUP BY node", "as")
def g03_neighbors(spark, d):
    return G.neighbors(network(spark, d, "as").links).select("node", F.array_join("neighbors", ",").alias("neighbors"))


@query("SELECT CAST((SELECT count(*) FROM nodes) AS BIGINT) AS n_nodes, CAST((SELECT count(*) FROM links) AS BIGINT) AS n_links", "as")
def g02_sizes(spark, d):
    net = network(spark, d, "as")
    return net.nodes.agg(F.count("*").alias("n_nodes")).crossJoin(net.links.agg(F.count("*").alias("n_links")))


BFS_SQL = network_sql("as").replace("WITH hops", "WITH RECURSIVE hops", 1) + """,
step AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links),
reach(src, dst, h) AS (SELECT DISTINCT a, a, 0 FROM step UNION
  SELECT r.src, s.b, r.h + 1 FROM reach r JOIN step s ON s.a = r.dst WHERE r.h < (SELECT count(DISTINCT a) FROM step)),
far AS (SELECT src, dst, min(h) AS h FROM reach GROUP BY src, dst),
walk(src, dst, path, h) AS (SELECT src, dst, [src], 0 FROM far WHERE h = 0 UNION ALL
  SELECT w.src, s.b, list_append(w.path, s.b), w.h + 1 FROM walk w JOIN step s ON s.a = w.dst JOIN far f ON f.src = w.src AND f.dst = s.b AND f.h = w.h + 1),
best AS (SELECT src, dst, h, path, row_number() OVER (PARTITION BY src, dst ORDER BY path) AS k FROM walk WHERE src <> dst)"""


@query()
def g05_apsp(spark, d):
    return G.all_pairs(network(spark, d, "as").links).select("src", "dst", "hops", F.array_join("path", ",").alias("path"))


@query()
def g04_shortest_path(spark, d):
    one = spark.range(1).select(F.lit(1).cast("bigint").alias("node"))
    return G.shortest_paths(network(spark, d, "as").links, one).select("src", "dst", "hops", F.array_join("path", ",").alias("path"))


ORACLE_SQL["g05_apsp"] = f"{BFS_SQL} SELECT src, dst, CAST(h AS BIGINT) AS hops, array_to_string(path, ',') AS path FROM best WHERE k = 1 AND src < dst"
ORACLE_SQL["g04_shortest_path"] = f"{BFS_SQL} SELECT src, dst, CAST(h AS BIGINT) AS hops, array_to_string(path, ',') AS path FROM best WHERE k = 1 AND src = 1"
# both run over all links, and go by their earlier names as well
for _name in ("g04_shortest_path", "g05_apsp"):
    QUERIES[f"{_name}_all_links"], ORACLE_SQL[f"{_name}_all_links"] = QUERIES[_name], ORACLE_SQL[_name]

KM_SQL = "2 * 6371.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h))"
HAV_SQL = "pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)"
PLACES_SQL = "places AS (SELECT CAST(n_nationkey AS BIGINT) AS label, CASE WHEN n_nationkey = 7 THEN 0.0::DOUBLE ELSE n_nationkey * 5.0::DOUBLE - 60 END AS lat, CASE WHEN n_nationkey = 7 THEN 0.0::DOUBLE ELSE n_nationkey * 11.0::DOUBLE - 130 END AS lon FROM nation)"


@query(f"WITH {PLACES_SQL} SELECT i, j, round(CASE WHEN z THEN 0 ELSE {KM_SQL} END, 6) AS km FROM (SELECT a.label AS i, b.label AS j, (a.lat = 0 AND a.lon = 0) OR (b.lat = 0 AND b.lon = 0) AS z, {HAV_SQL} AS h FROM places a JOIN places b ON a.label < b.label)")
def g06_geo_distance(spark, d):
    p = S.nation_places(spark, d)
    pairs = G.pairs_in_order(p.select(F.col("label").alias("node_id")))
    end = lambda c, s: p.select(F.col("label").alias(c), F.col("lat").alias(f"lat{s}"), F.col("lon").alias(f"lon{s}"))
    both = pairs.join(end("i", 1), "i").join(end("j", 2), "j")
    return both.select("i", "j", F.round(scalar.geo_distance_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 6).alias("km"))


@query()
def f09_speed_of_light(spark, d):
    net = network(spark, d, "as")
    x = prior_of(net).select("link_id", (F.round("x", 6) - 20).alias("x"))
    return E.speed_violations(x, net.links.select("link_id", "src", "dst"), S.nation_places(spark, d)).select("link_id", F.round("x", 6).alias("x"), F.round("lower_bound", 6).alias("lower_bound"), F.round("km", 6).alias("km"))


ORACLE_SQL["f09_speed_of_light"] = f"""{network_sql("as")}, {PLACES_SQL}, e AS (SELECT link_id, round(p.x, 6) - 20 AS x, NOT ((a.lat = 0 AND a.lon = 0) OR (b.lat = 0 AND b.lon = 0)) AS known, {HAV_SQL} AS h
 FROM prior p JOIN links USING (link_id) JOIN places a ON a.label = src JOIN places b ON b.label = dst), f AS (SELECT *, {KM_SQL} AS km FROM e)
SELECT link_id, round(x, 6) AS x, round(CASE WHEN x < 0 THEN 0 ELSE 0.005::DOUBLE * km END, 6) AS lower_bound, round(CASE WHEN x < 0 THEN 0 ELSE km END, 6) AS km FROM f WHERE x < 0 OR (known AND x < 0.005::DOUBLE * km)"""

ALIAS_SQL = """, num AS (SELECT node_id, label, CAST(split_part(label, '.', 3) AS BIGINT) * 256 + CAST(split_part(label, '.', 4) AS BIGINT) + 167772160 AS n FROM nodes),
par AS (SELECT b.node_id, max(a.node_id) AS parent FROM num a JOIN num b ON a.n // 4 = b.n // 4 AND a.node_id < b.node_id AND a.n // 2 <> b.n // 2
  WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.lo = least(a.label, b.label) AND l.hi = greatest(a.label, b.label)) GROUP BY b.node_id),
r1 AS (SELECT n.node_id, n.label, coalesce(p.parent, n.node_id) AS root FROM nodes n LEFT JOIN par p USING (node_id)),
r2 AS (SELECT r.node_id, r.label, coalesce(p.parent, r.root) AS root FROM r1 r LEFT JOIN par p ON p.node_id = r.root),
r3 AS (SELECT r.node_id, r.label, coalesce(p.parent, r.root) AS root FROM r2 r LEFT JOIN par p ON p.node_id = r.root),
named AS (SELECT r.node_id, r.label, n.label AS rep FROM r3 r JOIN nodes n ON n.node_id = r.root)"""


@query(f"{ALIAS_SQL} SELECT node_id, label, rep FROM named", "ip")
def g08_alias_resolution(spark, d):
    net = network(spark, d, "ip")
    return G.aliases(net.nodes, net.links)


@query(f"""{ALIAS_SQL}, m AS (SELECT l.link_id, a.rep AS s, b.rep AS d, least(a.rep, b.rep) AS ml, greatest(a.rep, b.rep) AS mh FROM links l JOIN named a ON a.label = l.src JOIN named b ON b.label = l.dst WHERE a.rep <> b.rep)
SELECT CAST(row_number() OVER (ORDER BY f.k) - 1 AS BIGINT) AS link_id, m.s AS src, m.d AS dst FROM (SELECT min(link_id) AS k FROM m GROUP BY ml, mh) f JOIN m ON m.link_id = f.k""", "ip")
def g08_merged_links(spark, d):
    net = network(spark, d, "ip")
    return G.merged_links(net.links, G.aliases(net.nodes, net.links))


@query("SELECT link_id, 'AS' || CAST(src AS VARCHAR) AS src, 'AS' || CAST(dst AS VARCHAR) AS dst FROM links", "as")
def g09_as_graph(spark, d):
    tag = lambda c: F.concat(F.lit("AS"), F.col(c).cast("string")).alias(c)
    return network(spark, d, "as").links.select("link_id", tag("src"), tag("dst"))


@query("SELECT meas_idx, pos, label AS asn FROM seen", "as")
def w04_collapsed_asns(spark, d):
    return I.collapsed(I.visible(I.accepted(hops_at(spark, d, "as"))), label("as")).select("meas_idx", "pos", F.col("label").alias("asn"))


ADJ_SQL = ", e AS (SELECT link_id, src AS v FROM links UNION ALL SELECT link_id, dst FROM links), adj AS (SELECT DISTINCT a.link_id AS a, b.link_id AS b FROM e a JOIN e b USING (v) WHERE a.link_id <> b.link_id)"


@query(f"{ADJ_SQL} SELECT a, b FROM adj", "region")
def j08_link_adjacency(spark, d):
    return G.link_adjacency(network(spark, d, "region").links)


@query(f"{ADJ_SQL} SELECT link_id, CAST(count(b) AS BIGINT) AS degree FROM links LEFT JOIN adj ON a = link_id GROUP BY link_id", "region")
def a21_link_degree(spark, d):
    return G.link_degrees(network(spark, d, "region").links)


@query(f"{ADJ_SQL} SELECT a AS i, b AS j, CAST(-1 AS BIGINT) AS value FROM adj UNION ALL SELECT link_id, link_id, CAST(count(b) AS BIGINT) FROM links LEFT JOIN adj ON a = link_id GROUP BY link_id", "region")
def g10_link_laplacian(spark, d):
    return G.laplacian(network(spark, d, "region").links)


@query("SELECT src, dst, round(x, 6) AS x, CASE WHEN round(x, 6) < 2 THEN 'green' WHEN round(x, 6) <= 10 THEN 'yellow' ELSE 'red' END AS band FROM prior JOIN links USING (link_id)", "as")
def g11_heatmap(spark, d):
    net = network(spark, d, "as")
    x = F.round("x", 6)
    return prior_of(net).join(net.links, "link_id").select("src", "dst", x.alias("x"), scalar.delay_band(x).alias("band"))


@query("SELECT i, j FROM (SELECT a.node_id AS i, b.node_id AS j FROM nodes a JOIN nodes b ON a.node_id < b.node_id)", "as")
def j09_node_pairs(spark, d):
    return G.pairs_in_order(network(spark, d, "as").nodes)


@query("""SELECT c.path_id, CAST(len(c.l) AS BIGINT) AS n_links FROM (SELECT path_id, list_sort(list(link_id)) AS l FROM coo WHERE path_id % 10 = 3 GROUP BY path_id) c
WHERE NOT EXISTS (SELECT 1 FROM (SELECT list_sort(list(link_id)) AS l FROM coo WHERE path_id % 10 <> 3 GROUP BY path_id) e WHERE e.l = c.l)""", "region")
def j06_new_candidates(spark, d):
    r = network(spark, d, "region").routing
    return E.new_candidates(r.filter("path_id % 10 = 3"), r.filter("path_id % 10 <> 3"))


@query("SELECT l.link_id, src, dst FROM links l WHERE CAST(src AS VARCHAR) LIKE '%1%' OR CAST(dst AS VARCHAR) LIKE '%1%'", "as")
def f11_label_filter(spark, d):
    hit = lambda c: scalar.label_matches(F.col(c).cast("string"), "1")
    return network(spark, d, "as").links.filter(hit("src") | hit("dst")).select("link_id", "src", "dst")


@query("SELECT link_id FROM judged WHERE identifiable", "as")
def f06_identifiable(spark, d):
    j = judged(spark, d)
    return j.join(j.filter("link_id % 7 = 3").select("link_id"), "link_id", "left_anti").select("link_id")


# --- scalars, sinks, sources


def _sinks():
    from pathlight.sources import sinks

    return sinks


def report_rows(spark, d):
    return judged(spark, d).select("link_id", "src", "dst", F.round("x", 6).alias("x"), F.lit(None).cast("double").alias("confidence"), "identifiable")


@query("SELECT link_id, CAST(link_id AS VARCHAR) || ',' || CAST(src AS VARCHAR) || ',' || CAST(dst AS VARCHAR) || ',' || printf('%.3f', round(round(x, 6), 3)) || ',0.000,' || CASE WHEN identifiable THEN 'true' ELSE 'false' END AS line FROM judged JOIN links USING (link_id)", "as")
def k02_csv_rows(spark, d):
    return _sinks().csv_lines(report_rows(spark, d).withColumn("x", F.round("x", 3)))


@query("SELECT link_id, '  \"' || CAST(src AS VARCHAR) || '\" -- \"' || CAST(dst AS VARCHAR) || '\" [label=\"' || printf('%.1f', round(round(x, 6), 1)) || 'ms\", color=\"' || CASE WHEN round(x, 1) < 2 THEN 'green' WHEN round(x, 1) <= 10 THEN 'yellow' ELSE 'red' END || '\"' || CASE WHEN identifiable THEN '' ELSE ', style=dashed' END || '];' AS line FROM judged JOIN links USING (link_id)", "as")
def k04_dot_edges(spark, d):
    return _sinks().dot_edges(report_rows(spark, d).withColumn("x", F.round("x", 1)))


@query("SELECT link_id, CASE WHEN v < 2 THEN 'green' WHEN v <= 10 THEN 'yellow' ELSE 'red' END AS drawn, CASE WHEN v < 0 THEN 'red' WHEN v < 5 THEN 'green' WHEN v < 20 THEN 'yellow' ELSE 'red' END AS reported, CASE WHEN identifiable THEN 'yes' ELSE 'NO' END AS ident, CAST(greatest(0, least(floor(v / 50 * 30), 30)) AS INT) AS bar, rpad(CAST(link_id AS VARCHAR), 6, ' ') AS padded FROM (SELECT *, round(x, 6) - 12 AS v FROM judged)", "as")
def k05_k08_bands(spark, d):
    v = F.round("x", 6) - 12
    return judged(spark, d).select(
        "link_id", scalar.delay_band(v).alias("drawn"), scalar.report_band(v).alias("reported"), scalar.identifiable_label(F.col("identifiable")).alias("ident"), scalar.bar_length(v, 30).alias("bar"), scalar.pad_right(F.col("link_id").cast("string"), 6).alias("padded")
    )


@query("SELECT link_id, signum(v) * greatest(abs(v) - 2.5, 0) AS shrunk FROM (SELECT link_id, CAST(link_id % 17 - 8 AS DOUBLE) AS v FROM links)".replace("signum", "sign"), "as")
def l10_soft_threshold(spark, d):
    v = (F.col("link_id") % 17 - 8).cast("double")
    return network(spark, d, "as").links.select("link_id", scalar.soft_threshold(v, 2.5).alias("shrunk"))


@query(f"WITH {HOPS_SQL} SELECT DISTINCT ip, n, n - n % 4 AS net30, n - n % 2 AS net31 FROM (SELECT ip, 167772160 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS n FROM hops)")
def c02_address_bits(spark, d):
    n = scalar.ipv4_number(F.col("ip"))
    return S.hops(spark, d).select("ip").distinct().select("ip", n.alias("n"), scalar.slash30(n).alias("net30"), scalar.slash31(n).alias("net31"))


@query("SELECT event_id, CAST(trunc(value * 1e6) AS BIGINT) AS ns FROM events")
def c04_units(spark, d):
    return S.table(spark, d, "events").select("event_id", scalar.ms_to_ns(F.col("value")).alias("ns"))


@query("SELECT event_id, sha256(CAST(user_id AS VARCHAR) || ':' || event_type) AS cache_key, CASE WHEN strlen(event_type) > 3 THEN substr(event_type, 1, 3) || '...' ELSE event_type END AS body FROM events")
def s17_cache_key(spark, d):
    return S.table(spark, d, "events").select("event_id", scalar.cache_key(F.col("user_id").cast("string"), F.col("event_type")).alias("cache_key"), scalar.truncated(F.col("event_type"), 3).alias("body"))


@query("SELECT n_nationkey, CASE WHEN h = 'x' OR TRY_CAST(h AS INT) < 0 THEN 5.0::DOUBLE WHEN h = '0' THEN 0.1::DOUBLE ELSE CAST(h AS DOUBLE) END AS seconds FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN 'x' ELSE CAST(n_nationkey - 4 AS VARCHAR) END AS h FROM nation)")
def s16_retry_after(spark, d):
    k = F.col("n_nationkey")
    h = F.when(k % 6 == 0, "x").otherwise((k - 4).cast("string"))
    return S.table(spark, d, "nation").select("n_nationkey", scalar.retry_after_seconds(h).alias("seconds"))


@query("SELECT s_suppkey AS suppkey, CAST(s_nationkey AS BIGINT) AS asn FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag <> 'R')")
def s18_resolved_asns(spark, d):
    seen = S.hops(spark, d).filter("NOT anonymous").select("suppkey").distinct()
    return seen.join(S.ip_asn(spark, d), "suppkey", "left").select("suppkey", F.coalesce("asn", F.lit(0)).cast("bigint").alias("asn"))


@query("SELECT user_id AS src, event_type AS dst, CAST(count(*) AS BIGINT) AS n_points, CAST(min(trunc(value * 1e6)) AS BIGINT) AS min_ns FROM events GROUP BY user_id, event_type")
def s14_latency_minrtt(spark, d):
    return S.latencies(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n_points"), F.min("rtt_ns").alias("min_ns"))


@query(f"WITH {HOPS_SQL} SELECT o_orderkey AS k FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 25")
def o03_hash_sample(spark, d):
    return E.hash_sample(S.table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), "k", 25)


@query(f"WITH {PLACES_SQL} SELECT i, j, round(0.4::DOUBLE * exp(-dd / (0.3::DOUBLE * max(dd) OVER ())), 9) AS p FROM (SELECT a.label AS i, b.label AS j, sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) AS dd FROM places a JOIN places b ON a.label < b.label)")
def s21_waxman_probability(spark, d):
    from pathlight.sources import synthetic

    p = S.nation_places(spark, d).select(F.col("label").alias("node_id"), F.col("lat").alias("x"), F.col("lon").alias("y"))
    return synthetic.waxman_pairs(p, 0.3, 0.4).select("i", "j", F.round("p", 9).alias("p"))


@query(f"WITH {PLACES_SQL} SELECT i, j, round(CASE WHEN km * 0.005::DOUBLE > 0 THEN km * 0.005::DOUBLE ELSE 1 END, 6) AS truth FROM (SELECT i, j, {KM_SQL} AS km FROM (SELECT a.label AS i, b.label AS j, {HAV_SQL} AS h FROM places a JOIN places b ON a.label < b.label))")
def m04_truth_delays(spark, d):
    from pathlight.plans import simulate

    p = S.nation_places(spark, d)
    links = G.pairs_in_order(p.select(F.col("label").alias("node_id"))).select("i", "j")
    return simulate.propagation(links, p, F.lit(1.0)).select("i", "j", F.round("truth", 6).alias("truth"))


EM_SQL = "".join(
    f""", f{k} AS (SELECT path_id, sum(x) AS f FROM coo JOIN x{k} USING (link_id) GROUP BY path_id HAVING sum(x) > 0),
x{k + 1} AS (SELECT x.link_id, x.x * coalesce(g.g, 0) AS x FROM x{k} x LEFT JOIN (SELECT link_id, avg(b / f) AS g FROM coo JOIN f{k} USING (path_id) JOIN obs USING (path_id) GROUP BY link_id) g USING (link_id))"""
    for k in range(5)
)


@query(f", x0 AS (SELECT link_id, 1.0::DOUBLE AS x FROM links){EM_SQL} SELECT link_id, round(x, 6) AS x FROM x5", "region")
def l12_em_5_iterations(spark, d):
    from pathlight.plans.lineage import cut

    net = network(spark, d, "region")
    return E.em_steps(cut(net.routing), cut(net.observed), cut(net.links), 5).select("link_id", F.round("x", 6).alias("x"))


# --- JSON round trips: traces written in each layout and read back


def _written(spark, d, one, wrap) -> DataFrame:
    """meas_idx and value: the JSON text of each trace; `one` is a hop, `wrap` the document around the hops in order."""
    rows = S.hops(spark, d).groupBy("meas_idx").agg(F.sort_array(F.collect_list(F.struct("pos", one))).alias("_h"))
    return rows.select("meas_idx", F.to_json(wrap(F.transform("_h", lambda x: x["h"]))).alias("value"))


HOPS_BACK = "SELECT meas_idx, pos, CAST(ttl AS BIGINT) AS ttl, CASE WHEN anonymous THEN '' ELSE ip END AS ip, CASE WHEN anonymous THEN 0 ELSE rtt_ns END AS rtt_ns, anonymous, mpls AND NOT anonymous AS mpls FROM hops"


@query(f"WITH {HOPS_SQL} {HOPS_BACK}")
def s05_json_traces(spark, d):
    from pathlight.sources import traces_json as J

    ext = F.when(F.col("mpls"), F.struct(F.array(F.struct(F.array(F.struct(F.lit(16).alias("label"))).alias("mpls"))).alias("obj")))
    reply = F.when(F.col("anonymous"), F.struct(F.lit("*").alias("x"), F.lit(None).cast("string").alias("from"), F.lit(None).cast("double").alias("rtt"), F.lit(None).cast(ext_type()).alias("icmpext")))
    reply = reply.otherwise(F.struct(F.lit(None).cast("string").alias("x"), F.col("ip").alias("from"), (F.col("rtt_ns") / 1e6).alias("rtt"), ext.alias("icmpext")))
    hop = F.struct(F.col("ttl").cast("int").alias("hop"), F.array(reply).alias("result")).alias("h")
    texts = _written(spark, d, hop, lambda h: F.array(F.struct(F.lit("traceroute").alias("type"), F.lit("a").alias("src_addr"), F.lit("b").alias("dst_addr"), h.alias("result"))))
    return J.exploded_hops(J.ripe(texts))


def ext_type() -> str:
    return "struct<obj:array<struct<mpls:array<struct<label:int>>>>>"


@query(f"WITH {HOPS_SQL} SELECT meas_idx, pos, CAST(ttl AS BIGINT) AS ttl, CASE WHEN anonymous THEN '' ELSE ip END AS ip, rtt_ns, anonymous, mpls FROM hops")
def s06_scamper_traces(spark, d):
    from pathlight.sources import traces_json as J

    ext = F.when(F.col("mpls"), F.struct(F.array(F.struct(F.lit(16).alias("label"))).alias("mpls")))
    hop = F.struct(F.when(F.col("anonymous"), "").otherwise(F.col("ip")).alias("addr"), F.col("ttl").cast("int").alias("probe_ttl"), (F.col("rtt_ns") / 1e3).alias("rtt"), ext.alias("icmpext")).alias("h")
    texts = _written(spark, d, hop, lambda h: F.struct(F.lit("trace").alias("type"), F.lit("a").alias("src"), F.lit("b").alias("dst"), h.alias("hops")))
    return J.exploded_hops(J.scamper(texts))


@query(f"WITH {HOPS_SQL} SELECT meas_idx, pos, pos + 1 AS ttl, CASE WHEN anonymous THEN '' ELSE ip END AS ip, rtt_ns, anonymous, FALSE AS mpls FROM hops")
def s08_mtr_reports(spark, d):
    from pathlight.sources import traces_json as J

    ms = F.col("rtt_ns") / 1e6
    hop = F.struct(F.when(F.col("anonymous"), "???").otherwise(F.col("ip")).alias("host"), ms.alias("Best"), ms.alias("Avg"), ms.alias("Wrst")).alias("h")
    texts = _written(spark, d, hop, lambda h: F.struct(F.struct(F.struct(F.lit("a").alias("src"), F.lit("b").alias("dst")).alias("mtr"), h.alias("hubs")).alias("report")))
    return J.exploded_hops(J.mtr(texts))


@query("SELECT user_id AS src, event_type AS dst, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, CAST(count(*) AS BIGINT) AS n, CAST(min(trunc(value * 1e6)) AS BIGINT) AS least_ns FROM events GROUP BY 1, 2, 3")
def x01_hourly_least_rtt(spark, d):
    from pathlight.streaming import rolling

    return rolling.least_by_window(S.latencies(spark, d)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


# --- simulation: draws are md5 sums of seed and keys, so SQL can draw the same


def draw_sql(*keys: str) -> str:
    """Of the seed 42 and these SQL expressions: a number in [0, 1)."""
    return f"(CAST('0x' || substr(md5(concat_ws(':', '42', {', '.join(keys)})), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


TRUTH_SQL = "truth AS (SELECT link_id, 1 + ((lo * 7 + hi * 13) % 20) / 2.0::DOUBLE AS x FROM links)"
NORMAL_SQL = f"sqrt(-2 * ln(greatest({draw_sql("'u'", 'path_id', 'k')}, 1.1102230246251565e-16))) * cos(2 * 3.141592653589793 * {draw_sql("'v'", 'path_id', 'k')})"
NOISY_SQL = f"""{TRUTH_SQL}, slow AS (SELECT link_id FROM links ORDER BY {draw_sql("'congested'", 'link_id')}, link_id LIMIT 2),
delays AS (SELECT link_id, CASE WHEN link_id IN (SELECT link_id FROM slow) THEN x * 5 ELSE x END AS x FROM truth),
totals AS (SELECT path_id, sum(x) AS total FROM coo JOIN delays USING (link_id) GROUP BY path_id),
drawn AS (SELECT path_id, k, total * exp(0.1 * ({NORMAL_SQL})) AS b FROM totals, (SELECT unnest([1, 2, 3]) AS k))"""


def with_sql(name: str, level: str, tables: str, sql: str) -> None:
    ORACLE_SQL[name] = f"{network_sql(level)},\n{tables}\n{sql}"


def true_delays(net: I.Network) -> DataFrame:
    return net.links.select("link_id", (1 + ((F.col("lo") * 7 + F.col("hi") * 13) % 20) / 2.0).alias("x"))


@query("SELECT * FROM (VALUES ('noise_scale', '0.1'), ('noise_model', 'lognormal'), ('congested_links', '2'), ('congestion_factor', '5.0'), ('samples', '3'), ('seed', '42'), ('path_fraction', '1.0')) AS t(name, value)")
def m07_simulation_defaults(spark, d):
    from dataclasses import asdict

    from pathlight.plans import simulate

    return spark.createDataFrame([(k, str(v)) for k, v in asdict(simulate.SimConfig()).items()], "name string, value string")


@query()
def m05_congested_delays(spark, d):
    from pathlight.plans import simulate

    return simulate.congest(true_delays(network(spark, d, "as")), simulate.SimConfig())


@query()
def m06_noisy_samples(spark, d):
    from pathlight.plans import simulate

    net, cfg = network(spark, d, "as"), simulate.SimConfig()
    return simulate.samples(E.path_sums(net.routing, simulate.congest(true_delays(net), cfg)), cfg).select("path_id", "k", F.round("b", 6).alias("b"))


@query()
def a07_least_samples(spark, d):
    from pathlight.plans import simulate

    net, cfg = network(spark, d, "as"), simulate.SimConfig()
    return simulate.observe(E.path_sums(net.routing, simulate.congest(true_delays(net), cfg)), cfg).select("path_id", F.round("b", 6).alias("b"))


with_sql("m05_congested_delays", "as", NOISY_SQL, "SELECT link_id, x FROM delays")
with_sql("m06_noisy_samples", "as", NOISY_SQL, "SELECT path_id, k, round(b, 6) AS b FROM drawn")
with_sql("a07_least_samples", "as", NOISY_SQL, "SELECT path_id, round(min(b), 6) AS b FROM drawn GROUP BY path_id")


@query()
def o04_resampled_paths(spark, d):
    from pathlight.plans import uncertainty

    rows = network(spark, d, "as").observed.select("path_id", "b")
    return uncertainty.resampled(rows, 5, 42).groupBy("replicate", "path_id").agg(F.count("*").alias("n"))


with_sql("o04_resampled_paths", "as", """placed AS (SELECT path_id, row_number() OVER (ORDER BY path_id) - 1 AS i FROM obs), size AS (SELECT count(*) AS n FROM obs),
draws AS (SELECT replicate, k, CAST('0x' || substr(md5(concat_ws(':', '42', replicate, k)), 1, 13) AS BIGINT) % n AS i
  FROM size, (SELECT unnest(range(5)) AS replicate), (SELECT i AS k FROM placed))""", "SELECT CAST(replicate AS INT) AS replicate, path_id, count(*) AS n FROM draws JOIN placed USING (i) GROUP BY replicate, path_id")


# --- GraphML: a file drawn from the nations, each with one of the ways to name and place a node


def graphml_files(spark, d) -> DataFrame:
    key, name = F.col("n_nationkey"), F.col("n_name")
    lat, lon = (key * 5 - 60).cast("string"), (key * 11 - 130).cast("string")
    cell = lambda k, *v: F.concat(F.lit(f'<data key="{k}">'), *v, F.lit("</data>"))
    label = F.when(key % 3 == 0, cell("d0", name)).when(key % 3 == 1, cell("d3", F.lit('<y:ShapeNode><y:Geometry height="3" x="'), lon, F.lit('" y="'), lat, F.lit('"/><y:NodeLabel visible="true"> '), name, F.lit(" </y:NodeLabel></y:ShapeNode>"))).otherwise("")
    place = F.when(key % 3 == 0, F.concat(cell("d1", lat), cell("d2", lon))).otherwise("")
    node = F.concat(F.lit('<node id="'), key.cast("string"), F.lit('">'), label, place, F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), key.cast("string"), F.lit('" target="'), (key + F.col("n_regionkey")).cast("string"), F.lit('"/>'))
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns" xmlns:y="http://www.yworks.com/xml/graphml">' + "".join(f'<key id="d{i}" for="node" attr.name="{a}"/>' for i, a in enumerate(("LABEL", "Latitude", "longitude"))) + '<key id="d3" for="node"/><graph edgedefault="undirected">'
    nation = S.table(spark, d, "nation")
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), c.alias("t")))), lambda x: x["t"]), "")
    text = F.concat(F.lit(head), listed(node), listed(edge), F.lit("</graph></graphml>"))
    return nation.agg(F.encode(text, "UTF-8").alias("content")).select(F.lit("/nations.graphml").alias("path"), "content")


@query("""SELECT 'nations' AS topo, CAST(n_nationkey AS BIGINT) AS node_id, CASE WHEN n_nationkey % 3 = 2 THEN 'n' || n_nationkey ELSE n_name END AS label,
CASE WHEN n_nationkey % 3 = 2 THEN 0.0::DOUBLE ELSE n_nationkey * 5.0::DOUBLE - 60 END AS lat, CASE WHEN n_nationkey % 3 = 2 THEN 0.0::DOUBLE ELSE n_nationkey * 11.0::DOUBLE - 130 END AS lon FROM nation""")
def s02_graphml_nodes(spark, d):
    from pathlight.sources import graphml

    return graphml.parsed(graphml_files(spark, d)).filter("kind = 'node'").selectExpr("topo", "i AS node_id", "label", "lat", "lon")


@query("""WITH e AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_nationkey AS a, n_nationkey + n_regionkey AS b FROM nation),
k AS (SELECT min(i) AS i FROM e WHERE a <> b AND b IN (SELECT n_nationkey FROM nation) GROUP BY least(a, b), greatest(a, b))
SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS BIGINT) AS link_id, CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst FROM k JOIN e USING (i)""")
def s01_graphml_links(spark, d):
    from pathlight.sources import graphml

    return G.build(graphml.parsed(graphml_files(spark, d)).filter("kind = 'edge'").select("i", "src", "dst"))


# --- the other orders of node groups


def _orders() -> None:
    keys = {"default": "first_link", "delay_desc": "max_delay DESC, first_link", "name": "src, first_link"}
    for mode, by in keys.items():

        def run(spark, d, mode=mode):
            net = network(spark, d, "as")
            groups = E.node_groups(net.links, prior_of(net), E.coverage(net.links, net.routing)).withColumn("max_delay", F.round("max_delay", 6))
            return E.ordered_groups(groups, mode).select("place", "src", "max_delay", "coverage")

        run.__name__ = f"o02_groups_{mode}"
        query(f"""SELECT CAST(row_number() OVER (ORDER BY {by}) AS BIGINT) AS place, src, max_delay, coverage FROM (SELECT src, min(l.link_id) AS first_link,
round(greatest(0.0, max(x)), 6) AS max_delay, CAST(sum(coverage) AS BIGINT) AS coverage FROM links l JOIN prior USING (link_id) JOIN cov USING (link_id) GROUP BY src)""", "as")(run)


_orders()


# --- solvers, on the AS network; what SQL solves by elimination is the network of regions, whose routing has full rank


ELIMINATED_SQL = network_sql("region").replace("WITH hops", "WITH RECURSIVE hops", 1) + """,
used AS (SELECT path_id, b FROM obs), m AS (SELECT count(*) AS n FROM links),
gram AS (SELECT x.link_id AS i, y.link_id AS j, CAST(count(*) AS DOUBLE) AS v FROM coo x JOIN coo y USING (path_id) GROUP BY ALL),
grid AS (SELECT p.link_id AS i, q.link_id AS j, coalesce(v, 0.0) AS v FROM links p CROSS JOIN links q LEFT JOIN gram ON gram.i = p.link_id AND gram.j = q.link_id),
right_side AS (SELECT link_id AS i, sum(b) AS v FROM coo JOIN used USING (path_id) GROUP BY link_id),
start AS (SELECT g.i, list_append(list(g.v ORDER BY j), any_value(r.v)) AS r FROM (SELECT grid.i, j, grid.v FROM grid) g JOIN right_side r USING (i) GROUP BY g.i),
step(k, i, r) AS (SELECT CAST(0 AS BIGINT), i, r FROM start UNION ALL
  SELECT k + 1, i, CASE WHEN i = k THEN list_transform(p, lambda x: x / p[k + 1]) ELSE list_transform(range(1, len(r) + 1), lambda c: r[c] - r[k + 1] / p[k + 1] * p[c]) END
  FROM (SELECT k, i, r, max(CASE WHEN i = k THEN r END) OVER (PARTITION BY k) AS p FROM step) WHERE k < (SELECT n FROM m)),
solved AS (SELECT i AS link_id, r[len(r)] AS x FROM step WHERE k = (SELECT n FROM m))"""


@query(f"{ELIMINATED_SQL} SELECT link_id, round(x, 6) AS x, TRUE AS identifiable, 'tsvd' AS method FROM solved")
def l04_least_squares(spark, d):
    from pathlight.plans import solve

    return solve.solution_rows(solve.settled(network(spark, d, "region")), "tsvd").withColumn("x", F.round("x", 6))


@query(f"{ELIMINATED_SQL} SELECT link_id, round(x, 6) AS x, TRUE AS identifiable, 'nnls' AS method FROM solved")
def l08_non_negative(spark, d):
    """Where the least squares solution is positive, it is the non-negative one."""
    from pathlight.plans import solve

    return solve.solution_rows(solve.settled(network(spark, d, "region")), "nnls").withColumn("x", F.round("x", 6))


@query(f"{ELIMINATED_SQL} SELECT CAST((SELECT n FROM m) AS INT) AS n_links, CAST(count(*) AS INT) AS n_paths, CAST((SELECT n FROM m) AS INT) AS rank, 0 AS n_unidentifiable FROM used")
def l02_rank_and_identifiability(spark, d):
    from pathlight.plans import solve, solvers

    s = solve.system_of(solve.settled(network(spark, d, "region")), False)
    q = solvers.audit(s.r, s.m)
    return spark.createDataFrame([(q.n, q.m, q.rank, len(q.unidentifiable))], "n_links int, n_paths int, rank int, n_unidentifiable int")


@query("SELECT CAST((SELECT count(*) FROM links) AS INT) AS rank", "region")
def l17_numerical_rank(spark, d):
    from pathlight.plans import design

    rows, net = path_rows(spark, d, "region")
    return spark.createDataFrame([(design.rank(rows, net.links.count()),)], "rank int")


def _solver(name: str, method: str) -> None:
    def run(spark, d):
        from pathlight.plans import solve

        return solve.solution_rows(solve.settled(network(spark, d, "as")), method)

    run.__name__ = name
    query()(run)


for _name, _method in (("l04_tsvd", "tsvd"), ("l05_tikhonov", "tikhonov"), ("l08_nnls", "nnls"), ("l09_admm", "admm"), ("l11_irl1", "irl1"), ("l12_vardi_em", "vardi-em"), ("l14_laplacian", "laplacian")):
    _solver(_name, _method)


def path_rows(spark, d, level: str = "as") -> tuple[DataFrame, I.Network]:
    from pathlight.plans import solve

    net = solve.settled(network(spark, d, level))
    return solve.rows_of(net.routing, net.observed), net


@query()
def l13_tomogravity(spark, d):
    from pathlight.plans import solve

    net = solve.settled(network(spark, d, "as"))
    some = net.routing.select("path_id").distinct()
    held = I.Network(net.nodes, net.links, net.paths.join(some, "path_id", "left_semi"), net.routing, net.observed.join(some, "path_id", "left_semi"))
    return solve.solution_rows(held, "tomogravity")


@query()
def l01_quality(spark, d):
    from pathlight.plans import solve, solvers

    s = solve.system_of(solve.settled(network(spark, d, "as")), False)
    q = solvers.audit(s.r, s.m)
    return spark.createDataFrame([(q.rank, q.n, q.m, q.condition, q.identifiable_share, q.unidentifiable, q.singular)], "rank int, n_links int, n_paths int, condition double, identifiable_share double, unidentifiable array<int>, singular array<double>")


@query()
def l06_gcv_grid(spark, d):
    from pathlight.plans import solve, solvers

    s = solve.system_of(solve.settled(network(spark, d, "as")), False)
    lam, score = solvers.gcv_curve(s.svd[0], s.svd[1], s.m)
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(lam, score, strict=True)], "lambda double, score double")


@query()
def l15_bootstrap(spark, d):
    from pathlight.plans import uncertainty

    rows, net = path_rows(spark, d)
    return uncertainty.bootstrap(rows, net.links.count(), "nnls")


@query()
def l16_conformal(spark, d):
    from pathlight.plans import uncertainty

    rows, net = path_rows(spark, d)
    return uncertainty.conformal(rows, net.links.count(), "nnls")


@query()
def l18_probe_plan(spark, d):
    from pathlight.plans import design

    rows, net = path_rows(spark, d)
    return design.running_rank(design.recommend(rows.limit(0), rows, net.links.count(), 50))


@query()
def l19_benchmark(spark, d):
    from pathlight.plans import design, solve, simulate

    _, net = path_rows(spark, d)
    truth = true_delays(net)
    cfg = simulate.SimConfig()
    seen = simulate.observe(E.path_sums(net.routing, simulate.congest(truth, cfg)), cfg)
    near = [(int(r["a"]), int(r["b"])) for r in G.link_adjacency(net.links).collect()]
    known = simulate.congest(truth, cfg).select("link_id", F.col("x").alias("truth"))
    return design.table(design.benchmark(solve.rows_of(net.routing, seen), known, net.links.count(), near=near))


@query()
def s20_preferential_attachment(spark, d):
    from pathlight.sources import synthetic

    return synthetic.barabasi_albert(spark, [("ba-30", 30, 2, 1), ("ba-50", 50, 3, 2)])


@query("""WITH RECURSIVE n AS (SELECT k AS node_id, CAST('0x' || substr(md5(concat_ws(':', '7', 'x', k)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS x, CAST('0x' || substr(md5(concat_ws(':', '7', 'y', k)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS y FROM (SELECT unnest(range(50)) AS k)),
d AS (SELECT a.node_id AS i, b.node_id AS j, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM n a JOIN n b ON a.node_id < b.node_id),
e AS (SELECT i, j FROM d WHERE CAST('0x' || substr(md5(concat_ws(':', '7', 'e', i, j)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < 0.3 * exp(-d / (0.4 * (SELECT max(d) FROM d)))),
reach(a, b) AS (SELECT node_id, node_id FROM n UNION SELECT r.a, CASE WHEN e.i = r.b THEN e.j ELSE e.i END FROM reach r JOIN e ON r.b IN (e.i, e.j)),
first AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT i * 50 + j AS i, i AS src, j AS dst FROM e UNION ALL SELECT 2500 + a, a - 1, a FROM first WHERE a = b AND a > 0""")
def s21_waxman(spark, d):
    from pathlight.sources import synthetic

    return synthetic.waxman(spark, 50, 0.4, 0.3, 7)[1]


@query()
def k03_json_document(spark, d):
    rows = report_rows(spark, d)
    return _sinks().json_document(rows, "gravity", 0.0, {"rank": 276, "num_links": 276, "condition_number": float("inf"), "identifiable_pct": 100.0})
