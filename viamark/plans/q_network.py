"""Queries: edges, arcs and iterative jobs over the derived network."""

from __future__ import annotations

from pyspark.sql import functions as F

from viamark.functions.tags import SPEED_KMH
from viamark.operators import network
from viamark.operators.components import components
from viamark.plans.catalog import query
from viamark.plans.derived import REFS, WAYS, derive

_EDGES = f"""
SELECT way_id, seq, arg_min(node_id, n) AS u, arg_max(node2, n) AS v, sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))) AS length_m, count(*) + 1 AS points FROM (
  SELECT *, sum(CASE WHEN rn = 1 OR uses >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY way_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS seq FROM (
    SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY node_id) AS uses, lead(node_id) OVER w AS node2, lead(x) OVER w AS x2, lead(y) OVER w AS y2
    FROM ({REFS}) r WINDOW w AS (PARTITION BY way_id ORDER BY n)) a) b
WHERE node2 IS NOT NULL GROUP BY way_id, seq HAVING sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))) >= 1"""
_KMH = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SPEED_KMH.items())
_ROADS = f"SELECT e.way_id * 10000 + seq AS edge, u, v, length_m, highway, oneway, length_m / 1000 / (CASE highway {_KMH} END * CASE highway WHEN 'motorway' THEN 1.16 ELSE 0.95 END) * 60 AS minutes, CAST((e.way_id * 37 + seq) % 100 AS DOUBLE) / 10 AS score FROM ({_EDGES}) e JOIN ({WAYS}) w ON w.way_id = e.way_id"
_ARCS = f"SELECT edge, u AS tail, v AS head, minutes, length_m, score FROM ({_ROADS}) r WHERE oneway <> '-1' UNION ALL SELECT edge, v, u, minutes, length_m, score FROM ({_ROADS}) r WHERE oneway <> 'yes'"


def _edges(spark, sf_dir):
    e = network.edges(derive(spark, sf_dir, REFS))
    e = e.join(derive(spark, sf_dir, WAYS).select("way_id", "highway", "oneway").hint("merge"), "way_id")
    kmh = F.create_map(*[F.lit(x) for k, v in SPEED_KMH.items() for x in (k, float(v))])[F.col("highway")]
    e = e.withColumns({"edge": F.col("way_id") * 10000 + F.col("seq"), "minutes": network.minutes("length_m", kmh, "highway"), "score": ((F.col("way_id") * 37 + F.col("seq")) % 100).cast("double") / 10})
    return e.select("edge", "u", "v", "length_m", "highway", "oneway", "minutes", "score")


def _arcs(spark, sf_dir):
    return network.arcs(_edges(spark, sf_dir))


@query(f"SELECT way_id, seq, u, v, round(length_m, 3) AS length_m, points FROM ({_EDGES}) e")
def g1_edges(spark, sf_dir):
    return network.edges(derive(spark, sf_dir, REFS)).withColumn("length_m", F.round("length_m", 3))


@query(f"SELECT node_id, min(x) AS x, min(y) AS y FROM ({REFS}) r WHERE node_id IN (SELECT u FROM ({_EDGES}) e UNION SELECT v FROM ({_EDGES}) e) GROUP BY node_id")
def g2_nodes(spark, sf_dir):
    refs = derive(spark, sf_dir, REFS)
    return network.node_table(refs, network.edges(refs))


@query(f"SELECT tail, head, round(min(minutes), 6) AS minutes, arg_min(edge, (minutes, edge)) AS edge FROM ({_ARCS}) a WHERE tail <> head GROUP BY tail, head")
def g4_cheapest_arcs(spark, sf_dir):
    """Arcs of both directions and the cheapest of parallel ones."""
    return network.cheapest(_arcs(spark, sf_dir)).withColumn("minutes", F.round("minutes", 6))


@query(f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT u AS a, v AS b FROM ({_EDGES}) x WHERE u <> v UNION SELECT DISTINCT v, u FROM ({_EDGES}) x WHERE u <> v),
l(node, root, i) AS (SELECT DISTINCT a, a, 0 FROM e UNION ALL SELECT node, min(root), i + 1 FROM (SELECT node, root, i FROM l UNION ALL SELECT e.b, l.root, l.i FROM l JOIN e ON e.a = l.node) GROUP BY node, i HAVING i < 300)
SELECT root, count(*) AS nodes FROM l WHERE i = 300 GROUP BY root""")
def g6_components(spark, sf_dir):
    """Connected components of the undirected network, and their sizes."""
    e = _edges(spark, sf_dir).select(F.col("u").alias("a"), F.col("v").alias("b"))
    return components(e).groupBy("root").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"""
SELECT edge, tail, round(minutes + 0.25 * 8 * length_m / 1000 * (1 - score / 10), 6) AS cost_half, round(minutes + 8 * length_m / 1000 * (1 - score / 10), 6) AS cost_full FROM ({_ARCS}) a""")
def g12_scenic_costs(spark, sf_dir):
    a = _arcs(spark, sf_dir)
    return a.select("edge", "tail", F.round(network.scenic_cost(F.lit(0.5)), 6).alias("cost_half"), F.round(network.scenic_cost(F.lit(1.0)), 6).alias("cost_full"))


@query("""
WITH RECURSIVE p AS (SELECT o_orderkey AS node, o_orderkey // 2 AS parent, o_custkey % 100 AS v FROM orders),
w(node, up, total) AS (SELECT node, parent, CASE WHEN parent = node THEN 0 ELSE v END FROM p UNION ALL SELECT w.node, p.parent, w.total + CASE WHEN p.parent = p.node THEN 0 ELSE p.v END FROM w JOIN p ON p.node = w.up WHERE w.up <> 0)
SELECT node, max(total)::DOUBLE AS total FROM w GROUP BY node""")
def g10_path_sums(spark, sf_dir):
    """Sums along the way to the root of a tree of orders, by pointer doubling."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    p = o.select(F.col("o_orderkey").alias("node"), F.expr("o_orderkey div 2").alias("parent"), (F.col("o_custkey") % 100).cast("double").alias("v"))
    return network.path_sums(p, "v").select("node", "total")


@query(f"""
WITH RECURSIVE a AS MATERIALIZED (SELECT DISTINCT tail, head FROM ({_ARCS}) q WHERE tail <> head), d AS (SELECT node, count(*) AS n FROM (SELECT tail AS node FROM a UNION ALL SELECT head FROM a) z GROUP BY node), s AS (SELECT arg_min(node, (-n, node)) AS node FROM d),
f(node) AS (SELECT node FROM s UNION SELECT a.head FROM f JOIN a ON a.tail = f.node), b(node) AS (SELECT node FROM s UNION SELECT a.tail FROM b JOIN a ON a.head = b.node)
SELECT f.node FROM f JOIN b ON b.node = f.node""")
def g5_largest_scc(spark, sf_dir):
    """The largest strongly connected component. The SQL takes that of the busiest node; tests hold toy graphs against brute force."""
    return network.largest_scc(_arcs(spark, sf_dir))
