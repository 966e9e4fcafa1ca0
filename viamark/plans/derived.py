"""Road tables derived from the star-schema tables by integer arithmetic.

``lineitem`` gives the vertices of ways, ``orders`` the ways, ``customer``, ``supplier``
and ``part`` point, polygon and place layers, ``events`` the fixes of drives. The texts run
in Spark and in DuckDB alike, so that both sides of a comparison begin with the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vertices: one row for each item of an order, in a fixed order.
REFS = """
SELECT way_id, n, node_id, CAST(gx * 250 + (node_id * 31) % 97 - 48 AS DOUBLE) AS x, CAST(gy * 250 + (node_id * 17) % 89 - 44 AS DOUBLE) AS y
FROM (SELECT way_id, n, gx, gy, gx * 1000 + gy AS node_id
  FROM (SELECT l_orderkey AS way_id, n, (l_orderkey * 7919) % 149 + n AS gx, (l_orderkey * 104729) % 151 + l_partkey % 3 AS gy
    FROM (SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS n FROM lineitem) a) b) c"""
WAYS = """
SELECT o_orderkey AS way_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'primary' WHEN '2' THEN 'secondary' WHEN '3' THEN 'tertiary' WHEN '4' THEN 'residential' ELSE 'motorway' END AS highway,
  CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'P' THEN '-1' ELSE '' END AS oneway,
  concat(c_mktsegment, ' ', CAST(c_custkey % 40 AS STRING)) AS name,
  CASE o_orderkey % 5 WHEN 0 THEN 'gravel' WHEN 1 THEN 'asphalt' WHEN 2 THEN 'compacted' WHEN 3 THEN 'paved' ELSE '' END AS surface,
  o_orderkey % 9 = 0 AS scenic, c_nationkey AS region, c_custkey AS custkey
FROM orders JOIN customer ON o_custkey = c_custkey"""
WATER = "SELECT c_custkey AS id, CAST((c_custkey * 7919) % 37250 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 37750 AS DOUBLE) AS y, c_nationkey AS kind FROM customer"
PARKS = "SELECT s_suppkey AS id, CAST((s_suppkey * 7919) % 37250 AS DOUBLE) AS x, CAST((s_suppkey * 104729) % 37750 AS DOUBLE) AS y, CAST(60 * (s_suppkey % 10) + 50 AS DOUBLE) AS side FROM supplier"
PLACES = "SELECT p_partkey AS id, CAST((p_partkey * 6007) % 37250 AS DOUBLE) AS x, CAST((p_partkey * 99991) % 37750 AS DOUBLE) AS y, p_size AS size FROM part"
#: Fixes of drives: a user is a drive, events are fixes.
FIXES = """
SELECT user_id AS drive, event_id AS fix, ts, value AS speed, event_type AS kind,
  CAST((event_id * 7919) % 37250 AS DOUBLE) AS x, CAST((event_id * 104729) % 37750 AS DOUBLE) AS y FROM events"""
SEGMENTS = f"""
SELECT way_id, n, x, y, x2, y2, node_id, node2, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len
FROM (SELECT way_id, n, x, y, node_id, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(node_id) OVER w AS node2 FROM ({REFS}) r WINDOW w AS (PARTITION BY way_id ORDER BY n)) s
WHERE x2 IS NOT NULL"""
ROAD_LENGTH = f"SELECT s.way_id, sum(len) AS length FROM ({SEGMENTS}) s JOIN ({WAYS}) w ON s.way_id = w.way_id GROUP BY s.way_id"

#: Steps of edges: ways cut where a node is used twice or more; z runs from the edge's first vertex.
EDGE_STEPS = f"""
SELECT way_id, seq, n, node_id, node2, x, y, x2, y2, len, sum(len) OVER (PARTITION BY way_id, seq ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS z, sum(len) OVER (PARTITION BY way_id, seq) AS total FROM (
  SELECT *, sum(CASE WHEN rn = 1 OR uses >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY way_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seq, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len FROM (
    SELECT *, row_number() OVER (PARTITION BY way_id ORDER BY n) AS rn, count(*) OVER (PARTITION BY node_id) AS uses,
      lead(node_id) OVER (PARTITION BY way_id ORDER BY n) AS node2, lead(x) OVER (PARTITION BY way_id ORDER BY n) AS x2, lead(y) OVER (PARTITION BY way_id ORDER BY n) AS y2 FROM ({REFS}) r) a) b
WHERE node2 IS NOT NULL"""
#: Edges with the point in their middle. A way has at most 2,000 vertices, so way_id * 10000 + seq is an edge's own.
EDGES = f"""
SELECT way_id * 10000 + seq AS edge, way_id, seq, min_by(node_id, n) AS u, max_by(node2, n) AS v, sum(len) AS length_m, count(*) + 1 AS points,
  min_by(x + (CASE WHEN len > 0 THEN (total / 2 - z + len) / len ELSE 0.0 END) * (x2 - x), n) FILTER (WHERE z >= total / 2 - 1e-9) AS mx,
  min_by(y + (CASE WHEN len > 0 THEN (total / 2 - z + len) / len ELSE 0.0 END) * (y2 - y), n) FILTER (WHERE z >= total / 2 - 1e-9) AS my
FROM ({EDGE_STEPS}) s GROUP BY way_id, seq HAVING sum(len) >= 1"""
#: Edges with the tags of their ways and a score of their own.
ROADS = f"SELECT e.*, highway, oneway, name, surface, scenic, region, CAST((e.way_id * 37 + seq) % 100 AS DOUBLE) / 10 AS score FROM ({EDGES}) e JOIN ({WAYS}) w ON w.way_id = e.way_id"
NODES = f"SELECT node_id, min(x) AS x, min(y) AS y, count(*) AS uses FROM ({REFS}) r GROUP BY node_id"
#: Trips: every supplier's, from its park's nearest grid corner to one a few cells on.
TRIPS = """
SELECT s_suppkey AS trip, CAST((s_suppkey * 7919) % 143 + 2 AS BIGINT) AS gx, CAST((s_suppkey * 104729) % 145 + 2 AS BIGINT) AS gy, CAST(2 + s_suppkey % 3 AS BIGINT) AS ahead, s_nationkey AS region FROM supplier"""

_TABLES = ("lineitem", "orders", "customer", "supplier", "part", "events", "nation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """One of the texts above as a DataFrame over the tables of ``sf_dir``."""
    used = {t: table(spark, sf_dir, t) for t in _TABLES if re.search(rf"\b{t}\b", text)}
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN|,) {t}\b", rf"\1 {{{t}}} {t}", text)
    return spark.sql(text, **used)


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, geom (array of x, y), nodes (array of ids) and tags of every way with two vertices or more."""
    refs = derive(spark, sf_dir, REFS).groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("n", "x", "y", "node_id"))).alias("v"))
    lines = refs.where(F.size("v") > 1).select("way_id", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("geom"), F.col("v.node_id").alias("nodes"))
    return lines.join(derive(spark, sf_dir, WAYS), "way_id")
