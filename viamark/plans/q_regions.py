"""Queries: regions, byways and attributes by place. Regions are squares, one for each nation, five in a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from viamark.functions import geometry as g
from viamark.operators import raster, regions, scenery, spatial
from viamark.plans.catalog import query
from viamark.plans.derived import EDGE_STEPS, EDGES, NODES, PARKS, PLACES, REFS, ROADS, SEGMENTS, WATER, WAYS, derive, roads
from viamark.plans.q_rasters import GRID
from viamark.plans.tables import stage

#: Regions of 6.5 km, with gaps of 1 km between them.
CORES = "SELECT n_nationkey AS region, CAST((n_nationkey % 5) * 7500 AS DOUBLE) AS x0, CAST(floor(n_nationkey / 5) * 7500 AS DOUBLE) AS y0, CAST((n_nationkey % 5) * 7500 + 6500 AS DOUBLE) AS x1, CAST(floor(n_nationkey / 5) * 7500 + 6500 AS DOUBLE) AS y1 FROM nation"
_DX, _DY = "greatest(x0 - x, x - x1, 0.0)", "greatest(y0 - y, y - y1, 0.0)"
_OWNERS = "SELECT p.pid, m.region FROM ({points}) p LEFT JOIN (SELECT pid, arg_min(region, (d, region)) AS region FROM (SELECT pid, region, sqrt(pow({dx}, 2) + pow({dy}, 2)) AS d FROM ({points}) p, ({cores}) c) z WHERE d <= 600 GROUP BY pid) m ON m.pid = p.pid"


def _owners_sql(points: str) -> str:
    return _OWNERS.format(points=points, cores=CORES, dx=_DX, dy=_DY)


_POINTS = f"SELECT id AS pid, x, y FROM ({PLACES}) p"
_MIDS = f"SELECT edge AS pid, mx AS x, my AS y FROM ({EDGES}) e"


@query(f"SELECT region, sum(CASE WHEN x >= x0 AND x < x1 AND y >= y0 AND y < y1 THEN 1 ELSE 0 END) AS owned, count(*) AS with_ring, round(avg(x - (x0 + x1) / 2), 3) AS mean_x FROM ({_POINTS}) p JOIN ({CORES}) c ON x >= x0 - 1500 AND x < x1 + 1500 AND y >= y0 - 1500 AND y < y1 + 1500 GROUP BY region")
def n1_region_halo(spark, sf_dir):
    """Places of every region and its ring, in the region's own coordinates."""
    h = regions.halo(derive(spark, sf_dir, _POINTS), derive(spark, sf_dir, CORES), 1500.0)
    return h.groupBy("region").agg(F.sum(F.col("owned").cast("int")).alias("owned"), F.count(F.lit(1)).alias("with_ring"), F.round(F.avg("local_x"), 3).alias("mean_x"))


@query(_owners_sql(_POINTS))
def j20_owners(spark, sf_dir):
    """The region of every place: the one around it, else the nearest within 600 m, else none."""
    return regions.owners(derive(spark, sf_dir, _POINTS), derive(spark, sf_dir, CORES), 600.0)


@query(f"SELECT o.region, count(*) AS owned, sum(CASE WHEN r.region <> o.region THEN 1 ELSE 0 END) AS from_elsewhere FROM ({_owners_sql(_MIDS)}) o JOIN ({ROADS}) r ON r.edge = o.pid WHERE o.region IS NOT NULL GROUP BY o.region")
def n3_owned_edges(spark, sf_dir):
    """Edges by the region that owns their middle, and those of them that another region's customer has."""
    o = regions.owners(derive(spark, sf_dir, _MIDS), derive(spark, sf_dir, CORES), 600.0).where("region is not null")
    r = derive(spark, sf_dir, ROADS).select(F.col("edge").alias("pid"), F.col("region").alias("home"))
    return o.join(r.hint("merge"), "pid").groupBy("region").agg(F.count(F.lit(1)).alias("owned"), F.sum(F.when(F.col("home") != F.col("region"), 1).otherwise(0)).alias("from_elsewhere"))


_LABELS = """l(node, root, i) AS (SELECT DISTINCT a, a, 0 FROM p UNION ALL SELECT node, min(root), i + 1 FROM (SELECT * FROM l UNION ALL SELECT p.b, l.root, l.i FROM l JOIN p ON p.a = l.node) q GROUP BY node, i HAVING i < {n}), comp AS MATERIALIZED (SELECT node, root FROM l WHERE i = {n})"""


@query(f"""
WITH RECURSIVE o AS MATERIALIZED (SELECT e.edge, e.u, e.v, w.region FROM ({EDGES}) e JOIN ({_owners_sql(_MIDS)}) w ON w.pid = e.edge WHERE w.region IS NOT NULL), p AS MATERIALIZED (SELECT u AS a, v AS b FROM o WHERE u <> v UNION SELECT v, u FROM o WHERE u <> v),
{_LABELS.format(n=300)}, main AS (SELECT node FROM comp WHERE root = (SELECT arg_min(root, (-n, root)) FROM (SELECT root, count(*) AS n FROM comp GROUP BY root) z))
SELECT region, count(*) AS edges, CAST(sum(CASE WHEN u IN (SELECT node FROM main) THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM o GROUP BY region""")
def n4_stitch(spark, sf_dir):
    """The largest component over all owned edges, and each region's share in it."""
    own = regions.owners(derive(spark, sf_dir, _MIDS), derive(spark, sf_dir, CORES), 600.0).where("region is not null").withColumnRenamed("pid", "edge")
    e = derive(spark, sf_dir, EDGES).select("edge", "u", "v").join(own.hint("merge"), "edge")
    return regions.stitched(e).groupBy("region").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.col("kept").cast("int")).alias("kept"))


@query(f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT u, v FROM ({ROADS}) r WHERE highway = 'residential' AND u <> v), p AS MATERIALIZED (SELECT u AS a, v AS b FROM e UNION SELECT v, u FROM e), {_LABELS.format(n=100)},
r AS (SELECT root AS pid, min((x, y)) AS m, count(*) AS nodes FROM comp JOIN ({NODES}) n ON n.node_id = comp.node GROUP BY root), q AS MATERIALIZED (SELECT pid, m[1] AS x, m[2] AS y, nodes FROM r), o AS ({_owners_sql("SELECT pid, x, y FROM q")})
SELECT region, row_number() OVER (PARTITION BY region ORDER BY o.pid) AS component, nodes FROM o JOIN q ON q.pid = o.pid WHERE region IS NOT NULL""")
def n5_access_components(spark, sf_dir):
    """Components of residential roads, each whole in one region and numbered there."""
    e = derive(spark, sf_dir, ROADS).where("highway = 'residential' and u <> v")
    nodes = derive(spark, sf_dir, NODES).select(F.col("node_id").alias("node"), "x", "y")
    return regions.access_components(e, nodes, derive(spark, sf_dir, CORES), 600.0)


@query(f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT edge, u, v FROM ({ROADS}) r WHERE highway = 'residential' AND u <> v), p AS MATERIALIZED (SELECT u AS a, v AS b FROM e UNION SELECT v, u FROM e), {_LABELS.format(n=100)},
d AS (SELECT u AS node FROM ({ROADS}) r WHERE highway <> 'residential' AND edge % 10 < 9 UNION SELECT v FROM ({ROADS}) r WHERE highway <> 'residential' AND edge % 10 < 9), o AS (SELECT u AS node FROM ({ROADS}) r WHERE highway <> 'residential' UNION SELECT v FROM ({ROADS}) r WHERE highway <> 'residential'),
n AS (SELECT count(*) AS new_, (SELECT count(*) FROM comp WHERE node IN (SELECT node FROM o)) AS old_ FROM comp WHERE node IN (SELECT node FROM d))
SELECT 'access_entries' AS layer, new_ AS rows, new_ <> old_ AS changed FROM n UNION ALL SELECT 'access_ways', count(*), false FROM e UNION ALL SELECT 'roads', count(*), false FROM ({ROADS}) r UNION ALL SELECT 'parks', count(*), false FROM ({PARKS}) k""")
def v17_access_rebuild(spark, sf_dir):
    """The access layer built again after some roads were closed to cars, the other layers left as they lie."""
    r = stage(derive(spark, sf_dir, ROADS), "roads")
    own = r.where("highway = 'residential' and u <> v").select("edge", "u", "v")
    ends = lambda keep: r.where(f"highway <> 'residential' and {keep}").select(F.explode(F.array("u", "v")).alias("node"))
    ways, entries = (stage(t, "access") for t in regions.access_layer(own, ends("true")))
    again = dict(zip(("access_ways", "access_entries"), regions.access_layer(own, ends("edge % 10 < 9"))))
    old = {"access_ways": ways, "access_entries": entries, "roads": r.select("edge", "u", "v", "highway"), "parks": derive(spark, sf_dir, PARKS)}
    return regions.rebuilt(old, {k: stage(t, "access") for k, t in again.items()})


_NATIONAL = f"SELECT edge AS national_edge, way_id, seq, region FROM ({ROADS}) r"
_PART = f"SELECT way_id % 3 AS region, way_id * 7 + seq AS edge, way_id, seq FROM ({EDGES}) e"
_SIDE = f"SELECT way_id % 3 AS region, way_id * 7 + seq AS edge, CASE WHEN length_m > 500 THEN 'long' ELSE 'short' END AS tag FROM ({EDGES}) e UNION ALL SELECT way_id % 3, way_id * 7 + seq, 'short' FROM ({EDGES}) e"


@query(f"SELECT DISTINCT n.national_edge, s.region, s.tag FROM ({_SIDE}) s JOIN ({_PART}) p ON p.region = s.region AND p.edge = s.edge JOIN ({_NATIONAL}) n ON n.way_id = p.way_id AND n.seq = p.seq WHERE n.region % 3 = s.region")
def n6_side_tables(spark, sf_dir):
    """Rows of regional side tables under national edge numbers, owned rows only, each once."""
    nat = derive(spark, sf_dir, _NATIONAL).withColumn("region", F.col("region") % 3)
    return regions.remapped(derive(spark, sf_dir, _SIDE), derive(spark, sf_dir, _PART), nat, ["tag"]).select("national_edge", "region", "tag")


@query(f"""
WITH b AS (SELECT region, count(*) AS edges, count(DISTINCT u) AS tails, sum(length_m) / 1000 AS km FROM ({ROADS}) r GROUP BY region)
SELECT region, edges, round(km, 4) AS km, round((edges * 88 + tails * 24) / 1048576.0, 6)::DOUBLE AS mb, round(edges / sum(edges) OVER (), 8) AS share, edges * 88 + tails * 24 > 100000 AS over_budget FROM b""")
def n7_region_budget(spark, sf_dir):
    """Size and share of every region's tables against a budget."""
    from pyspark.sql import Window

    b = derive(spark, sf_dir, ROADS).groupBy("region").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("u").alias("tails"), (F.sum("length_m") / 1000).alias("km"))
    size, every = F.col("edges") * 88 + F.col("tails") * 24, Window.partitionBy(F.lit(0))  # as many rows as regions
    return b.select("region", "edges", F.round("km", 4).alias("km"), F.round(size / 1048576.0, 6).alias("mb"), F.round(F.col("edges") / F.sum("edges").over(every), 8).alias("share"), (size > 100000).alias("over_budget"))


@query(f"SELECT w.region, count(*) AS ways, sum(CASE WHEN b.l_orderkey IS NOT NULL THEN 1 ELSE 0 END) AS byways FROM ({WAYS}) w LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey % 10 = 0) b ON b.l_orderkey = w.way_id GROUP BY w.region")
def j15_byway_members(spark, sf_dir):
    """Ways that a designated relation (a supplier's orders) names."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # A relation's member list is a property of the input; here it is rebuilt in parts of at most 1,000.
    parts = li.select("l_suppkey", "l_orderkey", (F.col("l_orderkey") % 1000).alias("part")).groupBy("l_suppkey", "part").agg(F.collect_set("l_orderkey").alias("members"))
    rel = parts.select((F.col("l_suppkey") % 10 == 0).alias("designated"), "members")
    flagged = regions.members_flag(derive(spark, sf_dir, WAYS), rel)
    return flagged.groupBy("region").agg(F.count(F.lit(1)).alias("ways"), F.sum(F.col("byway").cast("int")).alias("byways"))


_T = "CASE WHEN s.len > 0 THEN greatest(0.0, least(1.0, ((p.x - s.x) * (s.x2 - s.x) + (p.y - s.y) * (s.y2 - s.y)) / (s.len * s.len))) ELSE 0.0 END"


def _near_ways(points: str, d: float, where: str = "TRUE") -> str:
    """pid, way columns and dist of ways within d of points."""
    return f"""
SELECT pid, way_id, name, highway, surface, min(sqrt(pow(px - x - t * (x2 - x), 2) + pow(py - y - t * (y2 - y), 2))) AS dist FROM (SELECT p.pid, p.x AS px, p.y AS py, s.x, s.y, s.x2, s.y2, w.way_id, w.name, w.highway, w.surface, {_T} AS t FROM ({points}) p
  JOIN ({SEGMENTS}) s ON least(s.x, s.x2) - {d} <= p.x AND greatest(s.x, s.x2) + {d} >= p.x AND least(s.y, s.y2) - {d} <= p.y AND greatest(s.y, s.y2) + {d} >= p.y JOIN ({WAYS}) w ON w.way_id = s.way_id WHERE {where}) z
GROUP BY ALL HAVING min(sqrt(pow(px - x - t * (x2 - x), 2) + pow(py - y - t * (y2 - y), 2))) <= {d}"""


@query(f"""
WITH o AS ({_owners_sql(_POINTS)}), n AS (SELECT pid, arg_min(name, (name)) AS name FROM ({_near_ways(_POINTS, 40.0, "w.scenic")}) q GROUP BY pid)
SELECT o.pid, o.region, n.name FROM o LEFT JOIN n ON n.pid = o.pid""")
def j21_attributes(spark, sf_dir):
    """Region and the first name of a scenic road within 40 m of every place."""
    p = derive(spark, sf_dir, _POINTS)
    o = regions.owners(p, derive(spark, sf_dir, CORES), 600.0)
    segs = spatial.exploded(roads(spark, sf_dir).where("scenic"), "name")
    near = spatial.near_pairs(p, segs, "name", 40.0).groupBy("pid").agg(F.min("name").alias("name"))
    return o.join(near.hint("merge"), "pid", "left")


_RECT = "greatest(abs(p.x - q.x) - q.side / 2, abs(p.y - q.y) - q.side / 2)"
_BOXD = "sqrt(pow(greatest(abs(p.x - q.x) - q.side / 2, 0), 2) + pow(greatest(abs(p.y - q.y) - q.side / 2, 0), 2))"
_BIG = f"SELECT id, x, y, side * 3 AS side, id % 3 AS class, id % 4 AS designation FROM ({PARKS}) k"


def _big(spark, sf_dir):
    b = derive(spark, sf_dir, _BIG)
    return b.withColumn("geom", g.square(F.col("x"), F.col("y"), F.col("side")))


_FLAG = "max(CASE WHEN {c} AND p.x < q.x + q.side / 2 AND p.x >= q.x - q.side / 2 AND p.y < q.y + q.side / 2 AND p.y >= q.y - q.side / 2 THEN 1 ELSE 0 END) = 1 AS {n}, max(CASE WHEN {c} AND " + _BOXD + " <= {d} THEN 1 ELSE 0 END) = 1 AS {n}_near"


@query(f"SELECT pid, {_FLAG.format(c='class < 2 AND designation > 0', n='landmark', d=80)} FROM ({_MIDS}) p JOIN ({_BIG}) q ON {_BOXD} <= 80 GROUP BY pid")
def j22_landmarks(spark, sf_dir):
    """Edges with their middle in a landmark polygon, and within 80 m of one."""
    mids = stage(derive(spark, sf_dir, _MIDS), "middles")
    f = regions.polygon_flags(mids, _big(spark, sf_dir), {"landmark": (F.col("class") < 2) & (F.col("designation") > 0)}, 80.0, 1000.0)
    touched = regions.polygon_flags(mids, _big(spark, sf_dir), {"any": F.lit(True)}, 80.0, 1000.0).where("any_near").select("pid")
    return f.join(touched.hint("merge"), "pid", "left_semi").select("pid", "landmark", "landmark_near")


@query(f"SELECT pid, {_FLAG.format(c='class = 0', n='landmark', d=500)}, {_FLAG.format(c='designation <= 1', n='protected', d=500)} FROM ({_MIDS}) p JOIN ({_BIG}) q ON {_BOXD} <= 500 GROUP BY pid")
def v22_designations(spark, sf_dir):
    """Several designations at the middle of edges, inside and within 500 m."""
    f = regions.polygon_flags(stage(derive(spark, sf_dir, _MIDS), "middles"), _big(spark, sf_dir), {"landmark": F.col("class") == 0, "protected": F.col("designation") <= 1, "any": F.lit(True)}, 500.0, 1000.0)
    return f.where("any_near").select("pid", "landmark", "landmark_near", "protected", "protected_near")


#: Shores of 96 vertices around parks, 20 times as wide.
_SHORES = f"SELECT id, x + side * 10 * (1 + 0.3 * sin(7 * a)) * cos(a) AS x, y + side * 10 * (1 + 0.3 * sin(7 * a)) * sin(a) AS y, k FROM (SELECT q.*, k, k * 0.06544984694978735 AS a FROM ({PARKS}) q, LATERAL (SELECT unnest(range(0, 96)) AS k) z) w"
_CROSS = f"SELECT id, x AS ax, y AS ay, lead(x, 1, x0) OVER w AS nx, lead(y, 1, y0) OVER w AS ny FROM (SELECT *, first_value(x) OVER (PARTITION BY id ORDER BY k) AS x0, first_value(y) OVER (PARTITION BY id ORDER BY k) AS y0 FROM ({_SHORES}) s) t WINDOW w AS (PARTITION BY id ORDER BY k)"
_IN_SHORE = f"SELECT pid, id FROM (SELECT p.pid, s.id, count(*) AS n FROM ({_POINTS}) p JOIN sh s ON (ay > p.y) <> (ny > p.y) WHERE p.x < (nx - ax) * (p.y - ay) / (ny - ay) + ax GROUP BY 1, 2) z WHERE n % 2 = 1"


def _shores(spark, sf_dir):
    a = F.col("k") * 0.06544984694978735
    r = F.col("side") * 10 * (1 + 0.3 * F.sin(7 * a))
    p = derive(spark, sf_dir, PARKS).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(95)))).select("id", "k", (F.col("x") + r * F.cos(a)).alias("x"), (F.col("y") + r * F.sin(a)).alias("y"))
    return p.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("geom"))


@query(f"WITH sh AS MATERIALIZED ({_CROSS}) {_IN_SHORE}")
def d13_in_cut_polygons(spark, sf_dir):
    """Places and the polygons around them; polygons over 64 vertices are cut into cells of segments and flags."""
    return spatial.containing(derive(spark, sf_dir, _POINTS), _shores(spark, sf_dir), "id", 1000.0, 64)


@query(f"""
WITH sh AS MATERIALIZED ({_CROSS}), d AS (SELECT DISTINCT pid FROM (SELECT p.pid, sqrt(pow(p.x - ax - t * (nx - ax), 2) + pow(p.y - ay - t * (ny - ay), 2)) AS dist FROM (SELECT p.*, s.*, greatest(0.0, least(1.0, ((p.x - ax) * (nx - ax) + (p.y - ay) * (ny - ay)) / (pow(nx - ax, 2) + pow(ny - ay, 2)))) AS t FROM ({_POINTS}) p JOIN sh s ON least(ax, nx) - 80 <= p.x AND greatest(ax, nx) + 80 >= p.x AND least(ay, ny) - 80 <= p.y AND greatest(ay, ny) + 80 >= p.y) p) z WHERE dist <= 80)
SELECT pid FROM d UNION SELECT pid FROM ({_IN_SHORE}) i""")
def d13_near_large_polygons(spark, sf_dir):
    """Places in or within 80 m of large polygons, by segments in cells and flags of cells."""
    return regions.near_polygons(derive(spark, sf_dir, _POINTS), _shores(spark, sf_dir), 80.0, 1000.0, 64)


_WAYBOX = f"SELECT way_id AS id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM ({REFS}) r GROUP BY way_id"
_PARKBOX = f"SELECT id, x - side / 2 AS x0, y - side / 2 AS y0, x + side / 2 AS x1, y + side / 2 AS y1 FROM ({PARKS}) p"


@query(f"SELECT b.id AS park, count(*) AS ways FROM ({_WAYBOX}) a JOIN ({_PARKBOX}) b ON a.x0 <= b.x1 + 100 AND a.x1 >= b.x0 - 100 AND a.y0 <= b.y1 + 100 AND a.y1 >= b.y0 - 100 GROUP BY b.id")
def d14_boxes(spark, sf_dir):
    """Ways whose box meets a park's box padded by 100 m."""
    # Ways with equal boxes are one class, which counts as many times as it has ways.
    classes = regions.box_classes(derive(spark, sf_dir, _WAYBOX))
    pairs = regions.box_pairs(classes, derive(spark, sf_dir, _PARKBOX), 100.0, 1000.0)
    return pairs.join(classes.select(F.col("id").alias("a_id"), "n").hint("merge"), "a_id").groupBy(F.col("b_id").alias("park")).agg(F.sum("n").alias("ways"))


_HEX = f"SELECT id, x, y, side * 6 AS side, id % 3 AS carrier, CAST(id % 4 AS INT) AS env FROM ({PARKS}) k"


@query(f"""
WITH h AS (SELECT p.pid, q.carrier, max(q.env) AS env FROM ({_MIDS}) p JOIN ({_HEX}) q ON {_RECT} <= 0 WHERE p.x < q.x + q.side / 2 AND p.x >= q.x - q.side / 2 AND p.y < q.y + q.side / 2 AND p.y >= q.y - q.side / 2 GROUP BY 1, 2)
SELECT carrier, env, count(*) AS samples FROM h GROUP BY carrier, env""")
def j32_route_coverage(spark, sf_dir):
    """The best environment of each carrier around the middle of every edge."""
    h = derive(spark, sf_dir, _HEX).withColumn("geom", g.square(F.col("x"), F.col("y"), F.col("side")))
    return regions.best_cover(derive(spark, sf_dir, _MIDS), h, 2000.0).groupBy("carrier", "env").agg(F.count(F.lit(1)).alias("samples"))


@query(f"""
WITH c AS (SELECT DISTINCT p.pid FROM ({_MIDS}) p JOIN ({_HEX}) q ON {_RECT} <= 0 WHERE q.env >= 2 AND p.x < q.x + q.side / 2 AND p.x >= q.x - q.side / 2 AND p.y < q.y + q.side / 2 AND p.y >= q.y - q.side / 2),
s AS (SELECT r.way_id, r.seq, r.region, r.length_m, c.pid IS NULL AS bare FROM ({ROADS}) r LEFT JOIN c ON c.pid = r.edge), g AS (SELECT *, seq - row_number() OVER (PARTITION BY way_id, bare ORDER BY seq) AS run FROM s),
x AS (SELECT way_id, any_value(region) AS region, sum(length_m) AS m FROM g WHERE bare GROUP BY way_id, run), w AS (SELECT region, count(DISTINCT way_id) AS crossing FROM x WHERE m >= 1000 GROUP BY region)
SELECT t.region, t.bare_share, coalesce(w.crossing, 0) AS crossing FROM (SELECT region, round(sum(CASE WHEN bare THEN length_m ELSE 0 END) / sum(length_m), 8) AS bare_share FROM s GROUP BY ROLLUP (region)) t LEFT JOIN w ON w.region = t.region""")
def a27_uncovered(spark, sf_dir):
    """Uncovered shares by region with a total, and drives (ways) that cross 1 km or more without cover."""
    from pyspark.sql import Window

    h = derive(spark, sf_dir, _HEX).where("env >= 2").withColumn("geom", g.square(F.col("x"), F.col("y"), F.col("side")))
    covered = regions.best_cover(derive(spark, sf_dir, _MIDS), h, 2000.0).select(F.col("pid").alias("edge"), F.lit(False).alias("bare")).distinct()
    s = derive(spark, sf_dir, ROADS).join(covered.hint("merge"), "edge", "left").withColumn("bare", F.coalesce("bare", F.lit(True)))
    share = s.rollup("region").agg(F.round(F.sum(F.when(F.col("bare"), F.col("length_m")).otherwise(0.0)) / F.sum("length_m"), 8).alias("bare_share"))
    runs = s.withColumn("run", F.col("seq") - F.row_number().over(Window.partitionBy("way_id", "bare").orderBy("seq"))).where("bare")
    long = runs.groupBy("way_id", "run").agg(F.first("region").alias("region"), F.sum("length_m").alias("m")).where("m >= 1000").groupBy("region").agg(F.countDistinct("way_id").alias("crossing"))
    return share.join(long.hint("merge"), "region", "left").withColumn("crossing", F.coalesce("crossing", F.lit(0)))


_LINE_SAMPLES = f"""
SELECT c.way_id * 10000 + c.k AS pid, c.way_id, c.piece, arg_min(s.x + t * (s.x2 - s.x), s.n) AS x, arg_min(s.y + t * (s.y2 - s.y), s.n) AS y FROM (
  SELECT way_id, k, total / n AS piece, (k + 0.5) * total / n AS at FROM (SELECT way_id, total, n, unnest(range(0, n)) AS k FROM (SELECT s.way_id, sum(len) AS total, CAST(greatest(1, ceil(sum(len) / 100)) AS BIGINT) AS n FROM ({SEGMENTS}) s JOIN ({WAYS}) w ON w.way_id = s.way_id WHERE w.oneway = '-1' GROUP BY s.way_id) a) b) c
  JOIN (SELECT *, sum(len) OVER (PARTITION BY way_id ORDER BY n ROWS UNBOUNDED PRECEDING) - len AS pos FROM ({SEGMENTS}) q) s ON s.way_id = c.way_id AND s.pos + s.len >= c.at - 1e-9,
  LATERAL (SELECT CASE WHEN s.len > 0 THEN greatest(0.0, least(1.0, (c.at - s.pos) / s.len)) ELSE 0.0 END AS t) z GROUP BY ALL"""


def _line_matches(spark, sf_dir):
    """Samples each 100 m of the agency's lines (oneway -1) with the nearest other way within 15 m."""
    r = roads(spark, sf_dir).withColumn("parts", g.located("geom")).withColumn("total", F.aggregate("parts", F.lit(0.0), lambda t, s: t + s["len"]))
    a = r.where("oneway = '-1' and total > 0").withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("total") / 100)).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    a = a.withColumn("p", g.point_on("parts", (F.col("k") + 0.5) * F.col("total") / F.col("n") - 1e-9))
    a = a.select((F.col("way_id") * 10000 + F.col("k")).alias("pid"), F.col("surface").alias("own_surface"), F.col("highway").alias("own_class"), (F.col("total") / F.col("n")).alias("piece"), "p.x", "p.y")
    segs = spatial.alike(spatial.exploded(r.where("oneway <> '-1'"), "way_id"), "way_id")
    near = spatial.near_pairs(a.select("pid", "x", "y"), segs, "way_id", 15.0).groupBy("pid").agg(F.min(F.struct(F.round("dist", 6).alias("dist"), "way_id")).alias("m")).select("pid", "m.way_id")
    ways = derive(spark, sf_dir, WAYS).select("way_id", "highway", "surface")
    return a.join(near.join(ways.hint("merge"), "way_id").hint("merge"), "pid", "left")


_MATCHED = f"""
SELECT a.pid, a.piece, o.surface AS own_surface, o.highway AS own_class, w.highway, w.surface FROM ({_LINE_SAMPLES}) a JOIN ({WAYS}) o ON o.way_id = a.way_id
LEFT JOIN (SELECT pid, arg_min(way_id, (round(dist, 6), way_id)) AS way_id FROM ({_near_ways(f"SELECT * FROM ({_LINE_SAMPLES}) ls", 15.0, "w.oneway <> '-1'")}) q GROUP BY pid) m ON m.pid = a.pid LEFT JOIN ({WAYS}) w ON w.way_id = m.way_id"""


@query(f"SELECT own_surface, surface, highway, round(sum(piece) / 1000, 4) AS km FROM ({_MATCHED}) m GROUP BY ALL")
def j33_agency_km(spark, sf_dir):
    """Km of an agency's lines by their surface and by class and surface of the way within 15 m."""
    return _line_matches(spark, sf_dir).groupBy("own_surface", "surface", "highway").agg(F.round(F.sum("piece") / 1000, 4).alias("km"))


@query(f"SELECT own_class, coalesce(highway, 'none') AS matched, round(sum(piece) / 1000, 4) AS km, round(sum(piece) / sum(sum(piece)) OVER (PARTITION BY own_class), 8) AS share FROM ({_MATCHED}) m GROUP BY 1, 2")
def v7_class_agreement(spark, sf_dir):
    """V7: an agency's classes against those of the matched ways, km and shares."""
    from pyspark.sql import Window

    m = _line_matches(spark, sf_dir).groupBy("own_class", F.coalesce("highway", F.lit("none")).alias("matched")).agg(F.sum("piece").alias("m"))
    return m.select("own_class", "matched", F.round(F.col("m") / 1000, 4).alias("km"), F.round(F.col("m") / F.sum("m").over(Window.partitionBy("own_class")), 8).alias("share"))


@query(f"""
WITH a AS (SELECT DISTINCT region, name FROM ({WAYS}) w WHERE scenic), s AS (SELECT DISTINCT region, name FROM ({WAYS}) w WHERE surface = 'asphalt')
SELECT coalesce(a.region, s.region) AS region, CAST(sum(CASE WHEN a.name IS NOT NULL AND s.name IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS admitted, CAST(sum(CASE WHEN a.name IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missed, CAST(sum(CASE WHEN s.name IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unseen FROM a FULL JOIN s ON a.region = s.region AND a.name = s.name GROUP BY 1""")
def v8_byway_admission(spark, sf_dir):
    """V8: names on both lists of byways and on only one, by region."""
    w = derive(spark, sf_dir, WAYS)
    return regions.admissions(w.where("scenic"), w.where("surface = 'asphalt'"), "region")


@query(f"""
WITH n AS (SELECT name, highway, count(*) AS c, max(CASE WHEN scenic THEN 1 ELSE 0 END) = 1 AS admitted FROM ({WAYS}) w GROUP BY name, highway)
SELECT name AS network, string_split(name, ' ')[1] AS state, regexp_matches(name, '[0-9]') AS numbered, max(c) AS most, max(admitted::INT) = 1 AS admitted FROM n WHERE regexp_matches(name, '^(BUILDING|MACHINERY) [1-3]') GROUP BY name""")
def b27_byway_census(spark, sf_dir):
    """Networks whose name matches, with the state in it, the most seen at once, and whether one is admitted."""
    n = derive(spark, sf_dir, WAYS).groupBy("name", "highway").agg(F.count(F.lit(1)).alias("count"), F.max("scenic").alias("admitted"))
    return regions.byway_census(n, "^(BUILDING|MACHINERY) [1-3]")


@query(f"SELECT highway, count(*) AS edges, round(sum(CASE WHEN surface <> '' THEN length_m ELSE 0 END) / 1000, 4) AS surface_km, round(sum(CASE WHEN oneway <> '' THEN length_m ELSE 0 END) / 1000, 4) AS oneway_km FROM ({ROADS}) r GROUP BY highway")
def j38_edge_tags(spark, sf_dir):
    """Tags of ways joined to their edges: km of each class with a tag."""
    e = derive(spark, sf_dir, EDGES).select("way_id", "length_m").join(derive(spark, sf_dir, WAYS).select("way_id", "highway", "surface", "oneway").hint("merge"), "way_id", "left")
    km = lambda c: F.round(F.sum(F.when(c, F.col("length_m")).otherwise(0.0)) / 1000, 4)
    return e.where("highway is not null").groupBy("highway").agg(F.count(F.lit(1)).alias("edges"), km(F.col("surface") != "").alias("surface_km"), km(F.col("oneway") != "").alias("oneway_km"))


@query(f"SELECT way_id, count(*) AS vertices, round((SELECT sum(len) FROM ({SEGMENTS}) s WHERE s.way_id = q.way_id), 3) AS length_m FROM (SELECT *, lag(x) OVER (PARTITION BY way_id ORDER BY n) AS px, lag(y) OVER (PARTITION BY way_id ORDER BY n) AS py FROM ({REFS}) r) q WHERE px IS NULL OR px <> x OR py <> y GROUP BY way_id HAVING way_id IN (SELECT way_id FROM ({SEGMENTS}) z)")
def d15_stitched(spark, sf_dir):
    """Steps of every way stitched to one line without repeated vertices, those driven backwards turned round."""
    s = derive(spark, sf_dir, EDGE_STEPS).select("way_id", "n", F.array(g.point(F.col("x"), F.col("y")), g.point(F.col("x2"), F.col("y2"))).alias("piece"))
    back = s.withColumns({"back": F.col("n") % 2 == 0, "piece": F.when(F.col("n") % 2 == 0, F.reverse("piece")).otherwise(F.col("piece"))})
    turned = back.withColumn("piece", F.when(F.col("back"), F.reverse("piece")).otherwise(F.col("piece")))
    line = turned.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("p")).select("way_id", g.stitch(F.col("p.piece")).alias("geom"))
    return line.select("way_id", F.size("geom").cast("long").alias("vertices"), F.round(g.length("geom"), 3).alias("length_m"))


_AT200 = f"""
SELECT r.way_id, any_value(total) AS total, any_value(x0) AS x0, any_value(y0) AS y0, arg_min(x + t * (x2 - x), n) AS x, arg_min(y + t * (y2 - y), n) AS y FROM (SELECT *, CASE WHEN len > 0 THEN greatest(0.0, least(1.0, (least(200.0, total) - pos) / len)) ELSE 0.0 END AS t FROM (
  SELECT *, sum(len) OVER (PARTITION BY way_id ORDER BY n ROWS UNBOUNDED PRECEDING) - len AS pos, sum(len) OVER (PARTITION BY way_id) AS total, first_value(x) OVER (PARTITION BY way_id ORDER BY n) AS x0, first_value(y) OVER (PARTITION BY way_id ORDER BY n) AS y0 FROM ({SEGMENTS}) s) q) r WHERE pos + len >= least(200.0, total) - 1e-9 GROUP BY r.way_id"""


@query(f"SELECT way_id, round(total, 3) AS length_m, round((degrees(atan2(x - x0, y - y0)) + 360) % 360, 3) AS direction FROM ({_AT200}) q WHERE total > 0")
def d17_chord_direction(spark, sf_dir):
    """Length along every road and its direction over the chord of its first 200 m."""
    r = roads(spark, sf_dir).withColumn("parts", g.located("geom")).withColumn("total", F.element_at(g.cumulative("geom"), -1)).where("total > 0")
    end = g.point_on("parts", F.least(F.lit(200.0), F.col("total")) - 1e-9)
    r = r.withColumn("end", end)
    return r.select("way_id", F.round("total", 3).alias("length_m"), F.round(g.bearing(F.element_at("geom", 1), F.col("end")), 3).alias("direction"))


@query(f"""
WITH c AS (SELECT * FROM ({WATER}) w WHERE kind < 5), d AS (SELECT pid, min(sqrt(pow(p.x - c.x, 2) + pow(p.y - c.y, 2))) AS d FROM ({_POINTS}) p JOIN c ON abs(p.x - c.x) <= 350 AND abs(p.y - c.y) <= 350 GROUP BY pid),
s AS (SELECT pid, CASE WHEN g.cls IN (1, 2, 3) THEN 0.6 ELSE 0.2 END AS share FROM ({_POINTS}) p LEFT JOIN ({GRID}) g ON g.row = CAST(floor(p.y / 500) AS BIGINT) AND g.col = CAST(floor(p.x / 500) AS BIGINT))
SELECT s.pid, CASE WHEN share >= 0.5 AND d <= 120 THEN 1.0 WHEN share >= 0.5 AND d <= 350 THEN 0.45 ELSE 0.0 END::DOUBLE AS credit FROM s LEFT JOIN d ON d.pid = s.pid""")
def j3_sea_as_water(spark, sf_dir):
    """The coast as water where half of what lies around is water."""
    p = derive(spark, sf_dir, _POINTS)
    coast = derive(spark, sf_dir, WATER).where("kind < 5").select("id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d = spatial.least_distance(p, coast, "id", scenery.DIST["water_mid"])
    at = raster.sample(p.withColumn("tile", F.lit(0)), derive(spark, sf_dir, GRID), "cls", 500.0)
    share = F.when(F.col("cls").isin(1, 2, 3), 0.6).otherwise(0.2)
    return at.join(d.hint("merge"), "pid", "left").select("pid", scenery.sea_as_water("dist", share).alias("credit"))


@query(f"SELECT region, highway, name, round(m / 1000, 4) AS km FROM (SELECT *, row_number() OVER (PARTITION BY region, highway ORDER BY round(m, 6) DESC, name) AS nth FROM (SELECT region, highway, name, sum(length_m) AS m FROM ({ROADS}) r GROUP BY ALL) g) q WHERE nth = 1")
def w17_first_by_key(spark, sf_dir):
    """The longest name of every region and class, by a sort on several keys."""
    r = derive(spark, sf_dir, ROADS).groupBy("region", "highway", "name").agg(F.sum("length_m").alias("m")).withColumn("cell", F.struct("region", "highway"))
    return scenery.ranked(r, "cell", [F.desc(F.round("m", 6)), F.col("name")], 1).select("region", "highway", "name", F.round(F.col("m") / 1000, 4).alias("km"))
