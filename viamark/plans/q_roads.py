"""Queries: geometry, spatial joins and scores over the derived roads."""

from __future__ import annotations

from pyspark.sql import functions as F

from viamark.functions import geometry as g
from viamark.operators import scenery, spatial
from viamark.plans.catalog import query
from viamark.plans.derived import PARKS, PLACES, REFS, SEGMENTS, WATER, WAYS, derive, roads

_RUNNING = f"SELECT *, sum(len) OVER (PARTITION BY way_id ORDER BY n ROWS UNBOUNDED PRECEDING) - len AS pos, sum(len) OVER (PARTITION BY way_id) AS total FROM ({SEGMENTS}) s"
#: Chunks of at most 400 m and their end points, from running sums.
_CHUNKS = f"""
SELECT r.way_id, k, n_chunks, total, total / n_chunks AS length_m, k * total / n_chunks AS d0, (k + 1) * total / n_chunks AS d1
FROM (SELECT way_id, total, CAST(greatest(1, ceil(total / 400)) AS BIGINT) AS n_chunks FROM (SELECT way_id, sum(len) AS total FROM ({SEGMENTS}) s GROUP BY way_id)) r,
LATERAL (SELECT unnest(range(0, n_chunks)) AS k)"""
#: A point at distance d of way: the first segment that reaches it.
_MIDS = f"""
SELECT c.way_id, c.k, c.length_m, arg_min(s.x + t * (s.x2 - s.x), s.n) AS x, arg_min(s.y + t * (s.y2 - s.y), s.n) AS y
FROM (SELECT c.*, (d0 + d1) / 2 AS d FROM ({_CHUNKS}) c) c JOIN ({_RUNNING}) s ON s.way_id = c.way_id AND s.pos + s.len >= c.d - 1e-9,
LATERAL (SELECT CASE WHEN s.len > 0 THEN greatest(0.0, least(1.0, (c.d - s.pos) / s.len)) ELSE 0.0 END AS t) z
GROUP BY ALL"""


def _chunks(spark, sf_dir, curves: bool = False):
    """way_id, k, length_m, x, y (middle) and the way's tags: pieces of at most 400 m; with their curvature if asked for."""
    r = roads(spark, sf_dir).withColumn("parts", g.located("geom")).withColumn("total", F.aggregate("parts", F.lit(0.0), lambda t, s: t + s["len"]))
    more = ["curvature"] if curves else []
    r = r.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("total") / 400)).cast("int"))
    r = r.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    mid = g.point_on("parts", (F.col("k") + 0.5) * F.col("total") / F.col("n") - 1e-9)
    r = r.withColumn("mid", mid)
    if curves:
        r = r.withColumn("curvature", g.curvature("parts", F.col("total") / F.col("n"), F.col("total"), F.col("k") * F.col("total") / F.col("n")))
    return r.select("way_id", F.col("k").cast("long").alias("k"), (F.col("total") / F.col("n")).alias("length_m"), F.col("mid.x").alias("x"), F.col("mid.y").alias("y"), "highway", "oneway", "name", "surface", "scenic", "region", *more)


def _as_segments(points, key="id"):
    return points.select(F.col("id").alias(key), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))


@query(f"SELECT s.way_id, round(sum(len), 3) AS length_m, count(*) AS segments FROM ({SEGMENTS}) s JOIN ({WAYS}) w ON s.way_id = w.way_id GROUP BY s.way_id")
def d1_line_length(spark, sf_dir):
    return roads(spark, sf_dir).select("way_id", F.round(g.length("geom"), 3).alias("length_m"), (F.size("geom") - 1).cast("long").alias("segments"))


@query(f"SELECT way_id, k, round(length_m, 3) AS length_m, round(x, 2) AS x, round(y, 2) AS y FROM ({_MIDS}) m")
def d3_chunk_roads(spark, sf_dir):
    """Equal pieces of at most 400 m, and the point in the middle of each."""
    return _chunks(spark, sf_dir).select("way_id", "k", F.round("length_m", 3).alias("length_m"), F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query(f"""
SELECT way_id, round(max(b), 4) AS last_bearing, sum(CASE WHEN least(d, 180 - d) <= 30 THEN 1 ELSE 0 END) AS aligned
FROM (SELECT way_id, b, abs(b - 90) % 180 AS d FROM (SELECT way_id, (degrees(atan2(x2 - x, y2 - y)) + 360) % 360 AS b FROM ({SEGMENTS}) s WHERE len > 0) q) z GROUP BY way_id""")
def d6_bearings(spark, sf_dir):
    """Bearing of every segment, and how many run east-west within 30 degrees."""
    s = derive(spark, sf_dir, SEGMENTS).where("len > 0")
    b = g.bearing(g.point(F.col("x"), F.col("y")), g.point(F.col("x2"), F.col("y2")))
    s = s.withColumn("b", b).withColumn("f", g.folded(F.col("b"), F.lit(90.0)))
    return s.groupBy("way_id").agg(F.round(F.max("b"), 4).alias("last_bearing"), F.sum(F.when(F.col("f") <= 30, 1).otherwise(0)).alias("aligned"))


@query("""
SELECT a.c_custkey AS a, b.c_custkey AS b, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 6) AS km
FROM (SELECT c_custkey, 40 + (c_custkey * 7919 % 5000) / 1000.0 AS lat, -75 + (c_custkey * 104729 % 6000) / 1000.0 AS lon FROM customer) a
JOIN (SELECT c_custkey, 40 + (c_custkey * 7919 % 5000) / 1000.0 AS lat, -75 + (c_custkey * 104729 % 6000) / 1000.0 AS lon FROM customer) b ON b.c_custkey = a.c_custkey + 1""")
def d7_haversine(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (40 + (F.col("c_custkey") * 7919 % 5000) / 1000.0).alias("lat"), (-75 + (F.col("c_custkey") * 104729 % 6000) / 1000.0).alias("lon"))
    a = c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = c.select(F.col("c_custkey").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b.hint("merge"), "b").select("a", "b", F.round(g.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 6).alias("km"))


@query("""
SELECT c_custkey AS id, round(radians(lon) * 6378137.0, 3) AS mx, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) AS my,
  CAST(floor((lon + 180) / 360 * 4096) AS BIGINT) AS tx, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 4096) AS BIGINT) AS ty,
  CAST(floor(lat / 3) * 3 AS BIGINT) AS tile_lat, CAST(floor(lon / 3) * 3 AS BIGINT) AS tile_lon
FROM (SELECT c_custkey, 40 + (c_custkey * 7919 % 5000) / 1000.0 AS lat, -75 + (c_custkey * 104729 % 6000) / 1000.0 AS lon FROM customer) c""")
def d9_projections(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), (40 + (F.col("c_custkey") * 7919 % 5000) / 1000.0).alias("lat"), (-75 + (F.col("c_custkey") * 104729 % 6000) / 1000.0).alias("lon"))
    mx, my = g.mercator(F.col("lon"), F.col("lat"))
    tx, ty = g.tile(F.col("lon"), F.col("lat"), 12)
    return c.select("id", F.round(mx, 3).alias("mx"), F.round(my, 3).alias("my"), tx.alias("tx"), ty.alias("ty"), (F.floor(F.col("lat") / 3) * 3).alias("tile_lat"), (F.floor(F.col("lon") / 3) * 3).alias("tile_lon"))


@query(f"""
WITH t AS (SELECT way_id, n, ((degrees(atan2(x2 - x, y2 - y)) + 360) % 360) AS b, lead((degrees(atan2(x2 - x, y2 - y)) + 360) % 360) OVER (PARTITION BY way_id ORDER BY n) AS b2 FROM ({SEGMENTS}) s WHERE len > 0),
u AS (SELECT (b2 - b + 540) % 360 - 180 AS a, b2 FROM t WHERE b2 IS NOT NULL)
SELECT CASE WHEN abs(a) < 20 THEN 'straight' WHEN abs(a) < 45 THEN 'slight ' || side WHEN abs(a) < 120 THEN side WHEN abs(a) < 160 THEN 'sharp ' || side ELSE 'uturn' END AS modifier,
  ['north', 'northeast', 'east', 'southeast', 'south', 'southwest', 'west', 'northwest'][CAST(floor((b2 + 22.5) / 45) AS BIGINT) % 8 + 1] AS octant, count(*) AS turns
FROM (SELECT *, CASE WHEN a < 0 THEN 'left' ELSE 'right' END AS side FROM u) v GROUP BY 1, 2""")
def d8_turns(spark, sf_dir):
    """Turns between neighbouring segments by wording and compass octant."""
    from pyspark.sql import Window

    s = derive(spark, sf_dir, SEGMENTS).where("len > 0")
    s = s.withColumn("b", g.bearing(g.point(F.col("x"), F.col("y")), g.point(F.col("x2"), F.col("y2"))))
    s = s.withColumn("b2", F.lead("b").over(Window.partitionBy("way_id").orderBy("n"))).where("b2 is not null")
    return s.groupBy(g.modifier(g.turn(F.col("b"), F.col("b2"))).alias("modifier"), g.octant(F.col("b2")).alias("octant")).agg(F.count(F.lit(1)).alias("turns"))


@query(f"""
WITH p AS ({WATER}), s AS (SELECT s.*, w.custkey FROM ({_RUNNING}) s JOIN ({WAYS}) w ON w.way_id = s.way_id),
d AS (SELECT p.id, s.way_id, s.n, s.pos, s.len, CASE WHEN len > 0 THEN greatest(0.0, least(1.0, ((p.x - s.x) * (x2 - s.x) + (p.y - s.y) * (y2 - s.y)) / ((x2 - s.x) * (x2 - s.x) + (y2 - s.y) * (y2 - s.y)))) ELSE 0.0 END AS t, p.x AS px, p.y AS py, s.x, s.y, x2, y2
  FROM p JOIN s ON p.id = s.custkey)
SELECT id, way_id, round(min(sqrt(pow(px - x - t * (x2 - x), 2) + pow(py - y - t * (y2 - y), 2))), 3) AS dist,
  round(arg_min(pos + t * len, sqrt(pow(px - x - t * (x2 - x), 2) + pow(py - y - t * (y2 - y), 2))), 3) AS along FROM d GROUP BY 1, 2""")
def d10_project(spark, sf_dir):
    """Distance of every road to its customer's point, and the place along it."""
    p = derive(spark, sf_dir, WATER)
    m = roads(spark, sf_dir).join(p.withColumn("custkey", F.col("id")).hint("merge"), "custkey").withColumn("m", g.project(g.point(F.col("x"), F.col("y")), "geom"))
    return m.select("id", "way_id", F.round("m.dist", 3).alias("dist"), F.round("m.along", 3).alias("along"))


@query(f"SELECT id, side * side AS area, side * side >= 30000 AS large FROM ({PARKS}) p")
def d11_ring_area(spark, sf_dir):
    p = derive(spark, sf_dir, PARKS)
    return p.select("id", g.ring_area(g.square(F.col("x"), F.col("y"), F.col("side"))).alias("area")).withColumn("large", F.col("area") >= scenery.MIN_AREA["green"])


@query(f"""
SELECT p.id AS place, q.id AS park FROM ({PLACES}) p JOIN ({PARKS}) q ON abs(p.x - q.x) <= 20 * q.side / 2 AND abs(p.y - q.y) <= 20 * q.side / 2
WHERE p.x < q.x + 10 * q.side AND p.x >= q.x - 10 * q.side AND p.y < q.y + 10 * q.side AND p.y >= q.y - 10 * q.side""")
def d12_point_in_polygon(spark, sf_dir):
    """Places inside parks grown twenty times, by cells and the even-odd rule."""
    parks = derive(spark, sf_dir, PARKS).select(F.col("id").alias("park"), g.square(F.col("x"), F.col("y"), F.col("side") * 20).alias("geom"))
    places = derive(spark, sf_dir, PLACES).withColumnRenamed("id", "pid")
    return spatial.containing(places, parks, "park", 2000.0).select(F.col("pid").alias("place"), "park")


@query(f"""
WITH m AS ({_MIDS}), c AS (SELECT way_id * 10000 + k AS pid, x, y FROM m)
SELECT c.pid, round(min(sqrt(pow(c.x - w.x, 2) + pow(c.y - w.y, 2))), 3) AS dist,
  CASE WHEN min(sqrt(pow(c.x - w.x, 2) + pow(c.y - w.y, 2))) <= 120 THEN 1.0::DOUBLE ELSE 0.45::DOUBLE END AS credit
FROM c JOIN ({WATER}) w ON abs(c.x - w.x) <= 350 AND abs(c.y - w.y) <= 350 WHERE sqrt(pow(c.x - w.x, 2) + pow(c.y - w.y, 2)) <= 350 GROUP BY c.pid""")
def j2_two_band_credit(spark, sf_dir):
    """Pieces near water, full credit within 120 m and less within 350 m."""
    pieces = _chunks(spark, sf_dir).select((F.col("way_id") * 10000 + F.col("k")).alias("pid"), "x", "y")
    water = _as_segments(derive(spark, sf_dir, WATER))
    best = spatial.least_distance(pieces, water, "id", scenery.DIST["water_mid"])
    return best.select("pid", F.round("dist", 3).alias("dist"), scenery.two_bands("dist", 120.0, 350.0, scenery.WATER_MID).alias("credit"))


@query(f"""
WITH d AS (SELECT p.id AS pid, w.id, sqrt(pow(p.x - w.x, 2) + pow(p.y - w.y, 2)) AS dist FROM ({PLACES}) p, ({WATER}) w)
SELECT pid, arg_min(id, (dist, id)) AS id, round(min(dist), 3) AS dist FROM d GROUP BY pid""")
def j4_nearest(spark, sf_dir):
    """Nearest water of every place at any distance, by growing rings."""
    places = derive(spark, sf_dir, PLACES).withColumnRenamed("id", "pid")
    out = spatial.nearest_any(places, _as_segments(derive(spark, sf_dir, WATER)), "id", 500.0)
    return out.select("pid", "id", F.round("dist", 3).alias("dist"))


@query(f"""
WITH s AS (SELECT s.way_id, x, y, x2, y2, len FROM ({SEGMENTS}) s JOIN ({WAYS}) w ON w.way_id = s.way_id),
d AS (SELECT p.id AS pid, s.way_id, CASE WHEN len > 0 THEN greatest(0.0, least(1.0, ((p.x - s.x) * (x2 - s.x) + (p.y - s.y) * (y2 - s.y)) / ((x2 - s.x) * (x2 - s.x) + (y2 - s.y) * (y2 - s.y)))) ELSE 0.0 END AS t, p.x AS px, p.y AS py, s.x, s.y, x2, y2
  FROM ({PLACES}) p JOIN s ON least(s.x, x2) - 30 <= p.x AND greatest(s.x, x2) + 30 >= p.x AND least(s.y, y2) - 30 <= p.y AND greatest(s.y, y2) + 30 >= p.y),
e AS (SELECT pid, way_id, min(sqrt(pow(px - x - t * (x2 - x), 2) + pow(py - y - t * (y2 - y), 2))) AS dist FROM d GROUP BY 1, 2)
SELECT pid, arg_min(way_id, (dist, way_id)) AS way_id, round(min(dist), 3) AS dist FROM e WHERE dist <= 30 GROUP BY pid""")
def j23_nearest_edge_capped(spark, sf_dir):
    """J4 with a cap, J23: the nearest road within 30 m of a point, if any."""
    places = derive(spark, sf_dir, PLACES).withColumnRenamed("id", "pid")
    segs = spatial.exploded(roads(spark, sf_dir), "way_id")
    return spatial.nearest(places, segs, "way_id", 30.0).select("pid", "way_id", F.round("dist", 3).alias("dist"))


#: Curvature of pieces: points each 60 m and at the end, capped turns between chords.
CURVES = f"""
SELECT way_id, k, coalesce(sum(CASE WHEN turn IS NOT NULL THEN least(25.0, turn) END), 0) / (CASE WHEN any_value(total) < 300 THEN greatest(any_value(length_m), 300.0) ELSE any_value(length_m) END / 1000) AS curvature FROM (
  SELECT *, abs((lead(h) OVER (PARTITION BY way_id, k ORDER BY j) - h + 540) % 360 - 180) AS turn FROM (
    SELECT *, (degrees(atan2(lead(x) OVER (PARTITION BY way_id, k ORDER BY j) - x, lead(y) OVER (PARTITION BY way_id, k ORDER BY j) - y)) + 360) % 360 AS h FROM (
      SELECT c.way_id, c.k, c.j, c.total, c.length_m, arg_min(s.x + t * (s.x2 - s.x), s.n) AS x, arg_min(s.y + t * (s.y2 - s.y), s.n) AS y FROM (SELECT *, d0 + least(j * 60.0, length_m) - 1e-9 AS d FROM (SELECT *, unnest(range(0, CAST(ceil(length_m / 60 - 1e-9) AS BIGINT) + 1)) AS j FROM ({_CHUNKS}) a) b) c
        JOIN ({_RUNNING}) s ON s.way_id = c.way_id AND s.pos + s.len >= c.d, LATERAL (SELECT CASE WHEN s.len > 0 THEN greatest(0.0, least(1.0, (c.d - s.pos) / s.len)) ELSE 0.0 END AS t) z GROUP BY ALL) p) q) r GROUP BY way_id, k"""


def _scored(spark, sf_dir):
    """Pieces with the eleven components and the composite score.

    The layers: water and its coast (kinds under 5), parks by number as green, farm and protected
    land, places as towns and, large ones, as viewpoints, the grid as heights and land cover.
    """
    from viamark.operators import raster
    from viamark.plans.q_rasters import GRID
    from viamark.plans.tables import stage

    pieces = stage(_chunks(spark, sf_dir, curves=True).withColumn("pid", F.col("way_id") * 10000 + F.col("k")), "pieces")
    at = pieces.select("pid", "x", "y")
    water, places = derive(spark, sf_dir, WATER), derive(spark, sf_dir, PLACES)
    parks = derive(spark, sf_dir, PARKS).select("id", "side", g.square(F.col("x"), F.col("y"), F.col("side")).alias("geom"))
    area = F.col("side") * F.col("side")
    green, farm, land = parks.where(area >= scenery.MIN_AREA["green"]), parks.where((F.col("id") % 3 == 0) & (area >= scenery.MIN_AREA["farm"])), parks.where("id % 4 = 0")
    d = scenery.DIST
    near = spatial.distances(at, {
        "water": (_as_segments(water), d["water_mid"]), "coast": (_as_segments(water.where("kind < 5")), d["coast"]), "place": (_as_segments(places), d["place_mid"]), "view": (_as_segments(places.where("size >= 45")), d["view"]),
        "green": (spatial.outlines(green, "id"), d["green"]), "farm": (spatial.outlines(farm, "id"), d["farm"]), "land": (spatial.outlines(land, "id"), 80.0),
    }, {"green": green, "farm": farm, "land": land}, "id", 700.0)
    grid = raster.focal(derive(spark, sf_dir, GRID).select("tile", "row", "col", "z", "cls"), "z", 7)
    grid = grid.select("row", "col", "cls", (F.col("high") - F.col("low")).alias("relief"), (F.col("high") - F.col("z")).alias("prominence"))
    df = pieces.withColumns({"row": F.floor(F.round("y", 6) / 500), "col": F.floor(F.round("x", 6) / 500)}).join(grid.hint("merge"), ["row", "col"], "left").join(near.hint("merge"), "pid", "left")
    df = scenery.with_cover(df, F.col("cls"))
    return scenery.scored(scenery.with_components(df))


_ADJ = " ".join(f"WHEN '{k}' THEN {v}" for k, v in scenery.CLASS_ADJ.items())
_PT = "(SELECT pid, min(sqrt(pow(c.x - w.x, 2) + pow(c.y - w.y, 2))) AS d FROM c JOIN (SELECT * FROM ({t}) q WHERE {w}) w ON abs(c.x - w.x) <= {r} AND abs(c.y - w.y) <= {r} GROUP BY pid)"
_SQ = "(SELECT DISTINCT pid FROM c JOIN ({t}) p ON {w} AND sqrt(pow(greatest(abs(c.x - p.x) - p.side / 2, 0), 2) + pow(greatest(abs(c.y - p.y) - p.side / 2, 0), 2)) <= 80)"
_GRIDSQL = f"SELECT CAST(floor(y / 500) AS BIGINT) AS row, CAST(floor(x / 500) AS BIGINT) AS col, CAST(sum(node_id * 7 + n * 131) % 900 AS DOUBLE) AS z, min(node_id) % 5 AS cls FROM ({REFS}) v GROUP BY 1, 2"
_SCORED = f"""
WITH m AS MATERIALIZED ({_MIDS}), cv AS MATERIALIZED ({CURVES}), c AS MATERIALIZED (SELECT m.way_id * 10000 + m.k AS pid, m.x, m.y, length_m, w.* EXCLUDE (way_id), m.way_id, cv.curvature FROM m JOIN ({WAYS}) w ON w.way_id = m.way_id JOIN cv ON cv.way_id = m.way_id AND cv.k = m.k),
gr0 AS MATERIALIZED ({_GRIDSQL}), gf AS MATERIALIZED (SELECT a.row, a.col, a.cls, max(b.z) - min(b.z) AS relief, max(b.z) - a.z AS prominence FROM gr0 a JOIN gr0 b ON abs(a.row - b.row) <= 3 AND abs(a.col - b.col) <= 3 GROUP BY a.row, a.col, a.cls, a.z),
wa AS {_PT.format(t=WATER, w='TRUE', r=350)}, co AS {_PT.format(t=WATER, w='kind < 5', r=800)}, pl AS {_PT.format(t=PLACES, w='TRUE', r=900)}, vi AS {_PT.format(t=PLACES, w='size >= 45', r=400)},
gr AS {_SQ.format(t=PARKS, w='p.side * p.side >= 30000')}, fa AS {_SQ.format(t=PARKS, w='p.id % 3 = 0 AND p.side * p.side >= 20000')}, la AS {_SQ.format(t=PARKS, w='p.id % 4 = 0')},
b AS (SELECT c.*, wa.d AS dw, co.d AS dc, pl.d AS dp, vi.d AS dv, gr.pid IS NOT NULL AS green, fa.pid IS NOT NULL AS farm, la.pid IS NOT NULL AS land, coalesce(relief, 0) AS relief, coalesce(prominence, 0) AS prominence,
  CASE WHEN cls = 0 THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS tree, CASE WHEN cls = 2 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS desert, CASE WHEN cls = 3 THEN 0.6::DOUBLE ELSE 0.05::DOUBLE END AS built, CASE WHEN cls = 1 THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END AS wet, CASE WHEN cls = 4 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS mangrove
  FROM c LEFT JOIN gf ON gf.row = CAST(floor(round(c.y, 6) / 500) AS BIGINT) AND gf.col = CAST(floor(round(c.x, 6) / 500) AS BIGINT) LEFT JOIN wa USING (pid) LEFT JOIN co USING (pid) LEFT JOIN pl USING (pid) LEFT JOIN vi USING (pid) LEFT JOIN gr USING (pid) LEFT JOIN fa USING (pid) LEFT JOIN la USING (pid)),
v AS (SELECT *, greatest(CASE WHEN dw <= 120 THEN 1.0 WHEN dw <= 350 THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN wet >= 0.5 AND dc <= 120 THEN 1.0 WHEN wet >= 0.5 AND dc <= 350 THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END) AS c_water, CASE WHEN dc <= 800 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_coast,
  greatest(0.5::DOUBLE * CASE WHEN green THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.5::DOUBLE * tree, desert) AS c_forest, greatest(0.0, least(1.0, curvature / 160)) AS c_curves, greatest(0.0, least(1.0, relief / 100)) AS c_relief, CASE WHEN farm THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_farm, CASE WHEN dv <= 400 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_views,
  CASE WHEN scenic THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_scenic_tag, CASE WHEN dp <= 400 THEN 1.0 WHEN dp <= 900 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS c_urban, greatest(0.0, 1.0::DOUBLE - tree - built - mangrove) * greatest(0.0, least(1.0, (prominence - 300) / 600)) AS c_grand, CASE WHEN land AND built <= 0.3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_protected, CAST(CASE highway {_ADJ} ELSE 0.0 END AS DOUBLE) AS adj FROM b),
scored AS (SELECT *, 10 * greatest(0.0, least(1.0, ({' + '.join(f'{w}::DOUBLE * c_{k}' for k, w in scenery.WEIGHTS.items())} + 0.143::DOUBLE) * 1.2::DOUBLE + adj))::DOUBLE AS score FROM v)
"""


@query(_SCORED + "SELECT highway, round(sum(length_m) / 1000, 3) AS km, round(sum(score * length_m) / sum(length_m), 5) AS score, count(*) AS pieces FROM scored GROUP BY highway")
def a5_score_by_class(spark, sf_dir):
    """A2, A3, A5, the flagship: length-weighted scenic score of eleven components by road class."""
    out = scenery.by_class(_scored(spark, sf_dir))
    return out.select("highway", F.round("km", 3).alias("km"), F.round("score", 5).alias("score"), "pieces")


@query(_SCORED + "SELECT name, round(sum(length_m) / 1000, 3) AS km, round(sum(score * length_m) / sum(length_m), 5) AS score FROM scored WHERE name <> '' GROUP BY name HAVING sum(length_m) >= 3000 ORDER BY sum(score * length_m) / sum(length_m) DESC, name LIMIT 25")
def t1_top_roads(spark, sf_dir):
    """The 25 best named roads of 3 km or more."""
    return scenery.top_roads(_scored(spark, sf_dir)).select("name", F.round("km", 3).alias("km"), F.round("score", 5).alias("score"))


@query(_SCORED + """, r AS (SELECT round(score, 6) AS score FROM scored, LATERAL (SELECT unnest(range(0, greatest(1, CAST(round(length_m / 100) AS BIGINT))))) z)
SELECT round((SELECT quantile_cont(score, 0.1) FROM r), 4) AS p10, round((SELECT quantile_cont(score, 0.5) FROM r), 4) AS p50, round((SELECT quantile_cont(score, 0.9) FROM r), 4) AS p90, round((SELECT quantile_cont(score, 0.99) FROM r), 4) AS p99,
  round(sum(CASE WHEN round(score, 6) <= 0 THEN length_m ELSE 0 END) / sum(length_m), 6) AS floor_share, round(sum(CASE WHEN round(score, 6) >= 10 THEN length_m ELSE 0 END) / sum(length_m), 6) AS ceiling_share FROM scored""")
def a4_calibration(spark, sf_dir):
    from viamark.plans.tables import stage

    # Read several times: the quantiles take four passes over two columns.
    out = scenery.calibration(stage(_scored(spark, sf_dir).select(F.round("score", 6).alias("score"), "length_m"), "scores"))
    return out.select(*[F.round(c, 4 if c.startswith("p") else 6).alias(c) for c in out.columns])


@query(_SCORED + f"""SELECT way_id, round(sum(c_water * length_m) / sum(length_m), 8) AS c_water, round(sum(c_urban * length_m) / sum(length_m), 8) AS c_urban, round(sum(c_forest * length_m) / sum(length_m), 8) AS c_forest, {', '.join(f"round(sum(c_{k} * length_m) / sum(length_m), 8)::DOUBLE AS c_{k}" for k in ("coast", "curves", "relief", "farm", "views", "grand", "protected"))},
  round(sum(CASE WHEN surface IN ('gravel', 'compacted') THEN length_m ELSE 0 END) / sum(length_m), 8) AS unpaved FROM scored GROUP BY way_id""")
def a1_edge_means(spark, sf_dir):
    """A1, A3: length-weighted means of components for each way, and its unpaved share."""
    values = ["c_water", "c_urban", "c_forest", "c_coast", "c_curves", "c_relief", "c_farm", "c_views", "c_grand", "c_protected", "unpaved"]
    out = scenery.edge_means(_scored(spark, sf_dir), "way_id", "length_m", values)
    return out.select("way_id", *[F.round(v, 8).alias(v) for v in values])


@query(f"SELECT node_id, count(*) AS uses FROM ({REFS}) r GROUP BY node_id HAVING count(*) >= 2")
def a7_junctions(spark, sf_dir):
    """Nodes referenced twice or more, over all ways at once."""
    from viamark.operators.network import junctions

    return junctions(derive(spark, sf_dir, REFS))
