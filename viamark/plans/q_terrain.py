"""Queries: heights, classes and defects of rasters, and audits of what was built from them. The grid is one tile of 500 m cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from viamark.operators import evaluation as ev
from viamark.operators import raster, scenery, spatial, studies
from viamark.plans.catalog import query
from viamark.plans.derived import EDGES, PARKS, PLACES, ROADS, WATER, WAYS, derive
from viamark.plans.q_closures import _WINTERS, _longest_closed
from viamark.plans.q_rasters import GRID
from viamark.plans.tables import stage



def _grid(spark, sf_dir):
    return derive(spark, sf_dir, GRID)


_RGB = "SELECT p_partkey AS id, CAST(126 + p_partkey % 40 AS BIGINT) AS r, CAST(p_partkey * 7 % 256 AS BIGINT) AS g, CAST(p_size * 5 % 256 AS BIGINT) AS b FROM part"


@query(f"SELECT id, CASE WHEN z BETWEEN -500 AND 9000 THEN greatest(z, 0) END AS z FROM (SELECT id, r * 256 + g + b / 256 - 32768 AS z FROM ({_RGB}) p) q")
def r1_terrarium(spark, sf_dir):
    """Encoded pixels to heights; out of band is null, below the sea 0."""
    return derive(spark, sf_dir, _RGB).select("id", raster.terrarium(F.col("r"), F.col("g"), F.col("b")).alias("z"))


_TILES = f"SELECT CAST(floor(col / 8) AS BIGINT) AS tx, CAST(floor(row / 8) AS BIGINT) AS ty, row % 8 AS r, col % 8 AS c, row AS row0, col AS col0, z FROM ({GRID}) g"


@query(f"WITH t AS ({_TILES}) SELECT tx * 1000 + ty AS mosaic, count(*) AS pixels, round(count(*) / 64, 8) AS share, count(*) / 64 < 0.98 AS refused, CAST(sum(ty * 8 + r + tx * 8 + c) AS BIGINT) AS place FROM t GROUP BY 1")
def r2_mosaic(spark, sf_dir):
    """R2: tiles put in one grid, and the share of each that is there; under 98 % it is refused."""
    m = raster.mosaic(derive(spark, sf_dir, _TILES), 8).withColumn("mosaic", F.col("tx") * 1000 + F.col("ty"))
    place = m.groupBy("mosaic").agg(F.sum(F.col("row") + F.col("col")).alias("place"))
    return raster.coverage(m, "mosaic", 64).join(place.hint("merge"), "mosaic").select("mosaic", "pixels", F.round("share", 8).alias("share"), (F.col("share") < 0.98).alias("refused"), "place")


@query("SELECT n_nationkey AS region, greatest(3, CAST(2 * round((750 / mpp - 1) / 2) + 1 AS BIGINT)) AS near_px, greatest(3, CAST(2 * round((3000 / mpp - 1) / 2) + 1 AS BIGINT)) AS far_px FROM (SELECT n_nationkey, 40075016.686 * cos(radians(n_nationkey * 2.0 + 10)) / (256 * 4096) AS mpp FROM nation) n")
def r3_window_px(spark, sf_dir):
    """Odd windows in pixels for 750 m and 3 km at every region's latitude."""
    mpp = 40075016.686 * F.cos(F.radians(F.col("n_nationkey") * 2.0 + 10)) / (256 * 4096)
    px = lambda m: F.greatest(F.lit(3), (2 * F.round((m / mpp - 1) / 2) + 1).cast("long"))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("region"), px(750).alias("near_px"), px(3000).alias("far_px"))


@query(f"""
WITH b AS MATERIALIZED (SELECT CAST(floor(row / 4.0) AS BIGINT) AS brow, CAST(floor(col / 4.0) AS BIGINT) AS bcol, median(z) AS m FROM ({GRID}) g GROUP BY 1, 2), n AS (SELECT a.brow, a.bcol, a.m, median(c.m) AS around FROM b a JOIN b c ON abs(a.brow - c.brow) <= 2 AND abs(a.bcol - c.bcol) <= 2 GROUP BY 1, 2, 3),
bad AS (SELECT * FROM n WHERE abs(m - around) > 250) SELECT DISTINCT b.brow, b.bcol FROM b JOIN bad ON abs(b.brow - bad.brow) <= 1 AND abs(b.bcol - bad.bcol) <= 1""")
def r7_blob_mask(spark, sf_dir):
    """Blocks of four cells 250 off the blocks around them, grown by one."""
    return raster.blob_mask(_grid(spark, sf_dir), "z", 4, 2, 250.0, 1).select("brow", "bcol")


@query(f"SELECT CAST(floor(col / 10.0) AS BIGINT) AS band, round(avg(d), 8) AS desert, round(sum(d * k) / nullif(sum(d), 0), 8) AS kept, round(count(*) / sum(count(*)) OVER (), 8) AS footprint FROM (SELECT col, CASE WHEN cls = 2 THEN 1.0::DOUBLE ELSE 0.0 END AS d, CASE WHEN z > 300 THEN 1.0::DOUBLE ELSE 0.0 END AS k FROM ({GRID}) g) q GROUP BY 1")
def r12_gate_seam(spark, sf_dir):
    """Shares of desert, of what a gate keeps of it, and of the footprint by band of columns."""
    g = _grid(spark, sf_dir).select(F.col("col").cast("double").alias("lon"), F.when(F.col("cls") == 2, 1.0).otherwise(0.0).alias("desert"), F.when(F.col("z") > 300, 1.0).otherwise(0.0).alias("kept"))
    return raster.gate_seam(g, 10.0).select("band", *[F.round(c, 8).alias(c) for c in ("desert", "kept", "footprint")])


_DEFECT = f"""
SELECT row, col, z, abs(z - m) > 2 * mad AND abs(z - m) > 50 AS defect FROM (SELECT row, col, z, m, median(abs(n - m)) AS mad FROM (SELECT a.row, a.col, a.z, b.z AS n, median(b.z) OVER (PARTITION BY a.row, a.col) AS m FROM g a JOIN g b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2) q GROUP BY row, col, z, m) w"""


@query(f"""
WITH g AS MATERIALIZED ({GRID}), d AS ({_DEFECT}), e AS (SELECT g.row, g.col, max(n.z) - min(n.z) AS relief FROM g JOIN g n ON abs(g.row - n.row) <= 1 AND abs(g.col - n.col) <= 1 GROUP BY 1, 2)
SELECT CASE WHEN relief < 300 THEN 'flat' WHEN relief < 600 THEN 'hills' ELSE 'mountains' END AS terrain, count(*) AS pixels, CAST(sum(defect::INT) AS BIGINT) AS defects, round(avg(defect::INT), 8) AS rate FROM d JOIN e USING (row, col) GROUP BY 1""")
def r13_pixel_defects(spark, sf_dir):
    """Defects of pixels by a robust spread test, and their rate by class of terrain."""
    g = _grid(spark, sf_dir).select("tile", "row", "col", "z")
    d = raster.robust_defects(g, "z", 2, 2.0, 50.0)
    e = raster.relief(g, "z", 3).select("tile", "row", "col", "relief")
    terrain = F.when(F.col("relief") < 300, "flat").when(F.col("relief") < 600, "hills").otherwise("mountains")
    out = d.join(e.hint("merge"), ["tile", "row", "col"]).groupBy(terrain.alias("terrain")).agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col("defect").cast("int")).alias("defects"))
    return out.withColumn("rate", F.round(F.col("defects") / F.col("pixels"), 8))


_AT = f"SELECT edge, CAST(floor(my / 500) AS BIGINT) AS row, CAST(floor(mx / 500) AS BIGINT) AS col FROM ({EDGES}) e"
_FOCAL = "SELECT a.row, a.col, a.z, max(b.z) AS hi{k}, min(b.z) AS lo{k} FROM g a JOIN g b ON abs(a.row - b.row) <= {k} AND abs(a.col - b.col) <= {k} GROUP BY 1, 2, 3"


@query(f"""
WITH g AS MATERIALIZED ({GRID}), a AS ({_FOCAL.format(k=1)}), b AS ({_FOCAL.format(k=3)}) SELECT e.edge, a.z, hi3 - a.z AS above, a.z - lo3 AS below, hi1 - lo1 AS relief_near, hi3 - lo3 AS relief_far FROM ({_AT}) e JOIN a USING (row, col) JOIN b USING (row, col)""")
def r14_midpoint_terrain(spark, sf_dir):
    """Height, what rises and falls around it, and relief at two widths at the middle of edges."""
    g = raster.focal(_grid(spark, sf_dir).select("tile", "row", "col", "z"), "z", 3).withColumnsRenamed({"low": "lo1", "high": "hi1"})
    g = raster.focal(g, "z", 7)
    at = derive(spark, sf_dir, EDGES).select("edge", F.floor(F.col("my") / 500).alias("row"), F.floor(F.col("mx") / 500).alias("col"))
    out = at.join(g.hint("merge"), ["row", "col"])
    return out.select("edge", "z", (F.col("high") - F.col("z")).alias("above"), (F.col("z") - F.col("low")).alias("below"), (F.col("hi1") - F.col("lo1")).alias("relief_near"), (F.col("high") - F.col("low")).alias("relief_far"))


_BOXES = "SELECT s_suppkey AS id, CAST(s_suppkey * 7 % 50 - 25 AS DOUBLE) AS west, CAST(s_suppkey * 11 % 60 - 30 AS DOUBLE) AS south, CAST(s_suppkey * 7 % 50 - 25 + s_suppkey % 8 AS DOUBLE) AS east, CAST(s_suppkey * 11 % 60 - 30 + s_suppkey % 5 AS DOUBLE) AS north FROM supplier"


@query(f"SELECT lat, lon, count(*) AS boxes FROM (SELECT id, CAST(unnest(range(CAST(floor(south / 3) * 3 AS BIGINT), CAST(floor(north / 3) * 3 AS BIGINT) + 1, 3)) AS INT) AS lat, west, east FROM ({_BOXES}) b) q, LATERAL (SELECT CAST(unnest(range(CAST(floor(west / 3) * 3 AS BIGINT), CAST(floor(east / 3) * 3 AS BIGINT) + 1, 3)) AS INT) AS lon) z GROUP BY lat, lon")
def r15_tile_inventory(spark, sf_dir):
    """The tiles of three degrees that boxes need, and how many need each."""
    b = derive(spark, sf_dir, _BOXES).select("id", F.explode(raster.tiles_of_box(F.col("west"), F.col("south"), F.col("east"), F.col("north"))).alias("t"))
    return b.groupBy("t.lat", "t.lon").agg(F.count(F.lit(1)).alias("boxes"))


_RAYSQL = f"SELECT id AS pid, ray, d * 500.0 AS dist, CAST((id * 31 + ray * 17 + d * 7919) % 400 AS DOUBLE) AS rise FROM ({PLACES}) p, range(0, 4) r(ray), range(1, 25) s(d)"


def _rays(spark, sf_dir):
    p = derive(spark, sf_dir, PLACES).withColumn("ray", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(24))))
    return p.select(F.col("id").alias("pid"), "ray", (F.col("d") * 500.0).alias("dist"), ((F.col("id") * 31 + F.col("ray") * 17 + F.col("d") * 7919) % 400).cast("double").alias("rise"))


_VISIBLE = f"SELECT pid, max(rise) AS rise FROM (SELECT *, max(rise / dist) OVER (PARTITION BY pid, ray ORDER BY dist ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({_RAYSQL}) r) q WHERE (before IS NULL OR rise / dist >= before) AND dist <= 10000 GROUP BY pid"


@query(f"SELECT pid, rise FROM ({_VISIBLE}) v")
def w21_viewshed(spark, sf_dir):
    """The highest visible rise along the rays of every place."""
    return studies.steepest(_rays(spark, sf_dir))


@query(f"""
WITH v AS ({_VISIBLE}), p AS (SELECT p.id, p.size, greatest(0.0, least(1.0, (v.rise - 100) / 200)) AS true_view, greatest(0.0, least(1.0, (CAST((p.id * 31) % 400 AS DOUBLE) - 100) / 200)) AS proxy FROM ({PLACES}) p JOIN v ON v.pid = p.id)
SELECT size % 5 AS road, round(avg(true_view), 8) AS viewshed, round(avg(proxy), 8) AS proxy, round(avg(CASE WHEN true_view >= 0.7 THEN 1.0 ELSE 0.0 END), 8)::DOUBLE AS high_viewshed, round(avg(CASE WHEN proxy >= 0.7 THEN 1.0 ELSE 0.0 END), 8)::DOUBLE AS high_proxy FROM p GROUP BY 1""")
def v10_proxy_viewshed(spark, sf_dir):
    """A proxy of views against the visible rise, by road: means and shares at 0.7 or more."""
    p = derive(spark, sf_dir, PLACES).withColumn("flat", ((F.col("id") * 31) % 400).cast("double"))
    p = p.join(studies.steepest(_rays(spark, sf_dir)).withColumnRenamed("pid", "id").hint("merge"), "id")
    p = p.withColumns({"true_view": scenery.ramp("rise", 100.0, 300.0), "proxy": scenery.ramp("flat", 100.0, 300.0), "road": F.col("size") % 5})
    r8 = lambda c, n: F.round(c, 8).alias(n)
    return p.groupBy("road").agg(r8(F.avg("true_view"), "viewshed"), r8(F.avg("proxy"), "proxy"), r8(ev.share(F.col("true_view") >= 0.7), "high_viewshed"), r8(ev.share(F.col("proxy") >= 0.7), "high_proxy"))


_TWO = f"SELECT CAST(floor(row / 16.0) AS BIGINT) * 100 + CAST(floor(col / 16.0) AS BIGINT) AS block, z, z + CAST((row * 7 + col * 13) % 41 AS DOUBLE) * 5 - 60 AS other FROM ({GRID}) g"


@query(f"SELECT block, count(*) AS pixels, round(median(abs(other - z)), 6) AS median_m, round(quantile_cont(abs(other - z), 0.95), 6) AS p95_m, round(avg(other - z), 6) AS bias_m, round(avg(CASE WHEN abs(other - z) > 100 THEN 1.0 ELSE 0.0 END), 8)::DOUBLE AS over_100, round(abs((max(other) - min(other)) - (max(z) - min(z))), 6) AS relief_off FROM ({_TWO}) t GROUP BY block")
def v5_two_sources(spark, sf_dir):
    """V5: two sources of height by block: median, 95 %, bias, share over 100 m, difference of relief."""
    t = derive(spark, sf_dir, _TWO).withColumn("off", F.col("other") - F.col("z"))
    d, span = F.abs("off"), lambda c: F.max(c) - F.min(c)
    r = lambda c, n: F.round(c, 6).alias(n)
    return t.groupBy("block").agg(F.count(F.lit(1)).alias("pixels"), r(F.percentile(d, F.lit(0.5)), "median_m"), r(F.percentile(d, F.lit(0.95)), "p95_m"), r(F.avg("off"), "bias_m"), F.round(ev.share(d > 100), 8).alias("over_100"), r(F.abs(span("other") - span("z")), "relief_off"))


_REL = "SELECT a.row, a.col, max(b.z) - min(b.z) AS relief FROM {g} a JOIN {g} b ON abs(a.row - b.row) <= 3 AND abs(a.col - b.col) <= 3 GROUP BY 1, 2"


@query(f"""
WITH g AS MATERIALIZED ({GRID}), d AS ({_DEFECT}), c AS MATERIALIZED (SELECT row, col, CASE WHEN NOT defect THEN z END AS z FROM d), x AS ({_REL.format(g='g')}), y AS ({_REL.format(g='c')})
SELECT r.highway, round(avg(0.16 * 12 * (least(1.0, x.relief / 800) - least(1.0, coalesce(y.relief, 0) / 800))), 8) AS effect, count(*) AS edges FROM ({_AT}) e JOIN x USING (row, col) JOIN y USING (row, col) JOIN ({ROADS}) r ON r.edge = e.edge GROUP BY r.highway""")
def v6_corrupt_effect(spark, sf_dir):
    """V6: what defective pixels add to the relief term of scores, by class."""
    g = _grid(spark, sf_dir).select("tile", "row", "col", "z")
    clean = raster.robust_defects(g, "z", 2, 2.0, 50.0).withColumn("z", F.when(~F.col("defect"), F.col("z"))).drop("defect")
    rel = lambda d, n: raster.relief(d, "z", 7).select("tile", "row", "col", F.col("relief").alias(n))
    both = rel(g, "x").join(rel(clean, "y").hint("merge"), ["tile", "row", "col"])
    at = derive(spark, sf_dir, ROADS).select("edge", "highway", F.floor(F.col("my") / 500).alias("row"), F.floor(F.col("mx") / 500).alias("col"))
    term = lambda c: F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0.0)) / 800)
    out = at.join(both.hint("merge"), ["row", "col"]).withColumn("d", 0.16 * 12 * (term("x") - term("y")))
    return out.groupBy("highway").agg(F.round(F.avg("d"), 8).alias("effect"), F.count(F.lit(1)).alias("edges"))


@query(_WINTERS + f"""
, p AS (SELECT name, count(*) AS edges, min(reopens) AS first_open, max(reopens) AS last_open FROM winters w JOIN ({ROADS}) r ON r.edge = w.edge WHERE reopens IS NOT NULL GROUP BY name)
SELECT name, edges, first_open, last_open, CAST(110 + length(name) AS BIGINT) AS official, last_open - (110 + length(name)) AS late_days FROM p""")
def v9_season_table(spark, sf_dir):
    """V9: official opening days beside what tags say, for every named road."""
    w = _longest_closed(spark, sf_dir).where("reopens is not null")
    r = w.join(derive(spark, sf_dir, WAYS).select("way_id", "name").hint("merge"), "way_id").groupBy("name").agg(F.count(F.lit(1)).alias("edges"), F.min("reopens").cast("long").alias("first_open"), F.max("reopens").cast("long").alias("last_open"))
    official = (110 + F.length("name")).cast("long")
    return r.select("name", "edges", "first_open", "last_open", official.alias("official"), (F.col("last_open") - official).alias("late_days"))


_PINS = f"SELECT edge, name, mx AS x, my AS y FROM ({ROADS}) r WHERE name LIKE 'MACHINERY%'"


def _features_sql(points: str) -> str:
    """pid, relief, cls, coast and park distances of points."""
    return f"""
SELECT p.pid, f.hi3 - f.lo3 AS relief, g.cls, least(800.0, coalesce(c.d, 800.0)) AS coast, least(500.0, coalesce(k.d, 500.0)) AS park FROM ({points}) p LEFT JOIN ({_FOCAL.format(k=3).replace('FROM g a JOIN g b', f'FROM ({GRID}) a JOIN ({GRID}) b')}) f ON f.row = CAST(floor(p.y / 500) AS BIGINT) AND f.col = CAST(floor(p.x / 500) AS BIGINT)
  LEFT JOIN ({GRID}) g ON g.row = CAST(floor(p.y / 500) AS BIGINT) AND g.col = CAST(floor(p.x / 500) AS BIGINT)
  LEFT JOIN (SELECT pid, min(sqrt(pow(p.x - w.x, 2) + pow(p.y - w.y, 2))) AS d FROM ({points}) p JOIN (SELECT * FROM ({WATER}) w WHERE kind < 5) w ON abs(p.x - w.x) <= 800 AND abs(p.y - w.y) <= 800 GROUP BY pid) c ON c.pid = p.pid
  LEFT JOIN (SELECT pid, min(sqrt(pow(p.x - w.x, 2) + pow(p.y - w.y, 2))) AS d FROM ({points}) p JOIN ({PARKS}) w ON abs(p.x - w.x) <= 500 AND abs(p.y - w.y) <= 500 GROUP BY pid) k ON k.pid = p.pid"""


def _features(spark, sf_dir, points):
    """pid, relief, cls, coast, park of points (pid, x, y); points at the same place are worked on once."""
    every, points = points, stage(points.select("x", "y").distinct().select(F.struct("x", "y").alias("pid"), "x", "y"), "places")
    grid = raster.focal(_grid(spark, sf_dir), "z", 7).withColumn("relief", F.col("high") - F.col("low"))
    at = raster.sample(raster.sample(points.withColumn("tile", F.lit(0)), grid, "relief", 500.0).drop("row", "col"), grid, "cls", 500.0).select("pid", "relief", "cls")
    seg = lambda d: d.select("id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    coast = spatial.least_distance(points, seg(derive(spark, sf_dir, WATER).where("kind < 5")), "id", 800.0).withColumnRenamed("dist", "coast")
    park = spatial.least_distance(points, seg(derive(spark, sf_dir, PARKS)), "id", 500.0).withColumnRenamed("dist", "park")
    out = at.join(coast.hint("merge"), "pid", "left").join(park.hint("merge"), "pid", "left")
    out = out.select("pid.x", "pid.y", "relief", "cls", F.least(F.lit(800.0), F.coalesce("coast", F.lit(800.0))).alias("coast"), F.least(F.lit(500.0), F.coalesce("park", F.lit(500.0))).alias("park"))
    return every.join(stage(out, "features").hint("merge"), ["x", "y"]).drop("x", "y")


@query(f"SELECT pid AS edge, relief, cls, round(coast, 3) AS coast, round(park, 3) AS park FROM ({_features_sql(f'SELECT edge AS pid, x, y FROM ({_PINS}) q')}) f")
def v11_pinned_features(spark, sf_dir):
    """Features of pinned roads' pieces: relief, class, capped distances to the coast and to parks."""
    pins = stage(derive(spark, sf_dir, _PINS).select(F.col("edge").alias("pid"), "x", "y"), "pins")
    return _features(spark, sf_dir, pins).select(F.col("pid").alias("edge"), "relief", "cls", F.round("coast", 3).alias("coast"), F.round("park", 3).alias("park"))


@query(f"""
WITH f AS ({_features_sql(f"SELECT edge AS pid, mx AS x, my AS y FROM ({EDGES}) e")})
SELECT r.region, count(*) AS edges, round(avg(relief), 6) AS relief, round(avg(coast), 4) AS coast, CAST(sum(CASE WHEN cls = 2 THEN 1 ELSE 0 END) AS BIGINT) AS desert, CAST(sum(r.scenic::INT) AS BIGINT) AS labels FROM f JOIN ({ROADS}) r ON r.edge = f.pid GROUP BY r.region""")
def v27_region_features(spark, sf_dir):
    """Feature tables of every region: terrain, classes, coast, labels."""
    e = derive(spark, sf_dir, ROADS).select(F.col("edge").alias("pid"), F.col("mx").alias("x"), F.col("my").alias("y"), "region", "scenic")
    f = _features(spark, sf_dir, stage(e, "edges"))
    return f.groupBy("region").agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg("relief"), 6).alias("relief"), F.round(F.avg("coast"), 4).alias("coast"), F.sum((F.col("cls") == 2).cast("int")).alias("desert"), F.sum(F.col("scenic").cast("int")).alias("labels"))


@query(f"""
WITH b AS (SELECT CAST(floor(row / 2.0) AS BIGINT) AS row, CAST(floor(col / 2.0) AS BIGINT) AS col, avg(CASE WHEN cls = 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS share FROM ({GRID}) g GROUP BY 1, 2)
SELECT a.row, a.col, round((sum(b.share) + (99 - count(*)) * 0.25) / 99, 8) AS mean FROM b a JOIN b ON abs(a.row - b.row) <= 4 AND abs(a.col - b.col) <= 5 GROUP BY a.row, a.col""")
def v23_moving_shares(spark, sf_dir):
    """The mean share of a class over 9 by 11 blocks; absent blocks count as a quarter."""
    b = raster_blocks(_grid(spark, sf_dir))
    return raster.block_means(b, "share", 9, 11, 0.25).select("row", "col", F.round("mean", 8).alias("mean"))


def raster_blocks(grid):
    """tile, row, col, share of class 1 in blocks of two cells."""
    return grid.groupBy("tile", F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col")).agg(F.avg(F.when(F.col("cls") == 1, 1.0).otherwise(0.0)).alias("share"))


@query(f"SELECT surface, count(*) AS edges, count(*) FILTER (edge % 2 = 0) AS rebuilt FROM ({ROADS}) r WHERE surface <> '' GROUP BY surface")
def v29_rebuilt_tables(spark, sf_dir):
    """Side tables written to a new directory; the part whose inputs are unchanged is carried over by its digest."""
    from viamark.operators import checks
    from viamark.plans.tables import new_path

    e = derive(spark, sf_dir, ROADS).where("surface <> ''").select("edge", "surface")
    same, changed = e.where("edge % 2 = 1"), e.where("edge % 2 = 0")
    kept = checks.reused("side-table", [same], {"table": "surface"}, lambda: same)
    path = new_path(spark, "rebuilt")
    kept.withColumn("rebuilt", F.lit(False)).unionByName(changed.withColumn("rebuilt", F.lit(True))).write.parquet(path)
    return spark.read.parquet(path).groupBy("surface").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.col("rebuilt").cast("int")).alias("rebuilt"))
