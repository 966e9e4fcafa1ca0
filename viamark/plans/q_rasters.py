"""Queries: rasters, trips and checks over derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from viamark.operators import checks, raster, trips
from viamark.plans.catalog import query
from viamark.plans.derived import REFS, SEGMENTS, WAYS, derive

#: One tile: cells of 500 m with the parts that lie on their vertices as height and class.
GRID = f"SELECT 0 AS tile, CAST(floor(y / 500) AS BIGINT) AS row, CAST(floor(x / 500) AS BIGINT) AS col, CAST(sum(node_id * 7 + n * 131) % 900 AS DOUBLE) AS z, min(node_id) % 5 AS cls, CAST(count(*) AS DOUBLE) AS n FROM ({REFS}) v GROUP BY 1, 2, 3"


@query(f"""
WITH g AS MATERIALIZED ({GRID}) SELECT a.row, a.col, max(b.z) - min(b.z) AS relief, max(b.z) - a.z AS prominence FROM g a JOIN g b ON abs(a.row - b.row) <= 3 AND abs(a.col - b.col) <= 3 GROUP BY a.row, a.col, a.z""")
def r4_relief(spark, sf_dir):
    """Relief and prominence in a square of seven cells; holes are invisible."""
    g = raster.focal(derive(spark, sf_dir, GRID), "z", 7)
    return g.select("row", "col", (F.col("high") - F.col("low")).alias("relief"), (F.col("high") - F.col("z")).alias("prominence"))


@query(f"""
WITH g AS ({GRID}), m AS (SELECT a.row, a.col, a.z, median(b.z) AS m FROM g a JOIN g b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY ALL)
SELECT row, col, CASE WHEN abs(z - m) > 250 THEN NULL ELSE z END AS z FROM m""")
def r6_despike(spark, sf_dir):
    """Cells far from the median of their square become null."""
    return raster.despiked(derive(spark, sf_dir, GRID).select("tile", "row", "col", "z"), "z").select("row", "col", "z")


@query(f"""
WITH n AS (SELECT CAST(floor(row / 3.0) AS BIGINT) AS brow, CAST(floor(col / 3.0) AS BIGINT) AS bcol, cls, count(*) AS n FROM ({GRID}) g GROUP BY ALL)
SELECT brow, bcol, arg_min(cls, (-n, cls)) AS class, max(n) AS n FROM n GROUP BY brow, bcol""")
def r10_majority(spark, sf_dir):
    """Counts of classes in blocks of three and their majority."""
    return raster.majority(derive(spark, sf_dir, GRID), "cls").drop("tile")




@query(f"""
WITH g AS ({GRID}), e AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM g),
s AS (SELECT a.row, a.col, sum(b.n) AS n FROM g a JOIN g b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY ALL)
SELECT s.row, s.col, round(n / ((least(s.row + 2, r1) - greatest(s.row - 2, r0) + 1) * (least(s.col + 2, c1) - greatest(s.col - 2, c0) + 1)), 8) AS share FROM s, e""")
def r9_box_shares(spark, sf_dir):
    """Shares in a box of five cells by four corners of the summed area; the grid is filled first."""
    g = derive(spark, sf_dir, GRID).select("tile", "row", "col", "n")
    full = raster.filled(g).withColumn("n", F.coalesce("n", F.lit(0.0))).drop("here_")
    out = raster.box_shares(full, "n", 2).join(g.select("row", "col").hint("merge"), ["row", "col"], "left_semi")
    return out.select("row", "col", F.round("share", 8).alias("share"))


_AT = "SELECT p_partkey AS id, CAST(floor((p_partkey * 99991 % 37750) / 500) AS BIGINT) AS row, CAST(floor((p_partkey * 6007 % 37250) / 500) AS BIGINT) AS col FROM part"


@query(f"""
WITH g AS ({GRID}) SELECT w.id, round(count(CASE WHEN cls = 0 THEN 1 END) / 25.0, 6)::DOUBLE AS desert, round(count(CASE WHEN cls = 0 AND z <= 600 THEN 1 END) / 25.0, 6)::DOUBLE AS desert_gated, round(count(CASE WHEN z <= 600 THEN 1 END) / 25.0, 6)::DOUBLE AS range
FROM ({_AT}) w LEFT JOIN g ON g.row BETWEEN w.row - 2 AND w.row + 2 AND g.col BETWEEN w.col - 2 AND w.col + 2 GROUP BY w.id""")
def r11_gated_shares(spark, sf_dir):
    """Shares of a class around places, gated by a second raster, over tiles of 16 cells: summed areas inside and over tiles."""
    flag = lambda c: F.when(c, 1).otherwise(0)
    cells = derive(spark, sf_dir, GRID).select("row", "col", flag(F.col("cls") == 0).alias("desert"), flag((F.col("cls") == 0) & (F.col("z") <= 600)).alias("desert_gated"), flag(F.col("z") <= 600).alias("range"))
    at = derive(spark, sf_dir, _AT).withColumnRenamed("id", "pid")
    out = raster.gated_box_shares(at, cells, ["desert", "desert_gated", "range"], 2, 16)
    return out.select(F.col("pid").alias("id"), *[F.round(c, 6).alias(c) for c in ("desert", "desert_gated", "range")])


@query(f"SELECT w.id, g.z FROM (SELECT p_partkey AS id, CAST(floor((p_partkey * 99991 % 37750) / 500) AS BIGINT) AS row, CAST(floor((p_partkey * 6007 % 37250) / 500) AS BIGINT) AS col FROM part) w LEFT JOIN ({GRID}) g USING (row, col)")
def r8_sample(spark, sf_dir):
    """The cell under each place; null where there is none."""
    from viamark.plans.derived import PLACES

    p = derive(spark, sf_dir, PLACES).withColumn("tile", F.lit(0))
    return raster.sample(p, derive(spark, sf_dir, GRID), "z", 500.0).select("id", "z")


#: A trip is an order's customer; its edges are the segments of the customer's ways in order.
ROUTE = f"""
SELECT o_custkey AS trip, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY s.way_id, s.n) AS BIGINT) AS seq, s.node_id AS edge, len AS length_m, len / 1000 AS minutes,
  CAST((s.node_id * 37) % 101 AS DOUBLE) / 10 AS score, w.name, w.highway, w.surface FROM ({SEGMENTS}) s JOIN ({WAYS}) w ON w.way_id = s.way_id JOIN orders ON o_orderkey = s.way_id"""
#: Options: a trip's orders by extra minutes and gained km.
OPTIONS = "SELECT o_custkey AS trip, o_orderkey AS option, CAST(o_orderkey * 7919 % 60 AS DOUBLE) AS extra, CAST(o_orderkey * 104729 % 4000 AS DOUBLE) / 100 AS gain FROM orders"


@query(f"SELECT trip, round(sum(length_m) / 1000, 6) AS km, round(sum(score * length_m) / sum(length_m), 6) AS mean_score, round(sum(CASE WHEN score >= 7 THEN length_m ELSE 0 END) / 1000, 6) AS beautiful_km FROM ({ROUTE}) r GROUP BY trip")
def a37_trip_summary(spark, sf_dir):
    out = trips.summary(derive(spark, sf_dir, ROUTE))
    return out.select("trip", *[F.round(c, 6).alias(c) for c in ("km", "mean_score", "beautiful_km")])


@query(f"SELECT trip, option, extra, gain FROM (SELECT *, max(gain) OVER (PARTITION BY trip ORDER BY extra, gain DESC, option ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ({OPTIONS}) o) f WHERE b IS NULL OR gain > b")
def w18_frontier(spark, sf_dir):
    return trips.frontier(derive(spark, sf_dir, OPTIONS)).select("trip", "option", "extra", "gain")


@query(f"""
WITH RECURSIVE f AS MATERIALIZED (SELECT trip, option, extra, gain FROM (SELECT *, max(gain) OVER (PARTITION BY trip ORDER BY extra, gain DESC, option ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ({OPTIONS}) o) z WHERE b IS NULL OR gain > b),
s AS MATERIALIZED (SELECT trip, max(gain) AS top, greatest({trips.NEXT_GAIN}::DOUBLE, {trips.NEXT_SHARE}::DOUBLE * max(gain)) AS step FROM f GROUP BY trip),
k(trip, gain, n) AS (SELECT trip, min(gain), 1 FROM f WHERE gain >= {trips.FIRST_GAIN} GROUP BY trip UNION ALL SELECT trip, gain, n FROM (SELECT k.trip, f.gain, k.n + 1 AS n, row_number() OVER (PARTITION BY k.trip ORDER BY f.gain) AS nth FROM k JOIN s ON s.trip = k.trip JOIN f ON f.trip = k.trip AND f.gain >= k.gain + s.step) z WHERE nth = 1),
m AS (SELECT trip, max(n) AS n, max(gain) AS last FROM k GROUP BY trip)
SELECT s.trip, coalesce(n, 0) + CASE WHEN last = top THEN 0 ELSE 1 END AS options, top AS best_gain FROM s LEFT JOIN m ON m.trip = s.trip""")
def w19_menu(spark, sf_dir):
    """The thinned menu of each trip, by a greedy scan along its frontier."""
    m = trips.menu(trips.frontier(derive(spark, sf_dir, OPTIONS)))
    return m.select("trip", F.size("options").alias("options"), F.element_at("options", -1)["gain"].alias("best_gain"))


@query(f"""
WITH e AS (SELECT trip, name, sum(length_m) AS m, min(seq) AS first FROM ({ROUTE}) r WHERE name <> '' GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY round(m, 6) DESC, name) AS rank FROM e)
SELECT trip, string_agg(name, ' / ' ORDER BY first) AS names FROM t WHERE rank <= 3 GROUP BY trip""")
def w20_road_names(spark, sf_dir):
    return trips.road_names(derive(spark, sf_dir, ROUTE)).select("trip", F.array_join("names", " / ").alias("names"))


@query(f"SELECT trip, round(sum(CASE WHEN n > 1 THEN length_m ELSE 0 END) / 1000, 6) AS repeated_km FROM (SELECT *, row_number() OVER (PARTITION BY trip, edge ORDER BY seq) AS n FROM ({ROUTE}) r) q GROUP BY trip")
def w22_repeated_km(spark, sf_dir):
    return trips.repeated_km(derive(spark, sf_dir, ROUTE)).select("trip", F.round("repeated_km", 6).alias("repeated_km"))


@query(f"""
WITH r AS (SELECT *, score >= 7 AS f FROM ({ROUTE}) q), a AS (SELECT *, lag(f) OVER (PARTITION BY trip ORDER BY seq) AS was, sum(length_m) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING) AS z FROM r),
b AS (SELECT *, sum(CASE WHEN f AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT trip, island, round(min(z - length_m), 3) AS from_m, round(max(z), 3) AS to_m, count(*) AS edges FROM b WHERE f GROUP BY trip, island""")
def w14_stretches(spark, sf_dir):
    """Maximal runs of beautiful edges with where they begin and end."""
    out = trips.stretches(derive(spark, sf_dir, ROUTE), F.col("score") >= trips.BEAUTIFUL)
    return out.select("trip", "island", F.round("from_m", 3).alias("from_m"), F.round("to_m", 3).alias("to_m"), "edges")


_ARMS = "SELECT o_custkey AS pair, CASE o_orderkey % 2 WHEN 0 THEN 'fast' ELSE 'scenic' END AS arm, max(CAST(o_orderkey % 97 AS DOUBLE)) AS minutes, max(CAST(o_orderkey % 53 AS DOUBLE)) AS beautiful_km, max(CAST(o_orderkey % 11 AS DOUBLE)) AS km FROM orders GROUP BY 1, 2"


@query(f"""
WITH p AS (SELECT pair, max(CASE WHEN arm = 'fast' THEN minutes END) AS fm, max(CASE WHEN arm = 'scenic' THEN minutes END) AS sm, max(CASE WHEN arm = 'fast' THEN beautiful_km END) AS fb, max(CASE WHEN arm = 'scenic' THEN beautiful_km END) AS sb, max(CASE WHEN arm = 'fast' THEN km END) AS fk, max(CASE WHEN arm = 'scenic' THEN km END) AS sk FROM ({_ARMS}) a GROUP BY pair)
SELECT pair, sm - fm AS extra, round((sb - fb) / 1.609344, 6) AS gain, round((sb - fb) / 1.609344 / CASE WHEN sm IS NULL OR fm IS NULL THEN 0.1 ELSE greatest(sm - fm, 0.1) END, 6) AS rate, abs(sk - fk) < 1e-6 AS same FROM p""")
def a15_trade(spark, sf_dir):
    out = trips.trade(derive(spark, sf_dir, _ARMS))
    return out.select("pair", "extra", F.round("gain", 6).alias("gain"), F.round("rate", 6).alias("rate"), "same")


@query(f"""
WITH s AS (SELECT trip % 97 AS pair, CAST(option % 11 AS DOUBLE) / 10 AS pref, max(gain) AS beautiful_km FROM ({OPTIONS}) o GROUP BY 1, 2), g AS (SELECT pref, beautiful_km - lag(beautiful_km) OVER (PARTITION BY pair ORDER BY pref) AS gain FROM s)
SELECT pref, round(avg(CASE WHEN gain < 0 THEN 1.0 ELSE 0.0 END), 8)::DOUBLE AS falls, round(avg(gain), 8) AS gain, round(avg(CASE WHEN gain = 0 THEN 1.0 ELSE 0.0 END), 8)::DOUBLE AS unchanged FROM g WHERE gain IS NOT NULL GROUP BY pref""")
def a17_preference_sweep(spark, sf_dir):
    s = derive(spark, sf_dir, OPTIONS).groupBy((F.col("trip") % 97).alias("pair"), ((F.col("option") % 11).cast("double") / 10).alias("pref")).agg(F.max("gain").alias("beautiful_km"))
    return trips.sweep(s).select("pref", *[F.round(c, 8).alias(c) for c in ("falls", "gain", "unchanged")])


@query(f"""
WITH e AS (SELECT t.threshold, o.trip % 5 AS band, CASE WHEN gain > t.threshold THEN 1.0 ELSE 0.0 END AS f FROM ({OPTIONS}) o, (VALUES (5.0::DOUBLE), (10.0), (20.0)) t(threshold))
SELECT threshold, band, round(avg(f), 8)::DOUBLE AS share FROM e GROUP BY GROUPING SETS ((threshold, band), (threshold))""")
def a16_firing_rates(spark, sf_dir):
    o = derive(spark, sf_dir, OPTIONS).withColumn("band", F.col("trip") % 5)
    return trips.firing_rates(o, "gain", [5.0, 10.0, 20.0], "band").withColumn("share", F.round("share", 8))


@query(f"""
WITH m AS (SELECT trip % 40 AS source, CAST(floor(gain) AS BIGINT) AS miss FROM ({OPTIONS}) o), k AS (SELECT unnest(range(0, 15)) AS k), e AS (SELECT source, k, CASE WHEN miss > k THEN 1.0 ELSE 0.0 END AS f FROM m, k),
a AS (SELECT k, avg(f) AS s FROM e GROUP BY k) SELECT source, e.k, round(CASE WHEN count(*) >= 380 THEN avg(f) ELSE any_value(a.s) END, 8)::DOUBLE AS s FROM e JOIN a USING (k) GROUP BY source, e.k""")
def a42_survival(spark, sf_dir):
    o = derive(spark, sf_dir, OPTIONS).select((F.col("trip") % 40).alias("source"), F.floor("gain").alias("miss"))
    return trips.survival(o, "source", 14, 380).withColumn("s", F.round("s", 8))


@query("""
WITH a AS (SELECT o_custkey AS k, o_orderdate AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice) AS nth, o_totalprice AS p FROM orders WHERE o_orderkey % 10 <> 3),
b AS (SELECT o_custkey AS k, o_orderdate AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice + (o_orderkey % 7 = 0)::INT) AS nth, o_totalprice + (o_orderkey % 7 = 0)::INT AS p FROM orders WHERE o_orderkey % 10 <> 4),
j AS (SELECT CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'old' ELSE 'both' END AS side, a.v IS DISTINCT FROM b.v AS dv, a.p IS DISTINCT FROM b.p AS dp FROM a FULL JOIN b ON a.k = b.k AND a.nth = b.nth)
SELECT side, count(*) AS rows, sum(CASE WHEN side = 'both' AND dv THEN 1 ELSE 0 END) AS dates, sum(CASE WHEN side = 'both' AND dp THEN 1 ELSE 0 END) AS prices FROM j GROUP BY side""")
def j18_reconcile(spark, sf_dir):
    """Full outer comparison of two builds, repeats numbered, differences by column."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("v"), F.col("o_totalprice").alias("p"), F.col("o_orderkey").alias("i"))
    old = o.where("i % 10 <> 3").drop("i")
    new = o.where("i % 10 <> 4").withColumn("p", F.col("p") + (F.col("i") % 7 == 0).cast("int")).drop("i")
    d = checks.reconcile(old, new, ["k"], ["v", "p"])
    n = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    return d.groupBy("side").agg(F.count(F.lit(1)).alias("rows"), n("v_differs").alias("dates"), n("p_differs").alias("prices"))


@query()
def q2_dataset_digest(spark, sf_dir):
    """Q2: a digest of a table that does not depend on the order or the files of its rows."""
    return checks.digest(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


@query("SELECT l_orderkey AS way_id, l_partkey AS part FROM lineitem WHERE l_quantity > 49 UNION SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount > 0.09 EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def s2_set_operations(spark, sf_dir):
    """Union of parts made distinct, less another set."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pick = lambda c: li.where(c).select(F.col("l_orderkey").alias("way_id"), F.col("l_partkey").alias("part"))
    return pick("l_quantity > 49").unionByName(pick("l_discount > 0.09")).dropDuplicates(["way_id", "part"]).join(pick("l_returnflag = 'R'").distinct().hint("merge"), ["way_id", "part"], "left_anti")
