"""Queries: study tables over roads, drives and marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from viamark.functions.tags import SPEED_KMH
from viamark.operators import checks, studies
from viamark.operators.scenery import unpaved
from viamark.plans.catalog import query
from viamark.plans.derived import PLACES, REFS, SEGMENTS, WAYS, derive
from viamark.plans.q_rasters import ROUTE
from viamark.plans.q_roads import _RUNNING, CURVES
from viamark.plans.q_traces import _MARKS, _marks

_KMH = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SPEED_KMH.items())
LENGTHS = f"SELECT w.way_id, highway, oneway, name, surface, region, length_m, CAST((w.way_id * 37) % 101 AS DOUBLE) / 10 AS score FROM ({WAYS}) w JOIN (SELECT way_id, sum(len) AS length_m FROM ({SEGMENTS}) s GROUP BY way_id) l ON l.way_id = w.way_id"


def _ways(spark, sf_dir):
    w = derive(spark, sf_dir, LENGTHS)
    kmh = F.create_map(*[F.lit(x) for k, v in SPEED_KMH.items() for x in (k, float(v))])[F.col("highway")]
    return w.withColumns({"kmh": kmh, "unpaved": unpaved()})


@query(f"""
SELECT highway, round(sum(length_m) / 1000, 4) AS km, round(sum(CASE WHEN surface <> '' THEN length_m ELSE 0 END) / sum(length_m), 8) AS tagged, round(sum(CASE WHEN surface IN ('gravel', 'compacted') THEN length_m ELSE 0 END) / sum(length_m), 8) AS unpaved,
  round(sum(length_m) / sum(length_m / CASE highway {_KMH} END), 6) AS kmh FROM ({LENGTHS}) w GROUP BY highway""")
def a23_tag_coverage(spark, sf_dir):
    out = studies.tag_coverage(_ways(spark, sf_dir), "highway")
    return out.select("highway", F.round("km", 4).alias("km"), F.round("tagged", 8).alias("tagged"), F.round("unpaved", 8).alias("unpaved"), F.round("kmh", 6).alias("kmh"))


@query(f"SELECT region, highway, round(sum(length_m) / 1000, 4) AS km, round(sum(length_m * score) / sum(length_m), 8) AS mean, round(sum(CASE WHEN score >= 7 THEN length_m ELSE 0 END) / sum(length_m), 8) AS high FROM ({LENGTHS}) w GROUP BY ROLLUP (region, highway)")
def a26_region_totals(spark, sf_dir):
    """Tables by region and class with total rows."""
    out = studies.totals(_ways(spark, sf_dir), "region", "highway")
    return out.select("region", "highway", F.round("km", 4).alias("km"), F.round("mean", 8).alias("mean"), F.round("high", 8).alias("high"))


@query(f"SELECT region, round(sum(CASE WHEN highway = 'motorway' THEN length_m END), 3) AS motorway, round(sum(CASE WHEN highway = 'primary' THEN length_m END), 3) AS primary, round(sum(CASE WHEN highway = 'residential' THEN length_m END), 3) AS residential FROM ({LENGTHS}) w GROUP BY region")
def a28_crossed_table(spark, sf_dir):
    return studies.crossed(_ways(spark, sf_dir), "region", "highway", ["motorway", "primary", "residential"], F.round(F.sum("length_m"), 3))


@query(f"SELECT region, round(sum(length_m) / 1000, 4) AS km, round(sum(length_m * score) / sum(length_m), 8) AS mean, median(score) AS p50, round(sum(CASE WHEN score >= 7 THEN length_m ELSE 0 END) / sum(length_m), 8) AS high, round(sum(CASE WHEN score < 3 THEN length_m ELSE 0 END) / sum(length_m), 8) AS low FROM ({LENGTHS}) w GROUP BY region HAVING sum(length_m) >= 600000")
def a29_distribution(spark, sf_dir):
    out = studies.distribution(_ways(spark, sf_dir), "region", 600.0)
    return out.select("region", F.round("km", 4).alias("km"), F.round("mean", 8).alias("mean"), "p50", F.round("high", 8).alias("high"), F.round("low", 8).alias("low"))


@query(f"""
SELECT name, round(moved, 4) AS moved_km, round(change, 8) AS change FROM (SELECT name, sum(CASE WHEN abs(d) > 0.25 THEN length_m ELSE 0 END) / 1000 AS moved, sum(length_m * d) / sum(length_m) AS change
  FROM (SELECT *, CAST(way_id % 13 AS DOUBLE) / 20 - 0.3 AS d FROM ({LENGTHS}) w) x GROUP BY name) y WHERE moved > 0 ORDER BY moved DESC, name LIMIT 15""")
def a31_movers(spark, sf_dir):
    """The 15 roads that a candidate moves most."""
    w = _ways(spark, sf_dir).withColumn("base", F.lit(0.0)).withColumn("candidate", (F.col("way_id") % 13).cast("double") / 20 - 0.3)
    return studies.movers(w, "base", "candidate", "name").select("name", F.round("moved_km", 4).alias("moved_km"), F.round("change", 8).alias("change"))


_ALL = f"SELECT s.way_id, s.n, s.x, s.y, s.x2, s.y2, (degrees(atan2(x2 - x, y2 - y)) + 360) % 360 AS b, w.highway FROM ({SEGMENTS}) s JOIN ({WAYS}) w ON w.way_id = s.way_id WHERE len > 0"


#: Samples each 25 m of minor ways, with the bearing of the segment they lie on.
_EVERY = f"""
SELECT c.way_id AS edge, c.way_id * 100000 + c.k AS pid, round(arg_min(s.x + t * (s.x2 - s.x), s.n), 6) AS px, round(arg_min(s.y + t * (s.y2 - s.y), s.n), 6) AS py, arg_min((degrees(atan2(s.x2 - s.x, s.y2 - s.y)) + 360) % 360, s.n) AS pb FROM (
  SELECT way_id, k, (k + 0.5) * total / n AS at FROM (SELECT way_id, total, n, unnest(range(0, n)) AS k FROM (SELECT s.way_id, sum(len) AS total, CAST(greatest(1, round(sum(len) / 25)) AS BIGINT) AS n FROM ({SEGMENTS}) s JOIN ({WAYS}) w ON w.way_id = s.way_id WHERE highway IN ('tertiary', 'residential') GROUP BY s.way_id HAVING sum(len) > 0) a) b) c
  JOIN ({_RUNNING}) s ON s.way_id = c.way_id AND s.pos + s.len >= c.at - 1e-9, LATERAL (SELECT CASE WHEN s.len > 0 THEN greatest(0.0, least(1.0, (c.at - s.pos) / s.len)) ELSE 0.0 END AS t) z GROUP BY c.way_id, c.k"""
_OFFS = """
SELECT p.*, q.way_id, CASE WHEN abs(pb - b) % 180 > 90 THEN 180 - abs(pb - b) % 180 ELSE abs(pb - b) % 180 END AS off, sqrt(pow(px - x - t * (x2 - x), 2) + pow(py - y - t * (y2 - y), 2)) AS dist
  FROM p JOIN a q ON q.highway IN ('motorway', 'primary', 'secondary') AND least(q.x, q.x2) - {d} <= px AND greatest(q.x, q.x2) + {d} >= px AND least(q.y, q.y2) - {d} <= py AND greatest(q.y, q.y2) + {d} >= py,
  LATERAL (SELECT greatest(0.0, least(1.0, ((px - q.x) * (q.x2 - q.x) + (py - q.y) * (q.y2 - q.y)) / ((q.x2 - q.x) * (q.x2 - q.x) + (q.y2 - q.y) * (q.y2 - q.y)))) AS t) z"""


def _every(spark, sf_dir):
    """edge, pid, x, y, bearing: samples each 25 m of minor ways."""
    from viamark.functions import geometry as g
    from viamark.plans.derived import roads

    r = roads(spark, sf_dir).where(F.col("highway").isin("tertiary", "residential")).withColumn("parts", g.located("geom")).withColumn("total", F.aggregate("parts", F.lit(0.0), lambda t, s: t + s["len"])).where("total > 0")
    r = r.withColumn("n", F.greatest(F.lit(1), F.round(F.col("total") / 25)).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = (F.col("k") + 0.5) * F.col("total") / F.col("n") - 1e-9
    r = r.withColumns({"p": g.point_on("parts", at), "on": F.element_at(F.filter("parts", lambda s: s["at"] + s["len"] >= at), 1)})
    return r.select(F.col("way_id").alias("edge"), (F.col("way_id") * 100000 + F.col("k")).alias("pid"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), g.bearing(F.col("on.a"), F.col("on.b")).alias("bearing"))


def _major(spark, sf_dir):
    s = derive(spark, sf_dir, _ALL).where(F.col("highway").isin("motorway", "primary", "secondary"))
    return s.select("way_id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by"), F.col("b").alias("bearing"))


@query(f"""
WITH a AS MATERIALIZED ({_ALL}), p AS MATERIALIZED ({_EVERY}), d AS ({_OFFS.format(d=12)})
SELECT pid, arg_min(way_id, (dist, way_id)) AS way_id, round(min(dist), 4) AS dist FROM d WHERE dist <= 12 AND off <= 30 GROUP BY pid""")
def j5_same_way_match(spark, sf_dir):
    """The nearest major road within 12 m that runs the same way, each 25 m of every minor road."""
    return studies.same_way(_every(spark, sf_dir).drop("edge"), _major(spark, sf_dir), "way_id").withColumn("dist", F.round("dist", 4))


@query(f"""
WITH g AS (SELECT region, CAST(count(*) AS DOUBLE) AS y, sum(CASE WHEN highway IN ('residential', 'tertiary') THEN length_m ELSE 0 END) / 1000 AS u, sum(CASE WHEN highway NOT IN ('residential', 'tertiary') THEN length_m ELSE 0 END) / 1000 AS v FROM ({LENGTHS}) w GROUP BY region),
t AS (SELECT *, sum(u * u) OVER () - u * u AS a, sum(u * v) OVER () - u * v AS b, sum(v * v) OVER () - v * v AS c, sum(u * y) OVER () - u * y AS d, sum(v * y) OVER () - v * y AS e FROM g)
SELECT region, round((c * d - b * e) / (a * c - b * b) * u + (a * e - b * d) / (a * c - b * b) * v, 4) AS predicted, y AS actual FROM t""")
def v21_growth_projection(spark, sf_dir):
    """Least squares without intercept, each region predicted from the others."""
    minor = F.col("highway").isin("residential", "tertiary")
    km = lambda c: F.sum(F.when(c, F.col("length_m")).otherwise(0.0)) / 1000
    g = _ways(spark, sf_dir).groupBy("region").agg(F.count(F.lit(1)).cast("double").alias("y"), km(minor).alias("u"), km(~minor).alias("v"))
    return studies.projection(g, "region", "y", "u", "v").withColumn("predicted", F.round("predicted", 4))


@query(f"""
WITH r AS (SELECT trip, seq, name, length_m, CAST((edge * 31) % 120 AS DOUBLE) - 60 AS turn FROM ({ROUTE}) q), f AS (SELECT *, CASE WHEN name IS DISTINCT FROM lag(name) OVER w OR abs(turn) >= 45 THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY trip ORDER BY seq)),
l AS (SELECT *, sum(new) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING) AS leg FROM f)
SELECT trip, min(seq) AS first, any_value(name) AS name, round(sum(length_m), 3) AS length_m, count(*) AS edges FROM l GROUP BY trip, leg""")
def w15_legs(spark, sf_dir):
    """Instruction legs of every trip."""
    r = derive(spark, sf_dir, ROUTE).withColumn("turn", ((F.col("edge") * 31) % 120).cast("double") - 60)
    return studies.legs(r, "name", "turn").select("trip", "first", "name", F.round("length_m", 3).alias("length_m"), "edges")


@query(f"""
WITH e AS (SELECT way_id, region, highway FROM ({LENGTHS}) w), o AS (SELECT way_id, CASE WHEN way_id % 17 = 0 THEN 'other' ELSE highway END AS highway FROM e)
SELECT e.region, count(*) AS rows, sum(CASE WHEN e.highway <> o.highway THEN 1 ELSE 0 END) AS differ FROM e JOIN o USING (way_id) GROUP BY e.region""")
def j16_aligned_check(spark, sf_dir):
    """Two tables of the same keys joined and the columns that must be equal counted."""
    e = derive(spark, sf_dir, LENGTHS).select("way_id", "region", "highway")
    o = e.select("way_id", F.when(F.col("way_id") % 17 == 0, "other").otherwise(F.col("highway")).alias("other"))
    return e.join(o.hint("merge"), "way_id").groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("highway") != F.col("other")).cast("int")).alias("differ"))


@query("SELECT l_orderkey AS way_id, l_partkey AS part FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def j17_side_table_check(spark, sf_dir):
    """Rows of a side table that the graph (orders but for pending ones) does not have."""
    side = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("way_id"), F.col("l_partkey").alias("part"))
    graph = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("way_id"))
    return checks.matches(side, graph, ["way_id"])


@query(f"""
WITH m AS (SELECT stratum, score, nice, road FROM ({_MARKS}) q), r AS (SELECT stratum, count(*) AS n, round(avg(CASE WHEN nice = 1 THEN score END), 6) AS nice_mean, round(avg(CASE WHEN nice = 0 THEN score END), 6) AS dull_mean, count(DISTINCT road) AS roads FROM m GROUP BY stratum)
SELECT * FROM r""")
def v28_feature_separation(spark, sf_dir):
    """How a single feature separates marks in each stratum."""
    m = _marks(spark, sf_dir)
    mean = lambda v: F.round(F.avg(F.when(F.col("nice") == v, F.col("score"))), 6)
    return m.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), mean(1).alias("nice_mean"), mean(0).alias("dull_mean"), F.countDistinct("road").alias("roads"))


@query()
def a47_balanced_logistic(spark, sf_dir):
    """A class-balanced logistic model of marks, trained on all other strata."""
    m = _marks(spark, sf_dir).withColumns({"log_chars": F.log1p("score"), "toxic_": F.col("toxic").cast("double"), "label": F.col("nice").cast("double")})
    return studies.balanced_logistic(m.where("nice is not null and toxic is not null"), ["log_chars", "toxic_"], "label", "stratum")


_BANDS = [1000.0, 5000.0, 10000.0, 20000.0, 60000.0]
_MIX = "({x}) % 1000003 * 48271 % 2147483647"


@query(f"""
WITH p AS MATERIALIZED (SELECT id, x, y FROM ({PLACES}) q), n AS (SELECT count(*) AS n FROM p), a AS (SELECT id, x, y, {_MIX.format(x="id * 7919 + (1700 + j) * 104729 + 1")} % n AS slot FROM p, n, range(1, 9) r(j)), b AS (SELECT id AS dest, x AS x2, y AS y2, {_MIX.format(x="id * 7919 + 1700 * 104729 + 1")} % n AS slot FROM p, n),
d AS (SELECT DISTINCT id, dest, sqrt(pow(x - x2, 2) + pow(y - y2, 2)) AS d FROM a JOIN b USING (slot) WHERE id <> dest),
c AS (SELECT *, CAST({" + ".join(f"(d >= {e})::INT" for e in _BANDS[1:])} AS INT) AS band FROM d WHERE d >= {_BANDS[0]} AND d < {_BANDS[-1]})
SELECT band, id, dest AS "to", round(d, 6) AS d FROM c QUALIFY row_number() OVER (PARTITION BY band ORDER BY {_MIX.format(x="id * 7919 + dest * 104729 + 17")}, id, dest) <= 500""")
def j37_banded_pairs(spark, sf_dir):
    """A seeded sample of ordered pairs of places in bands of distance (a sampling operator)."""
    return studies.banded_pairs(derive(spark, sf_dir, PLACES), _BANDS, 500, 8).select("band", "id", "to", F.round("d", 6).alias("d"))


@query(f"""
WITH a AS MATERIALIZED ({_ALL}), p AS MATERIALIZED ({_EVERY}), d AS ({_OFFS.format(d=15)}),
b AS (SELECT edge, pid, arg_min(way_id, (dist, way_id, off)) AS way_id, arg_min(off, (dist, way_id, off)) AS off FROM d WHERE dist <= 15 GROUP BY edge, pid)
SELECT b.edge, b.way_id, round(count(*) / any_value(n.n), 8) AS share FROM b JOIN (SELECT edge, count(*) AS n FROM p GROUP BY edge) n ON n.edge = b.edge WHERE off <= 30 GROUP BY b.edge, b.way_id""")
def j6_line_shares(spark, sf_dir):
    """Nearest line within 15 m first, then its direction; the share of each road's samples, 25 m apart, on a line."""
    p = _every(spark, sf_dir)
    m = studies.same_way(p, _major(spark, sf_dir), "way_id", 15.0, 30.0, align_first=False)
    return studies.covered(m, p.select("pid", "edge"), "edge", "way_id").withColumn("share", F.round("share", 8))


@query(f"""
WITH w AS ({LENGTHS})
SELECT CASE WHEN highway = 'motorway' THEN 'motorway' WHEN score >= 7 THEN 'beautiful' WHEN length_m < 500 THEN 'short' ELSE 'kept' END AS reason, count(*) AS rows FROM w GROUP BY 1""")
def q4_refusal_counters(spark, sf_dir):
    """Q4: every way that a report leaves out has one reason, in a fixed order, and a count."""
    w = _ways(spark, sf_dir)
    reason = F.when(F.col("highway") == "motorway", "motorway").when(F.col("score") >= 7, "beautiful").when(F.col("length_m") < 500, "short")
    return checks.refusals(w, reason)


@query(f"""
SELECT way_id, round(10 * greatest(0, least(1, (1.0 / 1.5 * 1.31 * CAST(way_id % 11 AS DOUBLE) / 10 + 0.5 / 1.5 * 1.31 * CAST(way_id % 7 AS DOUBLE) / 6 + 0.143) * 1.2)), 6) AS score FROM ({LENGTHS}) v""")
def g13_user_weights(spark, sf_dir):
    """Scores under a user's weights, scaled to the total of the defaults."""
    from viamark.operators import network, scenery

    w = _ways(spark, sf_dir).withColumns({"c_water": (F.col("way_id") % 11).cast("double") / 10, "c_forest": (F.col("way_id") % 7).cast("double") / 6})
    raw = network.reweighted(w, {"water": 1.0, "forest": 0.5}, scenery.WEIGHTS)
    return w.select("way_id", F.round(scenery.composite(raw, F.lit(0.0)), 6).alias("score"))


_SIGNED = "CASE node_id % 9 WHEN 0 THEN 'signal' WHEN 1 THEN 'stop' WHEN 2 THEN 'giveway' END"
_FACING = "CASE node_id % 5 WHEN 0 THEN 'forward' WHEN 1 THEN 'backward' ELSE '' END"


@query(f"""
WITH r AS (SELECT *, min(n) OVER (PARTITION BY way_id) AS first, max(n) OVER (PARTITION BY way_id) AS last, count(*) OVER (PARTITION BY node_id) AS uses, {_SIGNED} AS kind FROM ({REFS}) v),
s AS (SELECT *, CASE WHEN uses >= 2 THEN '' ELSE {_FACING} END AS d FROM r WHERE kind IS NOT NULL)
SELECT way_id, {', '.join(f"sum(CASE WHEN kind = '{k}' AND {ok} THEN 1 ELSE 0 END) AS n_{k}_{d}" for k in ('signal', 'stop', 'giveway') for d, ok in (('fwd', "n > first AND d <> 'backward'"), ('rev', "n < last AND d <> 'forward'")))}
FROM s GROUP BY way_id""")
def a6_controls(spark, sf_dir):
    """Controls of each way, charged to the direction that approaches them."""
    from viamark.operators import network

    refs = derive(spark, sf_dir, REFS)
    signs = refs.select("node_id").distinct().select("node_id", F.expr(_SIGNED).alias("kind"), F.expr(_FACING).alias("direction")).where("kind is not null")
    ways = refs.groupBy("way_id").agg(F.lit(1).alias("seq"), F.min("n").alias("first"), F.max("n").alias("last"))
    return network.controls(refs.select("way_id", "n", "node_id"), signs, network.junctions(refs), ways).drop("seq")


@query(f"SELECT way_id, k, round(curvature, 4) AS curvature FROM ({CURVES}) c WHERE way_id IN (SELECT way_id FROM ({WAYS}) w)")
def d4_curvature(spark, sf_dir):
    """Degrees of turn per km of every piece of a road, between chords of 60 m."""
    from viamark.plans.q_roads import _chunks

    return _chunks(spark, sf_dir, curves=True).select("way_id", "k", F.round("curvature", 4).alias("curvature"))
