"""Queries: tag rules and seasonal windows. Tags are picked for each part by arithmetic on its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from viamark.functions import calendar as cal
from viamark.functions import tags as t
from viamark.operators.scenery import UNPAVED
from viamark.plans.catalog import query
from viamark.plans.derived import derive


def _pick(name: str, key: str, values: list[str | None]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE ({key}) % {len(values)} {cases} END AS {name}"


_KEYS = {
    "highway": ("p_partkey * 7 + p_size", ["motorway", "trunk", "primary", "secondary", "tertiary", "residential", "unclassified", "footway", "living_street", "trunk_link", "primary_link", "service", "track"]),
    "access": ("p_partkey * 3", [None, "private", "no", None, "yes", "permit", " Destination", None, "Forestry"]),
    "motor_vehicle": ("p_partkey * 5 + 1", [None, None, "yes", None, "no", None, None]),
    "barrier": ("p_partkey * 11", [None, "gate", "bollard", "toll_booth", None, "lift_gate", "chain", "kerb", "Gate", "block"]),
    "locked": ("p_partkey", [None, None, "yes"]),
    "ford": ("p_partkey * 13", [None, None, None, None, "yes", None, None, None, None, None, None]),
    "surface": ("p_partkey * 17 + 2", [None, "gravel", "asphalt", "Dirt", "paved", "compacted", None]),
    "smoothness": ("p_partkey * 19", [None, "good", "horrible", "very_bad", None]),
    "4wd_only": ("p_partkey", [None] * 16 + ["yes"]),
    "maxspeed": ("p_partkey * 23", [None, "55 mph", "50", "none", "0", "35 mph", "", "80"]),
    "oneway": ("p_partkey * 29", [None, "yes", "-1", "no", "", "reverse", "true"]),
    "junction": ("p_partkey", [None] * 5 + ["roundabout", "circular"]),
    "name": ("p_partkey", ["Bald Hill Checkpoint", None, "Main Street", None]),
    "tiger:cfcc": ("p_partkey * 31", [None, "A51", "A41", "A51;A53", "A51;A41", " A52 "]),
}
TAGGED = "SELECT p_partkey AS id, " + ", ".join(_pick(f'"{k}"', *v) for k, v in _KEYS.items()) + " FROM part"


def _tagged(spark, sf_dir):
    flat = derive(spark, sf_dir, TAGGED.replace('"', "`"))
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{k}`").alias("v")) for k in _KEYS]), lambda p: p["v"].isNotNull())
    return flat.select("id", F.map_from_entries(pairs).alias("tags"))


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_P = lambda k: f"""lower(trim(coalesce("{k}", '')))"""
_ACC = "CASE WHEN " + " WHEN ".join(f"{_P(k)} <> '' THEN '{k}=' || {_P(k)}" for k in ("motor_vehicle", "access")) + " END"
_VAL = "CASE WHEN " + " WHEN ".join(f"{_P(k)} <> '' THEN {_P(k)}" for k in ("motor_vehicle", "access")) + " END"


@query(f"""
SELECT id, highway IN {_in(t.DRIVABLE)} AND NOT (coalesce(access, '') IN {_in(t.PRIVATE)} AND coalesce(motor_vehicle, '') <> 'yes') AS drivable,
  {_ACC} AS access_tag, CASE WHEN {_VAL} IN {_in(t.CLOSING)} THEN {_ACC} END AS closed, lower(coalesce(surface, '')) IN {_in(UNPAVED)} AS dirt
FROM ({TAGGED}) t""")
def b1_access(spark, sf_dir):
    """Drivable ways, the tag that decides for cars, and dirt surfaces."""
    a = t.car_access("tags")
    return _tagged(spark, sf_dir).select("id", t.drivable("tags").alias("drivable"), F.concat_ws("=", a["key"], a["value"]).alias("access_tag"), t.closed_to_cars("tags").alias("closed"), t.plain("tags", "surface").isin(*UNPAVED).alias("dirt")).withColumn("access_tag", F.nullif("access_tag", F.lit("")))


@query(f"""
WITH v AS (SELECT *, {_P('barrier')} AS b, {_ACC} AS says, {_VAL} AS val FROM ({TAGGED}) t)
SELECT id, CASE WHEN ford = 'yes' AND NOT (highway IN {_in(t.MAJOR)} AND lower(coalesce(surface, '')) NOT IN {_in(UNPAVED)}) THEN 'ford=yes' WHEN b = '' THEN NULL
  WHEN b = 'toll_booth' AND name = 'Bald Hill Checkpoint' THEN 'barrier=toll_booth, logging checkpoint'
  WHEN b IN {_in(t.PASSABLE)} AND val IN {_in(t.CLOSING)} THEN 'barrier=' || b || ', ' || says WHEN b IN {_in(t.PASSABLE)} AND locked = 'yes' THEN 'barrier=' || b || ', locked=yes'
  WHEN b IN {_in(t.PASSABLE)} THEN NULL WHEN val IS NOT NULL AND val NOT IN {_in(t.CLOSING)} THEN NULL WHEN val IS NOT NULL THEN 'barrier=' || b || ', ' || says ELSE 'barrier=' || b END AS why FROM v""")
def b6_barriers(spark, sf_dir):
    """Why a node stops a car, in the order of the rules."""
    return _tagged(spark, sf_dir).select("id", t.barrier_closes("tags", "tags", UNPAVED).alias("why"))


_SPEEDS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.SPEED_KMH.items())


@query(f"""
WITH v AS (SELECT *, CASE WHEN coalesce(oneway, '') = '' AND (coalesce(junction, '') IN ('roundabout', 'circular') OR highway = 'motorway') THEN 'yes' ELSE coalesce(oneway, '') END AS ow,
  CASE WHEN maxspeed LIKE '%mph%' THEN try_cast(trim(replace(maxspeed, 'mph', '')) AS DOUBLE) * 1.60934 ELSE try_cast(maxspeed AS DOUBLE) END AS posted FROM ({TAGGED}) t)
SELECT id, round(coalesce(nullif(posted, 0), CAST(CASE highway {_SPEEDS} END AS DOUBLE)), 6) AS kmh, ow AS oneway, ow NOT IN ('-1', 'reverse') AS forward, ow NOT IN ('yes', 'true', '1') AS backward FROM v""")
def b9_speed_and_oneway(spark, sf_dir):
    """Posted limit in km/h or the default of the class; directions open to a car."""
    w = _tagged(spark, sf_dir).select("id", F.round(t.maxspeed_kmh("tags"), 6).alias("kmh"), t.oneway("tags").alias("oneway"))
    forward, backward = t.allows(F.col("oneway"))
    return w.withColumns({"forward": forward, "backward": backward})


@query(f"""
WITH v AS (SELECT *, CASE WHEN {_P('surface')} <> '' THEN {_P('surface')} IN {_in(t.SEALED)} ELSE highway IN {_in(t.PAVED_BY_DEFAULT)} END AS paved FROM ({TAGGED}) t)
SELECT id, paved, concat_ws(',', CASE WHEN "4wd_only" = 'yes' THEN '4wd_only=yes' END, CASE WHEN smoothness IN {_in(t.ROUGH)} AND NOT paved THEN 'smoothness=' || smoothness END) AS rough,
  CASE WHEN trim("tiger:cfcc") IN ('A51', 'A52', 'A51;A53') AND {_P('surface')} NOT IN {_in(t.SEALED)} THEN 'tiger:cfcc=' || trim("tiger:cfcc") END AS tiger FROM v""")
def b11_rough_surfaces(spark, sf_dir):
    return _tagged(spark, sf_dir).select("id", t.paved("tags").alias("paved"), F.array_join(t.too_rough("tags"), ",").alias("rough"), t.tiger_unpaved("tags").alias("tiger"))


_STATE = "SELECT s_suppkey AS id, " + ", ".join([_pick("state", "s_suppkey", ["NH", "VT", "MA", "ME"]), _pick("cls", "s_suppkey * 3 + s_nationkey", ["VI", "0", "4", "7", "96", "8", "H", "1", "2", None]), _pick("surf", "s_suppkey * 7", ["6", "1", "2", None])]) + " FROM supplier"


@query(f"""
SELECT id, CASE WHEN state = 'NH' AND cls = 'VI' THEN 'closed:NH VI' WHEN state = 'NH' AND cls = '0' THEN 'private:NH 0'
  WHEN state = 'VT' AND cls = '4' AND surf = '6' THEN 'closed:VT 4 impassable' WHEN state = 'VT' AND cls = '4' THEN 'unpaved:VT 4' WHEN state = 'VT' AND cls = '7' THEN 'closed:VT 7 trail' WHEN state = 'VT' AND cls = '96' THEN 'closed:VT 96 discontinued' WHEN state = 'VT' AND cls = '8' THEN 'private:VT 8 private'
  WHEN state = 'MA' AND cls = 'H' THEN 'private:MA jurisdiction H' WHEN state = 'MA' AND surf = '1' THEN 'unpaved:MA earth' WHEN state = 'MA' AND surf = '2' THEN 'unpaved:MA gravel' WHEN state = 'ME' THEN 'private:ME ' || coalesce(cls, 'unclassed') END AS class FROM ({_STATE}) s""")
def b14_state_classes(spark, sf_dir):
    s = derive(spark, sf_dir, _STATE)
    keys = {"LEGIS_CLASS": "cls", "AOTCLASS": "cls", "JURISDICTN": "cls", "RDCLASS": "cls", "SURFACETYPE": "surf", "SURFACE_TP": "surf"}
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(v).alias("v")) for k, v in keys.items()]), lambda p: p["v"].isNotNull())
    c = t.state_class("state", "attrs")
    out = s.withColumn("attrs", F.map_from_entries(pairs)).withColumn("c", c)
    return out.select("id", F.when(F.col("c").isNotNull(), F.concat_ws(":", "c.rule", "c.label")).alias("class"))


_REFS = "SELECT p_partkey AS id, " + ", ".join([_pick("ref", "p_partkey * 3 + p_size", ["I 95;US 1", "US 20", "MA 2A", " I 495 ; ;US 202", "Main Street", "VT 100 ALT", "", None]), "CAST((p_partkey * 37) % 360 AS DOUBLE) AS bearing", _pick("highway", "p_partkey", ["motorway_link", "primary", "trunk_link", "secondary_link", "residential"]), _pick("junction", "p_partkey * 7", [None, "roundabout", None, "circular", None, None])]) + " FROM part"
_FIRST = "coalesce(list_filter(list_transform(string_split(coalesce(ref, ''), ';'), lambda x: trim(x)), lambda x: x <> '')[1], '')"


@query(f"""
WITH v AS (SELECT *, {_FIRST} AS label, CASE WHEN cos(radians(bearing)) >= 0 THEN 'North' ELSE 'South' END AS ns, CASE WHEN sin(radians(bearing)) >= 0 THEN 'East' ELSE 'West' END AS ew FROM ({_REFS}) r)
SELECT id, label, len(list_filter(list_transform(string_split(coalesce(ref, ''), ';'), lambda x: trim(x)), lambda x: x <> '')) AS refs,
  CASE WHEN label IN ('', 'Main Street') THEN '' WHEN label IN ('US 20') THEN ew WHEN label = 'I 95' THEN ns WHEN abs(cos(radians(bearing))) >= abs(sin(radians(bearing))) THEN ns ELSE ew END AS direction,
  CASE WHEN junction IS NOT NULL THEN 'roundabout' WHEN highway IN ('motorway_link', 'trunk_link') THEN 'ramp' ELSE 'road' END AS kind FROM v""")
def b18_signed_routes(spark, sf_dir):
    """Parts of a multi-value, the signed direction of its first, and the kind of leg."""
    r = derive(spark, sf_dir, _REFS).withColumn("v", t.values(F.col("ref"))).withColumn("label", F.coalesce(F.get("v", F.lit(0)), F.lit("")))
    return r.select("id", "label", F.size("v").cast("long").alias("refs"), t.signed_direction(F.col("label"), F.col("bearing")).alias("direction"), t.leg_kind(F.col("highway"), F.col("junction")).alias("kind"))


#: A window for each customer: months and days by arithmetic, days that every month has.
_WINDOWS = "SELECT c_custkey AS id, CAST(c_custkey % 12 + 1 AS INT) AS m1, CAST(c_custkey * 7 % 28 + 1 AS INT) AS d1, CAST(c_custkey * 5 % 12 + 1 AS INT) AS m2, CAST(c_custkey * 11 % 28 + 1 AS INT) AS d2 FROM customer"
_DOY = "list_value(0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335)"


@query(f"""
WITH w AS ({_WINDOWS}), o AS (SELECT o_orderkey AS id, o_custkey, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders)
SELECT o.id, CASE WHEN m1 * 100 + d1 <= m2 * 100 + d2 THEN m * 100 + d BETWEEN m1 * 100 + d1 AND m2 * 100 + d2 ELSE m * 100 + d >= m1 * 100 + d1 OR m * 100 + d <= m2 * 100 + d2 END AS closed FROM o JOIN w ON w.id = o.o_custkey""")
def c1_in_window(spark, sf_dir):
    """Whether an order's day falls in its customer's window."""
    w = derive(spark, sf_dir, _WINDOWS).withColumn("w", F.struct("m1", "d1", "m2", "d2")).select(F.col("id").alias("o_custkey"), "w")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.join(w.hint("merge"), "o_custkey").select(F.col("o_orderkey").alias("id"), cal.in_window(F.col("w"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")).alias("closed"))


@query(f"""
WITH w AS (SELECT id % 700 AS k, {_DOY}[m1] + d1 - 1 AS a, {_DOY}[m2] + d2 - 1 AS b FROM ({_WINDOWS}) v),
s AS (SELECT k, a - 7 AS a, (b - a + 366) % 366 + 1 + 21 AS n FROM w),
d AS (SELECT DISTINCT k, (a + i + 366) % 366 AS day FROM s, LATERAL (SELECT unnest(range(0, least(n, 366))) AS i) z), c AS (SELECT k, count(*) AS closed FROM d GROUP BY k),
r AS (SELECT d.k, count(*) AS runs, min(d.day) AS first FROM d LEFT JOIN d e ON e.k = d.k AND e.day = (d.day + 365) % 366 WHERE e.k IS NULL GROUP BY d.k)
SELECT c.k, CASE WHEN closed >= 366 THEN 366 ELSE closed END AS closed, CASE WHEN closed >= 366 THEN 1 ELSE runs END AS runs, CASE WHEN closed >= 366 THEN 0 ELSE first END AS first FROM c LEFT JOIN r USING (k)""")
def c5_widened_windows(spark, sf_dir):
    """Windows widened by 7 days before and 14 after, merged, as runs of closed days."""
    w = derive(spark, sf_dir, _WINDOWS).groupBy((F.col("id") % 700).alias("k")).agg(F.collect_list(F.struct("m1", "d1", "m2", "d2")).alias("w"))
    w = w.withColumn("r", cal.widen(F.col("w"), 7, 14))
    days = F.aggregate("r", F.lit(0), lambda n, x: n + F.pmod(cal.day_of(x["m2"], x["d2"]) - cal.day_of(x["m1"], x["d1"]), F.lit(cal.DAYS)) + 1)
    return w.select("k", days.cast("long").alias("closed"), F.size("r").cast("long").alias("runs"), cal.day_of(F.col("r")[0]["m1"], F.col("r")[0]["d1"]).cast("long").alias("first"))


_TEXTS = ["no @ (Dec-Mar)", "no @ (Oct 20-Apr 30; 20:00-07:00)", "yes @ (Jun 3-Sep 12, sunrise-sunset)", "no @ (axleload>8)", "no @ wet", "destination @ (Oct-May)", "no @ Apr-Aug Mo 10:00-18:00", "no @ (3 Nov - 14 Apr); yes @ (May-Jul)", "no @ (2024 Mar 02-2024 Nov 11)"]


@query()
def c2_conditional_windows(spark, sf_dir):
    """Closed windows and refusals of a conditional tag for each order; tests hold the rule table."""
    o = derive(spark, sf_dir, f"SELECT o_orderkey AS id, {_pick('v', 'o_orderkey', _TEXTS)} FROM orders")
    return cal.conditional_windows(o, "id", "v").select("id", F.size("windows").alias("windows"), F.array_join("refused", ",").alias("refused"))
