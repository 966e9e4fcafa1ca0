"""Queries: closures of edges by tags, barriers and agency lines, and when they hold.

Tags, barriers and agency lines are derived from keys by arithmetic, as all layers are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from viamark.functions import calendar
from viamark.functions.tags import MAJOR, row_source
from viamark.operators import closures as c
from viamark.plans.catalog import query
from viamark.plans.derived import EDGE_STEPS, EDGES, NODES, REFS, ROADS, SEGMENTS, WAYS, derive
from viamark.plans.tables import stage

_W = "m1, d1, m2, d2"
#: Seasonal tags of ways: five kinds of source.
TAGGED = f"""
SELECT way_id, name, CASE way_id % 5 WHEN 0 THEN 'winter_service=no' WHEN 1 THEN 'motor_vehicle:conditional=no @ (Nov 15-Apr 30)' WHEN 2 THEN 'table loop road: survey' WHEN 3 THEN 'mvum passengervehicle_datesopen=05/01-11/15' ELSE 'access:conditional=no @ (Jun 1-Aug 31)' END AS tag,
  CASE way_id % 5 WHEN 0 THEN 11 WHEN 1 THEN 11 WHEN 2 THEN 10 WHEN 3 THEN 11 ELSE 6 END AS m1, CASE way_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 15 WHEN 2 THEN 20 WHEN 3 THEN 16 ELSE 1 END AS d1,
  CASE way_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN 4 ELSE 8 END AS m2, CASE way_id % 5 WHEN 0 THEN 15 WHEN 1 THEN 30 WHEN 2 THEN 20 WHEN 3 THEN 30 ELSE 31 END AS d2
FROM ({WAYS}) w WHERE scenic OR surface = 'gravel'"""
#: Barriers: nodes with a gate or a ford; some gates are seasonal.
BARRIERS = f"SELECT node_id AS node, x, y, CASE node_id % 4 WHEN 0 THEN 'ford=yes' WHEN 1 THEN 'barrier=gate, locked=yes' ELSE 'barrier=gate' END AS why FROM ({NODES}) n WHERE (node_id * 13) % 11 < 3"
_SOURCE = "CASE WHEN tag LIKE 'table %' THEN 'table' WHEN tag LIKE 'mvum%' THEN 'agency_dated' WHEN m1 = 11 AND d1 = 1 AND m2 = 5 AND d2 = 15 AND tag NOT LIKE '%@%' THEN 'osm_default' ELSE 'osm_dated' END"
_DIST = "sqrt(pow({x} - s.x - t * (s.x2 - s.x), 2) + pow({y} - s.y - t * (s.y2 - s.y), 2))"
_T = "CASE WHEN s.len > 0 THEN greatest(0.0, least(1.0, (({x} - s.x) * (s.x2 - s.x) + ({y} - s.y) * (s.y2 - s.y)) / (s.len * s.len))) ELSE 0.0 END"


def _pairs_sql(ways: str) -> str:
    """way_id, edge of the ways that ``ways`` (a text with way_id) names."""
    t = _T.format(x="e.mx", y="e.my")
    return f"""
SELECT DISTINCT way_id, edge FROM (SELECT a.way_id, e.edge, e.mx, e.my, s.x, s.y, s.x2, s.y2, {t} AS t FROM ({EDGES}) e
  JOIN (SELECT DISTINCT way_id, node_id FROM ({REFS}) r) a ON a.node_id = e.u JOIN (SELECT DISTINCT way_id, node_id FROM ({REFS}) r) b ON b.node_id = e.v AND b.way_id = a.way_id
  JOIN ({ways}) w ON w.way_id = a.way_id JOIN ({SEGMENTS}) s ON s.way_id = a.way_id) s WHERE {_DIST.format(x="mx", y="my")} <= 1"""


def _shapes(spark, sf_dir, ways):
    """way_id and shape of the ways' edges, and all edges with their shape."""
    edges, ids = derive(spark, sf_dir, EDGES), ways.select("way_id").distinct()
    nodes = derive(spark, sf_dir, REFS).select("way_id", F.col("node_id").alias("node")).join(ids.hint("merge"), "way_id", "left_semi")
    segs = derive(spark, sf_dir, SEGMENTS).select("way_id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by")).join(ids.hint("merge"), "way_id", "left_semi")
    edges = stage(edges.select("edge", "way_id", *c.SHAPE, "length_m"), "shapes")
    return c.way_shapes(nodes, segs, edges), edges


def _pairs(spark, sf_dir, ways):
    return c.of_shape(*_shapes(spark, sf_dir, ways)).select("way_id", "edge")


_UNPAVED = f"SELECT way_id, name FROM ({WAYS}) w WHERE surface = 'compacted'"


@query(f"SELECT way_id, edge FROM ({_pairs_sql(_UNPAVED)}) p")
def j11_way_edges(spark, sf_dir):
    """The edges of every way with a compacted surface."""
    return _pairs(spark, sf_dir, derive(spark, sf_dir, _UNPAVED))


_PLACED = f"""
WITH e AS MATERIALIZED ({EDGES}), b AS ({BARRIERS}), g AS (SELECT node, count(*) AS degree, count(DISTINCT edge) AS edges FROM (SELECT u AS node, edge FROM e UNION ALL SELECT v, edge FROM e) z GROUP BY node),
k AS (SELECT b.*, degree, edges FROM b LEFT JOIN g USING (node)), own AS (SELECT DISTINCT b.node, q.node_id AS way_node FROM b JOIN ({REFS}) p ON p.node_id = b.node JOIN ({REFS}) q ON q.way_id = p.way_id),
cand AS (SELECT DISTINCT k.node, k.x AS px, k.y AS py, e.edge FROM k JOIN own o1 ON o1.node = k.node JOIN e ON e.u = o1.way_node JOIN own o2 ON o2.node = k.node AND o2.way_node = e.v WHERE degree IS NULL),
seg AS (SELECT way_id * 10000 + seq AS edge, x, y, x2, y2, len, z - len AS start FROM ({EDGE_STEPS}) s),
pt AS (SELECT node, edge, start + t * len AS at_m, {_DIST.format(x="px", y="py")} AS dist FROM (SELECT cand.*, s.x, s.y, s.x2, s.y2, s.len, s.start, {_T.format(x="px", y="py")} AS t FROM cand JOIN seg s USING (edge)) s),
hits AS (SELECT node, edge, arg_min(at_m, (dist, at_m)) AS at_m FROM pt GROUP BY node, edge HAVING min(dist) <= 1),
placed AS (SELECT node, 'edge' AS place, edge, at_m FROM hits
  UNION ALL SELECT node, 'through', edge, 0.0 FROM k JOIN e ON e.u = k.node WHERE degree = 2 AND edges = 2 UNION ALL SELECT node, 'through', edge, length_m FROM k JOIN e ON e.v = k.node WHERE degree = 2 AND edges = 2
  UNION ALL SELECT node, CASE WHEN degree = 1 THEN 'dead end' ELSE 'junction' END, NULL, NULL FROM k WHERE degree IS NOT NULL AND NOT (degree = 2 AND edges = 2)
  UNION ALL SELECT node, 'not in the graph', NULL, NULL FROM k WHERE degree IS NULL AND node NOT IN (SELECT node FROM hits))
"""


def _placed(spark, sf_dir, edges=None):
    """Where barriers stand; ``edges``: those of EDGES where they have been staged."""
    edges = derive(spark, sf_dir, EDGES) if edges is None else edges
    barriers, refs = derive(spark, sf_dir, BARRIERS), derive(spark, sf_dir, REFS)
    on = refs.join(barriers.select("node").hint("merge"), F.col("node_id") == F.col("node")).select("node", "way_id")
    owner = on.join(refs.select("way_id", F.col("node_id").alias("way_node")).hint("merge"), "way_id").select("node", "way_node")
    segs = derive(spark, sf_dir, EDGE_STEPS).select((F.col("way_id") * 10000 + F.col("seq")).alias("edge"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by"), (F.col("z") - F.col("len")).alias("start"))
    return c.place_barriers(barriers.select("node", "x", "y"), owner, edges, segs)


@query(_PLACED + "SELECT node, place, edge, round(at_m, 3) AS at_m FROM placed")
def j12_barriers(spark, sf_dir):
    """Where each barrier stands and which edges it closes."""
    return _placed(spark, sf_dir).select("node", "place", "edge", F.round("at_m", 3).alias("at_m"))


_SEASONAL = f"""
SELECT edge, rule, node_id, {_W}, min(tag) AS tag FROM (
  SELECT p.edge, 'edge' AS rule, CAST(-1 AS BIGINT) AS node_id, {_W}, tag FROM ({_pairs_sql(TAGGED)}) p JOIN ({TAGGED}) w ON w.way_id = p.way_id
  UNION ALL SELECT edge, place, node, 11, 1, 5, 15, 'barrier=gate, winter' FROM (SELECT * FROM ({_PLACED} SELECT * FROM placed) q) q WHERE edge IS NOT NULL AND node % 4 >= 2) z
GROUP BY ALL"""


def _seasonal_parts(spark, sf_dir):
    """Way rows by SHAPE and gate rows by edge, each closure once and with its source; and all edges with their shape."""
    tagged = derive(spark, sf_dir, TAGGED)
    shapes, edges = _shapes(spark, sf_dir, tagged)
    ways = shapes.join(tagged.hint("merge"), "way_id")
    ways = ways.select(*c.SHAPE, "way_id", "tag", *[F.col(x).cast("int").alias(x) for x in c.WINDOW], F.lit("edge").alias("rule"), F.lit(-1).cast("long").alias("node_id"), F.lit(None).cast("double").alias("at_m"))
    gates = _placed(spark, sf_dir, edges).where("edge is not null and node % 4 >= 2")
    gates = gates.select("edge", F.lit(None).cast("long").alias("way_id"), F.lit("barrier=gate, winter").alias("tag"), *[F.lit(v).alias(x) for x, v in zip(c.WINDOW, calendar.WINTER, strict=True)], F.col("place").alias("rule"), F.col("node").alias("node_id"), "at_m")
    source = row_source(F.col("tag"), F.struct(*c.WINDOW) == calendar.window(*calendar.WINTER))
    # Rows of ways and of gates differ in node_id, so each kind is made single apart, ways before their edges are named.
    return c.seasonal_table(ways, key=c.SHAPE).withColumn("source", source), c.seasonal_table(gates).withColumn("source", source), edges


def _seasonal(spark, sf_dir):
    """Way rows and gate rows with their source."""
    ways, gates, edges = _seasonal_parts(spark, sf_dir)
    return c.of_shape(ways, edges).unionByName(gates)


@query(f"SELECT edge, rule, node_id, CAST(m1 AS INT) AS m1, CAST(d1 AS INT) AS d1, CAST(m2 AS INT) AS m2, CAST(d2 AS INT) AS d2, tag FROM ({_SEASONAL}) t")
def j13_seasonal_table(spark, sf_dir):
    """The seasonal table, way rows and gate rows, each closure once."""
    return _seasonal(spark, sf_dir).select("edge", "rule", "node_id", *c.WINDOW, "tag")


@query(f"""
SELECT edge, rule, kind, osm_id, round(min(at_m), 3) AS at_m FROM (
  SELECT edge, 'edge' AS rule, 'way' AS kind, way_id AS osm_id, CAST(NULL AS DOUBLE) AS at_m FROM ({_pairs_sql(f"SELECT way_id FROM ({WAYS}) w WHERE oneway = '-1'")}) p
  UNION ALL SELECT edge, place, CASE WHEN node % 4 = 0 THEN 'ford' ELSE 'barrier' END, node, at_m FROM ({_PLACED} SELECT * FROM placed) q WHERE edge IS NOT NULL AND node % 4 < 2) z
GROUP BY edge, rule, kind, osm_id""")
def j13_closed_to_cars(spark, sf_dir):
    """The all-year table: closed ways' edges, and barriers by where they stand."""
    ways = _pairs(spark, sf_dir, derive(spark, sf_dir, WAYS).where("oneway = '-1'")).select("edge", F.lit("edge").alias("rule"), F.lit("way").alias("kind"), F.col("way_id").alias("osm_id"), F.lit(None).cast("double").alias("at_m"))
    shut = _placed(spark, sf_dir).where("edge is not null and node % 4 < 2").select("edge", F.col("place").alias("rule"), F.when(F.col("node") % 4 == 0, "ford").otherwise("barrier").alias("kind"), F.col("node").alias("osm_id"), "at_m")
    # Pairs of ways and edges come once as they are.
    return ways.unionByName(shut.groupBy("edge", "rule", "kind", "osm_id").agg(F.round(F.min("at_m"), 3).alias("at_m")))


@query(f"SELECT edge, min(way_id) AS way_id FROM ({_pairs_sql(_UNPAVED)}) p GROUP BY edge")
def j13_osm_unpaved(spark, sf_dir):
    """The unpaved table, one row an edge."""
    shapes, edges = _shapes(spark, sf_dir, derive(spark, sf_dir, _UNPAVED))
    return c.of_shape(shapes.groupBy(*c.SHAPE).agg(F.min("way_id").alias("way_id")), edges).select("edge", "way_id")


@query(f"""
WITH t AS (SELECT *, {_SOURCE} AS source FROM ({_SEASONAL}) q), f AS (SELECT *, CASE WHEN m1 * 100 + d1 <= m2 * 100 + d2 THEN 115 BETWEEN m1 * 100 + d1 AND m2 * 100 + d2 ELSE 115 >= m1 * 100 + d1 OR 115 <= m2 * 100 + d2 END AS winter FROM t),
d AS (SELECT DISTINCT edge FROM f WHERE source IN ('osm_dated', 'table', 'agency_dated') AND rule = 'edge' AND winter),
h AS (SELECT f.*, source = 'osm_default' AS def, edge IN (SELECT edge FROM d) AS dated FROM f), g AS (SELECT DISTINCT node_id FROM h WHERE def AND dated AND rule = 'through')
SELECT source, rule, (def AND dated AND rule = 'edge') OR (def AND rule = 'through' AND node_id IN (SELECT node_id FROM g)) AS gives_way, count(*) AS rows FROM h GROUP BY ALL""")
def c9_default_gives_way(spark, sf_dir):
    """Rows by source, and the undated defaults that give way to a dated winter."""
    return c.default_gives_way(_seasonal(spark, sf_dir)).groupBy("source", "rule", "gives_way").agg(F.count(F.lit(1)).alias("rows"))


#: Tags of the map, of forests, parks and hand tables, one for each way.
_TAGS_OF = f"""
SELECT way_id, CASE way_id % 6 WHEN 0 THEN concat('motor_vehicle:conditional=no @ (Nov ', CAST(way_id % 28 + 1 AS STRING), '-Apr 15)') WHEN 1 THEN concat('mvum passengervehicle=open ', CAST(way_id % 12 + 1 AS STRING), '/01-11/15')
  WHEN 2 THEN concat('nps YOSE: closed in winter, ', name) WHEN 3 THEN concat('table pass ', CAST(way_id % 4 AS STRING), ': by hand') WHEN 4 THEN 'seasonal=yes' ELSE 'access:conditional = no @ snow' END AS tag,
  CASE way_id % 6 WHEN 1 THEN 'mvum' WHEN 2 THEN 'nps' WHEN 3 THEN 'table' ELSE 'osm' END AS kind, CASE WHEN way_id % 5 = 0 THEN way_id ELSE -1 END AS node_id FROM ({WAYS}) w"""


@query(f"""
SELECT CASE kind WHEN 'mvum' THEN concat('mvum ', string_split(regexp_extract(tag, '^[^ ]* (.*)$', 1), '=')[1]) WHEN 'nps' THEN string_split(tag, ':')[1] WHEN 'table' THEN string_split(tag, ':')[1] ELSE regexp_replace(tag, ':conditional *=.*$', ':conditional') END AS family,
  CASE WHEN string_split(tag, ' ')[1] IN ('mvum', 'nps', 'table') THEN string_split(tag, ' ')[1] WHEN node_id >= 0 THEN 'osm gate' ELSE 'osm way' END AS source, count(*) AS rows FROM ({_TAGS_OF}) t GROUP BY ALL""")
def b20_provenance(spark, sf_dir):
    """Seasonal rows by the family of their tag and by who closes them."""
    from viamark.functions.tags import family, seasonal_source

    t = derive(spark, sf_dir, _TAGS_OF)
    return t.groupBy(family(F.col("tag"), F.col("kind")).alias("family"), seasonal_source(F.col("tag"), F.col("node_id")).alias("source")).agg(F.count(F.lit(1)).alias("rows"))


#: A day for each kind of event: that of its last one.
_DAYS = "SELECT kind AS day_id, CAST(month(max(ts)) AS INT) AS month, CAST(day(max(ts)) AS INT) AS day FROM (SELECT event_type AS kind, CAST(ts AS TIMESTAMP) AS ts FROM events) e GROUP BY kind"


@query(f"""
WITH t AS MATERIALIZED ({_SEASONAL}), d AS ({_DAYS})
SELECT day_id, count(DISTINCT edge) AS edges, count(DISTINCT CASE WHEN rule = 'through' THEN node_id END) AS gates, count(DISTINCT ({_W})) AS windows FROM t JOIN d ON CASE WHEN m1 * 100 + d1 <= m2 * 100 + d2 THEN month * 100 + day BETWEEN m1 * 100 + d1 AND m2 * 100 + d2 ELSE month * 100 + day >= m1 * 100 + d1 OR month * 100 + day <= m2 * 100 + d2 END GROUP BY day_id""")
def c10_closed_on(spark, sf_dir):
    """For each day, the windows in force and how many edges and gates they close."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("day_id")).agg(F.max("ts").alias("ts"))
    days = e.select("day_id", F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"))
    return c.closed_counts(_seasonal(spark, sf_dir), days)


_BEFORE = "[0,31,60,91,121,152,182,213,244,274,305,335]"
_START, _SPAN = f"({_BEFORE}[m1] + d1 - 1)", f"((({_BEFORE}[m2] + d2 - 1) - ({_BEFORE}[m1] + d1 - 1) + 366) % 366 + 1)"
#: Margins in days before and after, by source.
MARGINS = {"osm_default": (0, 30), "agency_dated": (7, 14)}
_PRE = "CASE source " + " ".join(f"WHEN '{k}' THEN {a}" for k, (a, _) in MARGINS.items()) + " ELSE 0 END"
_POST = "CASE source " + " ".join(f"WHEN '{k}' THEN {b}" for k, (_, b) in MARGINS.items()) + " ELSE 0 END"
_CLOSED = f"""
SELECT edge, day, min(source) AS source FROM (SELECT edge, source, (x % 366 + 366) % 366 AS day FROM (
  SELECT edge, source, unnest(range({_START} - {_PRE}, {_START} + least({_SPAN} + {_POST}, 366))) AS x FROM (SELECT *, {_SOURCE} AS source FROM ({_SEASONAL}) q) r) y) z GROUP BY edge, day"""


def _closed_days(spark, sf_dir):
    """edge, way_id and the set of its windows; and the days on which each set is closed (set, day, source)."""
    margin = lambda i: F.coalesce(F.create_map(*[F.lit(x) for k, v in MARGINS.items() for x in (k, v[i])])[F.col("source")], F.lit(0))
    ways, gates, edges = _seasonal_parts(spark, sf_dir)
    by_set, sets = c.edges_by_windows(ways, gates, edges.drop("length_m"))
    return by_set, c.closed_days(sets, margin(0), margin(1), "set")


def _longest_closed(spark, sf_dir):
    """edge, way_id and the longest closed run of its windows, found once for each set of them."""
    by_set, days = _closed_days(spark, sf_dir)
    return c.by_size(by_set, stage(c.longest_closed(days, "set"), "longest"), "set").drop("set")


@query(f"SELECT edge, count(*) AS days, count(DISTINCT source) AS sources FROM ({_CLOSED}) d GROUP BY edge")
def c12_policy_days(spark, sf_dir):
    """Days on which each edge is closed under margins by source."""
    by_set, days = _closed_days(spark, sf_dir)
    n = days.groupBy("set").agg(F.count(F.lit(1)).alias("days"), F.countDistinct("source").alias("sources"))
    return c.by_size(by_set, stage(n, "days"), "set").select("edge", "days", "sources")


_WINTERS = f"""
WITH d AS MATERIALIZED ({_CLOSED}), two AS (SELECT * FROM d UNION ALL SELECT edge, day + 366, source FROM d),
r AS (SELECT edge, min(day) AS f, count(*) AS n, arg_max(source, day) AS source FROM (SELECT *, day - row_number() OVER (PARTITION BY edge ORDER BY day) AS run FROM two) q GROUP BY edge, run),
b AS (SELECT edge, arg_min((f, n, source), (-least(n, 366), f)) AS m FROM r GROUP BY edge),
winters AS (SELECT edge, m[1] % 366 AS first_day, least(m[2], 366) AS closed, CASE WHEN m[2] < 366 THEN (m[1] % 366 + m[2]) % 366 END AS reopens, m[3] AS source FROM b)
"""


@query(_WINTERS + "SELECT edge, first_day, closed, reopens, source FROM winters")
def c13_longest_closed(spark, sf_dir):
    """Each edge's longest closed run, its first open day and who binds it."""
    w = _longest_closed(spark, sf_dir)
    return w.select("edge", F.col("first_day").cast("long").alias("first_day"), F.col("closed").cast("long").alias("closed"), F.col("reopens").cast("long").alias("reopens"), "source")


@query(_WINTERS + f"""
SELECT source, count(*) AS edges, round(avg(CASE WHEN miss > 0 THEN 1.0 ELSE 0.0 END), 8)::DOUBLE AS late, round(avg(abs(miss)), 6) AS mean_miss, max(miss) AS worst
FROM (SELECT w.source, reopens - (100 + r.region * 3) AS miss FROM winters w JOIN ({ROADS}) r ON r.edge = w.edge WHERE reopens IS NOT NULL) z GROUP BY source""")
def c14_season_miss(spark, sf_dir):
    """C14: first open days against published ones (a date for each region), by the source that binds."""
    w = _longest_closed(spark, sf_dir).where("reopens is not null")
    r = derive(spark, sf_dir, WAYS).select("way_id", (100 + F.col("region") * 3).alias("published"))
    m = w.join(r.hint("merge"), "way_id").withColumn("miss", F.col("reopens").cast("long") - F.col("published"))
    return m.groupBy("source").agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg(F.when(F.col("miss") > 0, 1.0).otherwise(0.0)), 8).alias("late"), F.round(F.avg(F.abs("miss")), 6).alias("mean_miss"), F.max("miss").alias("worst"))


#: Lines of an agency: shares of edges that they cover, and what each line says.
SHARES = "SELECT l_orderkey AS edge, l_suppkey AS line, max(l_quantity) / 90 AS share FROM lineitem GROUP BY l_orderkey, l_suppkey"
LINES = "SELECT s_suppkey AS line, CASE s_suppkey % 6 WHEN 0 THEN '05/01-11/15' WHEN 1 THEN '01/01-10/11    10/22-12/31' WHEN 2 THEN '01/01-12/31' WHEN 3 THEN '13/01-02/30' WHEN 4 THEN '' ELSE '06/15-09/30, 11/01-12/15' END AS dates, CASE WHEN s_suppkey % 4 = 0 THEN 'seasonal' ELSE '' END AS seasonal, s_suppkey % 7 < 3 AS car FROM supplier"
_OPEN = f"""
SELECT line, seasonal, CASE WHEN ok THEN list_transform(r, lambda x: [CAST(x[1:2] AS INT), CAST(x[4:5] AS INT), CAST(x[7:8] AS INT), CAST(x[10:11] AS INT)]) END AS o
FROM (SELECT *, len(r) > 0 AND trim(regexp_replace(dates, '\\d\\d/\\d\\d-\\d\\d/\\d\\d', '', 'g'), ' ,;&') = '' AND len(list_filter(r, lambda x: NOT (CAST(x[1:2] AS INT) BETWEEN 1 AND 12 AND CAST(x[7:8] AS INT) BETWEEN 1 AND 12))) = 0 AS ok FROM (SELECT *, regexp_extract_all(dates, '\\d\\d/\\d\\d-\\d\\d/\\d\\d') AS r FROM ({LINES}) l) a) b"""
_SHUT = f"""
SELECT line, how, day FROM (SELECT line, 'dates' AS how, unnest(list_filter(range(0, 366), lambda d: len(list_filter(o, lambda w: CASE WHEN {_BEFORE}[w[1]] + w[2] <= {_BEFORE}[w[3]] + w[4] THEN d BETWEEN {_BEFORE}[w[1]] + w[2] - 1 AND {_BEFORE}[w[3]] + w[4] - 1 ELSE d >= {_BEFORE}[w[1]] + w[2] - 1 OR d <= {_BEFORE}[w[3]] + w[4] - 1 END)) = 0)) AS day FROM ({_OPEN}) q WHERE o IS NOT NULL
  UNION ALL SELECT line, 'seasonal, no readable dates', (305 + k) % 366 FROM ({_OPEN}) q, range(0, 243) z(k) WHERE o IS NULL AND seasonal = 'seasonal') y"""


def _line_windows(spark, sf_dir):
    """line, how, windows: closed windows of an agency's lines."""
    return derive(spark, sf_dir, LINES).select("line", "car", calendar.agency_windows(F.col("dates"), F.col("seasonal")).alias("a")).select("line", "car", "a.how", "a.windows")


@query(f"SELECT line, how, count(*) AS days, min(day) AS first_day, max(day) AS last_day FROM ({_SHUT}) s GROUP BY line, how")
def c7_agency_windows(spark, sf_dir):
    """Open ranges of a dated field to the days they close; an unknown season where none can be read."""
    w = _line_windows(spark, sf_dir).withColumn("w", F.explode("windows"))
    d = w.select("line", "how", F.explode(calendar.days_of(F.col("w"))).alias("day")).distinct()
    return d.groupBy("line", "how").agg(F.count(F.lit(1)).alias("days"), F.min("day").cast("long").alias("first_day"), F.max("day").cast("long").alias("last_day"))


@query(f"""
WITH s AS ({SHARES}), w AS (SELECT s_suppkey AS line, CASE WHEN s_suppkey % 2 = 0 THEN 11 ELSE 12 END AS m1 FROM supplier WHERE s_suppkey % 3 <> 0), k AS (SELECT s.*, w.m1, round(sum(share) OVER (PARTITION BY edge), 9) AS covered, max(share) OVER (PARTITION BY edge) AS most FROM s JOIN w USING (line))
SELECT edge, m1, min(line) AS line, count(*) AS lines FROM k WHERE covered >= 0.5 AND (share >= 0.2 OR most < 0.2) GROUP BY edge, m1""")
def j7_closed_by_lines(spark, sf_dir):
    """Edges that seasonal lines cover by half, and the windows of lines with a fifth of them."""
    s = derive(spark, sf_dir, SHARES)
    w = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("line"), F.when(F.col("s_suppkey") % 2 == 0, 11).otherwise(12).alias("m1"), F.lit(1).alias("d1"), F.lit(4).alias("m2"), F.lit(30).alias("d2"))
    return c.closed_by_lines(s, w).select("edge", "m1", "line", "lines")


#: Agency rows of edges: dates, table roads and park windows.
_AGENCY = "SELECT l_orderkey AS edge, CAST(10 + l_partkey % 3 AS INT) AS m1, CAST(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE 2 END AS INT) AS level, concat(l_returnflag, ' ', CAST(l_suppkey AS STRING)) AS tag FROM lineitem"


@query(f"""
WITH r AS ({_AGENCY}), t AS (SELECT DISTINCT edge FROM r WHERE level = 1), k AS (SELECT * FROM r WHERE level < 2 OR edge NOT IN (SELECT edge FROM t))
SELECT edge, m1, min(level) AS level, arg_min(tag, (level, tag)) AS tag FROM k GROUP BY edge, m1""")
def j8_agency_precedence(spark, sf_dir):
    """One row for each edge and window by level; a table road removes its park's windows."""
    r = derive(spark, sf_dir, _AGENCY).withColumns({"d1": F.lit(1), "m2": F.lit(4), "d2": F.lit(30)})
    return c.with_precedence(r, r.where("level = 1")).select("edge", "m1", "level", "tag")


@query(f"""
WITH s AS ({SHARES}), n AS (SELECT line FROM ({LINES}) l WHERE NOT car), g AS (SELECT edge, round(sum(share), 9) AS covered, arg_min(line, (-share, line)) AS line FROM s JOIN n USING (line) GROUP BY edge)
SELECT edge, line, CASE WHEN highway IN ({', '.join(f"'{m}'" for m in MAJOR if m != 'secondary' and m != 'secondary_link')}) THEN 'highway=' || highway WHEN surface IN ('asphalt', 'paved') THEN 'sealed surface' END AS why FROM g JOIN ({WAYS}) w ON w.way_id = edge WHERE covered >= 0.5""")
def j9_no_car_edges(spark, sf_dir):
    """Edges that lines without a designation for cars close, and the exceptions that keep them open."""
    ways = derive(spark, sf_dir, WAYS).withColumnRenamed("way_id", "edge")
    from viamark.functions.tags import agency_exception

    why = agency_exception(F.col("highway"), F.lit(""))
    return c.no_car_edges(derive(spark, sf_dir, SHARES), derive(spark, sf_dir, LINES), ways, why, F.col("surface").isin("asphalt", "paved"))


@query(f"""
WITH e AS MATERIALIZED ({ROADS}), p AS (SELECT region AS road, edge, u, v FROM e WHERE scenic), x AS (SELECT edge, u, v FROM e WHERE surface = ''), n AS (SELECT road, u AS node FROM p UNION SELECT road, v FROM p)
SELECT DISTINCT n.road, x.edge FROM x JOIN n ON n.node = x.u OR n.node = x.v WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.road = n.road AND p.edge = x.edge)""")
def j10_beside_paths(spark, sf_dir):
    """Edges without a season that touch a table road's path."""
    e = derive(spark, sf_dir, ROADS)
    return c.beside_paths(e.where("surface = ''"), e.where("scenic").select(F.col("region").alias("road"), "edge"), e)


#: Samples along ways, each with the class of the agency line beside it (null: none).
_SAMPLES = "SELECT way_id AS edge, (n - 0.5) * 60.0 AS along, CASE WHEN r = 4 THEN NULL ELSE r END AS rule FROM (SELECT way_id, n, CAST((way_id * 7 + CAST(floor(n / 2) AS BIGINT) * 3) % 5 AS INT) AS r FROM (" + REFS + ") v) q"
_ENDS = f"SELECT way_id AS edge, min_by(node_id, n) AS u, max_by(node_id, n) AS v, count(*) * 60.0 AS length_m FROM ({REFS}) r GROUP BY way_id"
_RUNS = f"""
SELECT edge, run, any_value(rule) AS rule, count(*) AS n, min(along) AS from_m, max(along) AS to_m, coalesce(arg_min(b, along), -2) AS before, coalesce(arg_max(a, along), -2) AS after FROM (
  SELECT *, sum(CASE WHEN b = rule THEN 0 ELSE 1 END) OVER (PARTITION BY edge ORDER BY along ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, lag(rule) OVER w AS b, lead(rule) OVER w AS a FROM (SELECT edge, along, coalesce(rule, -1) AS rule FROM ({_SAMPLES}) s) t WINDOW w AS (PARTITION BY edge ORDER BY along)) u) x GROUP BY edge, run"""


def _samples(spark, sf_dir):
    return derive(spark, sf_dir, _SAMPLES)


@query(f"SELECT edge, CAST(run AS BIGINT) AS run, rule, n, CAST(from_m AS DOUBLE) AS from_m, CAST(to_m AS DOUBLE) AS to_m, before, after FROM (SELECT edge, run, rule, n, from_m, to_m, first(b ORDER BY run) AS before, first(a ORDER BY run) AS after FROM (SELECT *, coalesce(lag(rule) OVER (PARTITION BY edge ORDER BY run), -2) AS b, coalesce(lead(rule) OVER (PARTITION BY edge ORDER BY run), -2) AS a FROM ({_RUNS}) r) z GROUP BY ALL) y")
def w11_rule_runs(spark, sf_dir):
    """Runs of equal class along an edge with the classes before and after."""
    r = c.rule_runs(_samples(spark, sf_dir))
    return r.select("edge", "run", "rule", "n", F.col("from_m").cast("double").alias("from_m"), F.col("to_m").cast("double").alias("to_m"), "before", "after")


_LABELS = f"""
WITH r AS MATERIALIZED ({_RUNS}), s AS (SELECT edge, count(*) AS samples, {', '.join(f"sum(CASE WHEN rule = {i} THEN 1 ELSE 0 END) AS c{i}" for i in (1, 2, 3))} FROM ({_SAMPLES}) q GROUP BY edge),
l AS (SELECT edge, {', '.join(f"max(CASE WHEN rule = {i} THEN n ELSE 0 END) AS l{i}" for i in (1, 2, 3))}, min(CASE WHEN rule = 1 THEN from_m END) AS f, max(CASE WHEN rule = 1 THEN to_m END) AS z FROM r GROUP BY edge),
e AS (SELECT e.*, w.highway, w.name, w.highway IN ('motorway', 'primary', 'secondary') AS major, samples, c1, c2, c3, l1, l2, l3, f, z, length_m / samples AS sp FROM ({_ENDS}) e JOIN ({WAYS}) w ON w.way_id = e.edge JOIN s USING (edge) JOIN l USING (edge)),
q AS (SELECT *, c1 / samples >= 0.5 OR (NOT major AND l1 * sp >= 100) AS q1, c2 / samples >= 0.5 OR (NOT major AND l2 * sp >= 100) AS q2, c3 / samples >= 0.5 AS q3 FROM e),
o AS (SELECT node, count(*) AS n FROM (SELECT u AS node FROM q WHERE NOT (q1 OR q2) UNION ALL SELECT v FROM q WHERE NOT (q1 OR q2)) z GROUP BY node),
k AS (SELECT q.*, coalesce(a.n, 0) - CASE WHEN q1 OR q2 THEN 0 ELSE 1 END > 0 AND coalesce(b.n, 0) - CASE WHEN q1 OR q2 THEN 0 ELSE 1 END > 0 AS con FROM q LEFT JOIN o a ON a.node = q.u LEFT JOIN o b ON b.node = q.v),
t AS (SELECT *, CASE WHEN q1 OR (NOT major AND con AND l1 >= 2) THEN 1 WHEN q2 OR (NOT major AND con AND l2 >= 2) THEN 2 WHEN q3 THEN 3 END AS best FROM k),
labels AS (SELECT edge, name, ['closed', 'private', 'unpaved'][best] AS rule, [c1, c2, c3][best] / samples AS coverage, [l1, l2, l3][best] * sp AS run_m, CASE WHEN best = 1 THEN greatest(0.0, f - sp / 2) END AS from_m, CASE WHEN best = 1 THEN least(length_m, z + sp / 2) END AS to_m, length_m FROM t WHERE best IS NOT NULL)
"""


def _labels(spark, sf_dir):
    e = derive(spark, sf_dir, _ENDS).withColumn("length_m", F.col("length_m").cast("double")).join(derive(spark, sf_dir, WAYS).select(F.col("way_id").alias("edge"), "highway").hint("merge"), "edge")
    return c.road_class_labels(_samples(spark, sf_dir), e, F.col("highway").isin(*MAJOR))


@query(_LABELS + "SELECT edge, rule, round(coverage, 8)::DOUBLE AS coverage, round(run_m, 4)::DOUBLE AS run_m, round(from_m, 4)::DOUBLE AS from_m, round(to_m, 4)::DOUBLE AS to_m FROM labels")
def w12_road_class(spark, sf_dir):
    """The class of a state's lines that an edge takes, by coverage, by a long run or as a connector."""
    return _labels(spark, sf_dir).select("edge", "rule", F.round("coverage", 8).alias("coverage"), *[F.round(x, 4).alias(x) for x in ("run_m", "from_m", "to_m")])


_BOXES = "(VALUES ('BUILDING 3', 0.0, 0.0, 40000.0, 20000.0), ('FURNITURE 7', 0.0, 0.0, 20000.0, 40000.0)) b(rule_name, x0, y0, x1, y1)"


@query(_LABELS + f"""
, m AS (SELECT way_id, arg_min(mx, seq) AS x, arg_min(my, seq) AS y FROM ({EDGES}) q GROUP BY way_id), sealed AS (SELECT way_id FROM ({WAYS}) w WHERE surface IN ('asphalt', 'paved')),
opened AS (SELECT edge FROM labels JOIN m ON m.way_id = edge JOIN {_BOXES} ON rule_name = name AND rule = 'private' AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)
SELECT rule, CASE WHEN edge IN (SELECT edge FROM opened) THEN 'open to all: ' || name WHEN rule = 'unpaved' AND edge IN (SELECT way_id FROM sealed) THEN 'sealed surface' END AS why, count(*) AS labels FROM labels JOIN m ON m.way_id = edge GROUP BY ALL""")
def w13_overrides(spark, sf_dir):
    """Labels overruled by a box of a road open to all or by a sealed surface, with the reason."""
    boxes = spark.createDataFrame([("BUILDING 3", 0.0, 0.0, 40000.0, 20000.0), ("FURNITURE 7", 0.0, 0.0, 20000.0, 40000.0)], "name string, x0 double, y0 double, x1 double, y1 double")
    ways = derive(spark, sf_dir, WAYS).select(F.col("way_id").alias("edge"), "name", "surface")
    mid = derive(spark, sf_dir, EDGES).groupBy(F.col("way_id").alias("edge")).agg(F.min_by("mx", "seq").alias("x"), F.min_by("my", "seq").alias("y"))
    labels = _labels(spark, sf_dir).join(ways.hint("merge"), "edge").join(mid.hint("merge"), "edge")
    return c.overridden(labels, boxes, ways.where("surface in ('asphalt', 'paved')")).groupBy("rule", "why").agg(F.count(F.lit(1)).alias("labels"))


_ROWS = "b AS (SELECT edge, unnest(CASE WHEN (from_m IS NULL OR from_m <= 25) AND (to_m IS NULL OR to_m >= length_m - 25) THEN [NULL] ELSE [from_m, to_m] END) AS at_m FROM labels WHERE rule = 'closed')"


@query(_LABELS + f", {_ROWS} SELECT edge, round(at_m, 4)::DOUBLE AS at_m FROM b")
def g18_partly_closed(spark, sf_dir):
    """Closed labels as a whole edge, or as two barriers where only a stretch is closed."""
    return c.barrier_rows(_labels(spark, sf_dir)).withColumn("at_m", F.round("at_m", 4))


@query(_LABELS + f""", {_ROWS}, p AS (SELECT way_id * 10000 + n AS pid, way_id AS edge, (n - 0.25) * 60.0 AS pos FROM ({REFS}) r)
SELECT pid, NOT max(coalesce(at_m <= pos, false)) AS u_open, NOT max(coalesce(at_m > pos, false)) AS v_open FROM p LEFT JOIN b USING (edge) GROUP BY pid""")
def j36_open_side(spark, sf_dir):
    """The ends of its edge that a point may leave by, barriers inside the edge considered."""
    p = derive(spark, sf_dir, REFS).select((F.col("way_id") * 10000 + F.col("n")).alias("pid"), F.col("way_id").alias("edge"), ((F.col("n") - 0.25) * 60.0).alias("pos"))
    return c.open_side(p, c.barrier_rows(_labels(spark, sf_dir)))


_ALL_CLOSED = f"SELECT r.edge, r.highway, r.name, r.length_m, CASE WHEN r.oneway = '-1' THEN 'way' ELSE 'ford' END AS kind, CASE WHEN r.surface IN ('gravel', 'compacted') THEN 'surface' ELSE 'access' END AS family FROM ({ROADS}) r WHERE oneway = '-1' OR u % 29 = 0"


@query(f"SELECT kind, family, count(*) AS edges, round(sum(length_m) / 1000, 4) AS km FROM ({_ALL_CLOSED}) c WHERE highway IN ('motorway', 'primary', 'secondary') GROUP BY kind, family")
def a39_major_closures(spark, sf_dir):
    """Closed km of major roads by kind and family of tag; an edge counts once."""
    t = derive(spark, sf_dir, _ALL_CLOSED).where(F.col("highway").isin(*MAJOR)).dropDuplicates(["edge"])
    return t.groupBy("kind", "family").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("length_m") / 1000, 4).alias("km"))


@query(f"SELECT edge, name, round(length_m, 3) AS length_m FROM ({_ALL_CLOSED}) c WHERE highway IN ('motorway', 'primary', 'secondary') ORDER BY round(length_m, 3) DESC, edge LIMIT 30")
def a39_longest_closures(spark, sf_dir):
    """The 30 longest closed edges of major roads (a report)."""
    t = derive(spark, sf_dir, _ALL_CLOSED).where(F.col("highway").isin(*MAJOR)).withColumn("length_m", F.round("length_m", 3))
    return t.select("edge", "name", "length_m").orderBy(F.desc("length_m"), "edge").limit(30)


@query(f"""
WITH t AS MATERIALIZED ({_SEASONAL}), d AS ({_DAYS}), r AS ({ROADS}), n AS (SELECT DISTINCT day_id, r.name, r.edge, r.length_m FROM t JOIN d ON CASE WHEN m1 * 100 + d1 <= m2 * 100 + d2 THEN month * 100 + day BETWEEN m1 * 100 + d1 AND m2 * 100 + d2 ELSE month * 100 + day >= m1 * 100 + d1 OR month * 100 + day <= m2 * 100 + d2 END JOIN r ON r.edge = t.edge WHERE t.rule = 'edge')
SELECT day_id, name, round(sum(length_m) / 1000, 4) AS km, round(sum(length_m) / 1000, 4) >= 1 AS closed FROM n GROUP BY day_id, name""")
def a40_seasonal_km(spark, sf_dir):
    """Closed km of every named road on each day, an edge once, against the bar of 1 km."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("day_id")).agg(F.max("ts").alias("ts"))
    on = c.closed_on(_seasonal(spark, sf_dir).where("rule = 'edge'"), e.select("day_id", F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"))).select("day_id", "edge").distinct()
    named = on.join(derive(spark, sf_dir, ROADS).select("edge", "name", "length_m").hint("merge"), "edge")
    return named.groupBy("day_id", "name").agg(F.round(F.sum("length_m") / 1000, 4).alias("km")).withColumn("closed", F.col("km") >= 1)
