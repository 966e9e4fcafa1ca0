"""Queries: drives against the lines they followed. Places and clocks are coarse, so thresholds are scaled up."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from viamark.functions import geometry as g
from viamark.operators import driven, spatial, traces
from viamark.plans.catalog import query
from viamark.plans.derived import FIXES, PLACES, SEGMENTS, WATER, WAYS, derive
from viamark.plans.q_traces import _STEPS, _STOPS, H, _steps, _stops
from viamark.plans.tables import stage

#: A drive's lines: one for each reroute (a signup), across the whole square.
_FOLLOW = f"SELECT *, sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY drive ORDER BY ts, fix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seq, CAST((fix * 37) % 360 AS DOUBLE) AS course FROM ({FIXES}) f"
_AX, _AY, _BX, _BY = "CAST(({k} * 7919) % 37250 AS DOUBLE)", "CAST(({k} * 3571) % 37750 AS DOUBLE)", "CAST(({k} * 6007) % 37250 AS DOUBLE)", "CAST(({k} * 4421) % 37750 AS DOUBLE)"
_K = "(drive * 101 + seq * 17)"
_LINES = "SELECT DISTINCT drive, seq, " + ", ".join(f"{e.format(k=_K)} AS {n}" for e, n in ((_AX, "ax"), (_AY, "ay"), (_BX, "qx"), (_BY, "qy"))) + f" FROM ({_FOLLOW}) q"


def _off(p: str = "") -> str:
    """Distance and share along of a fix to its line."""
    return f"CASE WHEN {p}qx = {p}ax AND {p}qy = {p}ay THEN 0.0 ELSE greatest(0.0, least(1.0, ((x - {p}ax) * ({p}qx - {p}ax) + (y - {p}ay) * ({p}qy - {p}ay)) / (pow({p}qx - {p}ax, 2) + pow({p}qy - {p}ay, 2)))) END"


_AGAINST = f"""
SELECT drive, fix, ts, kind, speed, course, seq, x, y, sqrt(pow(x - ax - t * (qx - ax), 2) + pow(y - ay - t * (qy - ay), 2)) AS off, t * sqrt(pow(qx - ax, 2) + pow(qy - ay, 2)) AS along, (degrees(atan2(qx - ax, qy - ay)) + 360) % 360 AS line_bearing
FROM (SELECT f.*, ax, ay, qx, qy, {_off()} AS t FROM ({_FOLLOW}) f JOIN ({_LINES}) l USING (drive, seq)) z"""
ON, OFF = 8000.0, 6000.0


def _followed(spark, sf_dir):
    f = driven.followed(derive(spark, sf_dir, FIXES), F.col("kind") == "signup").withColumn("seq", F.col("seq").cast("long"))
    return f.withColumn("course", ((F.col("fix") * 37) % 360).cast("double"))


def _against(spark, sf_dir):
    f = _followed(spark, sf_dir)
    k = F.col("drive") * 101 + F.col("seq") * 17
    at = lambda m, n: ((k * m) % n).cast("double")
    lines = f.select("drive", "seq").distinct().withColumns({"ax": at(7919, 37250), "ay": at(3571, 37750), "bx": at(6007, 37250), "by": at(4421, 37750)})
    return driven.against(f, lines)


@query(f"SELECT drive, CAST(seq AS BIGINT) AS seq, count(*) AS fixes, min(ts) AS begin, max(ts) AS end FROM ({_FOLLOW}) f GROUP BY drive, seq")
def w5_segments(spark, sf_dir):
    """Fixes grouped by the route they followed."""
    return driven.segments(_followed(spark, sf_dir))


_WIDTHS = (2000.0, 4000.0, 8000.0, 16000.0, 32000.0)
_FIRST = f"SELECT s.drive, s.fix, s.dist, a.off, sqrt(pow(a.x - l.ax - t * (l.qx - l.ax), 2) + pow(a.y - l.ay - t * (l.qy - l.ay), 2)) AS off_first FROM ({_STEPS}) s JOIN (SELECT a.*, {_off('l0.').replace('(x -', '(a.x -').replace('(y -', '(a.y -')} AS t, l0.ax, l0.ay, l0.qx, l0.qy FROM ({_AGAINST}) a JOIN (SELECT * FROM ({_LINES}) q WHERE seq = 0) l0 ON l0.drive = a.drive) a ON a.drive = s.drive AND a.fix = s.fix JOIN (SELECT * FROM ({_LINES}) q WHERE seq = 0) l ON l.drive = a.drive WHERE s.reason IS NULL"


@query(f"SELECT width::DOUBLE AS width, round(sum(CASE WHEN off <= width THEN dist ELSE 0 END) / sum(dist), 8) AS followed, round(sum(CASE WHEN off_first <= width THEN dist ELSE 0 END) / sum(dist), 8) AS original FROM ({_FIRST}) s, (SELECT unnest({list(_WIDTHS)}) AS width) w GROUP BY width")
def w7_width_shares(spark, sf_dir):
    """Shares of driven km within widths of the followed and of the first line."""
    a = _against(spark, sf_dir)
    k = F.col("drive") * 101
    at = lambda m, n: ((k * m) % n).cast("double")
    first = a.where("seq = 0").select("drive").distinct()
    d, _ = g.to_segment(F.col("x"), F.col("y"), at(7919, 37250), at(3571, 37750), at(6007, 37250), at(4421, 37750))
    a = a.join(first.hint("merge"), "drive").withColumn("off_first", d)
    s = _steps(spark, sf_dir).where("reason is null").select("drive", "fix", "dist").join(a.select("drive", "fix", "off", "off_first").hint("merge"), ["drive", "fix"])
    return driven.width_shares(s, _WIDTHS).select("width", F.round("followed", 8).alias("followed"), F.round("original", 8).alias("original"))


@query(f"SELECT count(*) AS holes, round(median(gap), 6) AS median_s, round(max(gap), 6) AS longest_s FROM (SELECT (epoch_us(lead(ts) OVER (PARTITION BY drive ORDER BY ts, fix)) - epoch_us(ts)) / 1e6 AS gap FROM ({FIXES}) f) q WHERE gap > {6 * H}")
def w7_fix_holes(spark, sf_dir):
    """Holes between fixes of more than six hours."""
    h = driven.holes(derive(spark, sf_dir, FIXES), 6 * H)
    return h.select("holes", F.round("median_s", 6).alias("median_s"), F.round("longest_s", 6).alias("longest_s"))


_ANGLED = f"SELECT *, CASE WHEN off <= {ON} AND speed >= 3 THEN abs((course - line_bearing + 540) % 360 - 180) END AS angle FROM ({_AGAINST}) a"
_RUN = "SELECT *, sum(CASE WHEN flag AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY drive ORDER BY ts, fix ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, lag(flag) OVER (PARTITION BY drive ORDER BY ts, fix) AS was FROM ({q}) z) y"


def _angled(spark, sf_dir):
    return driven.course_angles(_against(spark, sf_dir), ON)


@query(f"""
WITH a AS MATERIALIZED (SELECT *, coalesce(angle >= 120, false) AS flag FROM ({_ANGLED}) q), r AS ({_RUN.format(q="SELECT * FROM a")}), n AS (SELECT drive, max(n) AS longest FROM (SELECT drive, island, count(*) AS n FROM r WHERE flag GROUP BY 1, 2) z GROUP BY drive)
SELECT a.drive, count(angle) AS fixes, CAST(sum(CASE WHEN flag THEN 1 ELSE 0 END) AS BIGINT) AS against, coalesce(any_value(n.longest), 0) AS longest FROM a LEFT JOIN n ON n.drive = a.drive GROUP BY a.drive""")
def w8_course_agreement(spark, sf_dir):
    """How often the course points against the line it is on, and the longest run of that."""
    return driven.course_agreement(_angled(spark, sf_dir)).select("drive", "fixes", "against", F.col("longest").cast("long").alias("longest"))


@query(f"""
WITH r AS ({_RUN.format(q=f"SELECT *, coalesce(angle >= 60, false) AS flag FROM ({_ANGLED}) q")})
SELECT drive, CAST(island AS BIGINT) AS island, count(*) AS fixes, round(arg_min(along, (ts, fix)) - arg_max(along, (ts, fix)), 3) AS back_m FROM r WHERE flag GROUP BY drive, island HAVING count(*) >= 3""")
def w9_wrong_way_runs(spark, sf_dir):
    """Runs of three fixes or more that point 60 degrees off their line, and how far they go back."""
    return driven.wrong_way_runs(_angled(spark, sf_dir), 60.0, 3).select("drive", "island", "fixes", F.round("back_m", 3).alias("back_m"))


_STEPPED = f"SELECT a.*, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step, off > {OFF} AS flag, coalesce(max(CASE WHEN off <= {OFF} THEN 1 ELSE 0 END) OVER (PARTITION BY drive, seq ORDER BY ts, fix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM ({_AGAINST}) a WINDOW w AS (PARTITION BY drive ORDER BY ts, fix)"


@query(f"""
WITH r AS MATERIALIZED ({_RUN.format(q=_STEPPED)}), s AS (SELECT drive, island, min(ts) AS b, max(ts) AS e, arg_min(reached, (ts, fix)) AS reached FROM r WHERE flag GROUP BY 1, 2),
c AS (SELECT drive, island, b AS cut FROM s WHERE reached = 1 UNION ALL SELECT s.drive, s.island, f.ts FROM s JOIN ({FIXES}) f ON f.drive = s.drive AND f.kind = 'error' AND f.ts > b AND f.ts <= e WHERE reached = 1 UNION ALL SELECT drive, island, e FROM s WHERE reached = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY drive, island ORDER BY cut) AS piece, lead(cut) OVER (PARTITION BY drive, island ORDER BY cut) AS nxt FROM c),
i AS (SELECT p.drive, p.island, p.piece, (epoch_us(nxt) - epoch_us(cut)) / 1e6 AS seconds, r.speed, r.step FROM p JOIN r ON r.drive = p.drive AND r.island = p.island AND r.flag AND r.ts BETWEEN cut AND nxt WHERE nxt IS NOT NULL AND (epoch_us(nxt) - epoch_us(cut)) / 1e6 >= {H})
SELECT drive, CAST(island AS BIGINT) AS island, round(seconds, 3) AS seconds, round(sum(step), 3) AS metres FROM i GROUP BY drive, island, piece, seconds HAVING avg(CASE WHEN speed >= 3 THEN 1.0 ELSE 0.0 END) >= 0.5""")
def w9_silences(spark, sf_dir):
    """An hour or more off a line that had been reached, moving, without a reply (an error event stands for one)."""
    w = Window.partitionBy("drive").orderBy("ts", "fix")
    step = F.coalesce(F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2), F.lit(0.0))
    f = _against(spark, sf_dir).withColumn("step", step)
    replies = derive(spark, sf_dir, FIXES).where("kind = 'error'").select("drive", "ts")
    return driven.silences(f, replies, F.col("off") > OFF, H).select("drive", "island", F.round("seconds", 3).alias("seconds"), F.round("metres", 3).alias("metres"))


_STOP_AT = f"SELECT s.drive * 100000 + s.island AS pid, min(f.x) AS x, min(f.y) AS y FROM ({_STOPS}) s JOIN ({FIXES}) f ON f.drive = s.drive AND f.ts = s.begin_ WHERE s.seconds >= {3 * H} GROUP BY 1"


def _stop_places(spark, sf_dir):
    s = _stops(spark, sf_dir).select("drive", "island", F.col("begin").alias("ts"))
    at = s.join(derive(spark, sf_dir, FIXES).select("drive", "ts", "x", "y").hint("merge"), ["drive", "ts"])
    return at.groupBy((F.col("drive") * 100000 + F.col("island")).alias("pid")).agg(F.min("x").alias("x"), F.min("y").alias("y"))


@query(f"""
WITH s AS MATERIALIZED ({_STOP_AT}), t AS (SELECT DISTINCT pid FROM s JOIN ({PLACES}) p ON sqrt(pow(s.x - p.x, 2) + pow(s.y - p.y, 2)) <= 350),
c AS (SELECT pid, arg_min(w.kind, (sqrt(pow(s.x - w.x, 2) + pow(s.y - w.y, 2)), w.id)) AS kind FROM s JOIN ({WATER}) w ON sqrt(pow(s.x - w.x, 2) + pow(s.y - w.y, 2)) <= 450 GROUP BY pid)
SELECT s.pid, coalesce(CASE c.kind % 3 WHEN 0 THEN 'signal' WHEN 1 THEN 'stop' WHEN 2 THEN 'giveway' END, CASE WHEN t.pid IS NOT NULL THEN 'maneuver' END, 'unexplained') AS cause FROM s LEFT JOIN t USING (pid) LEFT JOIN c USING (pid)""")
def j24_stop_causes(spark, sf_dir):
    """A control within 450 m explains a stop, else a turn within 350 m, else nothing."""
    kinds = F.element_at(F.array(F.lit("signal"), F.lit("stop"), F.lit("giveway")), (F.col("kind") % 3 + 1).cast("int"))
    controls = derive(spark, sf_dir, WATER).select("id", "x", "y", kinds.alias("kind"))
    return driven.stop_causes(_stop_places(spark, sf_dir), derive(spark, sf_dir, PLACES), controls, 350.0, 450.0)


@query(f"""
WITH s AS MATERIALIZED ({_STOP_AT}), l AS MATERIALIZED ({_LINES}), c AS (SELECT DISTINCT id, w.x AS wx, w.y AS wy, drive FROM (SELECT w.*, l.*, {_off().replace('(x -', '(w.x -').replace('(y -', '(w.y -')} AS t FROM ({WATER}) w, l) w WHERE sqrt(pow(w.x - ax - t * (qx - ax), 2) + pow(w.y - ay - t * (qy - ay), 2)) <= 150)
SELECT pid, arg_min(id, (d, id)) AS control, round(min(d), 3) AS dist FROM (SELECT s.pid, c.id, sqrt(pow(s.x - wx, 2) + pow(s.y - wy, 2)) AS d FROM s JOIN c ON c.drive = CAST(floor(s.pid / 100000) AS BIGINT)) z WHERE d <= 2500 GROUP BY pid""")
def j25_control_on_line(spark, sf_dir):
    """The nearest control within 2.5 km of a stop, of those within 150 m of a line that its drive followed."""
    a = _against(spark, sf_dir).select("drive", "seq").distinct()
    k = F.col("drive") * 101 + F.col("seq") * 17
    at = lambda m, n: ((k * m) % n).cast("double")
    lines = a.select("drive", at(7919, 37250).alias("ax"), at(3571, 37750).alias("ay"), at(6007, 37250).alias("bx"), at(4421, 37750).alias("by"))
    s = _stop_places(spark, sf_dir).withColumn("drive", F.expr("pid div 100000"))
    best = driven.controls_on_lines(s, lines, derive(spark, sf_dir, WATER), 2500.0, 150.0)
    return best.select("pid", "control", F.round("dist", 3).alias("dist"))


#: Marks: purchases, each on the way of its user's number, at a place along it.
_MARKED = f"SELECT f.fix, f.drive, w.way_id, f.speed / 20 AS speed, w.total * (f.fix % 100) / 100 AS anchor FROM ({FIXES}) f JOIN (SELECT s.way_id, sum(len) AS total, min(custkey) AS custkey FROM ({SEGMENTS}) s JOIN ({WAYS}) w ON w.way_id = s.way_id GROUP BY s.way_id) w ON w.custkey = f.drive WHERE f.kind = 'purchase'"
_STRETCH = """
SELECT fix, way_id, lo + (k + 0.5) * (hi - lo) / n AS at FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, CAST(greatest(1, ceil((hi - lo) / 25)) AS BIGINT) AS n FROM (SELECT *, greatest(0.0, hi - {window}) AS lo FROM (SELECT *, greatest(0.0, anchor - speed * {reaction}) AS hi FROM ({marked}) m) a) b) c) d"""
_RUNNING = f"SELECT *, sum(len) OVER (PARTITION BY way_id ORDER BY n ROWS UNBOUNDED PRECEDING) - len AS pos FROM ({SEGMENTS}) s"


def _samples_sql(window: float, reaction: float) -> str:
    return f"""
SELECT c.fix, c.way_id, c.at, arg_min(s.x + t * (s.x2 - s.x), s.n) AS x, arg_min(s.y + t * (s.y2 - s.y), s.n) AS y FROM ({_STRETCH.format(window=window, reaction=reaction, marked=_MARKED)}) c JOIN ({_RUNNING}) s ON s.way_id = c.way_id AND s.pos + s.len >= c.at - 1e-9,
LATERAL (SELECT CASE WHEN s.len > 0 THEN greatest(0.0, least(1.0, (c.at - s.pos) / s.len)) ELSE 0.0 END AS t) z GROUP BY c.fix, c.way_id, c.at"""


_HITS = f"""
SELECT q.fix, q.way_id, q.at, arg_min(edge, (round(dist, 6), edge)) AS edge FROM (SELECT p.fix, p.way_id, p.at, s.way_id AS edge, sqrt(pow(p.x - s.x - t * (s.x2 - s.x), 2) + pow(p.y - s.y - t * (s.y2 - s.y), 2)) AS dist FROM (
  SELECT p.*, s.x AS sx FROM ({{samples}}) p, (SELECT 1 AS one) o, LATERAL (SELECT 0 AS x) s) p JOIN ({SEGMENTS}) s ON least(s.x, s.x2) - 30 <= p.x AND greatest(s.x, s.x2) + 30 >= p.x AND least(s.y, s.y2) - 30 <= p.y AND greatest(s.y, s.y2) + 30 >= p.y,
  LATERAL (SELECT CASE WHEN s.len > 0 THEN greatest(0.0, least(1.0, ((p.x - s.x) * (s.x2 - s.x) + (p.y - s.y) * (s.y2 - s.y)) / (s.len * s.len))) ELSE 0.0 END AS t) z) q WHERE dist <= 30 GROUP BY q.fix, q.way_id, q.at""".replace(", s.x AS sx FROM ({samples}) p, (SELECT 1 AS one) o, LATERAL (SELECT 0 AS x) s) p", " FROM ({samples}) p) p")


def _marked(spark, sf_dir):
    w = derive(spark, sf_dir, SEGMENTS).groupBy("way_id").agg(F.sum("len").alias("total")).join(derive(spark, sf_dir, WAYS).select("way_id", F.col("custkey").alias("drive")).hint("merge"), "way_id")
    f = derive(spark, sf_dir, FIXES).where("kind = 'purchase'").select("fix", "drive", (F.col("speed") / 20).alias("speed"))
    return f.join(w.hint("merge"), "drive").withColumn("anchor", F.col("total") * (F.col("fix") % 100) / 100)


def _sampled_edges(spark, sf_dir, tries):
    """fix, way_id, back_m, reaction_s, edge, samples: how many samples of each marked stretch have the edge as their nearest within 30 m.

    tries: lengths of stretches and reaction times. Marks meet the lines of their ways before they are sampled.
    """
    from viamark.plans.derived import roads

    lines = roads(spark, sf_dir).select("way_id", g.located("geom").alias("parts"))
    each = F.array(*[F.struct(F.lit(w).alias("back_m"), F.lit(r).alias("reaction_s")) for w, r in tries])
    s = _marked(spark, sf_dir).join(lines.hint("merge"), "way_id").select("*", F.inline(each))
    s = driven.marked_stretches(s, F.col("back_m"), F.col("reaction_s"))
    by = ["way_id", "fix", "back_m", "reaction_s"]
    s = s.withColumn("p", g.point_on("parts", F.col("at") - 1e-9)).select(*by, "at", "p.x", "p.y")
    cells, size = spatial.nearest_cells(spatial.exploded(roads(spark, sf_dir).withColumnRenamed("way_id", "edge"), "edge"), "edge", 30.0)
    return spatial.nearest_in(s, cells, size, [*by, "at"], "edge", 30.0, 6).groupBy(*by, "edge").agg(F.count("at").alias("samples"))


@query(f"""
WITH h AS MATERIALIZED ({_HITS.format(samples=_samples_sql(400.0, 1.5))}), j AS (SELECT h.*, CAST((h.edge * 37) % 101 AS DOUBLE) / 10 AS score, w.highway, w.name FROM h JOIN ({WAYS}) w ON w.way_id = h.edge),
c AS (SELECT fix, way_id, arg_min(highway, (-n, highway)) AS highway FROM (SELECT fix, way_id, highway, count(*) AS n FROM j GROUP BY ALL) z GROUP BY 1, 2), m AS (SELECT fix, way_id, arg_min(name, (-n, name)) AS name FROM (SELECT fix, way_id, name, count(*) AS n FROM j GROUP BY ALL) z GROUP BY 1, 2)
SELECT j.fix, j.way_id, count(*) AS samples, round(avg(score), 6) AS score, any_value(c.highway) AS highway, any_value(m.name) AS name FROM j JOIN c USING (fix, way_id) JOIN m USING (fix, way_id) GROUP BY j.fix, j.way_id""")
def j26_marked_stretches(spark, sf_dir):
    """The 400 m behind each mark, less the reaction: mean score, commonest class and name of the nearest edges."""
    h = _sampled_edges(spark, sf_dir, [(400.0, 1.5)]).join(derive(spark, sf_dir, WAYS).select(F.col("way_id").alias("edge"), "highway", "name").hint("merge"), "edge")
    n, score = F.col("samples"), ((F.col("edge") * 37) % 101).cast("double") / 10
    h = stage(h.select(F.struct("fix", "way_id").alias("mark"), "samples", score.alias("score"), "highway", "name"), "marked")
    out = h.groupBy("mark").agg(F.sum(n).alias("samples"), F.round(F.sum(n * F.col("score")) / F.sum(n), 6).alias("score"))
    out = out.join(driven.mode_of(h, "mark", "highway", n).hint("merge"), "mark").join(driven.mode_of(h, "mark", "name", n).hint("merge"), "mark")
    return out.select("mark.fix", "mark.way_id", "samples", "score", "highway", "name")


_TRIES = ((200.0, 1.0), (400.0, 1.5), (800.0, 2.5))


_SPAN = "range(CAST(floor((least({a}, {b}) - 30) / 300) AS BIGINT), CAST(floor((greatest({a}, {b}) + 30) / 300) AS BIGINT) + 1)"


@query(f"""
WITH sg AS MATERIALIZED (SELECT way_id, x, y, x2, y2, len, cx, unnest({_SPAN.format(a='y', b='y2')}) AS cy FROM (SELECT *, unnest({_SPAN.format(a='x', b='x2')}) AS cx FROM ({SEGMENTS}) s) q),
sm AS MATERIALIZED ({" UNION ALL ".join(f"SELECT *, {w}::DOUBLE AS back_m, {r}::DOUBLE AS reaction_s FROM ({_samples_sql(w, r)}) q" for w, r in _TRIES)}),
d AS (SELECT p.fix, p.way_id, p.at AS spot, back_m, reaction_s, s.way_id AS edge, sqrt(pow(p.x - s.x - t * (s.x2 - s.x), 2) + pow(p.y - s.y - t * (s.y2 - s.y), 2)) AS dist FROM sm p JOIN sg s ON s.cx = CAST(floor(p.x / 300) AS BIGINT) AND s.cy = CAST(floor(p.y / 300) AS BIGINT),
  LATERAL (SELECT CASE WHEN s.len > 0 THEN greatest(0.0, least(1.0, ((p.x - s.x) * (s.x2 - s.x) + (p.y - s.y) * (s.y2 - s.y)) / (s.len * s.len))) ELSE 0.0 END AS t) z),
h AS (SELECT fix, way_id, spot, back_m, reaction_s, arg_min(edge, (round(dist, 6), edge)) AS edge FROM d WHERE dist <= 30 GROUP BY ALL)
SELECT fix, way_id, back_m, reaction_s, count(DISTINCT edge) AS edges, count(*) AS samples FROM h GROUP BY ALL""")
def v14_mark_windows(spark, sf_dir):
    """The edges under each mark for several windows and reaction times."""
    h = _sampled_edges(spark, sf_dir, _TRIES)
    return h.groupBy("fix", "way_id", "back_m", "reaction_s").agg(F.count("edge").alias("edges"), F.sum("samples").alias("samples"))


_BACK = f"SELECT way_id AS route, pos AS start, x AS ax, y AS ay, x2 AS qx, y2 AS qy, px + 150 AS px, py, CAST((way_id * 37) % 360 AS DOUBLE) AS heading FROM (SELECT *, first_value(x) OVER (PARTITION BY way_id ORDER BY n) AS px, first_value(y) OVER (PARTITION BY way_id ORDER BY n) AS py FROM ({_RUNNING.replace('ROWS UNBOUNDED PRECEDING', 'ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}) r) q WHERE len > 0"


@query(f"""
WITH d AS (SELECT *, (ax - px) * sin(radians(heading)) + (ay - py) * cos(radians(heading)) AS f0, (qx - px) * sin(radians(heading)) + (qy - py) * cos(radians(heading)) AS f1, (ax - px) * cos(radians(heading)) - (ay - py) * sin(radians(heading)) AS s0, (qx - px) * cos(radians(heading)) - (qy - py) * sin(radians(heading)) AS s1 FROM ({_BACK}) b),
e AS (SELECT *, greatest(0.0, CASE WHEN f1 = f0 THEN CASE WHEN f0 BETWEEN -1000 AND 0 THEN 0.0 ELSE 2.0 END ELSE least((-1000 - f0) / (f1 - f0), (0 - f0) / (f1 - f0)) END, CASE WHEN s1 = s0 THEN CASE WHEN s0 BETWEEN -200 AND 200 THEN 0.0 ELSE 2.0 END ELSE least((-200 - s0) / (s1 - s0), (200 - s0) / (s1 - s0)) END) AS t0,
  least(1.0, CASE WHEN f1 = f0 THEN CASE WHEN f0 BETWEEN -1000 AND 0 THEN 1.0 ELSE -1.0 END ELSE greatest((-1000 - f0) / (f1 - f0), (0 - f0) / (f1 - f0)) END, CASE WHEN s1 = s0 THEN CASE WHEN s0 BETWEEN -200 AND 200 THEN 1.0 ELSE -1.0 END ELSE greatest((-200 - s0) / (s1 - s0), (200 - s0) / (s1 - s0)) END) AS t1 FROM d)
SELECT route, round(min(start + t0 * sqrt(pow(qx - ax, 2) + pow(qy - ay, 2))), 4) AS at_m FROM e WHERE t0 <= t1 AND abs((((degrees(atan2(qx - ax, qy - ay)) + 360) % 360) - heading + 540) % 360 - 180) >= 120 GROUP BY route""")
def d16_turned_back(spark, sf_dir):
    """How far along a route first runs back through the strip (400 m wide here) behind the driver."""
    return driven.turned_back(derive(spark, sf_dir, _BACK).withColumnsRenamed({"qx": "bx", "qy": "by"}), strip=400.0).select("route", F.round("at_m", 4).alias("at_m"))


@query(f"""
SELECT kind, CASE WHEN grade < -2 THEN 'down' WHEN grade > 2 THEN 'up' ELSE 'flat' END AS band, round(sum(dist) / sum(dt), 8) AS measured, round(sum(dist) / sum(dist / (speed + 1)), 6) AS assumed, round(sum(dist / (speed + 1)) / sum(dt), 8) AS factor
FROM (SELECT *, CAST((fix * 31) % 13 AS DOUBLE) - 6 AS grade FROM ({_STEPS}) s WHERE reason IS NULL) q GROUP BY 1, 2""")
def a19_grade_bands(spark, sf_dir):
    """Speed factors by kind and band of grade."""
    grade = ((F.col("fix") * 31) % 13).cast("double") - 6
    s = _steps(spark, sf_dir).where("reason is null").withColumns({"v": F.col("speed") + 1, "band": F.when(grade < -2, "down").when(grade > 2, "up").otherwise("flat")})
    s = s.withColumn("cell", F.struct("kind", "band"))
    return traces.speed_factors(s, "cell", "v").select("cell.kind", "cell.band", F.round("measured", 8).alias("measured"), F.round("assumed", 6).alias("assumed"), F.round("factor", 8).alias("factor"))
