"""Queries: drives and statistics. Fixes are events, hours apart, so thresholds are in hours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from viamark.operators import spatial, stats, traces
from viamark.plans.catalog import query
from viamark.plans.derived import FIXES, derive

H = 3600.0
_STEPS = f"""
SELECT *, CASE WHEN dt <= 0 THEN 'no time' WHEN dt > {24 * H} THEN 'gap' WHEN dist > 2.0 * dt THEN 'jump' END AS reason
FROM (SELECT drive, fix, ts, kind, speed, (epoch_us(ts2) - epoch_us(ts)) / 1e6 AS dt, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS dist
  FROM (SELECT *, lead(ts) OVER w AS ts2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM ({FIXES}) f WINDOW w AS (PARTITION BY drive ORDER BY ts, fix)) g WHERE ts2 IS NOT NULL) h"""
_SPEED = f"""
SELECT *, max(CASE WHEN v < 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY drive ORDER BY ts, fix ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS stopped
FROM (SELECT *, sum(dist) OVER w / sum(dt) OVER w AS v FROM ({_STEPS}) s WHERE reason IS NULL WINDOW w AS (PARTITION BY drive ORDER BY ts, fix ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) t"""
_STOPS = f"""
SELECT drive, island, min(ts) AS begin_, sum(dt) AS seconds, count(*) AS steps FROM (
  SELECT *, sum(CASE WHEN stopped AND (NOT coalesce(was, false) OR since > {H}) THEN 1 ELSE 0 END) OVER (PARTITION BY drive ORDER BY ts, fix ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, lag(stopped) OVER w AS was, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 - lag(dt) OVER w AS since FROM ({_SPEED}) a WINDOW w AS (PARTITION BY drive ORDER BY ts, fix)) b) c
WHERE stopped GROUP BY drive, island"""
_MARKS = "SELECT l.doc_id AS id, l.quality AS nice, l.toxic, d.n_chars AS score, d.lang AS stratum, d.source AS road FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def _fixes(spark, sf_dir):
    return derive(spark, sf_dir, FIXES)


def _steps(spark, sf_dir):
    return traces.steps(_fixes(spark, sf_dir), 24 * H, 2.0)


def _kept(spark, sf_dir):
    return traces.window_speed(_steps(spark, sf_dir).where("reason is null"), 2, 0.5)


def _stops(spark, sf_dir):
    return traces.stops(_kept(spark, sf_dir), H, 3 * H, 24 * H)


def _marks(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("quality", "nice")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("n_chars").alias("score"), F.col("lang").alias("stratum"), F.col("source").alias("road"))
    return labels.join(docs.hint("merge"), "doc_id").withColumnRenamed("doc_id", "id")


@query(f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS steps, round(sum(dist) / 1000, 3) AS km FROM ({_STEPS}) s GROUP BY 1")
def w1_steps(spark, sf_dir):
    """Steps between fixes, and a count for every reason to drop one."""
    s = _steps(spark, sf_dir)
    return s.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("steps"), F.round(F.sum("dist") / 1000, 3).alias("km"))


@query(f"SELECT drive, fix, round(v, 6) AS v, stopped FROM ({_SPEED}) s")
def w2_window_speed(spark, sf_dir):
    return _kept(spark, sf_dir).select("drive", "fix", F.round("v", 6).alias("v"), "stopped")


_ALONG = f"""
SELECT drive, fix, ts, CAST((fix * 7919) % 900 AS DOUBLE) AS alt, coalesce(sum(d) OVER (PARTITION BY drive ORDER BY ts, fix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS along
FROM (SELECT *, CAST(floor(speed * 100) + 1 AS DOUBLE) AS d FROM ({FIXES}) f) g"""


@query(f"""
WITH s AS (SELECT *, median(alt) OVER (PARTITION BY drive ORDER BY ts, fix ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS smooth FROM ({_ALONG}) a)
SELECT a.drive, a.fix, round(a.smooth, 3) AS smooth, round((arg_min(b.smooth, b.along) - a.smooth) / (min(b.along) - a.along), 8) AS grade
FROM s a LEFT JOIN s b ON a.drive = b.drive AND b.along >= a.along + 20000 GROUP BY a.drive, a.fix, a.smooth, a.along""")
def w3_grade(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("drive").orderBy("ts", "fix").rowsBetween(Window.unboundedPreceding, -1)
    f = _fixes(spark, sf_dir).withColumn("d", (F.floor(F.col("speed") * 100) + 1).cast("double"))
    f = f.withColumns({"along": F.coalesce(F.sum("d").over(w), F.lit(0.0)), "alt": ((F.col("fix") * 7919) % 900).cast("double")})
    return traces.grade(f, 20000.0).select("drive", "fix", F.round("smooth", 3).alias("smooth"), F.round("grade", 8).alias("grade"))


@query(f"SELECT drive, island, begin_ AS begin, round(seconds, 3) AS seconds, steps, seconds >= {24 * H} AS parked FROM ({_STOPS}) s WHERE seconds >= {3 * H}")
def w4_stops(spark, sf_dir):
    return _stops(spark, sf_dir).withColumn("seconds", F.round("seconds", 3))


@query(f"""
WITH f AS (SELECT *, speed > 60 AS off FROM ({FIXES}) f),
g AS (SELECT *, lag(off) OVER w AS was, lead(off) OVER w AS nxt, max(CASE WHEN NOT off THEN 1 ELSE 0 END) OVER (PARTITION BY drive ORDER BY ts, fix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ever FROM f WINDOW w AS (PARTITION BY drive ORDER BY ts, fix)),
h AS (SELECT *, sum(CASE WHEN off AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY drive ORDER BY ts, fix ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT drive, island, min(ts) AS begin, count(*) AS fixes, max(speed) AS farthest, CASE WHEN max(CASE WHEN nxt IS NULL THEN 1 ELSE 0 END) = 1 THEN 'drive end' ELSE 'rejoined' END AS ended,
  min_by(coalesce(ever, 0), (ts, fix)) = 1 AS departed FROM h WHERE off GROUP BY drive, island""")
def w6_excursions(spark, sf_dir):
    """Runs more than 60 off the line, with how they began and ended."""
    f = _fixes(spark, sf_dir).withColumn("off", F.col("speed"))
    return traces.excursions(f, F.col("off") > 60).select("drive", "island", "begin", "fixes", "farthest", "ended", "departed")


@query(f"""
WITH f AS (SELECT *, kind = 'view' AS flag FROM ({FIXES}) f), g AS (SELECT *, lag(flag) OVER (PARTITION BY drive ORDER BY ts, fix) AS was FROM f),
h AS (SELECT *, sum(CASE WHEN flag AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY drive ORDER BY ts, fix ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT length, count(*) AS runs FROM (SELECT drive, island, count(*) AS length FROM h WHERE flag GROUP BY 1, 2) GROUP BY length""")
def w10_run_lengths(spark, sf_dir):
    runs = traces.islands(_fixes(spark, sf_dir), F.col("kind") == "view").groupBy("drive", "island").agg(F.count(F.lit(1)).alias("length"))
    return runs.groupBy("length").agg(F.count(F.lit(1)).alias("runs"))


@query(f"""
SELECT kind, round(sum(dist) / sum(dt), 8) AS measured, round(sum(dist) / sum(dist / (speed + 1)), 6) AS assumed, round(sum(dist / (speed + 1)) / sum(dt), 8) AS factor
FROM ({_STEPS}) s WHERE reason IS NULL GROUP BY kind""")
def a19_speed_factors(spark, sf_dir):
    s = _steps(spark, sf_dir).where("reason is null").withColumn("v", F.col("speed") + 1)
    return traces.speed_factors(s, "kind", "v").select("kind", F.round("measured", 8).alias("measured"), F.round("assumed", 6).alias("assumed"), F.round("factor", 8).alias("factor"))


@query(f"""
SELECT drive, round(sum(dt) / 3600, 4) AS hours, round(sum(dist) / 1000, 3) AS km, round(sum(CASE WHEN stopped THEN 0 ELSE dt END) / 3600, 4) AS moving, sum(CASE WHEN stopped THEN 1 ELSE 0 END) AS stopped FROM ({_SPEED}) s GROUP BY drive""")
def a20_drive_headline(spark, sf_dir):
    k = _kept(spark, sf_dir)
    return k.groupBy("drive").agg(
        F.round(F.sum("dt") / 3600, 4).alias("hours"), F.round(F.sum("dist") / 1000, 3).alias("km"),
        F.round(F.sum(F.when(F.col("stopped"), 0.0).otherwise(F.col("dt"))) / 3600, 4).alias("moving"), F.sum(F.when(F.col("stopped"), 1).otherwise(0)).alias("stopped"),
    )


@query(f"""
SELECT cause, stops, round(seconds, 3) AS seconds, round(seconds / sum(seconds) OVER (), 8) AS share FROM (
SELECT f.kind AS cause, count(*) AS stops, sum(s.seconds) AS seconds FROM ({_STOPS}) s JOIN ({FIXES}) f ON f.drive = s.drive AND f.ts = s.begin_ WHERE s.seconds >= {3 * H} AND s.seconds < {24 * H} GROUP BY f.kind) c""")
def a21_stop_causes(spark, sf_dir):
    """Stops by the control at which they begin, parked ones held out, with their share."""
    from pyspark.sql import Window

    s = _stops(spark, sf_dir).where("not parked").select("drive", F.col("begin").alias("ts"), "seconds")
    out = s.join(_fixes(spark, sf_dir).select("drive", "ts", F.col("kind").alias("cause")).hint("merge"), ["drive", "ts"]).groupBy("cause").agg(F.count(F.lit(1)).alias("stops"), F.sum("seconds").alias("seconds"))
    every = Window.partitionBy(F.lit(0))  # as many rows as causes
    return out.select("cause", "stops", F.round("seconds", 3).alias("seconds"), F.round(F.col("seconds") / F.sum("seconds").over(every), 8).alias("share"))


@query(f"""
WITH p AS (SELECT drive, kind, count(*) AS met, sum(floor(speed)) AS lost FROM ({FIXES}) f GROUP BY 1, 2)
SELECT drive, kind, round((sum(lost) OVER w - lost) / (sum(met) OVER w - met), 8) AS fitted, round(lost / met, 8) AS actual FROM p WINDOW w AS (PARTITION BY kind)""")
def a22_leave_one_out(spark, sf_dir):
    p = _fixes(spark, sf_dir).groupBy("drive", "kind").agg(F.count(F.lit(1)).alias("met"), F.sum(F.floor("speed")).alias("lost"))
    return traces.leave_one_out(p, "met", "lost").select("drive", "kind", F.round("fitted", 8).alias("fitted"), F.round("actual", 8).alias("actual"))


@query(f"""
SELECT s.drive, s.island, count(*) AS inside, max(f.speed) AS fastest FROM ({_STOPS}) s JOIN ({FIXES}) f ON f.drive = s.drive AND epoch_us(f.ts) / 1e6 BETWEEN epoch_us(s.begin_) / 1e6 AND epoch_us(s.begin_) / 1e6 + s.seconds
WHERE s.seconds >= {3 * H} GROUP BY 1, 2""")
def j27_interval_join(spark, sf_dir):
    """Fixes inside the span of a stop, by buckets of six hours."""
    spans = _stops(spark, sf_dir).select("drive", "island", (traces.micros("begin") / 1e6).alias("a"), (traces.micros("begin") / 1e6 + F.col("seconds")).alias("b"))
    at = _fixes(spark, sf_dir).select("drive", "speed", (traces.micros("ts") / 1e6).alias("t"))
    return spatial.interval_join(at, spans, ["drive"], "t", "a", "b", 6 * H).groupBy("drive", "island").agg(F.count(F.lit(1)).alias("inside"), F.max("speed").alias("fastest"))


#: Spans between two fixes of a drive that lie hours apart, and spans after a kind of fix until the next fix but one.
_HOLES = f"SELECT drive, fix, a, b FROM (SELECT drive, fix, epoch_us(ts) / 1e6 AS a, lead(epoch_us(ts)) OVER (PARTITION BY drive ORDER BY ts, fix) / 1e6 AS b FROM ({FIXES}) f) g WHERE b - a > {12 * H}"
_PHASES = f"SELECT drive, fix AS phase, c, d FROM (SELECT drive, fix, kind, epoch_us(ts) / 1e6 + 3600 AS c, lead(epoch_us(ts), 2) OVER (PARTITION BY drive ORDER BY ts, fix) / 1e6 - 3600 AS d FROM ({FIXES}) f) g WHERE kind IN ('error', 'click') AND d >= c"


@query(f"""
SELECT h.drive, h.fix, count(p.phase) AS phases, round(coalesce(sum(CASE WHEN phase IS NOT NULL THEN greatest(0, least(b, d) - greatest(a, c)) END), 0), 3)::DOUBLE AS seconds FROM ({_HOLES}) h LEFT JOIN ({_PHASES}) p ON p.drive = h.drive AND a - 5 <= d AND c <= b + 5 GROUP BY 1, 2""")
def j30_background_gaps(spark, sf_dir):
    """Gaps between fixes and the background phases that overlap them, with 5 s of slack; each pair once."""
    w = Window.partitionBy("drive").orderBy("ts", "fix")
    f = _fixes(spark, sf_dir).withColumn("at", traces.micros("ts") / 1e6)
    holes = f.select("drive", "fix", F.col("at").alias("a"), F.lead("at").over(w).alias("b")).where(F.col("b") - F.col("a") > 12 * H)
    phases = f.select("drive", F.col("fix").alias("phase"), "kind", (F.col("at") + H).alias("c"), (F.lead("at", 2).over(w) - H).alias("d")).where("kind in ('error', 'click') and d >= c").drop("kind")
    met = spatial.overlap_join(holes, phases, ["drive"], ("a", "b"), ("c", "d"), 5.0, 24 * H)
    shared = F.greatest(F.lit(0.0), F.least("b", "d") - F.greatest("a", "c"))
    found = met.groupBy("drive", "fix").agg(F.count(F.lit(1)).alias("phases"), F.sum(shared).alias("seconds"))
    out = holes.select("drive", "fix").join(found.hint("merge"), ["drive", "fix"], "left")
    return out.select("drive", "fix", F.coalesce("phases", F.lit(0)).alias("phases"), F.round(F.coalesce("seconds", F.lit(0.0)), 3).alias("seconds"))


@query(f"""
SELECT a.fix, count(*) AS near, arg_min(b.fix, (abs(epoch_us(a.ts) - epoch_us(b.ts)), b.fix)) AS closest FROM ({FIXES}) a JOIN ({FIXES}) b ON a.drive = b.drive AND a.kind = 'purchase' AND b.kind = 'view' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 7200000000 GROUP BY a.fix""")
def j28_time_near(spark, sf_dir):
    """Views within two hours of a purchase of the same drive, and the closest."""
    f = _fixes(spark, sf_dir).withColumn("t", traces.micros("ts"))
    a = f.where("kind = 'purchase'").select("drive", "fix", "t")
    b = f.where("kind = 'view'").select("drive", F.col("fix").alias("view"), F.col("t").alias("u"))
    m = spatial.time_near(a, b, ["drive"], "t", "u", 7.2e9)
    return m.groupBy("fix").agg(F.count(F.lit(1)).alias("near"), F.min(F.struct(F.abs(F.col("t") - F.col("u")).alias("d"), "view")).alias("m")).select("fix", "near", F.col("m.view").alias("closest"))


@query(f"""
SELECT a.fix, a.drive, b.fix AS last_view FROM (SELECT * FROM ({FIXES}) f WHERE kind = 'purchase') a ASOF LEFT JOIN (SELECT * FROM ({FIXES}) f WHERE kind = 'view') b ON a.drive = b.drive AND a.ts >= b.ts""")
def j29_as_of(spark, sf_dir):
    f = _fixes(spark, sf_dir)
    a = f.where("kind = 'purchase'").select("fix", "drive", "ts")
    b = f.where("kind = 'view'").select("drive", F.col("ts").alias("u"), F.col("fix").alias("last_view"))
    return spatial.as_of(a, b, ["drive"], "ts", "u", "last_view").drop("ts")


@query(f"""
WITH m AS ({_MARKS}), v AS (SELECT stratum, score, sum(1 + id % 5) AS w FROM m GROUP BY 1, 2),
r AS (SELECT *, (sum(w) OVER (PARTITION BY stratum ORDER BY score ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY stratum) AS p FROM v),
s AS (SELECT *, lead(p) OVER o AS p2, lead(score) OVER o AS v2, row_number() OVER o = 1 AS f FROM r WINDOW o AS (PARTITION BY stratum ORDER BY score))
SELECT stratum, """ + ", ".join(f"round(max(CASE WHEN p <= {q} AND p2 > {q} THEN score + (v2 - score) * ({q} - p) / (p2 - p) WHEN (f AND p > {q}) OR (p2 IS NULL AND p <= {q}) THEN score END), 6) AS q{round(q * 100)}" for q in (0.1, 0.5, 0.9)) + " FROM s GROUP BY stratum")
def a8_weighted_quantiles(spark, sf_dir):
    m = _marks(spark, sf_dir).withColumn("w", (1 + F.col("id") % 5).cast("double"))
    out = stats.weighted_quantiles(m, ["stratum"], "score", "w", (0.1, 0.5, 0.9))
    return out.select("stratum", *[F.round(c, 6).alias(c) for c in ("q10", "q50", "q90")])


_AUC = f"""
WITH m AS ({_MARKS}), g AS (SELECT stratum, score, CAST(sum(CASE WHEN nice = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS p, CAST(sum(CASE WHEN nice = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n FROM m GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY stratum ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g),
s AS (SELECT stratum, sum(p * (b + n / 2)) AS won, sum(p) AS n1, sum(n) AS n0 FROM r GROUP BY stratum)"""


@query(_AUC + " SELECT stratum, n1, n0, round(won / (n1 * n0), 8) AS auc, round(0.5 + 1.645 * sqrt((n1 + n0 + 1) / (12 * n1 * n0)), 8) AS ceiling FROM s")
def a9_auc(spark, sf_dir):
    """AUC of a score for good marks in each stratum, and what chance stays below."""
    out = stats.auc(_marks(spark, sf_dir), ["stratum"], "score", "nice")
    return out.select("stratum", "n1", "n0", F.round("auc", 8).alias("auc"), F.round(stats.null_ceiling(F.col("n1"), F.col("n0")), 8).alias("ceiling"))


@query(_AUC + " SELECT round(sum(won) / sum(n1 * n0), 8) AS auc, sum(n1 * n0) AS pairs FROM s")
def a9_pooled_auc(spark, sf_dir):
    out = stats.pooled(stats.auc(_marks(spark, sf_dir), ["stratum"], "score", "nice"))
    return out.select(F.round("auc", 8).alias("auc"), "pairs")


@query(f"""
WITH m AS ({_MARKS}) SELECT stratum, count(*) AS marks, round(sum(CASE WHEN score >= 1500 AND nice = 1 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN score >= 1500 THEN 1 ELSE 0 END), 0), 8) AS precision_high,
  round(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) / count(*), 8) AS toxic_share FROM m GROUP BY stratum""")
def a11_mark_report(spark, sf_dir):
    m = _marks(spark, sf_dir)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    high = F.col("score") >= 1500
    return m.groupBy("stratum").agg(F.count(F.lit(1)).alias("marks"), F.round(n(high & (F.col("nice") == 1)) / F.nullif(n(high), F.lit(0)), 8).alias("precision_high"), F.round(n(F.col("toxic") == 1) / F.count(F.lit(1)), 8).alias("toxic_share"))


@query(f"""
WITH c AS (SELECT drive, sum(floor(speed)) AS s, sum(CASE WHEN kind = 'view' THEN floor(speed) ELSE 1 END) AS o, count(*) AS n FROM ({FIXES}) f GROUP BY drive), d AS (SELECT r, s, o, n, (((drive * 7919 + r * 104729 + 1) % 1000003) * 48271 % 2147483647) / 2147483647.0 AS u FROM c, range(0, 200) a(r)),
w AS (SELECT r, s, o, n, {' + '.join(f"CASE WHEN u >= {p!r}::DOUBLE THEN 1 ELSE 0 END" for p in stats.POISSON)} AS w FROM d), b AS (SELECT r, sum(s * w) / sum(n * w) AS mean, (sum(s * w) - sum(o * w)) / sum(n * w) AS diff FROM w GROUP BY r HAVING sum(n * w) > 0)
SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.5), 6) AS mid, round(quantile_cont(mean, 0.975), 6) AS high, round(quantile_cont(diff, 0.025), 6) AS diff_low, round(quantile_cont(diff, 0.975), 6) AS diff_high FROM b""")
def a12_bootstrap(spark, sf_dir):
    """Intervals of a mean and of a paired difference by drawing whole drives."""
    f = _fixes(spark, sf_dir).withColumns({"v": F.floor("speed"), "o": F.when(F.col("kind") == "view", F.floor("speed")).otherwise(1)})
    b = stats.bootstrap_means(f, "drive", "v", "o", 200)
    p = b.agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("p"), F.percentile("difference", F.array(F.lit(0.025), F.lit(0.975))).alias("d"))  # 200 rows
    r = lambda c, i, n: F.round(F.col(c)[i], 6).alias(n)
    return p.select(r("p", 0, "low"), r("p", 1, "mid"), r("p", 2, "high"), r("d", 0, "diff_low"), r("d", 1, "diff_high"))


_Z = "greatest(0, abs(w - l) - 1) / sqrt(w + l)"
_X = f"({_Z} / sqrt(2.0::DOUBLE))"
_T = f"(1 / (1 + 0.3275911::DOUBLE * {_X}))"


@query(f"""
WITH m AS (SELECT stratum, CAST(sum(nice) AS DOUBLE) AS w, CAST(sum(1 - nice) AS DOUBLE) AS l, CAST(count(*) AS DOUBLE) AS n FROM ({_MARKS}) q GROUP BY stratum)
SELECT stratum, round((w / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(w / n * (1 - w / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 8) AS low,
  round((w / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(w / n * (1 - w / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 8) AS high,
  round({_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429)))) * exp(-{_X} * {_X}), 8) AS p FROM m""")
def a13_wilson_and_sign_test(spark, sf_dir):
    m = _marks(spark, sf_dir).groupBy("stratum").agg(F.sum("nice").cast("double").alias("w"), F.sum(1 - F.col("nice")).cast("double").alias("l"), F.count(F.lit(1)).cast("double").alias("n"))
    low, high = stats.wilson(F.col("w"), F.col("n"))
    return m.select("stratum", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"), F.round(stats.sign_test(F.col("w"), F.col("l")), 8).alias("p"))


@query(f"SELECT stratum, count(score) AS n, min(score) AS low, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3, max(score) AS high, round(avg(score), 6) AS mean FROM ({_MARKS}) m GROUP BY stratum")
def a14_five_numbers(spark, sf_dir):
    return stats.five_numbers(_marks(spark, sf_dir), ["stratum"], "score").withColumn("mean", F.round("mean", 6))


_GRID = "[" + ", ".join(f"{i / 20}" for i in range(21)) + "]"


@query(f"""
WITH m AS (SELECT id, stratum, CAST(score AS DOUBLE) AS score FROM ({_MARKS}) q), own AS (SELECT stratum, quantile_cont(score, {_GRID}) AS o FROM m GROUP BY stratum), every AS (SELECT quantile_cont(score, {_GRID}) AS e FROM m),
j AS (SELECT m.*, o, e, greatest(1, least(20, len(list_filter(o, lambda q: q <= m.score)))) AS i FROM m JOIN own USING (stratum), every)
SELECT id, stratum, score, round(e[i] + CASE WHEN o[i + 1] > o[i] THEN (score - o[i]) / (o[i + 1] - o[i]) ELSE 0 END * (e[i + 1] - e[i]), 6) AS mapped FROM j""")
def a34_quantile_map(spark, sf_dir):
    m = _marks(spark, sf_dir).withColumn("score", F.col("score").cast("double"))
    return stats.quantile_map(m, "score", "id", "stratum").withColumn("mapped", F.round("mapped", 6))


_LEAST, _FULL = 160.0, 4000.0


def _grid_sql(name: str, rows: str) -> str:
    """Weighted quantiles at 0, 1/200, ... 1 of each group of ``rows`` (stratum, v, w)."""
    return f"""
{name}_r AS (SELECT *, lead(p) OVER o AS p2, lead(v) OVER o AS v2, row_number() OVER o = 1 AS f FROM (SELECT stratum, v, (sum(w) OVER (PARTITION BY stratum ORDER BY v ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY stratum) AS p FROM (SELECT stratum, v, sum(w) AS w FROM {rows} GROUP BY 1, 2) z) y WINDOW o AS (PARTITION BY stratum ORDER BY v)),
{name} AS MATERIALIZED (SELECT stratum, i, max(CASE WHEN p <= i / 200.0::DOUBLE AND p2 > i / 200.0::DOUBLE THEN v + (v2 - v) * (i / 200.0::DOUBLE - p) / (p2 - p) WHEN (f AND p > i / 200.0::DOUBLE) OR (p2 IS NULL AND p <= i / 200.0::DOUBLE) THEN v END) AS q FROM {name}_r, range(0, 201) g(i) GROUP BY 1, 2)"""


@query(f"""
WITH m AS MATERIALIZED (SELECT id, stratum, CAST(score AS DOUBLE) AS score, CAST(1 + id % 5 AS DOUBLE) AS w FROM ({_MARKS}) q), sh AS (SELECT 1 - sum(CASE WHEN score >= {_FULL} THEN w ELSE 0 END) / sum(w) AS q FROM m WHERE stratum = 'en'),
r AS (SELECT *, lead(p) OVER o AS p2, lead(score) OVER o AS v2, row_number() OVER o = 1 AS f FROM (SELECT stratum, score, (sum(w) OVER (PARTITION BY stratum ORDER BY score ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY stratum) AS p FROM (SELECT stratum, score, sum(w) AS w FROM m GROUP BY 1, 2) z) y WINDOW o AS (PARTITION BY stratum ORDER BY score)),
cap AS (SELECT stratum, CASE WHEN stratum = 'en' THEN {_FULL} ELSE max(CASE WHEN p <= sh.q AND p2 > sh.q THEN score + (v2 - score) * (sh.q - p) / (p2 - p) WHEN (f AND p > sh.q) OR (p2 IS NULL AND p <= sh.q) THEN score END) END AS cap FROM r, sh GROUP BY stratum),
c AS MATERIALIZED (SELECT m.*, cap, round(least(1.0, score / cap), 9) AS v FROM m JOIN cap USING (stratum)), {_grid_sql('o', 'c')},
z AS MATERIALIZED (SELECT o.stratum, o.q AS own, min(e.i) AS i, arg_min(e.q, e.i) AS ref FROM o JOIN o e ON e.stratum = 'en' AND e.i = o.i GROUP BY 1, 2), n AS (SELECT *, lead(own) OVER p AS own2, lead(ref) OVER p AS ref2, row_number() OVER p = 1 AS f FROM z WINDOW p AS (PARTITION BY stratum ORDER BY own)),
s AS (SELECT stratum, sum(w) AS size FROM c GROUP BY 1)
SELECT c.id, c.stratum, round(cap, 6) AS cap, round(CASE WHEN size < {_LEAST} THEN v WHEN v < own THEN ref WHEN own2 > own THEN ref + (v - own) / (own2 - own) * (ref2 - ref) ELSE ref END, 6) AS mapped
FROM c JOIN s USING (stratum) JOIN n ON n.stratum = c.stratum AND (n.own <= v OR f) AND (own2 > v OR own2 IS NULL)""")
def a34_recalibrated(spark, sf_dir):
    """A cap in each group at the share that home has at its own, values mapped to home's distribution, groups under a minimum left as they are."""
    m = _marks(spark, sf_dir).select("id", "stratum", F.col("score").cast("double").alias("score"), (1 + F.col("id") % 5).cast("double").alias("w"))
    caps = stats.equal_share_caps(m, "stratum", "score", "w", "en", _FULL)
    c = m.join(caps.hint("merge"), "stratum").withColumn("v", F.round(F.least(F.lit(1.0), F.col("score") / F.col("cap")), 9))
    out = stats.recalibrated(c, "stratum", "v", "w", "en", _LEAST)
    return out.select("id", "stratum", F.round("cap", 6).alias("cap"), F.round("mapped", 6).alias("mapped"))


@query(f"""
WITH q AS (SELECT quantile_cont(v, 0.5) AS a, quantile_cont(v, 0.99) AS b FROM (SELECT (fix * 7919 % 1000) / 2000.0 AS v FROM ({FIXES}) f) z),
g AS (SELECT x / 100.0 AS base, y / 10.0 AS stretch, a, b FROM q, range(5, 25) p(x), range(8, 20) r(y)),
e AS (SELECT base, stretch, round(abs(greatest(0, least(10, 10 * (a + base) * stretch)) - 4.5) + abs(greatest(0, least(10, 10 * (b + base) * stretch)) - 9.5), 9) AS error FROM g)
SELECT CAST(base AS DOUBLE) AS base, CAST(stretch AS DOUBLE) AS stretch, CAST(error AS DOUBLE) AS error FROM e ORDER BY error, base, stretch LIMIT 1""")
def a35_affine_fit(spark, sf_dir):
    f = _fixes(spark, sf_dir).select(((F.col("fix") * 7919 % 1000) / 2000.0).alias("v"))
    return stats.affine_fit(f, "v", [x / 100 for x in range(5, 25)], [y / 10 for y in range(8, 20)], 4.5, 9.5)
