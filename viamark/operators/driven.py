"""Drives against the lines they followed: widths, courses, silences, causes of stops, marked stretches.

A drive is the unit of a window, as in :mod:`viamark.operators.traces`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viamark.functions.geometry import bearing, point, to_segment
from viamark.operators.spatial import CELL, cells_of_box, interval_join, nearest
from viamark.operators.traces import in_drive, islands, micros
from viamark.plans.tables import stage

# Metres, degrees, seconds and fixes.
WIDTHS, HOLE_S, ON_LINE_M, AGAINST_DEG, SILENCE_S, RUN_FIXES = (60, 100, 150, 250, 500, 1000, 2000), 10.0, 15.0, 120.0, 30.0, 5
MOVING, MANEUVER_M, CONTROL_M, SPACING, BACK_M, STRIP_M, BEHIND_M = 3.0, 35.0, 45.0, 25.0, 400.0, 40.0, 1000.0


def followed(fixes: DataFrame, reroute: Column) -> DataFrame:
    """Fixes with ``seq``: the number of the route they followed, counted up at each reroute."""
    return fixes.withColumn("seq", F.sum(F.when(reroute, 1).otherwise(0)).over(in_drive("ts", "fix")))


def against(fixes: DataFrame, lines: DataFrame) -> DataFrame:
    """Fixes joined to their line (drive, seq, ax, ay, bx, by): off, along and bearing of the line."""
    dist, t = to_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    length = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    b = bearing(point(F.col("ax"), F.col("ay")), point(F.col("bx"), F.col("by")))
    return fixes.join(lines.hint("merge"), ["drive", "seq"]).withColumns({"off": dist, "along": t * length, "line_bearing": b}).drop("ax", "ay", "bx", "by")


def segments(fixes: DataFrame) -> DataFrame:
    """drive, seq, fixes, begin, end: the fixes of each route followed."""
    return fixes.groupBy("drive", "seq").agg(F.count(F.lit(1)).alias("fixes"), F.min("ts").alias("begin"), F.max("ts").alias("end"))


def width_shares(steps: DataFrame, widths: tuple[float, ...]) -> DataFrame:
    """width, followed, original: shares of driven metres within each width of either line. steps: dist, off, off_first."""
    near = lambda c: F.sum(F.when(F.col(c) <= F.col("width"), F.col("dist")).otherwise(0.0)) / F.sum("dist")
    s = steps.withColumn("width", F.explode(F.array(*[F.lit(float(w)) for w in widths])))
    return s.groupBy("width").agg(near("off").alias("followed"), near("off_first").alias("original"))


def holes(fixes: DataFrame, least: float = HOLE_S) -> DataFrame:
    """holes, median_s, longest_s: gaps between fixes that last longer than ``least`` seconds."""
    gap = (micros(F.lead("ts").over(in_drive("ts", "fix"))) - micros("ts")) / 1e6
    g = fixes.withColumn("gap", gap).where(F.col("gap") > least)
    return g.agg(F.count(F.lit(1)).alias("holes"), F.median("gap").alias("median_s"), F.max("gap").alias("longest_s"))


def course_angles(fixes: DataFrame, on_line: float = ON_LINE_M, moving: float = MOVING) -> DataFrame:
    """Fixes with ``angle`` between their course and the line: null unless on the line and moving."""
    angle = F.abs(F.pmod(F.col("course") - F.col("line_bearing") + 180.0, F.lit(360.0)) - 180.0)
    return fixes.withColumn("angle", F.when((F.col("off") <= on_line) & (F.col("speed") >= moving), angle))


def course_agreement(angled: DataFrame, limit: float = AGAINST_DEG) -> DataFrame:
    """drive, fixes, against, longest: how often the course points against the line, and the longest run."""
    flag = F.coalesce(F.col("angle") >= limit, F.lit(False))
    runs = islands(angled, flag).groupBy("drive", "island").agg(F.count(F.lit(1)).alias("n")).groupBy("drive").agg(F.max("n").alias("longest"))
    out = angled.groupBy("drive").agg(F.count("angle").alias("fixes"), F.sum(flag.cast("int")).alias("against"))
    return out.join(runs.hint("merge"), "drive", "left").withColumn("longest", F.coalesce("longest", F.lit(0)))


def wrong_way_runs(angled: DataFrame, limit: float = AGAINST_DEG, least: int = RUN_FIXES) -> DataFrame:
    """drive, island, fixes, back_m: runs of ``least`` fixes or more against the line, and the metres they go back."""
    runs = islands(angled, F.col("angle") >= limit).groupBy("drive", "island")
    at = F.struct("ts", "fix")
    return runs.agg(F.count(F.lit(1)).alias("fixes"), (F.min_by("along", at) - F.max_by("along", at)).alias("back_m")).where(F.col("fixes") >= least)


def silences(fixes: DataFrame, replies: DataFrame, off: Column, least: float = SILENCE_S, moving: float = MOVING) -> DataFrame:
    """drive, island, piece, seconds, metres: stretches off a line that had been reached, without a reply, mostly moving.

    fixes: drive, fix, ts, seq, speed, step (metres from the fix before); replies: drive, ts. A
    run off the line is cut at every reply inside it.
    """
    w = Window.partitionBy("drive", "seq").orderBy("ts", "fix").rowsBetween(Window.unboundedPreceding, -1)
    f = fixes.withColumns({"off_": off, "reached": F.coalesce(F.max((~off).cast("int")).over(w), F.lit(0))})
    runs = islands(f, F.col("off_"))
    span = runs.groupBy("drive", "island").agg(F.min("ts").alias("begin"), F.max("ts").alias("end"), F.min_by("reached", F.struct("ts", "fix")).alias("reached")).where("reached = 1").drop("reached")
    # Replies and fixes meet spans in buckets of time, not all those of a drive.
    seconds = lambda c: micros(c) / 1e6
    width = 8 * least
    spans = span.select("drive", "island", "begin", seconds("begin").alias("a_"), seconds("end").alias("b_"))
    cuts = interval_join(replies.select("drive", F.col("ts").alias("cut"), seconds("ts").alias("t_")), spans, ["drive"], "t_", "a_", "b_", width).where("cut > begin").select("drive", "island", "cut")
    ends = span.select("drive", "island", F.col("begin").alias("cut")).unionByName(cuts).unionByName(span.select("drive", "island", F.col("end").alias("cut")))
    order = Window.partitionBy("drive", "island").orderBy("cut")
    pieces = ends.withColumns({"piece": F.row_number().over(order), "next": F.lead("cut").over(order)}).where("next is not null")
    pieces = pieces.withColumn("seconds", (micros("next") - micros("cut")) / 1e6).where(F.col("seconds") >= least)
    timed = pieces.withColumns({"a_": seconds("cut"), "b_": seconds("next")})
    inside = interval_join(runs.select("drive", "island", "speed", "step", seconds("ts").alias("t_")), timed, ["drive", "island"], "t_", "a_", "b_", width)
    out = inside.groupBy("drive", "island", "piece", "seconds").agg(F.avg((F.col("speed") >= moving).cast("double")).alias("share"), F.sum("step").alias("metres"))
    return out.where("share >= 0.5").drop("share")


def stop_causes(stops: DataFrame, maneuvers: DataFrame, controls: DataFrame, near_turn: float = MANEUVER_M, near_control: float = CONTROL_M) -> DataFrame:
    """pid, cause: a control within reach explains a stop before a turn does; else nothing does.

    stops: pid, x, y; maneuvers: id, x, y; controls: id, x, y, kind.
    """
    as_segs = lambda p: p.select("id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    turn = nearest(stops, as_segs(maneuvers), "id", near_turn).select("pid", F.lit("maneuver").alias("turn"))
    ctl = nearest(stops, as_segs(controls), "id", near_control).join(controls.select("id", "kind").hint("merge"), "id").select("pid", "kind")
    out = stops.join(ctl.hint("merge"), "pid", "left").join(turn.hint("merge"), "pid", "left")
    return out.select("pid", F.coalesce("kind", "turn", F.lit("unexplained")).alias("cause"))


def controls_on_lines(stops: DataFrame, lines: DataFrame, controls: DataFrame, reach: float, width: float, piece: float = CELL) -> DataFrame:
    """pid, control, dist: the nearest control within ``reach`` of a stop, of those within ``width`` of a line of its drive; ties take the smallest.

    stops: pid, drive, x, y; lines: drive, ax, ay, bx, by; controls: id, x, y. A stop goes through the pieces of its
    lines by how near a control beside them can be, in rounds of twice as many, until none left can have a nearer
    one: neither all controls on a line nor all those around a stop become rows. Pieces are finite, so rounds end.
    """
    spark, (x, y, ends) = stops.sparkSession, (F.col("x"), F.col("y"), [F.col(c) for c in ("ax", "ay", "bx", "by")])
    # Few bytes become many rows, so parts are not put together.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    off, t = to_segment(x, y, *ends)
    near = stops.repartition(parts, "drive").join(lines.distinct().hint("merge"), "drive").withColumns({"off": off, "t": t}).where(F.col("off") <= reach + width)
    length = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    near = near.withColumn("n", F.greatest(F.lit(1), F.ceil(length / piece)).cast("int")).withColumn("far", F.when(length > 0, (reach + width + 1) / length).otherwise(1.0))
    # Of a line only what lies no farther from the place nearest to the stop can be in reach.
    at = lambda c: F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor(c * F.col("n")).cast("int")))
    near = near.withColumn("k", F.explode(F.sequence(at(F.col("t") - F.col("far")), at(F.col("t") + F.col("far")))))
    part = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * (F.col("k") + i) / F.col("n")
    near = near.select("drive", "pid", "x", "y", part("ax", "bx", 0).alias("ax"), part("ay", "by", 0).alias("ay"), part("ax", "bx", 1).alias("bx"), part("ay", "by", 1).alias("by"))
    # What rounding may take off the least distance is allowed for.
    near = near.withColumn("least", to_segment(x, y, *ends)[0] - width - 1e-6).where(F.col("least") <= reach)
    todo = near.groupBy("drive", "pid", "x", "y").agg(F.sort_array(F.collect_list(F.struct("least", "ax", "ay", "bx", "by"))).alias("pieces"))
    none = F.lit(None).cast(f"struct<d: double, control: {controls.schema['id'].dataType.simpleString()}>")
    todo = stage(todo.select("pid", "x", "y", "pieces", none.alias("best")), "stops")
    size = max(width, CELL)
    held = stage(controls.select(F.col("id").alias("control"), F.col("x").alias("cx_"), F.col("y").alias("cy_"), F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy")), "controls")
    done, take = None, 1
    while not todo.isEmpty():
        box = cells_of_box(F.least("ax", "bx") - width, F.least("ay", "by") - width, F.greatest("ax", "bx") + width, F.greatest("ay", "by") + width, size)
        asked = todo.select("pid", "x", "y", F.coalesce("best.d", F.lit(float(reach))).alias("most"), F.inline(F.slice("pieces", 1, take))).drop("least")
        asked = asked.withColumn("c_", F.explode(box)).select("pid", "x", "y", "most", "ax", "ay", "bx", "by", "c_.cx", "c_.cy")
        d = F.sqrt((x - F.col("cx_")) ** 2 + (y - F.col("cy_")) ** 2)
        met = asked.join(held.hint("merge"), ["cx", "cy"]).withColumn("d", d).where((F.col("d") <= F.col("most")) & (to_segment(F.col("cx_"), F.col("cy_"), *ends)[0] <= width))
        found = met.groupBy("pid").agg(F.min(F.struct("d", "control")).alias("now"))
        nxt = todo.join(found.hint("merge"), "pid", "left").withColumn("best", F.least("best", "now"))
        most = F.coalesce("best.d", F.lit(float(reach)))
        nxt = nxt.select("pid", "x", "y", F.filter(F.slice("pieces", take + 1, F.greatest(F.size("pieces"), F.lit(1))), lambda p: p["least"] <= most).alias("pieces"), "best")
        nxt = stage(nxt, "stops")
        over = nxt.where("size(pieces) = 0 and best is not null").select("pid", "best.control", F.col("best.d").alias("dist"))
        done = over if done is None else done.unionByName(over)
        todo, take = nxt.where("size(pieces) > 0"), take * 2
    if done is None:
        done = spark.createDataFrame([], f"pid {stops.schema['pid'].dataType.simpleString()}, control {controls.schema['id'].dataType.simpleString()}, dist double")
    return done


def marked_stretches(marks: DataFrame, window: float | Column = BACK_M, reaction: float | Column = 1.5, spacing: float = SPACING) -> DataFrame:
    """Marks with lo, hi and one row for each sample ``at`` of the stretch behind them.

    marks: anchor (metres along), speed. The stretch ends where the driver was when they
    reacted, and its samples lie in the middle of equal pieces of at most ``spacing``.
    """
    hi = F.greatest(F.lit(0.0), F.col("anchor") - F.col("speed") * reaction)
    m = marks.withColumn("hi", hi).withColumn("lo", F.greatest(F.lit(0.0), F.col("hi") - window))
    n = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / spacing)).cast("int")
    m = m.withColumn("n_", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_") - 1)))
    return m.withColumn("at", F.col("lo") + (F.col("k") + 0.5) * (F.col("hi") - F.col("lo")) / F.col("n_")).drop("n_")


def mode_of(df: DataFrame, by: str, value: str, weight: Column | None = None) -> DataFrame:
    """by, value: the most frequent value of each group; ties take the smallest. weight: how often a row counts."""
    n = df.groupBy(by, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    return n.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("less"), value)).alias("m")).select(by, F.col(f"m.{value}").alias(value))


def turned_back(segs: DataFrame, behind: float = BEHIND_M, strip: float = STRIP_M, limit: float = AGAINST_DEG) -> DataFrame:
    """route, at_m: how far along a route first runs back through the strip behind its start.

    segs: route, start (metres along), ax, ay, bx, by, px, py, heading (of the driver at p). A
    segment counts where it runs ``limit`` degrees or more from the heading; it is cut to the strip.
    """
    s, c = F.sin(F.radians("heading")), F.cos(F.radians("heading"))
    ahead = lambda x, y: (F.col(x) - F.col("px")) * s + (F.col(y) - F.col("py")) * c
    aside = lambda x, y: (F.col(x) - F.col("px")) * c - (F.col(y) - F.col("py")) * s
    d = segs.withColumns({"f0": ahead("ax", "ay"), "f1": ahead("bx", "by"), "s0": aside("ax", "ay"), "s1": aside("bx", "by")})

    def span(a: str, b: str, low: float, high: float) -> tuple[Column, Column]:
        """Shares of the segment between which a value that goes from a to b lies inside."""
        step = F.col(b) - F.col(a)
        t0, t1 = (low - F.col(a)) / step, (high - F.col(a)) / step
        inside = (F.col(a) >= low) & (F.col(a) <= high)
        first = F.when(step == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(t0, t1))
        last = F.when(step == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(t0, t1))
        return first, last

    f, z = span("f0", "f1", -behind, 0.0), span("s0", "s1", -strip / 2, strip / 2)
    d = d.withColumns({"t0": F.greatest(F.lit(0.0), f[0], z[0]), "t1": F.least(F.lit(1.0), f[1], z[1])})
    b = bearing(point(F.col("ax"), F.col("ay")), point(F.col("bx"), F.col("by")))
    turn = F.abs(F.pmod(b - F.col("heading") + 540.0, F.lit(360.0)) - 180.0)
    length = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    return d.where((F.col("t0") <= F.col("t1")) & (turn >= limit)).groupBy("route").agg(F.min(F.col("start") + F.col("t0") * length).alias("at_m"))
