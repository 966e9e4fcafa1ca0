"""Recorded drives: steps, speeds, grade, stops, excursions, runs.

A table of fixes has drive, fix, ts and what each operator names. Windows are partitioned
by drive, so a drive is the unit of skew: no drive is longer than a day's fixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, in seconds and metres; queries over slower clocks pass their own.
MAX_GAP, STOP_SPEED, MIN_STOP, PARKED, GRADE_RUN, MEDIAN_WIDTH = 20.0, 1.0, 3.0, 300.0, 200.0, 15


def in_drive(*order: str) -> Window:
    return Window.partitionBy("drive").orderBy(*order)


def micros(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def seconds(a: Column | str, b: Column | str) -> Column:
    """Whole microseconds between two timestamps, as seconds."""
    return (micros(b) - micros(a)) / 1e6


def steps(fixes: DataFrame, max_gap: float = MAX_GAP, max_speed: float = 90.0) -> DataFrame:
    """Each fix with dt and dist to the next one, and why the step is dropped (null: kept)."""
    w = in_drive("ts", "fix")
    nxt = F.lead(F.struct("ts", "x", "y")).over(w)
    s = fixes.withColumn("next", nxt).where(F.col("next").isNotNull())
    dx, dy = F.col("next.x") - F.col("x"), F.col("next.y") - F.col("y")
    s = s.withColumns({"dt": seconds("ts", F.col("next.ts")), "dist": F.sqrt(dx * dx + dy * dy)})
    reason = F.when(F.col("dt") <= 0, "no time").when(F.col("dt") > max_gap, "gap").when(F.col("dist") > max_speed * F.col("dt"), "jump")
    return s.withColumn("reason", reason).drop("next")


def window_speed(kept: DataFrame, reach: int = 2, stop_speed: float = STOP_SPEED) -> DataFrame:
    """Speed over a centred window of steps, and the stop flag widened by the same reach."""
    w = in_drive("ts", "fix").rowsBetween(-reach, reach)
    v = F.sum("dist").over(w) / F.sum("dt").over(w)
    own = kept.withColumn("v", v).withColumn("slow", (F.col("v") < stop_speed).cast("int"))
    return own.withColumn("stopped", F.max("slow").over(w) == 1).drop("slow")


def rolling_median(value: str, width: int = MEDIAN_WIDTH) -> Column:
    """Median over a centred frame of rows, by the sorted frame: a framed median() does not exist."""
    w = in_drive("ts", "fix").rowsBetween(-(width // 2), width // 2)
    a = F.array_sort(F.collect_list(value).over(w))
    n = F.size(a)
    return (F.element_at(a, F.floor((n + 1) / 2).cast("int")) + F.element_at(a, F.floor(n / 2 + 1).cast("int"))) / 2


def grade(fixes: DataFrame, run: float = GRADE_RUN) -> DataFrame:
    """Rise of the smoothed altitude to the first fix ``run`` ahead along the drive; null at the tail."""
    from viamark.operators.spatial import as_of

    # Metres ahead are whole centimetres. Counted backwards, the first fix ahead is the last one not after.
    cm = F.round(F.col("along") * 100).cast("long")
    s = fixes.withColumn("smooth", rolling_median("alt"))
    ahead = s.select("drive", (-cm).alias("at_"), F.struct("along", "fix", "smooth").alias("far"))
    s = as_of(s.withColumn("want_", -cm - round(run * 100)), ahead, ["drive"], "want_", "at_", "far")
    return s.withColumn("grade", (F.col("far.smooth") - F.col("smooth")) / (F.col("far.along") - F.col("along"))).drop("far", "want_")


def islands(df: DataFrame, flag: Column, split: Column | None = None) -> DataFrame:
    """Rows where ``flag`` holds, with ``island``: the number of their run in the drive.

    A run ends where the flag does, or before a row for which ``split`` holds.
    """
    w = in_drive("ts", "fix")
    on = F.coalesce(flag, F.lit(False))
    new = on & (~F.coalesce(F.lag(on).over(w), F.lit(False)) | (split if split is not None else F.lit(False)))
    out = df.withColumns({"on_": on, "new_": new.cast("int")})
    return out.withColumn("island", F.sum("new_").over(w)).where("on_").drop("on_", "new_")


def stops(stepped: DataFrame, gap: float, least: float = MIN_STOP, parked: float = PARKED) -> DataFrame:
    """drive, island, begin, seconds, steps, parked: runs of stopped steps, cut at clock gaps."""
    since = seconds(F.lag("ts").over(in_drive("ts", "fix")), "ts") - F.lag("dt").over(in_drive("ts", "fix"))
    runs = islands(stepped, F.col("stopped"), since > gap)
    out = runs.groupBy("drive", "island").agg(F.min("ts").alias("begin"), F.sum("dt").alias("seconds"), F.count(F.lit(1)).alias("steps"))
    return out.where(F.col("seconds") >= least).withColumn("parked", F.col("seconds") >= parked)


def excursions(fixes: DataFrame, off: Column) -> DataFrame:
    """Runs off the line: length, farthest, whether the drive was ever on the line before, and how it ended."""
    w = in_drive("ts", "fix")
    marked = fixes.withColumns({"ever_on": F.max((~off).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), "next_off": F.lead(off).over(w)})
    runs = islands(marked, off)
    out = runs.groupBy("drive", "island").agg(F.min("ts").alias("begin"), F.count(F.lit(1)).alias("fixes"), F.max("off").alias("farthest"), F.max_by("next_off", F.struct("ts", "fix")).alias("next_off"), F.min_by(F.coalesce("ever_on", F.lit(0)), F.struct("ts", "fix")).alias("ever_on"))
    return out.withColumn("ended", F.when(F.col("next_off").isNull(), "drive end").otherwise("rejoined")).withColumn("departed", F.col("ever_on") == 1).drop("next_off", "ever_on")


def speed_factors(steps_: DataFrame, by: str, assumed: str) -> DataFrame:
    """Measured speed (km over hours) against the assumed one (distance-weighted harmonic mean)."""
    out = steps_.groupBy(by).agg(F.sum("dist").alias("d"), F.sum("dt").alias("t"), F.sum(F.col("dist") / F.col(assumed)).alias("h"))
    return out.select(by, (F.col("d") / F.col("t")).alias("measured"), (F.col("d") / F.col("h")).alias("assumed"), (F.col("h") / F.col("t")).alias("factor"))


def leave_one_out(per_drive: DataFrame, met: str, lost: str) -> DataFrame:
    """Seconds lost for each control met, from all other drives: totals minus a drive's own."""
    every = Window.partitionBy("kind")
    m, s = F.sum(met).over(every) - F.col(met), F.sum(lost).over(every) - F.col(lost)
    return per_drive.withColumns({"fitted": F.when(m > 0, s / m), "actual": F.when(F.col(met) > 0, F.col(lost) / F.col(met))})
