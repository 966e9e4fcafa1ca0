"""Trips: summaries, frontiers and menus of options, sweeps, before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the menu, in km and shares.
FIRST_GAIN, NEXT_GAIN, NEXT_SHARE, DEFAULT_EXTRA, BEAUTIFUL = 0.805, 1.609, 0.05, 0.25, 7.0


def summary(route_edges: DataFrame) -> DataFrame:
    """km, minutes, weighted mean score and beautiful km of each trip."""
    km = F.col("length_m") / 1000
    return route_edges.groupBy("trip").agg(
        F.sum(km).alias("km"), F.sum("minutes").alias("minutes"), (F.sum(F.col("score") * km) / F.sum(km)).alias("mean_score"),
        F.sum(F.when(F.col("score") >= BEAUTIFUL, km).otherwise(0.0)).alias("beautiful_km"),
    )


def frontier(options: DataFrame) -> DataFrame:
    """Options that gain more than every option with fewer extra minutes (equal minutes: the larger gain first)."""
    w = Window.partitionBy("trip").orderBy("extra", F.desc("gain"), "option").rowsBetween(Window.unboundedPreceding, -1)
    return options.withColumn("best_", F.max("gain").over(w)).where(F.col("best_").isNull() | (F.col("gain") > F.col("best_"))).drop("best_")


def menu(front: DataFrame) -> DataFrame:
    """trip, options (array of struct(extra, gain, option)): a frontier thinned to gains a driver would notice.

    The first gains FIRST_GAIN km; each further one the larger of NEXT_GAIN and 5 % of the
    last gain more than the one before; the last is always kept.
    """
    rows = front.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("extra", "gain", "option"))).alias("f"))
    none = F.slice("f", 1, 0)
    step = F.greatest(F.lit(NEXT_GAIN), NEXT_SHARE * F.element_at("f", -1)["gain"])

    def add(kept: Column, x: Column) -> Column:
        least = F.when(F.size(kept) == 0, F.lit(FIRST_GAIN)).otherwise(F.element_at(kept, -1)["gain"] + step)
        return F.when(x["gain"] >= least, F.concat(kept, F.array(x))).otherwise(kept)

    kept = F.aggregate("f", none, add)
    last = F.element_at("f", -1)
    whole = F.when((F.size(kept) > 0) & (F.element_at(kept, -1)["option"] == last["option"]), kept).otherwise(F.concat(kept, F.array(last)))
    return rows.select("trip", whole.alias("options"))


def default_option(menu_: DataFrame, fastest: str = "fastest") -> DataFrame:
    """The dearest option within 25 % extra minutes; null if none is."""
    fits = F.filter("options", lambda o: o["extra"] <= DEFAULT_EXTRA * F.col(fastest))
    return menu_.withColumn("default", F.get(fits, F.size(fits) - 1)["option"])


def road_names(route_edges: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` names with most km of each trip, in driving order."""
    each = route_edges.where("name <> ''").groupBy("trip", "name").agg(F.sum("length_m").alias("m"), F.min("seq").alias("first"))
    top = each.withColumn("rank", F.row_number().over(Window.partitionBy("trip").orderBy(F.desc("m"), "name"))).where(F.col("rank") <= n)
    return top.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("first", "name")))["name"].alias("names"))


def repeated_km(route_edges: DataFrame) -> DataFrame:
    """Length of second and later appearances of an edge in a trip."""
    nth = F.row_number().over(Window.partitionBy("trip", "edge").orderBy("seq"))
    return route_edges.withColumn("n_", nth).groupBy("trip").agg((F.sum(F.when(F.col("n_") > 1, F.col("length_m")).otherwise(0.0)) / 1000).alias("repeated_km"))


def stretches(route_edges: DataFrame, flag: Column) -> DataFrame:
    """trip, island, from_m, to_m, edges: maximal runs of consecutive edges with ``flag``."""
    w = Window.partitionBy("trip").orderBy("seq")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    on = F.coalesce(flag, F.lit(False))
    r = route_edges.withColumns({"on_": on, "new_": (on & ~F.coalesce(F.lag(on).over(w), F.lit(False))).cast("int"), "end_": F.sum("length_m").over(run)})
    r = r.withColumn("island", F.sum("new_").over(run)).where("on_")
    return r.groupBy("trip", "island").agg(F.min(F.col("end_") - F.col("length_m")).alias("from_m"), F.max("end_").alias("to_m"), F.count(F.lit(1)).alias("edges"))


def trade(arms: DataFrame) -> DataFrame:
    """Per pair: extra minutes, gained miles and miles a minute (a tenth of a minute at least) of scenic over fast."""
    pick = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    p = arms.groupBy("pair").agg(*[pick(a, c).alias(f"{a}_{c}") for a in ("fast", "scenic") for c in ("minutes", "beautiful_km", "km")])
    extra, gain = F.col("scenic_minutes") - F.col("fast_minutes"), (F.col("scenic_beautiful_km") - F.col("fast_beautiful_km")) / 1.609344
    return p.select("pair", extra.alias("extra"), gain.alias("gain"), (gain / F.greatest(extra, F.lit(0.1))).alias("rate"), (F.abs(F.col("scenic_km") - F.col("fast_km")) < 1e-6).alias("same"))


def sweep(routes: DataFrame) -> DataFrame:
    """Per step of preference: share of pairs where beauty falls, mean gain, share where nothing changes."""
    w = Window.partitionBy("pair").orderBy("pref")
    steps = routes.withColumn("gain", F.col("beautiful_km") - F.lag("beautiful_km").over(w)).where("gain is not null")
    return steps.groupBy("pref").agg(F.avg((F.col("gain") < 0).cast("double")).alias("falls"), F.avg("gain").alias("gain"), F.avg((F.col("gain") == 0).cast("double")).alias("unchanged"))


def firing_rates(pairs: DataFrame, value: str, thresholds: list[float], band: str) -> DataFrame:
    """Share of pairs above each threshold, by band and over all (null band)."""
    each = pairs.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return each.rollup("threshold", band).agg(F.avg((F.col(value) > F.col("threshold")).cast("double")).alias("share")).where("threshold is not null")


def survival(misses: DataFrame, by: str, days: int, thin: int) -> DataFrame:
    """S(k) = P(miss > k) by source; sources with fewer than ``thin`` misses take the pooled curve."""
    ks = F.explode(F.sequence(F.lit(0), F.lit(days)))
    each = misses.withColumn("k", ks).withColumn("over", (F.col("miss") > F.col("k")).cast("double"))
    own = each.groupBy(by, "k").agg(F.avg("over").alias("own"), F.count(F.lit(1)).alias("n"))
    every = each.groupBy("k").agg(F.avg("over").alias("all"))
    # As many rows as days.
    return own.join(F.broadcast(every), "k").select(by, "k", F.when(F.col("n") >= thin, F.col("own")).otherwise(F.col("all")).alias("s"))


def worth_the_detour(arms: DataFrame, first_gain: float = 0.805) -> DataFrame:
    """pair, sent, no_gain: the scenic arm unless it scores less, has less beautiful road or gains less than half a mile.

    arms: pair, arm (fast, scenic), score, beautiful_km. Pairs without both arms have no answer.
    """
    of = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    p = arms.groupBy("pair").agg(of("fast", "score").alias("fs"), of("scenic", "score").alias("ss"), of("fast", "beautiful_km").alias("fb"), of("scenic", "beautiful_km").alias("sb")).where("fs is not null and ss is not null")
    short = F.col("sb") - F.col("fb") < first_gain
    back = (F.col("ss") < F.col("fs")) | (F.col("sb") < F.col("fb")) | short
    return p.select("pair", F.when(back, "fast").otherwise("scenic").alias("sent"), (back & short).alias("no_gain"))
