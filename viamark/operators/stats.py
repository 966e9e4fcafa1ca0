"""Statistics over tables: quantiles, AUC, intervals, bootstrap, recalibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viamark.plans.tables import stage, stored_bytes

#: Stored size up to which a table with one row a group is broadcast.
BROADCAST_BYTES = 8 << 20


def _ranked(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """by, value, at_ (share of the weight below the middle of a value's own), at2_ and v2_ (of the next value), first_."""
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, value).agg(F.sum(weight).alias("w_"))
    w = Window.partitionBy(*by).orderBy(value)
    rows = rows.withColumns({"total_": F.sum("w_").over(Window.partitionBy(*by)), "run_": F.sum("w_").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumn("at_", (F.col("run_") - F.col("w_") / 2) / F.col("total_"))
    return rows.withColumns({"at2_": F.lead("at_").over(w), "v2_": F.lead(value).over(w), "first_": F.row_number().over(w) == 1})


def equal_share_caps(df: DataFrame, by: str, value: str, weight: str, home: str, full: float) -> DataFrame:
    """by, cap: for each group the value above which the same share of its weight lies as lies at ``full`` or above in ``home``.

    The share is looked up backwards in every group's own distribution; home keeps ``full``.
    """
    at_home = df.where(F.col(by) == home)
    share = at_home.agg((1 - F.sum(F.when(F.col(value) >= full, F.col(weight)).otherwise(0)) / F.sum(weight)).alias("q_"))  # one row
    rows = _ranked(df.where(F.col(by) != home), [by], value, weight).join(F.broadcast(share), F.lit(True))
    inner = (F.col("at_") <= F.col("q_")) & (F.col("at2_") > F.col("q_"))
    v = F.col(value) + (F.col("v2_") - F.col(value)) * (F.col("q_") - F.col("at_")) / (F.col("at2_") - F.col("at_"))
    ends = F.col("first_") & (F.col("at_") > F.col("q_")) | F.col("at2_").isNull() & (F.col("at_") <= F.col("q_"))
    caps = rows.groupBy(by).agg(F.max(F.when(inner, v).when(ends, F.col(value))).cast("double").alias("cap"))
    return caps.unionByName(at_home.select(by).distinct().withColumn("cap", F.lit(float(full))))


def _grid_quantiles(df: DataFrame, by: list[str], value: str, weight: str, grid: int) -> DataFrame:
    """by, q: an array of grid + 1 weighted quantiles; each stretch between two values gives the ones that lie in it."""
    rows = _ranked(df, by, value, weight)
    low = F.when(F.col("first_"), 0).otherwise(F.ceil(F.col("at_") * grid)).cast("int")
    high = F.when(F.col("at2_").isNull(), grid).otherwise(F.ceil(F.col("at2_") * grid) - 1).cast("int")
    rows = rows.withColumns({"low_": low, "high_": high}).where("low_ <= high_").withColumn("i", F.explode(F.sequence("low_", "high_")))
    q = F.col("i") / grid
    inside = F.col("at2_").isNotNull() & (q >= F.col("at_"))
    v = F.when(inside, F.col(value) + (F.col("v2_") - F.col(value)) * (q - F.col("at_")) / (F.col("at2_") - F.col("at_"))).otherwise(F.col(value))
    return rows.select(*by, F.struct("i", v.cast("double").alias("v")).alias("s_")).groupBy(*by).agg(F.array_sort(F.collect_list("s_")).alias("s_")).select(*by, F.transform("s_", lambda s: s["v"]).alias("q"))


def recalibrated(df: DataFrame, by: str, value: str, weight: str, home: str, least: float, grid: int = 200) -> DataFrame:
    """``df`` with ``mapped``: the value at the same place of the distribution in ``home``; groups of less weight than ``least`` keep theirs.

    Where several quantiles of a group are equal, the first of them counts.
    """
    own = _grid_quantiles(df, [by], value, weight, grid).withColumnRenamed("q", "own_")
    ref = _grid_quantiles(df.where(F.col(by) == home), [by], value, weight, grid).select(F.col("q").alias("ref_"))  # one row
    size = df.groupBy(by).agg(F.sum(weight).alias("size_"))
    pairs = F.filter(F.arrays_zip("own_", "ref_"), lambda z, i: (i == 0) | (z["own_"] > F.get(F.col("own_"), i - 1)))
    maps = stage(own.join(F.broadcast(ref), F.lit(True)).join(size.hint("merge"), by).select(by, pairs.alias("map_"), (F.col("size_") >= least).alias("mapped_")), "maps")
    # A row of grid + 1 pairs for each group.
    hint = "broadcast" if stored_bytes(maps) <= BROADCAST_BYTES else "merge"
    out = df.join(maps.hint(hint), by, "left").withColumn("i_", F.size(F.filter("map_", lambda z: z["own_"] <= F.col(value))))
    at = lambda k, c: F.get(F.col("map_"), F.greatest(F.lit(0), F.least(k, F.size("map_") - 1))).getField(c)
    a, b = F.col("i_") - 1, F.col("i_")
    t = F.when(at(b, "own_") > at(a, "own_"), (F.col(value) - at(a, "own_")) / (at(b, "own_") - at(a, "own_"))).otherwise(0.0)
    there = at(a, "ref_") + F.greatest(F.lit(0.0), t) * (at(b, "ref_") - at(a, "ref_"))
    return out.withColumn("mapped", F.when(F.col("mapped_"), there).otherwise(F.col(value))).drop("map_", "mapped_", "i_")


def weighted_quantiles(df: DataFrame, by: list[str], value: str, weight: str, shares: tuple[float, ...]) -> DataFrame:
    """Quantiles by interpolating the midpoints of the cumulative weight.

    Equal values are added up first, so the running window holds one row a value.
    """
    rows = _ranked(df, by, value, weight)
    out = []
    for q in shares:
        inner = (F.col("at_") <= q) & (F.col("at2_") > q)
        v = F.col(value) + (F.col("v2_") - F.col(value)) * (q - F.col("at_")) / (F.col("at2_") - F.col("at_"))
        below, above = F.col("first_") & (F.col("at_") > q), F.col("at2_").isNull() & (F.col("at_") <= q)
        out.append(F.max(F.when(inner, v).when(below | above, F.col(value))).alias(f"q{round(q * 100)}"))
    return rows.groupBy(*by).agg(*out)


def auc(df: DataFrame, by: list[str], score: str, positive: str, weight: Column | None = None) -> DataFrame:
    """Probability that a positive row scores above a negative one, ties at half; also the masses.

    One row a distinct score enters the window.
    """
    w = weight if weight is not None else F.lit(1.0)
    mass = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    rows = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(*by, score).agg(mass(F.col(positive) == 1).alias("p_"), mass(F.col(positive) == 0).alias("n_"))
    below = F.coalesce(F.sum("n_").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = rows.withColumn("won_", F.col("p_") * (below + F.col("n_") / 2)).groupBy(*by).agg(F.sum("won_").alias("won"), F.sum("p_").alias("n1"), F.sum("n_").alias("n0"))
    return out.withColumn("auc", F.when(F.col("n1") * F.col("n0") > 0, F.col("won") / (F.col("n1") * F.col("n0"))))


def pooled(strata: DataFrame) -> DataFrame:
    """AUC within strata, pooled by how many pairs each has."""
    return strata.agg((F.sum("won") / F.sum(F.col("n1") * F.col("n0"))).alias("auc"), F.sum(F.col("n1") * F.col("n0")).alias("pairs"))


def null_ceiling(n1: Column, n0: Column, z: float = 1.645) -> Column:
    """The AUC that chance alone stays below."""
    return 0.5 + z * F.sqrt((n1 + n0 + 1) / (12 * n1 * n0))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, d = k / n, 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (p + z * z / (2 * n) - half) / d, (p + z * z / (2 * n) + half) / d


def normal_tail(z: Column) -> Column:
    """P(|Z| > z), by the rational approximation 7.1.26 of Abramowitz and Stegun (error under 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided paired sign test with continuity correction."""
    n = wins + losses
    z = F.greatest(F.lit(0.0), F.abs(wins - losses) - 1) / F.sqrt(n)
    return F.when(n == 0, 1.0).otherwise(normal_tail(z))


def group_percentiles(df: DataFrame, by: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """by, p: exact interpolated percentiles of each group, as :func:`percentile` gives them, by a sort that may spill.

    Equal values are counted first, in each task; no buffer holds a group's values.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("w_"))
    w = Window.partitionBy(*by)
    rows = rows.withColumns({"n_": F.sum("w_").over(w), "to_": F.sum("w_").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumn("from_", F.col("to_") - F.col("w_"))
    at = {i: F.lit(float(s)) * (F.col("n_") - 1) for i, s in enumerate(shares)}
    holds = lambda rank: (F.col("from_") <= rank) & (rank < F.col("to_"))
    ends = [F.max(F.when(holds(f(at[i])), F.col(value))).alias(f"{n}{i}_") for i in at for n, f in (("a", F.floor), ("b", F.ceil))]
    out = rows.groupBy(*by).agg(F.max("n_").alias("n_"), *ends)
    p = [F.col(f"a{i}_") + (F.col(f"b{i}_") - F.col(f"a{i}_")) * (at[i] - F.floor(at[i])) for i in at]
    return out.select(*by, F.array(*[x.cast("double") for x in p]).alias("p"))


def with_percentiles(df: DataFrame, by: list[str], value: str, shares: tuple[float, ...], *sums: Column) -> DataFrame:
    """by, the aggregates ``sums`` and the percentiles ``p`` of each group."""
    p = group_percentiles(df, by, value, shares).select(*[F.col(b).alias(f"{b}_p_") for b in by], "p")
    out = df.groupBy(*by).agg(*sums)
    same = [out[b].eqNullSafe(p[f"{b}_p_"]) for b in by]
    return out.join(p.hint("merge"), same, "left").drop(*[f"{b}_p_" for b in by])


def five_numbers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    out = with_percentiles(df, by, value, (0.25, 0.5, 0.75), F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
    return out.select(*by, "n", "low", F.col("p")[0].alias("q1"), F.col("p")[1].alias("median"), F.col("p")[2].alias("q3"), "high", "mean")


def quantiles(df: DataFrame, value: str, shares: tuple[float, ...], weight: Column | None = None, bins: int = 256) -> DataFrame:
    """One row, ``q``: exact interpolated quantiles over all rows, as :func:`percentile` gives them, without one task that holds all values.

    Rows are counted in bins between approximate quantiles; only the values of the bins that
    hold a wanted rank are looked at again, one bin in one task. weight: whole numbers.
    """
    w = weight if weight is not None else F.lit(1)
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), w.cast("long").alias("w"))
    cuts = rows.agg(F.percentile_approx("v", F.array(*[F.lit(i / bins) for i in range(1, bins)]), F.lit(10_000)).alias("cuts"))  # one row
    tagged = rows.join(F.broadcast(cuts), F.lit(True)).withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("v")))).groupBy("bin", "v").agg(F.sum("w").alias("w"))
    sizes = tagged.groupBy("bin").agg(F.sum("w").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # as many rows as bins
    total = sizes.agg(F.sum("n").alias("n_"))
    place = [F.struct(F.lit(i).alias("i"), (F.lit(float(s)) * (F.col("n_") - 1)).alias("at")) for i, s in enumerate(shares)]
    asked = total.select(F.explode(F.array(*place)).alias("a")).select("a.i", "a.at", F.explode(F.array(F.floor("a.at"), F.ceil("a.at"))).alias("rank")).distinct()
    asked = asked.join(F.broadcast(sizes), (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).select("i", "at", "rank", "bin", "before")
    held = tagged.join(F.broadcast(asked.select("bin").distinct()), "bin")  # twice as many rows as shares
    run = F.sum("w").over(Window.partitionBy("bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = held.withColumn("to", run).join(F.broadcast(asked), "bin").where((F.col("rank") - F.col("before") >= F.col("to") - F.col("w")) & (F.col("rank") - F.col("before") < F.col("to")))
    low = found.groupBy("i", "at").agg(F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"))
    each = low.select("i", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("q"))
    return each.agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("x")).select(F.transform("x", lambda s: s["q"]).alias("q"))


#: P(Poisson(1) <= k) for k = 0, 1, ...: a uniform number above k of these draws a cluster k times.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def bootstrap_means(df: DataFrame, cluster: str, value: str, other: str, replicates: int) -> DataFrame:
    """replicate, mean, difference: means of ``value``, and less that of ``other``, with whole clusters drawn by Poisson weights.

    A weight is a seeded number of the cluster and the replicate, so clusters need no order
    and meet no other; a task adds up its own clusters for every replicate.
    """
    sums = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.sum(other).alias("o"), F.count(value).alias("n"))
    each = sums.withColumn("replicate", F.explode(F.expr(f"sequence(0L, {replicates - 1}L)")))
    u = (((F.col(cluster) * 7919 + F.col("replicate") * 104729 + 1) % 1000003) * 48271 % 2147483647) / 2147483647.0
    w = sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    total = lambda c: F.sum(F.col(c) * F.col("w"))
    out = each.withColumn("w", w).groupBy("replicate").agg((total("s") / total("n")).alias("mean"), ((total("s") - total("o")) / total("n")).alias("difference"))
    return out.where("mean is not null")


def quantile_map(df: DataFrame, value: str, key: str, by: str, grid: int = 20) -> DataFrame:
    """Scores of each group mapped to the quantiles of all: an interval join on ``grid`` steps."""
    shares = [i / grid for i in range(grid + 1)]
    own = group_percentiles(df, [by], value, tuple(shares)).withColumnRenamed("p", "own")
    every = quantiles(df, value, tuple(shares)).withColumnRenamed("q", "all")
    # One row for each group, and one row for all.
    both = stage(own.join(F.broadcast(every), F.lit(True)), "grids")
    i = F.expr(f"greatest(1, least({grid}, size(filter(own, q -> q <= {value}))))")
    out = df.join(both.hint("broadcast" if stored_bytes(both) <= BROADCAST_BYTES else "merge"), by).withColumn("i", i)
    low, high = F.element_at("own", F.col("i")), F.element_at("own", F.col("i") + 1)
    t = F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0)
    a, b = F.element_at("all", F.col("i")), F.element_at("all", F.col("i") + 1)
    return out.select(key, by, value, (a + t * (b - a)).alias("mapped"))


def affine_fit(df: DataFrame, raw: str, bases: list[float], stretches: list[float], p50: float, p99: float) -> DataFrame:
    """The base and stretch of a grid whose median and 99th percentile come closest to the targets.

    The percentiles of the raw value are taken once: an affine map moves them along.
    """
    q = quantiles(df, raw, (0.5, 0.99))
    grid = q.withColumn("base", F.explode(F.array(*map(F.lit, bases)))).withColumn("stretch", F.explode(F.array(*map(F.lit, stretches))))
    scale = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(10.0), 10 * (v + F.col("base")) * F.col("stretch")))
    error = F.abs(scale(F.col("q")[0]) - p50) + F.abs(scale(F.col("q")[1]) - p99)
    best = grid.agg(F.min(F.struct(F.round(error, 9).alias("error"), "base", "stretch")).alias("m"))
    return best.select("m.base", "m.stretch", "m.error")


def map_points(df: DataFrame, value: str, by: str, points: list[float], grid: int = 20) -> DataFrame:
    """by, value, mapped: what fixed values of each group become on the quantiles of all groups together."""
    own = group_percentiles(df, [by], value, tuple(i / grid for i in range(grid + 1))).withColumnRenamed("p", "own")
    # One row for each group, and one row for all.
    every = quantiles(df, value, tuple(i / grid for i in range(grid + 1))).withColumnRenamed("q", "all")
    both = own.join(F.broadcast(every), F.lit(True)).withColumn(value, F.explode(F.array(*map(F.lit, points))))
    out = both.withColumn("i", F.expr(f"greatest(1, least({grid}, size(filter(own, q -> q <= {value}))))"))
    low, high = F.element_at("own", F.col("i")), F.element_at("own", F.col("i") + 1)
    t = F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0)
    a, b = F.element_at("all", F.col("i")), F.element_at("all", F.col("i") + 1)
    return out.select(by, value, (a + t * (b - a)).alias("mapped"))
