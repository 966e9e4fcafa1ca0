"""Study tables over trips, scores, policies and candidates.

Candidates, weight sets, thresholds and policies are rows or named expressions; groups are
states, bands or runs, so tables of them are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viamark.operators import stats
from viamark.operators.scenery import composite
from viamark.plans.tables import stage


def share(c: Column, weight: Column | None = None) -> Column:
    """The share of rows, or of a weight, for which a condition holds."""
    w = weight if weight is not None else F.lit(1.0)
    return F.sum(F.when(c, w).otherwise(0.0)) / F.sum(w)


def compare_sets(trips: DataFrame, base: str) -> DataFrame:
    """weights, pairs, same_path, drift, wins, losses, p: every weight set against ``base`` on columns without a scale.

    trips: pair, weights, path (what was driven), score, beauty (share of km). Drift is the mean
    change of the score where the path is the same: what the ruler alone does.
    """
    b = trips.where(F.col("weights") == base).select("pair", F.col("path").alias("b_path"), F.col("score").alias("b_score"), F.col("beauty").alias("b_beauty"))
    m = trips.where(F.col("weights") != base).join(b.hint("merge"), "pair")
    same, up, down = F.col("path") == F.col("b_path"), F.col("beauty") > F.col("b_beauty"), F.col("beauty") < F.col("b_beauty")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = m.groupBy("weights").agg(F.count(F.lit(1)).alias("pairs"), n(same).alias("same_path"), F.avg(F.when(same, F.col("score") - F.col("b_score"))).alias("drift"), n(up).alias("wins"), n(down).alias("losses"))
    return out.withColumn("p", stats.sign_test(F.col("wins"), F.col("losses")))


def proxy_errors(df: DataFrame, group: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """column, groups, bias, mean_error, worst: measured against proxy columns over all groups, one row a pair."""
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("column"), F.col(m).alias("measured"), F.col(p).alias("proxy")) for k, (m, p) in pairs.items()])).alias("v")
    e = df.select(group, stacked).select(group, "v.*").withColumn("error", F.col("proxy") - F.col("measured"))
    return e.groupBy("column").agg(F.countDistinct(group).alias("groups"), F.avg("error").alias("bias"), F.avg(F.abs("error")).alias("mean_error"), F.max(F.abs("error")).alias("worst"))


def grouped_auc(df: DataFrame, by: str, score: str, positive: str, least: int) -> DataFrame:
    """AUC of every group with at least ``least`` rows on either side."""
    return stats.auc(df, [by], score, positive).where((F.col("n1") >= least) & (F.col("n0") >= least)).select(by, "n1", "n0", "auc")


def breakdown(df: DataFrame, by: str, terms: dict[str, float], target_raw: float, weight: str = "length_m") -> DataFrame:
    """Weighted mean of every weighted term by road, their sum, and what is missing to a target."""
    w = F.sum(weight)
    mean = lambda c: F.sum(F.col(c) * F.col(weight)) / w
    out = df.groupBy(by).agg(*[(F.lit(v) * mean(c)).alias(f"t_{c}") for c, v in terms.items()])
    raw = sum((F.col(f"t_{c}") for c in terms), F.lit(0.0))
    return out.withColumn("raw", raw).withColumn("missing", F.greatest(F.lit(0.0), target_raw - F.col("raw")))


def candidates(df: DataFrame, specs: dict[str, Column], positive: str, high: float, least_auc: float, most_high: float) -> DataFrame:
    """candidate, auc, high_share, passes: every candidate score over the same rows, with its two bars."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("candidate"), e.alias("score")) for k, e in specs.items()])).alias("c")
    rows = df.select(positive, each).select(positive, "c.*")
    a = stats.auc(rows, ["candidate"], "score", positive).select("candidate", "auc")
    s = rows.groupBy("candidate").agg(share(F.col("score") >= high).alias("high_share"))
    return a.join(s.hint("merge"), "candidate").withColumn("passes", (F.col("auc") >= least_auc) & (F.col("high_share") <= most_high))


def cap_sweep(df: DataFrame, feature: str, caps: list[float], other: str, weight: float, by: str, label: str, high: float) -> DataFrame:
    """cap, by, auc, share_high: what one cap of a feature for everyone does to scores, group by group.

    df: length_m, score_adj, the raw sum of all ``other`` terms, the feature and a label (0 or 1). At a cap the
    feature counts as its share of the cap, at most 1; auc is the label's, by length.
    """
    each = df.withColumn("cap", F.explode(F.array(*map(F.lit, caps))))
    raw = F.col(other) + weight * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(feature) / F.col("cap")))
    each = each.withColumn("at_", F.round(composite(raw, F.col("score_adj")), 9))
    a = stats.auc(each, ["cap", by], "at_", label, F.col("length_m")).select("cap", by, "auc")
    part = F.sum(F.when(F.col("at_") >= high, F.col("length_m")).otherwise(0.0)) / F.sum("length_m")
    return a.join(each.groupBy("cap", by).agg(part.alias("share_high")).hint("merge"), ["cap", by])


def slot_sources(df: DataFrame, sources: dict[str, Column], other: str, weight: float, by: str, label: str, moved: float = 0.25) -> DataFrame:
    """source, by, covered, auc, moved_km, mean: several sources tried in one slot of the score, against the first of them.

    covered: share of length where a source says a half or more; auc: of the label, by
    length; moved_km: km whose score lies more than ``moved`` from that with the first source.
    """
    (first, base), *_ = sources.items()
    score = lambda c: F.round(composite(F.col(other) + weight * F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), F.col("score_adj")), 9)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("source"), c.alias("share"), score(c).alias("score")) for k, c in sources.items()]))
    each = df.withColumn("was_", score(base)).withColumn("s_", kinds).select("*", "s_.source", "s_.share", F.col("s_.score").alias("now_"))
    m = F.col("length_m")
    part = lambda c: F.sum(F.when(c, m).otherwise(0.0))
    sums = each.groupBy("source", by).agg((part(F.col("share") >= 0.5) / F.sum(m)).alias("covered"), (part(F.abs(F.col("now_") - F.col("was_")) > moved) / 1000).alias("moved_km"), (F.sum(F.col("now_") * m) / F.sum(m)).alias("mean"))
    return stats.auc(each, ["source", by], "now_", label, m).select("source", by, "auc").join(sums.hint("merge"), ["source", by])


def exposure(route: DataFrame) -> DataFrame:
    """trip, closed_m, inner_private_m, unpaved_m: metres on closed, on private between the first and last public edge, on unpaved.

    route: trip, seq, length_m, closed, private, unpaved.
    """
    w = Window.partitionBy("trip")
    public = F.when(~F.col("private"), F.col("seq"))
    r = route.withColumns({"first_": F.min(public).over(w), "last_": F.max(public).over(w)})
    inner = F.col("private") & (F.col("seq") > F.col("first_")) & (F.col("seq") < F.col("last_"))
    m = lambda c: F.sum(F.when(F.coalesce(c, F.lit(False)), F.col("length_m")).otherwise(0.0))
    return r.groupBy("trip").agg(m(F.col("closed")).alias("closed_m"), m(inner).alias("inner_private_m"), m(F.col("unpaved")).alias("unpaved_m"))


def answered(trips: DataFrame, by: str) -> DataFrame:
    """by, trips, answered, refused, on_seasonal, minutes: trips by run, each trip once (the first by seq)."""
    first = trips.groupBy(by, "trip").agg(F.min(F.struct("seq", "ok", "seasonal", "minutes")).alias("m")).select(by, "m.*")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return first.groupBy(by).agg(F.count(F.lit(1)).alias("trips"), n(F.col("ok")).alias("answered"), n(~F.col("ok")).alias("refused"), share(F.col("seasonal") & F.col("ok")).alias("on_seasonal"), F.avg(F.when(F.col("ok"), F.col("minutes"))).alias("minutes"))


def policy_frontier(use: DataFrame, masks: DataFrame) -> DataFrame:
    """policy, trip_days, open_days, risk, stranded, kept: what a policy of closures does to trips.

    use: trip, day, edge, risk, beauty, minutes; masks: policy, edge, day (closed then). A
    trip-day is open where none of its edges is closed; its risk is that of its worst edge.
    """
    policies = masks.select("policy").distinct()  # few
    both = use.join(F.broadcast(policies), F.lit(True)).join(masks.withColumn("shut", F.lit(1)).hint("merge"), ["policy", "edge", "day"], "left")
    t = both.groupBy("policy", "trip", "day").agg(F.max(F.coalesce("shut", F.lit(0))).alias("shut"), F.max("risk").alias("risk"), F.sum("beauty").alias("beauty"), F.sum("minutes").alias("minutes"))
    is_open = F.col("shut") == 0
    return t.groupBy("policy").agg(F.count(F.lit(1)).alias("trip_days"), F.sum(is_open.cast("int")).alias("open_days"), F.avg(F.when(is_open, F.col("risk"))).alias("risk"), F.sum(F.when(is_open, 0.0).otherwise(F.col("minutes"))).alias("stranded"), F.sum(F.when(is_open, F.col("beauty")).otherwise(0.0)).alias("kept"))


def choose_policy(results: DataFrame, bar: float, samples: int, n: int = 5) -> DataFrame:
    """The ``n`` policies that keep at least ``bar`` on every one of ``samples`` samples, least stranded first (a report)."""
    ok = results.groupBy("policy").agg(F.min("kept").alias("least_kept"), F.countDistinct("sample").alias("n_"), F.sum("stranded").alias("stranded"))
    return ok.where((F.col("least_kept") >= bar) & (F.col("n_") == samples)).drop("n_").orderBy("stranded", "policy").limit(n)


def arm_statistics(pairs: DataFrame, by: str) -> DataFrame:
    """by, pairs, same, no_gain, small_gain, long: how the scenic arm differs from the fast one. pairs: extra_km, gain_km, km."""
    gain = F.col("gain_km") / 1.609344
    return stats.with_percentiles(pairs, [by], "extra_km", (0.5, 0.9), F.count(F.lit(1)).alias("pairs"), share(F.col("extra_km") == 0).alias("same"), share(F.col("gain_km") <= 0).alias("no_gain"), share(gain < 0.5).alias("small_gain"), share(F.col("extra_km") > 0.25 * F.col("km")).alias("long"))


def drive_summary(runs: DataFrame) -> DataFrame:
    """persona, category, staged, runs, p50, p90: recorded values by persona and category, what was not staged apart."""
    out = stats.with_percentiles(runs, ["persona", "category", "staged"], "value", (0.5, 0.9), F.count(F.lit(1)).alias("runs"))
    return out.select("persona", "category", "staged", "runs", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"))


def excess(points: DataFrame, bands: list[float]) -> DataFrame:
    """band, trips, p50, p90, p99: how much longer than the straight line the way over a trip's farthest point is.

    points: trip, d1, d2 (to either end), d (straight).
    """
    t = points.groupBy("trip").agg((F.max(F.col("d1") + F.col("d2")) - F.max("d")).alias("excess"), F.max("d").alias("d"))
    band = sum((F.when(F.col("d") >= b, 1).otherwise(0) for b in bands), F.lit(0))
    out = stats.with_percentiles(t.withColumn("band", band), ["band"], "excess", (0.5, 0.9, 0.99), F.count(F.lit(1)).alias("trips"))
    return out.select("band", "trips", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"), F.col("p")[2].alias("p99"))


def strengths(routes: DataFrame, settings: list[float]) -> DataFrame:
    """trip, strength, option: the route that owns each setting of a slider; routes: trip, option, low, high."""
    s = routes.withColumn("strength", F.explode(F.array(*[F.lit(x) for x in settings])))
    return s.where("strength >= low and strength < high").select("trip", "strength", "option")


def decisive(df: DataFrame, base: str, candidate: str, least_m: float, high: float = 7.0) -> DataFrame:
    """name, km, group, verdict: paved named roads and which of two scores lifts them over ``high``."""
    w = F.sum("length_m")
    mean = lambda c: F.sum(F.col(c) * F.col("length_m")) / w
    sizes = df.groupBy("name", "group").agg(w.alias("m_"))
    modal = sizes.groupBy("name").agg(F.min(F.struct((-F.round("m_", 6)).alias("less"), "group")).alias("g")).select("name", F.col("g.group").alias("group"))
    r = df.groupBy("name").agg((w / 1000).alias("km"), mean(base).alias("b_"), mean(candidate).alias("c_")).where(F.col("km") * 1000 >= least_m)
    over_b, over_c = F.round("b_", 9) >= high, F.round("c_", 9) >= high
    verdict = F.when(over_b & over_c, "both").when(over_b, "base only").when(over_c, "candidate only").otherwise("neither")
    return r.join(modal.hint("merge"), "name").select("name", "km", "group", verdict.alias("verdict"))


def interval_draws(edges: DataFrame, draws: DataFrame, rows: int = 100_000) -> DataFrame:
    """draw, edge, offset: draws at places of the total length, each with the edge that holds its place.

    edges: edge, mm (whole millimetres, so sums are exact); draws: draw, u (0 to 1). Edges are in the order
    of their ids and cut into ranges of about ``rows``: a range's sum tells where it begins,
    and inside it running sums and places are merged in one sort, without pairs. Draws find
    their range by slices of the total length, so neither edges nor draws are held against all ranges.
    """
    n = max(1, -(-edges.count() // rows))
    e = stage(edges.repartitionByRange(n, "edge").select("edge", "mm", F.spark_partition_id().alias("range")), "ranges")
    sums = e.groupBy("range").agg(F.sum("mm").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # as many rows as ranges
    sums = stage(sums.where("m > 0"), "sums")
    whole = sums.agg(F.sum("m").alias("total")).withColumn("wide", F.greatest(F.lit(1), F.ceil(F.col("total") / n)).cast("long"))  # one row
    # A place at the very end is the last edge's.
    stop = F.col("before") + F.col("m") + (F.col("before") + F.col("m") == F.col("total")).cast("long")
    at = sums.join(F.broadcast(whole), F.lit(True)).withColumn("stop", stop)
    at = at.withColumn("slice", F.explode(F.sequence(F.expr("before div wide"), F.expr("(stop - 1) div wide")))).select("slice", "range", "before", "stop")
    d = draws.join(F.broadcast(whole), F.lit(True)).withColumn("place", F.floor(F.col("u") * F.col("total"))).withColumn("slice", F.expr("place div wide"))
    d = d.join(at.hint("merge"), "slice").where("place >= before and place < stop").select("draw", "range", (F.col("place") - F.col("before")).alias("place"))
    own = Window.partitionBy("range").orderBy("edge").rowsBetween(Window.unboundedPreceding, 0)
    starts = e.withColumn("place", F.sum("mm").over(own) - F.col("mm")).where("mm > 0")
    both = starts.select("range", "place", F.struct("edge", "place").alias("e"), F.lit(None).cast("long").alias("draw")).unionByName(d.select("range", "place", F.lit(None).cast("struct<edge:bigint,place:bigint>").alias("e"), F.col("draw").cast("long").alias("draw")))
    last = F.last("e", ignorenulls=True).over(Window.partitionBy("range").orderBy("place", F.col("draw").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("e", last).where("draw is not null").select("draw", "e.edge", (F.col("place") - F.col("e.place")).alias("offset"))


def offset_ends(draws: DataFrame, x: str, y: str, near_m: float, far_m: float) -> DataFrame:
    """``draws`` with the other end of a trip (tx, ty): at a seeded distance and bearing from (x, y). Needs columns v, w (0 to 1)."""
    d, b = near_m + (far_m - near_m) * F.col("v"), F.radians(360.0 * F.col("w"))
    return draws.withColumns({"tx": F.col(x) + d * F.sin(b), "ty": F.col(y) + d * F.cos(b)})


def first_difference(before: DataFrame, after: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Answers of the same request by the first column in ``order`` that differs: new, gone, a column, or same."""
    a = before.select(key, F.struct(*order).alias("a_"))
    b = after.select(key, F.struct(*order).alias("b_"))
    kind = F.when(F.col("a_").isNull(), "new").when(F.col("b_").isNull(), "gone")
    for c in order:
        kind = kind.when(~F.col(f"a_.{c}").eqNullSafe(F.col(f"b_.{c}")), c)
    return a.join(b.hint("merge"), key, "full").select(key, kind.otherwise("same").alias("difference"))


def nodes_beside(refs: DataFrame) -> DataFrame:
    """way_id, via, beside: the nodes before and after every node of a way. refs: way_id, n, node_id."""
    w = Window.partitionBy("way_id").orderBy("n")
    r = refs.withColumns({"prev": F.lag("node_id").over(w), "next": F.lead("node_id").over(w)})
    return r.select("way_id", F.col("node_id").alias("via"), F.explode(F.array_compact(F.array("prev", "next"))).alias("beside"))


def turn_triples(refs: DataFrame, restrictions: DataFrame) -> DataFrame:
    """kind, before, via, after: restrictions between ways as triples of nodes, on either side of the shared node.

    refs: way_id, n, node_id; restrictions: kind, from_way, via, to_way.
    """
    beside = nodes_beside(refs)
    a = restrictions.join(beside.select(F.col("way_id").alias("from_way"), "via", F.col("beside").alias("before")).hint("merge"), ["from_way", "via"])
    return a.join(beside.select(F.col("way_id").alias("to_way"), "via", F.col("beside").alias("after")).hint("merge"), ["to_way", "via"]).select("kind", "before", "via", "after").distinct()


def class_triples(refs: DataFrame, classes: Column, restricted: Column, kind: Column) -> DataFrame:
    """What :func:`turn_triples` gives where a rule on the classes of two ways says whether they restrict each other.

    classes: a way's class, from way_id; restricted and kind: from from_class and to_class. All
    ways of a class that leave a node on the same side are one row with their first and last
    way, so a node costs the pairs of its classes and sides, however many ways cross there.
    No way restricts itself.
    """
    sides = nodes_beside(refs).groupBy("via", "beside", classes.alias("class")).agg(F.min("way_id").alias("low"), F.max("way_id").alias("high"))
    sides = stage(sides, "sides")
    a = sides.select("via", F.col("beside").alias("before"), F.col("class").alias("from_class"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    b = sides.select("via", F.col("beside").alias("after"), F.col("class").alias("to_class"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    others = (F.col("a_low") != F.col("b_high")) | (F.col("a_high") != F.col("b_low"))
    return a.join(b.hint("merge"), "via").where(restricted & others).select(kind.alias("kind"), "before", "via", "after").distinct()


def illegal_turns(route: DataFrame, triples: DataFrame) -> DataFrame:
    """trip, via, why: turns of a route that a triple forbids, or an only-movement that was not taken. route: trip, seq, node."""
    w = Window.partitionBy("trip").orderBy("seq")
    t = route.withColumns({"before": F.lag("node").over(w), "after": F.lead("node").over(w)}).where("before is not null and after is not null").withColumnRenamed("node", "via").select("trip", "before", "via", "after")
    no = triples.where(F.col("kind").startswith("no_")).select("before", "via", "after").distinct()
    only = triples.where(F.col("kind").startswith("only_")).select("before", "via", "after").distinct()
    bad = t.join(no.hint("merge"), ["before", "via", "after"], "left_semi").select("trip", "via", F.lit("banned").alias("why"))
    bound = t.join(only.select("before", "via").distinct().hint("merge"), ["before", "via"], "left_semi")
    missed = bound.join(only.hint("merge"), ["before", "via", "after"], "left_anti").select("trip", "via", F.lit("only").alias("why"))
    return bad.unionByName(missed).distinct()


def silent_forks(route: DataFrame, arcs: DataFrame, told: DataFrame) -> DataFrame:
    """trip, node: junctions where a rival road runs straighter than the one taken, or within 45 degrees of it, untold.

    route: trip, node, came, took (bearings), edge_in, edge_out; arcs: node, edge, bearing; told: trip, node.
    """
    turn = lambda a, b: F.abs(F.pmod(b - a + 540.0, F.lit(360.0)) - 180.0)
    r = route.join(arcs.withColumnsRenamed({"edge": "rival", "bearing": "rival_bearing"}).hint("merge"), "node").where("rival <> edge_in and rival <> edge_out")
    r = r.withColumns({"own_turn": turn(F.col("came"), F.col("took")), "rival_turn": turn(F.col("came"), F.col("rival_bearing")), "between": turn(F.col("took"), F.col("rival_bearing"))})
    fork = (F.col("rival_turn") <= 150) & ((F.col("rival_turn") < F.col("own_turn")) | (F.col("between") <= 45))
    return r.where(fork).select("trip", "node").distinct().join(told.select("trip", "node").hint("merge"), ["trip", "node"], "left_anti")
