"""Batch routing on the tables of a network: private roads, barriers, loops, splices, snapping.

Many trips are worked on at once. Each search keeps to the nodes its corridor or disc
names, so that its state is bounded by trips and not by the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viamark.functions.geometry import folded, to_segment
from viamark.operators.components import components
from viamark.operators.spatial import CELL, cells_of_box, nearest_of
from viamark.plans.tables import Appended, Bucketed, stage

# Loops, splices, snapping, private roads, unpaved penalty of old tables.
PENALTY, TOLERANCE, MIN_SECTOR, MIN_LEG_KM, PICKS = 3.0, 0.10, 5, 0.5, 5
FIRST_GAIN_KM, SLACK_M, HEADING_DEG = 0.805, 20.0, 40.0
SWITCH_POINTS, SWITCH_STEP_KM = 40, 0.3
PRIVATE_PER_KM, PRIVATE_ENTRY, LEGACY_UNPAVED = 10.0, 10_000.0, -0.25


def fields(arcs: DataFrame, starts: DataFrame, within: DataFrame | None, cost: str, carry: tuple[str, ...] = (), penalties: DataFrame | None = None, graph: str | None = None, limit: float | None = None) -> DataFrame:
    """trip, node, cost, pred and sums of ``carry`` along the cheapest path from each trip's start.

    arcs: tail, head, cost, carry; starts: trip, node; within: trip, node (what each trip may
    use); penalties: trip, tail, head, factor (its own price of an arc); graph: a column of
    arcs and starts that keeps networks apart; limit: the greatest cost. Only nodes that have become cheaper are
    relaxed again; costs fall each round and are bounded below, so rounds end. A round writes
    what has become cheaper and reads the buckets of the trips that are still under way.
    """
    own = [graph] if graph else []
    hops = arcs.select(*own, F.col("tail").alias("node"), F.col("head").alias("next"), F.col(cost).alias("w_"), *[F.col(c).alias(f"{c}_") for c in carry])
    zero = [F.lit(0.0).alias(c) for c in carry]
    key = [*own, "trip", "node"]
    best = lambda rows: rows.groupBy(*key).agg(F.min(F.struct("cost", "pred", *carry)).alias("m")).select(*key, "m.*")
    state = Bucketed(arcs.sparkSession, "state", ["trip"], best)
    front = state.append(starts.select(*key, F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("pred"), *zero))
    while front is not None:
        step = front.join(hops.hint("merge"), [*own, "node"])
        if penalties is not None:
            step = step.join(penalties.select("trip", F.col("tail").alias("node"), F.col("head").alias("next"), "factor").hint("merge"), ["trip", "node", "next"], "left").withColumn("w_", F.col("w_") * F.coalesce("factor", F.lit(1.0)))
        if limit is not None:
            step = step.where(F.col("cost") + F.col("w_") <= limit)
        step = step.select(*own, "trip", F.col("next").alias("node"), F.struct((F.col("cost") + F.col("w_")).alias("cost"), F.col("node").alias("pred"), *[(F.col(c) + F.col(f"{c}_")).alias(c) for c in carry]).alias("m"))
        if within is not None:
            step = step.join(within.select("trip", "node").hint("merge"), ["trip", "node"], "left_semi")
        step = step.groupBy(*key).agg(F.min("m").alias("m")).select(*key, "m.*")
        was = state.read(state.touched).groupBy(*key).agg(F.min("cost").alias("was"))
        front = state.append(step.join(was.hint("merge"), key, "left").where(F.col("was").isNull() | (F.col("cost") < F.col("was") - 1e-9)).drop("was"))
    return stage(best(state.read()), "field")


def path(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """trip, back, tail, head: the arcs from each trip's end (trip, node) back to its start.

    By pointer doubling: after k rounds the nodes within 2^k steps of an end are known, so a
    path of 2,000 arcs takes 11 rounds. A tree has no circles, so rounds end.
    """
    hops = tree.where("pred is not null").select("trip", "node", "pred")
    jump, far = hops.select("trip", "node", F.col("pred").alias("to")), 1
    known = Appended(ends.select("trip", "node", F.lit(0).alias("back")), "back")
    while True:
        # The nodes known so far lie less than ``far`` steps back; a jump goes ``far`` steps.
        known.append(known.all().join(jump.hint("merge"), ["trip", "node"]).select("trip", F.col("to").alias("node"), (F.col("back") + far).alias("back")))
        if known.last.isEmpty():
            break
        ahead = jump.select("trip", F.col("node").alias("to"), F.col("to").alias("next"))
        jump = stage(jump.join(ahead.hint("merge"), ["trip", "to"]).select("trip", "node", F.col("next").alias("to")), "jump")
        far *= 2
    return stage(known.all().join(hops.hint("merge"), ["trip", "node"]).select("trip", "back", F.col("pred").alias("tail"), F.col("node").alias("head")), "path")


def reversed_arcs(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.col("head").alias("tail"), F.col("tail").alias("head"), *[c for c in arcs.columns if c not in ("tail", "head")])


def disc(starts: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """trip, node, d: nodes within ``radius`` of each trip's start. starts: trip, x, y; nodes: node, x, y."""
    size = max(radius, CELL)
    box = cells_of_box(F.col("x") - radius, F.col("y") - radius, F.col("x") + radius, F.col("y") + radius, size)
    cut = starts.select("trip", F.col("x").alias("sx"), F.col("y").alias("sy"), F.explode(box).alias("cell")).select("trip", "sx", "sy", "cell.cx", "cell.cy")
    at = nodes.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    d = F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2)
    return at.join(cut.hint("merge"), ["cx", "cy"]).select("trip", "node", d.alias("d")).where(F.col("d") <= radius)


def cell_counts(nodes: DataFrame, cell: float = CELL) -> DataFrame:
    """cx, cy, n: nodes in each cell of a grid."""
    return nodes.groupBy(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.count(F.lit(1)).alias("n"))


def longest_loop(starts: DataFrame, counts: DataFrame, most_nodes: int, reach: float, cell: float = CELL) -> DataFrame:
    """trip, radius: the distance of the first cell with which the disc around a start holds more than ``most_nodes``; ``reach`` where none has.

    starts: trip, x, y; counts: cx, cy, n. A cell counts whole, at the distance of its
    middle, so a start costs as many rows as there are cells within ``reach`` and no node.
    """
    box = cells_of_box(F.col("x") - reach - cell, F.col("y") - reach - cell, F.col("x") + reach + cell, F.col("y") + reach + cell, cell)
    near = starts.select("trip", "x", "y", F.explode(box).alias("c")).select("trip", "x", "y", "c.cx", "c.cy").join(counts.hint("merge"), ["cx", "cy"])
    middle = lambda c: (F.col(c) + 0.5) * cell
    d = F.sqrt((middle("cx") - F.col("x")) ** 2 + (middle("cy") - F.col("y")) ** 2)
    at = near.withColumn("d", F.round(d, 6)).withColumn("held", F.sum("n").over(Window.partitionBy("trip").orderBy("d", "cx", "cy").rowsBetween(Window.unboundedPreceding, 0)))
    full = at.where((F.col("held") > most_nodes) & (F.col("d") <= reach)).groupBy("trip").agg(F.min("d").alias("radius"))
    return starts.select("trip").join(full.hint("merge"), "trip", "left").withColumn("radius", F.coalesce("radius", F.lit(float(reach))))


def nearest_source(edges: DataFrame, sources: DataFrame, cost: str) -> DataFrame:
    """node, source, cost: the source that is nearest over the undirected edges, for every node a source reaches."""
    ways = edges.select(F.col("u").alias("node"), F.col("v").alias("next"), F.col(cost).alias("w_"))
    ways = ways.unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("next"), F.col(cost).alias("w_")))
    ways = stage(ways.groupBy("node", "next").agg(F.min("w_").alias("w_")), "ways")
    best = lambda rows: rows.groupBy("node").agg(F.min(F.struct("cost", "source")).alias("m")).select("node", "m.*")
    state = Bucketed(edges.sparkSession, "state", ["node"], best)
    front = state.append(sources.select("node", F.lit(0.0).alias("cost"), F.col("node").alias("source")))
    while front is not None:
        step = best(front.join(ways.hint("merge"), "node").select(F.col("next").alias("node"), (F.col("cost") + F.col("w_")).alias("cost"), "source"))
        was = state.read().groupBy("node").agg(F.min("cost").alias("was"))
        front = state.append(step.join(was.hint("merge"), "node", "left").where(F.col("was").isNull() | (F.col("cost") < F.col("was") - 1e-9)).select("node", "cost", "source"))
    return stage(best(state.read()).select("node", "source", "cost"), "nearest")


def dirt_fraction(edges: DataFrame, dirt: DataFrame, class_adjust: Column) -> DataFrame:
    """``edges`` with ``dirt``: the stored unpaved share; from an old table's adjustment where there is none; 1 on edges of ``dirt``.

    edges: edge, unpaved_frac (null in old tables), score_adj; dirt: edge, from state and map tables.
    """
    legacy = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score_adj") - class_adjust) / LEGACY_UNPAVED))
    called = dirt.select("edge", F.lit(1.0).alias("called_")).distinct()
    return edges.join(called.hint("merge"), "edge", "left").withColumn("dirt", F.coalesce("called_", "unpaved_frac", legacy)).drop("called_")


def private_costs(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edge, tail, extra) of private arcs, and the nodes on private road off the main public network.

    edges: edge, u, v, km, private, closed. A private kilometre costs, and leaving the largest
    component of public edges onto private road costs once more.
    """
    public = edges.where("not private and not closed").select(F.col("u").alias("a"), F.col("v").alias("b"))
    comp = components(public)
    loops = public.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root")).distinct().join(comp.select("node").hint("merge"), "node", "left_anti")
    comp = stage(comp.unionByName(loops), "public")
    sizes = comp.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.agg(F.min(F.struct((-F.col("n")).alias("less"), "root")).alias("m")).select(F.col("m.root").alias("root"))
    core = comp.join(F.broadcast(main), "root").select("node")  # one row is broadcast
    own = edges.where("private")
    arcs = own.select("edge", F.col("u").alias("tail"), "km").unionByName(own.select("edge", F.col("v").alias("tail"), "km"))
    marked = arcs.join(core.select(F.col("node").alias("tail"), F.lit(True).alias("core")).hint("merge"), "tail", "left")
    extra = PRIVATE_PER_KM * F.col("km") + F.when(F.col("core"), PRIVATE_ENTRY).otherwise(0.0)
    inside = arcs.select(F.col("tail").alias("node")).distinct().join(core.hint("merge"), "node", "left_anti")
    return marked.select("edge", "tail", extra.alias("extra")), inside


def split_junctions(arcs: DataFrame, bans: DataFrame) -> DataFrame:
    """Arcs between (node, approach) pairs: one copy of a junction for each approach that may not go everywhere.

    arcs: edge, tail, head; bans: via, from_edge, to_edge. approach is 0 on the junction itself;
    an arc that comes in by a banned approach ends on its copy, whose exits are all but the banned ones.
    """
    copies = bans.select("via", "from_edge").distinct()
    into = copies.select(F.col("via").alias("head"), F.col("from_edge").alias("edge"), F.col("from_edge").alias("head_copy"))
    base = arcs.join(into.hint("merge"), ["head", "edge"], "left").withColumn("head_copy", F.coalesce("head_copy", F.lit(0).cast("long")))
    exits = base.join(copies.select(F.col("via").alias("tail"), F.col("from_edge").alias("tail_copy")).hint("merge"), "tail")
    banned = bans.select(F.col("via").alias("tail"), F.col("from_edge").alias("tail_copy"), F.col("to_edge").alias("edge")).distinct()
    exits = exits.join(banned.hint("merge"), ["tail", "tail_copy", "edge"], "left_anti")
    cols = ["edge", "tail", "tail_copy", "head", "head_copy"]
    return base.withColumn("tail_copy", F.lit(0).cast("long")).select(*cols).unionByName(exits.select(*cols))


def through_bans(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """via, from_edge, to_edge: at a barrier between edges no movement from one edge to another."""
    at = nodes.select("node").distinct()
    come = arcs.select(F.col("head").alias("node"), F.col("edge").alias("from_edge")).join(at.hint("merge"), "node", "left_semi")
    leave = arcs.select(F.col("tail").alias("node"), F.col("edge").alias("to_edge"))
    return come.join(leave.hint("merge"), "node").where("from_edge <> to_edge").select(F.col("node").alias("via"), "from_edge", "to_edge").distinct()


def loop_candidates(out: DataFrame, back: DataFrame, target_km: float, inside: DataFrame | None = None) -> DataFrame:
    """trip, node, km, out_km, scenic: turnarounds of loops of about ``target_km`` (both fields: trip, node, cost in km, scenic)."""
    b = back.select("trip", "node", F.col("cost").alias("back_km"), F.col("scenic").alias("back_scenic"))
    c = out.join(b.hint("merge"), ["trip", "node"]).withColumns({"km": F.col("cost") + F.col("back_km"), "scenic": F.col("scenic") + F.col("back_scenic")})
    c = c.where((F.abs(F.col("km") - target_km) <= TOLERANCE * target_km) & (F.col("cost") >= MIN_LEG_KM))
    if inside is not None:
        c = c.join(inside.hint("merge"), "node", "left_anti")
    return c.select("trip", "node", "km", F.col("cost").alias("out_km"), "scenic")


def spread(candidates: DataFrame, target_km: float, picks: int = PICKS) -> DataFrame:
    """trip, slice, node, km: the best scenic rate in each of ``picks`` slices of length; ties take the smallest node."""
    low, width = target_km * (1 - TOLERANCE), 2 * TOLERANCE * target_km / picks
    part = F.floor((F.col("km") - low) / width).cast("int")
    best = F.min(F.struct((-F.round(F.col("scenic") / F.greatest("km", F.lit(1e-9)), 9)).alias("less"), "node", "km"))
    c = candidates.withColumn("slice", part).where((F.col("slice") >= 0) & (F.col("slice") < picks))
    return c.groupBy("trip", "slice").agg(best.alias("m")).select("trip", "slice", "m.node", "m.km")


def snap_heading(fixes: DataFrame, segs: DataFrame, reach: float, slack: float = SLACK_M, angle: float = HEADING_DEG) -> DataFrame:
    """pid, edge, ahead: the nearest edge, or one within ``slack`` more that runs along the heading, and its end ahead.

    fixes: pid, x, y, heading; segs: edge, ax, ay, bx, by, bearing, u, v. The nearest edge is
    kept where it is aligned, or where none other within the slack is.
    """
    size, d = max(reach + slack, CELL), reach + slack
    touched = cells_of_box(F.least("ax", "bx") - d, F.least("ay", "by") - d, F.greatest("ax", "bx") + d, F.greatest("ay", "by") + d, size)
    # Of edges that lie alike, with all their segments, only the one with the smallest number can be chosen.
    whole = segs.groupBy("edge", "u", "v").agg(F.array_sort(F.collect_list(F.struct("ax", "ay", "bx", "by", "bearing"))).alias("parts"))
    segs = whole.groupBy("u", "v", "parts").agg(F.min("edge").alias("edge")).select("edge", "u", "v", F.inline("parts"))
    cut = segs.withColumn("cell", F.explode(touched)).select("*", "cell.cx", "cell.cy").drop("cell")
    at = fixes.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    dist, _ = to_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    c = at.join(cut.hint("merge"), ["cx", "cy"]).withColumn("dist", dist).where(F.col("dist") <= d).withColumn("off", folded(F.col("heading"), F.col("bearing")))
    one = F.min(F.struct("dist", "off", "bearing", "u", "v", "heading"))
    c = c.groupBy("pid", "edge").agg(one.alias("m")).select("pid", "edge", "m.*")
    w = Window.partitionBy("pid")
    c = c.withColumns({"least": F.min("dist").over(w), "nearest": F.min(F.struct("dist", "edge")).over(w)})
    c = c.withColumn("keep_near", F.max(F.when(F.col("edge") == F.col("nearest.edge"), F.col("off") <= angle)).over(w))
    c = c.where((F.col("least") <= reach) & (F.col("dist") <= F.col("least") + slack))
    is_near = F.col("edge") == F.col("nearest.edge")
    rank = F.when(F.col("keep_near"), F.when(is_near, 0.0).otherwise(999.0)).otherwise(F.when(F.col("off") <= angle, F.col("off")).otherwise(F.when(is_near, 500.0).otherwise(999.0)))
    best = c.groupBy("pid").agg(F.min(F.struct(rank.alias("rank"), "edge", "heading", "bearing", "u", "v")).alias("m")).select("pid", "m.*")
    turn = F.abs(F.pmod(F.col("bearing") - F.col("heading") + 540.0, F.lit(360.0)) - 180.0)
    return best.select("pid", "edge", F.when(turn <= 90, F.col("v")).otherwise(F.col("u")).alias("ahead"))


def entrances(points: DataFrame, access: DataFrame, roads: DataFrame, entries: DataFrame) -> DataFrame:
    """pid, component, node: the nearest entry of the access road that is nearer to a point than any road.

    points: pid, x, y; access: pid, component, dist and roads: pid, dist (nearest of each);
    entries: component, node, x, y.
    """
    near = access.join(roads.select("pid", F.col("dist").alias("to_road")).hint("merge"), "pid").where("dist < to_road")
    at = near.select("pid", "component").join(points.hint("merge"), "pid")
    return nearest_of(at.select("pid", "component", "x", "y"), entries, "component", "node", CELL).select("pid", "component", "node")


def traversed(route: DataFrame, edges: DataFrame) -> DataFrame:
    """trip, seq, edge, flip, covered: edges under a route's steps with the share that was driven.

    route: trip, seq, a, b (nodes), start, stop (metres along), low, high (driven range);
    edges: edge, u, v, length_m. Of parallel edges the one whose length fits the step is taken;
    an edge that runs the other way is taken only where none runs this way.
    """
    r = route.where("stop > low and start < high").withColumn("span", F.col("stop") - F.col("start"))
    fwd = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "edge", "length_m", F.lit(False).alias("flip"))
    both = fwd.unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b"), "edge", "length_m", F.lit(True).alias("flip")))
    # Of edges as long between the same nodes only the one with the smallest number can be chosen.
    both = both.groupBy("a", "b", "flip", "length_m").agg(F.min("edge").alias("edge"))
    best = r.join(both.hint("merge"), ["a", "b"]).groupBy("trip", "seq", "start", "stop", "low", "high", "span").agg(F.min(F.struct("flip", F.round(F.abs(F.col("length_m") - F.col("span")), 6).alias("miss"), "edge")).alias("m"))
    share = (F.least("stop", "high") - F.greatest("start", "low")) / F.col("span")
    return best.select("trip", "seq", "m.edge", "m.flip", F.when(F.col("span") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(0.0).alias("covered"))


def rotary_exits(route: DataFrame, leaves: DataFrame) -> DataFrame:
    """trip, island, exits: on each rotary of a route, the nodes passed after the entry from which a road leaves.

    route: trip, seq, node (end of the step), rotary; leaves: node.
    """
    w = Window.partitionBy("trip").orderBy("seq")
    r = route.withColumn("new", (F.col("rotary") & ~F.coalesce(F.lag("rotary").over(w), F.lit(False))).cast("int"))
    r = r.withColumn("island", F.sum("new").over(w)).where("rotary")
    r = r.join(leaves.select("node", F.lit(1).alias("leaves")).distinct().hint("merge"), "node", "left")
    return r.groupBy("trip", "island").agg(F.sum(F.coalesce("leaves", F.lit(0))).alias("exits"))


def switch_points(line: DataFrame, points: int = SWITCH_POINTS, step_km: float = SWITCH_STEP_KM) -> DataFrame:
    """Rows of ``line`` (trip, pos, km along it, ...) where a splice may leave or come back.

    Along each path the next point is the first one a step further on than the last point,
    where a step is the path's length over ``points``, or ``step_km`` if that is more; the
    last node is one besides. So a path has ``points`` + 2 of them at most.
    """
    whole = line.groupBy("trip").agg(F.max("km").alias("whole"), F.max("pos").alias("last"))
    on = line.join(whole.hint("merge"), "trip").withColumn("step", F.greatest(F.lit(step_km), F.col("whole") / points))
    ahead = on.select("trip", "pos", "km", "step")
    # The first row a step on from each row: one sort of rows and their marks together.
    both = ahead.select("trip", F.col("km").alias("at"), F.lit(1).alias("row"), "pos").unionByName(ahead.select("trip", (F.col("km") + F.col("step") - 1e-9).alias("at"), F.lit(0).alias("row"), "pos"))
    nxt = F.first(F.when(F.col("row") == 1, F.col("pos")), ignorenulls=True).over(Window.partitionBy("trip").orderBy("at", "row", "pos").rowsBetween(1, Window.unboundedFollowing))
    links = both.withColumn("next", nxt).where("row = 0").select("trip", F.col("pos").alias("node"), F.col("next").alias("pred"))
    first = ahead.groupBy("trip").agg(F.min("pos").alias("node"))
    hit = path(stage(links, "links"), first)
    chosen = hit.select("trip", F.col("tail").alias("pos")).unionByName(first.select("trip", F.col("node").alias("pos"))).unionByName(whole.select("trip", F.col("last").alias("pos"))).distinct()
    return line.join(chosen.hint("merge"), ["trip", "pos"], "left_semi")


def frontier_of(options: DataFrame) -> DataFrame:
    """Options (trip, i, j, extra, gain) that no other betters: more gain than every option of less extra time.

    One sweep by extra time along each trip.
    """
    w = Window.partitionBy("trip").orderBy("extra", F.desc("gain"), "i", "j").rowsBetween(Window.unboundedPreceding, -1)
    return options.withColumn("most", F.max("gain").over(w)).where(F.col("most").isNull() | (F.col("gain") > F.col("most"))).drop("most")


def splices(scenic: DataFrame, ahead: DataFrame, behind: DataFrame, fast: DataFrame) -> DataFrame:
    """trip, i, j, extra, gain: fastest to node i of the scenic path, along it to node j, fastest on.

    scenic: trip, pos, node, minutes, beauty (sums along the path); ahead and behind: trip, node,
    cost, beauty (fast trees from the start and to the end); fast: trip, minutes, beauty.
    """
    s = scenic.select("trip", "pos", "node", "minutes", "beauty")
    a = s.join(ahead.select("trip", "node", F.col("cost").alias("m1"), F.col("beauty").alias("b1")).hint("merge"), ["trip", "node"]).select("trip", F.col("pos").alias("i"), (F.col("m1") - F.col("minutes")).alias("head_m"), (F.col("b1") - F.col("beauty")).alias("head_b"))
    b = s.join(behind.select("trip", "node", F.col("cost").alias("m2"), F.col("beauty").alias("b2")).hint("merge"), ["trip", "node"]).select("trip", F.col("pos").alias("j"), (F.col("m2") + F.col("minutes")).alias("tail_m"), (F.col("b2") + F.col("beauty")).alias("tail_b"))
    pairs = a.join(b.hint("merge"), "trip").where("i < j").join(fast.select("trip", F.col("minutes").alias("f_m"), F.col("beauty").alias("f_b")).hint("merge"), "trip")
    out = pairs.select("trip", "i", "j", F.round(F.col("head_m") + F.col("tail_m") - F.col("f_m"), 6).alias("extra"), F.round(F.col("head_b") + F.col("tail_b") - F.col("f_b"), 6).alias("gain"))
    return out.where("extra > 0 and gain > 1e-9")
