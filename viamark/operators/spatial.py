"""Spatial and interval joins as equi-joins on cells, with an exact test afterwards.

A distance alone as join condition plans as a nested loop; here one side is copied to the
cells it may touch and both are joined on the cell by sorting, so that a crowded cell spills
and can be split. Cells are as large as the distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viamark.functions.geometry import inside, point, segments, to_segment
from viamark.plans.tables import stage, stored_bytes


def cells_of_box(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """Array of struct(cx, cy): every cell a box touches."""
    across = F.sequence(F.floor(x0 / size), F.floor(x1 / size))
    up = F.sequence(F.floor(y0 / size), F.floor(y1 / size))
    return F.flatten(F.transform(across, lambda i: F.transform(up, lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def exploded(lines: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """key, ax, ay, bx, by: the segments of lines."""
    return lines.select(key, F.explode(segments(geom)).alias("s")).select(key, F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def outlines(rings: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """key, ax, ay, bx, by: the edges of closed rings."""
    closed = rings.withColumn(geom, F.concat(geom, F.slice(geom, 1, 1)))
    return exploded(closed, key, geom)


#: Cells are at least this wide, so that a long segment does not fall into hundreds of them.
CELL = 500.0


def _candidates(points: DataFrame, segs: DataFrame, key: str, d: float, cell: float | None) -> DataFrame:
    """pid, key, dist for points and segments that are within ``d``, with repeats of a key."""
    size = cell or max(d, CELL)
    touched = cells_of_box(F.least("ax", "bx") - d, F.least("ay", "by") - d, F.greatest("ax", "bx") + d, F.greatest("ay", "by") + d, size)
    cut = segs.withColumn("cell", F.explode(touched)).select(key, "ax", "ay", "bx", "by", "cell.cx", "cell.cy")
    at = points.select("pid", "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    dist, _ = to_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return at.join(cut.hint("merge"), ["cx", "cy"]).select("pid", key, dist.alias("dist")).where(F.col("dist") <= d)


def near_pairs(points: DataFrame, segs: DataFrame, key: str, d: float, cell: float | None = None) -> DataFrame:
    """pid, key, dist: the least distance of every point and feature within ``d``.

    points: pid, x, y; segs: key, ax, ay, bx, by (a point is a segment of no length).
    """
    return _candidates(points, segs, key, d, cell).groupBy("pid", key).agg(F.min("dist").alias("dist"))


#: Cells are halved while a layer has more features to a cell than this, on the average, and at most so many times.
PER_CELL, HALVINGS = 4.0, 8


def _boxed(segs: DataFrame, size: float) -> DataFrame:
    """Segments (with their own ``reach``) copied to the cells of ``size`` that they may touch."""
    d = F.col("reach")
    touched = cells_of_box(F.least("ax", "bx") - d, F.least("ay", "by") - d, F.greatest("ax", "bx") + d, F.greatest("ay", "by") + d, size)
    return segs.withColumn("cell_", F.explode(touched)).select("*", F.col("cell_.cx").alias("cx"), F.col("cell_.cy").alias("cy")).drop("cell_")


def _middle(size: float) -> tuple[Column, Column, Column]:
    """Distance of a segment to the middle of its cell, and half a cell's diagonal, a little widened."""
    return (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, F.lit(size * 0.7072 + 1e-6)


def _halved(cells: DataFrame) -> DataFrame:
    half = F.array(F.lit(0), F.lit(1))
    out = cells.withColumn("i_", F.explode(half)).withColumn("j_", F.explode(half))
    return out.withColumns({"cx": F.col("cx") * 2 + F.col("i_"), "cy": F.col("cy") * 2 + F.col("j_")}).drop("i_", "j_")


def _narrowed(cut: DataFrame, size: float, on: list[str]) -> DataFrame:
    """Segments by cell without those that are nearest to no place of their cell.

    If the nearest one is m from a cell's middle, no place in the cell is farther than m and half
    the diagonal from it, and none nearer than its own distance less that half to another one.
    """
    x, y, half = _middle(size)
    mid, _ = to_segment(x, y, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    near = cut.withColumn("mid_", mid).where(F.col("mid_") <= F.col("reach") + half)
    least = F.min("mid_").over(Window.partitionBy(*on, "kx", "ky", "cx", "cy"))
    return near.withColumn("least_", least).where(F.col("mid_") <= F.col("least_") + 2 * half).drop("mid_", "least_")


def _halvings(segs: DataFrame, size: float, layers: int) -> int:
    """How often cells of ``size`` are halved, by the number of features of a layer on the ground they cover."""
    x, y = F.col("ax"), F.col("ay")
    n, w, h = segs.agg(F.count(F.lit(1)), F.max(x) - F.min(x), F.max(y) - F.min(y)).first()
    if not n:
        return 0
    cells, times = layers * (w / size + 1) * (h / size + 1), 0
    while n > cells * PER_CELL * 4**times and times < HALVINGS:
        times += 1
    return times


def _fine(segs: DataFrame, d: float, cell: float, on: list[str], layers: int = 1) -> tuple[DataFrame, float]:
    """Features by cell that may be nearest to a place in it, and the cells' size.

    segs: staged; on, ax, ay, bx, by, reach (at most ``d``). Where features are many, cells begin wide and are halved,
    and each time those that cannot be nearest are dropped; a cell keeps a few, however many lie within the reach.
    """
    times = _halvings(segs, cell, layers)
    if not times:
        return _boxed(segs, cell), cell
    size = cell
    while size < 2 * d:
        size, times = size * 2, times + 1
    # All cells of one wide cell stay in one part, so that halving needs no shuffle; few bytes become many rows, so parts are not put together.
    parts = int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = _boxed(segs, size).withColumns({"kx": F.col("cx"), "ky": F.col("cy")}).repartition(parts, *on, "kx", "ky")
    for _ in range(times):
        cut = _halved(_narrowed(cut, size, on))
        size /= 2
    return _narrowed(cut, size, on).drop("kx", "ky"), size


def alike(segs: DataFrame, key: str) -> DataFrame:
    """Staged segments, those that lie alike once under the smallest of their keys."""
    return stage(segs.groupBy("ax", "ay", "bx", "by").agg(F.min(key).alias(key)), "segments")


def nearest_cells(segs: DataFrame, key: str, d: float) -> tuple[DataFrame, float]:
    """Features by the cells in which they may be nearest within ``d``, those that lie alike once, and the cells' size; for :func:`nearest_in`."""
    cut, size = _fine(alike(segs, key).withColumn("reach", F.lit(float(d))), d, max(d, CELL), [])
    return stage(cut.drop("reach"), "cells"), size


def nearest_in(points: DataFrame, cells: DataFrame, size: float, by: list[str], key: str, d: float, digits: int) -> DataFrame:
    """by, key: the nearest feature within ``d`` of every point; of distances equal to ``digits`` the one with the smallest key.

    points: by, x, y; cells, size: from :func:`nearest_cells`. Where cells are few the points are not shuffled, and
    points that lie together by one of ``by`` stay so; else a point's rows are together by its cell.
    """
    small = stored_bytes(cells) <= BROADCAST_BYTES
    at = points.select(*by, "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    dist, _ = to_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    met = at.join(cells.hint("broadcast" if small else "merge"), ["cx", "cy"]).withColumn("dist", dist).where(F.col("dist") <= d)
    met = met.groupBy(*by, *([] if small else ["cx", "cy"])).agg(F.min(F.struct(F.round("dist", digits).alias("dist"), key)).alias("m"))
    return met.select(*by, f"m.{key}")


def _near(points: DataFrame, segs: DataFrame, d: float, cell: float | None) -> DataFrame:
    """pid, dist and the columns of ``segs`` (staged) for points and features within ``d`` that may be the nearest."""
    cut, size = _fine(segs.withColumn("reach", F.lit(float(d))), d, cell or max(d, CELL), [])
    cut = stage(cut, "cells")
    at = points.select("pid", "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    dist, _ = to_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    hint = "broadcast" if stored_bytes(cut) <= BROADCAST_BYTES else "merge"
    return at.join(cut.drop("reach").hint(hint), ["cx", "cy"]).withColumn("dist", dist).where(F.col("dist") <= d)


def least_distance(points: DataFrame, segs: DataFrame, key: str, d: float, cell: float | None = None) -> DataFrame:
    """pid, dist: the distance to whatever is nearest within ``d``; one aggregation, partial in each task."""
    lines = stage(segs.select("ax", "ay", "bx", "by").distinct(), "segments")
    return _near(points, lines, d, cell).groupBy("pid").agg(F.min("dist").alias("dist"))


def nearest_of(points: DataFrame, others: DataFrame, on: str, key: str, d: float) -> DataFrame:
    """pid, on, key: of the ``others`` (on, key, x, y) of a point's own group the nearest, at any distance; ties take the smallest key.

    points: pid, on, x, y. Cells as wide as a radius that doubles for points without one;
    points whose group has none are left out first, so rounds end.
    """
    left, found = stage(points.join(others.select(on).distinct().hint("merge"), on, "left_semi"), "points"), []
    while not left.isEmpty():
        cells = F.explode(F.expr("flatten(transform(array(-1, 0, 1), i -> transform(array(-1, 0, 1), j -> struct(i, j))))"))
        cell = lambda c: F.floor(F.col(c) / d)  # noqa: B023, E731
        asked = left.withColumns({"cx": cell("x"), "cy": cell("y")}).withColumn("c_", cells).select("pid", on, "x", "y", (F.col("cx") + F.col("c_.i")).alias("cx"), (F.col("cy") + F.col("c_.j")).alias("cy"))
        held = others.select(on, key, F.col("x").alias("x_"), F.col("y").alias("y_"), cell("x").alias("cx"), cell("y").alias("cy"))
        far = (F.col("x") - F.col("x_")) ** 2 + (F.col("y") - F.col("y_")) ** 2
        near = asked.join(held.hint("merge"), [on, "cx", "cy"]).withColumn("far", far).where(F.col("far") <= d * d)
        now = stage(near.groupBy("pid", on).agg(F.min(F.struct("far", key)).alias("m")).select("pid", on, f"m.{key}"), "nearest")
        found.append(now)
        left = stage(left.join(now.select("pid", on).hint("merge"), ["pid", on], "left_anti"), "points")
        d *= 2
    return reduce(DataFrame.unionByName, found) if found else points.join(others.select(on, key), on).select("pid", on, key).limit(0)


#: Polygons with more vertices do not travel whole, see :mod:`viamark.operators.polygons`.
VERTICES = 2_000
#: Stored size up to which the features of all layers, copied to their cells, are broadcast.
BROADCAST_BYTES = 16 << 20


def distances(points: DataFrame, layers: dict[str, tuple[DataFrame, float]], rings: dict[str, DataFrame], key: str, cell: float) -> DataFrame:
    """pid and ``d_<layer>``: the distance to the nearest feature of each layer within its reach, else null.

    layers: segments and reach; rings: polygons of layers, inside which the distance is 0; a layer may have either or both.
    Features of all layers lie in one table by cells, each copied as far as its own reach, so
    the points are joined once, whatever the number of layers, and not shuffled at all where
    the features are few. All layers share one aggregation, partial in each task.
    """
    tagged = [segs.select("ax", "ay", "bx", "by", F.lit(name).alias("layer"), F.lit(float(d)).alias("reach")) for name, (segs, d) in layers.items()]
    every = stage(reduce(DataFrame.unionAll, tagged), "features")
    cut, size = _fine(every, max(d for _, d in layers.values()), cell, ["layer"], len(layers))
    if rings:
        areas = stage(reduce(DataFrame.unionAll, [r.select(F.lit(name).alias("layer"), "geom") for name, r in rings.items()]), "areas")
        large = areas.where(F.size("geom") > VERTICES)
        cut = cut.unionByName(_areas(areas.where(F.size("geom") <= VERTICES), cell, size), allowMissingColumns=True)
    else:
        cut = cut.withColumns({"geom": F.lit(None).cast("array<struct<x: double, y: double>>"), "whole": F.lit(None).cast("boolean")})
    cut = stage(cut, "layers")
    at = points.select("pid", "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    line, _ = to_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    hint = "broadcast" if stored_bytes(cut) <= BROADCAST_BYTES else "merge"
    met = lambda t: at.join(t.hint(hint), ["cx", "cy"])
    # A point lies in one cell, so after a join by cells its rows are together already; the reach is asked of the least alone.
    dist = F.when(F.col("whole"), 0.0).otherwise(line)
    least = met(cut.where("geom is null").drop("geom")).groupBy("cx", "cy", "pid", "layer", "reach").agg(F.min(dist).alias("dist"))
    found = least.where("reach is null or dist <= reach").select("pid", "layer", "dist")
    if rings:
        # The even-odd rule runs on its own: beside it the distances would not be compiled.
        around = met(cut.where("geom is not null").select("layer", "geom", "cx", "cy")).where(inside(point(F.col("x"), F.col("y")), "geom"))
        found = found.unionAll(around.select("pid", "layer", F.lit(0.0)))
        if not large.isEmpty():
            big = containing(points, large.select(F.struct("layer", F.xxhash64("geom")).alias("area_"), "geom"), "area_", cell)
            found = found.unionAll(big.select("pid", "area_.layer", F.lit(0.0)))
    return found.groupBy("pid").agg(*[F.min(F.when(F.col("layer") == name, F.col("dist"))).alias(f"d_{name}") for name in dict.fromkeys([*layers, *rings])])


def _areas(areas: DataFrame, wide: float, size: float) -> DataFrame:
    """layer, cx, cy with ``geom`` or, where a polygon of the layer holds all of the cell, ``whole`` alone.

    areas: layer, geom. Cells are halved from ``wide`` to ``size``; one that is held whole needs no polygon any more.
    """
    low = lambda c: F.array_min(F.transform("geom", lambda p: p[c]))
    high = lambda c: F.array_max(F.transform("geom", lambda p: p[c]))
    while wide < size:
        wide *= 2
    cells = F.explode(cells_of_box(low("x"), low("y"), high("x"), high("y"), wide))
    cut = areas.withColumn("c_", cells).select("layer", "geom", F.lit(False).alias("whole"), *[F.col(f"c_.c{a}").alias(f"{b}{a}") for b in "ck" for a in "xy"])
    cut = cut.repartition("layer", "kx", "ky")
    first = Window.partitionBy("layer", "kx", "ky", "cx", "cy").orderBy(F.desc("whole"))
    while True:
        x, y, half = _middle(wide)
        ring = segments(F.concat("geom", F.slice("geom", 1, 1)))
        edge = F.array_min(F.transform(ring, lambda s: to_segment(x, y, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])[0]))
        away = F.col("whole") | (edge > half)
        cut = cut.withColumn("away_", away).withColumn("whole", F.col("whole") | (F.col("away_") & inside(point(x, y), "geom"))).where("whole or not away_").drop("away_")
        cut = cut.withColumn("geom", F.when(~F.col("whole"), F.col("geom"))).withColumns({"any_": F.first("whole").over(first), "n_": F.row_number().over(first)})
        cut = cut.where("not any_ or n_ = 1").drop("any_", "n_")
        if wide <= size:
            return cut.drop("kx", "ky")
        cut, wide = _halved(cut), wide / 2


def nearest(points: DataFrame, segs: DataFrame, key: str, d: float) -> DataFrame:
    """pid, key, dist: the nearest feature within ``d``; ties take the smallest key."""
    return _nearest(points, alike(segs, key), key, d)


def _nearest(points: DataFrame, lines: DataFrame, key: str, d: float) -> DataFrame:
    best = _near(points, lines, d, None).groupBy("pid").agg(F.min(F.struct("dist", key)).alias("m"))
    return best.select("pid", f"m.{key}", "m.dist")


def nearest_any(points: DataFrame, segs: DataFrame, key: str, d: float) -> DataFrame:
    """The nearest feature at any distance: the radius doubles for points without one.

    A find within the radius is the nearest, so no later round can better it. Rounds end
    when every point has found one; without any feature there is nothing to find.
    """
    left, found, lines = stage(points.select("pid", "x", "y"), "points"), None, alike(segs, key)
    if lines.isEmpty():
        return _nearest(left, lines, key, d)
    while True:
        now = stage(_nearest(left, lines, key, d), "nearest")
        found = now if found is None else found.unionByName(now)
        left = stage(left.join(now.hint("merge"), "pid", "left_anti"), "points")
        if left.isEmpty():
            return found
        d *= 2


def containing(points: DataFrame, rings: DataFrame, key: str, size: float, vertices: int | None = None, staged: bool = False) -> DataFrame:
    """pid, key: polygons (key, geom) around each point.

    Rings of up to ``vertices`` vertices are copied to the cells of ``size`` they touch; of
    larger ones only segments and flags of cells are. staged: the copies are written first, and
    broadcast when their stored size is small.
    """
    from viamark.operators import polygons

    most = polygons.VERTICES if vertices is None else vertices
    small = _containing_whole(points, rings.where(F.size("geom") <= most), key, size, staged)
    large = rings.where(F.size("geom") > most)
    if large.isEmpty():
        return small
    width = min(size / 2, polygons.CELL)
    return small.unionByName(polygons.containing_cut(points, *polygons.cut(large, key, width), key, width))


def inside_any(points: DataFrame, rings: DataFrame, key: str, size: float, vertices: int | None = None) -> DataFrame:
    """pid: points inside any of the polygons, each once; see :func:`containing`."""
    from viamark.operators import polygons

    most = polygons.VERTICES if vertices is None else vertices
    small = _containing_whole(points, rings.where(F.size("geom") <= most), key, size, False).select("pid")
    large = rings.where(F.size("geom") > most)
    if large.isEmpty():
        return small.distinct()
    width = min(size / 2, polygons.CELL)
    return small.unionByName(polygons.inside_cut(points, *polygons.cut(large, key, width), key, width)).distinct()


def _containing_whole(points: DataFrame, rings: DataFrame, key: str, size: float, staged: bool) -> DataFrame:
    low = lambda c: F.array_min(F.transform("geom", lambda p: p[c]))
    high = lambda c: F.array_max(F.transform("geom", lambda p: p[c]))
    cut = rings.withColumn("cell", F.explode(cells_of_box(low("x"), low("y"), high("x"), high("y"), size))).select(key, "geom", "cell.cx", "cell.cy")
    at = points.select("pid", "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    hint = "merge"
    if staged:
        cut = stage(cut, "ring-copies")
        hint = "broadcast" if stored_bytes(cut) <= BROADCAST_BYTES else "merge"
    return at.join(cut.hint(hint), ["cx", "cy"]).where(inside(point(F.col("x"), F.col("y")), "geom")).select("pid", key)


def interval_join(points: DataFrame, spans: DataFrame, on: list[str], t: str, start: str, stop: str, width: float) -> DataFrame:
    """Rows of ``points`` with the ``spans`` that hold their ``t``; both sides share the keys ``on``.

    Spans are copied to the buckets of ``width`` they touch.
    """
    bucket = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width)))
    cut = spans.withColumn("bucket_", bucket)
    at = points.withColumn("bucket_", F.floor(F.col(t) / width))
    return at.join(cut.hint("merge"), [*on, "bucket_"]).where((F.col(t) >= F.col(start)) & (F.col(t) <= F.col(stop))).drop("bucket_")


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], slack: float, width: float) -> DataFrame:
    """Pairs of rows whose spans overlap, or lie within ``slack`` of each other.

    Both sides are copied to the buckets of ``width`` they touch (the left side widened by
    the slack); a pair is kept in the first bucket that both touch, so it comes once.
    """
    (a, b), (c, d) = left_span, right_span
    bucket = lambda x: F.floor(x / width)
    own = left.withColumn("bucket_", F.explode(F.sequence(bucket(F.col(a) - slack), bucket(F.col(b) + slack))))
    other = right.withColumn("bucket_", F.explode(F.sequence(bucket(F.col(c)), bucket(F.col(d)))))
    met = own.join(other.hint("merge"), [*on, "bucket_"]).where((F.col(a) - slack <= F.col(d)) & (F.col(c) <= F.col(b) + slack))
    return met.where(F.col("bucket_") == F.greatest(bucket(F.col(a) - slack), bucket(F.col(c)))).drop("bucket_")


def time_near(left: DataFrame, right: DataFrame, on: list[str], t: str, u: str, d: float) -> DataFrame:
    """Pairs of rows whose times lie within ``d``: buckets of ``d``, the right side in three."""
    near = F.explode(F.array(*[F.floor(F.col(u) / d) + k for k in (-1, 0, 1)]))
    return left.withColumn("bucket_", F.floor(F.col(t) / d)).join(right.withColumn("bucket_", near).hint("merge"), [*on, "bucket_"]).where(F.abs(F.col(t) - F.col(u)) <= d).drop("bucket_")


def as_of(left: DataFrame, right: DataFrame, on: list[str], t: str, u: str, value: str) -> DataFrame:
    """``left`` with ``value`` of the last ``right`` row not after ``t``: one sort of the union, no join."""
    mark = "is_right_"
    names = left.columns
    both = left.withColumns({"order_": F.col(t), value: F.lit(None).cast(right.schema[value].dataType), mark: F.lit(0)}).unionByName(
        right.select(*on, F.col(u).alias("order_"), value, F.lit(1).alias(mark)), allowMissingColumns=True
    )
    # On equal times right rows come first, so that they count as not after.
    w = Window.partitionBy(*on).orderBy("order_", F.desc(mark)).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where(F.col(mark) == 0).select(*names, value)
