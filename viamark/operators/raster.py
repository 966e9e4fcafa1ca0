"""Rasters as pixel tables (row, col, v), by window frames and running sums.

Focal filters are separable: a frame along rows, then one along columns. Windows are
partitioned by tile and row (or column), so no task holds more than one line of a tile.
Missing pixels may be missing rows or null values: they are filled in before a filter and
are invisible to extremes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viamark.plans.tables import stage


def terrarium(r: Column, g: Column, b: Column, low: float = -500.0, high: float = 9000.0) -> Column:
    """Height of an encoded pixel; out of band is null, below the sea is 0."""
    z = r * 256 + g + b / 256 - 32768
    return F.when((z >= low) & (z <= high), F.greatest(z, F.lit(0.0)))


def window_px(metres: float, metres_per_px: float) -> int:
    """The odd number of pixels nearest to a width on the ground, 3 at least."""
    return max(3, 2 * round((metres / metres_per_px - 1) / 2) + 1)


def metres_per_px(lat: float, zoom: int, tile: int = 256) -> float:
    return 40075016.686 * math.cos(math.radians(lat)) / (tile * 2**zoom)


def mosaic(tiles: DataFrame, size: int = 256) -> DataFrame:
    """Global row and col of pixels given by tile (tx, ty) and place (r, c)."""
    return tiles.withColumns({"row": F.col("ty") * size + F.col("r"), "col": F.col("tx") * size + F.col("c")})


def _along(by: str, order: str, reach: int) -> Window:
    return Window.partitionBy("tile", by).orderBy(order).rangeBetween(-reach, reach)


def filled(df: DataFrame) -> DataFrame:
    """Every place of each tile's box, with ``here_``: true where ``df`` has a pixel, else null like its columns.

    A frame over rows only sees the columns that are there, so holes must be rows before two
    passes can stand for a square. Rows are dealt to tasks before their columns are laid out.
    """
    edge = df.groupBy("tile").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    rows = edge.withColumn("row", F.explode(F.sequence("r0", "r1"))).repartition("tile", "row")
    full = rows.withColumn("col", F.explode(F.sequence("c0", "c1"))).select("tile", "row", "col")
    return full.join(df.withColumn("here_", F.lit(True)).hint("merge"), ["tile", "row", "col"], "left")


def focal(df: DataFrame, value: str, px: int) -> DataFrame:
    """Adds ``low`` and ``high``: extremes of the square of ``px`` pixels around each pixel that is there."""
    k = px // 2
    across = filled(df).withColumns({"lo_": F.min(value).over(_along("row", "col", k)), "hi_": F.max(value).over(_along("row", "col", k))})
    both = across.withColumns({"low": F.min("lo_").over(_along("col", "row", k)), "high": F.max("hi_").over(_along("col", "row", k))})
    return both.where("here_").select(*df.columns, "low", "high")


def relief(df: DataFrame, value: str, px: int) -> DataFrame:
    return focal(df, value, px).withColumn("relief", F.col("high") - F.col("low")).drop("low", "high")


def prominence(df: DataFrame, value: str, px: int) -> DataFrame:
    return focal(df, value, px).withColumn("prominence", F.col("high") - F.col(value)).drop("low", "high")


def despiked(df: DataFrame, value: str, off: float = 250.0) -> DataFrame:
    """Pixels farther than ``off`` from the exact median of their 5 by 5 square become null.

    Only candidates, which differ that much from the square's extremes, are looked at.
    """
    near = focal(df, value, 5)
    suspects = near.where((F.col("high") - F.col(value) > off) | (F.col(value) - F.col("low") > off)).select("tile", "row", "col", value)
    square = F.expr("explode(flatten(transform(sequence(-2, 2), i -> transform(sequence(-2, 2), j -> struct(i, j)))))")
    asked = suspects.withColumn("o", square).select("tile", (F.col("row") + F.col("o.i")).alias("r"), (F.col("col") + F.col("o.j")).alias("c"), "row", "col", F.col(value).alias("own_"))
    seen = asked.join(df.select("tile", F.col("row").alias("r"), F.col("col").alias("c"), F.col(value).alias("n_")).hint("merge"), ["tile", "r", "c"])
    spikes = seen.groupBy("tile", "row", "col").agg(F.median("n_").alias("m"), F.first("own_").alias("own_")).where(F.abs(F.col("own_") - F.col("m")) > off).select("tile", "row", "col", F.lit(True).alias("spike_"))
    return df.join(spikes.hint("merge"), ["tile", "row", "col"], "left").withColumn(value, F.when(F.col("spike_").isNull(), F.col(value))).drop("spike_")


def block_counts(df: DataFrame, cls: str, size: int = 12) -> DataFrame:
    """Pixels of each class in blocks of ``size`` by ``size``."""
    return df.groupBy("tile", F.floor(F.col("row") / size).alias("brow"), F.floor(F.col("col") / size).alias("bcol"), cls).agg(F.count(F.lit(1)).alias("n"))


def majority(df: DataFrame, cls: str, size: int = 3) -> DataFrame:
    """The most frequent class of each block; ties take the lowest code."""
    n = block_counts(df, cls, size)
    best = F.max(F.struct("n", (-F.col(cls)).alias("neg")))
    return n.groupBy("tile", "brow", "bcol").agg(best.alias("b")).select("tile", "brow", "bcol", (-F.col("b.neg")).alias("class"), F.col("b.n").alias("n"))


def summed(df: DataFrame, value: str) -> DataFrame:
    """Adds ``area``: the sum over all rows and columns up to each pixel (two running sums)."""
    row = Window.partitionBy("tile", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    col = Window.partitionBy("tile", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("s_", F.sum(value).over(row)).withColumn("area", F.sum("s_").over(col)).drop("s_")


def box_shares(df: DataFrame, value: str, reach: int) -> DataFrame:
    """tile, row, col, share, pixels: the mean of ``value`` in the box around each pixel, clipped at the edge.

    Four corners of the summed area; the grid of a tile must be full.
    """
    a = summed(df, value).select("tile", "row", "col", "area")
    edge = a.groupBy("tile").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    at = df.select("tile", "row", "col").join(edge.hint("merge"), "tile")
    at = at.withColumns({"top": F.greatest(F.col("row") - reach, "r0"), "bottom": F.least(F.col("row") + reach, "r1"), "left": F.greatest(F.col("col") - reach, "c0"), "right": F.least(F.col("col") + reach, "c1")})
    out, total = at, F.lit(0.0)
    for i, (r, c, sign) in enumerate((("bottom", "right", 1), ("top", "right", -1), ("bottom", "left", -1), ("top", "left", 1))):
        corner = a.select("tile", F.col("row").alias(f"r_{i}"), F.col("col").alias(f"c_{i}"), F.col("area").alias(f"a_{i}"))
        rr = F.col(r) - 1 if r == "top" else F.col(r)
        cc = F.col(c) - 1 if c == "left" else F.col(c)
        out = out.withColumns({f"r_{i}": rr, f"c_{i}": cc}).join(corner.hint("merge"), ["tile", f"r_{i}", f"c_{i}"], "left")
        total = total + sign * F.coalesce(f"a_{i}", F.lit(0.0))
    n = (F.col("bottom") - F.col("top") + 1) * (F.col("right") - F.col("left") + 1)
    return out.select("tile", "row", "col", (total / n).alias("share"), n.alias("pixels"))


def gated_box_shares(points: DataFrame, pixels: DataFrame, layers: list[str], reach: int, size: int) -> DataFrame:
    """pid and, for each of ``layers``, its share of the box of (2 ``reach`` + 1)^2 pixels around a point; boxes may cross tiles.

    points: pid, row, col; pixels: row, col and layers (0 or 1, or any amount), of
    which ``size`` x ``size`` make a tile; a pixel that is not there counts as 0.
    Summed areas on two levels: inside each tile, and over whole tiles, rows of tiles and
    columns of tiles. No task sums more than one row or column of pixels of a tile, or of tiles.
    """
    tile = lambda c: F.floor(F.col(c) / size)
    there = pixels.select(tile("row").alias("ty"), tile("col").alias("tx")).distinct()
    square = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    every = there.withColumn("o", square).select("ty", "tx", (F.col("ty") * size + F.col("o.i")).alias("row"), (F.col("tx") * size + F.col("o.j")).alias("col"))
    p = stage(every.join(pixels.select("row", "col", *layers).hint("merge"), ["row", "col"], "left").fillna(0, layers), "pixels")
    upto = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    before = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = lambda df, w: df.withColumns({c: F.sum(c).over(w) for c in layers})
    total = lambda df, by: df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in layers])
    inner = sums(sums(p, upto(["ty", "tx", "row"], "col")), upto(["ty", "tx", "col"], "row"))
    edge = p.agg(F.min("ty").alias("y0"), F.max("ty").alias("y1"), F.min("tx").alias("x0"), F.max("tx").alias("x1"))  # one row
    # Tables of what lies before a tile: rows of the tiles to its left, columns of the tiles above, tiles up and left.
    grid = edge.select(F.explode(F.sequence("y0", "y1")).alias("ty"), "x0", "x1").select("ty", F.explode(F.sequence("x0", "x1")).alias("tx"))
    lines = grid.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    rows = lines.select("ty", "tx", (F.col("ty") * size + F.col("k")).alias("row")).join(total(p, ["ty", "tx", "row"]).hint("merge"), ["ty", "tx", "row"], "left")
    cols = lines.select("ty", "tx", (F.col("tx") * size + F.col("k")).alias("col")).join(total(p, ["ty", "tx", "col"]).hint("merge"), ["ty", "tx", "col"], "left")
    left = sums(sums(rows, upto(["ty", "tx"], "row")), before(["row"], "tx"))
    above = sums(sums(cols, upto(["ty", "tx"], "col")), before(["col"], "ty"))
    whole = sums(sums(grid.join(total(p, ["ty", "tx"]).hint("merge"), ["ty", "tx"], "left"), before(["ty"], "tx")), before(["tx"], "ty"))
    inner, left, above, whole = (stage(df.select(*keys, *[zero(F.col(c)).alias(f"{c}_{n}") for c in layers]), "areas") for n, df, keys in (("i", inner, ["row", "col"]), ("l", left, ["tx", "row"]), ("a", above, ["ty", "col"]), ("w", whole, ["ty", "tx"])))
    # Corners outside the raster are moved to its last row and column; before the first there is nothing.
    low, high = (F.struct((F.col(c) - reach - 1).alias("v"), F.lit(-1).alias("sign")) for c in ("row", "col")), (F.struct((F.col(c) + reach).alias("v"), F.lit(1).alias("sign")) for c in ("row", "col"))
    (r0, c0), (r1, c1) = low, high
    asked = points.select("pid", F.explode(F.array(r0, r1)).alias("r"), "col").select("pid", "r", F.explode(F.array(c0, c1)).alias("c"))
    at = asked.join(F.broadcast(edge), F.lit(True)).select("pid", (F.col("r.sign") * F.col("c.sign")).alias("sign"), F.least("r.v", (F.col("y1") + 1) * size - 1).alias("row"), F.least("c.v", (F.col("x1") + 1) * size - 1).alias("col"), (F.col("x0") * size).alias("left_"), (F.col("y0") * size).alias("top_"))
    at = at.where("row >= top_ and col >= left_").select("pid", "sign", "row", "col").withColumns({"ty": tile("row"), "tx": tile("col")})
    for other, keys in ((inner, ["row", "col"]), (left, ["tx", "row"]), (above, ["ty", "col"]), (whole, ["ty", "tx"])):
        at = at.join(other.hint("merge"), keys, "left")
    area = {c: sum((zero(F.col(f"{c}_{n}")) for n in "ilaw"), F.lit(0)) for c in layers}
    got = at.groupBy("pid").agg(*[(F.sum(F.col("sign") * a) / float((2 * reach + 1) ** 2)).alias(c) for c, a in area.items()])
    return points.select("pid").join(got.hint("merge"), "pid", "left").select("pid", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in layers])


def sample(points: DataFrame, df: DataFrame, value: str, size: float) -> DataFrame:
    """points (tile, x, y) with the value of the pixel of ``size`` they lie in; null outside."""
    at = points.withColumns({"row": F.floor(F.col("y") / size), "col": F.floor(F.col("x") / size)})
    return at.join(df.select("tile", "row", "col", value).hint("merge"), ["tile", "row", "col"], "left")


def tiles_of_box(west: Column, south: Column, east: Column, north: Column, step: int = 3) -> Column:
    """Array of struct(lat, lon): south-west corners of the tiles a box needs."""
    first = lambda v: (F.floor(v / step) * step).cast("int")
    lats, lons = F.sequence(first(south), first(north), F.lit(step)), F.sequence(first(west), first(east), F.lit(step))
    return F.flatten(F.transform(lats, lambda a: F.transform(lons, lambda o: F.struct(a.alias("lat"), o.alias("lon")))))


def coverage(pixels: DataFrame, by: str, expected: int) -> DataFrame:
    """by, pixels, share: how much of what is expected each mosaic holds."""
    return pixels.groupBy(by).agg(F.count(F.lit(1)).alias("pixels")).withColumn("share", F.col("pixels") / expected)


def blob_mask(df: DataFrame, value: str, block: int = 4, reach: int = 2, off: float = 1200.0, grow: int = 2) -> DataFrame:
    """tile, brow, bcol: blocks whose median is ``off`` from the median of the blocks around them, grown by ``grow`` blocks."""
    b = df.groupBy("tile", F.floor(F.col("row") / block).alias("brow"), F.floor(F.col("col") / block).alias("bcol")).agg(F.median(value).alias("m"))
    square = F.expr(f"explode(flatten(transform(sequence(-{reach}, {reach}), i -> transform(sequence(-{reach}, {reach}), j -> struct(i, j)))))")
    asked = b.withColumn("o", square).select("tile", (F.col("brow") + F.col("o.i")).alias("r"), (F.col("bcol") + F.col("o.j")).alias("c"), "brow", "bcol", F.col("m").alias("own_"))
    seen = asked.join(b.select("tile", F.col("brow").alias("r"), F.col("bcol").alias("c"), F.col("m").alias("n_")).hint("merge"), ["tile", "r", "c"])
    bad = seen.groupBy("tile", "brow", "bcol").agg(F.median("n_").alias("around"), F.first("own_").alias("own_")).where(F.abs(F.col("own_") - F.col("around")) > off)
    wide = F.expr(f"explode(flatten(transform(sequence(-{grow}, {grow}), i -> transform(sequence(-{grow}, {grow}), j -> struct(i, j)))))")
    grown = bad.withColumn("o", wide).select("tile", (F.col("brow") + F.col("o.i")).alias("brow"), (F.col("bcol") + F.col("o.j")).alias("bcol")).distinct()
    return grown.join(b.select("tile", "brow", "bcol").hint("merge"), ["tile", "brow", "bcol"], "left_semi")


def robust_defects(df: DataFrame, value: str, reach: int = 2, times: float = 6.0, least: float = 50.0) -> DataFrame:
    """Pixels with ``defect``: farther from the median of their square than ``times`` its median deviation, and than ``least``."""
    square = F.expr(f"explode(flatten(transform(sequence(-{reach}, {reach}), i -> transform(sequence(-{reach}, {reach}), j -> struct(i, j)))))")
    asked = df.withColumn("o", square).select("tile", (F.col("row") + F.col("o.i")).alias("r"), (F.col("col") + F.col("o.j")).alias("c"), "row", "col", F.col(value).alias("own_"))
    seen = asked.join(df.select("tile", F.col("row").alias("r"), F.col("col").alias("c"), F.col(value).alias("n_")).hint("merge"), ["tile", "r", "c"])
    # At most (2 reach + 1)^2 values a pixel are gathered.
    m = seen.groupBy("tile", "row", "col").agg(F.median("n_").alias("m"), F.collect_list("n_").alias("all_"), F.first("own_").alias("own_"))
    dev = F.array_sort(F.transform("all_", lambda v: F.abs(v - F.col("m"))))
    m = m.withColumn("dev", dev).withColumn("mad", (F.element_at("dev", F.floor((F.size("dev") + 1) / 2).cast("int")) + F.element_at("dev", F.floor(F.size("dev") / 2 + 1).cast("int"))) / 2)
    far = F.abs(F.col("own_") - F.col("m"))
    return m.select("tile", "row", "col", F.col("own_").alias(value), ((far > times * F.col("mad")) & (far > least)).alias("defect"))


def gate_seam(cells: DataFrame, step: float) -> DataFrame:
    """band, desert, kept, footprint: shares by band of longitude. cells: lon, desert, kept (both 0 to 1)."""
    band = F.floor(F.col("lon") / step)
    out = cells.groupBy(band.alias("band")).agg(F.avg("desert").alias("desert"), (F.sum(F.col("desert") * F.col("kept")) / F.nullif(F.sum("desert"), F.lit(0.0))).alias("kept"), F.count(F.lit(1)).alias("n_"))
    every = Window.partitionBy(F.lit(0))  # as many rows as bands
    return out.select("band", "desert", "kept", (F.col("n_") / F.sum("n_").over(every)).alias("footprint"))


def block_means(df: DataFrame, value: str, rows: int, cols: int, absent: float) -> DataFrame:
    """tile, row, col, mean: the mean over a window of rows and columns on a full grid; blocks that are absent count as ``absent``.

    Sums and counts along rows, then along columns; what is missing in the window's clipped
    box takes the absent value.
    """
    across, up = _along("row", "col", cols // 2), _along("col", "row", rows // 2)
    s = filled(df).withColumns({"s_": F.sum(value).over(across), "n_": F.count(value).over(across)})
    s = s.withColumns({"sum_": F.sum("s_").over(up), "have_": F.sum("n_").over(up)}).where("here_")
    return s.select("tile", "row", "col", ((F.col("sum_") + (rows * cols - F.col("have_")) * absent) / (rows * cols)).alias("mean"))
