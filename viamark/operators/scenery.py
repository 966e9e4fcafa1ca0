"""Scores of road pieces: components, their blend, the composite, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the scale: weights of components, base and stretch, class adjustments,
# distances in metres, smallest polygons in square metres, surfaces.
WEIGHTS = {
    "water": 0.22, "coast": 0.13, "forest": 0.18, "curves": 0.13, "relief": 0.16, "farm": 0.06,
    "views": 0.05, "scenic_tag": 0.07, "urban": 0.14, "grand": 0.10, "protected": 0.07,
}
RAW_BASE, STRETCH = 0.143, 1.2
CLASS_ADJ = {
    "motorway": -0.45, "motorway_link": -0.40, "trunk": -0.10, "trunk_link": -0.18, "primary": -0.04,
    "primary_link": -0.10, "secondary": 0.0, "secondary_link": -0.10, "tertiary": 0.0, "tertiary_link": -0.05,
    "unclassified": 0.0, "residential": -0.05, "living_street": -0.08,
}
DIST = {"water": 120.0, "water_mid": 350.0, "coast": 800.0, "green": 80.0, "farm": 80.0, "view": 400.0, "urban": 100.0, "place": 400.0, "place_mid": 900.0}
MIN_AREA = {"water": 20_000.0, "green": 30_000.0, "farm": 20_000.0}
UNPAVED = (
    "unpaved", "compacted", "fine_gravel", "gravel", "shells", "rock", "pebblestone", "ground", "dirt", "earth",
    "grass", "grass_paver", "mud", "sand", "woodchips", "snow", "ice", "salt",
)
WATER_MID, PLACE_MID, SEA_SHARE, BUILT_MAX = 0.45, 0.5, 0.5, 0.3
RELIEF_FULL, GRAND_START, GRAND_FULL, CURVE_FULL = 100.0, 300.0, 900.0, 160.0


def components(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("c_")]


def blend(names: list[str], weights: dict[str, float] = WEIGHTS) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(weights[c[2:]]) * F.col(c) for c in names])


def composite(raw: Column, adjust: Column) -> Column:
    return 10.0 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw + RAW_BASE) * STRETCH + adjust))


def class_adjustment(highway: str = "highway") -> Column:
    table = F.create_map(*[F.lit(x) for pair in CLASS_ADJ.items() for x in pair])
    return F.coalesce(table[F.col(highway)], F.lit(0.0))


def unpaved(surface: str = "surface") -> Column:
    return F.when(F.col(surface).isin(*UNPAVED), 1.0).otherwise(0.0)


def two_bands(dist: str, near: float, far: float, credit: float) -> Column:
    """1 within ``near``, ``credit`` within ``far``, else 0; null distance: nothing there."""
    return F.when(F.col(dist) <= near, 1.0).when(F.col(dist) <= far, credit).otherwise(0.0)


def ramp(value: str, start: float, full: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce(value, F.lit(0.0)) - start) / (full - start)))


def forest(green: Column, tree: Column, desert: Column) -> Column:
    return F.greatest(0.5 * green + 0.5 * tree, desert)


def vista(prominence: str, tree: Column, built: Column, mangrove: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - tree - built - mangrove) * ramp(prominence, GRAND_START, GRAND_FULL)


def sea_as_water(dist: str, water_share: Column) -> Column:
    return F.when(water_share >= SEA_SHARE, two_bands(dist, DIST["water"], DIST["water_mid"], WATER_MID)).otherwise(0.0)


def landmark(inside: Column, near: Column, built: Column) -> Column:
    return F.when((inside | near) & (built <= BUILT_MAX), 1.0).otherwise(0.0)


#: Shares of land cover by class of the grid: tree, desert, built, wet, mangrove; any other class takes the second.
COVER = {"tree": (0, 0.8, 0.1), "desert": (2, 0.7, 0.0), "built": (3, 0.6, 0.05), "wet": (1, 0.6, 0.1), "mangrove": (4, 0.2, 0.0)}


def with_cover(df: DataFrame, cls: Column) -> DataFrame:
    return df.withColumns({name: F.when(cls == own, inside).otherwise(outside) for name, (own, inside, outside) in COVER.items()})


def with_components(df: DataFrame) -> DataFrame:
    """The eleven components from distances (d_*, null: nothing near), curvature, relief, prominence and shares of cover."""
    near = lambda c, d: F.when(F.col(c) <= d, 1.0).otherwise(0.0)
    clip = lambda c, full: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0.0)) / full))
    on = lambda c: F.col(c).isNotNull()
    return df.withColumns({
        "c_water": F.greatest(two_bands("d_water", DIST["water"], DIST["water_mid"], WATER_MID), sea_as_water("d_coast", F.col("wet"))),
        "c_coast": near("d_coast", DIST["coast"]),
        "c_forest": forest(on("d_green").cast("double"), F.col("tree"), F.col("desert")),
        "c_curves": clip("curvature", CURVE_FULL),
        "c_relief": clip("relief", RELIEF_FULL),
        "c_farm": on("d_farm").cast("double"),
        "c_views": near("d_view", DIST["view"]),
        "c_scenic_tag": F.col("scenic").cast("double"),
        "c_urban": two_bands("d_place", DIST["place"], DIST["place_mid"], PLACE_MID),
        "c_grand": vista("prominence", F.col("tree"), F.col("built"), F.col("mangrove")),
        "c_protected": landmark(on("d_land"), F.lit(False), F.col("built")),
    })


def scored(df: DataFrame) -> DataFrame:
    """Adds score_adj, unpaved, raw and score to a table with c_ columns, highway and surface."""
    df = df.withColumns({"score_adj": class_adjustment(), "unpaved": unpaved()})
    df = df.withColumn("raw", blend(components(df)))
    return df.withColumn("score", composite(F.col("raw"), F.col("score_adj")))


def edge_means(samples: DataFrame, key: str, piece: str, values: list[str]) -> DataFrame:
    """Length-weighted means of ``values`` for each edge of a table of samples."""
    total = F.sum(piece)
    return samples.groupBy(key).agg(*[(F.sum(F.col(v) * F.col(piece)) / total).alias(v) for v in values], total.alias("length_m"))


def by_class(df: DataFrame) -> DataFrame:
    km = F.sum("length_m") / 1000
    return df.groupBy("highway").agg(km.alias("km"), (F.sum(F.col("score") * F.col("length_m")) / F.sum("length_m")).alias("score"), F.count(F.lit(1)).alias("pieces"))


def top_roads(df: DataFrame, least_km: float = 3.0, n: int = 25) -> DataFrame:
    """The best named roads: a report of ``n`` rows, ties by name."""
    roads = df.where("name <> ''").groupBy("name").agg((F.sum("length_m") / 1000).alias("km"), (F.sum(F.col("score") * F.col("length_m")) / F.sum("length_m")).alias("score"))
    return roads.where(F.col("km") >= least_km).orderBy(F.desc("score"), "name").limit(n)


def calibration(df: DataFrame, shares: tuple[float, ...] = (0.1, 0.5, 0.9, 0.99)) -> DataFrame:
    """Percentiles of the score over length (a piece counts once for every 0.1 km), and clipped shares."""
    from viamark.operators.stats import quantiles

    w = F.greatest(F.lit(1), F.round(F.col("length_m") / 100)).cast("long")
    clip = lambda c: F.sum(F.when(c, F.col("length_m")).otherwise(0.0)) / F.sum("length_m")
    out = df.agg(clip(F.col("score") <= 0).alias("floor_share"), clip(F.col("score") >= 10).alias("ceiling_share"))
    p = quantiles(df, "score", shares, w).withColumnRenamed("q", "p")
    out = out.join(F.broadcast(p), F.lit(True))  # one row
    return out.select(*[F.col("p")[i].alias(f"p{round(s * 100)}") for i, s in enumerate(shares)], "floor_share", "ceiling_share")


def ranked(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)
