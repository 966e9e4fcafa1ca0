"""Readers and writers: traces as NDJSON, measurement CSV, GeoJSON features, parts of a build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = """t string, ts double, started double, app string, dest array<double>, pref double, seq int, reason string, km double,
minutes double, mean_score double, coords array<array<double>>, lat double, lon double, acc double, alt double, spd double, crs double,
route int, travelled double, remaining double, off double, joined boolean, step int, verdict string, fix_age double, outcome string,
elapsed_s double, phase string, _corrupt_record string"""


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace records with their drive (file name); unreadable lines keep ``_corrupt_record`` only."""
    return spark.read.schema(TRACE).option("mode", "PERMISSIVE").json(path).withColumn("drive", F.element_at(F.split(F.input_file_name(), "/"), -1))


def unreadable(traces: DataFrame) -> DataFrame:
    """Lines of each drive that could not be read, such as a truncated last one."""
    return traces.groupBy("drive").agg(F.count("_corrupt_record").alias("unreadable"), F.count("t").alias("records"))


def records(traces: DataFrame, kind: str) -> DataFrame:
    return traces.where(F.col("t") == kind)


def read_measurements(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_measurements(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Lines of GeoJSON features: properties (DDL of a struct's fields) and geom; multipart lines are split, null ones dropped."""
    coords = "array<array<double>>"
    schema = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).where("f.geometry is not null")
    one = F.from_json("f.geometry.coordinates", coords)
    many = F.from_json("f.geometry.coordinates", f"array<{coords}>")
    parts = F.when(F.col("f.geometry.type") == "LineString", F.array(one)).when(F.col("f.geometry.type") == "MultiLineString", many)
    lines = f.select("f.properties.*", F.explode(parts).alias("line")).where(F.size("line") > 1)
    return lines.withColumn("geom", F.transform("line", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).drop("line")


def latest_snapshot(files: DataFrame) -> DataFrame:
    """layer, path, date: the newest file of each layer. files: path such as ``layer_YYYY-MM-DD.parquet``."""
    dated = files.select("path", F.regexp_extract("path", r"([^/]+)_(\d{4}-\d{2}-\d{2})\.[^/.]+$", 1).alias("layer"), F.to_date(F.nullif(F.regexp_extract("path", r"_(\d{4}-\d{2}-\d{2})\.[^/.]+$", 1), F.lit(""))).alias("date"))
    return dated.where("date is not null").groupBy("layer").agg(F.max_by("path", "date").alias("path"), F.max("date").alias("date"))


def append_parts(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Parts of regions in one table with the first one's columns and types; missing columns are null."""
    out = first
    for part in more:
        cast = part.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in first.schema if f.name in part.columns])
        out = out.unionByName(cast, allowMissingColumns=True)
    return out


def with_optional(df: DataFrame, column: str, default) -> DataFrame:
    return df if column in df.columns else df.withColumn(column, F.lit(default))


def export_filter(features: DataFrame, major: tuple[str, ...], limit: int = 40_000, low: float = 4.0, high: float = 5.0) -> DataFrame:
    """Features for a map: major classes and scores from ``low``; from ``high`` if there are more than ``limit``."""
    chosen = features.where(F.col("highway").isin(*major) | (F.col("score") >= low))
    total = chosen.agg(F.count(F.lit(1)).alias("total_"))
    # One row.
    out = chosen.join(F.broadcast(total), F.lit(True))
    keep = (F.col("total_") <= limit) | F.col("highway").isin(*major) | (F.col("score") >= high)
    return out.where(keep).withColumn("score", F.round("score", 2)).drop("total_")


def layers(areas: DataFrame) -> DataFrame:
    """The layer of an area by its tags; the first rule that holds wins."""
    tag = lambda k: F.coalesce(F.col("tags")[k], F.lit(""))
    layer = (
        F.when((tag("natural") == "water") | tag("landuse").isin("reservoir", "basin"), "water")
        .when(tag("leisure").isin("park", "nature_reserve") | tag("landuse").isin("forest", "recreation_ground") | tag("natural").isin("wood", "heath", "grassland") | (tag("boundary") == "national_park"), "green")
        .when(tag("landuse").isin("farmland", "orchard", "vineyard", "meadow"), "farm")
        .when(tag("landuse").isin("retail", "commercial"), "urban")
    )
    return areas.withColumn("layer", layer).where("layer is not null")


def slice_with_neighbours(spark: SparkSession, path: str, partition: str, values: list, columns: list[str]) -> DataFrame:
    """Rows of some partitions with few columns, and all edges that touch their nodes (columns edge, u, v among them)."""
    every = spark.read.parquet(path)
    own = every.where(F.col(partition).isin(*values)).select(*columns)
    nodes = own.select(F.col("u").alias("node_")).unionAll(own.select(F.col("v").alias("node_"))).distinct()
    other = every.where(~F.col(partition).isin(*values)).select(*columns)
    at_u = other.join(nodes.hint("merge"), F.col("u") == F.col("node_"), "left_semi")
    at_v = other.join(nodes.hint("merge"), F.col("v") == F.col("node_"), "left_semi")
    touching = at_u.unionByName(at_v).dropDuplicates(["edge"])
    return own.withColumn("inside", F.lit(True)).unionByName(touching.withColumn("inside", F.lit(False)))


def report(row: DataFrame, path: str) -> DataFrame:
    """metric, value: a one-row table of numbers written as JSON, one line a metric, and read back."""
    lines = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])).alias("m")
    row.select(lines).select("m.metric", "m.value").write.json(path)
    return row.sparkSession.read.schema("metric string, value double").json(path)
