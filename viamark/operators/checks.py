"""Digests, reconciliation of two builds, guards, reuse of results by content."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viamark.plans.tables import shared_dir


def digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rows, x, s: a digest that does not depend on the order of rows (repeated rows count)."""
    h = F.xxhash64(*(columns or sorted(df.columns)))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s"))


def reused(name: str, inputs: list[DataFrame], params: dict, build) -> DataFrame:
    """The table ``build()`` gives, kept under a name made of its inputs' digests and parameters.

    Parameters that only act afterwards (weights) must not be among ``params``.
    """
    spark = inputs[0].sparkSession
    key = json.dumps([[list(digest(df).first()) for df in inputs], params], sort_keys=True, default=str)
    path = f"{shared_dir(spark)}/reuse/{name}-{hashlib.sha256(key.encode()).hexdigest()[:32]}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def reconcile(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """The key, nth, side (both, old, new) and for each value whether it differs; repeats of a key are numbered."""
    nth = lambda df: df.select(*key, *values, F.row_number().over(Window.partitionBy(*key).orderBy(*values)).alias("nth"))
    a, b = nth(old).withColumn("in_a", F.lit(True)), nth(new).withColumn("in_b", F.lit(True))
    b = b.withColumnsRenamed({v: f"new_{v}" for v in values})
    out = a.join(b.hint("merge"), [*key, "nth"], "full_outer")
    side = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "old").otherwise("new")
    return out.select(*key, "nth", side.alias("side"), *[(side == "both") .__and__(~F.col(v).eqNullSafe(F.col(f"new_{v}"))).alias(f"{v}_differs") for v in values])


def require_empty(df: DataFrame, what: str, shown: int = 20) -> None:
    """Raise with the first rows if there are any."""
    if bad := df.limit(shown).collect():
        raise ValueError(f"{what}: {bad}")


def matches(side: DataFrame, graph: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a side table whose key the graph does not have; must be empty."""
    return side.join(graph.select(*key).distinct().hint("merge"), key, "left_anti")


def complete(df: DataFrame, key: str, expected: int) -> DataFrame:
    """Distinct rows by key, refused if fewer than the source says it has."""
    out = df.dropDuplicates([key])
    got = out.count()
    if got < expected:
        raise ValueError(f"{got} of {expected} rows")
    return out


def refusals(df: DataFrame, reason: Column | str = "reason") -> DataFrame:
    """How many rows each reason drops, kept ones included."""
    r = F.col(reason) if isinstance(reason, str) else reason
    return df.groupBy(F.coalesce(r, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def border_hash(edges: DataFrame, region: str) -> DataFrame:
    """way_id and region with a hash of its edges, to find ways that two regions split differently."""
    return edges.groupBy("way_id", region).agg(F.bit_xor(F.xxhash64("u", "v", F.round("length_m", 3))).alias("hash"), F.count(F.lit(1)).alias("edges"))


def first_examples(df: DataFrame, by: str, order: str, n: int = 20) -> DataFrame:
    """The first ``n`` examples of each check, as an array."""
    top = df.withColumn("rank_", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("rank_") <= n)
    return top.groupBy(by).agg(F.array_sort(F.collect_list(order)).alias("examples"))
