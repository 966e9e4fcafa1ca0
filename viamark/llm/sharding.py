"""Two-pass external shuffle into shards (DataFrame functions only).

Pass one scatters rows over memory-sized buckets by a seeded hash. Pass two gathers each
bucket and shuffles it with ``shuffle``, Spark's seeded Fisher-Yates. Buckets laid end to
end are a random order of all rows, which is cut into ``n_shards`` equal runs: law
``rows``, counts at most one apart. A bucket holds about ``bucket_rows`` slim rows (ids
and sizes, not texts), however large the input.

Rows that agree in doc_id, size and checksum are interchangeable. They are counted before
the shuffle and numbered from their count, and the number enters the hash, so that many of
them fill all buckets alike. What a row gets depends on the rows alone: the number of
partitions of :func:`assign` is its own, and buckets are sorted before they are shuffled.

Defined cases: a null text has no bytes and the checksum of nothing; a null doc_id is a
value like any other; an empty table gives no rows; with fewer rows than shards some shards
stay empty; further columns of any name are ignored by :func:`assign` and carried by
:func:`write_shards`, but for ``shard`` and ``slot``, which it sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viamark.llm.common import stage, text_of, with_row_id

SHARDS = 40
BUCKET_ROWS = 1 << 16
#: Offsets of this many buckets (24 bytes each) may be broadcast; more are joined by a shuffle.
BROADCAST_BUCKETS = 1 << 20
#: Repeats of one row that a task numbers at once; more go to several tasks.
REPEATS = 4096
#: Partitions of pass two; buckets beyond that share one, a bucket at a time.
MAX_PARTS = 20_000
KEY = ["doc_id", "size", "text_crc32"]


def _keys() -> list[Column]:
    body = text_of().cast("binary")
    return [F.col("doc_id"), (F.octet_length(body) + F.lit(16)).cast("long").alias("size"), F.crc32(body).alias("text_crc32")]


def _numbered(counts: DataFrame) -> DataFrame:
    """KEY and nth, one row for each of the ``n`` repeats of a key."""
    few = counts.where(F.col("n") <= REPEATS).select(*KEY, F.explode(F.expr("sequence(0L, n - 1)")).alias("nth"))
    parts = counts.where(F.col("n") > REPEATS).withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {REPEATS})"))).repartition(*KEY, "part")
    return few.unionByName(parts.select(*KEY, F.explode(F.expr(f"sequence(part * {REPEATS}, least(n, (part + 1) * {REPEATS}) - 1)")).alias("nth")))


def _before(sizes: DataFrame) -> DataFrame:
    """bucket, before: rows of all buckets with a smaller number; runs of 4,096 buckets first, then the runs."""
    runs = sizes.withColumn("run", F.expr("bucket div 4096"))
    inner = F.sum("n").over(Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    # One row for every 4,096 buckets, or 268 million rows of the input.
    total = runs.groupBy("run").agg(F.sum("n").alias("m")).withColumn("outer", F.sum("m").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)))
    joined = runs.withColumn("inner", inner).join(total.select("run", "outer").hint("merge"), "run")
    return joined.select("bucket", (F.coalesce("inner", F.lit(0)) + F.coalesce("outer", F.lit(0))).alias("before"))


def _placed(slim: DataFrame, n_shards: int, seed: int, bucket_rows: int) -> DataFrame:
    """KEY, nth, shard, slot for every row of ``slim`` (KEY)."""
    counts = stage(slim.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), "sizes")
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(n_shards, -(-rows // bucket_rows))
    key = F.xxhash64(F.lit(seed), *KEY, "nth")
    scattered = _numbered(counts).withColumn("key", key).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    record = F.struct("key", *KEY, "nth")
    # The partition of a bucket and its order are fixed, so that the seeded permutation comes out the same again.
    gathered = (
        scattered.repartition(min(buckets, MAX_PARTS), "bucket")
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list(record)).alias("records"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle("records", F.lit(seed)).alias("records"))
    )
    offsets = _before(scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    joined = gathered.join(offsets.hint("broadcast" if buckets <= BROADCAST_BUCKETS else "merge"), "bucket")
    out = joined.select("before", F.posexplode("records").alias("at", "r")).select("r.*", (F.col("before") + F.col("at")).alias("place"))
    out = out.withColumn("shard", F.expr(f"(place * {n_shards}) div {max(rows, 1)}"))
    first = F.expr(f"(shard * {rows} + {n_shards - 1}) div {n_shards}")
    return out.select(*KEY, "nth", F.col("shard").cast("int").alias("shard"), (F.col("place") - first).alias("slot"))


def assign(docs: DataFrame, n_shards: int = SHARDS, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    placed = _placed(docs.select(*_keys()), n_shards, seed, bucket_rows)
    return placed.select(*KEY, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> None:
    """Write ``docs`` with all columns as ``path/shard=N/``, rows in slot order.

    Repeats of a key are numbered by input partition and place in it, so that no task
    numbers more of them than one partition holds.
    """
    body = stage(with_row_id(docs.select(F.struct("*").alias("doc_"), *_keys())), "records")
    slim = body.select("row_id", F.expr("shiftright(row_id, 33)").alias("part"), *KEY)
    per = slim.groupBy(*KEY, "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(*KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select(*[F.col(c).alias(f"{c}_") for c in (*KEY, "part")], F.coalesce(earlier, F.lit(0)).alias("earlier"))
    own = slim.withColumn("own", F.row_number().over(Window.partitionBy(*KEY, "part").orderBy("row_id")) - 1)
    own = own.join(per.hint("merge"), [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*KEY, "part")])
    own = own.select("row_id", *KEY, (F.col("own") + F.col("earlier")).alias("nth"))
    at = _placed(slim.select(*KEY), n_shards, seed, bucket_rows).select(*[F.col(c).alias(f"{c}_") for c in (*KEY, "nth")], "shard", "slot")
    at = own.join(at.hint("merge"), [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*KEY, "nth")]).select("row_id", "shard", "slot")
    full = body.join(at.hint("merge"), "row_id").select(*[F.col(f"doc_.`{c}`") for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
    full.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
