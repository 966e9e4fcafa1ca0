"""Exact dedup with a heavy-hitter split (DataFrame functions only).

Texts are equal when they are identical after deleting white space. A Misra-Gries
summary (``freqItems``, at most ``1 / support`` counters a partition) names digests that
may be frequent. Their exact counts and winners are computed with map-side partial
aggregation, and those that prove frequent are broadcast: at most ``1 / support`` rows,
whatever the input. Every row of such a digest is settled map-side; only the other
digests are counted and shuffled, and a group among them is joined back by parts.

Defined cases: a null text is an empty one; null ``doc_id`` sorts after all others; rows
that repeat a document entirely form a group in which exactly one row stays; an empty
table gives an empty result; further columns of any name are ignored by :func:`resolve` and carried
by :func:`keep_one`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viamark.llm.common import drop_rows, stage, text_of, union_all, with_row_id, without_blanks

SUPPORT = 0.001
#: A set of dropped rows up to this size (as stored) is sent to every executor; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20


def _digest() -> Column:
    return F.sha2(without_blanks(text_of()).cast("binary"), 256)


def _rank() -> Column:
    """The row that sorts first stays."""
    return F.struct((-F.col("n_points")).alias("fewer"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_id")


def resolve(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, n_points, text_sha256, keep (struct), group_size."""
    slim = docs.select("doc_id", F.length(text_of()).alias("n_points"), _digest().alias("text_sha256"))
    slim = stage(with_row_id(slim), "digests").withColumn("h", F.xxhash64("text_sha256"))
    rows = slim.count()
    found = slim.freqItems(["h"], support).select(F.explode("h_freqItems").alias("h"))
    group = (F.min(_rank()).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    suspects = slim.join(F.broadcast(found), "h", "left_semi").groupBy("text_sha256").agg(*group)
    winners = stage(suspects.where(F.col("group_size") >= max(2.0, support * rows)), "winners")
    slim = slim.drop("h")
    hot = slim.join(F.broadcast(winners), "text_sha256")
    rest = slim.join(F.broadcast(winners), "text_sha256", "left_anti")
    # Groups that are not frequent may still be large: they are counted before the shuffle, and the join back may be split.
    repeats = rest.groupBy("text_sha256").agg(*group).where("group_size > 1")
    own = F.struct(F.col("fewer"), F.col("unnamed"), "doc_id", "row_id")
    alone = rest.withColumns({"fewer": -F.col("n_points"), "unnamed": F.col("doc_id").isNull()}).join(repeats.hint("merge"), "text_sha256", "left")
    rest = alone.withColumns({"keep": F.coalesce("keep", own), "group_size": F.coalesce("group_size", F.lit(1))})
    return union_all(hot, rest.select(*hot.columns))


def report(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    return resolve(docs, support).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("keep.row_id")).alias("kept"), "text_sha256",
    )


def keep_one(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only dropped rows travel: broadcast when their stored size is small, else shuffled.
    Rows are told apart by doc_id and digest; where the row that stays has twins in both,
    the longest of them is picked afterwards.
    """
    found = resolve(docs, support)
    is_kept = F.col("row_id") == F.col("keep.row_id")
    twin = F.col("doc_id").eqNullSafe(F.col("keep.doc_id"))
    dropped = stage(found.where(~is_kept).select("doc_id", "text_sha256", twin.alias("twin")).distinct(), "dropped")
    return drop_rows(docs, {"doc_id": F.col("doc_id"), "text_sha256": _digest()}, dropped, BROADCAST_BYTES, F.length(text_of()))
