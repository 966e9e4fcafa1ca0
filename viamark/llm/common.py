"""What the text operators share: tables between steps, text columns, Arrow runs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viamark.plans.tables import collecting, drop_paths, ship_package, stage, stored_bytes

__all__ = ["BLANKS", "collecting", "drop_paths", "drop_rows", "lowered", "runs", "ship_package", "stage", "stored_bytes", "text_of", "union_all", "with_row_id", "without_blanks"]

#: The six white-space characters that end a word: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def without_blanks(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def with_row_id(df: DataFrame) -> DataFrame:
    """A number for each row; it is only stable once the result has been staged."""
    return df.withColumn("row_id", F.monotonically_increasing_id())


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def drop_rows(docs: DataFrame, keys: dict[str, Column], dropped: DataFrame, broadcast_bytes: int, best: Column | None = None) -> DataFrame:
    """``docs`` without the rows whose ``keys`` are in ``dropped`` (a staged table: columns named like the keys, and twin).

    Where ``twin`` is set, one row of those keys stays: the one with the greatest ``best``.
    Rows travel inside one struct, so columns of ``docs`` may have any names. The dropped
    keys are broadcast when their stored size is small, else shuffled.
    """
    marked = docs.select(F.struct("*").alias("doc_"), *[e.alias(k) for k, e in keys.items()], (best if best is not None else F.lit(0)).alias("best_"))
    hint = "broadcast" if stored_bytes(dropped) <= broadcast_bytes else "merge"

    def same(other: DataFrame) -> list[Column]:
        return [marked[k].eqNullSafe(other[k]) for k in keys]

    kept = marked.join(dropped.hint(hint), same(dropped), "left_anti").select("doc_.*")
    twins = dropped.where("twin")
    if twins.isEmpty():
        return kept
    again = marked.join(twins.hint(hint), same(twins), "left_semi").groupBy(*keys).agg(F.max_by("doc_", "best_").alias("doc_"))
    return kept.unionByName(again.select("doc_.*"))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup batches that are sorted by ``key`` so that no key's rows are cut in two.

    Memory: one batch and the rows of one key.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table[key].combine_chunks()
        last = keys[-1]
        if held and held[-1][key][-1] != keys[0]:
            yield pa.concat_tables(held).combine_chunks()
            held = []
        if keys[0] == last:
            held.append(table)
            continue
        cut = _first(keys, last)
        yield pa.concat_tables([*held, table.slice(0, cut)]).combine_chunks()
        held = [table.slice(cut)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _first(keys: pa.Array, value: pa.Scalar) -> int:
    """Where the last run begins, by bisection on sorted keys."""
    low, high = 0, len(keys) - 1
    while low < high:
        mid = (low + high) // 2
        if keys[mid] == value:
            high = mid
        else:
            low = mid + 1
    return low
