"""Phrases whose words belong together, counted by a multikey three-way quicksort.

Texts are cut into pieces and words inside Arrow batches; each batch first adds up its
own equal suffixes (the next ``max_words`` words from a place, inside its piece). Suffixes
then travel to buckets by their leading word, so that all with one leading word meet and
a partition of fewer than ``least`` occurrences can be abandoned for good. Leading words that are
too frequent for one bucket (at most ``HEAVY_WORDS`` of them, found by a count of all words)
are routed by the whole suffix instead; their shorter prefixes are summed over buckets
afterwards. In a bucket the pointers to suffixes are sorted by a three-way quicksort that
goes one word deeper in each equal partition; the size of an equal partition is the count
of its phrase. All partitions of a pass are split at once, as NumPy arrays. A bucket that
holds more than ``CHUNK`` suffixes all the same is worked on in chunks that abandon
nothing, so memory is bounded and counts stay whole.

Defined cases: a null text is an empty one and a null language is ``und``; a repeated row
counts again; a text of any length is counted whole; ties are settled by the phrase;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viamark.llm.common import ship_package, stage

BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Bytes of text whose suffixes are added up before they travel; a longer text is a block of its own.
BLOCK = 4 << 20
#: Words of the corpus for each bucket, and suffixes held at once.
BUCKET_WORDS, CHUNK = 250_000, 500_000
HEAVY_WORDS = 2_000
#: Parts in which the first of each language are taken before they meet.
PARTS = 64
COUNTS = "lang string, word string, a long"
#: A row has the suffixes of one block for one bucket: its words once, and for each suffix ``max_words`` places among them (-1: none).
SUFFIXES = "bucket long, heavy boolean, lang string, words array<string>, places array<int>, times array<int>"
PHRASES = "lang string, phrase string, a long"

_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_APART = _BREAK.copy()
_APART[[32, 9]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, pa.Array]]:
    """Language, word ids, piece of each word and vocabulary of blocks of texts."""
    for batch in batches:
        for lang in pc.unique(batch["lang"]):
            texts = batch["text"].filter(pc.equal(batch["lang"], lang))
            sizes = np.cumsum(np.asarray(pc.binary_length(texts), np.int64) + 1)
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK, "right")))
                yield lang.as_py(), *_words(texts.slice(at, stop - at))
                at = stop


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")[0]
    raw = np.frombuffer(joined.as_buffer(), np.uint8)
    inside = ~_APART[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    start, end = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    held = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]])]).dictionary_encode()
    return np.asarray(held.indices), np.cumsum(_BREAK[raw], dtype=np.int32)[start], held.dictionary


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, ids, _, words in _blocks(batches):
        n = np.bincount(ids, minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(words)), words, pa.array(n, pa.int64())], names=["lang", "word", "a"])


def _suffixes(max_words: int, buckets: int, heavy: dict[str, set[str]]):
    """Each block's distinct suffixes of two words or more with their number, by bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, piece, words in _blocks(batches):
            n = len(ids) - 1
            if n < 1:
                continue
            first = np.flatnonzero(piece[1:] == piece[:-1])
            deep = np.full((len(first), max_words), -1, np.int64)
            for d in range(max_words):
                at = np.minimum(first + d, n)
                fits = (first + d <= n) & (piece[at] == piece[first])
                deep[fits, d] = ids[at[fits]]
            key = deep[:, 0]
            for d in range(1, max_words):
                key = np.unique(key * (len(words) + 1) + deep[:, d] + 1, return_inverse=True)[1]
            _, one, times = np.unique(key, return_index=True, return_counts=True)
            deep = deep[one]
            if not len(deep):
                continue
            # The last place stands for a missing word.
            hashed = np.concatenate([pd.util.hash_array(np.array(words.to_pylist(), object), categorize=False), np.zeros(1, np.uint64)])
            dense = np.concatenate([np.asarray(pc.is_in(words, value_set=pa.array(sorted(heavy.get(lang, ())), pa.string())), bool), [False]])[deep[:, 0]]
            route = hashed[deep[:, 0]] + pd.util.hash_array(np.array([lang], object), categorize=False)[0]
            for d in range(1, max_words):
                route = np.where(dense, route * np.uint64(0x9E3779B97F4A7C15) + hashed[deep[:, d]], route)
            # Heavy and light suffixes keep apart: only the light ones of a bucket are all there are.
            group = (route ^ (route >> np.uint64(29))) % np.uint64(buckets) * np.uint64(2) + dense
            order = np.argsort(group, kind="stable")
            group, deep, times = group[order].astype(np.int64), deep[order], times[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]).astype(np.int32)
            # Each row's own words, in the order of their ids, and where they stand in it.
            row = np.repeat(np.arange(len(cut) - 1), np.diff(cut) * max_words)
            pairs, inverse = np.unique(row * (len(words) + 1) + deep.ravel() + 1, return_inverse=True)
            own, missing = np.searchsorted(pairs, np.arange(len(cut)) * (len(words) + 1)), pairs % (len(words) + 1) == 0
            none = np.cumsum(missing)
            has = np.zeros(len(cut), np.int32)
            has[:-1] = missing[own[:-1]]
            places = inverse - own[row] - has[row]
            starts = (own - np.concatenate([[0], none])[own]).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(starts), words.take(pa.array(pairs[~missing] % (len(words) + 1) - 1, pa.int32()))),
                pa.ListArray.from_arrays(pa.array(cut * max_words), pa.array(places, pa.int32())),
                pa.ListArray.from_arrays(pa.array(cut), pa.array(times, pa.int32())),
            ]
            found = group[cut[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(found >> 1, pa.int64()), pa.array(found % 2 == 1), pa.repeat(pa.scalar(lang), len(found)), *lists], names=["bucket", "heavy", "lang", "words", "places", "times"])

    return work


def equal_partitions(keys: np.ndarray, times: np.ndarray, least: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of pointers to the rows of ``keys``.

    keys: one column for each depth, -1 where a suffix has ended; times: weight of each row;
    least: for each depth, the weight under which a partition is abandoned. Gives, after each
    pass, for its equal partitions: depth, a row of each, its weight.
    """
    seeded = np.random.default_rng(7)
    n, depth = keys.shape
    flat = np.ascontiguousarray(keys).ravel()
    ptr, sizes, deep = np.arange(n), np.array([n] if n else [], np.int64), np.zeros(1 if n else 0, np.int64)
    least = np.array(least)
    while len(ptr):
        starts = np.cumsum(sizes) - sizes
        part = np.repeat(np.arange(len(sizes)), sizes)
        key = flat[ptr * depth + deep[part]]
        pivot = key[starts + seeded.integers(0, sizes)]
        side = np.sign(key - pivot[part]) + 1
        # Stable counting of the three sides of every partition.
        into = part * 3 + side
        held = np.bincount(into, minlength=3 * len(sizes))
        begin = np.cumsum(held) - held
        place = np.empty(len(ptr), np.int64)
        for s in range(3):
            mine = np.flatnonzero(side == s)
            place[mine] = begin[into[mine]] + np.arange(len(mine)) - (np.cumsum(held[s::3]) - held[s::3])[part[mine]]
        weight = np.bincount(into, weights=times[ptr], minlength=3 * len(sizes)).astype(np.int64)
        ptr[place] = ptr.copy()
        equal = np.arange(3 * len(sizes)) % 3 == 1
        found = equal & (weight >= np.repeat(least[deep], 3)) & (np.repeat(pivot, 3) >= 0)
        for d in np.unique(deep):
            at = found & (np.repeat(deep, 3) == d)
            yield int(d), ptr[begin[at]], weight[at]
        deep = np.repeat(deep, 3) + equal
        alive = np.where(equal, found & (deep < depth), held > 0)
        alive &= weight >= least[np.minimum(deep, depth - 1)]
        keep = np.repeat(alive, held)
        ptr, sizes, deep = ptr[keep], held[alive], deep[alive]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], bool]]:
    """Rows of one bucket, in chunks of about CHUNK suffixes; whether they are all rows of the bucket."""
    held, size, last, cut = [], 0, None, False
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            key = (batch["bucket"][at].as_py(), batch["heavy"][at].as_py())
            if held and (key != last or size >= CHUNK):
                cut = cut or key == last
                yield held, not cut
                cut, held, size = key == last, [], 0
            last = key
            held.append(batch.slice(at, 1))
            size += len(batch["times"][at])
            at += 1
    if held:
        yield held, not cut


def _frequent(max_words: int, least: int):
    """Partial counts of the phrases of two words or more in each bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, whole in _gathered(batches):
            table = pa.Table.from_batches(held).combine_chunks()
            times = np.asarray(pc.list_flatten(table["times"]).combine_chunks()).astype(np.int64)
            langs, words = table["lang"].combine_chunks().dictionary_encode(), pc.list_flatten(table["words"]).combine_chunks().dictionary_encode()
            lengths, first = (np.asarray(pc.list_value_length(table[c].combine_chunks()), np.int64) for c in ("times", "words"))
            row = np.repeat(np.arange(len(table)), lengths)
            places = np.asarray(pc.list_flatten(table["places"]).combine_chunks()).reshape(-1, max_words)
            at = np.where(places < 0, 0, places + (np.cumsum(first) - first)[row][:, None])
            ids = np.where(places < 0, -1, np.asarray(words.indices)[at])
            keys = np.column_stack([np.asarray(langs.indices)[row], ids])
            # A heavy leading word has its suffixes in many buckets: only whole suffixes can be abandoned here.
            alone = not table["heavy"][0].as_py()
            if not whole:
                bounds = [1] * (max_words + 1)
            else:
                bounds = [least if alone else 1] * max_words + [least]
            for d, rows, weight in equal_partitions(keys, times, bounds):
                if d >= 2 and len(rows):
                    parts = [words.dictionary.take(pa.array(ids[rows, k], pa.int32())) for k in range(d)]
                    yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(keys[rows, 0], pa.int32())), pc.binary_join_element_wise(*parts, " "), pa.array(weight, pa.int64())], names=["lang", "phrase", "a"])

    return work


def count_phrases(docs: DataFrame, max_words: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Staged tables (lang, n: all words) and (lang, phrase, a): phrases of 1 to ``max_words`` words found ``least`` times."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = stage(texts.mapInArrow(_count_words, COUNTS).groupBy("lang", "word").agg(F.sum("a").alias("a")), "words")
    totals = stage(words.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    # At most HEAVY_WORDS rows, as each has that part of all words.
    heavy: dict[str, set[str]] = {}
    for r in words.where(F.col("a") >= max(BUCKET_WORDS // 2, -(-total // HEAVY_WORDS))).select("lang", "word").collect():
        heavy.setdefault(r.lang, set()).add(r.word)
    suffixes = texts.mapInArrow(_suffixes(max_words, total // BUCKET_WORDS + 1, heavy), SUFFIXES)
    routed = suffixes.repartition("bucket", "heavy").sortWithinPartitions("bucket", "heavy")
    longer = routed.mapInArrow(_frequent(max_words, least), PHRASES).groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    phrases = longer.unionByName(words.withColumnRenamed("word", "phrase")).where(F.col("a") >= least)
    return totals, stage(phrases, "phrases")


def mine(docs: DataFrame, max_words: int = 3, least: int = 10, inside_percent: int = 50, top: int = 2_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    A phrase of 2 to ``max_words`` words scores floor(10^6 a^2 / (l r)) at its lowest cut; one
    that lies inside a longer one with ``inside_percent`` of its count or more is dropped.
    """
    totals, phrases = count_phrases(docs, max_words, least)
    several = phrases.withColumn("w", F.split("phrase", " ")).where("size(w) > 1")
    cuts = several.withColumn("k", F.explode(F.expr("sequence(1, size(w) - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("concat_ws(' ', slice(w, 1, k))").alias("left"), F.expr("concat_ws(' ', slice(w, k + 1, size(w)))").alias("right"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")).hint("merge"), ["lang", "left"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")).hint("merge"), ["lang", "right"])
    score = F.expr("(cast(a as decimal(19, 0)) * cast(a as decimal(19, 0)) * 1000000) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s"))
    # Every phrase inside a longer one, with the count of the longer one.
    inner = several.where("size(w) > 2").withColumn("m", F.explode(F.expr("sequence(2, size(w) - 1)")))
    inner = inner.withColumn("i", F.explode(F.expr("sequence(1, size(w) - m + 1)"))).select("lang", F.expr("concat_ws(' ', slice(w, i, m))").alias("phrase"), "a")
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    left = scored.join(around.hint("merge"), ["lang", "phrase"], "left").where(F.expr(f"outer is null or 100 * cast(outer as decimal(20, 0)) < {inside_percent} * cast(a as decimal(20, 0))"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = stage(left.select("lang", "phrase", "a", "s.l", "s.r", "s.score"), "scored").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    # First inside parts of a language, so that no task sorts all of one.
    some = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return some.join(totals.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
