"""Substring dedup by content-defined chunking.

A gear hash over the last 16 bytes rolls over every text. A chunk ends after a word whose
hash is the largest among its ``REACH`` neighbours on either side, so cut points depend on
nearby text only and come back soon after an insertion; chunks have ``REACH`` + 1 words or
more and about twice that on average. Chunks are compared by a 64-bit digest of their
words (white space is ignored). Of equal chunks the document with the smallest doc_id
keeps its own; in other documents a run of such chunks with ``min_words`` words or more is
removed, so a phrase that recurs by chance stays. Repeats inside a document are removed
after the first in the same way.

Digests are counted with map-side partial aggregation, so a passage that many documents
share is one row for each task; digests found once never travel again.

Defined cases: a null or empty text has no chunks and stays as it is; rows with the same
doc_id count as one document, of which none loses to another; rows without a doc_id come
after all others, in the order of a hash of their texts, and those with equal texts count as one document; further columns of any name are ignored, or carried by
:func:`remove`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viamark.llm.common import ship_package, stage, stored_bytes, with_row_id
from viamark.llm.textbytes import BLANK_TABLE, blocks, mixed, powers, words

REACH = 2
MIN_WORDS = 16
#: Stored size up to which the spans to remove are broadcast; above it they are shuffled.
BROADCAST_BYTES = 8 << 20
GEAR = mixed(np.where(BLANK_TABLE == 0, 0, np.arange(256)).astype(np.uint64) + np.uint64(1)).astype(np.uint32)


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """The sum of GEAR[byte] << age over the last 16 bytes, by doubling the window."""
    h = GEAR[raw]
    for w in (1, 2, 4, 8):
        longer = h.copy()
        longer[w:] += h[:-w] << np.uint32(w)
        h = longer
    return h


def chunk_ends(w) -> np.ndarray:
    """Whether a chunk ends after each word."""
    at = w.end - 1
    score = np.where(at - w.text_start[w.doc] >= 15, gear_hash(w.raw)[at].astype(np.int64), -1)
    ends = score >= 0
    for k in range(1, REACH + 1):
        same = w.doc[k:] == w.doc[:-k]
        ends[k:] &= ~same | (score[k:] > score[:-k])
        ends[:-k] &= ~same | (score[:-k] >= score[k:])
    ends[w.first[1:][np.diff(w.first) > 0] - 1] = True
    return ends


def chunk_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a block: offsets of each text's chunks, and of each chunk: digest, words, start (code points); words of texts."""
    w = words(texts, BLANK_TABLE)
    if not len(w.start):
        none = np.zeros(0, np.int64)
        return np.zeros(len(texts) + 1, np.int64), none, none, none, np.zeros(len(texts), np.int64)
    last = np.flatnonzero(chunk_ends(w))
    first = np.concatenate([[0], last[:-1] + 1])
    up, down = powers(len(w.hash) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * up[:-1], dtype=np.uint64)])
    size = last - first + 1
    digest = mixed((total[last + 1] - total[first]) * down[first] + size.astype(np.uint64))
    points = np.concatenate([[0], np.cumsum((w.raw & 0xC0) != 0x80)])
    doc = w.doc[first]
    start = points[w.start[first]] - points[w.text_start[doc]]
    offsets = np.searchsorted(doc, np.arange(len(texts) + 1))
    return offsets, digest.view(np.int64), size, start, np.diff(w.first)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, stop in blocks(b["text"]):
            part = b.slice(at, stop - at)
            offsets, digest, size, start, n = chunk_texts(part["text"])
            off = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(off, pa.array(x, kind)) for x, kind in ((digest, pa.int64()), (size, pa.int32()), (start, pa.int32()))]
            yield pa.RecordBatch.from_arrays([part["row_id"], part["doc_id"], part["text_hash"], pa.array(n, pa.int64()), *lists], names=["row_id", "doc_id", "text_hash", "n_words", "digests", "sizes", "starts"])


CHUNKS = "row_id long, doc_id long, text_hash long, n_words long, digests array<long>, sizes array<int>, starts array<int>"
SPANS = "row_id long, doc_id long, text_hash long, n_words long, n_chunks long, repeat_words long, removed_words long, removed array<struct<start:int,stop:int>>"


def _runs(flags: np.ndarray, sizes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of flagged chunks with at least so many words: first chunk, chunk after."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    total = np.concatenate([[0], np.cumsum(sizes)])
    return [(a, z) for a, z in edges.reshape(-1, 2).tolist() if total[z] - total[a] >= least]


def _spans(min_words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared, removed, spans, counts = [], [], [], []
            for digests, sizes, starts, again, mine in zip(*(b[c].to_pylist() for c in ("digests", "sizes", "starts", "again", "mine")), strict=True):
                digests, sizes = np.array(digests, np.int64), np.array(sizes, np.int64)
                counts.append(len(digests))
                later = np.ones(len(digests), bool)
                later[np.unique(digests, return_index=True)[1]] = False
                again, mine = np.array(again or (), np.int64), np.array(mine or (), np.int64)
                found = np.isin(digests, again)
                out = _runs(later | (found & ~np.isin(digests, mine)), sizes, min_words)
                shared.append(sum(int(sizes[a:z].sum()) for a, z in _runs(later | found, sizes, min_words)))
                removed.append(sum(int(sizes[a:z].sum()) for a, z in out))
                spans.append([{"start": starts[a], "stop": starts[z] if z < len(starts) else None} for a, z in out])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b["row_id"], b["doc_id"], b["text_hash"], b["n_words"], pa.array(counts, pa.int64()), pa.array(shared, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind)], names=["row_id", "doc_id", "text_hash", "n_words", "n_chunks", "repeat_words", "removed_words", "removed"])

    return work


def find(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: words in repeated runs, and the spans to remove (code points; a null stop is the end)."""
    ship_package(docs.sparkSession)
    d = with_row_id(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")))
    chunks = stage(d.mapInArrow(_chunked, CHUNKS), "chunks")
    # Document order: by doc_id, then rows without one. What is cut from a row depends on its doc_id and text alone.
    owner = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", "text_hash").alias("by"))
    each = chunks.select("row_id", owner.alias("owner"), F.explode(F.array_distinct("digests")).alias("digest"))
    counted = each.groupBy("digest").agg(F.min("owner").alias("keeper"), F.count(F.lit(1)).alias("n"))
    repeated = stage(counted.where("n > 1").select("digest", "keeper"), "repeated")
    hits = each.join(repeated.hint("merge"), "digest")
    lists = hits.groupBy("row_id").agg(F.collect_list("digest").alias("again"), F.collect_list(F.when(F.col("keeper") == F.col("owner"), F.col("digest"))).alias("mine"))
    return chunks.join(lists.hint("merge"), "row_id", "left").mapInArrow(_spans(min_words), SPANS)


def remove(docs: DataFrame, min_words: int = MIN_WORDS, facts: bool = False) -> DataFrame:
    """``docs`` with repeated runs cut out of ``text``; rows, order of columns and types stay.

    facts: add repeat_words (in runs that repeat, whoever keeps them) and removed_words, in
    place of columns of ``docs`` that have these names.
    Only rows that take part in a repeat are joined: broadcast when their stored size is
    small, else shuffled.
    """
    found = find(docs, min_words).where("repeat_words > 0").select("doc_id", "text_hash", "repeat_words", "removed_words", "removed")
    cut = stage(found.dropDuplicates(["doc_id", "text_hash"]), "cuts")
    small = stored_bytes(cut) <= BROADCAST_BYTES
    # Rows travel inside one struct, so their columns may have any names.
    marked = docs.select(F.struct("*").alias("doc_"), "text", F.col("doc_id").alias("id_"), F.xxhash64("text").alias("hash_"))
    on = [marked["id_"].eqNullSafe(cut["doc_id"]), marked["hash_"] == cut["text_hash"]]
    # Kept pieces lie between one removed span's stop and the next one's start.
    begin = "if(k = 0, 0, coalesce(removed[k - 1].stop, length(text)))"
    kept = F.expr(f"concat_ws('', transform(sequence(0, size(removed)), k -> substring(text, {begin} + 1, if(k = size(removed), length(text), removed[k].start) - {begin})))")
    joined = marked.join(cut.hint("broadcast" if small else "merge"), on, "left")
    text = F.when(F.coalesce(F.size("removed"), F.lit(0)) > 0, kept).otherwise(F.col("text"))
    more = {c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("repeat_words", "removed_words")} if facts else {}
    return joined.select(*[text.alias(c) if c == "text" else F.col("doc_").getField(c).alias(c) for c in docs.columns if c not in more], *more.values())
