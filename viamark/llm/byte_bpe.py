"""Byte-level BPE: overlapping chunk encoding, and decoding by concatenating raw bytes.

A text of up to ``chunk_chars`` characters is pre-tokenised and encoded where it lies.
Longer texts are cut into chunks that overlap, which Spark deals out to all tasks. The
pattern has no look-behind, so from any common pre-token boundary on two chunks agree;
neighbours are joined at the first boundary that both show in their overlap. Where an
overlap has no common boundary (one very long run), the whole text is encoded at once in
the task that joins it. Each distinct piece is merged once while a worker remembers it.

Defined cases: a null or empty text has no tokens; each input row gives one row; further
columns are ignored. Memory of a task: the vocabulary, a bounded memory of pieces, one
Arrow batch, and for joining the chunks of one document.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viamark.llm.common import ship_package, text_of, with_row_id

CHUNK_CHARS, OVERLAP = 1 << 15, 1 << 10
#: Characters before the end of a chunk where a boundary may still depend on what follows.
UNSURE = 8
REMEMBERED = 1 << 20
DIGESTS = "row_id long, doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS = "row_id long, doc_id long, ids array<int>"


class Pieces(dict):
    """Piece to ids, filled as pieces are met."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        rank = self.ranks.get(raw)
        ids = self[piece] = (rank,) if rank is not None else tuple(merge(raw, self.ranks))
        return ids


def merge(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Join the neighbours of lowest rank, leftmost first, until none has a rank."""
    if len(raw) > 100:
        return _merge_long(raw, ranks)
    parts = [raw[i : i + 1] for i in range(len(raw))]
    get, none = ranks.get, len(ranks) + 1
    pairs = [get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pairs and (best := min(pairs)) != none:
        i = pairs.index(best)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs: n log n for one long piece."""
    n = len(raw)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or end[j] != stop:
            continue
        gone[j], end[i], after[i] = 1, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(raw[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (p := before[i]) >= 0 and (r := ranks.get(raw[p : end[i]])) is not None:
            heapq.heappush(heap, (r, p, end[i]))
    return [ranks[raw[i : end[i]]] for i in range(n) if not gone[i]]


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.pieces = Pieces(ranks)
        size = max(ranks.values(), default=-1) + 1
        self.raw: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.raw[i] = token
        self.digits = [str(i) for i in range(size)]

    def encode(self, text: str) -> list[int]:
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        listed = ",".join(map(self.digits.__getitem__, ids))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


@lru_cache(maxsize=1)
def codec(ranks_file: str | None = None, pattern: str | None = None) -> Codec:
    """ranks_file: lines of base64 token and rank, at the same path on every executor."""
    if ranks_file is None or pattern is None:
        import public_tokenizers

        ranks_file = ranks_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    with open(ranks_file, "rb") as lines:
        return Codec({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)


def join_chunks(c: Codec, parts: list[str], found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], step: int) -> list[int]:
    """The ids of a whole text from those of its chunks.

    parts: the chunks with their overlaps; found: for each the starts of its pre-tokens,
    how many ids precede each of them (and all), and its ids.
    """
    out, begin = [], 0
    for k, (starts, before, ids) in enumerate(found):
        if k + 1 == len(found):
            stop = len(starts)
        else:
            mine = starts[(starts >= step) & (starts <= len(parts[k]) - UNSURE)] - step
            theirs = found[k + 1][0]
            common = np.intersect1d(mine, theirs[theirs <= len(parts[k]) - step - UNSURE])
            if not len(common):
                return c.encode("".join(p[:step] for p in parts[:-1]) + parts[-1])
            stop = int(np.searchsorted(starts, common[0] + step))
        first = int(np.searchsorted(starts, begin))
        out.append(ids[before[first] : before[stop]])
        if k + 1 < len(found):
            begin = int(common[0])
    return np.concatenate(out).tolist()


def encode(docs: DataFrame, digests: bool = False, ranks_file: str | None = None, pattern: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs``: its ids, or only their number and two digests."""
    schema = DIGESTS if digests else IDS

    def finish(c: Codec, row_ids, doc_ids, ids: list[list[int]]) -> pa.RecordBatch:
        if digests:
            n, a, b = zip(*map(c.digests, ids), strict=True) if ids else ((), (), ())
            return pa.RecordBatch.from_arrays([row_ids, doc_ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["row_id", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return pa.RecordBatch.from_arrays([row_ids, doc_ids, pa.array(ids, pa.list_(pa.int32()))], names=["row_id", "doc_id", "ids"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_file, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield finish(c, part["row_id"], part["doc_id"], [c.encode(t) for t in part["text"].to_pylist()])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_file, pattern)
        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1)
                pieces = c.split(row["part"][0].as_py())
                starts = np.cumsum([0, *map(len, pieces)], dtype=np.int64)[:-1]
                ids = [c.pieces[p] for p in pieces]
                before = np.cumsum([0, *map(len, ids)], dtype=np.int64)
                flat = np.fromiter(chain.from_iterable(ids), np.int32)
                raw = [pa.array([x.tobytes()], pa.binary()) for x in (starts, before, flat)]
                yield pa.RecordBatch.from_arrays([row["row_id"], row["doc_id"], row["k"], row["part"], *raw], names=["row_id", "doc_id", "k", "part", "starts", "before", "ids"])

    def stitched(rows: pa.Table) -> pa.Table:
        c = codec(ranks_file, pattern)
        rows = rows.sort_by("k")
        found = [tuple(np.frombuffer(x, kind) for x, kind in zip(raw, (np.int64, np.int64, np.int32), strict=True)) for raw in zip(*(rows[n].to_pylist() for n in ("starts", "before", "ids")), strict=True)]
        ids = join_chunks(c, rows["part"].to_pylist(), found, chunk_chars)
        one = rows.slice(0, 1).combine_chunks().to_batches()[0]
        return pa.Table.from_batches([finish(c, one["row_id"], one["doc_id"], [ids])])

    ship_package(docs.sparkSession)
    d = with_row_id(docs.select("doc_id", text_of().alias("text")))
    short = d.where(F.length("text") <= chunk_chars).mapInArrow(whole, schema)
    # A last chunk that would lie inside its predecessor's overlap is not cut off.
    n = F.expr(f"greatest(0, (length(text) - {overlap} - 1) div {chunk_chars})")
    cut = d.where(F.length("text") > chunk_chars).select("row_id", "doc_id", "text", F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("k"), n.alias("n"))
    size = F.when(F.col("k") == F.col("n"), F.length("text")).otherwise(chunk_chars + overlap)
    cut = cut.select("row_id", "doc_id", "k", F.col("text").substr(F.col("k") * chunk_chars + 1, size).alias("part"))
    done = cut.repartition("row_id", "k").mapInArrow(chunks, "row_id long, doc_id long, k int, part string, starts binary, before binary, ids binary")
    return short.unionByName(done.groupBy("row_id").applyInArrow(stitched, schema))


def decoder(ranks_file: str | None = None) -> Callable[[pd.Series], pd.Series]:
    """A function for ``F.pandas_udf(.., 'binary')``: arrays of ids to raw bytes."""

    def decode(ids: pd.Series) -> pd.Series:
        c = codec(ranks_file)
        return ids.map(lambda x: None if x is None else c.decode(x))

    return decode
