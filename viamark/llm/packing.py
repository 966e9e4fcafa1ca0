"""Packing token sequences: first-fit decreasing with a tournament tree, in random groups.

A document becomes its ids and one end id. Full pieces of ``length`` ids are sequences of
their own; what is left over is packed by first-fit decreasing. A tournament tree holds
the largest free space below each node, so the first bin with room is found in log n steps.
Pieces are dealt to groups of about ``GROUP`` by a seeded hash, and groups are packed
independently of each other: memory and time of a task do not grow with the input.

Ids are those of the ``tokenizers`` file; the rank file of the same vocabulary gives the
same ids faster, and texts that contain a special token's string go to ``tokenizers``.

Defined cases: a null or empty text is the end id alone; each input row is packed, repeated
rows too; further columns of any name are ignored; an empty table gives no pieces; a text of
any length is encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viamark.llm.common import ship_package, stage, text_of, with_row_id

LENGTH, END_ID = 1024, 0
GROUP = 4096
SPECIAL = "<|endoftext|>"
PIECES = "row_id long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PACKED = f"{PIECES}, sequence_id long, offset long"


def first_fit(sizes: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, in the order given; bins hold ``room``."""
    leaves = 1
    while leaves < max(len(sizes), 1):
        leaves *= 2
    free = [room] * (2 * leaves)
    bins, offsets = [], []
    for size in sizes:
        v = 1
        while v < leaves:
            v *= 2
            if free[v] < size:
                v += 1
        bins.append(v - leaves)
        offsets.append(room - free[v])
        free[v] -= size
        while v > 1:
            v //= 2
            free[v] = max(free[2 * v], free[2 * v + 1])
    return bins, offsets


@lru_cache(maxsize=1)
def _encoders():
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def encode(text: str) -> list[int]:
    fast, exact = _encoders()
    return exact.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)


def _cut(length: int, with_ids: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                rows, out = b.slice(at, 512), []
                for row_id, doc_id, text in zip(*(rows[c].to_pylist() for c in ("row_id", "doc_id", "text")), strict=True):
                    ids = np.array([*encode(text), END_ID], "<u4")
                    for start in range(0, len(ids), length):
                        piece = ids[start : start + length].tobytes()
                        out.append((row_id, doc_id, start, len(piece) // 4, zlib.crc32(piece), len(ids), piece if with_ids else None))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 6 + [pa.binary()]
                names = ["row_id", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return work


def _pack(length: int):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit(table["length"].to_pylist(), length)
        group = table["group"][0].as_py() << 32
        table = table.append_column("sequence_id", pa.array([group + b for b in bins], pa.int64()))
        return table.append_column("offset", pa.array(offsets, pa.int64())).drop_columns("group")

    return work


def pack(docs: DataFrame, length: int = LENGTH, seed: int = 17, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """One row per piece: its place in its document and in its sequence, and its ids if asked for."""
    ship_package(docs.sparkSession)
    d = with_row_id(docs.select("doc_id", text_of().alias("text")))
    pieces = stage(d.mapInArrow(_cut(length, with_ids), PIECES), "pieces")
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "row_id", "start"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(_pack(length), PACKED)
