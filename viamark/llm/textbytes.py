"""Words of many texts at once, as NumPy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is a block of its own.
BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """Byte to byte: separators become 0, A-Z lower case if asked for."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


#: Words of ``[^\x20\x09-\x0D]`` (and no NUL), and lower-case words of letters and digits.
BLANK_TABLE = byte_table(b"\0 \t\n\x0b\x0c\r", False)
WORD_TABLE = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()), True)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate([one, np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (BASE, INVERSE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(max(BLOCK * 2, 1 << (n - 1).bit_length()))
    return up[:n], down[:n]


@dataclass
class Words:
    raw: np.ndarray  #: all bytes of the block, with a separator after each text
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    doc: np.ndarray  #: text of each word
    hash: np.ndarray  #: 64-bit hash of each word
    first: np.ndarray  #: first word of each text, and the number of words
    text_start: np.ndarray  #: first byte of each text


def blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        yield at, stop
        at = stop


def words(texts: pa.Array, table: np.ndarray) -> Words:
    """The words of a block of texts; a null text has none."""
    listed = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts.to_pylist()]
    raw = np.frombuffer(b"\0".join([*listed, b""]), np.uint8)
    sizes = np.fromiter(map(len, listed), np.int64, len(listed)) + 1
    text_start = np.cumsum(sizes) - sizes
    plain = table[raw]
    plain[text_start + sizes - 1] = 0
    inside = np.concatenate([[False], plain != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(plain.astype(np.uint64) * up[:-1], out=total[1:])
    hashed = mixed((total[end] - total[start]) * down[start])
    doc = np.searchsorted(text_start, start, "right") - 1
    first = np.searchsorted(start, np.concatenate([text_start, [len(raw)]]))
    return Words(raw, start, end, doc, hashed, first, text_start)
