"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary becomes a byte trie with two roots: pieces that begin a word and pieces
that continue one. Every node gets a failure link and the number of pieces that are
complete when it is followed; both are folded into one transition table, so that a byte
costs one look-up and no piece is ever built. The tables are computed once in each Python
worker and shared by all its tasks. The words of a batch advance together, one byte each
step, and each distinct word of a batch is walked once.

The vocabulary is read from a SentencePiece model: ``▁x`` begins a word with ``x``
and ``x`` continues one. Words are runs of ``[^\\x20\\x09-\\x0D]``. A word with no
segmentation counts as one unknown token.

Defined cases: a null or empty text has no words and no tokens; each input row gives one
row, repeated rows too; an empty table gives no rows; further columns of any name are
ignored; a word of any length is walked whole. Memory of a task: the tables and one batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from viamark.llm.common import ship_package, with_row_id

MARK = "▁"
#: Words of more bytes than this are walked alone, so that a batch advances no further than its usual words.
LONG = 4096
SCHEMA = "row_id long, doc_id long, n_words long, n_tokens long, n_unknown long"


def pieces_of(model_file: str) -> tuple[frozenset[str], frozenset[str]]:
    """Pieces that begin a word, and pieces that continue one."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return frozenset(p[1:] for p in plain if p.startswith(MARK) and len(p) > 1), frozenset(p for p in plain if not p.startswith(MARK))


class Automaton:
    """``go[v, byte]`` is the next node, ``pops[v, byte]`` the pieces completed on the way.

    ``last[v]`` is how many pieces complete a word that ends at ``v``, -1 if none do.
    Node 0 is dead, 1 the root of beginning pieces, 2 the root of continuing ones.
    """

    def __init__(self, begin: frozenset[str], inside: frozenset[str]):
        children: list[dict[int, int]] = [{}, {}, {}]
        ends: set[int] = set()
        for root, pieces in ((1, begin), (2, inside)):
            for piece in pieces:
                v = root
                for c in piece.encode():
                    if c not in children[v]:
                        children[v][c] = len(children)
                        children.append({})
                    v = children[v][c]
                ends.add(v)
        n = len(children)
        self.go = np.zeros((n, 256), np.int32)
        self.pops = np.zeros((n, 256), np.uint8)
        self.last = np.full(n, -1, np.int32)
        self.last[2] = 0
        fail, popped = np.zeros(n, np.int64), np.zeros(n, np.int64)
        level = [1, 2]
        while level:
            below = []
            for v in level:
                if f := fail[v]:
                    self.go[v] = self.go[f]
                    self.pops[v] = self.pops[f] + popped[v]
                    self.last[v] = -1 if self.last[f] < 0 else popped[v] + self.last[f]
                for c, u in children[v].items():
                    if u in ends:
                        fail[u], popped[u] = 2, 1
                    elif (f := fail[v]) and self.go[f, c]:
                        fail[u], popped[u] = self.go[f, c], popped[v] + self.pops[f, c]
                    self.go[v, c], self.pops[v, c] = u, 0
                    below.append(u)
            level = below
        self.go, self.pops = self.go.ravel(), self.pops.ravel()

    def walk(self, raw: bytes) -> tuple[int, bool]:
        """Tokens of one long word, byte by byte, and whether it is unknown."""
        go, pops, v, n = memoryview(self.go), memoryview(self.pops), 1, 0
        for c in raw:
            slot = v * 256 + c
            n += pops[slot]
            v = go[slot]
            if not v:
                return 1, True
        rest = int(self.last[v])
        return (1, True) if rest < 0 else (n + rest, False)

    def count(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each word, and whether it is unknown."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        tokens, unknown = np.zeros(len(raw), np.int64), np.zeros(len(raw), bool)
        long = [i for i, w in enumerate(raw) if len(w) > LONG]
        for i in long:
            tokens[i], unknown[i] = self.walk(raw[i])
            raw[i] = b""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(raw), np.uint8)
        start = np.cumsum(size) - size
        first, size = start[order], size[order]
        at, seen = np.ones(len(raw), np.int64), np.zeros(len(raw), np.int64)
        live = len(raw)
        for j in range(int(size[0]) if live else 0):
            live = int(np.searchsorted(-size, -j, "left"))  # words longer than j come first
            if not live:
                break
            slot = at[:live] * 256 + data[first[:live] + j]
            seen[:live] += self.pops[slot]
            at[:live] = self.go[slot]
        rest = self.last[at]
        lost = (rest < 0) | (at == 0)
        short = np.ones(len(raw), bool)
        short[long] = False
        mine = short[order]
        tokens[order[mine]] = np.where(lost, 1, seen + rest)[mine]
        unknown[order[mine]] = lost[mine]
        return tokens, unknown


@lru_cache(maxsize=1)
def automaton(model_file: str) -> Automaton:
    return Automaton(*pieces_of(model_file))


def count(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """row_id, doc_id, n_words, n_tokens, n_unknown for every row of ``docs``; no shuffle.

    model_file must be readable at the same path on every executor; None: the public
    32,000-piece model.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = model_file
        if file is None:
            import public_tokenizers

            file = public_tokenizers.path("piece_bpe_32k.model")
        auto = automaton(file)
        for batch in batches:
            seen: dict[str, int] = {}
            ids, sizes = [], []
            for text in batch["text"].to_pylist():
                words = words_of(text)
                ids.extend([seen.setdefault(w, len(seen)) for w in words])
                sizes.append(len(words))
            tokens, unknown = auto.count(list(seen)) if seen else (np.zeros(0, np.int64), np.zeros(0, bool))
            ids, sizes = np.array(ids, np.int64), np.array(sizes, np.int64)
            ends = np.cumsum(sizes)
            total, none = (np.concatenate([[0], np.cumsum(x[ids])]) if len(ids) else np.zeros(1, np.int64) for x in (tokens, unknown.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch["row_id"], batch["doc_id"], pa.array(sizes), pa.array(total[ends] - total[ends - sizes]), pa.array(none[ends] - none[ends - sizes])],
                names=["row_id", "doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    ship_package(docs.sparkSession)
    return with_row_id(docs.select("doc_id", "text")).mapInArrow(work, SCHEMA)


_OTHER = dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")


def words_of(text: str | None) -> list[str]:
    """Runs of ``[^\\x20\\x09-\\x0D]``; str.split() would also cut at other Unicode spaces."""
    return [w for w in (text or "").translate(_OTHER).split(" ") if w]
