"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts become sets of five-word shingles (lower-case words of letters and digits; a text
of one to four words is one shingle). Rows with equal sets form a class, which is compared
once. MinHash values, ``BANDS`` x ``ROWS``, give candidates: classes that agree in a band.
Candidates are compared value by value in steps and dropped as soon as the posterior
probability that their Jaccard similarity reaches the threshold (uniform prior, so a
binomial tail) falls below ``TOLERANCE``. Survivors tie classes to clusters; inside a
cluster pairs are pruned the same way and the rest are verified exactly on their shingles.

At similarity 0.8 a pair has no common band with probability (1 - 0.8^4)^32 < 5e-8.

Skew: equal rows collapse before anything is joined. A band or cluster that holds more
than ``BLOCK`` classes is cut into blocks by hash and its pairs of blocks go to separate
tasks, so a task holds two blocks at most. Tasks return a row per class and block pair,
never a row per pair. Nothing is capped.

Defined cases: a text without words (null, empty, punctuation) has no links and is its own
group; repeated rows are links of each other, and :func:`keep_one` keeps one of them;
further columns of any name are ignored, or carried by :func:`keep_one`; a null doc_id is
never a group's id if the group has another; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viamark.llm.common import drop_rows, runs, ship_package, stage, stored_bytes, with_row_id
from viamark.llm.textbytes import WORD_TABLE, blocks, mixed, words
from viamark.operators.components import components

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEPS = (16, 32, 64, 96, 128)
BLOCK = 1024
#: Stored size up to which ids of candidates, or of dropped rows, are broadcast; above it they are shuffled.
BROADCAST_BYTES = 16 << 20
_seeds = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS, SHIFTS = _seeds[:HASHES] | np.uint64(1), _seeds[HASHES:]
#: Columns of shingles that one step of the exact comparison counts.
WIDTH = 8192


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block, and their offsets."""
    w = words(texts, WORD_TABLE)
    n = np.diff(w.first)
    size = np.minimum(n, SHINGLE)
    count = np.where(n > 0, n - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + w.first[doc]
    total = np.zeros(len(doc), np.uint64)
    for k in range(SHINGLE):
        inside = k < size[doc]
        total += np.where(inside, mixed(w.hash[np.where(inside, at + k, 0)] + np.uint64(k)), np.uint64(0)) if len(w.hash) else 0
    total = mixed(total)
    order = np.lexsort((total, doc))
    total, doc = total[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
    total, doc = total[new], doc[new]
    return total, np.searchsorted(doc, np.arange(len(n) + 1))


def sketches(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low bytes of the MinHash values, band keys, and a 128-bit digest of each set."""
    full = np.flatnonzero(np.diff(offsets))
    starts = offsets[full]
    low = np.zeros((len(offsets) - 1, HASHES), np.uint8)
    keys = np.zeros((len(offsets) - 1, BANDS), np.uint64)
    digest = np.zeros((len(offsets) - 1, 2), np.uint64)
    if len(full):
        for k in range(HASHES):
            least = np.minimum.reduceat((sets * FACTORS[k] + SHIFTS[k]) >> np.uint64(20), starts)
            low[full, k] = mixed(least).astype(np.uint8)
            keys[full, k // ROWS] = mixed(keys[full, k // ROWS] + least + np.uint64(k))
        digest[full, 0] = np.add.reduceat(sets, starts)
        digest[full, 1] = np.add.reduceat(mixed(sets), starts)
    return low, keys.view(np.int64), digest.view(np.int64)


@lru_cache(maxsize=8)
def needed(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each step n, the fewest matches m with P(similarity >= threshold | m of n) >= tolerance.

    Under a uniform prior the posterior is a Beta, and that tail is P(Bin(n + 1, threshold) <= m).
    """
    out = []
    for n in STEPS:
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def prune(low: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which of the pairs a[i], b[i] survive; values are compared step by step."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in zip(STEPS, needed(threshold, tolerance), strict=True):
        matches += (low[a[alive], done:n] == low[b[alive], done:n]).sum(1, dtype=np.int32)
        ok = matches >= least
        alive, matches, done = alive[ok], matches[ok], n
    return alive


def _low(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and size of each run of equal keys."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return first, np.diff(np.concatenate([first, [len(keys)]]))


def _pairs(m: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(m, 1)


def forest(low: np.ndarray, label: np.ndarray, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """Surviving pairs that merge two labels, one for each merger; ``label`` is brought up to date.

    Only rows of different labels are compared, so a run of copies costs one comparison a row.
    """
    found: list[tuple[int, int]] = []
    for p in range(len(low)):
        others = p + 1 + np.flatnonzero(label[p + 1 :] != label[p])
        near = others[prune(low, np.full(len(others), p), others, threshold, tolerance)]
        if len(near):
            merged, at = np.unique(label[near], return_index=True)
            found += [(p, int(x)) for x in near[at]]
            label[np.isin(label, merged)] = label[p]
    return found


def ties(low: np.ndarray, side: np.ndarray, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """Surviving pairs of one run, just enough to connect all that are connected: fewer than rows.

    Rows come in order of rep, so the bands of one group mostly name the same few rows first.
    Where the run holds two blocks (``side``), what is tied inside a block is named by that
    block's own task, and only pairs across that tie more are named here.
    """
    label = np.arange(len(low))
    if side.any() and not side.all():
        for half in (np.flatnonzero(side), np.flatnonzero(~side)):
            own = np.arange(len(half))
            forest(low[half], own, threshold, tolerance)
            label[half] = half[own]
    return forest(low, label, threshold, tolerance)


def spanning(alive: np.ndarray, i: np.ndarray, j: np.ndarray, m: int) -> np.ndarray:
    """Which surviving pairs (runs x pairs i < j) of small runs are needed to connect the same rows.

    With f the first partner of j, the pair i, j goes if f and i survive as a pair: both hang on f.
    """
    near = np.zeros((len(alive), m, m), bool)
    near[:, i, j] = alive
    first = near.argmax(1)[:, j]
    return alive & ((first == i) | ~near[np.arange(len(alive))[:, None], first, i])


def common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    if len(a) < 4 * len(sets):
        return np.array([np.intersect1d(sets[i], sets[j], assume_unique=True).size for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    vocabulary, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(vocabulary), WIDTH):
        low, high = np.searchsorted(column, (at, at + WIDTH))
        held = np.zeros((len(sets), WIDTH), np.float32)
        held[row[low:high], column[low:high] - at] = 1
        total += held @ held.T
    return total[a, b].astype(np.int64)


def _blocked(df: DataFrame, key: Column, size: Column, block: int) -> DataFrame:
    """Rows copied to each pair of blocks they take part in: part (pair), mine (0 or 1), both (two blocks)."""
    n = F.ceil(size / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("rep"), n.cast("long")).cast("int")
    out = df.withColumns({"key_": key, "blk_": mine, "other_": F.explode(F.sequence(F.lit(0), n - 1))})
    pair = F.when(n == 1, F.col("key_")).otherwise(F.xxhash64("key_", F.least("blk_", "other_"), F.greatest("blk_", "other_")))
    return out.select("*", pair.alias("part"), (F.col("blk_") > F.col("other_")).alias("mine"), (F.col("blk_") != F.col("other_")).alias("both"))


SKETCH = "row_id long, doc_id long, text_hash long, n_shingles long, s1 long, s2 long, low binary, keys binary, bands array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, stop in blocks(batch["text"]):
            part = batch.slice(at, stop - at)
            sets, offsets = shingles(part["text"])
            low, keys, digest = sketches(sets, offsets)
            n = len(low)
            raw = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.nbytes // max(n, 1)), n, [None, pa.py_buffer(x.tobytes())]).cast(pa.binary()) for x in (low, keys.astype(np.uint32))]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
            cols = [part["row_id"], part["doc_id"], part["text_hash"], pa.array(np.diff(offsets)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), *raw, bands]
            yield pa.RecordBatch.from_arrays(cols, names=["row_id", "doc_id", "text_hash", "n_shingles", "s1", "s2", "low", "keys", "bands"])


def _compare(threshold: float, tolerance: float):
    """Rows (part, rep, nth, mine, low, keys), sorted by part and rep, to edges that connect surviving candidates.

    Every run names fewer edges than it has rows. A pair is named only in the first band
    that both share; that band connects them as well.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "part"):
            rep, low, nth, mine = table["rep"].to_numpy(), _low(table["low"]), table["nth"].to_numpy(), table["mine"].to_numpy()
            keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint32).reshape(-1, BANDS)
            first, size = _bounds(table["part"].to_numpy())
            a, b = [], []
            for m in range(2, 9):  # small runs: all pairs of all runs at once
                at, (i, j) = first[size == m], _pairs(m)
                for k in range(0, len(at), 4096):
                    x, y = ((at[k : k + 4096, None] + z).ravel() for z in (i, j))
                    keep = np.zeros(len(x), bool)
                    keep[prune(low, x, y, threshold, tolerance)] = True
                    keep = spanning(keep.reshape(-1, len(i)), i, j, m).ravel()
                    a.append(x[keep])
                    b.append(y[keep])
            for at, m in zip(first[size > 8].tolist(), size[size > 8].tolist(), strict=True):
                if found := ties(low[at : at + m], mine[at : at + m], threshold, tolerance):
                    x, y = np.array(found).T + at
                    a.append(x)
                    b.append(y)
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            new = np.concatenate([(keys[x] == keys[y]).argmax(1) == nth[x] for x, y in ((a[k : k + 65536], b[k : k + 65536]) for k in range(0, len(a), 65536))] or [np.zeros(0, bool)])
            a, b = a[new], b[new]
            yield pa.RecordBatch.from_arrays([pa.array(rep[a], pa.int64()), pa.array(rep[b], pa.int64())], names=["a", "b"])

    return work


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate texts to their shingles; rows that only share a doc_id with a candidate go."""
    for batch in batches:
        for at, stop in blocks(batch["text"]):
            part = batch.slice(at, stop - at)
            sets, offsets = shingles(part["text"])
            low, _, digest = sketches(sets, offsets)
            same = (digest[:, 0] == part["s1"].to_numpy()) & (digest[:, 1] == part["s2"].to_numpy())
            keep = np.flatnonzero(same).tolist()
            raw = [pa.array([x[i].tobytes() for i in keep], pa.binary()) for x in (low,)]
            body = pa.array([sets[offsets[i] : offsets[i + 1]].tobytes() for i in keep], pa.binary())
            kept = part.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept[c] for c in ("rep", "members", "cluster", "size")), *raw, body], names=["rep", "members", "cluster", "size", "low", "sets"])


def _verify(threshold: float, tolerance: float):
    """Sorted rows (part, rep, members, mine, both, low, sets) to rep, links, parent."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "part"):
            rep, members = table["rep"].to_numpy(), table["members"].to_numpy()
            mine, both = table["mine"].to_numpy(), table["both"].to_numpy()
            low, raw = _low(table["low"]), table["sets"].to_pylist()
            links, parent = np.zeros(len(rep), np.int64), rep.copy()
            for at, m in zip(*map(np.ndarray.tolist, _bounds(table["part"].to_numpy())), strict=True):
                _, once = np.unique(rep[at : at + m], return_index=True)
                rows = at + once
                i, j = _pairs(len(rows))
                if both[at]:
                    across = mine[rows[i]] != mine[rows[j]]
                    i, j = i[across], j[across]
                keep = np.concatenate([k + prune(low[rows], i[k : k + 65536], j[k : k + 65536], threshold, tolerance) for k in range(0, len(i), 65536)]) if len(i) else i
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                sets = [np.frombuffer(raw[r], np.uint64) for r in rows.tolist()]
                sizes = np.array([len(s) for s in sets])
                n = common(sets, i, j)
                near = n >= threshold * (sizes[i] + sizes[j] - n) - 1e-9
                i, j = i[near], j[near]
                np.add.at(links, rows[i], members[rows[j]])
                np.add.at(links, rows[j], members[rows[i]])
                label = rep[rows].copy()
                while True:  # smallest rep of everything linked
                    before = label.copy()
                    np.minimum.at(label, i, before[j])
                    np.minimum.at(label, j, before[i])
                    if (label == before).all():
                        break
                parent[rows] = label
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(parent)], names=["rep", "links", "parent"])

    return work


def resolve(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, text_hash, root (group), group_id, n_links."""
    ship_package(docs.sparkSession)
    base = docs.select("doc_id", "text")
    d = with_row_id(base.withColumn("text_hash", F.xxhash64("text")))
    sigs = stage(d.mapInArrow(_sketch, SKETCH), "sketches")
    full = sigs.where("n_shingles > 0")
    classes = full.groupBy("s1", "s2").agg(F.min("row_id").alias("rep"), F.min(F.struct("row_id", "doc_id", "text_hash")).alias("own"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("members"), F.first("low").alias("low"), F.first("keys").alias("keys"), F.first("bands").alias("bands"))
    classes = stage(classes, "classes")

    banded = classes.select("rep", F.posexplode("bands").alias("nth", "band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    hits = stage(banded.join(shared.hint("merge"), "band"), "hits")
    lows = hits.join(classes.select("rep", "low", "keys").hint("merge"), "rep")
    parts = _blocked(lows, F.col("band"), F.col("size"), block).select("part", "rep", "nth", "mine", "low", "keys")
    edges = parts.repartition("part").sortWithinPartitions("part", "rep").mapInArrow(_compare(threshold, tolerance), "a long, b long")
    near = stage(components(edges).withColumnsRenamed({"node": "rep", "root": "cluster"}), "clusters")

    sizes = near.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    wanted = near.join(sizes.hint("merge"), "cluster").join(classes.select("rep", F.col("own.doc_id").alias("id_"), F.col("own.text_hash").alias("hash_"), "members", "s1", "s2").hint("merge"), "rep")
    wanted = stage(wanted, "wanted")
    hint = "broadcast" if stored_bytes(wanted) <= BROADCAST_BYTES else "merge"
    on = [F.col("doc_id").eqNullSafe(F.col("id_")), F.xxhash64("text") == F.col("hash_")]
    bodies = base.join(wanted.hint(hint), on).select("text", "rep", "members", "cluster", "size", "s1", "s2")
    bodies = bodies.mapInArrow(_shingled, "rep long, members long, cluster long, size long, low binary, sets binary")
    bodies = bodies.dropDuplicates(["rep"])  # rows that repeat id and text bring the same body
    parts = _blocked(bodies, F.col("cluster"), F.col("size"), block // 2).select("part", "rep", "members", "mine", "both", "low", "sets")
    checked = parts.repartition("part").sortWithinPartitions("part").mapInArrow(_verify(threshold, tolerance), "rep long, links long, parent long")
    checked = stage(checked, "links")

    links = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(checked.select(F.col("rep").alias("a"), F.col("parent").alias("b")))
    named = classes.select("rep", "doc_id", "members", "s1", "s2").join(groups.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").join(links.hint("merge"), "rep", "left")
    named = stage(named.withColumn("root", F.coalesce("root", "rep")), "named")
    names = named.groupBy("root").agg(F.min("doc_id").alias("group_id"))
    named = named.join(names.hint("merge"), "root").select("s1", "s2", "root", "group_id", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    out = full.select("row_id", "doc_id", "text_hash", "s1", "s2").join(named.hint("merge"), ["s1", "s2"]).drop("s1", "s2")
    alone = sigs.where("n_shingles = 0").select("row_id", "doc_id", "text_hash", F.col("row_id").alias("root"), F.col("doc_id").alias("group_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: of each group one row with the smallest doc_id (nulls last).

    Only ids of dropped rows travel: broadcast when their stored size is small, else shuffled.
    """
    rows = resolve(docs, threshold).groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    rows = stage(rows, "groups")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash")
    first = rows.groupBy("root").agg(F.min(rank).alias("first"))
    marked = rows.join(first.hint("merge"), "root").withColumn("twin", rank == F.col("first"))
    gone = stage(marked.where("not twin or n > 1").select("doc_id", "text_hash", "twin"), "dropped")
    return drop_rows(docs, {"doc_id": F.col("doc_id"), "text_hash": F.xxhash64("text")}, gone, BROADCAST_BYTES)
