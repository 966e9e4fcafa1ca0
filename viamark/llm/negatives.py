"""Hard negatives by a distributed STR-packed R-tree.

Rows are cut into tiles by sort-tile-recursive order: quantiles of the two coordinates
with the greatest variance, the second inside each slab of the first; a tile that holds
too many equal rows is split by row number. Each tile is packed, in one group of bounded
size, into leaves of ``LEAF`` rows and nodes of ``FAN`` children with their minimum
bounding boxes; the tiles' own boxes are the top of the tree.

An anchor ``a`` and a box [lo, hi] bound every inner product inside by taking, for each
coordinate, a*lo or a*hi. Each anchor first looks into its own tile, which gives it a k-th
best score; it then travels only to tiles whose bound reaches that score (or, for
negatives, overlaps one of its score windows). Inside a tile a queue opens the box with the
highest bound first, skips boxes outside the window and stops at a bound strictly below
the k-th score, so ties are all seen and results are exact.

In many dimensions boxes are wide and few tiles are pruned: the work is then that of all
anchors against all rows, tile by tile.

Defined cases: rows with a null label or vector, or with a null or non-finite component,
take no part; rows score only against rows with as many components; a null vec_id sorts
after all others and is no anchor; repeated rows are rows of their own; ties go to the
smaller vec_id; an anchor without positives, and a positive without negatives, give no
rows; scores are exact integers and are cut to 64 bits only when returned; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viamark.llm.common import ship_package, stage, stored_bytes, with_row_id

#: Rows of a tile and of a leaf, children of a node.
TILE, LEAF, FAN = 2_048, 512, 8
NO_ID = 2**63 - 1
#: Stored size up to which boxes and cuts of tiles are broadcast.
BROADCAST_BYTES = 32 << 20
#: Up to this magnitude every sum of products is exact in double precision.
EXACT = 2.0**53
HIT = "struct<score:decimal(38,0),vec_id:long,row:long>"
TILE_ROW = f"dims int, tile long, piece long, n long, data array<double>, ids array<long>, labels array<int>, rows array<long>, lo array<double>, hi array<double>, home array<struct<row:long,vec_id:long,label:int,v:array<double>,found:array<{HIT}>>>"
FOUND = f"row long, k int, found array<{HIT}>"


def _hits(rows: list) -> pa.Array:
    kind = pa.struct([("score", pa.decimal128(38, 0)), ("vec_id", pa.int64()), ("row", pa.int64())])
    return pa.array([[{"score": int(-s), "vec_id": i, "row": r} for s, i, r in found] for found in rows], pa.list_(kind))


def str_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """Rows of ``x`` sorted and tiled by the two coordinates that vary most."""
    n = len(x)
    if not x.shape[1]:
        return np.arange(n)
    a, b = np.argsort(-x.astype(float).var(axis=0), kind="stable")[[0, min(1, x.shape[1] - 1)]]
    slabs = max(1, round((-(-n // leaf)) ** 0.5))
    order = np.argsort(x[:, a], kind="stable")
    slab = np.arange(n) * slabs // n
    return order[np.lexsort((x[order, b], slab))]


class Tree:
    """The R-tree of one tile; node 0 is the root, children follow their parents level by level."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        order = str_order(x, leaf)
        self.x, self.ids, self.labels, self.rows, self.leaf = x[order], ids[order], labels[order], rows[order], leaf
        cut = np.arange(0, len(x), leaf)
        levels = [(np.minimum.reduceat(self.x, cut), np.maximum.reduceat(self.x, cut))]
        while len(levels[-1][0]) > 1:
            cut = np.arange(0, len(levels[-1][0]), fan)
            levels.append((np.minimum.reduceat(levels[-1][0], cut), np.maximum.reduceat(levels[-1][1], cut)))
        levels.reverse()
        self.lo, self.hi = (np.concatenate([level[side] for level in levels]) for side in (0, 1))
        first = np.cumsum([0] + [len(level[0]) for level in levels])
        self.first_leaf = int(first[-2])
        self.children = {
            int(first[d] + i): range(int(first[d + 1] + i * fan), int(min(first[d + 1] + (i + 1) * fan, first[d + 2])))
            for d in range(len(levels) - 1)
            for i in range(len(levels[d][0]))
        }
        self.most = float(np.abs(self.x).max(initial=0))

    def view(self, v: np.ndarray) -> View:
        exact = self.most * float(np.abs(v).max(initial=0)) * max(1, len(v)) < EXACT
        if exact:
            return View(self, self.x, self.lo, self.hi, v)
        big = np.vectorize(int, otypes=[object])
        as_ints = lambda m: big(m) if m.size else m.astype(object)
        return View(self, as_ints(self.x), as_ints(self.lo), as_ints(self.hi), as_ints(v))


class View:
    """One anchor's look at a tree: bounds of all boxes, scores of the leaves it has opened."""

    def __init__(self, tree: Tree, x, lo, hi, v):
        self.tree, self.x, self.v = tree, x, v
        up, down = np.maximum(v, 0), np.minimum(v, 0)
        self.high, self.low = hi @ up + lo @ down, lo @ up + hi @ down
        self.scores: dict[int, np.ndarray] = {}

    def best(self, k: int, wanted: np.ndarray, low=None, high=None, kth=None) -> list[tuple]:
        """The first ``k`` wanted rows with a score in [low, high] (and of ``kth`` or more): (-score, vec_id, row)."""
        t, found = self.tree, []
        top = lambda node: self.high[node] if high is None else min(self.high[node], high)
        queue = [(-top(0), 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if len(found) == k and -bound < -found[-1][0] or kth is not None and -bound < kth:
                break
            if low is not None and self.high[node] < low or high is not None and self.low[node] > high:
                continue
            if node in t.children:
                for child in t.children[node]:
                    heapq.heappush(queue, (-top(child), child))
                continue
            at = (node - t.first_leaf) * t.leaf
            s = self.scores.get(node)
            if s is None:
                s = self.scores[node] = self.x[at : at + t.leaf] @ self.v
            good = wanted[at : at + t.leaf]
            if low is not None:
                good = good & (s >= low).astype(bool)
            if high is not None:
                good = good & (s <= high).astype(bool)
            if len(found) == k:
                good = good & (s >= -found[-1][0]).astype(bool)
            rows = np.flatnonzero(good)
            if len(rows) > k:
                # All that reach the k-th score of this leaf, ties included.
                rows = rows[s[rows] >= np.sort(s[rows])[-k]]
            if len(rows):
                found = sorted(found + [(-s[i], int(t.ids[at + i]), int(t.rows[at + i])) for i in rows])[:k]
        return found


def _pack(positives: int, every: int):
    """One tile: its packed rows, and what its own anchors find in it."""

    def work(group: pa.Table) -> pa.Table:
        v = group["v"].combine_chunks()
        dims = group["dims"][0].as_py()
        x = np.floor(256.0 * np.asarray(v.flatten(), np.float64)).reshape(len(group), dims)
        ids, labels, rows = (np.asarray(group[c].combine_chunks()) for c in ("vec_id", "label", "row"))
        t = Tree(x, ids, labels, rows)
        home = []
        for i in np.flatnonzero((t.ids % every == 0) & (t.ids != NO_ID)):
            found = t.view(t.x[i]).best(positives, (t.labels == t.labels[i]) & (t.rows != t.rows[i]))
            home.append({"row": int(t.rows[i]), "vec_id": int(t.ids[i]), "label": int(t.labels[i]), "v": t.x[i].tolist(), "found": _hits([found])[0].as_py()})
        one = {
            "dims": [dims], "tile": [group["tile"][0].as_py()], "piece": [group["piece"][0].as_py()], "n": [len(x)], "data": [t.x.ravel()], "ids": [t.ids], "labels": [t.labels], "rows": [t.rows],
            "lo": [t.lo[0]], "hi": [t.hi[0]], "home": [home],
        }
        return pa.table(one, schema=_tile_schema())

    return work


def _tile_schema() -> pa.Schema:
    hit = pa.struct([("score", pa.decimal128(38, 0)), ("vec_id", pa.int64()), ("row", pa.int64())])
    home = pa.struct([("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int32()), ("v", pa.list_(pa.float64())), ("found", pa.list_(hit))])
    longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
    kinds = {"dims": pa.int32(), "tile": pa.int64(), "piece": pa.int64(), "n": pa.int64(), "data": doubles, "ids": longs, "labels": pa.list_(pa.int32()), "rows": longs, "lo": doubles, "hi": doubles, "home": pa.list_(home)}
    return pa.schema(list(kinds.items()))


def _search(k: int, same: bool):
    """Rows of one tile follow each other: first the tile, then the anchors that come to it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for b in batches:
            out, at, rows = [], [], []
            for i in range(b.num_rows):
                if b["kind"][i].as_py() == 0:
                    ids = np.asarray(b["ids"][i].values)
                    x = np.asarray(b["data"][i].values, np.float64).reshape(len(ids), -1)
                    tree = Tree(x, ids, np.asarray(b["labels"][i].values), np.asarray(b["rows"][i].values))
                    continue
                label, row = b["label"][i].as_py(), b["row"][i].as_py()
                view = tree.view(np.asarray(b["data"][i].values, np.float64))
                wanted = (tree.labels == label) & (tree.rows != row) if same else tree.labels != label
                for w, (low, high) in enumerate([(None, None)] if same else [(-(-int(s) // 2), 19 * int(s) // 20) for s in b["scores"][i].as_py()]):
                    kth = b["kth"][i].as_py() if same else None
                    if same or low <= high:
                        found = view.best(k, wanted, low, high, None if kth is None else int(kth))
                        if found:
                            out.append(found)
                            at.append(w)
                            rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(at, pa.int32()), _hits(out)], names=["row", "k", "found"])

    return work


def _visit(tiles: DataFrame, visits: DataFrame, k: int, same: bool) -> DataFrame:
    """row, k, found of the ``visits`` (dims, tile, piece, row, label, data, kth, scores) in their tiles."""
    none = {"row": F.lit(None).cast("long"), "label": F.lit(None).cast("int"), "kth": F.lit(None).cast("decimal(38,0)"), "scores": F.expr("cast(null as array<decimal(38,0)>)")}
    held = tiles.select("dims", "tile", "piece", F.lit(0).alias("kind"), "data", "ids", "labels", "rows").withColumns(none)
    lists = {c: F.lit(None).cast(t) for c, t in (("ids", "array<long>"), ("labels", "array<int>"), ("rows", "array<long>"))}
    both = held.unionByName(visits.withColumns(lists | {"kind": F.lit(1)}).select(*held.columns))
    key = ["dims", "tile", "piece"]
    return both.repartition(*key).sortWithinPartitions(*key, "kind").mapInArrow(_search(k, same), FOUND)


def _small(df: DataFrame) -> DataFrame:
    return df.hint("broadcast" if stored_bytes(df) <= BROADCAST_BYTES else "merge")


def clean(embeddings: DataFrame, flip: int = 7, labels: int = 10) -> DataFrame:
    """row, vec_id (a null one as the largest number), label, v, dims: rows that take part, staged."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % flip == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("int")
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    rows = rows.select(F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), label.alias("label"), F.col("embedding").alias("v"), F.size("embedding").alias("dims"))
    return stage(with_row_id(rows).withColumnRenamed("row_id", "row"), "vectors")


def build(rows: DataFrame, positives: int, every: int, tile: int = TILE) -> DataFrame:
    """Staged tiles of the cleaned ``rows``: one row for each, packed in STR order."""
    spread = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.var_pop("x").alias("s")).orderBy(F.desc("s"), "at").limit(2).collect()
    a, b = (F.coalesce(F.get("v", F.lit(r.at)), F.lit(0.0)) for r in (spread * 2)[:2]) if spread else (F.lit(0.0), F.lit(0.0))
    need = -(-rows.count() // tile)
    slabs = max(1, round(need**0.5))
    parts = max(1, -(-need // slabs))

    def cuts(column: str, n: int):
        return F.percentile_approx(column, F.array(*[F.lit(k / n) for k in range(1, n)]), 10_000) if n > 1 else F.expr("cast(array() as array<double>)")

    below = lambda at, x: F.size(F.filter(at, lambda c: c < x)).cast("long")
    placed = rows.withColumns({"a_": a, "b_": b})
    # One row, and one row for each slab: about the square root of the tiles.
    first = placed.agg(cuts("a_", slabs).alias("at_"))
    placed = placed.join(F.broadcast(first)).withColumn("slab", below("at_", F.col("a_"))).drop("at_")
    second = stage(placed.groupBy("slab").agg(cuts("b_", parts).alias("at_")), "cuts")
    placed = placed.join(_small(second), "slab").withColumn("tile", F.col("slab") * parts + below("at_", F.col("b_")))
    sizes = stage(placed.groupBy("dims", "tile").agg(F.count(F.lit(1)).alias("held")), "sizes")
    placed = placed.join(_small(sizes), ["dims", "tile"]).withColumn("piece", F.pmod(F.xxhash64("row"), F.ceil(F.col("held") / (2 * tile))))
    slim = placed.select("dims", "tile", "piece", "row", "vec_id", "label", "v")
    return stage(slim.groupBy("dims", "tile", "piece").applyInArrow(_pack(positives, every), TILE_ROW), "tiles")


def _bound(side: str, other: str):
    """The highest (or lowest) inner product of ``data`` with the box [lo, hi]."""
    return F.expr(f"aggregate(arrays_zip(data, {side}, {other}), 0D, (s, z) -> s + z.data * if(z.data > 0, z.{side}, z.{other}))")


def mine(embeddings: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50, tile: int = TILE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    ship_package(embeddings.sparkSession)
    tiles = build(clean(embeddings), positives, every, tile)
    key = ["dims", "tile", "piece"]
    home = stage(tiles.select(*key, F.explode("home").alias("h")).select(*key, "h.*").withColumnRenamed("v", "data"), "anchors")
    boxes = stage(tiles.select("dims", F.col("tile").alias("tile_"), F.col("piece").alias("piece_"), "lo", "hi"), "boxes")
    there = {"tile": F.col("tile_"), "piece": F.col("piece_")}
    kth = F.get(F.col("found"), F.lit(positives - 1)).getField("score")
    # Beyond the exact range bounds are rounded, so a little is allowed for.
    slack = "1e-9 * abs(up) + 1"
    away = home.withColumn("kth", kth).join(_small(boxes), "dims").where("tile <> tile_ or piece <> piece_").withColumn("up", _bound("hi", "lo")).where(F.expr(f"kth is null or up + {slack} >= kth"))
    visits = away.withColumns(there).withColumn("scores", F.expr("cast(null as array<decimal(38,0)>)"))
    found = _visit(tiles, visits, positives, True).select("row", F.explode("found").alias("f"))
    every_one = found.unionByName(home.select("row", F.explode("found").alias("f")))
    order = [F.desc("f.score"), F.asc("f.vec_id"), F.asc("f.row")]
    first = every_one.withColumn("p", F.row_number().over(Window.partitionBy("row").orderBy(*order)) - 1).where(F.col("p") < positives)
    chosen = stage(first.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("p", F.col("f.score").alias("score"), F.col("f.vec_id").alias("id")))).alias("chosen")), "positives")
    # Scores of an anchor's positives, in order; a window may be empty.
    asked = home.select("dims", "row", "vec_id", "label", "data").join(chosen.hint("merge"), "row").withColumn("scores", F.col("chosen.score"))
    overlap = f"exists(scores, s -> 0.5D * s <= up + {slack} and down - ({slack}) <= 0.95D * s)"
    asked = asked.join(_small(boxes), "dims").withColumns({"up": _bound("hi", "lo"), "down": _bound("lo", "hi")}).where(F.expr(overlap)).withColumns(there).withColumn("kth", F.lit(None).cast("decimal(38,0)"))
    against = _visit(tiles, asked, negatives, False).select("row", "k", F.explode("found").alias("f"))
    ranked = against.withColumn("rank", F.row_number().over(Window.partitionBy("row", "k").orderBy(*order))).where(F.col("rank") <= negatives)
    named = home.select("row", F.col("vec_id").alias("anchor_id")).join(chosen.select("row", F.explode("chosen").alias("c")).hint("merge"), "row").select("row", "anchor_id", F.col("c.p").alias("k"), F.col("c.id").alias("p_id"), F.col("c.score").alias("p_score"))
    in_long = lambda c: F.least(F.greatest(c, F.lit(-(2**63)).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    named_id = lambda c: F.when(c != NO_ID, c)
    return named.join(ranked.hint("merge"), ["row", "k"]).select(
        "anchor_id", named_id(F.col("p_id")).alias("positive_id"), "rank", named_id(F.col("f.vec_id")).alias("negative_id"),
        in_long(F.col("p_score")).alias("positive_score"), in_long(F.col("f.score")).alias("negative_score"),
    )
