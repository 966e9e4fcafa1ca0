"""Collocations, benchmark passages and hard negatives against brute force on small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from viamark.llm import collocations, decontaminate, negatives

DOCS = "doc_id long, text string, lang string, words long"


def some_text(rng, n, size=30):
    return "".join(f"w{int(rng.zipf(1.4)) % size}" + rng.choice([" ", "\t", "  ", ", ", ".", "\n"], p=[0.7, 0.05, 0.05, 0.1, 0.05, 0.05]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    rows = [(i, some_text(rng, int(rng.integers(1, 200))), ["en", None, "de"][i % 3]) for i in range(60)]
    rows += [(100, None, "en"), (None, "", None), (101, "Ab aB ab " * 40, "xx"), (101, "Ab aB ab " * 40, "xx"), (102, some_text(rng, 30_000), "en"), (103, "é\x00é ô\x0bü " * 30, "de")]
    return rows


def phrases_by_force(rows, max_words=3, least=10, top=2000):
    n, f = Counter(), defaultdict(Counter)
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, max_words + 1):
                f[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        around, found = Counter(), []
        for p, a in counts.items():
            if a >= least:
                for m in range(2, len(p)):
                    for i in range(len(p) - m + 1):
                        around[p[i : i + m]] = max(around[p[i : i + m]], a)
        for p, a in counts.items():
            if len(p) > 1 and a >= least and 100 * around[p] < 50 * a:
                score, _, left, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, r))
        out += [(lang, k + 1, p.decode(), -a, left, r, n[lang], -s) for k, (s, a, p, left, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("max_words", "tight"), [(3, False), (3, True), (4, False)])
def test_collocations(spark, corpus, monkeypatch, max_words, tight):
    if tight:  # many buckets, heavy leading words, a bucket in several chunks
        monkeypatch.setattr(collocations, "BUCKET_WORDS", 2_000)
        monkeypatch.setattr(collocations, "HEAVY_WORDS", 40)
        monkeypatch.setattr(collocations, "CHUNK", 300)
        monkeypatch.setattr(collocations, "BLOCK", 4_000)
    docs = spark.createDataFrame([(*r, 1) for r in corpus], DOCS)
    got = sorted(tuple(r) for r in collocations.mine(docs, max_words=max_words).collect())
    assert got == phrases_by_force(corpus, max_words)
    assert len(got) > 100


def test_collocations_without_rows(spark):
    none = spark.createDataFrame([], DOCS)
    assert collocations.mine(none).count() == 0
    assert collocations.mine(spark.createDataFrame([(1, None, None, 1)], DOCS)).count() == 0


def test_a_cut_bucket_keeps_whole_counts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"bucket": [1, 1, 1, 2], "heavy": [False] * 4, "times": [[1] * 4, [1] * 4, [1] * 4, [1]]})
    saved, collocations.CHUNK = collocations.CHUNK, 6
    try:
        assert [(sum(b.num_rows for b in held), whole) for held, whole in collocations._gathered(iter([batch]))] == [(2, False), (1, False), (1, True)]
    finally:
        collocations.CHUNK = saved


def test_three_way_quicksort():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 6, (5000, 3))
    keys[rng.random(5000) < 0.1, 2] = -1
    times = rng.integers(1, 4, 5000)
    want = Counter()
    for row, t in zip(keys.tolist(), times.tolist()):
        for d in range(3):
            if row[d] >= 0:
                want[tuple(row[: d + 1])] += t
    got = {tuple(keys[r][: d + 1].tolist()): int(w) for d, rows, weight in collocations.equal_partitions(keys, times, [1, 1, 1]) for r, w in zip(rows, weight)}
    assert got == dict(want)
    some = {tuple(keys[r][: d + 1].tolist()) for d, rows, weight in collocations.equal_partitions(keys, times, [60, 60, 60]) for r in rows}
    assert some == {k for k, n in want.items() if n >= 60}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks_by_force(docs, items, window=10):
    split = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        words = split(text)
        m = min(len(words), window)
        for i in range(len(words) - m + 1):
            if m:
                windows.setdefault(tuple(words[i : i + m]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        words, hit, found = split(text), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(words) - m + 1):
                if tuple(words[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[tuple(words[i : i + m])]
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leak_tables():
    rng = np.random.default_rng(5)
    text = lambda n, size: [f"v{x}" for x in rng.integers(0, size, n)]
    items = [(i, " ".join(text(int(rng.integers(1, 60)), 50))) for i in range(12)]
    items += [(20, "same " * 30), (21, "one"), (22, None), (23, ""), (None, " ".join(text(15, 9))), (0, " ".join(text(30, 50))), (24, items[3][1].upper()), (25, "x y " * 8)]
    docs = [(i, " ".join(text(int(rng.integers(0, 120)), 50))) for i in range(25)]
    for i, (_, t) in enumerate(items):
        w = (t or "").split()
        a = int(rng.integers(0, max(1, len(w) - 12)))
        docs.append((100 + i, " ".join([*text(20, 50), *w[a : a + 14], *text(8, 50), *w[: len(w) // 2], *text(3, 50), *w])))
    docs += [(200, None), (None, ""), (100, docs[25][1]), (201, "SAME, same; " * 9), (202, "same " * 4000), (203, "x y " * 500), (204, " ".join(text(20_000, 9)))]
    return docs, items


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_BYTES, 0])
def test_decontaminate(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    docs, items = leak_tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("a.b", F.lit(2)).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("row_id", F.lit(7))
    got = sorted((tuple(r) for r in decontaminate.report(d, b).collect()), key=str)
    assert got == leaks_by_force(docs, items)


def test_decontaminate_near_and_empty(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha x beta y gamma delta"), (3, "alpha " + "x " * 30 + "beta gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "alpha beta gamma delta")], "item_id long, text string")
    got = {r.doc_id: (list(r.item_ids), list(r.near_ids)) for r in decontaminate.scan(docs, items, slack=3).collect()}
    assert got == {1: (["5"], ["5"]), 2: ([], ["5"]), 3: ([], [])}
    assert decontaminate.report(docs.limit(0), items).count() == 0
    assert [r.contaminated for r in decontaminate.report(docs, items.limit(0)).collect()] == [False] * 3


def negatives_by_force(rows):
    kept = []
    for i, (vec, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec is not None and vec % 7 == 0 else label
        kept.append((i, vec, label, [math.floor(256.0 * x) for x in v]))
    key = lambda x: (-x[0], math.inf if x[1] is None else x[1])
    out = []
    for i, vec, label, v in kept:
        if vec is None or vec % 50:
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), o, lab) for j, o, lab, w in kept if j != i and len(w) == len(v)]
        for ps, p, _ in sorted((s for s in scores if s[2] == label), key=key)[:5]:
            good = sorted((s for s in scores if s[2] != label and 50 * ps <= 100 * s[0] <= 95 * ps), key=key)[:3]
            out += [(vec, p, k + 1, o, ps, s) for k, (s, o, _) in enumerate(good)]
    return sorted(out, key=str)


def vectors():
    rng = np.random.default_rng(11)
    rows = [(i, (rng.normal(size=6) + (i % 4)).round(2).tolist(), int(rng.integers(0, 10))) for i in range(700)]
    same = [1.0, 0.5, 0.25, 0.0, 1.5, 1.0]
    rows += [(1000 + i, same, i % 3) for i in range(200)]
    rows += [(i, [1.0, 2.0], i % 2) for i in range(2000, 2060)] + [(None, same, 1), (None, same, 2), (50, same, 1), (50, same, 1)]
    rows += [(3000, None, 1), (3050, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 1), (3100, [math.nan] * 6, 1), (3150, [math.inf] * 6, 2), (3200, same, None), (3250, [], 1), (3251, [], 1), (3252, [], 2)]
    return rows


@pytest.mark.parametrize("tile", [negatives.TILE, 40])
def test_hard_negatives(spark, tile):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, tile long").repartition(3)
    got = sorted((tuple(r) for r in negatives.mine(df, tile=tile).collect()), key=str)
    assert got == negatives_by_force(rows)
    assert len(got) > 100


def test_hard_negatives_without_rows_and_with_large_numbers(spark):
    kind = "vec_id long, embedding array<double>, label int"
    assert negatives.mine(spark.createDataFrame([], kind)).count() == 0
    rows = [(i, [2.0**22 + i % 5, 2.0**21, i / 8], 1 + i % 2) for i in range(1, 120)]
    got = sorted((tuple(r) for r in negatives.mine(spark.createDataFrame(rows, kind)).collect()), key=str)
    assert got == negatives_by_force(rows)


def test_bounds_hold_every_score():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(1000, 8)) * 256)
    tree = negatives.Tree(x, np.arange(1000), np.zeros(1000, int), np.arange(1000), leaf=16, fan=4)
    view = tree.view(x[3])
    for leaf in range(tree.first_leaf, len(tree.lo)):
        at = (leaf - tree.first_leaf) * 16
        s = tree.x[at : at + 16] @ x[3]
        assert view.low[leaf] <= s.min() and s.max() <= view.high[leaf]
    assert view.high[0] == max(view.high[tree.first_leaf :].max(), view.high[0])
