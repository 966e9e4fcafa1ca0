"""Shards of repeated rows under any partitioning, and licence notices that share their sentence."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from viamark.llm import license_scan, sharding, substring_dedup
from viamark.llm.textbytes import BLANK_TABLE


def test_shards_do_not_depend_on_partitions_and_repeats_are_spread(spark, tmp_path):
    rows = [(7, "same")] * 900 + [(None, None)] * 300 + [(i, f"text {i}") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, aqe in ((4, "true"), (8, "false"), (211, "true")):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            got = sharding.assign(df.repartition(parts), bucket_rows=40).collect()
            seen.add(tuple(sorted(map(str, map(tuple, got)))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(seen) == 1
    sizes = Counter(r.shard for r in got)
    assert len(got) == 2000 and set(sizes.values()) == {50}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(50)) for s in sizes)
    hot = Counter(r.shard for r in got if r.doc_id == 7)
    assert len(hot) == 40 and max(hot.values()) < 40  # 22.5 of 50 on average
    wide = df.withColumns({"n": F.monotonically_increasing_id(), "shard": F.lit("own"), "nth": F.lit(1), "row_id": F.lit(2)})
    sharding.write_shards(wide.repartition(5), str(tmp_path / "out"), 8, bucket_rows=40)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 2000 and back.select("shard", "slot").distinct().count() == 2000 and back.select("n").distinct().count() == 2000
    slots = {(r.doc_id, r.shard, r.slot) for r in back.collect()}
    assert slots == {(r.doc_id, r.shard, r.slot) for r in sharding.assign(df, 8, bucket_rows=40).collect()}


def test_numbers_of_many_repeats(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REPEATS", 7)
    df = spark.createDataFrame([(1, "a")] * 50 + [(2, "b")] * 7 + [(3, "c")], "doc_id long, text string")
    assert Counter(r.doc_id for r in sharding.assign(df, 4, bucket_rows=5).collect()) == {1: 50, 2: 7, 3: 1}


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Released under the BSD License", ["bsd"]),
        ("Released under the MIT License", ["mit"]),
        ("Licensed under the Mozilla Public License, Version 2.0", ["mpl-2.0"]),
        ("Licensed under the Apache License, Version 2.0", ["apache-2.0"]),
        ("This work is licensed under the Open Public License, version 3", ["unnamed"]),
        ("Released under the Zope License", ["unnamed"]),
        ("released with a licence for the public", []),
    ],
)
def test_sentences_about_other_licences(spark, text, labels):
    for max_words in (20_000, 1):  # one batch, and a batch for each notice
        got = license_scan.scan(spark.createDataFrame([(1, text), (2, "unlike")], "doc_id long, text string"), max_words=max_words).collect()
        assert {r.doc_id: list(r.labels) for r in got} == {1: labels, 2: []}


def naive_chunks(text):
    """Chunks of a text by the definition: (words, first word), one word at a time."""
    raw, words, at = text.encode(), [], 0
    for w in text.split(" "):
        if w:
            words.append((at, at + len(w.encode())))
        at += len(w.encode()) + 1
    score = []
    for _, end in words:
        if end - 1 < 15:
            score.append(-1)
            continue
        h = 0
        for age in range(16):
            h = (h + (int(substring_dedup.GEAR[raw[end - 1 - age]]) << age)) & 0xFFFFFFFF
        score.append(h)
    reach, out, first = substring_dedup.REACH, [], 0
    for k, s in enumerate(score):
        before, after = score[max(0, k - reach) : k], score[k + 1 : k + 1 + reach]
        if (s >= 0 and all(s > x for x in before) and all(s >= x for x in after)) or k == len(score) - 1:
            out.append((tuple(text.split(" ")[first : k + 1]), first))
            first = k + 1
    return out


def test_substring_dedup_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    word = lambda n, top: [f"w{x}" for x in rng.integers(0, top, n)]
    shared = [word(int(n), 4000) for n in rng.integers(20, 90, 6)]
    texts = []
    for _ in range(40):
        parts = [word(int(rng.integers(5, 60)), 4000)]
        for k in rng.choice(6, rng.integers(0, 3), replace=False):
            parts += [shared[k], word(int(rng.integers(5, 60)), 4000)]
        texts.append(" ".join(x for p in parts for x in p))
    texts += [texts[0], " ".join(shared[1] + shared[1])]
    chunks = [naive_chunks(t) for t in texts]
    keeper = {}
    for i, cs in enumerate(chunks):
        for c, _ in cs:
            keeper.setdefault(c, set()).add(i)
    expect = []
    for i, cs in enumerate(chunks):
        seen, gone, run = set(), [], []
        for c, first in [*cs, (None, None)]:
            again = c is not None and (c in seen or (len(keeper[c]) > 1 and min(keeper[c]) != i))
            if again:
                run += range(first, first + len(c))
            else:
                gone += run if len(run) >= substring_dedup.MIN_WORDS else []
                run = []
            seen.add(c)
        expect.append([w for k, w in enumerate(texts[i].split(" ")) if k not in set(gone)])
    got = {r.doc_id: r for r in substring_dedup.remove(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), facts=True).collect()}
    assert any(len(e) < len(t.split(" ")) for e, t in zip(expect, texts))
    for i, e in enumerate(expect):
        assert got[i].text.split() == e and got[i].removed_words == len(texts[i].split(" ")) - len(e)
    assert BLANK_TABLE[32] == 0
