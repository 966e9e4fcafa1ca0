"""Operators on small tables: nulls, empty and long texts, ties, repeats, empty tables, further columns."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from viamark.llm import byte_bpe, exact_dedup, license_scan, lm_score, ngram_join, packing, quality, sharding, substring_dedup, token_count
from viamark.llm.common import stage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, size=400):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, size, n)]


def corpus():
    passage = " ".join(words(60, 5, 5000))
    base = " ".join(words(200, 1, 5000))
    near = base.split()
    near[100] = "changed"
    long = " ".join(words(9000, 9, 9000))
    return [
        (1, base), (2, base.replace(" ", "\n")), (3, " ".join(near)), (4, None), (5, ""), (6, "   \n"),
        (7, " ".join(words(80, 7, 5000)) + " " + passage + " " + " ".join(words(80, 8, 5000))),
        (8, " ".join(words(70, 11, 5000)) + "\n" + passage + "\n" + " ".join(words(75, 12, 5000))),
        (9, long), (10, "All rights reserved. Licensed under CC-BY 4.0"), (10, "All rights reserved. Licensed under CC-BY 4.0"),
        (None, "Ünïcödé 漢字 text, twice"), (None, "Ünïcödé 漢字 text, twice"), (13, "don't  stop\t\tit's <|endoftext|> 12 €"),
        (14, "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and or sell copies of the Software"),
        (15, "a"), (16, "one two three"), (17, "One, two: three!"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, "s", len(t or "")) for (i, t), lang in zip(corpus(), ["en", None, "fr", "xx"] * 9)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_license_scan(docs, none):
    got = {r.doc_id: r for r in license_scan.scan(docs.withColumn("w_", F.lit(1))).collect()}
    assert list(got[10].base_labels) == ["cc-by", "reserved"] and got[10].n_base == 2
    assert (got[10].first_word, got[10].last_word, got[10].score) == (0, 5, 1.0)
    assert list(got[14].labels) == ["mit"] and got[14].base_labels == [] and got[14].score >= 0.8
    assert got[4].n_words == 0 and got[4].labels == [] and got[4].first_word is None
    assert license_scan.scan(none).count() == 0
    assert [list(r.labels) for r in license_scan.scan(docs.where("doc_id = 14"), notices=()).collect()] == [[]]


def test_license_filters_lose_nothing(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefghijkl"), rng.integers(1, 40))) for _ in range(150)]
    notices = [("x", "a b c d e"), ("y", "c f g h i j"), ("z", "k l a")]
    got = {r.doc_id: set(r.labels) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), notices, {"a b": "ab"}, 0.8).collect()}
    for i, t in enumerate(texts):
        w, expect = t.split(), set()
        if any(w[k : k + 2] == ["a", "b"] for k in range(len(w))):
            expect.add("ab")
        for k in range(0, max(0, (len(w) - 7) // 6) + 1):
            block = set(w[6 * k : 6 * k + 12])
            expect |= {n for n, x in notices if len(block & set(x.split())) >= np.ceil(0.8 * len(x.split()))}
        assert got[i] == expect


def test_exact_dedup(docs, none):
    got = exact_dedup.report(docs).collect()
    groups = defaultdict(list)
    for i, t in corpus():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    assert len(got) == len(corpus())
    for r in got:
        key = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(groups[key])
    by = {r.doc_id: r for r in got}
    assert by[2].keep_id == 1 and not by[2].kept and by[6].kept and by[4].keep_id == 6  # the longest text stays
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.report(none).count() == 0 and exact_dedup.keep_one(none).count() == 0


def test_exact_dedup_hot_group(spark):
    rows = [(i, "same" if i % 3 else f"text {i}") for i in range(3000)]
    got = {r.doc_id: r for r in exact_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].keep_id == (1 if i % 3 else i) and got[i].group_size == (2000 if i % 3 else 1) for i in got)


def test_sharding(spark, docs, none, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 50}" * (i % 7)) for i in range(1003)], "doc_id long, text string")
    got = sharding.assign(df, bucket_rows=20).collect()
    sizes = Counter(r.shard for r in got)
    assert sorted(r.doc_id for r in got) == list(range(1003)) and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 40
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    text = dict(df.collect())
    assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] != list(range(1003))
    assert sharding.assign(docs).count() == docs.count() and sharding.assign(none).count() == 0
    sharding.write_shards(df, str(tmp_path / "out"), 8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 1003 and back.select("shard", "slot").distinct().count() == 1003


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + o for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for o in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, docs, none):
    extra = [(20, "a b c d e a b c d e a b c d e f g"), (21, "x y\nx y\n \n\nx y"), (22, "é # * é # * é # * é # * 1 2"), (23, "a " * 500)]
    df = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(i, t, "en") for i, t in extra], "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(df, labels).collect()
    texts = defaultdict(list)
    for i, t in corpus() + extra:
        texts[i].append(brute_quality(t))
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in texts[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)  # too few labels to certify a cutoff
    assert quality.judge(none, labels.limit(0)).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_levels_are_exact(spark):
    """The strictest level whose exact tail is small enough, tested in order; nothing under 459 good texts."""
    from math import comb

    kinds = "stratum string, " + ", ".join(f"{r} double" for r in quality.RULES)
    worst = [0.0] * 1960 + [0.03] * 5 + [0.12] * 30 + [0.5] * 5
    rows = [("en", v if k % 2 else 0.0, 0.0, 0.0, 0.0, v) for k, v in enumerate(worst)]
    rows += [("de", 0.0, 0.0, 0.0, 0.0, 0.0)] * 459 + [("fr", 0.0, 0.0, 0.0, 0.0, 0.0)] * 458
    got = {r.stratum: r for r in quality.choose_levels(spark.createDataFrame(rows, kinds)).collect()}
    tail = lambda n, k: sum(comb(n, j) * 0.01**j * 0.99 ** (n - j) for j in range(k + 1))
    level = 0.05 / (len(quality.STRATA) + 1)
    good = []
    for c in quality.LADDER:
        if tail(2000, sum(v > c for v in worst)) > level:
            break
        good.append(c)
    assert got["en"].cutoff == good[-1] == 0.15 and (got["en"].n_good, got["en"].n_lost) == (2000, 5)
    assert abs(math.exp(got["en"].log_p) - tail(2000, 5)) < 1e-9
    assert got["de"].cutoff == quality.LADDER[-1] and tail(459, 0) <= level < tail(458, 0) and "fr" not in got


def test_quality_rejects_by_rule(spark):
    """Both ways to judge reject the texts above the certified cutoff of their stratum, and no others."""
    rows = [(k, lettered(k), "en") for k in range(600)] + [(9000 + k, lettered(k) + " " + "#" * (4 * k), lang) for k in (1, 4, 30) for lang in ("en", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("a.b", F.lit(1))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(600)], "doc_id long, quality int, toxic int")
    judged = quality.judge(df, labels).collect()
    share = {r.doc_id: r.symbol_share for r in judged if r.stratum == "en"}
    gone = sorted(i for i, v in share.items() if v > quality.LADDER[-1])
    assert sorted(r.doc_id for r in judged if not r.kept) == gone == [9001, 9004, 9030]
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and sorted((r.doc_id, r.lang) for r in kept.where("doc_id >= 9000").collect()) == [(9001, "de"), (9004, "de"), (9030, "de")]
    assert kept.count() == 603


def lettered(k):
    return " ".join("".join(chr(97 + int(d)) for d in f"{k * 12 + j:06d}") for j in range(12))


def test_quality_rules_together_lose_at_most_max_false(spark):
    """25 of 6,000 good texts fail each of four rules: each rule alone is under 1 %, all together are not."""
    odd = [" ####", " AAAA", " 1111", "\nx\nx"]
    texts = [lettered(k) + (odd[k // 25] if k < 100 else "") for k in range(6000)]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(6000)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(df, labels).count() >= 0.99 * 6000
    assert quality.judge(df, labels).where("kept").count() >= 0.99 * 6000


def test_quality_counts_copies_once(spark):
    """Copies of one clean text, in different white space, certify nothing against another text."""
    copies = [(k, lettered(7).replace(" ", "  " if k % 2 else " "), "en") for k in range(6000)]
    df = spark.createDataFrame([*copies, (9000, lettered(8) + " ####", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(6000)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(df, labels).where("doc_id = 9000").count() == 1
    assert quality.judge(df, labels).where("doc_id = 9000 and kept").count() == 1


def test_ngram_join_against_brute_force(spark, docs, none):
    rng = np.random.default_rng(2)
    texts = [t for _, t in corpus()]
    for g in range(6):
        base = words(int(rng.integers(20, 120)), 100 + g, 3000)
        for k in range(12):
            w = list(base)
            for _ in range(k // 3):
                w[int(rng.integers(0, len(w)))] = f"z{rng.integers(0, 99)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [[j for j in range(len(sets)) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(sets))]
    group = list(range(len(sets)))
    while (new := [min([group[i], *(group[j] for j in links[i])]) for i in range(len(sets))]) != group:
        group = new
    for block in (1024, 4):  # a small block makes every group a hot one
        got = {r.doc_id: (r.group_id, r.n_links) for r in ngram_join.resolve(df, block=block).collect()}
        assert got == {i: (group[i], len(links[i])) for i in range(len(sets))}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and {3, 2}.isdisjoint(r.doc_id for r in kept.collect())
    assert ngram_join.resolve(none).count() == 0


def test_common_counts_by_either_way():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 20000, 3000).astype(np.uint64)) for _ in range(12)]
    i, j = np.triu_indices(12, 1)
    expect = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert ngram_join.common(sets, i, j).tolist() == expect and ngram_join.common(sets, i[:9], j[:9]).tolist() == expect[:9]


def test_byte_bpe(docs, none):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = defaultdict(set)
    for i, t in corpus():
        ids = exact.encode_ordinary(t or "")
        texts[i].add((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    for size, overlap in ((1 << 15, 1 << 10), (300, 60), (200, 3)):  # the last overlap never shows a common boundary
        got = byte_bpe.encode(docs, True, chunk_chars=size, overlap=overlap).collect()
        assert len(got) == docs.count() and all((r.n_tokens, r.ids_sha256, r.decoded_sha256) in texts[r.doc_id] for r in got)
    back = byte_bpe.encode(docs).select("doc_id", F.pandas_udf(byte_bpe.decoder(), "binary")("ids").alias("raw")).collect()
    assert sorted(bytes(r.raw).decode() for r in back) == sorted((t or "") for _, t in corpus())
    assert byte_bpe.encode(none).count() == 0
    for raw in (b"x" * 500, "漢字かな".encode() * 60, b"abcdefgh" * 40):
        assert byte_bpe._merge_long(raw, ranks) == exact._encode_single_piece(raw)


def test_packing(docs, none):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
    expect = Counter()
    for i, t in corpus():
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for s in range(0, len(ids), 1024):
            expect[i, s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)] += 1
    got = packing.pack(docs, with_ids=True).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == expect
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    seqs = defaultdict(list)
    for r in packing.pack(docs, group=4).collect():
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, size in sorted(s):
            assert offset == at
            at += size
        assert at <= 1024
    assert packing.pack(none).count() == 0


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(4)
    sizes = sorted(rng.integers(1, 101, 300).tolist(), reverse=True)
    free, expect = [], []
    for s in sizes:
        b = next((k for k, f in enumerate(free) if f >= s), len(free))
        if b == len(free):
            free.append(100)
        free[b] -= s
        expect.append(b)
    assert packing.first_fit(sizes, 100)[0] == expect


def test_token_counts(docs, none):
    from public_tokenizers import path

    begin, inside = token_count.pieces_of(path("piece_bpe_32k.model"))

    def greedy(w):
        n = i = 0
        while i < len(w):
            j = next((j for j in range(len(w), i, -1) if w[i:j] in (inside if i else begin)), None)
            if j is None:
                return 1, 1
            n, i = n + 1, j
        return n, 0

    expect = defaultdict(set)
    for i, t in corpus():
        found = [greedy(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        expect[i].add((len(found), sum(a for a, _ in found), sum(b for _, b in found)))
    got = token_count.count(docs).collect()
    assert len(got) == docs.count() and all((r.n_words, r.n_tokens, r.n_unknown) in expect[r.doc_id] for r in got)
    assert token_count.count(none).count() == 0


def test_automaton_falls_back_over_several_pieces():
    a = token_count.Automaton(frozenset({"ab", "abcde", "a"}), frozenset({"c", "d", "cd", "x", "é"}))
    n, unknown = a.count(["abcdx", "abcde", "abc", "abcdé", "b", "abz", "ab"])
    assert n.tolist() == [3, 1, 2, 3, 1, 1, 1] and unknown.tolist() == [False, False, False, False, True, True, False]


def test_substring_dedup(docs, none):
    got = {r.doc_id: r for r in substring_dedup.remove(docs, facts=True).collect()}
    before = dict(corpus())
    assert got[7].text == before[7] and got[7].repeat_words >= 35 and got[7].removed_words == 0  # the first keeps it
    assert 35 <= got[8].removed_words <= 60 and len(got[8].text.split()) == len(before[8].split()) - got[8].removed_words
    assert set(got[8].text.split()) <= set(before[8].split())
    assert got[9].text == before[9] and got[9].removed_words == 0 and got[4].text is None
    assert not got[2].text.split()  # a whole copy
    out = substring_dedup.remove(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and substring_dedup.remove(none).count() == 0


def test_chunks_come_back_after_an_insertion():
    w = words(600, 3, 5000)
    a, b = " ".join(w), " ".join(w[:200] + ["inserted"] + w[200:])
    off, digest, *_ = substring_dedup.chunk_texts(pa.array([a, b]))
    first, second = set(digest[: off[1]].tolist()), set(digest[off[1] :].tolist())
    assert len(first - second) <= 4


def test_lm_score(spark, docs, none):
    rows = [(i, t) for i, t in corpus() if i is not None] + [(100 + k, " ".join(words(40, k, 60))) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (500_000, 20):
        got = lm_score.score(df, hot_words=hot).collect()
        out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
        tokens = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]) for i, t in rows]
        c = Counter(w for i, ws in tokens if not out[i] for w in ws)
        per = np.log10(sum(c.values()) + len(c) + 1)
        expect = {(i, len(ws), sum(w in c for w in ws), round(sum(np.log10(c[w] + 1) - per for w in ws), 4)) for i, ws in tokens}
        assert {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got} == expect
        assert all(r.held_out == out[r.doc_id] and r.train_tokens == sum(c.values()) and r.score < 0 for r in got)
    assert lm_score.score(docs).count() == docs.count() and lm_score.score(none).count() == 0


def test_lm_gradient_and_training():
    rng = np.random.default_rng(0)
    w = lm_score.first_weights().astype(np.float64)
    x, y = rng.integers(0, 50, (3, 12)), rng.integers(0, lm_score.CLASSES, (3, 12))
    _, g = lm_score.gradient(w, x, y)
    for i in np.flatnonzero(np.abs(g) > 1e-3)[::37]:
        up, down = w.copy(), w.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        slope = (lm_score.gradient(up, x, y)[0] - lm_score.gradient(down, x, y)[0]) / 2e-4
        assert abs(slope - g[i]) < 1e-3 * max(1, abs(slope))
    rows = np.tile(np.array([[11, 290, 318, 11, 290, 318] * 6])[:, : lm_score.WINDOW], (4096, 1))
    trained = lm_score.train(lm_score.first_weights(), rows)
    seen, kind = lm_score.seen_as(rows[:1, :-1]), lm_score.kinds()[rows[:1, 1:]]
    assert lm_score.gradient(trained, seen, kind)[0] < 0.3 * lm_score.gradient(lm_score.first_weights(), seen, kind)[0]


def test_lm_windows_score_each_id_once():
    """Blocks give the same as a plain pass with the same context for every id."""
    w = lm_score.first_weights()
    p = lm_score.unpack(w.astype(np.float64))
    within = np.log10(np.random.default_rng(1).random(lm_score.VOCABULARY))
    texts = [[5, 9, 700, 40000, *range(60), lm_score.END_ID], [lm_score.END_ID]]
    got = lm_score.Scorer(w, within).score(texts)
    for ids, total in zip(texts, got):
        x = lm_score.seen_as(np.array([lm_score.END_ID, *ids[:-1]]))
        expect = 0.0
        for t, target in enumerate(ids):
            first = max(0, t // lm_score.STRIDE * lm_score.STRIDE - lm_score.CONTEXT)
            e = p["e"][x[first : t + 1]]
            s = (e @ p["k"]) @ (e[-1] @ p["q"]) * lm_score.WIDTH**-0.5 + p["near"][np.arange(t - first, -1, -1)]
            a = np.exp(s - s.max())
            z = (a / a.sum()) @ (e @ p["v"]) @ p["o"] + e[-1] @ p["r"] + p["b"]
            expect += (z[lm_score.kinds()[target]] - np.log(np.exp(z).sum())) / np.log(10) + within[target]
        assert abs(total - expect) < 1e-2


def test_lm_trains_on_every_id_of_every_text(spark):
    """Each target once, at any length and without a blank; what fills up a window changes nothing."""
    get = lm_score.ids()
    texts = ["", "a", " ".join(words(9000, 3)), "x1" * 300, " ".join(words(31, 4)), "y" * 150 + " " + "z9" * 60]
    whole = [get.each(lm_score.words_of(t)) for t in texts]
    df = spark.createDataFrame([(w.tobytes(), k * 7) for k, w in enumerate(whole)], "ids binary, key long")
    rows = [lm_score.windows_of(np.frombuffer(bytes(r.piece), "<u2")) for k in range(lm_score.ROUNDS) for r in df.mapInArrow(lm_score._pieces(k), "piece binary").collect()]
    rows = np.concatenate(rows).astype(np.int64)
    real = np.ones((len(rows), lm_score.WINDOW - 1), bool)
    real[:, 1:] = rows[:, 1:-1] != lm_score.END_ID
    got = Counter(zip(rows[:, :-1][real].tolist(), rows[:, 1:][real].tolist()))
    assert got == Counter(p for w in whole for p in zip([lm_score.END_ID, *w.tolist()], w.tolist()))
    w, part = lm_score.first_weights(), rows[~real.all(1)][:1]
    size = int(real[~real.all(1)][0].sum())
    x, y = lm_score.seen_as(part[:, :-1]), lm_score.kinds()[part[:, 1:]]
    filled, bare = lm_score.gradient(w, x, y, real[~real.all(1)][:1]), lm_score.gradient(w, x[:, :size], y[:, :size])
    assert abs(filled[0] - bare[0]) < 1e-5 and np.allclose(filled[1], bare[1], atol=1e-6)


def test_lm_words_learnt_together():
    """Words encoded in one call have the ids they have alone; white space of another kind in a word is left to the slow path."""
    get = lm_score.ids()
    lists = [lm_score.words_of(t) for t in ("plain words, 12 o'clock it's", "na\u00efve \u4f60\u597d \U0001f600 x\x1cy", "\ud800 lone 'tis")]
    alone = {w: np.array(get.encode(" " + w.decode("utf-8", "replace")), "<u2").tobytes() for ws in lists for w in ws}
    get.known.clear()
    get.learn([lists[0]])
    assert set(get.known) == set(lists[0])
    get.learn(lists[1:])
    odd = lm_score.words_of("\u00a0 \u00a0x y\u3000")
    get.learn([odd])
    assert not set(odd) & set(get.known)
    for ws in (*lists, odd):
        one = [alone.get(w, np.array(get.encode(" " + w.decode("utf-8", "replace")), "<u2").tobytes()) for w in ws]
        assert get.each(ws).tobytes() == b"".join(one) + lm_score.END


def test_lm_gradient_with_large_exponents():
    """Where exponents may pass the limit, the other way of taking them gives the same gradient."""
    rng = np.random.default_rng(3)
    w = lm_score.first_weights().astype(np.float64)
    x, y = rng.integers(0, 50, (3, 12)), rng.integers(0, lm_score.CLASSES, (3, 12))
    limit = lm_score.LARGEST
    try:
        lm_score.LARGEST = np.float32(0)
        slow = lm_score.gradient(w, x, y)
    finally:
        lm_score.LARGEST = limit
    fast = lm_score.gradient(w, x, y)
    assert abs(slow[0] - fast[0]) < 1e-9 and np.allclose(slow[1], fast[1], atol=1e-7)


def test_pipeline_stages(spark, tmp_path, docs):
    import corpus_pipeline

    path = str(tmp_path / "sf")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    df, ids = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, work in corpus_pipeline.STAGES:
        df = stage(work(spark, df, path), name.replace(" ", ""))
        ids.append({r.doc_id for r in df.select("doc_id").collect()})
    assert ids[0] == {1, 2, 3, 7, 8, 9, 14} and ids[1] == {1, 3, 7, 8, 9, 14}  # 1 and 2 differ in white space only
    assert ids[2] == ids[3] == ids[4] == {1, 7, 8, 9, 14}
    assert corpus_pipeline.run(spark, path).count() == df.count()
