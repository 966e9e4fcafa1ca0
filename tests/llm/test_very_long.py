"""One word of a megabyte, and one line of many words, through every text operator."""

import pytest
from pyspark.sql import functions as F

from viamark.llm import byte_bpe, exact_dedup, license_scan, lm_score, ngram_join, packing, quality, sharding, substring_dedup, token_count

LONG = ("abcdefghij" * 100_000, " ".join(f"k{i % 977}" for i in range(60_000)))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, LONG[0]), (2, LONG[1]), (3, "short")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "ids": F.lit(1), "words": F.lit(2), "key": F.lit(3), "n": F.lit(4), "held_out": F.lit(5)})


def test_long_words_and_texts_are_read_whole(docs):
    labels = docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.n_words for r in license_scan.scan(docs).collect()} == {1: 1, 2: 60_000, 3: 1}
    assert {r.doc_id: r.n_tokens for r in lm_score.score(docs).collect()} == {1: 2, 2: 60_001, 3: 2}
    assert {r.doc_id: r.word_chars for r in quality.judge(docs, labels).collect()}[1] == 1_000_000
    assert {r.doc_id: r.n_words for r in token_count.count(docs).collect()} == {1: 1, 2: 60_000, 3: 1}
    assert exact_dedup.keep_one(docs).count() == ngram_join.keep_one(docs).count() == sharding.assign(docs).count() == 3
    pieces = packing.pack(docs).collect()
    assert all(sum(r.length for r in pieces if r.doc_id == i) == next(r.doc_tokens for r in pieces if r.doc_id == i) for i in (1, 2, 3))
    out = {r.doc_id: r for r in substring_dedup.remove(docs.select("doc_id", "text"), facts=True).collect()}
    assert out[1].text == LONG[0] and len(out[2].text.split()) == 60_000 - out[2].removed_words
    got = {r.doc_id: r for r in byte_bpe.encode(docs, True).collect()}
    assert len(got) == 3 and got[1].n_tokens > 1000


def test_long_words_have_the_tokens_of_the_batch_walk():
    a = token_count.Automaton(frozenset({"ab", "abcde", "a"}), frozenset({"c", "d", "cd", "x", "é"}))
    words = ["ab" + "cd" * k + end for k in range(5) for end in ("", "x", "é", "b")]
    n, unknown = a.count(words)
    assert [a.walk(w.encode()) for w in words] == list(zip(n.tolist(), unknown.tolist()))


def test_empty_tables_give_no_rows(docs):
    none, labels = docs.limit(0), docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (license_scan.scan(none), lm_score.score(none), quality.judge(none, labels), quality.keep_good(none, labels), token_count.count(none), packing.pack(none), substring_dedup.remove(none), byte_bpe.encode(none), sharding.assign(none)):
        assert out.count() == 0
