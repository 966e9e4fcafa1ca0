"""Pipeline stages on repeated rows, null ids, clashing names and empty tables; edges of the n-gram join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from viamark.llm import exact_dedup, ngram_join, packing, quality, substring_dedup

TEXT = " ".join(f"w{k * k % 97}" for k in range(40))
NEAR = TEXT.replace("w0 w1", "w0 wx", 1)
CLASHES = ("id_", "hash_", "doc_", "keep", "twin", "best_", "gone_id", "text_sha256", "text_hash", "row_id", "repeat_words", "removed", "n_words", "h", "a.b", "a`b")


@pytest.fixture(scope="module")
def rows(spark):
    texts = [(1, TEXT), (1, TEXT), (1, TEXT), (2, NEAR), (None, TEXT), (None, TEXT), (5, "a b c d e f"), (5, "a  b c d   e f "), (6, None), (6, ""), (7, "x" * 3_000_000)]
    return spark.createDataFrame(texts, "doc_id long, text string").withColumn("lang", F.lit("en"))


def test_near_stage_keeps_one_row_a_group(rows):
    kept = ngram_join.keep_one(rows).collect()
    assert sorted((r.doc_id, (r.text or "")[:1]) for r in kept) == [(1, "w"), (5, "a"), (6, ""), (6, ""), (7, "x")]


def test_exact_stage_keeps_the_longest_twin(rows):
    kept = exact_dedup.keep_one(rows).collect()
    assert sorted((r.doc_id, len(r.text or "")) for r in kept) == [(1, len(TEXT)), (2, len(NEAR)), (5, 15), (6, 0), (7, 3_000_000)]


@pytest.mark.parametrize("work", [exact_dedup.keep_one, ngram_join.keep_one, substring_dedup.remove, lambda d: quality.keep_good(d, d.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int"))])
def test_columns_of_any_name_are_carried(rows, work):
    wide = rows.withColumns({c: F.lit(c) for c in CLASHES})
    out = work(wide)
    assert out.columns == wide.columns and out.count() == work(rows).count()
    assert {tuple(r[c] for c in CLASHES) for r in out.collect()} == {CLASHES}
    assert work(wide.limit(0)).count() == 0


def test_packing_carries_no_column_of_the_input(rows):
    assert packing.pack(rows.withColumns({c: F.lit(c) for c in CLASHES})).count() >= rows.count()


def connected(m, pairs):
    label = list(range(m))
    for a, b in pairs:
        x, y = label[a], label[b]
        label = [x if z == y else z for z in label]
    return [label.index(z) for z in label]


def test_edges_of_a_run_are_few_and_connect_it():
    rng = np.random.default_rng(5)
    for m in (2, 3, 5, 8, 40, 300):
        low = rng.integers(0, 255, (m, ngram_join.HASHES)).astype(np.uint8)
        for k in range(1, m):  # chains of near copies, and copies of copies
            if rng.random() < 0.7:
                low[k] = low[rng.integers(max(0, k - 3), k)]
                low[k, rng.integers(0, ngram_join.HASHES, 25)] = 7
        i, j = np.triu_indices(m, 1)
        alive = np.zeros(len(i), bool)
        alive[ngram_join.prune(low, i, j, 0.8, 1e-6)] = True
        whole = connected(m, zip(i[alive].tolist(), j[alive].tolist()))
        found = ngram_join.ties(low, np.zeros(m, bool), 0.8, 1e-6)
        assert len(found) == m - len(set(whole)) and connected(m, found) == whole
        few = ngram_join.spanning(alive[None, :], i, j, m)[0]
        assert few.sum() <= alive.sum() and connected(m, zip(i[few].tolist(), j[few].tolist())) == whole
        side = rng.random(m) < 0.5
        side[:2] = True, False
        across = ngram_join.ties(low, side, 0.8, 1e-6)
        inside = [(a, b) for a, b in zip(i[alive].tolist(), j[alive].tolist()) if side[a] == side[b]]
        assert connected(m, [*inside, *across]) == whole and all(side[a] != side[b] for a, b in across)
        assert len(across) == len(set(connected(m, inside))) - len(set(whole))


def test_a_run_of_copies_gives_one_edge_a_row():
    low = np.zeros((1000, ngram_join.HASHES), np.uint8)
    assert len(ngram_join.ties(low, np.zeros(1000, bool), 0.8, 1e-6)) == 999
    assert len(ngram_join.ties(low, np.arange(1000) % 2 == 1, 0.8, 1e-6)) == 1


def test_pipeline_on_null_ids_further_columns_and_no_rows(spark, tmp_path):
    import corpus_pipeline
    from viamark.llm.common import stage

    body = " ".join(f"word{k}" for k in range(60))
    rows = [(None, body), (None, body), (1, body), (2, body.replace("word7 ", "other ")), (3, None), (4, ""), (None, " ".join(f"x{k}" for k in range(50)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en")} | {c: F.lit(c) for c in CLASHES})
    path = str(tmp_path / "sf")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    df, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, work in corpus_pipeline.STAGES[:-1]:
        df = stage(work(spark, df, path), name.replace(" ", ""))
        assert df.columns == docs.columns and work(spark, df.limit(0), path).count() == 0
        kept.append(sorted((r.doc_id or 0, (r.text or "")[:1]) for r in df.collect()))
    assert kept == [[(0, "w"), (0, "w"), (0, "x"), (1, "w"), (2, "w")], [(0, "x"), (1, "w"), (2, "w")], [(0, "x"), (1, "w")], [(0, "x"), (1, "w")]]
    packed = corpus_pipeline.STAGES[-1][1](spark, df, path)
    assert packed.count() == 2 and corpus_pipeline.STAGES[-1][1](spark, df.limit(0), path).count() == 0
    first, second = corpus_pipeline.run(spark, path), corpus_pipeline.run(spark, path)
    assert first.count() == second.count() == 2  # a second run leaves the first one's rows alone


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_substring_dedup_loses_no_text(spark, parts):
    """Rows without an id, with one id and with equal texts: what is cut depends on id and text alone, and one copy stays."""
    a, b = (" ".join(f"{c}{k * k % 89}" for k in range(60)) for c in "ab")
    rows = [(None, a), (None, a), (None, a), (None, a + " tail"), (None, b), (7, b), (7, b), (9, b + " more"), (9, "short"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted(((r.doc_id, r.text) for r in substring_dedup.remove(docs).collect()), key=str)
    texts = [t for _, t in got if t]
    assert [t for i, t in got if i == 7] == [b, b] and len(got) == len(rows)
    whole = [t for i, t in got if i is None and t and t.startswith(a)]
    assert a in "|".join(texts) and (whole in ([a, a, a], [a + " tail"])), got
    again = sorted(((r.doc_id, r.text) for r in substring_dedup.remove(docs.repartition(3)).collect()), key=str)
    assert again == got
