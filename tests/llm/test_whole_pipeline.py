"""The whole pipeline on a small corpus against what each stage should leave, worked out by hand and by brute force."""

import re
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline

TOKENS = "doc_id long, text string, lang string, source string, n_chars long"


def fresh(rng, n):
    return ["".join(rng.choice(list("abcdefghijklmnopqrst"), 6)) for _ in range(n)]


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def repetitive(text):
    w = text.split()
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_pipeline_against_brute_force(spark, tmp_path):
    import public_tokenizers

    rng = np.random.default_rng(21)
    passage = fresh(rng, 80)
    texts = {k: " ".join(fresh(rng, int(rng.integers(60, 200)))) for k in range(40)}
    for k in (40, 41, 42):  # a passage that three documents share
        texts[k] = " ".join([*fresh(rng, 70), *passage, *fresh(rng, 70)])
    for k in range(50, 56):  # equal but for white space
        texts[k] = texts[k - 50].replace(" ", "\n" if k % 2 else "  ")
    for k in range(60, 66):  # one word of the middle changed
        w = texts[k - 50].split()
        w[len(w) // 2] = "changed"
        texts[k] = " ".join(w)
    texts |= {70: "too short", 71: "", 72: "again and again the same words " * 20}
    rows = [(k, t, "en", "s", len(t)) for k, t in texts.items()] + [(73, None, "en", "s", 0)]
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, TOKENS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")

    good = {k: t for k, t in texts.items() if not repetitive(t)}
    once = {}
    for k in sorted(good, key=lambda k: (-len(good[k]), k)):
        once.setdefault(re.sub(r"[\x20\x09-\x0D]", "", good[k]), k)
    kept = sorted(once.values())
    near, sets = [], {k: shingles(good[k]) for k in kept}
    for k in kept:
        if not any(len(sets[k] & sets[j]) / max(1, len(sets[k] | sets[j])) >= 0.8 for j in near):
            near.append(k)
    assert len(near) == 43

    pieces = corpus_pipeline.run(spark, path).collect()
    tokens = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    size = lambda text: len(tokens.encode(text, add_special_tokens=False).ids) + 1
    total = {r.doc_id: r.doc_tokens for r in pieces}
    assert sorted(total) == near
    for k in near:
        mine = sorted((r.start, r.length) for r in pieces if r.doc_id == k)
        assert [a for a, _ in mine] == list(np.cumsum([0] + [n for _, n in mine[:-1]])) and sum(n for _, n in mine) == total[k]
        if k not in (41, 42):
            assert total[k] == size(good[k])  # nothing is cut from a document that is first or alone
        else:
            assert size(good[k]) - size(" ".join(passage)) - 10 <= total[k] <= size(good[k]) - 0.85 * size(" ".join(passage))
    used = Counter()
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024
