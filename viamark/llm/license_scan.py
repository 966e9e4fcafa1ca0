"""Licence scan: exact set-similarity join of text blocks with notices (DataFrame functions only).

A block is a window of words, twice as long as the longest notice of its size class and
moved on by half, so that any passage as long as a notice lies whole in some block. A
block matches a notice when it contains at least ``threshold`` of the notice's distinct
words. Blocks are cut down to words of notices, words are ordered by how many blocks hold
them (rarest first), and only blocks that share a word of both prefixes, pass the length
filter and the positional filter are compared. The filters lose no match.

A notice may name words that make it out, as a short notice has the same sentence as that
of another licence. A block that meets the threshold without them is a match as well, but
names no label; a text all of whose matches are such has the label ``unnamed``.

Whole phrases are found by position besides. Notices are parameters and are worked on in
batches of ``MAX_WORDS`` words, which bounds everything that is broadcast or collected.

Defined cases: a null or empty text has no words, no labels and score 0; each row of the
input gives one row, repeated rows too; further columns of any name are ignored; texts of
any length are read whole; no notices, or an empty table, give base labels or no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viamark.llm.common import lowered, stage, text_of, union_all, with_row_id

THRESHOLD = 0.8
MAX_WORDS = 20_000
#: Label of a match without the words that make the notice out.
UNNAMED = "unnamed"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label and wording of widely used public licence notices, and the words that make them out.
NOTICES = (
    ("mit", "Released under the MIT License", ("mit",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu", "general", "public")),
    ("bsd", "Released under the BSD License", ("bsd",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc", "by", "nc")),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative", "commons", "attribution")),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission", "granted", "copy")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution", "binary")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla",)),
    ("mpl-2.0", "Licensed under the Mozilla Public License, Version 2.0", ("mozilla",)),
)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def size_classes(notices) -> dict[int, list[tuple[str, list[str], list[str]]]]:
    """Notices by window: the words of the longest notice up to 16, 64, 256, ... words; label, words, words that make it out."""
    out: dict[int, list[tuple[str, list[str], list[str]]]] = {}
    for label, text, *must in notices:
        if words := words_of(text):
            size = 4 ** max(2, math.ceil(math.log(len(words), 4)))
            out.setdefault(size, []).append((label, words, [w for w in (must[0] if must else ()) if w in words]))
    return {max(len(w) for _, w, _ in group): group for _, group in sorted(out.items())}


def batches(classes: dict[int, list], max_words: int) -> list[dict[int, list]]:
    """The size classes cut into parts of at most ``max_words`` words, or one notice."""
    out, held = [{}], 0
    for span, group in classes.items():
        for notice in group:
            if held and held + len(notice[1]) > max_words:
                out.append({})
                held = 0
            out[-1].setdefault(span, []).append(notice)
            held += len(notice[1])
    return out


def _in_block(span: int, vocabulary: Column):
    return lambda b: F.struct(F.lit(span).alias("span"), F.array_intersect(F.array_distinct(b), vocabulary).alias("words"))


def _at_least(n: int):
    return lambda b: F.size(b["words"]) >= n


def _words(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, t_ (lower-case text)."""
    return with_row_id(docs.select("doc_id", lowered(text_of()).alias("t_")))


def _places(d: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """Adds w_ (words) and places (at, label) of whole phrases."""
    d = d.withColumns({"w_": F.regexp_extract_all("t_", F.lit(WORD), 0), "near_": F.rlike("t_", F.lit("|".join(GAP.join(p.split()) for p in phrases)))})
    places = []
    for phrase, label in phrases.items():
        test = " and ".join(f"get(w_, i + {k}) = '{w}'" if k else f"w = '{w}'" for k, w in enumerate(phrase.split()))
        places.append(F.expr(f"filter(transform(w_, (w, i) -> if({test}, struct(i as at, '{label}' as label), null)), x -> x is not null)"))
    return d.withColumn("places", F.when(F.col("near_"), F.concat(*places)))


def _blocks(d: DataFrame, need: dict[int, list]) -> DataFrame:
    """Adds blocks: windows of w_ cut down to the words of notices, those with enough of them."""
    vocab = sorted({w for group in need.values() for _, ws, _, _ in group for w in ws})
    none = F.expr("cast(array() as array<struct<span:int,words:array<string>>>)")
    if not vocab:
        return d.withColumn("blocks", none)
    words_lit = F.array(*[F.lit(w) for w in vocab])
    d = d.withColumn("v_", F.array_intersect(F.array_distinct("w_"), words_lit))
    parts = []
    for span, group in need.items():
        least = min(a for _, _, _, a in group)
        cut = F.expr(f"transform(sequence(0, greatest(0, (size(w_) - {span} - 1) div {span})), k -> slice(w_, k * {span} + 1, {2 * span}))")
        parts.append(F.coalesce(F.when(F.size("v_") >= least, F.filter(F.transform(cut, _in_block(span, words_lit)), _at_least(least))), none))
    return d.withColumn("blocks", F.concat(*parts))


def _matches(slim: DataFrame, need: dict[int, list]) -> DataFrame:
    """row_id, label, notice_no, at, share: blocks of ``slim`` (row_id, blocks) that contain a notice."""
    block = slim.select("row_id", F.posexplode("blocks").alias("at", "b")).select("row_id", "at", "b.span", "b.words")
    # One row for each word of the notices of a batch.
    held = dict(block.select(F.explode("words").alias("w")).groupBy("w").count().collect())
    order = sorted({w for group in need.values() for _, ws, _, _ in group for w in ws}, key=lambda w: (held.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = [
        (span, w, i, label, len(ws), a, sorted(ws, key=rank.get), must, n)
        for span, group in need.items()
        for n, (label, ws, must, a) in enumerate(group)
        for i, w in enumerate(sorted(ws, key=rank.get)[: len(ws) - a + 1])
    ]
    index_df = slim.sparkSession.createDataFrame(index, "span int, w string, i int, label string, size int, least int, notice array<string>, must array<string>, notice_no int")
    least = F.create_map(*[F.lit(x) for span, group in need.items() for x in (span, min(a for _, _, _, a in group))])
    b = block.withColumn("words", F.array_intersect(F.array(*[F.lit(w) for w in order]), F.col("words")))
    b = b.withColumn("prefix", F.slice("words", F.lit(1), F.size("words") - least[F.col("span")] + 1))
    # As many rows as words in the prefixes of a batch of notices.
    pairs = b.select("row_id", "at", "span", "words", F.posexplode("prefix").alias("j", "w")).join(F.broadcast(index_df), ["span", "w"])
    pairs = pairs.where("size(words) >= least and 1 + least(size - i - 1, size(words) - j - 1) >= least")
    pairs = pairs.withColumn("common", F.size(F.array_intersect("words", "notice"))).where("common >= least")
    label = F.expr(f"if(forall(must, m -> array_contains(words, m)), label, '{UNNAMED}')")
    return pairs.select("row_id", label.alias("label"), F.struct("span", "notice_no").alias("notice_no"), "at", (F.col("common") / F.col("size")).alias("share"))


def scan(docs: DataFrame, notices=NOTICES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, max_words: int = MAX_WORDS) -> DataFrame:
    """row_id, doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score, n_matches (blocks with a notice)."""
    classes = size_classes(notices)
    parts = [{span: [(label, list(dict.fromkeys(ws)), must, math.ceil(threshold * len(set(ws)) - 1e-9)) for label, ws, must in group] for span, group in part.items()} for part in batches(classes, max_words)]
    d = _words(docs) if len(parts) == 1 else stage(_words(docs), "texts")  # row numbers hold over batches
    d = _places(d, phrases)
    slim = stage(_blocks(d, parts[0]).select("row_id", "doc_id", F.size("w_").cast("long").alias("n_words"), "places", "blocks"), "licence")
    pairs = [_matches(slim, parts[0])] if parts[0] else []
    pairs += [_matches(stage(_blocks(d, part).select("row_id", "blocks"), "licence"), part) for part in parts[1:]]
    none = F.expr("cast(array() as array<string>)")
    out = slim.drop("blocks")
    if pairs:
        found = union_all(*pairs).groupBy("row_id").agg(F.collect_set("label").alias("all_"), F.max("share").alias("share"), F.countDistinct("at", "notice_no").alias("n_matches"))
        named = F.array_remove("all_", UNNAMED)
        found = found.withColumn("found", F.when(F.size(named) > 0, named).otherwise(F.col("all_"))).drop("all_")
        out = out.join(found.hint("merge"), "row_id", "left")
    else:
        out = out.withColumns({"found": none, "share": F.lit(0.0), "n_matches": F.lit(0).cast("long")})
    base = F.coalesce(F.array_sort(F.array_distinct(F.col("places.label"))), none)
    n_base = F.coalesce(F.size(F.coalesce("places", F.expr("cast(array() as array<struct<at:int,label:string>>)"))), F.lit(0)).cast("long")
    return out.select(
        "row_id", "doc_id", "n_words", n_base.alias("n_base"),
        F.array_min("places.at").cast("long").alias("first_word"), F.array_max("places.at").cast("long").alias("last_word"),
        base.alias("base_labels"), F.array_sort(F.array_union(base, F.coalesce("found", none))).alias("labels"),
        F.greatest(F.when(n_base > 0, 1.0).otherwise(0.0), F.coalesce("share", F.lit(0.0))).alias("score"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
    )
