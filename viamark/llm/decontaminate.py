"""Benchmark passages in documents by a positional inverted index (DataFrame functions only).

Words of all documents are counted as far as the benchmark has them. In every window of
``window`` consecutive words of an item the rarest ``LISTS`` words are looked up: the index
holds their postings (term, row, position), lists are shifted by the word's place in the
window and intersected, rarest first. Windows with the same words at the same distances
share one look-up. What is left says where an item may lie over a document; there the words are
compared, and every run of ``window`` equal words is an exact phrase. With ``slack`` the
lists are intersected within so many words instead: proximity matches.

Only the first, rarest list meets several patterns, map-side; later lists are joined on
term, row and position, so a common term does not gather in one task. Tables of the
benchmark are broadcast when their stored size is small, else joined by sorting. Equal
items are one body until the last step.

Defined cases: a null or empty text has no words and no hits; a null item_id is written as
an empty string; rows with equal item_id count as one item, repeated documents are
reported each; an item shorter than a window is one window; further columns are ignored;
an empty benchmark hits nothing, an empty corpus gives no rows; texts of any length are
compared whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viamark.llm.common import lowered, stage, stored_bytes, text_of, with_row_id

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, LISTS = 10, 3
#: Stored size up to which a table of the benchmark, or of its places, is broadcast.
BROADCAST_BYTES = 8 << 20


def _small(df: DataFrame) -> DataFrame:
    return df.hint("broadcast" if stored_bytes(df) <= BROADCAST_BYTES else "merge")


def _tokens(df: DataFrame, key: str) -> DataFrame:
    """Staged: row_id, the key and the words."""
    return stage(with_row_id(df.select(key, F.regexp_extract_all(lowered(text_of()), F.lit(WORD), 0).alias("words"))), "words")


def build_index(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """Staged postings (term, row_id, pos) of the ``terms`` (staged, column term) in ``tokens`` (row_id, words)."""
    placed = tokens.select("row_id", F.posexplode("words").alias("pos", "term"))
    return stage(placed.join(_small(terms), "term", "left_semi").select("term", "row_id", "pos"), "postings")


def rarest(bodies: DataFrame, tokens: DataFrame, window: int, lists: int) -> DataFrame:
    """Staged body_no, pattern, q0: the rarest words of each window, as words with distances from the first of them.

    Windows with a word that no document has are left out.
    """
    placed = bodies.select("body_no", F.size("body").alias("n"), F.least(F.size("body"), F.lit(window)).alias("w"), F.posexplode("body").alias("q", "term"))
    terms = stage(placed.select("term").distinct(), "terms")
    held = stage(tokens.select(F.explode("words").alias("term")).join(_small(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("held")), "held")
    placed = placed.join(_small(held), "term").withColumn("start", F.explode(F.expr("sequence(greatest(0, q - w + 1), least(q, n - w))")))
    found = placed.groupBy("body_no", "start", "w").agg(F.sort_array(F.collect_list(F.struct("held", "term", "q"))).alias("t")).where("size(t) = w")
    chosen = F.expr(f"transform(slice(t, 1, {lists}), x -> struct(x.term as term, x.q - t[0].q as d))")
    return stage(found.select("body_no", chosen.alias("pattern"), F.expr("t[0].q").alias("q0")).distinct(), "patterns")


def intersect(postings: DataFrame, patterns: DataFrame, lists: int, slack: int = 0) -> DataFrame:
    """pattern, row_id, pos: where the first word of a pattern stands and the others at their distances, within ``slack``."""
    each = stage(patterns.select("pattern", F.expr("pattern[0].term").alias("term")).distinct(), "each")
    at = postings.join(_small(each), "term").drop("term")
    width = 2 * slack + 1
    for k in range(1, lists):
        # Shorter patterns have no such word and stay.
        want = at.withColumns({"term_": F.expr(f"get(pattern, {k}).term"), "want": F.expr(f"pos + get(pattern, {k}).d")})
        more = want.where("term_ is not null").withColumn("near", F.explode(F.expr(f"sequence(floor((want - {slack}) / {width}), floor((want + {slack}) / {width}))")))
        listed = postings.select(F.col("term").alias("term_"), "row_id", F.floor(F.col("pos") / width).alias("near"), F.col("pos").alias("pos_"))
        met = more.join(listed.hint("merge"), ["term_", "row_id", "near"]).where(F.abs(F.col("pos_") - F.col("want")) <= slack).select("pattern", "row_id", "pos")
        at = want.where("term_ is null").select("pattern", "row_id", "pos").unionByName(met.distinct() if slack else met)
    return at


def _runs(places: DataFrame, tokens: DataFrame, bodies: DataFrame, window: int) -> DataFrame:
    """row_id, body_no, start, stop: maximal runs of a window or more words that agree. places: row_id, body_no, shift (staged)."""
    shown = tokens.join(_small(places), "row_id").join(_small(bodies), "body_no")
    breaks = "filter(sequence(0, size(body)), j -> j = size(body) or not (get(words, shift + j) <=> body[j]))"
    shown = shown.select("row_id", "body_no", "shift", F.least(F.size("body"), F.lit(window)).alias("w"), F.expr(f"concat(array(-1), {breaks})").alias("b"))
    runs = F.expr("filter(transform(sequence(1, size(b) - 1), k -> struct(shift + b[k - 1] + 1 as start, shift + b[k] as stop)), r -> r.stop - r.start >= w)")
    return shown.select("row_id", "body_no", F.explode(runs).alias("r")).select("row_id", "body_no", "r.start", "r.stop")


def _covered(runs: DataFrame) -> DataFrame:
    """row_id, n_hit: places inside any run, without gathering a row's runs."""
    before = F.max("stop").over(Window.partitionBy("row_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(before, "start")))
    return runs.withColumn("new", new).groupBy("row_id").agg(F.sum("new").cast("long").alias("n_hit"))


def _named(found: DataFrame, names: DataFrame) -> DataFrame:
    """row_id, item_ids (sorted strings). found: row_id, body_no."""
    return found.distinct().join(_small(names), "body_no").groupBy("row_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, lists: int = LISTS, slack: int | None = None) -> DataFrame:
    """row_id, doc_id, n_words, n_hit, item_ids; with ``slack`` also near_ids: items of which a window's rarest words stand close."""
    tokens = _tokens(docs.select("doc_id", "text"), "doc_id")
    read = _tokens(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text"), "item_id").where("size(words) > 0")
    bodies = stage(read.groupBy(F.col("words").alias("body")).agg(F.min("row_id").alias("body_no")), "bodies")
    names = stage(read.join(_small(bodies), F.col("words") == F.col("body")).select("body_no", "item_id").distinct(), "names")
    patterns = rarest(bodies, tokens, window, lists)
    terms = stage(patterns.select(F.explode("pattern.term").alias("term")).distinct(), "terms")
    postings = build_index(tokens, terms)

    def places(slack: int) -> DataFrame:
        return stage(intersect(postings, patterns, lists, slack).join(_small(patterns), "pattern").select("row_id", "body_no", (F.col("pos") - F.col("q0")).alias("shift")).distinct(), "places")

    runs = stage(_runs(places(0), tokens, bodies, window), "runs")
    found = [_covered(runs), _named(runs.select("row_id", "body_no"), names)]
    if slack is not None:
        found.append(_named(places(slack).select("row_id", "body_no"), names).withColumnRenamed("item_ids", "near_ids"))
    out = tokens.select("row_id", "doc_id", F.size("words").cast("long").alias("n_words"))
    for part in found:
        out = out.join(_small(stage(part, "found")), "row_id", "left")
    none = F.expr("cast(array() as array<string>)")
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long")} | {c: F.coalesce(c, none) for c in out.columns if c.endswith("_ids")})


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    found = scan(docs, items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
