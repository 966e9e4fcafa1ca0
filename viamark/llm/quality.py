"""Quality rules with risk-controlled cutoffs (DataFrame functions only).

Each rule measures one share of a text; ``LADDER`` is a fixed, nested family of cutoffs
for all rules together, from the level that rejects least to the strictest. At most
``max_false`` of the good texts of a stratum (language) that pass the base rule may be
rejected, by any of the rules. For every stratum the evidence at a level is an exact one-sided
binomial (Clopper-Pearson) test on labelled good texts: with ``k`` of ``n`` rejected there, the level
is certified when P(Bin(n, max_false) <= k) <= alpha / strata. Levels are tested from the
mildest on until the first that fails (fixed sequence), which needs no division by the
number of rules or levels; strata share alpha (Bonferroni). The strictest certified level
is used; without one the rules reject nothing in that stratum. Nothing is fitted, so every
labelled text serves as holdout. Copies are one trial: texts that are identical after
deleting white space count once in a stratum, with the greatest share of each rule.

Defined cases: a null text has no words, so the base rule rejects it; labels with a null
id or a quality other than 1 are no evidence, and repeated labels count once; a null or
unlisted language belongs to the stratum ``other``; without labels only the base rule acts;
repeated rows are judged alike and all kept or all rejected; an empty table gives no rows;
further columns of any name are ignored, or carried by :func:`keep_good`; a text of any
length is measured whole.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viamark.llm.common import BLANKS, stage, stored_bytes, text_of, with_row_id, without_blanks

SYMBOLS = "#*$%&|<>"
STRATA = ("en", "de", "fr", "es")
MAX_FALSE = 0.01
ALPHA = 0.05
#: Stored size up to which the ids of labelled good texts are broadcast.
BROADCAST_BYTES = 16 << 20
#: Cutoffs, one for each level and the same for every rule; a text above the one of the chosen level is rejected.
LADDER = (0.6, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02, 0.01, 0.005)
RULES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
}


def _count_of(chars: str) -> Column:
    return (F.length("t_") - F.length(F.translate("t_", chars, ""))).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of its texts, in one pass and without a shuffle.

    Five-word windows are compared by hash; only texts in which two hashes agree are
    looked at again, by the words themselves.
    """
    blank = F.translate("t_", BLANKS[1:], " " * (len(BLANKS) - 1))
    d = docs.withColumn("t_", text_of())
    d = d.withColumns({"w_": F.array_remove(F.split(blank, " "), ""), "l_": F.filter(F.split("t_", "\n"), lambda x: F.length(without_blanks(x)) > 0)})
    d = d.withColumn("n_words", F.size("w_").cast("long"))
    d = d.withColumn("h_", F.expr("if(n_words < 6, cast(array() as array<bigint>), transform(sequence(1, cast(n_words as int) - 4), i -> xxhash64(slice(w_, i, 5))))"))
    again = "size(array_distinct(h_)) < size(h_)"
    d = d.withColumn("g_", F.expr(f"if({again}, sort_array(transform(sequence(1, cast(n_words as int) - 4), i -> struct(concat_ws(' ', slice(w_, i, 5)) as g, i as i))), null)"))
    d = d.withColumn("p_", F.expr("if(g_ is null, null, sort_array(transform(filter(g_, (x, k) -> x.g = get(g_, k - 1).g or x.g = get(g_, k + 1).g), x -> x.i)))"))
    covered = "coalesce(aggregate(p_, struct(-5 as at, 0L as n), (a, p) -> struct(p as at, a.n + least(5, p - a.at) as n), a -> a.n), 0L)"
    return d.withColumns({
        "word_chars": F.length(without_blanks(F.col("t_"))).cast("long"),
        "n_symbols": _count_of(SYMBOLS),
        "n_upper": _count_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_digits": _count_of("0123456789"),
        "n_lines": F.size("l_").cast("long"),
        "n_dup_lines": (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long"),
        "n_repeat_words": F.expr(covered),
    }).withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")).drop("t_", "w_", "l_", "h_", "g_", "p_")


def _log_tail(share: float) -> Column:
    """ln P(Bin(n_, share) <= k_), by adding up logarithms of the terms 0 to k_; null above the expected count."""
    odds, none = f"ln({share}D) - ln(1 - {share}D)", f"n_ * ln(1 - {share}D)"
    log_sum = (
        "aggregate(sequence(1, cast(greatest(k_, 1) as int)), struct({none} as t, {none} as s),"
        " (a, j) -> if(j > k_, a, struct(a.t + ln(n_ - j + 1) - ln(j) + {odds} as t,"
        " greatest(a.s, a.t + ln(n_ - j + 1) - ln(j) + {odds})"
        " + ln(1 + exp(-abs(a.s - (a.t + ln(n_ - j + 1) - ln(j) + {odds})))) as s)), a -> a.s)"
    ).format(none=none, odds=odds)
    return F.expr(f"if(n_ = 0 or k_ > {share}D * n_, null, {log_sum})")


def stratum(lang: str = "lang") -> Column:
    return F.when(F.col(lang).isin(*STRATA), F.col(lang)).otherwise("other")


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the texts that every label with a quality calls good."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q_"))
    return good.where("q_ = 1").select("doc_id")


def digest() -> Column:
    return F.unhex(F.sha2(without_blanks(text_of()).cast("binary"), 256))


def each_once(held: DataFrame) -> DataFrame:
    """The holdout with one row for each stratum and ``digest_``: the greatest share of each rule."""
    return held.groupBy("stratum", "digest_").agg(*[F.max(r).alias(r) for r in RULES])


def choose_levels(held: DataFrame, max_false: float = MAX_FALSE, alpha: float = ALPHA) -> DataFrame:
    """stratum, level, cutoff, n_good, n_lost, log_p: the strictest certified level, at most one row a stratum.

    held: the holdout, labelled good; stratum and one column for each rule.
    """
    # A text is rejected at the first level whose cutoff its worst share exceeds, and at all stricter ones.
    spared = reduce(lambda a, b: a + b, [F.when(F.greatest(*RULES) <= c, 1).otherwise(0) for c in LADDER])
    counts = held.groupBy("stratum", spared.alias("spared")).agg(F.count(F.lit(1)).alias("m_"))
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(c).alias("cutoff")) for i, c in enumerate(LADDER)]))
    tested = (
        counts.withColumn("at", step)
        .groupBy("stratum", "at.level", "at.cutoff")
        .agg(F.sum("m_").cast("double").alias("n_"), F.sum(F.when(F.col("spared") <= F.col("at.level"), F.col("m_")).otherwise(0)).cast("double").alias("k_"))
        .withColumn("log_p", _log_tail(max_false))
    )
    # The families are nested, so no level after the first failure passes.
    passed = tested.where(F.col("log_p") <= math.log(alpha / (len(STRATA) + 1)))
    best = passed.groupBy("stratum").agg(F.max_by(F.struct("level", "cutoff", F.col("n_").cast("long").alias("n_good"), F.col("k_").cast("long").alias("n_lost"), "log_p"), "level").alias("b"))
    return best.select("stratum", "b.*")


def judge(docs: DataFrame, labels: DataFrame, max_false: float = MAX_FALSE, alpha: float = ALPHA) -> DataFrame:
    """Measured rows with stratum, one share for each rule, ``cutoff`` of the stratum, ``failed_rules`` and ``kept``.

    docs: doc_id, text, lang. The text itself is not carried on.
    """
    slim = stage(with_row_id(measure(docs.select("doc_id", "text", "lang").withColumn("digest_", digest())).drop("text")), "measured")
    shares = slim.withColumns({r: F.expr(e) for r, e in RULES.items()} | {"stratum": stratum()})
    held = shares.where(~F.col("base_failed")).join(good_ids(labels).hint("merge"), "doc_id", "left_semi")
    chosen = choose_levels(each_once(held), max_false, alpha).select("stratum", "cutoff")
    failed = F.filter(F.array(*[F.when(F.col(r) > F.col("cutoff"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    # As many rows as strata, which are listed in STRATA.
    out = shares.drop("digest_").join(F.broadcast(chosen), "stratum", "left").withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, max_false: float = MAX_FALSE, alpha: float = ALPHA) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Holdout texts are measured once to choose the level, all texts once to apply it.
    Ids of labelled good texts are broadcast when their stored size is small; only where
    it is not are texts shuffled to them.
    """
    shares = {r: F.expr(e) for r, e in RULES.items()} | {"stratum": stratum()}
    good = stage(good_ids(labels), "good")
    hint = "broadcast" if stored_bytes(good) <= BROADCAST_BYTES else "merge"
    held = docs.select("doc_id", "text", "lang").join(good.hint(hint), "doc_id", "left_semi")
    # A filter that needs the row number is not moved below it: the optimizer would copy the measures into it.
    measured = with_row_id(measure(held.withColumn("digest_", digest()))).drop("text").withColumns(shares).where((F.col("row_id") >= 0) & ~F.col("base_failed"))
    chosen = stage(choose_levels(each_once(measured), max_false, alpha), "levels").collect()  # at most one row for each stratum
    found = with_row_id(measure(docs.select(F.struct("*").alias("doc_"), "text", "lang"))).withColumns(shares)
    failed = [(F.col("stratum") == c.stratum) & (F.greatest(*RULES) > c.cutoff) for c in chosen]
    return found.where((F.col("row_id") >= 0) & ~reduce(lambda a, b: a | b, failed, F.col("base_failed"))).select("doc_.*")
