"""Quality rules combined by weak supervision, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from riskweir.llm.common import WHITE, saved

SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[^\p{L}\p{N}\s]"
PLAIN_WORD = r"(?<!\S)\p{L}+[.,;:!?]?(?!\S)"


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of each whole text: word_chars, n_words, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_upper, n_lower, n_distinct, n_marks (neither letters, digits nor space), n_plain (words of letters, with one closing mark at most).

    Words lie between ASCII white space. Repeated words are those in three-word windows found twice or more in the text, the first one included: the
    hashes of all windows are sorted with their places only where one of them repeats, and each repeated place covers up to three words.
    Everything runs within the row; nothing is shuffled. A null text counts as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*keep, text.alias("t"))
    words = F.array_remove(F.split(F.col("t"), WHITE + "+"), "")
    base = base.withColumn("w", words).withColumn("n_words", F.size("w").cast("long"))
    gram = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n_words") - 2, F.lit(1)).cast("int")), lambda i: F.xxhash64(F.try_element_at("w", i), F.try_element_at("w", i + 1), F.try_element_at("w", i + 2)))
    lines = F.filter(F.split(F.col("t"), "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    base = base.withColumn("g", F.when(F.col("n_words") >= 3, gram).otherwise(F.array().cast("array<bigint>"))).withColumn("l", lines)
    base = base.withColumn("repeats", F.size(F.array_distinct("g")) < F.size("g"))
    sorted_grams = F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("s", F.when(F.col("repeats"), sorted_grams))
    place = F.filter("s", lambda x, k: (x["h"] == F.get("s", k - 1)["h"]) | (x["h"] == F.get("s", k + 1)["h"]))
    base = base.withColumn("p", F.when(F.col("repeats"), F.sort_array(F.transform(place, lambda x: x["i"]))))
    covered = F.aggregate("p", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(3))).alias("n"), i.alias("last")))["n"]
    plain = F.array_join("w", "")
    return base.select(
        *keep, F.length(plain).cast("long").alias("word_chars"), "n_words",
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("repeats"), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count("t", F.lit(r"[A-Z]")).cast("long").alias("n_upper"), F.regexp_count("t", F.lit(r"[a-z]")).cast("long").alias("n_lower"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.regexp_count("t", F.lit(MARKS)).cast("long").alias("n_marks"), F.regexp_count("t", F.lit(PLAIN_WORD)).cast("long").alias("n_plain"),
    )


def votes() -> dict[str, Column]:
    """Rules over :func:`features`: 1 votes for quality, -1 against it, 0 abstains. Each has a range in which it doesn't know.

    Rules overlap on purpose: the model learns what a vote is worth from how votes agree.
    """
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")

    def rule(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    symbols, repeats = F.col("n_symbols") / n, F.col("n_repeat_words") / n
    mean, lines = F.col("word_chars") / n, F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    letters = F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)).cast("double")
    distinct, marks = F.col("n_distinct") / n, F.col("n_marks") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "symbols": rule(symbols < 0.05, symbols > 0.2),
        "repeats": rule(repeats < 0.15, repeats > 0.4),
        "lines": rule((F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1), (F.col("n_dup_lines") > 1) & (F.col("n_dup_lines") / lines > 0.3)),
        "marks": rule(marks < 0.06, marks > 0.12),
        "plain_words": rule(F.col("n_plain") / n > 0.8, F.col("n_plain") / n < 0.5),
        "word_length": rule((mean >= 3.5) & (mean <= 8.5), (mean < 2.5) | (mean > 12)),
        "case": rule(F.col("n_upper") / letters < 0.2, F.col("n_upper") / letters > 0.5),
        "variety": rule((distinct > 0.35) | (F.col("n_words") > 1000) & (distinct > 0.2), distinct < 0.12),
    }


#: Assumed at the start: how often a rule votes for, against or not at all, on good and on bad text. A vote against is rare on good text, and
#: one kind of bad text sets off few rules.
ASSUMED = {+1: {1: 0.80, -1: 0.01, 0: 0.19}, -1: {1: 0.55, -1: 0.30, 0: 0.15}}


def fit(patterns: DataFrame, rules: list[str], rounds: int = 12, prior: float = 0.7, smoothing: float = 10.0, change: float = 1e-4) -> tuple[float, dict[str, dict[int, float]]]:
    """P(quality) and, per rule and vote, the log odds that the vote gives, from counts of vote patterns.

    Expectation-maximisation of a model in which rules vote independently given the class: the expected class of each pattern and the
    rates of votes in both classes are found in turn. Each round is one aggregation over at most 3^rules rows, whatever
    the corpus, and returns one row per rule and vote. Pseudo-votes as assumed at the start keep the classes from trading
    places and rates off 0 and 1. It ends when the share of good text moves by less than ``change``, or after ``rounds``.
    """
    rate, share, before = {r: ASSUMED for r in rules}, prior, 2.0
    for _ in range(rounds):
        odds = {r: {v: math.log(rate[r][1][v] / rate[r][-1][v]) for v in (1, 0, -1)} for r in rules}
        if abs(share - before) < change:
            break
        before = share
        each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("vote")) for r in rules)))
        sums = patterns.withColumn("good", F.col("n") * posterior(share, odds)).select("n", "good", each.alias("v"))
        rows = sums.groupBy("v").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect()
        seen = {(x["v"]["rule"], x["v"]["vote"]): (x["n"], x["good"]) for x in rows}
        if not seen:
            break
        every = sum(seen.get((rules[0], v), (0, 0))[0] for v in (1, 0, -1))
        good = sum(seen.get((rules[0], v), (0, 0.0))[1] for v in (1, 0, -1))
        share = (good + smoothing * prior) / (every + smoothing)
        rate = {r: {
            +1: {v: (seen.get((r, v), (0, 0.0))[1] + smoothing * ASSUMED[1][v]) / (good + smoothing) for v in (1, 0, -1)},
            -1: {v: (seen.get((r, v), (0, 0.0))[0] - seen.get((r, v), (0, 0.0))[1] + smoothing * ASSUMED[-1][v]) / (every - good + smoothing) for v in (1, 0, -1)},
        } for r in rules}
    return share, {r: {v: math.log(rate[r][1][v] / rate[r][-1][v]) for v in (1, 0, -1)} for r in rules}


def posterior(share: float, odds: Mapping[str, Mapping[int, float]]) -> Column:
    """P(quality | votes) as an expression over the vote columns."""
    total = F.lit(math.log(share / (1 - share)))
    for name, by_vote in odds.items():
        vote = F.col(name)
        total = total + F.when(vote == 1, by_vote[1]).when(vote == -1, by_vote[-1]).otherwise(by_vote[0])
    return 1 / (1 + F.exp(-total))


def judge(docs: DataFrame, threshold: float = 0.5, min_words: int = 50, max_repeat: int = 50, **settings) -> DataFrame:
    """(doc_id, counts..., votes as vote_<rule>, base_failed, quality, kept) of every row.

    ``base_failed``: fewer than ``min_words`` words, or repeated words above ``max_repeat`` percent. Other rows are kept if the posterior quality
    probability of their votes reaches ``threshold``. Texts are read once: their counts are stored, vote patterns are counted over
    all documents that the model decides on, and the fitted odds apply as a column expression. Null and empty texts fail. Other columns are ignored.
    """
    rules = votes()
    voted = saved(features(docs).withColumns({f"vote_{r}": v for r, v in rules.items()}), "quality")
    names = [f"vote_{r}" for r in rules]
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    patterns = saved(voted.filter(~failed).groupBy(*names).agg(F.count("*").alias("n")), "quality-patterns")
    share, odds = fit(patterns, names, **settings)
    out = voted.withColumn("base_failed", failed).withColumn("quality", posterior(share, odds))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
