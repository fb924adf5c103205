"""Operator 10: quality rules as a short-circuit cascade.

Each rule is a Column that is true where a document fails. On a bounded sample every rule is evaluated alone; its
selectivity is the share it rejects and its cost the median time of its runs less that of an empty rule. Rules are
then ordered by rejection per cost (each one's selectivity taken on the documents that the rules before it let pass) and
become one ``CASE WHEN`` chain, of which Spark evaluates no condition behind the first that is true. The verdict does
not depend on the order; only the time does. The base measures are results, so they are computed for every row; the
cascade saves the rules behind them. Native: DataFrame functions only; the texts are read once for the verdicts and once
for the sample, and only the sample's texts move.

Defined cases: a null text has no words and fails the base rule; a very long text is judged whole, its windows sorted as
hashes within its row; an empty table yields no rows and keeps the rules in the order given; ties in rank keep that
order; repeated rows and repeated or null ids are judged alike, row by row; extra columns are carried through, and those
named like a result are replaced by it.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CLASS, BLANKS, let

SYMBOLS = "#*$%&|<>"
#: Rows of the sample (chosen by a hash of doc_id) and times each rule is run on it.
SAMPLE_ROWS, RUNS = 500, 2
#: Base rule.
LEAST_WORDS, REPEAT_PERCENT = 50, 50


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_CLASS + "+", -1), lambda w: w != "")


def duplicate_lines(text: Column) -> Column:
    """Lines that have a word and equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words in windows of ``width`` words that occur twice or more. The windows' hashes are sorted with their places; the
    places of windows with an equal neighbour, sorted again, cover up to ``width`` words each."""
    places = F.sequence(F.lit(0), F.size(words) - width)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, lambda x: _covered(x, width)))

    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(hashes, counted)).cast("bigint")


def _covered(placed: Column, width: int) -> Column:
    again = F.filter(placed, lambda x, k: F.coalesce(x["h"] == F.get(placed, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(placed, k + 1)["h"], F.lit(False)))
    start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"))
    # a window adds the words from the end of the one before it
    return F.aggregate(F.sort_array(F.transform(again, lambda x: x["i"])), start, step, lambda acc: acc["n"])


def with_measures(docs: DataFrame) -> DataFrame:
    """Adds the base measures n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.withColumn("__words", words_of(F.col("text")))
    counted = words.withColumns(
        {
            "n_words": F.size("__words").cast("bigint"),
            "word_chars": F.char_length(F.translate(text, BLANKS, "")).cast("bigint"),
            "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
            "n_dup_lines": duplicate_lines(F.col("text")),
            "n_repeat_words": repeated_words(F.col("__words")),
        }
    )
    return counted.drop("__words")


@dataclass(frozen=True)
class Rule:
    """``fails``: true where the document is to go."""

    name: str
    fails: Column


def default_rules() -> list[Rule]:
    """Rules after the base rule: junk symbols, odd word lengths, repeated lines, too few letters, shouting, broken text."""
    text, chars, words = F.col("text"), F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > words),
        Rule("word_length", (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 15 * words)),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.size(F.split(text, "\n", -1))),
        Rule("few_letters", 10 * F.char_length(F.regexp_replace(text, r"[\P{L}]+", "")) < 6 * chars),
        Rule("shouting", 2 * F.char_length(F.regexp_replace(text, r"[^!?]+", "")) > words),
        Rule("broken_text", 200 * F.regexp_count(text, F.lit("�|Ã.|â€")) > words),
    ]


def measured_order(sample: DataFrame, rules: Sequence[Rule], runs: int = RUNS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, selectivity) in order of rejection per cost on ``sample``, which should be cached."""
    spark = sample.sparkSession

    def seconds(column: Column) -> float:
        taken = []
        for _ in range(runs):
            began = time.perf_counter()
            sample.select(F.count_if(column)).collect()
            taken.append(time.perf_counter() - began)
        return min(taken)

    spark.sparkContext.setJobDescription("quality rules: costs on a sample")
    empty = seconds(F.lit(False))
    cost = {r.name: max(seconds(r.fails) - empty, 1e-4) for r in rules}
    left, order = list(rules), []
    passed = F.lit(True)
    while left:
        counts = sample.filter(passed).agg(F.count("*").alias("n"), *[F.count_if(r.fails).alias(r.name) for r in left]).first()
        share = {r.name: counts[r.name] / max(counts["n"], 1) for r in left}
        best = max(left, key=lambda r: share[r.name] / cost[r.name])
        order.append((best, cost[best.name], share[best.name]))
        left.remove(best)
        passed &= ~F.coalesce(best.fails, F.lit(True))
    spark.sparkContext.setJobDescription(None)
    return order


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the base measures, base_failed, failed_rule (the first of the cascade, null if none) and kept."""
    rules = default_rules() if rules is None else rules
    # the hashes of ids are cut first, so that no text is sorted or moved but those of the sample
    place = F.xxhash64("doc_id")
    cut = docs.select(place.alias("h")).orderBy("h").limit(sample_rows).agg(F.max("h").alias("h")).first()["h"]
    sample = docs.filter(place <= F.lit(cut)).limit(sample_rows)  # a repeated id brings no more rows than that
    held = with_measures(sample).cache()
    order = [r for r, _, _ in measured_order(held, rules)]
    held.unpersist()
    measured = with_measures(docs)
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    chain = F.when(F.col("base_failed"), F.lit("base"))
    for rule in order:
        chain = chain.when(F.coalesce(rule.fails, F.lit(True)), F.lit(rule.name))
    return measured.withColumn("base_failed", base).withColumn("failed_rule", chain).withColumn("kept", F.col("failed_rule").isNull())
