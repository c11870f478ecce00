"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule's cost and share of rejected rows are estimated on a bounded sample;
rules then run in the order of rejections per second, and a row leaves the
cascade at the first rule that rejects it. The order changes the cost, never the
verdict: a row is kept when no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftframe.llm.common import WORD_GAPS

WINDOW = 8
# Fixed values of the base rules.
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
# rows of the sample that orders the rules
SAMPLE_ROWS = 500


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over ``text``, ``words`` (array) and ``n_words``; null is no rejection."""

    name: str
    rejects: Column


def _count_of(chars: str) -> Column:
    return F.length("text") - F.length(F.translate("text", chars, ""))


def _word_chars() -> Column:
    return F.length(F.translate("text", " \t\n\x0b\x0c\r", ""))


def _lines() -> Column:
    return F.filter(F.split("text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))


def default_rules() -> list[Rule]:
    """Rules that well-formed prose of any language passes by a wide margin."""
    n = F.col("n_words")
    return [
        Rule("symbols", _count_of("#*$%&|<>") * 4 > n),
        Rule("word_length", (_word_chars() < 2 * n) | (_word_chars() > 14 * n)),
        Rule("letters", F.size(F.filter("words", lambda w: w.rlike("\\p{L}"))) * 10 < n * 6),
        Rule("repeated_lines", F.size(_lines()) > 2 * F.size(F.array_distinct(_lines()))),
        Rule("few_distinct_words", F.size(F.array_distinct("words")) * 50 < n),
    ]


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``words`` and ``n_words``; the text, null as empty, becomes ``text``."""
    known = docs.withColumn("text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    known = known.withColumn("words", F.array_remove(F.split("text", WORD_GAPS), ""))
    return known.withColumn("n_words", F.size("words").cast("long"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: as the only element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in an array of words.

    Windows are compared by 64-bit hashes, built from word hashes in three
    doublings; only where some window repeats are the windows sorted. One expression,
    so a filter on it that moves towards the scan does not repeat its parts.
    """

    def doubled(hashes: Column, size: int) -> Column:
        return F.zip_with(
            F.slice(hashes, F.lit(1), F.size(hashes) - size),
            F.slice(hashes, F.lit(size + 1), F.size(hashes) - size),
            lambda a, b: F.xxhash64(a, b),
        )

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
            again = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def total(at: Column) -> Column:
            first, later = F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1)
            gaps = F.zip_with(first, later, lambda a, b: F.least(b - a, F.lit(WINDOW)))
            return F.aggregate(gaps, F.lit(WINDOW), lambda sum_, gap: sum_ + gap)

        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(_let(pairs, places), total)).otherwise(0)

    by_two = lambda h: _let(doubled(h, 1), lambda h2: _let(doubled(h2, 2), lambda h4: _let(doubled(h4, 4), covered)))
    found = _let(F.transform(words, lambda w: F.xxhash64(w)), by_two)
    return F.when(F.size(words) > WINDOW, found).otherwise(0).cast("long")


def with_measures(worded: DataFrame) -> DataFrame:
    """Adds ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words``."""
    df = worded.withColumn("word_chars", _word_chars().cast("long"))
    df = df.withColumn("n_symbols", _count_of("#*$%&|<>").cast("long"))
    df = df.withColumn("_lines", _lines())
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    return df.drop("_lines").withColumn("n_repeat_words", repeat_words(F.col("words")))


def base_failed() -> Column:
    """Too few words, or too many of them repeated; over ``n_words`` and ``n_repeat_words``."""
    n = F.col("n_words")
    return (n < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * n)


def order_rules(worded: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejected share per second, measured on ``sample_rows`` rows at most.

    The time of an idle pass over the same rows is taken off, so what is compared
    is the rule's own cost. Ties and an empty table keep the given order.
    """
    # take() reads no more partitions than it needs and shuffles nothing
    picked = worded.select("text", "words", "n_words").take(sample_rows)
    sample = worded.sparkSession.createDataFrame(picked, worded.select("text", "words", "n_words").schema).persist()
    try:
        rows = sample.count()

        def timed(column: Column) -> tuple[float, int]:
            best, hits = float("inf"), 0
            for _ in range(2):
                began = time.perf_counter()
                hits = sample.agg(F.count_if(column)).first()[0]
                best = min(best, time.perf_counter() - began)
            return best, hits

        if not rows:
            return list(rules)
        idle, _ = timed(F.col("n_words") < 0)
        worth = {}
        for rule in rules:
            seconds, hits = timed(rule.rejects)
            worth[rule.name] = (hits / rows) / max(seconds - idle, 1e-3)
        return sorted(rules, key=lambda r: -worth[r.name])
    finally:
        sample.unpersist()


def passes(rules: Sequence[Rule]) -> Column:
    """True where no rule rejects; the rules run in this order and stop at the first rejection."""
    if not rules:
        return F.lit(True)
    verdict = None
    for rule in rules:
        verdict = F.when(rule.rejects, F.lit(False)) if verdict is None else verdict.when(rule.rejects, F.lit(False))
    return verdict.otherwise(F.lit(True))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per document: its measures, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rules. Rows repeat as
    given, null keys included; no other column is read. An empty table gives none.
    """
    worded = with_words(docs.select(F.col(key).alias("_key"), F.col(text).alias("text")))
    ordered = order_rules(worded, rules if rules is not None else default_rules())
    judged = with_measures(worded).withColumn("base_failed", base_failed())
    judged = judged.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(passes(ordered)))
    return judged.select(
        F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that pass the cascade, base rules last as they cost most; columns as given.

    The rules' own working columns carry a prefix, so tables may have columns
    named like them.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.col(text).cast("string").alias("text"))
    worded = with_words(packed)
    base = [Rule("few_words", F.col("n_words") < LEAST_WORDS)]
    ordered = order_rules(worded, [*base, *(rules if rules is not None else default_rules())])
    judged = worded.withColumn("n_repeat_words", F.when(passes(ordered), repeat_words(F.col("words"))))
    left = judged.where(~base_failed())
    return left.select(*[F.col("_row").getField(n).alias(n) for n in names])
