"""Quality rules in a short-circuit cascade, in DataFrame functions alone.

A rule is a measure with a rejecting condition. ``order_rules`` times each rule on a bounded sample
(seconds over the sample) and counts what it rejects there; ``cascade`` then evaluates the rules by
rejections per cost, and a document that a rule rejects skips the later ones (``CASE WHEN``), with whatever
they would measure. MEASURES are reported for every document, so they are measured for all; a rule on
these alone costs a comparison and comes early. The order changes only the cost: a document is kept
exactly when no rule rejects it.

All measures are per-row expressions over the whole text: one map over the scan, no shuffle.

Defined cases: a null text counts as empty (no words, all measures zero, base_failed); very long
texts are measured whole; repeated rows are measured row by row; an empty table gives no rows; other
columns are carried through untouched unless they bear an output's name, in which case the output wins.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII blanks.
BLANKS = "[\\x20\\x09-\\x0D]+"
#: A blank-free character.
NOT_BLANK = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: Rows that costs and selectivities are estimated on.
SAMPLE_ROWS = 512
#: How often each of them is measured.
REPEAT = 20


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_BLANK))


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a pattern's class a text holds."""
    return (F.length(text) - F.length(F.regexp_replace(text, characters, ""))).cast("long")


def window_hashes(w: Column) -> Column:
    """A 64-bit hash for each window of five words; none with fewer words."""
    at = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))
    return F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))


def covered_words(places: Column) -> Column:
    """Words inside the windows that start at the sorted ``places``."""
    none = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(WINDOW), p - a.last)).cast("long").alias("n"))
    return F.aggregate(places, none, step, lambda a: a.n)


#: What a rule may refer to, besides ``text``: columns that ``measure`` adds.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds MEASURES. Each select names once what the next one uses several times, so that Spark
    evaluates it once."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in {*MEASURES, "_t", "_w", "_l", "_h", "_p"}]
    t = docs.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    w = t.select("*", words(F.col("_t")).alias("_w"), lines(F.col("_t")).alias("_l"))
    h = w.select("*", window_hashes(F.col("_w")).alias("_h"))
    # texts without an equal pair of windows, most of them, don't pay for the places
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    pairs = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    p = h.select("*", F.when(twice, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_p"))
    places = F.sort_array(F.transform(F.filter("_p", lambda x, k: F.coalesce(x.h == F.get("_p", k - 1).h, F.lit(False)) | F.coalesce(x.h == F.get("_p", k + 1).h, F.lit(False))), lambda x: x.i))
    found = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        count_of(F.col("_t"), SYMBOLS).alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered_words(places).alias("n_repeat_words"),
    )
    # one row out of one: but a filter on a measure stays above it, and isn't worked out in the measure's place,
    # where it would be evaluated for every element of the lambdas
    return p.select(*kept, F.col("_t"), F.inline_outer(F.array(found)))


@dataclass(frozen=True)
class Rule:
    """``rejects(text)`` is true where the rule rejects; it may also refer to MEASURES."""

    name: str
    rejects: Callable[[Column], Column]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


RULES = [
    Rule("symbols", lambda t: 100 * F.col("n_symbols") > 4 * F.col("word_chars")),
    Rule("repeated_lines", lambda t: 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
    Rule("word_length", lambda t: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
    Rule("capitals", lambda t: 100 * count_of(t, "[A-Z]") > 40 * F.col("word_chars")),
    Rule("marks", lambda t: 100 * count_of(t, "[!?]") > 10 * F.col("word_chars")),
]


def _seconds(rows: DataFrame, *measures: Column) -> float:
    """The least time of three runs of an aggregation."""
    out = []
    for _ in range(3):
        began = time.perf_counter()
        rows.agg(F.count(F.lit(1)), *measures).collect()
        out.append(time.perf_counter() - began)
    return min(out)


def order_rules(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost on a random sample of the documents that the base lets through;
    rules that reject nothing there come last, the cheapest first. The sample is bounded and only the order
    depends on it. A rule's cost is its time over the sample, repeated ``REPEAT`` times, beyond that of a
    mere count."""
    share = min(1.0, 2 * sample_rows / max(1, docs.count()))
    drawn = measure(docs.where(F.rand(7) < share).limit(sample_rows), text).select(*MEASURES, "_t").repartition(1).cache()
    try:
        sample = drawn.where(~base_failed())
        n = max(1, sample.count())
        rejected = sample.agg(*(F.count_if(rule.rejects(F.col("_t"))).alias(f"r{k}") for k, rule in enumerate(rules))).head()
        often = sample.select(*MEASURES, "_t", F.explode(F.sequence(F.lit(1), F.lit(REPEAT))).alias("again"))
        base, rated = _seconds(often), []
        for k, rule in enumerate(rules):
            cost = max(1e-6, _seconds(often, F.count_if(rule.rejects(F.col("_t")))) - base)
            rated.append((-rejected[k] / n / cost, cost if not rejected[k] else 0.0, k))
        return [rules[k] for *_, k in sorted(rated)]
    finally:
        drawn.unpersist()


def cascade(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with MEASURES, ``base_failed``, ``kept`` and ``rejected_by`` (the first rule of the
    cascade that rejects; which one of several depends on their order, ``kept`` does not)."""
    measured = measure(docs, text)
    verdict = F.when(base_failed(), F.lit("base"))
    for rule in order_rules(docs, text, rules, sample_rows):
        verdict = verdict.when(rule.rejects(F.col("_t")), F.lit(rule.name))
    out = measured.withColumn("base_failed", base_failed()).withColumn("rejected_by", verdict)
    return out.withColumn("kept", F.col("rejected_by").isNull()).drop("_t")
