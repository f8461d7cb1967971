"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every rule bounds a ratio of two measured counts in percent; compared as whole numbers, so no rounding decides.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
RUN = 8

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "as", "was", "on", "are", "this", "be", "by", "from",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "dans", "pour", "par", "sur",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ein", "eine", "nicht", "ist", "auf", "sich",
    "el", "los", "las", "y", "por", "con", "para", "del", "se", "su", "una", "es",
)


class Rule(NamedTuple):
    """Holds if ``low`` <= 100 * part / whole <= ``high``; checked from ``from_words`` words on."""

    part: str
    whole: str
    low: int
    high: int
    from_words: int = 0


# Percent bounds.
RULES = (
    Rule("word_chars", "n_words", 200, 1500),
    Rule("n_symbols", "n_words", 0, 30),
    Rule("n_stop_words", "n_words", 2, 100, from_words=50),
    Rule("n_dup_lines", "n_lines", 0, 30),
    Rule("n_bullet_lines", "n_lines", 0, 90),
    Rule("n_ellipsis_lines", "n_lines", 0, 30),
)
BASE_RULES = (Rule("n_repeat_words", "n_words", 0, 30),)
MIN_WORDS = 20


def holds(rule: Rule) -> Column:
    part, whole = F.col(rule.part) * 100, F.col(rule.whole)
    ok = (part >= whole * rule.low) & (part <= whole * rule.high)
    return ok if not rule.from_words else ok | (F.col("n_words") < rule.from_words)


def compiled(rules: tuple[Rule, ...]) -> Column:
    return reduce(lambda a, b: a & b, map(holds, rules), F.lit(True))


def count_of(array: Column) -> Column:
    return F.size(array).cast("long")


def repeated_words(runs: Column, pairs: Column) -> Column:
    """Words inside runs that occur again in the text, from the rising (hash, place) pairs of all its runs."""
    same = lambda x, i, step: F.coalesce(x["h"] == F.get(pairs, i + step)["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(pairs, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))


def quality_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """One row per row of ``docs``: ``keep`` columns, the measured counts, ``base_failed`` and ``kept``.

    Null text has no words and so fails the base rules; so does any text under 20 words. Repeated runs of eight
    words are compared by a 64-bit hash within one text. Other columns are ignored, repeated rows are judged alike,
    an empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    flat = docs.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], body.alias("body"))
    cut = flat.withColumn("words", F.array_remove(F.split("body", SPLIT), "")).withColumn(
        "lines", F.filter(F.split("body", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    )
    counted = cut.select(
        "*",
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"),
        F.length(F.translate("body", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        count_of(F.col("words")).alias("n_words"),
        count_of(F.filter("words", lambda w: w.isin(*STOP_WORDS))).alias("n_stop_words"),
        count_of(F.col("lines")).alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        count_of(F.filter("lines", lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•"))).alias("n_bullet_lines"),
        count_of(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("n_ellipsis_lines"),
    ).drop("body", "words", "lines")
    none = F.array().cast("array<bigint>")
    run = lambda i: F.xxhash64(*[F.get(F.col("codes"), i + k) for k in range(RUN)])
    at = F.sequence(F.lit(0), F.size("codes") - RUN)
    runs = counted.withColumn("runs", F.when(F.size("codes") > RUN, F.transform(at, run)).otherwise(none)).drop("codes")
    again = F.size(F.array_distinct("runs")) < F.size("runs")
    no_pairs = F.array().cast("array<struct<h:bigint,i:int>>")
    pairs = runs.withColumn(
        "pairs", F.when(again, F.sort_array(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(no_pairs)
    )
    placed = pairs.withColumn("places", repeated_words(F.col("runs"), F.col("pairs"))).drop("runs", "pairs")
    width = F.transform("places", lambda p, i: F.least(F.lit(RUN), F.get(F.col("places"), i + 1) - p).cast("long"))
    measured = placed.withColumn("n_repeat_words", F.aggregate(width, F.lit(0).cast("long"), lambda a, b: a + b)).drop("places")
    base_failed = (F.col("n_words") < MIN_WORDS) | ~compiled(BASE_RULES)
    return measured.withColumn("base_failed", base_failed).select(
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines",
        "base_failed", (~F.col("base_failed") & compiled(rules)).alias("kept"),
    )
