"""Quality rules: one table of thresholds, compiled into one projection."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tallymill.llm.common import column, spaced_words, total


class Rule(NamedTuple):
    """A document passes while ``low`` <= ``measure`` <= ``high``."""

    name: str
    measure: str
    low: float | None
    high: float | None


# The usual function words of the languages served.
STOP_WORDS = {
    "en": "the of and to in a is that it for was on are with as be this by at from or an have not "
    "which he they but had we you all her she there been who will more if they their his",
    "fr": "le la les de des du et en un une que qui dans est pour au sur pas par ce il elle avec "
    "ne se son sont plus ou mais nous vous cette aux",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "es an werden aus er hat dass sie nach wird bei einer um am sind noch wie über",
    "es": "el la de que y a en un ser se no haber por con su para como estar lo todo pero más o "
    "este ese los las del una es al mi",
}

# The signs that count as symbols.
SYMBOLS = r"[#*$%&|<>]"

THRESHOLDS = (
    Rule("too_long", "n_words", None, 1_000_000),
    Rule("word_length", "try_divide(word_chars, n_words)", 2.0, 12.0),
    Rule("symbols", "try_divide(n_symbols, n_words)", None, 0.3),
    Rule("capitals", "try_divide(n_upper, word_chars)", None, 0.5),
    Rule("stop_words", "try_divide(n_stop, n_words)", 0.04, None),
    Rule("repeated_lines", "try_divide(n_dup_lines, n_lines)", None, 0.5),
)
# The part that no table can change: the least length and the most repetition.
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5


def stop_forms(stop_words: dict[str, str]) -> list[str]:
    """The words as listed and with a capital."""
    return sorted({f for w in " ".join(stop_words.values()).split() for f in (w, w.title())})


def compiled(rule: Rule) -> Column:
    """True where the rule holds; a measure without a value holds."""
    value = F.expr(rule.measure)
    bounds = [F.lit(True)]
    if rule.low is not None:
        bounds.append(value >= rule.low)
    if rule.high is not None:
        bounds.append(value <= rule.high)
    return F.coalesce(reduce(and_, bounds), F.lit(True))


def _window_hashes(hashes: Column) -> Column:
    """Of each five consecutive word hashes one hash: of pairs, of pairs of
    pairs, and of those with the fifth word."""
    n, both = F.size(hashes), lambda a, b: F.xxhash64(a, b)
    pairs = F.zip_with(hashes, F.slice(hashes, F.lit(2), n), both)
    fours = F.zip_with(pairs, F.slice(pairs, F.lit(3), n), both)
    return F.slice(F.zip_with(fours, F.slice(hashes, F.lit(5), n), both), F.lit(1), n - WINDOW + 1)


def _covered(starts: Column) -> Column:
    """Words under windows that begin at the sorted ``starts``."""
    return total(F.transform(
        starts,
        lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1), s + WINDOW) - s),
    ))


def quality_table(
    docs: DataFrame,
    text: str = "text",
    thresholds: tuple[Rule, ...] = THRESHOLDS,
    stop_words: dict[str, str] = STOP_WORDS,
) -> DataFrame:
    """Measures and verdict of each row, beside the row itself as struct ``row``.

    Counts, all of the whole text: ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_lines`` (with a word), ``n_dup_lines`` (equal to an earlier one),
    ``n_repeat_words`` (under a five-word window found twice or more),
    ``n_upper``, ``n_stop`` (bare stop words, small or with a capital). ``base_failed`` is the fixed part of the verdict,
    ``failed_rules`` names the thresholds that do not hold, ``kept`` is true where
    neither objects. There is no shuffle and no function outside Spark's own.

    A null or empty text has no words, so it fails the base. Repeated rows get
    equal results. Columns of ``docs`` are kept apart in ``row``, whatever their
    names; an empty table gives an empty one.
    """
    t = F.coalesce(column(text), F.lit(""))
    stops = stop_forms(stop_words)
    step = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), t.alias("t"))
    step = step.select(
        "row", "t", spaced_words(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    step = step.select(
        "row",
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        F.size("w").cast("bigint").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: x.isin(stops))).cast("bigint").alias("n_stop"),
    )
    counted = ("row", "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_stop")
    step = step.select(
        *counted,
        F.when(F.size("h") >= WINDOW, _window_hashes(F.col("h")))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("g"),
    )
    step = step.select(
        *counted,
        F.when(
            F.size(F.array_distinct("g")) < F.size("g"),
            F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("g"),
    )
    again = lambda x, i: F.coalesce(
        (x["h"] == F.get("g", i + 1)["h"]) | (x["h"] == F.get("g", i - 1)["h"]),
        x["h"] == F.get("g", i - 1)["h"],
        F.lit(False),
    )
    step = step.select(
        *counted, F.sort_array(F.transform(F.filter("g", again), lambda x: x["i"])).alias("s")
    )
    step = step.select(
        *counted, F.coalesce(_covered(F.col("s")), F.lit(0)).cast("bigint").alias("n_repeat_words")
    )
    base = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    failed = F.array_compact(F.array(*[F.when(~compiled(r), F.lit(r.name)) for r in thresholds]))
    step = step.select(*counted, "n_repeat_words", base.alias("base_failed"), failed.alias("failed_rules"))
    return step.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns they came with."""
    table = quality_table(docs, text, **options)
    # exploded, not filtered: a filter would be pushed below the projection and
    # work everything out once more
    kept = table.select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
