"""Word counts over text columns."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from tallymill.functions.text import words_of

# The worker function of this module travels with the task, so workers need not
# have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Transform = Callable[[DataFrame], DataFrame]


def tokenize(col: str) -> Transform:
    """DataFrame to one row per word."""

    def apply(df: DataFrame) -> DataFrame:
        return df.select(F.explode(words_of(F.col(col))).alias("word")).where("word <> ''")

    return apply


def count_by(key: str) -> Transform:
    """DataFrame to (key, n)."""

    def apply(df: DataFrame) -> DataFrame:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))

    return apply


def word_count(df: DataFrame, col: str) -> DataFrame:
    """(word, n). Each task counts its own rows before the shuffle, so a word
    that makes up much of the text costs one row per task."""
    return count_by("word")(tokenize(col)(df))


def combine_words(
    batches: Iterator[pa.RecordBatch], max_entries: int
) -> Iterator[pa.RecordBatch]:
    """Sum up one task's words, passing partial counts on when too many are held."""
    held: pa.Table | None = None
    for batch in batches:
        part = (
            pa.Table.from_batches([batch])
            .group_by("word")
            .aggregate([("word", "count", pa.compute.CountOptions(mode="all"))])
            .select(["word", "word_count"])
            .rename_columns(["word", "n"])
        )
        held = part if held is None else pa.concat_tables([held, part])
        if held.num_rows > max_entries:
            held = held.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            if held.num_rows > max_entries:
                yield from held.to_batches()
                held = None
    if held is not None:
        held = held.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
        yield from held.to_batches()


def precombine(df: DataFrame, max_entries: int) -> DataFrame:
    """Partial (word, n) rows of a DataFrame or stream of words, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return combine_words(batches, max_entries)

    return df.select("word").mapInArrow(run, "word string, n bigint")


def word_count_combined(df: DataFrame, col: str, max_entries: int = 50_000) -> DataFrame:
    """(word, n) with an explicit combine step of bounded size before the shuffle."""
    partial = precombine(tokenize(col)(df), max_entries)
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


# Windows whose rows one task makes at a time.
WINDOWS_PER_BLOCK = 100_000


def window_rows(spans: DataFrame, size: int) -> DataFrame:
    """(word, w, n): windows ``first`` to ``end`` - 1 of each row of ``spans``.

    Spans are cut into blocks and the blocks dealt out, so the windows of one
    frequent word are made by many tasks.
    """
    per_block = WINDOWS_PER_BLOCK
    low = F.greatest(F.col("first"), F.col("block") * per_block)
    high = F.least(F.col("end"), (F.col("block") + 1) * per_block)
    return (
        spans.where(F.col("end") > F.col("first"))
        .select(
            "word", "first", "end",
            F.explode(F.expr(f"sequence(first div {per_block}, (end - 1) div {per_block})")).alias("block"),
        )
        .repartition("word", "block")
        .select("word", F.explode(F.sequence(low, high - 1)).alias("w"))
        .select("word", "w", F.lit(size).cast("bigint").alias("n"))
    )


def count_windows(df: DataFrame, key: str, size: int = 10_000) -> DataFrame:
    """(word, w, n): tumbling windows of ``size`` occurrences of each key.

    Window ``w`` of a key is complete once (w + 1) * size occurrences exist; an
    incomplete last window is left out. Only the total per key decides this, so
    no rows are ordered or gathered per key.
    """
    totals = df.groupBy(F.col(key).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return window_rows(
        totals.select("word", F.lit(0).cast("bigint").alias("first"), F.expr(f"n div {size}").alias("end")), size
    )


def time_window_count(
    df: DataFrame, ts: str, key: str, width: str = "1 hour", delay: str | None = None
) -> DataFrame:
    """(window_start, word, n) in half-open tumbling windows of event time.

    The same expression serves tables and streams; a stream needs ``delay``, the
    time after which a window is taken as complete.
    """
    if delay is not None:
        df = df.withWatermark(ts, delay)
    return (
        df.groupBy(F.window(ts, width).alias("span"), F.col(key).alias("word"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("span.start").alias("window_start"), "word", "n")
    )


def normalize_words(df: DataFrame, col: str, sep: str = "/") -> DataFrame:
    """Distinct dictionary words: each entry up to its first ``sep``."""
    return df.select(F.substring_index(col, sep, 1).alias("word")).distinct()
