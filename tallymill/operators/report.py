"""Text reports of suite runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallymill.functions.ranking import range_positions
from tallymill.functions.timefmt import duration_text, start_text

SUITE = ""  # section of the suite run itself; sorts before any benchmark
NO_DATA = "no data"


def _timing(description: Column) -> Column:
    """Description, start and duration of one phase, and an empty line."""
    known = lambda text: F.coalesce(text, F.lit(NO_DATA))
    return F.concat(
        known(description), F.lit("\n"), known(start_text(F.col("start_time"))), F.lit("\n"),
        known(duration_text(F.col("duration"))), F.lit("\n\n"),
    )


def _joined(entries: str) -> Column:
    """The texts of (order, text) entries, in order."""
    texts = F.transform(F.array_sort(entries), lambda e: e["text"])
    return F.array_join(texts, "")


def _parts(timings: DataFrame, section: Column, order: list[str], number: str, per_part: int) -> DataFrame:
    """(suite_uid, section, part, report) from one row per timing. ``number``
    counts the timings of a section; ``per_part`` of them make a part."""
    entry = F.struct(*order, _timing(F.col("phase")).alias("text"))
    return (
        timings.groupBy("suite_uid", section.alias("section"),
                        F.floor(F.col(number) / per_part).cast("bigint").alias("part"))
        .agg(F.collect_list(entry).alias("entries"))
        .select("suite_uid", "section", "part", _joined("entries").alias("report"))
    )


def report(
    runs: DataFrame, run_phases: DataFrame, suite_phases: DataFrame | None = None, per_part: int = 10_000
) -> DataFrame:
    """(suite_uid, section, part, report).

    A suite run's report is its texts in order of section and part: a heading and
    its own phases, then for each benchmark a heading (part -1) and all phases of
    its runs. ``run_phases`` is (suite_uid, bench_id, run_id, seq, phase,
    start_time, duration), where ``seq`` orders the phases of a run, and
    ``suite_phases`` (suite_uid, seq, phase, start_time, duration), where it orders
    those of the suite run. Timings that are missing read "no data". Both are
    numbered within their section and cut after ``per_part`` timings, so no
    section's text is gathered as a whole.
    """

    def heading(section, text, *keys) -> DataFrame:
        named = runs.select("suite_uid", *keys).distinct()
        part = F.lit(-1).cast("bigint").alias("part")
        return named.select("suite_uid", section.alias("section"), part, text.alias("report"))

    numbered = range_positions(run_phases, ["run_id", "seq"], ["suite_uid", "bench_id"], "_n")
    texts = [
        heading(F.lit(SUITE), F.concat(F.lit("Cluster suite "), "suite_uid", F.lit("\n\n"))),
        heading(F.col("bench_id"), F.concat("bench_id", F.lit(":\n\n")), "bench_id"),
        _parts(numbered, F.col("bench_id"), ["run_id", "seq"], "_n", per_part),
    ]
    if suite_phases is not None:
        numbered = range_positions(suite_phases, ["seq"], ["suite_uid"], "_n")
        texts.append(_parts(numbered, F.lit(SUITE), ["seq"], "_n", per_part))
    return reduce(DataFrame.unionByName, texts)
