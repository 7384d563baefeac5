"""Analytics over the table of benchmark runs.

A run is (run_id, suite_id, suite_uid, bench_id, start_time, duration, failed).
``failed`` is 1 or 0 as stored; -1 stands for "no data" in a filled grid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymill.functions.ranking import number_within, range_positions
from tallymill.functions.timefmt import day_text, duration_text, start_text, suite_epoch
from tallymill.sources.scratch import materialize

LATEST = 15  # suite runs shown in a chart


def runs_of(
    df: DataFrame, suite_uid: str, bench_id: str, suite_id: str | None = None
) -> DataFrame:
    """Duration and outcome of each run of one benchmark in one suite run."""
    chosen = df.where((F.col("suite_uid") == suite_uid) & (F.col("bench_id") == bench_id))
    if suite_id is not None:
        chosen = chosen.where(F.col("suite_id") == suite_id)
    return chosen.select("run_id", "duration", "failed")


def count_violations(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Benchmarks whose number of stored runs is not the requested one.

    ``expected`` is (suite_uid, suite_id, bench_id, times). A benchmark that is
    missing on either side counts as 0 there.
    """
    keys = ["suite_uid", "suite_id", "bench_id"]
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return (
        found.join(expected, keys, "full_outer")
        .select(
            *keys,
            F.coalesce(F.col("times").cast("bigint"), F.lit(0)).alias("times"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
        .where("n <> times")
    )


def benchmarks_of(df: DataFrame, suite_id: str) -> DataFrame:
    """Distinct benchmarks of a suite, in ascending order."""
    return _benchmarks(df, suite_id).orderBy("bench_id")


def _benchmarks(df: DataFrame, suite_id: str) -> DataFrame:
    return df.where(F.col("suite_id") == suite_id).select("bench_id").distinct()


def _newest(df: DataFrame, suite_id: str, n: int) -> DataFrame:
    return (
        df.where(F.col("suite_id") == suite_id)
        .select("suite_uid")
        .distinct()
        .orderBy(F.desc("suite_uid"))
        .limit(n)
    )


def latest_runs(df: DataFrame, suite_id: str, n: int = LATEST) -> DataFrame:
    """The newest ``n`` suite runs of a suite, oldest of them first."""
    return _newest(df, suite_id, n).orderBy("suite_uid")


def latest_runs_per_suite(df: DataFrame, n: int = LATEST) -> DataFrame:
    """The newest ``n`` suite runs of every suite."""
    newest = Window.partitionBy("suite_id").orderBy(F.desc("suite_uid"))
    return (
        df.select("suite_id", "suite_uid")
        .distinct()
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= n)
        .drop("_rank")
    )


def suite_grid(df: DataFrame, suite_id: str, n: int = LATEST) -> DataFrame:
    """Every run of the newest ``n`` suite runs, and one row (0, -1) for each
    suite run and benchmark of the suite that has none.

    Runs are only filtered, never joined: a cell with most of the rows stays
    spread out. Newest runs, benchmarks and taken cells all come from the distinct
    cells, which are found once.
    """
    runs = df.where(F.col("suite_id") == suite_id)
    cells = materialize(runs.select("suite_uid", "bench_id").distinct(), "cells")
    newest = cells.select("suite_uid").distinct().orderBy(F.desc("suite_uid")).limit(n)
    uids = newest.agg(F.collect_list("suite_uid")).scalar()  # n values at most
    recent = runs.where(F.array_contains(uids, F.col("suite_uid")))
    grid = cells.select("bench_id").distinct().select("bench_id", F.explode(uids).alias("suite_uid"))
    gaps = grid.join(cells, ["bench_id", "suite_uid"], "left_anti")
    return recent.select(
        "suite_uid",
        "bench_id",
        "run_id",
        F.coalesce("duration", F.lit(0.0)).alias("duration"),
        "failed",
    ).unionByName(
        gaps.select(
            "suite_uid",
            "bench_id",
            F.lit(None).cast("bigint").alias("run_id"),
            F.lit(0.0).alias("duration"),
            F.lit(-1).alias("failed"),
        )
    )


def with_status(df: DataFrame) -> DataFrame:
    """Add ``status``, and ``run_minutes`` for runs that did not fail."""
    failed = F.col("failed")
    return df.withColumn(
        "status",
        F.when(failed == 1, "failed").when(failed == -1, "no data").otherwise("ok"),
    ).withColumn("run_minutes", F.when(failed == 0, F.col("duration") / 60))


def with_slots(df: DataFrame, step: float = 2.0, space: float = 1.5) -> DataFrame:
    """Add the bar layout: ``x`` of the suite run, ``width`` and ``pos`` of the run.

    Suite runs stand ``step`` apart in order of their name; the runs of one
    benchmark share ``min(space, step)``, centred in the step.
    """
    bar = float(min(space, step))
    uids = df.select("suite_id", "suite_uid").distinct()
    ticks = range_positions(uids, ["suite_uid"], ["suite_id"], "_tick")
    cell = ["suite_id", "suite_uid", "bench_id"]
    return (
        number_within(df, cell, "run_id", "_slot", "_slots", attach=ticks)
        .withColumn("x", F.col("_tick") * F.lit(step))
        .withColumn("width", F.lit(bar) / F.col("_slots"))
        .withColumn("pos", F.col("x") + F.lit((step - bar) / 2) + F.col("_slot") * F.col("width"))
        .select(*df.columns, "x", "width", "pos")
    )


def with_label(df: DataFrame) -> DataFrame:
    """Add the day (UTC) of the suite run as ``label``."""
    return df.withColumn("label", day_text(suite_epoch(F.col("suite_uid"))))


def with_duration_text(df: DataFrame) -> DataFrame:
    """Add ``took`` and ``started`` as text."""
    return df.withColumn("took", duration_text(F.col("duration"))).withColumn(
        "started", start_text(F.col("start_time"))
    )


def with_suite_uid(df: DataFrame, id_col: str, epoch: Column) -> DataFrame:
    """Add ``suite_uid``: the suite id and the epoch second of its start."""
    return df.withColumn("suite_uid", F.concat_ws("_", F.col(id_col), epoch.cast("string")))


def last_phase(
    df: DataFrame, run: str, phase: str, start: str, duration: str, seq: str
) -> DataFrame:
    """(run, phase, start_time, duration): the last timing of each phase."""
    last = lambda c: F.max_by(F.col(c), F.col(seq))
    return df.groupBy(F.col(run).alias("run"), F.col(phase).alias("phase")).agg(
        last(start).alias("start_time"), last(duration).alias("duration")
    )


def main_phase_or_zero(runs: DataFrame, phases: DataFrame, phase: str) -> DataFrame:
    """(run, start_time, duration) of the main phase, 0 and 0 where it never ran."""
    main = phases.where(F.col("phase") == phase).drop("phase")
    return runs.join(main, "run", "left").select(
        "run",
        F.coalesce("start_time", F.lit(0)).alias("start_time"),
        F.coalesce("duration", F.lit(0.0)).alias("duration"),
    )


def with_logs(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """Each run with each of its log paths."""
    return runs.join(logs, "run_id")


def ordered_union(dfs: list[DataFrame], key: str, priority: str) -> DataFrame:
    """(key, idx): distinct rows of all lists, numbered by priority, then key."""
    every = reduce(
        lambda a, b: a.union(b), [df.select(key, priority) for df in dfs]
    ).distinct()
    return range_positions(every, [priority, key], number="idx").select(key, "idx")
