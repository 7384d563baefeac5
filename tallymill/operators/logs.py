"""Error scans of log lines, and what they mean for a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallymill.functions.ranking import number_within
from tallymill.sources.logs import parse_log_path

ERROR = r"(?i)(error|exception)"


def scan_logs(df: DataFrame, pattern: str = ERROR) -> DataFrame:
    """The lines that match."""
    return df.where(matches(pattern))


def matches(pattern: str = ERROR) -> Column:
    """The condition that a line matches, for readers that can drop the others' text."""
    return F.col("line").rlike(pattern)


def scan_numbered(
    df: DataFrame, file: list[str], order: str, number: str = "line_no", pattern: str = ERROR
) -> DataFrame:
    """The lines that match, with their 0-based number within the file.

    All lines are numbered, but only the text of those that match travels.
    """
    hit = F.when(F.col("line").rlike(pattern), F.col("line"))
    return number_within(df.withColumn("line", hit), file, order, number).where("line is not null")


def tree_hits(lines: DataFrame, path: str = "path", pattern: str = ERROR) -> DataFrame:
    """(suite_uid, bench_id, attempt, system) of the logs with a matching line."""
    keys = ["suite_uid", "bench_id", "attempt", "system"]
    hits = scan_logs(lines, pattern).select(path).distinct()
    return parse_log_path(hits, path).select(*keys).distinct()


def flags_from_tree(runs: DataFrame, lines: DataFrame, exempt: DataFrame) -> DataFrame:
    """(run_id, failed) of runs keyed by (suite_uid, bench_id, attempt), from the
    lines of their log tree, as ``scan_log_files`` gives them: a flag asks for no
    line's number, so the lines are filtered where they are read."""
    of_run = runs.select("run_id", "suite_uid", "bench_id", "attempt")
    hits = tree_hits(lines).join(of_run, ["suite_uid", "bench_id", "attempt"])
    return failed_flag(runs.select("run_id", "failed"), hits.select("run_id", "system"), exempt)


def failed_flag(runs: DataFrame, hits: DataFrame, exempt: DataFrame) -> DataFrame:
    """(run_id, failed): 1 if stored as failed, or if a system that is not exempt
    has a matching log line."""
    blamed = (
        hits.join(exempt.select("system"), "system", "left_anti")
        .groupBy("run_id")
        .agg(F.lit(1).alias("hit"))
    )
    return runs.join(blamed, "run_id", "left").select(
        "run_id", F.greatest("failed", F.coalesce("hit", F.lit(0))).alias("failed")
    )
