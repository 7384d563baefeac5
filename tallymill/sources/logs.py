"""Log files: keys in their paths, and lines with their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallymill.sources.scratch import materialize

# <anything>/logs/<suite_uid>/<bench_id>/<attempt>/<system>[/<file>]; a part may be
# spelt with its name, as in suite_uid=<suite_uid>
_PART = r"/(?:[a-z_]+=)?"
LOG_PATH = rf"logs{_PART}([^/]+){_PART}([^/]+){_PART}(\d+){_PART}([^/]+)(?:/([^/]+))?$"
# <system>_<role>[_<worker>].<log or out>
LOG_FILE = r"^([^_.]+)_([^_.]+)(?:_([^_.]+))?\.(log|out)$"


def parse_log_path(df: DataFrame, path_col: str) -> DataFrame:
    """Add suite_uid, bench_id, attempt, system, file, role, worker and stream."""
    path = F.col(path_col)
    key = lambda i: F.regexp_extract(path, LOG_PATH, i)
    named = lambda i: F.regexp_extract("file", LOG_FILE, i)
    return (
        df.withColumn("suite_uid", key(1))
        .withColumn("bench_id", key(2))
        .withColumn("attempt", key(3).try_cast("int"))
        .withColumn("system", key(4))
        .withColumn("file", key(5))
        .withColumn("role", named(2))
        .withColumn("worker", named(3))
        .withColumn("stream", named(4))
    )


def _log_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)


def scan_log_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of every log file below ``path``: one scan, nothing is stored."""
    return _log_text(spark, path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def read_log_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """(path, line_no, line) of every log file below ``path``, numbered from 0.

    A large file is read by many tasks. Each task's share of it (one file block)
    is numbered locally; the blocks' line counts, one row per block, then say
    where each share starts. No file passes through one task. Shares and numbers
    are written once, as a second scan might cut the files elsewhere.

    ``keep`` is a condition on ``line``: every line counts for the numbers, but only
    lines that meet it are returned, and no other line's text is written.
    """
    raw = _log_text(spark, path).withColumnRenamed("value", "line")
    if keep is not None:
        raw = raw.withColumn("line", F.when(keep, F.col("line")))
    lines = raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "line",
    )
    lines = materialize(lines, "log-lines")
    kept = lines if keep is None else lines.where("line is not null")
    blocks = lines.groupBy("path", "block").agg(
        F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")
    )
    before = (
        Window.partitionBy("path")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = blocks.select(
        "path",
        "block",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
    )
    return kept.join(starts, ["path", "block"]).select(
        "path", (F.col("seq") + F.col("shift")).alias("line_no"), "line"
    )
