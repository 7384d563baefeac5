"""The canonical inputs, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallymill.operators.wordcount import normalize_words, tokenize
from tallymill.sources.tables import read_table

LINE_COLUMNS = ["doc_id", "posexplode(split(text, '\\n')) as (pos, line)"]


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", "text")


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, pos, line)"""
    return documents(spark, d).selectExpr(*LINE_COLUMNS)


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with ``ts`` as an instant (the session's time zone is UTC)."""
    return read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """One benchmark run per event."""
    suite = F.concat(F.lit("suite"), (F.col("user_id") % 5).cast("string"))
    day = F.unix_timestamp(F.date_trunc("day", "ts")).cast("string")
    return events(spark, d).select(
        F.col("event_id").alias("run_id"),
        suite.alias("suite_id"),
        F.concat(suite, F.lit("_"), day).alias("suite_uid"),
        F.col("event_type").alias("bench_id"),
        F.unix_timestamp("ts").alias("start_time"),
        F.col("value").alias("duration"),
        F.when(F.col("value") > 100, 1).otherwise(0).alias("failed"),
        F.concat(F.lit("system"), (F.col("user_id") % 7).cast("string")).alias("system"),
        "props",
    )


def results(spark: SparkSession, d: str) -> DataFrame:
    """The stored columns of ``runs``."""
    return runs(spark, d).drop("system", "props")


def logs(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, system, log_path)"""
    return runs(spark, d).select(
        "run_id",
        "system",
        F.concat_ws("/", F.lit("results/logs"), "suite_uid", "bench_id", F.lit("1"), "system")
        .alias("log_path"),
    )


def log_text(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, suite_uid, system, line)"""
    return runs(spark, d).select(
        "run_id", "suite_uid", "system", F.concat_ws(" ", "bench_id", "props").alias("line")
    )


def grid_runs(spark: SparkSession, d: str) -> DataFrame:
    """Results of benchmarks so many that a suite run has not all of them."""
    bench = F.concat_ws("-", "bench_id", (F.col("run_id") % 37).cast("string"))
    return results(spark, d).withColumn("bench_id", bench)


def tree_text(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, suite_uid, bench_id, attempt, system, failed, line) of suite runs that
    last a month, with one attempt per benchmark."""
    month = F.unix_timestamp(F.date_trunc("month", F.timestamp_seconds("start_time"))).cast("string")
    return runs(spark, d).select(
        "run_id", F.concat_ws("_", "suite_id", month).alias("suite_uid"), "bench_id",
        F.lit(1).alias("attempt"), "system", "failed", F.concat_ws(" ", "bench_id", "props").alias("line"),
    )


def tree_runs(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, suite_uid, bench_id, attempt, failed): failed as stored if all its
    results are."""
    return tree_text(spark, d).groupBy("suite_uid", "bench_id", "attempt").agg(
        F.min("run_id").alias("run_id"), F.min("failed").alias("failed")
    )


def run_phases(spark: SparkSession, d: str) -> DataFrame:
    """(suite_uid, bench_id, run_id, seq, phase, start_time, duration): set-up and
    shutdown take a tenth and a twentieth of a run's whole seconds."""
    whole = F.floor("duration")

    def phase(seq: int, name: str, start: Column, duration: Column) -> Column:
        return F.struct(
            F.lit(seq).alias("seq"), F.lit(name).alias("phase"), start.alias("start_time"),
            duration.cast("double").alias("duration"),
        )

    start = F.col("start_time")
    phases = F.array(
        phase(0, "Setup", start - 60, F.floor(whole / 10)),
        phase(1, "Benchmark", start, F.col("duration")),
        phase(2, "Shutdown", start + whole, F.floor(whole / 20)),
    )
    return results(spark, d).select("suite_uid", "bench_id", "run_id", F.explode(phases).alias("p")).select(
        "suite_uid", "bench_id", "run_id", "p.*"
    )


def suite_timings(spark: SparkSession, d: str) -> DataFrame:
    """Timings of suite runs in the order they were taken."""
    return runs(spark, d).select("suite_uid", "bench_id", "start_time", "duration", "run_id")


def dictionary_entries(spark: SparkSession, d: str) -> DataFrame:
    """(entry): words of the documents with a flag after a slash."""
    return tokenize("text")(documents(spark, d)).select(
        F.concat_ws("/", "word", F.length("word").cast("string")).alias("entry")
    ).distinct()


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """(word): the dictionary of the documents."""
    return normalize_words(dictionary_entries(spark, d), "entry")
