"""Running and windowed word counts over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallymill.operators.wordcount import count_by, time_window_count, tokenize, window_rows
from tallymill.streaming.drive import drain


# Batches after which all totals so far are stored together.
SNAPSHOT_EVERY = 16


def totals_before(path: str, batch_id: int, every: int = SNAPSHOT_EVERY) -> list[str]:
    """The folders that hold all totals before a batch: the last snapshot, and the
    totals that the batches after it changed; never more than ``every``."""
    last = batch_id // every * every - 1
    snapshot = [f"{path}/snapshots/batch={last}"] if last >= 0 else []
    return snapshot + [f"{path}/totals/batch={b}" for b in range(last + 1, batch_id)]


def _totals(spark: SparkSession, folders: list[str]) -> DataFrame:
    kind = "word string, n bigint"
    if not folders:
        return spark.createDataFrame([], kind)
    stored = spark.read.schema(kind).parquet(*folders)
    return stored.groupBy("word").agg(F.max("n").alias("n"))


def _changes(counts: DataFrame, sink_path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of the counts that each batch changed, into a folder of the batch's
    number; a batch that is run again after a failure replaces its folder."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_path}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
    )


def last_totals(stream: DataFrame, sink_path: str, schema: str = "word string, n bigint") -> DataFrame:
    """The last stored count ``n`` of each key; counts only rise."""
    stored = stream.sparkSession.read.schema(f"{schema}, batch bigint").parquet(sink_path)
    keys = [c for c in stored.columns if c not in ("n", "batch")]
    return stored.groupBy(*keys).agg(F.max("n").alias("n"))


def stream_word_count(
    stream: DataFrame, col: str, sink_path: str, checkpoint: str, timeout: int | None = None
) -> DataFrame:
    """(word, n): running totals after the stream has been drained."""
    totals = count_by("word")(tokenize(col)(stream))
    drain(_changes(totals, sink_path, checkpoint), timeout)
    return last_totals(stream, sink_path)


def stream_count_windows(
    stream: DataFrame,
    key: str,
    sink_path: str,
    checkpoint: str,
    size: int = 10_000,
    timeout: int | None = None,
) -> DataFrame:
    """(word, w, n): tumbling windows of ``size`` occurrences, as they fill up.

    The stream keeps one running count per word, summed up in each task before the
    shuffle. A batch stores the totals it changed; the windows it puts out are
    those between the last total of earlier batches and its own, and their rows
    are made by many tasks. Every few batches all totals are stored together, so a
    batch reads one snapshot and the batches after it, however many came before. A
    batch that is run again reads the same folders and replaces what it stored.
    """
    spark = stream.sparkSession
    totals = count_by("word")(stream.select(F.col(key).alias("word")))
    windows = f"{sink_path}/windows"

    def store(batch: DataFrame, batch_id: int) -> None:
        at = f"{sink_path}/totals/batch={batch_id}"
        batch.write.mode("overwrite").parquet(at)
        now, earlier = _totals(spark, [at]), totals_before(sink_path, batch_id)
        if (batch_id + 1) % SNAPSHOT_EVERY == 0:
            _totals(spark, [*earlier, at]).write.mode("overwrite").parquet(f"{sink_path}/snapshots/batch={batch_id}")
        before = _totals(spark, earlier).select(F.col("word").alias("key"), F.col("n").alias("before"))
        full = now.join(before, F.col("word").eqNullSafe(F.col("key")), "left").select(
            "word",
            F.expr(f"coalesce(before, 0L) div {size}").alias("first"),
            F.expr(f"n div {size}").alias("end"),
        )
        window_rows(full, size).write.mode("overwrite").parquet(f"{windows}/batch={batch_id}")

    writer = (
        totals.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
    )
    drain(writer, timeout)
    out = spark.read.schema("word string, w bigint, n bigint, batch bigint").parquet(windows)
    return out.drop("batch")


def stream_time_windows(
    stream: DataFrame,
    ts: str,
    key: str,
    sink_path: str,
    checkpoint: str,
    width: str = "1 hour",
    delay: str | None = None,
    timeout: int | None = None,
) -> DataFrame:
    """(window_start, word, n) of all windows of the stream, open ones included.

    Batches store the counts they changed and the last count of each window is
    the result, so nothing is left out when the input ends: windows that the watermark
    has not closed by then are stored like the others. With ``delay``, the state of
    windows that ended longer before the newest row of earlier batches is freed, and
    rows that come after that are dropped; without it, state is never freed.
    """
    counts = time_window_count(stream, ts, key, width, delay)
    drain(_changes(counts, sink_path, checkpoint), timeout)
    return last_totals(stream, sink_path, "window_start timestamp, word string, n bigint")
