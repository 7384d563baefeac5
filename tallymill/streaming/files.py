"""Streams into files, each batch exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tallymill.streaming.drive import drain


def to_files(
    stream: DataFrame, sink_path: str, checkpoint: str, partition_by: list[str] | None = None
) -> DataStreamWriter:
    """A writer into Parquet files; a batch that is repeated counts once."""
    writer = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", sink_path)
        .option("checkpointLocation", checkpoint)
    )
    return writer.partitionBy(*partition_by) if partition_by else writer


def stream_copy(
    stream: DataFrame, sink_path: str, checkpoint: str, timeout: int | None = None
) -> DataFrame:
    """Everything the stream holds, stored as a table."""
    drain(to_files(stream, sink_path, checkpoint), timeout)
    return stream.sparkSession.read.schema(stream.schema).parquet(sink_path)
