"""Word search over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tallymill.operators.grep import grep
from tallymill.streaming.files import to_files


def stream_grep(
    stream: DataFrame,
    col: str,
    words: list[str],
    sink_path: str,
    checkpoint: str,
    partition_by_word: bool = False,
) -> DataStreamWriter:
    """A writer of the matching lines, as files, by word if wanted."""
    partition_by = ["word"] if partition_by_word else None
    return to_files(grep(stream, col, words), sink_path, checkpoint, partition_by)
