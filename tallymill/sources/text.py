"""Text corpora and tables, read whole or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamReader

TEXT = T.StructType([T.StructField("value", T.StringType())])


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, split at newlines only."""
    return spark.read.option("lineSep", "\n").text(path)


# Encodings that a dictionary file can have, with the characters that they lack. A line
# break is one byte in each of them.
LACKING = {"US-ASCII": r"[^\x00-\x7F]", "ISO-8859-1": r"[^\x00-\xFF]", "UTF-8": r"[^\s\S]"}


def _escaped(word: Column, lacking: str) -> Column:
    """A backslash is doubled; a character that the file cannot hold, or that would end
    the line, becomes its number in hexadecimal between ``\\u{`` and ``}``."""
    spelt = lambda c: F.concat(F.lit("\\u{"), F.hex(F.ascii(c)), F.lit("}"))
    sign = lambda c: (
        F.when(c == "\\", F.lit("\\\\")).when((c == "\n") | c.rlike(lacking), spelt(c)).otherwise(c)
    )
    signs = F.regexp_extract_all(word, F.lit(r"(?s)."), F.lit(0))
    plain = ~word.rlike(rf"{lacking}|[\\\n]")
    return F.when(plain, word).otherwise(F.array_join(F.transform(signs, sign), ""))


def _unescaped(word: Column) -> Column:
    parts = F.regexp_extract_all(word, F.lit(r"(?s)\\\\|\\u\{[0-9A-F]+\}|."), F.lit(0))
    number = lambda p: F.unhex(F.lpad(F.regexp_replace(p, r"[^0-9A-F]", ""), 8, "0"))
    sign = lambda p: (
        F.when(p == "\\\\", F.lit("\\")).when(p.startswith("\\u{"), F.decode(number(p), "UTF-32")).otherwise(p)
    )
    return F.when(F.instr(word, "\\") == 0, word).otherwise(F.array_join(F.transform(parts, sign), ""))


def read_words(
    spark: SparkSession, path: str, encoding: str = "ISO-8859-1", escaped: bool = False
) -> DataFrame:
    """(entry): one dictionary entry per line, from ``encoding`` to UTF-8. ``escaped``
    undoes what ``write_words`` spelt; other people's files may hold backslashes."""
    entry = F.decode(F.col("value").cast("binary"), encoding)
    return read_text(spark, path).select((_unescaped(entry) if escaped else entry).alias("entry"))


def write_words(df: DataFrame, col: str, path: str, encoding: str = "ISO-8859-1") -> str:
    """A dictionary file: one entry per line in ``encoding``, bytes as they are, no quotes.

    Every entry reads back the same, empty ones too: characters that the encoding lacks,
    line feeds and backslashes are escaped. Null entries are left out. Encodings other
    than those in ``LACKING`` are an error.
    """
    if encoding not in LACKING:
        raise ValueError(f"a dictionary file is in one of {', '.join(LACKING)}")
    entry = F.encode(_escaped(F.col(col), LACKING[encoding]), encoding)
    lines = df.where(F.col(col).isNotNull()).select(entry.cast("string").alias("value"))
    lines.write.option("lineSep", "\n").text(path)
    return path


def write_text(df: DataFrame, col: str, path: str) -> str:
    df.select(F.col(col).alias("value")).write.option("lineSep", "\n").text(path)
    return path


def _bounded(reader: DataStreamReader, bytes_per_batch: int | None) -> DataStreamReader:
    if bytes_per_batch is None:
        return reader
    return reader.option("maxBytesPerTrigger", bytes_per_batch)


def stream_text(spark: SparkSession, path: str, bytes_per_batch: int | None = None) -> DataFrame:
    """One row per line of the files under ``path``, as a stream."""
    reader = spark.readStream.schema(TEXT).option("lineSep", "\n")
    return _bounded(reader, bytes_per_batch).text(path)


def stream_table(
    spark: SparkSession, folder: str, name: str, schema: T.StructType, bytes_per_batch: int | None = None
) -> DataFrame:
    """The files of the table ``name`` in ``folder``, as they lie, as a stream.

    A table is one Parquet file or a folder of them. Batches are bounded by bytes,
    whatever the number of files.
    """
    table = f"{folder}/{name}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = _bounded(spark.readStream.schema(schema), bytes_per_batch)
    if files.getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", path.getName()).parquet(folder)
    return reader.parquet(table)
