"""Typed tables: delimited text, binary copies, results and keyed appends."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallymill.sources.scratch import materialize

BUILT_IN_FORMATS = ("orc", "parquet", "csv", "json", "text")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Text that stands for null, and how times are written: nothing of a value is lost.
NULL = "\\N"
_DELIMITED = {
    "nullValue": NULL,
    "emptyValue": '""',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def _one_line(value: Column) -> Column:
    """Backslashes doubled and line breaks spelt, so that a row is one line."""
    for sign, spelt in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        value = F.replace(value, F.lit(sign), F.lit(spelt))
    return value


def _as_it_was(value: Column) -> Column:
    """Undoes ``_one_line``: between doubled backslashes, breaks are breaks again."""
    part = lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    joined = F.array_join(F.transform(F.split(value, r"\\\\", -1), part), "\\")
    return F.when(F.instr(value, "\\") == 0, value).otherwise(joined)


def _strings(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    return df.select(*[
        change(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else f.name
        for f in df.schema
    ])


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = "|"
) -> DataFrame:
    """What ``write_delimited`` wrote; a row that does not fit is an error."""
    reader = spark.read.schema(schema).options(**_DELIMITED | {"emptyValue": ""})
    return _strings(reader.option("sep", sep).option("mode", "FAILFAST").csv(path), _as_it_was)


def write_delimited(df: DataFrame, path: str, sep: str = "|") -> str:
    """Delimited text without a header, one line per row, that reads back the same:
    spaces, empty strings, line breaks, nulls and microseconds included."""
    _strings(df, _one_line).write.options(**_DELIMITED).option("sep", sep).csv(path)
    return path


def write_result(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Write a result and return what a reader of the path sees."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    back = df.sparkSession.read.schema(df.schema).format(fmt).load(path)
    return back.select(*df.columns)


def convert(df: DataFrame, path: str, fmt: str = "orc") -> DataFrame:
    """Keep a typed binary copy of a table and return it."""
    try:
        return write_result(df, path, fmt=fmt)
    except AnalysisException as e:
        if fmt in BUILT_IN_FORMATS or "data source" not in str(e).lower():
            raise
        raise ValueError(
            f"format {fmt!r} needs its Spark module on the class path; "
            f"built in are {', '.join(BUILT_IN_FORMATS)}"
        ) from e


COMMIT = "_commit"


def _commits(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the appends that a table is made of; none if there is no table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{COMMIT}="))


def read_appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table that ``append_rows`` keeps."""
    whole = T.StructType([*schema.fields, T.StructField(COMMIT, T.LongType())])
    return spark.read.schema(whole).parquet(path).select(*schema.fieldNames())


def _committed(spark: SparkSession, staged: str, place: str) -> bool:
    """Whether the staged folder got its place, which only one writer does: a rename
    that fails where something is. HDFS does it in one step; a local disk, and object
    stores without a rename of their own, look first and move then."""
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    source, target = fs.Path(staged), fs.Path(place)
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf).rename(source, target, options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        source.getFileSystem(conf).delete(source, True)
        return False
    return True


def _within(stored: DataFrame, fresh: DataFrame, partition_by: list[str]) -> DataFrame:
    """The stored rows in partitions between the smallest and the largest that the
    fresh rows go to, so that the others are not even listed."""
    ends = fresh.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in partition_by for f in (F.min, F.max)],
                     *[F.bool_or(F.col(c).isNull()).alias(f"null_{c}") for c in partition_by]).first()
    for c in partition_by:
        inside = F.col(c).between(F.lit(ends[f"min_{c}"]), F.lit(ends[f"max_{c}"]))
        stored = stored.where(inside | F.col(c).isNull() if ends[f"null_{c}"] else inside)
    return stored


def append_rows(
    df: DataFrame, path: str, key_cols: list[str], partition_by: list[str] | None = None
) -> DataFrame:
    """Append the rows whose key is not stored yet; return the whole table.

    The key of a row is ``key_cols`` together with ``partition_by``: the same
    ``key_cols`` in another partition are another row. Of new rows with one key
    the smallest is taken, by its other columns in their order. Running it again
    with the same rows adds nothing, so a job that died can simply be repeated.

    An append is written beside the table, out of readers' sight, and takes the next
    number by one rename: readers see all of it or nothing. Of writers at the same time
    one gets the number; the others look again at what is stored now, so a key that
    several of them bring is stored once. Rows are dealt by partition first, and large
    partitions over several tasks, so a partition gets few files whatever the number of
    tasks. Plain readers of ``path`` find the number as a column ``_commit``.
    """
    spark = df.sparkSession
    partition_by = partition_by or []
    keys = list(dict.fromkeys([*key_cols, *partition_by]))
    rest = [c for c in df.columns if c not in keys]
    smallest = F.min(F.struct(*rest) if rest else F.lit(0)).alias("_rest")
    fresh = df.groupBy(*keys).agg(smallest).select(*keys, *[F.col("_rest")[c].alias(c) for c in rest])
    fresh = materialize(fresh, "fresh")
    while True:
        commits, new = _commits(spark, path), fresh
        if commits:
            stored = read_appended(spark, path, df.schema)
            if partition_by:
                stored = _within(stored, fresh, partition_by)
            known = stored.select(*[F.col(c).alias(f"_{c}") for c in keys])
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
            new = fresh.join(known, same, "left_anti")
        writer = new.select(*df.columns).hint("rebalance", *partition_by).write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        staged = f"{path}/_staged-{uuid.uuid4().hex}"
        writer.parquet(staged)
        if _committed(spark, staged, f"{path}/{COMMIT}={commits[-1] + 1 if commits else 0}"):
            return read_appended(spark, path, df.schema)


def explode_paths(df: DataFrame, run: str = "run_id", paths: str = "log_paths") -> DataFrame:
    """One row per run and system from a map of system to log path."""
    return df.select(F.col(run).alias("run_id"), F.explode(paths).alias("system", "log_path"))
