"""Scratch paths that every executor can reach.

On a cluster the folder comes from ``spark.checkpoint.dir``. Only where that is
unset, as in local tests, a temporary folder of this machine is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_root: tempfile.TemporaryDirectory | None = None
_handed_out: list[str] = []
_collected: ContextVar[list[str] | None] = ContextVar("_collected", default=None)


def shared_root(spark: SparkSession) -> str:
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.TemporaryDirectory(prefix="tallymill-")
    return _local_root.name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path, never handed out before; nothing is created there yet."""
    if not _handed_out:
        atexit.register(_release_quietly, spark)
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _handed_out.append(path)
    if (paths := _collected.get()) is not None:
        paths.append(path)
    return path


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths handed out within the block, to this thread alone: what others of the
    session work with is never among them."""
    paths: list[str] = []
    token = _collected.set(paths)
    try:
        yield paths
    finally:
        _collected.reset(token)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back: cuts lineage, and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def handed_out() -> tuple[str, ...]:
    """The scratch paths in use, oldest first."""
    return tuple(_handed_out)


def release(spark: SparkSession, paths: tuple[str, ...] | None = None) -> None:
    """Delete scratch paths, all by default, when what was read from them is used."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for name in handed_out() if paths is None else paths:
        if name in _handed_out:
            _handed_out.remove(name)
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def _release_quietly(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # the session may be gone at interpreter exit
        pass
