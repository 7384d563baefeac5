"""Session settings shared by tests, bench and applications."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def build_session(
    master: str | None = None,
    app_name: str = "tallymill",
    shuffle_partitions: int | None = None,
    memory_fraction: float | None = None,
    off_heap_bytes: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with adaptive execution, UTC time and RocksDB stream state.

    ``master`` and ``shuffle_partitions`` are left to the cluster's own
    configuration when not given. ``memory_fraction`` and ``off_heap_bytes``
    are the two memory levers that the workloads are compared under.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        .config(CHANGELOG, "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
            builder = (
                builder.config("spark.driver.host", "127.0.0.1")
                .config("spark.driver.bindAddress", "127.0.0.1")
                .config("spark.driver.memory", os.environ.get("DRIVER_MEMORY", "8g"))
                .config("spark.ui.enabled", "false")
            )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory_fraction is not None:
        builder = builder.config("spark.memory.fraction", str(memory_fraction))
    if off_heap_bytes is not None:
        builder = builder.config("spark.memory.offHeap.enabled", "true").config(
            "spark.memory.offHeap.size", str(off_heap_bytes)
        )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
