"""Shuffled shards: a Feistel permutation of global row numbers.

The permutation is computed, not stored: the shard and slot of a row number, and
the row number behind a shard and slot, follow from the number of rows, the number
of shards and the seed alone.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from tallymill.functions.ranking import range_positions
from tallymill.llm.common import column
from tallymill.llm.shingles import mixed
from tallymill.sources.scratch import materialize

# Workers get this module with the task, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARDS, SEED = 40, 1
# Rounds of the network; four already make it a strong permutation of random functions.
ROUNDS = 6


class Shuffle:
    """A permutation of 0 to ``n`` - 1, and its inverse, by arithmetic alone."""

    def __init__(self, n: int, seed: int = SEED):
        self.n = n
        self.half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) + mixed(np.array([seed], np.int64).view(np.uint64)))

    def _forward(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ (mixed(right ^ key) & self.mask)
        return left << self.half | right

    def _backward(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1]:
            left, right = right ^ (mixed(left ^ key) & self.mask), left
        return left << self.half | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        """The network permutes up to four times ``n`` numbers; one that lands outside
        goes on along its cycle, which leads back inside, as it began there."""
        x = step(np.asarray(x).astype(np.uint64))
        while len(out := np.flatnonzero(x >= np.uint64(self.n))):
            x[out] = step(x[out])
        return x.astype(np.int64)

    def place(self, row: np.ndarray) -> np.ndarray:
        return self._walk(row, self._forward)

    def row(self, place: np.ndarray) -> np.ndarray:
        return self._walk(place, self._backward)


def shard_and_slot(row: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED):
    """Where the rows with these global numbers lie, as two arrays."""
    place = Shuffle(n, seed).place(row)
    return place % shards, place // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """The global numbers of the rows that lie there."""
    return Shuffle(n, seed).row(np.asarray(slot) * shards + np.asarray(shard))


def shard_rows(
    rows: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """(row, row_number, shard, slot): each row of ``rows``, as a struct, with its place.

    Rows are numbered by the columns in ``order``, nulls first, whatever files and
    partitions they come in, and the numbers are permuted. Place ``p`` is slot
    ``p div shards`` of shard ``p mod shards``: counts of shards differ by one at
    most, and slots have no gaps. Rows alike in ``order`` follow each other as they
    are read, so a key that a third of the rows share is still cut into many ranges;
    which of them takes which place may change with the files. No row in, no row out;
    fewer rows than shards leave shards empty. Names of columns cannot clash.
    """
    kept = rows.select(
        F.struct(*[column(c) for c in rows.columns]).alias("row"),
        *[column(c).alias(f"by{i}") for i, c in enumerate(order)],
        F.monotonically_increasing_id().alias("read"),
    )
    kept = materialize(kept, "rows")
    shuffle = Shuffle(kept.count(), seed)

    @F.pandas_udf("bigint")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(shuffle.place(row.to_numpy()))

    by = [c for c in kept.columns if c != "row"]
    numbered = range_positions(kept, by, number="row_number")
    placed = numbered.select("row", "row_number", place("row_number").alias("place"))
    return placed.select(
        "row", "row_number", F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"place div {shards}L").alias("slot"),
    )


def shard_table(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each document.

    The law is ``rows``: counts of shards differ by one at most, whatever the sizes;
    so ``grown_shard`` is null, and equal texts spread over all shards like any other
    rows. Documents are numbered by ``doc_id``, then by a hash of the text. Texts are
    read once; what is sorted and numbered is a few numbers for each. ``size`` is 16
    plus the text's UTF-8 bytes, none for null, whose checksum is that of no bytes.
    Null and repeated ``doc_id`` are numbered like others.
    """
    t = F.coalesce(column(text), F.lit(""))
    small = docs.select(
        column(doc_id).cast("bigint").alias("doc_id"), (F.octet_length(t) + F.lit(16)).cast("bigint").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("fp"),
    )
    return shard_rows(small, ["doc_id", "fp"], shards, seed).select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(
    docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Stores the documents by shard, each file a run of its slots in order, with the
    columns (shard, slot, row); returns them as read back. A shard may be far larger
    than one task holds: it is cut into ranges of slots."""
    rows = docs.select("*", F.xxhash64(column(text)).alias(name := _free("fp", docs.columns)))
    placed = shard_rows(rows, [doc_id, name], shards, seed)
    row = F.struct(*[F.col("row")[c].alias(c) for c in docs.columns]).alias("row")
    out = placed.select("shard", "slot", row)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path).select("shard", "slot", "row")


def _free(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name
