"""How filters of a corpus overlap, counted by a stream that can retract.

Documents come in micro-batches, in any order. Whether a text is a copy depends on
documents that may not have come yet: the document with the smallest id so far
counts as the first, and when a smaller one arrives its count is taken back and
given again as a copy's.
"""

from __future__ import annotations

import json
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tallymill.llm.common import SPACED_WORD, column, let
from tallymill.sources.scratch import materialize, scratch_path
from tallymill.streaming.drive import drain

# Workers get this module with the task, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILTERS = "ABCDE"
# The bit of each filter in a mask of failed filters; the last stands for copies.
BITS = {f: 1 << i for i, f in enumerate(FILTERS)}
COPY = BITS["E"]
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 100, 80, 10
SYMBOLS = r"[#$%&*|]"

# ``known`` is 0 for rows that can be no first: pandas would make floats of ids and nulls.
_KEYED = "key string, mask int, known int, doc_id bigint, part string, good int, toxic int, n bigint"
_ARROW = pa.schema([
    ("key", pa.string()), ("mask", pa.int32()), ("known", pa.int32()), ("doc_id", pa.int64()),
    ("part", pa.string()), ("good", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64()),
])
_DELTA = "part string, mask int, good int, toxic int, n bigint"
_STATE = "texts string"
# Texts that share a state are those of about so many bytes of the table; a call in
# Python for each text alone would take longer than all the rest.
BUCKET_BYTES = 16 << 20


def failed(text: Column) -> Column:
    """The mask of the filters that a text fails by itself: too few words, too few
    distinct ones, too many capitals, symbols. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    bit = lambda f, fails: F.when(fails, BITS[f]).otherwise(0)
    words = let(
        F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0)),
        lambda w: bit("A", F.size(w) < MIN_WORDS)
        + bit("B", 100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * F.size(w)),
    )
    return (
        words
        + bit("C", 100 * capitals.cast("bigint") > MAX_CAPITALS_PERCENT * F.char_length(text))
        + bit("D", text.rlike(SYMBOLS))
    ).cast("int")


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with the same text become few: those with its smallest id, and
    counts without an id of the others, which are copies whatever comes later."""
    for batch in batches:
        c = batch.to_pydict()
        least: dict[str, int] = {}
        for key, doc in zip(c["key"], c["doc_id"]):
            if doc is not None and doc <= least.get(key, doc):
                least[key] = doc
        rows: Counter = Counter()
        for key, mask, doc, part, good, toxic in zip(*(c[x] for x in batch.schema.names)):
            if doc is not None and doc != least[key]:
                mask, doc = mask | COPY, None
            rows[key, mask, int(doc is not None), doc or 0, part, good, toxic] += 1
        columns = list(zip(*((*k, n) for k, n in rows.items()))) or [()] * len(_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _ARROW)], schema=_ARROW)


def _retracted(bucket: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """What the rows of some texts change in the counts. The state holds, by text, the
    smallest id so far, and how often each part and pair of labels came with it."""
    texts = json.loads(state.get[0]) if state.exists else {}
    out: Counter = Counter()
    for frame in frames:
        rows = zip(*(frame[c].tolist() for c in ("key", "mask", "known", "doc_id", "part", "good", "toxic", "n")))
        for key, mask, known, doc, part, good, toxic, n in rows:
            if not known:
                out[part, mask, good, toxic] += n
                continue
            least, first = texts.get(key, (doc, []))
            if doc < least:
                for p, m, g, t, k in first:
                    out[p, m, g, t] -= k
                    out[p, m | COPY, g, t] += k
                least, first = doc, []
            if doc == least:
                texts[key] = (least, [*first, (part, mask, good, toxic, n)])
            else:
                mask |= COPY
            out[part, mask, good, toxic] += n
    if texts:
        state.update((json.dumps(texts, separators=(",", ":")),))
    changed = [(*k, n) for k, n in out.items() if n]
    if changed:
        yield pd.DataFrame(changed, columns=["part", "mask", "good", "toxic", "n"])


def buckets_for(spark: SparkSession, table_bytes: int) -> int:
    """Buckets for a table of this size, some for every task of a shuffle at least."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(4 * tasks, table_bytes // BUCKET_BYTES)


def label_flags(labels: DataFrame) -> DataFrame:
    """(id, good, toxic): 1 for ids that some row gives quality 1, or toxic 1."""
    one = lambda c: F.max(F.coalesce(column(c) == 1, F.lit(False)).cast("int"))
    flags = labels.where(column("doc_id").isNotNull()).groupBy(column("doc_id").cast("bigint").alias("id"))
    return materialize(flags.agg(one("quality").alias("good"), one("toxic").alias("toxic")), "flags")


def mask_counts(
    stream: DataFrame, labels: DataFrame, buckets: int, doc_id: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """(part, mask, good, toxic, n): documents of a stream by part, the set of filters
    they fail and their labels, when all that is there has been read.

    The stream may come in any number of batches and in any order. Each batch is
    keyed by a hash of 128 bits of the text; copies are combined within tasks before
    and only numbers are shuffled. The state of a text is its smallest id and the
    counts that came with it. Texts are dealt by hash over ``buckets``, which should
    grow with the table (see ``buckets_for``); a bucket's texts are stored together, in
    the session's state store (``build_session`` sets RocksDB) and its checkpoint, so a
    lost executor costs the tasks it ran. A batch's changes go to a folder of its
    number, which a repeated batch replaces. A row is a copy if a smaller id has its text: rows with
    one id and one text are not copies of each other, and a row without an id neither
    is a copy nor makes one.
    """
    spark = stream.sparkSession
    flags = label_flags(labels)
    t = F.coalesce(column(text), F.lit(""))
    rows = stream.select(
        F.md5(t.cast("binary")).alias("key"), failed(t).alias("mask"),
        column(doc_id).cast("bigint").alias("doc_id"), F.coalesce(column(part).cast("string"), F.lit("")).alias("part"),
    )
    rows = rows.join(flags, F.col("doc_id") == F.col("id"), "left").select(
        "key", "mask", "doc_id", "part", F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )
    combined = rows.mapInArrow(_combined, _KEYED)
    combined = combined.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    changes = combined.groupBy("bucket").applyInPandasWithState(
        _retracted, _DELTA, _STATE, "update", GroupStateTimeout.NoTimeout
    )
    deltas = scratch_path(spark, "deltas")

    def store(batch: DataFrame, batch_id: int) -> None:
        summed = batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        summed.write.mode("overwrite").parquet(f"{deltas}/batch={batch_id}")

    writer = (
        changes.writeStream.outputMode("update")
        .option("checkpointLocation", scratch_path(spark, "checkpoint"))
        .foreachBatch(store)
    )
    drain(writer)
    try:
        stored = spark.read.schema(f"{_DELTA}, batch bigint").parquet(deltas)
    except Exception as e:
        if getattr(e, "getCondition", lambda: None)() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _DELTA)  # nothing came
    counts = stored.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    return counts.where("n <> 0")


def _steps() -> list[dict]:
    """Every order of the filters, cut into its steps."""
    return [
        {"filter_order": "".join(order), "step": i + 1, "bit": BITS[f], "before": sum(BITS[x] for x in order[:i])}
        for order in permutations(FILTERS)
        for i, f in enumerate(order)
    ]


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from ``mask_counts``.

    ``kept`` after the step; ``removed`` by it; ``redundant``: failing its filter but
    removed before; ``unique_fails``: failing no other; ``good_lost`` and ``toxic_lost``
    of the removed; ``shapley``: removed by this filter, summed over all orders. A part
    without documents does not appear, and no counts give no row.
    """
    kind = "array<struct<filter_order:string,step:int,bit:int,before:int>>"
    each = counts.select("*", F.explode(F.from_json(F.lit(json.dumps(_steps())), kind)).alias("at"))
    fails = F.col("mask").bitwiseAND(F.col("at.bit")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("at.before")) != 0
    total = lambda when, n="n": F.sum(F.when(when, F.col(n)).otherwise(0)).cast("bigint")
    table = (
        each.withColumn("good_n", F.col("good") * F.col("n")).withColumn("toxic_n", F.col("toxic") * F.col("n"))
        .groupBy("part", "at.filter_order", "at.step", "at.bit")
        .agg(
            total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"),
            total(fails & earlier).alias("redundant"), total(F.col("mask") == F.col("at.bit")).alias("unique_fails"),
            total(fails & ~earlier, "good_n").alias("good_lost"), total(fails & ~earlier, "toxic_n").alias("toxic_lost"),
        )
    )
    whole = table.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return table.join(whole, ["part", "bit"]).drop("bit")


def audit(
    stream: DataFrame, labels: DataFrame, buckets: int, doc_id: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """``interactions`` of the documents in a stream.

    Null texts are empty, null parts the empty string; a row without a text still
    counts. Repeated labels of an id count once, 1 if any of them is. Other columns
    play no part. An empty stream gives no row.
    """
    return interactions(mask_counts(stream, labels, buckets, doc_id, text, part))
