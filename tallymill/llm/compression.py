"""A quality classifier from compressed sizes under two dictionaries."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from tallymill.llm.common import column
from tallymill.llm.langid import fold
from tallymill.sources.scratch import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Labelled texts of each kind, and their bytes altogether, that the classifier is built
# from at most: half for the dictionary, half to calibrate. They come to the driver.
LABELLED, LABELLED_BYTES = 3_000, 32 << 20
DICTIONARY_BYTES, LEVEL = 64 << 10, 3
CUT = 0.7


class Model(NamedTuple):
    good: bytes
    bad: bytes
    mean: list[float]
    deviation: list[float]
    low: list[float]
    high: list[float]
    weights: list[float]


class Sizes:
    """Compressed sizes of a text with the good and with the bad dictionary, and the
    features made of them."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def compressor(dictionary: bytes):
            return zstandard.ZstdCompressor(
                level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary),
                write_content_size=False, write_dict_id=False,
            )

        self.compressors = [compressor(d) for d in (good, bad)]

    def features(self, text: str | None) -> list[float]:
        """The normalised difference of the sizes, how far the text shrinks at
        all, its length, and products of these."""
        data = (text or "").encode("utf-8", "surrogatepass")
        good, bad = (len(c.compress(data)) for c in self.compressors)
        difference = (bad - good) / (bad + good)
        shrunk = np.log((good + bad) / 2 / (len(data) + 1))
        length = np.log(len(data) + 1)
        return [1.0, difference, difference**2, shrunk, shrunk**2, difference * shrunk, length, length * difference]


def _chance(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def build(good: list[str], bad: list[str]) -> Model | None:
    """Dictionaries from every second text, and a logistic calibration on the
    others. None unless there are some of both kinds."""
    import zstandard

    if min(len(good), len(bad)) < 2:
        return None

    def dictionary(texts: list[str]) -> bytes:
        data = [t.encode("utf-8", "surrogatepass") for t in texts if t]
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, data).as_bytes()
        except zstandard.ZstdError:  # too few to train: their end is the dictionary
            return b"".join(data)[-DICTIONARY_BYTES:]

    dictionaries = [dictionary(t[::2]) for t in (good, bad)]
    sizes = Sizes(*dictionaries)
    x = np.array([sizes.features(t) for t in good[1::2] + bad[1::2]])
    y = np.r_[np.ones(len(good[1::2])), np.zeros(len(bad[1::2]))]
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], deviation[0] = 0, 1
    z = (x - mean) / deviation
    weights = np.zeros(z.shape[1])
    penalty = 0.1
    loss = lambda w: (
        np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ w)).sum() + penalty / 2 * (w @ w)
    )
    for _ in range(60):
        p = _chance(z, weights)
        curve = (z * (p * (1 - p))[:, None]).T @ z + penalty * np.eye(len(weights))
        step = np.linalg.solve(curve, z.T @ (y - p) - penalty * weights)
        size = 1.0
        while size > 1e-6 and loss(weights + size * step) > loss(weights):
            size /= 2
        weights = weights + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return Model(
        *dictionaries, mean.tolist(), deviation.tolist(), z.min(axis=0).tolist(),
        z.max(axis=0).tolist(), weights.tolist(),
    )


def learn(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    label: str = "quality", sample: int = LABELLED, sample_bytes: int = LABELLED_BYTES,
) -> Model | None:
    """Built from the first ``sample`` labelled ids of each kind by a hash of ``doc_id``,
    and of their texts, whole, the first that make up ``sample_bytes`` at most: no more
    comes to the driver, however large the tables and whatever repeats in them.

    Rows of the held-out quarter are never used, nor labels that are neither 0 nor 1,
    nor ids with both. Of an id's texts the one with the smallest hash counts; an id
    without a text counts for none.
    """
    id_ = column(doc_id)
    known = labels.where(column(label).isin(0, 1) & id_.isNotNull() & ~fold(id_)).groupBy(id_.alias("d")).agg(
        F.min(column(label)).alias("y"), F.max(column(label)).alias("other")
    ).where("y = other").select("d", "y", F.xxhash64("d").alias("place"))
    kinds = [known.where(F.col("y") == y).orderBy("place", "d").limit(sample) for y in (1, 0)]
    chosen = materialize(kinds[0].union(kinds[1]), "labelled")
    texts = docs.select(id_.alias("d"), column(text).alias("t")).where("t is not null").join(chosen, "d")
    first = texts.groupBy("d", "y", "place").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))
    first = materialize(first.withColumn("bytes", F.octet_length("t")), "labelled-texts")
    within, left = [], {0: sample_bytes, 1: sample_bytes}
    for r in first.drop("t").orderBy("place", "d").collect():  # numbers of twice ``sample`` rows
        if r.bytes <= left[r.y]:
            left[r.y] -= r.bytes
            within.append(r.place)
    found = first.where(F.col("place").isin(within)).collect() if within else []
    found = sorted((r.d, r.y, r.t) for r in found)
    return build(*[[t for _, label_, t in found if label_ == y] for y in (1, 0)])


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model:
            sizes = Sizes(model.good, model.bad)
            mean, deviation, low, high, weights = (np.array(v) for v in model[2:])
        for batch in batches:
            if model:
                x = np.array([sizes.features(t.as_py()) for t in batch["t"]]).reshape(-1, len(mean))
                scores = _chance(np.clip((x - mean) / deviation, low, high), weights)
            else:
                scores = np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "score"],
            )

    return run


def quality_scores(
    docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", cut: float = CUT
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row, from its whole text.

    The score is the calibrated chance of label 1 given the difference of the
    text's compressed sizes under the good and the bad dictionary, over their sum.
    How far the text shrinks at all and its length enter the calibration, since
    they say how much the difference means. Features beyond those of the labelled
    texts count as the outermost of those.

    Null and empty texts are scored as empty. Without a model every score is 0.5.
    Repeated rows get equal results; a null ``doc_id`` is not held out; other
    columns play no part; no row in, no row out.
    """
    rows = docs.select(
        column(doc_id).cast("bigint").alias("doc_id"), fold(column(doc_id)).alias("held_out"), column(text).alias("t")
    )
    scored = rows.mapInArrow(_scored(model), "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
