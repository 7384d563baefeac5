"""Language identification with hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tallymill.llm.common import column

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMENSIONS, GRAM = 512, 3
UNKNOWN = "und"
# Cosines are this many times as far apart in the score.
SHARPNESS = 30.0
# n-gram vectors remembered by a task; forgotten when they are more.
REMEMBERED = 1 << 15
_NOT_LETTERS = re.compile(r"[\W\d_]+")


class Grams:
    """n-gram vectors: the letters' random signs, each rotated by its place, and
    multiplied. Letters are seeded by their code point, so all tasks agree."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        self.index: dict[int, int] = {}
        self.vectors = np.empty((256, self.dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            signs = np.random.Generator(np.random.Philox(key=code)).integers(0, 2, self.dimensions)
            self.letters[code] = (2 * signs - 1).astype(np.float32)
        return self.letters[code]

    def row(self, gram: int) -> int:
        at = self.index.get(gram)
        if at is None:
            at = self.index[gram] = len(self.index)
            if at == len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
            bound = np.ones(self.dimensions, np.float32)
            for place in range(GRAM):
                code = gram >> (21 * (GRAM - 1 - place)) & 0x1FFFFF
                bound *= np.roll(self.letter(code), GRAM - 1 - place)
            self.vectors[at] = bound
        return at

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The sum of the vectors of all n-grams of a text; None without a letter.
        Whatever is no letter counts as one blank between words."""
        spaced = " " + _NOT_LETTERS.sub(" ", (text or "").lower()).strip() + " "
        if len(spaced) < GRAM:
            return None
        codes = np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        grams = sum(codes[i : len(codes) - GRAM + 1 + i] << (21 * (GRAM - 1 - i)) for i in range(GRAM))
        grams, counts = np.unique(grams, return_counts=True)
        if len(self.index) > REMEMBERED:
            self._forget()
        rows = np.fromiter(map(self.row, grams.tolist()), np.int64, len(grams))
        return counts.astype(np.float32) @ self.vectors[rows]


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per language seen by the task: the sum of its documents' vectors,
    each of length one."""
    grams, sums = Grams(), {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["t"]):
            v = grams.bundle(text.as_py())
            if v is not None:
                unit = v.astype(float) / max(float(np.linalg.norm(v)), 1e-9)
                sums[lang] = sums[lang] + unit if lang in sums else unit
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.float64()))],
        ["lang", "v"],
    )


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[float]]:
    """Language -> profile, from all rows with text and language. Tasks bundle
    their own rows; only the profiles, one per language, come to the driver."""
    rows = docs.select(column(lang).alias("lang"), column(text).alias("t")).where("lang is not null and t is not null")
    parts = rows.mapInArrow(_bundled, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    profiles = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return {r.lang: r.v for r in profiles.select("lang", F.col("v.x").alias("v")).orderBy("lang").collect()}


def _compared(profiles: dict[str, list[float]]):
    names = sorted(profiles)
    matrix = np.array([profiles[n] for n in names], np.float32).reshape(len(names), DIMENSIONS)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            langs, scores = [], []
            for text in batch["t"]:
                v = grams.bundle(text.as_py()) if names else None
                if v is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosine = (matrix @ v).astype(float) / max(float(np.linalg.norm(v)), 1e-9)
                best = int(cosine.argmax())
                langs.append(names[best])
                scores.append(float(1 / np.exp(SHARPNESS * (cosine - cosine[best])).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def fold(doc_id: Column) -> Column:
    """True for the quarter of the documents that is held out of training."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(
    docs: DataFrame, profiles: dict[str, list[float]], doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row, from its whole text.

    The n-grams' vectors are bundled and compared with every profile by cosine;
    ``score`` is the share of the best among the exponentials of the cosines.
    Null texts and texts without a letter are 'und' with score 0, as is every text
    if nothing was learned. Ties go to the first language by name. Repeated rows
    get equal results; a null ``doc_id`` is not held out; other columns play no
    part; no row in, no row out.
    """
    rows = docs.select(
        column(doc_id).cast("bigint").alias("doc_id"), fold(column(doc_id)).alias("held_out"), column(text).alias("t")
    )
    return rows.mapInArrow(_compared(profiles), "doc_id bigint, held_out boolean, lang_pred string, score double")
