"""The training-data pipeline: stages over ``documents``, each written and reread.

Every stage works on all rows that the one before it kept. The first four return
the columns of ``documents``; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymill.llm import decontaminate, linededup, neardup, packing, quality
from tallymill.llm.queries import vocabulary_file
from tallymill.sources.scratch import collecting, materialize, release
from tallymill.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents left without a word."""
    return linededup.drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark items go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes pieces of sequences of at most 1024 tokens."""
    return packing.packed_pieces(docs, vocabulary_file())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

# Components of near copies, tokens and packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is stored before what the stage wrote
    on its way, and the result before it, are freed; only what this run wrote is freed,
    so other results of the session stay readable. A stage that is called by itself
    frees nothing: its result is read later."""
    docs, spent = read_table(spark, sf_dir, "documents"), []
    for _, step in STAGES:
        with collecting() as paths:
            docs = materialize(step(spark, docs, sf_dir), "stage")
        release(spark, (*spent, *paths[:-1]))  # the last path is the stored result
        spent = paths[-1:]
    return docs
