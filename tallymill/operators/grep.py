"""Search of lines for literal words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallymill.functions.text import contained, contains_any
from tallymill.sources.scratch import materialize

# Characters of a word by which lines are looked up.
GRAM = 3


def grep(df: DataFrame, col: str, words: list[str]) -> DataFrame:
    """One row per (word, line) where the line contains the word, case-sensitively.

    The words are literals of one expression, so a line is looked at where it is
    read and only matching lines are expanded. Works on tables and streams.
    """
    words = list(dict.fromkeys(words))
    if not words:
        return df.select(F.lit("").alias("word"), *df.columns).where(F.lit(False))
    return (
        df.where(contains_any(F.col(col), words))
        .select(F.explode(contained(F.col(col), words)).alias("word"), *df.columns)
        .where(F.col("word").isNotNull())
    )


def _grams(text: Column, length: int) -> Column:
    """The distinct pieces of so many characters, found in one pass over the text."""
    if length == 0:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def word_index(words: DataFrame, word: str = "word") -> DataFrame:
    """(gram, word): each distinct word under that of its grams which the fewest words
    of the list have; a shorter word under itself. Nulls are no words."""
    listed = words.select(F.col(word).alias("word")).where("word is not null").distinct()
    own = F.when(F.char_length("word") < GRAM, F.array("word")).otherwise(_grams(F.col("word"), GRAM))
    grams = materialize(listed.select("word", F.explode(own).alias("gram")), "word-grams")
    held = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(held, "gram").groupBy("word").agg(F.min(F.struct("n", "gram")).alias("x"))
    return materialize(rarest.select("x.gram", "word"), "word-index")


def grep_list(df: DataFrame, col: str, words: DataFrame, word: str = "word") -> DataFrame:
    """``grep`` for a table of words of any length: one row per (word, line).

    The words are indexed by one gram each and the lines' grams probe the index, so a
    line is compared only with words that share a rare piece with it. The index is
    stored, so its size is known: Spark broadcasts it below its threshold, and beyond
    that joins by gram. Gram lengths that no word needs are not made.
    """
    index = word_index(words, word)
    lengths = [r[0] for r in index.select(F.char_length("gram")).distinct().collect()]  # GRAM + 1 at most
    line = F.struct(*df.columns).alias("row")
    if not lengths:
        return df.select(F.lit("").alias("word"), *df.columns).where(F.lit(False))
    grams = F.concat(*[_grams(F.col(col), n) for n in sorted(lengths)])
    probes = df.where(F.col(col).isNotNull()).select(line, F.explode(grams).alias("gram"))
    found = probes.join(index, "gram").where(F.contains(F.col("row")[col], F.col("word")))
    return found.select("word", *[F.col("row")[c].alias(c) for c in df.columns])
