"""Text expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# A word is a run of letters, digits and underscores of any script.
WORD_BREAK = r"[^\p{L}\p{N}_]+"


def words_of(text: Column) -> Column:
    """Array of lower-case words; may hold empty strings at either end."""
    return F.split(F.lower(text), WORD_BREAK)


def contains_any(text: Column, words: list[str]) -> Column:
    """True where the text contains one of the words, literally."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def contained(text: Column, words: list[str]) -> Column:
    """Array with each contained word, and null in place of the others."""
    return F.array(*[F.when(text.contains(w), F.lit(w)) for w in words])
