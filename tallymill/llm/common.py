"""Expressions and small plans that several operators share.

Rows are told apart by ``doc_id`` and a hash of the text, so a repeated or null
``doc_id`` does no harm: rows alike in both get the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallymill.sources.scratch import materialize

# White space that parts words: space, and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]"
SPACED_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col(quoted(name))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def spaced_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPACED_WORD), F.lit(0))


def total(numbers: Column, kind: str = "bigint") -> Column:
    return F.aggregate(numbers, F.lit(0).cast(kind), lambda a, x: a + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row. A plain expression, or a
    column that the optimizer folds into its only use, would be worked out again
    for every element where ``body`` uses it within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(lengths: Column) -> Column:
    """The sum before each element, in n * sqrt(n) steps and without copying.

    The array is cut into about sqrt(n) pieces; a sum is that of the pieces
    before, and of the elements before it in its own piece.
    """

    def sums(x: Column) -> Column:
        n = F.size(x)
        step = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
        at = F.sequence(F.lit(0), F.ceil(n / step).cast("int"))
        pieces = F.transform(at, lambda p: total(F.slice(x, p * step + 1, step)))
        before = lambda ps: F.transform(ps, lambda _, p: total(F.slice(ps, F.lit(1), p)))

        def element(b: Column) -> Column:
            piece = lambda i: F.floor(i / step).cast("int")
            return F.transform(
                x, lambda _, i: F.get(b, piece(i)) + total(F.slice(x, piece(i) * step + 1, i % step))
            )

        return let(pieces, lambda ps: let(before(ps), element))

    none = F.array().cast("array<bigint>")
    return F.when(F.size(lengths) > 0, let(lengths, sums)).when(lengths.isNotNull(), none)


def _starry(e: DataFrame) -> bool:
    """Whether every node hangs on one other, and none of those hangs on another."""
    ends = F.array(
        F.struct(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )
    nodes = e.select(F.explode(ends).alias("x")).groupBy("x.node").agg(
        F.sum("x.up").alias("up"), F.max("x.down").alias("down")
    )
    return nodes.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node can reach.

    Nodes without an edge do not appear. Alternates two steps until stars are
    left: every larger neighbour is hung on the smallest neighbour, then every
    node on the smallest of its smaller ones. Each step is a grouped minimum and
    a join, so no group is gathered; rounds grow with the logarithm of the
    longest path. Each round's edges are written, so lost executors cost a round.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    e = materialize(e.where("hi <> lo").distinct(), "edges")
    while not _starry(e):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(
            F.col("v").alias("hi"), F.col("m").alias("lo")
        )
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where("lo <> m").select(
            F.col("lo").alias("hi"), F.col("m").alias("lo")
        )
        e = materialize(small.union(root).distinct(), "edges")
    roots = e.select(F.col("lo").alias("hi"), "lo").distinct()
    return e.union(roots).select(F.col("hi").alias("node"), F.col("lo").alias("component"))
