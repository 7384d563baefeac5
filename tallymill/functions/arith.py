"""Deterministic integer pseudo-randomness.

Generated data must not depend on how many tasks make it, nor on which task is
retried after a lost executor. ``rand(seed)`` depends on the partition number;
the functions here depend only on the row id, so the same row is always the
same, at any parallelism. All intermediate values stay below 2**63.

Rows and items are given as SQL text naming non-negative bigint columns.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PRIME = 2147483647  # 2**31 - 1
ROW_STEP = 48271
HIGH_STEP = 69621
ITEM_STEP = 16807
SALT_STEP = 271828183


def _scatter(row: str, item: str, salt: int) -> str:
    x = (
        f"((({row} & {PRIME}L) * {ROW_STEP} + shiftright({row}, 31) * {HIGH_STEP}"
        f" + {item} * {ITEM_STEP} + {salt * SALT_STEP % PRIME}L) % {PRIME})"
    )
    x2 = f"({x} * {x} % {PRIME})"
    return f"({x2} * {x2} % {PRIME} * {x} % {PRIME})"


def scatter(row: str, item: str | int = 0, salt: int = 0) -> Column:
    """A value in [0, PRIME) for (row, item, salt).

    The three are mixed linearly, then raised to the fifth power modulo PRIME.
    Five is coprime to PRIME - 1, so the power is a permutation.
    """
    return F.expr(_scatter(row, f"{item}", salt))


def near_normal(row: str, item: str | int = 0, salt: int = 0) -> Column:
    """Mean 0, variance 1: twelve uniforms added up, minus six."""
    total = " + ".join(_scatter(row, f"{item}", salt + k) for k in range(12))
    return F.expr(f"({total}) / {float(PRIME)}D - 6.0D")
