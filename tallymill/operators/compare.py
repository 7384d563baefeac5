"""Comparison of two copies of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallymill.sources.scratch import materialize


LEFT, RIGHT = "_left", "_right"
# Parts of a table whose contents are compared by digests before any row is shuffled.
BUCKETS = 1024


def _both(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.withColumns({LEFT: F.lit(1), RIGHT: F.lit(0)}).unionByName(
        right.withColumns({LEFT: F.lit(0), RIGHT: F.lit(1)})
    )


def _bucket(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


HASHES = ("_hash", "_hash2")


def _digest() -> Column:
    """Copies, and sums of the halves of two 64-bit hashes of the rows: the same for the
    same rows in any order, and by no sensible chance for others."""
    halves = [half for h in map(F.col, HASHES) for half in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    return F.struct(F.count(F.lit(1)), *[F.sum(half) for half in halves])


def row_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each distinct row with its number of copies on either side.

    Both sides are read once and meet in one shuffle; copies are counted in each
    task before it, so a row repeated very often costs little.
    """
    return _both(left, right).groupBy(*left.columns).agg(
        F.sum(LEFT).alias(LEFT), F.sum(RIGHT).alias(RIGHT)
    )


def row_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with the surplus of the left side."""
    surplus = F.col(LEFT) - F.col(RIGHT)
    return (
        row_counts(left, right)
        .where(surplus != 0)
        .select(*left.columns, surplus.alias("surplus"))
    )


def _totals(df: DataFrame) -> dict[str, str]:
    """Check to SQL aggregate over the rows of one side.

    Sums are whole numbers, so that row order does not matter.
    """
    totals = {"rows": "sum(1)"}
    for field in df.schema.fields:
        name, col, kind = field.name, f"`{field.name}`", field.dataType
        totals[f"non_null:{name}"] = f"count({col})"
        if isinstance(kind, T.StringType):
            totals[f"chars:{name}"] = f"sum(length({col}))"
        elif isinstance(kind, T.NumericType):
            totals[f"min:{name}"] = f"min({col})"
            totals[f"max:{name}"] = f"max({col})"
        elif isinstance(kind, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            totals[f"days:{name}"] = f"sum(datediff({col}, '1970-01-01'))"
    return totals


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """(check, left_value, right_value, same): one row per check.

    ``only_here`` counts the row copies that the other side lacks; the other
    checks are totals and ranges of each column, null where it has no value.

    One scan of both copies gives totals and a digest per bucket, combined in each task,
    so a shuffle carries a row per bucket and task. Only rows of buckets whose digests
    differ are read again and meet, to be counted one by one; equal copies never do.
    """
    totals = _totals(left)
    sides = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    hashed = sides.withColumns(dict(zip(
        (*HASHES, "_bucket"),
        (F.xxhash64(*left.columns), F.xxhash64(F.lit("again"), *left.columns), _bucket(left.columns)),
    )))
    buckets = hashed.groupBy("_bucket", "_side").agg(
        *[F.expr(sql).alias(f"_{i}") for i, sql in enumerate(totals.values())], _digest().alias("_digest")
    )
    buckets = materialize(buckets, "digests")
    of = lambda side: F.max(F.when(F.col("_side") == side, F.col("_digest")))
    differ = buckets.groupBy("_bucket").agg(of(0).alias("l"), of(1).alias("r")).where("not l <=> r")
    differ = [r[0] for r in differ.select("_bucket").collect()]  # BUCKETS at most
    lacking = differing_rows(left, right, differ) if differ else (0, 0)
    checks = []
    for i, name in enumerate(totals):
        kind = name.split(":")[0]
        whole = kind if kind in ("min", "max") else "sum"
        none = "if(count(1) = 0, null, 0)" if kind in ("rows", "non_null") else "null"
        l, r = (f"coalesce({whole}(if(_side = {side}, _{i}, null)), {none})" for side in (0, 1))
        checks.append(
            f"struct('{name}' as check, double({l}) as left_value, double({r}) as right_value, {l} <=> {r} as same)"
        )
    some = "if(count(1) = 0, null, {}d)"  # of no rows at all there is nothing to say
    checks.append(
        f"""struct('only_here' as check, {some.format(lacking[0])} as left_value,
            {some.format(lacking[1])} as right_value, {lacking == (0, 0)} as same)"""
    )
    return buckets.selectExpr(f"array({', '.join(checks)}) as checks").selectExpr("inline(checks)")


def differing_rows(left: DataFrame, right: DataFrame, buckets: list[int]) -> tuple[int, int]:
    """Row copies of these buckets that the right side lacks, and the left."""
    of = lambda df: df.where(_bucket(left.columns).isin(buckets))
    counted = row_counts(of(left), of(right))
    more = lambda a, b: F.coalesce(F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0))), F.lit(0))
    found = counted.agg(more(LEFT, RIGHT), more(RIGHT, LEFT)).first()
    return found[0], found[1]
