"""Row numbers and totals within groups that one task could not hold.

A plain ``row_number() over (partition by g)`` sends a whole group to one task.
Here rows are first cut into ranges of the group and the order, numbered within a
range, and the sizes of the ranges before are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallymill.sources.scratch import materialize


def range_positions(
    df: DataFrame,
    order: list[str],
    group: list[str] | None = None,
    number: str = "row_no",
    total: str | None = None,
    attach: DataFrame | None = None,
) -> DataFrame:
    """0-based row number within ``group`` (or overall) by any sortable columns.

    Nulls in ``order`` come first. ``total`` names an optional column with the
    group's row count. The columns of ``attach``, keyed by columns of ``group``,
    come with the ranges' sizes, so that the rows need no second join. Groups
    travel as structs: structs are equal where the same fields are null, so rows
    without a group are numbered like any others.

    Ranges are cut by samples of the rows, so a large group spreads over several
    tasks whatever its ids look like, and only one row per task and group is
    needed to line them up. The ranged rows are written out first: a second
    evaluation might cut elsewhere.
    """
    group = group or []
    key = F.struct(F.struct(*group).alias("g") if group else F.lit(0).alias("g"), "_part")
    ranged = materialize(
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id()),
        "ranged",
    ).withColumn("_share", key)
    whole = Window.partitionBy("_group")
    before = whole.orderBy("_share._part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy("_share")
        .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_size"))
        .withColumn("_group", F.col("_share.g"))
        .select(
            "_share",
            (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
            *([F.sum("_size").over(whole).alias(total)] if total else []),
        )
    )
    added = [total] if total else []
    if attach is not None:
        on = [c for c in group if c in attach.columns]
        kept = [c for c in attach.columns if c not in on]
        named = attach.select(F.struct(*on).alias("_on"), *kept)
        shifts = shifts.withColumn("_on", F.struct(*[F.col(f"_share.g.{c}").alias(c) for c in on]))
        shifts = shifts.join(named, "_on", "left").drop("_on")
        added += kept
    return ranged.join(shifts, "_share").select(
        *df.columns, (F.col("_row") + F.col("_shift")).alias(number), *added
    )


def number_within(
    df: DataFrame,
    group: list[str],
    order: str,
    number: str = "row_no",
    total: str | None = None,
    attach: DataFrame | None = None,
) -> DataFrame:
    """0-based row number within ``group`` by ``order``, unique within a group."""
    return range_positions(df, [order], group, number, total, attach)
