"""Text forms of durations and times (UTC)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY = 86_400


def duration_text(seconds: Column) -> Column:
    """``H hours, M minutes, S seconds``, rounded down to whole seconds."""
    whole = F.floor(seconds)
    return F.concat(
        F.floor(whole / 3600).cast("string"),
        F.lit(" hours, "),
        (F.floor(whole / 60) % 60).cast("string"),
        F.lit(" minutes, "),
        (whole % 60).cast("string"),
        F.lit(" seconds"),
    )


def _two(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def day_text(epoch: Column) -> Column:
    """``dd.mm.yyyy`` in UTC, whatever the session's time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / DAY).cast("int"))
    parts = [_two(F.dayofmonth(day)), _two(F.month(day)), F.lpad(F.year(day).cast("string"), 4, "0")]
    return F.when(epoch.isNotNull(), F.concat_ws(".", *parts))


def start_text(epoch: Column) -> Column:
    """``dd.mm.yyyy hh:mm:ss`` in UTC."""
    second = F.pmod(epoch, F.lit(DAY))
    clock = [F.floor(second / 3600), F.floor(second / 60) % 60, second % 60]
    text = F.concat(day_text(epoch), F.lit(" "), F.concat_ws(":", *map(_two, clock)))
    return F.when(epoch.isNotNull(), text)


def suite_epoch(suite_uid: Column) -> Column:
    """The epoch seconds after the last underscore of a suite run's name."""
    return F.element_at(F.split(suite_uid, "_"), -1).cast("bigint")
