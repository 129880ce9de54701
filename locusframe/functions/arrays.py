"""Small helpers on arrays and maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusframe.schema import INTERVALS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def no_intervals() -> Column:
    return F.array().cast(INTERVALS)


def interval(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def not_empty(intervals: Column) -> Column:
    return F.filter(intervals, lambda x: x["start"] < x["end"])


def total(intervals: Column) -> Column:
    """Sum of lengths; overlaps count twice, negative lengths as 0."""
    return F.aggregate(intervals, F.lit(0).cast("bigint"), lambda a, x: a + F.greatest(x["end"] - x["start"], F.lit(0)))


def joined(values: Column) -> Column:
    return F.array_join(values, ",")
