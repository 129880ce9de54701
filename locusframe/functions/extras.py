"""Extras: a map from a key to its distinct values in order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusframe.functions.arrays import joined
from locusframe.schema import EXTRAS

NUMERIC = r"^\+?[0-9]+$"


def empty_extras() -> Column:
    return F.create_map().cast(EXTRAS)


def get_extra(extras: Column, key: str) -> Column:
    return F.try_element_at(extras, F.lit(key))


def first_value(values: Column) -> Column:
    return F.get(values, F.lit(0))


def push(values: Column, value: Column) -> Column:
    """``values`` with one more, unless it is there."""
    return F.when(F.array_contains(values, value), values).otherwise(F.array_append(values, value))


def add_extra(extras: Column, key: str, value: Column) -> Column:
    old = get_extra(extras, key)
    rest = F.map_filter(extras, lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), F.when(old.isNull(), F.array(value)).otherwise(push(old, value))))


def set_extra(extras: Column, key: str, value: Column) -> Column:
    """Replaces whatever the key held."""
    return F.map_concat(F.map_filter(extras, lambda k, _: k != key), F.create_map(F.lit(key), F.array(value)))


def as_scalar(values: Column) -> Column:
    """The value if there is just one."""
    return F.when(F.size(values) == 1, first_value(values))


def as_array(values: Column) -> Column:
    return F.when(F.size(values) != 1, values)


def is_blank(values: Column) -> Column:
    return (F.size(values) == 0) | ((F.size(values) == 1) & (first_value(values) == ""))


def display(values: Column) -> Column:
    return joined(values)


def unnest(extras: Column, delimiter: str) -> Column:
    """All values, cut at the delimiter (a literal; empty: not cut), without empty parts, in order of key."""
    values = F.flatten(F.transform(F.array_sort(F.map_keys(extras)), lambda k: F.element_at(extras, k)))
    if delimiter:
        quoted = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        values = F.flatten(F.transform(values, lambda v: F.split(v, quoted, -1)))
    return F.filter(values, lambda v: v != "")


def allowed(extras: Column, keys: Iterable[str] | None) -> Column:
    if keys is None:
        return extras
    keep = F.array(*[F.lit(k) for k in sorted(keys)]).cast("array<string>")
    return F.map_filter(extras, lambda k, _: F.array_contains(keep, k))


def entries_by_number(extras: Column) -> Column:
    """(n, key, text) of the keys that are numbers, by number."""
    numeric = F.filter(F.map_entries(extras), lambda e: e["key"].rlike(NUMERIC))
    return F.array_sort(F.transform(numeric, lambda e: F.struct(e["key"].cast("decimal(38,0)").alias("n"), e["key"].alias("key"), joined(e["value"]).alias("text"))))


def entries_by_key(extras: Column, numeric: bool = True) -> Column:
    """(key, text) by key; ``numeric`` False leaves out the keys that are numbers."""
    entries = F.map_entries(extras)
    if not numeric:
        entries = F.filter(entries, lambda e: ~e["key"].rlike(NUMERIC))
    return F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), joined(e["value"]).alias("text"))))
