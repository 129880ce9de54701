"""Fields of text lines: each parser gives a value and, where that is null, a message."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusframe.functions.arrays import let

#: What counts as white space at the ends of lines and fields.
WHITE = " \t\n\f\r"


@dataclass(frozen=True)
class Field:
    """``error`` is null where the text could be read."""

    value: Column
    error: Column


def _any(test: Callable[[str], Column]) -> Column:
    return reduce(lambda a, b: a | b, [test(c) for c in WHITE])


def trimmed(text: Column) -> Column:
    """Without ASCII white space at either end. Most texts have none, and trimming goes over all of a text."""
    return F.when(_any(text.startswith) | _any(text.endswith), F.btrim(text, F.lit(WHITE))).otherwise(text)


def right_trimmed(text: Column) -> Column:
    """Without ASCII white space at the end; attributes mostly end in a semicolon, which one look tells."""
    return F.when(text.endswith(";"), text).when(_any(text.endswith), F.rtrim(text, F.lit(WHITE))).otherwise(text)


def all_white(text: Column) -> Column:
    """Whether there is nothing but ASCII white space; what begins with a later character is not looked at further."""
    return ~(text >= "!") & (right_trimmed(text) == "")


def unsigned(text: Column, label: str, most: int = (1 << 63) - 1) -> Field:
    """Digits with an optional plus sign, no larger than ``most``.

    Spark reads a number with a sign or white space around it as well, and nothing
    else: one that begins and ends with a digit needs no pattern.
    """
    digits = (text >= "0") & (text < ":") & F.lit("0123456789").contains(F.substring(text, -1, 1))
    value = F.when(digits | text.rlike(r"^\+?[0-9]+\z"), text.try_cast("bigint"))
    value = value if most == (1 << 63) - 1 else F.when(value <= most, value)
    return Field(value, unread(value, text, label))


def unread(value: Column, text: Column, label: str) -> Column:
    """The message for a text that ``unsigned`` gave no ``value`` for."""
    return F.when(value.isNull(), F.concat(F.lit(f"invalid {label}: expected unsigned integer, got '"), text, F.lit("'")))


def score(text: Column) -> Field:
    whole = F.when(text.rlike(r"^\+?[0-9]+\z"), text.try_cast("bigint"))
    wrong = F.when(whole.isNull(), F.concat(F.lit("invalid score: expected integer between 0 and 1000, got '"), text, F.lit("'")))
    return Field(F.when(whole <= 1000, whole.cast("int")), wrong.when(whole > 1000, F.concat(F.lit("invalid score: "), whole.cast("string"), F.lit(" exceeds the maximum 1000"))))


def strand(text: Column) -> Field:
    """``+``, ``-`` or ``.``; a question mark is unknown too."""
    value = F.when(text.isin("+", "-", "."), text).when(text == "?", ".")
    return Field(value, F.when(value.isNull(), F.concat(F.lit("invalid strand: expected '+', '-', '.' or '?', got '"), text, F.lit("'"))))


def rgb(text: Column) -> Field:
    """Exactly three numbers of 0 to 255."""
    parts = F.transform(F.split(text, ",", -1), lambda p: F.when(p.rlike(r"^\+?[0-9]+\z"), p.try_cast("int")))
    good = (F.size(parts) == 3) & F.forall(parts, lambda p: F.coalesce(p <= 255, F.lit(False)))
    value = F.when(good, F.struct(*[F.get(parts, i).cast("smallint").alias(c) for i, c in enumerate("rgb")]))
    return Field(value, F.when(~good, F.concat(F.lit("invalid itemRgb: expected three numbers of 0 to 255, got '"), text, F.lit("'"))))


def rgb_text(value: Column) -> Column:
    return F.concat_ws(",", *[value[c].cast("string") for c in "rgb"])


def unsigned_list(text: Column, label: str, read: Column | None = None) -> Field:
    """Comma-separated 32-bit numbers; empty items are passed over. ``read`` is the value, where a column holds it already."""
    items = F.filter(F.split(text, ",", -1), lambda x: x != "")
    numbers = F.transform(items, lambda x: F.when(x.rlike(r"^\+?[0-9]+\z"), x.try_cast("bigint")))
    value = let(numbers, lambda n: F.when(F.forall(n, lambda x: F.coalesce(x <= 4294967295, F.lit(False))), n)) if read is None else read
    return Field(value, F.when(value.isNull(), F.concat(F.lit(f"invalid {label}: expected unsigned integers, got '"), text, F.lit("'"))))


def first_error(*errors: Column) -> Column:
    """The first message in the order given; later fields are not looked at once one is wrong."""
    return F.coalesce(*errors, F.lit(None).cast("string"))
