"""The attribute column of GTF and GFF lines."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusframe.functions.arrays import let
from locusframe.functions.fields import right_trimmed

# Fixed value: one attribute, with SEP standing for the dialect's separator. Groups: key, quoted value, bare value, flag at the end.
GRAMMAR = r'[ \t\n\f\r]*(?:([^SEP]*?) *SEP *(?:"([^"]*)(?:"[^;]*(?:;|\z)|\z)|(?!")([^;]*?) *(?:;|\z))|([^SEP]+)\z)'


#: Marks between the parts of an attribute, its ends, and what cannot be in a text that takes the quick way.
_PART, _OPEN, _CLOSE = "\u0001", "\u0002", "\u0003"


def tokens(text: Column, separator: str) -> Column:
    """(k, v) of each attribute in order; an empty array where there is none.

    A key reaches to the separator; its value is quoted, or ends at a semicolon and
    is trimmed. What follows the last separator is a flag with an empty value.
    Nothing is percent-decoded or cut at commas.

    One pass of the pattern marks the parts of all attributes, which are then cut
    at the marks; a text that holds such marks itself is matched part by part.
    """
    pattern = GRAMMAR.replace("SEP", separator)
    tail = right_trimmed(text)
    return F.when(text.rlike(f"[{_PART}-{_CLOSE}]"), _matched(tail, pattern)).otherwise(_marked(tail, pattern))


def tokens_of_all(texts: Column, separator: str) -> Column:
    """(k, v) of the attributes of all texts in order. One that is written alike in several texts is there once at most."""
    pattern = GRAMMAR.replace("SEP", separator)
    pieces = F.array_distinct(F.flatten(F.transform(texts, lambda t: _pieces(right_trimmed(t), pattern))))
    return F.when(F.exists(texts, lambda t: t.rlike(f"[{_PART}-{_CLOSE}]")), F.flatten(F.transform(texts, lambda t: tokens(t, separator)))).otherwise(_cut(pieces))


def _marked(tail: Column, pattern: str) -> Column:
    return _cut(_pieces(tail, pattern))


def _pieces(tail: Column, pattern: str) -> Column:
    return F.split(F.regexp_replace(tail, pattern, f"{_OPEN}$1{_PART}$2$3{_PART}$4{_PART}$0{_CLOSE}"), _CLOSE, -1)


def _cut(pieces: Column) -> Column:
    parts = F.transform(pieces, lambda p: F.split(F.substring_index(p, _OPEN, -1), _PART, -1))
    found = F.filter(parts, lambda a: (F.size(a) == 4) & (F.get(a, F.lit(3)) != ""))
    at = lambda a, i: F.get(a, F.lit(i))
    return F.transform(found, lambda a: F.struct(F.when(at(a, 2) != "", at(a, 2)).otherwise(at(a, 0)).alias("k"), at(a, 1).alias("v")))


def _matched(tail: Column, pattern: str) -> Column:
    found = F.filter(F.regexp_extract_all(tail, F.lit(pattern), F.lit(0)), lambda t: t != "")

    def parsed(t: Column) -> Column:
        part = lambda g: F.regexp_extract(t, pattern, g)
        flag = part(4)
        return F.when(flag != "", F.struct(flag.alias("k"), F.lit("").alias("v"))).otherwise(F.struct(part(1).alias("k"), F.concat(part(2), part(3)).alias("v")))

    return F.transform(found, parsed)


# Fixed value: one attribute with a separator, however it ends; it cannot match in two ways.
_PASSED = r'[ \t\n\f\r]*+[^SEP]*+SEP *+(?:"[^"]*+(?:"[^;]*+(?:;|\z)|\z)|[^;]*+(?:;|\z))'


# Fixed value: keys that the pattern looks for; others are looked up among all attributes.
_PLAIN = re.compile(r"[A-Za-z0-9_.-]+")


def found_of(text: Column, separator: str, key: str) -> Column:
    """The first attribute with this key, from the last character of the key on; empty without it.

    One pass of a pattern over the attributes up to that one; the others are not built.
    To be kept in a column for ``value_of``, which names it several times.
    """
    if not _PLAIN.fullmatch(key):
        value = F.get(F.filter(tokens(text, separator), lambda t: t["k"] == key), F.lit(0))["v"]
        return F.coalesce(F.concat(F.lit(f'_{separator}"'), value), F.lit(""))
    pattern = rf'\A(?>{_PASSED})*?[ \t\n\f\r]*+{re.escape(key[:-1])}({re.escape(key[-1])}(?: *?SEP *+(?:"[^"]*+|[^;]*+)|\z))'.replace("SEP", separator)
    return F.regexp_extract(right_trimmed(text), pattern, 1)


def value_of(found: Column, separator: str, *keys: str) -> Column:
    """The value in what ``found_of`` gave; null where that is empty. If ``keys`` are those that it looked for, one look tells a quoted value."""
    marks = sorted({f'{key[-1] if _PLAIN.fullmatch(key) else "_"}{separator}"' for key in keys})
    rest = F.ltrim(F.substr(found, F.lit(2)))
    value = rest if separator == " " else F.ltrim(F.substr(rest, F.lit(len(separator) + 1)))
    value = F.when(found != "", F.when(value.startswith('"'), F.substr(value, F.lit(2))).otherwise(F.rtrim(value)))
    return F.when(reduce(or_, map(found.startswith, marks)), F.substr(found, F.lit(len(separator) + 3))).otherwise(value) if marks else value


def first_of(text: Column, separator: str, key: str) -> Column:
    """The value of the first of ``tokens(text, separator)`` with this key; null without it."""
    return let(found_of(text, separator, key), lambda found: value_of(found, separator, key))


def to_map(pairs: Column) -> Column:
    """Distinct values of each key, in order."""
    keys = F.array_distinct(F.transform(pairs, lambda t: t["k"]))
    values = lambda ks: F.transform(ks, lambda k: F.array_distinct(F.transform(F.filter(pairs, lambda t: t["k"] == k), lambda t: t["v"])))
    return let(keys, lambda ks: F.map_from_arrays(ks, values(ks)))
