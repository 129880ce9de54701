"""Secret scans: fixed patterns, and sliding-window entropy per character class."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import let, named, unpacked, whole_row

# The base patterns of a scan, with the least number of characters.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: A text without a match of these has no base span of the kind; cheaper than the whole pattern.
_GATES = {"assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}


@dataclass(frozen=True)
class CharClass:
    """Candidates of one character class: ``window`` characters of them with at least ``bits`` of entropy a character are a secret."""

    kind: str
    pattern: str
    alphabet: str
    window: int
    bits: float


CLASSES = (
    CharClass("entropy_hex", r"[0-9A-Fa-f]{24,}", "0123456789abcdefABCDEF", 24, 3.0),
    CharClass("entropy_upper", r"[A-Z0-9]{20,}", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 20, 3.5),
    CharClass("entropy_base64", r"[A-Za-z0-9+/_=-]{24,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 4.0),
)
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))

#: Candidates that match one of these are suppressed: examples, counting alphabets, UUIDs, integrity digests.
ALLOW = (r"(?i)example", r"(?i)abcdefghijkl", r"0123456789", r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", r"(?i)^sha(1|256|384|512)[-_]")
_BLOCK = 256


def prefix_sums(values: Column) -> Column:
    """Sum of the values before each one; blocks keep the work near-linear in long arrays."""
    zero = F.lit(0)
    plus = lambda a, x: a + x
    last = F.floor((F.size(values) - 1) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(zero, last), lambda b: F.aggregate(F.slice(values, b * _BLOCK + 1, _BLOCK), zero, plus))
    bases = let(blocks, lambda s: F.transform(s, lambda _, b: F.aggregate(F.slice(s, F.lit(1), b), zero, plus)))

    def before(base: Column) -> Column:
        return F.transform(values, lambda _, i: F.get(base, F.floor(i / _BLOCK).cast("int")) + F.aggregate(F.slice(values, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK), zero, plus))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(bases, before))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (s, e, m) of the leftmost non-overlapping matches: code points, end exclusive; m is the group's text.

    The pieces between matches give the places: a split and an extraction find the same matches.
    """
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.lit(None)).alias("g"), F.transform(F.split(text, pattern, -1), F.length).alias("gaps"))

    def spans(p: Column) -> Column:
        steps = F.transform(p["m"], lambda m, i: F.length(m) + F.get(p["gaps"], i))

        def placed(st: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(st["before"], i) + F.get(p["gaps"], i)
                return F.struct(start.alias("s"), (start + F.length(m)).alias("e"), (F.get(p["g"], i) if group else m).alias("m"))

            return F.transform(p["m"], one)

        return let(let(steps, lambda s: F.struct(prefix_sums(s).alias("before"))), placed)

    return let(parts, spans)


_NONE = "array<struct<s:int,k:int,e:int>>"


def base_spans(text: Column, kind: str) -> Column:
    """Spans (s, k, e) of one base kind."""
    # A run of hex digits is matched whole or not at all, so asking for 24 at once finds the same spans.
    pattern, group = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX[:-1] + "{24,}", 0)}[kind]
    kept = F.filter(matches(text, pattern, group), lambda x: F.length(x["m"]) >= LEAST[kind])
    spans = F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))
    return F.when(text.rlike(_GATES[kind]), spans).otherwise(F.array().cast(_NONE))


def _hot_window(codes: Column, c: CharClass) -> Column:
    """(first, last) character of the windows of ``c.window`` characters that reach ``c.bits``; null if none does.

    One pass: the counts and the sum of count * log2(count) change by the
    character that enters a window and by the one that leaves it. Counts lie side by
    side in a few numbers, with as many bits each as the window's size takes.
    """
    terms = F.array(*[F.lit(x * math.log2(x) if x else 0.0) for x in range(c.window + 1)])
    term = lambda n: F.get(terms, n)
    most = c.window * (math.log2(c.window) - c.bits) + 1e-9  # of the sum, at c.bits of entropy
    wide = c.window.bit_length()
    each = 62 // wide
    numbers = -(-(len(c.alphabet) + 1) // each)
    # Where a character's count is: which number, and its lowest bit there.
    where = F.array(*[F.struct(F.lit(x // each).alias("number"), F.lit(x % each * wide).alias("shift"), F.lit(1 << (x % each * wide)).cast("long").alias("one")) for x in range(len(c.alphabet) + 1)])
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), numbers).alias("n"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(state: Column, i: Column) -> Column:
        new, old = F.get(codes, i), F.when(i >= c.window, F.get(codes, i - c.window)).otherwise(-1)
        at_new, at_old = F.get(where, new), F.get(where, F.greatest(old, F.lit(0)))
        count = lambda at: F.call_function("shiftright", F.get(state["n"], at["number"]), at["shift"]).bitwiseAND(F.lit((1 << wide) - 1)).cast("int")
        n_new, n_old = count(at_new), count(at_old)
        change = F.when(new == old, 0.0).otherwise(term(n_new + 1) - term(n_new) + F.when(old >= 0, term(n_old - 1) - term(n_old)).otherwise(0.0))
        moved = lambda n, at: n + F.when(at == at_new["number"], at_new["one"]).otherwise(0) - F.when((old >= 0) & (at == at_old["number"]), at_old["one"]).otherwise(0)
        counts = F.when(new == old, state["n"]).otherwise(F.transform(state["n"], moved))
        total = state["sum"] + change
        hot = (i >= c.window - 1) & (total <= most)
        return F.struct(counts.alias("n"), total.alias("sum"), F.when(state["first"].isNull() & hot, i - (c.window - 1)).otherwise(state["first"]).alias("first"), F.when(hot, i + 1).otherwise(state["last"]).alias("last"))

    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def entropy_spans(text: Column, c: CharClass, allow: tuple[str, ...] = ALLOW) -> Column:
    """Spans (s, k, e) of what reaches the class's entropy, in candidates with a letter and a digit that no allow-list pattern matches."""
    candidates = F.filter(matches(text, c.pattern), lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))
    for p in allow:
        candidates = F.filter(candidates, lambda x: ~x["m"].rlike(p))

    def scored(x: Column) -> Column:
        codes = F.transform(F.filter(F.split(x["m"], ""), lambda ch: ch != ""), lambda ch: F.position(ch, F.lit(c.alphabet)))
        hot = let(codes, lambda v: _hot_window(v, c))
        return let(hot, lambda h: F.struct((x["s"] + h["first"]).alias("s"), F.lit(KINDS.index(c.kind)).alias("k"), (x["s"] + h["last"]).alias("e")))

    found = F.filter(F.transform(candidates, scored), lambda x: x["s"].isNotNull())
    return F.when(text.rlike(c.pattern), found).otherwise(F.array().cast(_NONE))


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _with_spans(rows: DataFrame, allow: tuple[str, ...]) -> DataFrame:
    """``rows`` with arrays ``base`` and ``all`` of the spans of their column ``text``."""
    t = F.col("text")
    base = F.sort_array(F.concat(*[base_spans(t, k) for k in LEAST]))
    found = rows.withColumn("base", base).withColumn("more", F.concat(*[entropy_spans(t, c, allow) for c in CLASSES]))
    return found.withColumn("all", F.sort_array(F.concat("base", "more")))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """One row a document: doc_id, and arrays ``base`` and ``all`` of spans (s, k, e).

    s and e are code points of the whole text, e exclusive; k numbers KINDS. ``base``
    holds the spans of the three fixed patterns, ``all`` those and the spans of
    high-entropy windows; both are in order of start, then kind.

    A null text counts as empty and an empty text has no spans; a text of any length
    is one row. Rows are independent: ties, repeated rows and null ids pass through, an
    empty table gives an empty result, and columns that are not named are not read. Only
    DataFrame functions run here; the rows are never shuffled.
    """
    rows = docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    return _with_spans(rows, allow).select("doc_id", "base", "all")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of what ``scan`` returns."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", *[count(k) for k in LEAST], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each run of overlapping ``spans`` (sorted) replaced by ``mark``."""
    kind = "struct<done:array<struct<s:int,e:int>>,s:int,e:int>"
    start = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("done"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"))

    def step(a: Column, x: Column) -> Column:
        apart = F.struct(F.concat(a["done"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e")))).alias("done"), x["s"].alias("s"), x["e"].alias("e"))
        joined = F.struct(a["done"].alias("done"), a["s"].alias("s"), F.greatest(a["e"], x["e"]).alias("e"))
        first = F.struct(a["done"].alias("done"), x["s"].alias("s"), x["e"].alias("e"))
        return F.when(a["s"].isNull(), first).when(x["s"] < a["e"], joined).otherwise(apart).cast(kind)

    merged = F.aggregate(spans, start.cast(kind), step, lambda a: F.concat(a["done"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e")))))

    def cut(m: Column) -> Column:
        piece = lambda x, i: F.concat(F.substring(text, F.when(i == 0, 1).otherwise(F.get(m, i - 1)["e"] + 1), x["s"] - F.when(i == 0, 0).otherwise(F.get(m, i - 1)["e"])), F.lit(mark))
        tail = F.substring(text, F.element_at(m, -1)["e"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(m, piece), ""), tail)

    return F.when(F.size(spans) > 0, let(merged, cut)).otherwise(text)


def without_secrets(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with every span that ``scan`` finds replaced by ``mark``, and the length column, if there is one, set anew where the text changed.

    Null and empty texts stay as they are; a text of any length is one row, and every
    row is one for itself, repeated ones too. An empty table gives an empty result. All
    other columns, of any name, are kept in one struct and come out unchanged.
    """
    text = named(text_col)
    rows = docs.select(whole_row(docs).alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    found = _with_spans(rows, allow).select("row", "text", "all")
    old = F.col("row").getField(text_col)
    changed = F.size("all") > 0
    done = found.select("row", changed.alias("changed"), F.when(changed, redacted(F.col("text"), F.col("all"), mark)).otherwise(old).alias("text"))
    new = {text_col: F.col("text")}
    if length_col in docs.columns:
        kind = docs.select(named(length_col)).schema[0].dataType
        new[length_col] = F.when(F.col("changed"), F.length("text").cast(kind)).otherwise(F.col("row").getField(length_col))
    return unpacked(done, docs, "row", new)
