"""Random lines and records against small plain models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from locusframe.functions import attributes
from locusframe.functions import intervals as iv
from locusframe.functions.arrays import let
from locusframe.operators.joins import interval_join
from locusframe.schema import RECORD_DDL
from locusframe.sources import bed
from locusframe.sources.lines import lines_of

NUMBER = re.compile(r"\+?[0-9]+\Z")


def plain_bed6(line):
    """(chrom, start, end, name, strand, whether it is an error), or None for a line that is skipped."""
    t = line.strip(" \t\n\f\r")
    if not t or t.startswith(("#", "track ", "browser ")):
        return None
    f = [x for x in t.split("\t") if x]
    if len(f) < 6:
        return "error"
    number = lambda x: int(x) if NUMBER.match(x) and int(x) < 1 << 63 else None
    score = number(f[4])
    strand = {"+": "+", "-": "-", ".": ".", "?": "."}.get(f[5])
    if number(f[1]) is None or number(f[2]) is None or score is None or score > 1000 or strand is None:
        return "error"
    return f[0], number(f[1]), number(f[2]), f[3], strand


def test_bed6_lines(spark):
    rng = random.Random(1)
    cells = [["chr1", "", "#c", "track x", " chr2 "], ["0", "7", "+9", "-1", "x", "", "9223372036854775808", "007"], ["10", "1 ", "99999999999"], ["n", "", "a b"], ["0", "1000", "1001", "1.0"], ["+", "-", ".", "?", "*", "++"]]
    lines = ["\t".join(rng.choice(c) for c in cells[: rng.choice([6, 6, 6, 4])]) + rng.choice(["", "\tmore", "\r", " "]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line bigint, value string")
    got = {r._line: r for r in bed.from_lines(lines_of(df), 6).collect()}
    for i, line in enumerate(lines, 1):
        expected = plain_bed6(line)
        if expected is None:
            assert i not in got, repr(line)
        elif expected == "error":
            assert got[i]._error, repr(line)
        else:
            r = got[i]
            assert r._error is None and (r.chrom, r.start, r.end, r.name, r.strand) == expected, repr(line)


def plain_tokens(text, sep):
    """Key up to the separator; quoted value, or up to a semicolon; on to after the next semicolon; what is left is a flag."""
    white, out, at = " \t\n\f\r", [], 0
    text = text.rstrip(white)
    while True:
        while at < len(text) and text[at] in white:
            at += 1
        if at >= len(text):
            return out
        cut = text.find(sep, at)
        if cut < 0:
            return [*out, (text[at:], "")]
        key, at = text[at:cut].rstrip(" "), cut + 1
        while at < len(text) and text[at] == " ":
            at += 1
        if text[at : at + 1] == '"':
            end = text.find('"', at + 1)
            end = len(text) if end < 0 else end
            value, at = text[at + 1 : end], end + 1
            at = text.find(";", at)
        else:
            end = text.find(";", at)
            value, at = (text[at:] if end < 0 else text[at:end]).rstrip(" "), end
        out.append((key, value))
        if at < 0:
            return out
        at += 1


@pytest.mark.parametrize("sep", [" ", "="])
def test_attributes(spark, sep):
    rng = random.Random(2)
    parts = ['gene_id', sep, '"', "g1", ";", " ", "; ", "tag", '"a b"', "=", "x;y", ",", sep]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r.t, [tuple(x) for x in r.x]) for r in df.select("t", attributes.tokens(F.col("t"), sep).alias("x")).collect()]
    wrong = [(t, x, plain_tokens(t, sep)) for t, x in got if x != plain_tokens(t, sep)]
    assert not wrong, wrong[:5]


@pytest.mark.parametrize("sep", [" ", "="])
def test_first_value_of_an_attribute(spark, sep):
    rng = random.Random(7)
    parts = ["k", "k", "kk", " ", sep, "=", ";", '"', "x", "\t", "\n", "; k", "k=", 'k "', "\u0001"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for key in ("k", "k k"):
        got = [(r.t, r.x) for r in df.select("t", attributes.first_of(F.col("t"), sep, key).alias("x")).collect()]
        wrong = [(t, x) for t, x in got if x != next((v for k, v in plain_tokens(t, sep) if k == key), None)]
        assert not wrong, wrong[:5]


def plain_features(r):
    blocks = list(zip(r["block_starts"] or [], r["block_ends"] or []))[: r["block_count"] or 0]
    ex = [b for b in blocks if b[0] < b[1]] or [(r["start"], r["end"])]
    introns = [(a[1], b[0]) for a, b in zip(ex, ex[1:]) if a[1] < b[0]]
    ts, te = r["thick_start"], r["thick_end"]
    coding = ts is not None and te is not None and ts < te
    cds = [(max(s, ts), min(e, te)) for s, e in ex if max(s, ts) < min(e, te)] if coding else []
    order = cds[::-1] if r["strand"] == "-" else cds
    phase, used = {}, 0
    for i, (s, e) in enumerate(order):
        phase[len(order) - 1 - i if r["strand"] == "-" else i] = (3 - used % 3) % 3
        used += e - s
    return ex, introns, cds, [(*c, phase[i]) for i, c in enumerate(cds)]


def test_derived_intervals(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        n = rng.randrange(5)
        cuts = sorted(rng.sample(range(200), 2 * n))
        starts, ends = cuts[::2], cuts[1::2]
        if n and rng.random() < 0.3:
            ends[rng.randrange(n)] = starts[rng.randrange(n)]
        thick = rng.choice([(None, None), tuple(sorted(rng.sample(range(200), 2))), (50, 50), (None, 5)])
        rows.append(dict(chrom="c", start=cuts[0] if cuts else 0, end=cuts[-1] if cuts else 9, name="n", strand=rng.choice(["+", "-", ".", None]), thick_start=thick[0], thick_end=thick[1], block_count=rng.choice([n, n, None, n + 1]), block_starts=starts, block_ends=ends, extras={}))
    df = spark.createDataFrame([tuple(r.values()) for r in rows], RECORD_DDL).withColumn("e", iv.exons()).withColumn("c", let(F.col("e"), iv.cds))
    found = df.select("start", "e", iv.introns(F.col("e")).alias("i"), "c", iv.phases(F.col("c")).alias("p")).collect()
    for r, g in zip(rows, found):
        ex, introns, cds, phases = plain_features(r)
        assert ([tuple(x) for x in g.e], [tuple(x) for x in g.i], [tuple(x) for x in g.c], [tuple(x) for x in g.p]) == (ex, introns, cds, phases)


@pytest.mark.parametrize("bin_size", [7, 1000])
def test_interval_join_finds_each_pair_once(spark, bin_size):
    rng = random.Random(bin_size)
    make = lambda: [(rng.choice(["a", "b"]), s := rng.randrange(300), s + rng.randrange(-2, 60), i) for i in range(200)]
    left, right = make(), make()
    frames = [spark.createDataFrame(x, "chrom string, start bigint, end bigint, i int") for x in (left, right)]
    got = sorted((r.i, r.i_r) for r in interval_join(*frames, bin_size=bin_size).collect())
    assert got == sorted((x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] < y[2] and x[2] > y[1])
