"""Intervals derived from a record's blocks and coding bounds, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.arrays import interval, let, no_intervals, not_empty, total


def exons() -> Column:
    """Non-empty blocks in stored order; the whole record where there is none."""
    starts, ends, count = F.col("block_starts"), F.col("block_ends"), F.col("block_count")
    n = F.least(count, F.size(starts), F.size(ends))
    blocks = F.zip_with(F.slice(starts, F.lit(1), n), F.slice(ends, F.lit(1), n), interval)
    given = F.when((count > 0) & starts.isNotNull() & ends.isNotNull(), not_empty(blocks)).otherwise(no_intervals())
    return let(given, lambda b: F.when(F.size(b) > 0, b).otherwise(F.array(interval(F.col("start"), F.col("end")))))


def introns(ex: Column) -> Column:
    """Gaps between neighbouring exons in stored order."""
    return not_empty(F.transform(F.slice(ex, F.lit(2), F.size(ex)), lambda x, i: interval(F.get(ex, i)["end"], x["start"])))


def _coding() -> Column:
    return F.col("thick_start") < F.col("thick_end")


def cds(ex: Column) -> Column:
    """Exons clipped to the coding bounds; none without bounds."""
    ts, te = F.col("thick_start"), F.col("thick_end")
    clipped = F.transform(ex, lambda x: interval(F.greatest(x["start"], ts), F.least(x["end"], te)))
    return F.when(_coding(), not_empty(clipped)).otherwise(no_intervals())


def before_coding(ex: Column) -> Column:
    return not_empty(F.transform(ex, lambda x: interval(x["start"], F.least(x["end"], F.col("thick_start")))))


def after_coding(ex: Column) -> Column:
    return not_empty(F.transform(ex, lambda x: interval(F.greatest(x["start"], F.col("thick_end")), x["end"])))


def utr(ex: Column) -> Column:
    """What of each exon lies outside the coding bounds, exon by exon; touching is outside."""
    ts, te = F.col("thick_start"), F.col("thick_end")

    def parts(x: Column) -> Column:
        sides = F.array(interval(x["start"], F.least(x["end"], ts)), interval(F.greatest(x["start"], te), x["end"]))
        return F.when((x["end"] <= ts) | (x["start"] >= te), F.array(x)).otherwise(not_empty(sides))

    return F.when(_coding(), F.flatten(F.transform(ex, parts))).otherwise(no_intervals())


def five_prime_utr(ex: Column) -> Column:
    strand = F.col("strand")
    return F.when(_coding() & (strand == "+"), before_coding(ex)).when(_coding() & (strand == "-"), after_coding(ex)).otherwise(no_intervals())


def three_prime_utr(ex: Column) -> Column:
    strand = F.col("strand")
    return F.when(_coding() & (strand == "+"), after_coding(ex)).when(_coding() & (strand == "-"), before_coding(ex)).otherwise(no_intervals())


def _reverse() -> Column:
    return F.coalesce(F.col("strand") == "-", F.lit(False))


def phases(coding: Column) -> Column:
    """The coding intervals with the reading-frame phase of each: bases before it in transcription order decide."""

    def phased(x: Column, i: Column) -> Column:
        earlier = F.when(_reverse(), F.slice(coding, i + 2, F.size(coding))).otherwise(F.slice(coding, F.lit(1), i))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), ((3 - total(earlier) % 3) % 3).cast("int").alias("phase"))

    return F.transform(coding, phased)


def exon_number(i: Column, n: Column) -> Column:
    """1-based number of the i-th (from 0) of n exons, counted from the record's 5' end."""
    return F.when(_reverse(), n - i).otherwise(i + 1)


def numbered_cds(sorted_exons: Column) -> Column:
    """Coding intervals of sorted exons with their exon's number and phase."""
    ts, te = F.col("thick_start"), F.col("thick_end")

    def one(x: Column, i: Column) -> Column:
        return F.struct(F.greatest(x["start"], ts).alias("start"), F.least(x["end"], te).alias("end"), exon_number(i, F.size(sorted_exons)).alias("number"))

    kept = F.filter(F.transform(sorted_exons, one), lambda x: x["start"] < x["end"])

    def with_phase(c: Column) -> Column:
        def phased(x: Column, i: Column) -> Column:
            earlier = F.when(_reverse(), F.slice(c, i + 2, F.size(c))).otherwise(F.slice(c, F.lit(1), i))
            return x.withField("phase", ((3 - total(earlier) % 3) % 3).cast("int"))

        return F.transform(c, phased)

    none = F.array().cast("array<struct<start:bigint,end:bigint,number:int,phase:int>>")
    return F.when(_coding(), let(kept, with_phase)).otherwise(none)


def coding_span(coding: Column) -> Column:
    """(start of the first, end of the last) coding interval; null without any."""
    return F.when(F.size(coding) > 0, interval(F.element_at(coding, 1)["start"], F.element_at(coding, -1)["end"]))


def _low(span: Column) -> Column:
    return F.when(span["start"] < span["end"], interval(span["start"], F.least(span["start"] + 3, span["end"])))


def _high(span: Column) -> Column:
    return F.when(span["start"] < span["end"], interval(F.greatest(span["end"] - 3, F.lit(0), span["start"]), span["end"]))


def start_codon(span: Column) -> Column:
    """The three bases at the 5' end of a span, fewer if it is shorter; no strand counts as forward."""
    return F.when(_reverse(), _high(span)).otherwise(_low(span))


def stop_codon(span: Column) -> Column:
    return F.when(_reverse(), _low(span)).otherwise(_high(span))


def exon_start_codon(coding: Column) -> Column:
    """start_codon within the one coding interval at the 5' end."""
    return F.when(F.size(coding) > 0, F.when(_reverse(), _high(F.element_at(coding, -1))).otherwise(_low(F.element_at(coding, 1))))


def exon_stop_codon(coding: Column) -> Column:
    return F.when(F.size(coding) > 0, F.when(_reverse(), _low(F.element_at(coding, 1))).otherwise(_high(F.element_at(coding, -1))))


def length() -> Column:
    return F.greatest(F.col("end") - F.col("start"), F.lit(0))


def is_empty() -> Column:
    return F.col("start") >= F.col("end")


def overlaps(start: Column, end: Column) -> Column:
    """Whether the record and [start, end) share a base; touching does not count."""
    return (F.col("start") < end) & (F.col("end") > start)


def exon_overlaps(ex: Column, start: Column, end: Column) -> Column:
    return F.exists(ex, lambda x: (x["start"] < end) & (x["end"] > start))


def sorted_exons(ex: Column) -> Column:
    """Exons by start; equal starts stay in stored order."""
    keyed = F.transform(ex, lambda x, i: F.struct(x["start"].alias("s"), i.alias("i"), x["end"].alias("e")))
    return F.transform(F.array_sort(keyed), lambda x: interval(x["s"], x["e"]))


DERIVED = {"exons": lambda ex: ex, "introns": introns, "cds": cds, "utr": utr, "fiveutr": five_prime_utr, "threeutr": three_prime_utr}


def with_measures(records: DataFrame) -> DataFrame:
    """``records`` with exonic, intronic, coding and untranslated lengths and the counts of exons and introns."""
    ex = F.col("_exons")
    df = records.withColumn("_exons", exons())
    return df.select(
        *records.columns,
        total(ex).alias("exonic_length"),
        total(introns(ex)).alias("intronic_length"),
        total(cds(ex)).alias("cds_length"),
        total(utr(ex)).alias("utr_length"),
        F.size(ex).alias("exon_count"),
        (F.size(ex) - 1).alias("intron_count"),
    )
