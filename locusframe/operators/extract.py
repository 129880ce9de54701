"""Feature extraction: one BED row for each derived interval of a record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions import intervals as iv
from locusframe.functions.arrays import let
from locusframe.functions.extras import empty_extras
from locusframe.operators.writers import to_bed
from locusframe.schema import FormatError, WriterOptions

WIDTHS = (3, 4, 5, 6, 8, 9)
KINDS = tuple(iv.DERIVED)


def check_type(width: int) -> int:
    if width not in WIDTHS:
        raise FormatError(f"unsupported --type {width}: expected one of {', '.join(map(str, WIDTHS))}")
    return width


def intervals(records: DataFrame, kind: str) -> DataFrame:
    """Records of the derived intervals of ``kind``, in order within a record: they keep chrom, name, strand and extras and have no blocks or coding bounds."""
    if kind not in iv.DERIVED:
        raise FormatError(f"unknown feature {kind!r}: expected one of {', '.join(KINDS)}")
    derived = let(iv.exons(), iv.DERIVED[kind])
    keep = [c for c in ("_file", "_line", "key") if c in records.columns]
    out = records.select("chrom", "name", "strand", "extras", *keep, F.posexplode(derived).alias("interval_no", "_x"))
    none = lambda t: F.lit(None).cast(t)
    return out.select(
        "chrom", F.col("_x.start").alias("start"), F.col("_x.end").alias("end"), "name", "strand", none("bigint").alias("thick_start"), none("bigint").alias("thick_end"),
        none("int").alias("block_count"), none("array<bigint>").alias("block_starts"), none("array<bigint>").alias("block_ends"), "extras", *keep, "interval_no",
    )


def extract(records: DataFrame, kind: str, width: int = 6, additional: tuple[str, ...] = ()) -> DataFrame:
    """One BED line (``value``) for each interval; ``additional`` extras follow as columns, a dot where one is missing."""
    check_type(width)
    cut = intervals(records, kind)
    if not additional:
        cut = cut.withColumn("extras", empty_extras())
    return to_bed(cut, width, WriterOptions(numeric_extras=False, additional=additional))


def counts(records: DataFrame, kind: str) -> DataFrame:
    """records_in and intervals_out of an extraction."""
    n = F.size(let(iv.exons(), iv.DERIVED[kind])).cast("bigint")
    return records.agg(F.count("*").alias("records_in"), F.coalesce(F.sum(n), F.lit(0)).alias("intervals_out"))
