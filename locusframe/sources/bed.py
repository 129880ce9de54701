"""BED lines of 3, 4, 5, 6, 8, 9 or 12 columns, with extra columns, as canonical records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import fields as f
from locusframe.functions.extras import empty_extras
from locusframe.schema import EXTRAS, FormatError, check_width
from locusframe.sources.lines import held, not_text, read_lines, skipped_bed

MODES = ("permissive", "drop", "strict")


def bed_fields(raw: Column) -> Column:
    """Tab-separated fields of the trimmed line; empty ones are dropped."""
    return F.filter(F.split(f.trimmed(raw), "\t", -1), lambda x: x != "")


def parse_bed(lines: DataFrame, width: int, additional_fields: int = 0) -> DataFrame:
    """A typed row for each data line of (_file, _line, _raw): the BED columns, ``extras`` and ``_error``.

    The first wrong field gives the error: in order of columns, but for twelve
    columns the blocks come first. With ``additional_fields`` that many more columns
    must be there and all further ones are kept in ``extras`` under their numbers.
    """
    check_width(width)
    if additional_fields < 0:
        raise FormatError("additional_fields must not be negative")
    split = held(lines.select("_file", "_line", "_raw")).filter(~skipped_bed(F.col("_raw"))).withColumn("_f", bed_fields(F.col("_raw")))
    at = lambda i: F.get(F.col("_f"), F.lit(i))
    need = width + additional_fields
    short = F.when(F.size("_f") < need, F.concat(F.lit("line has "), F.size("_f").cast("string"), F.lit(f" fields, expected {need}")))
    columns: dict[str, Column] = {"chrom": at(0)}
    errors: list[Column] = []

    def take(name: str, field: f.Field) -> None:
        columns[name] = field.value
        errors.append(field.error)

    take("start", f.unsigned(at(1), "chromStart"))
    take("end", f.unsigned(at(2), "chromEnd"))
    if width >= 4:
        columns["name"] = at(3)
    if width >= 5:
        take("score", f.score(at(4)))
    if width >= 6:
        take("strand", f.strand(at(5)))
    if width >= 8:
        take("thick_start", f.unsigned(at(6), "thickStart"))
        take("thick_end", f.unsigned(at(7), "thickEnd"))
    if width >= 9:
        take("item_rgb", f.rgb(at(8)))
    if width == 12:
        split = split.withColumn("_sizes", f.unsigned_list(at(10), "").value).withColumn("_starts", f.unsigned_list(at(11), "").value)
        count, sizes, starts = f.unsigned(at(9), "blockCount", 4294967295), f.unsigned_list(at(10), "blockSizes", F.col("_sizes")), f.unsigned_list(at(11), "blockStarts", F.col("_starts"))
        columns |= {"block_count": count.value, "block_sizes": sizes.value, "relative_starts": starts.value}

        def counted(label: str, values: Column) -> Column:
            return F.when(F.size(values) != count.value, F.concat(F.lit(f"invalid {label}: expected "), count.value.cast("string"), F.lit(" entries, got "), F.size(values).cast("string")))

        errors = [count.error, sizes.error, starts.error, counted("blockSizes", sizes.value), counted("blockStarts", starts.value), *errors]
    extras = empty_extras()
    if additional_fields:
        keys = F.transform(F.sequence(F.lit(width + 1), F.size("_f")), lambda i: i.cast("string"))
        values = F.transform(F.slice("_f", F.lit(width + 1), F.size("_f")), lambda v: F.array(v))
        extras = F.when(short.isNull(), F.map_from_arrays(keys, values).cast(EXTRAS))
    return held(split.select("_file", "_line", "_raw", *[c.alias(k) for k, c in columns.items()], extras.alias("extras"), f.first_error(not_text(F.col("_raw")), short, *errors).alias("_error")))


def canonical(parsed: DataFrame) -> DataFrame:
    """Canonical records of parse_bed's rows: blocks become absolute; score and colour are dropped."""
    have = set(parsed.columns)
    col = lambda c, t: F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c)
    none = F.lit(None).cast("array<bigint>")
    starts, ends = none, none
    if "relative_starts" in have:
        starts = F.transform("relative_starts", lambda x: F.col("start") + x)
        ends = F.zip_with("relative_starts", "block_sizes", lambda s, n: F.col("start") + s + n)
    return parsed.select(
        "chrom", "start", "end", col("name", "string"), col("strand", "string"), col("thick_start", "bigint"), col("thick_end", "bigint"), col("block_count", "int"), starts.alias("block_starts"), ends.alias("block_ends"), "extras", "_file", "_line", "_raw", "_error"
    )


def by_mode(df: DataFrame, mode: str) -> DataFrame:
    """permissive keeps rows with ``_error``; drop leaves them out; strict makes the first one fail the query."""
    if mode not in MODES:
        raise FormatError(f"unknown mode {mode!r}: expected one of {', '.join(MODES)}")
    if mode == "drop":
        return df.filter("_error IS NULL")
    if mode == "strict":
        where = F.concat(F.lit("line "), F.coalesce(F.col("_line").cast("string"), F.lit("?")), F.lit(": "), F.col("_error"))
        return df.filter(F.when(F.col("_error").isNull(), F.lit(True)).otherwise(F.raise_error(where).cast("boolean")))
    return df


def read_bed(spark: SparkSession, path: str | list[str], width: int, additional_fields: int = 0, mode: str = "permissive", numbered: bool = True) -> DataFrame:
    return by_mode(canonical(parse_bed(read_lines(spark, path, numbered), width, additional_fields)), mode)


def from_lines(lines: DataFrame, width: int, additional_fields: int = 0, mode: str = "permissive") -> DataFrame:
    """Records of lines that are in no file (see lines_of), such as a stream's or a pipe's."""
    return by_mode(canonical(parse_bed(lines, width, additional_fields)), mode)
