"""Lint and prune: rules on records, diagnostics, counts, and the lines that stay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.schema import Dialect, FormatError, GroupOptions
from locusframe.sources import gxf
from locusframe.sources.bed import canonical, parse_bed
from locusframe.sources.lines import held


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# The rules' messages, in the order in which they are reported.
def _bounds_rules() -> list[Column]:
    start, end, ts, te = (F.col(c) for c in ("start", "end", "thick_start", "thick_end"))
    out = lambda x: (x < start) | (x > end)
    return [
        F.when(F.col("chrom") == "", F.lit("chrom must not be empty")),
        F.when(start >= end, _say("start (", start, ") must be less than end (", end, ")")),
        F.when(ts > te, _say("thick_start (", ts, ") must be <= thick_end (", te, ")")),
        F.when(out(ts), _say("thick_start (", ts, ") must be inside transcript bounds ", start, "..", end)),
        F.when(out(te), _say("thick_end (", te, ") must be inside transcript bounds ", start, "..", end)),
    ]


def _block_rules() -> Column:
    """Messages on the blocks; a missing list or a count of zero ends the checks."""
    start, end = F.col("start"), F.col("end")
    count, starts, ends = F.col("block_count"), F.col("block_starts"), F.col("block_ends")
    differs = lambda name, values: F.when(F.size(values) != count, _say("block_count (", count, f") must match {name} length (", F.size(values), ")"))
    n = F.least(F.size(starts), F.size(ends))

    def block(i: Column) -> Column:
        s, e, last = F.get(starts, i), F.get(ends, i), F.when(i > 0, F.get(ends, i - 1))
        no = i + 1
        return F.array(
            F.when(s >= e, _say("block ", no, " start (", s, ") must be less than end (", e, ")")),
            F.when((s < start) | (e > end), _say("block ", no, " bounds ", s, "..", e, " must be inside transcript bounds ", start, "..", end)),
            F.when(s < last, _say("block ", no, " starts before the previous block ends (", s, " < ", last, ")")),
        )

    each = F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), block))).otherwise(F.array().cast("array<string>"))
    lengths = F.array(differs("block_starts", starts), differs("block_ends", ends))
    one = lambda text: F.array(F.lit(text))
    return (
        F.when(count.isNull() & (starts.isNotNull() | ends.isNotNull()), one("block_count is missing while block coordinates are present"))
        .when(count.isNull(), F.array().cast("array<string>"))
        .when(starts.isNull(), one("block_starts are missing while block_count is present"))
        .when(ends.isNull(), one("block_ends are missing while block_count is present"))
        .when(count == 0, F.concat(lengths, one("block_count must be greater than 0")))
        .otherwise(F.concat(lengths, each))
    )


def _sound() -> Column:
    """True only where no rule is broken; false or null where one may be."""
    start, end, ts, te = (F.col(c) for c in ("start", "end", "thick_start", "thick_end"))
    count, starts, ends = F.col("block_count"), F.col("block_starts"), F.col("block_ends")
    inside = lambda x: x.isNull() | ((x >= start) & (x <= end))
    spans = F.forall(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: (x["s"] < x["e"]) & (x["s"] >= start) & (x["e"] <= end))
    later = F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(0)))
    apart = F.forall(F.zip_with(later, ends, lambda s, e: s.isNull() | (s >= e)), lambda ok: ok)
    return (F.col("chrom") != "") & (start < end) & inside(ts) & inside(te) & (ts.isNull() | te.isNull() | (ts <= te)) & (count > 0) & (F.size(starts) == count) & (F.size(ends) == count) & spans & apart


def messages() -> Column:
    """Array of all rules' messages that a record breaks; empty for a valid one, for which none is made."""
    return F.when(_sound(), F.array().cast("array<string>")).otherwise(F.filter(F.concat(F.array(*_bounds_rules()), _block_rules()), lambda m: m.isNotNull()))


def validate(records: DataFrame) -> DataFrame:
    """``records`` with ``diagnostics``, an array of messages."""
    return records.withColumn("diagnostics", messages())


def diagnosed_bed(lines: DataFrame, width: int, additional_fields: int = 0) -> DataFrame:
    """A row for each record line with ``diagnostics``: its parse error, or the rules it breaks."""
    read = canonical(parse_bed(lines, width, additional_fields))
    return read.withColumn("diagnostics", F.when(F.col("_error").isNotNull(), F.array("_error")).otherwise(messages()))


@dataclass(frozen=True)
class GxfLint:
    """``groups``: a row for each transcript, stray bad line and preserved line (comment or blank), with
    ``diagnostics`` and its ``lines``, (line, text) in order."""

    groups: DataFrame

    @property
    def records(self) -> DataFrame:
        """A row for each transcript or stray bad line, with ``diagnostics``; ``key`` is null for the latter."""
        return self.groups.filter("NOT _skipped").select("_file", "_line", "key", "diagnostics")

    @property
    def valid(self) -> DataFrame:
        return self.groups.filter("key IS NOT NULL AND size(diagnostics) = 0")

    @property
    def kept(self) -> DataFrame:
        """(_file, _line, value) of preserved lines and of valid transcripts' lines."""
        stays = self.groups.filter("_skipped OR (key IS NOT NULL AND size(diagnostics) = 0)")
        return stays.select("_file", F.explode("lines").alias("x")).select("_file", "x.*")


def diagnosed_gxf(lines: DataFrame, kind: str | Dialect, options: GroupOptions = GroupOptions()) -> GxfLint:
    """A line that cannot be parsed is an invalid record of its own; one that does not fit its transcript makes that one invalid, which is then held against no rule.

    Lines are read and parsed once and shuffled once, by transcript; preserved and
    stray lines are groups of one line, so none gathers with others. Lines that
    belong to no transcript and are not bad go. A transcript's lines are held in one
    row where they are asked for.
    """
    by = ("_file", "key", "_own")
    rows = gxf.keyed(gxf.parse_gxf(lines, kind, keep_skipped=True), kind, options)
    rows = rows.withColumn("key", F.when(~F.col("_skipped"), F.col("key"))).filter("_at >= 0 AND (_skipped OR key IS NOT NULL OR _error IS NOT NULL)")
    rows = rows.withColumn("_own", F.when(F.col("key").isNull(), F.col("_line")))
    text = F.struct("_line", F.col("_raw").alias("value"))
    built = gxf.group(rows, kind, by, _skipped=F.bool_or("_skipped"), _stray=F.min("_error"), lines=F.sort_array(F.collect_list(text)))
    said = (
        F.when(F.col("_skipped"), F.array().cast("array<string>"))
        .when(F.col("key").isNull(), F.array("_stray"))
        .when(F.col("conflict_line").isNotNull(), F.array(_say("grouped lines span several chromosomes or strands at line ", F.col("conflict_line"))))
        .otherwise(messages())
    )
    return GxfLint(held(built.select("_file", "_line", "key", "_skipped", said.alias("diagnostics"), "lines")))


def summary(diagnosed: DataFrame, name: str) -> DataFrame:
    """format, records, valid, invalid."""
    bad = F.size("diagnostics") > 0
    return diagnosed.agg(F.lit(name).alias("format"), F.count("*").alias("records"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid")).select("format", "records", "valid", "invalid")


def whole_file_summary(diagnosed: DataFrame, name: str) -> DataFrame:
    """As ``summary``, but one line that cannot be read, or does not fit, makes the file one invalid record."""
    bad = F.size("diagnostics") > 0
    fatal = F.count_if(F.col("key").isNull() | F.exists("diagnostics", lambda m: m.startswith("grouped lines")))
    counts = diagnosed.agg(F.count("*").alias("records"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid"), fatal.alias("_n"))
    pick = lambda c, one: F.when(F.col("_n") > 0, F.lit(one).cast("bigint")).otherwise(F.col(c)).alias(c)
    return counts.select(F.lit(name).alias("format"), pick("records", 1), pick("valid", 0), pick("invalid", 1))


def diagnostics(diagnosed: DataFrame) -> DataFrame:
    """(_file, line, message, text), one row a message; the text is that of a report."""
    rows = diagnosed.select("_file", F.col("_line").alias("line"), F.explode("diagnostics").alias("message"))
    return rows.withColumn("text", F.when(F.col("line").isNull(), F.col("message")).otherwise(_say("line ", F.col("line"), ": ", F.col("message"))))


def prune_bed(lines: DataFrame, width: int, additional_fields: int = 0) -> DataFrame:
    """(_file, _line, value): the original lines of valid records; comments and blank lines go."""
    return diagnosed_bed(lines, width, additional_fields).filter(F.size("diagnostics") == 0).select("_file", "_line", F.col("_raw").alias("value"))


def prune_gxf(lines: DataFrame, kind: str | Dialect, options: GroupOptions = GroupOptions()) -> DataFrame:
    """(_file, _line, value): comments, blank lines and the lines of valid transcripts, to be put in order of _line."""
    return diagnosed_gxf(lines, kind, options).kept


def reject_additional_fields(additional_fields: int | None, name: str) -> None:
    if additional_fields and name != "BED":
        raise FormatError(f"--additional-fields/-a is only supported for BED input; detected {name}")
