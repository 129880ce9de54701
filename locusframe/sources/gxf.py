"""GTF and GFF lines, and the transcripts they make up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import fields as f
from locusframe.functions.arrays import let
from locusframe.functions.attributes import first_of, found_of, to_map, tokens, tokens_of_all, value_of
from locusframe.schema import CHILD_FEATURES, RECORD_COLUMNS, Dialect, FormatError, GroupOptions, dialect
from locusframe.sources.lines import held, not_text, read_lines, skipped_gxf

# The nine columns, and the attributes that name a transcript, in order of preference.
COLUMNS = ("chromosome", "source", "feature", "start", "end", "score", "strand", "phase", "attributes")
NAMES = ("transcript_name", "Name", "gene_name", "transcript_id")


def parse_gxf(lines: DataFrame, kind: str | Dialect, keep_skipped: bool = False) -> DataFrame:
    """A typed row for each data line: chrom, feature, start (0-based), end, strand, attributes (the text), tokens, _error; _raw and the line stay.

    ``keep_skipped`` keeps blank lines and comments too, marked by ``_skipped``; their other columns mean nothing.
    """
    d = kind if isinstance(kind, Dialect) else dialect(kind)
    skipped = skipped_gxf(F.col("_raw"))
    lines = held(lines.select("_file", "_line", "_raw"))
    split = (lines if keep_skipped else lines.filter(~skipped)).withColumn("_f", F.split("_raw", "\t", -1))
    at = lambda i: F.get(F.col("_f"), F.lit(i))
    names = F.array(*[F.lit(c) for c in COLUMNS])
    short = F.when(F.size("_f") < 9, F.concat(F.lit("invalid "), F.get(names, F.size("_f")), F.lit(": missing field")))
    start, end, strand = f.unsigned(at(3), "start"), f.unsigned(at(4), "end"), f.strand(at(6))
    split = split.withColumn("_s", start.value).withColumn("_e", end.value)
    start, end = f.Field(F.col("_s"), f.unread(F.col("_s"), at(3), "start")), f.Field(F.col("_e"), f.unread(F.col("_e"), at(4), "end"))
    order = F.when(end.value < start.value, F.concat(F.lit("invalid coordinates: end ("), end.value.cast("string"), F.lit(") must be >= start ("), start.value.cast("string"), F.lit(")")))
    bare = F.when(f.all_white(at(8)), F.lit("invalid attributes: empty"))
    error = f.first_error(not_text(F.col("_raw")), short, start.error, end.error, order, strand.error, bare)
    return held(split.select("_file", "_line", "_raw", at(0).alias("chrom"), at(2).alias("feature"), F.greatest(start.value - 1, F.lit(0)).alias("start"), end.value.alias("end"), strand.value.alias("strand"), at(8).alias("attributes"), tokens(at(8), d.separator).alias("tokens"), error.alias("_error"), *([skipped.alias("_skipped")] if keep_skipped else [])))


def _lower(feature: Column) -> Column:
    """``feature`` in lower case; the usual ones are told without Spark's slow case mapping."""
    return F.when(feature.isin("transcript", *CHILD_FEATURES), feature).when(feature == "CDS", "cds").otherwise(F.lower(feature))


def keyed(parsed: DataFrame, kind: str | Dialect, options: GroupOptions = GroupOptions()) -> DataFrame:
    """``parsed`` with ``is_parent``, ``kept`` (the feature is asked for), ``key``, the transcript's id (null if there is none), and ``_kind``, the feature in lower case.

    ``_at`` numbers the rows of a task. A filter that names it stays above this
    projection, so that attributes are parsed once and not in the filter as well.
    """
    d = options.resolved(kind if isinstance(kind, Dialect) else dialect(kind))
    parsed, feature = parsed.withColumn("_kind", _lower(F.col("feature"))), F.col("_kind")
    parent = feature == d.parent_feature.lower()
    kept = F.lit(True) if options.child_features is None else parent | feature.isin(*[c.lower() for c in options.child_features])
    id_of = lambda attribute: found_of(F.col("attributes"), d.separator, attribute)
    found = id_of(d.child_attribute)
    found = found if d.parent_attribute == d.child_attribute else F.when(parent, id_of(d.parent_attribute)).otherwise(found)
    parsed = parsed.withColumn("_found", F.when(kept & F.col("_error").isNull(), found))
    return parsed.select("*", parent.alias("is_parent"), kept.alias("kept"), value_of(F.col("_found"), d.separator, d.parent_attribute, d.child_attribute).alias("key"), F.monotonically_increasing_id().alias("_at")).drop("_found")


# What a line that is no exon is to its transcript.
_PARENT, _CDS, _CODON, _OTHER = range(4)


def group(rows: DataFrame, kind: str | Dialect, by: tuple[str, ...] = ("_file", "key"), **more: Column) -> DataFrame:
    """Canonical records of ``keyed`` rows, one for each (file, key), with the first line and the first line that does not fit, and the aggregates in ``more``. Rows without a key go, unless ``by`` names more.

    One shuffle, on the key, after each task has put together the lines of a
    transcript that it holds. A line fits if chromosome and strand are those of the
    first line; others give nothing but the conflict. The span is that of parent
    lines, or else of all; without exons the span is the only block. Coding starts
    at the least CDS start, ends with the CDS last by start (of equal ones the later
    line), and is widened by codons.

    Keys are compared by ``_hash`` first: names of files and transcripts begin
    alike, so that comparing them is slow. Exons and other lines are lists of their
    own, so that most transcripts need no search for exons; a list is looked through
    for lines that do not fit only if its least and greatest places differ. The
    attributes' texts are an aggregate of their own, which goes where no extras are
    asked for.
    """
    d = kind if isinstance(kind, Dialect) else dialect(kind)
    rows = rows.filter("key IS NOT NULL AND _at >= 0") if by == ("_file", "key") else rows
    feature, line = F.col("_kind"), F.col("_line")
    exon = ~F.col("is_parent") & (feature == "exon")
    role = F.when(F.col("is_parent"), _PARENT).when(feature == "cds", _CDS).when(feature.isin("start_codon", "stop_codon"), _CODON).otherwise(_OTHER)
    # The strand is one character, so that this tells the two apart.
    place = F.concat("strand", "chrom").alias("p")
    span = [F.col("start").alias("s"), line.alias("l"), F.col("end").alias("e")]
    merged = rows.withColumn("_hash", F.xxhash64(*by)).groupBy("_hash", *by).agg(
        F.min(F.struct(line.alias("l"), place, F.col("attributes").alias("t"))).alias("_head"),
        F.sort_array(F.collect_list(F.when(exon, F.struct(*span, place)))).alias("_exons"),
        F.sort_array(F.collect_list(F.when(F.coalesce(~exon, F.lit(True)), F.struct(*span, place, role.alias("r"))))).alias("_others"),
        F.sort_array(F.collect_list(F.struct(line.alias("l"), place, F.col("attributes").alias("t")))).alias("_texts"),
        *[c.alias(k) for k, c in more.items()],
    )
    # Texts tell their first place themselves, so that nothing else is gathered where extras alone are asked for.
    first_in = lambda c: F.get("_texts", F.lit(0))["p"] if c == "_texts" else F.col("_head.p")
    first, alike = F.col("_head.p"), lambda c: (F.size(c) == 0) | ((F.array_min(f"{c}.p") == first_in(c)) & (F.array_max(f"{c}.p") == first_in(c)))
    fit = lambda c: F.when(alike(c), F.col(c)).otherwise(F.filter(c, lambda x: x["p"] == first_in(c)))
    unfit = lambda c: F.when(~F.coalesce(alike(c), F.lit(False)), F.array_min(F.filter(c, lambda x: x["p"] != first_in(c))["l"]))
    merged = merged.withColumns({"_exons": fit("_exons"), "_others": fit("_others"), "_texts": fit("_texts"), "conflict_line": F.least(unfit("_exons"), unfit("_others"))})
    of = lambda r: F.filter("_others", lambda x: x["r"] == r)
    merged = merged.withColumns({"_parents": of(_PARENT), "_cds": of(_CDS), "_codons": of(_CODON)})
    ends = lambda least, most, field: least(*[most(f"{c}.{field}") for c in ("_exons", "_others")])
    merged = merged.select(
        "*", F.coalesce(F.array_min("_parents.s"), ends(F.least, F.array_min, "s")).alias("_s"), F.coalesce(F.array_max("_parents.e"), ends(F.greatest, F.array_max, "e")).alias("_e"),
        F.least(F.get("_cds", F.lit(0))["s"], F.array_min("_codons.s")).alias("_low"), F.greatest(F.get("_cds", F.size("_cds") - 1)["e"], F.array_max("_codons.e")).alias("_high"),
    )
    whole, low, high = F.size("_exons") == 0, F.col("_low"), F.col("_high")
    said = F.col("_head.t")
    # A text without the letters of the attribute's name has no such attribute; telling that is cheaper than the pattern.
    name = F.coalesce(*[F.when(said.contains(n), first_of(said, d.separator, n)) for n in NAMES], F.col("key"))
    # A text that was there before adds no value to a key.
    texts = F.array_distinct("_texts.t")
    extras = let(tokens_of_all(texts, d.separator), to_map)
    built = merged.select(
        "_file", "key", F.col("_head.l").alias("_line"), "conflict_line", F.substr(first, F.lit(2)).alias("chrom"), F.col("_s").alias("start"), F.col("_e").alias("end"), name.alias("name"), F.substr(first, F.lit(1), F.lit(1)).alias("strand"),
        F.when(low < high, low).alias("thick_start"), F.when(low < high, high).alias("thick_end"),
        F.when(whole, 1).otherwise(F.size("_exons")).alias("block_count"),
        F.when(whole, F.array("_s")).otherwise(F.col("_exons.s")).alias("block_starts"),
        F.when(whole, F.array("_e")).otherwise(F.col("_exons.e")).alias("block_ends"),
        extras.alias("extras"), *more,
    )
    return built.select(*RECORD_COLUMNS, "key", "_file", "_line", "conflict_line", *more)


def transcripts(lines: DataFrame, kind: str | Dialect, options: GroupOptions = GroupOptions(), strict: bool = False) -> DataFrame:
    """Records of (_file, _line, _raw) lines; ``strict`` makes any bad line or conflict fail the query, as a whole-file reader does."""
    parsed = parse_gxf(lines, kind)
    if strict:
        bad = F.concat(F.lit("line "), F.col("_line").cast("string"), F.lit(": "), F.col("_error"))
        parsed = parsed.filter(F.when(F.col("_error").isNull(), F.lit(True)).otherwise(F.raise_error(bad).cast("boolean")))
    grouped = group(keyed(parsed, kind, options), kind)
    if strict:
        where = F.concat(F.lit("line "), F.col("conflict_line").cast("string"), F.lit(": grouped lines span several chromosomes or strands"))
        grouped = grouped.filter(F.when(F.col("conflict_line").isNull(), F.lit(True)).otherwise(F.raise_error(where).cast("boolean")))
    return grouped


def read_gxf(spark: SparkSession, path: str | list[str], kind: str, options: GroupOptions = GroupOptions(), strict: bool = False, additional_fields: int = 0) -> DataFrame:
    if additional_fields:
        raise FormatError("additional fields are columns of BED lines; GTF and GFF have attributes")
    return transcripts(read_lines(spark, path), kind, options, strict)


def read_gtf(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    return read_gxf(spark, path, "gtf", **options)


def read_gff(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    return read_gxf(spark, path, "gff", **options)


__all__ = ["CHILD_FEATURES", "group", "keyed", "parse_gxf", "read_gff", "read_gtf", "read_gxf", "transcripts"]
