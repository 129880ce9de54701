"""Records as text: BED, GTF and GFF lines, transcript-table lines, and their sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions import intervals as iv
from locusframe.functions.arrays import let
from locusframe.functions.extras import allowed, entries_by_key, entries_by_number, first_value, get_extra
from locusframe.schema import FormatError, WriterOptions, check_width, dialect
from locusframe.shipping import ship

CODECS = {"gz": "gzip", "bz2": "bzip2"}


def _text(c: Column) -> Column:
    return c.cast("string")


def strand_text() -> Column:
    return F.coalesce(F.when(F.col("strand").isin("+", "-"), F.col("strand")), F.lit("."))


def _bed_core(width: int, rgb: Column) -> list[Column]:
    """The columns of a BED line; the exons of a twelve-column one are in order of start."""
    start, end = F.col("start"), F.col("end")
    columns = [F.col("chrom"), _text(start), _text(end)]
    if width >= 4:
        columns.append(F.coalesce("name", F.lit(".")))
    if width >= 5:
        columns.append(F.lit("0"))
    if width >= 6:
        columns.append(strand_text())
    if width >= 8:
        columns += [_text(F.coalesce("thick_start", start)), _text(F.coalesce("thick_end", end))]
    if width >= 9:
        columns.append(rgb)
    if width == 12:
        listed = lambda ex, of: F.concat(F.array_join(F.transform(ex, lambda x: _text(F.greatest(of(x), F.lit(0)))), ","), F.lit(","))
        blocks = lambda ex: F.concat_ws("\t", _text(F.size(ex)), listed(ex, lambda x: x["end"] - x["start"]), listed(ex, lambda x: x["start"] - start))
        columns.append(let(iv.sorted_exons(iv.exons()), blocks))
    return columns


def bed_line(width: int, options: WriterOptions = WriterOptions()) -> Column:
    """A BED line with the extras that the options let through: numbered ones by number, then ``key=value`` by key; no colour is kept."""
    check_width(width)
    extras = allowed(F.col("extras"), options.allow)
    parts = _bed_core(width, F.lit("0,0,0"))
    if options.numeric_extras:
        parts.append(F.transform(entries_by_number(extras), lambda e: e["text"]))
    if options.other_extras:
        parts.append(F.transform(entries_by_key(extras, numeric=False), lambda e: F.concat(e["key"], F.lit("="), e["text"])))
    if options.additional:
        parts.append(F.array(*[F.coalesce(F.array_join(get_extra(F.col("extras"), k), ","), F.lit(".")) for k in options.additional]))
    return F.concat_ws("\t", *parts)


def bed_text(width: int, additional_fields: int = 0) -> Column:
    """A BED line with the record's own colour and the extras numbered width + 1 and on; a missing one fails the query."""
    check_width(width)
    rgb = F.coalesce(first_value(get_extra(F.col("extras"), "rgb")), F.lit("0,0,0"))
    parts = _bed_core(width, rgb)
    for i in range(width + 1, width + additional_fields + 1):
        value = F.array_join(get_extra(F.col("extras"), str(i)), ",")
        parts.append(F.when(value.isNull(), F.raise_error(F.lit(f"missing additional BED field key '{i}'")).cast("string")).otherwise(value))
    return F.concat_ws("\t", *parts)


def _pair(key, value) -> Column:
    return F.struct(F.lit(key).alias("key") if isinstance(key, str) else key.alias("key"), value.alias("text"))


def _rendered(kind: str, pairs: Column) -> Column:
    """``key "value"; ...`` for GTF, ``key=value;...`` for GFF; each ends in a semicolon."""
    if kind == "gtf":
        return F.concat(F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit(' "'), p["text"], F.lit('"'))), "; "), F.lit(";"))
    return F.concat(F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["text"])), ";"), F.lit(";"))


def attribute_text(kind: str, options: WriterOptions = WriterOptions()) -> Column:
    """Attributes of every line of a record: gene and transcript ids first, then the extras by key.

    GTF leaves out the extras that give the ids; GFF leaves out ID and Parent only.
    """
    dialect(kind)
    extras, gtf = F.col("extras"), kind == "gtf"
    transcript = F.coalesce(first_value(get_extra(extras, "transcript_id" if gtf else "ID")), F.col("name"), F.lit("."))
    gene = F.coalesce(first_value(get_extra(extras, "gene_id")), transcript)
    ids = [("gene_id", gene), ("transcript_id", transcript), *([] if gtf else [("ID", transcript)])]
    ids = [_pair(k, v) for k, v in ids if options.allow is None or k in options.allow]
    out = ("gene_id", "transcript_id") if gtf else ("ID", "Parent")
    rest = F.filter(entries_by_key(allowed(extras, options.allow)), lambda e: ~e["key"].isin(*out))
    pairs = F.concat(F.array(*ids), rest) if ids else rest
    return _rendered(kind, pairs)


def _row(feature, start: Column, end: Column, phase: Column | None, attributes: Column) -> Column:
    kind = F.lit(feature) if isinstance(feature, str) else feature
    return F.struct(kind.alias("feature"), start.alias("start"), end.alias("end"), (F.lit(".") if phase is None else _text(phase)).alias("phase"), attributes.alias("attributes"))


_NO_ROWS = "array<struct<feature:string,start:bigint,end:bigint,phase:string,attributes:string>>"


def _optional(span: Column, row) -> Column:
    return F.when(span.isNotNull(), F.array(row(span))).otherwise(F.array().cast(_NO_ROWS))


def _lines(rows: Column, source: str) -> Column:
    """Nine-column lines with 1-based starts."""
    return F.transform(rows, lambda r: F.concat_ws("\t", F.col("chrom"), F.lit(source), r["feature"], _text(r["start"] + 1), _text(r["end"]), F.lit("."), strand_text(), r["phase"], r["attributes"]))


def gxf_lines(kind: str, options: WriterOptions = WriterOptions()) -> Column:
    """Array of a record's lines: transcript (GFF: mRNA), exons, coding intervals with phases, start and stop codon.

    All lines have the same attributes; there is no gene line, and codons lie on the coding span.
    """
    kind = kind.lower()

    def build(p: Column) -> Column:
        ex, coding, attributes = p["ex"], p["coding"], p["attributes"]
        span = iv.coding_span(coding)
        head = F.array(_row("transcript" if kind == "gtf" else "mRNA", F.col("start"), F.col("end"), None, attributes))
        body = [
            F.transform(ex, lambda x: _row("exon", x["start"], x["end"], None, attributes)),
            F.transform(iv.phases(coding), lambda x: _row("CDS", x["start"], x["end"], x["phase"], attributes)),
            *[_optional(c, lambda s, f=f: _row(f, s["start"], s["end"], None, attributes)) for f, c in (("start_codon", iv.start_codon(span)), ("stop_codon", iv.stop_codon(span)))],
        ]
        return F.concat(head, *body)

    parts = let(iv.exons(), lambda e: F.struct(iv.sorted_exons(e).alias("ex"), iv.cds(e).alias("coding"), attribute_text(kind, options).alias("attributes")))
    return _lines(let(parts, build), options.source)


def gxf_text(kind: str, additional_fields: int = 0, gene: Column | None = None, source: str = "locusframe") -> Column:
    """Array of a record's lines with a gene line and exon numbers: gene, transcript, exons, coding intervals, codons.

    ``gene`` is the looked-up gene of the record's name, null where there is none:
    the transcript's id is used then. Codons lie in one coding interval each. The
    first ``additional_fields`` numbered extras go on every line; too few fail the query.
    """
    kind = kind.lower()
    dialect(kind)
    extras, gtf = F.col("extras"), kind == "gtf"
    transcript = F.coalesce(first_value(get_extra(extras, "transcript_id")), first_value(get_extra(extras, "ID")), F.col("name"), F.lit("."))
    gene_id = F.coalesce(gene, transcript) if gene is not None else transcript
    more = F.transform(F.slice(entries_by_number(extras), 1, additional_fields), lambda e: _pair(e["key"], e["text"]))
    if additional_fields:
        few = F.concat(F.lit(f"missing numeric GXF additional fields: requested {additional_fields}, found "), _text(F.size(more)))
        more = F.when(F.size(more) < additional_fields, F.raise_error(few).cast("array<struct<key:string,text:string>>")).otherwise(more)
    middle, after, between = (' "', '"', "; ") if gtf else ("=", "", ";")
    tail = F.concat(F.array_join(F.transform(more, lambda e: F.concat(F.lit(between), e["key"], F.lit(middle), e["text"], F.lit(after))), ""), F.lit(";")) if additional_fields else F.lit(";")

    def attributes(p: Column, level: str, number: Column | None = None) -> Column:
        g, t = p["gene"], p["transcript"]
        if gtf:
            pairs = [("gene_id", g)] if level == "gene" else [("gene_id", g), ("transcript_id", t)]
        else:
            pairs = {"gene": [("ID", g)], "transcript": [("ID", t), ("Parent", g)], "child": [("Parent", t)]}[level]
        if number is not None:
            pairs.append(("exon_number", _text(number)))
        parts = [c for i, (k, v) in enumerate(pairs) for c in (F.lit(f"{after + between if i else ''}{k}{middle}"), v)]
        return F.concat(*parts, F.lit(after), p["more"])

    def build(p: Column) -> Column:
        ex, coding = p["ex"], p["coding"]
        child = lambda f, x, phase=None: _row(f, x["start"], x["end"], phase, attributes(p, "child", x["number"]))
        numbered = F.transform(ex, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), iv.exon_number(i, F.size(ex)).alias("number")))
        first, last = F.element_at(coding, 1), F.element_at(coding, -1)
        five, three = F.when(F.col("strand") == "-", last).otherwise(first), F.when(F.col("strand") == "-", first).otherwise(last)
        span = lambda codon, of: F.when(codon.isNotNull(), F.struct(codon["start"].alias("start"), codon["end"].alias("end"), of["number"].alias("number")))
        coded = F.size(coding) > 0
        codons = [("start_codon", F.when(coded, span(iv.exon_start_codon(coding), five))), ("stop_codon", F.when(coded, span(iv.exon_stop_codon(coding), three)))]
        head = [_row("gene", F.col("start"), F.col("end"), None, attributes(p, "gene")), _row("transcript" if gtf else "mRNA", F.col("start"), F.col("end"), None, attributes(p, "transcript"))]
        return F.concat(F.array(*head), F.transform(numbered, lambda x: child("exon", x)), F.transform(coding, lambda x: child("CDS", x, x["phase"])), *[_optional(c, lambda s, f=f: child(f, s)) for f, c in codons])

    parts = let(iv.sorted_exons(iv.exons()), lambda e: F.struct(e.alias("ex"), iv.numbered_cds(e).alias("coding"), transcript.alias("transcript"), gene_id.alias("gene"), tail.alias("more")))
    return _lines(let(parts, build), source)


def record_text() -> Column:
    """name, chrom, strand, start, end, coding start and end, blocks, starts, ends, then ``key=value`` by key."""
    blocks = F.coalesce("block_count", F.when(F.col("block_starts").isNotNull(), F.size("block_starts")), F.lit(0))
    listed = lambda c: F.coalesce(F.array_join(F.transform(c, _text), ","), F.lit(""))
    extras = F.transform(entries_by_key(F.col("extras")), lambda e: F.concat(e["key"], F.lit("="), e["text"]))
    core = [F.coalesce("name", F.lit(".")), F.col("chrom"), F.coalesce("strand", F.lit(".")), _text(F.col("start")), _text(F.col("end")), _text(F.coalesce("thick_start", "start")), _text(F.coalesce("thick_end", "end")), _text(blocks), listed("block_starts"), listed("block_ends")]
    return F.concat_ws("\t", *core, extras)


def _chrom_given(line: Column) -> Column:
    return F.when(F.col("chrom") == "", F.raise_error(F.lit("missing field: chrom")).cast("string")).otherwise(line)


def to_bed(records: DataFrame, width: int = 6, options: WriterOptions = WriterOptions()) -> DataFrame:
    """One ``value`` a record; a record with an empty chromosome fails the query."""
    return records.select(_chrom_given(bed_line(width, options)).alias("value"))


def to_gxf(records: DataFrame, kind: str, options: WriterOptions = WriterOptions(), order: str | None = None) -> DataFrame:
    """One ``value`` a line, lines of a record together; ``order`` names columns kept for sorting."""
    lines = F.when(F.col("chrom") == "", F.raise_error(F.lit("missing field: chrom")).cast("array<string>")).otherwise(gxf_lines(kind, options))
    keep = [order] if order else []
    return records.select(*keep, F.posexplode(lines).alias("line_in_record", "value"))


def _zstd_writer(folder: str):
    """Writes a task's lines as a compressed file of its attempt and tells its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        task = TaskContext.get()
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, name = task.partitionId(), f"part-{task.partitionId():05d}.{task.taskAttemptId()}"
        with store.open_output_stream(f"{root}/{name}", compression=None) as raw, zstandard.ZstdCompressor().stream_writer(raw, closefd=False) as out:
            for batch in batches:
                for value in batch.column("value").to_pylist():
                    out.write((value or "").encode() + b"\n")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": pa.array([name])})

    return run


def _put_end_to_end(spark, store, parts: list, target, whole) -> None:
    """One file of many, copied by the driver's JVM a buffer at a time; it is at its place when it is whole."""
    copy = spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    out = store.create(whole)
    try:
        for part in parts:
            packed = store.open(part)
            try:
                copy(packed, out, 4 << 20, False)
            finally:
                packed.close()
    finally:
        out.close()
    store.rename(whole, target)


def write_lines(lines: DataFrame, path: str, single: bool = False) -> None:
    """Writes ``value`` as text under ``path``, which must not be there; a ``.gz``, ``.bz2`` or ``.zst`` path compresses.

    Without ``single`` the path is a folder of part files. With it the path is one file:
    the parts, each compressed by its own task, put end to end, a few megabytes at a
    time; gzip, bzip2 and zstd files may be made of several streams. Spark's text sink
    has no zstd codec, so such parts are written by Python tasks; of a task that ran
    more than once, one file takes its place in the end.
    """
    spark, suffix = lines.sparkSession, path.rsplit(".", 1)[-1] if "." in path else ""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    target = paths(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    target = target.makeQualified(store.getUri(), store.getWorkingDirectory())
    if store.exists(target):
        raise FormatError(f"{path} is already there")
    out = lines.select("value")
    if suffix not in ("zst", "zstd") and not single:
        out.write.option("compression", CODECS.get(suffix, "none")).text(path)
        return
    at = paths(target.getParent(), f"_{target.getName()}-{uuid.uuid4().hex}")
    try:
        if suffix in ("zst", "zstd"):
            ship(spark)
            uri = at.toString()
            uri = f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri
            # A row for each task comes to the driver.
            done = {r["part"]: r["name"] for r in out.mapInArrow(_zstd_writer(uri), "part int, name string").collect()}
            names = [done[p] for p in sorted(done)]
        else:
            out.write.option("compression", CODECS.get(suffix, "none")).text(at.toString())
            names = sorted(f.getPath().getName() for f in store.listStatus(at) if f.getPath().getName().startswith("part-"))
        if single:
            _put_end_to_end(spark, store, [paths(at, name) for name in names], target, paths(at, "whole"))
            return
        store.mkdirs(target)
        for name in names:
            store.rename(paths(at, name), paths(target, f"{name.split('.')[0]}.{suffix}"))
        store.create(paths(target, "_SUCCESS")).close()
    finally:
        store.delete(at, True)
