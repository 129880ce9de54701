"""Files written and read again: codecs, line numbers, skip rules, detection."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators import chunks, writers
from locusframe.plans import bridge
from locusframe.plans.bridge import SQL, scratch
from locusframe.plans.registry import query
from locusframe.schema import WriterOptions
from locusframe.sources import bed, detect, gxf
from locusframe.sources.lines import read_encoded_lines, read_lines, skipped_bed, skipped_gxf

_PLAIN = WriterOptions(numeric_extras=False)


@query("s24_codecs", f"{SQL} SELECT codec, count(*) AS n, CAST(sum(en - st) AS BIGINT) AS bases FROM t CROSS JOIN (SELECT unnest(['none', 'gz', 'bz2', 'zst']) AS codec) GROUP BY codec")
def codecs(spark, sf_dir):
    """The same records written plain, by gzip, bzip2 and zstd, and read back."""
    lines, at, out = writers.to_bed(bridge.records(spark, sf_dir), 6, _PLAIN), scratch(spark, "codecs"), None
    for codec in ("none", "gz", "bz2", "zst"):
        path = f"{at}/x.bed" + ("" if codec == "none" else f".{codec}")
        writers.write_lines(lines, path)
        part = bed.read_bed(spark, path, 6, mode="strict").agg(F.lit(codec).alias("codec"), F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"))
        out = part if out is None else out.unionByName(part)
    return out


@query("s26_explicit_codec", f"{SQL} SELECT chrom, count(*) AS n FROM t GROUP BY chrom")
def explicit_codec(spark, sf_dir):
    """Compressed files read under a codec that is given by name."""
    path = f"{scratch(spark, 'packed')}/x"
    writers.write_lines(writers.to_bed(bridge.records(spark, sf_dir), 6, _PLAIN), f"{path}.gz")
    return bed.from_lines(read_encoded_lines(spark, f"{path}.gz/*.gz", "gzip"), 6, mode="strict").groupBy("chrom").agg(F.count("*").alias("n"))


@query("s45_line_numbers", f"{SQL} SELECT count(*) AS lines, CAST(0 AS BIGINT) AS wrong FROM t")
def line_numbers(spark, sf_dir):
    """Each line holds its place in the file it is written to; the numbers read say the same."""
    path = f"{scratch(spark, 'numbers')}/x"
    at = F.monotonically_increasing_id()
    place = at.bitwiseAND(F.lit((1 << 33) - 1)) + 1
    bridge.records(spark, sf_dir).select(place.cast("string").alias("value")).write.text(path)
    wrong = F.count_if(F.col("_raw") != F.col("_line").cast("string"))
    return read_lines(spark, path).agg(F.count("*").alias("lines"), wrong.alias("wrong"))


_KINDS = "CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN '# note' WHEN 2 THEN 'track name=x' WHEN 3 THEN 'browser position' WHEN 4 THEN '  # late' ELSE 'chr1' END"


def _kinds(spark, sf_dir) -> DataFrame:
    return bridge.records(spark, sf_dir).select("name", F.expr(_KINDS).alias("raw"))


@query("s03_skip_bed", f"{SQL} SELECT name, k % 6 < 5 AS skipped FROM t")
def skip_bed(spark, sf_dir):
    return _kinds(spark, sf_dir).select("name", skipped_bed(F.col("raw")).alias("skipped"))


@query("s17_skip_gxf", f"{SQL} SELECT name, k % 6 IN (0, 1, 4) AS skipped FROM t")
def skip_gxf(spark, sf_dir):
    return _kinds(spark, sf_dir).select("name", skipped_gxf(F.col("raw")).alias("skipped"))


@query("s28_invalid_utf8", f"{SQL} SELECT k AS line, CASE WHEN k % 4 = 0 THEN 'invalid UTF-8' END AS error FROM t")
def invalid_utf8(spark, sf_dir):
    """Every fourth name holds a byte that is no text."""
    name = F.when(F.col("k") % 4 == 0, F.expr("CAST(X'61FF62' AS STRING)")).otherwise(F.col("name"))
    df = bridge.records(spark, sf_dir).withColumn("name", name)
    lines = df.select(F.lit("t").alias("_file"), F.col("k").alias("_line"), writers.bed_line(4, _PLAIN).alias("_raw"))
    return bed.from_lines(lines, 4).select(F.col("_line").alias("line"), F.col("_error").alias("error"))


@query("s42_detected_layout", f"{SQL} SELECT CAST(count(*) AS BIGINT) AS n, 'BED' AS format, 6 AS width, 2 AS additional FROM t")
def detected_layout(spark, sf_dir):
    """Format by content and layout by the first data line of files with two extra columns."""
    path = f"{scratch(spark, 'layout')}/x"
    writers.write_lines(writers.to_bed(bridge.records(spark, sf_dir), 6), path)
    kind = detect.detect_format(spark, path)
    width, more = detect.detect_layout(spark, path, 2)
    return bed.read_bed(spark, path, width, more, mode="strict").agg(F.count("*").alias("n")).select("n", F.lit(kind).alias("format"), F.lit(width).alias("width"), F.lit(more).alias("additional"))


def _written(spark, sf_dir, name: str) -> str:
    """A file of annotation lines in GTF or GFF, by the name's suffix."""
    path = f"{scratch(spark, 'annotation')}/{name}"
    kind = "gtf" if ".gtf" in name else "gff"
    df = bridge.records(spark, sf_dir).select(F.explode(writers.gxf_text(kind)).alias("value"))
    writers.write_lines(df, path)
    return path


_TX = f"""{SQL} SELECT name AS key, chrom, st AS "start", en AS "end", strand, ts AS thick_start, te AS thick_end, CAST(n AS INTEGER) AS block_count FROM t"""


def _records_of(df: DataFrame) -> DataFrame:
    return df.select("key", "chrom", "start", "end", "strand", "thick_start", "thick_end", "block_count")


@query("s32_read_gtf", _TX)
def read_gtf_file(spark, sf_dir):
    return _records_of(gxf.read_gtf(spark, _written(spark, sf_dir, "x.gtf.gz"), strict=True))


@query("s33_read_gff", _TX)
def read_gff_file(spark, sf_dir):
    return _records_of(gxf.read_gff(spark, _written(spark, sf_dir, "x.gff3"), strict=True))


@query("s35_read_by_format", f"{SQL} SELECT 'GFF' AS format, count(*) AS records, CAST(sum(n) AS BIGINT) AS blocks FROM t")
def read_by_format(spark, sf_dir):
    """The reader that the file's name asks for."""
    path = _written(spark, sf_dir, "x.gff.bz2")
    kind = detect.detect_format(spark, path)
    return gxf.read_gxf(spark, path, kind.lower()).agg(F.lit(kind).alias("format"), F.count("*").alias("records"), F.sum("block_count").alias("blocks"))


_NAMES = [("a.bed", "BED", None), ("a.BED.gz", "BED", "gzip"), ("a.gtf.zst", "GTF", "zstd"), ("a.gff3.bz2", "GFF", "bzip2"), ("a.GFF", "GFF", None), ("a.gtf.GZ", "GTF", None), ("a.txt.zstd", None, "zstd"), ("gtf", None, None)]
_TEXT = lambda v: "NULL" if v is None else f"'{v}'"


@query("s39_names", "SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(_TEXT, row))})" for row in _NAMES) + ") AS v(name, format, codec)")
def names(spark, sf_dir):
    """Format and codec of file names."""
    rows = [(n, detect.format_of_name(n), detect.codec(n)) for n, _, _ in _NAMES]
    return spark.createDataFrame(rows, "name string, format string, codec string")


@query("s44_other_layout", f"{SQL} SELECT CAST(count(*) AS BIGINT) AS n, 12 AS width, 2 AS additional, 9 AS wide, 0 AS none FROM t")
def other_layout(spark, sf_dir):
    """Layouts of two files by their first data lines, without being told."""
    at = scratch(spark, "layouts")
    writers.write_lines(writers.to_bed(bridge.records(spark, sf_dir), 12), f"{at}/x")
    writers.write_lines(writers.to_bed(bridge.records(spark, sf_dir), 9, _PLAIN), f"{at}/y")
    (width, more), (wide, none) = detect.detect_layout(spark, f"{at}/x"), detect.detect_layout(spark, f"{at}/y")
    return bed.read_bed(spark, f"{at}/x", width, more, mode="strict").agg(F.count("*").alias("n"), *[F.lit(v).alias(k) for k, v in (("width", width), ("additional", more), ("wide", wide), ("none", none))])


@query("k15_single_file", f"{SQL} SELECT count(*) AS lines, CAST(1 AS BIGINT) AS files, CAST(count(*) AS BIGINT) AS last FROM t")
def single_file(spark, sf_dir):
    """One compressed file, whose lines are numbered from the first to the last."""
    path = f"{scratch(spark, 'single')}/x.bed.zst"
    writers.write_lines(writers.to_bed(bridge.records(spark, sf_dir), 6, _PLAIN), path, single=True)
    return read_lines(spark, path).agg(F.count("*").alias("lines"), F.countDistinct("_file").alias("files"), F.max("_line").alias("last"))


def _lengths(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("name"), pc.subtract(batch.column("end"), batch.column("start"))], ["name", "span"])


@query("x01_map_batches", f"{SQL} SELECT name, en - st AS span FROM t")
def map_batches(spark, sf_dir):
    """A user's function over batches of records."""
    return chunks.map_batches(bridge.records(spark, sf_dir).select("name", "start", "end"), _lengths, "name string, span bigint")
