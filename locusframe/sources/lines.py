"""Text lines with their file and true line number."""

from __future__ import annotations

import bz2
import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.functions.arrays import let
from locusframe.functions.fields import trimmed
from locusframe.schema import FormatError
from locusframe.shipping import ship

#: Input splits up to which their first line numbers are broadcast.
BROADCAST_SPLITS = 100_000


def read_lines(spark: SparkSession, path: str | list[str], numbered: bool = True) -> DataFrame:
    """(_file, _line, _raw) of text files; gzip, bzip2 and zstd are told by the suffix.

    Lines end at \\n alone; a \\r before it is dropped. Numbers start at 1 in each
    file and count every line. They come from the ids of the scan, which are
    gapless in an input split, and a running sum over the splits of a file (a second
    scan that reads no columns but these); no line is sorted or shuffled.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    line = F.regexp_replace("value", r"\r\z", "").alias("_raw")
    if not numbered:
        return raw.select(F.col("_metadata.file_path").alias("_file"), F.lit(None).cast("bigint").alias("_line"), line)
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    placed = raw.select(*split, F.monotonically_increasing_id().alias("_id"), line)
    sizes = raw.select(*split, F.monotonically_increasing_id().alias("_id")).groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if raw.rdd.getNumPartitions() <= BROADCAST_SPLITS:
        bases = F.broadcast(bases)
    return placed.join(bases, ["_file", "_block"]).select("_file", (F.col("_id") - F.col("_first") + F.col("_base") + 1).alias("_line"), "_raw")


def _opened(path: str):
    """A stream of a file that Spark listed; its store is the one that the path names."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"), compression=None)
    authority, _, name = rest.removeprefix("//").partition("/")
    store, root = pafs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return store.open_input_stream(f"{root.rstrip('/')}/{name}", compression=None)


def _unpacked(codec: str, packed):
    if codec == "zstd":
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(packed, read_across_frames=True))
    return {"gzip": gzip.open, "bzip2": bz2.open}[codec](packed)


def read_encoded_lines(spark: SparkSession, path: str | list[str], codec: str) -> DataFrame:
    """(_file, _line, _raw) of files whose suffix does not tell their codec, as one names it: gzip, bzip2 or zstd.

    Such a file is not cut into splits: Spark lists it, and one task opens it, unpacks
    it as a stream and numbers its lines, a megabyte at a time, whatever its size.
    """
    if codec not in ("gzip", "bzip2", "zstd"):
        raise FormatError(f"unknown codec {codec!r}: expected gzip, bzip2 or zstd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("path").to_pylist():
                at = 0
                with _opened(file) as packed, _unpacked(codec, packed) as text:
                    while rows := text.readlines(1 << 20):
                        raw = [r.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace") for r in rows]
                        yield pa.RecordBatch.from_pydict({"_file": pa.array([file] * len(raw)), "_line": pa.array(range(at + 1, at + len(raw) + 1), pa.int64()), "_raw": pa.array(raw)})
                        at += len(raw)

    ship(spark)
    # The files' contents are not read here: only the paths are asked for.
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(run, "_file string, _line bigint, _raw string")


def held(rows: DataFrame) -> DataFrame:
    """``rows`` whose columns are worked out once.

    A filter that follows would be pushed below them, with a copy of their expressions
    for each place that names them. It stays above a column that differs by task. As
    that column has a lambda, the columns are compiled in parts and not into one
    method with the steps around them, which the JVM interprets if it is long.
    """
    return rows.withColumn("_task", let(F.spark_partition_id(), lambda task: task)).filter("_task >= 0").drop("_task")


def not_text(raw: Column) -> Column:
    """The message for a line that is not UTF-8; null for one that is."""
    return F.when(~F.is_valid_utf8(raw), F.lit("invalid UTF-8"))


def lines_of(values: DataFrame, file: str = "") -> DataFrame:
    """(_file, _line, _raw) of a DataFrame with columns ``line`` (number) and ``value``: lines that are in no file."""
    return values.select(F.lit(file).alias("_file"), F.col("line").cast("bigint").alias("_line"), F.regexp_replace("value", r"\r\z", "").alias("_raw"))


def skipped_bed(raw: Column) -> Column:
    """Blank lines, comments, and track and browser lines."""
    t = trimmed(raw)
    return (t == "") | t.startswith("#") | t.startswith("track ") | t.startswith("browser ")


def skipped_gxf(raw: Column) -> Column:
    """Blank lines and comments. What begins with a character after ``#`` is neither, and is not looked at further."""
    t = trimmed(raw)
    return ~(raw >= "$") & ((t == "") | t.startswith("#"))
