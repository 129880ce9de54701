"""Command line: ``lint`` and one command for each derived feature. Exit codes: 0 done, 1 invalid records, 2 a request that cannot be met."""

from __future__ import annotations

import argparse
import bz2
import contextlib
import gzip
import sys
from collections.abc import Iterator
from typing import IO

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators import extract, lint
from locusframe.operators.writers import bed_line
from locusframe.schema import FormatError, WriterOptions
from locusframe.sources import bed, detect, gxf
from locusframe.sources.lines import read_lines


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise FormatError(message)


def _parser() -> argparse.ArgumentParser:
    top = _Parser(prog="locusframe", description="Genomic interval and transcript annotations on Spark")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("lint", *extract.KINDS):
        p = commands.add_parser(name)
        p.add_argument("path", nargs="?")
        p.add_argument("-i", "--input")
        p.add_argument("-o", "--output")
        if name == "lint":
            modes = p.add_mutually_exclusive_group()
            modes.add_argument("--warn", action="store_true")
            modes.add_argument("--prune", action="store_true")
            p.add_argument("-a", "--additional-fields", type=int)
        else:
            p.add_argument("-t", "--type", type=int, default=6, choices=range(3, 10), metavar="3..9")
            p.add_argument("-a", "--additional-fields", default="")
    return top


def _input(args: argparse.Namespace) -> str:
    if args.path and args.input:
        raise FormatError("give --input/-i OR positional input, not both")
    if not (args.path or args.input):
        raise FormatError("no input provided")
    return args.path or args.input


@contextlib.contextmanager
def _sink(path: str | None) -> Iterator[IO[bytes]]:
    """Standard output, or one file, compressed as its suffix says."""
    if path is None:
        yield sys.stdout.buffer
        sys.stdout.buffer.flush()
        return
    kind = detect.codec(path)
    if kind == "zstd":
        import zstandard

        with open(path, "wb") as raw, zstandard.ZstdCompressor().stream_writer(raw) as out:
            yield out
        return
    opener = {"gzip": gzip.open, "bzip2": bz2.open}.get(kind, open)
    with opener(path, "wb") as out:
        yield out


def _emit(lines: DataFrame, path: str | None) -> None:
    """Writes ``value`` in the order the rows are in, one partition at a time."""
    with _sink(path) as out:
        for row in lines.select("value").toLocalIterator():
            out.write(row["value"].encode() + b"\n")


def _readable(path: str) -> str:
    if path.endswith(".bzip2"):
        raise FormatError("the text source reads bzip2 under the suffix .bz2 only")
    return path


def _records(spark: SparkSession, path: str) -> DataFrame:
    kind = detect.detect_format(spark, path)
    if kind == "BED":
        width, more = detect.detect_layout(spark, path)
        return bed.read_bed(spark, path, width, more, mode="strict")
    return gxf.read_gxf(spark, path, kind.lower(), strict=True)


def run_feature(spark: SparkSession, args: argparse.Namespace) -> int:
    width = extract.check_type(args.type)
    more = tuple(k for k in args.additional_fields.split(",") if k)
    cut = extract.intervals(_records(spark, _readable(_input(args))), args.command)
    line = bed_line(width, WriterOptions(numeric_extras=False, additional=more))
    _emit(cut.orderBy("_line", "interval_no").select(line.alias("value")), args.output)
    return 0


def run_lint(spark: SparkSession, args: argparse.Namespace) -> int:
    path = _readable(_input(args))
    kind = detect.detect_format(spark, path)
    lint.reject_additional_fields(args.additional_fields, kind)
    lines = read_lines(spark, path)
    if kind == "BED":
        layout = detect.detect_layout(spark, path, args.additional_fields)
        found = lint.diagnosed_bed(lines, *layout)
        kept = lint.prune_bed(lines, *layout)
    else:
        checked = lint.diagnosed_gxf(lines, kind.lower())
        found, kept = checked.records, checked.kept
    label = "PRUNE" if args.prune else "WARN" if args.warn else "LINT"
    for row in lint.diagnostics(found).orderBy(F.col("line").asc_nulls_last()).toLocalIterator():
        print(f"{label}: {row['text']}", file=sys.stderr)
    counts = (lint.summary if args.prune or kind == "BED" else lint.whole_file_summary)(found, kind).first()
    print(f"LINT: {kind} records={counts['records']}, valid={counts['valid']}, invalid={counts['invalid']}", file=sys.stderr)
    if args.prune:
        _emit(kept.orderBy("_line"), args.output)
    return int(bool(counts["invalid"]) and not (args.warn or args.prune))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
        spark = spark or SparkSession.builder.appName("locusframe").getOrCreate()
        return run_lint(spark, args) if args.command == "lint" else run_feature(spark, args)
    except (FormatError, PySparkException) as error:
        print(f"ERROR: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
