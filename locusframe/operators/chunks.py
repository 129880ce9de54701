"""Logical chunks of records and user-defined formats."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.schema import FormatError
from locusframe.shipping import ship
from locusframe.sources.lines import skipped_bed


def chunk_ids(lines: DataFrame, size: int) -> DataFrame:
    """Data lines of (_file, _line, _raw) with ``chunk``: the number of data lines before it in its file, divided by ``size``.

    The count before a line is that of its block of lines plus the blocks before:
    two levels of windows, so no task orders a whole file.
    """
    from pyspark.sql import Window as W

    if size < 1:
        raise FormatError("chunk size must be 1 or more")
    block = F.floor(F.col("_line") / 100_000)
    data = lines.filter(~skipped_bed(F.col("_raw"))).withColumn("_block", block)
    sums = data.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    sums = sums.withColumn("_before", F.sum("_n").over(W.partitionBy("_file").orderBy("_block")) - F.col("_n")).drop("_n")
    at = F.row_number().over(W.partitionBy("_file", "_block").orderBy("_line"))
    return data.withColumn("_at", at).join(sums, ["_file", "_block"]).withColumn("chunk", F.floor((F.col("_before") + F.col("_at") - 1) / size)).drop("_block", "_at", "_before")


def map_batches(records: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """A user's function over Arrow batches of records, in parallel; its batches make up the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield fn(b)

    ship(records.sparkSession)
    return records.mapInArrow(run, schema)


@dataclass(frozen=True)
class LineFormat:
    """A user's line format: at least ``fields`` tab-separated fields, and a column for each name, built from them."""

    fields: int
    build: Callable[[Column], dict[str, Column]]

    def read(self, lines: DataFrame) -> DataFrame:
        cells = F.split("_raw", "\t", -1)
        data = lines.filter(~skipped_bed(F.col("_raw"))).withColumn("_f", cells)
        short = F.when(F.size("_f") < self.fields, F.concat(F.lit("line has "), F.size("_f").cast("string"), F.lit(f" fields, expected {self.fields}")))
        return data.select("_file", "_line", *[c.alias(k) for k, c in self.build(F.col("_f")).items()], short.alias("_error"))
