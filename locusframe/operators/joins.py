"""Interval joins and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bases of a bin of the interval join.
BIN = 16_384


def interval_join(left: DataFrame, right: DataFrame, bin_size: int = BIN, suffix: str = "_r") -> DataFrame:
    """Pairs of rows on one chromosome whose [start, end) overlap; right columns get ``suffix``.

    Each side is cut into the bins that it touches and the bins are joined, so
    nothing is quadratic in a chromosome and a hot bin is split like any skewed join
    key. A pair is reported in the first bin that both touch, which needs no distinct.
    """

    def binned(df: DataFrame, tail: str) -> DataFrame:
        start, end = F.col(f"start{tail}"), F.col(f"end{tail}")
        first = F.floor(start / bin_size)
        last = F.floor(F.greatest(start, end - 1) / bin_size)
        return df.withColumn(f"_first{tail}", first).withColumn(f"_bin{tail}", F.explode(F.sequence(first, last)))

    r = right.select(*[F.col(c).alias(f"{c}{suffix}") for c in right.columns])
    a, b = binned(left, ""), binned(r, suffix)
    met = (F.col("chrom") == F.col(f"chrom{suffix}")) & (F.col("_bin") == F.col(f"_bin{suffix}"))
    once = F.col("_bin") == F.greatest("_first", f"_first{suffix}")
    overlap = (F.col("start") < F.col(f"end{suffix}")) & (F.col("end") > F.col(f"start{suffix}"))
    return a.join(b, met & once & overlap).drop("_first", "_bin", f"_first{suffix}", f"_bin{suffix}")


def with_genes(records: DataFrame, genes: DataFrame, key: str = "transcript", value: str = "gene") -> DataFrame:
    """``records`` with ``gene`` looked up by name; null where the map has none.

    The map is joined as it is: Spark broadcasts it where its size is under the
    session's limit and shuffles it otherwise.
    """
    named = genes.select(F.col(key).alias("_name"), F.col(value).alias("gene"))
    return records.join(named, F.col("name") == F.col("_name"), "left").drop("_name")
