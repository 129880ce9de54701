"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import discard, named, numbered, save, small_side


def shard(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 29) -> DataFrame:
    """One row a document: doc_id, source, size, text_crc32, law, shard, slot, grown_shard.

    Rows of each source are put in a seeded random order; a row's fractional rank
    is (rank + 1/2) / rows of its source. All rows are then ordered by fractional
    rank and cut into ``shards`` runs, so that every shard holds every source in
    proportion and the shards' row counts differ by one at most (law ``rows``).
    Both orders are made by range partitioning and prefix sums, never by a window
    over a source or over all rows.

    A null text has no bytes (size 1, crc 0); a null source is a source; ties in
    the random order fall to id, checksum and size, and fully equal rows are
    interchangeable. An empty table gives an empty result. Other columns of
    ``docs`` are not read.
    """
    text = F.coalesce(named(text_col), F.lit(""))
    base = docs.select(named(id_col).alias("doc_id"), named(source_col).alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    base = save(base.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")).withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    within = ["_h", "doc_id", "text_crc32", "size", "_row"]
    ranked = numbered(base, [F.col("source"), *map(F.col, within)], "_rank", "shard-ranked")
    strata = save(ranked.groupBy("source").agg(F.min("_rank").alias("_first"), F.count("*").alias("_n")), "shard-strata")
    sources, rows = strata.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    placed = ranked.withColumnRenamed("source", "_s").join(small_side(strata, sources), F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    # Written before it is numbered: the range partitioner samples its input.
    placed = save(placed.select("source", *within, ((F.col("_rank") - F.col("_first") + 0.5) / F.col("_n")).alias("_f")), "shard-fraction")
    cut = numbered(placed, [F.col("_f"), F.col("source"), *map(F.col, within)], "_g", "shard-cut")
    discard(base, ranked, strata, placed)
    at = F.expr(f"_g * {shards} div {max(rows, 1)}")
    first = F.expr(f"(_shard * {max(rows, 1)} + {shards - 1}) div {shards}")
    out = cut.withColumn("_shard", at).withColumn("slot", F.col("_g") - first)
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
