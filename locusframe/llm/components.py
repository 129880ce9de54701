"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import discard, save


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); the label is the least node of its component.

    Each step is a hash aggregate with map-side combining and a join; nothing is
    collected but the count and checksum that tell when the edges stay as they
    are, which is when each component is a star around its least node.
    """
    now = save(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}-edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        # Written first, so that both sides of the join are plain exchanges and a hub's rows can be split.
        least = save(now.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m"), f"{tag}-least")
        large = now.join(least, F.col("v") == F.col("n"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        head = large.groupBy("u").agg(F.min("v").alias("m"))
        # u itself already points at its least neighbour in ``head``; its others are sent there.
        small = large.join(head, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(head.select("u", F.col("m").alias("v"))).distinct()
        then = save(small, f"{tag}-round")
        discard(now, least)
        now = then
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out = nodes.unionByName(nodes.select(F.col("label").alias("node"), "label").distinct())
    out._saved_at = now._saved_at
    return out
