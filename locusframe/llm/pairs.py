"""All pairs within groups of any size: groups cut into blocks, and a task for each pair of blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks that a group is cut into at least, as far as the least size of a block allows, so that its pairs spread over many tasks.
BLOCKS = 24


def gridded(df: DataFrame, by: str, node: str, size: tuple[int, int], block_bytes: int | None = None) -> DataFrame:
    """Rows of a group of several blocks go to every pair of blocks that theirs is in; no task gets an unbounded group.

    ``n`` tells a row's group's number of rows and ``size`` the least and most of
    a block; with ``block_bytes``, a block also holds about that much of the group's ``bytes``.
    Rows come sorted by group, ``i``, ``j`` and ``node``; ``block`` is the row's own.
    """
    each = F.greatest(F.lit(size[0]), F.least(F.lit(size[1]), F.col("n") / BLOCKS))
    blocks = F.greatest(F.ceil(F.col("n") / each), F.lit(1))
    if block_bytes:
        blocks = F.greatest(blocks, F.least(F.col("n"), F.ceil(F.col("bytes") / block_bytes)))
    df = df.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(node), "blocks"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    df = df.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")
    # In order of node the least one heads its set in every task, so tasks that overlap give the same edges.
    return df.repartition(by, "i", "j").sortWithinPartitions(by, "i", "j", node)


def sides(block: list[int], i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows on the two sides of a pair of blocks: the same ones where a block meets itself."""
    of = np.array(block)
    return np.flatnonzero(of == i), np.flatnonzero(of == j)


class Sets:
    """Sets of rows that hang together, each named by its least row."""

    def __init__(self, n: int):
        self.head = np.arange(n)

    def join(self, x: int, others: np.ndarray) -> None:
        heads = np.unique(self.head[others])
        own = self.head[x]
        if len(heads) > 1 or (len(heads) and heads[0] != own):
            heads = np.append(heads, own)
            self.head[np.isin(self.head, heads)] = heads.min()
