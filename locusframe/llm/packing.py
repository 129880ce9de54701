"""Conflict-constrained best-fit packing of documents into bins of equal capacity."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import runs, save, ship, word_count

#: Words a bin holds, documents packed together, and how often a bin takes one source.
CAPACITY, GROUP_ROWS, PER_SOURCE = 8192, 4096, 8
#: Numbers reserved for the bins of a group, which may exceed ``group_rows`` by chance.
BINS = 1 << 20


class BestFit:
    """Bins of one group, ordered by residual.

    Each bin has a bitmap of the duplicate clusters it holds and, for each j up to
    ``per_source``, a bitmap of the sources of which it holds j documents or more.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.open: list[tuple[int, int]] = []  # (residual, bin), ascending
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.residual: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> int:
        """The tightest bin that has room and neither the cluster nor the source's full number; a new one if there is none."""
        at, source_bit, cluster_bit = bisect_left(self.open, (size, -1)), 1 << source, 1 << cluster
        while at < len(self.open):
            b = self.open[at][1]
            if not (self.clusters[b] & cluster_bit or self.sources[b][-1] & source_bit):
                del self.open[at]
                break
            at += 1
        else:
            b = len(self.clusters)
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
            self.residual.append(self.capacity)
        self.clusters[b] |= cluster_bit
        for j, held in enumerate(self.sources[b]):
            if not held & source_bit:
                self.sources[b][j] |= source_bit
                break
        self.residual[b] -= size
        if self.residual[b]:
            insort(self.open, (self.residual[b], b))
        return b


def _pack(capacity: int, per_source: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group,), g, schema in runs(batches, ["grp"]):
            # Largest first; ties in an order that depends on the rows alone.
            order = sorted(range(len(g["h"])), key=lambda i: (-g["words"][i], g["h"][i], g["piece"][i]))
            fit, sources, clusters = BestFit(capacity, per_source), {}, {}
            bins = [0] * len(order)
            for i in order:
                bins[i] = fit.place(g["words"][i], sources.setdefault(g["source"][i], len(sources)), clusters.setdefault(g["cluster"][i], len(clusters)))
            out = {c: pa.array(g[c], schema.field(c).type) for c in ("doc_id", "source", "piece", "offset", "words")}
            out["bin"] = pa.array([group * BINS + b for b in bins], pa.int64())
            out["bin_words"] = pa.array([capacity - fit.residual[b] for b in bins], pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, per_source: int = PER_SOURCE, seed: int = 43) -> DataFrame:
    """One row a piece: doc_id, source, piece, offset, words, bin, bin_words.

    A document of more than ``capacity`` words is cut into full pieces, each alone
    in a bin, and a last piece that is packed like a document; ``offset`` is the
    piece's first word. Pieces are dealt at random (by hash) into groups of about
    ``group_rows`` and each group is packed largest first, best fit: the search
    starts at the least residual that holds the piece and goes on over the
    residual-ordered bins until one has no conflict. A bin takes one piece of a
    duplicate cluster (``cluster_col``, or equal texts) and ``per_source`` of one source at
    most. A source or cluster of any share of the rows is spread evenly over the
    groups; what a group cannot pair opens new bins, and nothing is dropped.

    Documents without words (null and empty texts) need no room: one row each with
    a null bin. A null source or cluster is a value like any other. Repeated rows
    are copies: each is packed, and they conflict. An empty table gives an empty
    result. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.col(text_col)
    cluster = F.xxhash64(F.lit(seed), text) if cluster_col is None else F.xxhash64(F.lit(seed), F.col(cluster_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("n"), cluster.alias("cluster"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", "n", "cluster"))
    # Equal rows have equal hashes; the row number of the scan deals them to different groups.
    rows = save(rows.withColumn("_row", F.monotonically_increasing_id()), "pack-rows")
    last = F.when(F.col("n") > 0, F.col("n") - (F.col("n") - 1) % capacity - 1)
    tails = rows.filter("n > 0").withColumn("offset", last).withColumn("words", F.col("n") - F.col("offset")).withColumn("piece", (F.col("offset") / capacity).cast("long"))
    groups = max(1, -(-rows.count() // group_rows))
    spread = F.pmod(F.xxhash64("h", "_row"), F.lit(groups))
    tails = tails.withColumn("grp", spread).select("grp", "doc_id", "source", "cluster", "h", "piece", "offset", "words")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = f"doc_id {kinds['doc_id']}, source {kinds['source']}, piece long, offset long, words long, bin long, bin_words long"
    packed = tails.repartition("grp").sortWithinPartitions("grp").mapInArrow(_pack(capacity, per_source), columns)
    # A full piece has a bin of its own, named by the document and the piece, below zero.
    full = rows.filter(F.col("n") > capacity).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity) - 1)))
    own = -1 - F.xxhash64("h", "_row", "piece").bitwiseAND(F.lit((1 << 62) - 1))
    full = full.select("doc_id", "source", "piece", (F.col("piece") * capacity).alias("offset"), F.lit(capacity).cast("long").alias("words"), own.alias("bin"), F.lit(capacity).cast("long").alias("bin_words"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    empty = rows.filter("n = 0").select("doc_id", "source", zero.alias("piece"), zero.alias("offset"), zero.alias("words"), none.alias("bin"), none.alias("bin_words"))
    return packed.unionByName(full).unionByName(empty)
