"""Approximate nearest neighbours by a forest of sorted hash strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.llm.common import discard, save, ship
from locusframe.llm.shingles import kept

#: Trees of a forest, bits of a hash string, and distinct vectors of a block, which has a forest of its own.
TREES, BITS, BLOCK_ROWS = 256, 32, 16_384
#: The ascent ends when the k nearest met so far would be met in some tree with this probability, on average.
RECALL = 0.92
#: Growth of the ranges from which candidates are looked at anew, queries answered together, vectors hashed at once.
_GROWTH, _QUERIES, _HASHED = 1.25, 256, 512
#: Rows whose distances are taken at once in double precision.
_SLICE = 2048


class Forest:
    """Per tree the vectors' hash strings in order: signs of random projections around the block's mean."""

    def __init__(self, vectors: np.ndarray, trees: int, bits: int):
        self.vectors, self.trees, self.bits = vectors, trees, bits
        self.mean = vectors.mean(0)
        centred = vectors - self.mean
        self.norms = np.sqrt((centred**2).sum(1))
        self.scale = float(self.norms.max()) or 1.0
        self.norms /= self.scale
        self.short = (centred / self.scale).astype(np.float32)
        labels = self._labels(self.short)
        self.order = np.argsort(labels, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(labels, self.order, 1)

    def _labels(self, short: np.ndarray) -> np.ndarray:
        """The hash string of each vector in each tree, as a number of 32 bits with the first bit highest."""
        dim = short.shape[1]
        planes = kept(f"planes{self.trees}-{self.bits}-{dim}", lambda: np.random.default_rng(4241).normal(size=(dim, self.trees * self.bits)).astype(np.float32))
        value = (1 << np.arange(self.bits - 1, -1, -1)).astype(np.uint32)
        out = np.empty((self.trees, len(short)), np.uint32)
        for a in range(0, len(short), _HASHED):
            above = (short[a : a + _HASHED] @ planes > 0).reshape(-1, self.trees, self.bits)
            out[:, a : a + _HASHED] = (np.packbits(above, axis=2).view(">u4")[:, :, 0] if self.bits == 32 else above @ value).T
        return out

    def _ranges(self, labels: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) of the strings with the labels' prefixes of ``length`` bits, in each tree."""
        if not length:
            return np.zeros(labels.shape, np.int64), np.full(labels.shape, self.order.shape[1], np.int64)
        free = np.uint32(self.bits - length)
        low = (labels >> free) << free
        high = low + ((np.uint32(1) << free) - np.uint32(1))
        find = lambda of, side: np.stack([np.searchsorted(s, x, side) for s, x in zip(self.sorted, of)])
        return find(low, "left"), find(high, "right")

    def _expected_recall(self, own: np.ndarray, size: float, rows: np.ndarray, k: int, length: int) -> float:
        """Mean probability, over the k nearest of ``rows``, of sharing a prefix of ``length`` bits in some tree.

        A bit is shared with probability 1 - angle / pi. While better rows are still
        to be met, the k nearest met are too far away, so the mean is rather too low.
        """
        dot = self.short[rows] @ own
        best = np.argpartition(self.norms[rows] ** 2 - 2.0 * dot, k - 1)[:k]
        cosine = dot[best] / np.maximum(self.norms[rows[best]] * size, 1e-30)
        shared = (1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi) ** length
        return float((1 - (1 - shared) ** self.trees).mean())

    def candidates(self, queries: np.ndarray, k: int, recall: float) -> Iterator[np.ndarray]:
        """Rows for each query: every tree descends to its longest prefix match, then all go up together, to shorter
        prefixes, until the k nearest rows met so far are expected to be met with probability ``recall``."""
        n, trees = len(self.vectors), np.arange(self.trees)
        # Four bits at a time while prefixes are long, then one by one.
        lengths = [*range(self.bits, 16, -4), *range(min(self.bits, 16), -1, -1)]
        for a in range(0, len(queries), _QUERIES):
            own = ((queries[a : a + _QUERIES] - self.mean) / self.scale).astype(np.float32)
            labels, sizes = self._labels(own), np.sqrt((own.astype(np.float64) ** 2).sum(1))
            met, drawn = np.zeros((len(own), n), dtype=bool), np.zeros(len(own))
            left = np.arange(len(own))
            for length in lengths:
                lo, hi = self._ranges(labels[:, left], length)
                found, open_ = (hi - lo).sum(0), []
                for j, q in enumerate(left):
                    if not length:
                        met[q] = True
                        continue
                    open_.append(q)
                    if found[j] < max(k, _GROWTH * drawn[q]):
                        continue
                    drawn[q], size = found[j], hi[:, j] - lo[:, j]
                    place = np.repeat(lo[:, j] - np.cumsum(size) + size, size) + np.arange(found[j])
                    met[q, self.order[np.repeat(trees, size), place]] = True
                    rows = np.flatnonzero(met[q])
                    if len(rows) == n or (len(rows) >= k and self._expected_recall(own[q], sizes[q], rows, k, length) >= recall):
                        open_.pop()
                left = np.array(open_, np.int64)
                if not len(left):
                    break
            for q in range(len(own)):
                yield np.flatnonzero(met[q])

    def _possible(self, query: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """Those of ``rows`` that can be among the k nearest: their single-precision values are within the error bounds of the k-th.

        The value is the squared distance over scale**2, less the query's own share,
        of the vectors x and y around the block's mean. Rounding x and y and summing
        their products in single precision, in any order, moves 2xy by at most
        2(dim + 3)u |x||y| / (1 - (dim + 3)u), u = 2**-24; the terms after it stand for
        underflow and for the double precision of all else, the final distance's too.
        """
        dim = self.vectors.shape[1]
        own = (query - self.mean) / self.scale
        size, part = float(np.sqrt((own**2).sum())), (dim + 3) * 2.0**-24
        if not size < 1e15 or part >= 0.5:
            return rows
        norms = self.norms[rows]
        rough = norms**2 - 2.0 * (self.short[rows] @ own.astype(np.float32)).astype(np.float64)
        error = 2.02 * part / (1 - part) * norms * size + (dim + 16) * 2.0**-49 * (norms**2 + size**2) + dim * 2.0**-120 * (1 + size)
        return rows[~(rough - error > np.partition(rough + error, k - 1)[k - 1])]

    def nearest(self, queries: np.ndarray, k: int, recall: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, distances) of at least the k nearest candidates of each query and of those as near as the last of them."""
        for q, rows in zip(queries, self.candidates(queries, k, recall)):
            if len(rows) > k:
                rows = self._possible(q, rows, k)
            distance = np.concatenate([np.sqrt(((self.vectors[rows[a : a + _SLICE]] - q) ** 2).sum(1)) for a in range(0, max(len(rows), 1), _SLICE)])
            if len(rows) > k:
                near = distance <= np.partition(distance, k - 1)[k - 1]
                rows, distance = rows[near], distance[near]
            yield rows, distance


def _search(k: int, trees: int, bits: int, recall: float):
    """Rows of a block come before its queries, which are then answered batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, ids, forest = None, [], [], None
        for batch in batches:
            block = list(zip(batch.column("dim").to_pylist(), batch.column("block").to_pylist()))
            kind = batch.column("kind").to_pylist()
            cuts = [0, *[i for i in range(1, len(kind)) if block[i] != block[i - 1] or kind[i] != kind[i - 1]], len(kind)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                vectors = np.asarray(part.column("vec").flatten(), dtype=np.float64).reshape(b - a, -1)
                if block[a] != at:
                    at, rows, ids, forest = block[a], [], [], None
                if kind[a] == 0:
                    rows.append(vectors)
                    ids += part.column("ids").to_pylist()
                    continue
                if rows and forest is None:
                    forest, rows = Forest(np.concatenate(rows), trees, bits), []
                if forest is None:
                    continue
                found: tuple[list, list, list] = ([], [], [])
                for own, (near, distance) in zip(part.column("query_id").to_pylist(), forest.nearest(vectors, k + 1, recall)):
                    pairs = sorted((d, i) for r, d in zip(near.tolist(), distance.tolist()) for i in ids[r] if i != own)[:k]
                    found[0].extend([own] * len(pairs))
                    found[1].extend(i for _, i in pairs)
                    found[2].extend(d for d, _ in pairs)
                kind_of_id = part.schema.field("query_id").type
                yield pa.RecordBatch.from_arrays([pa.array(found[0], kind_of_id), pa.array(found[1], kind_of_id), pa.array(found[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, bits: int = BITS, recall: float = RECALL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest found of each row of ``queries`` among ``vectors``, but its own id: query_id, rank, vec_id, score.

    Nearness is the Euclidean distance, taken in double precision on the vectors as
    they are; ties go to the smaller id. Equal vectors are one row of the index with
    the k + 2 least of their different ids, so a vector of any number of ids is no hot
    group; no result needs more of them. The index lies in blocks of about
    ``block_rows`` distinct vectors, dealt by hash; each has its forest, and each
    query visits all blocks. In a block every tree is descended to the longest prefix
    of the query's hash string, then all trees are ascended together until the k
    nearest rows met are expected to be met with probability ``recall`` (see
    Forest.candidates): close groups end the ascent early, equidistant vectors late.
    Candidates are sifted in single precision around the block's mean, and none goes
    that its error bound lets be among the nearest; the distances of the rest are
    exact. The hash functions are random and fitted to nothing but a block's mean.

    Vectors that are null, empty, zero, or hold null or non-finite components take
    no part, nor do null ids. Vectors of different lengths never meet. Rows equal in id
    and vector are one candidate, however often they are repeated. An id with
    different vectors is queried once, with the least of them, and each can
    be found. Fewer than k candidates are returned as they are; empty tables give an
    empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("vec")
    sound = v.isNotNull() & F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    pick = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec")).filter(sound)
    # Repeated rows go first, so that the limit counts different ids; it is applied before the shuffle too.
    order = W.partitionBy("vec").orderBy("id")
    least = pick(vectors).dropDuplicates(["id", "vec"]).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 2)
    index = save(least.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("dim", F.size("vec")), "ann-index")
    sizes = index.groupBy("dim").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.lit(1)).alias("blocks"))
    # One row for each vector length.
    asked = pick(queries).groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))
    kind = index.schema["ids"].dataType.elementType.simpleString()
    rows = index.join(sizes, "dim").select("dim", F.pmod(F.xxhash64("vec"), "blocks").alias("block"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("query_id"), "ids", "vec")
    visits = asked.join(sizes, "dim").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), F.col("id").alias("query_id"), F.lit(None).cast(f"array<{kind}>").alias("ids"), "vec")
    dealt = rows.unionByName(visits).repartition("dim", "block").sortWithinPartitions("dim", "block", "kind")
    found = dealt.mapInArrow(_search(k, trees, bits, recall), f"query_id {kind}, vec_id {kind}, score double")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    out = save(found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "ann")
    discard(index)
    return out.select("query_id", "rank", "vec_id", "score")
