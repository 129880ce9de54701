"""What the operators share: tables written to the shared folder, gapless
numbering without a global window, and joins whose small side is size-checked."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.shipping import ship  # noqa: F401

#: Rows up to which a table with a few short columns is broadcast; beyond it a shuffled join is used.
BROADCAST_ROWS = 20_000
#: Most words of 64 bits in a filter of hashes (2 MB), bits that a hash sets in it, and bits that it has for each.
FILTER_WORDS, FILTER_PROBES, FILTER_BITS = 1 << 18, 4, 16
#: Rows of a part that is made by ranges; least rows for which another part is worth its task; bytes of text in a part; most parts.
PART_ROWS, LEAST_ROWS, PART_BYTES, MOST_PARTS = 250_000, 4_000, 24 << 20, 50_000
_LOCAL: dict[str, str] = {}
_OPEN: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="locusframe-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return f"file://{_LOCAL[app]}"


def fresh_folder(spark: SparkSession, tag: str) -> str:
    path = f"{shared_folder(spark)}/locusframe/{tag}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(path)
    return path


def save(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: the lineage ends there,
    later stages survive lost executors, and a value drawn once stays as it is."""
    path = fresh_folder(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``save`` or ``numbered`` made and that nothing reads any more."""
    for df in tables:
        if getattr(df, "_saved_at", None):
            delete_folders(df.sparkSession, [df._saved_at])


def delete_folders(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def folders_made() -> Iterator[list[str]]:
    """The folders that operators make in the shared folder meanwhile."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN[:] = [m for m in _OPEN if m is not made]


def take_place(store: pafs.FileSystem, own: str, name: str) -> None:
    """Gives a finished file its name; one that an earlier run of the task left makes way (not all stores rename over a file)."""
    if store.get_file_info(name).type != pafs.FileType.NotFound:
        store.delete_file(name)
    store.move(own, name)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def uniform(*parts: Column) -> Column:
    """A deterministic number in [0, 1) drawn from the hash of ``parts``."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / float(1 << 53)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    runs = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "\u0001")
    return F.length(F.regexp_replace(runs, "[\\x20\\x09-\\x0D]+", "")).cast("long")


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast where its counted ``rows`` are within BROADCAST_ROWS."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """The inner join on ``key``, of which ``right`` has one row each and ``left`` as many as ``weight`` says, ``total`` in all at most.

    Keys with more than total / BROADCAST_ROWS rows are BROADCAST_ROWS at most: they are
    broadcast and their rows stay where they are, so no key is a hot one of the shuffle.
    """
    hot = F.col(weight) > max(64, -(-total // BROADCAST_ROWS))
    few = F.broadcast(right.filter(hot))
    cold = left.join(F.broadcast(right.filter(hot).select(key)), key, "left_anti").join(right.filter(~hot), key)
    return left.join(few, key).unionByName(cold)


def named(name: str) -> Column:
    """The column of exactly that name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that columns made beside it can clash with none of them."""
    return F.struct(*[named(c) for c in df.columns])


def unpacked(df: DataFrame, like: DataFrame, row: str = "row", new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``like`` out of the struct ``row``, those named in ``new`` replaced."""
    return df.select(*[(new or {}).get(c, F.col(row).getField(c)).alias(c) for c in like.columns])


def parts_for(df: DataFrame, rows: int, size: int = 0) -> int:
    """Parts for ``rows`` rows with ``size`` bytes of text: enough to bound a part, fewer than the session's number where that would leave little in each."""
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_PARTS, max(1, -(-rows // PART_ROWS), -(-size // PART_BYTES), min(session, -(-rows // LEAST_ROWS))))


#: Beside the id, what puts rows of one id in order: a hash of the text, then the row's number in the scan.
TIES = ("text_hash", "scan_row")


def with_ties(df: DataFrame, text: Column) -> DataFrame:
    return df.withColumn(TIES[0], F.xxhash64(text)).withColumn(TIES[1], F.monotonically_increasing_id())


def _place(doc_id, text_hash: int, row: int, nulls_last: bool) -> tuple:
    return ((doc_id is None) == nulls_last, 0 if doc_id is None else doc_id, text_hash, row)


def range_bounds(rows: DataFrame, text_col: str, tag: str, nulls_last: bool) -> list[tuple]:
    """Least places, but for the first, of ranges of (doc_id, ties) that hold about PART_BYTES of text each.

    Only keys and sizes are moved for it. A row for each range comes to the driver,
    MOST_PARTS at most. An id of any number of rows spans several ranges.
    """
    keys = save(rows.select("doc_id", *TIES, F.octet_length(text_col).alias("bytes")), tag)
    n, size = keys.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    order = [F.col("doc_id").asc_nulls_last() if nulls_last else F.col("doc_id").asc_nulls_first(), *map(F.col, TIES)]
    ranges = keys.repartitionByRange(parts_for(rows, n, size), *order).groupBy(F.spark_partition_id())
    least = ranges.agg(F.min(F.struct(F.col("doc_id").isNull() if nulls_last else F.col("doc_id").isNotNull(), "doc_id", *TIES)).alias("least")).select("least.*").collect()
    discard(keys)
    return sorted(_place(*r[1:], nulls_last) for r in least)[1:]


def range_of(bounds: list[tuple], ids: list, hashes: list[int], rows: list[int], nulls_last: bool) -> list[int]:
    return [bisect_right(bounds, _place(*x, nulls_last)) for x in zip(ids, hashes, rows)]


def numbered(df: DataFrame, keys: list[Column], index: str, tag: str) -> DataFrame:
    """``df`` with a gapless 0-based ``index`` in the order of ``keys``, as a saved table.

    Rows are dealt by ranges of the keys and sorted within each; the position in a
    partition comes from monotonically_increasing_id and the partitions' first
    numbers from prefix sums over one row a partition, so no window spans all rows.
    ``df`` should be saved already, as the ranges are sampled from it. Keys should
    tell rows apart as far as the rows differ, or equal rows share a partition.
    """
    n = parts_for(df, df.count())
    at = F.monotonically_increasing_id()
    placed = save(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", at), tag)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row a partition, at most n: the single task of this window is bounded.
    bases = counts.select("_part", (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_base"))
    out = placed.withColumn("_part", part).join(F.broadcast(bases), "_part").withColumn(index, F.col("_base") + place).drop("_part", "_at", "_base")
    out._saved_at = placed._saved_at
    return out


def maybe_in(keys: DataFrame) -> Callable[[Column], Column]:
    """A test of 64-bit hashes that holds for all in the only column of ``keys`` and for few others.

    A Bloom filter of FILTER_WORDS words at most, for any number of keys: it comes to
    a query as one value of a scalar subquery. Beyond some millions of keys it lets
    all pass; an exact join must follow it, so it saves work and decides nothing.
    ``keys`` is read twice and should be a saved table's. The filter is written, so that
    it is made once however often it is asked; ``folder`` of the test tells where.
    """
    words = min(FILTER_WORDS, 1 << max(4, (keys.count() * FILTER_BITS // 64).bit_length()))
    bits_of = lambda value: [F.pmod(F.xxhash64(value, F.lit(i)), F.lit(words * 64)) for i in range(FILTER_PROBES)]
    bits = keys.select(F.explode(F.array(*bits_of(F.col(keys.columns[0])))).alias("bit"))
    ones = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("word"))
    none = keys.sparkSession.range(0, words, 1, 1).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("word"))
    # One row a word in the last task, whatever the number of keys.
    whole = save(none.unionByName(ones).groupBy("at").agg(F.bit_or("word").alias("word")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words")), "filter")

    def test(value: Column) -> Column:
        held = F.lit(True)
        for bit in bits_of(value):
            word = F.get(whole.scalar(), F.shiftright(bit, 6).cast("int"))
            held = held & (F.call_function("getbit", word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return held

    test.folder = whole._saved_at
    return test


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows_each: int = 512) -> Iterator[tuple[tuple, dict[str, list], pa.Schema]]:
    """Groups of consecutive rows with equal ``keys``, over the bounds of batches: (key, columns as lists, schema).

    A batch is turned into Python values ``rows_each`` rows at a time, so that long texts are not all there twice.
    """
    key, rows, schema = None, None, None
    for part in (b.slice(at, rows_each) for b in batches for at in range(0, b.num_rows, rows_each)):
        schema = part.schema
        columns = {c: part.column(c).to_pylist() for c in schema.names}
        marks = list(zip(*[columns[k] for k in keys]))
        first = 0
        for i in range(1, len(marks) + 1):
            if i < len(marks) and marks[i] == marks[first]:
                continue
            if marks[first] != key:
                if rows:
                    yield key, rows, schema
                key, rows = marks[first], {c: [] for c in columns}
            for c, v in columns.items():
                rows[c] += v[first:i]
            first = i
    if rows:
        yield key, rows, schema
