"""Annotation records made of the order tables, in Spark and in SQL.

An order is a transcript: its line items are exons in slots of 100 bases, as long
as their quantity; returned ones are coding; the order's status is the strand.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.schema import EXTRAS, RECORD_COLUMNS

#: e: exons (name, k, rn, f, s, en); t: transcripts; x comes first. To be followed by more tables or a SELECT.
SQL = """WITH x AS (
  SELECT l_orderkey, l_returnflag, CAST(l_quantity AS BIGINT) q,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) rn
  FROM lineitem),
e AS (
  SELECT 'tx' || CAST(l_orderkey AS VARCHAR) AS name, l_orderkey k, rn, l_returnflag f,
         CAST(l_orderkey * 10000 + (rn - 1) * 100 AS BIGINT) s, CAST(l_orderkey * 10000 + (rn - 1) * 100 + q AS BIGINT) en
  FROM x),
t AS (
  SELECT name, k, 'chr' || CAST(o_custkey % 22 + 1 AS VARCHAR) AS chrom,
         CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '.' END AS strand,
         CAST(o_custkey AS VARCHAR) AS cust, o_orderstatus AS status, o_orderpriority AS prio,
         min(s) AS st, max(en) AS en, min(CASE WHEN f <> 'N' THEN s END) AS ts, max(CASE WHEN f <> 'N' THEN en END) AS te, count(*) AS n
  FROM e JOIN orders ON o_orderkey = k GROUP BY ALL),
c AS (
  SELECT e.name, t.chrom, t.strand, e.rn, t.n, greatest(e.s, ts) AS s, least(e.en, te) AS en
  FROM e JOIN t USING (name) WHERE ts < te AND greatest(e.s, ts) < least(e.en, te)),
p AS (
  SELECT *, (3 - coalesce(sum(en - s) OVER (PARTITION BY name ORDER BY CASE strand WHEN '-' THEN -rn ELSE rn END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3) % 3 AS ph
  FROM c)"""


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names; in a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        folder = tempfile.mkdtemp(prefix="locusframe-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
    return f"{base.rstrip('/')}/locusframe-{tag}-{uuid.uuid4().hex}"


def exon_rows(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """name, k, rn, f, s, en, chrom, strand, cust, status, prio of every exon.

    ``spread`` is for rows that much is made of: they stay in all shuffle partitions,
    and have their order's greatest en, ``last``; its least s is that of the first one.
    Spark would merge the partitions by their bytes, down to a few more than there
    are cores, so that all wait for the last ones.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", F.col("l_quantity").cast("bigint").alias("q"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    if spread:
        items = items.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    rn = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    e = items.withColumn("rn", rn).withColumn("s", F.col("l_orderkey") * 10000 + (F.col("rn") - 1) * 100)
    status, spans = F.col("o_orderstatus"), []
    if spread:
        # Before the join, while rows are a few numbers: a window copies its rows.
        spans = ["last"]
        e = e.withColumn("last", F.max(F.col("s") + F.col("q")).over(W.partitionBy("l_orderkey")))
    return e.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("tx"), F.col("l_orderkey").cast("string")).alias("name"), F.col("l_orderkey").alias("k"), "rn", F.col("l_returnflag").alias("f"), "s", (F.col("s") + F.col("q")).alias("en"),
        F.concat(F.lit("chr"), (F.col("o_custkey") % 22 + 1).cast("string")).alias("chrom"), F.when(status == "F", "+").when(status == "O", "-").otherwise(".").alias("strand"),
        F.col("o_custkey").cast("string").alias("cust"), status.alias("status"), F.col("o_orderpriority").alias("prio"), *spans,
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records with ``k``; extras 13 (customer), 14 (priority, status) and note (status)."""
    coding = F.col("f") != "N"
    keys = ["k", "name", "chrom", "strand", "cust", "status", "prio"]
    t = exon_rows(spark, sf_dir).groupBy(*keys).agg(
        F.min("s").alias("start"), F.max("en").alias("end"), F.min(F.when(coding, F.col("s"))).alias("thick_start"), F.max(F.when(coding, F.col("en"))).alias("thick_end"),
        F.count("*").cast("int").alias("block_count"), F.array_sort(F.collect_list(F.struct("s", "en"))).alias("b"),
    )
    extras = F.create_map(F.lit("13"), F.array("cust"), F.lit("14"), F.array("prio", "status"), F.lit("note"), F.array("status")).cast(EXTRAS)
    return t.withColumn("block_starts", F.col("b.s")).withColumn("block_ends", F.col("b.en")).withColumn("extras", extras).select(*RECORD_COLUMNS, "k")


def with_ids(df: DataFrame) -> DataFrame:
    """Records whose extras hold gene_id (the customer), transcript_id and a tag, as annotation files have them."""
    gene = F.concat(F.lit("g"), F.col("extras")["13"][0])
    ids = F.create_map(F.lit("gene_id"), F.array(gene), F.lit("transcript_id"), F.array("name"), F.lit("tag"), F.col("extras")["14"]).cast(EXTRAS)
    return df.withColumn("extras", ids)


def lines(spark: SparkSession, sf_dir: str, more: tuple[tuple[int, int, str], ...] = ()) -> DataFrame:
    """(_file, _line, _raw): GTF lines, a transcript line before its exons; returned exons have a CDS line too. Tags are return flags.

    ``more`` adds a line for every so-manieth order: (every, place, text). All lines of an
    order come from its exon rows, over the partitioning that numbers these.
    """
    e = exon_rows(spark, sf_dir, spread=True)
    # The kinds of lines are exploded as numbers, and a line's text is made once it is a row: arrays of texts with a filter are not compiled.
    head, i = F.col("rn") == 1, F.col("i")
    kinds = [F.when(head, 0), F.lit(1), F.when(F.col("f") != "N", 2), *[F.when(head & (F.col("k") % every == 0), 3 + n) for n, (every, _, _) in enumerate(more)]]
    each = e.withColumn("i", F.explode(F.array(*kinds))).filter("i IS NOT NULL")
    place, text = F.when(i == 0, 0).when(i == 1, F.col("rn") * 2).when(i == 2, F.col("rn") * 2 + 1), None
    feature = F.when(i == 0, "transcript").when(i == 1, "exon").otherwise("CDS")
    # The transcript line comes of the first exon, whose s is the least.
    start, end = F.col("s"), F.when(i == 0, F.col("last")).otherwise(F.col("en"))
    own = F.when(i == 0, F.concat(F.lit('gene_name "N'), F.col("cust"), F.lit('";'))).otherwise(F.concat(F.lit('tag "'), F.col("f"), F.lit('"; tag "x";')))
    attributes = F.concat(F.lit('gene_id "g'), F.col("cust"), F.lit('"; transcript_id "'), F.col("name"), F.lit('"; '), own)
    value = F.concat_ws("\t", "chrom", F.lit("src"), feature, (start + 1).cast("string"), end.cast("string"), F.lit("."), "strand", F.lit("."), attributes)
    for n, (_, at, note) in enumerate(more):
        place = place.when(i == 3 + n, at)
        text = (F if text is None else text).when(i == 3 + n, note)
    raw = value if text is None else text.otherwise(value)
    return each.select(F.lit("t").alias("_file"), (F.col("k") * 1000 + place).alias("_line"), raw.alias("_raw"))
