"""Transcripts grouped from annotation lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators import writers
from locusframe.plans import bridge
from locusframe.plans.bridge import SQL
from locusframe.plans.registry import query
from locusframe.schema import GroupOptions
from locusframe.sources import gxf

_BLOCKS = "b AS (SELECT name, string_agg(CAST(s AS VARCHAR), ',' ORDER BY rn) AS starts, string_agg(CAST(e.en AS VARCHAR), ',' ORDER BY rn) AS ends FROM e GROUP BY name)"


def _shown(df: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return df.select("key", "chrom", "start", "end", "name", "strand", "thick_start", "thick_end", text("block_starts").alias("starts"), text("block_ends").alias("ends"))


@query("a01_group", f"""{SQL}, {_BLOCKS} SELECT name AS key, chrom, st AS "start", en AS "end", 'N' || cust AS name, strand, ts AS thick_start, te AS thick_end, starts, ends FROM t JOIN b USING (name)""")
def group(spark, sf_dir):
    return _shown(gxf.transcripts(bridge.lines(spark, sf_dir), "gtf"))


@query("a03_bounds_without_parent", f"""{SQL}, {_BLOCKS} SELECT name AS key, chrom, st AS "start", en AS "end", name, strand, ts AS thick_start, te AS thick_end, starts, ends FROM t JOIN b USING (name)""")
def without_parent(spark, sf_dir):
    return _shown(gxf.transcripts(bridge.lines(spark, sf_dir).filter("_line % 1000 <> 0"), "gtf"))


@query("a01_group_written_gff", f"""{SQL}, {_BLOCKS} SELECT name AS key, chrom, st AS "start", en AS "end", name, strand, ts AS thick_start, te AS thick_end, starts, ends FROM t JOIN b USING (name)""")
def group_written(spark, sf_dir):
    rows = bridge.records(spark, sf_dir).select("k", F.posexplode(writers.gxf_text("gff")).alias("i", "v"))
    lines = rows.select(F.lit("t").alias("_file"), (F.col("k") * 1000 + F.col("i")).alias("_line"), F.col("v").alias("_raw"))
    return _shown(gxf.transcripts(lines, "gff", strict=True))


def _turned(spark, sf_dir) -> DataFrame:
    """The second exon's line is on another strand."""
    other = F.when(F.col("_raw").contains("\t+\t"), F.regexp_replace("_raw", "\t\\+\t", "\t-\t")).otherwise(F.regexp_replace("_raw", "\t\\.\t[-.]\t\\.\t", "\t.\t+\t.\t"))
    return bridge.lines(spark, sf_dir).withColumn("_raw", F.when(F.col("_line") % 1000 == 4, other).otherwise(F.col("_raw")))


@query("a03_conflicts", f"{SQL} SELECT name AS key, CASE WHEN n > 1 THEN k * 1000 + 4 END AS conflict_line, CAST(greatest(n - 1, 1) AS BIGINT) AS blocks FROM t")
def conflicts(spark, sf_dir):
    return gxf.transcripts(_turned(spark, sf_dir), "gtf").select("key", "conflict_line", F.col("block_count").cast("bigint").alias("blocks"))


@query("a05_merge_attributes", f"""{SQL} SELECT name AS key, string_agg(v, ',' ORDER BY m) AS tags FROM (SELECT name, v, min(pos) AS m FROM (SELECT name, f AS v, rn * 10 AS pos FROM e UNION ALL SELECT name, 'x', rn * 10 + 1 FROM e) GROUP BY name, v) GROUP BY name""")
def merge_attributes(spark, sf_dir):
    return gxf.transcripts(bridge.lines(spark, sf_dir), "gtf").select("key", F.array_join(F.col("extras")["tag"], ",").alias("tags"))


@query("a06_name_first_line", f"{SQL} SELECT name AS key, CASE WHEN k % 2 = 0 THEN 'N' || cust ELSE name END AS name FROM t")
def name_first_line(spark, sf_dir):
    lines = bridge.lines(spark, sf_dir).filter("_line % 1000 <> 0 OR (_line div 1000) % 2 = 0")
    late = F.when(F.col("_line") % 1000 > 2, F.concat("_raw", F.lit(' transcript_name "late";'))).otherwise(F.col("_raw"))
    return gxf.transcripts(lines.withColumn("_raw", late), "gtf").select("key", "name")


@query("a07_cds_bounds", f"""{SQL}, w AS (SELECT name, rn, s, CASE WHEN rn = min(rn) OVER (PARTITION BY name) THEN en + 5000 ELSE en END AS en FROM e WHERE f <> 'N') SELECT name AS key, min(s) AS thick_start, arg_max(en, rn) AS thick_end FROM w GROUP BY name""")
def cds_bounds(spark, sf_dir):
    """The first coding line reaches far beyond the others; the last one by start still ends the coding span."""
    e = bridge.exon_rows(spark, sf_dir).filter("f <> 'N'")
    from pyspark.sql import Window as W

    first = F.col("rn") == F.min("rn").over(W.partitionBy("name"))
    value = F.concat_ws("\t", "chrom", F.lit("s"), F.lit("cds"), (F.col("s") + 1).cast("string"), (F.col("en") + F.when(first, 5000).otherwise(0)).cast("string"), F.lit("."), "strand", F.lit("."), F.concat(F.lit('transcript_id "'), F.col("name"), F.lit('"')))
    lines = e.select(F.lit("t").alias("_file"), (F.col("k") * 1000 + F.col("rn")).alias("_line"), value.alias("_raw"))
    return gxf.transcripts(lines, "gtf").select("key", "thick_start", "thick_end")


@query("a07_codon_bounds", f"{SQL} SELECT name AS key, coalesce(ts, en) AS thick_start, en + 3 AS thick_end FROM t")
def codon_bounds(spark, sf_dir):
    r = bridge.records(spark, sf_dir)
    value = F.concat_ws("\t", "chrom", F.lit("s"), F.lit("Stop_Codon"), (F.col("end") + 1).cast("string"), (F.col("end") + 3).cast("string"), F.lit("."), "strand", F.lit("."), F.concat(F.lit('transcript_id "'), F.col("name"), F.lit('"')))
    codon = r.select(F.lit("t").alias("_file"), (F.col("k") * 1000 + 999).alias("_line"), value.alias("_raw"))
    return gxf.transcripts(bridge.lines(spark, sf_dir).unionByName(codon), "gtf").select("key", "thick_start", "thick_end")


@query("f03_feature_filter", f"{SQL} SELECT name AS key, CAST(n AS BIGINT) AS blocks, FALSE AS coding FROM t")
def feature_filter(spark, sf_dir):
    t = gxf.transcripts(bridge.lines(spark, sf_dir), "gtf", GroupOptions(child_features=("EXON",)))
    return t.select("key", F.col("block_count").cast("bigint").alias("blocks"), F.col("thick_start").isNotNull().alias("coding"))


@query("f04_lines_without_key", f"{SQL} SELECT name AS key, CAST(n AS BIGINT) AS blocks FROM t WHERE k % 2 = 0")
def lines_without_key(spark, sf_dir):
    lines = bridge.lines(spark, sf_dir)
    cut = F.when((F.col("_line") / 1000).cast("bigint") % 2 == 0, F.col("_raw")).otherwise(F.regexp_replace("_raw", 'transcript_id "[^"]*"; ', ""))
    return gxf.transcripts(lines.withColumn("_raw", cut), "gtf").select("key", F.col("block_count").cast("bigint").alias("blocks"))


@query("s36_group_by_gene", f"""{SQL} SELECT 'g' || cust AS key, count(*) AS lines FROM (SELECT cust FROM t UNION ALL SELECT cust FROM e JOIN t USING (name) UNION ALL SELECT cust FROM e JOIN t USING (name) WHERE f <> 'N') GROUP BY cust""")
def group_by_gene(spark, sf_dir):
    rows = gxf.keyed(gxf.parse_gxf(bridge.lines(spark, sf_dir), "gtf"), "gtf", GroupOptions(parent_feature="transcript", parent_attribute="gene_id", child_attribute="gene_id"))
    return rows.groupBy("key").agg(F.count("*").alias("lines"))
