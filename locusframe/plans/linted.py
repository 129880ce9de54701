"""Rules, diagnostics, counts and pruning over dirtied records and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators import lint, writers
from locusframe.plans import bridge
from locusframe.plans.bridge import SQL
from locusframe.plans.registry import query
from locusframe.schema import WriterOptions
from locusframe.sources.lines import lines_of

_D = f"""{SQL},
d AS (SELECT name, k, CASE WHEN k % 29 = 0 THEN '' ELSE chrom END AS chrom,
        CASE WHEN k % 17 = 0 THEN en ELSE st END AS s, CASE WHEN k % 17 = 0 THEN st ELSE en END AS en,
        CASE WHEN k % 19 = 0 AND ts IS NOT NULL THEN st - 5 ELSE ts END AS ts, CASE WHEN k % 13 = 0 AND te IS NOT NULL THEN st - 9 ELSE te END AS te FROM t)"""
_S = "CAST({} AS VARCHAR)".format
_BOUNDS = f"{_S('s')} || '..' || {_S('en')}"
_RULES = [
    ("chrom = ''", "'chrom must not be empty'"),
    ("s >= en", f"'start (' || {_S('s')} || ') must be less than end (' || {_S('en')} || ')'"),
    ("ts > te", f"'thick_start (' || {_S('ts')} || ') must be <= thick_end (' || {_S('te')} || ')'"),
    ("ts < s OR ts > en", f"'thick_start (' || {_S('ts')} || ') must be inside transcript bounds ' || {_BOUNDS}"),
    ("te < s OR te > en", f"'thick_end (' || {_S('te')} || ') must be inside transcript bounds ' || {_BOUNDS}"),
]


@query("l12_rules", f"{_D} " + " UNION ALL ".join(f"SELECT name, {m} AS message FROM d WHERE {c}" for c, m in _RULES))
def rules(spark, sf_dir):
    k, none = F.col("k"), F.lit(None)
    r = bridge.records(spark, sf_dir).withColumn("s0", F.col("start"))
    r = r.withColumn("chrom", F.when(k % 29 == 0, "").otherwise(F.col("chrom")))
    r = r.withColumn("thick_start", F.when((k % 19 == 0) & F.col("thick_start").isNotNull(), F.col("s0") - 5).otherwise(F.col("thick_start")))
    r = r.withColumn("thick_end", F.when((k % 13 == 0) & F.col("thick_end").isNotNull(), F.col("s0") - 9).otherwise(F.col("thick_end")))
    r = r.withColumn("start", F.when(k % 17 == 0, F.col("end")).otherwise(F.col("s0"))).withColumn("end", F.when(k % 17 == 0, F.col("s0")).otherwise(F.col("end")))
    bare = r.withColumn("block_count", none.cast("int")).withColumn("block_starts", none.cast("array<bigint>")).withColumn("block_ends", none.cast("array<bigint>"))
    return bare.select("name", F.explode(lint.messages()).alias("message"))


_KIND = "CASE WHEN k % 43 = 0 THEN 6 WHEN k % 37 = 0 THEN 7 WHEN k % 41 = 0 THEN 8 WHEN k % 47 = 0 THEN 11 WHEN k % 31 = 0 THEN 9 ELSE 0 END"
_B = f"""{SQL},
q AS (SELECT e.name, e.k, rn, t.n, st, t.en AS te, {_KIND.replace('k %', 'e.k %')} AS kind,
        CASE WHEN e.k % 23 = 0 AND rn = 2 THEN st ELSE e.s END AS s, CASE WHEN e.k % 11 = 0 AND rn = 1 THEN e.s WHEN e.k % 5 = 0 AND rn = t.n THEN e.en + 5000 ELSE e.en END AS en
      FROM e JOIN t USING (name)),
r AS (SELECT *, lag(en) OVER (PARTITION BY name ORDER BY rn) AS last FROM q),
h AS (SELECT name, n, {_KIND} AS kind FROM t)"""
_LENGTH = "'block_count (' || {} || ') must match block_{} length (' || CAST(n AS VARCHAR) || ')'"
_BLOCK_RULES = [
    "SELECT name, 'block_count is missing while block coordinates are present' AS message FROM h WHERE kind = 6",
    "SELECT name, 'block_starts are missing while block_count is present' FROM h WHERE kind = 7",
    "SELECT name, 'block_ends are missing while block_count is present' FROM h WHERE kind = 8",
    "SELECT name, 'block_count must be greater than 0' FROM h WHERE kind = 11",
    *[f"SELECT name, {_LENGTH.format(text, side)} FROM h WHERE kind = {kind}" for kind, text in ((11, "'0'"), (9, "CAST(n + 1 AS VARCHAR)")) for side in ("starts", "ends")],
    "SELECT name, 'block ' || CAST(rn AS VARCHAR) || ' start (' || CAST(s AS VARCHAR) || ') must be less than end (' || CAST(en AS VARCHAR) || ')' FROM r WHERE kind IN (0, 9) AND s >= en",
    "SELECT name, 'block ' || CAST(rn AS VARCHAR) || ' bounds ' || CAST(s AS VARCHAR) || '..' || CAST(en AS VARCHAR) || ' must be inside transcript bounds ' || CAST(st AS VARCHAR) || '..' || CAST(te AS VARCHAR) FROM r WHERE kind IN (0, 9) AND (s < st OR en > te)",
    "SELECT name, 'block ' || CAST(rn AS VARCHAR) || ' starts before the previous block ends (' || CAST(s AS VARCHAR) || ' < ' || CAST(last AS VARCHAR) || ')' FROM r WHERE kind IN (0, 9) AND s < last",
]


@query("l13_block_rules", f"{_B} " + " UNION ALL ".join(_BLOCK_RULES))
def block_rules(spark, sf_dir):
    k, n = F.col("k"), F.size("block_starts")
    kind = F.expr(_KIND)
    starts = F.transform("block_starts", lambda s, i: F.when((k % 23 == 0) & (i == 1), F.col("start")).otherwise(s))
    ends = F.zip_with(F.transform("block_ends", lambda e, i: F.when((k % 5 == 0) & (i == n - 1), e + 5000).otherwise(e)), F.transform("block_starts", lambda s, i: F.when((k % 11 == 0) & (i == 0), s)), lambda e, s: F.coalesce(s, e))
    r = bridge.records(spark, sf_dir).select("name", "chrom", "start", "end", F.lit(None).cast("bigint").alias("thick_start"), F.lit(None).cast("bigint").alias("thick_end"), F.when(kind == 6, None).when(kind == 11, 0).when(kind == 9, n + 1).otherwise(n).alias("block_count"), F.when(kind != 7, starts).alias("block_starts"), F.when(kind != 8, ends).alias("block_ends"))
    return r.select("name", F.explode(lint.messages()).alias("message"))


def _bed_lines(spark, sf_dir) -> DataFrame:
    """BED6 lines: every seventh order adds a comment, every 17th has start and end swapped, every fifth a bad strand."""
    k = F.col("k")
    r = bridge.records(spark, sf_dir).withColumn("s0", F.col("start"))
    r = r.withColumn("start", F.when(k % 17 == 0, F.col("end")).otherwise(F.col("s0"))).withColumn("end", F.when(k % 17 == 0, F.col("s0")).otherwise(F.col("end")))
    line = writers.bed_line(6, WriterOptions(numeric_extras=False))
    line = F.when(k % 5 == 0, F.regexp_replace(line, "[+.-]$", "*")).otherwise(line)
    rows = r.select(F.explode(F.filter(F.array(F.struct((k * 10).alias("line"), line.alias("value")), F.when(k % 7 == 0, F.struct((k * 10 + 1).alias("line"), F.lit("# note").alias("value")))), lambda x: x.isNotNull())).alias("x"))
    return lines_of(rows.select("x.*"), "t")


@query("l03_prune_bed", f"{SQL} SELECT k * 10 AS line, chrom || chr(9) || CAST(st AS VARCHAR) || chr(9) || CAST(en AS VARCHAR) || chr(9) || name || chr(9) || '0' || chr(9) || strand AS value FROM t WHERE k % 17 <> 0 AND k % 5 <> 0")
def prune_bed(spark, sf_dir):
    return lint.prune_bed(_bed_lines(spark, sf_dir), 6).select(F.col("_line").alias("line"), "value")


@query("a09_lint_counts", f"{SQL} SELECT 'BED' AS format, count(*) AS records, count(*) FILTER (WHERE k % 17 <> 0 AND k % 5 <> 0) AS valid, count(*) FILTER (WHERE k % 17 = 0 OR k % 5 = 0) AS invalid FROM t")
def lint_counts(spark, sf_dir):
    return lint.summary(lint.diagnosed_bed(_bed_lines(spark, sf_dir), 6), "BED")


@query("l07_bed_diagnostics", f"""{SQL} SELECT 'line ' || CAST(k * 10 AS VARCHAR) || ': ' || CASE WHEN k % 5 = 0 THEN 'invalid strand: expected ''+'', ''-'', ''.'' or ''?'', got ''*''' ELSE 'start (' || CAST(en AS VARCHAR) || ') must be less than end (' || CAST(st AS VARCHAR) || ')' END AS text FROM t WHERE k % 5 = 0 OR k % 17 = 0""")
def bed_diagnostics(spark, sf_dir):
    return lint.diagnostics(lint.diagnosed_bed(_bed_lines(spark, sf_dir), 6)).select("text")


def _gtf_lines(spark, sf_dir) -> DataFrame:
    """GTF lines: in every 19th order the first exon reaches out of the transcript; every 23rd has a line that cannot be read, every seventh a comment."""
    lines = bridge.lines(spark, sf_dir, ((7, 999, "# note"), (23, 998, "chr1\tsrc\texon\tten")))
    k, no = F.floor(F.col("_line") / 1000), F.col("_line") % 1000
    far = F.regexp_replace("_raw", "\texon\t([0-9]+)\t[0-9]+\t", "\texon\t$1\t999999999999\t")
    return lines.withColumn("_raw", F.when((k % 19 == 0) & (no == 2), far).otherwise(F.col("_raw")))


@query("l04_prune_gtf", f"{SQL} SELECT k * 1000 AS line FROM t WHERE k % 19 <> 0 UNION ALL SELECT k * 1000 + rn * 2 FROM e WHERE k % 19 <> 0 UNION ALL SELECT k * 1000 + rn * 2 + 1 FROM e WHERE f <> 'N' AND k % 19 <> 0 UNION ALL SELECT k * 1000 + 999 FROM t WHERE k % 7 = 0")
def prune_gtf(spark, sf_dir):
    return lint.prune_gxf(_gtf_lines(spark, sf_dir), "gtf").select(F.col("_line").alias("line"))


@query("l06_gtf_counts", f"{SQL} SELECT 'GTF' AS format, count(*) + count(*) FILTER (WHERE k % 23 = 0) AS records, count(*) FILTER (WHERE k % 19 <> 0) AS valid, count(*) FILTER (WHERE k % 19 = 0) + count(*) FILTER (WHERE k % 23 = 0) AS invalid FROM t")
def gtf_counts(spark, sf_dir):
    return lint.summary(lint.diagnosed_gxf(_gtf_lines(spark, sf_dir), "gtf").records, "GTF")


@query("l08_whole_file", "SELECT 'GTF' AS format, CAST(1 AS BIGINT) AS records, CAST(0 AS BIGINT) AS valid, CAST(1 AS BIGINT) AS invalid")
def whole_file(spark, sf_dir):
    return lint.whole_file_summary(lint.diagnosed_gxf(_gtf_lines(spark, sf_dir), "gtf").records, "GTF")


@query("j03_prune_semi_join", f"{SQL} SELECT name AS key, count(*) AS lines FROM (SELECT name FROM t WHERE k % 19 <> 0 UNION ALL SELECT name FROM e WHERE k % 19 <> 0 UNION ALL SELECT name FROM e WHERE f <> 'N' AND k % 19 <> 0) GROUP BY name")
def prune_semi_join(spark, sf_dir):
    return lint.diagnosed_gxf(_gtf_lines(spark, sf_dir), "gtf").valid.select("key", F.size("lines").cast("bigint").alias("lines"))
