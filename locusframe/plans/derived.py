"""Derived intervals, measures, predicates, extras and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.functions import extras as ex
from locusframe.functions import intervals as iv
from locusframe.functions.arrays import let
from locusframe.operators.extract import intervals
from locusframe.operators.joins import interval_join, with_genes
from locusframe.plans import bridge
from locusframe.plans.bridge import SQL
from locusframe.plans.registry import query


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.records(spark, sf_dir)


MEASURES = f"""{SQL},
m AS (SELECT t.name, t.chrom, t.strand, t.st, t.en, ts, te, t.n,
        CAST((SELECT sum(e.en - e.s) FROM e WHERE e.name = t.name) AS BIGINT) AS exonic,
        CAST(coalesce((SELECT sum(c.en - c.s) FROM c WHERE c.name = t.name), 0) AS BIGINT) AS coding
      FROM t)"""


@query("flagship_summary", f"""{MEASURES} SELECT chrom, strand, count(*) AS transcripts, CAST(sum(n) AS BIGINT) AS exons, CAST(sum(exonic) AS BIGINT) AS exonic_length, CAST(sum(coding) AS BIGINT) AS cds_length FROM m GROUP BY chrom, strand""")
def flagship(spark, sf_dir):
    m = iv.with_measures(_records(spark, sf_dir))
    return m.groupBy("chrom", "strand").agg(F.count("*").alias("transcripts"), F.sum("exon_count").alias("exons"), F.sum("exonic_length").alias("exonic_length"), F.sum("cds_length").alias("cds_length"))


def _listed(name: str, kind: str, sql: str) -> None:
    @query(name, f"{SQL} {sql}")
    def run(spark, sf_dir, kind=kind):
        return intervals(_records(spark, sf_dir), kind).select("name", "strand", "start", "end")


_OUTSIDE = "(SELECT e.name, t.strand, e.s AS \"start\", least(e.en, ts) AS \"end\", 'L' AS side FROM e JOIN t USING (name) WHERE ts < te AND e.s < least(e.en, ts) UNION ALL SELECT e.name, t.strand, greatest(e.s, te), e.en, 'R' FROM e JOIN t USING (name) WHERE ts < te AND greatest(e.s, te) < e.en)"
_listed("d01_exons", "exons", 'SELECT e.name, strand, s AS "start", e.en AS "end" FROM e JOIN t USING (name)')
_listed("d02_introns", "introns", 'SELECT name, strand, "start", "end" FROM (SELECT e.name, t.strand, e.en AS "start", lead(e.s) OVER (PARTITION BY e.name ORDER BY rn) AS "end" FROM e JOIN t USING (name)) WHERE "start" < "end"')
_listed("d03_cds", "cds", 'SELECT name, strand, s AS "start", en AS "end" FROM c')
_listed("d04_utr", "utr", f'SELECT name, strand, "start", "end" FROM {_OUTSIDE}')
_listed("d05_five_utr", "fiveutr", f"""SELECT name, strand, "start", "end" FROM {_OUTSIDE} WHERE (strand = '+' AND side = 'L') OR (strand = '-' AND side = 'R')""")
_listed("d06_three_utr", "threeutr", f"""SELECT name, strand, "start", "end" FROM {_OUTSIDE} WHERE (strand = '+' AND side = 'R') OR (strand = '-' AND side = 'L')""")


def _coding(df: DataFrame) -> DataFrame:
    return df.withColumn("_c", let(iv.exons(), iv.cds))


@query("d07_numbered_cds", f"""{SQL} SELECT name, s AS "start", en AS "end", CAST(CASE strand WHEN '-' THEN n - rn + 1 ELSE rn END AS BIGINT) AS number, CAST(ph AS BIGINT) AS phase FROM p""")
def numbered_cds(spark, sf_dir):
    rows = _records(spark, sf_dir).select("name", F.inline(let(iv.sorted_exons(iv.exons()), iv.numbered_cds)))
    return rows.select("name", "start", "end", F.col("number").cast("bigint").alias("number"), F.col("phase").cast("bigint").alias("phase"))


@query("d08_phase", f"""{SQL} SELECT name, s AS "start", en AS "end", CAST(ph AS BIGINT) AS phase FROM p""")
def phase(spark, sf_dir):
    rows = _coding(_records(spark, sf_dir)).select("name", F.inline(iv.phases(F.col("_c"))))
    return rows.select("name", "start", "end", F.col("phase").cast("bigint").alias("phase"))


_SPAN = "(SELECT name, strand, min(s) AS cs, max(en) AS ce FROM c GROUP BY name, strand)"
_FIRST = "(SELECT name, strand, arg_min(s, rn) AS fs, arg_min(en, rn) AS fe, arg_max(s, rn) AS ls, arg_max(en, rn) AS le FROM c GROUP BY name, strand)"
_LOW, _HIGH = 'SELECT name, cs AS "start", least(cs + 3, ce) AS "end" FROM', 'SELECT name, greatest(ce - 3, cs) AS "start", ce AS "end" FROM'


def _codon(name: str, sql: str, codon) -> None:
    @query(name, f"{SQL} {sql}")
    def run(spark, sf_dir):
        df = _coding(_records(spark, sf_dir)).withColumn("x", codon(F.col("_c")))
        return df.filter("x IS NOT NULL").select("name", "x.start", "x.end")


_codon("d09_start_codon", f"{_LOW} {_SPAN} WHERE strand <> '-' UNION ALL {_HIGH} {_SPAN} WHERE strand = '-'", lambda c: iv.start_codon(iv.coding_span(c)))
_codon("d10_stop_codon", f"{_HIGH} {_SPAN} WHERE strand <> '-' UNION ALL {_LOW} {_SPAN} WHERE strand = '-'", lambda c: iv.stop_codon(iv.coding_span(c)))
_codon("d09b_start_codon_in_exon", f"""SELECT name, CASE strand WHEN '-' THEN greatest(le - 3, ls) ELSE fs END AS "start", CASE strand WHEN '-' THEN le ELSE least(fs + 3, fe) END AS "end" FROM {_FIRST}""", iv.exon_start_codon)
_codon("d10b_stop_codon_in_exon", f"""SELECT name, CASE strand WHEN '-' THEN fs ELSE greatest(le - 3, ls) END AS "start", CASE strand WHEN '-' THEN least(fs + 3, fe) ELSE le END AS "end" FROM {_FIRST}""", iv.exon_stop_codon)
_codon("d12_coding_span", f'SELECT name, cs AS "start", ce AS "end" FROM {_SPAN}', iv.coding_span)


@query("d11_exon_number", f"""{SQL} SELECT e.name, s AS "start", CAST(CASE strand WHEN '-' THEN n - rn + 1 ELSE rn END AS BIGINT) AS number FROM e JOIN t USING (name)""")
def exon_number(spark, sf_dir):
    df = _records(spark, sf_dir).withColumn("_e", iv.exons()).select("name", "strand", F.size("_e").alias("n"), F.posexplode("_e").alias("i", "x"))
    return df.select("name", "x.start", iv.exon_number(F.col("i"), F.col("n")).cast("bigint").alias("number"))


def _measure(name: str, column: str, sql: str) -> None:
    @query(name, f"{MEASURES} SELECT name, CAST({sql} AS BIGINT) AS value FROM m")
    def run(spark, sf_dir):
        return iv.with_measures(_records(spark, sf_dir)).select("name", F.col(column).cast("bigint").alias("value"))


_measure("m01_exonic_length", "exonic_length", "exonic")
_measure("m02_intronic_length", "intronic_length", "en - st - exonic")
_measure("m03_cds_length", "cds_length", "coding")
_measure("m04_utr_length", "utr_length", "CASE WHEN ts < te THEN exonic - coding ELSE 0 END")
_measure("m05_exon_count", "exon_count", "n")
_measure("m06_intron_count", "intron_count", "n - 1")


def _scalar(name: str, sql: str, value, before=None) -> None:
    @query(name, f"{SQL} SELECT name, {sql} AS value FROM t")
    def run(spark, sf_dir):
        df = _records(spark, sf_dir)
        return (before(df) if before else df).select("name", value().alias("value"))


E = lambda: F.col("extras")
_scalar("p01_from_coords", "chrom || ':' || CAST(st AS VARCHAR) || '-' || CAST(en AS VARCHAR)", lambda: F.concat("chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))
_scalar("p03_set_field", "upper(chrom)", lambda: F.col("chrom"), lambda df: df.withColumn("chrom", F.upper("chrom")))
_scalar("p04_length", "en - st", iv.length)
_scalar("p05_is_empty", "st >= en - 20", lambda: F.col("start") >= F.col("end") - 20)
_scalar("p06_set_rgb", "'1,2,' || CAST(n AS VARCHAR)", lambda: ex.first_value(ex.get_extra(ex.set_extra(E(), "rgb", F.concat(F.lit("1,2,"), F.col("block_count").cast("string"))), "rgb")))
_scalar("p07_add_extra", "prio || ',' || status || CASE WHEN status = 'F' THEN '' ELSE ',F' END", lambda: ex.display(ex.get_extra(ex.add_extra(E(), "14", F.lit("F")), "14")))
_scalar("p08_get_extra", "cust", lambda: ex.first_value(ex.get_extra(E(), "13")))
_scalar("p08_missing_extra", "CAST(NULL AS VARCHAR)", lambda: ex.first_value(ex.get_extra(E(), "nothing")))
_scalar("p09_clear_extras", "CAST(0 AS BIGINT)", lambda: F.size(ex.empty_extras()).cast("bigint"))
_scalar("p10_first_value", "prio", lambda: ex.first_value(E()["14"]))
_scalar("p11_push_dedup", "CAST(CASE WHEN status = 'O' THEN 2 ELSE 3 END AS BIGINT)", lambda: F.size(ex.push(E()["14"], F.lit("O"))).cast("bigint"))
_scalar("p14_as_scalar", "status", lambda: ex.as_scalar(E()["note"]))
_scalar("p15_as_array", "prio || ',' || status", lambda: ex.display(ex.as_array(E()["14"])))
_scalar("p16_is_blank", "FALSE", lambda: ex.is_blank(E()["note"]))
_scalar("p17_display", "prio || ',' || status", lambda: ex.display(E()["14"]))
_scalar("p18_unnest", "cust || '|' || replace(prio, '-', '|') || '|' || status || '|' || status", lambda: F.array_join(ex.unnest(E(), "-"), "|"))


@query("p12_explode_values", f"{SQL} SELECT name, unnest([prio, status]) AS value FROM t")
def explode_values(spark, sf_dir):
    return _records(spark, sf_dir).select("name", F.explode(E()["14"]).alias("value"))


@query("f01_overlaps", f"{SQL} SELECT name FROM t WHERE st < k * 10000 + 130 AND en > k * 10000 + 110")
def overlaps(spark, sf_dir):
    base = F.col("k") * 10000
    return _records(spark, sf_dir).filter(iv.overlaps(base + 110, base + 130)).select("name")


@query("f02_exon_overlaps", f"{SQL} SELECT DISTINCT name FROM e WHERE s < k * 10000 + 130 AND en > k * 10000 + 110")
def exon_overlaps(spark, sf_dir):
    base = F.col("k") * 10000
    return _records(spark, sf_dir).filter(let(iv.exons(), lambda e: iv.exon_overlaps(e, base + 110, base + 130))).select("name")


@query("f05_plus_strand_count", f"{SQL} SELECT count(*) AS n FROM t WHERE strand = '+'")
def plus_strand(spark, sf_dir):
    return _records(spark, sf_dir).filter("strand = '+'").agg(F.count("*").alias("n"))


@query("f05_total_exons", f"{SQL} SELECT CAST(sum(n) AS BIGINT) AS n FROM t")
def total_exons(spark, sf_dir):
    return _records(spark, sf_dir).agg(F.sum(F.size(iv.exons())).alias("n"))


@query("f06_allowed_extras", f"{SQL} SELECT name, unnest(['13', 'note']) AS key FROM t")
def allowed_extras(spark, sf_dir):
    return _records(spark, sf_dir).select("name", F.explode(F.map_keys(ex.allowed(E(), ["note", "13", "x"]))).alias("key"))


@query("j01_gene_map", f"{SQL} SELECT name, CASE WHEN status = 'F' THEN 'gene' || cust ELSE name END AS gene FROM t")
def gene_map(spark, sf_dir):
    """The map knows the genes of finished orders only; others keep their own name."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'")
    genes = orders.select(F.concat(F.lit("tx"), F.col("o_orderkey").cast("string")).alias("transcript"), F.concat(F.lit("gene"), F.col("o_custkey").cast("string")).alias("gene"))
    return with_genes(_records(spark, sf_dir), genes).select("name", F.coalesce("gene", "name").alias("gene"))


@query("j02_interval_join", f"{SQL} SELECT a.name AS name, b.name AS query FROM t a JOIN t b ON a.chrom = b.chrom AND a.st < b.en + 220050 AND a.en > b.st + 220050")
def range_join(spark, sf_dir):
    df = _records(spark, sf_dir)
    asked = df.select("chrom", (F.col("start") + 220050).alias("start"), (F.col("end") + 220050).alias("end"), F.col("name").alias("query"))
    return interval_join(df.select("chrom", "start", "end", "name"), asked).select("name", F.col("query_r").alias("query"))


def _exploded(df: DataFrame) -> DataFrame:
    return df.select("name", "strand", F.posexplode(iv.exons()).alias("i", "x")).select("name", "strand", "i", "x.start", "x.end")


def _in_order() -> Column:
    return F.when(F.col("strand") == "-", -F.col("i")).otherwise(F.col("i"))


@query("w01_running_length", f"""{SQL} SELECT e.name, s AS "start", CAST(coalesce(sum(e.en - s) OVER (PARTITION BY e.name ORDER BY CASE strand WHEN '-' THEN -rn ELSE rn END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS consumed FROM e JOIN t USING (name)""")
def running_length(spark, sf_dir):
    w = W.partitionBy("name").orderBy(_in_order()).rowsBetween(W.unboundedPreceding, -1)
    return _exploded(_records(spark, sf_dir)).select("name", "start", F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0)).alias("consumed"))


@query("w02_row_number", f"""{SQL} SELECT e.name, s AS "start", row_number() OVER (PARTITION BY e.name ORDER BY CASE strand WHEN '-' THEN -rn ELSE rn END) AS number FROM e JOIN t USING (name)""")
def row_number(spark, sf_dir):
    return _exploded(_records(spark, sf_dir)).select("name", "start", F.row_number().over(W.partitionBy("name").orderBy(_in_order())).cast("bigint").alias("number"))


@query("w03_next_start", f"""{SQL} SELECT name, s AS "start", lead(s) OVER (PARTITION BY name ORDER BY rn) AS following FROM e""")
def next_start(spark, sf_dir):
    return _exploded(_records(spark, sf_dir)).select("name", "start", F.lead("start").over(W.partitionBy("name").orderBy("i")).alias("following"))


@query("o01_sort_exons", f"""{SQL} SELECT name, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS starts FROM e GROUP BY name""")
def sort_exons(spark, sf_dir):
    df = _records(spark, sf_dir).withColumn("block_starts", F.reverse("block_starts")).withColumn("block_ends", F.reverse("block_ends"))
    return df.select("name", F.array_join(F.transform(iv.sorted_exons(iv.exons()), lambda x: x["start"].cast("string")), ",").alias("starts"))
