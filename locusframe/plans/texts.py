"""Writers, and readers fed with what the writers made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions import fields as f
from locusframe.functions.arrays import let
from locusframe.functions.attributes import to_map, tokens
from locusframe.operators import chunks, extract, writers
from locusframe.plans import bridge
from locusframe.plans.bridge import SQL, scratch
from locusframe.plans.registry import query
from locusframe.schema import BED_WIDTHS, WriterOptions
from locusframe.sources import bed, detect, gxf
from locusframe.sources.lines import held, lines_of
from locusframe.streaming.bed_stream import ingest, stream_bed

_V = "CAST({} AS VARCHAR)".format
_TAB = "chr(9)"


def _tabbed(*parts: str) -> str:
    return f" || {_TAB} || ".join(parts)


_BLOCKS = "b AS (SELECT name, string_agg(CAST(e.en - s AS VARCHAR), ',' ORDER BY rn) || ',' AS sizes, string_agg(CAST(s - k * 10000 AS VARCHAR), ',' ORDER BY rn) || ',' AS offs, string_agg(CAST(s AS VARCHAR), ',' ORDER BY rn) AS starts, string_agg(CAST(e.en AS VARCHAR), ',' ORDER BY rn) AS ends FROM e GROUP BY name)"
_FROM = "FROM t JOIN b USING (name)"
_COLUMNS = {3: ["chrom", _V("st"), _V("en")]}
_COLUMNS[4] = [*_COLUMNS[3], "name"]
_COLUMNS[5] = [*_COLUMNS[4], "'0'"]
_COLUMNS[6] = [*_COLUMNS[5], "strand"]
_COLUMNS[8] = [*_COLUMNS[6], _V("coalesce(ts, st)"), _V("coalesce(te, en)")]
_COLUMNS[9] = [*_COLUMNS[8], "'0,0,0'"]
_COLUMNS[12] = [*_COLUMNS[9], _V("n"), "sizes", "offs"]


def _lines(df: DataFrame, value) -> DataFrame:
    return lines_of(df.select(F.col("k").alias("line"), value.alias("value")), "t")


for _w in BED_WIDTHS:

    @query(f"k01_bed{_w}_lines", f"{SQL}, {_BLOCKS} SELECT {_tabbed(*_COLUMNS[_w])} AS value {_FROM}")
    def _bed_lines(spark, sf_dir, width=_w):
        return writers.to_bed(bridge.records(spark, sf_dir), width, WriterOptions(numeric_extras=False))

    @query(f"s05_bed{_w}_parse", f'{SQL} SELECT chrom, st AS "start", en AS "end", {"name" if _w >= 4 else "CAST(NULL AS VARCHAR)"} AS name, {"strand" if _w >= 6 else "CAST(NULL AS VARCHAR)"} AS strand, {"coalesce(ts, st)" if _w >= 8 else "CAST(NULL AS BIGINT)"} AS thick_start, {"coalesce(te, en)" if _w >= 8 else "CAST(NULL AS BIGINT)"} AS thick_end FROM t')
    def _bed_parse(spark, sf_dir, width=_w):
        lines = _lines(bridge.records(spark, sf_dir), writers.bed_line(width, WriterOptions(numeric_extras=False)))
        return bed.from_lines(lines, width, mode="strict").select("chrom", "start", "end", "name", "strand", "thick_start", "thick_end")


@query("s12_bed12_absolute", f"{SQL}, {_BLOCKS} SELECT name, CAST(n AS BIGINT) AS n, starts, ends {_FROM}")
def bed12_absolute(spark, sf_dir):
    lines = _lines(bridge.records(spark, sf_dir), writers.bed_line(12, WriterOptions(numeric_extras=False)))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return bed.from_lines(lines, 12).select("name", F.col("block_count").cast("bigint").alias("n"), text("block_starts").alias("starts"), text("block_ends").alias("ends"))


@query("s31_bed_extra_columns", f"{SQL} SELECT name, cust AS c7, prio || ',' || status AS c8 FROM t")
def bed_extra_columns(spark, sf_dir):
    lines = _lines(bridge.records(spark, sf_dir), writers.bed_line(6))
    return bed.from_lines(lines, 6, additional_fields=2).select("name", F.col("extras")["7"][0].alias("c7"), F.col("extras")["8"][0].alias("c8"))


#: Every third line lacks its end, every fifth has a letter in its start, every seventh is a comment.
def _dirty_bed(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    start = F.when(k % 5 == 0, F.concat(F.lit("x"), F.col("start").cast("string"))).otherwise(F.col("start").cast("string"))
    line = F.when(k % 3 == 0, F.concat_ws("\t", "chrom", start)).otherwise(F.concat_ws("\t", "chrom", start, F.col("end").cast("string")))
    return _lines(bridge.records(spark, sf_dir), F.when(k % 7 == 0, F.concat(F.lit("# "), line)).otherwise(line))


@query("s02_bad_lines", f"""{SQL} SELECT k AS line, CASE WHEN k % 3 = 0 THEN 'line has 2 fields, expected 3' WHEN k % 5 = 0 THEN 'invalid chromStart: expected unsigned integer, got ''x' || CAST(st AS VARCHAR) || '''' END AS error FROM t WHERE k % 7 <> 0""")
def bad_lines(spark, sf_dir):
    return bed.from_lines(_dirty_bed(spark, sf_dir), 3).select(F.col("_line").alias("line"), F.col("_error").alias("error"))


@query("s02_dropped_lines", f"{SQL} SELECT k AS line FROM t WHERE k % 7 <> 0 AND k % 3 <> 0 AND k % 5 <> 0")
def dropped_lines(spark, sf_dir):
    return bed.from_lines(_dirty_bed(spark, sf_dir), 3, mode="drop").select(F.col("_line").alias("line"))


_WORD = "CASE k % 6 WHEN 0 THEN '+' || CAST(k AS VARCHAR) WHEN 1 THEN '-1' WHEN 2 THEN ' 5' WHEN 3 THEN '5.0' WHEN 4 THEN '18446744073709551615' ELSE CAST(k AS VARCHAR) END"


def _word() -> F.Column:
    return F.expr(_WORD.replace("VARCHAR", "STRING"))


@query("s20_bad_ints", f"{SQL} SELECT name, CASE WHEN k % 6 IN (0, 5) THEN k END AS value FROM t")
def bad_ints(spark, sf_dir):
    return bridge.records(spark, sf_dir).select("name", f.unsigned(_word(), "x").value.alias("value"))


@query("s18_strand", f"{SQL} SELECT name, CASE k % 4 WHEN 0 THEN '+' WHEN 1 THEN '.' WHEN 2 THEN '-' END AS value FROM t")
def strands(spark, sf_dir):
    word = F.expr("CASE k % 4 WHEN 0 THEN '+' WHEN 1 THEN '?' WHEN 2 THEN '-' ELSE 'x' END")
    return bridge.records(spark, sf_dir).select("name", f.strand(word).value.alias("value"))


@query("s19_rgb", f"{SQL} SELECT name, CASE WHEN k % 300 <= 255 AND k % 2 = 0 THEN CAST(k % 300 AS VARCHAR) || ',0,7' END AS value FROM t")
def rgbs(spark, sf_dir):
    word = F.expr("concat(k % 300, ',0', CASE WHEN k % 2 = 0 THEN ',7' ELSE '' END)")
    return bridge.records(spark, sf_dir).select("name", let(f.rgb(word).value, lambda v: F.when(v.isNotNull(), f.rgb_text(v))).alias("value"))


@query("s22_score", f"{SQL} SELECT name, CASE WHEN k % 1200 <= 1000 THEN CAST(k % 1200 AS BIGINT) END AS value FROM t")
def scores(spark, sf_dir):
    return bridge.records(spark, sf_dir).select("name", f.score((F.col("k") % 1200).cast("string")).value.cast("bigint").alias("value"))


@query("s23_number_list", f"{SQL}, {_BLOCKS} SELECT name, sizes, CAST(n AS BIGINT) AS n {_FROM}")
def number_list(spark, sf_dir):
    lines = bridge.records(spark, sf_dir).select("name", F.concat(F.array_join(F.zip_with("block_starts", "block_ends", lambda s, e: (e - s).cast("string")), ","), F.lit(",")).alias("text"))
    value = f.unsigned_list(F.col("text"), "x").value
    return lines.select("name", F.concat(F.array_join(F.transform(value, lambda x: x.cast("string")), ","), F.lit(",")).alias("sizes"), F.size(value).cast("bigint").alias("n"))


@query("s40_sniff", f"{SQL} SELECT k AS line, CASE k % 3 WHEN 0 THEN 'BED' WHEN 1 THEN 'GTF' ELSE 'GFF' END AS format FROM t")
def sniff(spark, sf_dir):
    df = bridge.with_ids(bridge.records(spark, sf_dir))
    value = F.when(F.col("k") % 3 == 0, writers.bed_line(6)).when(F.col("k") % 3 == 1, F.get(writers.gxf_lines("gtf"), F.lit(0))).otherwise(F.get(writers.gxf_lines("gff"), F.lit(0)))
    return df.select(F.col("k").alias("line"), detect.format_of_line(value).alias("format"))


@query("s43_layout", f"{SQL} SELECT name, CASE WHEN n <= 3 THEN 3 WHEN n = 4 THEN 4 WHEN n = 5 THEN 5 WHEN n <= 7 THEN 6 WHEN n = 8 THEN 8 WHEN n <= 11 THEN 9 ELSE 12 END AS width, CASE WHEN n <= 5 OR n = 8 THEN 0 WHEN n <= 7 THEN n - 6 WHEN n <= 11 THEN n - 9 ELSE n - 12 END AS additional FROM (SELECT name, CAST(n AS INTEGER) AS n FROM t)")
def layout(spark, sf_dir):
    return bridge.records(spark, sf_dir).select("name", let(detect.layout_of_count(F.col("block_count")), lambda x: x).alias("x")).select("name", "x.width", "x.additional")


_ATTRS_SQL = f"{SQL} SELECT name, unnest(['gene_id', 'transcript_id', 'tag']) AS key, unnest(['g' || cust, name, prio || '/' || status]) AS value FROM t"


def _attributes(spark, sf_dir, kind: str, separator: str) -> DataFrame:
    pairs = {"gene_id": F.concat(F.lit("g"), F.col("extras")["13"][0]), "transcript_id": F.col("name"), "tag": F.array_join(F.col("extras")["14"], "/")}
    text = F.concat(*[F.concat(F.lit(f'{k} "'), v, F.lit('"; ')) if kind == "gtf" else F.concat(F.lit(f"{k}="), v, F.lit(";")) for k, v in pairs.items()])
    df = bridge.records(spark, sf_dir).withColumn("text", text).withColumn("pairs", tokens(F.col("text"), separator))
    return held(df.withColumn("m", to_map(F.col("pairs")))).select("name", F.explode("m").alias("key", "values")).select("name", "key", F.col("values")[0].alias("value"))


@query("s15_gtf_attributes", _ATTRS_SQL)
def gtf_attributes(spark, sf_dir):
    return _attributes(spark, sf_dir, "gtf", " ")


@query("s15_gff_attributes", _ATTRS_SQL)
def gff_attributes(spark, sf_dir):
    return _attributes(spark, sf_dir, "gff", "=")


@query("s14_gxf_lines", f"""{SQL} SELECT chrom, strand, 'exon' AS feature, e.s AS "start", e.en AS "end" FROM e JOIN t USING (name) UNION ALL SELECT chrom, strand, 'CDS', e.s, e.en FROM e JOIN t USING (name) WHERE f <> 'N' UNION ALL SELECT chrom, strand, 'transcript', st, en FROM t""")
def gxf_line(spark, sf_dir):
    return gxf.parse_gxf(bridge.lines(spark, sf_dir), "gtf").select("chrom", "strand", "feature", "start", "end")


@query("s14_bad_gxf", f"""{SQL} SELECT count(*) AS n, CASE WHEN rn % 4 = 0 THEN 'end' WHEN rn % 4 = 1 THEN 'strand' WHEN rn % 4 = 2 THEN 'short' END AS error FROM e GROUP BY 2""")
def bad_gxf(spark, sf_dir):
    e = bridge.exon_rows(spark, sf_dir)
    end = F.when(F.col("rn") % 4 == 0, F.col("s") - 5).otherwise(F.col("en"))
    strand = F.when(F.col("rn") % 4 == 1, "*").otherwise(F.col("strand"))
    attrs = F.when(F.col("rn") % 4 != 2, F.lit('transcript_id "a";'))
    value = F.concat_ws("\t", "chrom", F.lit("src"), F.lit("exon"), (F.col("s") + 1).cast("string"), end.cast("string"), F.lit("."), strand, F.lit("."), attrs)
    parsed = gxf.parse_gxf(lines_of(e.select(F.col("k").alias("line"), value.alias("value"))), "gtf")
    kind = F.when(F.col("_error").contains("must be >="), "end").when(F.col("_error").contains("strand"), "strand").when(F.col("_error").contains("missing field"), "short")
    return parsed.groupBy(kind.alias("error")).agg(F.count("*").alias("n"))


@query("k02_extras_policy", f"{SQL} SELECT {_tabbed(*_COLUMNS[3], 'cust')} || {_TAB} || prio || ',' || status || {_TAB} || 'note=' || status AS value FROM t")
def extras_policy(spark, sf_dir):
    return writers.to_bed(bridge.records(spark, sf_dir), 3, WriterOptions(other_extras=True))


@query("k09_allow_list", f"{SQL} SELECT {_tabbed(*_COLUMNS[3], 'cust')} || {_TAB} || 'note=' || status AS value FROM t")
def allow_list(spark, sf_dir):
    return writers.to_bed(bridge.records(spark, sf_dir), 3, WriterOptions(other_extras=True, allow=frozenset({"13", "note"})))


@query("k10_no_numeric_extras", f"{SQL} SELECT {_tabbed(*_COLUMNS[3])} || {_TAB} || 'note=' || status AS value FROM t")
def no_numeric_extras(spark, sf_dir):
    return writers.to_bed(bridge.records(spark, sf_dir), 3, WriterOptions(numeric_extras=False, other_extras=True))


@query("k16_bed_text", f"{SQL}, {_BLOCKS} SELECT {_tabbed(*_COLUMNS[12])} AS value {_FROM}")
def bed_text(spark, sf_dir):
    return bridge.records(spark, sf_dir).select(writers.bed_text(12).alias("value"))


@query("k17_bed_plus_n", f"{SQL}, {_BLOCKS} SELECT {_tabbed(*_COLUMNS[12], 'cust')} || {_TAB} || prio || ',' || status AS value {_FROM}")
def bed_plus_n(spark, sf_dir):
    return bridge.records(spark, sf_dir).select(writers.bed_text(12, 2).alias("value"))


def _line(feature: str, s: str, en: str, phase: str, attrs: str, alias: str = "") -> str:
    return f"{alias}chrom || {_TAB} || 'locusframe' || {_TAB} || {feature} || {_TAB} || CAST({s} + 1 AS VARCHAR) || {_TAB} || CAST({en} AS VARCHAR) || {_TAB} || '.' || {_TAB} || {alias}strand || {_TAB} || {phase} || {_TAB} || {attrs}"


def _writer_sql(transcript: str, attrs: str) -> str:
    codons = f"g AS (SELECT name, t.chrom, t.strand, cust, prio, status, cs, ce FROM t JOIN {_SPANS} USING (name))"
    low, high = ("cs", "least(cs + 3, ce)"), ("greatest(ce - 3, cs)", "ce")
    pick = lambda a, b, i: f"CASE strand WHEN '-' THEN {b[i]} ELSE {a[i]} END"
    parts = [
        f"SELECT {_line(repr(transcript), 'st', 'en', repr('.'), attrs)} AS value FROM t",
        f"SELECT {_line(repr('exon'), 'e.s', 'e.en', repr('.'), attrs)} FROM e JOIN t USING (name)",
        f"SELECT {_line(repr('CDS'), 'p.s', 'p.en', 'CAST(ph AS VARCHAR)', attrs, 't.')} FROM p JOIN t USING (name)",
        f"SELECT {_line(repr('start_codon'), pick(low, high, 0), pick(low, high, 1), repr('.'), attrs)} FROM g",
        f"SELECT {_line(repr('stop_codon'), pick(high, low, 0), pick(high, low, 1), repr('.'), attrs)} FROM g",
    ]
    return f"{SQL}, {codons} " + " UNION ALL ".join(parts)


_SPANS = "(SELECT name, min(s) AS cs, max(en) AS ce FROM c GROUP BY name)"
_GTF_ATTRS = """'gene_id "g' || cust || '"; transcript_id "' || name || '"; tag "' || prio || ',' || status || '";'"""
_GFF_ATTRS = """'gene_id=g' || cust || ';transcript_id=' || name || ';ID=' || name || ';gene_id=g' || cust || ';tag=' || prio || ',' || status || ';transcript_id=' || name || ';'"""


@query("k03_gtf", _writer_sql("transcript", _GTF_ATTRS))
def gtf(spark, sf_dir):
    return writers.to_gxf(bridge.with_ids(bridge.records(spark, sf_dir)), "gtf").select("value")


@query("k03_gff", _writer_sql("mRNA", _GFF_ATTRS))
def gff(spark, sf_dir):
    return writers.to_gxf(bridge.with_ids(bridge.records(spark, sf_dir)), "gff").select("value")


def _numbered_sql(gtf_kind: bool) -> str:
    gene = "(CASE WHEN k % 3 = 0 THEN 'gene' || CAST(k // 3 AS VARCHAR) ELSE name END)"
    if gtf_kind:
        g = f"""'gene_id "' || {gene} || '"; 13 "' || cust || '";'"""
        tx = f"""'gene_id "' || {gene} || '"; transcript_id "' || name || '"; 13 "' || cust || '";'"""
        child = f"""'gene_id "' || {gene} || '"; transcript_id "' || name || '"; exon_number "' || CAST(no AS VARCHAR) || '"; 13 "' || cust || '";'"""
    else:
        g = f"'ID=' || {gene} || ';13=' || cust || ';'"
        tx = f"'ID=' || name || ';Parent=' || {gene} || ';13=' || cust || ';'"
        child = "'Parent=' || name || ';exon_number=' || CAST(no AS VARCHAR) || ';13=' || cust || ';'"
    number = "CASE t.strand WHEN '-' THEN t.n - rn + 1 ELSE rn END AS no"
    low, high = ("s", "least(s + 3, en)"), ("greatest(en - 3, s)", "en")
    ends = "WHERE (rn = {} )"
    first, last = "(SELECT min(rn) FROM q z WHERE z.name = q.name)", "(SELECT max(rn) FROM q z WHERE z.name = q.name)"
    codon = lambda name, plus, minus, a, b: " UNION ALL ".join(f"SELECT {_line(repr(name), part[0], part[1], repr('.'), child)} FROM q {ends.format(at)} AND {cond}" for cond, part, at in (("strand <> '-'", a, plus), ("strand = '-'", b, minus)))
    parts = [
        f"SELECT {_line(repr('gene'), 'st', 'en', repr('.'), g)} AS value FROM t",
        f"SELECT {_line(repr('transcript' if gtf_kind else 'mRNA'), 'st', 'en', repr('.'), tx)} FROM t",
        f"SELECT {_line(repr('exon'), 's', 'en', repr('.'), child)} FROM (SELECT t.chrom, t.strand, t.name, t.k, cust, e.s, e.en, {number} FROM e JOIN t USING (name))",
        f"SELECT {_line(repr('CDS'), 's', 'en', 'CAST(ph AS VARCHAR)', child)} FROM q",
        codon("start_codon", first, last, low, high),
        codon("stop_codon", last, first, high, low),
    ]
    return f"{SQL}, q AS (SELECT t.chrom, t.strand, t.name, t.k, cust, p.s, p.en, p.rn, ph, {number} FROM p JOIN t USING (name)) " + " UNION ALL ".join(parts)


def _numbered(spark, sf_dir, kind: str) -> DataFrame:
    gene = F.when(F.col("k") % 3 == 0, F.concat(F.lit("gene"), F.expr("k div 3").cast("string")))
    return bridge.records(spark, sf_dir).withColumn("gene", gene).select(F.explode(writers.gxf_text(kind, 1, F.col("gene"))).alias("value"))


@query("k19_gtf", _numbered_sql(True))
def numbered_gtf(spark, sf_dir):
    return _numbered(spark, sf_dir, "gtf")


@query("k19_gff", _numbered_sql(False))
def numbered_gff(spark, sf_dir):
    return _numbered(spark, sf_dir, "gff")


@query("k25_record_text", f"{SQL}, {_BLOCKS} SELECT {_tabbed('name', 'chrom', 'strand', _V('st'), _V('en'), _V('coalesce(ts, st)'), _V('coalesce(te, en)'), _V('n'), 'starts', 'ends')} || {_TAB} || '13=' || cust || {_TAB} || '14=' || prio || ',' || status || {_TAB} || 'note=' || status AS value {_FROM}")
def record_text(spark, sf_dir):
    return bridge.records(spark, sf_dir).select(writers.record_text().alias("value"))


_OUT = "SELECT e.name, t.chrom, t.strand, e.s, least(e.en, ts) AS en, 'L' AS side FROM e JOIN t USING (name) WHERE ts < te AND e.s < least(e.en, ts) UNION ALL SELECT e.name, t.chrom, t.strand, greatest(e.s, te), e.en, 'R' FROM e JOIN t USING (name) WHERE ts < te AND greatest(e.s, te) < e.en"
_EXTRACTED = {
    "exons": "SELECT e.name, t.chrom, t.strand, e.s, e.en FROM e JOIN t USING (name)",
    "cds": "SELECT name, chrom, strand, s, en FROM c",
    "introns": "SELECT * FROM (SELECT e.name, t.chrom, t.strand, e.en AS s, lead(e.s) OVER (PARTITION BY e.name ORDER BY rn) AS en FROM e JOIN t USING (name)) WHERE s < en",
    "utr": f"SELECT * FROM ({_OUT})",
    "fiveutr": f"SELECT * FROM ({_OUT}) WHERE (strand = '+' AND side = 'L') OR (strand = '-' AND side = 'R')",
    "threeutr": f"SELECT * FROM ({_OUT}) WHERE (strand = '+' AND side = 'R') OR (strand = '-' AND side = 'L')",
}
for _kind, _sql in _EXTRACTED.items():

    @query(f"t01_{_kind}", f"{SQL} SELECT {_tabbed('chrom', _V('s'), _V('en'), 'name', repr('0'), 'strand', _V('s'), _V('en'), repr('0,0,0'))} AS value FROM ({_sql})")
    def _extract(spark, sf_dir, kind=_kind):
        return extract.extract(bridge.records(spark, sf_dir), kind, 9)


@query("t04_extra_columns", f"{SQL} SELECT {_tabbed('chrom', _V('e.s'), _V('e.en'), 'name', repr('0'), 'strand', 'cust', repr('.'))} || {_TAB} || prio || ',' || status AS value FROM e JOIN t USING (name)")
def extra_columns(spark, sf_dir):
    return extract.extract(bridge.records(spark, sf_dir), "exons", 6, ("13", "nothing", "14"))


@query("a10_feature_counts", f"{SQL} SELECT (SELECT count(*) FROM t) AS records_in, (SELECT count(*) FROM c) AS intervals_out")
def feature_counts(spark, sf_dir):
    return extract.counts(bridge.records(spark, sf_dir), "cds")


@query("x02_chunk_ids", f"{SQL} SELECT k AS line, (row_number() OVER (ORDER BY k) - 1) // 1000 AS chunk FROM t")
def chunk_ids(spark, sf_dir):
    lines = _lines(bridge.records(spark, sf_dir), writers.bed_line(3))
    return chunks.chunk_ids(lines, 1000).select(F.col("_line").alias("line"), "chunk")


@query("x06_user_format", f"{SQL} SELECT chrom, en - st AS length FROM t")
def user_format(spark, sf_dir):
    lines = _lines(bridge.records(spark, sf_dir), writers.bed_line(3, WriterOptions(numeric_extras=False)))
    own = chunks.LineFormat(3, lambda c: {"chrom": c[0], "length": c[2].try_cast("bigint") - c[1].try_cast("bigint")})
    return own.read(lines).select("chrom", "length")


@query("x04_stream_ingest", f'{SQL} SELECT chrom, strand, count(*) AS n, CAST(sum(en - st) AS BIGINT) AS bases FROM t GROUP BY chrom, strand')
def stream_ingest(spark, sf_dir):
    at = scratch(spark, "stream")
    writers.write_lines(writers.to_bed(bridge.records(spark, sf_dir), 6, WriterOptions(numeric_extras=False)), f"{at}/in")
    ingest(stream_bed(spark, f"{at}/in", 6), f"{at}/out", f"{at}/progress")
    return spark.read.parquet(f"{at}/out").groupBy("chrom", "strand").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"))
