"""Derived intervals, counts, predicates, extras and written text, on hand-made records."""

import pytest
from pyspark.sql import functions as F

from locusframe.functions import extras as ex
from locusframe.functions import intervals as iv
from locusframe.functions.arrays import let
from locusframe.operators import writers
from locusframe.schema import RECORD_DDL, FormatError, WriterOptions

BLOCKS = dict(block_count=3, block_starts=[10, 40, 100], block_ends=[30, 90, 120])
TX1 = dict(chrom="chr1", start=99, end=200, name="tx1", strand="+", thick_start=119, thick_end=180, block_count=2, block_starts=[99, 169], block_ends=[150, 200])
TXR = dict(chrom="chr2", start=0, end=90, name="rev1", strand="-", thick_start=10, thick_end=80, block_count=2, block_starts=[0, 40], block_ends=[20, 80])


def frame(spark, *rows):
    base = dict(chrom="chr1", start=10, end=120, name=None, strand=None, thick_start=None, thick_end=None, block_count=None, block_starts=None, block_ends=None, extras={})
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], RECORD_DDL)


def pairs(df, column):
    return [[tuple(x) for x in r[0]] for r in df.select(column).collect()]


def one(df, column):
    return df.select(column).first()[0]


def test_exons_skip_empty_blocks_and_fall_back_to_the_record(spark):
    df = frame(
        spark, BLOCKS, dict(block_count=2, block_starts=[10, 40], block_ends=[10, 50]), dict(block_count=2, block_starts=[10], block_ends=[10]), dict(start=9, end=9), dict(block_count=5, block_starts=[1, 2], block_ends=[2]), dict(block_count=1, block_starts=[], block_ends=[]), dict(block_count=0, block_starts=[], block_ends=[])
    )
    assert pairs(df, iv.exons()) == [[(10, 30), (40, 90), (100, 120)], [(40, 50)], [(10, 120)], [(9, 9)], [(1, 2)], [(10, 120)], [(10, 120)]]


def test_introns_counts_and_lengths(spark):
    m = iv.with_measures(frame(spark, BLOCKS | dict(thick_start=50, thick_end=80))).first()
    assert (m.exonic_length, m.intronic_length, m.cds_length, m.utr_length, m.exon_count, m.intron_count) == (90, 20, 30, 60, 3, 2)
    assert pairs(frame(spark, BLOCKS), let(iv.exons(), iv.introns)) == [[(30, 40), (90, 100)]]


@pytest.mark.parametrize("strand, five, three", [("+", [(10, 30), (40, 50)], [(80, 90), (100, 120)]), ("-", [(80, 90), (100, 120)], [(10, 30), (40, 50)]), (".", [], []), (None, [], [])])
def test_untranslated_regions(spark, strand, five, three):
    df = frame(spark, BLOCKS | dict(thick_start=50, thick_end=80, strand=strand))
    assert pairs(df, let(iv.exons(), iv.utr)) == [[(10, 30), (40, 50), (80, 90), (100, 120)]]
    assert pairs(df, let(iv.exons(), iv.five_prime_utr)) == [five]
    assert pairs(df, let(iv.exons(), iv.three_prime_utr)) == [three]


def test_touching_and_non_coding(spark):
    touching = dict(start=10, end=40, block_count=3, block_starts=[10, 20, 30], block_ends=[20, 30, 40], thick_start=20, thick_end=30)
    df = frame(spark, touching, touching | dict(thick_end=20), touching | dict(thick_start=None))
    assert pairs(df, let(iv.exons(), iv.utr)) == [[(10, 20), (30, 40)], [], []]
    assert pairs(df, let(iv.exons(), iv.cds)) == [[(20, 30)], [], []]


def test_overlap_truth_table(spark):
    df = frame(spark, dict(start=10, end=20))
    queries = {(0, 10): False, (0, 11): True, (10, 20): True, (12, 13): True, (19, 30): True, (20, 30): False, (15, 15): True, (10, 10): False, (5, 25): True}
    for (s, e), expected in queries.items():
        assert one(df, iv.overlaps(F.lit(s), F.lit(e))) is expected, (s, e)


def test_phases_and_codons(spark):
    df = frame(spark, TX1, TXR, TXR | dict(strand="."), dict(start=0, end=10, thick_start=2, thick_end=3, strand="+"))
    coding = let(iv.exons(), iv.cds)
    assert pairs(df, let(coding, iv.phases)) == [[(119, 150, 0), (169, 180, 2)], [(10, 20, 2), (40, 80, 0)], [(10, 20, 0), (40, 80, 2)], [(2, 3, 0)]]
    spans = lambda f: [tuple(r[0]) for r in df.select(let(coding, lambda c: f(iv.coding_span(c)))).collect()]
    assert spans(iv.start_codon) == [(119, 122), (77, 80), (10, 13), (2, 3)]
    assert spans(iv.stop_codon) == [(177, 180), (10, 13), (77, 80), (2, 3)]


def test_record_text(spark):
    df = frame(spark, dict(end=20), dict(end=20, name="alfa", strand="+"), dict(end=100, name="beta", strand="-", thick_start=10, thick_end=100, block_count=2, block_starts=[10, 40], block_ends=[20, 60], extras={"second": ["extra2"], "first": ["extra1"]}))
    assert [r[0] for r in df.select(writers.record_text()).collect()] == [
        ".\tchr1\t.\t10\t20\t10\t20\t0\t\t",
        "alfa\tchr1\t+\t10\t20\t10\t20\t0\t\t",
        "beta\tchr1\t-\t10\t100\t10\t100\t2\t10,40\t20,60\tfirst=extra1\tsecond=extra2",
    ]


def test_bed_text_of_each_width(spark):
    row = dict(end=100, name="alfa", strand="+", thick_start=20, thick_end=90, block_count=2, block_starts=[10, 40], block_ends=[20, 60], extras={"4": ["no"], "13": ["foo"], "14": ["bar", "baz"]})
    df = frame(spark, row)
    full = "chr1\t10\t100\talfa\t0\t+\t20\t90\t0,0,0\t2\t10,20,\t0,30,".split("\t")
    for width in (3, 4, 5, 6, 8, 9, 12):
        assert one(df, writers.bed_text(width)) == "\t".join(full[:width])
    assert one(df, writers.bed_text(12, 2)) == "\t".join([*full, "foo", "bar,baz"])
    assert one(frame(spark, row | dict(extras={"rgb": ["1,2,3"]})), writers.bed_text(9)).endswith("\t1,2,3")
    assert one(frame(spark, row | dict(extras={"rgb": ["1,2,3"]})), writers.bed_line(9)).endswith("\t0,0,0")
    with pytest.raises(Exception, match="missing additional BED field key '15'"):
        df.select(writers.bed_text(12, 3)).collect()
    with pytest.raises(FormatError, match="unsupported BED width 7"):
        writers.bed_line(7)


def test_numbered_gtf_and_gff_with_a_gene_map(spark):
    df = frame(spark, TX1 | dict(extras={"13": ["foo"], "14": ["bar", "baz"]}))
    ids, more = 'gene_id "gene1"; transcript_id "tx1"; ', '13 "foo"; 14 "bar,baz";'
    rows = [("gene", 100, 200, ".", 'gene_id "gene1"; '), ("transcript", 100, 200, ".", ids), ("exon", 100, 150, ".", ids + 'exon_number "1"; '), ("exon", 170, 200, ".", ids + 'exon_number "2"; '), ("CDS", 120, 150, "0", ids + 'exon_number "1"; '), ("CDS", 170, 180, "2", ids + 'exon_number "2"; '), ("start_codon", 120, 122, ".", ids + 'exon_number "1"; '), ("stop_codon", 178, 180, ".", ids + 'exon_number "2"; ')]
    assert one(df, writers.gxf_text("gtf", 2, F.lit("gene1"), "src")) == [f"chr1\tsrc\t{f}\t{s}\t{e}\t.\t+\t{p}\t{a}{more}" for f, s, e, p, a in rows]
    gff = one(df, writers.gxf_text("gff", 1, F.lit("gene1"), "src"))
    assert [line.split("\t")[8] for line in gff][:4] == ["ID=gene1;13=foo;", "ID=tx1;Parent=gene1;13=foo;", "Parent=tx1;exon_number=1;13=foo;", "Parent=tx1;exon_number=2;13=foo;"]
    assert [line.split("\t")[8] for line in one(frame(spark, TXR), writers.gxf_text("gff"))][2:4] == ["Parent=rev1;exon_number=2;", "Parent=rev1;exon_number=1;"]
    with pytest.raises(Exception, match="missing numeric GXF additional fields"):
        df.select(writers.gxf_text("gtf", 3)).collect()
    with pytest.raises(FormatError, match="unsupported layout"):
        writers.gxf_text("bed12")


def test_written_gtf_and_gff(spark):
    gtf = one(frame(spark, TX1 | dict(extras={"tag": ["a", "b"]})), writers.gxf_lines("gtf", WriterOptions(source="src")))
    assert len(gtf) == 7
    assert gtf[0].startswith("chr1\tsrc\ttranscript\t100\t200\t.\t+\t.\t")
    assert gtf[3] == 'chr1\tsrc\tCDS\t120\t150\t.\t+\t0\tgene_id "tx1"; transcript_id "tx1"; tag "a,b";'
    assert "\t+\t2\t" in gtf[4] and "\t120\t122\t" in gtf[5] and "\t178\t180\t" in gtf[6]
    gff = one(frame(spark, TXR), writers.gxf_lines("gff"))
    assert "\tCDS\t11\t20\t.\t-\t2\t" in gff[3] and "\tCDS\t41\t80\t.\t-\t0\t" in gff[4]
    assert "\tstart_codon\t78\t80\t" in gff[5] and "\tstop_codon\t11\t13\t" in gff[6]
    given = frame(spark, TX1 | dict(extras={"gene_id": ["gene1"], "transcript_id": ["tx1"], "tag": ["keep"]}))
    assert one(given, writers.gxf_lines("gtf", WriterOptions(allow=frozenset({"tag"}))))[0].endswith('\ttag "keep";')
    assert one(frame(spark, TX1), writers.gxf_lines("gff", WriterOptions(allow=frozenset())))[0].endswith("\t;")


def test_extras_policies_of_bed_lines(spark):
    df = frame(spark, dict(end=20, extras={"4": ["fourth"], "3": ["third"], "note": ["keep"]}))
    line = lambda **o: one(df, writers.bed_line(3, WriterOptions(**o)))
    assert line() == "chr1\t10\t20\tthird\tfourth"
    assert line(other_extras=True) == "chr1\t10\t20\tthird\tfourth\tnote=keep"
    assert line(other_extras=True, numeric_extras=False) == "chr1\t10\t20\tnote=keep"
    assert line(other_extras=True, allow=frozenset({"4", "note"})) == "chr1\t10\t20\tfourth\tnote=keep"
    with pytest.raises(Exception, match="missing field: chrom"):
        writers.to_bed(frame(spark, dict(chrom=""))).collect()


def test_extras(spark):
    df = frame(spark, dict(extras={"b": ["x,y", "z"], "a": [""]}))
    e = F.col("extras")
    assert one(df, ex.get_extra(ex.add_extra(e, "b", F.lit("z")), "b")) == ["x,y", "z"]
    assert one(df, ex.get_extra(ex.add_extra(e, "b", F.lit("w")), "b")) == ["x,y", "z", "w"]
    assert one(df, ex.get_extra(ex.add_extra(e, "c", F.lit("w")), "c")) == ["w"]
    assert one(df, ex.unnest(e, ",")) == ["x", "y", "z"]
    assert one(df, ex.unnest(e, "")) == ["x,y", "z"]
    assert one(df, ex.is_blank(e["a"])) is True
