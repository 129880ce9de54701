"""Files read, grouped, extracted, linted and pruned; the texts are those of a fixture table."""

import bz2
import gzip

import pytest
import zstandard
from pyspark.sql import functions as F

from locusframe import cli
from locusframe.functions import attributes
from locusframe.operators import chunks, extract, lint, writers
from locusframe.plans import registry
from locusframe.schema import FormatError, GroupOptions, WriterOptions
from locusframe.sources import bed, detect, gxf
from locusframe.sources.lines import read_lines
from locusframe.streaming.bed_stream import ingest, stream_bed


def gtf(*rows, ids='gene_id "g1"; transcript_id "tx1";', strand="+", chrom="chr1"):
    return "".join(f"{chrom}\tsource\t{f}\t{s}\t{e}\t.\t{strand}\t.\t{ids}{extra}\n" for f, s, e, extra in rows)


SIMPLE = gtf(("transcript", 100, 200, ' gene_name "Zeta9";'), ("exon", 100, 150, ""), ("exon", 170, 200, ""), ("CDS", 120, 180, ""))
FILES = {
    "bed3.bed": "chr1\t0\t100\nchr1\t150\t200\n",
    "bed6.bed": "chr1\t0\t100\talfa\t500\t+\nchr1\t150\t250\tbeta\t900\t-\n",
    "bed12.bed": "chr1\t100\t400\tmrnA\t950\t+\t120\t360\t0,128,0\t2\t80,60,\t0,200,\n",
    "bed12_extra.bed": "chr2\t50\t250\tmrnB\t800\t-\t70\t200\t128,0,0\t3\t60,40,50\t0,100,150\tfoo\tbar\n",
    "simple.gtf": SIMPLE,
    "simple.gff": "##gff-version 3\n" + "".join(f"chr1\tsource\t{f}\t{s}\t{e}\t.\t+\t.\t{a}\n" for f, s, e, a in [("mRNA", 100, 200, "ID=tx1;Name=Mone"), ("exon", 100, 150, "Parent=tx1"), ("exon", 170, 200, "Parent=tx1"), ("CDS", 120, 180, "Parent=tx1")]),
    "parentless.gtf": 'chr1\tsource\tgene\t100\t200\t.\t+\t.\tgene_id "g1"; gene_name "Zeta9";\n' + SIMPLE,
    "single.gtf": gtf(("five_prime_utr", 4711, 4711, ' gene_name "Zeta9";'), ("exon", 4711, 4711, ""), strand="-"),
    "stop.gtf": gtf(("transcript", 100, 200, ""), ("exon", 100, 200, ""), ("CDS", 110, 190, ""), ("stop_codon", 100, 102, ""), strand="-"),
    "codons.gtf": gtf(("transcript", 51, 250, ""), ("exon", 51, 150, ""), ("exon", 180, 250, ""), ("CDS", 73, 150, ""), ("CDS", 180, 197, ""), ("start_codon", 70, 72, ""), ("stop_codon", 198, 200, ""), chrom="chrQ"),
    "mixed.gtf": "# keep this\n" + gtf(("transcript", 1, 100, ""), ("exon", 1, 50, "")) + gtf(("transcript", 200, 250, ""), ("exon", 100, 120, ""), ids='gene_id "g2"; transcript_id "bad";'),
    "swapped.bed": "# comment\nchr1\t0\t10\nchr1\t20\t20\nchr2\t5\t8\n",
    "rgb9.bed": "chr1\t0\t10\ttx1\t500\t+\t0\t10\t255,0,300\n",
    "rgb12.bed": "chr1\t0\t10\ttx1\t500\t+\t0\t10\t255,0,bad\t1\t10\t0\n",
    "plus4.bed": "chr1\t0\t10\ttx1\t500\t+\t0\t10\tnot_rgb\textra\n",
    "lone.bed": "chr1\t100\t200\ttx\t0\t+\t100\t200\t0,0,0\t1\t100,\t0,\n",
    "odd.bed": "browser x\ntrack y\n\n  chr1\t\t10\t20\t\nchr1\tx\t30\n  # no\nchr1\t5\n",
    "sniffed": "#c\n" + SIMPLE,
}


@pytest.fixture(scope="session")
def path(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for name, text in FILES.items():
        (folder / name).write_text(text)
    raw = FILES["bed3.bed"].encode()
    (folder / "bed3.bed.gz").write_bytes(gzip.compress(raw[:13]) + gzip.compress(raw[13:]))
    (folder / "bed3.bed.bz2").write_bytes(bz2.compress(raw))
    (folder / "bed3.bed.zst").write_bytes(zstandard.compress(raw))
    (folder / "simple.gtf.gz").write_bytes(gzip.compress(SIMPLE.encode()))
    return lambda name: str(folder / name)


def shape(r):
    return r.chrom, r.start, r.end, r.name, r.strand, r.thick_start, r.thick_end, list(zip(r.block_starts, r.block_ends))


def test_bed_files(spark, path):
    assert [(r.start, r.end, r.strand) for r in bed.read_bed(spark, path("bed3.bed"), 3).orderBy("_line").collect()] == [(0, 100, None), (150, 200, None)]
    assert [(r.name, r.strand) for r in bed.read_bed(spark, path("bed6.bed"), 6).orderBy("_line").collect()] == [("alfa", "+"), ("beta", "-")]
    assert shape(bed.read_bed(spark, path("bed12.bed"), 12).first()) == ("chr1", 100, 400, "mrnA", "+", 120, 360, [(100, 180), (300, 360)])
    extra = bed.read_bed(spark, path("bed12_extra.bed"), 12, 2).first()
    assert shape(extra)[7] == [(50, 110), (150, 190), (200, 250)] and extra.extras == {"13": ["foo"], "14": ["bar"]}
    assert bed.read_bed(spark, path("bed12_extra.bed"), 6).first().extras == {}
    for codec in ("gz", "bz2", "zst"):
        assert bed.read_bed(spark, path(f"bed3.bed.{codec}"), 3).count() == 2


def test_line_numbers_skips_and_errors(spark, path):
    rows = bed.read_bed(spark, path("odd.bed"), 3).orderBy("_line").collect()
    assert [(r._line, r.start, r._error is None) for r in rows] == [(4, 10, True), (5, None, False), (7, 5, False)]
    assert "chromStart" in rows[1]._error and "2 fields, expected 3" in rows[2]._error
    assert bed.read_bed(spark, path("odd.bed"), 3, mode="drop").count() == 1
    with pytest.raises(Exception, match="line [57]"):
        bed.read_bed(spark, path("odd.bed"), 3, mode="strict").collect()


def test_line_numbers_over_many_splits(spark, tmp_path):
    for f in ("a", "b"):
        (tmp_path / f).write_text("".join(f"{f}{i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        wrong = read_lines(spark, str(tmp_path)).filter("substring(_raw, 2) <> _line - 1")
        assert wrong.count() == 0 and read_lines(spark, str(tmp_path)).count() == 40_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_first_wrong_field_gives_the_error(spark, tmp_path):
    (tmp_path / "x.bed").write_text("c\tx\ty\n" + "c\tx\t9\tn\t0\t+\t1\t2\t0,0,0\t2\t1,\t0,1,\n" + "c\t1\t9\tn\t1001\t*\n")
    p = str(tmp_path / "x.bed")
    assert "chromStart" in bed.read_bed(spark, p, 3).filter("_line = 1").first()._error
    assert "blockSizes" in bed.read_bed(spark, p, 12).filter("_line = 2").first()._error
    assert "score" in bed.read_bed(spark, p, 6).filter("_line = 3").first()._error


@pytest.mark.parametrize(
    "file, expected",
    [
        ("simple.gtf", ("chr1", 99, 200, "Zeta9", "+", 119, 180, [(99, 150), (169, 200)])),
        ("parentless.gtf", ("chr1", 99, 200, "Zeta9", "+", 119, 180, [(99, 150), (169, 200)])),
        ("simple.gtf.gz", ("chr1", 99, 200, "Zeta9", "+", 119, 180, [(99, 150), (169, 200)])),
        ("single.gtf", ("chr1", 4710, 4711, "Zeta9", "-", None, None, [(4710, 4711)])),
        ("stop.gtf", ("chr1", 99, 200, "tx1", "-", 99, 190, [(99, 200)])),
        ("codons.gtf", ("chrQ", 50, 250, "tx1", "+", 69, 200, [(50, 150), (179, 250)])),
        ("simple.gff", ("chr1", 99, 200, "Mone", "+", 119, 180, [(99, 150), (169, 200)])),
    ],
)
def test_grouped_files(spark, path, file, expected):
    rows = gxf.read_gxf(spark, path(file), "gff" if ".gff" in file else "gtf", strict=True).collect()
    assert [shape(r) for r in rows] == [expected]


def rows_of(spark, text, **options):
    from locusframe.sources.lines import lines_of

    lines = spark.createDataFrame(list(enumerate(text.splitlines(), 1)), "line bigint, value string")
    return gxf.transcripts(lines_of(lines), "gtf", **options)


def test_grouping_rules(spark):
    late = gtf(("exon", 10, 20, ""), ("exon", 5, 8, ' transcript_name "late"; tag "a";'), ("exon", 5, 9, ' tag "b"; tag "a";'), ("Exon", 0, 0, ""))
    r = rows_of(spark, late).first()
    assert r.name == "tx1" and list(zip(r.block_starts, r.block_ends)) == [(0, 0), (4, 8), (4, 9), (9, 20)] and r.extras["tag"] == ["a", "b"]
    nested = gtf(("transcript", 1, 100, ""), ("CDS", 10, 90, ""), ("CDS", 20, 30, ""))
    assert (lambda r: (r.thick_start, r.thick_end))(rows_of(spark, nested).first()) == (9, 30)
    outside = gtf(("transcript", 50, 60, ""), ("exon", 1, 100, ""))
    assert (lambda r: (r.start, r.end))(rows_of(spark, outside).first()) == (49, 60)
    kept = rows_of(spark, gtf(("transcript", 1, 9, ""), ("exon", 1, 9, ""), ("intron", 1, 90, "")), options=GroupOptions(child_features=None)).first()
    assert kept.end == 9


def test_conflicts_and_bad_lines(spark):
    turned = gtf(("exon", 1, 9, "")) + gtf(("exon", 20, 30, ""), strand="-")
    r = rows_of(spark, turned).first()
    assert (r.conflict_line, r.end, r.strand) == (2, 9, "+")
    with pytest.raises(Exception, match="line 2"):
        rows_of(spark, turned, strict=True).collect()
    bad = gtf(("exon", 1, 9, "")) + "chr1\ts\tintron\t9\t5\t.\t+\t.\ta \"b\"\n"
    assert rows_of(spark, bad).count() == 1
    with pytest.raises(Exception, match="must be >= start"):
        rows_of(spark, bad, strict=True).collect()


def test_attribute_marks_in_a_text(spark):
    df = spark.createDataFrame([('a "x\u0001y"; b "z";',), ('a "xy"; b "z"; f',), ('a "x;y" junk; b z ;',)], "t string")
    assert [[tuple(x) for x in r[0]] for r in df.select(attributes.tokens(F.col("t"), " ")).collect()] == [[("a", "x\u0001y"), ("b", "z")], [("a", "xy"), ("b", "z"), ("f", "")], [("a", "x;y"), ("b", "z")]]


def run(spark, capfdbinary, *argv):
    code = cli.main(list(argv), spark)
    out, err = capfdbinary.readouterr()
    return code, out.decode(), err.decode()


@pytest.mark.parametrize(
    "argv, out",
    [
        (["exons", "bed12.bed"], "chr1\t100\t180\tmrnA\t0\t+\nchr1\t300\t360\tmrnA\t0\t+\n"),
        (["exons", "simple.gtf"], "chr1\t99\t150\tZeta9\t0\t+\nchr1\t169\t200\tZeta9\t0\t+\n"),
        (["exons", "bed6.bed"], "chr1\t0\t100\talfa\t0\t+\nchr1\t150\t250\tbeta\t0\t-\n"),
        (["cds", "simple.gtf"], "chr1\t119\t150\tZeta9\t0\t+\nchr1\t169\t180\tZeta9\t0\t+\n"),
        (["cds", "bed6.bed"], ""),
        (["introns", "bed12.bed"], "chr1\t180\t300\tmrnA\t0\t+\n"),
        (["introns", "lone.bed"], ""),
        (["utr", "simple.gtf"], "chr1\t99\t119\tZeta9\t0\t+\nchr1\t180\t200\tZeta9\t0\t+\n"),
        (["fiveutr", "simple.gtf"], "chr1\t99\t119\tZeta9\t0\t+\n"),
        (["threeutr", "simple.gtf"], "chr1\t180\t200\tZeta9\t0\t+\n"),
        (["exons", "--type", "3", "bed12.bed"], "chr1\t100\t180\nchr1\t300\t360\n"),
        (["exons", "--type", "9", "bed12.bed"], "chr1\t100\t180\tmrnA\t0\t+\t100\t180\t0,0,0\nchr1\t300\t360\tmrnA\t0\t+\t300\t360\t0,0,0\n"),
        (["exons", "-a", "gene_id,nonexistent", "simple.gtf"], "chr1\t99\t150\tZeta9\t0\t+\tg1\t.\nchr1\t169\t200\tZeta9\t0\t+\tg1\t.\n"),
    ],
)
def test_feature_commands(spark, path, capfdbinary, argv, out):
    code, found, _ = run(spark, capfdbinary, *argv[:-1], path(argv[-1]))
    assert (code, found) == (0, out)


def test_feature_outputs_and_refusals(spark, path, capfdbinary, tmp_path):
    for name, opened in (("o.bed", open), ("o.bed.gz", gzip.open), ("o.bed.bz2", bz2.open), ("o.bed.zst", zstandard.open)):
        assert run(spark, capfdbinary, "exons", "-t", "3", "-o", str(tmp_path / name), "-i", path("bed12.bed"))[:2] == (0, "")
        with opened(tmp_path / name, "rt") as f:
            assert f.read() == "chr1\t100\t180\nchr1\t300\t360\n"
    code, _, err = run(spark, capfdbinary, "exons", "--type", "7", path("bed12.bed"))
    assert code == 2 and "unsupported --type 7" in err and "3, 4, 5, 6, 8, 9" in err
    assert run(spark, capfdbinary, "exons", "--type", "12", path("bed12.bed"))[0] == 2
    assert "OR positional" in run(spark, capfdbinary, "exons", "-i", path("bed3.bed"), path("bed3.bed"))[2]
    assert "no input provided" in run(spark, capfdbinary, "exons")[2]


def test_lint_commands(spark, path, capfdbinary):
    assert run(spark, capfdbinary, "lint", path("bed3.bed"))[0] == 0
    code, _, err = run(spark, capfdbinary, "lint", path("swapped.bed"))
    assert code == 1 and "line 3: start (20) must be less than end (20)" in err and "invalid=1" in err
    code, _, err = run(spark, capfdbinary, "lint", "--warn", path("swapped.bed"))
    assert code == 0 and "WARN:" in err
    assert run(spark, capfdbinary, "lint", "--prune", path("swapped.bed"))[:2] == (0, "chr1\t0\t10\nchr2\t5\t8\n")
    assert run(spark, capfdbinary, "lint", "-a", "4", path("plus4.bed"))[0] == 0
    assert run(spark, capfdbinary, "lint", "--prune", "-a", "4", path("plus4.bed"))[1] == FILES["plus4.bed"]
    for name in ("rgb9.bed", "rgb12.bed"):
        code, _, err = run(spark, capfdbinary, "lint", path(name))
        assert code == 1 and "itemRgb" in err
    code, _, err = run(spark, capfdbinary, "lint", "-a", "3", path("plus4.bed"))
    assert code == 2 and "leaves 7 standard field(s)" in err
    code, _, err = run(spark, capfdbinary, "lint", "-a", "1", path("simple.gtf"))
    assert code == 2 and "only supported for BED input" in err and "detected GTF" in err
    assert run(spark, capfdbinary, "lint", "--warn", "--prune", path("bed3.bed"))[0] == 2
    assert run(spark, capfdbinary, "lint", "--prune", path("simple.gtf.gz"))[:2] == (0, SIMPLE)
    code, out, err = run(spark, capfdbinary, "lint", "--prune", path("mixed.gtf"))
    assert code == 0 and "invalid=1" in err and out == "".join(FILES["mixed.gtf"].splitlines(True)[:3])


def test_whole_file_or_each_transcript(spark, path):
    lines = read_lines(spark, path("simple.gtf")).unionByName(spark.createDataFrame([("f", 99, "chr1\tx")], "_file string, _line bigint, _raw string"))
    found = lint.diagnosed_gxf(lines, "gtf").records
    assert tuple(lint.summary(found, "GTF").first()) == ("GTF", 2, 1, 1)
    assert tuple(lint.whole_file_summary(found, "GTF").first()) == ("GTF", 1, 0, 1)


def test_detection(spark, path):
    assert detect.detect_format(spark, path("sniffed")) == "GTF" and detect.format_of_name("x.GFF3.gz") == "GFF" and detect.codec("x.BED.GZ") is None
    assert detect.detect_layout(spark, path("bed12_extra.bed")) == (12, 2) and detect.detect_layout(spark, path("plus4.bed"), 4) == (6, 4)
    with pytest.raises(FormatError):
        gxf.read_gxf(spark, path("simple.gtf"), "gtf", additional_fields=1)


def test_chunks(spark, tmp_path):
    (tmp_path / "c.bed").write_text("chr1\t0\t1\n#\nchr1\t1\t2\nchr1\t2\t3\n")
    lines = read_lines(spark, str(tmp_path / "c.bed"))
    assert [(r._line, r.chunk) for r in chunks.chunk_ids(lines, 2).orderBy("_line").collect()] == [(1, 0), (3, 0), (4, 1)]
    with pytest.raises(FormatError):
        chunks.chunk_ids(lines, 0)


def test_stream_takes_in_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bed").write_text(FILES["bed6.bed"])
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    go = lambda: ingest(stream_bed(spark, str(tmp_path / "in"), 6), out, progress)
    go()
    (tmp_path / "in" / "b.bed").write_text("chr9\t1\t2\tx\t0\t+\nbad\n")
    go()
    rows = spark.read.parquet(out)
    assert rows.count() == 4 and rows.filter("_error IS NOT NULL").count() == 1


def test_empty_inputs(spark, tmp_path):
    (tmp_path / "e.bed").write_text("")
    (tmp_path / "e.gtf").write_text("# nothing\n")
    assert bed.read_bed(spark, str(tmp_path / "e.bed"), 12).count() == 0
    assert gxf.read_gtf(spark, str(tmp_path / "e.gtf")).count() == 0
    assert detect.detect_layout(spark, str(tmp_path / "e.bed")) == (3, 0)
    assert extract.counts(gxf.read_gtf(spark, str(tmp_path / "e.gtf")), "cds").first().intervals_out == 0


def test_sinks(spark, path, tmp_path):
    """A path is one file, or a folder of parts; suffixes compress, and what is there is not written over."""
    df = writers.to_bed(bed.read_bed(spark, path("bed12.bed"), 12), 12, WriterOptions())
    text = df.first()["value"] + "\n"
    for name, opened in (("x.bed", open), ("x.bed.gz", gzip.open), ("x.bed.bz2", bz2.open), ("x.bed.zst", zstandard.open)):
        writers.write_lines(df, str(tmp_path / name), single=True)
        with opened(tmp_path / name, "rt") as f:
            assert f.read() == text
        assert bed.read_bed(spark, str(tmp_path / name), 12).count() == 1
        writers.write_lines(df.unionByName(df).repartition(2), str(tmp_path / "parts" / name))
        assert (tmp_path / "parts" / name).is_dir() and bed.read_bed(spark, str(tmp_path / "parts" / name), 12).count() == 2
        writers.write_lines(df.limit(0), str(tmp_path / f"empty-{name}"), single=True)
        assert bed.read_bed(spark, str(tmp_path / f"empty-{name}"), 12).count() == 0
        with pytest.raises(FormatError):
            writers.write_lines(df, str(tmp_path / name), single=True)
    assert not [f for f in tmp_path.iterdir() if f.name.startswith("_")]


def test_codec_by_name(spark, path, tmp_path):
    """Files under other suffixes, of several frames and with blanks in their names, are unpacked as streams."""
    from locusframe.sources.lines import read_encoded_lines

    raw = b"".join(b"chr1\t%d\t%d\r\n" % (i, i + 1) for i in range(70_000))
    packed = {"gzip": gzip.compress(raw[:1000]) + gzip.compress(raw[1000:]), "bzip2": bz2.compress(raw), "zstd": zstandard.compress(raw[:1000]) + zstandard.compress(raw[1000:])}
    for codec, data in packed.items():
        (tmp_path / f"a {codec}%20.bin").write_bytes(data)
        rows = read_encoded_lines(spark, str(tmp_path / f"a {codec}%20.bin"), codec)
        assert rows.count() == 70_000 and rows.filter("_raw <> concat_ws('\t', 'chr1', _line - 1, _line)").count() == 0
    with pytest.raises(FormatError):
        read_encoded_lines(spark, str(tmp_path), "lz4")


def test_prune_reads_and_shuffles_lines_once(spark, tmp_path):
    (tmp_path / "m.gtf").write_text(FILES["mixed.gtf"])
    lines = spark.read.text(str(tmp_path / "m.gtf")).select(F.lit("f").alias("_file"), F.monotonically_increasing_id().alias("_line"), F.col("value").alias("_raw"))
    plan = lint.prune_gxf(lines, "gtf")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") == 1 and plan.count("Exchange") == 1 and "Join" not in plan


def test_map_batches(spark, path):
    import pyarrow as pa

    def named(batch):
        return pa.RecordBatch.from_arrays([pa.array([f"{n}!" for n in batch.column("name").to_pylist()])], ["name"])

    rows = chunks.map_batches(bed.read_bed(spark, path("bed6.bed"), 6).select("name"), named, "name string")
    assert sorted(r.name for r in rows.collect()) == ["alfa!", "beta!"]


def test_layout_query_runs_the_detection(spark, monkeypatch):
    seen, real = [], detect.detect_layout
    monkeypatch.setattr(detect, "detect_layout", lambda *a: seen.append(real(*a)) or seen[-1])
    row = registry.QUERIES["s42_detected_layout"](spark, "/root/testdata/sf0.001").first()
    assert seen == [(6, 2)] and (row["width"], row["additional"]) == (6, 2)


@pytest.mark.parametrize("suffix, mark", [("gz", b"\x1f\x8b\x08"), ("bz2", b"BZh9\x31\x41\x59\x26"), ("zst", b"\x28\xb5\x2f\xfd")])
def test_a_single_file_is_written_by_many_tasks(spark, tmp_path, suffix, mark):
    """Each task compresses its part; the parts follow one another in the one file, in order."""
    df, path = spark.range(0, 9000, 1, 5).select(F.col("id").cast("string").alias("value")), str(tmp_path / f"x.{suffix}")
    writers.write_lines(df, path, single=True)
    assert open(path, "rb").read().count(mark) >= 5
    assert [r._raw for r in read_lines(spark, path).orderBy("_line").collect()] == [str(i) for i in range(9000)]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == [f"x.{suffix}"]
