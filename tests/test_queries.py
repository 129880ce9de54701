"""Every registered query of the reference's operators against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from locusframe.plans import registry

DATA = "/root/testdata/sf0.001"
TYPES = {"BIGINT": "bigint", "VARCHAR": "string", "INTEGER": "int", "BOOLEAN": "boolean", "DOUBLE": "double"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df, sql = registry.QUERIES[name](spark, DATA), duck.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(sql.columns) == columns
    types = dict(zip(sql.columns, map(str, sql.types)))
    assert {c: TYPES[types[c]] for c in columns} == dict(df.dtypes)
    places = [sql.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in places)) for r in sql.fetchall())


def test_interval_join_plans_as_an_equi_join(spark):
    plan = registry.QUERIES["j02_interval_join"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["j01_gene_map"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan


@pytest.mark.parametrize("name, part, most", [("s05_bed12_parse", "invalid blockSizes: expected unsigned", 1), ("s05_bed12_parse", "concat_ws(", 2), ("a01_group_written_gff", "invalid coordinates", 1), ("a01_group", "regexp_extract_all", 0), ("s15_gff_attributes", "regexp_extract_all", 1), ("s32_read_gtf", "invalid coordinates", 1), ("s33_read_gff", "invalid coordinates", 1)])
def test_what_is_parsed_once_is_not_copied_into_filters(spark, name, part, most):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(part) <= most


@pytest.mark.parametrize("name", ["l06_gtf_counts", "a01_group", "l08_whole_file", "a05_merge_attributes", "a06_name_first_line", "j03_prune_semi_join", "l04_prune_gtf", "f03_feature_filter"])
def test_lines_are_grouped_before_the_shuffle_and_in_all_partitions(spark, name):
    query = registry.QUERIES[name](spark, DATA)._jdf.queryExecution()
    plan = query.optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert not [step for step in plan.splitlines() if "Window [" in step and "_hash" in step]
    steps = query.sparkPlan().toString()
    assert "partial_collect_list" in steps and "array_sort" not in steps


@pytest.mark.parametrize("name", ["a01_group", "a05_merge_attributes", "a06_name_first_line"])
def test_windows_copy_only_the_rows_before_the_join(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Join ") < plan.index("Window [")


@pytest.mark.parametrize("name", ["a01_group", "a06_name_first_line"])
def test_lines_are_made_of_two_windows_and_a_number_s_end_is_looked_at_once(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and plan.count("substring(_f") == 2


def test_the_transcript_line_reaches_from_the_least_start_to_the_greatest_end(spark, tmp_path):
    from locusframe.plans import bridge

    items = [(1, n, 7, 7, q, 1.0, "N") for n, q in ((3, 4.0), (1, 900.0), (2, 5.0))] + [(2, 1, 7, 7, 6.0, 1.0, "R"), (2, 1, 6, 7, 8.0, 1.0, "N")]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 5, "F", "1"), (2, 6, "O", "2")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted((r["_line"], *r["_raw"].split("\t")[2:5]) for r in bridge.lines(spark, str(tmp_path)).collect())
    one = [(1000, "transcript", "10001", "10900"), (1002, "exon", "10001", "10900"), (1004, "exon", "10101", "10105"), (1006, "exon", "10201", "10204")]
    assert got == one + [(2000, "transcript", "20001", "20106"), (2002, "exon", "20001", "20008"), (2004, "exon", "20101", "20106"), (2005, "CDS", "20101", "20106")]


@pytest.mark.parametrize("separator, key", [(" ", "id"), ("=", "id"), (" ", "i+d"), ("=", "i+d")])
def test_a_value_is_the_same_with_and_without_a_look_at_its_quote(spark, separator, key):
    from pyspark.sql import functions as F

    from locusframe.functions.attributes import found_of, tokens, value_of

    quoted = [f'{key}{separator}"a b";', f'x{separator}"{key}"; {key}{separator}  "a"; {key}{separator}"late"', f'{key} {separator}"a;b"', f'{key}{separator}"";', f'{key}{separator}"open', f'{key}{separator}"\u00e9 " ; x{separator}1', f'{key}{separator}" a"']
    other = [f'{key}{separator}a"b" ;', f"{key}{separator};", f"x{separator}1; {key}", f'x{separator}"1 {key}{separator}2"', f'x{key}{separator}"1";', "", None]
    rows = spark.createDataFrame([(t,) for t in quoted + other], "t string").withColumn("f", found_of(F.col("t"), separator, key)).coalesce(1)
    first = F.get(F.filter(tokens(F.col("t"), separator), lambda x: x["k"] == key), F.lit(0))["v"]
    for r in rows.select("t", value_of(F.col("f"), separator, "other", key).alias("a"), value_of(F.col("f"), separator).alias("b"), first.alias("c")).collect():
        assert r["a"] == r["b"] == r["c"], r


@pytest.mark.parametrize("text", ["7", "07", "+7", "7 ", " 7", "7\u007f", "7a", "7.5", "", "+", "7\u0663", "9223372036854775807", "9223372036854775808", None])
def test_unsigned_numbers_end_with_a_digit(spark, text):
    import re

    from pyspark.sql import functions as F

    from locusframe.functions.fields import unsigned

    read = int(text) if text is not None and re.fullmatch(r"\+?[0-9]+", text) and int(text) < 1 << 63 else None
    assert spark.createDataFrame([(text,)], "t string").select(unsigned(F.col("t"), "x").value).first()[0] == read


def test_lists_hold_a_line_once_and_its_place_as_one_text(spark):
    plan = registry.QUERIES["a01_group"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(strand" in plan and "struct(c, chrom" not in plan
    plan = registry.QUERIES["a05_merge_attributes"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by(" not in plan and "min(struct(" not in plan and plan.count("collect_list(") == 1


def test_lines_that_fit_and_do_not_among_all_roles(spark):
    from pyspark.sql import functions as F

    from locusframe.sources import gxf
    from locusframe.sources.lines import lines_of

    row = lambda c, feature, s, e, d, attrs: "\t".join([c, "x", feature, str(s), str(e), ".", d, ".", attrs])
    texts = [
        row("chr1", "exon", 11, 20, "+", 'transcript_id "a"; tag "p"; Name "n";'),
        row("chr1", "CDS", 12, "+18", "+", 'transcript_id "a"; tag "p"; tag "q";'),
        row("chr2", "exon", 1, 5, "+", 'transcript_id "a"; tag "lost";'),
        row("chr1", "CDS", "013", 90, "-", 'transcript_id "a";'),
        row("chr1", "exon", 31, 40, "+", 'transcript_id "a"; tag "q" ; tag "r"'),
        row("chr1", "exon", " 31", 40, "+", 'transcript_id "a"; tag "unread"'),
        row("chr1", "exon", 31, "40\u007f", "+", 'transcript_id "a"; tag "unread"'),
        "  # transcript_id",
        row("c", "transcript", 1, 9, "?", 'transcript_id "b"'),
        row("c", "exon", 3, 4, ".", 'transcript_id "b"; tag "\u0001";'),
    ]
    lines = lines_of(spark.createDataFrame(list(enumerate(texts, 1)), "line long, value string"))
    got = {r["key"]: r for r in gxf.transcripts(lines, "gtf").withColumn("tag", F.col("extras")["tag"]).collect()}
    a, b = got["a"], got["b"]
    assert (a["chrom"], a["strand"], a["name"], a["start"], a["end"], a["_line"], a["conflict_line"]) == ("chr1", "+", "n", 10, 40, 1, 3)
    assert (a["block_starts"], a["block_ends"], a["thick_start"], a["thick_end"], a["tag"]) == ([10, 30], [20, 40], 11, 18, ["p", "q", "r"])
    assert (b["chrom"], b["strand"], b["start"], b["end"], b["block_starts"], b["tag"], b["conflict_line"]) == ("c", ".", 0, 9, [2], ["\u0001"], None)
