"""Nearest neighbours, token files and archives against brute force and exact round trips."""

import base64
import gzip
import hashlib
import io
import json
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from helpers import DOCS, corpus, documents, odd_rows
from pyspark.sql import functions as F

from locusframe.llm import neighbours, token_files, warc
from locusframe.llm.common import fresh_folder

VECTORS = "vec_id bigint, embedding array<float>, label int, dim int, block int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 7, 7) for i, v in rows], VECTORS)


def plain_nearest(rows, query, k):
    own = dict(rows)[query]
    found = sorted((float(np.sqrt(((np.float64(np.float32(v)) - np.float64(np.float32(own))) ** 2).sum())), i) for i, v in rows if i != query and len(v) == len(own))
    return found[:k]


def test_recall_over_several_blocks(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(10, 32))
    rows = [(i, (centres[i % 10] + rng.normal(size=32)).astype(np.float32).tolist()) for i in range(4000)]
    df = vectors(spark, rows)
    found = neighbours.nearest_neighbours(df, df.filter("vec_id % 100 = 0"), block_rows=1000).collect()
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i, _ in rows if i % 100 == 0}
    hits = 0
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        true = plain_nearest(rows, q, 10)
        hits += len({r.vec_id for r in own} & {i for _, i in true})
        exact = dict((i, d) for d, i in plain_nearest(rows, q, len(rows)))
        assert all(r.score == pytest.approx(exact[r.vec_id], abs=1e-12) for r in own)
    assert hits / (10 * len(by)) >= 0.9


@pytest.mark.parametrize("noise, shift", [(1e-4, 0.0), (3e-5, 0.0), (1e-3, 1.0), (3e-4, 1.0), (1e-3, 10.0), (1e-9, 1.0)])
def test_tight_clusters_are_ranked_in_double_precision(noise, shift):
    """Of all rows as candidates, the nearest are those of brute force, in a cluster of 600 near-copies too."""
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(2000, 64))
    rows[:600] = rows[0] + noise * np.sqrt(64) * rng.normal(size=(600, 64))
    rows = rows / np.sqrt((rows**2).sum(1))[:, None] + shift
    forest, queries = neighbours.Forest(rows, 8, 32), np.concatenate((rows[:600:40], rows[1000:1005], 1e20 * rows[:1]))
    for q, (near, distance) in zip(queries, forest.nearest(queries, 11, 8.0)):
        true = np.sqrt(((rows - q) ** 2).sum(1))
        assert set(near.tolist()) == set(np.flatnonzero(true <= np.sort(true)[10]).tolist())
        assert distance.tolist() == true[near].tolist()


@pytest.mark.parametrize("kind, most", [("equidistant", 0.32), ("clusters", 0.02), ("near-copies", 0.45)])
def test_recall_and_share_looked_at_in_a_block(kind, most):
    """At the block size in use recall is 0.9 or more; how much of the block is looked at depends on the vectors."""
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(neighbours.BLOCK_ROWS, 64))
    rows /= np.sqrt((rows**2).sum(1))[:, None]
    if kind == "clusters":
        rows = rng.normal(size=(200, 64))[rng.integers(0, 200, len(rows))] + 0.3 * rng.normal(size=rows.shape)
    if kind == "near-copies":
        rows[: len(rows) // 3] = rows[0] + 1e-3 * rng.normal(size=(len(rows) // 3, 64))
    forest, queries = neighbours.Forest(rows, neighbours.TREES, neighbours.BITS), rows[::160]
    looked = [len(c) / len(rows) for c in forest.candidates(queries, 11, neighbours.RECALL)]
    hits = 0
    for q, (near, _) in zip(queries, forest.nearest(queries, 11, neighbours.RECALL)):
        true = np.argsort(((rows - q) ** 2).sum(1), kind="stable")[1:11]
        hits += len(set(true.tolist()) & set(near.tolist()))
    assert hits / (10 * len(queries)) >= 0.9
    assert np.mean(looked) <= most


@pytest.mark.parametrize("repeats", [12, 1000])
def test_repeated_rows_take_no_other_row_s_place(spark, repeats):
    """Rows equal in id and vector are one candidate; other ids with the vector are still found."""
    rows = [(1, [1.0, 2.0])] * repeats + [(2, [1.0, 2.0]), (3, [1.0, 2.0]), (50, [9.0, 13.0]), (100, [1.0, 2.1])]
    df = vectors(spark, rows)
    found = neighbours.nearest_neighbours(df, df.filter("vec_id in (1, 100)")).collect()
    once = sorted(dict(rows).items())
    for q in (1, 100):
        assert [(r.score, r.vec_id) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == plain_nearest(once, q, 10)


def test_many_ids_on_one_vector(spark):
    rows = [(i, [0.5, 0.25]) for i in range(3000)] + [(5000 + i, [0.5, 0.25 + 2.0**-i]) for i in range(1, 9)]
    df = vectors(spark, rows)
    found = neighbours.nearest_neighbours(df, df.filter("vec_id % 1000 = 0 or vec_id = 5008")).collect()
    for q in (0, 1000, 2000, 5008):
        assert [(r.score, r.vec_id) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == plain_nearest(rows, q, 10)


def test_recall_in_a_shifted_cluster(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (1 + (0.1 if i < 600 else 1) * rng.normal(size=32) * (1e-3 if i < 600 else 1)).astype(np.float32).tolist()) for i in range(1500)]
    df = vectors(spark, rows)
    found = neighbours.nearest_neighbours(df, df.filter("vec_id < 600 and vec_id % 30 = 0")).collect()
    hits = sum(r.vec_id in {i for _, i in plain_nearest(rows, r.query_id, 10)} for r in found)
    assert len(found) == 200 and hits >= 190


def test_ties_copies_and_unsound_vectors(spark):
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(50)] + [(100 + i, [1.0, 2.0, float(i + 1)]) for i in range(5)]
    bad = [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [1.0, None, 2.0]), (204, [float("nan"), 1.0, 1.0]), (205, [float("inf"), 1.0, 1.0]), (None, [1.0, 2.0, 0.4]), (300, [1.0, 2.0])]
    df = vectors(spark, rows + bad)
    found = neighbours.nearest_neighbours(df, df.filter("vec_id in (0, 30, 100, 200, 202, 204, 300)")).collect()
    for q in (0, 30, 100):
        assert [(r.score, r.vec_id) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == plain_nearest(rows, q, 10)
    assert {r.query_id for r in found} == {0, 30, 100}
    few = vectors(spark, rows[:3])
    assert neighbours.nearest_neighbours(few, few).count() == 6
    none = vectors(spark, []).limit(0)
    assert neighbours.nearest_neighbours(none, none).collect() == []


def tokenized(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, 2] for e in t.encode_batch(texts, add_special_tokens=False)]


def check_tokens(rows, found):
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]) + [r for r in rows if r[0] is None]
    start, expected = 0, []
    for (d, *_), ids in zip(order, tokenized([r[1] or "" for r in order])):
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_token_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df, rows = corpus(spark, 200, seed=2)
    check_tokens(rows, token_files.round_trip(df, path).collect())
    check_tokens(odd_rows(), token_files.round_trip(documents(spark, odd_rows()), path).collect())
    assert token_files.round_trip(spark.createDataFrame([], DOCS), path).collect() == []


def test_files_are_flat_and_mapped(spark):
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), fresh_folder(spark, "test-tokens")
    df, rows = corpus(spark, 60, seed=2)
    parts = token_files.write_token_files(df, folder, path, 2).orderBy("part").collect()
    flat = np.concatenate([np.memmap(p.file + ".bin", "<u2", "r") for p in parts])
    assert flat.tolist() == [i for ids in tokenized([r[1] for r in rows]) for i in ids]
    ends = np.concatenate([np.fromfile(p.file + ".idx", "<i8") + p.first_id for p in parts])
    assert ends.tolist() == np.cumsum([len(x) for x in tokenized([r[1] for r in rows])]).tolist()
    assert [p.first_doc for p in parts] == np.cumsum([0, *[p.n_docs for p in parts]])[:-1].tolist()
    assert not [f for f in Path(folder.removeprefix("file://")).iterdir() if f.suffix not in (".bin", ".idx", ".doc")]


TRICKY = ["", " ", "  a", "a  b", "x\n y", "x \ny", "<|endoftext|> a<|endoftext|>", " x y", "é ü", "a\tb c", "ab,\nCd", "ab\n\ncd", "\nab", "x.\n", "ab, cd. ef", "aÉ. b²,", "it's 12 3 %% ", "a b c", "don't, 'll. x,", "\u0001a b", "a b\r\nc d", "日本 語. x", "12, 3.", "a., b,."]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_library_s_ids(name):
    encoder = token_files.Encoder(public_tokenizers.path(name))
    texts = TRICKY + [" ".join(random.Random(i).sample(TRICKY, 4)) for i in range(300)]
    whole = [np.array(e.ids, encoder.kind).tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert encoder.encode(texts) == whole
    assert encoder.in_units == name.startswith("byte")


@pytest.mark.parametrize("change", ["lstrip", "rstrip", "single_word", "space", "truncation", "padding"])
def test_tokenizers_that_look_beyond_a_unit_take_whole_texts(tmp_path, change):
    shape = json.loads(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())
    token = shape["added_tokens"][0]
    if change == "space":
        token["content"] = "<a b>"
    elif change in token:
        token[change] = True
    else:
        shape[change] = {"truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}, "padding": {"strategy": {"Fixed": 8}, "direction": "Right", "pad_to_multiple_of": None, "pad_id": 0, "pad_type_id": 0, "pad_token": "!"}}[change]
    (tmp_path / "t.json").write_text(json.dumps(shape))
    encoder = token_files.Encoder(str(tmp_path / "t.json"))
    texts = ["ab <|endoftext|> cd", "one two <a b> three", "a b c d e f g h i j k", "x"]
    assert not encoder.in_units and encoder.encode(texts) == [np.array(e.ids, encoder.kind).tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_parts_follow_the_size_of_the_texts(spark, monkeypatch):
    """Ranges hold about as much text each; an id with a third of the rows spans several."""
    from locusframe.llm import common

    path, folder = public_tokenizers.path("byte_bpe_50k.json"), fresh_folder(spark, "test-tokens")
    monkeypatch.setattr(common, "PART_BYTES", 10_000)
    rows = [(i if i % 3 else 7, f"text {i} " * 40, "en", "s", 0) for i in range(300)]
    parts = token_files.write_token_files(spark.createDataFrame(rows, DOCS), folder, path, 2).collect()
    assert len(parts) >= 10 and max(p.n_docs for p in parts) < 80 and sum(p.n_docs for p in parts) == 300
    found = [(r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.round_trip(spark.createDataFrame(rows, DOCS), path).collect()]
    ids = tokenized([r[1] for r in rows])
    assert sorted(found) == sorted((r[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(rows, ids))


def test_cache_of_units_turns_over(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_UNITS", 5)
    encoder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["the cat sat, on the mat.", "the dog sat. on a log,\nThe end", "cat, dog. mat, log"]
    for t in texts * 3:
        assert encoder.encode([t]) == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, encoder.kind).tobytes()]


PAGES = "page_id bigint, url string, html string, digest string, first_id int, n int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2) for r in rows], PAGES)


def check_warc(rows, found):
    first, expected = {}, []
    for page, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        head = first.setdefault(digest, page)
        new = head == page and ("seen", digest) not in first
        first["seen", digest] = 1
        expected.append((page, len(payload), digest, "response" if new else "revisit", None if new else head))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_warc_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, f"http://e.example/{i} é", "<p>" + "".join(rng.choice("abcé \n") for _ in range(rng.choice([0, 10, 3000, 50_000])))) for i in range(60)]
    rows += [(100 + i, None, rows[i % 7][2]) for i in range(40)] + [(300, "u", None), (301, "u", ""), (302, "u\r\nX: y", "x"), (303, "v", "z"), (303, "v", "z")]
    for size in (100, 5000, 1 << 20):
        check_warc(rows, warc.round_trip(pages(spark, rows), segment_bytes=size).collect())
    assert warc.round_trip(pages(spark, []).limit(0)).collect() == []
    least = warc.round_trip(pages(spark, rows), least_bytes=10**9).collect()
    assert {r.record_type for r in least} == {"response"}


def test_repeated_pages_have_one_response(spark):
    """Also where Spark would split a partition of the join for its size."""
    rng = random.Random(3)
    rows = [(7, f"u{i}", "x" * 3000) for i in range(600)] + [(i, "v", "".join(rng.choice("ab ") for _ in range(200))) for i in range(100, 160)] + [(8, "w", "x" * 3000)]
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        check_warc(rows, warc.round_trip(pages(spark, rows).repartition(8)).collect())
    finally:
        for k in small:
            spark.conf.unset(k)


def test_null_page_ids_are_responses(spark):
    found = warc.round_trip(pages(spark, [(None, "u", "a"), (None, "u", "a"), (5, "u", "b")])).collect()
    assert len(found) == 3 and {r.record_type for r in found} == {"response"}


def test_segments_out_of_order_and_broken_ones(spark, tmp_path):
    payload = bytes(range(256)) * 40
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(payload, 1000)
    headers = {"WARC-Type": "response", "WARC-Record-ID": f"<{warc._ID}7:0>", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Payload-Digest": "sha1:" + warc._base32_sha1(payload)}
    pieces = list(warc.segmented(headers, block, 1500))
    assert len(pieces) == -(-len(block) // 1500)

    def read(*files):
        for i, parts in enumerate(files):
            (tmp_path / f"{i}.warc.gz").write_bytes(b"".join(parts))
        names = spark.createDataFrame([(str(tmp_path / f"{i}.warc.gz"),) for i in range(len(files))], "archive string")
        return warc.read_archives(names, f"file://{tmp_path}").collect()

    assert [tuple(r) for r in read(pieces[3:][::-1], pieces[:3][::-1])] == [(7, len(payload), warc._base32_sha1(payload), "response", None)]
    with pytest.raises(Exception, match="are not 1 to"):
        read(pieces[:2] + pieces[3:])
    short = gzip.compress(gzip.decompress(pieces[-1]).replace(b"Total-Length: ", b"Total-Length: 9"))
    with pytest.raises(Exception, match="the last one tells"):
        read([*pieces[:-1], short])
    with pytest.raises(Exception, match="does not fit its digest"):
        read([warc.record({**headers, "WARC-Payload-Digest": "sha1:A"}, block)])
    with pytest.raises(Exception, match="ends within"):
        read([warc.record(headers, block)[:-400]])


def test_chunked_framing():
    for size in (1, 7, 100):
        assert warc.dechunked(warc.chunked(b"hello world", size)) == b"hello world"
    assert warc.dechunked(b"5;ext=1\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nhelloXX0\r\n\r\n")
    assert [b for _, b in warc.records(io.BytesIO(warc.record({"A": "b"}, b"x\r\n\r\ny") + warc.record({"A": "b"}, b"")))] == [b"x\r\n\r\ny", b""]


def test_base32_digest_in_sql(spark):
    values = [b"", b"a", b"\x00" * 9, "é".encode()]
    df = spark.createDataFrame([(bytearray(v),) for v in values], "v binary")
    assert [r[0] for r in df.select(warc.payload_digest(F.col("v"))).collect()] == [base64.b32encode(hashlib.sha1(v).digest()).decode() for v in values]
