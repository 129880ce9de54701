"""Mixing, sharding and packing against their laws and plain counterparts."""

import zlib
from collections import Counter, defaultdict

import pytest
from helpers import DOCS, corpus, documents, odd_rows, words
from pyspark.sql import functions as F

from locusframe.llm.mixing import mix, mixed
from locusframe.llm.packing import BestFit, pack
from locusframe.llm.sharding import shard


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Share by weight again and again, capping sources, until none is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        level = left / sum(w[s] for s in free) if free else 0
        now = {s for s in free if level * w[s] > most * sizes[s]}
        if not now:
            return {s: most * sizes[s] if s in capped else level * w[s] for s in order}
        capped |= now


def check_mix(rows, found, tolerance):
    sizes, n = defaultdict(int), Counter()
    for d, text, _, source, _ in rows:
        sizes[source] += len(words(text))
        n[d, source, len(words(text))] += 1
    targets = plain_targets(sizes)
    assert Counter((r.doc_id, r.source, r.size) for r in found) == n
    taken = defaultdict(int)
    for r in found:
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= tolerance


def test_mix_meets_targets_and_reruns_agree(spark):
    df, rows = corpus(spark, 500)
    found = mix(df, fan_in=4).collect()
    check_mix(rows, found, max(len(words(r[1])) for r in rows))
    again = mix(df.repartition(5), fan_in=4).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))


def test_mix_keeps_expectations(spark):
    """Over many seeds each document is copied as often as its source's share says."""
    rows = [(i, " ".join("w" * (1 + i % 7)), "en", "a" if i < 12 else "b", 0) for i in range(24)]
    df = spark.createDataFrame(rows, DOCS).cache()
    sums, share, seeds = Counter(), {}, 60
    for seed in range(seeds):
        for r in mix(df, seed=seed * 101, fan_in=4).collect():
            sums[r.doc_id] += r.copies
            share[r.doc_id] = r.target / r.source_size
    assert all(abs(sums[d] / seeds - share[d]) < 0.3 for d in share)
    assert abs(sum(sums.values()) / seeds - sum(share.values())) < 1.5


def test_mix_takes_odd_rows(spark):
    rows = odd_rows()
    check_mix(rows, mix(documents(spark, rows)).collect(), 30_000)
    one = [(1, "a b c", "en", "s", 5)] * 50
    taken = sum(r.taken for r in mix(spark.createDataFrame(one, DOCS)).collect())
    assert abs(taken - 225) <= 3
    assert mix(spark.createDataFrame([], DOCS)).collect() == []
    assert [r.taken for r in mix(spark.createDataFrame([(1, None, "en", None, 0)], DOCS)).collect()] == [0]


def test_mixed_repeats_rows_as_mix_says(spark):
    for df in (corpus(spark, 120)[0], documents(spark, odd_rows())):
        copies = Counter()
        for r in mix(df).collect():
            copies[r.doc_id, r.source, r.size] += r.copies
        out = mixed(df)
        assert out.columns == df.columns
        assert Counter((r.doc_id, r.source, len(words(r.text))) for r in out.collect()) == +copies


def check_shards(rows, found, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    by = defaultdict(list)
    for r in found:
        assert r.law == "rows" and r.grown_shard is None
        by[r.shard].append(r)
    counts = [len(by[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for group in by.values():
        assert sorted(r.slot for r in group) == list(range(len(group)))
    totals = Counter(r[3] for r in rows)
    for group in by.values():
        own = Counter(r.source for r in group)
        for s, n in totals.items():
            assert abs(own[s] - n * len(group) / len(rows)) <= 2


def test_shards_match_the_mixture(spark):
    df, rows = corpus(spark, 700)
    found = shard(df, 16).collect()
    check_shards(rows, found, 16)
    assert sorted(map(repr, found)) == sorted(map(repr, shard(df.repartition(3), 16).collect()))


def test_shards_follow_the_plain_order(spark):
    """Ranks within sources and fractional ranks over all give the same shards and slots."""
    df, rows = corpus(spark, 90)
    hashed = df.withColumn("h", F.xxhash64(F.lit(29), "doc_id", F.crc32(F.col("text").cast("binary")), (F.octet_length("text") + 1).cast("long"))).collect()
    by = defaultdict(list)
    for r in hashed:
        by[r.source].append((r.h, r.doc_id))
    line = sorted(((i + 0.5) / len(v), s, h, d) for s, v in by.items() for i, (h, d) in enumerate(sorted(v)))
    expected = {d: g * 7 // len(line) for g, (_, _, _, d) in enumerate(line)}
    assert {r.doc_id: r.shard for r in shard(df, 7).collect()} == expected


def test_shards_take_odd_rows(spark):
    rows = odd_rows()
    found = shard(documents(spark, rows), 3).collect()
    assert len(found) == len(rows) and sorted(Counter(r.shard for r in found).values()) == [4, 4, 4]
    assert shard(spark.createDataFrame([], DOCS)).collect() == []
    assert len(shard(spark.createDataFrame(rows[:2], DOCS), 16).collect()) == 2


def plain_pack(pieces, capacity, per_source):
    """Best fit by looking at every bin."""
    bins = []
    for size, source, cluster in pieces:
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= size and cluster not in b["clusters"] and b["sources"][source] < per_source]
        if fits:
            b = bins[min(fits)[1]]
        else:
            b = {"left": capacity, "clusters": set(), "sources": Counter()}
            bins.append(b)
        b["left"] -= size
        b["clusters"].add(cluster)
        b["sources"][source] += 1
    return bins


def test_best_fit_is_the_tightest_compatible_bin():
    import random

    rng = random.Random(2)
    for per_source in (1, 3):
        pieces = sorted(((rng.randrange(1, 60), rng.randrange(4), rng.randrange(30)) for _ in range(600)), reverse=True)
        fit = BestFit(100, per_source)
        for p in pieces:
            fit.place(*p)
        assert [b["left"] for b in plain_pack(pieces, 100, per_source)] == fit.residual


def check_pack(rows, found, capacity, per_source):
    sizes = Counter((r.doc_id, r.source) for r in found)
    assert set(sizes) == {(d, s) for d, _, _, s, _ in rows}
    assert sum(r.words for r in found) == sum(len(words(r[1])) for r in rows)
    by = defaultdict(list)
    for r in found:
        assert (r.bin is None) == (r.words == 0)
        by[r.bin].append(r)
    by.pop(None, None)
    for group in by.values():
        assert sum(r.words for r in group) == group[0].bin_words <= capacity
        assert max(Counter(r.source for r in group).values()) <= per_source
    return by


def test_pack_keeps_copies_apart_and_words_whole(spark):
    df, rows = corpus(spark, 400)
    found = pack(df, capacity=256, group_rows=64, per_source=3).collect()
    text = {r[0]: r[1] for r in rows}
    for group in check_pack(rows, found, 256, 3).values():
        assert max(Counter(text[r.doc_id] for r in group).values()) == 1
    for d in text:
        own = sorted((r.piece, r.offset, r.words) for r in found if r.doc_id == d)
        at = 0
        for i, (piece, offset, n) in enumerate(own):
            assert (piece, offset) == (i, at)
            at += n
        assert at == len(words(text[d]))


def test_pack_of_many_copies_and_odd_rows(spark):
    same = [(i, "a b c", "en", "s", 5) for i in range(300)]
    by = check_pack(same, pack(spark.createDataFrame(same, DOCS), capacity=30, group_rows=50).collect(), 30, 8)
    assert len(by) == 300
    rows = odd_rows()
    check_pack(rows, pack(documents(spark, rows), capacity=1000).collect(), 1000, 8)
    assert pack(spark.createDataFrame([], DOCS)).collect() == []


def test_pack_keeps_given_clusters_apart(spark):
    """Different texts of one cluster are in no bin together; equal texts of different clusters may be."""
    rows = [(i, f"a b c w{i}", "en", f"s{i % 5}", i // 10) for i in range(100)]
    found = pack(spark.createDataFrame(rows, DOCS), cluster_col="n_chars", capacity=40, group_rows=1000).collect()
    for group in check_pack(rows, found, 40, 8).values():
        assert max(Counter(r.doc_id // 10 for r in group).values()) == 1
    assert len({r.bin for r in found}) < 20
