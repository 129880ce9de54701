"""The n-gram Jaccard join, its parts, and edit fingerprints, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, corpus, documents, odd_rows, prose, words

from locusframe.llm import edit_fingerprint as ef
from locusframe.llm import jaccard
from locusframe.llm.components import components
from locusframe.llm.shingles import chunks, gram_sets, ngram_hashes, signatures, text_buffer, word_hashes


def grams(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def plain(rows, threshold=0.8):
    """doc_id -> (least id of its class, copies, links), over all pairs of texts."""
    texts = {}
    for d, t, *_ in rows:
        texts.setdefault(t if words(t) else "", []).append(d)
    sets, names = {t: grams(t) for t in texts}, list(texts)
    linked = {t: [u for u in names if u != t and sets[t] and sets[u] and len(sets[t] & sets[u]) >= threshold * len(sets[t] | sets[u])] for t in names}
    out = {}
    for t in names:
        seen, todo = {t}, [t]
        while todo:
            for u in linked[todo.pop()]:
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        head = min((d for u in seen for d in texts[u] if d is not None), default=None)
        for d in texts[t]:
            out[d] = (head, len(texts[t]), sum(len(texts[u]) for u in linked[t]) + len(texts[t]) - 1, len(linked[t]))
    return out


def facts(found):
    return {r.doc_id: (r.class_id, r.n_copies, r.n_links, r.n_linked_texts) for r in found}


def test_all_links_are_found(spark):
    df, rows = corpus(spark, 400, seed=3)
    found = jaccard.near_duplicates(df).collect()
    assert len(found) == len(rows) and facts(found) == plain(rows)


def test_groups_over_several_blocks(spark, monkeypatch):
    """A group and a node far above a block's size are dealt as pairs of blocks; no link is lost."""
    monkeypatch.setattr(jaccard, "NODE_BLOCK", (7, 7))
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", (9, 9))
    rng = random.Random(8)
    base = [prose(rng, 1) for _ in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        w[rng.randrange(60)] = f"w{i}"
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(100 + i, prose(rng, 50), "en", "s", 0) for i in range(20)] + [(200 + i, rows[0][1], "en", "s", 0) for i in range(40)]
    assert facts(jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()) == plain(rows)


def test_odd_rows_form_classes(spark):
    rows = odd_rows()
    found = jaccard.near_duplicates(documents(spark, rows)).collect()
    assert len(found) == len(rows) and facts(found) == plain(rows)
    assert jaccard.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_one_of_each_class_stays(spark):
    for rows in (corpus(spark, 200, seed=4)[1], odd_rows()):
        df = documents(spark, rows)
        kept = jaccard.one_of_each(df)
        assert kept.columns == df.columns
        assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, {head for head, *_ in plain(rows).values()}))
    nulls = [(None, "a b c d e f", "en", "s", 0)] * 3 + [(None, "g h i j k l", "en", "s", 0)]
    assert jaccard.one_of_each(spark.createDataFrame(nulls, DOCS)).count() == 2


def test_the_shortest_prefix_meets_the_threshold():
    lengths = [jaccard.shortest_prefix(s, 0.99) for s in (0.9, 0.7, 0.5, 0.3)]
    assert lengths == sorted(lengths, reverse=True) and lengths[0] == jaccard.DEPTH and lengths[-1] < 3
    for s in (0.9, 0.5):
        k = jaccard.shortest_prefix(s, 0.99)
        assert 1 - (1 - s**k) ** jaccard.TREES >= 0.99


def test_prefixes_are_shortened_as_the_pairs_met_say():
    """Pairs far above the threshold ask for no shorter prefix; many pairs right at it do; without pairs nothing is known."""
    values = jaccard.TREES * jaccard.DEPTH
    high, low = {int(0.97 * values): 1000}, {int(0.8 * values): 1000}
    assert jaccard.expected_recall(high, jaccard.DEPTH, 0.8) > 0.99999
    recalls = [jaccard.expected_recall(low, d, 0.8) for d in range(jaccard.DEPTH, 3, -1)]
    assert recalls == sorted(recalls) and recalls[0] < 0.9999 < recalls[-1]
    assert recalls[0] < jaccard.expected_recall(high | low, jaccard.DEPTH, 0.8) < 1 and jaccard.expected_recall({}, 8, 0.8) == 0


def levels_used(spark, monkeypatch, rows):
    seen, real = [], jaccard.expected_recall
    monkeypatch.setattr(jaccard, "expected_recall", lambda pairs, depth, t: seen.append(depth) or real(pairs, depth, t))
    assert facts(jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()) == plain(rows)
    return seen


def test_the_data_say_how_far_prefixes_are_shortened(spark, monkeypatch):
    rng = random.Random(14)

    def copies(n, changed):
        out = []
        for i in range(n):
            w = prose(rng, 200).split(" ")
            v = list(w)
            for at in rng.sample(range(0, 195, 6), changed):
                v[at] = "other"
            out += [(2 * i, " ".join(w), "en", "s", 0), (2 * i + 1, " ".join(v), "en", "s", 0)]
        return out

    assert levels_used(spark, monkeypatch, copies(60, 1)) == [jaccard.DEPTH]
    assert levels_used(spark, monkeypatch, copies(60, 4))[-1] < jaccard.DEPTH


def test_longest_matches_of_a_sorted_part():
    """In a part cut into batches, each label has its longest match with any other; the part's ends count as whole matches."""
    rng = random.Random(3)
    rows = sorted((rng.randrange(2), *[int("".join(f"{rng.randrange(3):04x}" for _ in range(4)), 16) for _ in range(2)], i) for i in range(300))
    names = ["tree", "l0", "l1", "node"]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a : a + 37]], pa.int32() if not k else pa.int64()) for k in range(4)], names) for a in range(0, 300, 37)]
    values = lambda r: [(r[1 + k // 4] >> (48 - 16 * (k % 4))) & 0xFFFF for k in range(8)]
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(values(a), values(b))) if x != y), 8) if a[0] == b[0] else 0
    found = {r["node"]: r["match"] for b in jaccard._longest_matches(3)(iter(batches)) for r in b.to_pylist()}
    for r in rows[1:-1]:
        best = max(common(r, o) for o in rows if o is not r)
        assert found.get(r[3], 0) == (best if best >= 3 else 0)
    assert found[rows[0][3]] == found[rows[-1][3]] == 8
    assert list(jaccard._longest_matches(3)(iter([]))) == []


def test_rows_with_any_column_names_stay_whole(spark):
    """Columns that carry names used inside come out as they went in."""
    _, rows = corpus(spark, 60, seed=4)
    extra = ["row", "id", "digest", "i", "d", "node", "_id", "_kept", "_digest", "a.b", "label", "rows", "keeper"]
    df = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in extra]) for r in rows], [*(c.split(" ")[0] for c in DOCS.split(", ")), *extra])
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    whole = {r[0]: tuple(r) for r in df.collect()}
    found = kept.collect()
    assert sorted(r[0] for r in found) == sorted({head for head, *_ in plain(rows).values()}) and all(tuple(r) == whole[r[0]] for r in found)


def test_the_same_of_several_equal_rows_stays(spark):
    rows = [(1, "a b c d e f", "en", f"s{i}", i) for i in range(20)]
    kept = [tuple(r) for n in (1, 7) for r in jaccard.one_of_each(spark.createDataFrame(rows, DOCS).repartition(n)).collect()]
    assert len(kept) == 2 and kept[0] == kept[1]


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (5, 6)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 90)] + [(100, 101), (101, 90)], [(3, 3)], []])
def test_components(spark, edges):
    found = components(spark.createDataFrame(edges, "a bigint, b bigint"), "test").collect()
    up = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in up:
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert {r.node: r.label for r in found} == up and len(found) == len(up)


def test_word_hashes_do_not_depend_on_chunks_or_neighbours():
    texts = ["a bc  d", "", "bc", " é x\n", "a bc", None, "d"] * 3
    for kind in (pa.string(), pa.large_string()):
        data, at = text_buffer(pa.array(texts, kind))
        whole, firsts = word_hashes(data, at)
        for limit in (1, 5, 1000):
            parts = [word_hashes(data, at[a : b + 1])[0] for a, b in chunks(at, limit)]
            assert np.array_equal(np.concatenate(parts), whole)
        flat = [w for t in texts for w in words(t)]
        ids = {w: {h for v, h in zip(flat, whole.tolist()) if v == w} for w in flat}
        assert all(len(v) == 1 for v in ids.values()) and len({next(iter(v)) for v in ids.values()}) == len(ids)
        assert np.diff(firsts).tolist() == [len(words(t)) for t in texts]
    sliced = text_buffer(pa.array(texts)[2:5])
    assert np.array_equal(word_hashes(*sliced)[0], word_hashes(*text_buffer(pa.array(texts[2:5])))[0])


def test_gram_sets_and_signatures_estimate_similarity():
    rng = random.Random(1)
    a = prose(rng, 400).split()
    b = list(a)
    for i in range(0, 400, 40):
        b[i] = "z"
    sets = gram_sets([" ".join(a).encode(), " ".join(b).encode(), b"x y", b""], 5)
    assert [len(s) for s in sets] == [len(grams(" ".join(a))), len(grams(" ".join(b))), 1, 0]
    true = len(grams(" ".join(a)) & grams(" ".join(b))) / len(grams(" ".join(a)) | grams(" ".join(b)))
    assert len(np.intersect1d(sets[0], sets[1])) / len(np.union1d(sets[0], sets[1])) == true
    data, at = text_buffer(pa.array([" ".join(a), " ".join(b), ""]))
    sig = signatures(*ngram_hashes(*word_hashes(data, at), 5), 2000, 7)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.05 and not sig[2].any()


def slow_walk(classes, phase=0):
    stays, at, out = ef._stays(), 0, []
    for c in classes.tolist():
        out.append(at)
        at += int(stays[((at + phase) & (ef.PERIOD - 1)) * ef.CLASSES + c])
    return out, at


def test_walks_in_pieces_are_one_walk():
    rng = random.Random(2)
    texts = ["", "a", "ab", prose(rng, 3000), "ab" * 9000, prose(rng, 20), "é😀" * 3000]
    chars = [ef.char_classes(t) for t in texts]
    assert [len(c) for c in chars] == [len(t) for t in texts]
    for c, (reached, steps) in zip(chars, ef.walks(chars, np.arange(len(texts)))):
        pass
    for i, (c, (reached, steps)) in enumerate(zip(chars, ef.walks(chars, np.arange(len(texts))))):
        assert (reached.tolist(), steps) == slow_walk(c, i)


def test_sampled_places_are_nested_and_even():
    for level in range(0, 9):
        at = ef.places(level)
        assert np.array_equal(at >> level, np.arange(ef.SAMPLES))
        if level:
            assert set(at[: ef.SAMPLES // 2]) <= set(ef.places(level - 1))


def test_likeness_tells_edits_from_other_texts():
    rng = random.Random(3)
    for n in (30, 200, 2000):
        a, b = prose(rng, n), prose(rng, n)
        cut = a[: len(a) // 3] + "!" + a[len(a) // 3 :]
        f = ef.fingerprints([a, a, cut, b, ""])
        assert f[0] == f[1] and ef.likeness(f[0], f[1]) == 1
        assert ef.likeness(f[0], f[2]) > 0.5 > 0.35 > ef.likeness(f[0], f[3])
        assert ef.likeness(f[0], f[4]) == 0 and ef.likeness(f[4], f[4]) == 1
        assert ef.likeness(f[0], f[2]) == ef.likeness(f[2], f[0])


def check_prints(rows, found):
    """Contract values from plain code; the edited text's fingerprint from its whole text."""
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [r for r in rows if r[0] is None]
    texts = [r[1] or "" for r in order]
    got = {r.doc_id: r for r in found}
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    for i, (d, t) in enumerate(zip((r[0] for r in order), texts)):
        following, r = texts[(i + 1) % len(texts)], got[d]
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        own, after, changed = ef.fingerprints([t, following, edited])
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint, r.edited_sha256) == (len(t), own, changed, hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (ef.likeness(own, changed), ef.likeness(own, after))


def test_fingerprint_table(spark):
    df, rows = corpus(spark, 150, seed=6)
    check_prints(rows, ef.fingerprint_documents(df).collect())
    rows = [r for i, r in enumerate(odd_rows()) if i != 10]
    check_prints(rows, ef.fingerprint_documents(documents(spark, rows)).collect())
    assert len(ef.fingerprint_documents(documents(spark, odd_rows())).collect()) == len(odd_rows())
    check_prints(rows[3:4], ef.fingerprint_documents(spark.createDataFrame(rows[3:4], DOCS)).collect())
    assert ef.fingerprint_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_bands_pair_texts_a_few_edits_apart(spark):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        t = prose(rng, 150)
        rows += [(2 * i, t, "en", "s", 0), (2 * i + 1, t[:400] + "x" + t[401:], "en", "s", 0)]
    found = {(r.head_id, r.doc_id) for r in ef.near_in_edits(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum((2 * i, 2 * i + 1) in found for i in range(40)) >= 36
    assert all(a // 2 == b // 2 for a, b in found)


def test_near_pairs_do_not_hang_on_a_bands_head(spark, monkeypatch):
    """Documents with a common opening share bands; alike ones hang together over true pairs, over blocks of a band too."""
    rng = random.Random(12)
    opening, rows = prose(rng, 170), []
    for i in range(50):
        t = opening + prose(rng, 130)
        rows += [(3 * i, t, "en", "s", 0), (3 * i + 1, t[:-40] + "#" + t[-39:], "en", "s", 0), (3 * i + 2, t, "en", "s", 0)]
    prints = dict(zip((r[0] for r in rows), ef.fingerprints([r[1] for r in rows])))
    assert max(ef.likeness(prints[0], prints[3 * i]) for i in range(1, 50)) < 0.8
    alike = [i for i in range(50) if ef.likeness(prints[3 * i], prints[3 * i + 1]) >= 0.8]
    assert len(alike) >= 45
    for blocks in ((256, 1024), (7, 7)):
        monkeypatch.setattr(ef, "BAND_BLOCK", blocks, raising=False)
        found = [tuple(r) for r in ef.near_in_edits(spark.createDataFrame(rows, DOCS)).collect()]
        assert all(a < b and near == ef.likeness(prints[a], prints[b]) >= 0.8 for a, b, near in found) and len(set(found)) == len(found)
        assert {(3 * i, 3 * i + 2) for i in range(50)} <= {f[:2] for f in found}
        assert {(3 * i, 3 * i + 1) for i in alike} <= {f[:2] for f in found}


def text_of_values(rng, n, level=5):
    """A text whose fingerprint has n values on the level."""
    long = prose(rng, 600)
    chars = ef.char_classes(long)
    reached = ef.walks([chars])[0][0]
    at = next(k for k, r in enumerate(reached.tolist()) if r > ef.places(level)[n - 1])
    return long[:at]


def edited_pairs(rng, each=24):
    """(place of the edit, values, text, edited text) of pairs at least 0.8 alike."""
    out = []
    for n in (65, 96, 128):
        for place in (0.0, 0.42, 0.85):
            made = 0
            while made < each:
                t = text_of_values(rng, n)
                a, b = int(place * len(t)), int((place + 0.15) * len(t))
                u = t[:a] + prose(rng, 90)[: b - a] + t[b:]
                f, g = ef.fingerprints([t, u])
                assert f[:2] == "05" and len(f) == 2 + 2 * n
                if ef.likeness(f, g) >= 0.8:
                    made += 1
                    out.append((place, n, t, u))
    return out


def test_bands_see_the_whole_text(spark):
    """Pairs edited at the start, the middle or the end share a band alike, with few values and with many."""
    pairs = edited_pairs(random.Random(21))
    rows = [(2 * i + j, p[2 + j], "en", "s", 0) for i, p in enumerate(pairs) for j in (0, 1)]
    found = {(r.head_id, r.doc_id) for r in ef.near_in_edits(spark.createDataFrame(rows, DOCS)).collect()}
    met = Counter((p[:2]) for i, p in enumerate(pairs) if (2 * i, 2 * i + 1) in found)
    assert all(met[place, n] >= 22 for n in (65, 96, 128) for place in (0.0, 0.42, 0.85)), met


def near_classes(rows, prints, least=0.8):
    """doc_id -> (least id, documents) of what hangs together over all pairs of fingerprints."""
    head = {r[0]: r[0] for r in rows}
    ids = sorted(head)
    for x in ids:
        for y in ids:
            if x < y and head[x] != head[y] and ef.likeness(prints[x], prints[y]) >= least:
                low, high = sorted((head[x], head[y]))
                head = {d: low if h == high else h for d, h in head.items()}
    sizes = Counter(head.values())
    return {d: (h, sizes[h]) for d, h in head.items()}


def test_classes_of_edited_copies(spark, monkeypatch):
    """One large cluster of edited copies, small ones, copies and single documents, over blocks of a band too."""
    rng = random.Random(31)
    base, rows = prose(rng, 220), []
    for i in range(60):
        at = rng.randrange(len(base) - 40)
        rows.append((i, base[:at] + prose(rng, 9)[:30] + base[at + 30 :], "en", "s", 0))
    for i in range(20):
        t = prose(rng, rng.choice([5, 60, 300]))
        rows += [(100 + i, t, "en", "s", 0), (200 + i, t[:-2] + "#.", "en", "s", 0), (300 + i, t, "en", "s", 0)] if i % 2 else [(100 + i, t, "en", "s", 0)]
    rows += [(400, "", "en", "s", 0), (401, None, "en", "s", 0)]
    prints = dict(zip((r[0] for r in rows), ef.fingerprints([r[1] or "" for r in rows])))
    expected = near_classes(rows, prints)
    assert max(n for _, n in expected.values()) >= 40
    for blocks in ((256, 1024), (7, 7)):
        monkeypatch.setattr(ef, "BAND_BLOCK", blocks)
        found = ef.with_near_classes(ef.fingerprint_documents(spark.createDataFrame(rows, DOCS))).collect()
        assert {r.doc_id: (r.near_class, r.near_docs) for r in found} == expected and len(found) == len(rows)
    odd = ef.with_near_classes(ef.fingerprint_documents(documents(spark, odd_rows()))).collect()
    assert len(odd) == len(odd_rows()) and {r.near_docs for r in odd if r.n_chars == 0} == {2}
    assert ef.with_near_classes(ef.fingerprint_documents(spark.createDataFrame([], DOCS))).collect() == []
