"""N-gram Jaccard join: a MinHash LSH forest, then exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import delete_folders, discard, join_hot, maybe_in, named, parts_for, runs, save, ship, unpacked, whole_row
from locusframe.llm.components import components
from locusframe.llm.pairs import Sets, gridded, sides
from locusframe.llm.shingles import chunks, gram_sets, ngram_hashes, signatures, text_buffer, word_hashes

#: Trees, and the MinHash values of a label: four values of 16 bits to a number, first value highest.
TREES, DEPTH = 32, 8
_PER_LONG = 4
#: Least and most texts in a block of a trie node, or of a candidate group; bytes of gram differences in a block of the latter.
NODE_BLOCK, GROUP_BLOCK, BLOCK_BYTES = (256, 1024), (64, 512), 8 << 20
#: Least and most texts, and words of them, that are held against their group's head together; chunks that a group is cut into between the two.
HEAD_TEXTS, HEAD_WORDS, HEAD_CHUNKS = (16, 512), 1_000_000, 128
#: Estimated similarity below the threshold from which a pair is a candidate: over six standard errors at 0.8 for 256 values.
MARGIN = 0.16
_VERIFY_COLUMNS = 8192


def met_probability(similarity: float, depth: int, trees: int = TREES) -> float:
    """Probability that two texts share a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shortest_prefix(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The prefix at which even a pair right at the threshold is met with probability ``recall``; the ascent never goes further."""
    return next((d for d in range(depth, 1, -1) if met_probability(threshold, d, trees) >= recall), 1)


def _sketch(n: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for first, last in chunks(offsets):
                words, firsts = word_hashes(data, offsets[first : last + 1])
                grams, at = ngram_hashes(words, firsts, n)
                sig = signatures(grams, at, TREES * DEPTH, seed).astype(">u2").view(">i8").astype(np.int64)
                size = np.diff(firsts)
                digest = [hashlib.md5(data[offsets[i] : offsets[i + 1]] if size[i - first] else b"").digest() for i in range(first, last)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * sig.shape[1], pa.int32()), pa.array(sig.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), lists], ["doc_id", "digest", "words", "sig"])

    return run


def _shared(x: np.ndarray) -> np.ndarray:
    """Number of leading 16-bit values that are zero in each number."""
    x = x.view(np.uint64)
    return sum((x >> np.uint64(64 - 16 * k) == 0).astype(np.int8) for k in range(1, _PER_LONG)) + (x == 0)


def _prefix_lengths(tree: np.ndarray, labels: list[np.ndarray]) -> np.ndarray:
    """Values that each row's label shares with the next row's."""
    length = np.zeros(len(tree) - 1, np.int64)
    still = tree[1:] == tree[:-1]
    for part in labels:
        same = _shared(part[1:] ^ part[:-1])
        length += np.where(still, same, 0)
        still &= same == _PER_LONG
    return length


def _longest_matches(least: int):
    """Of a sorted part of the tries: the labels whose longest prefix match with a neighbour has ``least`` values or more, with its length.

    In sorted order a label's longest match is with a neighbour. The part's first and last
    label may match labels of the parts beside it, so they count as matching whole.
    """
    parts = [f"l{k}" for k in range(DEPTH // _PER_LONG)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, np.array([DEPTH])
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            columns = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in rows.schema.names}
            length = _prefix_lengths(columns["tree"], [columns[p] for p in parts])
            # The last row waits for the one after it.
            match = np.maximum(np.append(before, length[:-1]), length) if len(length) else np.zeros(0, np.int64)
            keep = np.flatnonzero(match >= least)
            if len(keep):
                yield pa.RecordBatch.from_arrays([*[rows.column(c).take(pa.array(keep)) for c in rows.schema.names], pa.array(match[keep], pa.int64())], [*rows.schema.names, "match"])
            before = length[-1:] if len(length) else before
            held = rows.slice(rows.num_rows - 1, 1)
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([DEPTH], pa.int64())], [*held.schema.names, "match"])

    return run


def _prefix(depth: int) -> Column:
    """A number for each prefix of ``depth`` values in each tree."""
    full, rest = divmod(depth, _PER_LONG)
    cut = [F.col(f"l{k}") for k in range(full)] + ([F.shiftrightunsigned(f"l{full}", 16 * (_PER_LONG - rest))] if rest else [])
    return F.xxhash64("tree", *cut)


def _candidates(least: float, count_from: float):
    """Per trie node (or pair of its blocks): edges that span the pairs whose signatures agree in ``least`` of their
    values, and the number of pairs for each number of agreeing values from ``count_from`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), g, _ in runs(batches, ["key", "i", "j"]):
            sig = np.array(g["sig"], np.int64).view(np.uint16)
            left, right = sides(g["block"], i, j)
            sets, values, pairs = Sets(len(sig)), sig.shape[1], np.zeros(sig.shape[1] + 1, np.int64)
            for at, x in enumerate(left):
                others = right[at + 1 :] if i == j else right
                agree = np.count_nonzero(sig[others] == sig[x], axis=1)
                sets.join(x, others[agree >= least * values])
                pairs += np.bincount(agree, minlength=values + 1)
            a = np.flatnonzero(sets.head != np.arange(len(sig)))
            b, seen = sets.head[a], np.flatnonzero(pairs[int(np.ceil(count_from * values)) :]) + int(np.ceil(count_from * values))
            node, none, empty = np.array(g["node"], np.int64), np.zeros(len(seen), np.int64), np.zeros(len(a), np.int64)
            if len(a) or len(seen):
                columns = (np.concatenate((node[a], none)), np.concatenate((node[b], none)), np.concatenate((empty, seen)), np.concatenate((empty, pairs[seen])))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "agree", "pairs"])

    return run


def expected_recall(pairs: dict[int, int], depth: int, threshold: float) -> float:
    """Share of the pairs at the threshold or above that are met at ``depth``, from those met, by their numbers of agreeing values.

    A pair of similarity s stands for 1 / p(s) pairs of its kind, p(s) being the probability
    that it is met. Pairs met in many trees are counted in each, so they weigh by
    the inverse of the expected number. Without any pair nothing is known: 0.
    """
    found = missed = 0.0
    for agree, n in pairs.items():
        s = max(agree / (TREES * DEPTH), threshold)
        weight, p = n / max(1.0, TREES * s**depth), met_probability(s, depth)
        found, missed = found + weight, missed + weight * (1 - p) / p
    return found / (found + missed) if found else 0.0


def _differences(n: int):
    """Each text of a group as what tells its grams from those of the group's head: (grams of the head, those missing, all that differ)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, None
        for batch in batches:
            labels, chunk, first = (batch.column(c).to_pylist() for c in ("label", "chunk", "first"))
            out: list[list] = [[], [], [], []]
            for x in range(batch.num_rows):
                grams = gram_sets([batch.column("text")[x].as_py().encode()], n)[0]
                if first[x]:
                    key, head = (labels[x], chunk[x]), grams
                    continue
                if (labels[x], chunk[x]) != key:
                    raise ValueError(f"group {labels[x]} has no head")
                missing = np.setdiff1d(head, grams, assume_unique=True)
                differ = np.concatenate((missing, np.setdiff1d(grams, head, assume_unique=True)))
                for c, v in zip(out, (x, len(head), len(missing), differ.tobytes())):
                    c.append(v)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("label", "node", "n_docs")], pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["label", "node", "n_docs", "head_grams", "missing", "differ"])

    return run


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets on the left with those on the right, by products of incidence columns taken a slice at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(flat):
        return out
    _, column, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df[column] > 1  # a gram of one text is in no intersection but its own
    row, column = row[shared], column[shared]
    names, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, len(names), _VERIFY_COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + _VERIFY_COLUMNS])
        m = np.zeros((len(sets), min(_VERIFY_COLUMNS, len(names) - lo)), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        out += m[left] @ m[right].T
    return out


def _verified(threshold: float):
    """Per candidate group (or pair of its blocks): each linked text's number of linked documents and texts, and the least text it hangs together with.

    The grams that two texts share are those of the head less those that either
    lacks, and what both add: |head| - missing of one - missing of the other + differences in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), g, _ in runs(batches, ["label", "i", "j"]):
            differ = [np.frombuffer(x, np.uint64) for x in g["differ"]]
            left, right = sides(g["block"], i, j)
            missing, head, weight = np.array(g["missing"]), g["head_grams"][0], np.array(g["n_docs"])
            size = head + np.array([len(x) for x in differ]) - 2 * missing
            both = _overlaps(differ, left, right).astype(np.float64) + head - missing[left][:, None] - missing[right][None]
            linked = both >= threshold * (size[left][:, None] + size[right][None] - both) - 1e-9
            if i == j:
                np.fill_diagonal(linked, False)
            docs, texts, sets = np.zeros(len(differ), np.int64), np.zeros(len(differ), np.int64), Sets(len(differ))
            docs[left], texts[left] = linked @ weight[right], linked.sum(1)
            if i != j:
                docs[right], texts[right] = weight[left] @ linked, linked.sum(0)
            for at, x in enumerate(left):
                sets.join(x, right[linked[at]])
            rows, node = np.flatnonzero(texts), np.array(g["node"], np.int64)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (node[rows], docs[rows], texts[rows], node[sets.head[rows]])], ["node", "linked_docs", "linked_texts", "head"])

    return run


def text_digest(text: Column) -> Column:
    """What tells texts apart: their MD5, and that of the empty text for all texts without words."""
    whole = F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.when(whole.rlike("[^\\x20\\x09-\\x0D]"), whole).otherwise("").cast("binary")))


def _candidate_groups(texts: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(node, label): texts that hang together over pairs whose signatures come near the threshold."""
    spark, least = texts.sparkSession, shortest_prefix(threshold, recall)
    longs = DEPTH // _PER_LONG
    entry = lambda t: F.struct(t.alias("tree"), *[F.get("sig", t * longs + k).alias(f"l{k}") for k in range(longs)])
    entries = texts.filter("words > 0").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), entry)).alias("e"), "node").select("e.*", "node")
    order = ["tree", *[f"l{k}" for k in range(longs)], "node"]
    # The tries' sorted arrays, cut by ranges: a prefix shared by any number of texts may span many parts.
    total = TREES * texts.count()
    tries = entries.repartitionByRange(parts_for(texts, total), *order).sortWithinPartitions(*order)
    tries = save(tries.mapInArrow(_longest_matches(least), "tree int, " + "".join(f"l{k} long, " for k in range(longs)) + "node long, match long"), "jaccard-tries")
    used, edges, depth, seen = [tries], [], DEPTH, None
    pairs: dict[int, int] = {}
    while True:
        placed = tries.filter(F.col("match") >= depth).select(_prefix(depth).alias("key"), "node")
        # A node with the same texts as one of another tree, or of a longer prefix, is looked at once.
        nodes = placed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("node").alias("least")).filter("n > 1")
        nodes = nodes.groupBy("n", "members", "least").agg(F.min("key").alias("key"))
        if seen is not None:
            nodes = nodes.join(seen, ["n", "members", "least"], "left_anti")
        nodes = save(nodes, "jaccard-nodes")
        met = join_hot(placed, nodes.select("key", "n"), "key", "n", total).join(texts.select("node", "sig"), "node")
        met = gridded(met, "key", "node", NODE_BLOCK).select("key", "i", "j", "block", "node", "sig")
        found = save(met.mapInArrow(_candidates(threshold - MARGIN, threshold), "a long, b long, agree long, pairs long"), "jaccard-edges")
        used += [nodes, found]
        edges.append(found.filter("pairs = 0").select("a", "b"))
        seen = nodes.drop("key") if seen is None else seen.unionByName(nodes.drop("key"))
        # A row for each number of agreeing values: TREES * DEPTH at most.
        for row in found.filter("pairs > 0").groupBy("agree").agg(F.sum("pairs").alias("pairs")).collect():
            pairs[row["agree"]] = pairs.get(row["agree"], 0) + row["pairs"]
        if depth == least or expected_recall(pairs, depth, threshold) >= recall:
            break
        depth -= 1
    every = edges[0]
    for more in edges[1:]:
        every = every.unionByName(more)
    stars = components(every, "jaccard-candidates")
    groups = save(stars, "jaccard-groups")
    discard(stars, *used)
    return groups


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999, seed: int = 7) -> DataFrame:
    """One row a document: doc_id, text_id, class_id, n_copies, n_links, n_linked_texts, keeper, digest.

    ``text_id`` is the least id with the same text, ``n_copies`` the number of
    documents with it. ``n_links`` counts the other documents whose sets of n-word
    grams have a Jaccard similarity of ``threshold`` or more (copies included),
    ``n_linked_texts`` the different texts among them. ``class_id`` is the least id
    that a document hangs together with over links. ``keeper`` marks the document of
    each class with that id (of several texts under it the one of least ``digest``).

    Texts get TREES labels of DEPTH MinHash values. The labels of a tree are sorted,
    which makes a trie; each finds its longest prefix match beside it. Texts meet in
    the nodes of the longest prefixes first. From the pairs met there, the share of
    pairs at the threshold or above that would be met is worked out; while it is below
    ``recall``, all trees' prefixes are shortened by a value and new nodes are looked
    at, as far as the length at which any pair at the threshold is met with that
    probability (see expected_recall and shortest_prefix).

    Pairs whose signatures come near the threshold span candidate groups; within these
    every pair is verified on the exact sets. A text goes once to its group's head
    and from there on as its gram differences from it. Pairs are counted inside tasks
    and never emitted; nodes and groups beyond a block's size, in texts or bytes, are
    dealt as pairs of blocks, so no link is lost and no task holds an unbounded group.
    The links of a group of n different near copies take work in n * n.

    Words are runs of characters other than \\x20 and \\x09-\\x0D. A text of one to
    n-1 words has their run as its only gram; a very long text is one row of a task.
    Texts without words, null included, are copies of one another. Ids may be null or
    repeat; repeated rows are copies. An empty table gives an empty result. Other
    columns of ``docs`` are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    sketches = save(rows.mapInArrow(_sketch(n, seed), f"doc_id {id_type}, digest binary, words long, sig array<long>"), "jaccard-sketches")
    texts = sketches.groupBy("digest").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("n_docs"), F.max("words").alias("words"), F.first("sig").alias("sig"))
    texts = save(texts.withColumn("node", F.xxhash64("digest")), "jaccard-texts")
    groups = _candidate_groups(texts, threshold, recall)
    total = sketches.count()
    wanted = groups.join(texts.select("node", "digest", "text_id", "n_docs", "words"), "node")
    sizes = save(wanted.groupBy("label").agg(F.count("*").alias("n"), F.sum("words").alias("sum_words")), "jaccard-sizes")
    wanted = join_hot(wanted, sizes, "label", "n", total)
    wanted = save(wanted.withColumn("chunks", F.greatest(F.ceil(F.col("n") / F.greatest(F.lit(HEAD_TEXTS[0]), F.least(F.lit(HEAD_TEXTS[1]), F.col("n") / HEAD_CHUNKS))), F.least(F.col("n"), F.ceil(F.col("sum_words") / HEAD_WORDS)), F.lit(1))), "jaccard-wanted")
    # The text of one document for each candidate text; only likely rows move, one of each text from a task.
    asked = maybe_in(wanted.select(F.xxhash64("digest", "text_id").alias("h")))
    marked = rows.select("text", text_digest(F.col("text")).alias("digest"), "doc_id")
    fetched = marked.filter(asked(F.xxhash64("digest", "doc_id"))).groupBy("digest").agg(F.first("text").alias("text"))
    with_text = fetched.join(wanted.select("digest", "node", "label", "n_docs", "chunks"), "digest")
    # A member goes to one chunk of its group, the group's head to all of them, ahead of the members.
    own = F.struct(F.lit(False).alias("first"), F.pmod(F.xxhash64("node"), "chunks").alias("chunk"))
    ahead = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda c: F.struct(F.lit(True).alias("first"), c.alias("chunk")))
    dealt = with_text.withColumn("at", F.explode(F.when(F.col("node") == F.col("label"), F.concat(ahead, F.array(own))).otherwise(F.array(own))))
    dealt = dealt.select("label", "at.chunk", "at.first", "node", "n_docs", "text").repartition("label", "chunk").sortWithinPartitions("label", "chunk", F.col("first").desc())
    parts = save(dealt.mapInArrow(_differences(n), "label long, node long, n_docs long, head_grams long, missing long, differ binary"), "jaccard-differences")
    bytes_of = save(parts.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.octet_length("differ")).alias("bytes")), "jaccard-bytes")
    grid = gridded(join_hot(parts, bytes_of, "label", "n", total), "label", "node", GROUP_BLOCK, BLOCK_BYTES)
    grid = grid.select("label", "i", "j", "block", "node", "n_docs", "head_grams", "missing", "differ")
    checked = save(grid.mapInArrow(_verified(threshold), "node long, linked_docs long, linked_texts long, head long"), "jaccard-checked")
    links = checked.groupBy("node").agg(F.sum("linked_docs").alias("linked_docs"), F.sum("linked_texts").alias("linked_texts"))
    stars = components(checked.select(F.col("node").alias("a"), F.col("head").alias("b")), "jaccard-links")
    linked = save(texts.select("node", "digest", "text_id", "n_docs").join(links, "node").join(stars, "node"), "jaccard-linked")
    # Ids may all be null: then the least digest is the class's.
    least = linked.groupBy("label").agg(F.min(F.struct(F.col("text_id").isNull().alias("none"), "text_id", "digest")).alias("head"), F.count("*").alias("n"))
    least = save(least.select("label", F.col("head.text_id").alias("class_id"), F.col("head.digest").alias("class_digest"), "n"), "jaccard-classes")
    known = ["digest", "text_id", "class_id", "n_copies", "n_links", "n_linked_texts", "heads"]
    in_class = join_hot(linked, least, "label", "n", total).select("digest", "text_id", "class_id", F.col("n_docs").alias("n_copies"), (F.col("linked_docs") + F.col("n_docs") - 1).alias("n_links"), F.col("linked_texts").alias("n_linked_texts"), (F.col("digest") == F.col("class_digest")).alias("heads"))
    alone = texts.join(linked.select("node"), "node", "left_anti").select("digest", "text_id", F.col("text_id").alias("class_id"), F.col("n_docs").alias("n_copies"), (F.col("n_docs") - 1).alias("n_links"), F.lit(0).cast("long").alias("n_linked_texts"), F.lit(True).alias("heads"))
    facts = save(in_class.unionByName(alone).select(*known), "jaccard-facts")
    keeper = F.col("heads") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    out = save(join_hot(sketches.select("doc_id", "digest"), facts, "digest", "n_copies", total).withColumn("keeper", keeper), "jaccard")
    delete_folders(docs.sparkSession, [asked.folder])
    discard(sketches, texts, groups, sizes, wanted, parts, bytes_of, checked, stars, linked, least, facts)
    result = out.select("doc_id", "text_id", "class_id", "n_copies", "n_links", "n_linked_texts", "keeper", "digest")
    result._saved_at = out._saved_at
    return result


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are their class's keeper, once each if repeated; all columns stay as they are.

    Rows that a filter of hashes tells from all rows that go, or come several times, are
    not moved; only the others meet their verdict. Of repeated rows that differ in
    other columns the first in order of a hash of the whole row stays.

    Nulls, empty and long texts, ties, repeated rows and an empty table are as in
    ``near_duplicates``. Columns may have any name: all are kept in one struct.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    keys = save(found.groupBy(F.col("doc_id").alias("i"), F.col("digest").alias("d")).agg(F.count("*").alias("rows"), F.bool_or("keeper").alias("keeper")), "jaccard-keys")
    discard(found)
    close = maybe_in(keys.filter("NOT keeper OR rows > 1").select(F.xxhash64("i", "d").alias("h")))
    marked = docs.select(whole_row(docs).alias("row"), named(id_col).alias("id"), text_digest(named(text_col)).alias("digest"))
    hit = close(F.xxhash64("id", "digest"))
    likely = marked.filter(hit).join(keys.filter("keeper").select("i", "d"), F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left_semi")
    once = likely.groupBy("id", "digest").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return unpacked(marked.filter(~hit).select("row").unionByName(once.select("row")), docs)
