"""Document fingerprints by a randomised edit embedding.

A walk goes over a text's characters: at step t it writes the character it is on
and moves to the next one or stays, as a random bit shared by all texts says for
(t mod PERIOD, character). Two texts a few edits apart fall back into step, so
their written strings differ in few places: edit distance becomes Hamming
distance. A fingerprint samples places of the written string, one from every
block of 2**level steps, the level being the least that gives at most SAMPLES.
Blocks of a level are pairs of those below and keep the place of one of the two,
so fingerprints of texts of any length are compared on places they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.llm.common import TIES, discard, join_hot, maybe_in, named, parts_for, range_bounds, range_of, runs, save, ship, with_ties
from locusframe.llm.components import components
from locusframe.llm.pairs import Sets, gridded, sides
from locusframe.llm.shingles import kept

SAMPLES, PERIOD, CLASSES = 128, 256, 256
#: Characters of a text walked at once, and those walked before them to fall into step with the piece before.
PIECE, LEAD = 4096, 512
#: Cells of the padded matrices of one pass; characters of the texts taken together.
_CELLS, _BATCH_CHARS = 4_000_000, 2_000_000
#: Least and most fingerprints in a block of a band; a task compares a block with itself or with another.
BAND_BLOCK = (256, 1024)
#: Bands of a fingerprint, sampled values in each, and the likeness from which two are near.
BANDS, PLACES, NEAR = 16, 6, 0.8


def _stays() -> np.ndarray:
    """Steps spent on a character of a class that is reached at a phase, at [phase * CLASSES + class]."""
    bits = np.random.default_rng(2003).integers(0, 2, (PERIOD, CLASSES), dtype=np.uint8)
    bits[0, ~bits.any(0)] = 1
    out = np.empty((PERIOD, CLASSES), np.uint8)
    for c in range(CLASSES):
        ones = np.flatnonzero(np.concatenate((bits[:, c], bits[:, c])))
        out[:, c] = ones[np.searchsorted(ones, np.arange(PERIOD))] - np.arange(PERIOD) + 1
    return out.ravel()


def char_classes(text: str) -> np.ndarray:
    """A byte for each code point, spread over CLASSES."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _runs_of(pieces: list[np.ndarray], phases: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Step at which each character of each piece is reached (from 0 at its first) and each piece's total."""
    stays = kept("edit-stays", _stays)
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    arrivals: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
    totals = np.zeros(len(pieces), np.int64)
    at = 0
    while at < len(order):
        width = int(lengths[order[at]])
        if not width:
            break
        group = order[at : at + max(1, _CELLS // width)]
        group = group[lengths[group] > 0]
        chars = np.zeros((width, len(group)), np.uint8)
        for j, g in enumerate(group):
            chars[: lengths[g], j] = pieces[g]
        reached = np.zeros((width, len(group)), np.int32)
        step, start = np.zeros(len(group), np.int32), phases[group].astype(np.int32)
        alive = np.searchsorted(-lengths[group], -np.arange(width), "left")  # pieces longer than each column
        for k in range(width):
            n = alive[k]
            s = step[:n]
            reached[k, :n] = s
            s += stays[((s + start[:n]) & (PERIOD - 1)) * CLASSES + chars[k, :n]]
        reached = np.ascontiguousarray(reached.T)
        for j, g in enumerate(group):
            arrivals[g], totals[g] = reached[j, : lengths[g]], step[j]
        at += len(group)
    return arrivals, totals


def walks(texts: list[np.ndarray], phases: np.ndarray | None = None) -> list[tuple[np.ndarray, int]]:
    """(step at which each character is reached, steps in all) of the walk over each text.

    Long texts are walked in pieces side by side: each piece begins LEAD characters
    early at a guessed phase, and walks that differ in phase soon meet. Pieces
    whose phase is not the one that the piece before left are walked again, until
    all fit, so the result is that of one walk.
    """
    phases = np.zeros(len(texts), np.int64) if phases is None else phases
    pieces, starts, leads, owner = [], [], [], []
    for i, t in enumerate(texts):
        for a in range(0, max(len(t), 1), PIECE):
            lead = min(a, LEAD)
            pieces.append(t[a - lead : a + PIECE])
            starts.append(phases[i] if not a else 0)
            leads.append(lead)
            owner.append(i)
    starts, leads, owner = np.array(starts, np.int64), np.array(leads), np.array(owner)
    arrivals, totals = _runs_of(pieces, starts)
    cut: list[np.ndarray] = []
    first_phase, spent = starts.copy(), totals.copy()
    for j, (a, lead) in enumerate(zip(arrivals, leads)):
        if lead:
            before = int(a[lead]) if lead < len(a) else int(totals[j])
            first_phase[j] = (starts[j] + before) & (PERIOD - 1)
            spent[j] -= before
            a = a[lead:] - before
        cut.append(a)
    while True:
        left = (first_phase + spent) & (PERIOD - 1)
        wrong = np.flatnonzero((owner[1:] == owner[:-1]) & (first_phase[1:] != left[:-1])) + 1 if len(owner) else owner
        if not len(wrong):
            break
        first_phase[wrong] = left[wrong - 1]
        again, totals = _runs_of([pieces[j][leads[j] :] for j in wrong], first_phase[wrong])
        for j, a, t in zip(wrong, again, totals):
            cut[j], spent[j] = a, t
    out, bounds = [], np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        b, e = bounds[i], bounds[i + 1]
        if e - b == 1:
            out.append((cut[b], int(spent[b])))
        else:
            base = np.concatenate(([0], np.cumsum(spent[b:e])))
            out.append((np.concatenate([cut[j].astype(np.int64) + base[j - b] for j in range(b, e)]), int(base[-1])))
    return out


def _bit(level: int, blocks: np.ndarray) -> np.ndarray:
    """Which of its two halves a block of a level takes its place from."""
    h = (blocks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(63)).astype(np.int64)


def places(level: int) -> np.ndarray:
    """The sampled step of each of the first SAMPLES blocks of a level."""

    def make() -> np.ndarray:
        at = np.arange(SAMPLES, dtype=np.int64)
        for k in range(level, 0, -1):
            at = 2 * at + _bit(k, at)
        return at

    return kept(f"edit-places{level}", make)


def sampled(classes: np.ndarray, reached: np.ndarray, steps: int) -> str:
    """The fingerprint: two digits of the level, then a byte in hex for each sampled step."""
    level = max(0, (max(steps, 1) - 1).bit_length() - (SAMPLES - 1).bit_length())
    at = places(level)
    at = at[: np.searchsorted(at, steps)]
    return f"{level:02x}" + classes[np.searchsorted(reached, at, "right") - 1].tobytes().hex()


def _values(print_: str, level: int) -> np.ndarray:
    """A fingerprint's values on ``level``, its own or a coarser one."""
    values = np.frombuffer(bytes.fromhex(print_[2:]), np.uint8)
    for k in range(int(print_[:2], 16) + 1, level + 1):
        blocks = np.arange((len(values) + 1) // 2)
        child = 2 * blocks + _bit(k, blocks)
        values = values[child[child < len(values)]]
    return values


def likeness(a: str, b: str) -> float:
    """Share of the places of either fingerprint, on the coarser of their levels, at which both have the same value."""
    top = max(int(a[:2], 16), int(b[:2], 16))
    parts = [_values(f, top) for f in (a, b)]
    n, most = min(map(len, parts)), max(map(len, parts))
    return float(np.count_nonzero(parts[0][:n] == parts[1][:n]) / most) if most else 1.0


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints of whole texts; equal texts have equal ones."""
    chars = [char_classes(t) for t in texts]
    return [sampled(c, *w) for c, w in zip(chars, walks(chars))]


def compared(texts: list[str]) -> list[tuple]:
    """For each text but the last, with the one after it: (n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has the text's last third replaced by as many first
    characters of the next one; its walk is the text's own up to there.
    """
    chars = [char_classes(t) for t in texts]
    walked = walks(chars)
    own = [sampled(c, *w) for c, w in zip(chars, walked)]
    keep = [len(c) - len(c) // 3 for c in chars]
    tails = [chars[i + 1][: len(chars[i]) // 3] for i in range(len(texts) - 1)]
    begin = [int(w[0][k]) if k < len(w[0]) else w[1] for k, w in zip(keep, walked)]
    tail_walks = walks(tails, np.array([b & (PERIOD - 1) for b in begin[:-1]], np.int64))
    out = []
    for i, (reached, steps) in enumerate(tail_walks):
        k = keep[i]
        edited = texts[i][:k] + texts[i + 1][: len(chars[i]) // 3]
        f = sampled(np.concatenate((chars[i][:k], tails[i])), np.concatenate((walked[i][0][:k].astype(np.int64), reached.astype(np.int64) + begin[i])), begin[i] + steps)
        out.append((len(chars[i]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own[i], f, likeness(own[i], f), likeness(own[i], own[i + 1])))
    return out


_FIELDS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_TYPES = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_DDL = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row_batch(ids: pa.Array, rows: list[tuple], **edge) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)] if rows else [pa.nulls(len(ids), t) for t in _TYPES]
    part = [pa.array([edge.get(k)] * len(ids), t) for k, t in (("part", pa.int64()), ("place", pa.int32()), ("text", pa.string()))]
    return pa.RecordBatch.from_arrays([ids, *columns, *part], ["doc_id", *_FIELDS, "part", "place", "text"])


def _packed(bounds: list[tuple]):
    """Rows with the range of ids they are in, largest ids first, and their texts compressed for the way there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                part = range_of(bounds, *[batch.column(c).to_pylist() for c in ("doc_id", *TIES)], nulls_last=False)
                text = [squeeze(t.as_buffer()) for t in batch.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([len(bounds) - p for p in part], pa.int64()), *[batch.column(c) for c in ("doc_id", *TIES)], pa.array(text, pa.binary())], ["part", "doc_id", *TIES, "packed"])

    return run


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their followers in the range; its first and last row come with their texts, for the ranges beside it."""
    part, ids, texts, chars, unpack = None, [], [], 0, zstandard.ZstdDecompressor().decompress

    def closed() -> Iterator[pa.RecordBatch]:
        if len(texts) > 1:
            yield _row_batch(pa.concat_arrays(ids[:-1]), compared(texts))
        if texts:
            yield _row_batch(ids[-1], [], part=part, place=1, text=texts[-1])

    for batch in batches:
        parts, packed = batch.column("part").to_pylist(), batch.column("packed")
        for i in range(batch.num_rows):
            text, own = unpack(packed[i].as_buffer()).decode("utf-8", "surrogatepass"), batch.column("doc_id").slice(i, 1)
            if parts[i] != part:
                yield from closed()
                part, ids, texts, chars = parts[i], [], [], 0
                yield _row_batch(own, [], part=part, place=0, text=text)
            ids.append(own)
            texts.append(text)
            chars += len(text)
            if chars >= _BATCH_CHARS and len(texts) > 1:
                yield _row_batch(pa.concat_arrays(ids[:-1]), compared(texts))
                ids, texts, chars = ids[-1:], texts[-1:], len(texts[-1])
    yield from closed()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows = compared([batch.column("text")[i].as_py(), batch.column("next_text")[i].as_py()])
            full = _row_batch(batch.column("doc_id").slice(i, 1), rows)
            yield full.select(["doc_id", *_FIELDS])


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, as a saved table.

    The next document is the one with the next smaller id; after the last comes the
    first. Whole texts are dealt once, compressed, by ranges of the id that hold about
    as much text each; only the first and the last row of each range are looked at
    again, to pair neighbouring ranges.

    A null text counts as empty; an empty text has an empty fingerprint, alike to
    another empty one (1) and to no other (0). A very long text is walked in pieces and
    takes some 20 bytes a character in its task. Null ids come last; equal ids are in
    order of their texts' hashes, largest first, and repeated rows follow one another. A
    single document is its own next one. An empty table gives an empty result. Other
    columns of ``docs`` are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = with_ties(rows, F.col("text"))
    bounds = range_bounds(rows, "text", "fingerprint-keys", nulls_last=False)
    order = ["part", F.col("doc_id").desc_nulls_last(), *[F.col(c).desc() for c in TIES]]
    packed = rows.mapInArrow(_packed(bounds), f"part long, doc_id {kind}, {TIES[0]} long, {TIES[1]} long, packed binary")
    dealt = packed.repartition(len(bounds) + 1, "part").sortWithinPartitions(*order).select("part", "doc_id", "packed")
    done = save(dealt.mapInArrow(_with_next, f"doc_id {kind}, {_DDL}, part long, place int, text string"), "fingerprint-parts")
    edges = done.filter("part IS NOT NULL")
    # One row a range: the window's single task gets as many rows as there are ranges.
    parts = edges.filter("place = 0").select("part").distinct()
    after = parts.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())).alias("next_part"))
    last = edges.filter("place = 1").select("doc_id", "text", "part").join(F.broadcast(after), "part")
    first = edges.filter("place = 0").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    paired = last.join(first, "next_part").select("doc_id", "text", "next_text").mapInArrow(_edges, f"doc_id {kind}, {_DDL}")
    out = done.filter("part IS NULL").select("doc_id", *_FIELDS).unionByName(paired)
    out._saved_at = done._saved_at
    return out


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        found = [f for a in range(0, batch.num_rows, 500) for f in fingerprints(texts.slice(a, 500).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])


def _band_keys(bands: int, places_each: int, least: float):
    """Bands of a fingerprint: random subsets of its values, at its own level and at those that an alike one may be on.

    A band takes, of its own random order of all SAMPLES places, the first that the
    fingerprint has. So the whole text is drawn from, and fingerprints whose numbers
    of values differ a little take the same places but for few. Its key holds the
    level, the band's number and, mixed, the values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = np.random.default_rng(77)
        orders = [pick.permutation(SAMPLES) for _ in range(bands)]
        for batch in batches:
            prints = batch.column("fingerprint").to_pylist()
            like: dict[tuple[int, int], list[int]] = {}
            for i, f in enumerate(prints):
                like.setdefault((int(f[:2], 16), (len(f) - 2) // 2), []).append(i)
            rows, keys = [], []
            for (level, n), own in like.items():
                values = np.frombuffer(bytes.fromhex("".join(prints[i][2:] for i in own)), np.uint8).reshape(len(own), n)
                while True:
                    for b, order in enumerate(orders):
                        key = np.full(len(own), level << 8 | b, np.uint64)
                        for at in order[order < values.shape[1]][:places_each]:
                            key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (key >> np.uint64(29)) ^ values[:, at]
                        rows.append(np.array(own, np.int64))
                        keys.append(key)
                    # An alike fingerprint has values / least at most; it is on the next level if that is more than SAMPLES.
                    if values.shape[1] <= least * SAMPLES:
                        break
                    level, blocks = level + 1, np.arange((values.shape[1] + 1) // 2)
                    child = 2 * blocks + _bit(level, blocks)
                    values = values[:, child[child < values.shape[1]]]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(keys).view(np.int64))], ["node", "band"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part sorted by band, the rows whose band a neighbour has too; the part's first and last row may be met in the parts beside it."""
    held, before = None, np.array([True])
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        band = rows.column("band").to_numpy()
        same = band[1:] == band[:-1]
        if len(same):
            keep = np.flatnonzero(np.append(before, same[:-1]) | same)
            yield rows.take(pa.array(keep))
            before = same[-1:]
        held = rows.slice(rows.num_rows - 1, 1)
    if held is not None:
        yield held


def _on_level(prints: list[str], level: int) -> tuple[np.ndarray, np.ndarray]:
    """(values padded by 256, their numbers) of fingerprints of at most that level, brought to it."""
    out = np.full((len(prints), SAMPLES), 256, np.uint16)
    sizes = np.zeros(len(prints), np.int64)
    for i, f in enumerate(prints):
        values = _values(f, level)
        sizes[i] = len(values)
        out[i, : len(values)] = values
    return out, sizes


def _spanning_pairs(least: float):
    """Per band (or pair of its blocks): pairs at least ``least`` alike that hang together all members that such pairs do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), g, _ in runs(batches, ["band", "i", "j"]):
            levels, node = np.array([int(f[:2], 16) for f in g["fingerprint"]]), g["node"]
            sets, found = Sets(len(levels)), []
            left, right = sides(g["block"], i, j)
            # A pair is compared on the coarser of its levels: with a fingerprint of level k, all of k and below.
            for k in np.unique(levels).tolist():
                member = np.flatnonzero(levels <= k)
                values, sizes = _on_level([g["fingerprint"][m] for m in member], k)
                at = np.zeros(len(levels), np.int64)
                at[member] = np.arange(len(member))
                rows, others_of = left[levels[left] <= k], right[levels[right] <= k]
                for n, x in enumerate(rows):
                    others = others_of[n + 1 :] if i == j else others_of
                    same = np.count_nonzero(values[at[others], : sizes[at[x]]] == values[at[x], : sizes[at[x]]], axis=1)
                    most = np.maximum(sizes[at[others]], sizes[at[x]])
                    near = np.where(most > 0, same / np.maximum(most, 1), 1.0)
                    hit = np.flatnonzero((near >= least) & (np.maximum(levels[others], levels[x]) == k))
                    # One pair for each set that the row is not in yet.
                    heads, first = np.unique(sets.head[others[hit]], return_index=True)
                    for y in hit[first[heads != sets.head[x]]]:
                        found.append((node[x], node[others[y]], float(near[y])))
                    sets.join(x, others[hit])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([min(a, b) for a, b, _ in found], pa.int64()), pa.array([max(a, b) for a, b, _ in found], pa.int64()), pa.array([x for *_, x in found], pa.float64())], ["a", "b", "near"])

    return run


def _near_nodes(prints: DataFrame, bands: int, places_each: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Different fingerprints (node, fingerprint, least_id, copies) and the pairs (a, b, near) of nodes that span the near ones, as saved tables."""
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    nodes = save(nodes.withColumn("node", F.xxhash64("fingerprint")), "edit-nodes")
    banded = save(nodes.select("node", "fingerprint").mapInArrow(_band_keys(bands, places_each, least), "node long, band long"), "edit-bands")
    total = banded.count()
    # Cut by ranges: a band of any number of fingerprints may span many parts.
    sorted_ = banded.repartitionByRange(parts_for(banded, total), "band", "node").sortWithinPartitions("band", "node")
    met = save(sorted_.mapInArrow(_met, "node long, band long"), "edit-met")
    # Bands of the same members are looked at once.
    sized = met.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("node").alias("first")).filter("n > 1")
    sized = save(sized.groupBy("n", "members", "first").agg(F.min("band").alias("band")).select("band", "n"), "edit-sized")
    grid = gridded(join_hot(met, sized, "band", "n", total).join(nodes.select("node", "fingerprint"), "node"), "band", "node", BAND_BLOCK)
    pairs = save(grid.select("band", "i", "j", "block", "node", "fingerprint").mapInArrow(_spanning_pairs(least), "a long, b long, near double"), "edit-pairs")
    discard(banded, met, sized)
    return nodes, pairs


def near_in_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, places_each: int = PLACES, least: float = NEAR) -> DataFrame:
    """Pairs (head_id, doc_id, near), head_id < doc_id, whose fingerprints are ``least`` alike and share a band, enough to span all such pairs.

    A band is a random subset of the sampled values, from the whole text. All members of a band are
    compared with one another, in pairs of blocks where it has more than a block's
    size (work in the square of its different fingerprints), and from each task come the pairs of a spanning forest: any two
    documents that share a band and are alike hang together over rows of the result,
    and a band of any size gives a row or so a member and block, never all pairs. Each
    row is a pair that was compared itself. Likeness is that of the sampled places.

    Documents with one fingerprint are one member, under the least of their ids, and
    each of the others gets a row with that id (near is 1). A null text counts as empty,
    empty texts are copies, and texts of any length have fingerprints of like size. Null
    ids take no part, and an id is not paired with itself, if it repeats. Which pairs span is fixed by the
    data. An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
    kind = rows.schema["doc_id"].dataType.simpleString()
    prints = save(rows.mapInArrow(_prints, f"doc_id {kind}, fingerprint string"), "edit-prints")
    nodes, pairs = _near_nodes(prints, bands, places_each, least)
    several = nodes.filter("copies > 1").select("fingerprint", F.col("least_id").alias("head_id"), "copies")
    copies = join_hot(prints, several, "fingerprint", "copies", prints.count()).select("head_id", "doc_id", F.lit(1.0).alias("near"))
    id_of = lambda node: nodes.select(F.col("node").alias(node), F.col("least_id").alias(f"{node}_id"))
    spanning = pairs.join(id_of("a"), "a").join(id_of("b"), "b").select(F.least("a_id", "b_id").alias("head_id"), F.greatest("a_id", "b_id").alias("doc_id"), "near")
    return copies.unionByName(spanning).filter("head_id <> doc_id").distinct()


def with_near_classes(prints: DataFrame, *, bands: int = BANDS, places_each: int = PLACES, least: float = NEAR) -> DataFrame:
    """``prints``, a saved table with doc_id and fingerprint, with near_class and near_docs: the least id that a document
    hangs together with over pairs that share a band and are ``least`` alike (see near_in_edits), and the number of documents that do.

    Rows of fingerprints that are alone, as a filter of hashes tells, are not moved. A
    class of null ids has a null near_class. Ties, repeated rows, empty texts and an
    empty table are as in near_in_edits.
    """
    ship(prints.sparkSession)
    nodes, pairs = _near_nodes(prints.select("doc_id", "fingerprint"), bands, places_each, least)
    stars = components(pairs.select("a", "b"), "edit-classes")
    total = prints.count()
    # Fingerprints of several documents, and those near another one.
    placed = nodes.select("node", "least_id", "copies").join(stars, "node", "left").filter("copies > 1 OR label IS NOT NULL")
    placed = save(placed.withColumn("label", F.coalesce("label", "node")), "edit-placed")
    classes = save(placed.groupBy("label").agg(F.min("least_id").alias("near_class"), F.sum("copies").alias("near_docs"), F.count("*").alias("n")), "edit-class")
    known = save(join_hot(placed, classes, "label", "n", total).select("node", "copies", "near_class", "near_docs").dropDuplicates(["node"]), "edit-known")
    several = maybe_in(known.select("node"))
    keyed = prints.withColumn("node", F.xxhash64("fingerprint"))
    met = join_hot(keyed.filter(several(F.col("node"))), known, "node", "copies", total).select(*prints.columns, "near_class", "near_docs")
    # Rows that the filter lets by and that are in no class after all.
    alone = keyed.filter(several(F.col("node"))).join(known.select("node"), "node", "left_anti").unionByName(keyed.filter(~several(F.col("node"))))
    discard(nodes, pairs, stars, placed, classes)
    return met.unionByName(alone.select(*prints.columns, F.col("doc_id").alias("near_class"), F.lit(1).cast("long").alias("near_docs")))
