"""Word n-gram sets and MinHash signatures, vectorised over the bytes of many texts at once."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def kept(name: str, make):
    """A value made once in a Python worker, however many tasks it runs."""
    store = sys.__dict__.setdefault("_locusframe_kept", {})
    if name not in store:
        store[name] = make()
    return store[name]


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least n positions."""
    have = kept("powers", lambda: [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    if len(have[0]) < n:
        size = max(n, CHUNK_BYTES * 2)
        for i, x in enumerate((int(_BASE), _inverse(int(_BASE)))):
            p = np.full(size, np.uint64(x))
            p[0] = 1
            have[i] = np.multiply.accumulate(p)
    return have[0], have[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Runs of texts (first, last) of at most ``limit`` bytes, or a single longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts in turn, and each text's first word (with one end more).

    A word is a run of bytes other than \\x20 and \\x09-\\x0D, in one text.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    part = data[lo:hi]
    if not len(part):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _IS_SPACE[part]
    begins = np.zeros(len(part) + 1, dtype=bool)
    begins[offsets - lo] = True  # a text ends the word before it
    starts_here = ~space
    before_ends = np.empty(len(part), dtype=bool)
    before_ends[0] = True
    before_ends[1:] = space[:-1]
    starts = np.flatnonzero(starts_here & (before_ends | begins[:-1]))
    after = np.empty(len(part), dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = np.flatnonzero(starts_here & (after | begins[1:])) + 1
    table = kept("bytes", lambda: np.random.default_rng(101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    power, inverse = _powers(len(part) + 1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(table[part] * power[: len(part)], out=sums[1:])
    hashes = _mixed((sums[ends] - sums[starts]) * inverse[starts])
    return hashes, np.searchsorted(starts, offsets - lo)


def ngram_hashes(words: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words of each text in turn (repeats kept), and each text's first.

    A text of fewer than n words, but at least one, has the run of all its words as its only gram.
    """
    counts = np.diff(firsts)
    grams = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(grams)))
    out = np.empty(int(at[-1]), np.uint64)
    if not len(out):
        return out, at
    factors = [np.uint64(int(_BASE) ** (2 * i + 3) & (1 << 64) - 1 | 1) for i in range(n)]
    full = np.zeros(len(words), np.uint64)
    for i, f in enumerate(factors):
        full[: len(words) - i] += words[i:] * f
    full = _mixed(full)
    doc = np.repeat(np.arange(len(counts)), grams)
    out[:] = full[firsts[doc] + np.arange(len(out)) - at[doc]]
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        run = words[firsts[d] : firsts[d] + counts[d]]
        h = np.uint64(counts[d])
        for w, f in zip(run, factors):
            h = np.uint64((int(h) + int(w) * int(f)) & (1 << 64) - 1)
        out[at[d]] = _mixed(np.array([h]))[0]
    return out, at


def signatures(grams: np.ndarray, at: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k 16-bit MinHash values of each text; zeros for a text without grams."""
    n = len(at) - 1
    sig = np.zeros((n, k), np.uint16)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return sig
    a, b = kept(f"minhash{k}-{seed}", lambda: (np.random.default_rng(seed).integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), np.random.default_rng(seed + 1).integers(0, 1 << 32, k, dtype=np.uint32)))
    short, starts = (grams >> np.uint64(32)).astype(np.uint32), at[full]
    for i in range(k):
        least = np.minimum.reduceat((short ^ b[i]) * a[i], starts)
        sig[full, i] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    return sig


def gram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The set of n-gram hashes of each text, sorted."""
    out: list[np.ndarray] = []
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    for first, last in chunks(offsets):
        words, firsts = word_hashes(data, offsets[first : last + 1])
        grams, at = ngram_hashes(words, firsts, n)
        out += [np.unique(grams[at[i] : at[i + 1]]) for i in range(last - first)]
    return out
