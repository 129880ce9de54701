"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from locusframe.llm.common import named, save, ship
from locusframe.llm.shingles import chunks, ngram_hashes, text_buffer, word_hashes

#: Shrinkage of a class covariance towards the pooled one, and of the result towards a multiple of the identity.
TO_POOLED, TO_SPHERE = 0.02, 0.005
#: Added to the counts behind a share, so that a single digit or repeated line says little in a short text.
SMOOTH_BYTES, SMOOTH_DISTINCT = 8, 4
THRESHOLD = 0.3

# Classes of bytes whose shares are statistics.
BYTE_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:?'\"-",
    "shout": b"!",
    "symbol": b"#$%&*@|<>{}[]\\^~_=+/`",
    "space": b"\x20\x09\x0b\x0c\x0d",
    "line": b"\x0a",
}
STATISTICS = (*BYTE_CLASSES, "other", "words", "word_bytes", "distinct_words", "distinct_trigrams", "distinct_lines", "line_words")


def _distinct_share(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Smoothed share of different values in each run; 1 for an empty run."""
    n = np.diff(at)
    run = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((values, run))
    v, r = values[order], run[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return (np.bincount(r[new], minlength=len(n)) + SMOOTH_DISTINCT) / (n + SMOOTH_DISTINCT)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each whole text: shares as arcsines of their roots, sizes as logarithms."""
    n_texts = len(offsets) - 1
    which = np.full(256, len(BYTE_CLASSES), np.int64)
    for k, chars in enumerate(BYTE_CLASSES.values()):
        which[list(chars)] = k
    lo = offsets[0]
    part, size = data[lo : offsets[-1]], np.diff(offsets)
    classes = len(BYTE_CLASSES) + 1
    text = np.repeat(np.arange(n_texts), size)
    counts = np.bincount(text * classes + which[part], minlength=n_texts * classes).reshape(n_texts, classes).astype(float)
    common = np.array([k in ("lower", "stop", "space") for k in (*BYTE_CLASSES, "other")])
    shares = counts / np.where(common, np.maximum(size, 1)[:, None], size[:, None] + SMOOTH_BYTES)
    words, firsts = word_hashes(data, offsets)
    grams, at = ngram_hashes(words, firsts, 3)
    n_words = np.diff(firsts)
    # A line is the sum of its words' hashes, which holds repeated lines together whatever the spacing.
    begins = np.zeros(len(part) + 1, dtype=bool)
    begins[offsets - lo] = True
    begins[1:][part == 10] = True
    line_at = np.flatnonzero(begins[:-1]) if len(part) else np.zeros(0, np.int64)
    word_start = _word_starts(part, offsets - lo)
    line_first = np.searchsorted(word_start, np.append(line_at, len(part)))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(words, dtype=np.uint64)))
    full = np.flatnonzero(np.diff(line_first) > 0)
    lines = sums[line_first[full + 1]] - sums[line_first[full]] if len(full) else np.zeros(0, np.uint64)
    line_text = np.searchsorted(offsets - lo, line_at[full], "right") - 1 if len(full) else np.zeros(0, np.int64)
    per_text = np.bincount(line_text, minlength=n_texts)
    lines_at = np.concatenate(([0], np.cumsum(per_text)))
    columns = [np.log1p(n_words), np.log1p((size - counts[:, 6] - counts[:, 7]) / np.maximum(n_words, 1))]
    columns += [np.arcsin(np.sqrt(_distinct_share(v, a))) for v, a in ((words, firsts), (grams, at), (lines, lines_at))]
    columns += [np.log1p(n_words / np.maximum(per_text, 1))]
    return np.column_stack([np.arcsin(np.sqrt(np.clip(shares, 0, 1))), *columns])


def _word_starts(part: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    space = (part == 0x20) | ((part >= 9) & (part <= 13))
    first = np.zeros(len(part) + 1, dtype=bool)
    first[offsets] = True
    before = np.ones(len(part), dtype=bool)
    before[1:] = space[:-1]
    return np.flatnonzero(~space & (before | first[:-1])) if len(part) else np.zeros(0, np.int64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for first, last in chunks(offsets):
            rows = statistics(data, offsets[first : last + 1])
            flat = pa.array(rows.ravel(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), flat)], ["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A class's count, sums and sums of products over a task's rows, as one array."""
    d, held = len(STATISTICS), {}
    for batch in batches:
        if batch.num_rows:
            x, y = _matrix(batch.column("x")), np.asarray(batch.column("label"))
            for c in (0, 1):
                own = x[y == c]
                held[c] = held.get(c, 0) + np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
    for c, m in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([c] * (1 + d + d * d), pa.int32()), pa.array(np.arange(1 + d + d * d), pa.int32()), pa.array(m, pa.float64())], ["label", "at", "v"])


@dataclass
class Discriminant:
    """Per class: mean, inverse of the Cholesky factor of the shrunk covariance, log determinant, log prior."""

    classes: dict[int, tuple[np.ndarray, np.ndarray, float, float]]
    default: float

    @classmethod
    def fit(cls, moments: dict[int, np.ndarray], to_pooled: float, to_sphere: float) -> Discriminant:
        d, n = len(STATISTICS), {c: m[0] for c, m in moments.items() if m[0] > 0}
        total = sum(n.values())
        if len(n) < 2:
            return cls({}, float(next(iter(n))) if n else 0.5)
        mean = {c: moments[c][1 : 1 + d] / n[c] for c in n}
        cov = {c: moments[c][1 + d :].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c in n}
        pooled = sum(cov[c] * n[c] for c in n) / total
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        pooled, classes = pooled / np.outer(scale, scale), {}
        for c in n:
            shrunk = (1 - to_pooled) * cov[c] / np.outer(scale, scale) + to_pooled * pooled
            shrunk = (1 - to_sphere) * shrunk + to_sphere * max(np.trace(shrunk) / d, 1e-3) * np.eye(d)
            factor = np.linalg.cholesky(shrunk)
            classes[c] = (mean[c], np.linalg.inv(factor) / scale, 2 * float(np.log(np.diag(factor)).sum()), float(np.log(n[c] / total)))
        return cls(classes, 0.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.default)
        density = {c: prior - 0.5 * (det + (((x - mean) @ inverse.T) ** 2).sum(1)) for c, (mean, inverse, det, prior) in self.classes.items()}
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def _scored(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("x"))), pa.float64())], ["doc_id", "score"])

    return run


def held_out(doc_id) -> F.Column:
    """Rows kept from training: crc32 of the id as text is a multiple of 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every whole text, as a saved table."""
    ship(docs.sparkSession)
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    return save(rows.mapInArrow(_measure, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>"), "quality-statistics")


def fit(statistics_table: DataFrame, labels: DataFrame, *, label_col: str = "quality", to_pooled: float = TO_POOLED, to_sphere: float = TO_SPHERE) -> Discriminant:
    """The discriminant of all labelled documents that are not held out; moments are summed on the executors."""
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    partial = statistics_table.join(known, "doc_id").select("x", "label").mapInArrow(_moments, "label int, at int, v double")
    moments: dict[int, np.ndarray] = {}
    for row in partial.groupBy("label", "at").agg(F.sum("v").alias("v")).collect():  # two arrays of fixed length
        moments.setdefault(row["label"], np.zeros(1 + len(STATISTICS) * (1 + len(STATISTICS))))[row["at"]] = row["v"]
    return Discriminant.fit(moments, to_pooled, to_sphere)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    A text's score is the posterior of label 1 under one Gaussian for each label
    over STATISTICS of the whole text, from differences of Mahalanobis log
    densities. Class covariances are shrunk to the pooled one and to a sphere;
    their Cholesky factors are inverted once and sent with the tasks. Training
    reads every labelled row that is not held out (no sample), and only its text.

    Null and empty texts get the score of the empty text. Null ids are scored but
    never trained on; a repeated id is scored for each row. Labels other than 0 and
    1 are passed over; with one label only, all scores are that label, with none 0.5.
    An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    x = measured(docs, id_col, text_col)
    model = fit(x, labels, label_col=label_col)
    kind = x.schema["doc_id"].dataType.simpleString()
    scored = x.mapInArrow(_scored(model), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def _with_statistics(text_col: str):
    """Whole rows with their texts' statistics as one more column, the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(text_col))
            for first, last in chunks(offsets):
                rows = statistics(data, offsets[first : last + 1])
                x = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), pa.float64()))
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, x], [*part.schema.names, "x"])

    return run


def _filtered(model: Discriminant, threshold: float):
    """Of rows with statistics in the last column, those that score ``threshold`` or more, without that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                last = batch.num_columns - 1
                good = pa.array(model.score(_matrix(batch.column(last))) >= threshold)
                yield pa.RecordBatch.from_arrays(batch.columns[:last], batch.schema.names[:last]).filter(good)

    return run


def accepted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``classify`` predicts 1 for, with all columns as they are.

    Statistics are worked out once and written beside their rows; no row is shuffled
    but the statistics of labelled ones. Null, empty and very long texts, null and
    repeated ids, repeated rows, missing labels and an empty table are as in
    ``classify``. Columns may have any name.
    """
    ship(docs.sparkSession)
    # Columns go by their places meanwhile, so that their names clash with nothing.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = save(plain.mapInArrow(_with_statistics(at[text_col]), StructType([*plain.schema.fields, StructField("x", ArrayType(DoubleType()))])), "quality-rows")
    model = fit(rows.select(F.col(at[id_col]).alias("doc_id"), "x"), labels, label_col=label_col)
    return rows.mapInArrow(_filtered(model, threshold), plain.schema).toDF(*docs.columns)
