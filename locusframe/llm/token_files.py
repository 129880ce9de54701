"""Token ids in flat binary files with 64-bit document offsets."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from locusframe.llm.common import TIES, fresh_folder, named, range_bounds, range_of, save, ship, take_place, with_ties
from locusframe.llm.shingles import kept

#: Different units a worker remembers the ids of, and the longest one remembered.
CACHED_UNITS, CACHED_CHARS = 600_000, 40


def _plain(text: str) -> bool:
    """Whether the text's only white space is single spaces and single line ends, each between visible characters."""
    return not ("  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[:1] in " \n" or text[-1:] in " \n") and text.replace("\n", "").isprintable()


def _stays_in_unit(token: dict) -> bool:
    """Whether an added token takes no white space beside it and holds none."""
    return not (token["lstrip"] or token["rstrip"] or token["single_word"] or any(c.isspace() for c in token["content"]))


class Encoder:
    """Encodes whole texts with a tokenizer of the tokenizers library.

    A byte-level tokenizer starts a new piece before a single space or line end
    between visible characters, after the latter too, and between a word and the
    point or comma that ends a unit. A plain text's ids are thus those of its units
    (what lies between spaces and line ends, with the space before it) in turn.
    Units recur: each new one is encoded by the library, many in one text that is
    cut where an id begins with a space, and its ids are kept. Other texts, and all
    texts of a tokenizer of another shape, are encoded as they are.
    """

    _PROBE = "Anb cdq,\nEf'g 12 ###.\nI h\u00e9x."

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for token, i in vocabulary.items() if token[0] == "\u0120"]] = True  # how byte-level vocabularies write a space
        self.recent: dict[str, bytes] = {}  # by unit without its space; a line's first unit has \0 in its place
        self.older: dict[str, bytes] = {}
        self.line, point, comma = [x.tobytes() for x in self._ids(["\n", ".", ","])]
        self.stop = {".": point, ",": comma}
        shape = json.loads(self.tokenizer.to_str())
        pieces = shape["pre_tokenizer"] or {}
        self.in_units = pieces.get("type") == "ByteLevel" and pieces.get("use_regex", True) and not pieces.get("add_prefix_space") and not shape["normalizer"]
        self.in_units = self.in_units and not shape.get("truncation") and not shape.get("padding") and all(_stays_in_unit(t) for t in shape["added_tokens"])
        self.in_units = self.in_units and self.encode([self._PROBE]) == [x.tobytes() for x in self._ids([self._PROBE])]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_units(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        spaced = [u for u in units if u[:1] != "\0"]
        groups = [spaced[i : i + 1000] for i in range(0, len(spaced), 1000)]
        for group, ids in zip(groups, self._ids(["".join([" " + u for u in g]) for g in groups])):
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) == len(group):
                raw, at = ids.tobytes(), [*(cuts * ids.itemsize).tolist(), ids.nbytes]
                yield from zip(group, [raw[a:b] for a, b in zip(at, at[1:])])
            else:
                yield from zip(group, [x.tobytes() for x in self._ids([" " + u for u in group])])
        first = [u for u in units if u[:1] == "\0"]
        yield from zip(first, [x.tobytes() for x in self._ids([u[1:] for u in first])])

    def _found(self, unit: str) -> bytes | None:
        """Ids of a unit that is not among the recent ones, from the older ones or a word and its stop."""
        ids = self.older.get(unit)
        if ids is None and unit[-1:] in self.stop:
            word = unit[:-1]
            known = self.recent.get(word) or self.older.get(word)
            if known is not None and word.lstrip("\0").isalpha():
                return known + self.stop[unit[-1]]
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian integers of the encoder's width."""
        if len(self.recent) > CACHED_UNITS:
            self.older, self.recent = self.recent, {}
        self.recent["\n"] = self.line
        known, join = self.recent.get, b"".join
        out: list[bytes | None] = [None] * len(texts)
        waiting: list[tuple[int, list[bytes | None], list[tuple[int, str]]]] = []
        met: dict[str, bytes | None] = {}
        other: list[int] = []
        for i, t in enumerate(texts):
            if not (t and self.in_units and _plain(t)):
                other.append(i)
                continue
            units: list[str] = []
            for line in t.split("\n"):
                own = line.split(" ")
                own[0] = "\0" + own[0]
                units += own
                units.append("\n")
            units.pop()
            ids = list(map(known, units))
            try:
                out[i] = join(ids)
            except TypeError:  # a unit is not known
                holes = [(at, units[at]) for at, x in enumerate(ids) if x is None]
                waiting.append((i, ids, holes))
                for _, u in holes:
                    if u not in met:
                        met[u] = self._found(u)
        met.update(self._encode_units([u for u, x in met.items() if x is None]))
        for i, ids, holes in waiting:
            for at, u in holes:
                ids[at] = met[u]
            out[i] = join(ids)
        self.recent.update((u, x) for u, x in met.items() if len(u) <= CACHED_CHARS)
        for i, ids in zip(other, self._ids([texts[i] for i in other])):
            out[i] = ids.tobytes()
        return out


def _encoded(tokenizer: str, end_id: int, bounds: list[tuple]):
    """(part, doc_id, ties, ids): the part is the range of ids that a row is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(f"encoder-{tokenizer}", lambda: Encoder(tokenizer))
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                ids = [x + end for x in encoder.encode([t or "" for t in rows.column("text").to_pylist()])]
                part = range_of(bounds, *[rows.column(c).to_pylist() for c in ("doc_id", *TIES)], nulls_last=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *[rows.column(c) for c in ("doc_id", *TIES)], pa.array(ids, pa.binary())], ["part", "doc_id", *TIES, "ids"])

    return run


class _Part:
    """The files of one part while they are written: ids, ends of documents, and document ids as an Arrow stream."""

    KINDS = ("bin", "idx", "doc")

    def __init__(self, store: pafs.FileSystem, name: str, attempt: int, schema: pa.Schema):
        self.store, self.name, self.attempt, self.n_docs, self.n_bytes = store, name, attempt, 0, 0
        self.out = [store.open_output_stream(f"{name}.{attempt}.{k}") for k in self.KINDS]
        self.docs = pa.ipc.new_stream(self.out[2], schema)

    def add(self, docs: pa.Array, ids: list[bytes], width: int) -> None:
        ends = (self.n_bytes + np.cumsum([len(x) for x in ids])) // width
        self.out[0].write(b"".join(ids))
        self.out[1].write(ends.astype("<i8").tobytes())
        self.docs.write_batch(pa.RecordBatch.from_arrays([docs], ["doc_id"]))
        self.n_docs, self.n_bytes = self.n_docs + len(ids), int(ends[-1]) * width

    def close(self) -> None:
        self.docs.close()
        for out, kind in zip(self.out, self.KINDS):
            out.close()
            take_place(self.store, f"{self.name}.{self.attempt}.{kind}", f"{self.name}.{kind}")


def _writer(folder: str, width: int):
    """Rows come in order of part and document. A task that runs again writes the same bytes and takes the place of its files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        now, files = None, None

        def closed() -> pa.RecordBatch:
            files.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32()), "file": pa.array([files.name]), "n_docs": pa.array([files.n_docs], pa.int64()), "n_ids": pa.array([files.n_bytes // width], pa.int64())})

        for batch in batches:
            parts = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if parts[a] != now:
                    if files:
                        yield closed()
                    now, files = int(parts[a]), _Part(store, f"{root}/part-{int(parts[a]):06d}", attempt, pa.schema([batch.schema.field("doc_id")]))
                files.add(batch.column("doc_id").slice(a, b - a), batch.column("ids").slice(a, b - a).to_pylist(), width)
        if files:
            yield closed()

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns their parts: part, file, n_docs, n_ids, first_doc, first_id, width.

    Texts are encoded where they lie; only ids move, by ranges of the document id that
    stand for about as much text each, however much there is. Each range is a part:
    ``.bin`` holds unsigned ids without a break, ``.idx`` the documents' 64-bit ends in
    it, ``.doc`` their ids. The parts' bases are prefix sums over one row a part.
    """
    spark = docs.sparkSession
    ship(spark)
    width = np.dtype(Encoder(tokenizer).kind).itemsize
    rows = with_ties(docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text")), F.col("text"))
    bounds = range_bounds(rows, "text", "token-keys", nulls_last=True)
    ddl = f"part int, doc_id {rows.schema['doc_id'].dataType.simpleString()}, {TIES[0]} long, {TIES[1]} long, ids binary"
    encoded = rows.mapInArrow(_encoded(tokenizer, end_id, bounds), ddl)
    dealt = encoded.repartition(len(bounds) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_last(), *TIES)
    parts = save(dealt.mapInArrow(_writer(folder, width), "part int, file string, n_docs long, n_ids long"), "token-parts")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    base = lambda c: F.sum(c).over(before) - F.col(c)
    return parts.withColumn("first_doc", base("n_docs")).withColumn("first_id", base("n_ids")).withColumn("width", F.lit(width))


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name, kind = row["file"], np.dtype("<u2" if row["width"] == 2 else "<u4")
                if isinstance(store, pafs.LocalFileSystem):
                    ids = np.memmap(f"{name}.bin", kind, "r")
                    between = lambda a, b: ids[a:b]  # noqa: E731, B023
                else:
                    file = store.open_input_file(f"{name}.bin")
                    between = lambda a, b: np.frombuffer(file.read_at((b - a) * kind.itemsize, a * kind.itemsize), kind)  # noqa: E731, B023
                with store.open_input_stream(f"{name}.idx", compression=None) as f:
                    ends = np.frombuffer(f.read(), "<i8")
                starts, at = np.concatenate(([0], ends[:-1])), 0
                with store.open_input_stream(f"{name}.doc", compression=None) as f:
                    for docs in pa.ipc.open_stream(f):
                        b = at + docs.num_rows
                        crc = [zlib.crc32(between(x, y).astype("<u4").tobytes()) for x, y in zip(starts[at:b].tolist(), ends[at:b].tolist())]
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts[at:b] + row["first_id"], pa.int64()), pa.array(ends[at:b] - starts[at:b], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        at = b

    return run


def read_token_files(parts: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """One row a document of the files: doc_id, start, n_tokens, ids_crc32; local files are mapped into memory."""
    ship(parts.sparkSession)
    n = max(1, parts.count())
    return parts.select("file", "first_id", "width").repartition(n).mapInArrow(_reader(folder), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes ``docs``, writes the files in the shared folder and reads them back (see the two functions above).

    A null text is encoded as the empty one: its only id is ``end_id``. Null ids come
    last; equal ids are in order of their texts' hashes, and repeated rows follow one
    another. A text of any length is one row. An empty table gives no files and an empty
    result. Other columns of ``docs`` are not read.
    """
    folder = fresh_folder(docs.sparkSession, "tokens")
    parts = write_token_files(docs, folder, tokenizer, end_id, id_col=id_col, text_col=text_col)
    return read_token_files(parts, folder, docs.select(named(id_col)).schema[0].dataType.simpleString())
