"""WARC archives: segmented, chunked and revisit records written and put together again."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.llm.common import discard, fresh_folder, named, runs, save, ship, take_place

#: Bytes of a record's block beyond which it is cut into continuation records, and of one transfer chunk.
SEGMENT_BYTES, CHUNK_BYTES = 32_768, 8_192
#: Compressed bytes read at a time.
_READ = 1 << 20
_ID = "urn:locusframe:page:"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: 160 bits are four numbers of 40 bits, each eight digits of base 32."""
    hexed = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = [b"%X\r\n%b\r\n" % (len(c), c) for i in range(0, len(payload), size) if (c := payload[i : i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body: chunk extensions and trailers are passed over; a torn frame is an error."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunked body is torn")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower case) and decoded payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, dechunked(body) if "chunked" in fields.get("transfer-encoding", "").lower() else body


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One WARC record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in {**headers, "Content-Length": str(len(block))}.items())
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def segmented(headers: dict[str, str], block: bytes, size: int) -> Iterator[bytes]:
    """The record, or its first segment and the continuation records with the rest."""
    if len(block) <= size:
        yield record(headers, block)
        return
    origin = headers["WARC-Record-ID"]
    last = (len(block) - 1) // size
    yield record({**headers, "WARC-Segment-Number": "1"}, block[:size])
    for k in range(1, last + 1):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"{origin[:-1]}:segment:{k + 1}>", "WARC-Date": headers["WARC-Date"], "WARC-Segment-Origin-ID": origin, "WARC-Segment-Number": str(k + 1)}
        if k == last:
            more["WARC-Segment-Total-Length"] = str(len(block))
        yield record(more, block[k * size : (k + 1) * size])


def _named(page_id) -> str:
    return quote(json.dumps(page_id, default=str), safe="")


def _writer(folder: str, segment_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        # A task that runs again writes the same bytes under its own name and then takes the place of the file.
        name = f"{root}/part-{task.partitionId():06d}.warc.gz"
        own = f"{name}.{task.taskAttemptId()}"
        count = 0
        with store.open_output_stream(own) as out:
            for batch in batches:
                for page, url, html, first, copy in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id", "copy")]):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    digest = _base32_sha1(payload)
                    headers = {"WARC-Type": "response", "WARC-Record-ID": f"<{_ID}{_named(page)}:{copy}>", "WARC-Date": date, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
                    if url is not None:
                        headers["WARC-Target-URI"] = quote(url, safe=":/?#[]@!$&'()*+,;=%~")
                    if first is not None and (first != page or copy):
                        headers |= {"WARC-Type": "revisit", "WARC-Refers-To": f"<{_ID}{_named(first)}:0>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                    else:
                        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
                    for piece in segmented(headers, block, segment_bytes):
                        out.write(piece)
                    count += 1
        if count:
            take_place(store, own, name)
            yield pa.RecordBatch.from_pydict({"archive": pa.array([name]), "records": pa.array([count], pa.int64())})
        else:
            store.delete_file(own)

    return run


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes an archive a task under ``folder`` and returns (archive, records).

    Of records with equal payloads of ``least_bytes`` or more, the one with the
    smallest id is a response and the others revisit it. Digests are summed up
    before any text moves: only (id, digest) rows meet, with map-side combining, so
    a payload of any number of pages is no hot group; texts are dealt once, by a hash of
    id and payload. Rows equal in both are numbered in order of their urls over the same
    dealing, and the first of them is the one that the others revisit.
    """
    ship(pages.sparkSession)
    rows = pages.select(named(id_col).alias("page_id"), named(url_col).alias("url"), F.coalesce(named(html_col), F.lit("")).alias("html"))
    body = F.col("html").cast("binary")
    facts = save(rows.select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).alias("bytes")).filter(F.col("bytes") >= least_bytes), "warc-digests")
    first = facts.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("digest", "first_id")
    # Keys without nulls: a null-safe comparison would deal by other expressions than the window's, and the texts twice.
    keys = {"key": F.xxhash64("page_id", "digest"), "page": F.coalesce(F.col("page_id").cast("string"), F.lit("")), "no_page": F.col("page_id").isNull()}
    roles = facts.join(first, "digest").withColumns(keys).select(*keys, "digest", "first_id").distinct()
    marked = rows.withColumn("digest", F.sha1(body)).withColumns(keys)
    # The window asks for rows of a key together, so no partition of the join is split for its size.
    alike = W.partitionBy(*keys, "digest").orderBy("url")
    dealt = marked.join(roles.hint("merge"), [*keys, "digest"], "left").withColumn("copy", F.row_number().over(alike) - 1).select("page_id", "url", "html", "first_id", "copy")
    out = save(dealt.mapInArrow(_writer(folder, segment_bytes, date), "archive string, records long"), "warc-archives")
    discard(facts)
    return out


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of a stream of gzip members, with one record in memory at a time."""
    held, unpack, ended = bytearray(), zlib.decompressobj(31), False

    def fill() -> bool:
        nonlocal unpack, ended
        raw = unpack.unused_data if unpack.eof else b""
        if unpack.eof:
            unpack = zlib.decompressobj(31)
        raw = raw or stream.read(_READ)
        if not raw:
            ended = True
            return False
        held.extend(unpack.decompress(raw))
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill():
                if held.strip():
                    raise ValueError("archive ends within a record's header")
                return
        lines = held[:end].decode().split("\r\n")
        fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
        size = int(fields["content-length"])
        while len(held) < end + 8 + size:
            if not fill():
                raise ValueError("archive ends within a record's block")
        yield fields, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]


_RESULT = [("page", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers", pa.string())]
_SEGMENT = [("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("headers", pa.string()), ("data", pa.binary())]
_RESULT_DDL = "page string, payload_bytes long, payload_digest string, record_type string, refers string"


def _page_of(uri: str) -> str:
    return unquote(uri[1:-1].removeprefix(_ID).split(":")[0])


def _resolved(fields: dict[str, str], block: bytes) -> dict:
    """The facts of a whole response or revisit record; a payload that its digest does not fit is an error."""
    http, payload = http_payload(block)
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind, size = fields["warc-type"], len(payload)
    if kind == "revisit":
        size = int(http["content-length"])
    elif _base32_sha1(payload) != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} does not fit its digest")
    return {"page": _page_of(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers": _page_of(fields["warc-refers-to"]) if kind == "revisit" else None}


def _table(rows: list[dict], columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in columns], [k for k, _ in columns])


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for fields, block in records(stream):
                        number = fields.get("warc-segment-number")
                        if number is None:
                            rows.append(_resolved(fields, block))
                        else:
                            total = fields.get("warc-segment-total-length")
                            rows.append({"origin": fields.get("warc-segment-origin-id", fields["warc-record-id"]), "number": int(number), "total": int(total) if total else None, "headers": json.dumps(fields) if number == "1" else None, "data": block})
                            size += len(block)
                        if len(rows) >= 2000 or size >= 8 * _READ:
                            yield _table(rows, _RESULT + _SEGMENT)
                            rows, size = [], 0
                if rows:
                    yield _table(rows, _RESULT + _SEGMENT)

    return run


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (origin,), g, _ in runs(batches, ["origin"]):
        block = b"".join(g["data"])
        if g["number"] != list(range(1, len(g["number"]) + 1)):
            raise ValueError(f"segments of {origin} are not 1 to {len(g['number'])}")
        if g["total"][-1] != len(block):
            raise ValueError(f"segments of {origin} hold {len(block)} bytes; the last one tells {g['total'][-1]}")
        yield _table([_resolved(json.loads(g["headers"][0]), block)], _RESULT)


def read_archives(archives: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """One row a page of the archives named in ``archives``: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Whole records are decoded where they are read. Segments are grouped by their
    origin's id over all archives, ordered by number, held against the total
    length and decoded (only these are shuffled). A missing segment, a wrong total
    or a wrong digest is an error.
    """
    ship(archives.sparkSession)
    ddl = f"{_RESULT_DDL}, origin string, number long, total long, headers string, data binary"
    n = max(1, archives.count())
    read = save(archives.select("archive").repartition(n).mapInArrow(_reader(folder), ddl), "warc-records")
    parts = read.filter("origin IS NOT NULL").select("origin", "number", "total", "headers", "data")
    joined = parts.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(_reassembled, _RESULT_DDL)
    whole = read.filter("origin IS NULL").select("page", "payload_bytes", "payload_digest", "record_type", "refers")
    value = lambda c: F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), f"v {id_type}")["v"]
    return whole.unionByName(joined).select(value(F.col("page")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", value(F.col("refers")).alias("refers_to"))


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads them back (see read_archives).

    A null html is an empty payload; a null url gives a record without a target; a
    null id is a page of its own. Of repeated rows (equal id and payload) the first
    is the response and the others revisit it. A payload of any length is one row, cut
    into segments. An empty table gives an empty result. Other columns of ``pages`` are
    not read.
    """
    folder = fresh_folder(pages.sparkSession, "warc")
    archives = write_archives(pages, folder, id_col=id_col, url_col=url_col, html_col=html_col, least_bytes=least_bytes, segment_bytes=segment_bytes)
    out = read_archives(archives, folder, pages.select(named(id_col)).schema[0].dataType.simpleString())
    discard(archives)
    return out
