"""WARC archives: writing, normalising a monolithic gzip stream to a member per record, and indexed reading.

``write_monolithic`` lays records down as plain whole-file gzip streams, which can only be read from the start.
``normalise`` inflates such a stream once, cuts it into records by their declared lengths, rewrites every record
as a gzip member of its own and writes a sidecar index (JSON lines: offset, length, record id, type) beside it.
``read_indexed`` fetches records through that index. Files live in a folder that all executors share; a task
writes under a name of its own attempt and renames at its end, so a repeated task leaves whole files only.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20
#: Fixed date of written records, so that a repeated task writes the same bytes.
WRITTEN_AT = "2024-01-01T00:00:00Z"
_HEADER_END = b"\r\n\r\n"
INDEX_SCHEMA = "archive string, offset long, length long, record_id string, record_type string"


def _store(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


class _Output:
    """A file under an attempt's own name that ``done`` renames to its final one."""

    def __init__(self, folder: str, name: str, attempt: str):
        self.fs, root = _store(folder)
        self.final, self.temporary, self.size = f"{root}/{name}", f"{root}/.{name}.{attempt}", 0
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def done(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.final)


def _attempt() -> tuple[int, str]:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId(), str(context.taskAttemptId())


def record_bytes(page_id, url, html, record_type: str, refers_to, digest: str) -> bytes:
    """One WARC record: the HTTP response, or for a revisit the HTTP header alone, as the standard has it."""
    payload = (html or "").encode()
    clean = re.sub(r"[\r\n\s]+", "%20", url) if url else f"urn:x-page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {WRITTEN_AT}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + _HEADER_END + block + _HEADER_END


def mark_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Adds payload_digest, record_type and refers_to by the rule of ``op3_warc``.

    The groups of equal payloads are aggregated before anything is shuffled, and only those with more than one
    page reach the join; Spark broadcasts them if they are under its own size limit and otherwise sorts and
    splits skewed keys, so a payload that a third of all pages share does not land in one task.
    """
    from .common import materialise

    payload = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", "html", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    groups = pages.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1 and holder is not null").drop("n")
    joined = pages.join(materialise(groups, "warc-groups"), ["payload_digest", "payload_bytes"], "left")
    revisits = F.col("page_id") < F.col("holder")
    return joined.select("page_id", "url", "html", "payload_digest", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("holder")).alias("refers_to"))


def write_monolithic(records: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Write marked pages as one whole-file gzip stream per partition; returns (archive, records)."""
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, attempt = _attempt()
        out, count, packer = None, 0, zlib.compressobj(level, wbits=31)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "record_type", "refers_to", "payload_digest")), strict=True):
                out = out or _Output(folder, f"part-{partition:05d}.warc.gz", attempt)
                out.write(packer.compress(record_bytes(*row)))
                count += 1
        if out:
            out.write(packer.flush())
            out.done()
            yield _batch([(f"part-{partition:05d}.warc.gz", count)], schema)

    return records.select("page_id", "url", "html", "record_type", "refers_to", "payload_digest").mapInArrow(run, "archive string, records long")


def inflate(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """Pieces of a gzip file of one or many members, each of bounded size."""
    inflater = zlib.decompressobj(wbits=31)
    while data := stream.read(chunk):
        while data:
            if inflater.eof:
                inflater = zlib.decompressobj(wbits=31)
            if piece := inflater.decompress(data, 4 * chunk):
                yield piece
            data = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
    while not inflater.eof and (piece := inflater.decompress(inflater.unconsumed_tail, 4 * chunk)):
        yield piece


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def record_pieces(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(header fields, pieces of the whole record) for each record; take a record's pieces before the next."""
    buffer = bytearray()

    def fill() -> bool:
        piece = next(pieces, None)
        buffer.extend(piece or b"")
        return piece is not None

    while True:
        while (at := buffer.find(_HEADER_END)) < 0:
            if not fill():
                if buffer.strip():
                    raise ValueError("the archive ends inside a record's header")
                return
        fields = parse_header(bytes(buffer[:at]))
        left = [at + 4 + int(fields["content-length"]) + 4]

        def body(left=left) -> Iterator[bytes]:
            while left[0]:
                if not buffer and not fill():
                    raise ValueError("the archive ends inside a record")
                piece = bytes(buffer[: left[0]])
                del buffer[: left[0]]
                left[0] -= len(piece)
                yield piece

        whole = body()
        yield fields, whole
        for _ in whole:
            pass


def normalise(archives: DataFrame, source: str, target: str, level: int = 4) -> DataFrame:
    """Rewrite each archive of ``source`` with a member per record, and a sidecar index; returns the index rows.

    Streams: neither a file nor a record has to fit in memory. One task takes an archive at a time.
    """
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, attempt = _attempt()
        fs, root = _store(source)
        for name in (x for batch in batches for x in batch.column("archive").to_pylist()):
            out, sidecar, rows = _Output(target, name, attempt), _Output(target, f"{name}.idx", attempt), []
            with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for fields, pieces in record_pieces(inflate(stream)):
                    offset, packer = out.size, zlib.compressobj(level, wbits=31)
                    for piece in pieces:
                        out.write(packer.compress(piece))
                    out.write(packer.flush())
                    rows.append((name, offset, out.size - offset, fields.get("warc-record-id", ""), fields.get("warc-type", "")))
                    sidecar.write((json.dumps(dict(zip(("offset", "length", "id", "type"), rows[-1][1:], strict=True))) + "\n").encode())
                    if len(rows) == 10_000:
                        yield _batch(rows, schema)
                        rows = []
            out.done()
            sidecar.done()
            yield _batch(rows, schema)

    return archives.mapInArrow(run, INDEX_SCHEMA)


def read_indexed(index: DataFrame, folder: str) -> DataFrame:
    """Fetch each indexed record by its offset and describe it: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is computed from its payload and must equal the one in its header; a revisit has
    no payload, so both figures come from its headers.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())])

    def page(value: str | None):
        number = re.search(r"urn:x-page:(-?\d+)", value or "")
        return int(number[1]) if number else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        opened, name = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != name:
                    opened, name = fs.open_input_file(f"{root}/{archive}"), archive
                data = zlib.decompress(opened.read_at(length, offset), wbits=31)
                head, _, rest = data.partition(_HEADER_END)
                fields = parse_header(head)
                http, _, payload = rest[: int(fields["content-length"])].partition(_HEADER_END)
                digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(parse_header(http)["content-length"])
                if fields["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"the record at {archive}:{offset} does not match its digest")
                rows.append((page(fields["warc-record-id"]), size, digest, fields["warc-type"], page(fields.get("warc-refers-to")), archive, offset))
            yield _batch(rows, schema)

    return index.select("archive", "offset", "length").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long")


def round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, normalise them and read them back, a row per page.

    Null html: an empty payload. Null url: a URN of the page id. Null page_id: always a response, referred to by
    none. Rows that share the largest page_id of a group are all responses. An empty table gives no row and no
    archive. Other columns are ignored. Records of any length stream through bounded buffers when normalised.
    """
    from .common import materialise, shared_dir

    spark = pages.sparkSession
    whole, members = shared_dir(spark, "warc-whole"), shared_dir(spark, "warc")
    for folder in (whole, members):
        fs, root = _store(folder)
        fs.create_dir(root, recursive=True)
    archives = materialise(write_monolithic(mark_revisits(pages, least_bytes), whole), "warc-archives")
    index = materialise(normalise(archives.repartition(max(1, archives.count())), whole, members), "warc-index")
    return read_indexed(index, members)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """All of ``pages`` through archives on shared storage and back."""
    from .common import table

    return round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("archive", "offset")


#: The same rows from the table itself.
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
h AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS holder FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < holder THEN holder END AS refers_to
FROM h
"""
