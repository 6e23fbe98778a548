"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of bounded size with the units and code points before each frame.
A cut at a unit is found by those counts: only the frame that holds it is decompressed. The transformed text is a list
of frames again: frames that no cut touches move to their new place as they are, only the ends of a cut frame are
compressed anew. Digests stream the frames of a text in order, one decompressed at a time.

Units are runs of ASCII letters and single other code points.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Bytes of UTF-8 in a frame.
FRAME_BYTES = 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
#: Bytes that begin a code point.
BEGINS = np.array([b & 0xC0 != 0x80 for b in range(256)])
#: Bytes sent on at once.
BATCH_BYTES = 1 << 24

STORED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("marked", pa.bool_()), ("units", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64())), ("frames", pa.list_(pa.binary()))])
STORED_DDL = "doc_id long, n long, marked boolean, units array<long>, chars array<long>, frames array<binary>"
MOVED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("frames", pa.list_(pa.binary()))])
MOVED_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>"
DIGESTS = pa.schema([*[f for f in MOVED if f.name != "frames"], ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
DIGESTS_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


@cache
def packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3)


@cache
def unpacker() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def unit_starts(data: np.ndarray, in_run: bool) -> np.ndarray:
    """True where a unit begins; ``in_run``: the byte before ``data`` is a letter."""
    letter = LETTER[data]
    follows = np.empty(len(data), bool)
    follows[:1], follows[1:] = in_run, letter[:-1]
    return BEGINS[data] & ~(letter & follows)


def store(text: str, frame_bytes: int = FRAME_BYTES) -> tuple[int, bool, list[int], list[int], list[bytes]]:
    """(units, holds a mark, units before each frame, code points before each frame, frames) of a text.

    Units before a frame are written as their bitwise complement where the frame begins inside a run of letters.
    """
    data = text.encode("utf-8", "surrogatepass")
    units, chars, frames, n, length, at, in_run = [], [], [], 0, 0, 0, False
    while at < len(data):
        end = min(at + max(4, frame_bytes), len(data))  # a code point has up to four bytes
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        piece = data[at:end]
        bytes_ = np.frombuffer(piece, np.uint8)
        units.append(~n if in_run and LETTER[piece[0]] else n)
        chars.append(length)
        frames.append(packer().compress(piece))
        n += int(np.count_nonzero(unit_starts(bytes_, in_run)))
        length += int(np.count_nonzero(BEGINS[bytes_]))
        in_run, at = bool(LETTER[piece[-1]]), end
    return n, any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)), units, chars, frames


def place(unit: int, n: int, units: list[int], chars: list[int], frames: list[bytes]) -> tuple[int, bytes, bytes, int]:
    """Where unit number ``unit`` begins: (frame, its bytes before the cut, its bytes after it, code points before the cut).

    The unit after the last begins at the end of the text, given as an empty frame past the last one.
    """
    if unit == n:
        end = unpacker().decompress(frames[-1])
        return len(frames), b"", b"", chars[-1] + int(np.count_nonzero(BEGINS[np.frombuffer(end, np.uint8)]))
    before = [u if u >= 0 else ~u for u in units]
    at = bisect_right(before, unit) - 1  # frames without a start of a unit have the same count as the next
    data = unpacker().decompress(frames[at])
    bytes_ = np.frombuffer(data, np.uint8)
    cut = int(np.flatnonzero(unit_starts(bytes_, units[at] < 0))[unit - before[at]])
    return at, data[:cut], data[cut:], chars[at] + int(np.count_nonzero(BEGINS[bytes_[:cut]]))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers from an id: the first 8-digit groups of a hexadecimal digest."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transform(doc_id: int | None, n: int, marked: bool, units: list[int], chars: list[int], frames: list[bytes], seed: int, plain_from: int, spm_below: int) -> tuple[str, int | None, int | None, list[bytes]]:
    """(form, code points of the prefix, of the middle, frames of the transformed text)."""
    h = draws(doc_id, seed)
    if not n or marked or h[2] % 100 >= plain_from:
        return "plain", None, None, frames
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    (a, a_before, a_after, a_chars), (b, b_before, b_after, b_chars) = (place(unit, n, units, chars, frames) for unit in (low, high))
    pack = lambda data: [packer().compress(data)] if data else []
    prefix = [*frames[:a], *pack(a_before)]
    suffix = [*pack(b_after), *frames[b + 1 :]]
    middle = pack(a_after[: len(a_after) - len(b_after)]) if a == b else [*pack(a_after), *frames[a + 1 : b], *pack(b_before)]
    marks = [packer().compress(mark) for mark in (PREFIX, SUFFIX, MIDDLE)]
    if h[3] % 100 < spm_below:
        return "spm", a_chars, b_chars - a_chars, [marks[1], *suffix, marks[0], *prefix, marks[2], *middle]
    return "psm", a_chars, b_chars - a_chars, [marks[0], *prefix, marks[1], *suffix, marks[2], *middle]


def stream(frames: list[bytes]) -> Iterator[bytes]:
    for frame in frames:
        yield unpacker().decompress(frame)


def cut_out(frames: list[bytes], ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes of each range [start, end) in turn, frame by frame."""
    for start, end in ranges:
        at = 0
        for data in stream(frames):
            if at >= end:
                break
            if at + len(data) > start:
                yield data[max(0, start - at) : end - at]
            at += len(data)


def digests(form: str, frames: list[bytes]) -> tuple[str, str]:
    """Digests of the transformed text and of the text rebuilt from it and its form alone."""
    whole, held, at, marks = hashlib.sha256(), b"", 0, {}
    second = PREFIX if form == "spm" else SUFFIX
    for data in stream(frames):
        whole.update(data)
        if form != "plain":
            # A mark may lie across frames; no text between marks holds one.
            near = held + data
            for mark in (second, MIDDLE):
                if mark not in marks and (found := near.find(mark)) >= 0:
                    marks[mark] = at - len(held) + found
            held = near[-2:]
        at += len(data)
    if form == "plain":
        return whole.hexdigest(), whole.hexdigest()
    first, last = (3, marks[second]), (marks[second] + 3, marks[MIDDLE])
    prefix, suffix = (last, first) if form == "spm" else (first, last)
    rebuilt = hashlib.sha256()
    for data in cut_out(frames, [prefix, (marks[MIDDLE] + 3, at), suffix]):
        rebuilt.update(data)
    return whole.hexdigest(), rebuilt.hexdigest()


def _batches(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (bytes, values) as batches of bounded size."""
    held, size = [], 0
    for n_bytes, row in rows:
        held.append(row)
        size += n_bytes
        if len(held) >= 2000 or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for row in zip(*(batch.column(c) for c in names), strict=True):
            yield tuple(x.as_py() for x in row)


def store_texts(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(doc_id, n, marked, units, chars, frames) of every whole text; null text: empty, without frames.

    A row holds a text compressed; frames have at most ``frame_bytes`` of it. Repeated rows and ids are rows like
    others, other columns are ignored, an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = ((doc_id, store(text or "", frame_bytes)) for doc_id, text in _rows(batches, ["doc_id", "text"]))
        yield from _batches(((sum(map(len, x[4])), (doc_id, *x)) for doc_id, x in stored), STORED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, STORED_DDL)


def fill_in_middle(stored: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, frames): each stored text with its middle last, as frames.

    Where the cuts lie, and the form, follow from a digest of seed and id: two cuts, each after 0 to n units; ``plain``
    (unchanged) for an empty text, one that holds a mark, and ``plain_percent`` of the others; of the rest
    ``spm_percent`` have the suffix first, the others the prefix. Equal cuts give an empty middle. Rows of one id have
    the same draws; a null id draws like an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def moved() -> Iterator[tuple[int, tuple]]:
            for row in _rows(batches, STORED.names):
                out = transform(*row, seed, 100 - plain_percent, spm_percent)
                yield sum(map(len, out[3])), (row[0], row[1], *out)

        yield from _batches(moved(), MOVED)

    return stored.mapInArrow(run, MOVED_DDL)


def texts_of(moved: DataFrame) -> DataFrame:
    """(doc_id, form, output): the transformed texts in plain form."""
    schema = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((doc_id, form, b"".join(stream(frames)).decode("utf-8", "surrogatepass")) for doc_id, form, frames in _rows(batches, ["doc_id", "form", "frames"]))
        yield from _batches(((len(x[2]), x) for x in texts), schema)

    return moved.mapInArrow(run, "doc_id long, form string, output string")


def digests_of(moved: DataFrame) -> DataFrame:
    """``fill_in_middle``'s rows with digests of the output and of the text rebuilt from it in place of the frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((200, (*row[:5], *digests(row[2], row[5]))) for row in _rows(batches, MOVED.names)), DIGESTS)

    return moved.mapInArrow(run, DIGESTS_DDL)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` with its middle last; one pass over the texts, without a shuffle."""
    return digests_of(fill_in_middle(store_texts(table(spark, sf_dir, "documents"))))


ORACLE = """
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
n as (select *, len(u)::bigint as n, ('0x' || h[1:8])::ubigint as h1, ('0x' || h[9:16])::ubigint as h2, ('0x' || h[17:24])::ubigint as h3, ('0x' || h[25:32])::ubigint as h4 from d),
f as (select *, least(h1 % (n + 1), h2 % (n + 1))::bigint as a, greatest(h1 % (n + 1), h2 % (n + 1))::bigint as b,
 case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from n),
p as (select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:n], '') as suf from f)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from p
"""
