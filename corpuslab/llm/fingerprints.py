"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes proposes boundaries; the chunk length is normalised by a harder condition
before the usual length and an easier one after it. Boundaries depend on nearby content only, so an insertion
shifts no chunk but its own. A fingerprint is the set of chunk digests with chunk lengths; likeness of one text
to another is the share of its fingerprint's length whose digests the other fingerprint holds too.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, USUAL, MOST = 16, 48, 160
#: Bits of the gear hash that must be zero at a boundary, before and after the usual length.
HARD, EASY = np.uint32(0b1111_111 << 25), np.uint32(0b1111 << 28)
GEAR = np.random.default_rng(20240101).integers(0, 1 << 32, 256, dtype=np.uint32)


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``, the last one included."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    gear = GEAR[np.frombuffer(data, np.uint8)]
    for shift in (1, 2, 4, 8, 16):  # after these, each place has the hash of its last 32 bytes
        gear[shift:] = gear[shift:] + (gear[:-shift] << np.uint32(shift))
    easy = np.flatnonzero(gear & EASY == 0)
    hard = (easy[gear[easy] & HARD == 0] + 1).tolist()
    easy = (easy + 1).tolist()
    ends, start, i, j = [], 0, 0, 0
    while n - start > LEAST:
        i = bisect_left(hard, start + LEAST, i)
        end = hard[i] if i < len(hard) else n
        if end > start + USUAL:
            j = bisect_left(easy, start + USUAL, j)
            end = min(easy[j] if j < len(easy) else n, start + MOST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def fingerprint(text: str) -> dict[str, int]:
    """Chunk digest -> chunk length in bytes; a repeated chunk counts once."""
    data, start, out = text.encode(), 0, {}
    for end in boundaries(data):
        out[hashlib.blake2b(data[start:end], digest_size=8).hexdigest()] = end - start
        start = end
    return out


def written(print_: dict[str, int]) -> str:
    return " ".join(f"{digest}:{length}" for digest, length in sorted(print_.items()))


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """Share of a's length in chunks that b has as well; two empty ones are alike, an empty one is like no other."""
    total = sum(a.values())
    return sum(a[x] for x in a.keys() & b.keys()) / total if total else float(not b)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text; null text: empty, whose fingerprint is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([written(fingerprint(x)) for x in texts], pa.string())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame, rows_per_part: int = 4000) -> DataFrame:
    """Rows (part, lent, doc_id, text) dealt so that within a part each document is followed by its next one.

    Order: descending doc_id, null ids last, ties by a hash of the text; the first follows the last. Ids and hashes
    alone are dealt by ranges first, about ``rows_per_part`` rows to a part; where a part begins is all that reaches
    the driver and, broadcast, the tasks: two numbers for ``rows_per_part`` documents. Texts are shuffled once, each
    to its part's own partition, and the first document of each part also to the part before. Part by part, the
    work does not grow with the input, nor with the rows of one id.
    """
    spark = docs.sparkSession
    key = [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("place"), F.xxhash64("text").alias("h")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", *key, "text")
    order = ["no_id", "place", "h"]
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-docs.count() // rows_per_part))
    ids = rows.select(*order).repartitionByRange(parts, *order)
    found = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*order)).alias("k")).select("k.*").collect()
    firsts = sorted(map(tuple, found))
    shared = spark.sparkContext.broadcast(firsts)

    @F.pandas_udf("long")
    def part_of(no_id: pd.Series, place: pd.Series, h: pd.Series) -> pd.Series:
        """Twice the number of a row's part, and one more for its first row."""
        firsts = shared.value
        keys = list(zip(no_id.tolist(), place.tolist(), h.tolist(), strict=True))
        at = [bisect_right(firsts, key) - 1 for key in keys]
        return pd.Series([2 * i + (firsts[i] == key) for i, key in zip(at, keys, strict=True)], dtype="int64")

    placed = rows.withColumn("code", part_of(*order)).withColumn("part", F.shiftright("code", 1))
    own = F.struct("part", F.lit(0).alias("lent"))
    lent = F.struct(F.pmod(F.col("part") - 1, F.lit(max(1, len(firsts)))).alias("part"), F.lit(1).alias("lent"))
    places = F.when(F.col("code") % 2 == 1, F.array(own, lent)).otherwise(F.array(own))
    dealt = placed.select(F.explode(places).alias("place"), "doc_id", *[F.col(c).alias(f"by_{c}") for c in order], "text").select(F.col("place.part").cast("int").alias("part"), "place.lent", "doc_id", *[f"by_{c}" for c in order], "text")
    return dealt.repartitionById(max(1, len(firsts)), "part").sortWithinPartitions("part", "lent", *[f"by_{c}" for c in order]).select("part", "lent", "doc_id", "text")


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness: the columns of ``op6_fingerprints``.

    The edited text has the last third (floor) of the code points replaced by as many from the start of the next
    document, or all it has. Null text: empty. Rows without an id come last, in order of a hash of their texts.
    A single document is its own next. Other columns are ignored; an empty table gives no row. A part of the
    order streams through its task; two documents at a time are held.
    """
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = None, [], 0
        for batch in batches:
            for part, lent, doc_id, text in zip(*(batch.column(c) for c in ("part", "lent", "doc_id", "text")), strict=True):
                part, lent, doc_id = part.as_py(), lent.as_py(), doc_id.as_py()
                if lent and (held is None or held[0] != part):
                    continue  # another copy of the lent document
                text = text.as_py() or ""
                own = fingerprint(text)
                if held is not None and held[0] == part:
                    _, before_id, before, before_print = held
                    n, cut = len(before), len(before) // 3
                    edited = before[: n - cut] + text[:cut]
                    other = fingerprint(edited)
                    rows.append((before_id, n, hashlib.sha256(edited.encode()).hexdigest(), written(before_print), written(other), containment(before_print, other), containment(before_print, own)))
                    size += n
                held = None if lent else (part, doc_id, text, own)
                if len(rows) >= 1000 or size >= 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and of its edited form."""
    from .common import table

    return edit_likeness(table(spark, sf_dir, "documents"))
