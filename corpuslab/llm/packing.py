"""Best-fit packing of documents into sequences of fixed length under conflict constraints.

Bins are kept in order of their residual space and carry two bitmaps: the sources and the duplicate clusters they
hold. A piece goes into the tightest bin that has room and shares neither its source nor its cluster; the search
starts at the smallest sufficient residual and goes on to the next larger one until a compatible bin is found, and
opens a new bin if there is none. Long documents are cut into full-length pieces and a rest. Each bin leaves as one
sequence of token ids with the boundaries of its pieces.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_tokenizer, load
from .common import materialise, released, table, text_or_empty
from .near_dedup import near_duplicates


def pack(pieces: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, start) of each piece (length, source, cluster), in the order given; null sources and clusters never conflict."""
    bits_of_source: dict = {}
    # Only clusters met more than once can conflict; the others need no bit.
    repeated = (c for c, n in Counter(c for _, _, c in pieces).items() if n > 1 and c is not None)
    bits_of_cluster = {c: 1 << i for i, c in enumerate(repeated)}
    residuals: list[tuple[int, int]] = []
    sources, clusters, out = [], [], []
    for length, source, cluster in pieces:
        s = 0 if source is None else bits_of_source.setdefault(source, 1 << len(bits_of_source))
        c = bits_of_cluster.get(cluster, 0)
        at = bisect_left(residuals, (length, -1))
        while at < len(residuals) and (sources[residuals[at][1]] & s or clusters[residuals[at][1]] & c):
            at += 1
        if at < len(residuals):
            room, number = residuals.pop(at)
            sources[number] |= s
            clusters[number] |= c
        else:
            room, number = capacity, len(sources)
            sources.append(s)
            clusters.append(c)
        out.append((number, capacity - room))
        if room > length:
            insort(residuals, (room - length, number))
    return out


PIECE = "row long, doc_id long, piece int, length int, source string, cluster string, ids array<int>"
SEQUENCE = "bin_id long, length int, input_ids array<int>, starts array<int>, doc_ids array<long>, offsets array<long>, sources array<string>"


def pieces_of(rows: DataFrame, path: str, capacity: int) -> DataFrame:
    """Rows (row, doc_id, source, cluster, text) -> pieces: up to ``capacity`` ids of a whole text and its end marker."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("length", pa.int32()), ("source", pa.string()), ("cluster", pa.string()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        end = np.array([bpe.added["<|endoftext|>"]], np.uint32)
        for batch in batches:
            taken, number, cuts = [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.concatenate((bpe.encode(text.as_py() or ""), end)).astype(np.int32)
                for at in range(0, len(ids), capacity):
                    taken.append(i)
                    number.append(at // capacity)
                    cuts.append(ids[at : at + capacity])
            of = batch.take(pa.array(taken, pa.int64()))
            columns = {"piece": number, "length": [len(x) for x in cuts], "ids": cuts}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else of.column(f.name) for f in schema], schema=schema)
        bpe.forget()  # workers live on for other stages

    return rows.select("row", "doc_id", "source", "cluster", "text").mapInArrow(released(run), PIECE)


def pack_documents(docs: DataFrame, clusters: DataFrame | None = None, capacity: int = 2048, shard_pieces: int = 4096, tokenizer: str | None = None) -> DataFrame:
    """Training sequences of up to ``capacity`` token ids, a row each: every token of every text is in one of them.

    Per sequence: bin_id, length, input_ids, and for each piece in it where it starts (``starts``), its document
    (``doc_ids``), the place of its first token in that document (``offsets``) and its source. Boundaries and
    positions follow: token i of the piece that starts at s has position offset + i - s, and attends from s on.

    ``docs``: doc_id, text, source. ``clusters``: (doc_id, cluster) of near copies; a document without one has its
    text's hash, so that copies of one text lie in different bins. Every text ends with an end marker. Pieces are
    dealt by a hash of their row to shards of about ``shard_pieces``, whose number grows with the input, and packed
    within a shard from long to short: a source, cluster or id that holds a third of all rows holds a third of each
    shard. Null texts are an end marker alone; a null source conflicts with none; null ids and repeated rows are
    packed like others. Other columns are ignored; an empty table gives no row.
    """
    own = F.concat(F.lit("text "), F.xxhash64(text_or_empty()).cast("string"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_or_empty().alias("text"))
    if clusters is None:
        rows = rows.withColumn("cluster", own)
    else:
        per_id = clusters.where("doc_id is not null").groupBy("doc_id").agg(F.min("cluster").cast("string").alias("cluster"))
        per_id = materialise(per_id, "packing-clusters")
        rows = rows.join(per_id, "doc_id", "left").withColumn("cluster", F.coalesce("cluster", own))
    # About how many pieces there will be: a token has some three characters.
    sizes = docs.agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars")).first()
    shards = max(1, -(-(sizes["n"] + (sizes["chars"] or 0) // (3 * capacity)) // shard_pieces))
    pieces = pieces_of(rows, tokenizer or default_tokenizer(), capacity)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int")).repartitionById(shards, "shard")
    ordered = dealt.sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece", "row")
    schema = pa.schema([("bin_id", pa.int64()), ("length", pa.int32()), ("input_ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("sources", pa.list_(pa.string()))])
    names = ("shard", "length", "source", "cluster", "doc_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*row, ids.values.to_numpy()) for batch in batches for *row, ids in zip(*(batch.column(c).to_pylist() for c in names), batch.column("ids"), strict=True))
        for shard, group in groupby(rows, key=lambda row: row[0]):
            held = list(group)
            bins: dict[int, list] = {}
            for (number, start), (_, _, source, _, doc_id, piece, ids) in zip(pack([row[1:4] for row in held], capacity), held, strict=True):
                bins.setdefault(number, []).append((start, doc_id, piece * capacity, source, ids))
            for number, inside in bins.items():
                starts, doc_ids, offsets, sources, ids = zip(*inside, strict=True)
                whole = np.concatenate(ids)
                values = ((shard << 32) + number, len(whole), whole, starts, doc_ids, offsets, sources)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema, strict=True)], schema=schema)

    return ordered.select(*names, "ids").mapInArrow(released(run), SEQUENCE)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` packed into sequences of 2,048 tokens, near copies in different ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    copies = near_duplicates(docs.select("doc_id", "text"))
    return pack_documents(docs, copies.select("doc_id", F.col("component_id").alias("cluster")))
