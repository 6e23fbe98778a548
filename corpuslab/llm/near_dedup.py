"""Near-duplicates by a multi-index Hamming join of b-bit minimum-hash signatures, confirmed on full shingle sets.

A document's signature has ``chunks * width`` symbols of 16 bits. Cut into chunks, two signatures that differ in
at most ``(errors + 1) * chunks - 1`` symbols agree in some chunk up to ``errors`` symbols (pigeonhole), so every
chunk is looked up under each choice of symbols that may be wrong. With the defaults (10 chunks of 6, one error),
all pairs up to 19 differing symbols of 60 are found, and a pair of similarity 0.8 is missed with a probability of
P(Bin(6, 0.2) > 1)^10 = 2.4e-5.

Documents with equal sets form a class and take part as one. Within a bucket of the index not all pairs are
tested: a class is first tested against one bucket mate that it shares most keys with. What is then connected need
not be tested again; classes that share a key and are still apart are tested in blocks on inverted lists, a
class against all of the groups that it shares a key with, and only links that join two components leave a task.

Buckets are judged by minima and maxima per key, which Spark adds up before it shuffles, and these figures are
written before rows are joined to them, so that the join of a hot key is one that Spark splits. Joins whose sides
both grow with the input are merge joins at every size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, released, table
from .components import connected_components

_U64 = np.uint64
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=_U64) * _U64(2) + _U64(1)
_STEP = _U64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_POWERS = np.ones(1, _U64)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text: runs of bytes other than space and 0x09-0x0D, A-Z lower-cased."""
    global _POWERS
    data = np.frombuffer(text.encode().lower(), np.uint8)
    inner = (data != 32) & ((data < 9) | (data > 13))
    at = np.flatnonzero(inner)
    if not len(at):
        return np.zeros(0, _U64)
    starts = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    lengths = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    if (longest := int(lengths.max())) >= len(_POWERS):
        _POWERS = np.concatenate(([_U64(1)], np.multiply.accumulate(np.full(2 * longest, _STEP, _U64))))
    return _mix(np.add.reduceat(_BYTES[data[at]] * _POWERS[place], starts) + lengths.astype(_U64))


def shingles(text: str | None, size: int = 2) -> np.ndarray:
    """The sorted set of hashes of ``size``-word shingles; with fewer words the whole sequence is one, without any none."""
    words = word_hashes(text or "")
    size = min(size, len(words))
    if not size:
        return words
    last = len(words) - size + 1
    out = words[:last]
    for i in range(1, size):  # words are mixed already, so a polynomial in an odd number will do
        out = out * _STEP + words[i : last + i]
    return np.unique(_mix(out))


def signature(found: np.ndarray, symbols: int, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    factors, seeds = rng.integers(0, 1 << 32, symbols, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, symbols, dtype=np.uint32)
    low = (found >> _U64(32)).astype(np.uint32)
    least = np.array([((low ^ s) * f).min() for f, s in zip(factors, seeds, strict=True)], np.uint32) if len(found) > 4096 else ((low ^ seeds[:, None]) * factors[:, None]).min(axis=1)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _signed(docs: DataFrame, size: int, symbols: int) -> DataFrame:
    """(row, doc_id, n, d1, d2, sig): set size, two digests of the set, and the signature, of every row."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, sig = [], [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), size)
                n.append(len(found))
                d1.append(int(_mix(found).sum(dtype=_U64).astype(np.int64)) if len(found) else 0)
                d2.append(int(_mix(found + _STEP).sum(dtype=_U64).astype(np.int64)) if len(found) else 0)
                sig.append(signature(found, symbols).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, d1, d2)), pa.array(sig, pa.binary())], schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(released(run), "row long, doc_id long, n long, d1 long, d2 long, sig binary")


def bitmap_of(ids: DataFrame, most_bits: int = 27) -> tuple[int, np.ndarray]:
    """(log2 of the size in bits, words) of a bitmap of a column of hashes: 16 bits per row, 2**most_bits at most.

    It only lets rows through that a join then tests exactly. Beyond 2**most_bits bits (16 MB), which is the bound of
    what is broadcast, more rows get through; none is lost.
    """
    (name,) = ids.columns
    log_bits = min(most_bits, max(10, (16 * ids.count()).bit_length()))
    places = ids.select(F.pmod(F.col(name), F.lit(1 << log_bits)).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits")).toPandas()
    bitmap = np.zeros(1 << (log_bits - 6), np.int64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return log_bits, bitmap.view(_U64)


def _held(bitmap: tuple[int, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` (int64) may be in the bitmap."""
    place = hashes & ((1 << bitmap[0]) - 1)
    return np.flatnonzero((bitmap[1][place >> 6] >> (place & 63).astype(_U64)) & _U64(1))


def index_keys(signatures: DataFrame, chunks: int, width: int, errors: int, only: Broadcast | None = None) -> DataFrame:
    """(key, node): for every chunk and every choice of ``errors`` symbols that may be wrong, a hash of the others.

    ``only``: a bitmap of the keys that may be wanted.
    """
    choices = [[x for x in range(width) if x not in wrong] for wrong in itertools.combinations(range(width), errors)]
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                symbols = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(part.num_rows, chunks, width).astype(_U64)
                keys = []
                for number, kept in enumerate(choices):
                    h = np.broadcast_to(_mix(np.arange(chunks, dtype=_U64) * _U64(len(choices)) + _U64(number)), symbols.shape[:2])
                    for j in kept:
                        h = _mix(h * _STEP + symbols[:, :, j])
                    keys.append(h)
                keys = np.stack(keys, axis=2).reshape(part.num_rows, -1)
                nodes, keys = np.repeat(part.column("node").to_numpy(), keys.shape[1]), keys.ravel().astype(np.int64)
                if only is not None:
                    held = _held(only.value, keys)
                    nodes, keys = nodes[held], keys[held]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes)], schema=schema)

    return signatures.select("node", "sig").mapInArrow(released(run), "key long, node long")


def _linked(targets: list[tuple[int, int, np.ndarray]]):
    """A function (set) -> positions of the targets (node, component, set) similar to it, by inverted lists."""
    sets = [x for _, _, x in targets]
    sizes = np.array([len(x) for x in sets])
    keys, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(keys, kind="stable")
    keys, owners = keys[order], owners[order]

    def similar(found: np.ndarray, percent: int) -> np.ndarray:
        low, high = keys.searchsorted(found), keys.searchsorted(found, "right")
        hits = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(hits)[:-1])), hits) + np.arange(hits.sum())
        both = np.bincount(owners[at], minlength=len(sets))
        return np.flatnonzero(100 * both >= percent * (sizes + len(found) - both))

    return similar


def confirm(queries: DataFrame, members: DataFrame, sets: DataFrame, percent: int, block: int = 256, together: int = 256) -> DataFrame:
    """Components (u, v) that a link between a query (grp, node) and a member (grp, node) of its group joins.

    Links are confirmed on full sets, ``sets``: (node, component, shingles). Members are dealt to blocks and queries
    to batches of bounded size; one task's unit is a batch against a block.
    """
    part = lambda n, per: F.ceil(F.col(n) / per).cast("int")
    counts = members.groupBy("grp").agg(F.count("*").alias("n_members")).join(queries.groupBy("grp").agg(F.count("*").alias("n_queries")), "grp")
    counts = materialise(counts.select("grp", part("n_members", block).alias("blocks"), part("n_queries", together).alias("batches")), "dedup-counts")
    of = lambda n: F.pmod(F.xxhash64("node", F.lit(17)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(counts.hint("merge"), "grp").select("grp", of("blocks").alias("block"), every("batches").alias("batch"), F.lit(0).alias("asks"), "node")
    right = queries.join(counts.hint("merge"), "grp").select("grp", every("blocks").alias("block"), of("batches").alias("batch"), F.lit(1).alias("asks"), "node")
    dealt = left.unionByName(right).join(sets.hint("merge"), "node").repartition("grp", "block", "batch").sortWithinPartitions("grp", "block", "batch", "asks")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, targets, similar = None, [], None
        for batch in batches:
            links = []
            columns = [batch.column(c).to_pylist() for c in ("grp", "block", "batch", "asks", "node", "component")]
            for i, (*own, asks, node, component) in enumerate(zip(*columns, strict=True)):
                found = batch.column("shingles")[i].values.to_numpy(zero_copy_only=False).view(_U64)
                if own != unit:
                    unit, targets, similar = own, [], None
                if not asks:
                    targets.append((node, component, found.copy()))
                    continue
                similar = similar or (_linked(targets) if targets else lambda *_: ())
                links += [(component, other) for other in {targets[j][1] for j in similar(found, percent)} if other != component]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=schema)

    return dealt.select("grp", "block", "batch", "asks", "node", "component", "shingles").mapInArrow(released(run), "u long, v long")


def star_links(queries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, grp) of the queries (node, grp) whose set is similar to that of the class ``grp``, the centre it meets."""
    own = queries.join(sets.hint("merge"), "node")
    centres = sets.select(F.col("node").alias("grp"), F.col("shingles").alias("of_centre"))
    both = F.size(F.array_intersect("shingles", "of_centre"))
    similar = 100 * both >= percent * (F.size("shingles") + F.size("of_centre") - both)
    return own.join(centres.hint("merge"), "grp").where(similar).select("node", "grp")


def _node_hash(column: str):
    return F.xxhash64(column, F.lit(23))


def _sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, shingles array<long>) of the classes in ``nodes`` (node, d1), from the rows that stand for them.

    Texts stay where they are read: a bitmap of the wanted ids' hashes tells which rows may be wanted; sets of
    those alone are shuffled to the join that drops what the bitmap let through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(nodes.select(_node_hash("node").alias("h"))))
    schema = pa.schema([("node", pa.int64()), ("d1", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(_held(shared.value, batch.column("h").to_numpy())))
            sets = [shingles(text.as_py(), size) for text in batch.column("text")]
            digests = [int(_mix(x).sum(dtype=_U64).astype(np.int64)) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(digests, pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], schema=schema)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").alias("node"), "text", _node_hash("doc_id").alias("h"))
    found = rows.mapInArrow(released(run), "node long, d1 long, shingles array<long>")
    return found.join(nodes.select("node", "d1").hint("merge"), ["node", "d1"], "left_semi").dropDuplicates(["node", "d1"]).select("node", "shingles")


def _sets_for(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``sets`` that ``nodes`` (node) may want: a bitmap spares the shuffle of the others."""
    shared = sets.sparkSession.sparkContext.broadcast(bitmap_of(nodes.select(_node_hash("node").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(_held(shared.value, batch.column("h").to_numpy()))).select(["node", "shingles"])

    return sets.withColumn("h", _node_hash("node")).mapInArrow(released(run), "node long, shingles array<long>")


def near_duplicates(docs: DataFrame, percent: int = 80, shingle_words: int = 5, chunks: int = 10, width: int = 6, errors: int = 1, rounds: int = 2) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Rows are linked if 100 * intersection >= percent * union of their shingle sets. component_id: the smallest
    doc_id reachable; kept: whether that is the row's own. Null or wordless texts have an empty set and are linked
    with nothing. Rows with a null doc_id are linked with nothing either, and are kept with a null component. Equal
    rows are linked like any others; rows that share a doc_id count as one document where it is the smallest of
    its set. Other columns are ignored; an empty table gives no row.
    """
    signed = materialise(_signed(docs, shingle_words, chunks * width), "dedup-signed")
    usable = signed.where("n > 0 and doc_id is not null")
    classes = materialise(usable.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("node"), F.min_by("sig", "doc_id").alias("sig")), "dedup-classes")
    lowest = index_keys(classes, chunks, width, errors).groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    met = materialise(lowest.where("lo < hi").select("key"), "dedup-met")
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap_of(met))
    shared = materialise(index_keys(classes, chunks, width, errors, wanted).join(met.hint("merge"), "key", "left_semi"), "dedup-keys")
    nodes = shared.select("node").distinct().join(classes.select("node", "d1").hint("merge"), "node")
    sets = materialise(_sets_of(docs, nodes, shingle_words), "dedup-sets")
    labels = materialise(shared.select("node").distinct().withColumn("component", F.col("node")), "dedup-labels")

    anchors = None
    for number in range(rounds + 1):
        labelled = shared.join(labels.hint("merge"), "node")
        best = F.min(F.struct(F.xxhash64("node", F.lit(number)).alias("h"), "node", "component")).alias("best")
        per_key = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), best).where("lo < hi")
        per_key = materialise(per_key.select("key", F.col("best.node").alias("grp"), F.col("best.component").alias("of_grp")), "dedup-apart")
        apart = labelled.join(per_key.hint("merge"), "key")
        if number < rounds:
            # A star round: every class meets the centre it shares most keys with, if they are apart.
            shares = materialise(apart.where("of_grp <> component").groupBy("node", "grp").agg(F.count("*").alias("n")), "dedup-shares")
            queries = materialise(shares.groupBy("node").agg(F.max(F.struct("n", F.negative("grp").alias("g"))).alias("x")).select("node", F.negative("x.g").alias("grp")), "dedup-queries")
            if anchors is None:
                # Of the centres a class meets, the one that most classes meet: few groups cover a dense cluster.
                popular = materialise(shares.groupBy("grp").agg(F.count("*").alias("p")), "dedup-popular")
                anchors = shares.join(popular.hint("merge"), "grp").groupBy("node").agg(F.max(F.struct("p", F.negative("grp").alias("g"))).alias("x")).select("node", F.negative("x.g").alias("grp"))
                anchors = materialise(anchors, "dedup-anchors")
            asking = queries.select("node").unionByName(queries.select(F.col("grp").alias("node")).distinct())
            linked = materialise(star_links(queries, _sets_for(sets, asking), percent), "dedup-linked")
            ends = linked.join(labels.select("node", F.col("component").alias("u")).hint("merge"), "node")
            found = ends.join(labels.select(F.col("node").alias("grp"), F.col("component").alias("v")).hint("merge"), "grp").select("u", "v").distinct()
        else:
            # What is still apart: a group is a component, with the lone classes that first met one of its members.
            sizes = materialise(labels.groupBy("component").agg(F.count("*").alias("n")), "dedup-sizes")
            centre = anchors.join(labels.select(F.col("node").alias("grp"), F.col("component").alias("anchor")).hint("merge"), "grp").select("node", "anchor")
            grouped = labels.join(sizes.hint("merge"), "component").join(centre.hint("merge"), "node", "left").select("node", "component", F.when((F.col("n") > 1) | F.col("anchor").isNull(), F.col("component")).otherwise(F.col("anchor")).alias("own"))
            grouped = materialise(grouped, "dedup-groups")
            unlinked = materialise(apart.select("key", "node").join(grouped.hint("merge"), "node"), "dedup-unlinked")
            groups = materialise(unlinked.select("key", F.col("own").alias("grp")).distinct(), "dedup-key-groups")
            asked = unlinked.join(groups.hint("merge"), "key").where((F.col("own") > F.col("grp")) | (F.col("own") == F.col("grp")) & (F.col("component") != F.col("grp")))
            queries = materialise(asked.select("grp", "node").distinct(), "dedup-queries")
            members = grouped.select(F.col("own").alias("grp"), "node").join(queries.select("grp").distinct(), "grp", "left_semi")
            asking = queries.select("node").unionByName(members.select("node")).distinct()
            found = confirm(queries, members, _sets_for(sets, asking).join(labels.hint("merge"), "node"), percent)
        joined = connected_components(materialise(found, "dedup-links")).select(F.col("node").alias("component"), F.col("component").alias("low"))
        labels = materialise(labels.join(joined, "component", "left").select("node", F.coalesce("low", "component").alias("component")), "dedup-labels")

    of_class = classes.select("n", "d1", "d2", "node").join(labels.hint("merge"), "node", "left").select("n", "d1", "d2", F.coalesce("component", "node").alias("component"))
    out = signed.join(of_class.hint("merge"), ["n", "d1", "d2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates among all of ``documents``: two-word shingles, similarity 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=80, shingle_words=2)
