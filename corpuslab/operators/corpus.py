"""Corpus building: budgets, splits, hold-outs, decontamination and audits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions.runs import whole_runs
from corpuslab.functions.scale import hash_mod, hash_order, ranked
from corpuslab.functions.storage import written


def qa_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): user turns that an assistant turn follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("text").over(w).alias("answer"), F.lead("role").over(w).alias("next"))
    return rows.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", "question", "answer")


def mix_budgets(docs: DataFrame, ratios: dict[str, float], target: int, category: str = "lang", length: str = "n_tokens") -> DataFrame:
    """Token budget per category from ratios (shares of their sum, floors), with supply and shortfall."""
    whole = sum(ratios.values())
    budgets = docs.sparkSession.createDataFrame([(k, int(target * r / whole)) for k, r in ratios.items()], f"{category} string, budget long")
    supply = docs.groupBy(category).agg(F.sum(F.col(length) + 1).alias("supply"))
    joined = F.broadcast(budgets).join(supply, category, "left").withColumn("supply", F.coalesce("supply", F.lit(0)))
    return joined.withColumn("shortfall", F.greatest(F.col("budget") - F.col("supply"), F.lit(0)))


def select_for_budget(docs: DataFrame, budgets: DataFrame, seed: int, category: str = "lang", length: str = "n_tokens") -> DataFrame:
    """Whole records in a seeded order until the category's budget is reached; the crossing record is kept.

    Each record counts one end token more than its length. Per category the running total is found range by range
    (see ``ranked``), so a category that holds most rows does not meet in one window.
    """
    keyed = docs.join(F.broadcast(budgets.select(category, "budget")), category).withColumn("__h", hash_order(seed, "doc_id"))
    summed = ranked(keyed, [F.col(category), F.col("__h"), F.col("doc_id")], {"__upto": F.col(length) + 1})
    base = summed.groupBy(category).agg(F.min(F.col("__upto") - F.col(length) - 1).alias("__base"))
    before = F.col("__upto") - F.col(length) - 1 - F.col("__base")
    return summed.join(F.broadcast(base), category).where(before < F.col("budget")).drop("__h", "__upto", "__base", "rank", "budget")


def needles(qa: DataFrame) -> DataFrame:
    """Normalised strings that must not occur: answers of 2 words, questions of 6, both together of 4, at least."""
    q, a = T.norm_alnum(F.col("question")), T.norm_alnum(F.col("answer"))
    forms = F.array(F.struct(a.alias("needle"), F.lit(2).alias("least")), F.struct(q.alias("needle"), F.lit(6).alias("least")), F.struct(F.trim(F.concat_ws(" ", q, a)).alias("needle"), F.lit(4).alias("least")))
    return qa.select(F.explode(forms).alias("x")).where(F.size(F.split("x.needle", " ")) >= F.col("x.least")).select("x.needle").distinct()


def filter_contaminated(docs: DataFrame, found: DataFrame, inner: int = 2) -> DataFrame:
    """``docs`` without those whose normalised text contains a needle as a plain substring.

    The inner words of a needle of three or more are whole words of a text that contains it, so candidates come
    from a join on the needle's inner words, up to ``inner`` of them, with the distinct word n-grams of the texts;
    needles of two words join on what lies around their blank, up to three letters on either side. Each candidate
    is verified.
    Needles have at least two words.
    """
    hay = docs.select("doc_id", T.norm_alnum(F.col("text")).alias("hay"))
    words = F.split("hay", " ")
    listed = written(found.withColumn("w", F.split("needle", " ")).withColumn("size", F.size("w")), "needles")
    keyed = listed.where("size >= 3").withColumn("n", F.least(F.col("size") - 2, F.lit(inner))).select("needle", "n", F.expr("slice(w, 2, n)").alias("inside")).select("needle", "n", T.window_key(F.col("inside")).alias("key"))
    # Only windows of the lengths that some needle asks for are spread.
    ns = sorted(r["n"] for r in keyed.select("n").distinct().collect())
    hit = docs.sparkSession.createDataFrame([], hay.select("doc_id").withColumn("needle", F.lit("")).schema)
    if ns:
        hit = _keyed(hay.select("doc_id", words.alias("tokens")), ns, "doc_id").join(keyed, ["n", "key"]).select("doc_id", "needle").distinct()
    # Two words: the first ends a word of the text and the second begins the next one.
    around = lambda a, b, n, m: F.concat(F.right(a, F.lit(n)), F.lit(" "), F.left(b, F.lit(m)))
    sides = [F.least(F.char_length(F.element_at("w", i)), F.lit(3)).alias(c) for i, c in ((1, "before"), (-1, "after"))]
    heads = listed.where("size <= 2").select("needle", *sides, around(F.element_at("w", 1), F.element_at("w", -1), 3, 3).alias("start"))
    short, lengths = hit.limit(0), sorted((r["before"], r["after"]) for r in heads.select("before", "after").distinct().collect())
    if lengths:
        follow = lambda w: F.arrays_zip(F.slice(w, 1, F.size(w) - 1).alias("a"), F.slice(w, 2, F.size(w)).alias("b"))
        starts = T.let(T.let(words, follow), lambda pairs: F.flatten(F.transform(pairs, lambda x: F.array(*[around(x["a"], x["b"], n, m) for n, m in lengths]))))
        short = hay.select("doc_id", F.explode(F.array_distinct(starts)).alias("start")).join(heads, "start").select("doc_id", "needle").distinct()
    bad = hit.unionByName(short).join(hay, "doc_id").where(F.col("hay").contains(F.col("needle"))).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")


def heldout(docs: DataFrame, selected: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(selected.select(key), key, "left_anti")


def windows_of(tokens: Column, n: int) -> Column:
    """All windows of n tokens, each joined by spaces."""
    at = lambda t: F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
    return T.let(tokens, lambda t: F.transform(at(t), lambda i: F.array_join(F.slice(t, i, n), " ")))


def _keyed(docs: DataFrame, ns: list[int], *columns: str) -> DataFrame:
    """(columns, n, key): the keys of all windows of n tokens, repeated ones too, for every n in one pass over ``tokens``."""
    tagged = [F.transform(T.window_keys(F.col("tokens"), n), T.tagged("n", n)) for n in ns]
    return docs.select(*columns, F.explode(F.concat(*tagged)).alias("x")).select(*columns, "x.n", "x.key")


#: Rows of whole runs that are compared at once.
RUN_ROWS = 1 << 17


def _rolling(words: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A 64-bit hash of each run of n words, given as 64-bit hashes."""
    x = (words ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    out = x[: len(x) - n + 1].copy()
    for i in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93 + 2 * salt)
        out += x[i : len(x) - n + 1 + i]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    return out ^ (out >> np.uint64(32))


def _token_windows(ns: list[int], wanted: np.ndarray | None = None):
    """For ``mapInArrow`` over (doc_id, words), word hashes: (h1, h2, e.., doc_id), a row per window of the least n.

    h1 and h2 are its hashes, e.. those of the longer windows that begin with it (null where the text ends before). Rows
    of a batch that are equal are kept once. With ``wanted``, those whose bit is zero there are left out.
    """
    least, *longer = ns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["words"]
            words = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if len(words) < least:
                continue
            sizes = np.diff(lists.offsets.to_numpy())
            ends = np.repeat(np.cumsum(sizes), sizes)
            h1 = _rolling(words, least, 1)
            at = np.flatnonzero(np.arange(len(h1)) + least <= ends[: len(h1)])
            if wanted is not None:
                bits = h1[at] & np.uint64(8 * len(wanted) - 1)
                at = at[wanted[(bits >> np.uint64(3)).astype(np.int64)] >> (bits & np.uint64(7)).astype(np.uint8) & 1 > 0]
            columns, valid = [h1[at], _rolling(words, least, 2)[at]], []
            for n in longer:
                whole = at + n <= ends[at]
                e = np.zeros(len(at), np.uint64)
                if whole.any():
                    e[whole] = _rolling(words, n, 3)[at[whole]]
                columns.append(e)
                valid.append(whole)
            doc = np.repeat(np.arange(len(sizes)), sizes)[at] if wanted is None else np.zeros(len(at), np.int64)
            order = np.lexsort([*valid, *columns, doc])
            keys = [x[order] for x in (doc, *columns, *valid)]
            new = np.ones(len(order), bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            on = order[new]
            out = [pa.array(x[on].view(np.int64), mask=~valid[i - 2][on] if i > 1 else None) for i, x in enumerate(columns)]
            ids = batch["doc_id"].take(pa.array(doc[on])) if wanted is None else pa.nulls(len(on), batch.schema.field("doc_id").type)
            yield pa.RecordBatch.from_arrays([*out, ids, pa.array(np.full(len(on), wanted is None))], ["h1", "h2", *[f"e{n}" for n in longer], "doc_id", "ours"])

    return run


def _met_windows(ns: list[int]):
    """For ``mapInArrow`` over rows of ``_token_windows``, sorted by h1: (n, doc_id) of candidates' windows that the reference has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, "h1", RUN_ROWS):
            ours, ids = rows["ours"].to_numpy(), rows["doc_id"].combine_chunks()
            for i, n in enumerate(ns):
                names = ["h1", "h2", *([f"e{n}"] if i else [])]
                at = np.flatnonzero(rows[names[-1]].is_valid().to_numpy())
                keys = [rows[c].fill_null(0).to_numpy()[at] for c in names]
                order = np.lexsort([ours[at], *keys])
                at, keys = at[order], [k[order] for k in keys]
                new = np.ones(len(at), bool)
                new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
                # A run that the reference has begins with a row of it.
                hit = at[ours[at] & ~ours[at[new]][np.cumsum(new) - 1]]
                if len(hit):
                    found = ids.take(pa.array(hit)).unique()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), n, np.int32)), found], ["n", "doc_id"])

    return run


def overlapping(cand: DataFrame, ref: DataFrame, ns: list[int]) -> DataFrame:
    """(n, doc_id) of candidates that share a verbatim n-token window with the reference (doc_id, tokens).

    A longer window is shared where it is after the same window of the least n, so only these are dealt, by 128-bit keys. A
    bitmap of the candidates' keys spares the shuffle most of the reference's: 64 bits per key, 16 MB at most.
    """
    ns = sorted(ns)
    kind = cand.schema["doc_id"].dataType.simpleString()
    schema = f"h1 long, h2 long, {''.join(f'e{n} long, ' for n in ns[1:])}doc_id {kind}, ours boolean"
    words = lambda df: df.where("tokens is not null").select(F.col("doc_id").cast(kind), F.transform("tokens", lambda t: F.xxhash64(t)).alias("words"))
    ours = words(cand).mapInArrow(_token_windows(ns), schema)
    size = min(1 << 27, max(1 << 15, 1 << (64 * (cand.agg(F.sum(F.size("tokens"))).first()[0] or 0)).bit_length()))
    wanted = _bitmap(ours, "h1", size)
    rows = ours.unionByName(words(ref).mapInArrow(_token_windows(ns, wanted), schema))
    return rows.repartition("h1").sortWithinPartitions("h1").mapInArrow(_met_windows(ns), f"n int, doc_id {kind}").distinct()


def _bitmap(keys: DataFrame, name: str, size: int) -> np.ndarray:
    """Bits of the keys' values modulo ``size``, a power of two from 2^15 on, as bytes on the driver."""
    at = F.col(name).bitwiseAND(F.lit(size - 1).cast("long")) + 1
    out = np.zeros(size // 8, np.uint8)
    for part in keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect():
        out[(part["part"] - 1) * 4096 : part["part"] * 4096] = np.frombuffer(part["bits"], np.uint8)
    return out


def token_overlap_report(cand: DataFrame, ref: DataFrame, ns: list[int]) -> DataFrame:
    """Per n: records and tokens excluded by a shared window, and untestable records (shorter than n)."""
    bad = overlapping(cand, ref, ns).withColumn("hit", F.lit(1))
    sized = cand.select("doc_id", F.size("tokens").alias("n_tokens"), F.explode(F.array(*map(F.lit, ns))).alias("n")).join(bad, ["n", "doc_id"], "left")
    return sized.groupBy("n").agg(F.count("hit").alias("excluded"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n_tokens"))), F.lit(0)).alias("excluded_tokens"), F.count_if(F.col("n_tokens") < F.col("n")).alias("untestable"))


def _gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k code points."""
    h = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    out, done, size = None, 0, 1
    while True:  # runs of 1, 2, 4 and so on, put together as k is made of them
        if k & size:
            out = h if out is None else out[: len(h) - done] * np.uint64(0xD6E8FEB86659FD93) + h[done:]
            done += size
        size *= 2
        if size > k:
            break
        h = h[: len(h) - size // 2] * np.uint64(0xFF51AFD7ED558CCD + 2 * size) + h[size // 2 :]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    return out ^ (out >> np.uint64(31))


def _anchors(n: int, k: int, wanted: np.ndarray | None = None):
    """For ``mapInArrow`` over (doc_id, held, text): (key, doc_id, at, around), the places that stand for all windows of n.

    Of the runs of k code points in a window of n the one with the smallest hash, the first of equals, is its anchor; equal
    windows have equal ones. An anchor is kept with what lies n - k code points on either side, so that it holds every
    window it stands for; ``at`` is where it begins there. Equal ones of a batch are kept once, without an id if not held; those whose bit in ``wanted`` is
    zero are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, keys, ids, ats, arounds = set(), [], [], [], []
            for doc_id, held, text in zip(batch["doc_id"], batch["held"].to_pylist(), batch["text"].to_pylist(), strict=True):
                hashes = _gram_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), k)
                first = np.lib.stride_tricks.sliding_window_view(hashes, n - k + 1).argmin(axis=1)
                places = np.unique(first + np.arange(len(first)))
                if wanted is not None:
                    bits = hashes[places] & np.uint64(8 * len(wanted) - 1)
                    places = places[wanted[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8) & 1 > 0]
                own = doc_id.as_py() if held else None
                for place, key in zip(places.tolist(), hashes[places].astype(np.int64).tolist(), strict=True):
                    begin = max(0, place - (n - k))
                    around = text[begin : place + n]
                    if (own, place - begin, around) not in seen:
                        seen.add((own, place - begin, around))
                        keys.append(key)
                        ids.append(own)
                        ats.append(place - begin)
                        arounds.append(around)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, batch.schema.field("doc_id").type), pa.array(ats, pa.int32()), pa.array(arounds, pa.string())], ["key", "doc_id", "at", "around"])

    return run


def _met_anchors(n: int, k: int):
    """For ``mapInArrow`` over rows of ``_anchors``, sorted by key: (doc_id) of held texts that share a window of n."""

    def windows(at: int, around: str) -> set[str]:
        return {around[i : i + n] for i in range(max(0, at + k - n), min(at, len(around) - n) + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ours, theirs, hit, kind = None, [], set(), set(), None

        def compare() -> None:
            left = [x for x in ours if x[0] not in hit]
            if not left or not theirs:
                return
            left = [x for x in left if x[1:] not in theirs or hit.add(x[0])]
            if left:
                known = set().union(*[windows(*x) for x in theirs])
                hit.update(doc_id for doc_id, at, around in left if doc_id not in hit and not known.isdisjoint(windows(at, around)))

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for one, doc_id, at, around in zip(*[batch[c].to_pylist() for c in ("key", "doc_id", "at", "around")], strict=True):
                if one != key:
                    compare()
                    key, ours, theirs = one, [], set()
                if doc_id is None:
                    theirs.add((at, around))
                elif doc_id not in hit:
                    ours.append((doc_id, at, around))
        compare()
        if hit:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(hit), kind)], ["doc_id"])

    return run


def char_overlap(cand: DataFrame, ref: DataFrame, n: int) -> DataFrame:
    """(doc_id, overlaps): null where the text is shorter than n code points and cannot be tested.

    Windows are not spread: each is found by its anchor, which about one place in n / 4 is (``_anchors``). Anchors of
    both sides meet by their hash, once, and the texts around them are compared as they are.
    """
    k = max(1, n // 2)
    kind = cand.schema["doc_id"].dataType.simpleString()
    long, schema = F.char_length("text") >= n, f"key long, doc_id {kind}, at int, around string"
    sides = [df.where(long).select("doc_id", F.lit(held).alias("held"), "text") for df, held in ((cand.where("doc_id is not null"), True), (ref, False))]
    # A bitmap of the candidates' anchors spares the shuffle most of the others: 64 bits per anchor, 16 MB at most; what gets through is compared.
    chars = cand.agg(F.sum(F.when(long, F.char_length("text")))).first()[0] or 0
    size = min(1 << 27, max(1 << 15, 1 << (256 * chars // n).bit_length()))
    ours = sides[0].mapInArrow(_anchors(n, k), schema)
    wanted = _bitmap(ours, "key", size)
    rows = ours.unionByName(sides[1].mapInArrow(_anchors(n, k, wanted), schema))
    # Of anchors without a held one nothing is compared; a window that several texts of the reference hold is compared once.
    met = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_met_anchors(n, k), f"doc_id {kind}")
    hit = met.distinct().withColumn("hit", F.lit(True))
    return cand.select("doc_id", long.alias("long")).join(hit, "doc_id", "left").select("doc_id", F.when(F.col("long"), F.coalesce("hit", F.lit(False))).alias("overlaps"))


def verify_disjoint(held: DataFrame, ref: DataFrame, ns: list[int]) -> DataFrame:
    """Per n: held records whose first n tokens occur in the reference, and how many were tested."""
    firsts = F.array(*[F.struct(F.lit(n).alias("n"), F.when(F.size("tokens") >= n, T.window_key(F.slice("tokens", 1, n))).alias("key")) for n in ns])
    heads = held.select(F.explode(firsts).alias("x")).select("x.n", "x.key")
    theirs = _keyed(ref, ns).join(heads.distinct(), ["n", "key"], "left_semi").distinct().withColumn("hit", F.lit(1))
    return heads.join(theirs, ["n", "key"], "left").groupBy("n").agg(F.count("key").alias("tested"), F.count("hit").alias("found"))


def grams_with_fallback(words: Column, n: int) -> Column:
    """Distinct n-grams; a text of fewer words is one gram as a whole, an empty one has none."""
    whole = lambda w: F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
    return T.let(words, lambda w: F.array_distinct(F.when(F.size(w) < n, whole(w)).otherwise(windows_of(w, n))))


def audit_contamination(items: DataFrame, docs: DataFrame, n: int = 8) -> DataFrame:
    """Per item (item_id, question, answer): exact occurrences on word boundaries, overlap ratios, severity.

    Exact: the words of the field occur in a row in some document. They are found by joining fields of k words
    with the k-grams of the documents (doc_id, text), k by k as the fields have it, never documents with items.
    """
    strict = lambda c: F.filter(F.split(T.norm_strict(F.col(c)), " "), lambda w: w != "")
    fields = items.select("item_id", strict("question").alias("q"), strict("answer").alias("a")).withColumn("qa", F.concat("q", "a"))
    words = docs.select("doc_id", strict("text").alias("w"))
    long = fields.select("item_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("words")) for f in ("q", "a", "qa")])).alias("x")).select("item_id", "x.field", "x.words").where(F.size("words") > 0)
    asked = long.select("item_id", "field", F.explode(grams_with_fallback(F.col("words"), n)).alias("gram"))
    met = words.select(F.explode(grams_with_fallback(F.col("w"), n)).alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi").distinct()
    ratios = asked.join(met.withColumn("hit", F.lit(1)), "gram", "left").groupBy("item_id", "field").agg((F.count("hit") / F.count("*")).alias("ratio"))
    exact = exact_fields(long, words)
    wide = ratios.join(exact, ["item_id", "field"]).groupBy("item_id").pivot("field", ["q", "a", "qa"]).agg(F.first("ratio").alias("ratio"), F.first("exact").alias("exact"))
    out = fields.select("item_id").join(wide, "item_id", "left")
    flag, ratio = (lambda f: F.coalesce(F.col(f"{f}_exact"), F.lit(False))), (lambda f: F.coalesce(F.col(f"{f}_ratio"), F.lit(0.0)))
    severity = F.when(flag("qa"), "critical").when(flag("q") | (ratio("qa") >= 0.8), "high").when(flag("a") | (ratio("q") >= 0.5), "medium").otherwise("low")
    return out.select("item_id", flag("a").alias("answer_exact"), flag("q").alias("question_exact"), flag("qa").alias("both_exact"), F.round(ratio("q"), 9).alias("question_overlap"), F.round(ratio("qa"), 9).alias("both_overlap"), severity.alias("severity"))


def field_findings(long: DataFrame, words: DataFrame, head: int = 4) -> DataFrame:
    """(item_id, field, doc_id): the texts (doc_id, w) in which the field's words occur in a row, each once.

    Of each text only the keys of its first-word windows are spread, for those lengths up to ``head`` that fields
    have; a text itself is joined again to the few keys that some field begins with.
    """
    start = F.slice("words", 1, head)
    keyed = long.select("item_id", "field", F.array_join("words", " ").alias("needle"), F.least(F.size("words"), F.lit(head)).alias("n"), T.window_key(start).alias("key"))
    ns = sorted(r["n"] for r in keyed.select("n").distinct().collect()) or [1]
    keys = _keyed(words.select("doc_id", F.col("w").alias("tokens")), ns, "doc_id").join(keyed.select("n", "key").distinct(), ["n", "key"], "left_semi").distinct()
    hay = words.select("doc_id", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("hay"))
    met = keys.join(hay.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id"))).join(keyed, ["n", "key"]).where(F.col("hay").contains(F.concat(F.lit(" "), F.col("needle"), F.lit(" "))))
    return met.select("item_id", "field", "doc_id").distinct()


def exact_fields(long: DataFrame, words: DataFrame, head: int = 4) -> DataFrame:
    """(item_id, field, exact): do the field's words occur in a row in some text (doc_id, w)?"""
    found = field_findings(long, words, head).select("item_id", "field").distinct().withColumn("exact", F.lit(True))
    return long.select("item_id", "field").join(found, ["item_id", "field"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))


def contamination_findings(items: DataFrame, docs: DataFrame, least: int = 2) -> DataFrame:
    """(item_id, docs, first_doc): in how many documents an item's answer occurs, and the smallest id; items without a finding are left out."""
    long = items.select("item_id", F.lit("a").alias("field"), T.word_tokens(F.col("answer")).alias("words")).where(F.size("words") >= least)
    found = field_findings(long, docs.select("doc_id", T.word_tokens(F.col("text")).alias("w")))
    return found.groupBy("item_id").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


def audit_by_task(audit: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task, items, exact counts, mean overlaps, severities) of an audit per item and (item_id, task); task null: all items.

    Items without a task count as ``unknown``.
    """
    rows = audit.join(tasks.select("item_id", "task"), "item_id", "left").withColumn("task", F.coalesce("task", F.lit("unknown")))
    counts = [F.count_if(c).alias(c) for c in ("answer_exact", "question_exact", "both_exact")]
    means = [F.avg(c).alias(c) for c in ("question_overlap", "both_overlap")]
    return rows.rollup("task").agg(F.count("*").alias("items"), *counts, *means, *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")])


def eval_contamination(items: DataFrame, docs: DataFrame, least: int = 2) -> DataFrame:
    """(item_id, contaminated): does the answer, of at least ``least`` word tokens, occur in a document; else null."""
    long = items.select("item_id", F.lit("a").alias("field"), T.word_tokens(F.col("answer")).alias("words")).where(F.size("words") >= least)
    found = exact_fields(long, docs.select("doc_id", T.word_tokens(F.col("text")).alias("w")))
    return items.select("item_id").join(found.select("item_id", F.col("exact").alias("contaminated")), "item_id", "left")


def hash_split(df: DataFrame, text: Column, frac: float, names=("eval", "train")) -> DataFrame:
    """Adds ``split``: rows whose content hash modulo 1000 lies below frac * 1000 get the first name."""
    return df.withColumn("split", F.when(hash_mod(text, 1000) < int(round(frac * 1000)), names[0]).otherwise(names[1]))


def collect_split(items: DataFrame, known: DataFrame, limit: int, task: str = "task") -> DataFrame:
    """Items with a ``status``: empty, excluded (known question), duplicate, over (beyond the cap) or kept.

    A question is known also by what follows its last "Question:"; a null one is empty. Of duplicates by normal form
    the smallest id stays. The cap per task is by global ranks, not a window per task. Normal forms are compared by their hashes.
    """
    tail = F.trim(F.element_at(F.split("question", "Question:"), -1))
    keyed = written(items.withColumn("__k", F.coalesce(T.norm_key(F.col("question")), F.lit(""))).withColumn("__t", T.norm_key(tail)), "split-keys")
    seen = known.select(T.norm_key(F.col("question")).alias("__k")).where("__k <> ''").distinct().withColumn("__known", F.lit(1))
    joined = keyed.join(seen, "__k", "left").join(seen.withColumnRenamed("__k", "__t").withColumnRenamed("__known", "__known2"), "__t", "left")
    firsts = joined.groupBy("__k").agg(F.min("item_id").alias("__first"))
    status = F.when(F.col("__k") == "", "empty").when(F.col("__known").isNotNull() | F.col("__known2").isNotNull(), "excluded").when(F.col("item_id") != F.col("__first"), "duplicate").otherwise("kept")
    marked = joined.join(firsts, "__k").withColumn("status", status)
    numbered = ranked(marked.where("status = 'kept'").select(task, "item_id"), [F.col(task), F.col("item_id")])
    base = numbered.groupBy(task).agg((F.min("rank") - 1).alias("__base"))
    over = numbered.join(F.broadcast(base), task).where(F.col("rank") - F.col("__base") > limit).select("item_id").withColumn("__over", F.lit(1))
    return marked.join(over, "item_id", "left").withColumn("status", F.when(F.col("__over") == 1, "over").otherwise(F.col("status"))).drop("__k", "__t", "__known", "__known2", "__first", "__over")


def rare_items(qa: DataFrame, docs: DataFrame, k: int = 5, least_chars: int = 4) -> DataFrame:
    """Per item: smallest and mean corpus count of the answer's content words, and whether the smallest is <= k."""
    content = lambda c: F.filter(T.word_tokens(F.col(c)), lambda w: (F.char_length(w) >= least_chars) & ~w.isin(*T.STOPWORDS))
    counts = docs.select(F.explode(content("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = qa.select("item_id", F.explode(F.array_distinct(content("answer"))).alias("word"))
    found = words.join(counts, "word", "left").groupBy("item_id").agg(F.min(F.coalesce("n", F.lit(0))).alias("min_count"), F.round(F.avg(F.coalesce("n", F.lit(0))), 9).alias("mean_count"))
    return found.withColumn("rare", F.col("min_count") <= k)


def sample_positions(tokens: DataFrame, k: int, seed: int, least_pos: int = 2) -> DataFrame:
    """At most k positions per document in a seeded order, from positions with ``least_pos`` tokens before them."""
    w = Window.partitionBy("doc_id").orderBy(hash_order(seed, "doc_id", "pos"))
    return tokens.where(F.col("pos") >= least_pos).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def sample_positions_of(docs: DataFrame, k: int, seed: int, least_pos: int = 2) -> DataFrame:
    """``sample_positions`` of (doc_id, tokens): each row keeps its own first k, and only those are shuffled."""
    order = lambda i: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), i.cast("string")))
    places = F.transform("tokens", lambda t, i: F.struct(order(i).alias("h"), i.alias("pos"), t.alias("token")))
    first = F.slice(F.sort_array(F.slice(places, least_pos + 1, F.greatest(F.size("tokens") - least_pos, F.lit(0)))), 1, k)
    kept = docs.select("doc_id", F.explode(first).alias("x")).select("doc_id", "x.pos", "x.token")
    return sample_positions(kept, k, seed, least_pos)


def split_exact(df: DataFrame, frac: float, seed: int, key: str = "doc_id") -> DataFrame:
    """Adds ``part``: exactly round(frac * n) rows, first in a seeded order, are eval."""
    n = int(round(frac * df.count()))
    return ranked(df.withColumn("__h", hash_order(seed, key)), [F.col("__h"), F.col(key)]).withColumn("part", F.when(F.col("rank") <= n, "eval").otherwise("train")).drop("__h", "rank")


def mix_streams(tokens: DataFrame, parts: list[tuple[str, int]]) -> DataFrame:
    """(stream, offset, token): the first k tokens of each named stream (columns stream, offset), one after the other."""
    sizes = {r["stream"]: r["n"] for r in tokens.groupBy("stream").agg(F.count("*").alias("n")).collect()}
    out, base = None, 0
    for name, k in parts:
        part = tokens.where((F.col("stream") == name) & (F.col("offset") < k)).withColumn("offset", F.col("offset") + base)
        base += min(k, sizes.get(name, 0))
        out = part if out is None else out.unionByName(part)
    return out


def rag_examples(rankings: DataFrame, docs: DataFrame, k: int = 3, separator: str = "\n---\n") -> DataFrame:
    """(query_id, context): the top k retrieved texts other than the query's own, joined in order of rank."""
    others = rankings.where("query_id <> doc_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    top = others.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).join(docs.select("doc_id", "text"), "doc_id")
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__r", "text"))), lambda x: x["text"]), separator).alias("context"))


def verify_examples(df: DataFrame) -> DataFrame:
    """Adds ``reason`` (null: accepted) by category: the last number equals gold, a code block, 20 characters at least."""
    last = F.try_element_at(F.regexp_extract_all("text", F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), F.lit(-1)).try_cast("double")
    math = F.when(last.isNull(), "no_number").when(last != F.col("gold"), "wrong_number")
    code = F.when(~F.col("text").contains("```"), "no_code_block")
    other = F.when(F.char_length(F.trim("text")) < 20, "too_short")
    return df.withColumn("reason", F.when(F.col("category") == "math", math).when(F.col("category") == "code", code).otherwise(other))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row: groups of equal normal forms with more than one record, records in them, the largest."""
    groups = docs.groupBy(F.sha2(T.norm_alnum(F.col("text")), 256)).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def vocab_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(token, id_a, id_b, kind): only_a, only_b or changed; equal entries are left out."""
    j = a.withColumnRenamed("id", "id_a").join(b.withColumnRenamed("id", "id_b"), "token", "full_outer")
    kind = F.when(F.col("id_b").isNull(), "only_a").when(F.col("id_a").isNull(), "only_b").when(F.col("id_a") != F.col("id_b"), "changed")
    return j.withColumn("kind", kind).where("kind is not null")


def leakage_matrix(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """How many items of each QA split have an answer that occurs in documents of each knowledge split."""
    out = None
    for split in ("train", "eval"):
        found = eval_contamination(questions, docs.where(F.col("split") == split)).where("contaminated")
        rows = found.join(questions.select("item_id", F.col("split").alias("qa_split")), "item_id").groupBy("qa_split").agg(F.count("*").alias("n")).withColumn("kb_split", F.lit(split))
        out = rows if out is None else out.unionByName(rows)
    return written(out, "leakage").groupBy("qa_split").pivot("kb_split", ["train", "eval"]).agg(F.first("n")).na.fill(0)
