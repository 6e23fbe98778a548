"""Benchmark decontamination with a generalised suffix automaton.

All normalised test items make one suffix automaton over words. The words of a text stream through it; after each
word the automaton's state and a length tell the longest run of words ending there that occurs in some item. Runs of
at least ``window`` words, and whole items that are shorter, are hits. States know which items hold their windows, so
hits name their items without a look at the items themselves. Spans of hits are cut out of a text, and texts whose
hits exceed a coverage limit go as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.scale import ranked

from .common import materialise, table, text_or_empty

#: Words are runs of these characters after A-Z became a-z: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same by bytes of UTF-8: capitals to small letters, every other ASCII byte outside words to a blank.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: A longer word counts by its digest, so that the automaton's size follows from the number of words.
LONGEST_WORD = 64


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(BYTES).split()


def short(word: bytes) -> bytes:
    return word if len(word) <= LONGEST_WORD else b" " + hashlib.sha256(word).digest()


def words_column(text: Column) -> Column:
    """The words of a text, long ones as digests, as ``words_of`` and ``short`` give them (hexadecimal digest)."""
    small = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.regexp_extract_all(small, F.lit(f"({WORD})"), F.lit(1)), lambda w: F.when(F.octet_length(w) <= LONGEST_WORD, w).otherwise(F.concat(F.lit(" "), F.sha2(w, 256))))


class Automaton:
    """The generalised suffix automaton of items (list of words each), with the items of every window by state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.ids = window, {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
        states = sorted(range(1, len(self.go)), key=self.length.__getitem__)
        #: The state above (or at) each one that holds its suffix of ``window`` words.
        self.at_window = [0] * len(self.go)
        for s in states:
            if self.length[s] >= window:
                self.at_window[s] = self.at_window[self.link[s]] or s
        #: By state: the items with a window there, and, for short items, (words, items) that end there.
        self.named: dict[int, set[str]] = {}
        self.whole: dict[int, dict[int, set[str]]] = {}
        for name, codes in coded:
            state = 0
            for i, code in enumerate(codes):
                state = self.go[state][code]
                if i + 1 >= window:
                    # The state of a whole item's beginning may hold longer strings; its window's state is above it.
                    self.named.setdefault(self.at_window[state], set()).update([name] if name is not None else [])
            if len(codes) < window:
                self.whole.setdefault(state, {}).setdefault(len(codes), set()).update([name] if name is not None else [])
        #: The nearest state above each one (itself included) at which a short item ends; 0: none.
        self.ends = [0] * len(self.go)
        for s in states:
            self.ends[s] = s if s in self.whole else self.ends[self.link[s]]

    def _extend(self, last: int, code: int) -> int:
        """The state of the string at ``last`` with one more word."""
        go, link, length = self.go, self.link, self.length
        if code in go[last]:
            q = go[last][code]
            return q if length[q] == length[last] + 1 else self._split(last, code, q)
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and code not in go[p]:
            go[p][code] = new
            p = link[p]
        if p >= 0:
            q = go[p][code]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, code, q)
        return new

    def _split(self, p: int, code: int, q: int) -> int:
        """A copy of state ``q`` for its strings that are one word longer than ``p``'s."""
        go, link, length = self.go, self.link, self.length
        copy = len(go)
        go.append(dict(go[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and go[p].get(code) == q:
            go[p][code] = copy
            p = link[p]
        return copy

    def matches(self, words: list[bytes]) -> tuple[list[list[int]], set[str], int]:
        """(spans of hit words, in order and apart; items with a hit; the longest run of words found in an item)."""
        ids, go, link, lengths, window, at_window, ends = self.ids, self.go, self.link, self.length, self.window, self.at_window, self.ends
        root, spans, items, state, n, longest, seen = go[0], [], set(), 0, 0, 0, set()
        if max(map(len, words), default=0) > LONGEST_WORD:
            words = [short(w) for w in words]
        for i, code in enumerate(map(ids.get, words)):
            if code is None:
                state = n = 0
                continue
            following = go[state].get(code)
            if following is None:
                while state and code not in go[state]:
                    state = link[state]
                n = lengths[state]
                following = root[code] if not state else go[state][code]
            state = following
            n += 1
            if n > longest:
                longest = n
            if n >= window:
                add(spans, i + 1 - window, i + 1)
                if at_window[state] not in seen:
                    seen.add(at_window[state])
                    items |= self.named[at_window[state]]
            end = ends[state]
            while end:
                for size, names in self.whole[end].items():
                    if size <= n:
                        add(spans, i + 1 - size, i + 1)
                        items |= names
                end = ends[link[end]]
        return spans, items, longest


def add(spans: list[list[int]], start: int, end: int) -> None:
    """Add a span that ends no earlier than those before it; spans that meet become one."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append([start, end])


def without(text: str, spans: list[list[int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    small = text.translate({c: c + 32 for c in range(65, 91)})
    places = [m.span() for m in re.finditer(WORD, small)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join([*out, text[at:]])


def pieces_of(items: DataFrame, window: int, piece_words: int, words_per_automaton: int) -> DataFrame:
    """(part, item, words): items cut so that every window lies whole in a piece, in parts of bounded size.

    A part has at most ``words_per_automaton`` + ``piece_words`` words; running sums deal pieces to parts.
    """
    words = items.select(F.col("item_id").cast("string").alias("item"), words_column(text_or_empty()).alias("words")).where(F.size("words") > 0).distinct()
    step = piece_words - window + 1
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(step))
    cut = words.select("item", F.posexplode(F.transform(starts, lambda s: F.slice("words", s + 1, F.lit(piece_words)))).alias("piece", "words"))
    sized = cut.withColumn("n", F.size("words"))
    return ranked(sized, [F.col("item"), F.col("piece"), F.array_join("words", " ")], {"upto": F.col("n")}).select(F.floor((F.col("upto") - 1) / words_per_automaton).cast("int").alias("part"), "item", "words")


def scan(docs: DataFrame, items: DataFrame, window: int = 10, words_per_automaton: int = 400_000, piece_words: int = 20_000) -> DataFrame:
    """(doc_id, text, n_words, spans, items, longest) of every whole text against all items.

    ``spans``: word positions [start, end) inside hits, in order and apart; ``items``: ids (text) of items with a hit,
    distinct, sorted as text; ``longest``: the longest run of words found in an item (of an item's piece where items
    are longer than ``piece_words``). A hit is any ``window`` consecutive words of an item, or a whole item of fewer.
    Null and empty texts have no words; items without words match nothing; an item without an id hits but is not
    named; items with one id count as one. Repeated documents and repeated ids are rows like others; other columns
    are ignored; an empty table gives no row, no items no hit. Items are collected part by part, a part has a bounded
    number of words (above); each part's automaton is broadcast and all texts pass it in one scan without a shuffle.
    More than one part: rows with what was found so far are written between scans.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("longest", pa.int64())])
    ddl = "doc_id long, text string, n_words long, spans array<array<long>>, items array<string>, longest long"
    none = F.array().cast("array<array<long>>").alias("spans"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("longest")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), *none)
    pieces = materialise(pieces_of(items, window, piece_words, words_per_automaton), "decontaminate-items")
    parts = (pieces.agg(F.max("part")).first()[0] or 0) + 1
    for part in range(parts):
        held = pieces.where(F.col("part") == part).select("item", "words").toLocalIterator()
        given = [(row["item"], [w.encode() if w[0] != " " else b" " + bytes.fromhex(w[1:]) for w in row["words"]]) for row in held]
        shared = docs.sparkSession.sparkContext.broadcast(Automaton(given, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                counts, all_spans, all_items, all_longest = [], [], [], []
                for text, spans, items, longest in zip(*(batch.column(c) for c in ("text", "spans", "items", "longest")), strict=True):
                    words = words_of(text.as_py() or "")
                    found, named, most = automaton.matches(words)
                    before = spans.as_py()
                    if before:
                        both, found = sorted(before + found), []
                        for start, end in both:
                            if found and found[-1][1] >= start:
                                found[-1][1] = max(found[-1][1], end)
                            else:
                                found.append([start, end])
                    counts.append(len(words))
                    all_spans.append(found)
                    all_items.append(sorted(named.union(items.as_py())))
                    all_longest.append(max(most, longest.as_py()))
                new = (batch.column("doc_id"), batch.column("text"), pa.array(counts, pa.int64()), pa.array(all_spans, schema.field("spans").type), pa.array(all_items, schema.field("items").type), pa.array(all_longest, pa.int64()))
                yield pa.RecordBatch.from_arrays(list(new), schema=schema)

        out = (materialise(out, "decontaminate") if part else out).mapInArrow(run, ddl)
    return out


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, most_coverage: float = 0.5, **sizes: int) -> DataFrame:
    """(doc_id, text, removed_words): texts without the spans hit, and without texts hit in more than ``most_coverage``.

    The span from the first hit word to the last goes, with what stands between; all else stays as it was. Texts
    without a hit are unchanged, null stays null. Edge cases as in ``scan``.
    """
    found = scan(docs, items, window, **sizes).withColumn("removed_words", hit_words()).where(F.col("removed_words") <= most_coverage * F.col("n_words"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("removed_words", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without(text.as_py(), spans.as_py()) if len(spans) else text.as_py() for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("removed_words")], schema=schema)

    return found.select("doc_id", "text", "removed_words", "spans").mapInArrow(cut, "doc_id long, text string, removed_words long")


def op12_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Words and items hit per document of ``documents``, all items of ``benchmark``, windows of 10 words."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hits = hit_words()
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"), "longest")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Runs of 1, 2, ... words that occur in an item tell the longest; hits are joins of windows, as SQL has no automaton.
ORACLE = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents), i as (select item_id, {_WORDS} as w from benchmark),
sizes as (select distinct least(len(w), 10) as k from i where len(w) > 0),
iw as (select distinct item_id, k, array_to_string(w[p:p + k - 1], ' ') as key from (select item_id, w, least(len(w), 10) as k, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) as p from i where len(w) > 0)),
dw as (select r, k, p, array_to_string(w[p:p + k - 1], ' ') as key from (select r, w, k, unnest(generate_series(1, len(w) - k + 1)) as p from d, sizes where len(w) >= k)),
h as (select r, p, k, item_id from dw join iw using (k, key)),
c as (select r, count(distinct q) as n_hit from (select r, unnest(generate_series(p, p + k - 1)) as q from h) group by r),
n as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as names from h group by r),
il as (select distinct s, array_to_string(w[p:p + s - 1], ' ') as key from (select w, s, unnest(generate_series(1, len(w) - s + 1)) as p from i, (select unnest(generate_series(1, (select max(len(w)) from i))) as s) where len(w) >= s)),
vocab as (select distinct unnest(w) as t from i),
runs as (select r, min(p) as p0, list(t order by p) as w from (select r, p, t, p - row_number() over (partition by r order by p) as g from (select r, unnest(w) as t, generate_subscripts(w, 1) as p from d) where t in (select t from vocab)) group by r, g),
rw as (select r, s, array_to_string(w[p:p + s - 1], ' ') as key from (select r, w, s, unnest(generate_series(1, len(w) - s + 1)) as p from runs, (select unnest(generate_series(1, (select max(len(w)) from i))) as s) where len(w) >= s)),
l as (select r, max(s) as longest from rw where (s, key) in (select s, key from il) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(longest, 0)::bigint as longest
from d left join c using (r) left join n using (r) left join l using (r)
"""
