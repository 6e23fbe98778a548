"""Toxicity scores of texts whose words may be disguised: a noisy channel restores them before they are scored.

Words written with look-alike digits and symbols, with letters spaced apart or repeated, form a lattice of
readings per character; Viterbi under a character trigram model finds the cheapest reading. Features of plain and
restored words (the word and its beginnings) are chosen from labelled rows by a likelihood-ratio test against the
number of features tried. Near copies among the toxic rows count as one, so copies of one toxic text do not make
all of its words suspicious.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import held_out, materialise, released, table
from .components import connected_components

# Letters that a character can stand for, beside itself if it is a letter.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "¢": "c", "€": "e", "£": "l", "¡": "i",
}
ANY_LETTER = "*#?%"
FILLERS = " .-_~'`·​"
EDGES = ".,;:!?\"'()[]{}<>|`*#$%&~-_/\\=+…«»„“”"
#: What is trimmed when symbols at an edge are read as letters.
EDGES_BEFORE, EDGES_AFTER = (EDGES.translate({ord(c): None for c in kept}) for kept in ("!$|(@", "$@"))
COST = {"lookalike": 0.7, "any": 3.0, "filler": 0.3, "repeat": 0.5, "literal": 6.0}
BEGINNINGS = (4, 5, 6, 7)
#: Letters from here on count as one letter per block of 128, those from ALPHABET_END on (ideographs, kana, syllable
#: blocks) as one letter in all: an alphabet of at most 26 + 32 + 93 letters, and so at most 153 ** 3 trigrams.
LETTERS_END, BLOCK, ALPHABET_END = 0x100, 128, 0x2E80
_BEYOND = re.compile(f"[{chr(LETTERS_END)}-\U0010ffff]")
_SPACED = re.compile(r"(?<!\w)[^\W_](?:[ .\-_*~]{1,2}[^\W_]){2,}(?!\w)")
#: The second and third letter of a spaced run: a cheap test that every text with such a run passes.
_MAY_BE_SPACED = re.compile(r"[ .\-_*~][^\W_][ .\-_*~]{1,2}[^\W_](?!\w)")
_WIDE_GAP = re.compile(r"[ .\-_*~]{2}")
_HIDDEN_RUN = re.compile(f"[{re.escape(ANY_LETTER)}]{{2,}}")
_REPEATED = re.compile(r"([^\W\d_])\1\1")


def plain(token: str) -> str:
    return token.strip(EDGES)


def disguised(token: str) -> bool:
    """Whether a token without its edges needs restoring: other characters among letters, or a letter thrice."""
    return not token.isalpha() and any(c.isalpha() for c in token) or _REPEATED.search(token) is not None


@dataclass
class CharModel:
    """Character trigrams of words with backoff to bigrams and to a uniform floor."""

    trigrams: dict[str, int]
    bigrams: Counter = field(default_factory=Counter)
    contexts: Counter = field(default_factory=Counter)
    singles: Counter = field(default_factory=Counter)
    known: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        for gram, n in self.trigrams.items():
            self.contexts[gram[:2]] += n
            self.bigrams[gram[1:]] += n
            self.singles[gram[1]] += n

    @cached_property
    def most_hidden(self) -> int:
        """More letters than this a run of symbols hides in no cheapest reading.

        A hidden letter costs more than a filler by ``any`` - ``filler`` at least, and hidden letters change the cost of
        none but the two letters after the run (or the end), each of which costs no more than one never seen in the
        commonest context.
        """
        most = math.log((max(self.contexts.values(), default=0) + 2.0) * (max(self.singles.values(), default=0) + 5.0) / 0.1)
        return int(2 * most / (COST["any"] - COST["filler"])) + 1

    def cost(self, context: str, letter: str) -> float:
        asked = context + letter
        found = self.known.get(asked)
        if found is not None:
            return found
        context, letter = folded(context), folded(letter)
        key = context + letter
        bigram = (self.bigrams.get(context[1] + letter, 0) + 0.05) / (self.singles.get(context[1], 0) + 5.0)
        found = self.known[asked] = -math.log((self.trigrams.get(key, 0) + 2.0 * bigram) / (self.contexts.get(context, 0) + 2.0))
        return found


def folded(word: str) -> str:
    """``word`` with a letter per block in place of letters beyond ``LETTERS_END``: the alphabet of the model is bounded."""
    return word if word.isascii() else _BEYOND.sub(lambda m: chr(min(ord(m[0]), ALPHABET_END) // BLOCK * BLOCK), word)


def trigrams_of(word: str) -> Iterator[str]:
    framed = f"^^{folded(word)}$"
    return (framed[i : i + 3] for i in range(len(framed) - 2))


SPACE, LETTER, EDGE, OTHER = range(4)
BEGIN, END = ord("^"), ord("$")


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every code point; no letter lies beyond U+3FFFF."""
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x40000):
        c = chr(i)
        out[i] = SPACE if c.isspace() else LETTER if c.isalpha() else EDGE if c in EDGES else OTHER
    return out


def stretches(texts: Iterable[str], size: int = 1 << 20) -> Iterator[str]:
    """The texts in lower case, joined and cut at white space to about ``size`` characters."""
    held, n = [], 0
    for text in texts:
        at = 0
        while at < len(text):
            end = len(text) if len(text) - at <= size else at + size
            while end < len(text) and not text[end].isspace():
                end += 1
            held.append(text[at:end].lower())
            n, at = n + end - at, end
            if n >= size:
                yield "\n".join(held)
                held, n = [], 0
    if held:
        yield "\n".join(held)


def count_trigrams(text: str) -> Iterator[tuple[str, int]]:
    """How often each trigram of ``trigrams_of`` occurs in the tokens that are letters once their edges are trimmed."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[codes]
    inner, letter = np.concatenate(([False], kind != SPACE)), np.concatenate(([False], kind == LETTER, [False]))
    token = np.cumsum(inner[1:] & ~inner[:-1], dtype=np.int32)
    starts, ends = np.flatnonzero(letter[1:-1] & ~letter[:-2]), np.flatnonzero(letter[1:-1] & ~letter[2:]) + 1
    # A token counts if its letters are one run and nothing but edges lies around it.
    of, n_tokens = token[starts], int(token[-1]) + 1 if len(token) else 1
    bad = np.bincount(of, minlength=n_tokens) != 1
    bad[token[kind == OTHER]] = True
    starts, lengths = starts[~bad[of]], (ends - starts)[~bad[of]]
    if not len(starts):
        return
    runs = np.arange(len(starts))
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    letters = np.minimum(codes[np.repeat(starts, lengths) + place], ALPHABET_END)
    letters = np.where(letters < LETTERS_END, letters, letters // BLOCK * BLOCK)
    alphabet = np.flatnonzero(np.bincount(np.concatenate((letters, [BEGIN, END]))))
    rank = np.zeros(ALPHABET_END + 1, np.int64)
    rank[alphabet] = np.arange(len(alphabet))
    framed = np.full(len(letters) + 3 * len(runs), rank[BEGIN])
    framed[np.arange(len(letters)) + np.repeat(3 * runs + 2, lengths)] = rank[letters]
    framed[np.cumsum(lengths + 3) - 1] = rank[END]
    first = np.arange(len(letters) + len(runs)) + np.repeat(2 * runs, lengths + 1)
    k = len(alphabet)
    keys = (framed[first] * k + framed[first + 1]) * k + framed[first + 2]
    if k**3 <= 1 << 22:
        counts = np.bincount(keys)
        keys = np.flatnonzero(counts)
        counts = counts[keys]
    else:
        keys, counts = np.unique(keys, return_counts=True)
    names = [chr(x) for x in alphabet]
    for key, n in zip(keys.tolist(), counts.tolist(), strict=True):
        yield names[key // k // k] + names[key // k % k] + names[key % k], n


def restore(token: str, model: CharModel) -> str:
    """The cheapest reading of a disguised token.

    Of a run of symbols that can stand for any letter as many are looked at as can be letters in a cheapest reading;
    the others are fillers in any order, which cost every reading the same.
    """
    return cheapest(_HIDDEN_RUN.sub(lambda m: m[0][: model.most_hidden], token), model)


def cheapest(token: str, model: CharModel) -> str:
    """Viterbi over states (last two letters), at most some 700 after any step; a step per character."""
    states: dict[tuple[str, str], tuple[float, tuple | None]] = {("^^", ""): (0.0, None)}
    for c in token:
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, 0.0))
        options += [(x, COST["lookalike"]) for x in LOOKALIKES.get(c, "")]
        if c in ANY_LETTER:
            options += [(x, COST["any"]) for x in "abcdefghijklmnopqrstuvwxyz"]
        if c in FILLERS or c in ANY_LETTER:
            options.append(("", COST["filler"]))
        if not options:
            options.append(("", COST["literal"]))
        reached: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        for (context, last), (cost, path) in states.items():
            for letter, own in options:
                if letter:
                    found = (context[1] + letter, c), cost + own + model.cost(context, letter), (path, letter)
                else:
                    found = (context, last), cost + own, path
                if found[0] not in reached or found[1] < reached[found[0]][0]:
                    reached[found[0]] = found[1:]
            if c == last:  # the same character again may be a repetition of the one before
                found = (context, last), cost + COST["repeat"], path
                if found[0] not in reached or found[1] < reached[found[0]][0]:
                    reached[found[0]] = found[1:]
        states = reached
    _, path = min(((cost + model.cost(context, "$"), path) for (context, _), (cost, path) in states.items()), key=lambda x: x[0])
    letters = []
    while path is not None:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in BEGINNINGS if len(word) > n)]


class Reader:
    """Words of a text, disguised ones restored; readings of tokens are kept in a bounded memory."""

    def __init__(self, model: CharModel, kept: int = 60_000):
        self.model, self.kept, self.known = model, kept, {}

    def readings(self, token: str) -> tuple[str, ...]:
        word = plain(token)
        found = (word,) if word else ()
        # Some symbols that are trimmed at the edges may also be disguised letters.
        for form in dict.fromkeys((word, token.lstrip(EDGES_BEFORE).rstrip(EDGES_AFTER))):
            if form and len(form) > 2 and disguised(form):
                found += (restore(form, self.model),)
        return found

    def token(self, token: str) -> tuple[str, ...]:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= self.kept:
                self.known = {}
            found = self.known[token] = self.readings(token)
        return found

    def spaced(self, low: str) -> set[str]:
        """Words written with their letters apart: whole runs, and what lies between the wider gaps of a run."""
        out = set()
        if _MAY_BE_SPACED.search(low):
            for run in _SPACED.findall(low):
                out.add(restore(run, self.model))
                parts = _WIDE_GAP.split(run)
                if 1 < len(parts) < (len(run) + 1) // 2:
                    out.update(restore(x, self.model) for x in parts if len(x) > 2)
        return out

    def words(self, text: str) -> set[str]:
        low = text.lower()
        return {w for t in set(low.split()) for w in self.token(t)} | self.spaced(low)


class Scorer(Reader):
    """For each text the surest feature of each of its words; tokens' features are kept in a bounded memory."""

    def __init__(self, model: CharModel, weights: dict[str, float], kept: int = 120_000):
        super().__init__(model, kept)
        self.weights, self.starts = weights, {f[:4] for f in weights}

    def of_word(self, word: str) -> str:
        return min((f for f in features_of(word) if f in self.weights), key=self.weights.get, default="")

    def of_token(self, token: str) -> tuple[str, ...]:
        if token.isalpha() and token[:4] not in self.starts and not _REPEATED.search(token):
            found = ()
        else:
            found = tuple({f for w in self.readings(token) if (f := self.of_word(w))})
        if len(self.known) >= self.kept:
            self.known = {}
        self.known[token] = found
        return found

    def features(self, text: str) -> set[str]:
        low, get, found = text.lower(), self.known.get, set()
        for token in set(low.split()):
            own = get(token)
            if own is None:
                own, get = self.of_token(token), self.known.get
            if own:
                found.update(own)
        found.update(f for w in self.spaced(low) if (f := self.of_word(w)))
        return found


@dataclass
class Model:
    chars: CharModel
    #: feature -> log of the share of rows without the label among training rows that have it
    weights: dict[str, float]
    base: float


def char_model(docs: DataFrame) -> CharModel:
    """Character trigrams of the plain words of all texts, added up per task before they are grouped."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, int] = {}
        for stretch in stretches(text.as_py() for batch in batches for text in batch.column("text")):
            for gram, n in count_trigrams(stretch):
                grams[gram] = grams.get(gram, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(grams.keys(), pa.string()), pa.array(grams.values(), pa.int64())], ["gram", "n"])

    counted = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(released(count), "gram string, n long")
    summed = counted.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return CharModel(dict(zip(summed["gram"].to_pylist(), summed["n"].to_pylist(), strict=True)))


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = 30_000, least_rows: int = 4, least_precision: float = 0.9) -> Model:
    """Letters from all texts of ``docs``, features from a bounded sample of labelled rows that are not held out.

    The character model needs no labels: every text counts and no trigram is left out. It is bounded by its alphabet
    of 151 letters and two marks, 153 ** 3 counts, whatever the corpus. The
    sample (about ``train_rows``, by id hash) bounds the features of at least ``least_rows`` toxic rows, and those
    rows. A feature is kept if, near copies counted once, at least ``least_precision`` of its rows are toxic and its
    likelihood ratio stands out among all features tried.
    """
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(~held_out())
    share = min(1.0, train_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < share * (1 << 20))
    train = materialise(docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(chosen, "doc_id"), "toxicity-train")

    chars = char_model(docs)
    shared = docs.sparkSession.sparkContext.broadcast(chars)

    toxic_rows = copies_counted_once(train.where("toxic = 1"))

    def toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            for text, doc_id, group in zip(*(batch.column(c).to_pylist() for c in ("text", "doc_id", "group")), strict=True):
                found = sorted({f for w in reader.words(text) for f in features_of(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([x] * len(found), pa.int64()) for x in (doc_id, group))], ["feature", "doc_id", "group"])

    rows = toxic_rows.select("text", "doc_id", "group").mapInArrow(released(toxic_features), "feature string, doc_id long, group long")
    counted = rows.distinct().groupBy("feature").agg(F.count("*").alias("rows"), F.count_distinct("group").alias("n")).where(F.col("rows") >= least_rows)
    covers = {r["feature"]: r["n"] for r in counted.collect()}
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(covers))

    def clean_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(shared.value), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(wanted.value & {f for w in reader.words(text) for f in features_of(w)})
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["feature", "n"])

    clean = {r["feature"]: r["n"] for r in train.where("toxic = 0").select("text").mapInArrow(released(clean_counts), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, rest = sizes.get(1, 0), sizes.get(0, 0)
    prior = (toxic + 1) / (toxic + rest + 2)
    weights = {}
    for feature, n in covers.items():
        bad = clean.get(feature, 0)
        precision = (n + 0.5) / (n + bad + 1)
        gain = n * math.log(precision / prior) + bad * math.log((1 - precision) / (1 - prior))
        if precision >= least_precision and gain >= math.log(max(1, len(covers))) + 5:
            weights[feature] = math.log(1 - precision)
    return Model(chars, weights, math.log(1 - prior / 4))


def copy_bands(text: str, bands: int = 8, width: int = 4) -> list[int]:
    """Hashes of bands of minimum hashes of the word pairs: near copies share one almost surely, others hardly ever."""
    words = text.lower().split()
    pairs = np.fromiter({zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:] or [""])}, np.uint64)
    if not len(pairs):
        return []
    factors = np.random.default_rng(3).integers(1, 1 << 63, (bands * width, 1), dtype=np.uint64) | np.uint64(1)
    lowest = ((pairs + np.uint64(1)) * factors >> np.uint64(20)).min(axis=1).reshape(bands, width)
    return [zlib.crc32(row.tobytes(), i) for i, row in enumerate(lowest)]


def copies_counted_once(rows: DataFrame) -> DataFrame:
    """``rows`` with ``group``: the smallest doc_id that shares a band with the row, directly or through others."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(band, doc_id) for text, doc_id in zip(batch.column("text").to_pylist(), batch.column("doc_id").to_pylist(), strict=True) for band in copy_bands(text)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], ["band", "doc_id"])

    bands = materialise(rows.select("text", "doc_id").mapInArrow(released(cut), "band long, doc_id long"), "toxicity-bands")
    low = bands.groupBy("band").agg(F.min("doc_id").alias("low"))
    groups = connected_components(bands.join(low, "band").select(F.col("doc_id").alias("u"), F.col("low").alias("v")))
    return rows.join(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("group")), "doc_id", "left").withColumn("group", F.coalesce("group", "doc_id"))


def score_texts(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` with tox_score (0 to 1, higher: likelier toxic) and tox_words (features found).

    The surest feature of each word counts; those of several words combine as independent signs (noisy or). Null and empty texts get the score of a text
    without any. Repeated rows stay; columns of ``keep`` that clash with the two are left out.
    """
    keep = [c for c in keep if c not in ("tox_score", "tox_words")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col("text").alias("__text"))
    fields = StructType([*source.drop("__text").schema.fields, *StructType.fromDDL("tox_score double, tox_words array<string>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model.chars, model.weights)
        for batch in batches:
            scores, words = [], []
            for text in batch.column("__text").to_pylist():
                found = scorer.features(text or "")
                scores.append(1 - math.exp(model.base + sum(model.weights[f] for f in sorted(found))))
                words.append(sorted(found))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64()), pa.array(words, pa.list_(pa.string()))], [*keep, "tox_score", "tox_words"])

    return source.mapInArrow(released(run), fields)


THRESHOLD = 0.7


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``, learned from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"))
