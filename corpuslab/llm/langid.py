"""Language identification of words and spans: script ranges, character trigrams and Viterbi over words.

The script of a word's first letter narrows the languages it may belong to (those that were learned with enough
letters of that script). Each word gets a score per candidate: the log-probabilities of its hashed character
trigrams. Viterbi with a penalty for switching then labels every word, so a text of several languages falls into
spans; the text's language is the one that labels most of its letters. Ties: a word keeps the language of the word
before it where switching is not better; languages that tie otherwise go to the first by name.
"""

from __future__ import annotations


from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import held_out, released, table

BUCKETS = 1 << 16
UNKNOWN = "und"

# Unicode ranges of scripts; letters outside of them form one script of their own.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("latin", 0x2C60, 0x2C7F), ("latin", 0xFF21, 0xFF5A),
    ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F), ("cyrillic", 0x1C80, 0x1C8F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFC),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F),
    ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F),
    ("georgian", 0x10A0, 0x10FF), ("ethiopic", 0x1200, 0x139F), ("khmer", 0x1780, 0x17FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF), ("kana", 0x31F0, 0x31FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x323AF),
)
NAMES = ("other", *dict.fromkeys(name for name, _, _ in SCRIPTS))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower-case letter, 0 if it is no letter; and its script's number."""
    fold, script = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            fold[c] = ord(low) if len(low) == 1 else c
    for name, first, last in SCRIPTS:
        script[first : last + 1] = NAMES.index(name)
    return fold, script


@dataclass
class Words:
    """Words of a stretch of code points: start, end, hashed trigrams by letter, and script."""

    starts: np.ndarray
    ends: np.ndarray
    buckets: np.ndarray
    firsts: np.ndarray
    scripts: np.ndarray


def words_of(codes: np.ndarray) -> Words:
    fold, script = _tables()
    f = np.zeros(len(codes) + 2, np.uint32)
    f[1:-1] = fold[codes]
    at = np.flatnonzero(f[1:-1])
    before, own, after = f[at], f[at + 1], f[at + 2]
    mixed = (before * np.uint32(0x9E3779B1)) ^ (own * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    firsts = np.flatnonzero(before == 0)
    starts, ends = at[firsts], at[after == 0] + 1
    return Words(starts, ends, mixed >> np.uint32(16), firsts, script[codes[starts]] if len(starts) else np.zeros(0, np.uint8))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Model:
    languages: list[str]
    #: bucket -> log-probability by language
    scores: np.ndarray
    #: script -> may the language be written in it
    allowed: np.ndarray
    penalty: float


def learn(docs: DataFrame, docs_per_language: int = 2000, penalty: float = 6.0, least_share: float = 0.001) -> Model:
    """Trigram and script counts of a bounded sample: about ``docs_per_language`` rows of each learned language.

    Learns only from text and non-null lang of rows that are not held out; the sample is the share of rows with
    the smallest hashes of their ids. What reaches the driver is bounded by languages x 65,536 counts.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool), penalty)
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, docs_per_language / sizes[name]))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                found = words_of(code_points(text))
                own = grams.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                own[:BUCKETS] += np.bincount(found.buckets, minlength=BUCKETS)
                own[BUCKETS:] += np.bincount(found.scripts, weights=found.ends - found.starts, minlength=len(NAMES)).astype(np.int64)
        for lang, own in grams.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], schema=schema)

    counted = chosen.select("text", "lang").mapInArrow(released(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS + len(NAMES), len(languages)))
    counts[counted["bucket"], [languages.index(x) for x in counted["lang"]]] = counted["n"]
    grams, letters = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
    allowed = letters >= least_share * np.maximum(letters.sum(axis=0), 1)
    return Model(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), allowed & (letters > 0), penalty)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word of many texts at once; ``scores``: words of all texts in a row, by language."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes, n = lengths[order], int(lengths.max(initial=0))
    active = np.searchsorted(-sizes, -np.arange(n), side="left")  # texts with more than t words
    back = np.zeros(scores.shape, np.uint8 if scores.shape[1] < 256 else np.uint16)
    own = np.arange(scores.shape[1])[None, :]
    value = np.zeros((len(sizes), scores.shape[1]), np.float64)
    for t in range(n):
        m = active[t]
        before, at = value[:m], starts[:m] + t
        best = before.argmax(axis=1)[:, None]
        switched = np.take_along_axis(before, best, 1) - penalty
        stay = before >= switched
        back[at] = np.where(stay, own, best)
        value[:m] = np.where(stay, before, switched) + scores[at]
    labels = np.zeros(len(scores), back.dtype)
    current = value.argmax(axis=1)
    for t in range(n - 1, -1, -1):
        m = active[t]
        at = starts[:m] + t
        labels[at] = current[:m]
        current[:m] = back[at, current[:m]]
    return labels


def label_texts(texts: list[str], model: Model, spans: bool = False) -> tuple[list[str], list[float], list[list[dict]] | None]:
    """Language, share of letters so labelled, and spans (start, end, lang in code points) of each text."""
    pieces, lengths, starts, ends = [], [], [], []
    for group in _groups(texts, 1 << 18):
        codes = [code_points(x) for x in group]
        joined = np.concatenate([y for x in codes for y in (x, np.array([10], np.uint32))]) if codes else np.zeros(0, np.uint32)
        found = words_of(joined)
        begins = np.cumsum([0, *(len(x) + 1 for x in codes)])
        text_of = np.searchsorted(begins, found.starts, side="right") - 1
        lengths.append(np.bincount(text_of, minlength=len(group)))
        starts.append(found.starts - begins[text_of])
        ends.append(found.ends - begins[text_of])
        if len(found.starts):
            scores = np.add.reduceat(model.scores[found.buckets], found.firsts, axis=0)
            allowed = model.allowed[found.scripts]
            scores[~allowed & allowed.any(axis=1)[:, None]] = -1e9
            pieces.append(scores)
    sizes = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    scores = np.concatenate(pieces) if pieces else np.zeros((0, len(model.languages)), np.float32)
    labels = viterbi(scores, sizes, model.penalty)
    starts_, ends_ = np.concatenate(starts) if starts else np.zeros(0, np.int64), np.concatenate(ends) if ends else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    letters = np.zeros((len(texts), len(model.languages)))
    np.add.at(letters, (owner, labels), ends_ - starts_)
    total = letters.sum(axis=1)
    best = letters.argmax(axis=1)
    names = [model.languages[b] if t else UNKNOWN for b, t in zip(best, total, strict=True)]
    shares = [float(letters[i, b] / t) if (t := total[i]) else 0.0 for i, b in enumerate(best)]
    if not spans:
        return names, shares, None
    out: list[list[dict]] = [[] for _ in texts]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(labels.astype(int)) != 0)))) if len(owner) else []
    for i, j in zip(new, [*new[1:], len(owner)], strict=True):
        out[owner[i]].append({"start": int(starts_[i]), "end": int(ends_[j - 1]), "lang": model.languages[labels[i]]})
    return names, shares, out


def _groups(texts: list[str], size: int) -> Iterator[list[str]]:
    group, held = [], 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), spans: bool = True, rows: int = 2048) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred, lang_score and (``spans``) lang_spans of the whole text.

    Null texts and texts without a letter: ``und``, score 0, no spans; so is every text if nothing was learned.
    Repeated rows stay. At most ``rows`` rows are worked on at once. Columns of ``keep`` that clash with the three are left out.
    """
    added = ["lang_pred", "lang_score", *["lang_spans"] * spans]
    keep = [c for c in keep if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    batch_chars = max(1 << 18, (1 << 24) // max(1, len(model.languages)))
    source = docs.select(*keep, F.col("text").alias("__text"))
    ddl = "lang_pred string, lang_score double" + ", lang_spans array<struct<start:int,end:int,lang:string>>" * spans
    fields = StructType([*source.drop("__text").schema.fields, *StructType.fromDDL(ddl).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in (whole.slice(i, rows) for whole in batches for i in range(0, whole.num_rows, rows)):
            texts = [x or "" for x in batch.column("__text").to_pylist()]
            names, shares, found = [], [], []
            for group in _groups(texts, batch_chars):
                if model.languages:
                    a, b, c = label_texts(group, model, spans)
                else:
                    a, b, c = [UNKNOWN] * len(group), [0.0] * len(group), [[] for _ in group]
                names, shares, found = names + a, shares + b, found + (c or [])
            columns = [batch.column(c) for c in keep] + [pa.array(names, pa.string()), pa.array(shares, pa.float64())]
            if spans:
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, [*keep, *added])

    return source.mapInArrow(released(run), fields)


def op4_language(spark, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.drop("lang"), learn(docs), spans=True)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").alias("n_spans"))
