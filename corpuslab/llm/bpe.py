"""Byte-level BPE with word ends: encoding by a contiguous rank array per word, and decoding.

A text is normalised, cut into words, and each frequent word is encoded once per worker: its part boundaries and
the ranks of adjacent parts lie in two short arrays; the smallest rank is looked up by a scan, the boundary
behind it is deleted, and the two ranks beside the gap are refreshed, until no adjacent pair has a rank.
Tokenizer files are read, never trained or copied.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

NO_RANK = 1 << 60
#: Words up to so many characters are merged by scanning and are cached.
SHORT = 256
#: Code points of the planes that may hold letters, digits or cases; the others are private or empty in all versions.
PLANES = [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xF0000)]


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next free character from U+0100."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    shifted = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(shifted)) for b in range(256)}


def _ranges(points: list[int]) -> str:
    """The inside of a bracket expression that holds just these code points, given in order."""
    out: list[list[int]] = []
    for x in points:
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Characters:
    """Classes, lower case and normal form of characters as the tokenizers library has them, asked once per worker.

    Python's tables are of another Unicode version; they serve where both agree. Normal forms of characters that
    both know never change between versions; texts with others are normalised by the library.
    """

    def __init__(self):
        from tokenizers import Regex, normalizers, pre_tokenizers

        self.blocks = ["".join(map(chr, PLANES[i : i + 4096])) for i in range(0, len(PLANES), 4096)]
        self.cut = lambda pattern: pre_tokenizers.Split(Regex(pattern), "removed")
        lower = normalizers.Lowercase()
        self.nfc = normalizers.NFC().normalize_str
        #: Characters whose lower case is not Python's, and its lower case here.
        self.lowered = {}
        for block in self.blocks:
            own = block.replace(" ", "")
            self.lowered.update((ord(c), low) for c, low in zip(own, lower.normalize_str(" ".join(own)).split(" "), strict=True) if low != c.lower())
        unknown = [x for x in PLANES if self._apart(chr(x))]
        #: By code point: 1 if only the library knows its normal form.
        self.unknown = bytearray(0x110000)
        for x in unknown:
            self.unknown[x] = 1
        #: Texts without a character from the first such one on need no further look.
        self.rare = re.compile(f"[^\\x00-\\U{min([*unknown, *self.lowered, 0x10FFFF]) - 1:08x}]")
        self.white = self.of(r"\s")
        white = set(map(chr, self.points(r"\s")))
        #: Where str.split cuts and the library's white space does not, or the other way round.
        differing = [x for x in PLANES if (chr(x) in white) != chr(x).isspace()]
        self.separators = re.compile(f"[{_ranges(differing)}]") if differing else None
        self.spaces = re.compile(f"[{self.white}]+")

    def _apart(self, c: str) -> bool:
        """Whether one of the two may not know this character's place in normal forms."""
        if unicodedata.category(c) == "Cn":
            return True
        tries = [c + "\u0334", "\u0345" + c] if unicodedata.combining(c) else []
        if unicodedata.decomposition(c)[:1] not in ("", "<"):
            tries.append(unicodedata.normalize("NFD", c))
        return any(self.nfc(x) != unicodedata.normalize("NFC", x) for x in tries)

    def points(self, member: str) -> list[int]:
        cut = self.cut(f"[^{member}]+")
        return sorted(ord(c) for block in self.blocks for piece, _ in cut.pre_tokenize_str(block) for c in piece)

    def of(self, member: str) -> str:
        return _ranges(self.points(member))

    def compiled(self, pattern: str) -> re.Pattern:
        """``pattern``, whose classes all stand in brackets, over the library's classes."""
        for member in dict.fromkeys(re.findall(r"\\p\{\w+\}|\\s", pattern)):
            pattern = pattern.replace(member, self.of(member))
        return re.compile(pattern)

    def normal(self, text: str) -> str:
        """The normal form C in lower case, each letter lowered by itself."""
        if not text.isascii():
            rare = set(map(ord, text)) if self.rare.search(text) else ()
            text = self.nfc(text) if any(map(self.unknown.__getitem__, rare)) else unicodedata.normalize("NFC", text)
            if rare:
                text = text.translate(self.lowered)
        # Of all letters only the capital sigma is lowered by its place in str.lower.
        return "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()

    def split(self, text: str) -> list[str]:
        return self.spaces.split(text) if self.separators and self.separators.search(text) else text.split()


@lru_cache(maxsize=1)
def characters() -> Characters:
    return Characters()


class WordBpe:
    """One tokenizer file of the kind BPE with word ends; ``encode`` and ``decode`` as its library does."""

    def __init__(self, path: str, cached: int = 200_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that take neighbouring characters or are looked for in normal forms are not supported")
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"])
        ids = self.vocab
        #: (left id, right id) -> rank, and the id of the part that the merge of a rank makes
        self.ranks, self.merged = {}, []
        for rank, (a, b) in enumerate(pairs):
            self.ranks[ids[a], ids[b]] = rank
            self.merged.append(ids[a + b])
        letters = byte_letters()
        self.inner = [ids.get(letters[b]) for b in range(256)]
        self.last = [ids.get(letters[b] + self.suffix) for b in range(256)]
        self.pieces = {i: piece for piece, i in {**self.vocab, **self.added}.items()}
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.characters = characters()
        self.words = self.characters.compiled(split["pattern"]["Regex"])
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.cached, self.cache, self.older = cached, {}, {}

    def forget(self) -> None:
        self.cache, self.older = {}, {}

    def _merge(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        parts = [*(self.inner[b] for b in raw[:-1]), self.last[raw[-1]]]
        if None in parts:
            parts = [x for x in parts if x is not None]
        get, merged = self.ranks.get, self.merged
        ranks = [get(pair, NO_RANK) for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NO_RANK:
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NO_RANK)
        return tuple(parts)

    def _kept(self, part: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        """``ids``, remembered for short parts in a memory of two bounded generations."""
        if len(part) <= SHORT:
            if len(self.cache) >= self.cached:
                self.older, self.cache = self.cache, {}
            self.cache[part] = ids
        return ids

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a stretch without white space; of those that are several words only the words are remembered."""
        words = self.words.findall(chunk)
        return self.word(chunk) if words == [chunk] else tuple(chain.from_iterable(map(self.word, words)))

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.cache.get(word)
        if ids is None:
            ids = self.older.get(word)
            ids = self._kept(word, self._whole(word) if ids is None else ids)
        return ids

    def _whole(self, word: str) -> tuple[int, ...]:
        return self._merge(word) if len(word) <= SHORT else self._merge_long(word)

    def _merge_long(self, word: str) -> tuple[int, ...]:
        """The same merges for an overlong word, with a queue of ranks in place of the scan, whose cost is quadratic."""
        import heapq

        raw = word.encode()
        parts = [x for x in [*(self.inner[b] for b in raw[:-1]), self.last[raw[-1]]] if x is not None]
        n, get = len(parts), self.ranks.get
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        queue = [(rank, i, pair) for i, pair in enumerate(zip(parts, parts[1:])) if (rank := get(pair)) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, pair = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i], alive[j], after[i] = self.merged[rank], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (rank := get(pair := (parts[left], parts[after[left]]))) is not None:
                    heapq.heappush(queue, (rank, left, pair))
        return tuple(x for x, y in zip(parts, alive, strict=True) if y)

    def _plain(self, text: str) -> list[tuple[int, ...]]:
        # No word spans white space.
        out, chunks = [], self.characters.split(self.characters.normal(text))
        cache, chunk = self.cache, self.chunk
        for c in chunks:
            ids = cache.get(c)
            if ids is None:
                ids = chunk(c)
                cache = self.cache
            out.append(ids)
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; strings of the file's added tokens in it stand for those tokens."""
        if not any(x in text for x in self.added) or len(pieces := self.special.split(text)) == 1:
            found = self._plain(text)
        else:
            found = []
            for piece in pieces:
                found += [(self.added[piece],)] if piece in self.added else self._plain(piece)
        return np.fromiter(chain.from_iterable(found), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The pieces with a space between: the file names no decoder, so nothing else is undone."""
        return " ".join(map(self.pieces.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _text_of(batch: pa.RecordBatch) -> Iterator[str]:
    return (x.as_py() or "" for x in batch.column("text"))


def encode_texts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text. Null text: empty, no ids. Repeated rows stay, a null id too."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = [bpe.encode(x).astype(np.int32) for x in _text_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids array<int>); null ids: an empty text."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(np.asarray(x.as_py() or [], np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Digests per row of ``docs``: n_tokens, ids_sha256, decoded_sha256; ids never leave the task that made them."""
    path = tokenizer or default_tokenizer()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            counts, digests, decoded = [], [], []
            for text in _text_of(batch):
                ids = bpe.encode(text)
                counts.append(len(ids))
                digests.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded."""
    from .common import table

    return round_trip(table(spark, sf_dir, "documents"))
