"""Chat formatting: token-level assembly of conversations with reserved ids and a loss mask.

Every turn becomes separately encoded segments (a role name where it is not a reserved one, and the text).
Reserved ids, which lie above the tokenizer's own, are spliced between the segments, so no text can ever
produce one. The loss mask is derived from prefix sums of segment lengths. The text form of the same
conversation uses the control strings below. Inside content, backslashes that stand before a control string or
at the end are doubled, and one more is put before the string: a control string of the template thus has an even
number of backslashes before it, one of the content an odd number. ``parse_text`` reads the text form back.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings of the template; the id of number i is the tokenizer's size + i.
CONTROLS = ("### System:", "### User:", "### Assistant:", "### Other:", "</role>", "</turn>")
NAMED_ROLES = {"system": 0, "user": 1, "assistant": 2}
OTHER, END_ROLE, END_TURN = 3, 4, 5
LEARNED_ROLE = "assistant"

_CONTROL = "|".join(map(re.escape, CONTROLS))
_RUN = re.compile(rf"(\\*)({_CONTROL})|(\\+)\Z")


def escape(text: str) -> str:
    return _RUN.sub(lambda m: f"{m[1] * 2}\\{m[2]}" if m[2] else m[3] * 2, text)


def unescape(text: str) -> str:
    return _RUN.sub(lambda m: m[1][: len(m[1]) // 2] + m[2] if m[2] else m[3][: len(m[3]) // 2], text)


def turns_of(pieces: Iterable[tuple[int, str]]) -> list[tuple[str, str]]:
    """(role, text) of each turn from pieces (number of a control string, escaped content behind it)."""
    turns, names, role = [], list(NAMED_ROLES), ""
    for kind, content in pieces:
        if kind == OTHER:
            role = unescape(content)
        elif kind != END_TURN:
            turns.append((names[kind] if kind < OTHER else role, unescape(content)))
    return turns


def parse_text(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of the text form."""
    marks = [m for m in _RUN.finditer(text) if m[2] and len(m[1]) % 2 == 0]
    bounds = [*(m.start(2) for m in marks[1:]), len(text)]
    return turns_of((CONTROLS.index(m[2]), text[m.end() : end]) for m, end in zip(marks, bounds, strict=True))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    return tokenizer, tokenizer.get_vocab_size(with_added_tokens=True)


def _assemble(segments: list[tuple[object, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Segments (ids, learned) in order -> the ids, and the mask from prefix sums of the lengths."""
    ends = np.cumsum([len(x) for x, _ in segments])
    steps = np.zeros(int(ends[-1]) + 1, np.int8)
    for (ids, learned), end in zip(segments, ends, strict=True):
        if learned and len(ids):
            steps[end - len(ids)] += 1
            steps[end] -= 1
    return np.concatenate([np.asarray(x, np.int32) for x, _ in segments]), np.cumsum(steps[:-1], dtype=np.int8)


def _encoded(path: str, batches: Iterator[pa.RecordBatch], together: int = 256) -> Iterator[tuple]:
    """(conv_id, block, role, role ids, text ids) of every turn, in the order given."""
    tokenizer, _ = _tokenizer(path)

    def ids(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    for batch in batches:
        for i in range(0, batch.num_rows, together):
            part = batch.slice(i, together)
            roles = [x or "" for x in part.column("role").to_pylist()]
            names = ids([escape(x) if x not in NAMED_ROLES else "" for x in roles])
            texts = ids([escape(x or "") for x in part.column("text").to_pylist()])
            yield from zip(part.column("conv_id").to_pylist(), part.column("block").to_pylist(), roles, names, texts, strict=True)


def _splice(path: str, part_tokens: int):
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int64()), ("input_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, base = _tokenizer(path)
        for (conv_id, block), rows in groupby(_encoded(path, batches), key=lambda row: row[:2]):
            part, n_turns, size, segments = 0, 0, 0, []

            def out(conv_id=conv_id, block=block):
                ids, mask = _assemble(segments)
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([conv_id], [block], [part], [n_turns], [ids], [mask]), schema.types, strict=True)], schema=schema)

            for _, _, role, role_ids, text_ids in rows:
                control = NAMED_ROLES.get(role, OTHER)
                segments.append(([base + control], False))
                if control == OTHER:
                    segments += [(role_ids, False), ([base + END_ROLE], False)]
                segments += [(text_ids, role == LEARNED_ROLE), ([base + END_TURN], False)]
                n_turns, size = n_turns + 1, size + len(text_ids)
                if size >= part_tokens:
                    yield out()
                    part, n_turns, size, segments = part + 1, 0, 0, []
            if segments:
                yield out()

    return run


def format_conversations(turns: DataFrame, tokenizer: str | None = None, part_tokens: int = 1 << 20, block_turns: int = 4096) -> DataFrame:
    """Conversations as token ids with a loss mask: (conv_id, block, part, n_turns, input_ids, loss_mask).

    ``turns``: one row per turn with conv_id, turn, role, text; other columns are ignored. A conversation is one
    row. Turn numbers from another multiple of ``block_turns`` on make another ``block``, and beyond
    ``part_tokens`` tokens a block is several rows (``part`` 0, 1, ...) that each hold whole turns. Blocks are
    dealt by ranges, so a hot conversation is spread over tasks, and no row grows with it. Null text or role:
    empty. Roles other than the three named: kept, behind "### Other:". Null turns come first, equal ones in
    order of role and content; repeated rows stay; a null conv_id is one conversation. An empty table gives no row.
    """
    path = tokenizer or default_tokenizer()
    rows = turns.select("conv_id", F.floor(F.col("turn") / block_turns).alias("block"), "turn", "role", "text")
    ordered = rows.repartitionByRange("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    return ordered.mapInArrow(_splice(path, part_tokens), "conv_id long, block long, part int, n_turns long, input_ids array<int>, loss_mask array<tinyint>")


def parse_part(ids: np.ndarray, mask: np.ndarray, path: str) -> tuple[list[tuple[str, str]], list[str], str]:
    """Of one row of ``format_conversations``: its turns (role, text), texts under the mask, and the text form."""
    tokenizer, base = _tokenizer(path)
    at = np.flatnonzero(ids >= base)
    bounds = list(zip(at.tolist(), [*at[1:].tolist(), len(ids)], strict=True))
    kinds = (ids[at] - base).tolist()
    contents = tokenizer.decode_batch([ids[i + 1 : j].tolist() for i, j in bounds], skip_special_tokens=False)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
    learned = tokenizer.decode_batch([ids[i:j].tolist() for i, j in edges.reshape(-1, 2)], skip_special_tokens=False)
    pieces = list(zip(kinds, contents, strict=True))
    return turns_of(pieces), [unescape(x) for x in learned], "".join(CONTROLS[k] + c for k, c in pieces)


def _parse(path: str):
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.int64()), ("turns", pa.binary()), ("learned", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                turns, learned, text = parse_part(batch.column("input_ids")[i].values.to_numpy(), batch.column("loss_mask")[i].values.to_numpy(), path)
                said = "".join(f"{role}\n{content}\n" for role, content in turns).encode()
                found = ([len(turns)], [len(text)], [said], ["".join(learned)])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("conv_id", "block", "part")), *(pa.array(x, t) for x, t in zip(found, schema.types[3:], strict=True))], schema=schema)

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema([(n, pa.string() if n.endswith("256") else pa.int64()) for n in names])
    parts = (row for batch in batches for row in zip(*(batch.column(c) for c in ("conv_id", "n_turns", "formatted", "turns", "learned")), strict=True))
    rows: list[tuple] = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    for conv_id, group in groupby(parts, key=lambda x: x[0].as_py()):
        turns_hash, loss_hash, n_turns, loss_chars, formatted = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for _, n, size, said, learned in group:
            turns_hash.update(said.as_buffer())
            loss_hash.update(learned.as_buffer())
            n_turns, formatted, loss_chars = n_turns + n.as_py(), formatted + size.as_py(), loss_chars + len(learned.as_py())
        rows.append((conv_id, n_turns, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), formatted))
        if len(rows) == 1000:
            yield out()
            rows.clear()
    if rows:
        yield out()


def read_back(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Digests of what the ids and masks of ``format_conversations`` decode to, a row per conversation.

    Rows are decoded where they lie; only the digests, which are sequential, read a conversation in one task.
    """
    path = tokenizer or default_tokenizer()
    parsed = formatted.select("conv_id", "block", "part", "input_ids", "loss_mask").mapInArrow(_parse(path), "conv_id long, block long, part int, n_turns long, formatted long, turns binary, learned string")
    ordered = parsed.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
    return ordered.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = r"\### Assistant: </turn> ok"


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """All of ``conversations`` and conversation -7, formatted and read back."""
    from .common import table

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(format_conversations(turns.unionByName(planted)))


_PLAIN = "|".join(CONTROLS)
#: The digests and lengths from the table itself; escaping only lengthens texts, which one regular expression shows.
ORACLE = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, x.turn, x.role, '{PROBE}' from (values (0, 'user'), (1, 'assistant')) x(turn, role)),
e as (
  select *, length(regexp_replace(regexp_replace(text, '(\\*)({_PLAIN})', '\1\1\\\2', 'g'), '(\\+)$', '\1\1')) as n_text,
    case role when 'system' then length('### System:') when 'user' then length('### User:') when 'assistant' then length('### Assistant:')
      else length('### Other:</role>') + length(regexp_replace(regexp_replace(role, '(\\*)({_PLAIN})', '\1\1\\\2', 'g'), '(\\+)$', '\1\1')) end + length('</turn>') as n_marks
  from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn nulls first, role, text)) as loss_sha256,
  sum(n_text + n_marks)::bigint as formatted_chars
from e group by conv_id
"""
