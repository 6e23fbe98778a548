"""Secret scanning with corpus-wide ownership frequency, in DataFrame expressions only.

Base detectors find assignments, access keys and hex runs. In addition every random-looking token is a candidate:
its hash is aggregated over the whole corpus by distinct repositories (documents) and distinct owners (sources).
A value that many owners or many repositories hold is a widely copied example; one that few of both hold looks
like a live credential of its owner, and a candidate of that kind outside the base spans is added as a span of kind ``owned``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import let

from .common import materialise, text_or_empty

# Kinds in order, their patterns, the group that is the value, and its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16))
CANDIDATE = r"[A-Za-z0-9_+=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")

SPAN = "struct<start:int,kind:int,end:int,hash:string>"


def _blocks(items: Column, of, rows: int = 256) -> Column:
    """``of`` each slice of at most ``rows`` items."""
    return let(items, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(rows)), lambda i: of(F.slice(x, i, rows))))


def _scan(items: Column, carry: Column, step, out: str) -> Column:
    """What ``step(carry, item)``, a pair of the next carry and an out, puts out item by item; null outs are left out.

    Appending copies a list, so outs are appended to lists of a block each, which are joined at the end: a text
    with 100,000 matches copies no list of that size. The carry over a block is folded by itself, without outs.
    """
    none = F.array().cast(f"array<{out}>")

    def one(state: Column, x: Column) -> Column:
        after, found = step(state["carry"], x)
        return F.struct(after.alias("carry"), F.concat(state["found"], F.filter(F.array(found), lambda y: y.isNotNull())).alias("found"))

    def block(state: Column, part: Column) -> Column:
        after = F.aggregate(part, state["carry"], lambda at, x: step(at, x)[0])
        found = F.aggregate(part, F.struct(state["carry"].alias("carry"), none.alias("found")), one, lambda y: y["found"])
        return F.struct(after.alias("carry"), F.array_append(state["lists"], found).alias("lists"))

    start = F.struct(carry.alias("carry"), F.array().cast(f"array<array<{out}>>").alias("lists"))
    return F.aggregate(_blocks(items, lambda part: part), start, block, lambda state: F.flatten(state["lists"]))


def _found(kind: int, pattern: str, group: int, least: int, also: str = "true") -> Column:
    """Spans of one kind in column ``text``: pieces between matches and the matches give the places.

    The pieces and matches are computed once per row and only for rows that have a match at all.
    """
    text, p = F.col("text"), F.lit(pattern)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, p, F.lit(0)).alias("w"), F.regexp_extract_all(text, p, F.lit(group)).alias("v"))
    fields = parts.cast("array<struct<p:string,w:string,v:string>>")

    def step(pos: Column, x: Column) -> tuple[Column, Column]:
        start = pos + F.char_length(x["p"])
        end = start + F.coalesce(F.char_length(x["w"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.sha2(x["v"], 256).alias("hash"))
        keep = x["w"].isNotNull() & (F.char_length(x["v"]) >= least) & _also(x["v"], also)
        return end, F.when(keep, span)

    return F.when(text.rlike(pattern), _scan(fields, F.lit(0), step, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _apart(tokens: Column, base: Column) -> Column:
    """Tokens that overlap no base span: a sweep over both by start, and one back, each with the nearest base end or start."""
    is_base, is_token = (lambda s: s["kind"] < 3), (lambda s: s["kind"] == 3)
    ahead = lambda end, s: (F.when(is_base(s), F.greatest(end, s["end"])).otherwise(end), F.when(is_token(s) & (end <= s["start"]), s))
    back = lambda start, s: (F.when(is_base(s), s["start"]).otherwise(start), F.when(is_token(s) & (start >= s["end"]), s))
    free = _scan(F.array_sort(F.concat(base, tokens)), F.lit(0), ahead, SPAN)
    free = _scan(F.reverse(F.array_sort(F.concat(base, free))), F.lit(2**31 - 1), back, SPAN)
    return F.when((F.size(base) > 0) & (F.size(tokens) > 0), free).otherwise(tokens)


def _also(value: Column, rule: str) -> Column:
    if rule == "random":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
    return F.lit(True)


def _joined(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, repo: str = "doc_id", owner: str = "source", max_owners: int = 2, min_copies: int = 3, max_repos: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key (MD5 of the text), base and added spans, and counts by ownership.

    Spans are in code points, end exclusive, ordered by start and kind. A hash held by one to ``max_owners`` distinct
    owners and by at most ``max_repos`` repositories looks live. One in more repositories is a copied example, whoever
    owns them, as is one in at least ``min_copies`` repositories of more owners. One without any known owner is never
    live. Null text: empty, no spans. A null repository or owner counts as none. Repeated rows each get their spans
    and count as one repository. Other columns are ignored; an empty table gives no row.

    Texts are read once: spans and hashes are written to shared storage without the texts, and frequencies,
    pre-aggregated per hash and owner, are joined to that small table. A hot value is a skewed join key that
    Spark splits; no group of occurrences is ever gathered.
    """
    base = F.array_sort(reduce(lambda a, b: F.concat(a, b), [_found(i, *kind[1:]) for i, kind in enumerate(BASE)]))
    texts = docs.select("doc_id", F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), text_or_empty().alias("text"))
    scanned = materialise(
        texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repo", "owner", F.md5("text").alias("text_key"), base.alias("base"), _found(3, CANDIDATE, 0, 20, "random").alias("tokens")),
        "secret-spans",
    )
    scanned = scanned.withColumn("tokens", _apart(F.col("tokens"), F.col("base")))
    seen = scanned.select("row", "repo", "owner", F.explode(F.concat("base", "tokens")).alias("span")).select("row", "repo", "owner", "span", F.col("span.hash").alias("hash"))
    frequency = seen.groupBy("hash").agg(F.countDistinct("repo").alias("repos"), F.countDistinct("owner").alias("owners"))
    live = F.col("owners").between(1, max_owners) & (F.col("repos") <= max_repos)
    copied = (F.col("repos") > max_repos) | (F.col("owners") > max_owners) & (F.col("repos") >= min_copies)
    added = (F.col("span.kind") == 3) & live
    judged = seen.join(frequency, "hash", "left").groupBy("row").agg(F.collect_list(F.when(added, F.col("span"))).alias("owned"), F.count_if((F.col("span.kind") < 3) & live).alias("n_live"), F.count_if(copied).alias("n_copied"))
    spans = F.array_sort(F.concat("base", F.coalesce("owned", F.array().cast(f"array<{SPAN}>"))))
    return (
        scanned.join(judged, "row", "left")
        .select("doc_id", "text_key", "base", spans.alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))
    )


def redact(docs: DataFrame, found: DataFrame, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every span of ``found`` replaced by ``mark``; overlapping spans are replaced as one.

    ``found`` comes from ``scan_secrets`` over the same rows. Spans depend on the text and the corpus alone, so
    they are joined by the text's key. Only texts that match some pattern at all reach that join; the others stay
    as they are, null included, and are not shuffled. n_chars, where it exists, follows the new text.
    """
    cuts = found.where(F.size("spans") > 0).groupBy("text_key").agg(F.first("spans").alias("__spans"))
    text = F.col("text")

    def step(pos: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(pos, s["end"]), F.when(s["start"] >= pos, F.struct(pos.alias("at"), s["start"].alias("to")))

    def piece(gaps: Column) -> Column:
        # A place is found by counting characters from a text's start: gaps are cut from their block's own part.
        first = F.element_at(gaps, 1)["at"]
        part = F.struct(first.alias("at"), F.substring(text, first + 1, F.element_at(gaps, -1)["to"] - first).alias("text"))
        return let(part, lambda own: F.array_join(F.transform(gaps, lambda g: F.concat(F.substring(own["text"], g["at"] - own["at"] + 1, g["to"] - g["at"]), F.lit(mark))), ""))

    rest = F.aggregate("__spans", F.lit(0), lambda pos, s: F.greatest(pos, s["end"]))
    pieces = _blocks(_scan(F.col("__spans"), F.lit(0), step, "struct<at:int,to:int>"), lambda gaps: let(gaps, piece))
    whole = F.concat(F.array_join(pieces, ""), let(rest, lambda pos: F.substring(text, pos + 1, F.char_length(text))))
    may = F.coalesce(reduce(lambda a, b: a | b, [text.rlike(p) for _, p, _, _ in BASE] + [text.rlike(CANDIDATE)]), F.lit(False))
    joined = docs.where(may).withColumn("__key", F.md5("text")).join(materialise(cuts, "secret-cuts").withColumnRenamed("text_key", "__key"), "__key", "left")
    out = joined.withColumn("text", F.when(F.col("__spans").isNull(), text).otherwise(whole))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(*docs.columns).unionByName(docs.where(~may))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of ``documents``."""
    from .common import table

    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "n_live", "n_copied")
