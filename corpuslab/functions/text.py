"""Column expressions over texts: normalising, tokenising, cutting, labelling. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word lists, markers and patterns of the normalisers and labels.
STOPWORDS = ("a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or")
ARTICLES = ("a", "an", "the")
UNITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
SCAFFOLD_MARKERS = ("<think>", "</think>", "<|im_start|>", "<|im_end|>", "assistant\n", "user\n")
ROLE_LINE = r"(?m)^\s*(system|user|assistant)\s*$"
CODE_LINE = r"(?m)^\s*(def |class |import |from \s*\S+\s+import|#include|public |function |fn |printf\s*\(|using namespace)"
CODE_TAIL = r"[{};]\s*$"
JSON_SHAPE = r'^\s*[\[{]\s*"?[\w\-]+"?\s*:'
REFUSAL = r"(?i)(i'?m sorry|i am sorry|i cannot|i can'?t|as an ai|i'?m not able|i don'?t know|unable to answer|not able to answer)"
CODE_MARKERS = ("def ", "return ", "import ", "print(", "self.", "->", "()", "{}", ";", "# ")
MATH_MARKERS = ("\\", "$", "^", "\\frac", "\\theta", "therefore", "<=", ">=")
PROSE_MARKERS = ("the ", " of ", " is ", " was ", " in ", " that ")
TOKEN = "[a-z0-9']+"
#: Ordered: the first task with a keyword in the query wins.
ROUTES = (
    ("code", ("def ", "class ", "import ", "return ", "function", "lambda", "code", "program", "script", "snippet", "write ", "implement", "debug", "compile", "select ", "where ", "if ", "for ", "while ", "=>", "{", "}", ";", "//", "#include")),
    ("semantic", ("what", "who", "whom", "why", "how", "explain", "describe", "define", "definition", "meaning", "capital", "country", "history", "science", "knowledge", "answer", "which", "where")),
    ("number", ("number", "count", "sum", "calculate", "compute", "math", "arithmetic", "digit", "numeric", "integer", "prime", "fibonacci")),
    ("name", ("name", "called", "author", "person", "entity", "company", "organization", "city", "river")),
)
#: task -> weights of the channels (bm25, dense, ngram)
CHANNEL_WEIGHTS = {"semantic": (1.0, 2.0, 0.0), "code": (1.0, 0.5, 2.0), "name": (1.0, 0.75, 1.5), "number": (1.0, 0.75, 1.5), "general": (1.0, 1.0, 1.0)}


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, also where ``use`` has it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def norm_alnum(text: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "))


def norm_key(text: Column) -> Column:
    """A key of bounded width for the normal form of a text of any length; empty where that is."""
    return let(norm_alnum(text), lambda k: F.when(k == "", k).otherwise(F.sha2(k, 256)))


def norm_words(text: Column) -> Column:
    return F.filter(F.split(norm_alnum(text), " "), lambda w: w != "")


def norm_strict(text: Column) -> Column:
    """``norm_alnum`` without stopwords."""
    return F.array_join(F.filter(norm_words(text), lambda w: ~w.isin(*STOPWORDS)), " ")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def number_value(word: Column) -> Column:
    pairs = [*((w, i) for i, w in enumerate(UNITS)), *((w, 10 * (i + 2)) for i, w in enumerate(TENS))]
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), word)


def norm_answer(text: Column) -> Column:
    """``norm_alnum`` without articles, runs of number words as digits; a lone "hundred" is 0."""
    words = F.filter(norm_words(text), lambda w: ~w.isin(*ARTICLES))

    def close(s: Column) -> Column:
        return F.when(s["open"], F.array_append(s["out"], (s["total"] + s["cur"]).cast("string"))).otherwise(s["out"])

    def step(s: Column, w: Column) -> Column:
        unit = number_value(w)
        known = unit.isNotNull() | w.isin("hundred", "thousand")
        cur = F.when(w == "hundred", s["cur"] * 100).when(w == "thousand", F.lit(0)).otherwise(s["cur"] + F.coalesce(unit, F.lit(0)))
        inside = F.struct(s["out"].alias("out"), F.when(w == "thousand", s["total"] + s["cur"] * 1000).otherwise(s["total"]).cast("long").alias("total"), cur.cast("long").alias("cur"), F.lit(True).alias("open"))
        outside = F.struct(F.array_append(close(s), w).alias("out"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("cur"), F.lit(False).alias("open"))
        return F.when(known, inside).otherwise(outside)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("cur"), F.lit(False).alias("open"))
    return F.aggregate(words, start, step, lambda s: F.array_join(close(s), " "))


#: White space as Unicode and Python have it.
SPACES = r"[\s\x1c-\x1f]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACES}+|{SPACES}+$", "")


def split_long(text: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` characters: a short text as it is, else whole sentences while they fit, overlong ones cut hard."""
    whole = stripped(text)
    sentences = F.filter(F.split(whole, f"(?U)(?<=[。！？!?.;]){SPACES}*"), lambda x: x != "")
    # An overlong sentence becomes full pieces and a rest; only the rest may be joined with what follows.
    cut = F.flatten(F.transform(sentences, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(x) - 1) / limit).cast("int")), lambda i: F.substring(x, i * limit + 1, F.lit(limit)))))

    def step(s: Column, x: Column) -> Column:
        fits = F.char_length(s["cur"]) + F.char_length(x) <= limit
        return F.when(fits, F.struct(s["out"].alias("out"), F.concat(s["cur"], x).alias("cur"))).otherwise(F.struct(F.array_append(s["out"], stripped(s["cur"])).alias("out"), x.alias("cur")))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    pieces = F.when(F.char_length(whole) <= limit, F.array(whole)).otherwise(F.aggregate(cut, start, step, lambda s: F.array_append(s["out"], stripped(s["cur"]))))
    return F.filter(pieces, lambda x: x != "")


def char_chunks(docs: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """(doc_id, source, chunk_index, chunk): overlapping pieces, cut behind the last white space past the half.

    Where a piece starts depends on the cut before it, so the starts are found by a fold within each row, over at
    most as many steps as the shortest possible advance allows.
    """
    text = stripped(F.col("text"))
    n = F.char_length("t")
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(n / max(1, size // 2 - overlap)).cast("int")))

    def step(s: Column, _: Column) -> Column:
        window = F.substring(F.col("t"), s["at"] + 1, F.lit(size))
        back = F.reverse(window)
        white = F.least(*[F.when(F.locate(c, back) > 0, F.locate(c, back)).otherwise(size + 1) for c in ("\n", " ")])
        cut = F.char_length(window) - white  # place of the last white space in the window
        end = F.when(s["at"] + size >= n, n).when(cut > size // 2, s["at"] + cut + 1).otherwise(s["at"] + size)
        found = F.array_append(s["out"], stripped(F.substring(F.col("t"), s["at"] + 1, end - s["at"])))
        going = F.struct(found.alias("out"), F.greatest(end - overlap, s["at"] + 1).alias("at"), (end >= n).alias("done"))
        return F.when(s["done"], s).otherwise(going)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"), (n == 0).alias("done"))
    rows = docs.select("doc_id", "source", text.alias("t")).where(F.col("t") != "")
    return rows.select("doc_id", "source", F.posexplode(F.aggregate(steps, start, step, lambda s: s["out"])).alias("chunk_index", "chunk"))


def token_chunks(tokens: Column, size: int) -> Column:
    return let(tokens, lambda t: F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0)), F.lit(size)), lambda i: F.slice(t, i + 1, size)))


def window_keys(tokens: Column, n: int) -> Column:
    """All windows of n tokens as 128-bit keys (two hashes), which stand for the windows in joins."""
    at = lambda t: F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
    return let(tokens, lambda t: F.transform(at(t), lambda i: let(F.slice(t, i, n), window_key)))


def tagged(name: str, value: int):
    """A function for ``transform``: a key with a number beside it."""
    return lambda key: F.struct(F.lit(value).alias(name), key.alias("key"))


def window_key(window: Column) -> Column:
    return F.struct(F.xxhash64(window).alias("h1"), F.xxhash64(F.lit(1), window).alias("h2"))


def first_sentence(text: Column, most: int = 120) -> Column:
    """Up to the first full stop, at most ``most`` characters."""
    stop = F.locate(".", text)
    return F.trim(F.substring(text, F.lit(1), F.least(F.when(stop > 0, stop).otherwise(most), F.lit(most))))


def format_label(text: Column) -> Column:
    """One label of empty, other, chat_scaffold, code_fence, json, refusal, raw_continuation; the first rule wins."""
    s = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(s, r"^\s+|\s+$", "")
    code_tails = F.size(F.filter(F.split(s, "\n"), lambda line: line.rlike(CODE_TAIL))) >= 3
    is_json = F.substring(bare, 1, 1).isin("{", "[") & (F.try_parse_json(bare).isNotNull() | bare.rlike(JSON_SHAPE))
    return (
        F.when(s.contains("�"), "other")
        .when(bare == "", "empty")
        .when(reduce(lambda a, b: a | b, [s.contains(m) for m in SCAFFOLD_MARKERS]) | s.rlike(ROLE_LINE), "chat_scaffold")
        .when(s.contains("```") | s.rlike(CODE_LINE) | code_tails, "code_fence")
        .when(is_json, "json")
        .when(F.substring(s, 1, 200).rlike(REFUSAL), "refusal")
        .otherwise("raw_continuation")
    )


def format_sublabel(text: Column, terse_tokens: int = 6) -> Column:
    label = format_label(text)
    first = F.trim(F.element_at(F.filter(F.split(F.concat(F.coalesce(text, F.lit("")), F.lit("\n.")), "\n"), lambda x: F.trim(x) != ""), 1))
    terse = (F.size(F.split(collapse(first), " ")) <= terse_tokens) & ~first.rlike(r"[.?!:]\s*$")
    return F.when(label != "raw_continuation", label).when(terse, "terse").otherwise("long")


def domain_counts(text: Column) -> dict[str, Column]:
    """How many markers of code, mathematics and prose occur at all."""
    s = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    total = lambda parts: reduce(lambda a, b: a + b, [p.cast("int") for p in parts])
    return {
        "code": total([*(s.contains(m) for m in CODE_MARKERS), s.rlike(r"(?m)^ {4}\S")]),
        "math": total([*(s.contains(m) for m in MATH_MARKERS), s.rlike(r"[0-9]\s*=\s*[0-9]")]),
        "prose": total([F.lower(s).contains(m) for m in PROSE_MARKERS]),
    }


def prefix_class(text: Column) -> Column:
    lead = F.regexp_extract(F.coalesce(text, F.lit("")), r"^(\s*)", 1)
    return F.when(lead == F.coalesce(text, F.lit("")), "empty").when(lead.contains("\n"), "newline_lead").when(lead != "", "space_lead").otherwise("no_lead")


def route_task(query: Column, digit_share: float = 0.15, generation: tuple[str, ...] = ()) -> Column:
    """The task of a query; phrases of ``generation`` (none by default) mark open generation, which is semantic."""
    low = F.lower(F.coalesce(query, F.lit("")))
    chain = None
    for task, keywords in (*([("semantic", generation)] if generation else []), *ROUTES):
        hit = reduce(lambda a, b: a | b, [low.contains(k) for k in keywords])
        chain = F.when(hit, task) if chain is None else chain.when(hit, task)
    digits = F.char_length(low) - F.char_length(F.regexp_replace(low, "[0-9]", ""))
    return chain.when(digits / F.greatest(F.char_length(low), F.lit(1)) > digit_share, "number").otherwise("general")


def token_categories(token: Column) -> Column:
    """Array of number and name, as far as they apply; empty for other tokens."""
    found = F.array(F.when(token.rlike("[0-9]"), "number"), F.when(token.rlike(r"^\p{Lu}\p{L}*$"), "name"))
    return F.array_compact(found)


def repetition_rate(tokens: Column, n: int = 3) -> Column:
    """One minus distinct n-grams over n-grams; 0 for fewer than n tokens."""
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
    rate = lambda t: F.when(F.size(t) < n, 0.0).otherwise(let(grams(t), lambda g: 1 - F.size(F.array_distinct(g)) / F.size(g)))
    return let(tokens, rate)


def render(template: str, **columns: Column) -> Column:
    """``template`` with each ``{name}`` replaced by a column; null counts as empty."""
    return reduce(lambda text, item: F.replace(text, F.lit("{" + item[0] + "}"), F.coalesce(item[1], F.lit(""))), columns.items(), F.lit(template))


def oracle_context(question: Column, answer: Column, passage: Column, mode: str) -> Column:
    """Prompts that hold the answer, a passage, or both before the question."""
    answer_line = F.concat(F.lit("Answer: "), answer)
    parts = {"answer": [answer_line], "passage": [passage], "both": [passage, answer_line]}[mode]
    return F.concat_ws("\n", *parts, F.concat(F.lit("Question: "), question))


def format_variants(text: Column) -> Column:
    """Array of (kind, text): the text as a chat, a reasoning and a tool example."""
    kinds = {"chat": "user: {}\nassistant: ok", "cot": "<think>\n{}\n</think>", "tool": "<tool_call>\n{}\n</tool_call>"}
    make = lambda form: F.concat(F.lit(form.split("{}")[0]), text, F.lit(form.split("{}")[1]))
    return F.array(*[F.struct(F.lit(k).alias("kind"), make(v).alias("text")) for k, v in kinds.items()])
