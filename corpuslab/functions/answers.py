"""Answer candidates in generated texts, by two extraction rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What announces an answer.
MARKERS = ("answer:", "the answer is:", "the answer is", "答案是", "答案：", "答案:", "therefore,", "so the answer is", "final answer:", "final answer")
LEADS = r"(?i)^(therefore|so|thus|hence|the answer is|answer)[,:.\s]*"
ROLES = r"(?i)^\s*(?:assistant|user|system)\s*"
ANNOUNCED = r"(?is)^.*(?:(?:final\s+answer|correct\s+answer|answer)\s*(?:is|:)\s*|(?:答案|回答)\s*[:：]\s*)"
ASSERTED = r"(?im)(?:^\s*(?:assistant\s*)?\**|\b(?:the\s+answer\s+is|answer\s+is|correct\s+answer\s+is|i\s+(?:would\s+)?(?:say|choose|select))\s*\**\s*|\b(?:so|therefore|thus|hence)\s*[,:]?\s*\**)(yes|no)\b"
OPTION = r"(?is)^(?:option\s*)?[\(\*]*([A-D])[\)\.\*]*\s*[,:;]?\s*(.*)$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), LEADS, ""))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), r"(?<=[.!?。！？])\s*"), strip), lambda x: x != "")


def last_candidate(text: Column) -> Column:
    """First rule: what follows the marker that ends last, on its line; else the last sentence."""
    t = strip(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    n = F.char_length(t)
    ends = [F.when(low.contains(m), n - F.locate(m[::-1], F.reverse(low)) + 1) for m in MARKERS]
    end = F.greatest(*ends)
    line = strip(F.element_at(F.split(strip(F.substring(t, end + 1, n)), "\n"), 1))
    last = F.element_at(sentences(t), -1)
    return F.when(t == "", "").when(end.isNotNull() & (line != ""), clean(line)).otherwise(clean(F.coalesce(last, F.lit(""))))


def first_meaningful(text: Column) -> Column:
    """The first sentence with a letter or digit; questions are passed over if something follows them."""
    all_ = sentences(text)
    n = F.size(all_)
    marked = F.transform(all_, lambda x, i: F.when(x.rlike("[A-Za-z0-9]") & ~(x.endswith("?") & (i + 1 < n)), x))
    return F.coalesce(F.element_at(F.array_append(F.array_compact(marked), F.lit("")), 1), F.lit(""))


def answer_candidate(text: Column, task: Column) -> Column:
    """Second rule: the tail of the last announcement, else the first meaningful sentence; yes or no for ``boolq``.

    For ``boolq`` an option letter counts only with what it stands for, and a text without a clear assertion gives
    the empty string: lists of options are ambiguous.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)</?think>\s*|<\|(?:im_start|im_end|endoftext)\|>", " ")
    t = F.regexp_replace(F.regexp_replace(strip(t), ROLES, ""), r"^[\s?:]+|[\s?:]+$", "")
    tail = F.when(t.rlike(ANNOUNCED), strip(F.regexp_replace(t, ANNOUNCED, ""))).otherwise("")
    bare = lambda x: clean(F.regexp_replace(x, r"[*_`]+", ""))
    yes_no = lambda x: F.lower(F.regexp_extract(x, r"(?i)\b(yes|no)\b", 1))
    letter, rest = F.upper(F.regexp_extract(tail, OPTION, 1)), strip(F.regexp_extract(tail, OPTION, 2))
    of_letter = F.when(letter == "A", "yes").when(letter == "B", "no").otherwise("")
    in_tail = F.when(tail == "", "").when((letter != "") & (rest == ""), of_letter).when(letter != "", yes_no(rest)).otherwise(yes_no(tail))
    asserted = F.lower(F.regexp_extract(t, ASSERTED, 1))
    free_tail, first = bare(first_meaningful(tail)), bare(first_meaningful(t))
    free = F.when((tail != "") & (free_tail != ""), free_tail).when(first != "", first).otherwise(last_candidate(text))
    return F.when(t == "", "").when(task == "boolq", F.when(in_tail != "", in_tail).otherwise(asserted)).otherwise(free)
