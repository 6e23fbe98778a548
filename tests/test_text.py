"""Hand-sized cases of the text and answer columns."""

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import answers as A
from corpuslab.functions import text as T


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"text {kind}").select(column(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("forty-two", "42"), ("twenty one", "21"), ("one hundred five", "105"), ("The Hundred", "0"), ("two thousand three men", "2003 men"), ("", "")])
def test_norm_answer(spark, text, want):
    assert one(spark, text, T.norm_answer) == want


def test_normalisers(spark):
    assert one(spark, " a\t\tb\nc ", T.collapse) == "a b c"
    assert one(spark, "Ça va, l'été!", T.norm_alnum) == "a va l t"
    assert one(spark, "The Capital of France!", T.norm_strict) == "capital france"
    assert one(spark, "Don't stop 42x", T.word_tokens) == ["don't", "stop", "42x"]


def test_split_long(spark):
    assert one(spark, "One. Two! Three?", lambda t: T.split_long(t, 9)) == ["One.Two!", "Three?"]
    assert one(spark, "x" * 25, lambda t: T.split_long(t, 10)) == ["x" * 10, "x" * 10, "x" * 5]


def test_char_chunks(spark):
    rows = T.char_chunks(spark.createDataFrame([(1, "s", "word " * 100), (2, "s", "short"), (3, "s", "  "), (4, "s", None)], "doc_id long, source string, text string"), 50, 10).collect()
    own = [r for r in rows if r["doc_id"] == 1]
    assert len(own) > 1 and [r["chunk_index"] for r in own] == list(range(len(own))) and {r["source"] for r in own} == {"s"}
    assert {r["doc_id"] for r in rows} == {1, 2} and all(len(r["chunk"]) <= 50 for r in rows)


@pytest.mark.parametrize("text,want", [(None, "empty"), ("  ", "empty"), ("<think> x", "chat_scaffold"), ("def f(): pass", "code_fence"), ('{"a": 1}', "json"), ("I'm sorry, no", "refusal"), ("plain words", "raw_continuation"), ("bad � char", "other")])
def test_format_label(spark, text, want):
    assert one(spark, text, T.format_label) == want


def test_repetition_and_prefix(spark):
    tokens = spark.createDataFrame([(["a"] * 6,), (["a", "b"],)], "t array<string>").select(T.repetition_rate(F.col("t")).alias("x"))
    assert [r["x"] for r in tokens.collect()] == [0.75, 0.0]
    assert [one(spark, t, T.prefix_class) for t in (" yes", "\n\nyes", "yes", "", None)] == ["space_lead", "newline_lead", "no_lead", "empty", "empty"]


@pytest.mark.parametrize("text,want", [("assistant\nYes, they are the same.", "yes"), ("The correct answer is **B. No**.", "no"), ("Answer: A. Yes.", "yes"), ("A: Yes / B: No", ""), ("", "")])
def test_boolq_candidates(spark, text, want):
    assert one(spark, text, lambda t: A.answer_candidate(t, F.lit("boolq"))) == want


def test_last_candidate(spark):
    assert one(spark, "Long talk. The answer is: Paris\nmore", A.last_candidate) == "Paris"
    assert one(spark, "First. Last one", A.last_candidate) == "Last one"
