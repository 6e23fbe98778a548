"""Shared windows found by their anchors against all windows."""

import random

import pytest

from corpuslab.operators import corpus as C


@pytest.mark.parametrize("n", [2, 7, 12])
def test_texts_that_share_a_window_of_characters(spark, monkeypatch, n):
    """Pieces of every window were written to storage before; now nothing is, and unasked anchors meet no shuffle."""
    monkeypatch.setattr(C, "written", lambda *a: pytest.fail("a table is written"))
    rng = random.Random(n)
    text = lambda: "".join(rng.choice(["a", "a", "é", "\U0001f600", " ", "b", rng.choice("cdefghijkl")]) for _ in range(rng.randrange(0, 40))) + "z" * rng.choice([0, 0, 0, 60])
    cand, ref = [(i, text()) for i in range(60)] + [(60, None)], [(i, text()) for i in range(25)] + [(None, "no id"), (90, None)]
    cand += [(61, ref[3][1]), (62, "a" * n), (63, "q" * n)]
    spread = lambda t: {t[i : i + n] for i in range(len(t) - n + 1)}
    theirs = set().union(*[spread(t) for _, t in ref if t])
    want = {i: None if t is None or len(t) < n else bool(spread(t) & theirs) for i, t in cand}
    frames = [spark.createDataFrame(x, "doc_id long, text string") for x in (cand, ref)]
    found = {r["doc_id"]: r["overlaps"] for r in C.char_overlap(*frames, n).collect()}
    assert found == {i: w if t is not None else None for (i, t), w in zip(cand, want.values(), strict=True)} and {True, False} <= set(want.values())


@pytest.mark.parametrize("ns", [[3], [5, 2]])
def test_documents_that_share_a_window_of_words(spark, monkeypatch, ns):
    """Every window of both sides was a row per length before; a row per window of the least length is dealt now."""
    monkeypatch.setattr(C, "_keyed", lambda *a: pytest.fail("windows are spread"))
    monkeypatch.setattr(C, "RUN_ROWS", 5)
    rng = random.Random(len(ns))
    text = lambda: [rng.choice(["a", "b", "c", "d", f"w{rng.randrange(30)}"]) for _ in range(rng.randrange(0, 9))]
    cand, ref = [(f"c{i}", text()) for i in range(80)] + [("none", None), ("word", ["a"])], [(f"r{i}", text()) for i in range(25)] + [("none", None)]
    frames = [spark.createDataFrame(x, "doc_id string, tokens array<string>") for x in (cand, ref)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = {tuple(r) for r in C.overlapping(*frames, ns).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spread = lambda t, n: {tuple(t[i : i + n]) for i in range(len(t or []) - n + 1)}
    want = {(n, i) for n in ns for i, t in cand if spread(t, n) & set().union(*[spread(r, n) for _, r in ref])}
    assert found == want and 0 < len(want) < len(ns) * len(cand)
