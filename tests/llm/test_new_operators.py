"""Whitening, decontamination and fill-in-middle against plain recomputations, and at their edges."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import decontaminate as D
from corpuslab.llm import fill_in_middle as M
from corpuslab.llm import toxicity
from corpuslab.llm import whitening as W

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# 11 whitening


def scatter(x):
    c = x - x.mean(axis=0)
    return c.T @ c


def plain_whitened(x, components=8):
    """(deviations, whitened, explained) by one dense eigendecomposition."""
    n, s = len(x), x.sum(axis=0)
    away = (n * x - s) / n
    cov = away.T @ away / n
    values, vectors = np.linalg.eigh(cov)
    keep = np.argsort(-values)[:components]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return deviation, away @ vectors[:, keep] / np.sqrt(values[keep]), values[keep] / np.trace(cov)


def test_secular_roots_are_eigenvalues():
    rng = np.random.default_rng(2)
    for k in (1, 2, 5, 40):
        for spread in (1.0, 1e-6, 1e9):
            d, z = np.sort(rng.random(k)) * spread + np.arange(k) * spread * 1e-3, rng.standard_normal(k)
            found, apart = W.roots(d, z)
            want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
            assert np.allclose(found, want, rtol=1e-9, atol=1e-12 * abs(want).max())
            assert np.allclose(apart, d[:, None] - found[None, :], atol=1e-9 * max(1, spread))


def test_rank_one_updates_with_deflation():
    rng = np.random.default_rng(3)
    values, vectors = np.zeros(6), np.eye(6)
    whole = np.zeros((6, 6))
    given = [*rng.standard_normal((20, 6)), np.eye(6)[0], np.eye(6)[0], np.zeros(6), np.ones(6), np.ones(6)]
    for i, v in enumerate(given):
        weight = 1.0 + i % 3
        whole += weight * np.outer(v, v)
        values, vectors = W.rank_one(values, vectors, v, weight)
        assert np.allclose(vectors @ np.diag(values) @ vectors.T, whole, atol=1e-10 * max(1, np.trace(whole)))
        assert np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-12)
        assert (np.diff(values) >= -1e-12).all()


def test_spectra_merge_as_one():
    rng = np.random.default_rng(4)
    x = np.floor(rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12)) * 500) + 100_000
    a, b, once = W.Spectrum(12), W.Spectrum(12), W.Spectrum(12)
    for i, row in enumerate(x):
        (a if i < 100 else b).add(row, 1 + i % 2)
        once.add(row, 1 + i % 2)
    a.merge(b)
    whole = scatter(np.repeat(x, [1 + i % 2 for i in range(300)], axis=0))
    for s in (a, once):
        assert s.n == 450 and np.allclose(s.values, np.linalg.eigvalsh(whole), rtol=1e-9)
        assert np.allclose(s.vectors @ np.diag(s.values) @ s.vectors.T, whole, rtol=0, atol=1e-9 * np.trace(whole))


@pytest.mark.parametrize("at_once", [2, 16])
def test_whitening_against_one_dense_solve(spark, at_once):
    rng = np.random.default_rng(5)
    c = rng.standard_normal((240, 10)) @ rng.standard_normal((10, 10)) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(c)] + [(i, c[0].tolist()) for i in range(240, 360)]  # a third are copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = sorted(W.whiten(df, at_once=at_once).collect())
    x = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64) + 100_000
    deviation, white, explained = plain_whitened(x)
    mine = np.array([r["whitened"] for r in got]).reshape(360, 8)
    assert [r["vec_id"] for r in got] == [i for i in range(360) for _ in range(8)] and [r["component"] for r in got[:8]] == list(range(1, 9))
    assert [r["deviation"] for r in got[::8]] == deviation and {r["n"] for r in got} == {360}
    signs = np.sign((mine * white).sum(axis=0))
    assert np.allclose(mine * signs, white, atol=1e-9)
    assert np.allclose([r["explained"] for r in got[:8]], explained, rtol=1e-10)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_of_the_given_table(spark):
    given = pq.read_table(f"{SF}/embeddings.parquet").to_pandas()
    got = W.op11_whitening(spark, SF).orderBy("vec_id", "component").collect()
    x = np.floor(1024 * np.stack(given.sort_values("vec_id")["embedding"].to_numpy()).astype(float)).astype(np.int64) + 100_000
    deviation, white, explained = plain_whitened(x)
    mine = np.array([r["whitened"] for r in got]).reshape(len(x), 8)
    assert [r["deviation"] for r in got[::8]] == deviation
    assert np.allclose(np.abs(mine), np.abs(white), atol=1e-7) and np.allclose([r["explained"] for r in got[:8]], explained, rtol=1e-9)


def test_whitening_at_the_edges(spark):
    ddl = "vec_id long, embedding array<double>, n long, x string"
    rows = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [2.0, 2.0, 5.0]), (3, None), (4, [1.0, None, 2.0]), (5, [math.nan, 1.0, 1.0]), (6, [math.inf, 1.0, 1.0]), (7, []), (8, [1e300, 0.0, 0.0]), (9, [4.0, 1.0]), (10, [4.0, 3.0])]
    got = W.whiten(spark.createDataFrame([(*r, 1, "y") for r in rows], ddl)).collect()
    assert sorted({(str(r["vec_id"]), r["n"]) for r in got}) == [("1", 3), ("10", 2), ("9", 2), ("None", 3)]
    assert len(got) == 3 * 3 + 2 * 2
    # Three points on a line vary in one direction, two in one as well; the rest has no variance.
    assert all((r["whitened"] is not None) == (r["component"] == 1) for r in got)
    assert all(r["identity_error"] < 1e-9 for r in got)
    assert W.whiten(spark.createDataFrame([], ddl)).collect() == []
    one = W.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, "y")], ddl)).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(0, None, None, None)] * 2


# 12 decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_hits(words, items, window):
    """(hit positions, items) by comparing every window of every item with every place."""
    hit, found = set(), set()
    for name, item in items:
        k = min(len(item), window)
        windows = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                if name is not None:
                    found.add(name)
    return hit, found


def plain_longest(words, items):
    runs = {tuple(item[i:j]) for _, item in items for i in range(len(item)) for j in range(i + 1, len(item) + 1)}
    return max((j - i for i in range(len(words)) for j in range(i + 1, len(words) + 1) if tuple(words[i:j]) in runs), default=0)


@pytest.mark.parametrize("per_automaton, piece", [(400_000, 20_000), (30, 9)])
def test_decontamination_against_all_windows(spark, per_automaton, piece):
    rng = random.Random(6)
    word = lambda: rng.choice("abc")
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 14)))) for i in range(25)] + [(None, "d e f"), (7, "g H,i"), (8, None), (8, "g h i")]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(70, None), (71, ""), (72, "x D-e_F g h;I"), (72, "x D-e_F g h;I")]
    got = D.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=6, words_per_automaton=per_automaton, piece_words=piece).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in docs)
    named = [(None if i is None else str(i), plain_words(t)) for i, t in items]
    for r in got:
        words = plain_words(r["text"])
        hit, found = plain_hits(words, named, 6)
        assert {p for a, b in r["spans"] for p in range(a, b)} == hit and r["items"] == sorted(found) and r["n_words"] == len(words)
        assert all(b[0] > a[1] for a, b in zip(r["spans"], r["spans"][1:]))  # noqa: B905
        if piece > 20:
            assert r["longest"] == plain_longest(words, named)


def test_texts_without_benchmark_passages(spark):
    items = spark.createDataFrame([(1, "One two three four five six seven eight nine ten eleven", 0)], "item_id long, text string, doc_id long")
    passage = "ONE, two three four five six seven eight (nine) ten eleven"
    rows = [(1, f"Before it. {passage}! After it."), (2, passage), (3, "clean Text, kept; as is  "), (4, None), (5, "é" * 200_000 + " " + passage + " " + "word " * 500_000)]
    got = {r["doc_id"]: r for r in D.decontaminate(spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, item_id int"), items, most_coverage=0.8).collect()}
    assert got[1]["text"] == "Before it. ! After it." and got[1]["removed_words"] == 11
    assert 2 not in got and got[3]["text"] == rows[2][1] and got[4]["text"] is None
    assert got[5]["text"] == rows[4][1].replace(passage, "")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.scan(spark.createDataFrame(rows, "doc_id long, text string"), none).where("size(spans) > 0").count() == 0
    assert D.scan(spark.createDataFrame([], "doc_id long, text string"), items).collect() == []


def test_words_are_the_same_in_spark_and_python(spark):
    texts = ["Aa-B_c 0é Ünü\ttab\x7f\x80ÀÉ", "日本語 text\nline", "x" * 70 + " short", "\U0001f600 A\U00010400b"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(D.words_column(F.col("text")).alias("w")).collect()
    for text, row in zip(texts, got, strict=True):
        want = [D.short(w) for w in D.words_of(text)]
        assert [w.encode() if w[0] != " " else b" " + bytes.fromhex(w[1:]) for w in row["w"]] == want
        assert [w.decode() for w in D.words_of(text)] == plain_words(text)


# 13 fill in the middle


def plain_form(doc_id, text):
    """(n, form, prefix, middle, suffix) by the rule, on the whole text."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, None
    return n, "spm" if h4 % 100 < 20 else "psm", "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])


@pytest.mark.parametrize("frame", [1, 7, 64, M.FRAME_BYTES])
def test_fill_in_middle_against_the_rule(spark, frame):
    rng = random.Random(7)
    alphabet = ["a", "B", "zz", " ", "\n", "é", "日", "\U0001f600", "<", ">", "P", "S", "M", "<S", "1"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 60)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "one <P> mark"), (None, "no id here"), (None, "no id here"), (503, "<M"), (504, "long" * 40), (505, "é")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, form string")
    moved = M.fill_in_middle(M.store_texts(df, frame))
    got = sorted(map(tuple, M.digests_of(moved).collect()), key=str)
    want, forms = [], set()
    for doc_id, text in rows:
        text = text or ""
        n, form, prefix, middle, suffix = plain_form(doc_id, text)
        out = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
        want.append((doc_id, n, form, None if form == "plain" else len(prefix), None if form == "plain" else len(middle), sha(out), sha(text)))
        forms.add(form)
    assert got == sorted(want, key=str) and forms == {"plain", "psm", "spm"}
    texts = {(r["doc_id"], r["form"]): r["output"] for r in M.texts_of(moved).collect()}
    assert sha(texts[(504, plain_form(504, "long" * 40)[1])]) in {w[5] for w in want}


def test_only_cut_frames_are_opened(monkeypatch):
    text = "word, " * 60_000
    n, marked, units, chars, frames = M.store(text, 4096)
    assert len(frames) == math.ceil(len(text) / 4096) and b"".join(M.stream(frames)).decode() == text and not marked
    opened = []
    real = M.unpacker()

    class Counting:
        def decompress(self, frame):
            opened.append(frame)
            return real.decompress(frame)

    monkeypatch.setattr(M, "unpacker", Counting)
    for doc_id in range(30):
        opened.clear()
        form, _, _, out = M.transform(doc_id, n, marked, units, chars, frames, 1, 90, 20)
        assert len(opened) <= 2 and (form == "plain" or len(out) >= len(frames))


def test_very_long_texts_and_no_rows(spark):
    text = "é日 wörd\n" * 400_000
    df = spark.createDataFrame([(9, text)], "doc_id long, text string")
    got = M.digests_of(M.fill_in_middle(M.store_texts(df))).first()
    assert got["restored_sha256"] == sha(text) and got["n"] == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text))
    assert M.digests_of(M.fill_in_middle(M.store_texts(df.limit(0)))).collect() == []


# 9 toxicity: long runs of hidden letters, the alphabet's bound


def test_long_runs_of_symbols_are_read_exactly():
    words = ["castle", "cattle", "candle", "bottle", "battle", "saddle", "settled"] * 200
    counts = {}
    for word in words:
        for gram in toxicity.trigrams_of(word):
            counts[gram] = counts.get(gram, 0) + 1
    model = toxicity.CharModel(counts)
    assert model.most_hidden > 10
    for token in ("c*****e", "ca****e", "s******d", "b*#?%e", "a" + "*" * 14 + "b", "c*a*****e***d"):
        assert toxicity.restore(token, model) == toxicity.cheapest(token, model)
    # The bound changes no reading, however small the run would have been kept before.
    long = "c" + "*" * (model.most_hidden + 6) + "e"
    assert toxicity.restore(long, model) == toxicity.cheapest(long, model)
    assert toxicity.restore("c" + "*" * 100_000 + "e", model) == toxicity.restore(long, model)


def test_alphabet_of_letters_is_bounded():
    names = {c for i in range(0x20000) if (c := toxicity.folded(chr(i))).isalpha() or chr(i).isalpha()}
    lower = {toxicity.folded(chr(i).lower()) for i in range(0x20000) if chr(i).isalpha() and len(chr(i).lower()) == 1}
    assert len(lower) <= 26 + 34 + 93 and len(names) < 300
    text = "żółw über 日本 кот"
    want = {}
    for word in text.split():
        for gram in toxicity.trigrams_of(word):
            want[gram] = want.get(gram, 0) + 1
    got = {}
    for gram, n in toxicity.count_trigrams(text):
        got[gram] = got.get(gram, 0) + n
    assert got == want
