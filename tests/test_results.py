"""Operators without SQL against plain recomputations in Python and numpy."""

import hashlib
import math
import os
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import corpus as C
from corpuslab.operators import evaluation as E
from corpuslab.operators import ngrams as N
from corpuslab.operators import positions as P
from corpuslab.operators import vectors as V

SF = "/root/testdata/sf0.001"


def sample(n=240, d=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    y = (x[:, 0] + 0.5 * rng.normal(size=n) > 0).astype(int)
    return x, y


def vectors_of(spark, x, y):
    rows = [(i, v.tolist(), int(t), i % 4) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, fold int").repartition(3)


# T: texts


def plain_split_long(text, limit):
    text = text.strip()
    if len(text) <= limit:
        return [text] if text else []
    out, cur = [], ""
    for sentence in re.split(r"(?<=[。！？!?.;])\s*", text):
        for part in [sentence[i : i + limit] for i in range(0, len(sentence), limit)]:
            if len(cur) + len(part) <= limit:
                cur += part
            else:
                out.append(cur.strip())
                cur = part
    return [x for x in [*out, cur.strip()] if x]


def plain_chunks(text, size, overlap):
    text, at, out = text.strip(), 0, []
    while text:
        end = len(text) if at + size >= len(text) else at + size
        if end < len(text):
            cut = max(text.rfind("\n", at, end), text.rfind(" ", at, end))
            end = cut + 1 if cut - at > size // 2 else end
        out.append(text[at:end].strip())
        if end >= len(text):
            return out
        at = max(end - overlap, at + 1)
    return out


def test_cutting_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["word", " ", "longerword", ". ", "! ", "x" * 40, "\n"], k=rng.randint(0, 60))) for _ in range(200)]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    split = {r["doc_id"]: r["x"] for r in docs.select("doc_id", T.split_long(F.col("text"), 30).alias("x")).collect()}
    assert all(split[i] == plain_split_long(t, 30) for i, t in enumerate(texts))
    chunks = {}
    for r in T.char_chunks(docs, 60, 10).collect():
        chunks.setdefault(r["doc_id"], []).append((r["chunk_index"], r["chunk"]))
    for i, t in enumerate(texts):
        assert [c for _, c in sorted(chunks.get(i, []))] == plain_chunks(t, 60, 10)


def test_routes(spark):
    cases = {"select a from b": "code", "if so": "code", "x => y": "code", "a // b": "code", "which one": "semantic", "common knowledge": "semantic", "where": "semantic", "count 3": "number", "my name": "name", "12345 ab": "number", "plain": "general", "": "general"}
    rows = spark.createDataFrame([(k,) for k in cases], "q string").select("q", T.route_task(F.col("q")).alias("t"))
    assert {r["q"]: r["t"] for r in rows.collect()} == cases
    assert spark.range(1).select(T.route_task(F.lit("write a poem; select x"), generation=("poem",)).alias("t")).first()["t"] == "semantic"


# C: audits and overlaps against substring search


def test_overlaps_and_audits(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(60)] + [(None, "w1 w2 w3 w4 w5")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8))), " ".join(rng.choices(words, k=rng.randint(0, 5)))) for i in range(40)]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string, answer string")
    found = {r["item_id"]: r["contaminated"] for r in C.eval_contamination(asked, frame).collect()}
    for i, _, a in items:
        assert found[i] == (None if len(a.split()) < 2 else any(f" {a} " in f" {t} " for _, t in docs))
    audit = {r["item_id"]: r for r in C.audit_contamination(asked, frame, 3).collect()}
    for i, q, a in items:
        hit = lambda s: s != "" and any(f" {s} " in f" {t} " for _, t in docs)
        r = audit[i]
        assert (r["question_exact"], r["answer_exact"], r["both_exact"]) == (hit(q), hit(a), hit(f"{q} {a}".strip()))
    tokens = spark.createDataFrame([(i, t.split()) for i, t in docs], "doc_id long, tokens array<string>")
    held, rest = tokens.where("doc_id < 20"), tokens.where("doc_id >= 20")
    grams = lambda t, n: {tuple(t.split()[j : j + n]) for j in range(len(t.split()) - n + 1)}
    report = {r["n"]: r for r in C.token_overlap_report(held, rest, [2, 4]).collect()}
    checked = {r["n"]: (r["tested"], r["found"]) for r in C.verify_disjoint(held, rest, [2, 4]).collect()}
    for n in (2, 4):
        theirs = set().union(*(grams(t, n) for i, t in docs if i is not None and i >= 20))
        bad = [t for i, t in docs if i is not None and i < 20 and grams(t, n) & theirs]
        assert (report[n]["excluded"], report[n]["excluded_tokens"]) == (len(bad), sum(len(t.split()) for t in bad))
        heads = [tuple(t.split()[:n]) for i, t in docs if i is not None and i < 20 and len(t.split()) >= n]
        assert checked[n] == (len(heads), sum(h in theirs for h in heads))


def test_contexts_with_and_without_the_tokens_before(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x"), (3, ""), (4, "p q")], "doc_id long, text string")
    rows = N.token_rows(docs, 4)
    for tokens in (rows, rows.drop("before"), N.token_rows(docs, 1)):
        got = {(r["doc_id"], r["pos"]): (r["c1"], r["c2"], r["c5"]) for r in N.contexts(tokens, [1, 2, 5]).collect()}
        assert got[1, 5] == ("", "e", "b c d e") and got[1, 0] == ("", None, None) and got[4, 1] == ("", "p", None) and len(got) == 9


# E: evaluation


def test_p_values_and_bootstrap(spark):
    rng = np.random.default_rng(2)
    d = rng.normal(0.3, 1, 80)
    rows = spark.createDataFrame([(i, float(v), "t") for i, v in enumerate(d)], "item_id long, d double, task string")
    a, b = rows.select("item_id", "task", F.lit(0.0).alias("v")), rows.select("item_id", "task", F.col("d").alias("v"))
    r = E.with_p_values(E.paired_delta(E.align(a, b, ["item_id", "task"], "v"), ["task"]), ["task"]).first()
    t = d.mean() / (d.std(ddof=1) / math.sqrt(len(d)))
    wins, n = int((d > 0).sum()), len(d)
    tail = lambda k: sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n
    assert r["t"] == pytest.approx(t) and r["p_t"] == pytest.approx(math.erfc(abs(t) / math.sqrt(2)))
    assert r["p_sign"] == pytest.approx(tail(wins)) and r["p_mcnemar"] == pytest.approx(min(1, 2 * tail(max(wins, n - wins))))
    boot = E.bootstrap(rows, "d", ["item_id"], ["task"], 2000).first()
    se = d.std() / math.sqrt(n)
    assert boot["mean"] == pytest.approx(d.mean()) and boot["lo"] == pytest.approx(d.mean() - 1.96 * se, abs=0.25 * se) and boot["hi"] == pytest.approx(d.mean() + 1.96 * se, abs=0.25 * se)


def test_noise_floor(spark):
    rng = np.random.default_rng(6)
    labels = rng.integers(0, 4, 400)
    rows = spark.createDataFrame([(i, int(x)) for i, x in enumerate(labels)], "item_id long, l int")
    got = E.split_half_noise(rows, "l", "item_id").first()["noise"]
    plain = []
    for _ in range(200):
        side = rng.integers(0, 2, 400)
        shares = [np.bincount(labels[side == s], minlength=4) / (side == s).sum() for s in (0, 1)]
        plain.append(0.5 * np.abs(shares[0] - shares[1]).sum())
    assert got == pytest.approx(np.mean(plain), rel=0.25)


def test_answer_scores(spark):
    rows = [(1, "qa", "The answer is: Paris", "Paris"), (2, "qa", "paris", "Paris"), (3, "qa", "It may be Rome. I think so", "Paris"), (4, "qa", "near Paris today", "paris"), (5, "qa", "", "x")]
    answers = spark.createDataFrame([(i, t, "q", g, gold, "a", len(g)) for i, t, g, gold in rows], "item_id long, task string, question string, generated string, gold string, arm string, n_generated int")
    scored = E.scores(answers)
    got = {r["item_id"]: (r["exact"], r["contains"], r["extracted_exact"]) for r in scored.collect()}
    as_bool = lambda v: tuple(bool(x) for x in v)
    assert as_bool(got[1]) == (False, True, True) and as_bool(got[2]) == (True, True, True) and as_bool(got[3]) == (False, False, False)
    assert as_bool(got[4])[:2] == (False, True)
    means = E.metrics(scored, ["arm", "task"]).first()
    assert means["n"] == 5 and means["exact"] == pytest.approx(0.2) and means["contains"] == pytest.approx(0.6)


# P: positions


def records_of(spark, n=4000, seed=7):
    rng = np.random.default_rng(seed)
    p, q, g = rng.exponential(2, n), rng.exponential(2, n), rng.integers(0, 3, n)
    rows = [(i, int(g[i]), float(p[i]), float(q[i])) for i in range(n)]
    return spark.createDataFrame(rows, "pos long, grp int, nll_p double, nll_q double").repartition(3), p, q, g


def test_whole_grid_of_weights(spark):
    rows, p, q, g = records_of(spark)
    lams = np.arange(1001) / 1000
    loss = lambda own: np.array([-np.log(np.maximum(lam * np.exp(-p[own]) + (1 - lam) * np.exp(-q[own]), 1e-12)).sum() for lam in lams])
    for r in P.best_lambda(P.mixture_grid(rows, ["grp"]), ["grp"]).collect():
        plain = loss(g == r["grp"])
        assert r["lam"] == pytest.approx(lams[plain.argmin()]) and r["loss"] == pytest.approx(plain.min() / (g == r["grp"]).sum())
    pos = np.arange(len(p))
    for r in P.crossfit_gain(rows, "grp").collect():
        rest, own = (g == r["grp"]) & (pos % 5 != r["fold"]), (g == r["grp"]) & (pos % 5 == r["fold"])
        best = loss(rest).argmin()
        at = loss(own)
        assert r["lam"] == pytest.approx(lams[best]) and r["gain"] == pytest.approx(at[0] - at[best])


def test_permuted_null_permutes_within_groups(spark):
    rows, p, q, g = records_of(spark, 600)
    gains = P.permuted_null(rows, "grp", 4, 5, 50).collect()
    assert sorted(r["perm"] for r in gains) == [0, 1, 2, 3] and len({round(r["gain"], 9) for r in gains}) == 4
    mixed = {r["pos"]: r["nll_p"] for r in N.permute(rows.select("pos", "grp", "nll_p"), "nll_p", "pos", 100, ["grp"]).collect()}
    for k in range(3):
        own = np.flatnonzero(g == k)
        assert sorted(mixed[i] for i in own) == pytest.approx(sorted(p[own])) and any(mixed[i] != p[i] for i in own)


def test_thresholds_fold_by_fold(spark):
    rng = np.random.default_rng(8)
    s, v = rng.integers(0, 12, 300), rng.normal(size=300)
    rows = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(s, v, strict=True))], "pos long, score int, value double")
    best = lambda keep: max(((v[keep & (s >= t)].sum(), t) for t in set(s[keep].tolist())))[1]
    fold = np.arange(300) * 4 // 300
    for r in P.gate_study(rows, "score", "value").collect():
        t, own = best(fold != r["fold"]), fold == r["fold"]
        assert r["threshold"] == t and r["gain"] == pytest.approx(np.where(s[own] >= t, v[own], 0).mean())


def test_gates_against_numpy(spark):
    x, y = sample(400, 3)
    frame = pd.DataFrame({"pos": range(400), "f0": x[:, 0], "f1": x[:, 1], "f2": x[:, 2], "y": y.astype(float), "train": np.arange(400) % 2 == 0})
    rows, train = spark.createDataFrame(frame), frame["train"].to_numpy()
    z = (x - x[train].mean(0)) / x[train].std(0)
    one = np.hstack([np.ones((400, 1)), z])
    w = np.linalg.solve(one[train].T @ one[train] + np.diag([0, 1, 1, 1]), one[train].T @ y[train])
    got = P.ridge_gate(rows, ["f0", "f1", "f2"], "y").orderBy("pos").toPandas()["predicted"].to_numpy()
    assert got == pytest.approx(one @ w)
    opened = P.logistic_policy(rows, ["f0", "f1", "f2"], "y").orderBy("pos").toPandas()["p_open"].to_numpy()
    z = (x - x[train].mean(0)) / x[train].std(0, ddof=1)
    one, w = np.hstack([np.ones((400, 1)), z]), np.zeros(4)
    for _ in range(60):  # Newton steps; the penalty is on weights of columns of unit variance
        p = 1 / (1 + np.exp(-one[train] @ w))
        grad = one[train].T @ (p - y[train]) / train.sum() + 1e-3 * np.r_[0, w[1:]]
        hess = (one[train].T * (p * (1 - p))) @ one[train] / train.sum() + 1e-3 * np.diag([0, 1, 1, 1])
        w -= np.linalg.solve(hess, grad)
    assert opened == pytest.approx(1 / (1 + np.exp(-one @ w)), abs=2e-3)


# V: vectors


def test_spread_and_cka(spark):
    x, y = sample()
    r = V.spread(vectors_of(spark, x, y), "embedding").first()
    c = np.cov(x.T, bias=True)
    values = np.linalg.eigvalsh(c)
    assert r["n"] == 240 and r["participation"] == pytest.approx(values.sum() ** 2 / (values**2).sum()) and r["top_share"] == pytest.approx(values[-1] / values.sum())
    halves = vectors_of(spark, x, y).withColumns({"a": F.slice("embedding", 1, 3), "b": F.slice("embedding", 4, 3)})
    a, b = x[:, :3] - x[:, :3].mean(0), x[:, 3:] - x[:, 3:].mean(0)
    r = V.linear_cka(halves, "a", "b").first()
    assert r["cka"] == pytest.approx(np.linalg.norm(a.T @ b) ** 2 / (np.linalg.norm(a.T @ a) * np.linalg.norm(b.T @ b)))
    assert r["procrustes"] == pytest.approx(np.linalg.svd(a.T @ b, compute_uv=False).sum() / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_permutation_test(spark):
    x, y = sample(60)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)

    def stat(label):
        cos, same = u @ u.T, label[:, None] == label[None]
        within = [np.mean(cos[np.ix_(label == k, label == k)][~np.eye((label == k).sum(), dtype=bool)]) for k in (0, 1)]
        return np.mean(within) - cos[~same].mean()

    r = V.permutation_p(vectors_of(spark, x, y), "embedding", "label", "vec_id", 200).first()
    rng = np.random.default_rng(0)
    plain = np.mean([stat(rng.integers(0, 2, 60)) >= stat(y) for _ in range(400)])
    assert r["difference"] == pytest.approx(stat(y)) and r["p"] == pytest.approx(plain, abs=0.1)


def plain_ridge(x, y, fold, l2=1.0):
    one, out = np.hstack([np.ones((len(x), 1)), x]), np.zeros(len(x))
    for k in set(fold.tolist()):
        rest = fold != k
        w = np.linalg.solve(one[rest].T @ one[rest] + l2 * np.diag([0.0] + [1.0] * x.shape[1]), one[rest].T @ y[rest])
        out[~rest] = one[~rest] @ w
    return out


def test_ridge_probes(spark):
    x, y = sample()
    rows, fold = vectors_of(spark, x, y), np.arange(240) % 4
    got = V.ridge_folds(rows, "embedding", "label", "fold").orderBy("vec_id").toPandas()["predicted"].to_numpy()
    assert got == pytest.approx(plain_ridge(x, y, fold))
    r2 = {r["model"]: (r["r2"], r["bound"]) for r in V.incremental_r2(rows, "embedding", "label", 3, 3, "vec_id").collect()}
    fit = lambda z: 1 - ((y - z @ np.linalg.lstsq(z, y, rcond=None)[0]) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    one = np.hstack([np.ones((240, 1)), x])
    assert r2["H"][0] == pytest.approx(fit(one[:, :4]), abs=1e-6) and r2["H+E"][0] == pytest.approx(fit(one), abs=1e-6)
    assert r2["H+E"][1] == pytest.approx(0.5 * math.log(1 / (1 - (fit(one) - fit(one[:, :4])))), abs=1e-6) and r2["H"][0] <= r2["H+control"][0] <= r2["H+E"][0] + 0.1
    gap = V.information_gap(rows, "embedding", "label", "fold", 3, "vec_id").first()
    plain = ((y - plain_ridge(x[:, :3], y, fold)) ** 2 - (y - plain_ridge(x, y, fold)) ** 2).mean()
    assert gap["n"] == 240 and gap["gain"] == pytest.approx(plain)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
def test_shuffled_control_is_worse(spark):
    """E18: a model of the documents beats one whose tokens are shuffled, and its contrast is that of the joined rows."""
    from corpuslab.plans.registry import load_all

    r = load_all()[0]["e18_real_vs_control"](spark, SF).first()
    assert r["n"] > 1000 and r["delta"] > 0 and r["p_t"] < 0.01 and r["t"] == pytest.approx(r["delta"] / r["sem"])


def test_character_windows_met_at_every_place(spark):
    """Windows of 40 at every offset of both texts, over the edges of blocks, and windows one character too short."""
    rng = random.Random(8)
    noise = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    ref, cand, want = [], [], {}
    for i in range(60):
        long = rng.random() < 0.6
        shared = noise(40 if long else 39)
        at, there = rng.randrange(600), rng.choice([0, 215, 216, 217, 255, 256, 257, rng.randrange(600)])
        ref.append((i, noise(there) + shared + noise(rng.randrange(300))))
        cand.append((100 + i, noise(at) + "0" + shared + "1" + noise(rng.randrange(300))))
        want[100 + i] = long
    cand += [(200, "short"), (201, None)]
    want |= {200: None, 201: None}
    found = C.char_overlap(spark.createDataFrame(cand, "doc_id long, text string"), spark.createDataFrame(ref, "doc_id long, text string"), 40)
    assert {r["doc_id"]: r["overlaps"] for r in found.collect()} == want


def test_hashed_ranks_write_counts_of_buckets_alone(spark, monkeypatch):
    from corpuslab.functions import scale

    kept = []
    real = scale.written
    monkeypatch.setattr(scale, "written", lambda df, name: kept.append(df.columns) or real(df, name))
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f"g{i % 3}", f"v{i}") for i in range(500)], "id long, g string, v string")
    got = {r["id"]: r["rank"] for r in scale.hash_ranked(rows, 7, ["id"], ["g"]).collect()}
    want = sorted(range(500), key=lambda i: ("" if i % 3 == 0 else f"g{i % 3}", hashlib.md5(f"7|{i}".encode()).hexdigest()))
    assert got == {i: k + 1 for k, i in enumerate(want)}
    assert kept and not any("v" in columns for columns in kept)
    # A permutation of values over composite keys deals the same way.
    kept.clear()
    dealt = E.shuffled_within(rows.select("id", F.lit(1).alias("pos"), "v"), "v", ["id", "pos"], 5)
    order = sorted(range(500), key=lambda i: hashlib.md5(f"5|{i}|1".encode()).hexdigest())
    assert {r["id"]: r["v"] for r in dealt.collect()} == {i: f"v{k}" for i, k in enumerate(order)}


def test_sampled_positions_are_chosen_within_rows(spark):
    rng = random.Random(3)
    # Document 5 lies in two rows; short and missing texts have no position.
    rows = [(i, [f"w{rng.randrange(9)}" for _ in range(n)]) for i, n in ((1, 40), (2, 2), (3, 3), (4, 0), (5, 30), (5, 9))] + [(6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    want = C.sample_positions(docs.select("doc_id", F.posexplode("tokens").alias("pos", "token")), 4, 7)
    got = C.sample_positions_of(docs, 4, 7)
    key = lambda df: sorted((r["doc_id"], r["pos"]) for r in df.collect())
    assert key(got) == key(want) and got.columns == want.columns
