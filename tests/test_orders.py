"""Coupling by blocks, comparison of distributions, slots and window orders against plain recomputations."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import address as A
from corpuslab.operators import evaluation as E
from corpuslab.operators import ngrams as N
from corpuslab.operators import positions as P
from corpuslab.operators import vectors as V


def test_blocks_doses_and_zeros(spark):
    rng = random.Random(1)
    rows = [(p, rng.random() < 0.2, rng.choice([0.0, 0.0005, -2.0, 1.0])) for p in sorted(rng.sample(range(400), 150))]
    split = P.block_split(spark.createDataFrame(rows, "pos long, changed boolean, delta double"), 32).cache()
    last, want = -1, {}
    for p, changed, delta in rows:
        want[p] = (last, last >= 0 and p // 32 == last // 32, last >= 0 and p // 32 != last // 32, changed, delta)
        last = p if changed else last
    got = {r["pos"]: (r["last"], r["same_block"], r["boundary"], r["changed"], r["delta"]) for r in split.collect()}
    assert got == want
    for r in P.dose_response(split, "delta").collect():
        own = [d for p, (at, same, _, changed, d) in want.items() if same and not changed and r["low"] <= p - at <= r["high"]]
        assert r["n"] == len(own)
        if own:
            assert r["mean"] == pytest.approx(sum(own) / len(own)) and r["mean_abs"] == pytest.approx(sum(map(abs, own)) / len(own))
            assert r["above"] == pytest.approx(sum(abs(d) > 1e-3 for d in own) / len(own)) and r["exact_zero"] == pytest.approx(own.count(0.0) / len(own))
    z = P.zero_rule(split, "delta").first()
    zeros = [(boundary, changed) for _, _, boundary, changed, d in want.values() if d == 0]
    assert (z["n"], z["n_zero"], z["n_zero_changed"], z["boundary_zero"]) == (len(rows), len(zeros), sum(c for _, c in zeros), sum(b for b, _ in zeros))
    assert z["zeros_not_boundary"] == sum(not b for b, _ in zeros) and z["zeros_explained"] == pytest.approx(sum(b for b, _ in zeros) / len(zeros))


def test_distributions_with_absent_tokens(spark):
    rng = random.Random(2)
    final, layers = {}, {}
    for item in range(6):
        make = lambda: {t: rng.random() / 4 for t in rng.sample(range(9), rng.randint(1, 6))}
        final[item] = make()
        layers |= {(item, layer): make() for layer in range(3)}
    long = [(i, layer, t, p) for (i, layer), d in layers.items() for t, p in d.items()]
    df = spark.createDataFrame(long, "item long, layer int, token int, p double")
    last = spark.createDataFrame([(i, t, p) for i, d in final.items() for t, p in d.items()], "item long, token int, p double")
    got = {(r["item"], r["layer"]): (r["kl"], r["overlap"]) for r in P.compare_distributions(df, last, 2).collect()}
    assert set(got) == set(layers)
    for (item, layer), d in layers.items():
        tokens = set(d) | set(final[item])
        p, q = ({t: max(x.get(t, 0.0), 1e-12) for t in tokens} for x in (final[item], d))
        kl = sum(p[t] / sum(p.values()) * math.log(p[t] / sum(p.values()) / (q[t] / sum(q.values()))) for t in tokens)
        best = lambda x: set(sorted(x, key=lambda t: (-x[t], t))[:2])
        assert got[item, layer] == (pytest.approx(kl), pytest.approx(len(best(d) & best(final[item])) / 2))
    curve = spark.createDataFrame([(1, 0, 4.0, 0.0), (1, 1, 2.1, 0.3), (1, 2, 2.0, 0.4), (2, 0, 0.0, 0.0)], "item long, layer int, kl double, overlap double")
    assert {r["item"]: (r["by_kl"], r["by_overlap"]) for r in P.distribution_depth(curve).collect()} == {1: (2, 2), 2: (0, None)}


def test_slots_are_rows(spark):
    rows = spark.createDataFrame([("a", 9), ("a", 5), ("a", 9), ("b", 1)], "key string, slot long")
    index = A.slot_index(rows)
    assert {(r["key"], r["slot"], r["n_slots"]) for r in index.collect()} == {("a", 5, 2), ("b", 1, 1)}
    keys = spark.createDataFrame([("a",), ("a",), ("z",)], "key string")
    assert sorted((r["key"], r["contained"], r["n_slots"]) for r in A.find_slots(keys, index).collect() if r["contained"]) == [("a", True, 2)] * 2
    assert sorted(map(tuple, A.slots_of(keys, rows).collect())) == [("a", 5), ("a", 9)]


def test_window_orders(spark):
    rng = random.Random(3)
    slots = {w: rng.randint(0, 5) for w in range(40)}
    df = spark.createDataFrame(list(slots.items()), "window long, slot int").repartition(5)
    digest = lambda w: hashlib.md5(f"7|{w}".encode()).hexdigest()
    orders = {"plain": ({}, sorted(slots)), "seeded": ({"seed": 7}, sorted(slots, key=digest)), "slot": ({"seed": 7, "slot": "slot"}, sorted(slots, key=lambda w: (slots[w], digest(w))))}
    for arguments, want in orders.values():
        got = N.window_order(df, most=25, shards=3, **arguments).orderBy("place").collect()
        assert [r["window"] for r in got] == want[:25] and [r["shard"] for r in got] == [i % 3 for i in range(25)]
    assert sorted(w for i in range(3) for w in (r["window"] for r in N.window_order(df, seed=7, shards=3).where(F.col("shard") == i).collect())) == sorted(slots)


def test_rank_bounds_against_residuals(spark):
    rng = np.random.default_rng(4)
    h, e = rng.normal(size=(300, 4)), rng.normal(size=(300, 5))
    e[:, 0] += h[:, 1]
    y = np.stack([h[:, 0] + e[:, 2], e[:, 2] - 2 * e[:, 3] + 0.1 * rng.normal(size=300), rng.normal(size=300)], axis=1) + 7
    df = spark.createDataFrame([(np.concatenate([h[i], e[i]]).tolist(), *y[i].tolist()) for i in range(300)], "x array<double>, a double, b double, c double").repartition(3)
    got = V.rank_bounds(df, "x", 4, [F.col(c) for c in "abc"], l2=2.0).orderBy("rank").collect()
    hc, ec, yc = (v - v.mean(axis=0) for v in (h, e, y))
    fit = lambda a, b: np.linalg.solve(a.T @ a + 2.0 * np.eye(a.shape[1]), a.T @ b)
    ep, r = ec - hc @ fit(hc, ec), yc - hc @ fit(hc, yc)
    total = (yc**2).sum()
    want = [((ep @ fit(ep, r)) ** 2).sum() / total]
    u = np.linalg.svd(ep.T @ r, full_matrices=False)[0]
    for i in range(3):
        score = ep @ u[:, i : i + 1]
        want.append(((score @ np.linalg.lstsq(score, r, rcond=None)[0]) ** 2).sum() / total)
    assert [x["delta_r2"] for x in got] == pytest.approx(want) and [x["rank"] for x in got] == [0, 1, 2, 3]
    assert [x["cumulative"] for x in got[1:]] == pytest.approx(np.cumsum(want[1:])) and got[0]["bound"] == pytest.approx(-0.5 * math.log(1 - want[0]))


def test_second_rule_and_the_tasks_metric(spark):
    rows = [
        ("boolq", "yes", "assistant\nYes, they are the same.", "yes", True, True), ("boolq", "no", "The correct answer is **B. No**.", "no", True, True),
        ("boolq", "yes", "A. Yes B. No", "", False, False), ("boolq", "no", "Answer: A. Yes.", "yes", False, False),
        ("qa", "Paris", "The answer is: Paris in France.", None, False, True), ("qa", "42", "Answer: forty-two", None, True, True), ("qa", "", "Answer: x", None, False, False), (None, "Rome", "It is Rome.", None, False, True), ("qa", "Rome", None, "", False, False),
    ]
    df = spark.createDataFrame([(i, t, g, x, 3) for i, (t, g, x, *_) in enumerate(rows)], "item_id long, task string, gold string, generated string, n_generated int")
    scored = E.second_scores(df).cache()
    got = {r["item_id"]: r for r in scored.collect()}
    for i, (task, _, _, extracted, exact, contains) in enumerate(rows):
        assert (got[i]["v2_exact"], got[i]["v2_contains"]) == (exact, contains), rows[i]
        assert got[i]["task_metric"] == (exact if task == "boolq" else contains)
        assert extracted is None or got[i]["extracted"].lower() == extracted
    means = {r["task"]: r for r in E.second_metrics(scored.fillna("none", ["task"]), ["task"]).collect()}
    assert means["boolq"]["n"] == 4 and means["boolq"]["task_metric"] == 0.5 and means[None]["n"] == 9
