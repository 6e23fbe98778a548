"""Memory features, gate studies and audits against plain recomputations in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import corpus as C
from corpuslab.operators import memory as M


def test_features_against_numpy(spark):
    rng = np.random.default_rng(5)
    logits = rng.normal(size=(30, 12)) * 3
    q = np.where(rng.random((30, 12)) < 0.4, rng.random((30, 12)), 0.0)
    q[3] = 0.0
    logits[4, 2] = logits[4, 7] = 9.0
    rows = [(p, t, float(logits[p, t]), float(q[p, t]) if q[p, t] or t % 2 else None) for p in range(30) for t in range(12)]
    got = {r["pos"]: r for r in M.memory_features(spark.createDataFrame(rows, "pos int, token int, logit double, q double").repartition(3)).collect()}
    assert len(got) == 30
    for p in range(30):
        lb = logits[p] - np.log(np.exp(logits[p]).sum())
        r, best = got[p], int(np.argmax(logits[p]))
        assert math.isclose(r["base_entropy"], -(np.exp(lb) * lb).sum(), rel_tol=1e-9)
        assert math.isclose(r["base_top1_prob"], math.exp(lb[best]), rel_tol=1e-9)
        held = q[p] > 0
        if not held.any():
            assert r["support"] == 0 and r["expected"] is None and r["memory_entropy"] is None and r["agrees"] is False
            continue
        pm = q[p] / q[p].sum()
        lm = np.log(pm[held])
        top = int(np.argmax(pm))
        assert math.isclose(r["memory_entropy"], -(pm[held] * lm).sum(), rel_tol=1e-9)
        assert math.isclose(r["expected"], (pm[held] * (lm - lb[held])).sum(), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r["memory_top1"], math.log(pm[top]) - lb[top], rel_tol=1e-9, abs_tol=1e-9)
        assert r["agrees"] == (top == best)
        assert (r["pseudo"] is None) == (not held[best])
        if held[best]:
            assert math.isclose(r["pseudo"], math.log(pm[best]) - lb[best], rel_tol=1e-9, abs_tol=1e-9)


def test_gates_by_mode(spark):
    rows = [(1, 0.6, 0.1, 0.2, "code"), (2, 0.6, -0.1, 0.9, None), (3, 0.6, 0.9, 0.9, "semantic"), (4, None, None, None, "code"), (5, 0.1, 0.9, 0.4, "name")]
    f = spark.createDataFrame(rows, "pos int, expected double, pseudo double, memory_top1 double, task string").withColumn("agrees", F.col("pos") == 1)
    opened = lambda mode: {r["pos"] for r in M.memory_gate(f, mode, 0.5).where("open").collect()}
    assert (opened("expected_kl"), opened("pseudo_label"), opened("memory_top1"), opened("hybrid")) == ({1, 2}, {5}, {2}, {1})
    grid = {(r["mode"], r["threshold"]): (r["n"], r["opened"], r["agreeing"]) for r in M.gate_grid(f, [0.0, 0.5]).collect()}
    assert grid["hybrid", 0.5] == (5, 1, 1) and grid["hybrid", 0.0] == (5, 2, 1) and grid["expected_kl", 0.5] == (5, 2, 1)
    assert {c: r for c, r in M.one_hot(f.where("pos = 2"), "task", ["code", "general"]).first().asDict().items() if c.startswith("task_")} == {"task_code": 0.0, "task_general": 1.0}


def test_gate_study_against_numpy(spark):
    rng = np.random.default_rng(8)
    n, folds = 403, 4
    x = np.column_stack([rng.normal(size=n) * 5 + 2, rng.normal(size=n), np.full(n, 3.0)])
    gain = 0.3 * (x[:, 0] - 2) - 0.5 * x[:, 1] + rng.normal(size=n)
    rows = [(i, *map(float, x[i]), float(gain[i])) for i in range(n)] + [(n, None, 1.0, 3.0, 1.0)]
    records = spark.createDataFrame(rows, "pos long, f0 double, f1 double, f2 double, gain double").repartition(3)
    out = M.gate_study(records, ["f0", "f1", "f2"], "gain", folds)
    got = {r["pos"]: r for r in out.collect()}
    assert len(got) == n
    fold = np.array([got[i]["fold"] for i in range(n)])
    assert list(fold) == sorted(fold) and len(set(fold)) == folds
    for g in range(folds):
        keep, left = fold != g, np.flatnonzero(fold == g)
        mu, sd = x[keep].mean(axis=0), x[keep].std(axis=0)
        sd[sd < 1e-9] = 1.0
        z = np.column_stack([np.ones(n), (x - mu) / sd])
        w = np.linalg.solve(z[keep].T @ z[keep] + np.diag([0, 1, 1, 1.0]), z[keep].T @ gain[keep])
        assert np.allclose([got[i]["ridge"] for i in left], z[left] @ w, atol=1e-7)
        v = np.zeros(4)
        for _ in range(60):
            p = 1 / (1 + np.exp(-z[keep] @ v))
            reg = 1e-3 * np.diag([0, 1, 1, 1.0])
            h = (z[keep] * (p * (1 - p))[:, None]).T @ z[keep] / keep.sum() + reg
            v = v - np.linalg.lstsq(h, z[keep].T @ (p - (gain[keep] > 0)) / keep.sum() + reg @ v, rcond=None)[0]
        assert np.allclose([got[i]["logistic"] for i in left], 1 / (1 + np.exp(-z[left] @ v)), atol=1e-7)
    report = {r["policy"]: r for r in M.gate_report(out, "gain").collect()}
    ridge = np.array([got[i]["ridge"] for i in range(n)])
    assert math.isclose(report["ridge"]["gain"], np.where(ridge > 0, gain, 0).mean()) and report["oracle"]["share"] == 1.0
    assert report["ridge"]["gain"] > report["always"]["gain"]
    with pytest.raises(ValueError, match="not observable"):
        M.gate_study(records.withColumn("margin", F.col("gain")), ["margin"], "gain")


def test_row_gating_by_hand(spark):
    rows = spark.createDataFrame([(True, True, 1.0, 3.0), (True, False, 2.0, 0.0), (False, True, 4.0, 1.0), (None, False, 0.0, -0.5)], "selected boolean, changed boolean, delta_a double, delta_b double")
    assert M.gating_table(rows).first().asDict() == {"n": 4, "both": 1, "selected_only": 1, "changed_only": 1, "neither": 1, "agreement": 0.5}
    assert M.gating_table(rows.limit(0)).first()["agreement"] == 1.0
    out = {r["region"]: r for r in M.region_means(rows).collect()}
    assert (out["untouched"]["n"], out["untouched"]["absmax_b"], out["untouched"]["zero_share"]) == (2, 0.5, 0.5)
    assert out["selected"]["mean_difference"] == 0.0 and out["all"]["mean_a"] == 1.75
    assert M.region_means(rows.limit(0)).where("n = 0 and mean_a is null").count() == 4
    bands = {r["threshold"]: tuple(r)[1:] for r in M.band_sums(spark.createDataFrame([(5, 1.0), (2, 3.0), (None, 9.0)], "c int, v double"), "c", "v", [2, 5, 9]).collect()}
    assert bands == {2: (2, 2 / 3, 4 / 3), 5: (1, 1 / 3, 1 / 3), 9: (0, 0.0, 0.0)}


def test_projection_and_findings_by_hand(spark):
    fits = spark.createDataFrame([(0.5, 1.0), (0.1, 1.0), (1.5, 0.0), (-0.2, 1.0), (None, None)], "exponent double, intercept double")
    got = {r["exponent"]: (r["tokens_needed"], r["note"]) for r in M.projection(fits, 1e6).collect()}
    assert math.isclose(got[0.5][0], math.exp((math.log(1e6) - 1) / 0.5)) and got[0.5][1] == "ok"
    assert got[0.1][1] == "saturating" and got[1.5][1] == "upper_bound" and got[-0.2] == (None, "saturating") and got[None] == (None, "no_fit")
    curve = spark.createDataFrame([(n, 2.0 + 30.0 / math.sqrt(n)) for n in (100, 400, 900)], "n_tokens long, nll double")
    fit = M.learning_curve(curve).first()
    assert (round(fit["asymptote"], 9), round(fit["slope"], 9)) == (2.0, 30.0)
    assert M.learning_curve(curve.limit(2)).first()["asymptote"] is None

    items = spark.createDataFrame([(1, "red fox"), (2, "one"), (3, "no such words"), (4, None), (5, "a b c d e f")], "item_id long, answer string")
    docs = spark.createDataFrame([(10, "the red fox, a red fox"), (11, "Red fox"), (12, None), (13, "x a b c d e f g"), (14, "a b c d e")], "doc_id long, text string")
    found = {r["item_id"]: (r["docs"], r["first_doc"]) for r in C.contamination_findings(items, docs).collect()}
    assert found == {1: (2, 10), 5: (1, 13)}
