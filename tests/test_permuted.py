"""The permuted null against a plain permutation, over several blocks of ranks."""

import hashlib
import random

import numpy as np
import pytest

from corpuslab.operators import positions as P


def test_permuted_losses_are_added_up_without_permuted_rows(spark, monkeypatch):
    """Every replicate was a table of rows joined by rank, and rows were written for it."""
    tables, real = [], P.written
    monkeypatch.setattr(P, "written", lambda df, name: tables.append(df.columns) or real(df, name))
    monkeypatch.setattr(P, "BLOCK_ROWS", 64)
    monkeypatch.setattr(P, "PACKED_ROWS", 150)
    rng = random.Random(2)
    rows = [(i * 3, rng.choice(["a", "b", "b", None]), rng.choice([0.1, 0.5, 2.5, rng.random()]), rng.choice([0.3, 1.2, 40.0])) for i in range(900)]
    found = P.permuted_null(spark.createDataFrame(rows, "pos long, g string, nll_p double, nll_q double"), "g", 2, 4, 20)
    gains = {r["perm"]: r["gain"] for r in found.collect()}
    assert tables and not any("nll_p" in columns for columns in tables)
    for perm in (0, 1):
        gain = 0.0
        for g in ("a", "b", None):
            own = sorted(r for r in rows if r[1] == g)
            dealt = sorted(own, key=lambda r: hashlib.md5(f"{100 + perm}|{r[0]}".encode()).hexdigest())
            fold = np.array([r[0] % 4 for r in own])
            p, q = np.exp([-r[2] for r in dealt]), np.exp([-r[3] for r in own])
            loss = np.stack([-np.log(np.maximum(i / 20 * p + (1 - i / 20) * q, 1e-12)) for i in range(21)])
            for f in range(4):
                at = loss[:, fold != f].sum(axis=1).argmin()
                gain += (loss[0] - loss[at])[fold == f].sum()
        assert gains[perm] == pytest.approx(gain / len(rows))


def test_products_of_losses_are_sums_of_logarithms():
    rng = np.random.default_rng(3)
    p, q, times = rng.exponential(4, 700), rng.exponential(20, 700), np.where(np.arange(700) < 650, 1, 3)
    grid = np.linspace(0, 1, 11)
    want = [-(np.log(np.maximum(w * np.exp(-p) + (1 - w) * np.exp(-q), 1e-12)) * times).sum() for w in grid]
    assert P._grid_losses(grid, p, q, times) == pytest.approx(want, rel=1e-13)
    assert P._grid_losses(grid, -10 * p, q, times) == pytest.approx([-(np.log(np.maximum(w * np.exp(10 * p) + (1 - w) * np.exp(-q), 1e-12)) * times).sum() for w in grid], rel=1e-12)
