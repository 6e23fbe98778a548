"""Hand-sized fixtures and properties of the operators."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from corpuslab.functions.scale import ranked
from corpuslab.operators import address as A
from corpuslab.operators import corpus as C
from corpuslab.operators import evaluation as E
from corpuslab.operators import ngrams as N
from corpuslab.operators import positions as P
from corpuslab.operators import retrieval as R


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate("1 2 3 1 2 3 4".split())], "doc_id long, pos int, token string")


def test_ranked(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    rows = ranked(df, [F.col("v"), F.desc("id")], {"upto": F.col("v")}).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 101))
    assert [(r["v"], r["id"]) for r in rows] == sorted(((i % 7, i) for i in range(100)), key=lambda x: (x[0], -x[1]))
    total = 0
    for r in rows:
        total += r["v"]
        assert r["upto"] == total


def test_counts_and_smoothing_sum_to_one(spark, tiny):
    counts = N.ngram_counts(tiny, [1, 2, 3])
    top = counts.where("ord = 3 and ctx = '1 2'").collect()
    assert [(r["next"], r["n"]) for r in top] == [("3", 2)]
    for smoothing in ("mkn", "kn"):
        model = N.finalize(N.kneser_ney_counts(counts, 3), smoothing)
        for r in model.groupBy("ord", "ctx").agg((F.sum("disc") + F.first("gamma")).alias("mass")).collect():
            assert abs(r["mass"] - 1) < 1e-9
        scored = N.score_interpolated(spark.createDataFrame([(9, 0, "1"), (9, 1, "zzz")], "doc_id long, pos int, token string"), model, 3, 5)
        assert all(math.isfinite(r["logp"]) for r in scored.collect())


def test_backoff_and_memory(spark, tiny):
    counts = N.ngram_counts(tiny, [1, 2, 3])
    logp = {r["pos"]: r["logp"] for r in N.backoff_scores(tiny, counts, 3).collect()}
    assert logp[2] == pytest.approx(0.0) and logp[3] == pytest.approx(math.log(1 / 2))
    q = spark.createDataFrame([(0, ["9", "1", "2"]), (1, ["9", "9"])], "query_id long, tokens array<string>")
    got = N.memory_continuation(q, counts, 3).collect()
    assert [(r["query_id"], r["used"], r["next"], r["p"]) for r in got] == [(0, 3, "3", 1.0)]


def test_memory_retrieve(spark):
    docs = spark.createDataFrame([(0, [str(x) for x in range(10, 16)]), (1, ["99", *[str(x) for x in range(11, 16)]])], "doc_id long, tokens array<string>")
    q = spark.createDataFrame([(0, ["10", "11", "12", "13"]), (1, ["9", "9", "9"])], "query_id long, tokens array<string>")
    got = N.memory_retrieve(q, docs, [2, 3, 4], 5).orderBy("rank").collect()
    assert got[0]["doc_id"] == 0 and got[0]["best_order"] >= 3 and {r["query_id"] for r in got} == {0}


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(0, "Paris is the capital of France"), (1, "Jupiter is a planet"), (2, "Python code"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "capital of France")], "query_id long, text string")
    assert R.bm25(docs, q, 2).orderBy("rank").first()["doc_id"] == 0
    both = spark.createDataFrame([(0, d, r, 1.0) for ranking in ([0, 1, 2], [2, 1, 0]) for r, d in enumerate(ranking)], "query_id long, doc_id long, rank int, weight double")
    fused = R.fuse(both, 5).orderBy("rank").collect()
    assert len(fused) == 3 and fused[0]["doc_id"] in (0, 2)


def test_addresses(spark):
    ids = spark.createDataFrame([(0, i, (i * i) % 50 + 1) for i in range(300)], "doc_id long, pos int, id long")
    spec = A.real_spec()
    assert len(spec.moduli) == 16 and sorted(spec.moduli) == list(spec.moduli) and spec.moduli[0] >= A.BASE
    rows = A.shifted(ids)
    assert rows.where("pos = 0").first()["t1"] == A.EOS
    real = A.resolution(rows.withColumn("address", A.row_ids(spec))).first()
    crushed = A.resolution(rows.withColumn("address", A.row_ids(spec.crushed(10**7)))).first()
    assert real["injective"] and crushed["lost"] > 0


def test_addresses_of_large_vocabularies_wrap(spark):
    ids = [1, 389_113, 389_114, 655_131, 800_000, 2_000_000, 2**31 - 1]
    rows = [(a, b, c) for a in ids for b in ids for c in (A.EOS, ids[-2], 900_000)]
    spec = A.real_spec()
    got = spark.createDataFrame(rows, "id long, t1 long, t2 long").select("id", "t1", "t2", A.row_ids(spec).alias("x")).collect()
    for r in got:
        products = [i * m % 2**64 for i, m in zip((r["id"], r["t1"], r["t2"]), spec.multipliers, strict=True)]
        mixed = [products[0] ^ products[1]] * 8 + [products[0] ^ products[1] ^ products[2]] * 8
        assert r["x"] == [m % p + o for m, p, o in zip(mixed, spec.moduli, spec.offsets, strict=True)]


def test_contamination(spark):
    docs = spark.createDataFrame([(0, "then james it was"), (1, "so James, I was there"), (2, "nothing here")], "doc_id long, text string")
    found = spark.createDataFrame([("james i",)], "needle string")
    assert {r["doc_id"] for r in C.filter_contaminated(docs, found).collect()} == {2}  # a plain substring: "james it" counts
    # Word boundaries: "james it" is not "james i".
    assert not C.eval_contamination(spark.createDataFrame([(0, "who", "james i")], "item_id long, question string, answer string"), docs.where("doc_id = 0")).first()["contaminated"]
    items = spark.createDataFrame([(0, "who", "james i"), (1, "who", "king")], "item_id long, question string, answer string")
    flags = {r["item_id"]: r["contaminated"] for r in C.eval_contamination(items, docs).collect()}
    assert flags == {0: True, 1: None}


def test_budget_keeps_the_crossing_record(spark):
    docs = spark.createDataFrame([(i, "en", 9) for i in range(10)], "doc_id long, lang string, n_tokens int")
    kept = C.select_for_budget(docs, spark.createDataFrame([("en", 25)], "lang string, budget long"), 1)
    assert kept.count() == 3


def test_oracle_routing(spark):
    hit = {"a": "110100", "b": "110010", "c": "000001"}
    rows = [("t", i, arm, int(x) == 1) for arm, xs in hit.items() for i, x in enumerate(xs)]
    got = E.oracle_routing(spark.createDataFrame(rows, "task string, item_id int, arm string, correct boolean"), ["a", "b", "c"]).where("task is null").first()
    assert got["oracle"] == pytest.approx(5 / 6, abs=1e-6) and got["a"] == 0.5 and got["chose_a"] == 3


def test_verdict_order(spark):
    df = spark.createDataFrame([(5.0,), (None,)], "t double")
    assert [r["verdict"] for r in E.verdict(df, [("UP", "t > 3", "high"), ("ANY", "t > 0", "low")], ("NONE", "no rule")).collect()] == ["UP", "NONE"]


def test_margins_and_last_change(spark):
    rec = spark.createDataFrame([(0, 3.0, 2.0), (1, 2.0, 2.5), (2, 5.0, 6.0), (3, float("nan"), 1.0)], "pos long, a double, b double")
    assert sorted(r["margin"] for r in P.margins(rec, "a", "b").collect()) == [-1.0, -0.5, 1.0]
    changed = spark.createDataFrame([(0, True), (1, False), (2, True), (3, False)], "pos long, changed boolean")
    assert [r["last"] for r in P.last_change(changed).orderBy("pos").collect()] == [-1, 0, 0, 2]


def test_planted_mixture_gain(spark):
    rows = [(i, 0, -math.log(0.9 if i // 4 % 2 else 0.001), -math.log(0.1 if i // 4 % 2 else 0.9)) for i in range(2000)]
    rec = spark.createDataFrame(rows, "pos long, g int, nll_p double, nll_q double")
    found = P.crossfit_gain(rec, "g", 4, 100)
    assert found.agg(F.sum("gain")).first()[0] > 0 and all(0 < r["lam"] < 1 for r in found.collect())
    assert P.permuted_null(rec, "g", 1, 4, 50).first()["gain"] < found.agg(F.sum("gain") / F.sum("n")).first()[0]


def test_ridge_gate_refuses_what_a_gate_cannot_see(spark):
    rec = spark.createDataFrame([(0, 1.0, True)], "pos long, delta double, train boolean")
    with pytest.raises(ValueError, match="delta"):
        P.ridge_gate(rec, ["delta"], "delta")


def test_whole_texts_are_the_question(spark, tmp_path):
    from corpuslab.plans.registry import load_all

    start = "the same forty characters begin every text "
    docs = [(1, start + "a"), (2, start + "b"), (3, start + "A!"), (4, start + "known"), (50, "Question: " + start + "known"), (51, start + "c")]
    spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, start + "known")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    queries = load_all()[0]
    got = {r["status"]: r["n"] for r in queries["c14_collect_split_whole"](spark, str(tmp_path)).collect()}
    assert got == {"kept": 3, "duplicate": 1, "excluded": 2}
    assert queries["st1_intake_whole"](spark, str(tmp_path)).first()["fresh"] == 4


SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="the given tables are not here")
def test_grids_are_whole(spark, monkeypatch):
    from corpuslab.operators import vectors as V
    from corpuslab.plans import positions
    from corpuslab.plans.registry import load_all

    queries = load_all()[0]
    rows = [(i, 0, -math.log(0.02 if i % 50 else 0.9), -math.log(0.5 if i % 50 else 0.001)) for i in range(600)]
    rec = spark.createDataFrame(rows, "pos long, grp int, nll_p double, nll_q double")
    monkeypatch.setattr(positions, "records", lambda spark, sf: rec)
    loss = lambda part, i: sum(-math.log(max(i / 1000 * math.exp(-p) + (1 - i / 1000) * math.exp(-q), 1e-12)) for _, _, p, q in part)
    best = lambda part: min(range(1001), key=lambda i: loss(part, i))
    assert 0 < best(rows) < 50
    assert queries["p6_mixture_lambda_fine"](spark, "").first()["lam"] == pytest.approx(best(rows) / 1000)
    for r in queries["p7_crossfit_gain_fine"](spark, "").collect():
        own = [x for x in rows if x[0] % 5 == r["fold"]]
        at = best([x for x in rows if x[0] % 5 != r["fold"]])
        assert r["lam"] == pytest.approx(at / 1000) and r["gain"] == pytest.approx(loss(own, 0) - loss(own, at), abs=1e-5)
    found = queries["p8_permuted_null"](spark, "").first()
    assert found["n_perm"] == 8 and found["verdict"].startswith("COMPLEMENTARITY_")
    assert found["excess"] == pytest.approx(found["gain"] - found["null_gain"]) and found["noise_floor"] == pytest.approx(3 * found["null_std"] / 8**0.5)
    seen = {}
    monkeypatch.setattr(E, "bootstrap", lambda *a: seen.setdefault("e9", a[4:]))
    monkeypatch.setattr(V, "permutation_p", lambda *a: seen.setdefault("v4", a[4:]))
    queries["e9_bootstrap"](spark, SMALLEST)
    queries["v4_permutation_p"](spark, SMALLEST)
    assert seen == {"e9": (2000,), "v4": ()}


def test_two_word_needles_by_brute_force(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("ab1", k=rng.randint(1, 5)))
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 8)))) for i in range(300)] + [(300, None), (301, "ba"), (301, "x ab a y")]
    pairs = [f"{word()} {word()}" for _ in range(6)] + ["ab a"]
    found = spark.createDataFrame([(p,) for p in pairs], "needle string")
    kept = C.filter_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), found)
    bad = {i for i, text in docs if any(p in (text or "") for p in pairs)}
    assert 10 < len(bad) < 250 and {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - bad
