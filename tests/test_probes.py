"""First-k accuracy, pruned models, calibration, conditional information, dense blocks and growing tables against plain recomputations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import corpus as C
from corpuslab.operators import evaluation as E
from corpuslab.operators import ngrams as N
from corpuslab.operators import positions as P
from corpuslab.operators import retrieval as R
from corpuslab.operators import vectors as V
from corpuslab.streaming import jobs as J


def streams(spark, seed=1, words=12, docs=30):
    """(train, held) token rows of random texts with a skewed vocabulary."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)]
    text = lambda: " ".join(rng.choices(vocab, [1 / (i + 1) for i in range(words)], k=rng.randint(1, 30)))
    made = [spark.createDataFrame([(i, text()) for i in range(n)], "doc_id long, text string") for n in (docs, docs // 2)]
    return [N.token_rows(x) for x in made]


def test_token_rows_match_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, ""), (4, "x")], "doc_id long, text string")
    got = {(r["doc_id"], r["pos"]): (r["token"], r["before"]) for r in N.token_rows(docs, 2).collect()}
    assert got == {(1, 0): ("a", []), (1, 1): ("b", ["a"]), (1, 2): ("c", ["a", "b"]), (1, 3): ("d", ["b", "c"]), (1, 4): ("e", ["c", "d"]), (4, 0): ("x", [])}
    plan = N.token_rows(docs.withColumn("text", F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def plain_model(rows):
    """{(ord, ctx): (gamma, {next: disc})} of a model's rows."""
    out = {}
    for r in rows:
        out.setdefault((r["ord"], r["ctx"]), (r["gamma"], {}))[1][r["next"]] = r["disc"]
    return out


def plain_p(model, ctx, token, order, n_vocab, lookup):
    gamma, entries = model[1, ""]
    p = unigram = entries.get(token, 0.0) + gamma / n_vocab
    for k in range(2, order + 1):
        key = (k, " ".join(ctx[len(ctx) - k + 1 :])) if len(ctx) >= k - 1 else None
        if key in model:
            gamma, entries = model[key]
            p = entries.get(token, 0.0) + gamma * (p if lookup == "interpolate" else unigram)
    return p


@pytest.mark.parametrize("lookup", ["interpolate", "longest"])
@pytest.mark.parametrize("thinned", [False, True])
def test_first_k_of_all_candidates(spark, lookup, thinned):
    """Every candidate scored at every position; also for a model whose shorter orders lack entries of longer ones."""
    train, held = streams(spark)
    level = N.kneser_ney_counts(N.ngram_counts(train, [1, 2, 3]), 3)
    if thinned:
        level = level.where("ord <> 2 or pmod(hash(ctx, next), 3) > 0")
    model = N.finalize(level)
    plain = plain_model(model.collect())
    candidates = N.candidate_set(train, 9)
    names = [r["token"] for r in candidates.collect()]
    got = N.topk_accuracy(held, model, 3, 12, candidates, 3, lookup).first()
    n = inside = first = among = 0
    for r in held.collect():
        ranked = sorted(names, key=lambda t: (-plain_p(plain, r["before"][-2:], t, 3, 12, lookup), t))  # noqa: B023
        n += 1
        inside += r["token"] in names
        first += ranked[0] == r["token"]
        among += r["token"] in ranked[:3]
    assert (got["positions"], got["outside"]) == (n, n - inside) and got["coverage"] == pytest.approx(inside / n)
    assert (got["top1"], got["topk"]) == (pytest.approx(first / inside), pytest.approx(among / inside))
    assert (got["top1_all"], got["topk_all"]) == (pytest.approx(first / n), pytest.approx(among / n))
    assert N.topk_accuracy(held.limit(0), model, 3, 12, candidates).first()["positions"] == 0


def test_loss_frontier_is_that_of_models_made_anew(spark):
    train, held = streams(spark, 2)
    level = N.kneser_ney_counts(N.ngram_counts(train, [1, 2, 3]), 3).cache()
    got = {r["tau"]: r for r in N.loss_frontier(held, level, 3, 12, [1, 2, 3, 50]).collect()}
    sizes = []
    for tau in (1, 2, 3, 50):
        kept = N.prune(level, tau)
        scored = N.score_interpolated(held, N.finalize(kept), 3, 12)
        assert got[tau]["nll"] == pytest.approx(scored.agg(F.avg(-F.col("logp"))).first()[0], rel=1e-9)
        assert got[tau]["entries"] == kept.count() and got[tau]["contexts"] == kept.select("ord", "ctx").distinct().count()
        sizes.append(got[tau]["bytes"])
    assert sizes == sorted(sizes, reverse=True)
    frontier = spark.createDataFrame([(1, 1000, 2.0), (2, 100, 3.0)], "tau int, bytes long, nll double")
    best = {r["budget"]: tuple(r)[1:] for r in N.best_within(frontier, [10, 100, 316, 5000]).collect()}
    assert best[10][:3] == (None, None, None) and best[100] == (2, 100, 3.0, 3.0) and best[5000] == (1, 1000, 2.0, None)
    assert best[316][:3] == (2, 100, 3.0) and best[316][3] == pytest.approx(3 - math.log(3.16) / math.log(10))


def test_nested_mixture_sums_to_one(spark):
    """Over all candidates after one context the mixture is a distribution."""
    train, _ = streams(spark, 3)
    counts, candidates = N.ngram_counts(train, [1, 2, 3]), N.candidate_set(train, 7)
    names = [r["token"] for r in candidates.collect()]
    for context in (["w0", "w1"], ["w3", "nowhere"], ["nowhere", "w0"]):
        asked = spark.createDataFrame([(i, 2, t, context, t) for i, t in enumerate(names)], "doc_id long, pos int, token string, before array<string>, part string")
        asked = asked.withColumn("before", F.col("before").alias("before", metadata={"most": 2}))
        grid = N.nested_mixture(asked, counts, candidates, [0.2, 0.95])
        totals = grid.groupBy("lam_bi", "lam_tri").agg(F.sum(F.exp(-F.col("nll"))).alias("p"), F.count("*").alias("n")).collect()
        assert len(totals) == 4 and all(r["p"] == pytest.approx(1.0) and r["n"] == len(names) for r in totals)


def test_calibration_is_a_full_softmax(spark):
    rng = np.random.default_rng(4)
    rows, tokens = [], 9
    for pos in range(40):
        logits = rng.normal(size=tokens) * 3
        q = np.where(rng.random(tokens) < 0.4, rng.random(tokens), 0.0)
        rows += [(pos, t, float(logits[t]), float(q[t]) if q[t] else (None if t % 2 else 0.0), t == pos % tokens) for t in range(tokens)]
    rows += [(99, 0, 1.0, 0.5, False)]  # no target
    df = spark.createDataFrame(rows, "pos long, token int, logit double, q double, is_target boolean").repartition(3)
    scales, biases, temperatures = [-2.0, 0.0, 1.5], [-1.0, 0.0, 2.0], [0.5, 2.0]
    got = {(r["temperature"], r["scale"], r["bias"]): r for r in P.calibration_grid(df, scales, biases, temperatures).collect()}
    assert len(got) == 18
    for (t, s, b), r in got.items():
        losses = []
        for pos in range(40):
            own = [x for x in rows if x[0] == pos]
            fused = np.array([x[2] + (s * math.log(x[3]) / t + b if x[3] else 0.0) for x in own])
            p = np.exp(fused - fused.max())
            losses.append(-math.log(max(p[pos % tokens] / p.sum(), 1e-12)))
        assert r["nll"] == pytest.approx(np.mean(losses)) and r["n"] == 40
    best = P.best_calibration(P.calibration_grid(df, scales, biases, temperatures)).first()
    assert best["nll"] == pytest.approx(min(r["nll"] for r in got.values())) and best["delta_nats"] == pytest.approx(best["base_nll"] - best["nll"])
    assert P.best_calibration(P.calibration_grid(df.limit(0), scales, biases)).collect() == []


def plain_probe_losses(x, y, fold, n_classes):
    """Held-out losses of a ridge probe on one-hot labels with a temperature from the training folds."""
    out, ok = np.zeros(len(y)), np.zeros(len(y), bool)
    for f in set(fold):
        tr, te = fold != f, fold == f
        mu, sd = x[tr].mean(axis=0), x[tr].std(axis=0)
        z = (x - mu) / sd
        w = np.linalg.solve(z[tr].T @ z[tr] + np.eye(x.shape[1]), z[tr].T @ np.eye(n_classes)[y[tr]])
        nll = lambda rows, tau: -(z[rows] @ w / tau - np.log(np.exp(z[rows] @ w / tau).sum(axis=1, keepdims=True)))[np.arange(rows.sum()), y[rows]]  # noqa: B023, E731
        tau = min(V.TAUS, key=lambda t: nll(tr, t).sum())
        out[te], ok[te] = nll(te, tau), (z[te] @ w).argmax(axis=1) == y[te]
    return out, ok


def test_conditional_information_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = 400
    y = rng.integers(0, 3, n)
    h, e = rng.normal(size=(n, 3)), rng.normal(size=(n, 3)) + 1.2 * np.eye(3)[y]  # only e knows the label
    rows = spark.createDataFrame([(i, np.concatenate([h[i], e[i]]).tolist(), int(y[i])) for i in range(n)] + [(n, None, 1), (n + 1, [0.0] * 6, None)], "id long, x array<double>, label int").repartition(4)
    got = V.conditional_information(rows, "x", "label", "id", 3, folds=4, permutations=2, replicates=400).first()
    data = V.paired_replicates(rows.where("id < 400"), "x", "label", "id", 3, 4, 2, 0).toPandas().sort_values("key")
    gains = {}
    for rep, own in data.groupby("rep"):
        x, fold = np.stack(own["x"].to_numpy()), own["fold"].to_numpy()
        (nll_h, ok_h), (nll_he, ok_he) = plain_probe_losses(x[:, :3], y, fold, 3), plain_probe_losses(x, y, fold, 3)
        gains[rep] = nll_h - nll_he
        if rep == -1:
            assert (got["nll_h"], got["nll_he"], got["acc_h"], got["acc_he"]) == tuple(pytest.approx(v.mean()) for v in (nll_h, nll_he, ok_h, ok_he))
        else:  # every row has another one's further inputs, each used once
            assert np.array_equal(x[:, :3], h) and not (x[:, 3:] == e).all(axis=1).any() and sorted(map(tuple, x[:, 3:])) == sorted(map(tuple, e))
    null = (gains[0] + gains[1]) / 2
    assert got["n"] == n and got["n_classes"] == 3
    assert got["delta"] == pytest.approx(gains[-1].mean()) and got["width_bias"] == pytest.approx(null.mean()) and got["excess"] == pytest.approx((gains[-1] - null).mean())
    half = 1.96 * (gains[-1] - null).std() / math.sqrt(n)
    assert got["excess_lo"] == pytest.approx(got["excess"] - half, rel=0.2) and got["excess_hi"] == pytest.approx(got["excess"] + half, rel=0.2) and got["positive"]
    blind = V.conditional_information(rows.withColumn("x", F.concat(F.slice("x", 4, 3), F.slice("x", 1, 3))), "x", "label", "id", 3, folds=4, replicates=400).first()
    assert blind["excess_lo"] < 0.02 and abs(blind["excess"]) < 0.05


def test_bootstrap_weights_and_interval(spark):
    rng = np.random.default_rng(6)
    weights = E.poisson_weights(rng.integers(-(1 << 63), 1 << 63, 4000), 50)
    assert weights.mean() == pytest.approx(1.0, abs=0.01) and weights.var() == pytest.approx(1.0, abs=0.03)
    assert abs(np.corrcoef(weights[:, 0], weights[:, 1])[0, 1]) < 0.06
    values = rng.normal(0.3, 2.0, 500)
    df = spark.createDataFrame([(i, float(v), i % 2) for i, v in enumerate(values)] + [(900, None, 0)], "id long, v double, g int").repartition(3)
    for r in E.bootstrap(df, "v", ["id"], ["g"], 1000).collect():
        own = values[r["g"] :: 2]
        half = 1.96 * own.std() / math.sqrt(len(own))
        assert (r["n"], r["wins"], r["losses"]) == (250, (own > 0).sum(), (own < 0).sum()) and r["mean"] == pytest.approx(own.mean())
        assert r["lo"] == pytest.approx(own.mean() - half, abs=0.06) and r["hi"] == pytest.approx(own.mean() + half, abs=0.06)


@pytest.mark.parametrize("n, wins", [(5, 5), (20, 0), (20, 13), (999, 540), (1001, 540), (3000, 1600), (3000, 1400), (1, 1)])
def test_exact_tests_at_every_size(spark, n, wins):
    df = spark.createDataFrame([("x", 0.5, wins, n - wins)], "task string, t double, wins long, losses long")
    got = E.with_p_values(df, ["task"]).first()
    tail = lambda w: sum(math.comb(n, i) for i in range(w, n + 1)) / 2**n
    assert got["p_sign"] == pytest.approx(tail(wins), rel=1e-9) and got["p_mcnemar"] == pytest.approx(min(1.0, 2 * tail(max(wins, n - wins))), rel=1e-9)


def test_dense_blocks_against_numpy(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(300, 6)), np.zeros((1, 6)), np.repeat(rng.normal(size=(1, 6)), 5, axis=0)])
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, 2.0])], "doc_id long, vector array<double>")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 7, 300, 303)] + [(5000, [2.0, 1.0])], "query_id long, vector array<double>")
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)
    got = {}
    for r in R.dense(docs, asked, 8, block_rows=40, query_rows=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    for q in (0, 7, 300, 303):
        scores = np.round(u @ u[q], 9)
        want = sorted(range(len(x)), key=lambda i: (-scores[i], i))[:8]
        assert [d for _, d, _ in sorted(got[q])] == want
    assert [d for _, d, _ in got[5000]] == [901]
    assert R.dense(docs.limit(0), asked, 3).collect() == [] and R.dense(docs, asked.limit(0), 3).collect() == []


def test_null_questions_have_a_status(spark):
    items = spark.createDataFrame([(1, "one two", "a"), (2, None, "a"), (3, "One, two", "a")], "item_id long, question string, task string")
    known = spark.createDataFrame([("other",), (None,)], "question string")
    assert {r["item_id"]: r["status"] for r in C.collect_split(items, known, 5).collect()} == {1: "kept", 2: "empty", 3: "duplicate"}


def test_grown_counts_over_batches_and_runs(spark, tmp_path):
    rows = [["a b a", "a c"], ["a a", None, "d"], ["b"]]
    counts = {}
    for i, texts in enumerate(rows):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        for t in texts:
            for w in (t or "").split():
                counts[w] = counts.get(w, 0) + 1
        stream = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        found = J.drain_counts(J.ngrams_of(stream, 1), "gram", "grown", f"file://{tmp_path}/table", buckets=4)
        assert {r["gram"]: r["n"] for r in found.collect()} == counts
        assert found.count() == len(counts)
    # A batch that is run again gives the same version; buckets it does not touch keep their files.
    table = J.GrownCounts(spark, f"file://{tmp_path}/table", "gram", buckets=4)
    last = max(int(p.name) for p in (tmp_path / "table" / "manifest").iterdir())
    before = table.versions(last)
    assert len({v for v in before.values()}) > 1
    table.add(spark.createDataFrame([("b",)], "gram string"), last)
    assert table.versions(last) == before and {r["gram"]: r["n"] for r in table.read(before).collect()} == counts


def test_telemetry_closes_windows_and_drops_late_rows(spark, tmp_path):
    event = "struct<ts: timestamp, event_type: string, value: double>"

    def arrive(*rows):
        spark.createDataFrame([r for r in rows], event).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    import datetime

    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    arrive((at(1), "a", 1.0), (at(1, 30), "a", 2.0), (at(5), "a", 4.0), (None, "a", 100.0))
    stream = lambda: J.telemetry(spark.readStream.schema(event[7:-1].replace(":", "")).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"))

    def run():
        def keep(batch, number):
            batch.write.mode("overwrite").parquet(f"file://{tmp_path}/out/batch={number}")

        stream().writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["start"].hour, r["n"], r["total"]) for r in spark.read.schema("start timestamp_ntz, event_type string, n long, total double").option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/out").collect())

    assert run() == [(1, 2, 3.0)]
    # An hour that is closed takes no late row; one within the watermark does.
    arrive((at(1, 40), "a", 50.0), (at(4), "a", 8.0), (at(12), "a", 1.0))
    assert run() == [(1, 2, 3.0), (4, 1, 8.0), (5, 1, 4.0)]


def test_whole_telemetry_has_open_hours_late_rows_and_rows_without_a_time(spark, tmp_path):
    import datetime

    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    for rows in ([(at(1), "a", 1.0), (at(12), "a", 4.0)], [(at(1, 30), "a", 2.0), (at(12, 5), "b", 8.0), (None, "a", 16.0)]):
        spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    events = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = {(r["start"] and r["start"].hour, r["event_type"], r["n"], r["total"]) for r in J.drain(J.telemetry_whole(events), "whole", "complete").collect()}
    assert got == {(1, "a", 2, 3.0), (12, "a", 1, 4.0), (12, "b", 1, 8.0), (None, "a", 1, 16.0)}
