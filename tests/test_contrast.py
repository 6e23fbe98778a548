"""A model of the texts against one of their shuffled tokens, from counted pairs, by plain recomputation."""

import hashlib
import math
import random
from collections import Counter

import pytest

from corpuslab.operators import evaluation as E
from corpuslab.operators import gates as G
from corpuslab.operators import ngrams as N


def test_pairs_of_shuffled_tokens_over_several_buckets(spark, monkeypatch):
    """Positions, shuffled tokens and their scores were tables of a row per position; pairs and words are counted now."""
    tables, real = [], G.written
    monkeypatch.setattr(G, "written", lambda df, name: tables.append(df.columns) or real(df, name))
    monkeypatch.setattr(G, "BUCKET_ROWS", 40)
    rng = random.Random(4)
    texts = [(i * 2, i % 4 == 0, " ".join(rng.choice(["a", "b", "b", "c", f"w{rng.randrange(20)}", "7"]) for _ in range(rng.choice([0, 1, 2, 30])))) for i in range(90)]
    lists = N.token_lists(spark.createDataFrame(texts, "doc_id long, held boolean, text string"), "held")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        rows = G.bigram_contrast(lists, 5).collect()
        train = [(i, t.split()) for i, h, t in texts if not h]
        places = [(i, p) for i, t in train for p in range(len(t))]
        order = sorted(((i, p, w) for i, t in train for p, w in enumerate(t)), key=lambda x: hashlib.md5(f"5|{x[0]}|{x[1]}".encode()).hexdigest())
        mixed = dict(zip(places, [w for *_, w in order], strict=True))
        control = Counter((mixed[i, p - 1], mixed[i, p]) for i, p in places if p)
        found = Counter()
        for r in G.shuffled_pairs(lists.where("not held").select("doc_id", "tokens"), 5).collect():
            found[r["w1"], r["token"]] += r["n"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == control and len(order) > 500
    assert tables and not any({"pos", "doc_id"} & set(columns) for columns in tables)
    words, want = Counter(w for _, t in train for w in t), Counter()
    bigrams = [Counter((t[p - 1], t[p]) for _, t in train for p in range(1, len(t))), control]
    top = lambda of: min(of, key=lambda w: (-of[w], w))
    for _, h, t in texts:
        for p, w in enumerate(t.split() if h else []):
            out = [w]
            for counts in bigrams:
                after = {b: n for (a, b), n in counts.items() if p and a == t.split()[p - 1]}
                share = words[w] / len(order) or 1e-12
                out += [round(math.log(after.get(w, 0) / sum(after.values()) or share if after else share), 9), w == top(after or words), bool(after)]
            want[tuple(out)] += 1
    got = Counter()
    for r in rows:
        got[r["token"], round(r["real_logp"], 9), r["real_top"], r["real_known"], round(r["control_logp"], 9), r["control_top"], r["control_known"]] += r["times"]
    assert got == want


def test_weighted_figures_are_those_of_repeated_rows(spark):
    rows = [(0.5, 1.0, 3), (2.0, 1.0, 1), (1.0, 1.0, 2), (0.1, 0.7, 5)]
    want = E.paired_delta(spark.createDataFrame([r[:2] for r in rows for _ in range(r[2])], "a double, b double"), []).first()
    got = E.weighted_delta(spark.createDataFrame(rows, "a double, b double, times long")).first()
    assert got.asDict() == pytest.approx(want.asDict())
