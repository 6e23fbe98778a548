"""Figures of held positions by sorted runs against joins of counted tables, and random texts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import ngrams as N


def texts(seed, n, first):
    r = random.Random(seed)
    return [(first + i, " ".join(r.choice("a b c d e f".split()) for _ in range(r.randrange(0, 14)))) for i in range(n)]


def two_parts(spark, order):
    train, held = texts(3, 60, 0), [*texts(4, 25, 1000), (2000, "zz a b"), (2001, "a zz"), (2002, None)]
    return tuple(N.token_rows(spark.createDataFrame(rows, "doc_id long, text string"), order - 1) for rows in (train, held))


@pytest.mark.parametrize("order", [3, 4, 5])
def test_positions_have_the_probabilities_of_the_joined_model(spark, order):
    train, held = two_parts(spark, order)
    model = N.finalize(N.kneser_ney_counts(N.ngram_counts(train, list(range(1, order + 1))), order))
    old = N.matched(held, model, order).select("doc_id", "pos", N.interpolated(order, 6), N.longest_match(order, 6), *[f"n{k}" for k in range(1, order + 1)])
    positions, figures, n_vocab = N.class_model(train, held, order, (order,), tuple(range(1, order)))
    names = [*[f"c{k}" for k in range(1, order)], f"r{order}"]
    new = positions.select("doc_id", "pos", *[N.class_interpolated(names, figures, n_vocab, way) for way in (False, True)], *[F.col(n)["n"] for n in names])
    want, found = ({(r[0], r[1]): tuple(r)[2:] for r in df.collect()} for df in (old, new))
    assert n_vocab == 6 and want.keys() == found.keys() and len(want) > 100
    for key, row in want.items():
        assert found[key][:2] == pytest.approx(row[:2], rel=1e-12) and found[key][2:] == row[2:]


def test_a_window_of_four_shuffles_its_tokens_once(spark):
    """Six shuffles of the four-gram query's model were joins of positions with tables of counts; no context table is made now."""
    train, held = two_parts(spark, 4)
    positions, totals = N.position_figures(train, held, 4, (4,), (1, 2, 3))
    plan = positions._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 5 and totals.where("kind = 'r' AND ord = 4").agg(F.sum(F.col("n") * F.col("k"))).first()[0] == train.where("pos >= 3").count()


def test_nested_mixtures_agree_with_those_of_joined_counts(spark):
    train, held = two_parts(spark, 3)
    part = F.when(F.col("doc_id") % 2 == 0, "dev").otherwise("test")
    candidates = N.candidate_set(train, 3)
    want = N.nested_mixture(held.withColumn("part", part), N.ngram_counts(train, [1, 2, 3]), candidates, [0.2, 0.95])
    found = N.nested_mixture_positions(train, held, part, candidates, [0.2, 0.95])
    rows = [{tuple(r)[:3]: tuple(r)[3:] for r in df.collect()} for df in (want, found)]
    assert rows[0].keys() == rows[1].keys() and len(rows[0]) == 8
    for key, row in rows[0].items():
        assert rows[1][key] == pytest.approx(row, rel=1e-12)


def test_equal_losses_meet_the_grid_once(spark):
    from corpuslab.operators import positions as P

    rows = [(0.5, 1.0, i % 2) for i in range(1000)] + [(2.0, 1.0, 0), (30.0, 40.0, 1)]
    grid = P.mixture_grid(spark.createDataFrame(rows, "nll_p double, nll_q double, g int"), ["g"], 4)
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("MapInPandas") :]
    one = lambda p, q, i: -math.log(max(i / 4 * math.exp(-p) + (1 - i / 4) * math.exp(-q), 1e-12))
    for r in grid.collect():
        assert r["n"] == 501 and r["losses"] == pytest.approx([sum(one(p, q, i) for p, q, g in rows if g == r["g"]) for i in range(5)], rel=1e-12)


def test_a_term_of_all_queries_is_scored_in_several_tasks(spark):
    """The common term was a join key of its own before, so one task scored every document for every query."""
    from corpuslab.operators import retrieval as R

    docs = spark.createDataFrame([(i, "common") for i in range(400)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, "common word") for i in range(20)], "query_id long, text string")
    assert "RepartitionByExpression [doc_id" in R.bm25(docs, queries, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["query_id"], r["doc_id"]) for r in R.bm25(docs, queries, 3).orderBy("query_id", "rank").collect()] == [(q, d) for q in range(20) for d in range(3)]
