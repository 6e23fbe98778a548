"""Queries V1-V9 over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions.storage import read
from corpuslab.operators import positions as P
from corpuslab.operators import vectors as V

from .registry import query


def rows(spark, sf):
    return read(spark, sf, "embeddings").withColumn("fold", (F.col("vec_id") % 5).cast("int"))


def halves(spark, sf):
    return rows(spark, sf).withColumns({"a": F.slice("embedding", 1, 32), "b": F.slice("embedding", 33, 32)})


HALVES = "WITH h AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE)[1:32] AS a, list_transform(embedding, lambda x: x::DOUBLE)[33:64] AS b FROM embeddings)"


@query("v1_pair_similarity", f"{HALVES} SELECT label, count(*) AS n, round(avg(list_cosine_similarity(a, b)), 6) AS cosine, round(avg(list_distance(a, b) / sqrt(list_inner_product(b, b))), 6) AS relative_l2, round(avg(sqrt(list_inner_product(a, a) / list_inner_product(b, b))), 6) AS norm_ratio FROM h GROUP BY label")
def v1(spark, sf):
    out = V.pair_similarity(halves(spark, sf), "a", "b")
    return out.groupBy("label").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("cosine", "relative_l2", "norm_ratio")])


UNITS = "WITH u AS (SELECT label, unnest(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), s AS (SELECT label, d, count(*) AS n, sum(x) AS s FROM u GROUP BY ALL)"


@query("v2_within_cosine", f"{UNITS} SELECT label, max(n) AS n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 6) AS within FROM s GROUP BY label")
def v2(spark, sf):
    out = V.within_cosine(V.summed_units(rows(spark, sf), ["label"], "embedding"))
    return out.select("label", "n", F.round("within", 6).alias("within"))


@query("v2_across_cosine", f"{UNITS} SELECT x.label AS a, y.label AS b, round(sum(x.s * y.s) / (max(x.n) * max(y.n)), 6) AS across FROM s x JOIN s y ON x.d = y.d AND x.label < y.label GROUP BY ALL")
def v2_across(spark, sf):
    return V.across_cosine(V.summed_units(rows(spark, sf), ["label"], "embedding"), "label").withColumn("across", F.round("across", 6))


@query("v3_spread")
def v3(spark, sf):
    return V.spread(rows(spark, sf), "embedding")


@query("v4_permutation_p")
def v4(spark, sf):
    return V.permutation_p(rows(spark, sf).withColumn("half", (F.col("label") >= 5).cast("int")), "embedding", "half", "vec_id")


@query("v5_ridge_folds")
def v5(spark, sf):
    data = rows(spark, sf).withColumn("y", (F.col("label") >= 5).cast("int"))
    scored = V.ridge_folds(data, "embedding", "y", "fold").withColumn("predicted", F.round("predicted", 9))
    return P.auc(scored, "predicted", "y")


@query("v6_incremental_r2")
def v6(spark, sf):
    return V.incremental_r2(rows(spark, sf), "embedding", "label", 32, 3, "vec_id").select("model", "r2")


@query("v7_information_bound")
def v7(spark, sf):
    return V.incremental_r2(rows(spark, sf), "embedding", "label", 16, 3, "vec_id").select("model", "bound")


@query("v7_rank_curve")
def v7_ranks(spark, sf):
    """Bound of the second half of an embedding on its label beside the first half, direction by direction."""
    return V.rank_bounds(rows(spark, sf), "embedding", 32, [(F.col("label") == c).cast("double") for c in range(10)])


@query("v8_information_gap")
def v8(spark, sf):
    return V.information_gap(rows(spark, sf), "embedding", "label", "fold", 32, "vec_id")


@query("v8_conditional_information")
def v8_conditional(spark, sf):
    """What the second half of an embedding tells about its label beside the first half, against permuted halves."""
    return V.conditional_information(read(spark, sf, "embeddings"), "embedding", "label", "vec_id", 32)


@query("v9_linear_cka")
def v9(spark, sf):
    return V.linear_cka(halves(spark, sf), "a", "b")
