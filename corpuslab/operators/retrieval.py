"""Retrieval in batch: queries in, rankings (query_id, channel, rank, doc_id, score) out; ranks from 0."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions.storage import written

from .ngrams import memory_retrieve


def top(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best rows per query, ties to the smaller doc_id, with ``rank`` from 0; tasks cut to k before the shuffle."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id"))
    return df.withColumn("rank", place).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank) by BM25; a term repeated in a query counts again; only matching documents.

    Postings are made for query terms only: the terms join before anything is counted. They are dealt by document, and
    the terms of the queries, a stated set, are broadcast with their weights: so a very common term, which meets most
    queries in most documents, is spread over all tasks, where a document's scores are summed and cut to the k best.
    """
    asked = queries.select("query_id", F.explode(T.word_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    words = docs.select("doc_id", T.word_tokens(F.col("text")).alias("w"))
    sizes = words.agg(F.count("*").alias("n_docs"), F.avg(F.size("w")).alias("mean_size"))
    terms = asked.select("term").distinct()
    postings = words.select("doc_id", F.size("w").alias("size"), F.explode("w").alias("term")).join(terms, "term", "left_semi").groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("size").alias("size"))
    postings = written(postings, "postings")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    weighted = asked.join(df, "term").join(F.broadcast(sizes)).withColumn("idf", F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean_size")))
    dealt = postings.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    scores = dealt.join(F.broadcast(weighted), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * F.col("idf") * tf), 9).alias("score"))
    return top(scores, k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    return T.let(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))


def dense(docs: DataFrame, queries: DataFrame, k: int, block_rows: int = 8192, query_rows: int = 1024) -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine of (…_id, vector) rows, exact.

    Vectors are dealt to blocks and queries, a stated set, to groups of bounded size by hashes; a task has one block
    and one group, multiplies them and keeps the k best of each query, ties to the smaller doc_id. So no key holds all
    vectors or all queries, and k rows per query and block reach the final window. A zero vector has score 0; null
    vectors take no part; vectors meet those of their own length.
    """
    sizes = docs.agg(F.count("*")).first()[0], queries.agg(F.count("*")).first()[0]
    blocks, groups = max(1, -(-sizes[0] // block_rows)), max(1, -(-sizes[1] // query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    doubles = F.transform("vector", lambda v: v.cast("double")).alias("vector")
    left = docs.where("vector is not null").select("doc_id", doubles, F.size("vector").alias("width"), dealt("doc_id", blocks).alias("block"), every(groups).alias("grp"))
    right = queries.where("vector is not null").select("query_id", doubles, F.size("vector").alias("width"), every(blocks).alias("block"), dealt("query_id", groups).alias("grp"))
    kinds = docs.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def units(rows: pd.DataFrame) -> np.ndarray:
        x = np.stack(rows["vector"].to_numpy())
        norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)

    def best(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if data.empty or asked.empty:
            return pd.DataFrame({"query_id": asked["query_id"][:0], "doc_id": data["doc_id"][:0], "score": np.zeros(0)})
        data = data.sort_values("doc_id", kind="stable")
        ids, names = data["doc_id"].to_numpy(), asked["query_id"].to_numpy()
        scores = np.round(units(asked) @ units(data).T, 9)
        kept = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query_id": np.repeat(names, kept.shape[1]), "doc_id": ids[kept.ravel()], "score": np.take_along_axis(scores, kept, axis=1).ravel()})

    keys = ["block", "grp", "width"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"query_id {kinds[1]}, doc_id {kinds[0]}, score double")
    return top(found, k)


def text_vectors(texts: DataFrame, weights: DataFrame, key: str, dims: int = 256) -> DataFrame:
    """(key, vector) of (key, text): every word adds a signed weight to one of ``dims`` hashed places.

    A word that occurs n times in the text adds (1 + ln n) times its weight in ``weights`` (token, idf); words without
    a weight add nothing. Place and sign come from a digest of the word, so that texts and queries made apart agree.
    Texts without a weighted word have no vector.
    """
    words = texts.select(key, F.explode(T.word_tokens(F.col("text"))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    digest = F.md5("token")
    place = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dims).cast("int")
    sign = F.when(F.substring(digest, 9, 1) < "8", 1.0).otherwise(-1.0)
    cells = words.join(weights, "token").groupBy(key, place.alias("dim")).agg(F.sum(sign * (1 + F.ln("n")) * F.col("idf")).alias("x"))
    held = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dim", "x"))).alias("m"))
    return held.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vector"))


def idf_weights(docs: DataFrame) -> DataFrame:
    """(token, idf): ln((N + 1) / (df + 1)) + 1 of every word of the documents (doc_id, text)."""
    words = docs.select(F.explode(F.array_distinct(T.word_tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    size = docs.agg(F.count("*").alias("n_docs"))
    return words.join(F.broadcast(size)).select("token", (F.ln((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def dense_texts(docs: DataFrame, queries: DataFrame, k: int, dims: int = 256) -> DataFrame:
    """Documents by cosine of hashed tf-idf vectors, as a ranking (query_id, doc_id, score, rank)."""
    weights = written(idf_weights(docs), "idf")
    return dense(written(text_vectors(docs, weights, "doc_id", dims), "doc-vectors"), written(text_vectors(queries, weights, "query_id", dims), "query-vectors"), k)


def mean_vectors(rows: DataFrame, by: list[str], vector: str = "vector") -> DataFrame:
    """Element-wise mean of a vector column per group; vectors may differ in length, null ones are left out."""
    cells = rows.select(*by, F.posexplode(vector).alias("dim", "x"))
    means = cells.groupBy(*by, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean"))


def ngram_channel(docs: DataFrame, queries: DataFrame, k: int, orders=(2, 3, 4)) -> DataFrame:
    """Documents by matches of the query's suffixes, as a ranking."""
    tokens = lambda df, key: df.select(key, T.word_tokens(F.col("text")).alias("tokens"))
    return memory_retrieve(tokens(queries, "query_id"), tokens(docs, "doc_id"), list(orders), k).select("query_id", "doc_id", F.col("score").cast("double").alias("score"), (F.col("rank") - 1).alias("rank"))


def fuse(rankings: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank, weight): weight / (constant + rank + 1)."""
    scores = rankings.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") / (F.lit(constant) + F.col("rank") + 1)), 12).alias("score"))
    return top(scores, k)


def hybrid(channels: dict[str, DataFrame], weights: DataFrame, k: int, pool: int = 50) -> DataFrame:
    """Fusion of the channels' rankings, at most ``pool`` deep, by the query's routed weights (query_id, channel…)."""
    both = None
    for name, ranking in channels.items():
        part = ranking.where(F.col("rank") < pool).join(weights.select("query_id", F.col(name).alias("weight")), "query_id").where("weight > 0").select("query_id", "doc_id", "rank", "weight")
        both = part if both is None else both.unionByName(part)
    return fuse(both, k)


def recall(rankings: DataFrame, targets: DataFrame, ks=(1, 3, 5), by: list[str] | None = None) -> DataFrame:
    """recall@k and MRR against the targets (query_id, doc_id), several of which count by the best rank."""
    names = by or []
    hits = rankings.join(targets, ["query_id", "doc_id"]).groupBy(*names, "query_id").agg(F.min("rank").alias("best"))
    asked = targets.select("query_id").distinct()
    if names:
        asked = asked.join(F.broadcast(rankings.select(*names).distinct()))
    joined = asked.join(hits, [*names, "query_id"], "left")
    cols = [F.avg(F.coalesce(F.col("best") < k, F.lit(False)).cast("int")).alias(f"recall_{k}") for k in ks]
    return joined.groupBy(*names).agg(F.count("*").alias("queries"), *cols, F.avg(F.coalesce(1 / (F.col("best") + 1), F.lit(0.0))).alias("mrr"))


def knn_mixture(neighbours: DataFrame, labels: DataFrame, base: DataFrame, targets: DataFrame, tau: float, lam: float) -> DataFrame:
    """(query_id, nll, hit): (1 - lam) base + lam kNN vote, the vote a softmax of clipped similarity / tau.

    ``neighbours``: (query_id, doc_id, score); ``labels``: (doc_id, label); ``base``: (query_id, label, p).
    """
    e = F.exp(F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.col("score") / tau)))
    votes = neighbours.join(labels, "doc_id").groupBy("query_id", "label").agg(F.sum(e).alias("e"))
    total = votes.groupBy("query_id").agg(F.sum("e").alias("z"))
    knn = votes.join(total, "query_id").select("query_id", "label", (F.col("e") / F.col("z")).alias("knn"))
    mixed = base.join(knn, ["query_id", "label"], "full_outer").select("query_id", "label", ((1 - lam) * F.coalesce("p", F.lit(0.0)) + lam * F.coalesce("knn", F.lit(0.0))).alias("p"))
    best = mixed.groupBy("query_id").agg(F.max(F.struct(F.round("p", 9).alias("p"), F.negative("label").alias("m"))).alias("x")).select("query_id", F.negative("x.m").alias("best"))
    own = targets.join(mixed, ["query_id", "label"], "left").join(best, "query_id", "left")
    return own.select("query_id", (-F.ln(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(1e-12)))).alias("nll"), (F.col("best") == F.col("label")).alias("hit"))


def transition_hits(rankings: DataFrame, docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, exact, any): does a retrieved text have the transition context -> target, or the target at all.

    ``asked``: (query_id, context, target); ``docs``: (doc_id, pos, token, before), as rows of tokens bring it along.
    """
    pairs = docs.select("doc_id", "token", F.try_element_at("before", F.lit(-1)).alias("previous"))
    wanted = rankings.select("query_id", "doc_id").join(asked, "query_id").withColumnRenamed("target", "token")
    met = pairs.join(wanted, ["doc_id", "token"])
    hits = met.groupBy("query_id").agg(F.max(F.col("previous") == F.col("context")).alias("exact"), F.lit(True).alias("any"))
    return asked.join(hits, "query_id", "left").select("query_id", F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("any", F.lit(False)).alias("any"))


def neighbour_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(query_id, overlap): share of the k neighbours that two rankings have in common."""
    lists = lambda r, name: r.groupBy("query_id").agg(F.collect_set("doc_id").alias(name))
    return lists(a, "x").join(lists(b, "y"), "query_id").select("query_id", (F.size(F.array_intersect("x", "y")) / k).alias("overlap"))
