"""Approximate nearest neighbours by collision counting over sorted single projections.

Inner product becomes Euclidean distance by the usual lift: every vector gets one more component that brings it
to the largest norm, queries get zero there. Each block of vectors keeps, for each of ``n_projections`` random
lines, its vectors in the order of their projections. A query opens a window around its own projection on every
line; virtual rehashing widens all windows by one series of widths, without new hash functions. On each line two
pointers move outward, and only the vectors they pass are counted. The windows stop growing once
``candidate_factor * sqrt(k * n)`` of the block's n vectors have fallen into the window on at least
``collision_share`` of the lines. All those are verified by their exact inner product in double precision. A
block's best k are merged per query over all blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector takes part: not null or empty, all components finite, not all zero."""
    x = F.col("embedding")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(x.isNotNull() & F.col("vec_id").isNotNull()).where(finite & F.exists(x, lambda v: v != 0))


def one_per_id(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, embedding): of several rows with one id and length, the vector that comes first in order of its components.

    Tasks keep one row per id before the shuffle, so an id that holds many rows fills no task.
    """
    return vectors.groupBy("vec_id", F.size("embedding").alias("dim")).agg(F.min("embedding").alias("embedding"))


def inner_products(by_component: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products in double precision, added up from the first component to the last."""
    out = np.zeros(by_component.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        for column, value in zip(by_component, q, strict=True):
            out += column * value
    return out


class SortedProjections:
    """One block of lifted vectors in the order of their projections on random lines."""

    def __init__(self, lifted: np.ndarray, n_projections: int, seed: int):
        self.lines = np.random.default_rng(seed).standard_normal((n_projections, lifted.shape[1]))
        projected, self.n = self.lines @ lifted.T, len(lifted)
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, axis=1)
        #: Where each vector stands on each line, in the smallest numbers that hold a window's size.
        self.place = np.empty(self.order.shape, np.uint16 if self.n < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, self.order, np.arange(self.n, dtype=self.place.dtype)[None, :], axis=1)

    def windows(self, queries: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end position of each window, by query, width and line."""
        at = np.stack([self.lines @ q for q in queries])
        low = np.empty((len(queries), len(widths), len(self.lines)), np.int64)
        high = np.empty_like(low)
        for line, values in enumerate(self.sorted):
            low[:, :, line] = values.searchsorted(at[:, line, None] - widths)
            high[:, :, line] = values.searchsorted(at[:, line, None] + widths, "right")
        return low, high

    def candidates(self, low: np.ndarray, high: np.ndarray, wanted: int, collisions: int) -> np.ndarray:
        """Vectors that one query's windows (by width and line) hold on enough lines, at the first width with ``wanted``."""
        first = low[0].astype(self.place.dtype)[:, None]
        # The first window is wide: places are compared with it. Places before it wrap round and are beyond any window.
        inside = self.place - first < (high[0] - low[0]).astype(self.place.dtype)[:, None]
        counts = inside.view(np.uint8).sum(axis=0, dtype=np.uint8 if len(inside) < 256 else np.uint32).astype(np.int64)
        left, right, found = low[0].tolist(), high[0].tolist(), np.flatnonzero(counts >= collisions)
        for lows, highs in zip(low[1:].tolist(), high[1:].tolist(), strict=True):
            if len(found) >= wanted:
                break
            entered = [order[a:b] for order, a, b in zip(self.order, lows, left, strict=True)]
            entered += [order[a:b] for order, a, b in zip(self.order, right, highs, strict=True)]
            counts += np.bincount(np.concatenate(entered), minlength=self.n)
            left, right = lows, highs
            found = np.flatnonzero(counts >= collisions)
        return found


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, n_projections: int = 80, collision_share: float = 0.75, candidate_factor: float = 5.0,
    width: float = 0.5, growth: float = 1.08, block_rows: int = 32768, query_rows: int = 16384, seed: int = 7,
) -> DataFrame:
    """The k nearest found of each query by inner product: (query_id, rank, vec_id, score).

    ``vectors`` and ``queries``: (vec_id long, embedding array). Vectors that are null, zero or hold null or
    non-finite components take no part; a vector meets only those of its own length, and never one of its own id.
    An id counts once: of several rows with one id and length, the smallest vector stands for it. Ties go to the
    smaller vec_id; scores that are no number (overflow) come last. Fewer than k candidates: all of them. The result
    depends on neither the order of rows nor the number of cores. Blocks of vectors and of queries meet pair by
    pair in tasks of bounded size; no candidate list is cut, so copies of one vector are verified in full. The
    last window of each query is unbounded, so every search ends. Other columns are ignored; empty tables give
    no row.
    """
    spark = vectors.sparkSession
    vectors, queries = usable(vectors.select("vec_id", "embedding")), usable(queries.select("vec_id", "embedding"))
    largest = F.aggregate("embedding", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v.cast("double"))))
    figures = vectors.agg(F.count("*").alias("n"), F.max(largest).alias("scale")).first()
    scale = float(figures["scale"] or 1.0)
    scaled = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + F.pow(v.cast("double") / scale, 2.0))
    # Components are divided by the largest of all, so no square overflows; the lift needs the largest norm.
    top = float(vectors.agg(F.max(scaled).alias("top")).first()["top"] or 1.0)
    n_queries = queries.count()
    blocks = max(1, -(-figures["n"] // block_rows))
    # Small inputs are still dealt to every core; how queries are grouped changes no result.
    groups = max(1, -(-n_queries // query_rows), min(n_queries // 64, -(-spark.sparkContext.defaultParallelism // blocks)))
    collisions = math.ceil(collision_share * n_projections)
    radius = math.sqrt(top)
    steps = math.ceil(math.log(8 / width) / math.log(growth))
    widths = np.append(radius * width * growth ** np.arange(steps), np.inf)

    def of(pair: tuple, data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if data.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        data, asked = data.sort_values("vec_id"), asked.sort_values("asked_id")
        ids, x = data["vec_id"].to_numpy(), np.stack(data["embedding"].to_numpy()).astype(float)
        asked_ids, q = asked["asked_id"].to_numpy(), np.stack(asked["asked"].to_numpy()).astype(float)
        small, by_component = x / scale, np.ascontiguousarray(x.T)
        rest = np.sqrt(np.maximum(top - np.einsum("ij,ij->i", small, small), 0.0))
        index = SortedProjections(np.hstack([small, rest[:, None]]), n_projections, seed)
        turned = q / np.abs(q).max(axis=1, keepdims=True)
        turned *= radius / np.sqrt(np.einsum("ij,ij->i", turned, turned))[:, None]
        lifted = np.hstack([turned, np.zeros((len(q), 1))])
        wanted = min(len(ids), math.ceil(candidate_factor * math.sqrt(k * len(ids))) + 1)
        out = []
        for start in range(0, len(q), 64):
            low, high = index.windows(lifted[start : start + 64], widths)
            for i in range(len(low)):
                found = index.candidates(low[i], high[i], wanted, collisions)
                found = found[ids[found] != asked_ids[start + i]]
                scores = inner_products(by_component[:, found], q[start + i])
                best = np.lexsort((ids[found], -scores))[:k]
                out.append(pd.DataFrame({"query_id": asked_ids[start + i], "vec_id": ids[found][best], "score": scores[best]}))
        return pd.concat(out)

    # Each block of vectors goes to every group of queries and the other way round: pairs of blocks, not of rows.
    data = one_per_id(vectors).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = one_per_id(queries).select(F.col("vec_id").alias("asked_id"), F.col("embedding").alias("asked"), "dim").withColumn("group", F.pmod(F.xxhash64("asked_id", F.lit(1)), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = data.groupBy("block", "group", "dim").cogroup(asked.groupBy("block", "group", "dim")).applyInPandas(of, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every row of ``embeddings`` whose vec_id is divisible by 20, among all rows."""
    from .common import table

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


#: The exact answer, which the search gives in full where it verifies every vector, as it does on 500.
ORACLE = """
with v as (select vec_id, embedding::double[] as x from embeddings where vec_id is not null and embedding is not null),
ok as (select vec_id, x from v where len(x) > 0 and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(x, lambda c: c <> 0)) > 0),
pairs as (select q.vec_id as query_id, d.vec_id, list_dot_product(q.x, d.x) as score from ok q join ok d on q.vec_id <> d.vec_id and len(q.x) = len(d.x) where q.vec_id % 20 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs) where rank <= 20
"""
