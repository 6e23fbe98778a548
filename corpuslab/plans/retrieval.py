"""Queries R1-R11: benchmark items as queries against documents, and embeddings against each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions.storage import read, written
from corpuslab.operators import corpus as C
from corpuslab.operators import ngrams as N
from corpuslab.operators import retrieval as R

from .registry import query
from .text import _ROUTES_SQL, TOKENS

K = 10


def asked(spark, sf):
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def documents(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "text")


BM25 = f"""WITH w AS (SELECT doc_id, {TOKENS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS m FROM w),
p AS (SELECT term, doc_id, any_value(size) AS size, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM w) GROUP BY term, doc_id),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
b AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / m))), 9) AS score FROM q JOIN df USING (term) JOIN p USING (term) CROSS JOIN s GROUP BY query_id, doc_id),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM b QUALIFY rank < 50)"""


@query("r1_bm25", f"{BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm WHERE rank < {K}")
def r1(spark, sf):
    return R.bm25(documents(spark, sf), asked(spark, sf), K).withColumn("score", F.round("score", 6))


def vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.col("embedding").alias("vector"))


def neighbours(spark, sf, k):
    """Every vector divisible by 20 as a query against all others."""
    v = vectors(spark, sf)
    found = R.dense(v, v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector"), k + 1)
    return R.top(found.where("query_id <> doc_id").drop("rank"), k)


NEAR = """WITH e AS (SELECT vec_id AS doc_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
c AS (SELECT q.doc_id AS query_id, d.doc_id, d.label, round(list_inner_product(q.v, d.v) / q.n / d.n, 9) AS score FROM e q JOIN e d ON q.doc_id <> d.doc_id WHERE q.doc_id % 20 = 0),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM c QUALIFY rank < 10)"""


@query("r2_dense", f"{NEAR} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM nn")
def r2(spark, sf):
    return neighbours(spark, sf, K).withColumn("score", F.round("score", 6))


@query("r3_mean_vectors", "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, round(avg(x), 6) AS m FROM x GROUP BY ALL) SELECT label, list(m ORDER BY d) AS mean FROM m GROUP BY label")
def r3(spark, sf):
    out = R.mean_vectors(vectors(spark, sf), ["label"])
    return out.select("label", F.transform("mean", lambda x: F.round(x, 6)).alias("mean"))


@query("r4_ngram_channel", f"""WITH d AS (SELECT doc_id, {TOKENS} AS t FROM documents), x AS (SELECT doc_id, o AS ord, array_to_string(t[i:i+o-1], ' ') AS key FROM (SELECT doc_id, t, o, unnest(generate_series(1, len(t) - o + 1)) AS i FROM d CROSS JOIN (SELECT unnest([2, 3, 4]) AS o))),
q AS (SELECT item_id AS query_id, o AS ord, array_to_string(t[len(t)-o+1:], ' ') AS key FROM (SELECT item_id, {TOKENS} AS t FROM benchmark) CROSS JOIN (SELECT unnest([2, 3, 4]) AS o) WHERE len(t) >= o)
SELECT query_id, doc_id, sum(ord)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY sum(ord) DESC, doc_id) - 1 AS rank FROM q JOIN x USING (ord, key) GROUP BY query_id, doc_id QUALIFY rank < {K}""")
def r4(spark, sf):
    return R.ngram_channel(documents(spark, sf), asked(spark, sf), K)


REVERSED = f"{BM25}, ch AS (SELECT query_id, doc_id, rank, 1.0::DOUBLE AS weight FROM bm WHERE rank < {K} UNION ALL SELECT query_id, doc_id, {K} - 1 - rank, 0.5 FROM bm WHERE rank < {K})"


@query("r5_rank_fusion", f"{REVERSED} SELECT query_id, doc_id, round(sum(weight / (60 + rank + 1)), 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(weight / (60 + rank + 1)), 12) DESC, doc_id) - 1 AS rank FROM ch GROUP BY query_id, doc_id")
def r5(spark, sf):
    ranking = written(R.bm25(documents(spark, sf), asked(spark, sf), K), "bm25").withColumn("weight", F.lit(1.0))
    other = ranking.withColumn("rank", K - 1 - F.col("rank")).withColumn("weight", F.lit(0.5))
    return R.fuse(ranking.unionByName(other), K)


def hybrid(spark, sf, k):
    """BM25, hashed tf-idf vectors and n-gram suffixes, fused by the weights of each query's task."""
    queries = asked(spark, sf)
    weights = spark.createDataFrame([(t, *w) for t, w in T.CHANNEL_WEIGHTS.items()], "task string, bm25 double, dense double, ngram double")
    routed = written(queries.select("query_id", T.route_task(F.col("text")).alias("task")).join(F.broadcast(weights), "task"), "routed")
    channels = {"bm25": R.bm25(documents(spark, sf), queries, 50), "dense": R.dense_texts(documents(spark, sf), queries, 50), "ngram": R.ngram_channel(documents(spark, sf), queries, 50)}
    return R.hybrid({name: written(c, name) for name, c in channels.items()}, routed, k)


HASHED = f"""tw AS (SELECT token, ln((n + 1) / (df + 1)) + 1 AS idf FROM (SELECT term AS token, df FROM df) CROSS JOIN (SELECT count(*) AS n FROM documents)),
dv AS (SELECT 'd' AS side, doc_id AS id, term AS token, tf AS n FROM p UNION ALL SELECT 'q', query_id, term, qtf FROM q),
cell AS (SELECT side, id, ('0x' || substring(md5(token), 1, 8))::BIGINT % 256 AS dim, sum(CASE WHEN substring(md5(token), 9, 1) < '8' THEN 1 ELSE -1 END * (1 + ln(n)) * idf) AS x FROM dv JOIN tw USING (token) GROUP BY ALL),
nrm AS (SELECT side, id, sqrt(sum(x * x)) AS l FROM cell GROUP BY ALL),
cs AS (SELECT b.id AS query_id, a.id AS doc_id, sum(a.x * b.x) AS s FROM cell a JOIN cell b ON a.side = 'd' AND b.side = 'q' AND a.dim = b.dim GROUP BY ALL),
de AS (SELECT query_id, doc_id, round(coalesce(s / nullif(na.l * nb.l, 0), 0), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s / nullif(na.l * nb.l, 0), 0), 9) DESC, doc_id) - 1 AS rank
 FROM (SELECT a.id AS doc_id, b.id AS query_id, coalesce(cs.s, 0) AS s FROM (SELECT id FROM nrm WHERE side = 'd') a CROSS JOIN (SELECT id FROM nrm WHERE side = 'q') b LEFT JOIN cs ON cs.doc_id = a.id AND cs.query_id = b.id) z JOIN nrm na ON na.side = 'd' AND na.id = doc_id JOIN nrm nb ON nb.side = 'q' AND nb.id = query_id QUALIFY rank < 50)"""


@query("r6_dense_texts", f"{BM25}, {HASHED} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM de WHERE rank < {K}")
def r6_dense(spark, sf):
    """The dense channel alone."""
    return R.dense_texts(documents(spark, sf), asked(spark, sf), K).withColumn("score", F.round("score", 6))


GRAMS = f"""gd AS (SELECT doc_id, {TOKENS} AS t FROM documents), gx AS (SELECT doc_id, o AS ord, array_to_string(t[i:i+o-1], ' ') AS key FROM (SELECT doc_id, t, o, unnest(generate_series(1, len(t) - o + 1)) AS i FROM gd CROSS JOIN (SELECT unnest([2, 3, 4]) AS o))),
gq AS (SELECT item_id AS query_id, o AS ord, array_to_string(t[len(t)-o+1:], ' ') AS key FROM (SELECT item_id, {TOKENS} AS t FROM benchmark) CROSS JOIN (SELECT unnest([2, 3, 4]) AS o) WHERE len(t) >= o),
gr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY sum(ord) DESC, doc_id) - 1 AS rank FROM gq JOIN gx USING (ord, key) GROUP BY query_id, doc_id QUALIFY rank < 50)"""
ROUTED = f"rt AS (SELECT item_id AS query_id, {_ROUTES_SQL} AS task FROM benchmark), wt AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{t}{chr(39)}, {a}, {b}, {c})' for t, (a, b, c) in T.CHANNEL_WEIGHTS.items())}) x(task, bm25, dense, ngram))"


@query("r6_hybrid", f"""{BM25}, {HASHED}, {GRAMS}, {ROUTED}, ch AS (SELECT query_id, doc_id, rank, 'bm25' AS c FROM bm UNION ALL SELECT query_id, doc_id, rank, 'dense' FROM de UNION ALL SELECT query_id, doc_id, rank, 'ngram' FROM gr),
fs AS (SELECT query_id, doc_id, round(sum(CASE c WHEN 'bm25' THEN bm25 WHEN 'dense' THEN dense ELSE ngram END::DOUBLE / (60 + rank + 1)), 12) AS score FROM ch JOIN rt USING (query_id) JOIN wt USING (task) WHERE CASE c WHEN 'bm25' THEN bm25 WHEN 'dense' THEN dense ELSE ngram END > 0 GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM fs QUALIFY rank < {K}""")
def r6(spark, sf):
    return hybrid(spark, sf, K)


def targets(spark, sf):
    """The documents in which an item's normalised text occurs: keys of six words meet first, the few texts after."""
    items = asked(spark, sf).select("query_id", T.norm_words(F.col("text")).alias("words"))
    docs = documents(spark, sf).select("doc_id", T.norm_words(F.col("text")).alias("words"))
    wanted = items.select("query_id", F.array_join(F.slice("words", 1, 6), " ").alias("key"), F.array_join("words", " ").alias("needle"))
    keys = docs.select("doc_id", F.explode(F.array_distinct(C.windows_of(F.col("words"), 6))).alias("key")).join(wanted.select("key").distinct(), "key", "left_semi")
    met = keys.join(wanted, "key").select("query_id", "doc_id", "needle")
    texts = docs.select("doc_id", F.array_join("words", " ").alias("hay"))
    return met.join(texts, "doc_id").where(F.col("hay").contains(F.col("needle"))).select("query_id", "doc_id").distinct()


NORM = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
TARGETS = f"tg AS (SELECT query_id, doc_id FROM (SELECT item_id AS query_id, {NORM} AS needle FROM benchmark) JOIN (SELECT doc_id, {NORM} AS hay FROM documents) ON contains(' ' || hay, ' ' || needle))"
RECALL = "SELECT count(*) AS queries, round(avg(coalesce(best < 1, false)::INT), 9) AS recall_1, round(avg(coalesce(best < 3, false)::INT), 9) AS recall_3, round(avg(coalesce(best < 5, false)::INT), 9) AS recall_5, round(avg(coalesce(1.0 / (best + 1), 0)), 9) AS mrr FROM (SELECT DISTINCT query_id FROM {tg}) LEFT JOIN (SELECT query_id, min(rank) AS best FROM bm JOIN {tg} USING (query_id, doc_id) WHERE rank < 10 GROUP BY query_id) USING (query_id)"


def rounded(df, *names):
    return df.select(*[F.round(c, 9).alias(c) if c.startswith(("recall", "mrr")) else c for c in df.columns])


@query("r7_recall_single", f"{BM25}, {TARGETS}, t1 AS (SELECT query_id, min(doc_id) AS doc_id FROM tg GROUP BY query_id) {RECALL.format(tg='t1')}")
def r7(spark, sf):
    single = targets(spark, sf).groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    return rounded(R.recall(R.bm25(documents(spark, sf), asked(spark, sf), K), single))


@query("r8_recall_set", f"{BM25}, {TARGETS} {RECALL.format(tg='tg')}")
def r8(spark, sf):
    return rounded(R.recall(R.bm25(documents(spark, sf), asked(spark, sf), K), targets(spark, sf)))


@query("r9_knn_mixture", f"""{NEAR}, v AS (SELECT query_id, label, sum(exp(least(30, greatest(-30, score / 0.05)))) AS e FROM nn GROUP BY ALL), k AS (SELECT query_id, label, e / sum(e) OVER (PARTITION BY query_id) AS knn FROM v),
b AS (SELECT vec_id AS query_id, l AS label, 0.1 AS p FROM embeddings CROSS JOIN (SELECT unnest(generate_series(0, 9)) AS l) WHERE vec_id % 20 = 0),
x AS (SELECT query_id, label, 0.5 * coalesce(p, 0) + 0.5 * coalesce(knn, 0) AS p FROM b FULL JOIN k USING (query_id, label)), m AS (SELECT query_id, label AS best FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, label) = 1)
SELECT t.vec_id AS query_id, round(-ln(greatest(coalesce(p, 0), 1e-12)), 6) AS nll, best = t.label AS hit FROM embeddings t LEFT JOIN x ON x.query_id = t.vec_id AND x.label = t.label LEFT JOIN m ON m.query_id = t.vec_id WHERE t.vec_id % 20 = 0""")
def r9(spark, sf):
    v = vectors(spark, sf)
    targets_ = v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "label")
    base = targets_.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("label"), F.lit(0.1).alias("p"))
    out = R.knn_mixture(neighbours(spark, sf, K), v.select("doc_id", "label"), base, targets_, 0.05, 0.5)
    return out.withColumn("nll", F.round("nll", 6))


@query("r10_transition_hits", f"""{BM25}, t AS (SELECT doc_id, token, lag(token) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM (SELECT doc_id, unnest({TOKENS}) AS token, generate_subscripts({TOKENS}, 1) AS pos FROM documents)),
k AS (SELECT item_id AS query_id, ({TOKENS})[-2] AS context, ({TOKENS})[-1] AS target FROM benchmark)
SELECT k.query_id, coalesce(bool_or(before = context), false) AS exact, count(token) > 0 AS "any" FROM k LEFT JOIN (SELECT query_id, doc_id FROM bm WHERE rank < {K}) USING (query_id) LEFT JOIN t ON t.doc_id = bm.doc_id AND t.token = target GROUP BY k.query_id""".replace("(SELECT query_id, doc_id FROM bm WHERE rank < 10) USING", "(SELECT query_id, doc_id FROM bm WHERE rank < 10) bm USING"))
def r10(spark, sf):
    queries = asked(spark, sf)
    ranking = written(R.bm25(documents(spark, sf), queries, K), "bm25")
    words = T.word_tokens(F.col("text"))
    wanted = queries.select("query_id", F.try_element_at(words, F.lit(-2)).alias("context"), F.try_element_at(words, F.lit(-1)).alias("target"))
    return R.transition_hits(ranking, N.token_rows(documents(spark, sf)), wanted)


@query("r11_neighbour_overlap", f"""{NEAR}, h AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: x::DOUBLE)[1:32] AS v FROM embeddings), hn AS (SELECT doc_id, v, sqrt(list_inner_product(v, v)) AS n FROM h),
c2 AS (SELECT q.doc_id AS query_id, d.doc_id, round(list_inner_product(q.v, d.v) / q.n / d.n, 9) AS score FROM hn q JOIN hn d ON q.doc_id <> d.doc_id WHERE q.doc_id % 20 = 0), n2 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10)
SELECT query_id, count(n2.doc_id) / 10 AS overlap FROM nn LEFT JOIN n2 USING (query_id, doc_id) GROUP BY query_id""")
def r11(spark, sf):
    v = vectors(spark, sf).select("doc_id", F.slice("vector", 1, 32).alias("vector"))
    half = R.dense(v, v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector"), K + 1)
    return R.neighbour_overlap(neighbours(spark, sf, K), R.top(half.where("query_id <> doc_id").drop("rank"), K), K)


@query("c19_rag_examples", f"{BM25} SELECT query_id, md5(string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank)) AS context FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM bm WHERE query_id <> doc_id AND rank < {K}) JOIN documents USING (doc_id) WHERE r <= 3 GROUP BY query_id")
def c19(spark, sf):
    ranking = R.bm25(documents(spark, sf), asked(spark, sf), K)
    return C.rag_examples(ranking, documents(spark, sf), 3).select("query_id", F.md5("context").alias("context"))
