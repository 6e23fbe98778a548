"""Queries of memory features, gates by mode, gate studies, audits of row gating and growth (halves of N12, P12, P13, P19, P22, P23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions.storage import read, written
from corpuslab.operators import memory as M
from corpuslab.operators import ngrams as N
from corpuslab.operators import positions as P

from .ngrams import BASE, FRACS, SCALING, parts
from .positions import REC, records
from .registry import query

TASKS = list(T.CHANNEL_WEIGHTS)
MEMORY = f"""WITH s AS (SELECT vec_id AS pos, unnest(embedding)::DOUBLE AS logit, generate_subscripts(embedding, 1)::INT - 1 AS token, unnest(list_concat(embedding[2:], embedding[1:1]))::DOUBLE AS other FROM embeddings),
q AS (SELECT pos, token, logit, CASE WHEN token % 2 = 0 AND pos % 10 <> 0 THEN exp(other) / 64 END AS q FROM s),
b AS (SELECT *, ln(exp(logit) / sum(exp(logit)) OVER (PARTITION BY pos)) AS lb, ln(q / sum(q) OVER (PARTITION BY pos)) AS lm FROM q),
f AS (SELECT pos, count(q) AS support, -sum(exp(lb) * lb) AS base_entropy, -sum(exp(lm) * lm) AS memory_entropy, sum(exp(lm) * (lm - lb)) AS expected, arg_max(token, (logit, -token)) AS bt, arg_max(token, (q, -token)) FILTER (q IS NOT NULL) AS mt, max(exp(lb)) AS base_top1_prob, max(exp(lm)) AS memory_top1_prob FROM b GROUP BY pos),
mf AS (SELECT f.*, x.lm - x.lb AS pseudo, y.lm - y.lb AS memory_top1, coalesce(bt = mt, false) AS agrees, (['semantic', 'code', 'name', 'number', 'general'])[f.pos % 5 + 1] AS task FROM f JOIN b x ON x.pos = f.pos AND x.token = bt LEFT JOIN b y ON y.pos = f.pos AND y.token = mt)"""
FIGURES = ("base_entropy", "memory_entropy", "expected", "pseudo", "memory_top1", "base_top1_prob", "memory_top1_prob")


def featured(spark, sf):
    """Embeddings as logits of 64 tokens; the memory knows every second token, with masses of their neighbours, and nothing at each tenth position."""
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), "embedding", F.posexplode("embedding").alias("token", "x"))
    other = F.element_at("embedding", (F.col("token") + 1) % F.size("embedding") + 1).cast("double")
    rows = v.select("pos", "token", F.col("x").cast("double").alias("logit"), F.when((F.col("token") % 2 == 0) & (F.col("pos") % 10 != 0), F.exp(other) / 64).alias("q"))
    task = F.element_at(F.array(*map(F.lit, TASKS)), (F.col("pos") % len(TASKS) + 1).cast("int"))
    return M.memory_features(rows).withColumn("task", task)


@query("p12_memory_features", f"{MEMORY} SELECT pos, support, agrees, task, {', '.join(f'round({c}, 6) AS {c}' for c in FIGURES)}, {', '.join(f'(task = {t!r})::DOUBLE AS task_{t}' for t in TASKS)} FROM mf")
def p12_features(spark, sf):
    out = M.one_hot(featured(spark, sf), "task", TASKS)
    return out.select("pos", "support", "agrees", "task", *[F.round(c, 6).alias(c) for c in FIGURES], *[f"task_{t}" for t in TASKS])


CUTS = (0.0, 0.25, 0.5, 1.0)
_OPEN = {"expected_kl": "expected >= t", "pseudo_label": "pseudo >= t", "memory_top1": "memory_top1 >= t", "hybrid": "expected >= t AND pseudo >= 0"}


@query("p13_gate_grid", f"{MEMORY}, th AS (SELECT unnest({list(CUTS)})::DOUBLE AS t) " + " UNION ALL ".join(f"SELECT '{m}' AS mode, t AS threshold, count(*) AS n, count(*) FILTER (task <> 'semantic' AND {rule}) AS opened, count(*) FILTER (task <> 'semantic' AND agrees AND {rule}) AS agreeing FROM mf CROSS JOIN th GROUP BY t" for m, rule in _OPEN.items()))
def p13_grid(spark, sf):
    return M.gate_grid(featured(spark, sf), list(CUTS))


@query("p13_gate_rows", f"{MEMORY} SELECT pos, task, coalesce(task <> 'semantic' AND expected >= 0.5 AND pseudo >= 0, false) AS \"open\" FROM mf")
def p13_rows(spark, sf):
    return M.memory_gate(featured(spark, sf), "hybrid", 0.5).select("pos", "task", "open")


@query("p19_band_sums", f"{REC}, t AS (SELECT unnest([1, 2, 5, 10, 50]) AS threshold) SELECT threshold, count(*) FILTER (evidence >= threshold) AS n, round(avg((evidence >= threshold)::INT), 9) AS share, round(sum(CASE WHEN evidence >= threshold THEN margin ELSE 0 END) / count(*), 6) AS sum_over_total FROM r CROSS JOIN t GROUP BY threshold")
def p19_sums(spark, sf):
    return M.band_sums(records(spark, sf), "evidence", "margin", [1, 2, 5, 10, 50]).withColumn("share", F.round("share", 9)).withColumn("sum_over_total", F.round("sum_over_total", 6))


def study(spark, sf):
    """Gains of the trigram over the unigram at each position, by what both show before the token is known."""
    rows = records(spark, sf).select("pos", F.col("margin").alias("gain"), F.ln(F.col("evidence") + 1).alias("log_evidence"), (F.col("grp") == 0).cast("double").alias("first_group"), (F.col("evidence") == 0).cast("double").alias("unseen"))
    return written(M.gate_study(rows, ["log_evidence", "first_group", "unseen"], "gain"), "gate-study")


@query("p22_gate_study")
def p22_study(spark, sf):
    out = M.gate_report(study(spark, sf), "gain")
    return out.select("policy", "n", "opened", F.round("gain", 6).alias("gain"), F.round("share", 6).alias("share"))


GATED = "WITH z AS (SELECT vec_id % 14 = 0 AS selected, vec_id % 7 = 0 AND embedding[1] <> 0 AS changed, embedding[2]::DOUBLE AS delta_a, CASE WHEN vec_id % 7 = 0 AND embedding[1] <> 0 THEN embedding[3]::DOUBLE ELSE 0 END AS delta_b FROM embeddings)"


def gating(spark, sf):
    """Rows with the first element zeroed at each seventh one; the mask selects each fourteenth."""
    a = read(spark, sf, "embeddings").select("vec_id", "embedding")
    b = a.select("vec_id", F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 7 == 0) & (i == 0), F.lit(0.0).cast("float")).otherwise(x)).alias("embedding"))
    rows = P.changed_rows(a, b, "vec_id", "embedding").join(a, "vec_id")
    return rows.select((F.col("vec_id") % 14 == 0).alias("selected"), "changed", F.col("embedding")[1].cast("double").alias("delta_a"), F.when(F.col("changed"), F.col("embedding")[2].cast("double")).otherwise(0.0).alias("delta_b"))


@query("p23_gating_table", f"{GATED} SELECT count(*) AS n, count(*) FILTER (selected AND changed) AS \"both\", count(*) FILTER (selected AND NOT changed) AS selected_only, count(*) FILTER (changed AND NOT selected) AS changed_only, count(*) FILTER (NOT selected AND NOT changed) AS neither, round(avg((selected = changed)::INT), 9) AS agreement FROM z")
def p23_table(spark, sf):
    return M.gating_table(gating(spark, sf)).withColumn("agreement", F.round("agreement", 9))


_REGIONS = {"all": "true", "selected": "selected", "unselected": "NOT selected", "untouched": "NOT changed"}


@query("p23_region_means", f"{GATED} " + " UNION ALL ".join(f"SELECT '{r}' AS region, count(*) AS n, round(avg(delta_a), 6) AS mean_a, round(avg(delta_b), 6) AS mean_b, round(avg(delta_b - delta_a), 6) AS mean_difference, round(max(abs(delta_b)), 6) AS absmax_b, round(avg((delta_b = 0)::INT), 9) AS zero_share FROM z WHERE {w}" for r, w in _REGIONS.items()))
def p23_regions(spark, sf):
    out = M.region_means(gating(spark, sf))
    return out.select("region", "n", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "mean_difference", "absmax_b")], F.round("zero_share", 9).alias("zero_share"))


TARGET = 1_000_000_000


@query("n12_projection", f"""{SCALING}, p AS (SELECT regr_slope(ln("distinct"), ln(n_tokens)) AS b, regr_intercept(ln("distinct"), ln(n_tokens)) AS a, regr_r2(ln("distinct"), ln(n_tokens)) AS r FROM x)
SELECT round(b, 6) AS exponent, round(a, 6) AS intercept, round(r, 6) AS r2, CASE WHEN b > 1e-9 THEN round(ln(exp((ln({TARGET}) - a) / b)), 5) END AS log_tokens_needed, CASE WHEN b < 0.2 THEN 'saturating' WHEN b > 1 THEN 'upper_bound' ELSE 'ok' END AS note FROM p""")
def n12_projection(spark, sf):
    fit = N.power_law(N.scaling(N.token_rows(read(spark, sf, "documents")), list(FRACS)))
    out = M.projection(fit, TARGET)
    return out.select(*[F.round(c, 6).alias(c) for c in ("exponent", "intercept", "r2")], F.round(F.ln("tokens_needed"), 5).alias("log_tokens_needed"), "note")


LOSSES = f"""{BASE}, f AS (SELECT unnest({list(FRACS)})::DOUBLE AS frac), c AS (SELECT frac, token, count(*) AS c FROM tr JOIN f ON doc_id <= frac * (SELECT max(doc_id) FROM tr) GROUP BY ALL), z AS (SELECT frac, sum(c) AS n_tokens FROM c GROUP BY frac), v AS (SELECT count(DISTINCT token) AS v FROM tr),
pl AS (SELECT z.frac, any_value(n_tokens)::BIGINT AS n_tokens, avg(-ln((coalesce(c, 0) + 1) / (n_tokens + v + 1))) AS nll FROM ev CROSS JOIN z CROSS JOIN v LEFT JOIN c ON c.frac = z.frac AND c.token = ev.token GROUP BY z.frac)"""


@query("n12_prefix_losses", f"{LOSSES} SELECT frac, n_tokens, round(nll, 6) AS nll FROM pl")
def n12_losses(spark, sf):
    train, held = parts(spark, sf)
    return M.prefix_losses(train, held, list(FRACS)).withColumn("nll", F.round("nll", 6))


@query("n12_learning_curve", f"{LOSSES} SELECT count(*) AS n_points, round(regr_intercept(nll, pow(n_tokens, -0.5)), 5) AS asymptote, round(regr_slope(nll, pow(n_tokens, -0.5)), 3) AS slope, round(regr_r2(nll, pow(n_tokens, -0.5)), 6) AS r2 FROM pl")
def n12_curve(spark, sf):
    train, held = parts(spark, sf)
    out = M.learning_curve(M.prefix_losses(train, held, list(FRACS)))
    return out.select("n_points", F.round("asymptote", 5).alias("asymptote"), F.round("slope", 3).alias("slope"), F.round("r2", 6).alias("r2"))
