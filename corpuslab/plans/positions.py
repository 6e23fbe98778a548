"""Queries P1-P25 over the positions of held-out documents, scored by a trigram and a unigram model."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions.storage import read, written
from corpuslab.operators import ngrams as N
from corpuslab.operators import positions as P

from .ngrams import BACKOFF, token_lists
from .registry import query


#: A position's number is its document times this, more than any text has tokens, plus its place.
PLACES = 3_000_000_000


def records(spark, sf):
    """(pos, doc_id, grp, nll_p, nll_q, evidence, margin): trigram backoff p, unigram q; a row per position."""
    scored = N.backoff_positions(N.position_counts(token_lists(spark, sf)))
    rows = scored.select((F.col("doc_id").cast("long") * PLACES + F.col("pos")).alias("pos"), "doc_id", (F.col("doc_id") % 3).alias("grp"), (-F.col("logp")).alias("nll_p"), (-F.col("unigram_logp")).alias("nll_q"), F.col("evidence").alias("evidence"))
    return written(P.margins(rows, "nll_q", "nll_p").withColumn("margin", F.round("margin", 9)), "positions")


REC = f"{BACKOFF}, rec AS (SELECT doc_id::BIGINT * {PLACES} + pos AS pos, doc_id, doc_id % 3 AS grp, -ln(coalesce(CASE WHEN z3 IS NOT NULL THEN n3 / z3 WHEN z2 IS NOT NULL THEN n2 / z2 ELSE n1 / z1 END, n1 / z1, 1e-12)) AS nll_p, -ln(coalesce(n1 / z1, 1e-12)) AS nll_q, coalesce(z3, 0) AS evidence FROM bo), r AS (SELECT *, round(nll_q - nll_p, 9) AS margin FROM rec)"


@query("p1_margin", f"{REC} SELECT count(*) AS n, round(avg(margin), 6) AS margin, round(avg((margin > 0)::INT), 9) AS positive FROM r")
def p1(spark, sf):
    return records(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg("margin"), 6).alias("margin"), F.round(F.avg((F.col("margin") > 0).cast("int")), 9).alias("positive"))


RANKED = f"{REC}, k AS (SELECT *, row_number() OVER (ORDER BY margin DESC, pos) AS rank, sum(margin) OVER (ORDER BY margin DESC, pos ROWS UNBOUNDED PRECEDING) AS upto, count(*) OVER () AS total FROM r)"


@query("p2_top_share", f"{RANKED} SELECT doc_id, count(*) AS n, round(sum(margin), 5) AS margin FROM k WHERE rank <= ceil(total * 0.05) GROUP BY doc_id")
def p2(spark, sf):
    return P.top_share(records(spark, sf), 5).groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("margin"), 5).alias("margin"))


@query("p3_gain_curve", f"{RANKED}, q AS (SELECT unnest([1, 2, 5, 10, 20, 50, 100])::DOUBLE AS q) SELECT q, rank AS n, round(upto / total, 6) AS gain FROM k JOIN q ON rank = greatest(1, ceil(total * q / 100))")
def p3(spark, sf):
    return P.gain_curve(records(spark, sf)).withColumn("gain", F.round("gain", 6))


def _band(c: str, edges) -> str:
    return "CASE " + " ".join(f"WHEN {c} >= {e} THEN {e}" for e in sorted(edges, reverse=True)) + " END"


@query("p4_band_summary", f"{REC}, g AS (SELECT unnest({list(P.COUNT_EDGES)}) AS band), b AS (SELECT {_band('evidence', P.COUNT_EDGES)} AS band, margin FROM r) SELECT g.band, count(margin) AS n, round(avg(margin), 6) AS mean, round(sum(margin), 4) AS total FROM g LEFT JOIN b USING (band) GROUP BY g.band")
def p4(spark, sf):
    return P.band_summary(records(spark, sf), "evidence", "margin").select("band", "n", F.round("mean", 6).alias("mean"), F.round("total", 4).alias("total"))


SURPRISAL = (0, 2, 4, 8, 16)


@query("p5_cross_table", f"{REC}, g AS (SELECT a::DOUBLE AS band_a, b::DOUBLE AS band_b FROM (SELECT unnest({list(SURPRISAL)}) AS a) CROSS JOIN (SELECT unnest([0, 1, 5, 50]) AS b)), x AS (SELECT {_band('round(nll_q, 9)', SURPRISAL)} AS band_a, {_band('evidence', (0, 1, 5, 50))} AS band_b, margin FROM r) SELECT g.band_a, g.band_b, count(margin) AS n, round(avg(margin), 6) AS mean FROM g LEFT JOIN x USING (band_a, band_b) GROUP BY ALL")
def p5(spark, sf):
    rows = records(spark, sf).withColumn("surprisal", F.round("nll_q", 9))
    return P.cross_table(rows, "surprisal", "evidence", "margin", SURPRISAL, (0, 1, 5, 50)).withColumn("mean", F.round("mean", 6))


GRID = f"{REC}, g AS (SELECT unnest(generate_series(0, 1000)) AS i), l AS (SELECT grp, pos % 5 AS fold, i, count(*) AS n, sum(-ln(greatest(i / 1000 * exp(-nll_p) + (1 - i / 1000) * exp(-nll_q), 1e-12))) AS loss FROM r CROSS JOIN g GROUP BY ALL)"


SQL_P6 = f"{GRID}, t AS (SELECT grp, i, sum(n) AS n, sum(loss) AS loss FROM l GROUP BY ALL) SELECT grp, n::BIGINT AS n, i / 1000 AS lam, round(loss / n, 6) AS loss FROM t QUALIFY row_number() OVER (PARTITION BY grp ORDER BY loss, i) = 1".replace("GROUP BY ALL) SELECT grp, n::BIGINT", "GROUP BY grp, i) SELECT grp, n::BIGINT")


@query("p6_mixture_lambda_fine", SQL_P6)
@query("p6_mixture_lambda", SQL_P6)
def p6(spark, sf):
    """All 1,001 weights."""
    return P.best_lambda(P.mixture_grid(records(spark, sf), ["grp"]), ["grp"]).withColumn("loss", F.round("loss", 6))


SQL_P7 = f"{GRID}, t AS (SELECT l.*, sum(loss) OVER (PARTITION BY grp, i) - loss AS train FROM l), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY grp, fold ORDER BY train, i) = 1) SELECT b.fold::INT AS fold, b.grp, b.i / 1000 AS lam, b.n, round(z.loss - b.loss, 5) AS gain FROM b JOIN l z ON z.grp = b.grp AND z.fold = b.fold AND z.i = 0"


@query("p7_crossfit_gain_fine", SQL_P7)
@query("p7_crossfit_gain", SQL_P7)
def p7(spark, sf):
    """All 1,001 weights."""
    return P.crossfit_gain(records(spark, sf), "grp").select("fold", "grp", "lam", "n", F.round("gain", 5).alias("gain"))


@query("p8_permuted_null")
def p8(spark, sf):
    return P.excess_verdict(records(spark, sf), "grp", 8, 5, 1000)


@query("p9_oracle_bound", f"{REC} SELECT count(*) AS n, round(avg(nll_q - least(nll_p, nll_q)), 6) AS gain FROM r")
def p9(spark, sf):
    return P.oracle_bound(records(spark, sf)).withColumn("gain", F.round("gain", 6))


FUSED = "WITH s AS (SELECT vec_id AS pos, unnest(embedding)::DOUBLE AS logit, generate_subscripts(embedding, 1)::INT - 1 AS token, unnest(list_transform(embedding, lambda x: exp(x::DOUBLE))) AS m FROM embeddings), q AS (SELECT *, CASE WHEN token % 2 = 0 THEN m / 64 END AS q FROM s), e AS (SELECT pos, token, exp(logit + coalesce(0.5 * ln(greatest(q, 1e-12)) / 2.0 + 0.1, 0)) AS e FROM q), d AS (SELECT pos, token, e / sum(e) OVER (PARTITION BY pos) AS p FROM e)"


def fused(spark, sf):
    """Each embedding as logits over 64 tokens, fused with a memory that knows every second one."""
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.posexplode("embedding").alias("token", "x")).select("pos", "token", F.col("x").cast("double").alias("logit"))
    return P.loglinear_fusion(rows.withColumn("q", F.when(F.col("token") % 2 == 0, F.exp("logit") / 64)), 0.5, 2.0, 0.1)


@query("p10_loglinear_fusion", f"{FUSED} SELECT pos, round(sum(p), 9) AS total, round(max(p), 6) AS top, round(sum(p * token), 6) AS centre FROM d GROUP BY pos")
def p10(spark, sf):
    return fused(spark, sf).groupBy("pos").agg(F.round(F.sum("p"), 9).alias("total"), F.round(F.max("p"), 6).alias("top"), F.round(F.sum(F.col("p") * F.col("token")), 6).alias("centre"))


@query("p11_temperature_grid", f"{REC}, t AS (SELECT unnest([0.5, 1.0, 2.0, 4.0])::DOUBLE AS temperature) SELECT temperature, round(avg(nll_p / temperature + nll_q * (1 - 1 / temperature)), 6) AS nll FROM r CROSS JOIN t GROUP BY temperature")
def p11(spark, sf):
    return P.temperature_grid(records(spark, sf), [0.5, 1.0, 2.0, 4.0]).withColumn("nll", F.round("nll", 6))


#: The grids of scale and bias, the line of weights, and the coarse search with a temperature.
CALIBRATION = [i / 4 - 5 for i in range(41)]
LINE = [i / 20 - 2 for i in range(161)]
COARSE = {"temperatures": [0.5, 0.75, 1.0, 1.5, 2.0, 3.0], "scales": [i / 2 - 2 for i in range(21)], "biases": [float(i - 5) for i in range(11)]}


def calibration_rows(spark, sf):
    """Each embedding as logits over 64 tokens, its label the target, beside a memory that knows every second token."""
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), "label", F.posexplode("embedding").alias("token", "x"))
    return rows.select("pos", "token", F.col("x").cast("double").alias("logit"), F.when(F.col("token") % 2 == 0, F.least(F.exp(F.col("x").cast("double")) / 64, F.lit(1.0))).alias("q"), (F.col("token") == F.col("label")).alias("is_target"))


#: A full softmax in every cell.
CELLS = "WITH s AS (SELECT vec_id AS pos, label, unnest(embedding)::DOUBLE AS logit, generate_subscripts(embedding, 1)::INT - 1 AS token FROM embeddings), q AS (SELECT pos, token = label AS own, logit, CASE WHEN token % 2 = 0 THEN ln(least(exp(logit) / 64, 1)) END AS lnq FROM s), c AS (SELECT {c}), f AS (SELECT c.*, pos, own, logit + coalesce(scale * lnq / temperature + bias, 0) AS x, logit FROM q CROSS JOIN c), g AS (SELECT temperature, scale, bias, pos, least(-ln(1e-12), -ln(sum(exp(x)) FILTER (own) / sum(exp(x)))) AS loss, least(-ln(1e-12), -ln(sum(exp(logit)) FILTER (own) / sum(exp(logit)))) AS base FROM f GROUP BY ALL), r AS (SELECT temperature, scale, bias, count(*) AS n, avg(loss) AS nll, avg(base) AS base_nll FROM g GROUP BY ALL)"
_BEST = "SELECT temperature, scale, bias, n, round(nll, 9) AS nll, round(base_nll, 9) AS base_nll, round(base_nll - nll, 9) AS delta_nats, round((base_nll - nll) / ln(2), 9) AS delta_bits FROM r ORDER BY r.nll, temperature, scale, bias LIMIT 1"


def rounded_best(grid):
    return P.best_calibration(grid).select("temperature", "scale", "bias", "n", *[F.round(c, 9).alias(c) for c in ("nll", "base_nll", "delta_nats", "delta_bits")])


@query("p11_calibration_grid", CELLS.format(c=f"1.0::DOUBLE AS temperature, scale::DOUBLE AS scale, bias::DOUBLE AS bias FROM (SELECT unnest({CALIBRATION}) AS scale) CROSS JOIN (SELECT unnest({CALIBRATION}) AS bias)") + " SELECT scale, bias, n, round(nll, 9) AS nll FROM r")
def p11_calibration(spark, sf):
    """All 41 x 41 cells."""
    return P.calibration_grid(calibration_rows(spark, sf), CALIBRATION, CALIBRATION).select("scale", "bias", "n", F.round("nll", 9).alias("nll"))


@query("p11_weight_line", CELLS.format(c=f"1.0::DOUBLE AS temperature, unnest({LINE})::DOUBLE AS scale, 0.0::DOUBLE AS bias") + " " + _BEST)
def p11_line(spark, sf):
    """The best of 161 weights without a bias."""
    return rounded_best(P.calibration_grid(calibration_rows(spark, sf), LINE, [0.0]))


@query("p11_temperature_search", CELLS.format(c=f"temperature::DOUBLE AS temperature, scale::DOUBLE AS scale, bias::DOUBLE AS bias FROM (SELECT unnest({COARSE['temperatures']}) AS temperature) CROSS JOIN (SELECT unnest({COARSE['scales']}) AS scale) CROSS JOIN (SELECT unnest({COARSE['biases']}) AS bias)") + " " + _BEST.replace("ORDER BY r.nll", "ORDER BY round(r.nll, 12)"))
def p11_temperature(spark, sf):
    """The best of 6 temperatures, 21 scales and 11 biases; equal ratios of scale and temperature tie."""
    return rounded_best(P.calibration_grid(calibration_rows(spark, sf), COARSE["scales"], COARSE["biases"], COARSE["temperatures"]).withColumn("nll", F.round("nll", 12)))


@query("p12_distribution_features", f"{FUSED} SELECT pos, round(sum(-p * ln(greatest(p, 1e-12))), 6) AS entropy, round(max(p), 6) AS top_p, count(*) AS support FROM d GROUP BY pos")
def p12(spark, sf):
    return P.distribution_features(fused(spark, sf)).select("pos", F.round("entropy", 6).alias("entropy"), F.round("top_p", 6).alias("top_p"), "support")


@query("p13_gate", f"{REC}, f AS (SELECT exp(round(margin, 6)) AS ratio, exp(-nll_p) AS top_p, evidence > 0 AS agrees, grp FROM r) SELECT count(*) AS n, count(*) FILTER (grp <> 0 AND top_p >= 0.5 AND (ratio >= 0.5 OR agrees)) AS opened FROM f")
def p13(spark, sf):
    f = records(spark, sf).select(F.exp(F.round("margin", 6)).alias("ratio"), F.exp(-F.col("nll_p")).alias("top_p"), (F.col("evidence") > 0).alias("agrees"), F.when(F.col("grp") == 0, "semantic").otherwise("number").alias("task"))
    return P.gate(f, "hybrid", 0.5).agg(F.count("*").alias("n"), F.count_if("open").alias("opened"))


def labelled(spark, sf):
    return records(spark, sf).select("pos", "nll_q", F.ln(F.col("evidence") + 1).alias("log_evidence"), (F.col("margin") > 0).cast("int").alias("y"), "margin", (F.col("grp") != 0).alias("train"))


@query("p14_logistic_policy")
def p14(spark, sf):
    scored = P.logistic_policy(labelled(spark, sf), ["nll_q", "log_evidence"], "y").where("not train")
    return P.auc(scored.withColumn("p_open", F.round("p_open", 9)), "p_open", "y")


@query("p15_auc", f"{REC}, c AS (SELECT evidence AS s, count(*) FILTER (margin > 0) AS p, count(*) FILTER (margin <= 0) AS n FROM r GROUP BY evidence), x AS (SELECT *, sum(n) OVER (ORDER BY s) AS below FROM c) SELECT round(sum(p * (below - n / 2)) / (sum(p) * sum(n)), 9) AS auc FROM x")
def p15(spark, sf):
    rows = records(spark, sf).select("evidence", (F.col("margin") > 0).cast("int").alias("y"))
    return P.auc(rows, "evidence", "y").select(F.round("auc", 9).alias("auc"))


@query("p16_banded_accuracy", f"{REC}, b AS (SELECT {_band('round(nll_q, 9)', SURPRISAL)} AS band, (nll_p < 1)::INT AS trigram, (nll_q < 5)::INT AS unigram FROM r) SELECT band, count(*) AS n, round(avg(trigram), 9) AS trigram, round(avg(unigram), 9) AS unigram FROM b GROUP BY ROLLUP (band)")
def p16(spark, sf):
    rows = records(spark, sf).select(F.round("nll_q", 9).alias("surprisal"), (F.col("nll_p") < 1).alias("trigram"), (F.col("nll_q") < 5).alias("unigram"))
    return P.banded_accuracy(rows, "surprisal", ["trigram", "unigram"], SURPRISAL).select("band", "n", F.round("trigram", 9).alias("trigram"), F.round("unigram", 9).alias("unigram"))


TAUS = [i + 0.5 for i in range(13)]


@query("p17_threshold_curve", f"{REC}, t AS (SELECT unnest({TAUS})::DOUBLE AS tau) SELECT tau, round(avg((nll_q >= tau)::INT), 9) AS kept, round(avg(CASE WHEN nll_q >= tau THEN margin ELSE 0 END), 6) AS gain FROM r CROSS JOIN t GROUP BY tau")
def p17(spark, sf):
    out = P.threshold_curve(records(spark, sf), "nll_q", "margin", TAUS)
    return out.select("tau", F.round("kept", 9).alias("kept"), F.round("gain", 6).alias("gain"))


@query("p18_concentration", f"{RANKED}, q AS (SELECT unnest([1, 5, 10, 25, 50])::DOUBLE AS q), w AS (SELECT sum(margin) AS s, avg((margin < 0)::INT) AS neg, sum(CASE WHEN margin < 0 THEN margin ELSE 0 END) AS neg_sum FROM r) SELECT q, round(upto / s, 6) AS share, round(neg, 9) AS negative_share, round(neg_sum, 4) AS negative_sum FROM k JOIN q ON rank = greatest(1, ceil(total * q / 100)) CROSS JOIN w")
def p18(spark, sf):
    out = P.concentration(records(spark, sf), "margin")
    return out.select("q", F.round("share", 6).alias("share"), F.round("negative_share", 9).alias("negative_share"), F.round("negative_sum", 4).alias("negative_sum"))


@query("p19_masked_share", f"{REC}, t AS (SELECT unnest([1, 2, 5, 10, 50]) AS threshold) SELECT threshold, round(sum(margin) FILTER (evidence >= threshold) / sum(margin), 6) AS share FROM r CROSS JOIN t GROUP BY threshold")
def p19(spark, sf):
    return P.masked_share(records(spark, sf), "evidence", "margin", [1, 2, 5, 10, 50]).withColumn("share", F.round("share", 6))


@query("p20_rebase_counts", f"{REC}, c AS (SELECT doc_id, count(*) AS own FROM r GROUP BY doc_id) SELECT grp, count(*) AS n, count(own) AS known, sum(own)::BIGINT AS total FROM r LEFT JOIN c USING (doc_id) GROUP BY grp")
def p20(spark, sf):
    rows = records(spark, sf)
    out = P.rebase_counts(rows, rows.groupBy("doc_id").agg(F.count("*").alias("own")), ["doc_id"])
    return out.groupBy("grp").agg(F.count("*").alias("n"), F.count("own").alias("known"), F.sum("own").alias("total"))


@query("p21_best_threshold", f"{REC}, s AS (SELECT evidence AS s, sum(margin) AS v, count(*) AS k FROM r GROUP BY evidence), c AS (SELECT s, sum(v) OVER (ORDER BY s DESC) AS total, sum(k) OVER (ORDER BY s DESC) AS kept FROM s) SELECT s AS threshold, round(total, 4) AS total, kept::BIGINT AS kept FROM c ORDER BY c.total DESC, s DESC LIMIT 1")
def p21(spark, sf):
    return P.best_threshold(records(spark, sf), "evidence", "margin").withColumn("total", F.round("total", 4))


@query("p21_gate_study")
def p21_gate(spark, sf):
    return P.gate_study(records(spark, sf), "evidence", "margin")


@query("p22_ridge_gate")
def p22(spark, sf):
    out = P.ridge_gate(labelled(spark, sf).withColumnRenamed("margin", "gain"), ["nll_q", "log_evidence"], "gain").where("not train")
    return out.agg(F.count("*").alias("n"), F.round(F.corr("predicted", "gain"), 6).alias("corr"), F.round(F.avg(F.when(F.col("predicted") > 0, F.col("gain")).otherwise(0.0)), 6).alias("kept"))


@query("p23_changed_rows", "SELECT (vec_id % 7 = 0 AND embedding[1] <> 0) AS changed, count(*) AS n FROM embeddings GROUP BY 1")
def p23(spark, sf):
    a = read(spark, sf, "embeddings").select("vec_id", "embedding")
    b = a.select("vec_id", F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 7 == 0) & (i == 0), F.lit(0.0).cast("float")).otherwise(x)).alias("embedding"))
    return P.changed_rows(a, b, "vec_id", "embedding").groupBy("changed").agg(F.count("*").alias("n"))


@query("p24_last_change", f"{REC}, m AS (SELECT pos, margin, evidence >= 50 AS changed FROM r), l AS (SELECT *, coalesce(last_value(CASE WHEN changed THEN pos END IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last FROM m) SELECT CASE WHEN last < 0 THEN -1 ELSE least(pos - last, 20) END AS distance, count(*) AS n, round(avg(margin), 6) AS margin FROM l GROUP BY 1")
def p24(spark, sf):
    rows = records(spark, sf).select("pos", "margin", (F.col("evidence") >= 50).alias("changed"))
    out = P.last_change(rows)
    return out.groupBy(F.when(F.col("distance").isNull(), -1).otherwise(F.least("distance", F.lit(20))).alias("distance")).agg(F.count("*").alias("n"), F.round(F.avg("margin"), 6).alias("margin"))


BLOCK = 64
SPLIT = f"{REC}, m AS (SELECT pos, round(margin, 3) AS margin, evidence >= 50 AS changed FROM r), l AS (SELECT *, coalesce(last_value(CASE WHEN changed THEN pos END IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last FROM m), sp AS (SELECT *, last >= 0 AND pos // {BLOCK} = last // {BLOCK} AS same, last >= 0 AND pos // {BLOCK} <> last // {BLOCK} AS boundary, pos - last AS distance FROM l)"


def split_rows(spark, sf):
    rows = records(spark, sf).select("pos", F.round("margin", 3).alias("margin"), (F.col("evidence") >= 50).alias("changed"))
    return P.block_split(rows, BLOCK)


@query("p24_dose_response", f"{SPLIT}, g AS (SELECT unnest({[a for a, _ in P.DISTANCES]})::BIGINT AS low, unnest({[b for _, b in P.DISTANCES]})::BIGINT AS high), x AS (SELECT * FROM sp WHERE same AND NOT changed) SELECT low, high, count(margin) AS n, round(avg(margin), 6) AS mean, round(avg(abs(margin)), 6) AS mean_abs, round(avg((abs(margin) > 0.001)::INT), 9) AS above, round(avg((margin = 0)::INT), 9) AS exact_zero FROM g LEFT JOIN x ON distance BETWEEN low AND high GROUP BY low, high")
def p24_dose(spark, sf):
    """Margins of positions by the distance of the last well-known context in their block."""
    out = P.dose_response(split_rows(spark, sf), "margin")
    return out.select("low", "high", "n", F.round("mean", 6).alias("mean"), F.round("mean_abs", 6).alias("mean_abs"), F.round("above", 9).alias("above"), F.round("exact_zero", 9).alias("exact_zero"))


@query("p24_zero_rule", f"{SPLIT}, c AS (SELECT count(*) AS n, count(*) FILTER (margin = 0) AS n_zero, count(*) FILTER (margin = 0 AND NOT changed) AS n_zero_untouched, count(*) FILTER (margin = 0 AND changed) AS n_zero_changed, count(*) FILTER (boundary) AS boundary_n, count(*) FILTER (boundary AND margin = 0) AS boundary_zero FROM sp) SELECT *, n_zero - boundary_zero AS zeros_not_boundary, round(coalesce(boundary_zero / nullif(boundary_n, 0), 0), 9) AS boundary_zero_share, round(coalesce(boundary_zero / nullif(n_zero, 0), 0), 9) AS zeros_explained FROM c")
def p24_zero(spark, sf):
    """How far margins of exactly zero are those behind a block boundary."""
    out = P.zero_rule(split_rows(spark, sf), "margin")
    return out.withColumn("boundary_zero_share", F.round("boundary_zero_share", 9)).withColumn("zeros_explained", F.round("zeros_explained", 9))


def layered(spark, sf):
    """Each embedding as eight layers of eight tokens, a softmax each, without what is below 0.03; the last layer is the final one."""
    cells = read(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.posexplode("embedding").alias("i", "x")).select("item", F.floor(F.col("i") / 8).cast("int").alias("layer"), (F.col("i") % 8).alias("token"), F.exp(F.col("x").cast("double")).alias("e"))
    z = cells.groupBy("item", "layer").agg(F.sum("e").alias("z"))
    dist = cells.join(z, ["item", "layer"]).select("item", "layer", "token", (F.col("e") / F.col("z")).alias("p")).where("p >= 0.03")
    return dist, dist.where("layer = 7").select("item", "token", "p")


COMPARED = """WITH c AS (SELECT vec_id AS item, (i - 1) // 8 AS layer, (i - 1) % 8 AS token, exp(x) AS e FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT AS i FROM embeddings)),
d AS (SELECT item, layer, token, p FROM (SELECT *, e / sum(e) OVER (PARTITION BY item, layer) AS p FROM c) WHERE p >= 0.03), f AS (SELECT item, token, p FROM d WHERE layer = 7),
g AS (SELECT i.item, i.layer, t.token, greatest(coalesce(f.p, 0), 1e-12) AS p, greatest(coalesce(d.p, 0), 1e-12) AS q FROM (SELECT DISTINCT item, layer FROM d) i CROSS JOIN (SELECT unnest(generate_series(0, 7)) AS token) t LEFT JOIN f ON f.item = i.item AND f.token = t.token LEFT JOIN d ON d.item = i.item AND d.layer = i.layer AND d.token = t.token WHERE f.p IS NOT NULL OR d.p IS NOT NULL),
n AS (SELECT item, layer, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM g WINDOW w AS (PARTITION BY item, layer)), k AS (SELECT item, layer, sum(p * ln(p / q)) AS kl FROM n GROUP BY ALL),
tf AS (SELECT item, token FROM f QUALIFY row_number() OVER (PARTITION BY item ORDER BY p DESC, token) <= 3), td AS (SELECT item, layer, token FROM d QUALIFY row_number() OVER (PARTITION BY item, layer ORDER BY p DESC, token) <= 3),
cmp AS (SELECT k.item, k.layer, kl, (SELECT count(*) FROM td JOIN tf USING (item, token) WHERE td.item = k.item AND td.layer = k.layer) / 3 AS overlap FROM k)"""


@query("p25_distributions", f"{COMPARED} SELECT item, layer::INT AS layer, round(kl, 6) + 0.0 AS kl, round(overlap, 9) AS overlap FROM cmp")
def p25_distributions(spark, sf):
    """Divergence and shared commonest tokens of every layer against the last."""
    return P.compare_distributions(*layered(spark, sf), 3).select("item", "layer", (F.round("kl", 6) + 0.0).alias("kl"), F.round("overlap", 9).alias("overlap"))


@query("p25_depth", f"{COMPARED}, m AS (SELECT *, max(round(kl, 9)) OVER (PARTITION BY item) AS most FROM cmp) SELECT item, (min(layer) FILTER (round(kl, 9) <= 0.5 * most))::INT AS by_kl, (min(layer) FILTER (overlap > 0.3))::INT AS by_overlap FROM m GROUP BY item")
def p25_depth(spark, sf):
    return P.distribution_depth(P.compare_distributions(*layered(spark, sf), 3).withColumn("kl", F.round("kl", 9)))


@query("p25_transition_points", "WITH c AS (SELECT vec_id AS item, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS layer FROM embeddings), x AS (SELECT *, max(value) OVER (PARTITION BY item) AS top, lead(value) OVER (PARTITION BY item ORDER BY layer) AS after FROM c) SELECT item, min(layer) FILTER (value <= top / 2)::INT AS half, min(layer) FILTER (value > 0.3)::INT AS above, min(layer) FILTER (value > 0 AND after > 0)::INT AS steady FROM x GROUP BY item")
def p25(spark, sf):
    curves = read(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.posexplode("embedding").alias("layer", "value")).withColumn("value", F.col("value").cast("double"))
    return P.transition_points(curves)
