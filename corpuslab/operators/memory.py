"""What a gate sees of a memory beside a base model: features, gates by mode, studies over folds, audits of row gating."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.storage import written

from .positions import ORACLE_FIELDS, fold_of


def memory_features(rows: DataFrame) -> DataFrame:
    """(pos, support, base_entropy, memory_entropy, expected, pseudo, memory_top1, base_top1_prob, memory_top1_prob, agrees).

    ``rows``: (pos, token, logit, q), a row per token of the base model; q null or 0 outside the memory, whose masses need
    not add up to 1. ``expected`` is the mean over the memory of ln(memory / base), ``pseudo`` and ``memory_top1`` that
    ratio at the base's and the memory's best token, ties to the smaller one. Without a memory its figures and the ratios
    are null and nothing agrees; where the memory lacks the base's best token ``pseudo`` is null.

    All of it are sums and maxima per position, combined before the shuffle; no list of a position's tokens is made.
    """
    top = rows.groupBy("pos").agg(F.max("logit").alias("__top"))
    x, q = F.col("x"), F.col("m")
    each = rows.join(top, "pos").select("pos", "token", (F.col("logit") - F.col("__top")).alias("x"), F.when(F.col("q") > 0, F.col("q")).alias("m"))
    best = lambda value, *more: F.max(F.struct(F.col(value).alias("v"), F.negative("token").alias("t"), *more))
    sums = each.groupBy("pos").agg(
        F.count("m").alias("support"), F.sum(F.exp(x)).alias("s"), F.sum(x * F.exp(x)).alias("sx"), F.sum(q).alias("z"), F.sum(q * F.ln(q)).alias("qlq"), F.sum(q * x).alias("qx"),
        best("x", q.alias("q")).alias("base"), F.max(F.when(q.isNotNull(), F.struct(q.alias("v"), F.negative("token").alias("t"), x.alias("x")))).alias("mem"),
    )
    entropy = F.ln("z") - F.col("qlq") / F.col("z")
    out = sums.select(
        "pos", "support", (F.ln("s") - F.col("sx") / F.col("s")).alias("base_entropy"), entropy.alias("memory_entropy"),
        (-entropy - F.col("qx") / F.col("z") + F.ln("s")).alias("expected"),
        (F.ln(F.col("base.q") / F.col("z")) + F.ln("s")).alias("pseudo"),
        (F.ln(F.col("mem.v") / F.col("z")) - F.col("mem.x") + F.ln("s")).alias("memory_top1"),
        (1 / F.col("s")).alias("base_top1_prob"), (F.col("mem.v") / F.col("z")).alias("memory_top1_prob"),
        F.coalesce(F.col("base.t") == F.col("mem.t"), F.lit(False)).alias("agrees"),
    )
    return out


def one_hot(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Adds ``<column>_<name>``, 1.0 or 0.0, for each name; a null or unknown value counts as ``general`` if that is a name."""
    value = F.coalesce(F.col(column), F.lit("general"))
    return df.withColumns({f"{column}_{n}": (value == n).cast("double") for n in names})


MODES = ("expected_kl", "pseudo_label", "memory_top1", "hybrid")


def opens(mode: str, threshold: float):
    """Whether a gate of this mode opens: its ratio reaches the threshold; hybrid asks for the expected ratio and a pseudo ratio of 0 or more."""
    at = lambda c, t: F.coalesce(F.col(c) >= t, F.lit(False))
    return {"expected_kl": at("expected", threshold), "pseudo_label": at("pseudo", threshold), "memory_top1": at("memory_top1", threshold), "hybrid": at("expected", threshold) & at("pseudo", 0.0)}[mode]


def memory_gate(features: DataFrame, mode: str, threshold: float, semantic: tuple[str, ...] = ("semantic",)) -> DataFrame:
    """Adds ``open``: a task of ``semantic`` keeps every gate shut, as does a missing ratio; a null task is no such task."""
    allowed = ~F.coalesce(F.col("task").isin(*semantic), F.lit(False))
    return features.withColumn("open", allowed & opens(mode, threshold))


def gate_grid(features: DataFrame, thresholds: list[float], modes: tuple[str, ...] = MODES, semantic: tuple[str, ...] = ("semantic",)) -> DataFrame:
    """(mode, threshold, n, opened, agreeing): positions, open ones, and open ones whose best tokens agree, in one pass."""
    allowed = ~F.coalesce(F.col("task").isin(*semantic), F.lit(False))
    cells = [F.struct(F.lit(m).alias("mode"), F.lit(float(t)).alias("threshold"), F.count_if(allowed & opens(m, t)).alias("opened"), F.count_if(allowed & opens(m, t) & F.col("agrees")).alias("agreeing")) for m in modes for t in thresholds]
    return features.agg(F.count("*").alias("n"), F.array(*cells).alias("x")).select("n", F.explode("x").alias("x")).select("x.mode", "x.threshold", "n", "x.opened", "x.agreeing")


def gate_study(records: DataFrame, features: list[str], target: str, folds: int = 5, ridge: float = 1.0, l2: float = 1e-3, steps: int = 30) -> DataFrame:
    """``records`` with ``fold``, ``ridge`` (predicted gain) and ``logistic`` (probability of a gain), both fitted without that fold.

    Folds are contiguous stretches of ``pos``. Features are standardised by the figures of the fold's training rows.
    Ridge solves for the gain itself; the logistic fit minimises mean loss plus l2/2 of the squared weights without the
    bias, by Newton steps. What comes to the driver are sums per fold of the features' number squared, never rows. Fields
    that a gate cannot see are refused by name; rows with a null feature or gain are left out.
    """
    refused = [f for f in features if f in ORACLE_FIELDS]
    if refused:
        raise ValueError(f"not observable when a gate decides: {', '.join(refused)}")
    d = len(features) + 1
    # Written once: every step of the fit reads these rows, and the ranking behind the folds is not done again.
    rows = written(fold_of(records.dropna(subset=[*features, target]), folds), "gate-folds")
    x = [F.col(f).cast("double") for f in features]
    own = rows.groupBy("fold").agg(F.count("*").alias("n"), F.array(*map(F.sum, x)).alias("s"), F.array(*[F.sum(v * v) for v in x]).alias("q")).collect()
    n, s, q = np.zeros(folds), np.zeros((folds, d - 1)), np.zeros((folds, d - 1))
    for r in own:
        n[r["fold"]], s[r["fold"]], q[r["fold"]] = r["n"], r["s"], r["q"]
    n, s, q = n.sum() - n, s.sum(axis=0) - s, q.sum(axis=0) - q
    size = np.maximum(n, 1)[:, None]
    mean = s / size
    spread = np.sqrt(np.maximum(q / size - mean**2, 0.0))
    spread[spread <= 1e-12] = 1.0
    data = rows.select("fold", F.array(*x).alias("x"), F.col(target).cast("double").alias("y"))

    def sums(weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Per left-out fold: Gram matrix and moments of the gain (no weights), or Hessian and gradient of the loss."""

        def run(batches):
            total = np.zeros((folds, d, d + 1))
            for part in batches:
                raw, gain, fold = np.stack(part["x"].to_numpy()), part["y"].to_numpy(), part["fold"].to_numpy()
                for g in range(folds):
                    keep = fold != g
                    z = np.column_stack([np.ones(keep.sum()), (raw[keep] - mean[g]) / spread[g]])
                    y, w = gain[keep], np.ones(keep.sum())
                    if weights is not None:
                        p = 1 / (1 + np.exp(-np.clip(z @ weights[g], -30, 30)))
                        y, w = p - (y > 0), p * (1 - p)
                    total[g, :, :d] += (z * w[:, None]).T @ z
                    total[g, :, d] += z.T @ y
            yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

        cells = {r["i"]: r["v"] for r in data.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        whole = np.array([cells.get(i, 0.0) for i in range(folds * d * (d + 1))]).reshape(folds, d, d + 1)
        return whole[:, :, :d], whole[:, :, d]

    free = np.diag([0.0] + [1.0] * (d - 1))
    gram, moments = sums(None)
    linear = np.array([np.linalg.lstsq(gram[g] + ridge * free, moments[g], rcond=None)[0] for g in range(folds)])
    logit = np.zeros((folds, d))
    for _ in range(steps):
        hessian, slope = sums(logit)
        move = np.array([np.linalg.lstsq(hessian[g] / size[g] + l2 * free, slope[g] / size[g] + l2 * free @ logit[g], rcond=None)[0] for g in range(folds)])
        logit -= move
        if np.abs(move).max() < 1e-10:
            break

    def applied(weights: np.ndarray):
        fitted = [sum(((v - float(m)) / float(e) * float(w) for v, m, e, w in zip(x, mean[g], spread[g], weights[g, 1:], strict=True)), F.lit(float(weights[g, 0]))) for g in range(folds)]
        return F.element_at(F.array(*fitted), F.col("fold") + 1)

    return rows.withColumn("ridge", applied(linear)).withColumn("logistic", 1 / (1 + F.exp(-applied(logit))))


def gate_report(studied: DataFrame, target: str) -> DataFrame:
    """(policy, n, opened, gain, share): mean gain per position if open where each policy says so, and its share of the oracle's."""
    value = F.col(target)
    policies = {"always": F.lit(True), "logistic": F.col("logistic") >= 0.5, "ridge": F.col("ridge") > 0, "oracle": value > 0}
    cells = [F.struct(F.lit(p).alias("policy"), F.count_if(c).alias("opened"), F.avg(F.when(c, value).otherwise(0.0)).alias("gain")) for p, c in policies.items()]
    one = studied.agg(F.count("*").alias("n"), F.avg(F.greatest(value, F.lit(0.0))).alias("__best"), F.array(*cells).alias("x"))
    return one.select("n", "__best", F.explode("x").alias("x")).select("x.policy", "n", "x.opened", "x.gain", F.when(F.col("__best") > 0, F.col("x.gain") / F.col("__best")).alias("share"))


def band_sums(records: DataFrame, count: str, value: str, thresholds: list[int]) -> DataFrame:
    """(threshold, n, share, sum_over_total): rows with at least so many counts, their share, their value over the number of all rows."""
    held = lambda t: F.coalesce(F.col(count) >= t, F.lit(False))
    cells = [F.struct(F.lit(int(t)).alias("threshold"), F.count_if(held(t)).alias("n"), (F.count_if(held(t)) / F.count("*")).alias("share"), (F.coalesce(F.sum(F.when(held(t), F.col(value))), F.lit(0.0)) / F.count("*")).alias("sum_over_total")) for t in thresholds]
    return records.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def gating_table(rows: DataFrame) -> DataFrame:
    """One row of (selected, changed): both, selected_only, changed_only, neither, and the share on which they agree (1 for no rows)."""
    s, c = (F.coalesce(F.col(x), F.lit(False)) for x in ("selected", "changed"))
    out = rows.agg(F.count("*").alias("n"), F.count_if(s & c).alias("both"), F.count_if(s & ~c).alias("selected_only"), F.count_if(~s & c).alias("changed_only"), F.count_if(~s & ~c).alias("neither"))
    return out.withColumn("agreement", F.when(F.col("n") > 0, (F.col("both") + F.col("neither")) / F.col("n")).otherwise(1.0))


def region_means(rows: DataFrame) -> DataFrame:
    """(region, n, mean_a, mean_b, mean_difference, absmax_b, zero_share) of (selected, changed, delta_a, delta_b).

    Regions: all, selected, unselected, and untouched, the positions whose row did not change: there ``delta_b`` must be
    exactly zero, and ``zero_share`` and ``absmax_b`` say how far it is. An empty region has means null.
    """
    s, c = (F.coalesce(F.col(x), F.lit(False)) for x in ("selected", "changed"))
    regions = F.array_compact(F.array(F.lit("all"), F.when(s, "selected").otherwise("unselected"), F.when(~c, "untouched")))
    grid = rows.sparkSession.createDataFrame([(r,) for r in ("all", "selected", "unselected", "untouched")], "region string")
    found = rows.select(F.explode(regions).alias("region"), "delta_a", "delta_b").groupBy("region").agg(
        F.count("*").alias("n"), F.avg("delta_a").alias("mean_a"), F.avg("delta_b").alias("mean_b"), F.avg(F.col("delta_b") - F.col("delta_a")).alias("mean_difference"),
        F.max(F.abs("delta_b")).alias("absmax_b"), F.avg((F.col("delta_b") == 0).cast("int")).alias("zero_share"),
    )
    return F.broadcast(grid).join(found, "region", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def prefix_losses(train: DataFrame, held: DataFrame, fracs: list[float]) -> DataFrame:
    """(frac, n_tokens, nll): loss of the held-out tokens under add-one unigrams of growing prefixes of the documents.

    Prefixes are in order of id up to that share of the largest. A token's counts in all prefixes are one vector, so
    training and held-out tokens meet once.
    """
    last = train.agg(F.max("doc_id")).first()[0] or 0
    upto = lambda f: F.count_if(F.col("doc_id") <= f * last)
    counts = train.groupBy("token").agg(F.array(*map(upto, fracs)).alias("c"))
    asked = held.groupBy("token").agg(F.count("*").alias("h"))
    sizes = counts.agg(F.count("*").alias("v"), F.array(*[F.sum(F.col("c")[i]) for i in range(len(fracs))]).alias("z"))
    met = asked.join(counts, "token", "left").join(F.broadcast(sizes))
    known = lambda i: F.coalesce(F.col("c")[i], F.lit(0))
    cells = [F.struct(F.lit(float(f)).alias("frac"), F.first(F.col("z")[i]).alias("n_tokens"), (F.sum(-F.col("h") * F.ln((known(i) + 1) / (F.col("z")[i] + F.col("v") + 1))) / F.sum("h")).alias("nll")) for i, f in enumerate(fracs)]
    return met.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*").where("n_tokens > 0")


def learning_curve(points: DataFrame) -> DataFrame:
    """One row (n_points, asymptote, slope, r2) of nll = asymptote + slope / sqrt(n_tokens); nulls for fewer than three points."""
    x = F.when(F.col("n_tokens") > 0, F.pow(F.col("n_tokens").cast("double"), F.lit(-0.5)))
    fit = points.agg(F.count(x).alias("n_points"), F.regr_intercept(F.col("nll"), x).alias("a"), F.regr_slope(F.col("nll"), x).alias("b"), F.regr_r2(F.col("nll"), x).alias("r"))
    enough = F.col("n_points") >= 3
    return fit.select("n_points", F.when(enough, F.col("a")).alias("asymptote"), F.when(enough, F.col("b")).alias("slope"), F.when(enough, F.col("r")).alias("r2"))


def projection(fit: DataFrame, target: float) -> DataFrame:
    """Adds ``tokens_needed`` for ``target`` distinct entries and ``note`` to a power law (exponent, intercept).

    Nothing is projected from an exponent of 0 or less. Note: flat below 0.2, above 1 an upper bound, else ok; none
    without a fit.
    """
    b = F.col("exponent")
    note = F.when(b.isNull(), "no_fit").when(b < 0.2, "saturating").when(b > 1, "upper_bound").otherwise("ok")
    return fit.withColumn("tokens_needed", F.when(b > 1e-9, F.exp((F.lit(float(np.log(target))) - F.col("intercept")) / b))).withColumn("note", note)
