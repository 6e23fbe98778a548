"""Answer scoring, paired comparison of arms, resampling and verdict rules."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import answers as A
from corpuslab.functions import text as T
from corpuslab.functions.scale import hash_ranked, ranked


def scores(answers: DataFrame) -> DataFrame:
    """Adds exact and contains of the whole text, and of its extracted candidate, against ``gold``.

    An empty normalised gold is never contained and an empty prediction never exact.
    """
    pred, gold = T.norm_answer(F.col("generated")), T.norm_answer(F.col("gold"))
    cand = T.norm_answer(A.last_candidate(F.col("generated")))
    out = answers.withColumns({"__p": pred, "__g": gold, "__c": cand})
    exact = lambda p: (F.col(p) != "") & (F.col(p) == F.col("__g"))
    contains = lambda p: (F.col("__g") != "") & F.col(p).contains(F.col("__g"))
    return out.withColumns({"exact": exact("__p"), "contains": contains("__p"), "extracted_exact": exact("__c"), "extracted_contains": contains("__c")}).drop("__p", "__g", "__c")


def second_scores(answers: DataFrame) -> DataFrame:
    """Adds what the second rule extracts: ``extracted``, its exact and contains, and ``task_metric``, the one that suits the task.

    ``boolq`` asks for an exact yes or no, every other task for a candidate that contains the gold. Rules of empty
    texts as in ``scores``; a null task is like any other but ``boolq``.
    """
    out = answers.withColumn("extracted", A.answer_candidate(F.col("generated"), F.coalesce("task", F.lit(""))))
    out = out.withColumns({"__c": T.norm_answer(F.col("extracted")), "__g": T.norm_answer(F.col("gold"))})
    exact, contains = (F.col("__c") != "") & (F.col("__c") == F.col("__g")), (F.col("__g") != "") & F.col("__c").contains(F.col("__g"))
    return out.withColumns({"v2_exact": exact, "v2_contains": contains, "task_metric": F.when(F.col("task") == "boolq", exact).otherwise(contains)}).drop("__c", "__g")


def second_metrics(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by…, n, v2_exact, v2_contains, task_metric, n_generated): means per group, rolled up as in ``metrics``."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 9).alias(c)
    return scored.rollup(*by).agg(F.count("*").alias("n"), *[mean(c) for c in ("v2_exact", "v2_contains", "task_metric", "n_generated")])


def reading_rules(answers: DataFrame) -> DataFrame:
    """Adds four readings on plain normal forms: substring (an empty gold counts), word window, exact, leading."""
    p, g = T.norm_alnum(F.col("generated")), T.norm_alnum(F.col("gold"))
    framed = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return answers.withColumns({"r_substring": p.contains(g), "r_window": (g != "") & framed(p).contains(framed(g)), "r_exact": p == g, "r_leading": (g != "") & framed(p).startswith(framed(g))})


def window_hit(tokens: Column, answer: Column, most: int = 8) -> Column:
    """Whether up to ``most`` tokens in a row, joined without spaces, equal the answer without spaces."""
    bare = F.regexp_replace(F.lower(answer), r"\s+", "")
    joined = lambda t: F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.array_join(F.slice(t, i, n), ""))))
    return T.let(tokens, lambda t: (bare != "") & F.array_contains(joined(t), bare))


def metrics(scored: DataFrame, by: list[str], n_generated: str = "n_generated") -> DataFrame:
    """Mean of each score per group and, rolled up, per leading groups and overall; mean generated length."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 9).alias(c)
    return scored.rollup(*by).agg(F.count("*").alias("n"), *[mean(c) for c in ("exact", "contains", "extracted_exact", "extracted_contains", n_generated)])


def format_fingerprint(answers: DataFrame, by: str = "arm") -> DataFrame:
    """Per arm: rates of empty, scaffolded, yes-leading and distinct answers."""
    g = F.coalesce(F.col("generated"), F.lit(""))
    rate = lambda c: F.round(F.avg(c.cast("double")), 9)
    return answers.groupBy(by).agg(F.count("*").alias("n"), rate(F.trim(g) == "").alias("empty"), rate(T.format_label(g) == "chat_scaffold").alias("scaffold"), rate(F.lower(F.trim(g)).startswith("yes")).alias("yes"), F.round(F.countDistinct(g) / F.count("*"), 9).alias("distinct_rate"))


def align(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows of both arms side by side (a, b); a missing side is null."""
    return a.select(*key, F.col(value).alias("a")).join(b.select(*key, F.col(value).alias("b")), key, "full_outer")


def alignment_report(a: DataFrame, b: DataFrame, key: list[str], check: str) -> DataFrame:
    """One row: items of one arm only, and items whose ``check`` column (the question) differs."""
    j = align(a, b, key, check)
    return j.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a") != F.col("b")).alias("mismatched"), F.count("*").alias("items"))


def paired_delta(aligned: DataFrame, by: list[str], sign: int = 1, ddof: int = 1) -> DataFrame:
    """Per group: n, mean of sign * (b - a), its standard error and t, win rate, counts of b only and a only ahead."""
    d = aligned.where("a is not null and b is not null").withColumn("d", sign * (F.col("b").cast("double") - F.col("a").cast("double")))
    sd = F.stddev_samp("d") if ddof else F.stddev_pop("d")
    out = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("delta"), (sd / F.sqrt(F.count("*"))).alias("sem"), F.avg((F.col("d") > 0).cast("int")).alias("win_rate"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"))
    return out.withColumn("t", F.when(F.col("sem") > 0, F.col("delta") / F.col("sem")))


def weighted_deviation(value: Column, times: Column) -> Column:
    """The sample's deviation of values that stand for so many each; null for a single one."""
    n, mean = F.sum(times), F.sum(times * value) / F.sum(times)
    return F.when(n > 1, F.sqrt(F.greatest(F.sum(times * value * value) - n * mean * mean, F.lit(0.0)) / (n - 1)))


def weighted_delta(rows: DataFrame) -> DataFrame:
    """``paired_delta`` over all rows (a, b, times), of which each stands for so many pairs."""
    d, times = F.col("b") - F.col("a"), F.col("times")
    count = lambda c: F.coalesce(F.sum(F.when(c, times)), F.lit(0))
    out = rows.agg(F.sum(times).alias("n"), (F.sum(times * d) / F.sum(times)).alias("delta"), (weighted_deviation(d, times) / F.sqrt(F.sum(times))).alias("sem"), (count(d > 0) / F.sum(times)).alias("win_rate"), count(d > 0).alias("wins"), count(d < 0).alias("losses"))
    return out.withColumn("t", F.when(F.col("sem") > 0, F.col("delta") / F.col("sem")))


def with_p_values(contrasts: DataFrame, by: list[str]) -> DataFrame:
    """Adds to paired contrasts: two-sided p of t (normal tail), exact McNemar p, one-sided sign-test p.

    Runs on aggregated rows, one per contrast.
    """
    names = [f for f in contrasts.schema.fieldNames() if f not in ("p_t", "p_mcnemar", "p_sign")]

    def tail(wins: int, n: int) -> float:
        """P(at least ``wins`` of ``n`` fair coins), exact at every size: terms relative to the largest, from its logarithm."""
        first = max(wins, (n + 1) // 2)
        log = math.lgamma(n + 1) - math.lgamma(first + 1) - math.lgamma(n - first + 1) - n * math.log(2)
        total, term = 0.0, 1.0
        for i in range(first, n + 1):
            total += term
            term *= (n - i) / (i + 1)
            if term < total * 1e-18:
                break
        term = 1.0
        for i in range(first, wins, -1):
            term *= i / (n - i + 1)
            total += term
            if term < total * 1e-18:
                break
        return min(1.0, math.exp(log) * total)

    def add(batches):
        for rows in batches:
            p_t, p_m, p_s = [], [], []
            for t, w, lo in zip(rows["t"], rows["wins"], rows["losses"], strict=True):
                n = int(w + lo)
                p_t.append(None if pd.isna(t) else math.erfc(abs(t) / math.sqrt(2)))
                p_m.append(min(1.0, 2 * tail(max(int(w), int(lo)), n)) if n else 1.0)
                p_s.append(tail(int(w), n) if n else 1.0)
            yield rows.assign(p_t=p_t, p_mcnemar=p_m, p_sign=p_s)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in contrasts.select(*names).schema.fields)
    return contrasts.select(*names).mapInPandas(add, f"{schema}, p_t double, p_mcnemar double, p_sign double")


POISSON_CUTS = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])


def poisson_weights(seeds: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson(1) weights (rows x replicates) of rows with 64-bit seeds: a mixed hash of seed and replicate, by its distribution."""
    with np.errstate(over="ignore"):
        x = seeds.astype(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(POISSON_CUTS, (x ^ (x >> np.uint64(31))) / 2.0**64, "right").astype(float)


def bootstrap(df: DataFrame, value: str, key: list[str], by: list[str], replicates: int = 200, seed: int = 0) -> DataFrame:
    """(by…, n, mean, wins, losses, lo, hi): percentile interval of the mean by a Poisson bootstrap; wins: values above 0.

    Each row draws a Poisson(1) weight per replicate from its hash. A task adds up one vector over replicates per group,
    and those are all that is shuffled; rows are never copied per replicate. Null values are left out.
    """
    names = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*names, F.xxhash64(*key, F.lit(seed)).alias("__s"), F.col(value).cast("double").alias("__v"))

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for part in batches:
            for group, own in part.groupby(names, dropna=False) if names else [((), part)]:
                group = group if isinstance(group, tuple) else (group,)
                for i in range(0, len(own), 1024):
                    v = own["__v"].to_numpy()[i : i + 1024]
                    weights = poisson_weights(own["__s"].to_numpy()[i : i + 1024], replicates)
                    sums[group] = sums.get(group, 0.0) + np.stack([weights.sum(axis=0), v @ weights], axis=1)
        yield pd.DataFrame([(*g, b, *row) for g, both in sums.items() for b, row in enumerate(both.tolist())], columns=[*names, "b", "w", "x"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    parts = rows.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "b int, w double, x double"]))
    means = parts.groupBy(*names, "b").agg(F.sum("w").alias("w"), F.sum("x").alias("x")).where("w > 0").withColumn("m", F.col("x") / F.col("w"))
    out = means.groupBy(*names).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    v = F.col("__v")
    mean = rows.groupBy(*names).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.count_if(v > 0).alias("wins"), F.count_if(v < 0).alias("losses"))
    return mean.join(out, names) if names else mean.join(F.broadcast(out))


def total_variation(rows: DataFrame, arm: str, label: str, a: str, b: str) -> DataFrame:
    """One row: half the sum of absolute differences of the label shares of two arms."""
    share = lambda x: rows.where(F.col(arm) == x).groupBy(label).agg(F.count("*").alias("n")).join(F.broadcast(rows.where(F.col(arm) == x).agg(F.count("*").alias("z")))).select(label, (F.col("n") / F.col("z")).alias(f"s_{x}"))
    j = share(a).join(share(b), label, "full_outer")
    return j.agg((0.5 * F.sum(F.abs(F.coalesce(f"s_{a}", F.lit(0.0)) - F.coalesce(f"s_{b}", F.lit(0.0))))).alias("tv"))


def split_half_noise(rows: DataFrame, label: str, key: str, halves: int = 50) -> DataFrame:
    """One row: mean total variation between the halves of ``halves`` hashed splits of one arm, its noise floor."""
    side = F.pmod(F.xxhash64(key, F.col("h")), F.lit(2))
    c = rows.select(F.col(label).alias("l"), key, F.explode(F.sequence(F.lit(0), F.lit(halves - 1))).alias("h")).groupBy("h", "l").agg(F.count_if(side == 0).alias("x"), F.count_if(side == 1).alias("y"))
    z = c.groupBy("h").agg(F.sum("x").alias("zx"), F.sum("y").alias("zy"))
    tv = c.join(F.broadcast(z), "h").groupBy("h").agg((0.5 * F.sum(F.abs(F.col("x") / F.col("zx") - F.col("y") / F.col("zy")))).alias("tv"))
    return tv.agg(F.avg("tv").alias("noise"))


def metric_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, a, b, delta, relative) of two long tables (metric, value)."""
    j = align(a, b, ["metric"], "value")
    return j.withColumn("delta", F.col("b") - F.col("a")).withColumn("relative", F.when(F.col("a") != 0, (F.col("b") - F.col("a")) / F.abs("a")))


def matrix_summary(runs: DataFrame, arms: list[str]) -> DataFrame:
    """Per corpus: mean and deviation over seeds of each arm's loss, and its perplexity, side by side."""
    per = runs.groupBy("corpus").pivot("arm", arms).agg(F.round(F.avg("loss"), 9).alias("mean"), F.round(F.stddev_pop("loss"), 9).alias("std"), F.round(F.exp(F.avg("loss")), 6).alias("ppl"))
    return per


def loss_gate(runs: DataFrame, real: str, control: str, least_share: float = 2 / 3) -> DataFrame:
    """Per seed: corpora on which the real arm's loss is below the control's, and whether enough are."""
    pivoted = runs.groupBy("corpus", "seed").pivot("arm", [real, control]).agg(F.first("loss"))
    won = F.count_if(F.col(real) < F.col(control))
    return pivoted.groupBy("seed").agg(F.count("*").alias("corpora"), won.alias("won"), (won >= F.ceil(least_share * F.count("*"))).alias("passed"))


def oracle_routing(correct: DataFrame, arms: list[str], by: str = "task") -> DataFrame:
    """Per task and overall: accuracy of each arm, of the best choice per item, and of items only one arm has.

    ``correct``: (item_id, task, arm, correct). Ties of the choice go to the first arm in ``arms``.
    """
    wide = correct.groupBy(by, "item_id").pivot("arm", arms).agg(F.max(F.col("correct").cast("int")))
    wide = wide.select(by, "item_id", *[F.coalesce(F.col(a), F.lit(0)).alias(a) for a in arms])
    any_ = F.greatest(*arms)
    total = sum(F.col(a) for a in arms)
    choice = F.lit("none")
    for a in reversed(arms):
        choice = F.when(F.col(a) == 1, a).otherwise(choice)
    rows = wide.withColumns({"oracle": any_, "choice": choice, "unique": (total == 1).cast("int")})
    mean = lambda c: F.round(F.avg(c), 9)
    return rows.rollup(by).agg(F.count("*").alias("items"), *[mean(a).alias(a) for a in arms], mean("oracle").alias("oracle"), mean("unique").alias("unique"), *[F.count_if(F.col("choice") == a).alias(f"chose_{a}") for a in arms])


def nuisance_contrast(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row of y regressed on x: slope, intercept, R², the mean of y, its part explained by the mean of x, the rest.

    The adjusted difference is the intercept: what remains of y where the nuisance does not differ.
    """
    r = rows.agg(F.count("*").alias("n"), F.avg(y).alias("mean_y"), F.avg(x).alias("mean_x"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("adjusted"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    residual = F.greatest(F.col("syy") * (1 - F.col("r2")), F.lit(0.0)) / (F.col("n") - 2)
    se = F.sqrt(residual * (1 / F.col("n") + F.col("mean_x") ** 2 / F.col("sxx")))
    share = F.when(F.col("mean_y") != 0, 1 - F.col("adjusted") / F.col("mean_y"))
    return r.select("n", "mean_y", "slope", "adjusted", "r2", se.alias("adjusted_se"), share.alias("explained_share"))


def verdict(df: DataFrame, rules: list[tuple[str, str, str]], default: tuple[str, str]) -> DataFrame:
    """Adds ``verdict`` and ``reason``: the first rule (label, SQL predicate, reason) that holds, else the default.

    A predicate that is null does not hold.
    """
    label, reason = F.lit(default[0]), F.lit(default[1])
    for name, predicate, why in reversed(rules):
        holds = F.coalesce(F.expr(predicate), F.lit(False))
        label, reason = F.when(holds, name).otherwise(label), F.when(holds, why).otherwise(reason)
    return df.withColumn("verdict", label).withColumn("reason", reason)


def pass_at_k(samples: DataFrame) -> DataFrame:
    """Per k up to the number of samples is left to the caller: any of a problem's samples passed; mean repetition."""
    per = samples.groupBy("problem").agg(F.max(F.col("passed").cast("int")).alias("any"), F.avg("repetition").alias("rep"))
    return per.agg(F.count("*").alias("problems"), F.avg("any").alias("pass_at_k"), F.avg("rep").alias("repetition"))


def grouped_means(rows: DataFrame, group: str, arm: str, value: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Per group: mean of each arm and the mean difference of each named pair of arms (later minus earlier)."""
    arms = sorted({x for p in pairs for x in p})
    wide = rows.groupBy(group).pivot(arm, arms).agg(F.avg(F.col(value).cast("double")))
    return wide.select(group, *[F.round(a, 9).alias(a) for a in arms], *[F.round(F.col(b) - F.col(a), 9).alias(f"{b}_minus_{a}") for a, b in pairs])


def channel_comparison(rows: DataFrame) -> DataFrame:
    """Per channel: positions with a finite log-probability, its mean, and hit rate."""
    ok = F.col("logp").isNotNull() & ~F.isnan("logp") & (F.abs("logp") != float("inf"))
    return rows.where(ok).groupBy("channel").agg(F.count("*").alias("n"), F.avg("logp").alias("mean_logp"), F.avg(F.col("hit").cast("int")).alias("hit"))


def shuffled_within(df: DataFrame, column: str, key: str | list[str], seed: int) -> DataFrame:
    """(key…, column) with values dealt anew over all keys, by meeting two global ranks."""
    keys = [key] if isinstance(key, str) else key
    a = ranked(df.select(*keys), [F.col(c) for c in keys])
    b = hash_ranked(df.select(*keys, column), seed, keys).select("rank", column)
    return a.join(b, "rank").drop("rank")
