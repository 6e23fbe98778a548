"""Gates between arms, routing bounds over seeds, contrasts of models and the rule sets that turn figures into verdicts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.scale import ranked
from corpuslab.functions.storage import written

from .evaluation import verdict, weighted_deviation


def rule_disagreements(read: DataFrame, by: str, rules: list[str]) -> DataFrame:
    """(by, rule_a, rule_b, only_a, only_b, agree): items on which two reading rules differ, for every pair of rules.

    One pass over the rows; a null reading counts as a miss.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    pairs = list(combinations(rules, 2))
    counts = [F.struct(F.lit(a).alias("rule_a"), F.lit(b).alias("rule_b"), F.count_if(flag(a) & ~flag(b)).alias("only_a"), F.count_if(flag(b) & ~flag(a)).alias("only_b"), F.count_if(flag(a) == flag(b)).alias("agree")) for a, b in pairs]
    return read.groupBy(by).agg(F.array(*counts).alias("x")).select(by, F.explode("x").alias("x")).select(by, "x.*")


def correlation(aligned: DataFrame, by: list[str]) -> DataFrame:
    """(by…, n, r): Pearson correlation of the two sides; null where a side does not vary. One-sided items are left out."""
    both = aligned.where("a is not null and b is not null")
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.corr(F.col("a").cast("double"), F.col("b").cast("double")).alias("r"))


def joint_variation(rows: DataFrame, arm: str, labels: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """(arm_a, arm_b, kind, tv): total variation of each label, and of all of them jointly, between pairs of arms.

    Kinds are the labels' names and ``joint``. Labels are counted once per arm; shares then meet over their union. A
    null label is a label like any other; an arm without rows has distance null.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in labels]
    kinds = [F.struct(F.lit(c).alias("kind"), p.alias("label")) for c, p in zip(labels, parts, strict=True)]
    kinds.append(F.struct(F.lit("joint").alias("kind"), F.concat_ws("\x01", *parts).alias("label")))
    arms = sorted({x for p in pairs for x in p})
    counted = rows.where(F.col(arm).isin(*arms)).select(F.col(arm).alias("arm"), F.explode(F.array(*kinds)).alias("x")).groupBy("x.kind", "x.label").pivot("arm", arms).count().na.fill(0)
    total = counted.groupBy("kind").agg(*[F.sum(a).alias(f"z_{a}") for a in arms])
    met = counted.join(F.broadcast(total), "kind")
    share = lambda a: F.when(F.col(f"z_{a}") > 0, F.col(a) / F.col(f"z_{a}"))
    sums = met.groupBy("kind").agg(F.array(*[F.struct(F.lit(a).alias("arm_a"), F.lit(b).alias("arm_b"), (0.5 * F.sum(F.abs(share(a) - share(b)))).alias("tv")) for a, b in pairs]).alias("x"))
    return sums.select("kind", F.explode("x").alias("x")).select("x.arm_a", "x.arm_b", "kind", "x.tv")


def loss_phase_gate(runs: DataFrame, real: str, control: str, bare: str) -> DataFrame:
    """One row: on how many corpora and runs the real arm's perplexity is below the control's and the bare one's, and ``passed``.

    ``runs``: (corpus, seed, arm, loss). A corpus compares means over seeds of perplexities. Passed: five sixths of the
    corpora and two thirds of the runs (rounded up) below the control, and all of both below the bare arm. A missing run
    counts as not below.
    """
    wide = runs.withColumn("ppl", F.exp("loss")).groupBy("corpus", "seed").pivot("arm", [real, control, bare]).agg(F.first("ppl"))
    below = lambda other: F.coalesce(F.col(real) < F.col(other), F.lit(False))
    seeds = wide.where(F.col(real).isNotNull()).agg(F.count("*").alias("runs"), F.count_if(below(control)).alias("runs_below_control"), F.count_if(below(bare)).alias("runs_below_bare"))
    means = wide.groupBy("corpus").agg(*[F.avg(a).alias(a) for a in (real, control, bare)])
    corpora = means.agg(F.count("*").alias("corpora"), F.count_if(below(control)).alias("corpora_below_control"), F.count_if(below(bare)).alias("corpora_below_bare"))
    most = lambda n, up, down: F.greatest(F.lit(1), F.ceil(F.col(n) * up / down))
    passed = (F.col("corpora") > 0) & (F.col("corpora_below_control") >= most("corpora", 5, 6)) & (F.col("corpora_below_bare") == F.col("corpora"))
    passed = passed & (F.col("runs_below_control") >= most("runs", 2, 3)) & (F.col("runs_below_bare") == F.col("runs"))
    return corpora.join(F.broadcast(seeds)).withColumn("passed", passed)


def task_gate(values: DataFrame, real: str, control: str, bare: str, regression: float = 0.05) -> DataFrame:
    """(corpus, task, real, control, bare, candidate, severe) of (corpus, task, arm, value), tasks that all arms have.

    Candidate: above the bare arm and not below the control. Severe: below the better of both by more than ``regression``.
    """
    wide = values.groupBy("corpus", "task").pivot("arm", [real, control, bare]).agg(F.first("value"))
    rows = wide.select("corpus", "task", F.col(real).alias("real"), F.col(control).alias("control"), F.col(bare).alias("bare")).where("real is not null and control is not null and bare is not null")
    return rows.withColumn("candidate", (F.col("real") > F.col("bare")) & (F.col("real") >= F.col("control"))).withColumn("severe", F.col("real") < F.greatest("control", "bare") - regression)


def task_gate_summary(gated: DataFrame) -> DataFrame:
    """One row: candidates, severe regressions, and passed, which asks for some of the first and none of the second."""
    out = gated.agg(F.count("*").alias("tasks"), F.count_if("candidate").alias("candidates"), F.count_if("severe").alias("severe"))
    return out.withColumn("passed", (F.col("candidates") > 0) & (F.col("severe") == 0))


def side_by_side(correct: DataFrame, keys: list[str], arms: list[str]) -> DataFrame:
    """(keys…, a column of 0 and 1 per arm) of (keys…, arm, correct); an arm without an answer is wrong there."""
    wide = correct.groupBy(*keys).pivot("arm", arms).agg(F.max(F.col("correct").cast("int")))
    return wide.select(*keys, *[F.coalesce(F.col(a), F.lit(0)).alias(a) for a in arms])


def routing_over_seeds(correct: DataFrame, arms: list[str], sets: dict[str, list[str]]) -> DataFrame:
    """(task, policy, seeds, mean, deviation): accuracy of each fixed arm and of the best choice in each set of arms.

    ``correct``: (seed, task, item_id, arm, correct); an arm without an answer is wrong there. Accuracies are taken per
    seed, per task and over all tasks (task null), then averaged over seeds; the deviation is that of these seeds, 0 for one.
    """
    wide = side_by_side(correct, ["seed", "task", "item_id"], arms)
    policies = {f"always_{a}": F.col(a) for a in arms} | {name: F.greatest(*own) for name, own in sets.items()}
    shares = F.array(*[F.struct(F.lit(name).alias("policy"), F.avg(value).alias("accuracy")) for name, value in policies.items()])
    per = wide.rollup("seed", "task").agg(F.grouping("seed").alias("__all"), shares.alias("x")).where("__all = 0")
    rows = per.select("seed", "task", F.explode("x").alias("x")).select("seed", "task", "x.*")
    return rows.groupBy("task", "policy").agg(F.count("*").alias("seeds"), F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("deviation"))


def unique_table(correct: DataFrame, real: str, control: str, bare: str) -> DataFrame:
    """(task, items, both, real_only, bare_only, control_only, none) per task and, with task null, overall.

    The first two arms compared are the real and the bare one; the control counts only where both of them are wrong.
    """
    wide = side_by_side(correct, ["task", "item_id"], [real, control, bare])
    r, c, b = (F.col(x) == 1 for x in (real, control, bare))
    cases = {"both": r & b, "real_only": r & ~b, "bare_only": b & ~r, "control_only": ~r & ~b & c, "none": ~r & ~b & ~c}
    return wide.rollup("task").agg(F.count("*").alias("items"), *[F.count_if(x).alias(name) for name, x in cases.items()])


def channel_deltas(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(channel_a, channel_b, logp_delta, hit_delta): b less a, of mean finite log-probabilities and of hit rates over all rows.

    A channel without a finite log-probability has none to compare; its hits count all the same, a null hit as a miss.
    """
    ok = F.col("logp").isNotNull() & ~F.isnan("logp") & (F.abs("logp") != float("inf"))
    figures = rows.groupBy("channel").agg(F.avg(F.when(ok, F.col("logp"))).alias("logp"), F.avg(F.coalesce(F.col("hit"), F.lit(False)).cast("int")).alias("hit"))
    wanted = rows.sparkSession.createDataFrame(pairs, "channel_a string, channel_b string")
    side = lambda s: figures.select(F.col("channel").alias(f"channel_{s}"), F.col("logp").alias(f"l_{s}"), F.col("hit").alias(f"h_{s}"))
    met = F.broadcast(wanted).join(side("a"), "channel_a").join(side("b"), "channel_b")
    return met.select("channel_a", "channel_b", (F.col("l_b") - F.col("l_a")).alias("logp_delta"), (F.col("h_b") - F.col("h_a")).alias("hit_delta"))


def grouped_median(rows: DataFrame, by: str, value: str, digits: int = 9, times: str | None = None) -> DataFrame:
    """(by, median) of values rounded to ``digits`` places: exact, from counts of distinct values ranked over ranges.

    With ``times`` a row stands for so many.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, F.round(value, digits).alias("v")).agg((F.sum(times) if times else F.count("*")).alias("n"))
    placed = ranked(counts, [F.col(by), F.col("v")], {"upto": F.col("n")})
    spans = placed.groupBy(by).agg((F.max("upto")).alias("last"), (F.min(F.col("upto") - F.col("n"))).alias("first"))
    at = placed.join(F.broadcast(spans), by).select(by, "v", (F.col("upto") - F.col("first")).alias("upto"), (F.col("upto") - F.col("first") - F.col("n")).alias("before"), (F.col("last") - F.col("first")).alias("total"))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    holds = lambda k: (F.col("before") < k) & (k <= F.col("upto"))
    return at.groupBy(by).agg(((F.max(F.when(holds(low), F.col("v"))) + F.max(F.when(holds(high), F.col("v")))) / 2).alias("median"))


def model_contrast(pairs: DataFrame) -> DataFrame:
    """(category, n, delta, median, deviation, t, real_ppl, control_ppl, real_top1, control_top1, real_known, control_known).

    ``pairs``: (category, times, real_logp, control_logp, real_top, control_top, real_known, control_known), a row per category
    and kind of position, which stands for ``times`` of them; those of category ``all`` are every position once. The delta is
    real less control; t is null where nothing varies. Deviations are the sample's.
    """
    d = pairs.withColumn("__d", F.col("real_logp") - F.col("control_logp"))
    n = F.sum("times")
    mean = lambda c: F.sum(F.col("times") * c) / n
    share = lambda c: mean(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias({"real_top": "real_top1", "control_top": "control_top1"}.get(c, c))
    out = d.groupBy("category").agg(
        n.alias("n"), mean(F.col("__d")).alias("delta"), weighted_deviation(F.col("__d"), F.col("times")).alias("deviation"), F.exp(-mean(F.col("real_logp"))).alias("real_ppl"), F.exp(-mean(F.col("control_logp"))).alias("control_ppl"),
        *[share(c) for c in ("real_top", "control_top", "real_known", "control_known")],
    )
    t = F.when(F.col("deviation") > 0, F.col("delta") / (F.col("deviation") / F.sqrt("n")))
    return out.join(grouped_median(d, "category", "__d", times="times"), "category").withColumn("t", t)


# The labels, thresholds and order of the rule sets. A rule set is a list of (label, predicate, reason)
# and the label and reason where none holds.
ROW_RECOVERY = (
    [
        ("INCOMPLETE", "linear is null or counted is null or majority is null or shuffled is null or counted <= 0", "a figure is missing"),
        ("ROWS_DEAD", "linear <= floor + 0.005D and mlp <= mlp_floor + 0.005D", "both probes at the floor"),
        ("ROWS_CARRY_THE_TRIGRAM", "linear / counted >= 0.5D", "half or more recovered"),
        ("ROWS_DEGRADED", "linear / counted >= 0.2D", "a fifth or more recovered"),
    ],
    ("ROWS_NEARLY_DEAD", "less than a fifth recovered"),
)
RECOVERY_SEVERITY = {"ROWS_DEAD": 0, "ROWS_NEARLY_DEAD": 1, "ROWS_DEGRADED": 2, "ROWS_CARRY_THE_TRIGRAM": 3}
GATE_SELECTIVITY = (
    [
        ("INCOMPLETE", "missing > 0", "inputs missing"),
        ("UNDERPOWERED", "injected <= 0", "an arm never injected"),
        ("DISEASE_NOT_REPRODUCED", "open_scalar < 0.5D", "the scalar gate is not saturated"),
        ("GATE_STILL_SATURATED", "not (open_per_dim < 0.9D)", "the gate per dimension is as open"),
        ("GATE_SELECTIVITY_HELPS", "open_per_dim <= open_scalar - 0.2D and real_per_dim - real_scalar >= 0.02D and real_per_dim - control_per_dim >= 0.02D", "gains over the scalar gate and over the control"),
        ("GATE_SELECTIVITY_NO_EFFECT", "open_per_dim <= open_scalar - 0.2D and abs(real_per_dim - real_scalar) < 0.02D", "more selective without effect"),
    ],
    ("PARTIAL", "no rule holds"),
)
DEPTH_SHIFT = (
    [
        ("UNDERPOWERED", "tv is null or tv <= 1e-6D", "the conditions do not differ"),
        ("DEPTH_FREED", "freed >= 2", "two instruments shift, the shuffled arm less"),
        ("PERTURBATION_ONLY", "shifted > 0 and matched = shifted", "the shuffled arm shifts as much"),
        ("DEPTH_NULL", "still = instruments", "no instrument shifts"),
    ],
    ("MIXED", "instruments disagree"),
)
TAIL_HITS = ([("GAIN", "delta > 0 and t >= 3 and not isnan(t) and abs(t) < double('infinity')", "above noise")], ("FLAT", "not above noise"))
RESHAPING = (
    [
        ("ROWS_HARMED", "delta <= -0.05D and (t is null or abs(t) > 3)", "worse beyond the floor"),
        ("ROWS_RESHAPEABLE_BUT_NULL_MOVED", "delta >= 0.05D and (t is null or abs(t) > 3) and shuffled_delta > 0.01D", "the shuffled arm gained too"),
        ("ROWS_RESHAPEABLE", "delta >= 0.05D and (t is null or abs(t) > 3)", "better beyond the floor"),
    ],
    ("ROWS_STUCK", "inside the floor"),
)


def judged(df: DataFrame, rule_set: tuple) -> DataFrame:
    """Adds ``verdict`` and ``reason`` by one of the rule sets of this module."""
    return verdict(df, *rule_set)


def row_recovery(panels: DataFrame) -> DataFrame:
    """Adds floors and the verdict to (panel, linear, counted, shuffled, majority, mlp, mlp_shuffled).

    A floor is the larger of the shuffled control and the majority; without a second probe nothing is dead.
    """
    floors = panels.withColumn("floor", F.greatest("shuffled", "majority")).withColumn("mlp_floor", F.greatest(F.coalesce("mlp_shuffled", "majority"), F.col("majority")))
    return judged(floors, ROW_RECOVERY).withColumn("recovery", F.when(F.col("counted") > 0, F.col("linear") / F.col("counted")))


def most_conservative(judged_rows: DataFrame, severity: dict[str, int] = RECOVERY_SEVERITY) -> DataFrame:
    """One row (panels, agreement, verdict): the most severe label; INCOMPLETE without panels or where one is."""
    place = reduce(lambda e, kv: F.when(F.col("verdict") == kv[0], kv[1]).otherwise(e), severity.items(), F.lit(None).cast("int"))
    label: Column = F.min_by("verdict", place)
    out = judged_rows.agg(F.count("*").alias("panels"), F.count_if(place.isNull()).alias("__open"), (F.countDistinct("verdict") <= 1).alias("agreement"), label.alias("__v"))
    return out.select("panels", "agreement", F.when((F.col("panels") == 0) | (F.col("__open") > 0), "INCOMPLETE").otherwise(F.col("__v")).alias("verdict"))


def depth_shift(rows: DataFrame, by: list[str], shift: int = 2) -> DataFrame:
    """(by…, tv, instruments, freed, shifted, matched, still, verdict, reason) of (by…, tv, instrument, off, real, shuf).

    ``off``, ``real`` and ``shuf`` are layers of a transition, null where there is none. An instrument is shifted where
    real lies ``shift`` layers or more before off, freed if the shuffled arm moved less, matched if as much, still if
    real moved by less than ``shift`` either way.
    """
    gained = rows.withColumn("__r", F.col("off") - F.col("real")).withColumn("__s", F.col("off") - F.col("shuf"))
    moved = F.col("__r") >= shift
    counts = {"freed": moved & (F.col("__s") < F.col("__r")), "shifted": moved, "matched": moved & (F.col("__s") >= F.col("__r")), "still": F.abs("__r") < shift}
    out = gained.groupBy(*by).agg(F.max("tv").alias("tv"), F.count("*").alias("instruments"), *[F.count_if(x).alias(name) for name, x in counts.items()])
    return judged(out, DEPTH_SHIFT)


def tail_hits(hits: DataFrame, tau: float, base: str, arms: list[str], by: list[str] | None = None) -> DataFrame:
    """(by…, arm, n_total, n_tail, base_hit, arm_hit, delta, t, verdict, reason): hits of arms against ``base`` in the tail.

    The tail are the positions whose ``surprisal`` is at least ``tau``. Differences are paired; t is null where nothing
    varies. Columns of hits are booleans named by their arm.
    """
    by = by or []
    tail = F.col("surprisal") >= tau
    hit = lambda c: F.when(tail, F.col(c).cast("double"))
    per = [F.struct(F.lit(a).alias("arm"), F.avg(hit(a)).alias("arm_hit"), F.avg(hit(a) - hit(base)).alias("delta"), F.stddev_samp(hit(a) - hit(base)).alias("sd")) for a in arms]
    sums = hits.groupBy(*by).agg(F.count("*").alias("n_total"), F.count_if(tail).alias("n_tail"), F.avg(hit(base)).alias("base_hit"), F.array(*per).alias("x"))
    rows = sums.select(*by, "n_total", "n_tail", "base_hit", F.explode("x").alias("x")).select(*by, "x.arm", "n_total", "n_tail", "base_hit", "x.arm_hit", "x.delta", "x.sd")
    return judged(rows.withColumn("t", F.when(F.col("sd") > 0, F.col("delta") / (F.col("sd") / F.sqrt("n_tail")))).drop("sd"), TAIL_HITS)


#: Tokens that one bucket of a shuffled order has at most, on average, and digits of their digest that order them within it.
BUCKET_ROWS, DIGITS = 1 << 16, 15


def shuffled_pairs(lists: DataFrame, seed: int) -> DataFrame:
    """(w1, token, n): pairs of neighbours in texts (doc_id, tokens) after all tokens were dealt anew over all positions.

    The k-th token by a digest of seed, document and position stands at the k-th position, as in ``shuffled_within``. Tokens
    are dealt to buckets by their digests' first bits and sorted there, so that they lie in their new order: a row needs
    its place for nothing but where texts begin, and those places are dealt to the buckets as well. The last
    token of a bucket goes to the next one too. No position is written, ranked or joined.
    """
    spark = lists.sparkSession
    sizes = lists.select("doc_id", F.size("tokens").cast("long").alias("n")).where("n > 0")
    starts = ranked(sizes, [F.col("doc_id")], {"upto": F.col("n")}).select((F.col("upto") - F.col("n")).alias("start"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bits = min(16, max(0, (total - 1) // BUCKET_ROWS).bit_length())
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("pos").cast("string")))
    tokens = lists.select("doc_id", F.posexplode("tokens").alias("pos", "token")).select(F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long").alias("h"), "token")
    bucket = F.shiftright("h", 4 * DIGITS - bits).cast("int").alias("bucket")
    found = sorted((r["bucket"], r["n"], r["last"]) for r in tokens.groupBy(bucket).agg(F.count("*").alias("n"), F.max("h").alias("last")).collect())
    names, begin = np.array([x[0] for x in found], np.int32), np.cumsum([0, *[x[1] for x in found]])
    following = [(found[i][2], found[i + 1][0]) for i in range(len(found) - 1)]
    last = F.broadcast(spark.createDataFrame(following, "h long, following int"))
    own = F.struct(bucket, F.col("h").alias("at"))
    sent = F.when(F.col("following").isNotNull(), F.array(own, F.struct(F.col("following").alias("bucket"), F.lit(-1).cast("long").alias("at")))).otherwise(F.array(own))
    dealt = tokens.join(last, "h", "left").select(F.explode(sent).alias("x"), "token").select("x.bucket", F.col("x.at").alias("h"), "token", F.lit(None).cast("long").alias("start"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = batch["start"].to_numpy()
            at = names[np.searchsorted(begin, start, "right") - 1]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), -2)), pa.nulls(len(at), pa.string()), pa.array(start)], ["bucket", "h", "token", "start"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            h = rows["h"].to_numpy()
            on = h > -2
            coded = rows["token"].filter(pa.array(on)).combine_chunks().dictionary_encode()
            words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            first = begin[np.searchsorted(names, rows["bucket"][0].as_py())] - int((h == -1).sum())
            new = np.zeros(len(codes), bool)
            new[rows["start"].filter(pa.array(~on)).to_numpy() - first] = True
            inner = np.flatnonzero(~new[1:])
            if len(inner):
                keys, times = np.unique(codes[inner] * len(words) + codes[inner + 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(keys // len(words))), words.take(pa.array(keys % len(words))), pa.array(times)], ["w1", "token", "n"])

        rest: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                of = batch["bucket"].to_numpy()
                cut = int(np.searchsorted(of, of[0], "right"))
                if rest and rest[0]["bucket"][0].as_py() != of[0]:
                    yield from pairs(pa.Table.from_batches(rest))
                    rest = []
                rest.append(batch.slice(0, cut))
                batch = batch.slice(cut)
        if rest:
            yield from pairs(pa.Table.from_batches(rest))

    rows = dealt.unionByName(starts.mapInArrow(placed, "bucket int, h long, token string, start long"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "h").mapInArrow(neighbours, "w1 string, token string, n long")


def bigram_contrast(lists: DataFrame, seed: int) -> DataFrame:
    """(token, times, real_logp, control_logp, real_top, control_top, real_known, control_known) of held positions.

    ``lists``: (doc_id, held, tokens). Real: bigrams of the training texts, control: of the same tokens dealt anew, both as
    of ``bigram_model``. What they say of a position follows from its token and the one before, so equal positions are one row.
    """
    train = lists.where("not held").select("doc_id", "tokens")
    words = lists.select("held", "tokens", F.posexplode("tokens").alias("pos", "token")).withColumn("w1", F.when(F.col("pos") > 0, F.get("tokens", F.col("pos") - 1)).otherwise(""))
    counted = lambda df, name, n: df.select("w1", "token", *[(n if c == name else F.lit(0)).cast("long").alias(c) for c in ("nr", "nc", "nh")])
    rows = counted(words.where("not held and pos > 0"), "nr", F.lit(1)).unionByName(counted(shuffled_pairs(train, seed), "nc", F.col("n"))).unionByName(counted(words.where("held"), "nh", F.lit(1)))
    pairs = written(rows.groupBy("w1", "token").agg(*[F.sum(c).alias(c) for c in ("nr", "nc", "nh")]), "contrast-pairs")
    best = lambda c: F.min(F.struct((-F.col(c)).alias("m"), "token"))["token"]
    masses = pairs.where("w1 <> '' and nr + nc > 0").groupBy("w1").agg(F.sum("nr").alias("zr"), F.sum("nc").alias("zc"), best("nr").alias("br"), best("nc").alias("bc"))
    single = written(train.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n1")), "contrast-words")
    whole = single.agg(F.sum("n1").alias("z1"), best("n1").alias("b1"))
    met = pairs.where("nh > 0").join(masses, "w1", "left").join(single, "token", "left").join(F.broadcast(whole))
    out = [F.col("token"), F.col("nh").alias("times")]
    for name, n, z, b in (("real", "nr", "zr", "br"), ("control", "nc", "zc", "bc")):
        known = F.coalesce(F.col(z) > 0, F.lit(False))
        lower = F.col("n1") / F.col("z1")
        p = F.coalesce(F.when(known, F.nullif(F.col(n), F.lit(0)) / F.col(z)).otherwise(lower), lower, F.lit(1e-12))
        out += [F.ln(p).alias(f"{name}_logp"), (F.col("token") == F.when(known, F.col(b)).otherwise(F.col("b1"))).alias(f"{name}_top"), known.alias(f"{name}_known")]
    return met.select(*out)


def commonest_next(counts: DataFrame, order: int) -> DataFrame:
    """(ctx, best): the commonest token after each context of ``order`` - 1 tokens, ties to the smaller token."""
    return counts.where(F.col("ord") == order).groupBy("ctx").agg(F.min(F.struct((-F.col("n")).alias("m"), "next")).alias("x")).select("ctx", F.col("x.next").alias("best"))


def bigram_model(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, pos, token, logp, top, known): bigrams with backoff to unigrams over (doc_id, pos, token, before).

    ``known``: the token before has continuations; ``top``: the token is the commonest of them, or of all tokens where
    it has none. A token that its context lacks has its unigram probability, an unknown one 1e-12.
    """
    level = {k: counts.where(F.col("ord") == k) for k in (1, 2)}
    z = level[2].groupBy(F.col("ctx").alias("c2")).agg(F.sum("n").alias("z2"))
    best = commonest_next(counts, 2).select(F.col("ctx").alias("c2"), F.col("best").alias("best2"))
    whole = level[1].agg(F.sum("n").alias("z1"), F.min(F.struct((-F.col("n")).alias("m"), "next"))["next"].alias("best1"))
    rows = tokens.select("doc_id", "pos", "token", F.try_element_at("before", F.lit(-1)).alias("c2"))
    met = rows.join(z.join(best, "c2"), "c2", "left").join(level[2].select(F.col("ctx").alias("c2"), F.col("next").alias("token"), F.col("n").alias("n2")), ["c2", "token"], "left")
    met = met.join(level[1].select(F.col("next").alias("token"), F.col("n").alias("n1")), "token", "left").join(F.broadcast(whole))
    known = F.col("z2").isNotNull()
    p = F.coalesce(F.when(known, F.col("n2") / F.col("z2")).otherwise(F.col("n1") / F.col("z1")), F.col("n1") / F.col("z1"), F.lit(1e-12))
    return met.select("doc_id", "pos", "token", F.ln(p).alias("logp"), (F.col("token") == F.coalesce("best2", "best1")).alias("top"), known.alias("known"))

