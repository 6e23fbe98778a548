"""Queries E1-E20 over answers derived from conversations: three arms that answer each question differently."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions.storage import read
from corpuslab.operators import corpus as C
from corpuslab.operators import evaluation as E

from .corpus import QA
from .registry import query
from .text import ALNUM

ARMS = ("full", "head", "echo")
#: An item's id is its conversation times this, more than any turn's number, plus its turn.
ITEM = 2**31 + 2


def answers(spark, sf):
    """(arm, task, item_id, question, gold, generated, n_generated): gold are the first two words of the answer."""
    pairs = C.qa_pairs(read(spark, sf, "conversations")).select((F.col("conv_id").cast("long") * ITEM + F.col("turn")).alias("item_id"), "question", "answer")
    gold = F.array_join(F.slice(T.norm_words(F.col("answer")), 1, 2), " ")
    task = F.when(F.pmod(F.char_length("question"), F.lit(2)) == 0, "even").otherwise("odd")
    forms = F.array(*[F.struct(F.lit(a).alias("arm"), g.alias("generated")) for a, g in (("full", F.col("answer")), ("head", F.substring("answer", 1, 12)), ("echo", F.col("question")))])
    rows = pairs.select("item_id", task.alias("task"), "question", gold.alias("gold"), F.explode(forms).alias("x"))
    return rows.select("x.arm", "task", "item_id", "question", "gold", "x.generated", F.char_length("x.generated").alias("n_generated"))


_NORM = lambda c: ALNUM.replace("text", c)
ANSWERS = f"""WITH q AS (SELECT conv_id::BIGINT * {ITEM} + turn AS item_id, question, answer, CASE WHEN length(question) % 2 = 0 THEN 'even' ELSE 'odd' END AS task, array_to_string(list_filter(string_split({_NORM('answer')}, ' '), lambda w: w <> '')[1:2], ' ') AS gold FROM {QA}),
an AS (SELECT unnest(['full','head','echo']) AS arm, task, item_id, question, gold, unnest([answer, substring(answer, 1, 12), question]) AS generated FROM q),
rr AS (SELECT *, {_NORM('generated')} AS p, {_NORM('gold')} AS g, length(generated) AS n_generated FROM an)"""


@query("e1_scores")
def e1(spark, sf):
    return E.scores(answers(spark, sf)).select("arm", "item_id", "exact", "contains", "extracted_exact", "extracted_contains")


@query("e2_reading_rules", f"{ANSWERS} SELECT arm, count(*) AS n, count(*) FILTER (contains(p, g)) AS r_substring, count(*) FILTER (g <> '' AND contains(' ' || p || ' ', ' ' || g || ' ')) AS r_window, count(*) FILTER (p = g) AS r_exact, count(*) FILTER (g <> '' AND starts_with(' ' || p || ' ', ' ' || g || ' ')) AS r_leading FROM rr GROUP BY arm")
def e2(spark, sf):
    names = ("r_substring", "r_window", "r_exact", "r_leading")
    return E.reading_rules(answers(spark, sf)).groupBy("arm").agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in names])


@query("e3_window_hit", f"{ANSWERS}, t AS (SELECT arm, regexp_extract_all(lower(generated), '[a-z0-9'']+') AS t, regexp_replace(lower(gold), '\\s+', '', 'g') AS b FROM an) SELECT arm, count(*) FILTER (b <> '' AND len(list_filter(generate_series(1, len(t)), lambda i: len(list_filter(generate_series(1, 8), lambda n: array_to_string(t[i:i+n-1], '') = b)) > 0)) > 0) AS hits FROM t GROUP BY arm")
def e3(spark, sf):
    rows = answers(spark, sf).withColumn("tokens", T.word_tokens(F.col("generated")))
    return rows.groupBy("arm").agg(F.count_if(E.window_hit(F.col("tokens"), F.col("gold"))).alias("hits"))


@query("e4_metrics")
def e4(spark, sf):
    return E.metrics(E.scores(answers(spark, sf)), ["arm", "task"])


def second(spark, sf):
    """Answers scored by the second rule; questions of even length count as yes-or-no ones."""
    rows = answers(spark, sf).withColumn("task", F.when(F.col("task") == "even", "boolq").otherwise("qa"))
    return E.second_scores(rows)


@query("e1_second_scores")
def e1_second(spark, sf):
    return second(spark, sf).select("arm", "item_id", "extracted", "v2_exact", "v2_contains", "task_metric")


@query("e4_task_metric")
def e4_second(spark, sf):
    return E.second_metrics(second(spark, sf), ["arm", "task"])


@query("e5_format_fingerprint", f"{ANSWERS} SELECT arm, count(*) AS n, round(avg((trim(generated) = '')::INT), 9) AS empty, 0.0::DOUBLE AS scaffold, round(avg(starts_with(lower(trim(generated)), 'yes')::INT), 9) AS yes, round(count(DISTINCT generated) / count(*), 9) AS distinct_rate FROM an GROUP BY arm")
def e5(spark, sf):
    return E.format_fingerprint(answers(spark, sf))


def arm(df, name):
    return df.where(F.col("arm") == name)


@query("e6_alignment", f"{ANSWERS} SELECT 0::BIGINT AS only_a, count(*) FILTER (length(question) < 40) AS only_b, 0::BIGINT AS mismatched, count(*) AS items FROM an WHERE arm = 'full'")
def e6(spark, sf):
    a = answers(spark, sf)
    short = arm(a, "full").where(F.char_length("question") >= 40)
    return E.alignment_report(short, arm(a, "head"), ["task", "item_id"], "question")


PAIRED = f"{ANSWERS}, d AS (SELECT task, item_id, max(CASE WHEN arm = 'head' THEN length(p) END)::DOUBLE - max(CASE WHEN arm = 'echo' THEN length(p) END) AS d FROM rr GROUP BY ALL)"


def paired(spark, sf):
    rows = answers(spark, sf).withColumn("value", F.char_length(T.norm_alnum(F.col("generated"))))
    return E.align(arm(rows, "echo"), arm(rows, "head"), ["task", "item_id"], "value")


@query("e7_paired_delta", f"{PAIRED} SELECT task, count(*) AS n, round(avg(d), 6) AS delta, round(stddev_samp(d) / sqrt(count(*)), 6) AS sem, round(avg((d > 0)::INT), 9) AS win_rate, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM d GROUP BY task")
def e7(spark, sf):
    out = E.paired_delta(paired(spark, sf), ["task"])
    return out.select("task", "n", F.round("delta", 6).alias("delta"), F.round("sem", 6).alias("sem"), F.round("win_rate", 9).alias("win_rate"), "wins", "losses", F.round("t", 6).alias("t"))


@query("e8_paired_tests")
def e8(spark, sf):
    return E.with_p_values(E.paired_delta(paired(spark, sf), ["task"]), ["task"])


@query("e9_bootstrap")
def e9(spark, sf):
    rows = paired(spark, sf).withColumn("d", F.col("b") - F.col("a"))
    return E.bootstrap(rows, "d", ["item_id"], ["task"], 2000)


@query("e10_total_variation", f"{ANSWERS}, l AS (SELECT arm, least(length(p) // 50, 20) AS l FROM rr), s AS (SELECT arm, l, n / sum(n) OVER (PARTITION BY arm) AS s FROM (SELECT arm, l, count(*) AS n FROM l GROUP BY arm, l)) SELECT round(0.5 * sum(abs(coalesce(x.s, 0) - coalesce(y.s, 0))), 9) AS tv FROM (SELECT * FROM s WHERE arm = 'full') x FULL JOIN (SELECT * FROM s WHERE arm = 'echo') y USING (l)")
def e10(spark, sf):
    rows = answers(spark, sf).withColumn("l", F.least(F.floor(F.char_length(T.norm_alnum(F.col("generated"))) / 50), F.lit(20)))
    return E.total_variation(rows, "arm", "l", "full", "echo").select(F.round("tv", 9).alias("tv"))


@query("e10_noise_floor")
def e10_noise(spark, sf):
    rows = arm(answers(spark, sf), "full").withColumn("l", F.least(F.floor(F.char_length("generated") / 50), F.lit(20)))
    return E.split_half_noise(rows, "l", "item_id")


@query("e11_metric_delta", f"{ANSWERS}, m AS (SELECT arm, unnest(['length', 'words', 'items']) AS metric, unnest([avg(length(p)), avg(len(string_split(p, ' '))), count(*)])::DOUBLE AS value FROM rr GROUP BY arm) SELECT metric, round(x.value, 6) AS a, round(y.value, 6) AS b, round(y.value - x.value, 6) AS delta, round((y.value - x.value) / abs(x.value), 6) AS relative FROM (SELECT * FROM m WHERE arm = 'full') x JOIN (SELECT * FROM m WHERE arm = 'echo') y USING (metric)")
def e11(spark, sf):
    p = T.norm_alnum(F.col("generated"))
    long = lambda name: arm(answers(spark, sf), name).agg(F.avg(F.char_length(p)).alias("length"), F.avg(F.size(F.split(p, " "))).alias("words"), F.count("*").cast("double").alias("items")).select(F.expr("stack(3, 'length', length, 'words', words, 'items', items) as (metric, value)"))
    out = E.metric_delta(long("full"), long("echo"))
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("a", "b", "delta", "relative")])


RUNS = f"{ANSWERS}, r AS (SELECT task AS corpus, item_id % 3 AS seed, arm, avg(ln(1 + length(p))) AS loss FROM rr GROUP BY ALL)"


def runs(spark, sf):
    rows = answers(spark, sf).withColumn("loss", F.ln(1 + F.char_length(T.norm_alnum(F.col("generated")))))
    return rows.groupBy(F.col("task").alias("corpus"), (F.col("item_id") % 3).alias("seed"), "arm").agg(F.avg("loss").alias("loss"))


@query("e12_matrix_summary", f"{RUNS} SELECT corpus, " + ", ".join(f"round(avg(loss) FILTER (arm = '{a}'), 9) AS {a}_mean, round(stddev_pop(loss) FILTER (arm = '{a}'), 9) AS {a}_std, round(exp(avg(loss) FILTER (arm = '{a}')), 6) AS {a}_ppl" for a in ARMS) + " FROM r GROUP BY corpus")
def e12(spark, sf):
    return E.matrix_summary(runs(spark, sf), list(ARMS))


@query("e13_loss_gate", f"{RUNS}, p AS (SELECT corpus, seed, max(loss) FILTER (arm = 'head') < max(loss) FILTER (arm = 'echo') AS won FROM r GROUP BY ALL) SELECT seed, count(*) AS corpora, count(*) FILTER (won) AS won, count(*) FILTER (won) >= ceil(2 / 3 * count(*)) AS passed FROM p GROUP BY seed")
def e13(spark, sf):
    return E.loss_gate(runs(spark, sf), "head", "echo")


CORRECT = f"{ANSWERS}, c AS (SELECT task, item_id, arm, (g <> '' AND contains(p, g))::INT AS ok FROM rr), w AS (SELECT task, item_id, max(ok) FILTER (arm = 'full') AS \"full\", max(ok) FILTER (arm = 'head') AS head, max(ok) FILTER (arm = 'echo') AS echo FROM c GROUP BY ALL)"


def correct(spark, sf):
    p, g = T.norm_alnum(F.col("generated")), T.norm_alnum(F.col("gold"))
    return answers(spark, sf).select("task", "item_id", "arm", ((g != "") & p.contains(g)).alias("correct"))


@query("e14_oracle_routing", f"""{CORRECT} SELECT task, count(*) AS items, round(avg("full"), 9) AS "full", round(avg(head), 9) AS head, round(avg(echo), 9) AS echo, round(avg(greatest("full", head, echo)), 9) AS oracle, round(avg(("full" + head + echo = 1)::INT), 9) AS "unique",
count(*) FILTER ("full" = 1) AS chose_full, count(*) FILTER ("full" = 0 AND head = 1) AS chose_head, count(*) FILTER ("full" = 0 AND head = 0 AND echo = 1) AS chose_echo FROM w GROUP BY ROLLUP (task)""")
def e14(spark, sf):
    return E.oracle_routing(correct(spark, sf), list(ARMS))


@query("e15_rare_vs_common", f"{CORRECT}, z AS (SELECT length(gold) <= 8 AS rare, arm, (g <> '' AND contains(p, g))::INT AS ok FROM rr) SELECT rare, round(avg(ok) FILTER (arm = 'echo'), 9) AS echo, round(avg(ok) FILTER (arm = 'full'), 9) AS \"full\", round(avg(ok) FILTER (arm = 'head'), 9) AS head, round(avg(ok) FILTER (arm = 'full') - avg(ok) FILTER (arm = 'echo'), 9) AS full_minus_echo, round(avg(ok) FILTER (arm = 'head') - avg(ok) FILTER (arm = 'echo'), 9) AS head_minus_echo FROM z GROUP BY rare")
def e15(spark, sf):
    rare = answers(spark, sf).select("item_id", "arm", (F.char_length("gold") <= 8).alias("rare"))
    rows = correct(spark, sf).join(rare, ["item_id", "arm"])
    return E.grouped_means(rows, "rare", "arm", "correct", [("echo", "full"), ("echo", "head")])


@query("e16_nuisance_contrast", f"{ANSWERS}, d AS (SELECT item_id, (max(len(string_split(p, ' '))) FILTER (arm = 'full') - max(len(string_split(p, ' '))) FILTER (arm = 'echo'))::DOUBLE AS y, (max(length(p)) FILTER (arm = 'full') - max(length(p)) FILTER (arm = 'echo'))::DOUBLE AS x FROM rr GROUP BY item_id) SELECT count(*) AS n, round(avg(y), 6) AS mean_y, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS adjusted, round(regr_r2(y, x), 6) AS r2, round(sqrt(regr_syy(y, x) * (1 - regr_r2(y, x)) / (count(*) - 2) * (1 / count(*) + avg(x) * avg(x) / regr_sxx(y, x))), 6) AS adjusted_se, round(1 - regr_intercept(y, x) / avg(y), 6) AS explained_share FROM d")
def e16(spark, sf):
    p = T.norm_alnum(F.col("generated"))
    rows = answers(spark, sf).withColumns({"words": F.size(F.split(p, " ")), "chars": F.char_length(p)})
    wide = rows.groupBy("item_id").pivot("arm", ["full", "echo"]).agg(F.max("words").alias("w"), F.max("chars").alias("c"))
    d = wide.select((F.col("full_w") - F.col("echo_w")).cast("double").alias("y"), (F.col("full_c") - F.col("echo_c")).cast("double").alias("x"))
    out = E.nuisance_contrast(d, "x", "y")
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])


@query("e17_channel_comparison", f"{ANSWERS} SELECT arm AS channel, count(*) AS n, round(avg(ln(length(p))), 6) AS mean_logp, round(avg(contains(p, g)::INT), 9) AS hit FROM rr WHERE length(p) > 0 GROUP BY arm")
def e17(spark, sf):
    p, g = T.norm_alnum(F.col("generated")), T.norm_alnum(F.col("gold"))
    out = E.channel_comparison(answers(spark, sf).select(F.col("arm").alias("channel"), F.ln(F.char_length(p)).alias("logp"), p.contains(g).alias("hit")))
    return out.select("channel", "n", F.round("mean_logp", 6).alias("mean_logp"), F.round("hit", 9).alias("hit"))


@query("e18_real_vs_control")
def e18(spark, sf):
    """A backoff model of the training documents against one whose tokens are shuffled over all positions."""
    from corpuslab.operators import gates as G

    from .ngrams import token_lists

    rows = G.bigram_contrast(token_lists(spark, sf), 5)
    return E.with_p_values(E.weighted_delta(rows.select(F.col("control_logp").alias("a"), F.col("real_logp").alias("b"), "times")), [])


@query("e19_pass_at_k", f"{CORRECT}, s AS (SELECT item_id, max((g <> '' AND contains(p, g))::INT) AS a FROM rr GROUP BY item_id) SELECT count(*) AS problems, round(avg(a), 9) AS pass_at_k FROM s")
def e19(spark, sf):
    rows = correct(spark, sf).join(answers(spark, sf).select("item_id", "arm", T.repetition_rate(T.word_tokens(F.col("generated"))).alias("repetition")), ["item_id", "arm"])
    out = E.pass_at_k(rows.select(F.col("item_id").alias("problem"), F.col("correct").alias("passed"), "repetition"))
    return out.select("problems", F.round("pass_at_k", 9).alias("pass_at_k"))


@query("e20_verdict", f"{PAIRED}, t AS (SELECT task, avg(d) AS delta, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM d GROUP BY task) SELECT task, CASE WHEN t >= 3 THEN 'GAIN' WHEN t <= -3 THEN 'LOSS' WHEN abs(delta) < 1 THEN 'NULL' ELSE 'UNCLEAR' END AS verdict, CASE WHEN t >= 3 THEN 'the head arm is longer' WHEN t <= -3 THEN 'the head arm is shorter' WHEN abs(delta) < 1 THEN 'no difference' ELSE 'within noise' END AS reason FROM t")
def e20(spark, sf):
    rules = [("GAIN", "t >= 3", "the head arm is longer"), ("LOSS", "t <= -3", "the head arm is shorter"), ("NULL", "abs(delta) < 1", "no difference")]
    return E.verdict(E.paired_delta(paired(spark, sf), ["task"]), rules, ("UNCLEAR", "within noise")).select("task", "verdict", "reason")
