"""Queries of gates, routing over seeds, pairs of channels, contrasts of models and rule sets (halves of E2-E20)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import evaluation as E
from corpuslab.operators import gates as G

from .evaluation import ANSWERS, ARMS, CORRECT, RUNS, answers, correct, paired, runs
from .ngrams import EVAL, TRAIN, _tokens, token_lists
from .registry import query
from .text import LABELS

PAIRS = list(combinations(ARMS, 2))
RULES = ["r_substring", "r_window", "r_exact", "r_leading"]
READ = f"{ANSWERS}, rd AS (SELECT arm, contains(p, g) AS r_substring, g <> '' AND contains(' ' || p || ' ', ' ' || g || ' ') AS r_window, p = g AS r_exact, g <> '' AND starts_with(' ' || p || ' ', ' ' || g || ' ') AS r_leading FROM rr)"


def _rounded(df, *names, digits: int = 9):
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


@query("e2_disagreements", READ + " " + " UNION ALL ".join(f"SELECT arm, '{a}' AS rule_a, '{b}' AS rule_b, count(*) FILTER ({a} AND NOT {b}) AS only_a, count(*) FILTER ({b} AND NOT {a}) AS only_b, count(*) FILTER ({a} = {b}) AS agree FROM rd GROUP BY arm" for a, b in combinations(RULES, 2)))
def e2_disagreements(spark, sf):
    return G.rule_disagreements(E.reading_rules(answers(spark, sf)), "arm", RULES)


MARKED = """CASE item_id % 5 WHEN 0 THEN 'assistant' || chr(10) || generated WHEN 1 THEN '<think>' || generated WHEN 2 THEN '  ' WHEN 3 THEN 'Yes, ' || generated ELSE generated END"""


@query("e5_marked_answers", f"{ANSWERS}, mk AS (SELECT arm, {MARKED} AS s FROM an), lb AS (SELECT arm, s, {LABELS} AS label FROM mk) SELECT arm, count(*) AS n, round(avg((trim(s) = '')::INT), 9) AS empty, round(avg((label = 'chat_scaffold')::INT), 9) AS scaffold, round(avg(starts_with(lower(trim(s)), 'yes')::INT), 9) AS yes, round(count(DISTINCT s) / count(*), 9) AS distinct_rate FROM lb GROUP BY arm")
def e5_marked(spark, sf):
    """Answers of which a fifth each holds a role line, a thinking mark, nothing, a yes in front."""
    text, kind = F.col("generated"), F.col("item_id") % 5
    marked = F.when(kind == 0, F.concat(F.lit("assistant\n"), text)).when(kind == 1, F.concat(F.lit("<think>"), text)).when(kind == 2, "  ").when(kind == 3, F.concat(F.lit("Yes, "), text)).otherwise(text)
    return E.format_fingerprint(answers(spark, sf).withColumn("generated", marked))


@query("e6_gaps", f"""{ANSWERS}, x AS (SELECT task, item_id, question FROM an WHERE arm = 'full' AND length(question) >= 40), y AS (SELECT task, item_id, CASE WHEN item_id % 7 = 0 THEN question || '!' ELSE question END AS question FROM an WHERE arm = 'head' AND item_id % 5 <> 0)
SELECT count(*) FILTER (y.item_id IS NULL) AS only_a, count(*) FILTER (x.item_id IS NULL) AS only_b, count(*) FILTER (x.question <> y.question) AS mismatched, count(*) AS items FROM x FULL JOIN y ON x.task = y.task AND x.item_id = y.item_id""")
def e6_gaps(spark, sf):
    """Arms that lack items of each other, and questions that differ."""
    rows = answers(spark, sf)
    a = rows.where("arm = 'full'").where(F.char_length("question") >= 40)
    b = rows.where("arm = 'head' and item_id % 5 <> 0").withColumn("question", F.when(F.col("item_id") % 7 == 0, F.concat("question", F.lit("!"))).otherwise(F.col("question")))
    return E.alignment_report(a, b, ["task", "item_id"], "question")


@query("e8_correlation", f"{ANSWERS}, w AS (SELECT task, item_id, max(length(p)) FILTER (arm = 'echo') AS a, max(length(p)) FILTER (arm = 'head') AS b FROM rr GROUP BY ALL) SELECT task, count(*) AS n, round(corr(a, b), 9) AS r FROM w GROUP BY task")
def e8_correlation(spark, sf):
    return _rounded(G.correlation(paired(spark, sf), ["task"]), "r")


@query("e10_joint_variation", f"""{ANSWERS}, l AS (SELECT arm, least(length(p) // 50, 20)::VARCHAR AS bucket, split_part(p, ' ', 1) AS prefix FROM rr),
k AS (SELECT arm, 'bucket' AS kind, bucket AS label FROM l UNION ALL SELECT arm, 'prefix', prefix FROM l UNION ALL SELECT arm, 'joint', bucket || chr(1) || prefix FROM l),
s AS (SELECT arm, kind, label, count(*) / sum(count(*)) OVER (PARTITION BY arm, kind) AS s FROM k GROUP BY arm, kind, label), u AS (SELECT DISTINCT kind, label FROM k)
""" + " UNION ALL ".join(f"SELECT '{a}' AS arm_a, '{b}' AS arm_b, kind, round(0.5 * sum(abs(coalesce(x.s, 0) - coalesce(y.s, 0))), 9) AS tv FROM u LEFT JOIN (SELECT * FROM s WHERE arm = '{a}') x USING (kind, label) LEFT JOIN (SELECT * FROM s WHERE arm = '{b}') y USING (kind, label) GROUP BY kind" for a, b in PAIRS))
def e10_joint(spark, sf):
    p = T.norm_alnum(F.col("generated"))
    rows = answers(spark, sf).select("arm", F.least(F.floor(F.char_length(p) / 50), F.lit(20)).alias("bucket"), F.split_part(p, F.lit(" "), F.lit(1)).alias("prefix"))
    return _rounded(G.joint_variation(rows, "arm", ["bucket", "prefix"], PAIRS), "tv")


@query("e13_phase_gate", f"""{RUNS}, p AS (SELECT corpus, seed, exp(max(loss) FILTER (arm = 'head')) AS r, exp(max(loss) FILTER (arm = 'echo')) AS c, exp(max(loss) FILTER (arm = 'full')) AS b FROM r GROUP BY ALL),
m AS (SELECT corpus, avg(r) AS r, avg(c) AS c, avg(b) AS b FROM p GROUP BY corpus), x AS (SELECT count(*) AS corpora, count(*) FILTER (r < c) AS corpora_below_control, count(*) FILTER (r < b) AS corpora_below_bare FROM m),
y AS (SELECT count(*) AS runs, count(*) FILTER (r < c) AS runs_below_control, count(*) FILTER (r < b) AS runs_below_bare FROM p WHERE r IS NOT NULL)
SELECT *, corpora > 0 AND corpora_below_control >= greatest(1, ceil(corpora * 5 / 6)) AND corpora_below_bare = corpora AND runs_below_control >= greatest(1, ceil(runs * 2 / 3)) AND runs_below_bare = runs AS passed FROM x CROSS JOIN y""")
def e13_phase(spark, sf):
    return G.loss_phase_gate(runs(spark, sf), "head", "echo", "full")


GATED = f"""{CORRECT}, v AS (SELECT item_id % 6 AS corpus, task, avg("full") AS "real", avg(head) AS control, avg(echo) AS bare FROM w GROUP BY ALL),
gt AS (SELECT corpus, task, "real", control, bare, "real" > bare AND "real" >= control AS candidate, "real" < greatest(control, bare) - 0.05 AS severe FROM v)"""


def gated(spark, sf):
    values = correct(spark, sf).groupBy((F.col("item_id") % 6).alias("corpus"), "task", "arm").agg(F.avg(F.col("correct").cast("int")).alias("value"))
    return G.task_gate(values, "full", "head", "echo")


@query("e13_task_gate", f'{GATED} SELECT corpus, task, round("real", 9) AS "real", round(control, 9) AS control, round(bare, 9) AS bare, candidate, severe FROM gt')
def e13_tasks(spark, sf):
    return _rounded(gated(spark, sf), "real", "control", "bare")


@query("e13_task_gate_passed", f"{GATED} SELECT count(*) AS tasks, count(*) FILTER (candidate) AS candidates, count(*) FILTER (severe) AS severe, count(*) FILTER (candidate) > 0 AND count(*) FILTER (severe) = 0 AS passed FROM gt")
def e13_passed(spark, sf):
    return G.task_gate_summary(gated(spark, sf))


SETS = {"oracle_full_echo": ["full", "echo"], "oracle_full_head": ["full", "head"], "oracle_all": list(ARMS)}
_ACC = {f"always_{a}": f'"{a}"' for a in ARMS} | {name: "greatest(" + ", ".join(f'"{a}"' for a in own) + ")" for name, own in SETS.items()}


@query("e14_routing_seeds", f"{CORRECT}, ws AS (SELECT *, item_id % 3 AS seed FROM w), pp AS (" + " UNION ALL ".join(f"SELECT seed, task, '{name}' AS policy, {value} AS ok FROM ws" for name, value in _ACC.items()) + """),
ps AS (SELECT seed, task, policy, avg(ok) AS acc FROM pp GROUP BY ALL UNION ALL SELECT seed, NULL, policy, avg(ok) FROM pp GROUP BY seed, policy)
SELECT task, policy, count(*) AS seeds, round(avg(acc), 9) AS mean, round(stddev_pop(acc), 9) AS deviation FROM ps GROUP BY task, policy""")
def e14_seeds(spark, sf):
    rows = correct(spark, sf).withColumn("seed", F.col("item_id") % 3)
    return _rounded(G.routing_over_seeds(rows, list(ARMS), SETS), "mean", "deviation")


@query("e14_unique_table", f"""{CORRECT} SELECT task, count(*) AS items, count(*) FILTER ("full" = 1 AND echo = 1) AS "both", count(*) FILTER ("full" = 1 AND echo = 0) AS real_only, count(*) FILTER ("full" = 0 AND echo = 1) AS bare_only,
count(*) FILTER ("full" + echo = 0 AND head = 1) AS control_only, count(*) FILTER ("full" + echo + head = 0) AS "none" FROM w GROUP BY ROLLUP (task)""")
def e14_unique(spark, sf):
    return G.unique_table(correct(spark, sf), "full", "head", "echo")


@query("e17_channel_deltas", f"{ANSWERS}, f AS (SELECT arm, avg(CASE WHEN length(p) > 0 THEN ln(length(p)) END) AS l, avg(contains(p, g)::INT) AS h FROM rr GROUP BY arm) SELECT x.arm AS channel_a, y.arm AS channel_b, round(y.l - x.l, 6) AS logp_delta, round(y.h - x.h, 9) AS hit_delta FROM f x JOIN f y ON (x.arm, y.arm) IN (" + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ")")
def e17_deltas(spark, sf):
    p, g = T.norm_alnum(F.col("generated")), T.norm_alnum(F.col("gold"))
    rows = answers(spark, sf).select(F.col("arm").alias("channel"), F.ln(F.char_length(p)).alias("logp"), p.contains(g).alias("hit"))
    return _rounded(_rounded(G.channel_deltas(rows, PAIRS), "logp_delta", digits=6), "hit_delta")


def _bigram_sql(name: str, source: str) -> str:
    """CTEs of one bigram model over ``source`` and the held-out tokens' scores under it, as ``<name>s``."""
    return f"""{name}1 AS (SELECT token, count(*) AS n1 FROM {source} GROUP BY token), {name}2 AS (SELECT c2, token, count(*) AS n2 FROM {source} WHERE c2 IS NOT NULL GROUP BY ALL),
{name}z AS (SELECT c2, sum(n2) AS z2, arg_min(token, (-n2, token)) AS best2 FROM {name}2 GROUP BY c2), {name}w AS (SELECT sum(n1) AS z1, arg_min(token, (-n1, token)) AS best1 FROM {name}1),
{name}s AS (SELECT e.doc_id, e.pos, e.token, ln(coalesce(CASE WHEN z2 IS NOT NULL THEN n2 / z2 ELSE n1 / z1 END, n1 / z1, 1e-12)) AS logp, e.token = coalesce(best2, best1) AS top, z2 IS NOT NULL AS known
 FROM eb e LEFT JOIN {name}z USING (c2) LEFT JOIN {name}2 ON {name}2.c2 = e.c2 AND {name}2.token = e.token LEFT JOIN {name}1 ON {name}1.token = e.token CROSS JOIN {name}w)"""


_LAG = "SELECT *, lag(token) OVER (PARTITION BY doc_id ORDER BY pos) AS c2 FROM ({})"
CONTRAST = f"""WITH tb AS ({_LAG.format(_tokens(TRAIN))}), eb AS ({_LAG.format(_tokens(EVAL))}),
ra AS (SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) AS k FROM tb), rb AS (SELECT token, row_number() OVER (ORDER BY md5('5|' || doc_id || '|' || pos), doc_id, pos) AS k FROM tb),
sb AS ({_LAG.format('SELECT doc_id, pos, token FROM ra JOIN rb USING (k)')}), {_bigram_sql('re', 'tb')}, {_bigram_sql('co', 'sb')},
pr AS (SELECT r.token, r.logp AS lr, c.logp AS lc, r.top AS tr, c.top AS tc, r.known AS kr, c.known AS kc FROM res r JOIN cos c USING (doc_id, pos)),
ct AS (SELECT 'all' AS category, * FROM pr UNION ALL SELECT CASE WHEN regexp_matches(token, '[0-9]') THEN 'number' ELSE 'other' END, * FROM pr), dd AS (SELECT *, lr - lc AS d FROM ct)
SELECT category, count(*) AS n, round(avg(d), 6) AS delta, round(stddev_samp(d), 6) AS deviation, round(exp(-avg(lr)), 4) AS real_ppl, round(exp(-avg(lc)), 4) AS control_ppl, round(avg(tr::INT), 9) AS real_top1, round(avg(tc::INT), 9) AS control_top1,
round(avg(kr::INT), 9) AS real_known, round(avg(kc::INT), 9) AS control_known, round(median(d), 6) AS median, round(avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0), 5) AS t FROM dd GROUP BY category"""


@query("e18_model_contrast", CONTRAST)
def e18_contrast(spark, sf):
    """Bigrams of the training documents against bigrams of the same tokens dealt anew over all positions."""
    met = G.bigram_contrast(token_lists(spark, sf), 5)
    kinds = F.array(F.lit("all"), F.when(F.col("token").rlike("[0-9]"), "number").otherwise("other"))
    out = G.model_contrast(met.withColumn("category", F.explode(kinds)))
    digits = {"delta": 6, "median": 6, "deviation": 6, "t": 5, "real_ppl": 4, "control_ppl": 4}
    return out.select(*[c if c in ("category", "n") else F.round(c, digits.get(c, 9)).alias(c) for c in out.columns])


@query("e19_repetition", f"""{ANSWERS}, t AS (SELECT arm, item_id, regexp_extract_all(lower(generated), '[a-z0-9'']+') AS t FROM an), s AS (SELECT arm, item_id, CASE WHEN len(t) < 3 THEN 0 ELSE 1 - len(list_distinct(list_transform(generate_series(1, len(t) - 2), lambda i: t[i:i+2]))) / (len(t) - 2) END AS rep FROM t),
c AS (SELECT arm, item_id, (g <> '' AND contains(p, g))::INT AS ok FROM rr), m AS (SELECT item_id, max(ok) AS a, avg(rep) AS rep FROM s JOIN c USING (arm, item_id) GROUP BY item_id) SELECT count(*) AS problems, round(avg(a), 9) AS pass_at_k, round(avg(rep), 9) AS repetition FROM m""")
def e19_repetition(spark, sf):
    p, g = T.norm_alnum(F.col("generated")), T.norm_alnum(F.col("gold"))
    rows = answers(spark, sf).select(F.col("item_id").alias("problem"), ((g != "") & p.contains(g)).alias("passed"), T.repetition_rate(T.word_tokens(F.col("generated"))).alias("repetition"))
    return _rounded(E.pass_at_k(rows), "pass_at_k", "repetition")


# Rule sets: figures of the arms stand for those of probes, gates and layers.

PANELS = f"""{CORRECT}, pn AS (SELECT item_id % 8 AS panel, avg(head) AS linear, nullif(avg("full"), 0) AS counted, avg(echo) AS shuffled, 0.25 * avg("full") AS majority, CASE WHEN item_id % 8 < 6 THEN avg(greatest(head, echo)) END AS mlp, avg(echo) AS mlp_shuffled FROM w GROUP BY item_id % 8),
jd AS (SELECT panel, CASE WHEN counted IS NULL THEN 'INCOMPLETE' WHEN linear <= greatest(shuffled, majority) + 0.005 AND mlp <= greatest(mlp_shuffled, majority) + 0.005 THEN 'ROWS_DEAD' WHEN linear / counted >= 0.5 THEN 'ROWS_CARRY_THE_TRIGRAM' WHEN linear / counted >= 0.2 THEN 'ROWS_DEGRADED' ELSE 'ROWS_NEARLY_DEAD' END AS verdict, linear / counted AS recovery FROM pn)"""


def panels(spark, sf):
    wide = G.side_by_side(correct(spark, sf), ["item_id"], list(ARMS)).withColumn("panel", F.col("item_id") % 8)
    full = F.avg("full")
    figures = wide.groupBy("panel").agg(F.avg("head").alias("linear"), F.when(full > 0, full).alias("counted"), F.avg("echo").alias("shuffled"), (0.25 * full).alias("majority"), F.avg(F.greatest("head", "echo")).alias("mlp"), F.avg("echo").alias("mlp_shuffled"))
    return G.row_recovery(figures.withColumn("mlp", F.when(F.col("panel") < 6, F.col("mlp"))))


@query("e20_row_recovery", f"{PANELS} SELECT panel, verdict, round(recovery, 9) AS recovery FROM jd")
def e20_recovery(spark, sf):
    return _rounded(panels(spark, sf).select("panel", "verdict", "recovery"), "recovery")


@query("e20_most_conservative", f"{PANELS} SELECT count(*) AS panels, count(DISTINCT verdict) <= 1 AS agreement, CASE WHEN count(*) = 0 OR count(*) FILTER (verdict = 'INCOMPLETE') > 0 THEN 'INCOMPLETE' ELSE arg_min(verdict, CASE verdict WHEN 'ROWS_DEAD' THEN 0 WHEN 'ROWS_NEARLY_DEAD' THEN 1 WHEN 'ROWS_DEGRADED' THEN 2 ELSE 3 END) END AS verdict FROM jd")
def e20_conservative(spark, sf):
    return G.most_conservative(panels(spark, sf))


@query("e20_gate_selectivity", f"""{CORRECT}, gs AS (SELECT item_id % 7 AS run, avg("full") AS os, avg(head) AS op, avg(echo) AS rs, avg(greatest(echo, head)) AS rp, avg(echo * head) AS cp, count(*) AS injected FROM w GROUP BY item_id % 7)
SELECT run, CASE WHEN injected <= 0 THEN 'UNDERPOWERED' WHEN os < 0.5 THEN 'DISEASE_NOT_REPRODUCED' WHEN op >= 0.9 THEN 'GATE_STILL_SATURATED' WHEN op <= os - 0.2 AND rp - rs >= 0.02 AND rp - cp >= 0.02 THEN 'GATE_SELECTIVITY_HELPS' WHEN op <= os - 0.2 AND abs(rp - rs) < 0.02 THEN 'GATE_SELECTIVITY_NO_EFFECT' ELSE 'PARTIAL' END AS verdict FROM gs""")
def e20_gate(spark, sf):
    wide = G.side_by_side(correct(spark, sf), ["item_id"], list(ARMS)).groupBy((F.col("item_id") % 7).alias("run"))
    figures = wide.agg(F.avg("full").alias("open_scalar"), F.avg("head").alias("open_per_dim"), F.avg("echo").alias("real_scalar"), F.avg(F.greatest("echo", "head")).alias("real_per_dim"), F.avg(F.col("echo") * F.col("head")).alias("control_per_dim"), F.count("*").alias("injected"), F.lit(0).alias("missing"))
    return G.judged(figures, G.GATE_SELECTIVITY).select("run", "verdict")


@query("e20_depth_shift", f"""{ANSWERS}, m AS (SELECT item_id % 9 AS report, arm, avg(length(p)) AS chars, avg(len(string_split(p, ' '))) AS words, avg(len(list_distinct(string_split(p, '')))) AS letters FROM rr GROUP BY ALL),
k AS (SELECT report, arm, unnest(['chars', 'words', 'letters']) AS instrument, floor(unnest([chars / 10, words, letters]))::INT AS v FROM m), g AS (SELECT report, instrument, max(v) FILTER (arm = 'full') - max(v) FILTER (arm = 'head') AS r, max(v) FILTER (arm = 'full') - max(v) FILTER (arm = 'echo') AS s FROM k GROUP BY ALL),
c AS (SELECT report, count(*) FILTER (r >= 2 AND s < r) AS freed, count(*) FILTER (r >= 2) AS shifted, count(*) FILTER (r >= 2 AND s >= r) AS matched, count(*) FILTER (abs(r) < 2) AS still FROM g GROUP BY report)
SELECT report, freed, shifted, matched, still, CASE WHEN freed >= 2 THEN 'DEPTH_FREED' WHEN shifted > 0 AND matched = shifted THEN 'PERTURBATION_ONLY' WHEN still = 3 THEN 'DEPTH_NULL' ELSE 'MIXED' END AS verdict FROM c""")
def e20_depth(spark, sf):
    p = T.norm_alnum(F.col("generated"))
    long = answers(spark, sf).groupBy((F.col("item_id") % 9).alias("report"), "arm").agg((F.avg(F.char_length(p)) / 10).alias("chars"), F.avg(F.size(F.split(p, " "))).alias("words"), F.avg(F.size(F.array_distinct(F.split(p, "")))).alias("letters"))
    rows = long.select("report", "arm", F.expr("stack(3, 'chars', chars, 'words', words, 'letters', letters) as (instrument, v)")).withColumn("v", F.floor("v"))
    wide = rows.groupBy("report", "instrument").pivot("arm", list(ARMS)).agg(F.first("v"))
    out = G.depth_shift(wide.select("report", F.lit(1.0).alias("tv"), "instrument", F.col("full").alias("off"), F.col("head").alias("real"), F.col("echo").alias("shuf")), ["report"])
    return out.select("report", "freed", "shifted", "matched", "still", "verdict")


@query("e20_tail_hits", f"""{CORRECT}, s AS (SELECT item_id, max(length(question)) >= 40 AS tail FROM an GROUP BY item_id), h AS (SELECT task, tail, w.* EXCLUDE (task) FROM w JOIN s USING (item_id)),
x AS (SELECT task, arm, count(*) AS n_total, count(*) FILTER (tail) AS n_tail, avg(echo) FILTER (tail) AS base_hit, avg(v) FILTER (tail) AS arm_hit, avg(v - echo) FILTER (tail) AS delta, stddev_samp(v - echo) FILTER (tail) AS sd FROM (SELECT task, tail, echo, unnest(['full', 'head']) AS arm, unnest(["full", head]) AS v FROM h) GROUP BY task, arm),
y AS (SELECT *, CASE WHEN sd > 0 THEN delta / (sd / sqrt(n_tail)) END AS t FROM x) SELECT task, arm, n_total, n_tail, round(base_hit, 9) AS base_hit, round(arm_hit, 9) AS arm_hit, round(delta, 9) AS delta, round(t, 6) AS t, CASE WHEN delta > 0 AND t >= 3 THEN 'GAIN' ELSE 'FLAT' END AS verdict FROM y""")
def e20_tail(spark, sf):
    wide = G.side_by_side(correct(spark, sf), ["task", "item_id"], list(ARMS))
    sizes = answers(spark, sf).groupBy("item_id").agg(F.max(F.char_length("question")).cast("double").alias("surprisal"))
    out = G.tail_hits(wide.join(sizes, "item_id"), 40, "echo", ["full", "head"], ["task"])
    return _rounded(_rounded(out.drop("reason"), "base_hit", "arm_hit", "delta"), "t", digits=6)


@query("e20_reshaping", f"""{CORRECT}, d AS (SELECT item_id % 10 AS run, avg(head - echo) AS delta, avg(head - echo) / nullif(stddev_samp(head - echo) / sqrt(count(*)), 0) AS t, avg("full" - 1) + 0.9 AS sh FROM w GROUP BY item_id % 10)
SELECT run, CASE WHEN delta <= -0.05 AND (t IS NULL OR abs(t) > 3) THEN 'ROWS_HARMED' WHEN delta >= 0.05 AND (t IS NULL OR abs(t) > 3) AND sh > 0.01 THEN 'ROWS_RESHAPEABLE_BUT_NULL_MOVED' WHEN delta >= 0.05 AND (t IS NULL OR abs(t) > 3) THEN 'ROWS_RESHAPEABLE' ELSE 'ROWS_STUCK' END AS verdict FROM d""")
def e20_reshaping(spark, sf):
    wide = G.side_by_side(correct(spark, sf), ["item_id"], list(ARMS)).withColumn("run", F.col("item_id") % 10)
    own = E.paired_delta(wide.select("run", F.col("echo").alias("a"), F.col("head").alias("b")), ["run"])
    moved = wide.groupBy("run").agg((F.avg(F.col("full") - 1) + 0.9).alias("shuffled_delta"))
    return G.judged(own.join(moved, "run"), G.RESHAPING).select("run", "verdict")
