"""Queries C1-C22: budgets, selections, splits and decontamination over documents, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions.scale import hash_mod
from corpuslab.functions.storage import read, written
from corpuslab.operators import corpus as C

from .registry import query
from .text import ALNUM, TOKENS

#: Content hash of a text modulo 1000, and the tenth of the documents that is held against the rest.
HASH16 = "(('0x' || substring(sha1(text), 1, 16))::UBIGINT % 1000)"
HELD, REST = f"{HASH16} < 100", f"{HASH16} >= 100"
RATIOS = {"en": 50, "fr": 20, "de": 20, "es": 10}
TARGET, SEED = 120_000, 7
SIZED = f"SELECT *, len({TOKENS}) AS n_tokens FROM documents"
BUDGETS = f"(VALUES {', '.join(f'({k!r}, {int(TARGET * r / sum(RATIOS.values()))})' for k, r in RATIOS.items())}) AS b(lang, budget)"
QA = "(SELECT row_number() OVER (ORDER BY conv_id, turn) AS item_id, conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, text AS question, lead(text) OVER w AS answer, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant')"


def held():
    return (hash_mod(F.col("text"), 1000) < 100).alias("held")


def sized(spark, sf):
    return read(spark, sf, "documents").withColumn("n_tokens", F.size(T.word_tokens(F.col("text"))))


def tokenised(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "lang", "source", T.word_tokens(F.col("text")).alias("tokens"), held())


def budgets(spark, sf):
    return C.mix_budgets(sized(spark, sf), RATIOS, TARGET)


def items(spark, sf):
    """Benchmark items as questions, with their first six words as answer."""
    rows = read(spark, sf, "benchmark")
    return rows.select("item_id", F.col("text").alias("question"), F.array_join(F.slice(F.split(T.norm_alnum(F.col("text")), " "), 1, 6), " ").alias("answer"))


ITEMS = f"(SELECT item_id, text AS question, array_to_string(string_split({ALNUM}, ' ')[1:6], ' ') AS answer FROM benchmark)"


@query("c1_mix_budgets", f"WITH s AS (SELECT lang, sum(n_tokens + 1) AS supply FROM ({SIZED}) GROUP BY lang) SELECT b.lang, b.budget::BIGINT AS budget, coalesce(supply, 0)::BIGINT AS supply, greatest(b.budget - coalesce(supply, 0), 0)::BIGINT AS shortfall FROM {BUDGETS} LEFT JOIN s USING (lang)")
def c1(spark, sf):
    return budgets(spark, sf)


SELECTED = f"SELECT doc_id, lang, n_tokens FROM (SELECT d.*, b.budget, coalesce(sum(n_tokens + 1) OVER (PARTITION BY lang ORDER BY md5('{SEED}|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({SIZED}) d JOIN {BUDGETS} USING (lang)) WHERE before < budget"


@query("c2_select_for_budget", SELECTED)
def c2(spark, sf):
    return C.select_for_budget(sized(spark, sf).select("doc_id", "lang", "n_tokens"), budgets(spark, sf), SEED).select("doc_id", "lang", "n_tokens")


NEEDLES = f"""SELECT DISTINCT needle FROM (SELECT a AS needle, 2 AS least FROM n UNION ALL SELECT q, 6 FROM n UNION ALL SELECT trim(q || ' ' || a), 4 FROM n) WHERE len(string_split(needle, ' ')) >= least"""


@query("c3_filter_contaminated", f"WITH n AS (SELECT {ALNUM.replace('text', 'answer')} AS a, {ALNUM.replace('text', 'question')} AS q FROM {ITEMS}), needles AS ({NEEDLES}) SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM needles WHERE contains({ALNUM}, needle))")
def c3(spark, sf):
    return C.filter_contaminated(read(spark, sf, "documents").select("doc_id", "text"), C.needles(items(spark, sf))).select("doc_id")


@query("c4_heldout", f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({SELECTED}))")
def c4(spark, sf):
    return C.heldout(read(spark, sf, "documents"), c2(spark, sf)).select("doc_id")


def grams_sql(n: int, where: str) -> str:
    return f"SELECT doc_id, array_to_string(t[i:i+{n - 1}], ' ') AS w FROM (SELECT doc_id, t, unnest(generate_series(1, len(t) - {n - 1})) AS i FROM (SELECT doc_id, {TOKENS} AS t FROM documents WHERE {where}))"


def _overlap_sql(n: int) -> str:
    return f"SELECT {n} AS n, count(*) FILTER (hit) AS excluded, coalesce(sum(k) FILTER (hit), 0)::BIGINT AS excluded_tokens, count(*) FILTER (k < {n}) AS untestable FROM (SELECT doc_id, len({TOKENS}) AS k, doc_id IN (SELECT doc_id FROM ({grams_sql(n, HELD)}) WHERE w IN (SELECT w FROM ({grams_sql(n, REST)}))) AS hit FROM documents WHERE {HELD})"


@query("c5_token_overlap", " UNION ALL ".join(_overlap_sql(n) for n in (8, 16)))
def c5(spark, sf):
    docs = tokenised(spark, sf)
    return C.token_overlap_report(docs.where("held"), docs.where("not held"), [8, 16])


@query("c6_char_overlap", f"WITH g AS (SELECT doc_id, {HELD} AS held, substring(text, i, 40) AS w FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 39)) AS i FROM documents)) SELECT doc_id, CASE WHEN length(text) >= 40 THEN doc_id IN (SELECT doc_id FROM g WHERE held AND w IN (SELECT w FROM g WHERE NOT held)) END AS overlaps FROM documents WHERE {HELD}")
def c6(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text", held())
    return C.char_overlap(docs.where("held"), docs.where("not held"), 40)


@query("c7_verify_disjoint", " UNION ALL ".join(f"SELECT {n} AS n, count(*) AS tested, count(*) FILTER (h IN (SELECT w FROM ({grams_sql(n, REST)}))) AS found FROM (SELECT array_to_string(({TOKENS})[1:{n}], ' ') AS h FROM documents WHERE {HELD} AND len({TOKENS}) >= {n})" for n in (8, 16)))
def c7(spark, sf):
    docs = tokenised(spark, sf)
    return C.verify_disjoint(docs.where("held"), docs.where("not held"), [8, 16])


STRICT = "list_filter(string_split(" + ALNUM + ", ' '), lambda w: w <> '' AND w NOT IN ('a','an','the','of','in','on','at','to','for','and','or'))"


def _grams(words: str) -> str:
    return f"list_distinct(CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) < 8 THEN [array_to_string({words}, ' ')] ELSE list_transform(generate_series(1, len({words}) - 7), lambda i: array_to_string({words}[i:i+7], ' ')) END)"


AUDIT = f"""WITH f AS (SELECT item_id, {STRICT.replace('text', 'question')} AS q, {STRICT.replace('text', 'answer')} AS a FROM {ITEMS}),
l AS (SELECT item_id, 'q' AS field, q AS w FROM f UNION ALL SELECT item_id, 'a', a FROM f UNION ALL SELECT item_id, 'qa', list_concat(q, a) FROM f),
d AS (SELECT {STRICT} AS w FROM documents), g AS (SELECT DISTINCT unnest({_grams('w')}) AS gram FROM d),
r AS (SELECT item_id, field, count(*) FILTER (gram IN (SELECT gram FROM g)) / count(*) AS ratio FROM (SELECT item_id, field, unnest({_grams('w')}) AS gram FROM l) GROUP BY ALL),
e AS (SELECT item_id, field, len(w) > 0 AND EXISTS (SELECT 1 FROM d WHERE contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(l.w, ' ') || ' ')) AS exact FROM l),
p AS (SELECT f.item_id, max(CASE WHEN e.field='a' THEN exact END) AS ae, max(CASE WHEN e.field='q' THEN exact END) AS qe, max(CASE WHEN e.field='qa' THEN exact END) AS qae, coalesce(max(CASE WHEN e.field='q' THEN ratio END), 0) AS qr, coalesce(max(CASE WHEN e.field='qa' THEN ratio END), 0) AS qar FROM f JOIN e USING (item_id) LEFT JOIN r ON r.item_id = e.item_id AND r.field = e.field GROUP BY f.item_id)
SELECT item_id, ae AS answer_exact, qe AS question_exact, qae AS both_exact, round(qr, 9) AS question_overlap, round(qar, 9) AS both_overlap, CASE WHEN qae THEN 'critical' WHEN qe OR qar >= 0.8 THEN 'high' WHEN ae OR qr >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM p"""


@query("c8_audit_contamination", AUDIT)
def c8(spark, sf):
    return C.audit_contamination(items(spark, sf), read(spark, sf, "documents"))


TASK_OF = "CASE WHEN item_id % 3 = 0 THEN 'recall' WHEN item_id % 3 = 1 THEN 'reading' END"


@query("c8_by_task", f"SELECT task, count(*) AS items, count(*) FILTER (answer_exact) AS answer_exact, count(*) FILTER (question_exact) AS question_exact, count(*) FILTER (both_exact) AS both_exact, round(avg(question_overlap), 9) AS question_overlap, round(avg(both_overlap), 9) AS both_overlap, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low")) + f" FROM (SELECT *, coalesce({TASK_OF}, 'unknown') AS task FROM ({AUDIT})) GROUP BY ROLLUP (task)")
def c8_tasks(spark, sf):
    """The audit per task; a third of the items has none."""
    asked = items(spark, sf)
    out = C.audit_by_task(c8(spark, sf), asked.select("item_id", F.expr(TASK_OF).alias("task")))
    return out.withColumn("question_overlap", F.round("question_overlap", 9)).withColumn("both_overlap", F.round("both_overlap", 9))


ANSWER_TOKENS = "regexp_extract_all(lower(answer), '[a-z0-9'']+')"
CONTAMINATED = f"SELECT item_id, CASE WHEN len({ANSWER_TOKENS}) >= 2 THEN EXISTS (SELECT 1 FROM documents WHERE contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' ' || array_to_string({ANSWER_TOKENS}, ' ') || ' ')) END AS contaminated FROM {ITEMS} i"


@query("c9_eval_contamination", CONTAMINATED)
def c9(spark, sf):
    return C.eval_contamination(items(spark, sf), read(spark, sf, "documents"))


@query("c9_findings", f"WITH k AS (SELECT doc_id, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS hay FROM documents) SELECT item_id, count(*) AS docs, min(doc_id) AS first_doc FROM (SELECT item_id, {ANSWER_TOKENS} AS a FROM {ITEMS} i) JOIN k ON contains(hay, ' ' || array_to_string(a, ' ') || ' ') WHERE len(a) >= 2 GROUP BY item_id")
def c9_findings(spark, sf):
    return C.contamination_findings(items(spark, sf), read(spark, sf, "documents"))


@query("c10_correct_by_memorised", f"SELECT contaminated AS memorised, count(*) AS n, count(*) FILTER (item_id % 3 = 0) AS n_correct FROM ({CONTAMINATED}) GROUP BY contaminated")
def c10(spark, sf):
    flags = c9(spark, sf).withColumn("correct", F.col("item_id") % 3 == 0)
    return flags.groupBy(F.col("contaminated").alias("memorised")).agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))


@query("c11_hash_split", f"SELECT doc_id, CASE WHEN {HASH16} < 100 THEN 'eval' ELSE 'train' END AS split FROM documents")
def c11(spark, sf):
    return C.hash_split(read(spark, sf, "documents"), F.col("text"), 0.1).select("doc_id", "split")


@query("c12_qa_split", f"SELECT conv_id, turn, CASE WHEN ('0x' || substring(sha1('7|' || question || '|' || answer), 1, 16))::UBIGINT % 1000 < 200 THEN 'eval' ELSE 'train' END AS split FROM {QA}")
def c12(spark, sf):
    pairs = C.qa_pairs(read(spark, sf, "conversations"))
    return C.hash_split(pairs, F.concat_ws("|", F.lit("7"), "question", "answer"), 0.2).select("conv_id", "turn", "split")


@query("c13_leakage_matrix", f"""WITH k AS (SELECT ' ' || array_to_string({TOKENS}, ' ') || ' ' AS hay, CASE WHEN {HASH16} < 300 THEN 'eval' ELSE 'train' END AS split FROM documents),
i AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'eval' ELSE 'train' END AS qa_split, {ANSWER_TOKENS} AS a FROM {ITEMS})
SELECT qa_split, count(*) FILTER (EXISTS (SELECT 1 FROM k WHERE split = 'train' AND contains(hay, ' ' || array_to_string(a, ' ') || ' '))) AS train, count(*) FILTER (EXISTS (SELECT 1 FROM k WHERE split = 'eval' AND contains(hay, ' ' || array_to_string(a, ' ') || ' '))) AS eval FROM i GROUP BY qa_split""")
def c13(spark, sf):
    asked = items(spark, sf).withColumn("split", F.when(F.col("item_id") % 2 == 0, "eval").otherwise("train"))
    return C.leakage_matrix(asked, C.hash_split(read(spark, sf, "documents"), F.col("text"), 0.3))


COLLECTED = f"""WITH n AS (SELECT doc_id AS item_id, lang AS task, {ALNUM} AS k, {ALNUM.replace('text', "string_split(text, 'Question:')[-1]")} AS t FROM documents), b AS (SELECT {ALNUM} AS k FROM benchmark),
m AS (SELECT *, min(item_id) OVER (PARTITION BY k) AS first FROM n), s AS (SELECT *, CASE WHEN k = '' THEN 'empty' WHEN k IN (SELECT k FROM b WHERE k <> '') OR t IN (SELECT k FROM b WHERE k <> '') THEN 'excluded' WHEN item_id <> first THEN 'duplicate' ELSE 'kept' END AS st FROM m)
SELECT task, status, count(*) AS n FROM (SELECT task, CASE WHEN st = 'kept' AND row_number() OVER (PARTITION BY task, st ORDER BY item_id) > 100 THEN 'over' ELSE st END AS status FROM s) GROUP BY ALL"""


@query("c14_collect_split_whole", COLLECTED)
@query("c14_collect_split", COLLECTED)
def c14(spark, sf):
    """Whole texts as questions, those of ``benchmark`` known."""
    asked = read(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("task"), F.col("text").alias("question"))
    known = read(spark, sf, "benchmark").select(F.col("text").alias("question"))
    return C.collect_split(asked, known, 100).groupBy("task", "status").agg(F.count("*").alias("n"))


CONTENT = "list_filter({}, lambda w: length(w) >= 4 AND w NOT IN ('a','an','the','of','in','on','at','to','for','and','or'))"


@query("c15_rare_items", f"""WITH c AS (SELECT word, count(*) AS n FROM (SELECT unnest({CONTENT.format(TOKENS)}) AS word FROM documents) GROUP BY word),
w AS (SELECT item_id, unnest(list_distinct({CONTENT.format(ANSWER_TOKENS)})) AS word FROM {ITEMS})
SELECT item_id, min(coalesce(n, 0)) AS min_count, round(avg(coalesce(n, 0)), 9) AS mean_count, min(coalesce(n, 0)) <= 5 AS rare FROM w LEFT JOIN c USING (word) GROUP BY item_id""")
def c15(spark, sf):
    return C.rare_items(items(spark, sf), read(spark, sf, "documents"))


@query("c16_sample_positions", f"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS token, generate_subscripts({TOKENS}, 1) - 1 AS pos FROM documents)
SELECT doc_id, pos::INT AS pos, token FROM t WHERE pos >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5('{SEED}|' || doc_id || '|' || pos)) <= 4""")
def c16(spark, sf):
    return C.sample_positions_of(tokenised(spark, sf), 4, SEED)


@query("c17_split_exact", f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}|' || doc_id), doc_id) <= round(0.2 * count(*) OVER ()) THEN 'eval' ELSE 'train' END AS part FROM documents")
def c17(spark, sf):
    return C.split_exact(read(spark, sf, "documents").select("doc_id"), 0.2, SEED)


@query("c18_mix_streams", f"""WITH t AS (SELECT lang AS stream, token, row_number() OVER (PARTITION BY lang ORDER BY doc_id, pos) - 1 AS o FROM (SELECT lang, doc_id, unnest({TOKENS}) AS token, generate_subscripts({TOKENS}, 1) AS pos FROM documents))
SELECT stream, o + CASE stream WHEN 'en' THEN 0 ELSE (SELECT least(3000, count(*)) FROM t WHERE stream = 'en') END AS "offset", token FROM t WHERE (stream = 'en' AND o < 3000) OR (stream = 'fr' AND o < 2000)""")
def c18(spark, sf):
    from corpuslab.functions.scale import ranked

    tokens = tokenised(spark, sf).where("lang in ('en', 'fr')").select(F.col("lang").alias("stream"), "doc_id", F.posexplode("tokens").alias("pos", "token"))
    numbered = ranked(tokens, [F.col("stream"), F.col("doc_id"), F.col("pos")])
    first = numbered.groupBy("stream").agg(F.min("rank").alias("first"))
    streams = written(numbered.join(F.broadcast(first), "stream").select("stream", (F.col("rank") - F.col("first")).alias("offset"), "token"), "streams")
    return C.mix_streams(streams, [("en", 3000), ("fr", 2000)])


@query("c20_verify_examples", """WITH e AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'code' ELSE 'other' END AS category, (doc_id % 7)::DOUBLE AS gold FROM documents),
r AS (SELECT category, CASE category WHEN 'math' THEN CASE WHEN len(regexp_extract_all(text, '-?[0-9]+(?:\\.[0-9]+)?')) = 0 THEN 'no_number' WHEN regexp_extract_all(text, '-?[0-9]+(?:\\.[0-9]+)?')[-1]::DOUBLE <> gold THEN 'wrong_number' END WHEN 'code' THEN CASE WHEN strpos(text, '```') = 0 THEN 'no_code_block' END ELSE CASE WHEN length(trim(text)) < 20 THEN 'too_short' END END AS reason FROM e)
SELECT category, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY ALL""")
def c20(spark, sf):
    kind = F.when(F.col("doc_id") % 3 == 0, "math").when(F.col("doc_id") % 3 == 1, "code").otherwise("other")
    rows = read(spark, sf, "documents").select("doc_id", "text", kind.alias("category"), (F.col("doc_id") % 7).cast("double").alias("gold"))
    return C.verify_examples(rows).groupBy("category", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("c21_duplicate_groups", f"SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS records, coalesce(max(n), 0) AS largest FROM (SELECT count(*) AS n FROM documents GROUP BY {ALNUM} HAVING count(*) > 1)")
def c21(spark, sf):
    return C.duplicate_groups(read(spark, sf, "documents"))


def _vocab_sql(where: str) -> str:
    return f"SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM (SELECT unnest({TOKENS}) AS token FROM documents WHERE {where}) GROUP BY token"


@query("c22_vocab_diff", f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN b.id IS NULL THEN 'only_a' WHEN a.id IS NULL THEN 'only_b' WHEN a.id <> b.id THEN 'changed' END AS kind FROM ({_vocab_sql(chr(39).join(['lang = ', 'en', '']))}) a FULL JOIN ({_vocab_sql(chr(39).join(['lang = ', 'fr', '']))}) b USING (token)) WHERE kind IS NOT NULL GROUP BY kind")
def c22(spark, sf):
    from corpuslab.operators.ngrams import vocab

    docs = tokenised(spark, sf).select("lang", "doc_id", F.posexplode("tokens").alias("pos", "token"))
    a, b = (vocab(docs.where(F.col("lang") == x)).select("token", "id") for x in ("en", "fr"))
    return C.vocab_diff(a, b).groupBy("kind").agg(F.count("*").alias("n"))
