"""Queries T1-T17: texts normalised, tokenised, cut and labelled over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions import answers as A
from corpuslab.functions import text as T
from corpuslab.functions.storage import read

from .registry import query

ALNUM = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
TOKENS = "regexp_extract_all(lower(text), '[a-z0-9'']+')"
DOC_TOKENS = f"SELECT doc_id, unnest({TOKENS}) AS token, generate_subscripts({TOKENS}, 1) - 1 AS pos FROM documents"


@query("t1_normalise", f"SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed, {ALNUM} AS alnum FROM documents")
def t1(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.collapse(F.col("text")).alias("collapsed"), T.norm_alnum(F.col("text")).alias("alnum"))


@query("t2_strict_normalise", f"SELECT doc_id, array_to_string(list_filter(string_split({ALNUM}, ' '), lambda w: w <> '' AND w NOT IN ('a','an','the','of','in','on','at','to','for','and','or')), ' ') AS strict FROM documents")
def t2(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.norm_strict(F.col("text")).alias("strict"))


@query("t3_word_tokens", f"SELECT doc_id, len({TOKENS}) AS n_tokens, md5(array_to_string({TOKENS}, ' ')) AS digest FROM documents")
def t3(spark, sf):
    tokens = T.word_tokens(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("digest"))


@query("t4_norm_answer")
def t4(spark, sf):
    benchmark = read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("forty two and "), F.col("text"), F.lit(" one hundred five thousand")).alias("text"))
    return benchmark.select("id", T.norm_answer(F.col("text")).alias("answer"))


@query("t5_split_long")
def t5(spark, sf):
    pieces = read(spark, sf, "documents").select("doc_id", F.posexplode(T.split_long(F.col("text"), 400)).alias("piece", "text"))
    return pieces.select("doc_id", "piece", F.char_length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query("t6_char_chunks")
def t6(spark, sf):
    chunks = T.char_chunks(read(spark, sf, "documents").select("doc_id", "source", "text"))
    return chunks.select("doc_id", "source", "chunk_index", F.char_length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


@query("t7_token_chunks", f"""WITH t AS ({DOC_TOKENS})
SELECT doc_id, pos // 64 AS chunk, count(*) AS n_tokens, md5(string_agg(token, ' ' ORDER BY pos)) AS digest FROM t GROUP BY ALL""")
def t7(spark, sf):
    chunks = read(spark, sf, "documents").select("doc_id", F.posexplode(T.token_chunks(T.word_tokens(F.col("text")), 64)).alias("chunk", "tokens"))
    return chunks.where(F.size("tokens") > 0).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("t8_first_sentence", "SELECT doc_id, trim(substring(text, 1, least(CASE WHEN strpos(text, '.') > 0 THEN strpos(text, '.') ELSE 120 END, 120)), ' ') AS first_sentence FROM documents")
def t8(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("first_sentence"))


LABELS = """CASE WHEN strpos(s, chr(65533)) > 0 THEN 'other'
 WHEN regexp_full_match(s, '\\s*') THEN 'empty'
 WHEN strpos(s,'<think>')>0 OR strpos(s,'</think>')>0 OR strpos(s,'<|im_start|>')>0 OR strpos(s,'<|im_end|>')>0 OR strpos(s,'assistant'||chr(10))>0 OR strpos(s,'user'||chr(10))>0 OR regexp_matches(s, '(?m)^\\s*(system|user|assistant)\\s*$') THEN 'chat_scaffold'
 WHEN strpos(s,'```')>0 OR regexp_matches(s, '(?m)^\\s*(def |class |import |from \\s*\\S+\\s+import|#include|public |function |fn |printf\\s*\\(|using namespace)') OR len(list_filter(string_split(s, chr(10)), lambda l: regexp_matches(l, '[{};]\\s*$'))) >= 3 THEN 'code_fence'
 WHEN substring(ltrim(s), 1, 1) IN ('{', '[') AND (json_valid(s) OR regexp_matches(s, '^\\s*[\\[{]\\s*"?[\\w\\-]+"?\\s*:')) THEN 'json'
 WHEN regexp_matches(substring(s, 1, 200), '(?i)(i''?m sorry|i am sorry|i cannot|i can''?t|as an ai|i''?m not able|i don''?t know|unable to answer|not able to answer)') THEN 'refusal'
 ELSE 'raw_continuation' END"""


@query("t9_format_label", f"""WITH s AS (SELECT doc_id, coalesce(text, '') AS s FROM documents), l AS (SELECT doc_id, s, {LABELS} AS label FROM s),
f AS (SELECT *, trim(list_filter(string_split(s || chr(10) || '.', chr(10)), lambda x: trim(x) <> '')[1]) AS line FROM l)
SELECT doc_id, label, CASE WHEN label <> 'raw_continuation' THEN label WHEN len(string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ')) <= 6 AND NOT regexp_matches(line, '[.?!:]\\s*$') THEN 'terse' ELSE 'long' END AS sublabel FROM f""")
def t9(spark, sf):
    text = F.col("text")
    return read(spark, sf, "documents").select("doc_id", T.format_label(text).alias("label"), T.format_sublabel(text).alias("sublabel"))


@query("t10_domain_fingerprint", """WITH s AS (SELECT doc_id, text, ' ' || coalesce(text, '') || ' ' AS s FROM documents)
SELECT doc_id,
 list_sum(list_transform(['def ','return ','import ','print(','self.','->','()','{}',';','# '], lambda m: (strpos(s, m) > 0)::INT))::INT + regexp_matches(s, '(?m)^ {4}\\S')::INT AS code,
 list_sum(list_transform(['\\','$','^','\\frac','\\theta','therefore','<=','>='], lambda m: (strpos(s, m) > 0)::INT))::INT + regexp_matches(s, '[0-9]\\s*=\\s*[0-9]')::INT AS math,
 list_sum(list_transform(['the ',' of ',' is ',' was ',' in ',' that '], lambda m: (strpos(lower(s), m) > 0)::INT))::INT AS prose,
 CASE WHEN regexp_full_match(coalesce(text, ''), '\\s*') THEN 'empty' WHEN regexp_matches(text, '^\\s*\\n') THEN 'newline_lead' WHEN regexp_matches(text, '^\\s') THEN 'space_lead' ELSE 'no_lead' END AS prefix FROM s""")
def t10(spark, sf):
    text = F.col("text")
    return read(spark, sf, "documents").select("doc_id", *[c.alias(k) for k, c in T.domain_counts(text).items()], T.prefix_class(text).alias("prefix"))


@query("t11_label_distribution", f"""WITH l AS (SELECT lang AS arm, {LABELS} AS label FROM (SELECT lang, coalesce(text, '') AS s FROM documents))
SELECT arm, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY arm), 9) AS share FROM l GROUP BY arm, label""")
def t11(spark, sf):
    counts = read(spark, sf, "documents").groupBy(F.col("lang").alias("arm"), T.format_label(F.col("text")).alias("label")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("arm").agg(F.sum("n").alias("total"))
    return counts.join(totals, "arm").select("arm", "label", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


@query("t12_answer_candidates")
def t12(spark, sf):
    turns = read(spark, sf, "conversations").where("role = 'assistant'")
    text = F.concat(F.lit("assistant\n"), F.col("text"), F.when(F.col("turn") % 4 == 1, " The final answer is: ").otherwise(" So: "), F.substring("text", 1, 20))
    task = F.when(F.col("conv_id") % 2 == 0, "boolq").otherwise("qa")
    return turns.select("conv_id", "turn", A.last_candidate(text).alias("v1"), A.answer_candidate(text, task).alias("v2"))


_ROUTES_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"strpos(lower(text), '{k}') > 0" for k in keys) + f" THEN '{task}'" for task, keys in T.ROUTES) + " WHEN len(regexp_replace(lower(text), '[^0-9]', '', 'g')) / greatest(len(text), 1) > 0.15 THEN 'number' ELSE 'general' END"
_WEIGHTS_SQL = "(VALUES " + ", ".join(f"('{t}', {a}, {b}, {c})" for t, (a, b, c) in T.CHANNEL_WEIGHTS.items()) + ") AS w(task, bm25, dense, ngram)"


@query("t13_route", f"SELECT conv_id, turn, r.task, bm25::DOUBLE AS bm25, dense::DOUBLE AS dense, ngram::DOUBLE AS ngram FROM (SELECT conv_id, turn, {_ROUTES_SQL} AS task FROM conversations WHERE role = 'user') r JOIN {_WEIGHTS_SQL} ON w.task = r.task")
def t13(spark, sf):
    turns = read(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", T.route_task(F.col("text")).alias("task"))
    weights = spark.createDataFrame([(t, *w) for t, w in T.CHANNEL_WEIGHTS.items()], "task string, bm25 double, dense double, ngram double")
    return turns.join(F.broadcast(weights), "task")


@query("t14_token_category", """WITH t AS (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS token FROM documents)
SELECT category, count(*) AS n, count(DISTINCT token) AS n_distinct FROM (
 SELECT token, 'number' AS category FROM t WHERE regexp_matches(token, '[0-9]') UNION ALL SELECT token, 'name' FROM t WHERE regexp_matches(token, '^\\p{Lu}\\p{L}*$')) GROUP BY category""")
def t14(spark, sf):
    tokens = read(spark, sf, "documents").select(F.explode(F.split("text", r"[ \t\n\x0B\f\r]+")).alias("token"))
    return tokens.select("token", F.explode(T.token_categories(F.col("token"))).alias("category")).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("token").alias("n_distinct"))


@query("t15_repetition", f"""WITH t AS ({DOC_TOKENS}), g AS (SELECT doc_id, token || ' ' || lead(token) OVER w || ' ' || lead(token, 2) OVER w AS g FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT d.doc_id, coalesce(round(1 - count(DISTINCT g) / nullif(count(g), 0), 9), 0) AS repetition FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id""")
def t15(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.round(T.repetition_rate(T.word_tokens(F.col("text"))), 9).alias("repetition"))


@query("t16_prompt", """WITH q AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next, role FROM conversations)
SELECT conv_id, turn, md5('Task: qa' || chr(10) || 'Q: ' || text || chr(10) || 'A:') AS prompt, md5('Answer: ' || answer || chr(10) || 'Question: ' || text) AS answer_mode, md5(answer || chr(10) || 'Answer: ' || answer || chr(10) || 'Question: ' || text) AS both_mode FROM q WHERE role = 'user' AND next = 'assistant'""")
def t16(spark, sf):
    from corpuslab.operators.corpus import qa_pairs

    pairs, q, a = qa_pairs(read(spark, sf, "conversations")), F.col("question"), F.col("answer")
    prompt = T.render("Task: {task}\nQ: {question}\nA:", task=F.lit("qa"), question=q)
    return pairs.select("conv_id", "turn", F.md5(prompt).alias("prompt"), F.md5(T.oracle_context(q, a, a, "answer")).alias("answer_mode"), F.md5(T.oracle_context(q, a, a, "both")).alias("both_mode"))


@query("t17_format_variants", """SELECT doc_id, unnest(['chat','cot','tool']) AS kind, unnest([md5('user: ' || text || chr(10) || 'assistant: ok'), md5('<think>' || chr(10) || text || chr(10) || '</think>'), md5('<tool_call>' || chr(10) || text || chr(10) || '</tool_call>')]) AS digest FROM documents""")
def t17(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.explode(T.format_variants(F.col("text"))).alias("v")).select("doc_id", "v.kind", F.md5("v.text").alias("digest"))
