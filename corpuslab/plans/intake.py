"""Queries S1-S9 and ST1-ST4: records read, rendered, merged and audited, and streaming jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions.storage import fresh_path, read, written
from corpuslab.sources import records as S
from corpuslab.streaming import jobs as J

from .registry import query
from .text import ALNUM, TOKENS


@query("s1_load_docs", "SELECT doc_id, lang, length(text) AS n FROM documents")
def s1(spark, sf):
    """Documents as JSON lines, read back as loose records."""
    lines = read(spark, sf, "documents").select(F.to_json(F.struct("doc_id", "lang", "text")).alias("value"))
    path = fresh_path(spark, "s1")
    lines.write.text(path)
    return S.load_docs(spark, path, "jsonl").select("doc_id", "lang", F.char_length("text").cast("long").alias("n"))


@query("s2_extract_text", "SELECT conv_id, turn, md5(CASE turn % 3 WHEN 0 THEN trim(text) WHEN 1 THEN '<|im_start|>user' || chr(10) || role || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || trim(text) || chr(10) || '<|im_end|>' || chr(10) ELSE '<|im_start|>user' || chr(10) || role || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || trim(text) || chr(10) || '</think>' || chr(10) || chr(10) || 'done' || chr(10) || '<|im_end|>' || chr(10) END) AS digest FROM conversations")
def s2(spark, sf):
    kind = F.col("turn") % 3
    rows = read(spark, sf, "conversations").select("conv_id", "turn", F.when(kind == 0, F.col("text")).alias("text"), F.when(kind != 0, F.col("role")).alias("instruction"), F.when(kind == 1, F.col("text")).when(kind == 2, F.lit("done")).alias("output"), F.when(kind == 2, F.col("text")).alias("thinking"))
    return S.extract_text(rows).select("conv_id", "turn", F.md5("training_text").alias("digest"))


@query("s3_render_chat", "SELECT conv_id, md5(string_agg(CASE WHEN trim(text) = '' THEN '' ELSE '<|im_start|>' || CASE WHEN role IN ('system', 'assistant') THEN role ELSE 'user' END || chr(10) || trim(text) || chr(10) || '<|im_end|>' || chr(10) END, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def s3(spark, sf):
    return S.render_chat(read(spark, sf, "conversations")).select("conv_id", F.md5("text").alias("digest"))


@query("s4_flatten_answers", "SELECT CASE WHEN conv_id % 2 = 0 THEN 'flat' ELSE 'nested' END AS mode, conv_id AS seed, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def s4(spark, sf):
    answer = F.struct(F.col("role").alias("task"), F.col("turn").cast("string").alias("question"), F.col("text").alias("answer"), F.col("text").alias("generated"), F.lit(True).alias("correct"))
    files = read(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(answer).alias("a"))
    flat = F.to_json(F.struct(F.lit("flat").alias("mode"), F.col("conv_id").alias("seed"), F.col("a").alias("answers")))
    nested = F.to_json(F.struct(F.create_map(F.lit("nested"), F.struct(F.col("conv_id").alias("seed"), F.col("a").alias("answers"))).alias("summary")))
    rows = S.flatten_answers(files.select(F.when(F.col("conv_id") % 2 == 0, flat).otherwise(nested).alias("value")))
    return rows.groupBy("mode", "seed").agg(F.count("*").alias("n"), F.sum(F.char_length("answer")).alias("chars"))


@query("s5_export_metrics", "SELECT 'train' AS part, count(*) AS n, round(sum(length(text)), 4)::DOUBLE AS total FROM conversations UNION ALL SELECT 'summary', count(DISTINCT conv_id), count(*)::DOUBLE FROM conversations")
def s5(spark, sf):
    step = F.struct(F.col("turn").alias("step"), F.char_length("text").cast("double").alias("loss"))
    runs = read(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("run")).agg(F.collect_list(step).alias("train"), F.count("*").cast("double").alias("c"))
    out = S.export_metrics(runs.select(F.to_json(F.struct("run", "train", F.create_map(F.lit("turns"), F.col("c")).alias("metrics"))).alias("value")))
    train = out["train"].agg(F.lit("train").alias("part"), F.count("*").alias("n"), F.sum("loss").alias("total"))
    return train.unionByName(out["summary"].agg(F.lit("summary").alias("part"), F.count("*").alias("n"), F.sum("value").alias("total")))


@query("s7_audit_files", "SELECT 'ok' AS status, count(*) > 0 AS found FROM documents UNION ALL SELECT 'missing', true")
def s7(spark, sf):
    """The files of a written corpus against a manifest of themselves and one file more."""
    table = written(read(spark, sf, "documents"), "s7")
    folder = table.inputFiles()[0].rsplit("/", 1)[0]
    own = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    more = spark.createDataFrame([("absent.parquet", 1, "")], "name string, size long, sha256 string")
    found = S.audit_files(spark, f"{folder}/*.parquet", own.unionByName(more))
    return found.groupBy("status").agg((F.count("*") > 0).alias("found"))


@query("s7_audit_statuses", "SELECT * FROM (VALUES ('extra', 1), ('missing', 1), ('ok', 5), ('sha256', 1), ('size', 1)) x(status, files)")
def s7_statuses(spark, sf):
    """A corpus of eight files against a manifest that leaves one out, names one more and has another size and hash."""
    path = fresh_path(spark, "s7")
    read(spark, sf, "documents").repartition(8).write.parquet(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    own = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    part = F.substring("name", 1, 10)
    stated = own.where(part != "part-00000").withColumn("size", F.col("size") + (part == "part-00001").cast("int")).withColumn("sha256", F.when(part == "part-00002", "").otherwise(F.col("sha256")))
    more = spark.createDataFrame([("absent.parquet", 1, "")], "name string, size long, sha256 string")
    return S.audit_files(spark, f"{path}/*.parquet", stated.unionByName(more)).groupBy("status").agg(F.count("*").cast("int").alias("files"))


@query("s8_write_corpus", f"SELECT lang AS category, count(*) AS records, sum(len({TOKENS}))::BIGINT AS tokens FROM documents GROUP BY lang")
def s8(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("category"), F.size(T.word_tokens(F.col("text"))).alias("n_tokens"))
    return S.write_corpus(docs, fresh_path(spark, "s8"))


@query("s9_merge_results", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM documents")
def s9(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id")
    return S.merge_results(docs.withColumn("state", F.lit("old")), docs.where("doc_id % 2 = 0").withColumn("state", F.lit("new")), ["doc_id"])


FRESH = f"SELECT count(DISTINCT k) AS fresh FROM (SELECT {ALNUM} AS k FROM documents) WHERE k <> '' AND k NOT IN (SELECT {ALNUM} FROM benchmark)"


@query("st1_intake_whole", FRESH)
@query("st1_intake", FRESH)
def st1(spark, sf):
    """Whole texts as questions, those of ``benchmark`` known."""
    items = J.read_stream(spark, sf, "documents").select(F.col("text").alias("question"))
    known = read(spark, sf, "benchmark").select(F.col("text").alias("question"))
    return J.drain(J.intake(items, known).select("key"), "st1").agg(F.count("*").alias("fresh"))


@query("st2_growing_ngrams", f"SELECT count(*) AS grams, sum(n)::BIGINT AS total, max(n) AS largest FROM (SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM (SELECT {TOKENS} AS t FROM documents)) GROUP BY g)")
def st2(spark, sf):
    """Bigrams added batch by batch to a bucketed table."""
    counts = J.drain_counts(J.ngrams_of(J.read_stream(spark, sf, "documents"), 2), "gram", "st2")
    return counts.agg(F.count("*").alias("grams"), F.sum("n").alias("total"), F.max("n").alias("largest"))


@query("st3_telemetry", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def st3(spark, sf):
    """Every hour, those that a watermark would leave open and late rows too."""
    return J.drain(J.telemetry_whole(J.read_stream(spark, sf, "events")), "st3", "complete")


@query("st4_flag_contaminated", f"WITH d AS (SELECT doc_id, unnest(list_distinct(list_transform(generate_series(1, len(t) - 7), lambda i: array_to_string(t[i:i+7], ' ')))) AS w FROM (SELECT doc_id, {TOKENS} AS t FROM documents)), b AS (SELECT item_id, unnest(list_transform(generate_series(1, len(t) - 7), lambda i: array_to_string(t[i:i+7], ' '))) AS w FROM (SELECT item_id, {TOKENS} AS t FROM benchmark)) SELECT DISTINCT doc_id, item_id FROM d JOIN b USING (w)")
def st4(spark, sf):
    return J.drain(J.flag_contaminated(J.read_stream(spark, sf, "documents"), read(spark, sf, "benchmark")), "st4")
