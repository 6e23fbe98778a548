"""The corpus pipeline: language ID, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
docs. The first four return the columns of ``documents``; the last returns packed sequences of token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import langid, near_dedup, packing, secrets, toxicity
from corpuslab.llm.common import materialise

#: Below this share of letters in its main language a text has none.
LEAST_LANGUAGE_SHARE = 0.4


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language; rejected: texts without a letter (null, empty), or without a main language.

    Every row is judged by its text alone, so repeated rows stay or go together; an empty table stays empty.
    """
    found = langid.predict(docs, langid.learn(docs), keep=tuple(docs.columns), spans=False)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SHARE)).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, learned from the labels of documents still present.

    Every row is scored by its text alone, null like empty; without labels all have the same score. An empty table stays empty.
    """
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_texts(docs, model, keep=tuple(docs.columns)).where(F.col("tox_score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more.

    Rows count by a number of their own, so a repeated row goes and another text under the same doc_id stays. Of a
    group the row with the smallest doc_id stays, of several the first; null ids come last. Texts without a word
    (null, empty) are like no other and stay. An empty table stays empty.
    """
    keyed = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-keyed")
    found = near_dedup.near_duplicates(keyed.select(F.col("__row").alias("doc_id"), "text"), percent=80, shingle_words=5)
    found = materialise(found.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group")), "pipeline-groups")
    groups = materialise(found.groupBy("__group").agg(F.count("*").alias("n")).where("n > 1").select("__group"), "pipeline-large")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row")
    grouped = materialise(found.join(groups, "__group").join(keyed.select("__row", "doc_id"), "__row").select("__group", order.alias("order")), "pipeline-grouped")
    stay = grouped.groupBy("__group").agg(F.min("order").alias("order")).select("order.__row")
    dropped = materialise(grouped.select("order.__row").join(stay, "__row", "left_anti"), "pipeline-dropped")
    return keyed.join(dropped, "__row", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; null texts stay null, an empty table stays empty."""
    return secrets.redact(docs, secrets.scan_secrets(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in training sequences of up to 2,048 token ids; near copies are gone already.

    Every row's whole text is packed, a null one as its end marker alone; an empty table gives no row.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_identified),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]
#: Learned decisions (language, toxicity) and packing have no SQL; the tests hold each stage's decisions against plain ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
