"""The pipeline's stages on the smallest tables: columns, decisions and what must stay."""

import os
import re

import pytest

import corpus_pipeline
from corpuslab.llm import bpe, langid, secrets, toxicity
from corpuslab.llm.common import materialise
from corpuslab.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] == counts[4] > 0.5 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.selectExpr("explode(doc_ids) as doc_id").distinct().count() == counts[4]


def test_each_stage_decides_as_a_plain_pass(spark):
    """What a stage drops or changes follows from its operator's results, row by row, and nothing else changes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    kept = {r["doc_id"] for r in corpus_pipeline.keep_identified(spark, docs, SF).collect()}
    letters = {i for i, t in rows.items() if any(c.isalpha() for c in t or "")}
    scores = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.predict(docs, langid.learn(docs), spans=False).collect()}
    assert kept <= letters and kept == {i for i, (lang, score) in scores.items() if lang != langid.UNKNOWN and score >= corpus_pipeline.LEAST_LANGUAGE_SHARE}

    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    tox = {r["doc_id"]: r["tox_score"] for r in toxicity.score_texts(docs, model).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()} == {i for i, x in tox.items() if x < toxicity.THRESHOLD}

    sets = {}
    for i, t in rows.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
    low = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(len(pairs) and 20):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()} == {i for i in sets if low[i] == i}

    spans = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(docs).collect()}
    for r in corpus_pipeline.redact_secrets(spark, docs, SF).collect():
        text, out, at = rows[r["doc_id"]], "", 0
        for s in spans[r["doc_id"]]:
            if s["start"] >= at:
                out += text[at : s["start"]] + "<secret>"
            at = max(at, s["end"])
        assert r["text"] == (text if text is None or not spans[r["doc_id"]] else out + text[at:])

    packed = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    tokenizer = bpe.load(bpe.default_tokenizer())
    assert sum(r["length"] for r in packed) == sum(len(tokenizer.encode(t or "")) + 1 for t in rows.values())
    assert all(len(set(r["sources"])) == len(r["sources"]) for r in packed)


def test_stages_take_nulls_and_empty_tables(spark):
    odd = spark.createDataFrame([(3, "one two three four five six " * 20_000, "en", "s", 1), (4, "same words", "en", "s", 1), (4, "same words", "en", "s", 1), (1, None, None, None, None), (None, "plain words here", "en", "s", 16), (2, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, SF).count() >= 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in ORACLE:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for t in ("documents", "pages", "conversations", "embeddings", "benchmark"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        rel = con.sql(ORACLE[name])
        names = list(rel.columns)
        assert sorted(map(repr, (tuple(r[c] for c in names) for r in rows))) == sorted(map(repr, rel.fetchall()))


def test_near_duplicates_by_row(spark):
    """Unrelated texts that share an id both stay, repeated rows leave one, null ids are rows like others."""
    texts = {"a": "one two three four five six seven eight nine ten eleven", "b": "red green blue black white grey pink brown gold", "c": "lonely words that nobody else has in any order here"}
    rows = [(4, texts["a"]), (4, texts["b"]), (4, texts["a"]), (2, texts["b"]), (None, texts["c"]), (None, texts["c"]), (7, None), (7, None), (8, ""), (None, texts["a"])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()), key=str)
    assert got == sorted([(4, texts["a"]), (2, texts["b"]), (None, texts["c"]), (7, None), (7, None), (8, "")], key=str)
