"""The operators against plain recomputations, and at their edges: very long texts, ties, repeats, clashing names."""

import hashlib
import os
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import ann, bpe, chat_format, fingerprints, langid, near_dedup, secrets, toxicity

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def given(name):
    if not os.path.isdir(SF):
        pytest.skip("the given tables are not here")
    return pq.read_table(f"{SF}/{name}.parquet").to_pandas()


# 1 chat formatting


def test_text_form_is_read_back():
    rng = random.Random(5)
    pieces = ["\\", "\\\\", "a", " ", "\n", *chat_format.CONTROLS]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "", "tool\\", "</role>"]), "".join(rng.choices(pieces, k=rng.randint(0, 6)))) for _ in range(rng.randint(1, 4))]
        text = ""
        for role, content in turns:
            control = chat_format.NAMED_ROLES.get(role, chat_format.OTHER)
            text += chat_format.CONTROLS[control]
            if control == chat_format.OTHER:
                text += chat_format.escape(role) + chat_format.CONTROLS[chat_format.END_ROLE]
            text += chat_format.escape(content) + chat_format.CONTROLS[chat_format.END_TURN]
            assert chat_format.unescape(chat_format.escape(content)) == content
        assert chat_format.parse_text(text) == turns


def test_long_conversations_are_spread(spark):
    turns = spark.range(3000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string"), F.lit("\\")).alias("text"), F.lit(1).alias("block"), F.lit(2).alias("part"))
    formatted = chat_format.format_conversations(turns, block_turns=500)
    assert formatted.count() == 6 and formatted.agg(F.sum("n_turns")).first()[0] == 3000
    got = chat_format.read_back(formatted).first()
    said = [("user" if i % 2 == 0 else "assistant", f"t{i}\\") for i in range(3000)]
    assert got["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in said)) and got["loss_sha256"] == sha("".join(t for r, t in said if r == "assistant"))
    long = spark.createDataFrame([(1, 0, "assistant", "wörd " * 200_000)], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_conversations(long)).first()["loss_chars"] == 1_000_000


# 4 language


def test_language_takes_repeats_and_long_texts(spark):
    words = {"en": "the of and this that with thing", "fr": "le la été où çà nous être"}
    rows = [(i, words[lang] * 5, lang) for i, lang in enumerate(list(words) * 40)] + [(500, (words["fr"] + " ") * 30_000, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.predict(docs, langid.learn(docs)).where("doc_id = 500").collect()
    assert [r["lang_pred"] for r in found] == ["fr", "fr"]


# 5 near duplicates


def test_one_hot_group_and_one_hot_key(spark):
    """A third of the rows is one text, a third near copies of one text; the rest shares its words."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([*base, f"x{i}"]) for i in range(150)]
    rest = [" ".join(rng.sample(base, 30)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(["same words in a row here"] * 150 + near + rest)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(150)} == {0} and {got[i] for i in range(150, 300)} == {150} and all(got[i] == i for i in range(300, 450))


def test_bitmaps_lose_nothing(spark):
    rng = random.Random(1)
    hashes = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(5000)]
    frame = spark.createDataFrame([(h,) for h in hashes[:2500]], "h long")
    for most in (27, 8):  # the second is too small for them
        held = set(near_dedup._held(near_dedup.bitmap_of(frame, most), np.array(hashes, np.int64)).tolist())
        assert held >= set(range(2500)) and (most == 8 or len(held) < 2900)


# 6 fingerprints


def test_edited_texts_against_a_plain_recomputation(spark):
    docs = given("documents").sort_values("doc_id", ascending=False)
    ids, texts = docs["doc_id"].tolist(), [x or "" for x in docs["text"]]
    got = {r["doc_id"]: r for r in fingerprints.op6_fingerprints(spark, SF).collect()}
    assert len(got) == len(ids)
    for i, (doc_id, a) in enumerate(zip(ids, texts, strict=True)):
        b, cut = texts[(i + 1) % len(texts)], len(a) // 3
        edited = a[: len(a) - cut] + b[:cut]
        own, other, after = map(fingerprints.fingerprint, (a, edited, b))
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(a), sha(edited), fingerprints.written(own), fingerprints.written(other))
        assert (r["near_edited"], r["near_next"]) == (fingerprints.containment(own, other), fingerprints.containment(own, after))


def test_parts_of_repeated_ids(spark):
    rows = [(None, f"n{i}") for i in range(300)] + [(5, f"five {i}") for i in range(300)] + [(2**60 + i, "big") for i in range(50)]
    got = fingerprints.edit_likeness(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(5)).collect()
    assert len(got) == 650 and {r["doc_id"] for r in got} == {r[0] for r in rows}
    dealt = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), rows_per_part=50)
    sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 300  # rows of one id lie in several parts


# 7 secrets


def plain_scan(text):
    found = []
    for kind, pattern, group, least in secrets.BASE:
        found += [(m.start(), secrets.KINDS.index(kind), m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(found)


def test_base_spans_against_a_plain_scanner(spark):
    rng = random.Random(8)
    pieces = ["password", "TOKEN", "api_key", "apikey", "Secret", "passwd", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", "\n", "/+._-", "xyzXYZ123456"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randint(0, 25))), "s") for i in range(1500)] + [(None, "token=abcdefghijkl", "s"), (2000, "password = abcdefghijkl " * 3000, "s"), (2001, None, None), (7, "token=abcdefghijkl", "s"), (7, "token=abcdefghijkl", "s")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, spans int")
    got = {}
    for r in secrets.scan_secrets(docs).select("doc_id", "base").collect():
        got.setdefault(r["doc_id"], []).append([(s["start"], s["kind"], s["end"]) for s in r["base"]])
    want = {}
    for doc_id, text, _ in rows:
        want.setdefault(doc_id, []).append(plain_scan(text or ""))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


# 8 BPE


def test_every_code_point_as_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    library, own = tokenizers.Tokenizer.from_file(bpe.default_tokenizer()), bpe.load(bpe.default_tokenizer())
    points = [chr(x) for x in bpe.PLANES]
    for i in range(0, len(points), 20_000):
        texts = [f"{c} a{c}1" for c in points[i : i + 20_000]]
        wrong = [hex(ord(x[0])) for x, want in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True) if want.ids != own.encode(x).tolist()]
        assert not wrong


def test_random_texts_as_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    library, own = tokenizers.Tokenizer.from_file(bpe.default_tokenizer()), bpe.load(bpe.default_tokenizer())
    rng = random.Random(1)
    pool = [chr(x) for x in range(0x3000)] + [chr(x) for x in (*range(0x11380, 0x11400), *range(0x16120, 0x16140))] + ["́", "̈", "Σ"] * 200 + list(" abc") * 300
    for _ in range(5000):
        text = "".join(rng.choices(pool, k=rng.randint(1, 30)))
        assert library.encode(text, add_special_tokens=False).ids == own.encode(text).tolist()


def test_bpe_takes_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(None, "x", 1), (3, "x", 1), (3, "x", 1)], "doc_id long, text string, n_tokens int")
    assert bpe.round_trip(docs).count() == 3 and bpe.round_trip(docs.limit(0)).count() == 0


# 9 toxicity


def plain_restore(token, model):
    """The cheapest of all readings of a short token."""
    cost, best = toxicity.COST, (float("inf"), "")

    def go(i, word, last, own):
        nonlocal best
        if i == len(token):
            context = ("^^" + word)[-2:]
            best = min(best, (own + model.cost(context, "$"), word))
            return
        c, context = token[i], ("^^" + word)[-2:]
        letters = [(c, 0.0)] if c.isalpha() else []
        letters += [(x, cost["lookalike"]) for x in toxicity.LOOKALIKES.get(c, "")]
        letters += [(x, cost["any"]) for x in "abcdefghijklmnopqrstuvwxyz"] if c in toxicity.ANY_LETTER else []
        for x, price in letters:
            go(i + 1, word + x, c, own + price + model.cost(context, x))
        if c in toxicity.FILLERS or c in toxicity.ANY_LETTER:
            go(i + 1, word, last, own + cost["filler"])
        elif not letters:
            go(i + 1, word, last, own + cost["literal"])
        if c == last:
            go(i + 1, word, last, own + cost["repeat"])

    go(0, "", "", 0.0)
    return best[1]


def test_restoring_is_the_cheapest_reading():
    model = toxicity.CharModel({g: 5 for w in ("idiot", "moron", "scum", "plain", "water", "tent") for g in toxicity.trigrams_of(w)})
    rng = random.Random(2)
    for _ in range(150):
        token = "".join(rng.choices("idtmorn10$@!.-sc", k=rng.randint(2, 6))) + rng.choice(["", "*", "#n"])
        assert toxicity.restore(token, model) == plain_restore(token, model), token


def test_very_long_tokens_end():
    model = toxicity.CharModel({g: 5 for w in ("idiot", "moron") for g in toxicity.trigrams_of(w)})
    assert toxicity.restore("m" + "*" * 100_000 + "n", model).endswith("n")
    assert len(toxicity.restore("a0" * 50_000, model)) == 100_000
    assert {"moron", "idiot"} <= toxicity.Reader(model).words("oh m o r o n  i d i o t")


def test_trigrams_by_arrays():
    texts = ["Hi there, (été) a.b it's 'x' İI 東京都 m0r0n", "", "word " * 1000, "\x1c a\x85b  ", "..."]
    want = {}
    for text in texts:
        for token in text.lower().split():
            if toxicity.plain(token).isalpha():
                for gram in toxicity.trigrams_of(toxicity.plain(token)):
                    want[gram] = want.get(gram, 0) + 1
    for size in (7, 1 << 20):
        got = {}
        for stretch in toxicity.stretches(texts, size):
            for gram, n in toxicity.count_trigrams(stretch):
                got[gram] = got.get(gram, 0) + n
        assert got == want


def test_scores_against_a_plain_model(spark):
    """Scores are those of a plain pass: the surest feature of each word, words of the reader."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    given("labels")
    model = toxicity.learn(docs, labels)
    reader = toxicity.Reader(model.chars)
    got = {r["doc_id"]: r["tox_score"] for r in toxicity.score_texts(docs, model).collect()}
    for doc_id, text in given("documents")[["doc_id", "text"]].itertuples(index=False):
        found = {min(own, key=model.weights.get) for w in reader.words(text or "") if (own := [f for f in toxicity.features_of(w) if f in model.weights])}
        assert got[doc_id] == pytest.approx(1 - np.exp(model.base + sum(model.weights[f] for f in found)))


# 10 nearest neighbours


def test_windows_against_brute_force(spark):
    """More vectors than are verified: recall, the share that is verified, and no dependence on the order of rows."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(400, 32))
    x = centres[rng.integers(0, 400, 20_000)] + 0.6 * rng.normal(size=(20_000, 32))
    index = ann.SortedProjections(np.hstack([x / np.abs(x).max(), np.zeros((len(x), 1))]), 80, 7)
    assert (np.diff(index.sorted, axis=1) >= 0).all()
    frame = spark.createDataFrame(list(zip(range(len(x)), x.tolist(), strict=True)), "vec_id long, embedding array<double>").repartition(4).cache()
    got = ann.search(frame, frame.where("vec_id % 200 = 0"), 20, block_rows=8192).toPandas()
    again = ann.search(frame.orderBy(F.desc("vec_id")), frame.where("vec_id % 200 = 0").orderBy("vec_id"), 20, block_rows=8192).toPandas()
    key = ["query_id", "rank"]
    assert got.sort_values(key).values.tolist() == again.sort_values(key).values.tolist()
    hits = 0
    for q in range(0, 20_000, 200):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(set(got[got["query_id"] == q]["vec_id"]) & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.9 * 20 * 100


def test_collisions_are_those_of_the_windows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 17))
    index = ann.SortedProjections(x, 40, 3)
    widths = np.append(0.5 * 1.08 ** np.arange(45), np.inf)
    verified = []
    for q in x[:20]:
        low, high = index.windows(q[None], widths)
        found = index.candidates(low[0], high[0], 1000, 30)
        at, projected = index.lines @ q, index.lines @ x.T
        for w in widths:  # the same by testing every vector on every line
            plain = np.flatnonzero((np.abs(projected - at[:, None]) <= w).sum(axis=0) >= 30)
            if len(plain) >= 1000:
                break
        assert len(np.setxor1d(found, plain)) <= 2  # rounding at a window's edge
        verified.append(len(found) / len(x))
    assert max(verified) < 0.25


def test_neighbours_of_odd_vectors(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(40)]
    rows += rows[:10] + [(3, [9.0, 9.0]), (100, [1e200, 1e200]), (101, [1e-310, 0.0]), (102, [-1e200, 1e200]), (20, [float(20 % 7), 1.0])]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, block int, dim int")
    got = ann.search(vectors, vectors.where("vec_id % 20 = 0 or vec_id >= 100"), 20).toPandas()
    for q, own in got.groupby("query_id"):
        assert len(own) == 20 and own["vec_id"].is_unique and q not in set(own["vec_id"])
    best = {i: v for i, v in sorted(rows, reverse=True)}  # of an id's vectors the smallest
    own = got[got["query_id"] == 20].sort_values("rank")
    scores = sorted(((float(np.dot(v, best[20])), -i) for i, v in best.items() if i != 20), reverse=True)[:20]
    assert own["vec_id"].tolist() == [-i for _, i in scores]
