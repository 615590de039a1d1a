"""The models against their direct formulas, and every pipeline stage on awkward tables."""
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reviewlens.llm import language, toxicity, winnowing
from reviewlens.llm.hashing import words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "score double, key long, _own string, sha string, row long, terms string, kept boolean, Host string"


def test_score_is_the_machine_formula():
    rng = np.random.default_rng(4)
    vocabulary = [f"t{k}" for k in range(30)]
    keys = np.concatenate([words(pa.array([t]))[0] for t in vocabulary])
    w, v = rng.normal(size=30), rng.normal(size=(30, 3))
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (1, 2, 8, 40)] + ["", None, "unknown words", "T1 t1!t1"]
    got = toxicity.Machine(0.25, keys, w, v).score(pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        held = sorted({vocabulary.index(t) for t in (text or "").lower().replace("!", " ").split() if t in vocabulary})
        z = 0.25 + sum(w[a] for a in held) + sum(v[a] @ v[b] for a, b in itertools.combinations(held, 2))
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9


def test_pairs_of_neutral_words_are_learnt(spark):
    """Toxic is the insult beside one of 50 group words only; neither group words nor other words tell anything alone."""
    rng = random.Random(1)
    rows = []
    for i in range(4000):
        insult, group = rng.random() < 0.2, rng.random() < 0.5
        held = [f"w{rng.randrange(500)}" for _ in range(30)] + ["insult"] * insult + [f"group{rng.randrange(50)}"] * group
        rng.shuffle(held)
        rows.append((i, " ".join(held), int(insult and group), insult))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, insult boolean")
    got = toxicity.op9(spark, df.select("doc_id", "text"), df.select("doc_id", "toxic")).filter("held_out").collect()
    toxic = [r.predicted for r in got if rows[r.doc_id][2]]
    alone = [r.predicted for r in got if rows[r.doc_id][3] and not rows[r.doc_id][2]]
    other = [r.predicted for r in got if not rows[r.doc_id][3]]
    assert np.mean(toxic) > 0.75 and np.mean(alone) < 0.25 and np.mean(other) < 0.01


def test_kernel_ridge_is_the_direct_solution():
    """With every text a landmark, Nystroem is exact: the scores are those of weighted kernel ridge regression."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(a) for _ in range(40)) for a in ("abcde ", "efghi ", "ijklm ") for _ in range(8)]
    langs = [g for g in "xyz" for _ in range(8)]
    x = np.stack([language.presence(t) for t in texts])
    for t, own in zip(texts, x, strict=True):        # a text's bits are those of its n-grams, each hashed alone
        assert (own == np.any([language.presence(t[i:i + 3]) for i in range(len(t) - 2)], axis=0)).all()
    held = [set(np.flatnonzero(r)) for r in x]
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in held] for a in held])
    got = language.fit(x, langs, landmarks=24, ridge=0.1)
    y = np.where(np.array(langs)[:, None] == np.array(sorted(set(langs)))[None, :], 1.0, -1.0)
    direct = k @ np.linalg.solve(k / 8 + 0.1 * np.eye(24), y / 8)     # every row weighs 1 / 8
    assert np.abs(got.predict(x.astype(np.float32), got.matrix()) - direct).max() < 1e-4


def test_samples_count_a_repeated_key_once(spark):
    """A third of all rows under one doc_id neither crowds the fit's sample nor reaches one task."""
    rng = random.Random(3)
    alphabets = {"xx": "abcdefgh ", "yy": "éèàùçfgh "}
    text = lambda g: "".join(rng.choice(alphabets[g]) for _ in range(60))
    rows = [(i, text(g), g) for i in range(200) for g in [("xx", "yy")[i % 2]]] + [(0, text("xx"), "xx") for _ in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    use = F.col("doc_id") >= 0
    model = language.train(docs, use, per_lang=40)
    alone = language.train(docs.dropDuplicates(["doc_id"]), use, per_lang=40)
    same = (model.bits == alone.bits).all(1)
    assert model.langs == alone.langs and same.sum() >= len(same) - 1 and len({b.tobytes() for b in model.bits}) == len(same)
    labels = docs.select("doc_id", (F.col("lang") == "yy").cast("int").alias("toxic"))
    rows = [(i, " ".join(rng.sample([f"w{k}" for k in range(40)], 9)) + " vile" * (i % 2), "xx") for i in range(200)]
    once = spark.createDataFrame(rows, docs.schema)
    often = spark.createDataFrame(rows + rows[:1] * 100, docs.schema).repartition(5)
    a, b = (toxicity.train(d, labels, use) for d in (once, often))
    assert (a.keys == b.keys).all() and (a.w == b.w).all() and (a.v == b.v).all()
    plain = "w1 w2 w3 w4 w5 w6 w7 w8 w9"
    vile, clean = a.score(pa.array([f"{plain} vile", plain]))
    assert vile > 0.5 > clean


def test_unspaced_scripts_do_not_shift(spark):
    rng = random.Random(7)
    thai = "".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(600))
    kana = "".join(chr(rng.randrange(0x3042, 0x3090)) for _ in range(600))
    df = spark.createDataFrame([(thai, "ก" + thai), (kana, "あ" + kana)], "a string, b string")
    df = winnowing.with_fingerprint(winnowing.with_fingerprint(df, "a", "fa"), "b", "fb")
    for r in df.select(winnowing.likeness(winnowing.hashes(F.col("fa")), winnowing.hashes(F.col("fb"))).alias("x")).collect():
        assert r.x > 0.9


def odd_tables(spark):
    secret = 'password = "hunter2hunter2"'
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None, None, None, None, None), (1, None, "en", "h", 0), (2, "", "en", "h", 0), (2, "", "en", "h", 0),
            (3, passage, None, None, 5), (4, passage, "en", "h", 5), (4, passage, "en", "h", 5), (5, secret, "de", "h", 1),
            (5, secret + " other", "de", "h", 1), (None, secret, "de", None, 1), (6, "x" * 300_000, "en", "k", 1),
            (7, "line\n" * 50_000, "en", "k", 1), (8, "word " * 60_000, "fr", "k", 1), (9, "中文" * 2_000, "zh", "k", 1)]
    extra = (0.5, 1, "o", "s", 2, "t", True, "h")
    odd = spark.createDataFrame([r + extra for r in rows], f"{COLUMNS}, {EXTRA}").repartition(3)
    plain = spark.createDataFrame(rows, COLUMNS)
    return {"odd": (odd, len(rows)), "plain": (plain, len(rows)), "one": (plain.limit(1), 1),
            "empty": (odd.filter("false"), 0), "null": (spark.createDataFrame([(None,) * 5] * 4, COLUMNS), 4)}


@pytest.mark.parametrize("which", ["odd", "one", "empty", "null"])
def test_stages_on_awkward_tables(spark, which):
    docs, n = odd_tables(spark)[which]
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.schema.simpleString() == docs.schema.simpleString(), name
        rows = got.collect()
        if name in ("toxicity", "line_dedup", "secrets"):
            assert len(rows) == n, name
        if name == "minhash" and which == "odd":
            texts = [r.text for r in rows if r.text and r.text.startswith("p0")]
            assert len(texts) == 1                   # copies under two ids and in repeated rows
            assert sum(r.text is None for r in rows) + sum(r.text == "" for r in rows) >= 1
        if name == "secrets" and which == "odd":
            assert not any("hunter2" in (r.text or "") for r in rows)
        if name != "minhash" and rows and "Host" in docs.columns:
            assert {(r.score, r.key, r._own, r.sha, r.row, r.terms, r.kept, r.Host) for r in rows} == {
                (0.5, 1, "o", "s", 2, "t", True, "h")}, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    pieces = packed.groupBy().agg(F.count("*").alias("n"), F.sum("length").alias("t")).first()
    assert pieces.n >= n and (pieces.t or 0) >= n    # every document holds at least its closing id
