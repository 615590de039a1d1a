"""One-pass word counts and the plans of the term statistics."""
import random
import re

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import compare as X
from reviewlens.operators import terms as T
from reviewlens.operators.patterns import Vocabulary, pattern_counts
from reviewlens.plans import adapters as A

SF = "/root/testdata/sf0.001"


def test_automaton_counts_like_replacing():
    rng = random.Random(3)
    for _ in range(400):
        words = list({"".join(rng.choice("ab中") for _ in range(rng.randint(0, 4))) for _ in range(6)})
        text = "".join(rng.choice("ab中 ") for _ in range(rng.randint(0, 60)))
        v = Vocabulary([{"vrank": k, "word": w} for k, w in enumerate(words)])
        got = {v.rows[k]: n for k, n in v.count(text).items()}
        assert got == {(k, w): text.count(w) for k, w in enumerate(words) if w and w in text}


@pytest.mark.parametrize("bound", [None, 10])
def test_pattern_counts_per_store(spark, bound):
    texts = [("a", "the cat the"), ("a", "then"), ("b", "aaaa"), (None, "the"), ("c", "the"), ("a", None), ("b", ""), ("a", "the cat the")]
    vocab = [("a", 1, "the"), ("a", 2, "cat"), ("a", 3, "dog"), ("b", 1, "aa"), ("b", 2, ""), ("b", 3, None), (None, 1, "he"), ("d", 1, "x")]
    got = pattern_counts(spark.createDataFrame(texts, "slug string, text string").repartition(3),
                         spark.createDataFrame(vocab, "slug string, vrank int, word string"), bound).collect()
    assert {(r.slug, r.word, r["count"], r.texts) for r in got} == {
        ("a", "the", 5, 3), ("a", "cat", 2, 2), ("b", "aa", 2, 1), (None, "he", 1, 1)}


def test_long_keyword_lists_equal_short_ones(spark):
    rows = [(s, t) for s in ("a", "b", None) for t in ("the theme then", "no hit", "", None, "aaa the")]
    df = spark.createDataFrame(rows, "slug string, text string")
    words = ["the", "a", "aa", "zzz"] + [f"w{i}" for i in range(20)]
    long = X.keyword_counts(df, words).collect()
    short = [r for k in range(0, len(words), 8) for r in X.keyword_counts(df, words[k:k + 8]).collect()]
    assert {tuple(r) for r in long} == {tuple(r) for r in short} and len(long) == len(short) == 3 * len(words)
    assert ("a", "the", 4, 2) in {(r.slug, r.word, r.mentions, r.reviews) for r in long}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_cross_the_network_once(spark):
    docs = T.lexical_docs(A.reviews(spark, SF))
    plan = _plan(T.term_freq(docs, (1, 2)))
    keyed = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert [re.sub(r"#\d+L?", "", k) for k in keyed if "slug" in k] == ["slug, pos"]
    counted = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", _plan(T.bm25(docs, (1,), n_stores=20)))
    assert not [k for k in counted if "pos" in k and "term" in k]


def test_reviews_read_each_table_once(spark):
    plan = _plan(A.reviews(spark, SF))
    assert plan.count("FileScan parquet") == 2 and "Union" not in plan


def test_guard_ratings_and_histogram_share_one_aggregate(spark):
    from reviewlens.plans import analyze as AN
    parts = AN.analysis(A.reviews(spark, SF))
    for name in ("guard", "ratings", "hist"):
        assert "FileScan" not in _plan(parts[name])
    assert _plan(AN.summary(A.reviews(spark, SF), parts=parts)).count("FileScan parquet") <= 10


def test_a_store_without_a_name_is_only_counted(spark):
    from conftest import reviews_df
    from reviewlens.plans import analyze as AN
    rows = [{"slug": s, "pos": i, "text": f"alpha beta {i}"} for s in ("a", None) for i in range(4)] + [{"slug": "few", "text": "x"}]
    got = {r.slug: r for r in AN.summary(reviews_df(spark, rows)).collect()}
    assert got["a"].total == 4 and got["few"].total is None and got["few"].error == "too few texts"
    assert got[None].with_text == 4 and got[None].total is None


def test_the_text_of_a_task_does_not_grow_with_the_table(spark, monkeypatch):
    from conftest import reviews_df
    monkeypatch.setattr(T, "TASK_TEXT_BYTES", 1000)
    cores = spark.sparkContext.defaultParallelism
    for n in (20 * cores, 80 * cores):
        rv = reviews_df(spark, [dict(slug="ab"[k % 2], pos=k, text="alpha beta " * 9, text_translated="é" * 10) for k in range(n)])
        assert T.text_bytes(rv) == 99 * n
        tf = T.term_freq(T.lexical_docs(rv), (1, 2))
        plan = _plan(tf)
        assert f", {max(cores, -(-99 * n // 1000))})" in plan and "REPARTITION_BY_NUM" in plan
        assert tf.count() == 4 * n
    assert T.text_bytes(rv.limit(0)) == 0 and T.lexical_docs(rv.limit(0)).count() == 0
