"""Long stop lists, two-headed scoring, period tables, exact sums and short labels."""
import datetime as dt
import math
import random

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import reviews_df
from reviewlens.functions import text as TX
from reviewlens.operators import compare as X
from reviewlens.operators import terms as T
from reviewlens.operators import tokens as TK
from reviewlens.plans.queries import QUERIES


@pytest.mark.parametrize("bound", [None, 100])
def test_listed_docs_equal_the_literal_list(spark, bound):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["the", "é"]
    rows = [(rng.choice(["a", "b", None]), k, [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40]))]) for k in range(80)]
    docs = spark.createDataFrame(rows, "slug string, pos long, words array<string>").withColumn("n_words", F.size("words"))
    stop = ["w1", "w2", "the", "é", "w9", "nowhere"]
    table = spark.createDataFrame([(w,) for w in [*stop, "w1", None]], "word string")
    got = {(r.slug, r.pos): (r.words, r.n_words) for r in T.listed_docs(docs, table, bound).collect()}
    want = docs.select("slug", "pos", TX.keep_words(F.col("words"), stop_words=stop, punct_tags=(), verb_tags=("X",)).alias("w"))
    assert got == {(r.slug, r.pos): (r.w, len(r.w)) for r in want.collect()} and len(got) == len(rows)
    own = spark.createDataFrame([("a", "w1"), ("a", "w1"), (None, "w2"), ("b", None)], "slug string, word string")
    got = {(r.slug, r.pos): r.words for r in T.listed_docs(docs, own, bound).collect()}
    assert got == {(s, p): [w for w in ws if w != "w2" and not (s == "a" and w == "w1")] for s, p, ws in rows}
    assert T.listed_docs(docs.limit(0), own, bound).count() == 0
    assert T.listed_docs(docs, own.limit(0), bound).count() == len(rows)


def test_listed_docs_keep_the_dealing_by_document(spark):
    rv = reviews_df(spark, [dict(slug="a", pos=k, text="one two three") for k in range(5)])
    stop = spark.createDataFrame([("two",)], "word string")
    df = T.listed_docs(T.lexical_docs(rv), stop, 1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(slug") == 1 and "SortMergeJoin" not in plan
    assert {tuple(r.words) for r in df.collect()} == {("one", "three")}


def test_two_heads_equal_two_passes(spark):
    texts = ["", None, "ab 12, c", "x" * 23 + " 7", "中文 abc!!", " ", "one two three four five six"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)

    def head(name):
        def loader():
            model = TK.script_run_heads()
            return lambda batch: model(batch)[name]
        return loader

    two = TK.score_heads(df, TK.script_run_heads, max_len=5, batch_size=2)
    one = TK.score_labels(df, head("ws"), out="ws", max_len=5)
    one = TK.score_labels(one, head("tag"), out="tag", max_len=5)
    key = lambda r: r.id                                            # noqa: E731
    assert sorted(two.collect(), key=key) == sorted(one.collect(), key=key)
    whole = {r.id: r for r in two.collect()}
    assert all(len(whole[i].ws) == len(whole[i].tag) == len(t or "") + 2 for i, t in enumerate(texts))
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    words = TK.explode_tokens(TK.tokens_table(
        two.select(F.lit("s").alias("slug"), F.col("id").alias("pos"), "text", "ws", "tag"), TK.CLASS_TAGS)).collect()
    assert [(r.word, r.tag) for r in sorted(words, key=lambda r: (r.pos, r.i)) if r.pos == 2] == [
        ("ab", "letter"), (" ", "space"), ("12", "digit"), (",", "other"), (" ", "space"), ("c", "letter")]


def test_batches_hold_windows_of_like_length(spark):
    df = spark.createDataFrame([("a" * n,) for n in (1, 9, 2, 8, 3, 7)], "text string").coalesce(1)

    def loader():
        def model(batch):
            assert max(map(len, batch)) - min(map(len, batch)) <= 5
            return {"ws": [[1] * (len(t) + 2) for t in batch]}
        return model

    rows = TK.score_heads(df, loader, ("ws",), batch_size=3).collect()
    assert all(len(r.ws) == len(r.text) + 2 for r in rows)


def test_short_labels_are_an_error_unless_cut(spark):
    df = spark.createDataFrame([("s", 1, "long text", [9, 0, 1, 9], [9, 1, 1, 9])],
                               "slug string, pos long, text string, ws array<int>, tag array<int>")
    with pytest.raises(PySparkException, match="labels end before the text"):
        TK.tokens_table(df, {1: "VC"}).collect()
    assert [t.word for t in TK.tokens_table(df, {1: "VC"}, short="cut").first().tokens] == ["lo"]
    with pytest.raises(PySparkException, match="4 labels for 9 characters"):
        df.select(TK.decode_words("text", "ws", "error")).collect()
    with pytest.raises(ValueError):
        TK.decode_words("text", "ws", "other")
    fine = spark.createDataFrame([("s", 1, "", [], []), ("s", 2, None, [9, 9], [9, 9]), ("s", 3, "ab", None, None)],
                                 df.schema)
    assert len(TK.tokens_table(fine, {1: "VC"}).collect()) == 3


def test_periods_against_plain_counts(spark):
    rng = random.Random(4)
    start = dt.date(2019, 1, 1)
    rows = [dict(slug=rng.choice("abc"), pos=k, rating=rng.choice([1, 2, 4, 5, None]),
                 date_abs=str(start + dt.timedelta(rng.randint(0, 900)))) for k in range(300)]
    rows += [dict(slug="a", pos=900 + k, date_abs=x) for k, x in enumerate(["", None, "soon", "2020-13-01"])]
    rows += [dict(slug=None, pos=950, date_abs="2020-02-29")]
    d = dt.date
    periods = [("x", d(2019, 3, 15), d(2020, 3, 15)), ("y", d(2020, 1, 1), d(2020, 1, 1)), ("all", d(2000, 1, 1), d(2100, 1, 1)),
               ("all", d(2019, 1, 1), d(2020, 1, 1)), ("x", d(2019, 3, 15), d(2020, 3, 15)), ("none", d(2020, 2, 1), d(2020, 1, 1)),
               ("none", None, d(2020, 1, 1)), ("void", d(1990, 1, 1), d(1991, 1, 1)), ("leap", d(2020, 2, 29), d(2020, 2, 29))]
    got = {(r.slug, r.period): (r.reviews, r.avg_rating) for r in X.by_period(
        reviews_df(spark, rows), spark.createDataFrame(periods, "label string, lo date, hi date")).collect()}
    want = {}
    for r in rows:
        try:
            day = d.fromisoformat(r["date_abs"])
        except (TypeError, ValueError):
            continue
        for label in {p[0] for p in periods if p[1] and p[1] <= day <= p[2]}:
            want.setdefault((r["slug"], label), []).append(r.get("rating", 5))
    assert {k: v[0] for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    for k, v in want.items():
        rated = [x for x in v if x is not None]
        assert got[k][1] is None if not rated else abs(got[k][1] - sum(rated) / len(rated)) <= 0.005 + 1e-9
    assert X.by_period(reviews_df(spark, rows), spark.createDataFrame([], "label string, lo date, hi date")).count() == 0


def test_scores_do_not_depend_on_partitioning(spark):
    rng = random.Random(6)
    rows = [("s", k, [rng.choice("abcdefgh") + rng.choice("xy") for _ in range(rng.randint(1, 25))]) for k in range(1500)]
    docs = spark.createDataFrame(rows, "slug string, pos long, words array<string>")
    runs = []
    for parts in (1, 3, 7, 16):
        bm = T.bm25(docs.repartition(parts, F.rand(parts)))
        runs.append(sorted((r.term, r.score) for r in bm.collect()))
    assert all(r == runs[0] for r in runs[1:])
    avg = sum(len(w) for *_, w in rows) / len(rows)
    for term, score in runs[0]:
        fs = [(w.count(term), len(w)) for *_, w in rows if term in w]
        idf = math.log((len(rows) - len(fs) + 0.5) / (len(fs) + 0.5) + 1)
        assert math.isclose(score, math.fsum(idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / avg)) for f, n in fs), rel_tol=1e-12)


def test_a_batch_is_labelled_in_chunks(spark):
    """A batch of many texts is given back in pieces of bounded size, whole and in order."""
    def loader():
        def model(batch):
            # the pieces of one call are those of a chunk, never those of the whole batch
            assert sum(map(len, batch)) <= 3 * TK.CHUNK_CHARS // 2, "a whole batch at once"
            return {"ws": [[len(batch[0]) and 7, *map(ord, t), 9] for t in batch]}
        return model

    n = 60
    df = spark.range(n).coalesce(1).selectExpr("id", "repeat(chr(int(65 + id % 26)), int(20000 + id)) AS text")
    rows = TK.score_heads(df, loader, ("ws",), max_len=1 << 20, batch_size=n).select(
        "id", F.size("ws").alias("n"), F.array_distinct("ws").alias("d")).collect()
    assert {r.id: (r.n, r.d) for r in rows} == {i: (20002 + i, [7, 65 + i % 26, 9]) for i in range(n)}


def test_decoding_gives_a_batch_back_in_pieces():
    """Words of a batch leave the worker piece by piece, not as one array of the whole batch."""
    texts = pa.array(["ab " * 100_000, None, "", "é" * 300_000, "x" * (TK.DECODE_BYTES + 5), "y"])
    labels = pa.array([[1] * (len(t.as_py() or "") + 2) for t in texts], pa.list_(pa.int32()))
    seen = []

    def decode(t, lab):
        seen.append((t.to_pylist(), [len(x) for x in lab]))
        return t

    got = TK._pieces(decode, iter([(texts, labels), (texts.slice(0, 0), labels.slice(0, 0)), (texts[-1:], labels[-1:])]))
    assert iter(got) is got and not seen                             # nothing is decoded before it is asked for
    pieces = [x.to_pylist() for x in got]
    assert len(pieces) >= 4 and sum(pieces, []) == [*texts.to_pylist(), "y"]
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= TK.DECODE_BYTES for p in pieces)
    assert [n for _, ns in seen for n in ns] == [len(t or "") + 2 for t in sum(pieces, [])]


def test_scoring_queries_deal_texts_to_bounded_tasks(spark, tmp_path):
    """A task's text, and so its labels in Arrow, doesn't grow with the table; words stay whole."""
    n, size = 80, 1 << 20
    spark.range(n).coalesce(1).selectExpr(
        "nullif(id, 7) AS doc_id", f"CASE WHEN id % 40 = 3 THEN NULL WHEN id = 5 THEN '' ELSE concat(id, repeat(' ', {size})) END AS text",
        "'en' AS lang", "'s' AS source", f"cast({size} AS bigint) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    cores = spark.sparkContext.defaultParallelism
    for name in ("score_heads", "score_labels"):
        df = QUERIES[name](spark, str(tmp_path))
        assert df.rdd.getNumPartitions() >= max(cores, (n - 3) * size // T.TASK_TEXT_BYTES)
        rows = df.where("pos >= 0 OR pos IS NULL").select("pos", "i", F.substring("word", 1, 9).alias("w"), F.length("word").alias("n")).collect()
        want = {(None if k == 7 else k, i, *w) for k in range(n) if k % 40 != 3 and k != 5
                for i, w in enumerate([(str(k), len(str(k))), (" " * 9, size)])}
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)
