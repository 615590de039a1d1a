"""Terms counted and sent as blocks: the rows of the plain plan, in less room."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlens.operators import term_blocks as B
from reviewlens.operators import terms as T

SCHEMA = "slug string, pos long, words array<string>"


def _odd_docs(spark, seed=5):
    """Two rows of one document, no position, no store, no words; words of other scripts."""
    rng = random.Random(seed)
    vocab = ["wörter", "花生", "aa", "bb", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = []
    for k in range(400):
        slug = rng.choice(["a", "a", "a", "b", "ü\n1", "", None])
        pos = rng.choice([k, k, -k, k // 3, None])
        words = None if k % 50 == 7 else [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 9, 40]))]
        rows.append((slug, pos, words))
    rows += [("lone", 1 << 60, ["aa"] * 5), ("none", None, ["bb", "aa", "bb"]), ("void", 3, [])]
    return spark.createDataFrame(rows, SCHEMA).withColumn("n_words", F.coalesce(F.size("words"), F.lit(0)))


def _rows(df):
    cols = ["slug", "n", "term", "df", "tf", "n_docs", "score", "first_pos", "first_i"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: r[:3])


@pytest.mark.parametrize("chunk", [1, 2000, B.CHUNK_BYTES])
def test_blocks_give_the_rows_of_the_plain_plan(spark, monkeypatch, chunk):
    docs = _odd_docs(spark).repartition(3, "slug", "pos")
    plain = T.bm25(docs, (1, 2, 3, 4), n_stores=7)
    monkeypatch.setattr(B, "CHUNK_BYTES", chunk)
    packed = T.bm25(docs, (1, 2, 3, 4), n_stores=7, n_bytes=1000)
    assert packed.dtypes == plain.select(packed.columns).dtypes
    want = _rows(plain)
    assert len(want) > 5000 and _rows(packed) == want          # scores to the last bit


def test_first_terms_of_blocks_with_many_equal_scores(spark):
    rng = random.Random(8)
    rows = [(f"s{k % 2}", k, [f"{k}x{j}" for j in range(4)]) for k in range(300)]
    rows += [("s2", k, [rng.choice("abcde") * 2 for _ in range(9)]) for k in range(60)]
    docs = spark.createDataFrame([(s, p, [w.translate(str.maketrans("0123456789", "qrstuvwxyz")) for w in ws]) for s, p, ws in rows], SCHEMA)
    docs = docs.withColumn("n_words", F.size("words")).repartition(4, "slug", "pos")
    for k in (1, 7, 100):
        plain = T.top_terms(docs, (1, 2), k, n_stores=3).collect()
        packed = T.top_terms(docs, (1, 2), k, n_stores=3, n_bytes=5000).collect()
        assert sorted(map(tuple, packed)) == sorted(map(tuple, plain)) and len(plain) > 2 * k
    few = T.bm25(docs, (1, 2), n_stores=3, n_bytes=5000, top=1)
    assert 6 <= few.count() < T.bm25(docs, (1, 2), n_stores=3, n_bytes=5000).count()


def test_terms_leave_a_task_packed(spark):
    """New 3-grams of a chunk take less than half the 33 bytes of a row of the plain plan."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    level = [{"n": 3, "n_docs": 300, "avgdl": 300.0}]
    rows = [("s", k, [rng.choice(vocab) for _ in range(300)], level) for k in range(300)]
    t = pa.table({"slug": [r[0] for r in rows], "pos": [r[1] for r in rows], "words": [r[2] for r in rows], "levels": [r[3] for r in rows]})
    blocks = list(B._blocks(t, (3,), 1.5, 0.75, 16))
    grams = 300 * 298
    assert {k for k, _ in blocks} == set(range(16)) and sum(len(x) for _, x in blocks) < 16 * grams
    merged = [r for k in range(16) for b in B._merge((x for at, x in blocks if at == k), 1.5, 0.75, None) for r in b.to_pylist()]
    assert sum(r["tf"] for r in merged) == grams and len({r["term"] for r in merged}) == len(merged)


@pytest.mark.parametrize("name", ["bm25_3gram", "bm25_chart"])
def test_no_row_a_term_is_shuffled(spark, name):
    import re

    from reviewlens.plans.queries import QUERIES
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    keyed = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]
    assert "bucket" in " ".join(keyed) and not [k for k in keyed if "term" in k]


def test_words_that_would_run_together_are_an_error(spark):
    for words in (["a b"], [""], ["a\nb"], [None]):
        t = pa.table({"slug": ["s"], "pos": [1], "words": pa.array([words], pa.list_(pa.string())),
                      "levels": [[{"n": 1, "n_docs": 1, "avgdl": 1.0}]]})
        with pytest.raises(ValueError, match="words of blocks"):
            list(B._blocks(t, (1,), 1.5, 0.75, 4))
