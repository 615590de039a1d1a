"""Review files in pieces, store names as strings, and runs seen whole or not at all."""
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import reviews_df
from reviewlens.sources import files as S
from reviewlens.sources import results as RS


def _store(root, slug, rows, **how):
    os.makedirs(os.path.join(root, slug), exist_ok=True)
    with open(os.path.join(root, slug, "reviews.json"), "w", encoding="utf-8") as f:
        f.write(rows if isinstance(rows, str) else json.dumps(rows, ensure_ascii=False, **how))


def test_large_files_are_read_in_pieces(spark, tmpdir_path):
    rows = [{"name": f"王 {i}", "rating": i % 6, "text": f"a\n  }},\n  {{ {i} \"q\" " + "字" * (i % 50)} for i in range(400)]
    _store(tmpdir_path, "big", rows, indent=2)
    _store(tmpdir_path, "a b+c%", rows[:3], indent=2)
    _store(tmpdir_path, "one line", rows[:5])
    _store(tmpdir_path, "single", rows[:1], indent=2)
    _store(tmpdir_path, "none", [], indent=2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = S.read_reviews_json(spark, tmpdir_path).select("slug", "pos", "name", "rating", "text").collect()
        blocks = S._pieces(spark, tmpdir_path).where(F.col("path").contains("/big/")).select("block").distinct().count()
        stores = [(r.slug, r.reviews) for r in S.list_stores(spark, tmpdir_path).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {(s, i, r["name"], r["rating"], r["text"]) for s, n in (("big", 400), ("a b+c%", 3), ("one line", 5), ("single", 1))
            for i, r in enumerate(rows[:n])}
    assert {tuple(r) for r in got} == want and len(got) == len(want) and blocks > 3
    assert stores == [("a b+c%", 3), ("big", 400), ("none", 0), ("one line", 5), ("single", 1)]


def test_bad_files_are_named_and_skipped(spark, tmpdir_path):
    rows = [{"name": "x", "rating": 1}, {"name": "y", "rating": 2}]
    whole = json.dumps(rows, indent=2)
    _store(tmpdir_path, "good", rows, indent=2)
    for slug, body in {"cut": whole[:-9], "cut2": whole[:-2], "half": whole.replace("2", '"two"'), "text": "oops", "line": '[{"name": "x", "rat',
                       "object": "{}", "empty": ""}.items():
        _store(tmpdir_path, slug, body)
    bad = {r.slug for r in S.bad_review_files(spark, tmpdir_path).collect()}
    assert bad == {"cut", "cut2", "half", "text", "line", "object"}          # an empty file has no record to judge
    assert [(r.slug, r.pos, r.name) for r in S.read_reviews_json(spark, tmpdir_path, skip_bad=True).orderBy("pos").collect()] == [
        ("good", 0, "x"), ("good", 1, "y")]
    assert [tuple(r) for r in S.list_stores(spark, tmpdir_path, skip_bad=True).collect()] == [("good", 2)]
    with pytest.raises(Exception, match="no review array"):
        S.read_reviews_json(spark, tmpdir_path).collect()


def test_merging_keeps_names_nulls_and_older_reviews(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "t")

    def merge(*rows):
        S.merge_reviews(reviews_df(spark, [{"slug": s, "pos": i, "text": t} for s, i, t in rows]), p)
        return sorted(((r.slug, r.pos, r.text) for r in S.read_reviews(spark, p).collect()), key=repr)

    merge(("007", 0, "a"), ("007", 1, "b"), ("42", 0, "c"), (None, 0, "n"), (None, 1, "m"))
    got = merge(("007", 2, "d"), (None, 2, "k"))
    want = [("007", 0, "a"), ("007", 1, "b"), ("007", 2, "d"), ("42", 0, "c"), (None, 0, "n"), (None, 1, "m"), (None, 2, "k")]
    assert got == sorted(want, key=repr)
    assert merge(("abc", 0, "z"), ("007", 2, "d"), ("007", 2, "d")) == sorted([*want, ("abc", 0, "z")], key=repr)
    assert not [f for f in os.listdir(tmpdir_path) if "staged" in f]


def test_files_follow_the_rows(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(S, "RECORDS_PER_FILE", 100)
    p = os.path.join(tmpdir_path, "t")
    rows = spark.range(0, 1000, numPartitions=16).selectExpr("concat('s', cast(id % 5 as string)) AS slug", "id AS pos", "'x' AS text")
    S.write_reviews(rows, p)
    files = [f for d, _, names in os.walk(p) for f in names if f.endswith(".parquet")]
    assert 10 <= len(files) <= 10 + 5 + 8 and S.read_reviews(spark, p).count() == 1000


def _rows(spark, root, name, **kw):
    got = RS.read_results(spark, root, name, **kw)
    return None if got is None else sorted(((r.slug, r.n) for r in got.collect()), key=repr)


def test_runs_are_seen_whole(spark, tmpdir_path, monkeypatch):
    def df(*rows):
        return spark.createDataFrame(list(rows), "slug string, n int")

    stores = spark.createDataFrame([("007",), ("b",), (None,)], "slug string")
    first = {"t": df(("007", 1), ("b", 2), ("c", 3), (None, 4)), "u": df(("007", 5))}
    assert RS.read_results(spark, tmpdir_path, "t") is None
    assert RS.write_results(first, tmpdir_path, stores=stores, keep_old=True) == 1
    assert _rows(spark, tmpdir_path, "t") == sorted([("007", 1), ("b", 2), ("c", 3), (None, 4)], key=repr)
    # a run that fails between its tables changes nothing that a reader sees
    failing = {"t": df(("007", 9)), "u": df(("007", 9)).withColumn("n", F.raise_error(F.lit("lost")).cast("int"))}
    with pytest.raises(Exception, match="lost"):
        RS.write_results(failing, tmpdir_path, stores=stores)
    assert _rows(spark, tmpdir_path, "t") == sorted([("007", 1), ("b", 2), ("c", 3), (None, 4)], key=repr)
    assert _rows(spark, tmpdir_path, "u") == [("007", 5)]
    # a written run is not seen before its commit
    real = RS._commit
    monkeypatch.setattr(RS, "_commit", lambda *a: (_ for _ in ()).throw(OSError("no commit")))
    with pytest.raises(OSError):
        RS.write_results({"t": df(("b", 7))}, tmpdir_path)
    assert ("b", 2) in _rows(spark, tmpdir_path, "t")
    monkeypatch.setattr(RS, "_commit", real)
    # the next run replaces its stores in all tables, keeps others, and older versions stay readable
    assert RS.write_results({"t": df(("b", 8)), "u": df(("b", 6))}, tmpdir_path, stores=stores, keep_old=True) == 2
    assert _rows(spark, tmpdir_path, "t") == [("b", 8), ("c", 3)] and _rows(spark, tmpdir_path, "u") == [("b", 6)]
    assert ("007", 1) in _rows(spark, tmpdir_path, "t", version=1) and _rows(spark, tmpdir_path, "u", version=1) == [("007", 5)]
    assert RS.vacuum(spark, tmpdir_path) > 0
    assert _rows(spark, tmpdir_path, "t") == [("b", 8), ("c", 3)] and _rows(spark, tmpdir_path, "u") == [("b", 6)]
    assert RS.write_results({"t": df(("c", 1))}, tmpdir_path) == 3 and _rows(spark, tmpdir_path, "t") == [("b", 8), ("c", 1)]


def test_analysis_computes_each_output_once(spark, tmpdir_path):
    from reviewlens.plans import analyze as AN
    rows = [{"slug": s, "pos": i, "rating": 1 + i % 5, "text": f"alpha beta gamma w{i} x{i % 3}", "date_abs": f"2022-0{1 + i % 6}-01"}
            for s in ("007", "7") for i in range(24)]
    seen = spark.sparkContext.accumulator(0)
    df = reviews_df(spark, rows).repartition(2)
    schema = df.schema

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    AN.write_analysis(df.mapInArrow(count, schema), tmpdir_path)
    # the reviews are read for totals, documents, negatives and the monthly series (twice: trend, chart list)
    assert seen.value <= 48 * 8
    got = {r.slug: r.total for r in RS.read_results(spark, tmpdir_path, "summary").collect()}
    assert got == {"007": 24, "7": 24}
