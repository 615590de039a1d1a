"""Files, pages, scoring hook, streaming, plan shape and oracle parity."""
import json
import os
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import reviews_df
from reviewlens.operators import tokens as TK
from reviewlens.sources import files as S
from reviewlens.sources import pages as PG

SF = "/root/testdata/sf0.001"


def _write_store(root, slug, rows):
    os.makedirs(os.path.join(root, slug), exist_ok=True)
    with open(os.path.join(root, slug, "reviews.json"), "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False)


def test_read_and_list_review_files(spark, tmpdir_path):
    _write_store(tmpdir_path, "巴蕊", [{"name": "王", "rating": 5, "text": "花生好吃"},
                                      {"name": "李", "rating": 1, "text": "", "date_abs": "2024-01-01",
                                       "timestamp_us": 1704067200000000}])
    _write_store(tmpdir_path, "empty", [])
    os.makedirs(os.path.join(tmpdir_path, "nofile"))
    rv = S.read_reviews_json(spark, tmpdir_path).orderBy("pos").collect()
    assert [(r.slug, r.pos, r.name, r.date_abs) for r in rv] == [("巴蕊", 0, "王", None),
                                                                ("巴蕊", 1, "李", "2024-01-01")]
    stores = [(r.slug, r.reviews) for r in S.list_stores(spark, tmpdir_path).collect()]
    assert stores == [("empty", 0), ("巴蕊", 2)]


def test_write_reviews_replaces_only_present_stores(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "t")
    S.write_reviews(reviews_df(spark, [{"slug": "a", "pos": 0}, {"slug": "b", "pos": 0}]), p)
    S.write_reviews(reviews_df(spark, [{"slug": "a", "pos": 1}]), p)
    got = sorted((r.slug, r.pos) for r in S.read_reviews(spark, p).collect())
    assert got == [("a", 1), ("b", 0)]


def test_extract_cards(spark):
    html = ('<div class="card r"><span class="n"> 王 </span><span class="s" aria-label="4 顆星"></span>'
            '<div class="t">好吃 &amp; 便宜</div><button class="p"></button><button class="p"></button></div>'
            '<div class="card"><span class="n">李</span><div class="t"><b>普</b>通</div></div><p>x</p>')
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id long, html string")
    got = PG.extract_cards(pages, "div.card", {"name": "span.n", "stars": "span.s@aria-label", "text": "div.t"},
                           {"photos": "button.p"}).orderBy("page_id", "card").collect()
    assert [(r.name, r.stars, r.text, r.photos) for r in got] == [("王", "4 顆星", "好吃 & 便宜", 2),
                                                                 ("李", "", "普通", 0)]


def test_score_labels_hook(spark):
    df = spark.createDataFrame([("ab 12,cd",), ("x" * 7,), ("",)], "text string")
    whole = {r.text: r.l for r in TK.score_labels(df, TK.script_run_loader, out="l").collect()}
    for n in (3, 4, 5):
        assert {r.text: r.l for r in TK.score_labels(df, TK.script_run_loader, out="l", max_len=n).collect()} == whole
    got = TK.score_labels(df, TK.script_run_loader, max_len=3)
    rows = got.select("text", TK.decode_words("text", "labels").alias("w")).collect()
    w = {r.text: r.w for r in rows}
    assert w["ab 12,cd"] == ["ab", " ", "12", ",", "cd"]
    assert w["x" * 7] == ["x" * 7]  # no word is cut where a window ends
    assert w[""] == []


def test_streaming_incremental(spark, tmpdir_path):
    from reviewlens.streaming.incremental import run_incremental
    inc = os.path.join(tmpdir_path, "in")
    os.makedirs(inc)
    rows = [{"slug": "s", "pos": i, "name": "n", "rating": 1 + i % 5, "text": f"alpha beta w{i}",
             "text_translated": "", "lang": "en", "date": "", "owner_reply": "", "photos": 0,
             "date_abs": f"2022-0{1 + i % 4}-01", "timestamp_us": None} for i in range(12)]
    with open(os.path.join(inc, "b1.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))
    schema = ("slug string, pos long, name string, rating int, text string, text_translated string, "
              "lang string, date string, owner_reply string, photos int, date_abs string, timestamp_us long")
    q = run_incremental(spark, inc, os.path.join(tmpdir_path, "tbl"), os.path.join(tmpdir_path, "out"),
                        os.path.join(tmpdir_path, "ckpt"), schema)
    q.awaitTermination(120)
    summ = spark.read.json(os.path.join(tmpdir_path, "out", "summary")).collect()
    assert len(summ) == 1 and summ[0].total == 12
    # a second batch of the store adds to it, and sending rows again changes nothing
    for name, part in (("b2.json", range(12, 17)), ("b3.json", range(10, 17))):
        with open(os.path.join(inc, name), "w") as f:
            f.write("\n".join(json.dumps(rows[i % 12] | {"pos": i}) for i in part))
        run_incremental(spark, inc, os.path.join(tmpdir_path, "tbl"), os.path.join(tmpdir_path, "out"),
                        os.path.join(tmpdir_path, "ckpt"), schema).awaitTermination(120)
        assert spark.read.json(os.path.join(tmpdir_path, "out", "summary")).first().total == 17


def test_a_store_that_loses_its_rows_loses_its_partition(spark, tmpdir_path):
    from reviewlens.sources.results import write_results
    stores = spark.createDataFrame([("a",), ("b",)], "slug string")
    both = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "slug string, n int")
    write_results({"t": both}, tmpdir_path)
    write_results({"t": both.where("slug = 'a'")}, tmpdir_path, stores=stores)
    assert {r.slug for r in spark.read.json(os.path.join(tmpdir_path, "t")).collect()} == {"a", "c"}


def test_broken_review_file_fails(spark, tmpdir_path):
    import pytest

    from reviewlens.sources import files as FS
    for slug, body in (("ok", "[]"), ("cut", '[{"name": "x", "rat')):
        os.makedirs(os.path.join(tmpdir_path, slug))
        with open(os.path.join(tmpdir_path, slug, "reviews.json"), "w") as f:
            f.write(body)
    for read in (FS.read_reviews_json, FS.list_stores):
        with pytest.raises(Exception):
            read(spark, tmpdir_path).collect()


def test_odd_timestamps_are_skipped(spark):
    from reviewlens.sources.payloads import explode_posts
    posts = ",".join(f'[["i",[0,0,{ts},0,[0,0,0,0,0,["n"]]]]]' for ts in ("1e30", 10**20, 10**18, 1704067207179575))
    df = spark.createDataFrame([("s", 1, ")]}'\n[null,null,[" + posts + "]]")], "slug string, arrival long, body string")
    assert [r.date_abs for r in explode_posts(df).collect()] == ["2024-01-01"]


def test_short_tag_arrays(spark):
    df = spark.createDataFrame([("ab", [1, 0, 0, 1], t) for t in ([], [0], [0, 0])],
                               "text string, ws array<int>, tag array<int>")
    got = df.select(TK.segment(F.col("text"), F.col("ws"), F.col("tag"), {0: "Na"}).alias("t")).collect()
    assert [[x.tag for x in r.t] for r in got] == [["X", "X"]] * 3


def test_flagship_plan_shape(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    plan = df._jdf.queryExecution().executedPlan().toString()
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in final
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "WindowGroupLimit" in final
    scan = [l for l in final.split("\n") if "FileScan parquet" in l and "documents" in l]
    assert scan and all("n_chars" not in l and "lang" not in l for l in scan)


def _duck(sf):
    con = duckdb.connect()
    from reviewlens.plans.adapters import TABLES
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


PARITY_KEYS = ["bm25_unigram", "word_freq", "summary", "neg_word_freq", "match_dates", "monthly",
               "compare_stores", "payload_posts", "decode_words", "slugify", "detect_lang"]


@pytest.mark.parametrize("key", PARITY_KEYS)
def test_oracle_parity_small(spark, key):
    import __spark_entry__ as E
    from check_parity import _rows
    df = E.queries()[key](spark, SF)
    cur = _duck(SF).execute(E.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, cur.fetchall())


def test_every_query_has_an_oracle():
    import __spark_entry__ as E
    from reviewlens.plans.queries import QUERIES
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


def test_broadcast_only_under_a_bound_and_balance_noop(spark):
    from reviewlens.session import BROADCAST_ROWS, balance, broadcast_if
    big = spark.range(0, 1000).selectExpr("cast(id % 10 as string) AS slug", "id")
    side = big.groupBy("slug").count()
    hinted = big.join(broadcast_if(side, 10), "slug")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in hinted.lower()
    unbounded = big.join(broadcast_if(side, BROADCAST_ROWS + 1), "slug")
    assert "strategy=broadcast" not in unbounded._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in big.join(broadcast_if(side, None), "slug")._jdf.queryExecution() \
        .optimizedPlan().toString()
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(0, 1000, numPartitions=cores * 2)
    assert balance(many) is many
    one = spark.range(0, 1000, numPartitions=1)
    assert balance(one).rdd.getNumPartitions() == cores
