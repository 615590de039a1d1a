"""Cards in cards, lists of fields, keys of any type, and review pages."""
import datetime

import pytest
from pyspark.sql import functions as F

from reviewlens.sources import pages as PG

NESTED = ('<div class="c"><b class="n">out</b><div class="c"><b class="n">in 1</b><i class="t">x</i></div>'
          '<i class="t">y &lt; <i class="t">z</i></i><div class="c"><b class="n"> in 2</b></div></div><i class="t">no</i>')


def test_nested_cards_and_lists():
    got = PG.parse_cards(NESTED, "div.c", {"name": "b.n", "tip": "i@title"}, {"tips": ".t"}, {"all": "i.t", "names": "b"})
    assert got == [
        {"name": "out", "tip": "", "all": ["x", "y < z", "z"], "names": ["out", "in 1", "in 2"], "tips": 3},
        {"name": "in 1", "tip": "", "all": ["x"], "names": ["in 1"], "tips": 1},
        {"name": "in 2", "tip": "", "all": [], "names": ["in 2"], "tips": 0}]


@pytest.mark.parametrize("html, want", [
    (None, []), ("", []), ("<p>no card", []),
    ("<ul><li>a<li>b <b>c</b><li></ul>", ["a", "b c", ""]),                    # closed by the next one
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["ab", "b", "c"]),                   # but not by one of an inner list
    ("<li>cut <b>short", ["cut short"]), ("</li><li>x</b>y</li>", ["xy"]), ("<LI>up</Li>", ["up"]),
    ("<li>a<br>b<img alt='z'></li>", ["ab"]), ("<li>&amp;&#20013;\u3000</li>", ["&中"]),
])
def test_odd_markup(html, want):
    got = PG.parse_cards(f"<div>{html}</div>" if html else html, "li", {}, {}, {})
    assert len(got) == len(want)
    # the card's own text, as a list of a wrapper's matches
    got = PG.parse_cards(f"<main>{html}</main>" if html else html, "main", {}, {}, {"li": "li"})
    assert [t for c in got for t in c["li"]] == want


def test_keys_of_any_type_and_bounded_pieces(spark, monkeypatch):
    monkeypatch.setattr(PG, "ROWS_AT_ONCE", 3)
    day = datetime.date(2024, 1, 2)
    df = spark.createDataFrame([("k1", day, [1, 2], "<li>a</li>" * 10), (None, None, None, "<li>b</li>"), ("k2", day, [], None)],
                               "k string, d date, a array<int>, html string")
    got = PG.extract_cards(df, "li", {}, {}, ["k", "d", "a"], lists={"none": "b"}).collect()
    assert sorted((r.k or "", r.card) for r in got) == [("", 0)] + [("k1", i) for i in range(10)]
    assert {(r.d, tuple(r.a)) for r in got if r.k} == {(day, (1, 2))} and all(r.none == [] for r in got)


def test_table_function(spark):
    PG.register_cards(spark, "nested_cards", "div.c", {"name": "b.n"}, {"tips": ".t"}, {"all": "i.t"})
    spark.createDataFrame([(7, NESTED), (8, None)], "page_id int, html string").createOrReplaceTempView("nested_pages")
    got = spark.sql("SELECT p.page_id, c.* FROM nested_pages p, LATERAL nested_cards(p.html) c ORDER BY card").collect()
    assert [(r.page_id, r.card, r.name, r.tips, r.all) for r in got] == [
        (7, 0, "out", 3, ["x", "y < z", "z"]), (7, 1, "in 1", 1, ["x"]), (7, 2, "in 2", 0, [])]


def test_review_pages(spark):
    card = ('<div class="jftiEf"><span class="d4r55">王</span><span class="kvMYJc" aria-label="4.5 顆星"></span>'
            '<div class="wiI7pd">good</div><div class="wiI7pd">好吃</div><button class="Tya61d"></button></div>')
    df = spark.createDataFrame([("s", 0, card + '<div class="jftiEf"></div>'), ("s", 1, card), ("t", 0, "")],
                               "slug string, page int, html string")
    got = PG.page_reviews(df).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [
        ("s", 0, "王", 4, "好吃", "good", "zh", "", "", 1), ("s", 1, "", 0, "", "", "zh", "", "", 0),
        ("s", PG.PAGE_STRIDE, "王", 4, "好吃", "good", "zh", "", "", 1)]
