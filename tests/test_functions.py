"""Hand-written golden rows for the column functions (the test tables hold no CJK text)."""
from pyspark.sql import functions as F

from reviewlens import functions as RF
from reviewlens.operators import ratings as R
from reviewlens.operators import tokens as TK


def col1(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_detect_lang(spark):
    got = col1(spark, ["好吃", "おいしい", "맛있다", "Great, 5!", "It’s ok", "", "\n", None],
               RF.detect_lang)
    assert got == ["zh", "ja", "ko", "en", "zh", "zh", "zh", "zh"]


def test_slugify_and_urls(spark):
    assert col1(spark, ["巴蕊 花生!Café", "__Ab__", "x" * 40], RF.slugify) == ["巴蕊_花生_café", "ab", "x" * 30]
    assert col1(spark, ["https://m/p?entry=ttu&g=1", "https://m/p"], RF.canonical_url) == ["https://m/p", "https://m/p"]
    assert col1(spark, ["a!4m6!3m5b!16sc"], RF.review_url) == ["a!4m8!3m7b!9m1!1b1!16sc?entry=ttu"]
    assert col1(spark, ["店 - Google 地圖 "], lambda c: RF.clean_label(c, " - Google 地圖")) == ["店"]


def test_rating_and_text_choice(spark):
    assert col1(spark, ["4.5 顆星", "none", "10", None], RF.parse_rating) == [4, 0, 1, 0]
    df = spark.createDataFrame([([],), (["o"],), (["t", "o"],), (["t", ""],), (["same", "same"],)],
                               "b array<string>")
    got = [(r.p.text, r.p.text_translated) for r in df.select(RF.pick_text("b").alias("p")).collect()]
    assert got == [("", ""), ("o", ""), ("o", "t"), ("t", ""), ("same", "")]


def test_strip_and_echo(spark):
    assert col1(spark, ["　 a b \n"], RF.ustrip) == ["a b"]
    df = spark.createDataFrame([("感謝您", "業主回應 3 個月前感謝您"), ("好吃", "業主回應 2 週前感謝"),
                                ("感謝您的支持 很棒", "業主回應感謝您的支持"), ("x", "")], "t string, r string")
    got = [r[0] for r in df.select(RF.is_reply_echo(F.col("t"), F.col("r"))).collect()]
    assert got == [True, False, True, False]


def test_keep_rule_and_ngrams(spark):
    df = spark.createDataFrame([([("吃", "VC"), ("我", "Nh"), ("店", "Nc"), ("花生", "Na"), ("。", "PERIODCATEGORY"),
                                  ("的", "DE"), ("好吃", "VH")],)],
                               "t array<struct<word:string,tag:string>>")
    kept = df.select(RF.token_words(RF.keep_tokens("t"))).first()[0]
    assert kept == ["吃", "花生", "好吃"]
    d = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in d.select(RF.ngrams("w", 2)).collect()] == [["a b", "b c"], [], []]
    assert [r[0] for r in d.select(RF.ngrams("w", 3)).collect()] == [["a b c"], [], []]


def test_substring_count_and_label(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("好吃好吃", "好吃"), (None, "a")], "t string, w string")
    assert [r[0] for r in df.select(RF.substring_count(F.col("t"), F.col("w"))).collect()] == [2, 2, 0]
    assert col1(spark, ["花生!!", "!!", "a b"], RF.chart_label) == ["花生", "?", "a b"]


def test_round_ratio_half_even(spark):
    df = spark.createDataFrame([(1, 8), (49, 4), (1, 3), (2, 3), (5, 0)], "n long, d long")
    got = [r[0] for r in df.select(R.round_ratio(F.col("n"), F.col("d"), 2)).collect()]
    assert got == [0.12, 12.25, 0.33, 0.67, None]
    got1 = [r[0] for r in df.select(R.round_ratio(F.col("n"), F.col("d"), 1)).collect()]
    assert got1[1] == 12.2


def test_decode_and_tags(spark):
    df = spark.createDataFrame([("花生好吃a", [9, 0, 1, 0, 1, 0, 9], [9, 0, 0, 1, 1, 2, 9]),
                                ("", [9, 9], [9, 9]), ("ab￿cd", [9, 0, 1, 0, 0, 1, 9], [9, 0, 0, 0, 0, 0, 9]),
                                ("long text", [9, 0, 1, 9], [9, 1, 1, 9])],
                               "text string, ws array<int>, tg array<int>")
    m = {0: "Na", 1: "VC"}
    rows = df.select(TK.decode_words("text", "ws").alias("w"),
                     TK.segment("text", "ws", "tg", m).alias("t"),
                     TK.tag_words(TK.decode_words("text", "ws"), F.col("tg"), m).alias("g")).collect()
    assert rows[0].w == ["花生", "好吃", "a"]
    assert [(t.word, t.tag) for t in rows[0].t] == [("花生", "Na"), ("好吃", "VC"), ("a", "X")]
    assert rows[0].g == ["Na", "VC", "X"]
    assert rows[1].w == [] and rows[1].t == []
    assert rows[2].w == ["ab", "￿", "cd"]
    assert rows[3].w == ["lo"]  # only labelled characters are decoded


def test_micros_to_date(spark):
    df = spark.createDataFrame([(1704067207179575,), (1704040000000000,)], "m long")
    got = [tuple(r) for r in df.select(RF.micros_to_date("m"), RF.micros_to_date("m", "Asia/Taipei")).collect()]
    assert got == [("2024-01-01", "2024-01-01"), ("2023-12-31", "2024-01-01")]


def test_lexical_pattern_equals_tokenize_and_keep(spark):
    import random
    rnd = random.Random(5)
    alphabet = ["a", "b", "É", "ß", "好", "吃", "Ｆ", "Ｂ", " ", ",", "1", "_", "\n", "'"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    texts += ["ＦＢ ＦＢＸ ab 有 好吃", "ab abc abcd", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    configs = [dict(), dict(stop_words=("ab", "好吃", "a", "x y")), dict(verb_tags=("X",)),
               dict(punct_tags=("X",)), dict(stop_words=("abc", "ab"), verb_tags=("X",))]
    for sets in configs:
        rows = df.select(RF.lexical_words("t", **sets).alias("a"),
                         RF.keep_words(RF.tokenize("t"), **sets).alias("b"),
                         RF.lexical_count("t", **sets).alias("c")).collect()
        for r in rows:
            assert r.a == r.b and r.c == len(r.b), (sets, r)


def test_decoding_equals_plain_python(spark, monkeypatch):
    """Words and tags of whole batches against one character at a time; null, short and long labels."""
    import random
    rnd = random.Random(11)
    rows = [("ab", None, [0, 1, 1, 0]), (None, [9, 9], [9, 9]), ("ab", [9, 0, 0, 9], None), ("", None, None), ("é", [], [])]
    for _ in range(300):
        t = "".join(rnd.choice(["a", "é", "好", "😀", "￿", " ", "\n"]) for _ in range(rnd.randint(0, 30)))
        ws = [rnd.choice([0, 1, 2, None]) for _ in range(max(0, len(t) + rnd.choice([2, 2, 2, 0, -3, 5])))]
        tag = [rnd.choice([0, 1, 7, -1, None]) for _ in range(max(0, len(t) + rnd.choice([2, 2, 1, 4])))]
        rows.append((t, ws, tag))
    names = {0: "Na", 1: "VC", -1: "Q"}

    def plain(t, ws, tag):
        if ws is None:
            return None if t else []
        t = t or ""
        m = max(0, min(len(t), len(ws) - 2))
        starts = [i for i in range(m) if i == 0 or ws[i + 1] == 0]
        words = [t[a:b] for a, b in zip(starts, [*starts[1:], m])]
        if tag is None:
            return [(w, None) for w in words]
        return [(w, names.get(tag[i + 1], "X") if i < len(tag) - 2 and tag[i + 1] is not None else "X")
                for w, i in zip(words, starts)]

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, ws array<int>, tag array<int>")
    for size in (1 << 20, 40):
        monkeypatch.setattr(TK, "DECODE_BYTES", size)
        got = df.coalesce(2).select("i", TK.decode_words("text", "ws").alias("w"), TK.word_starts("text", "ws").alias("s"),
                                    TK.segment("text", "ws", "tag", names).alias("t")).collect()
        assert len(got) == len(rows)
        for r in got:
            want = plain(*rows[r.i])
            assert (None if r.t is None else [tuple(x) for x in r.t]) == want, rows[r.i]
            assert r.w == (None if want is None else [w for w, _ in want])
            assert len(r.s) == len(want or [])


def test_label_decoding_runs_no_lambda_per_character(spark):
    df = spark.createDataFrame([("s", 1, "ab", [9, 0, 1, 9], [9, 1, 1, 9])],
                               "slug string, pos long, text string, ws array<int>, tag array<int>")
    plan = TK.tokens_table(df, {1: "VC"})._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("ArrowEvalPython") == 1


def test_decoding_ships_the_package(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(TK, "ship_package", seen.append)
    TK.decode_words("text", "ws"), TK.segment("text", "ws", "tag", {}), TK.word_starts("text", "ws")
    assert len(seen) == 3
