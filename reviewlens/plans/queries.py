"""Registered queries: (spark, sf_dir) -> DataFrame over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.config import DEFAULT
from reviewlens.functions import text as TX
from reviewlens.operators import compare as X
from reviewlens.operators import match as M
from reviewlens.sources import payloads as P
from reviewlens.operators import clean as C
from reviewlens.operators import ratings as R
from reviewlens.operators import terms as T
from reviewlens.operators import tokens as TK
from reviewlens.plans import adapters as A
from reviewlens.plans import analyze as AN
from reviewlens.session import cut_lineage, store_count


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return T.lexical_docs(A.reviews(spark, sf), DEFAULT)


def bm25(n: int):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        rv = A.reviews(spark, sf)
        # stores counted on the raw slug column bound every per-store side table
        n_bytes = T.text_bytes(rv)
        docs = T.lexical_docs(rv, DEFAULT, n_bytes=n_bytes, task_bytes=T.BLOCK_TEXT_BYTES)
        return T.top_terms(docs, (n,), DEFAULT.top_terms, DEFAULT, n_stores=store_count(rv), n_bytes=n_bytes)
    q.__doc__ = f"Corpus BM25 of {n}-grams per store, top {DEFAULT.top_terms}."
    return q


def word_freq(spark, sf):
    """Top 100 kept words per store by count, ties by first appearance."""
    rv = A.reviews(spark, sf)
    return T.top_words(T.lexical_docs(rv, DEFAULT), DEFAULT.top_words, DEFAULT.min_docs,
                       n_stores=store_count(rv))


def corpus_stats(spark, sf):
    """N (documents with text, empty ones included), total tokens and avgdl per store."""
    s = T.corpus_stats(_docs(spark, sf)).where(F.col("n_docs") >= DEFAULT.min_docs)
    return s.select("slug", "n_docs", "total", F.round("avgdl", 6).alias("avgdl"))


def doc_freq(spark, sf):
    """Document frequency, total term frequency and idf of every unigram per store."""
    bm = T.bm25(_docs(spark, sf), (1,), DEFAULT.k1, DEFAULT.b)
    bm = bm.where((F.col("n_docs") >= DEFAULT.min_docs) & F.col("term").isNotNull())
    return bm.select("slug", "term", "df", "tf",
                     F.round(T.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


def _cleaned(spark, sf):
    return C.strip_reply_echo(A.reviews(spark, sf))


def _parts(spark, sf):
    return AN.analysis(A.reviews(spark, sf), DEFAULT)


def reply_echo(spark, sf):
    """Reviews with text after owner-reply echo removal."""
    return C.with_text(_cleaned(spark, sf)).select("slug", "pos", "text")


def min_docs_guard(spark, sf):
    """Per store: texts after cleaning and whether the analysis runs."""
    return C.guard_min_docs(_cleaned(spark, sf), DEFAULT.min_docs)


def neg_reviews(spark, sf):
    """Negative reviews (rating <= 2, missing = 5, 0 included) with text."""
    return C.negatives(_cleaned(spark, sf), DEFAULT.neg_max_rating).select("slug", "pos", "rating")


def rating_summary(spark, sf):
    """Total, with text, average rating, negatives and negative rate per store."""
    return R.rating_summary(_cleaned(spark, sf), DEFAULT)


def rating_hist(spark, sf):
    """Zero-filled 5..1 star counts per store."""
    return R.rating_hist(_cleaned(spark, sf))


def monthly(spark, sf):
    """Monthly review volume and average rating (qualifying months only)."""
    return R.monthly(_cleaned(spark, sf), DEFAULT)


def trend(spark, sf):
    """Early vs recent monthly average and direction, stores with >= 6 months."""
    return R.trend(R.monthly(_cleaned(spark, sf), DEFAULT), DEFAULT)


def neg_word_freq(spark, sf):
    """Top-100 words counted as substrings of negative texts, top 50 per store."""
    return _parts(spark, sf)["neg_word_freq"]


def summary(spark, sf):
    """The analysis record of every store, flattened."""
    return AN.summary(A.reviews(spark, sf), DEFAULT)


def chart_manifest(spark, sf):
    """Which chart series every analyzed store gets."""
    return AN.chart_manifest(_parts(spark, sf), DEFAULT)


def bm25_chart(spark, sf):
    """BM25 chart bars (top 25 per n, cleaned labels, bottom-up order)."""
    return AN.chart_series(_parts(spark, sf), DEFAULT)


def word_freq_chart(spark, sf):
    """Word-frequency chart bars (first 30, bottom-up order)."""
    return AN.word_freq_chart(_parts(spark, sf), DEFAULT)


def neg_chart(spark, sf):
    """Negative-word chart bars (first 25, stores with more than 5 words)."""
    return AN.neg_chart(_parts(spark, sf), DEFAULT)


def payload_filter(spark, sf):
    """Captured responses kept as review-list API payloads."""
    return P.filter_payloads(A.payloads(spark, sf)).select("slug", "arrival", "url", "status")


def _posts(spark, sf):
    return P.explode_posts(P.filter_payloads(A.payloads(spark, sf)))


def payload_posts(spark, sf):
    """Posts parsed from payload bodies: name, date, timestamp, capture order."""
    return _posts(spark, sf)


def match_dates(spark, sf):
    """Positional match of reviews to posts by (store, name, k-th occurrence)."""
    m = M.match_dates(A.reviews(spark, sf), _posts(spark, sf))
    return m.select("slug", "pos", "name", "date_abs", "timestamp_us")


def match_metrics(spark, sf):
    """Reviews and matched dates per store."""
    return M.match_metrics(M.match_dates(A.reviews(spark, sf), _posts(spark, sf)))


def scalar_ingest(spark, sf):
    """Card fields: rating from the label, text and translation from the blocks."""
    c = A.cards(spark, sf)
    t = TX.pick_text(F.col("blocks"))
    return c.select("slug", "pos", TX.parse_rating(F.col("aria")).alias("rating"),
                    t["text"].alias("text"), t["text_translated"].alias("text_translated"))


def detect_lang(spark, sf):
    """Script-based language of every review text."""
    return A.reviews(spark, sf).select("slug", "pos", TX.detect_lang(F.col("text")).alias("lang"))


def slugify(spark, sf):
    """Resolved place: name, address, canonical URL, slug and review URL."""
    p = A.places(spark, sf)
    name = TX.clean_label(F.col("title"), TX.TITLE_SUFFIX)
    place = TX.canonical_url(F.col("resolved_url"))
    return p.select("page_id", name.alias("name"),
                    TX.clean_label(F.col("address_label"), TX.ADDRESS_PREFIX).alias("address"),
                    place.alias("place_url"), TX.slugify(name).alias("slug"),
                    TX.review_url(place).alias("review_url"))


def compare_stores(spark, sf):
    """Comparison table with rating rank."""
    return X.compare_stores(_cleaned(spark, sf))


def compare_rollup(spark, sf):
    """Per-store counts with a grand-total row."""
    return X.compare_rollup(_cleaned(spark, sf))


def sentiment_share(spark, sf):
    """Positive / neutral / negative shares per store."""
    return X.sentiment_share(_cleaned(spark, sf))


def photo_share(spark, sf):
    """Share of reviews with photos per store."""
    return X.photo_share(_cleaned(spark, sf))


def yearly(spark, sf):
    """Yearly volume and average rating of all dated reviews."""
    return X.yearly(_cleaned(spark, sf))


YEAR_BUCKETS = ((2018, 2022, "2018-2022"),)


def yearly_buckets(spark, sf):
    """Volume and average rating per period: 2018 to 2022 as one, later years alone."""
    return X.yearly(_cleaned(spark, sf), YEAR_BUCKETS)


def period_ratings(spark, sf):
    """Volume and average rating per overlapping period: every three years in a row that
    start with a year of the reviews, from its 1st of July."""
    rv = _cleaned(spark, sf)
    year = TX.has_text(F.col("date_abs"))
    y = rv.where(year).select(F.left("date_abs", F.lit(4)).try_cast("int").alias("y")).where("y is not null").distinct()
    periods = y.select(F.concat(F.col("y").cast("string"), F.lit("-"), (F.col("y") + 3).cast("string")).alias("label"),
                       F.make_date("y", F.lit(7), F.lit(1)).alias("lo"), F.make_date(F.col("y") + 3, F.lit(6), F.lit(30)).alias("hi"))
    return X.by_period(rv, periods)


def first_last_year(spark, sf):
    """First vs latest year average per store."""
    return X.first_last_year(X.yearly(_cleaned(spark, sf)))


KEYWORDS = ("the", "and", "de", "la", "und", "que")


def keyword_counts(spark, sf):
    """Mentions and mentioning reviews of chosen keywords per store."""
    return X.keyword_counts(_cleaned(spark, sf), KEYWORDS)


def neg_ratio(spark, sf):
    """Negative rate of every store relative to store src0."""
    return X.neg_ratio(_cleaned(spark, sf), "src0")


def shared_neg_words(spark, sf):
    """Negative keywords found in every analyzed store."""
    return X.shared_neg_words(_parts(spark, sf)["neg_word_freq"])


def sample_reviews(spark, sf):
    """Top 3 reviews per store and sentiment mentioning 'the'."""
    return X.sample_reviews(_cleaned(spark, sf), "the", 3)


def tokenize(spark, sf):
    """Lexical tokens (letter runs) of every cleaned review text, in order."""
    r = C.with_text(_cleaned(spark, sf))
    x = r.select("slug", "pos", F.posexplode_outer(TX.tokenize(F.col("text"))).alias("i", "word"))
    return x.where(F.col("i").isNotNull())


def ngrams(spark, sf):
    """2- and 3-grams of the kept words of every review."""
    d = T.lexical_docs(A.reviews(spark, sf), DEFAULT)
    g = d.select("slug", "pos", F.inline_outer(F.array(*[
        F.struct(F.lit(n).alias("n"), TX.ngrams(F.col("words"), n).alias("grams")) for n in (2, 3)])))
    x = g.select("slug", "pos", "n", F.posexplode_outer("grams").alias("i", "gram"))
    return x.where(F.col("i").isNotNull())


def _tokens(spark, sf):
    return TK.tokens_table(A.labels_in(spark, sf), A.FIXTURE_ID2LABEL)


def decode_words(spark, sf):
    """Words decoded from per-character segmentation labels."""
    l = A.labels_in(spark, sf)
    x = l.select("slug", "pos", F.posexplode_outer(TK.decode_words(F.col("text"), F.col("ws"), "error"))
                 .alias("i", "word"))
    return x.where(F.col("i").isNotNull())


def tag_words(spark, sf):
    """Words with the tag of their first character."""
    return TK.explode_tokens(_tokens(spark, sf))


def keep_tokens(spark, sf):
    """Tokens surviving the keep rule (punctuation tags, stop words, one-char non-verbs)."""
    t = _tokens(spark, sf).select("slug", "pos", TX.keep_tokens(F.col("tokens")).alias("tokens"))
    return TK.explode_tokens(t)


def listed_docs(spark, sf):
    """Kept words of every review without a long stop list: all words of the benchmark's texts."""
    words = A.table(spark, sf, "benchmark").select(F.explode(TX.tokenize(F.col("text"))).alias("word"))
    stop = cut_lineage(words.distinct())                          # counted and joined
    d = T.listed_docs(_docs(spark, sf), stop, stop.count())
    return d.select("slug", "pos", "n_words", F.sha2(F.array_join("words", " "), 256).alias("words_sha256"))


def _dealt_texts(spark, sf):
    """(slug, pos, text) of all reviews, dealt out to as many tasks as their bytes need: labels
    take four bytes a character and head, so the text of a task bounds what Arrow holds."""
    r = A.reviews(spark, sf).select("slug", "pos", "text")
    return r.repartition(T.text_tasks(r, T.text_bytes(r)), "slug", "pos", "text")


def score_heads(spark, sf):
    """Words and tags from labels of two heads, scored in one pass by the model-free stand-in."""
    scored = TK.score_heads(_dealt_texts(spark, sf), TK.script_run_heads)
    return TK.explode_tokens(TK.tokens_table(scored, TK.CLASS_TAGS))


def score_labels(spark, sf):
    """Words from labels that the scoring hook gives every review text, with the
    model-free stand-in as its model."""
    scored = TK.score_labels(_dealt_texts(spark, sf), TK.script_run_loader)
    x = scored.select("slug", "pos", F.posexplode_outer(TK.decode_words(F.col("text"), F.col("labels"), "error"))
                      .alias("i", "word"))
    return x.where(F.col("i").isNotNull())


def bm25_tagged(spark, sf):
    """Unigram BM25 over documents built from model labels (segment, tag, keep)."""
    labelled = A.labels_in(spark, sf)
    # Documents built from model labels feed two branches (statistics and
    # term table); they are written once to the shared checkpoint folder so
    # that labelling (a model run, in production) never happens twice.
    docs = cut_lineage(T.tagged_docs(TK.tokens_table(labelled, A.FIXTURE_ID2LABEL), DEFAULT))
    return T.top_terms(docs, (1,), DEFAULT.top_terms, DEFAULT, n_stores=store_count(labelled))


def list_stores(spark, sf):
    """Store catalogue: every store and its review count, sorted by slug."""
    from reviewlens.sources.files import store_counts
    return store_counts(A.reviews(spark, sf))


def page_cards(spark, sf):
    """Navigation cards of every page: link text, target and link count per <li>."""
    from reviewlens.sources.pages import extract_cards
    return extract_cards(A.pages(spark, sf), "li", {"text": "a", "href": "a@href"}, {"links": "a"})


def page_reviews(spark, sf):
    """Reviews assembled from pages of cards, with dates matched from the captured posts."""
    from reviewlens.sources.pages import page_reviews as assemble
    rows = cut_lineage(assemble(A.review_pages(spark, sf)))      # parsed once, read by both sides of the ordinal
    return M.match_dates(rows, _posts(spark, sf))


QUERIES = {
    "bm25_unigram": bm25(1),
    "bm25_2gram": bm25(2),
    "bm25_3gram": bm25(3),
    "word_freq": word_freq,
    "corpus_stats": corpus_stats,
    "doc_freq": doc_freq,
    "reply_echo": reply_echo,
    "min_docs_guard": min_docs_guard,
    "neg_reviews": neg_reviews,
    "rating_summary": rating_summary,
    "rating_hist": rating_hist,
    "monthly": monthly,
    "trend": trend,
    "neg_word_freq": neg_word_freq,
    "summary": summary,
    "chart_manifest": chart_manifest,
    "bm25_chart": bm25_chart,
    "neg_chart": neg_chart,
    "word_freq_chart": word_freq_chart,
    "payload_filter": payload_filter,
    "payload_posts": payload_posts,
    "match_dates": match_dates,
    "match_metrics": match_metrics,
    "scalar_ingest": scalar_ingest,
    "detect_lang": detect_lang,
    "slugify": slugify,
    "compare_stores": compare_stores,
    "compare_rollup": compare_rollup,
    "sentiment_share": sentiment_share,
    "photo_share": photo_share,
    "yearly": yearly,
    "yearly_buckets": yearly_buckets,
    "period_ratings": period_ratings,
    "first_last_year": first_last_year,
    "keyword_counts": keyword_counts,
    "neg_ratio": neg_ratio,
    "shared_neg_words": shared_neg_words,
    "sample_reviews": sample_reviews,
    "tokenize": tokenize,
    "ngrams": ngrams,
    "decode_words": decode_words,
    "tag_words": tag_words,
    "keep_tokens": keep_tokens,
    "score_labels": score_labels,
    "score_heads": score_heads,
    "listed_docs": listed_docs,
    "bm25_tagged": bm25_tagged,
    "list_stores": list_stores,
    "page_cards": page_cards,
    "page_reviews": page_reviews,
}
