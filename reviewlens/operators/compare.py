"""Store comparison operators (the multi-store report)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions.dates import year_of
from reviewlens.functions.text import has_text, substring_count
from reviewlens.operators.patterns import pattern_counts
from reviewlens.operators.ratings import is_negative, round_ratio


def _pct(num: Column, den: Column, digits: int = 1) -> Column:
    return round_ratio(num * 100, den, digits)


def global_rank(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """``rank()`` by ``value`` descending over the whole table; NULL values rank last.

    Rows are counted per distinct value, and only those counts are summed in
    order: a rank is one more than the rows of all greater values.  The ordered
    table has one row per distinct value (some 400 for two-decimal averages),
    however many rows share one.
    """
    ranks = df.groupBy(F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    above = Window.orderBy(F.col("_value").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranks.select("_value", (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).alias(name))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_value")), "left").drop("_value")


def compare_stores(reviews: DataFrame, max_neg: int = 2) -> DataFrame:
    """(slug, reviews, avg_rating, with_text, neg_rate_pct, replies, reply_rate_pct, first_year, rank).

    One aggregate per store; ``rank`` orders stores by average rating.
    """
    agg = reviews.groupBy("slug").agg(
        F.count("*").alias("reviews"),
        F.sum("rating").alias("_rs"), F.count("rating").alias("_rn"),
        F.count_if(has_text(F.col("text"))).alias("with_text"),
        F.count_if(is_negative(max_neg)).alias("_neg"),
        F.count_if(has_text(F.col("owner_reply"))).alias("replies"),
        F.min(year_of(F.col("date_abs"))).alias("first_year"))
    out = agg.select(
        "slug", "reviews", round_ratio(F.col("_rs"), F.col("_rn"), 2).alias("avg_rating"),
        "with_text", _pct(F.col("_neg"), F.col("reviews")).alias("neg_rate_pct"),
        "replies", _pct(F.col("replies"), F.col("reviews")).alias("reply_rate_pct"),
        "first_year")
    return global_rank(out, "avg_rating")


def compare_rollup(reviews: DataFrame, max_neg: int = 2) -> DataFrame:
    """Per-store counts plus a grand-total row (``slug`` NULL) via ROLLUP."""
    agg = reviews.rollup("slug").agg(
        F.count("*").alias("reviews"),
        F.sum("rating").alias("_rs"), F.count("rating").alias("_rn"),
        F.count_if(has_text(F.col("text"))).alias("with_text"),
        F.count_if(is_negative(max_neg)).alias("negatives"),
        F.count_if(has_text(F.col("owner_reply"))).alias("replies"))
    return agg.select("slug", "reviews", round_ratio(F.col("_rs"), F.col("_rn"), 2).alias("avg_rating"),
                      "with_text", "negatives", "replies")


def sentiment_share(reviews: DataFrame, max_neg: int = 2) -> DataFrame:
    """Positive (>= 4), neutral (3) and negative (<= max_neg, 0 included) counts and shares."""
    r = F.coalesce(F.col("rating"), F.lit(5))
    agg = reviews.groupBy("slug").agg(
        F.count("*").alias("reviews"),
        F.count_if(r >= 4).alias("positive"),
        F.count_if(r == 3).alias("neutral"),
        F.count_if(r <= max_neg).alias("negative"))
    return agg.select("slug", "reviews", "positive", "neutral", "negative",
                      _pct(F.col("positive"), F.col("reviews")).alias("positive_pct"),
                      _pct(F.col("neutral"), F.col("reviews")).alias("neutral_pct"),
                      _pct(F.col("negative"), F.col("reviews")).alias("negative_pct"))


def photo_share(reviews: DataFrame) -> DataFrame:
    """Reviews with at least one photo, count and share."""
    agg = reviews.groupBy("slug").agg(F.count("*").alias("reviews"),
                                      F.count_if(F.col("photos") > 0).alias("with_photos"),
                                      F.sum("photos").alias("photos"))
    return agg.select("slug", "reviews", "with_photos", "photos",
                      _pct(F.col("with_photos"), F.col("reviews")).alias("photo_pct"))


def period_of(date_str: Column, buckets=()) -> Column:
    """Year as a string, or the label of the first (lo, hi, label) bucket holding it."""
    y = year_of(date_str)
    out = None
    for lo, hi, label in buckets:
        cond = (y >= lo) & (y <= hi)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    plain = y.cast("string")
    return plain if out is None else out.otherwise(plain)


def yearly(reviews: DataFrame, buckets=()) -> DataFrame:
    """(slug, period, reviews, avg_rating): all dated reviews (text not required)."""
    d = reviews.where(has_text(F.col("date_abs")))
    agg = d.groupBy("slug", period_of(F.col("date_abs"), buckets).alias("period")).agg(
        F.count("*").alias("reviews"), F.sum("rating").alias("_rs"), F.count("rating").alias("_rn"))
    return agg.select("slug", "period", "reviews",
                      round_ratio(F.col("_rs"), F.col("_rn"), 2).alias("avg_rating"))


def by_period(reviews: DataFrame, periods: DataFrame) -> DataFrame:
    """(slug, period, reviews, avg_rating) for the periods of a table.

    ``periods`` is (label string, lo date, hi date), both ends included; periods may
    overlap, and a review counts in each that holds its date.  Repeated rows count once; periods
    of one label are united; a null end or lo > hi holds nothing.  Dates that are
    no ``yyyy-MM-dd`` count nowhere, and a period without reviews has no row.

    Reviews are counted per store and day first; days meet the periods that touch
    their month in an equi-join, so there is no pair of every day and period, and no
    review is copied per period.
    """
    day = F.try_to_date(F.col("date_abs"), "yyyy-MM-dd")
    days = (reviews.select("slug", day.alias("day"), "rating").where(F.col("day").isNotNull())
            .groupBy("slug", "day").agg(F.count("*").alias("n"), F.sum("rating").alias("rs"), F.count("rating").alias("rn"))
            .withColumn("month", F.trunc("day", "month")))
    p = periods.select("label", "lo", "hi").where(F.col("lo") <= F.col("hi")).distinct()
    p = p.withColumn("month", F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month"))))
    hit = days.join(p, "month").where(F.col("day").between(F.col("lo"), F.col("hi")))
    hit = hit.select("slug", "label", "day", "n", "rs", "rn").distinct()     # a label may hold a day twice
    return hit.groupBy("slug", F.col("label").alias("period")).agg(
        F.sum("n").alias("reviews"), round_ratio(F.sum("rs"), F.sum("rn"), 2).alias("avg_rating"))


def first_last_year(yearly_df: DataFrame) -> DataFrame:
    """(slug, first_period, first_avg, last_period, last_avg, change)."""
    agg = yearly_df.groupBy("slug").agg(
        F.min("period").alias("first_period"), F.min_by("avg_rating", "period").alias("first_avg"),
        F.max("period").alias("last_period"), F.max_by("avg_rating", "period").alias("last_avg"))
    return agg.withColumn("change", F.round(F.col("last_avg") - F.col("first_avg"), 2))


# Keywords counted as expressions; longer lists go through one automaton per text.
IN_ROW_KEYWORDS = 16


def keyword_counts(reviews: DataFrame, words, lower: bool = False) -> DataFrame:
    """(slug, word, mentions, reviews): substring hits and reviews mentioning each keyword.

    A short list is counted in-row: each keyword is one expression over the text, and
    rows per (text, keyword) carry two numbers, never the text.  A list beyond
    ``IN_ROW_KEYWORDS`` is found in one pass per text (``operators.patterns``).  Every
    keyword has a row for every store with text, also where it occurs nowhere.
    """
    text = F.lower(F.col("text")) if lower else F.col("text")
    words = list(dict.fromkeys(words))
    t = reviews.where(has_text(F.col("text"))).select("slug", text.alias("text"))
    if len(words) <= IN_ROW_KEYWORDS:
        counts = [F.struct(F.lit(w).alias("word"), substring_count(F.col("text"), F.lit(w)).alias("n")) for w in words]
        x = t.select("slug", F.inline(F.array(*counts)))
        return x.groupBy("slug", "word").agg(F.sum("n").alias("mentions"), F.count_if(F.col("n") > 0).alias("reviews"))
    stores = t.select("slug").distinct()
    vocab = stores.select("slug", F.posexplode(F.array(*[F.lit(w) for w in words])).alias("vrank", "word"))
    found = pattern_counts(t, vocab).select(F.col("slug").alias("s"), F.col("word").alias("w"), "count", "texts")
    zero = F.lit(0).cast("long")
    return (vocab.join(found, vocab["slug"].eqNullSafe(F.col("s")) & (F.col("word") == F.col("w")), "left")
            .select("slug", "word", F.coalesce("count", zero).alias("mentions"), F.coalesce("texts", zero).alias("reviews")))


def neg_ratio(reviews: DataFrame, base_slug: str, max_neg: int = 2) -> DataFrame:
    """(slug, neg_rate_pct, base_rate_pct, ratio): negative rate relative to a base store.

    The base rate is a scalar subquery (one value), not a join.  The ratio is
    NULL when the base store has no negative review.
    """
    rates = reviews.groupBy("slug").agg(
        (F.count_if(is_negative(max_neg)) / F.count("*") * 100).alias("rate"))
    base = rates.where(F.col("slug") == base_slug).select("rate").scalar()
    return rates.select("slug", F.round("rate", 4).alias("neg_rate_pct"),
                        F.round(base, 4).alias("base_rate_pct"),
                        F.round(F.try_divide(F.col("rate"), base), 4).alias("ratio"))


def shared_neg_words(neg_words: DataFrame) -> DataFrame:
    """(word, stores, count): negative keywords present in every store's list.

    ``neg_words`` is (slug, rank, word, count) with unique (slug, word); the
    number of stores is a scalar subquery.
    """
    n_stores = neg_words.select(F.count_distinct("slug")).scalar()
    return (neg_words.groupBy("word")
            .agg(F.count("*").alias("stores"), F.sum("count").alias("count"))
            .where(F.col("stores") == n_stores))


def sample_reviews(reviews: DataFrame, word: str, k: int = 3, max_neg: int = 2) -> DataFrame:
    """(slug, sentiment, rank, pos, rating, mentions): top-k quotes mentioning ``word``.

    Ranked by mentions, then scrape position, per store and sentiment; the
    rank filter becomes a ``WindowGroupLimit`` below the shuffle.
    """
    r = F.coalesce(F.col("rating"), F.lit(5))
    x = (reviews.where(has_text(F.col("text")) & F.col("text").contains(word))
         .select("slug", "pos", "rating",
                 F.when(r <= max_neg, "negative").when(r >= 4, "positive")
                 .otherwise("neutral").alias("sentiment"),
                 substring_count(F.col("text"), F.lit(word)).alias("mentions")))
    w = Window.partitionBy("slug", "sentiment").orderBy(F.col("mentions").desc(), F.col("pos"))
    return (x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("slug", "sentiment", "rank", "pos", "rating", "mentions"))
