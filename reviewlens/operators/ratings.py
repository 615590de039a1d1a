"""Rating summaries, histograms, monthly series and trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.config import DEFAULT, RATING_BUCKETS, AnalysisConfig
from reviewlens.functions.dates import month_of
from reviewlens.functions.text import has_text
from reviewlens.operators.clean import dated


def round_ratio(num: Column, den: Column, digits: int) -> Column:
    """num / den rounded half-to-even at ``digits`` decimals, as DOUBLE.

    Exact integer arithmetic on the ratio, so every engine gets the same
    answer (the ratio is rounded, not its binary approximation).  NULL when
    ``den`` is 0.  Both arguments are non-negative integers.
    """
    scale = 10 ** digits
    scaled = num.cast("long") * F.lit(scale)
    d = den.cast("long")
    rem = scaled % d
    q = ((scaled - rem) / d).cast("long")
    up = (rem * 2 > d) | ((rem * 2 == d) & (q % 2 == 1))
    return F.when(d > 0, (q + up.cast("long")) / F.lit(float(scale)))


def is_negative(max_rating: int = 2) -> Column:
    return (F.coalesce(F.col("rating"), F.lit(5)) <= max_rating) & has_text(F.col("text"))


def _hist(buckets) -> list[Column]:
    return [F.count_if(F.col("rating") == b).alias(f"r{b}") for b in buckets]


def store_totals(reviews: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """(slug, total, with_text, text_bytes, rating_sum, rating_n, neg_count, r5 .. r1): the counts
    that the small-corpus guard, the rating summary and the histogram are made of, and the size
    of the texts, in one aggregate.

    Expects echo-cleaned reviews.
    """
    return reviews.groupBy("slug").agg(
        F.count("*").alias("total"),
        F.count_if(has_text(F.col("text"))).alias("with_text"),
        F.sum(F.octet_length("text")).alias("text_bytes"),
        F.sum("rating").alias("rating_sum"),
        F.count("rating").alias("rating_n"),
        F.count_if(is_negative(cfg.neg_max_rating)).alias("neg_count"), *_hist(RATING_BUCKETS))


def rating_summary(reviews: DataFrame, cfg: AnalysisConfig = DEFAULT, totals: DataFrame | None = None) -> DataFrame:
    """(slug, total, with_text, avg_rating, neg_count, neg_rate_pct) per store.

    Expects echo-cleaned reviews, or their ``store_totals``.  The average includes
    unparsed (0) ratings; the negative rate is negatives with text over all reviews,
    in percent.
    """
    agg = store_totals(reviews, cfg) if totals is None else totals
    return agg.select(
        "slug", "total", "with_text",
        round_ratio(F.col("rating_sum"), F.col("rating_n"), 2).alias("avg_rating"),
        "neg_count",
        round_ratio(F.col("neg_count") * 100, F.col("total"), 1).alias("neg_rate_pct"))


def rating_hist(reviews: DataFrame, buckets=RATING_BUCKETS) -> DataFrame:
    """(slug, r5, r4, r3, r2, r1): zero-filled counts per star; 0 has no bucket."""
    return reviews.groupBy("slug").agg(*_hist(buckets))


def monthly_raw(reviews: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """(slug, month, reviews, rating_sum, rating_n, avg_raw): qualifying months only.

    A month qualifies with at least ``min_month_reviews`` dated reviews with
    text; a store's series exists only with at least ``min_months`` such
    months.  The per-store month count is a window over the already
    aggregated (store, month) table, which holds a few hundred rows per store.
    """
    m = (dated(reviews)
         .groupBy("slug", month_of(F.col("date_abs")).alias("month"))
         .agg(F.count("*").alias("reviews"), F.sum("rating").alias("rating_sum"),
              F.count("rating").alias("rating_n"))
         .where(F.col("reviews") >= cfg.min_month_reviews))
    m = m.withColumn("months", F.count("*").over(Window.partitionBy("slug")))
    return (m.where(F.col("months") >= cfg.min_months)
            .withColumn("avg_raw", F.col("rating_sum") / F.col("rating_n")))


def monthly(reviews: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """(slug, month, reviews, avg_rating, avg_raw): the monthly volume/rating series."""
    m = monthly_raw(reviews, cfg)
    return m.select("slug", "month", "reviews",
                    round_ratio(F.col("rating_sum"), F.col("rating_n"), 2).alias("avg_rating"),
                    "avg_raw")


def trend(monthly_df: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """(slug, early_avg, recent_avg, direction) for stores with enough months.

    Early/recent = mean of the unrounded monthly averages of the first/last
    ``trend_window`` qualifying months, each rounded to 2 decimals.
    """
    w = cfg.trend_window
    asc = Window.partitionBy("slug").orderBy(F.col("month").asc())
    desc = Window.partitionBy("slug").orderBy(F.col("month").desc())
    x = (monthly_df.select("slug", "month", "avg_raw")
         .withColumn("ra", F.row_number().over(asc))
         .withColumn("rd", F.row_number().over(desc)))
    t = x.groupBy("slug").agg(
        F.count("*").alias("months"),
        F.avg(F.when(F.col("ra") <= w, F.col("avg_raw"))).alias("early"),
        F.avg(F.when(F.col("rd") <= w, F.col("avg_raw"))).alias("recent"))
    t = (t.where(F.col("months") >= cfg.trend_months)
         .select("slug", F.bround("early", 2).alias("early_avg"),
                 F.bround("recent", 2).alias("recent_avg")))
    d = F.lit(float(cfg.trend_delta))
    return t.withColumn(
        "direction",
        F.when(F.col("recent_avg") < F.col("early_avg") - d, "declining")
        .when(F.col("recent_avg") > F.col("early_avg") + d, "improving")
        .otherwise("stable"))
