"""Cleaning and subset filters over the ``reviews`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.text import has_text, is_reply_echo


def strip_reply_echo(reviews: DataFrame) -> DataFrame:
    """Blank out review text that merely echoes the owner's reply.

    When the reply (without its header and relative age) is non-empty and the
    stripped text starts with its first 15 characters, the text becomes the
    translation, or ``''``.
    """
    echo = is_reply_echo(F.col("text"), F.col("owner_reply"))
    return reviews.withColumn(
        "text", F.when(echo, F.coalesce(F.col("text_translated"), F.lit("")))
        .otherwise(F.col("text")))


def with_text(reviews: DataFrame) -> DataFrame:
    """Reviews whose text is non-empty."""
    return reviews.where(has_text(F.col("text")))


def negatives(reviews: DataFrame, max_rating: int = 2) -> DataFrame:
    """Negative reviews with text; a missing rating counts as 5, 0 counts as negative."""
    return reviews.where((F.coalesce(F.col("rating"), F.lit(5)) <= max_rating)
                         & has_text(F.col("text")))


def dated(reviews: DataFrame) -> DataFrame:
    """Reviews with an absolute date and text."""
    return reviews.where(has_text(F.col("date_abs")) & has_text(F.col("text")))


def doc_counts(reviews: DataFrame) -> DataFrame:
    """(slug, count) of reviews with text; one partial+final aggregate."""
    return (reviews.groupBy("slug")
            .agg(F.count_if(has_text(F.col("text"))).alias("count")))


def guard_min_docs(reviews: DataFrame, min_docs: int = 3) -> DataFrame:
    """Per store: its text count and ``ok`` or ``too few texts``."""
    return guard_status(doc_counts(reviews), min_docs)


def guard_status(counts: DataFrame, min_docs: int = 3) -> DataFrame:
    """``counts`` (slug, count, ...) with the guard's ``status``."""
    return (counts
            .withColumn("error", F.when(F.col("count") < min_docs, F.lit("too few texts")))
            .withColumn("status", F.coalesce(F.col("error"), F.lit("ok")))
            .drop("error"))


def keep_analyzable(reviews: DataFrame, min_docs: int = 3, n_stores: int | None = None) -> DataFrame:
    """Reviews of stores that pass the small-corpus guard.

    A left-semi join against the passing slugs, broadcast when ``n_stores``
    bounds the list under the limit; otherwise the semi join is shuffled and
    a store holding a large share of the rows is split by AQE skew handling.
    """
    from reviewlens.session import broadcast_if
    ok = doc_counts(reviews).where(F.col("count") >= min_docs).select("slug")
    return reviews.join(broadcast_if(ok, n_stores), "slug", "left_semi")
