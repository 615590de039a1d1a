"""Positional date matching of scraped reviews to API posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordinal(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], name: str = "k",
            pieces: int | None = None) -> DataFrame:
    """Add the 1-based position of each row inside its ``keys`` group.

    ``order`` is a list of (column, ascending); ascending sorts NULLs first,
    descending NULLs last (Spark's defaults).  Same result as
    ``row_number()`` over ``partitionBy(keys).orderBy(order)``, but no group
    has to fit in one task: rows are cut into pieces by value ranges of the
    leading order column (``approxQuantile`` boundaries, a list of at most
    ``pieces`` numbers), ranked inside each (group, piece), and shifted by the
    sizes of the group's earlier pieces.  Piece ids are computed from the
    data, so every branch of the plan agrees on them.  The leading order
    column must be numeric and ``order`` must make rows unique in a group.
    """
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lead, asc = order[0]
    probs = [i / n for i in range(1, n)]
    bounds = sorted(set(df.approxQuantile(lead, probs, 1.0 / (4 * n)))) if n > 1 else []
    v = F.col(lead)
    arr = F.array(*[F.lit(float(b)) for b in bounds]) if bounds else F.array().cast("array<double>")
    if asc:
        piece = F.when(v.isNull(), F.lit(-1)).otherwise(F.size(F.filter(arr, lambda b: b < v)))
    else:
        piece = F.when(v.isNull(), F.lit(len(bounds) + 1)).otherwise(F.size(F.filter(arr, lambda b: b > v)))
    cols = [F.col(c).asc() if a else F.col(c).desc() for c, a in order]
    x = df.withColumn("_piece", piece)
    local = x.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*cols)))
    sizes = x.groupBy(*keys, "_piece").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    # null keys are groups too, as they are for row_number()
    offsets = offsets.withColumnsRenamed({k: f"_o_{k}" for k in keys} | {"_piece": "_o_piece"})
    same = F.col("_piece") == F.col("_o_piece")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return (local.join(offsets, same).drop("_o_piece", *[f"_o_{k}" for k in keys])
            .withColumn(name, (F.col("_off") + F.col("_local")).cast("long"))
            .drop("_piece", "_local", "_off"))


def match_dates(reviews: DataFrame, posts: DataFrame) -> DataFrame:
    """Give the k-th review of a reviewer (scrape order) the k-th newest post of that name.

    Matching is per store and name.  Posts are ordered by timestamp
    descending, equal timestamps by capture order; surplus reviews or posts
    stay unmatched (the review's ``date_abs``/``timestamp_us`` are NULL), as do
    reviews without a name or store.
    Repeated posts are not de-duplicated.  Both sides get their ordinal with
    ``ordinal`` and meet in an equi-join on (slug, name, k), which is unique on
    both sides, so no hot name can skew it.
    """
    r = reviews.drop("date_abs", "timestamp_us")
    r = ordinal(r, ["slug", "name"], [("pos", True)])
    seq = [("arrival", True)] + ([("seq", True)] if "seq" in posts.columns else [])
    p = ordinal(posts.select("slug", "name", "date_abs", "timestamp_us", "arrival",
                             *(["seq"] if "seq" in posts.columns else [])),
                ["slug", "name"], [("timestamp_us", False), *seq])
    p = p.select("slug", "name", "k", "date_abs", "timestamp_us")
    return r.join(p, ["slug", "name", "k"], "left").drop("k")


def match_metrics(matched: DataFrame) -> DataFrame:
    """(slug, count, matched_dates) per store."""
    return matched.groupBy("slug").agg(F.count("*").alias("count"),
                                       F.count("date_abs").alias("matched_dates"))
