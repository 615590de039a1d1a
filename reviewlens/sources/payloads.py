"""Captured review-list API responses -> posts with absolute timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.config import JSON_GUARD_PREFIX, MAX_POST_MICROS, MIN_POST_MICROS, REVIEW_API_MARKER
from reviewlens.functions.dates import micros_to_date
from reviewlens.functions.text import ustrip

# JSON paths inside one post (positional arrays, not objects).
TS_PATH = "$[0][1][2]"
NAME_PATH = "$[0][1][4][5][0]"
INTEGRAL = ("TINYINT", "SMALLINT", "INT", "BIGINT")


def filter_payloads(df: DataFrame, marker: str = REVIEW_API_MARKER, min_len: int = 1000) -> DataFrame:
    """Responses of the review-list API: URL has the marker, status 200, body > min_len chars."""
    return df.where(F.col("url").contains(marker) & (F.col("status") == 200)
                    & (F.length("body") > min_len))


def parse_payload(body) -> Column:
    """Body -> VARIANT; drops the anti-hijacking prefix; NULL when not JSON."""
    b = F.col(body) if isinstance(body, str) else body
    cleaned = F.when(b.startswith(JSON_GUARD_PREFIX),
                     ustrip(F.substr(b, F.lit(len(JSON_GUARD_PREFIX) + 1)))).otherwise(b)
    return F.try_parse_json(cleaned)


def explode_posts(payloads: DataFrame, tz: str = "UTC") -> DataFrame:
    """(slug, name, date_abs, timestamp_us, arrival, seq): one row per usable post.

    Posts are element 2 of the top-level array.  A post is skipped when its
    timestamp or name path is missing, or its timestamp is not a number above
    the plausibility threshold and before the year 10000; a JSON-null name becomes ''.  ``arrival`` is
    the capture order of the response, ``seq`` the post's index inside it.
    """
    v = payloads.select("slug", "arrival", parse_payload("body").alias("v"))
    posts = v.select("slug", "arrival",
                     F.posexplode_outer(F.try_variant_get("v", "$[2]", "array<variant>")).alias("seq", "post"))
    posts = posts.where(F.col("seq").isNotNull())
    ts_v = F.try_variant_get("post", TS_PATH, "variant")
    kind = F.schema_of_variant(ts_v)
    ts = (F.when(kind.isin(*INTEGRAL), F.try_variant_get("post", TS_PATH, "long"))
          .when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"),
                F.try_variant_get("post", TS_PATH, "double").try_cast("long")))
    ts_d = (F.when(kind.isin(*INTEGRAL), F.try_variant_get("post", TS_PATH, "double"))
            .when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"),
                  F.try_variant_get("post", TS_PATH, "double")))
    name_v = F.try_variant_get("post", NAME_PATH, "variant")
    x = posts.select("slug", "arrival", "seq", ts.alias("timestamp_us"), ts_d.alias("ts_d"),
                     name_v.alias("name_v"),
                     F.coalesce(F.try_variant_get("post", NAME_PATH, "string"), F.lit("")).alias("name"))
    x = x.where(F.col("name_v").isNotNull() & (F.col("ts_d") > F.lit(float(MIN_POST_MICROS)))
                & (F.col("timestamp_us") < F.lit(MAX_POST_MICROS)))
    return x.select("slug", "name", micros_to_date(F.col("timestamp_us"), tz).alias("date_abs"),
                    "timestamp_us", "arrival", "seq")
