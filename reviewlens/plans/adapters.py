"""Stand-in inputs built from the provided test tables.

Each adapter is one SQL text that both Spark and DuckDB run, so a query and
its oracle start from identical rows.  The adapters only shape rows into the
schemas the operators expect; none of them does an operator's work.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from reviewlens.session import balance

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# reviews: one review per document with its whole text; store = source, scrape
# position = doc_id.  Reviews without text or name and replies that echo the
# review (after a plain, ideographic or no-break space) are extra rows at
# negative positions (k 1 and 2), made in place from one reading of the tables.
REVIEWS_SQL = """
WITH base AS (
  SELECT d.doc_id, d.source AS slug, concat('u', cast(d.doc_id % 19 AS string)) AS name,
    cast(CASE WHEN d.doc_id % 41 = 0 THEN 0 WHEN l.toxic = 1 THEN 1
              WHEN l.quality = 0 THEN 2 ELSE 3 + d.doc_id % 3 END AS int) AS rating,
    d.text, d.lang, concat(cast(1 + d.doc_id % 11 AS string), ' 個月前') AS date,
    CASE WHEN d.doc_id % 11 = 5 THEN '業主回應 2 週前感謝您的支持' ELSE '' END AS owner_reply,
    cast(d.doc_id % 3 AS int) AS photos,
    CASE WHEN d.doc_id % 13 = 0 THEN NULL
         ELSE cast(date '2022-01-01' + cast((d.doc_id * 37) % 499 AS int) AS string) END AS date_abs
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT slug, CASE k WHEN 0 THEN doc_id WHEN 1 THEN -1 - 3 * doc_id ELSE -2 - 3 * doc_id END AS pos,
  CASE WHEN k <> 1 OR doc_id % 2 = 0 THEN name END AS name, rating, CASE WHEN k = 1 THEN '' ELSE text END AS text,
  CASE WHEN k = 2 AND doc_id % 3 = 0 THEN concat('translated ', text) ELSE '' END AS text_translated, lang, date,
  CASE WHEN k = 2 THEN concat('業主回應', CASE doc_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN '\u3000' ELSE '\u00a0' END,
                              '3 個月前', text) ELSE owner_reply END AS owner_reply, photos, date_abs
FROM base {each}
"""
_KINDS = "0, CASE WHEN doc_id % 7 = 6 THEN 1 END, CASE WHEN doc_id % 11 = 3 THEN 2 END"
SPARK_EACH = f"LATERAL VIEW explode(array_compact(array({_KINDS}))) v AS k"
DUCK_EACH = f", unnest(list_filter([{_KINDS}], lambda x: x IS NOT NULL)) AS v(k)"

# posts: review-list API posts (purchase events); name pool u0..u16, so the
# reviewers u17 and u18 never find a post.
POSTS_SQL = """
SELECT concat('src', cast(event_id % 20 AS string)) AS slug,
  concat('u', cast(user_id % 17 AS string)) AS name, ts, event_id AS arrival
FROM events WHERE event_type = 'purchase'
"""

# payloads: captured API responses, one per event.  Review-list URLs carry the
# marker; some responses failed; a few bodies are not JSON and a few carry a
# millisecond (too small) timestamp.  Element 3 pads the body like the real
# responses' other fields.  `ts_us` is the event time in epoch microseconds,
# computed by each engine's own function (see payloads_sql).
PAYLOADS_SQL = """
SELECT concat('src', cast(event_id % 20 AS string)) AS slug,
  concat('https://maps.example.com/maps/rpc/',
         CASE WHEN event_type = 'purchase' THEN 'listugcposts' ELSE 'photos' END,
         '?id=', cast(event_id AS string)) AS url,
  CASE WHEN user_id % 23 = 0 THEN 503 ELSE 200 END AS status,
  CASE WHEN event_id % 89 = 0 THEN concat('nope', repeat('x', 1200))
       ELSE concat(')]}}', chr(39), chr(10), '[null,null,[[["id', cast(event_id AS string), '",[0,0,',
                   cast(CASE WHEN event_id % 97 = 0 THEN {ts_ms} ELSE {ts_us} END AS string),
                   ',0,[0,0,0,0,0,["u', cast(user_id % 17 AS string), '"]]]]]],"',
                   repeat('p', 1100), '"]') END AS body,
  event_id AS arrival
FROM events
"""

SPARK_TS_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
SPARK_TS_MS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000"
DUCK_TS_US = "epoch_us(ts)"
DUCK_TS_MS = "epoch_us(ts) // 1000"

# labels_in: per-character segmentation labels (0 = a word starts here) and
# part-of-speech label ids for every review text; index 0 is the start marker
# and the last entry the end marker.  Values follow a fixed arithmetic rule.
LABELS_SQL = """
SELECT d.source AS slug, d.doc_id AS pos, d.text AS text,
  transform(sequence(0, length(d.text) + 1), i -> CAST(CASE WHEN (d.doc_id * 31 + (i % 1000) * (i % 1000) * 7) % 5 = 0 THEN 0 ELSE 1 END AS INT)) AS ws,
  transform(sequence(0, length(d.text) + 1), i -> CAST((d.doc_id + i * 7) % 13 AS INT)) AS tag
FROM documents d
"""
DUCK_LABELS_SQL = """
SELECT d.source AS slug, d.doc_id AS pos, d.text AS text,
  list_transform(range(0, length(d.text) + 2), lambda i: CAST(CASE WHEN (d.doc_id * 31 + (i % 1000) * (i % 1000) * 7) % 5 = 0 THEN 0 ELSE 1 END AS INT)) AS ws,
  list_transform(range(0, length(d.text) + 2), lambda i: CAST((d.doc_id + i * 7) % 13 AS INT)) AS tag
FROM documents d
"""

# id -> tag name for the label fixture (13 ids).
FIXTURE_ID2LABEL = {0: "Na", 1: "VC", 2: "Nh", 3: "Nc", 4: "D", 5: "VH", 6: "PERIODCATEGORY",
                    7: "COMMACATEGORY", 8: "P", 9: "Neu", 10: "Nf", 11: "DE", 12: "VA"}

# cards: rating label and text blocks of a review card, per document; cards
# without a block are extra rows.
CARDS_SQL = """
SELECT d.source AS slug, d.doc_id AS pos,
  CASE WHEN d.doc_id % 41 = 0 THEN 'none'
       ELSE concat(cast(1 + d.doc_id % 5 AS string), CASE WHEN d.doc_id % 2 = 0 THEN '.5' ELSE '' END, ' 顆星') END AS aria,
  CASE d.doc_id % 3 WHEN 0 THEN {one} WHEN 1 THEN {two_a} ELSE {two_b} END AS blocks
FROM documents d
UNION ALL
SELECT d.source, -1 - d.doc_id, 'none', {empty} FROM documents d WHERE d.doc_id % 4 = 0
"""
SPARK_CARD_BLOCKS = dict(empty="array()", one="array(d.text)",
                         two_a="array(concat('translated ', d.text), d.text)", two_b="array(d.text, '')")
DUCK_CARD_BLOCKS = dict(empty="[]::VARCHAR[]", one="[d.text]",
                        two_a="[concat('translated ', d.text), d.text]", two_b="[d.text, '']")

# review_pages: pages of review cards, some 16 to a page.  Every third card has no text block,
# one or two of them; every 29th holds another card.
REVIEW_PAGES_SQL = """
WITH c AS (
  SELECT source AS slug, cast(floor(doc_id / 320) AS bigint) AS page, doc_id,
    replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM documents),
h AS (
  SELECT slug, page, doc_id, concat(
    '<div class="x jftiEf"><div class="d4r55"> u', cast(doc_id % 19 AS string), '\n</div><p>',
    CASE WHEN doc_id % 41 = 0 THEN '' ELSE concat('<span class="kvMYJc" aria-label="', cast(1 + doc_id % 5 AS string),
      CASE WHEN doc_id % 2 = 0 THEN '.5' ELSE '' END, ' 顆星"><img></span>') END,
    '<span class="rsqaWe">', cast(1 + doc_id % 11 AS string), ' 個月前</span>',
    CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('<div class="wiI7pd"><b>', t, '</b></div>')
      ELSE concat('<div class="wiI7pd">translated ', t, '</div><div class="wiI7pd">', CASE WHEN doc_id % 2 = 0 THEN t ELSE '' END, '</div>') END,
    CASE WHEN doc_id % 11 = 5 THEN '<div class="CDe7pd"><span>業主回應</span> 感謝 &amp; 歡迎 </div>' ELSE '' END,
    repeat('<button class="Tya61d"></button>', cast(doc_id % 3 AS int)),
    CASE WHEN doc_id % 29 = 0 THEN '<div class="jftiEf"><i class="d4r55">inner</i><button class="a Tya61d"></button></div>' ELSE '' END,
    '</div>') AS card FROM c)
SELECT slug, page, concat('<html><body>', {joined}, '</body></html>') AS html FROM h GROUP BY slug, page
"""
SPARK_JOINED = "listagg(card, '') WITHIN GROUP (ORDER BY doc_id)"
DUCK_JOINED = "string_agg(card, '' ORDER BY doc_id)"

# places: what resolving a short link yields: page title, address label and
# the final URL (place path segments, sometimes an ``?entry=`` tail).
PLACES_SQL = """
SELECT page_id,
  concat(regexp_extract(html, '<title>(.*?)</title>', 1), ' - Google 地圖') AS title,
  concat('地址: ', url) AS address_label,
  concat(url, '/data=!4m6!3m5!1s', cast(page_id AS string), '!16s%2Fg%2F', cast(page_id % 7 AS string),
         CASE WHEN page_id % 3 = 0 THEN '?entry=ttu&g_ep=Eg' ELSE '' END) AS resolved_url
FROM pages
"""


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the provided Parquet tables as temp views."""
    for t in names:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            spark.read.parquet(p).createOrReplaceTempView(t)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table; under-split scans are spread over the cores (``balance``)."""
    return balance(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))


def _with_views(spark: SparkSession, sf_dir: str, names) -> None:
    for t in names:
        table(spark, sf_dir, t).createOrReplaceTempView(t)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    _with_views(spark, sf_dir, ("documents", "labels"))
    return spark.sql(REVIEWS_SQL.format(each=SPARK_EACH))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _with_views(spark, sf_dir, ("events",))
    return spark.sql(POSTS_SQL)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    _with_views(spark, sf_dir, ("events",))
    return spark.sql(PAYLOADS_SQL.format(ts_us=SPARK_TS_US, ts_ms=SPARK_TS_MS))


def labels_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    _with_views(spark, sf_dir, ("documents",))
    return spark.sql(LABELS_SQL)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    _with_views(spark, sf_dir, ("documents",))
    return spark.sql(CARDS_SQL.format(**SPARK_CARD_BLOCKS))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    _with_views(spark, sf_dir, ("pages",))
    return spark.sql(PLACES_SQL)


def review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    _with_views(spark, sf_dir, ("documents",))
    return spark.sql(REVIEW_PAGES_SQL.format(joined=SPARK_JOINED))
