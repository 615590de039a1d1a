"""Independent DuckDB SQL for every registered query.

Written from the operator semantics (not generated from the Spark plans);
the adapters are the same SQL texts the Spark side runs.
"""

from __future__ import annotations

from reviewlens.config import PUNCT_TAGS, STOP_WORDS, VERB_TAGS
from reviewlens.plans import adapters as A


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# the white space of Unicode; the engine's own class is ASCII
WS = "[\\s\\pZ\\x{85}\\x0B]"
STRIP = "regexp_replace({x}, '^" + WS.replace("{", "{{").replace("}", "}}") + "+|" \
    + WS.replace("{", "{{").replace("}", "}}") + "+$', '', 'g')"


def _strip(x: str) -> str:
    return STRIP.format(x=x)


CORE = _strip(f"regexp_replace(regexp_replace(owner_reply, '^業主回應{WS}*', ''), "
              f"'^\\pN+{WS}*(年|個月|週|天)前', '')")

REVIEWS = f"reviews AS ({A.REVIEWS_SQL.format(each=A.DUCK_EACH)})"
CLEANED = f"""cleaned AS (
  SELECT slug, pos, name, rating, text_translated, lang, date, owner_reply, photos, date_abs,
    CASE WHEN coalesce(length(owner_reply), 0) > 0 AND coalesce(length(text), 0) > 0
          AND length({CORE}) > 0 AND starts_with({_strip('text')}, left({CORE}, 15))
         THEN coalesce(text_translated, '') ELSE text END AS text
  FROM reviews)"""
KEEP = f"lambda w: length(w) > 1 AND NOT list_contains({_list(STOP_WORDS)}, w)"
HAS = "coalesce(length({x}), 0) > 0"
GUARD = f"""guard AS (
  SELECT slug, count_if({HAS.format(x='text')}) AS count FROM cleaned GROUP BY slug),
okc AS (SELECT * FROM cleaned WHERE slug IN (SELECT slug FROM guard WHERE count >= 3))"""
DOCS = f"""docs AS (
  SELECT slug, pos, list_filter(regexp_extract_all(text, '\\p{{L}}+'), {KEEP}) AS words
  FROM okc WHERE coalesce(length(text), 0) > 0)"""
BASE = f"WITH {REVIEWS},\n{CLEANED},\n{GUARD},\n{DOCS}"


def grams(n: int) -> str:
    if n == 1:
        return "words"
    return (f"CASE WHEN len(words) >= {n} THEN list_transform(range(1, len(words) - {n} + 2), "
            f"lambda i: array_to_string(words[i:i + {n} - 1], ' ')) ELSE [] END")


def tf_ctes(n: int) -> str:
    return f"""g AS (SELECT slug, pos, {grams(n)} AS grams FROM docs),
stats AS (SELECT slug, count(*) AS n_docs, sum(len(grams)) AS total,
          CASE WHEN count(*) > 0 THEN sum(len(grams)) / count(*) ELSE 1.0 END AS avgdl
          FROM g GROUP BY slug),
ex AS (SELECT slug, pos, len(grams) AS dl, unnest(grams) AS term,
       generate_subscripts(grams, 1) - 1 AS i FROM g),
tf AS (SELECT slug, pos, dl, term, count(*) AS f, min(i) AS first_i
       FROM ex GROUP BY slug, pos, dl, term)"""


# a document's share of a score, and its whole part in units of 2**-20: sums of whole
# numbers don't depend on the order of rows
SHARE = "(f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))"
WHOLE = f"floor({SHARE} * 1048576)::BIGINT"


def bm25(n: int, k: int = 100) -> str:
    return f"""{BASE},
{tf_ctes(n)},
sc AS (
  SELECT tf.slug, term, count(*) AS df, max(n_docs) AS n_docs,
    (sum({WHOLE}) + sum(floor(({SHARE} * 1048576 - {WHOLE}) * 1073741824)::BIGINT)::DOUBLE / 1073741824) / 1048576 AS tfn,
    min(pos) AS first_pos, arg_min(first_i, pos) AS first_i
  FROM tf JOIN stats USING (slug) GROUP BY tf.slug, term),
ranked AS (
  SELECT slug, term, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tfn AS score,
    row_number() OVER (PARTITION BY slug ORDER BY
      ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tfn DESC,
      first_pos, first_i) AS rank
  FROM sc)
SELECT slug, {n} AS n, rank, term, round(score, 2) AS score FROM ranked WHERE rank <= {k}"""


WORD_FREQ = f"""{BASE},
{tf_ctes(1)},
wf AS (SELECT slug, term AS word, sum(f) AS count, min(pos) AS first_pos,
       arg_min(first_i, pos) AS first_i FROM tf GROUP BY slug, term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY count DESC, first_pos, first_i) AS rank FROM wf)
SELECT slug, rank, word, count FROM ranked WHERE rank <= 100"""

CORPUS_STATS = f"""{BASE}
SELECT slug, count(*) AS n_docs, sum(len(words)) AS total,
  round(CASE WHEN count(*) > 0 THEN sum(len(words)) / count(*) ELSE 1.0 END, 6) AS avgdl
FROM docs GROUP BY slug"""

DOC_FREQ = f"""{BASE},
{tf_ctes(1)}
SELECT tf.slug, term, count(*) AS df, sum(f) AS tf,
  round(ln((max(n_docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1.0::DOUBLE), 6) AS idf
FROM tf JOIN stats USING (slug) GROUP BY tf.slug, term"""


def rr(num: str, den: str, digits: int) -> str:
    """Exact half-even rounding of num/den (non-negative integers)."""
    sc, d = f"(({num}) * {10 ** digits})", f"({den})"
    return (f"(CASE WHEN {d} > 0 THEN ({sc} // {d} + CASE WHEN 2 * ({sc} % {d}) > {d} OR "
            f"(2 * ({sc} % {d}) = {d} AND ({sc} // {d}) % 2 = 1) THEN 1 ELSE 0 END) "
            f"/ {float(10 ** digits)}::DOUBLE END)")


NEG = "coalesce(rating, 5) <= 2 AND " + HAS.format(x="text")
PRE = f"WITH {REVIEWS},\n{CLEANED}"

REPLY_ECHO = f"{PRE}\nSELECT slug, pos, text FROM cleaned WHERE {HAS.format(x='text')}"
MIN_DOCS_GUARD = f"""{PRE},\n{GUARD}
SELECT slug, count, CASE WHEN count < 3 THEN 'too few texts' ELSE 'ok' END AS status FROM guard"""
NEG_REVIEWS = f"{PRE}\nSELECT slug, pos, rating FROM cleaned WHERE {NEG}"


def _rs(src: str) -> str:
    return f"""SELECT slug, count(*) AS total, count_if({HAS.format(x='text')}) AS with_text,
  {rr('sum(rating)', 'count(rating)', 2)} AS avg_rating, count_if({NEG}) AS neg_count,
  {rr(f'count_if({NEG}) * 100', 'count(*)', 1)} AS neg_rate_pct,
  count_if(rating = 5) AS r5, count_if(rating = 4) AS r4, count_if(rating = 3) AS r3,
  count_if(rating = 2) AS r2, count_if(rating = 1) AS r1
FROM {src} GROUP BY slug"""


RATING_SUMMARY = f"""{PRE}, rs AS ({_rs('cleaned')})
SELECT slug, total, with_text, avg_rating, neg_count, neg_rate_pct FROM rs"""
RATING_HIST = f"""{PRE}, rs AS ({_rs('cleaned')})
SELECT slug, r5, r4, r3, r2, r1 FROM rs"""


def _months(src: str) -> str:
    return f"""m0 AS (
  SELECT slug, left(date_abs, 7) AS month, count(*) AS reviews, sum(rating) AS rating_sum,
    count(rating) AS rating_n
  FROM {src} WHERE {HAS.format(x='date_abs')} AND {HAS.format(x='text')}
  GROUP BY slug, left(date_abs, 7) HAVING count(*) >= 2),
m1 AS (SELECT *, count(*) OVER (PARTITION BY slug) AS months FROM m0),
m AS (SELECT slug, month, reviews, {rr('rating_sum', 'rating_n', 2)} AS avg_rating,
        rating_sum / rating_n AS avg_raw FROM m1 WHERE months >= 3),
tx AS (SELECT slug, month, avg_raw,
         row_number() OVER (PARTITION BY slug ORDER BY month) AS ra,
         row_number() OVER (PARTITION BY slug ORDER BY month DESC) AS rd FROM m),
t0 AS (SELECT slug, round_even(avg(avg_raw) FILTER (WHERE ra <= 3), 2) AS early_avg,
         round_even(avg(avg_raw) FILTER (WHERE rd <= 3), 2) AS recent_avg
       FROM tx GROUP BY slug HAVING count(*) >= 6),
t AS (SELECT slug, early_avg, recent_avg,
        CASE WHEN recent_avg < early_avg - 0.2::DOUBLE THEN 'declining'
             WHEN recent_avg > early_avg + 0.2::DOUBLE THEN 'improving' ELSE 'stable' END AS direction
      FROM t0)"""


MONTHLY = f"{PRE},\n{_months('cleaned')}\nSELECT slug, month, reviews, avg_rating, avg_raw FROM m"
TREND = f"{PRE},\n{_months('cleaned')}\nSELECT slug, early_avg, recent_avg, direction FROM t"

WF_CTE = """wf0 AS (SELECT slug, term AS word, sum(f) AS count, min(pos) AS first_pos,
        arg_min(first_i, pos) AS first_i FROM tf GROUP BY slug, term),
wf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY count DESC,
        first_pos, first_i) AS rank FROM wf0) WHERE rank <= 100)"""
NEG_CTE = f"""negt AS (SELECT slug, text FROM okc WHERE {NEG}),
hits AS (SELECT v.slug, v.word, v.rank AS vrank,
          sum((length(n.text) - length(replace(n.text, v.word, ''))) // length(v.word)) AS count
         FROM negt n JOIN wf v ON n.slug = v.slug GROUP BY v.slug, v.word, v.rank),
neg AS (SELECT * FROM (SELECT slug, word, count, row_number() OVER (PARTITION BY slug
          ORDER BY count DESC, vrank) AS rank FROM hits WHERE count > 0) WHERE rank <= 50)"""

NEG_WORD_FREQ = f"""{BASE},
{tf_ctes(1)},
{WF_CTE},
{NEG_CTE}
SELECT slug, rank, word, count FROM neg"""

SUMMARY = f"""{BASE},
{tf_ctes(1)},
{WF_CTE},
{NEG_CTE},
rs AS ({_rs('okc')}),
{_months('okc')},
lists AS (SELECT slug,
    string_agg(word, '|' ORDER BY rank) FILTER (WHERE rank <= 15) AS top_words,
    string_agg(word, '|' ORDER BY rank) FILTER (WHERE rank <= 10) AS top_keywords
  FROM wf GROUP BY slug),
nlists AS (SELECT slug, string_agg(word, '|' ORDER BY rank) FILTER (WHERE rank <= 5) AS neg_top_words
  FROM neg GROUP BY slug)
SELECT g.slug, rs.total, g.count AS with_text, rs.avg_rating, rs.r5, rs.r4, rs.r3, rs.r2, rs.r1,
  rs.neg_rate_pct,
  CASE WHEN g.count >= 3 THEN coalesce(l.top_words, '') END AS top_words,
  CASE WHEN g.count >= 3 THEN coalesce(l.top_keywords, '') END AS top_keywords,
  CASE WHEN g.count >= 3 THEN coalesce(nl.neg_top_words, '') END AS neg_top_words,
  t.early_avg, t.recent_avg, t.direction,
  CASE WHEN g.count < 3 THEN 'too few texts' END AS error
FROM guard g LEFT JOIN rs USING (slug) LEFT JOIN lists l USING (slug)
  LEFT JOIN nlists nl USING (slug) LEFT JOIN t USING (slug)"""

CHART_MANIFEST = f"""{BASE},
{tf_ctes(1)},
{WF_CTE},
{NEG_CTE},
{_months('okc')},
okg AS (SELECT slug FROM guard WHERE count >= 3)
SELECT slug, c AS chart FROM okg, (VALUES ('word_freq'), ('bm25_unigram'), ('bm25_2gram'), ('bm25_3gram')) v(c)
UNION ALL SELECT slug, 'neg_word_freq' FROM neg GROUP BY slug HAVING count(*) >= 6
UNION ALL SELECT DISTINCT slug, 'monthly_volume_rating' FROM m"""

LABEL = ("CASE WHEN {s} = '' THEN '?' ELSE {s} END").format(
    s=_strip("regexp_replace(term, '[^\\pL\\pN\\pM_\\s\\x{4E00}-\\x{9FFF}]', '', 'g')"))


def bm25_chart() -> str:
    parts = [f"SELECT * FROM ({bm25(n, 25)[len('WITH '):].join(['WITH ', ''])})" for n in (1, 2, 3)]
    body = "\nUNION ALL\n".join(parts)
    return f"""WITH b AS ({body})
SELECT slug, n, rank, {LABEL} AS label, score,
  count(*) OVER (PARTITION BY slug, n) - rank AS bar FROM b"""


NEG_CHART = f"""{BASE},
{tf_ctes(1)},
{WF_CTE},
{NEG_CTE},
nk AS (SELECT *, count(*) OVER (PARTITION BY slug) AS k FROM neg)
SELECT slug, rank, word, count, least(k, 25) - rank AS bar FROM nk WHERE k >= 6 AND rank <= 25"""


# --- ingest ------------------------------------------------------------------
PAYLOADS = f"payloads AS ({A.PAYLOADS_SQL.format(ts_us=A.DUCK_TS_US, ts_ms=A.DUCK_TS_MS)})"
PAYLOAD_FILTER_CTE = """f AS (SELECT * FROM payloads
  WHERE contains(url, 'listugcposts') AND status = 200 AND length(body) > 1000)"""
POSTS_CTE = f"""pb AS (SELECT slug, arrival, CASE WHEN starts_with(body, ')]}}''')
      THEN {_strip('substr(body, 5)')} ELSE body END AS b FROM f),
pj AS (SELECT slug, arrival, CAST(b AS JSON) AS j FROM pb WHERE json_valid(b)),
pe AS (SELECT slug, arrival, unnest(range(CAST(json_array_length(j, '$[2]') AS BIGINT))) AS seq, j
       FROM pj WHERE json_type(j, '$[2]') = 'ARRAY'),
pq AS (SELECT slug, arrival, seq, json_extract(j, '$[2][' || seq || ']') AS post FROM pe),
pr AS (SELECT slug, arrival, seq, json_type(post, '$[0][1][2]') AS tt,
         json_extract(post, '$[0][1][2]') AS tsj, json_extract(post, '$[0][1][4][5][0]') AS nj,
         json_extract_string(post, '$[0][1][4][5][0]') AS ns FROM pq),
posts AS (SELECT slug, coalesce(ns, '') AS name,
    strftime(make_timestamp(CAST(tsj AS BIGINT)), '%Y-%m-%d') AS date_abs,
    CAST(tsj AS BIGINT) AS timestamp_us, arrival, seq
  FROM pr WHERE nj IS NOT NULL AND tt IN ('BIGINT', 'UBIGINT', 'DOUBLE')
    AND CAST(tsj AS DOUBLE) > 1400000000000000)"""
PAYLOAD_FILTER = f"WITH {PAYLOADS},\n{PAYLOAD_FILTER_CTE}\nSELECT slug, arrival, url, status FROM f"
PAYLOAD_POSTS = f"WITH {PAYLOADS},\n{PAYLOAD_FILTER_CTE},\n{POSTS_CTE}\nSELECT * FROM posts"
MATCH_CTE = """mr AS (SELECT slug, pos, name, row_number() OVER (PARTITION BY slug, name ORDER BY pos) AS k
       FROM reviews),
mp AS (SELECT slug, name, date_abs, timestamp_us, row_number() OVER (PARTITION BY slug, name
       ORDER BY timestamp_us DESC, arrival, seq) AS k FROM posts),
matched AS (SELECT mr.slug, mr.pos, mr.name, mp.date_abs, mp.timestamp_us
            FROM mr LEFT JOIN mp USING (slug, name, k))"""
MATCH_BASE = f"WITH {REVIEWS},\n{PAYLOADS},\n{PAYLOAD_FILTER_CTE},\n{POSTS_CTE},\n{MATCH_CTE}"
MATCH_DATES = f"{MATCH_BASE}\nSELECT * FROM matched"
MATCH_METRICS = f"""{MATCH_BASE}
SELECT slug, count(*) AS count, count(date_abs) AS matched_dates FROM matched GROUP BY slug"""

CARDS = f"cards AS ({A.CARDS_SQL.format(**A.DUCK_CARD_BLOCKS)})"
SCALAR_INGEST = f"""WITH {CARDS},
c1 AS (SELECT slug, pos, aria, len(blocks) AS nb,
  CASE WHEN len(blocks) >= 2 THEN coalesce(blocks[1], '') ELSE '' END AS tr,
  CASE WHEN len(blocks) >= 2 THEN coalesce(blocks[2], '') WHEN len(blocks) = 1
       THEN coalesce(blocks[1], '') ELSE '' END AS tx FROM cards),
c2 AS (SELECT *, CASE WHEN tx <> '' THEN tx ELSE tr END AS text FROM c1)
SELECT slug, pos, coalesce(TRY_CAST(regexp_extract(aria, '(\\d)', 1) AS INT), 0) AS rating, text,
  CASE WHEN tr <> '' AND tr <> text THEN tr ELSE '' END AS text_translated FROM c2"""

EN = ("[a-zA-Z\\x{C0}-\\x{FF}\\t\\n\\x{0B}\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
      "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}0-9.,!?''\"()\\-:;]")
DETECT_LANG = f"""WITH {REVIEWS}, t AS (SELECT slug, pos, coalesce(text, '') AS t FROM reviews)
SELECT slug, pos, CASE
  WHEN regexp_matches(t, '[\\x{{3040}}-\\x{{309F}}\\x{{30A0}}-\\x{{30FF}}]') THEN 'ja'
  WHEN regexp_matches(t, '[\\x{{AC00}}-\\x{{D7AF}}]') THEN 'ko'
  WHEN regexp_full_match(replace(t, chr(10), ''), '{EN}+') THEN 'en'
  ELSE 'zh' END AS lang FROM t"""

PLACES = f"places AS ({A.PLACES_SQL})"
SLUGIFY = f"""WITH {PLACES},
p1 AS (SELECT page_id, {_strip("replace(title, ' - Google 地圖', '')")} AS name,
  {_strip("replace(address_label, '地址: ', '')")} AS address,
  regexp_replace(resolved_url, '\\?entry=.*$', '') AS place_url FROM places)
SELECT page_id, name, address, place_url,
  left(lower(trim(regexp_replace(name, '[^\\pL\\p{{Nd}}\\pM\\p{{Pc}}]', '_', 'g'), '_')), 30) AS slug,
  concat(replace(replace(place_url, '!4m6!3m5', '!4m8!3m7'), '!16s', '!9m1!1b1!16s'), '?entry=ttu') AS review_url
FROM p1"""

# --- comparisons ---------------------------------------------------------------
COMPARE_STORES = f"""{PRE},
a AS (SELECT slug, count(*) AS reviews, {rr('sum(rating)', 'count(rating)', 2)} AS avg_rating,
  count_if({HAS.format(x='text')}) AS with_text, {rr(f'count_if({NEG}) * 100', 'count(*)', 1)} AS neg_rate_pct,
  count_if({HAS.format(x='owner_reply')}) AS replies,
  {rr(f"count_if({HAS.format(x='owner_reply')}) * 100", 'count(*)', 1)} AS reply_rate_pct,
  min(TRY_CAST(left(date_abs, 4) AS INT)) AS first_year FROM cleaned GROUP BY slug)
SELECT *, rank() OVER (ORDER BY avg_rating DESC NULLS LAST) AS rank FROM a"""
COMPARE_ROLLUP = f"""{PRE}
SELECT slug, count(*) AS reviews, {rr('sum(rating)', 'count(rating)', 2)} AS avg_rating,
  count_if({HAS.format(x='text')}) AS with_text, count_if({NEG}) AS negatives,
  count_if({HAS.format(x='owner_reply')}) AS replies
FROM cleaned GROUP BY ROLLUP (slug)"""
SENTIMENT_SHARE = f"""{PRE},
a AS (SELECT slug, count(*) AS reviews, count_if(coalesce(rating, 5) >= 4) AS positive,
  count_if(coalesce(rating, 5) = 3) AS neutral, count_if(coalesce(rating, 5) <= 2) AS negative
  FROM cleaned GROUP BY slug)
SELECT *, {rr('positive * 100', 'reviews', 1)} AS positive_pct, {rr('neutral * 100', 'reviews', 1)} AS neutral_pct,
  {rr('negative * 100', 'reviews', 1)} AS negative_pct FROM a"""
PHOTO_SHARE = f"""{PRE},
a AS (SELECT slug, count(*) AS reviews, count_if(photos > 0) AS with_photos, sum(photos) AS photos
  FROM cleaned GROUP BY slug)
SELECT *, {rr('with_photos * 100', 'reviews', 1)} AS photo_pct FROM a"""
YEARLY_CTE = f"""y AS (SELECT slug, CAST(TRY_CAST(left(date_abs, 4) AS INT) AS VARCHAR) AS period,
  count(*) AS reviews, {rr('sum(rating)', 'count(rating)', 2)} AS avg_rating
  FROM cleaned WHERE {HAS.format(x='date_abs')} GROUP BY 1, 2)"""
YEARLY = f"{PRE},\n{YEARLY_CTE}\nSELECT * FROM y"
FIRST_LAST_YEAR = f"""{PRE},\n{YEARLY_CTE},
a AS (SELECT slug, min(period) AS first_period, arg_min(avg_rating, period) AS first_avg,
  max(period) AS last_period, arg_max(avg_rating, period) AS last_avg FROM y GROUP BY slug)
SELECT *, round(last_avg - first_avg, 2) AS change FROM a"""
KEYWORD_COUNTS = f"""{PRE},
t AS (SELECT slug, text FROM cleaned WHERE {HAS.format(x='text')}),
w AS (SELECT unnest(['the', 'and', 'de', 'la', 'und', 'que']) AS word),
c AS (SELECT slug, word, (length(text) - length(replace(text, word, ''))) // length(word) AS c FROM t, w)
SELECT slug, word, sum(c) AS mentions, count_if(c > 0) AS reviews FROM c GROUP BY slug, word"""
NEG_RATIO = f"""{PRE},
r AS (SELECT slug, count_if({NEG}) / count(*) * 100 AS rate FROM cleaned GROUP BY slug),
b AS (SELECT rate FROM r WHERE slug = 'src0')
SELECT slug, round(rate, 4) AS neg_rate_pct, round((SELECT rate FROM b), 4) AS base_rate_pct,
  round(rate / (SELECT rate FROM b), 4) AS ratio FROM r"""
SHARED_NEG_WORDS = f"""{BASE},
{tf_ctes(1)},
{WF_CTE},
{NEG_CTE}
SELECT word, count(*) AS stores, sum(count) AS count FROM neg GROUP BY word
HAVING count(*) = (SELECT count(DISTINCT slug) FROM neg)"""
SAMPLE_REVIEWS = f"""{PRE},
s AS (SELECT slug, pos, rating,
  CASE WHEN coalesce(rating, 5) <= 2 THEN 'negative' WHEN coalesce(rating, 5) >= 4 THEN 'positive'
       ELSE 'neutral' END AS sentiment,
  (length(text) - length(replace(text, 'the', ''))) // 3 AS mentions
  FROM cleaned WHERE {HAS.format(x='text')} AND contains(text, 'the')),
r AS (SELECT *, row_number() OVER (PARTITION BY slug, sentiment ORDER BY mentions DESC, pos) AS rank FROM s)
SELECT slug, sentiment, rank, pos, rating, mentions FROM r WHERE rank <= 3"""


# --- text ----------------------------------------------------------------------
TOKENIZE = f"""{PRE},
t AS (SELECT slug, pos, regexp_extract_all(text, '\\p{{L}}+') AS w FROM cleaned WHERE {HAS.format(x='text')})
SELECT slug, pos, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM t"""
DOCS_ALL = f"""docs AS (
  SELECT slug, pos, list_filter(regexp_extract_all(text, '\\p{{L}}+'), {KEEP}) AS words
  FROM cleaned WHERE {HAS.format(x='text')})"""


def _ng(n: int) -> str:
    return f"""SELECT slug, pos, {n} AS n, unnest(g) AS gram, generate_subscripts(g, 1) - 1 AS i
  FROM (SELECT slug, pos, {grams(n)} AS g FROM docs)"""


NGRAMS = f"""{PRE},\n{DOCS_ALL}
{_ng(2)}
UNION ALL
{_ng(3)}"""

from reviewlens.plans.adapters import FIXTURE_ID2LABEL as _ID2L  # noqa: E402

TAG_LIST = _list([_ID2L[i] for i in range(len(_ID2L))])
LABELS = f"l AS ({A.DUCK_LABELS_SQL})"
SEG_CTE = f"""{LABELS},
c AS (SELECT slug, pos, ws, tag, regexp_extract_all(text, '(?s).') AS chars FROM l),
cm AS (SELECT *, greatest(least(len(chars), len(ws) - 2), 0) AS m FROM c),
ce AS (SELECT slug, pos, len(tag) AS ntag, unnest(chars[1:m]) AS ch,
         unnest(list_zip(ws[2:m + 1], tag[2:m + 1])) AS lt,
         generate_subscripts(chars[1:m], 1) - 1 AS ci FROM cm),
cf AS (SELECT *, CASE WHEN ci = 0 OR lt[1] = 0 THEN 1 ELSE 0 END AS st FROM ce),
cw AS (SELECT *, sum(st) OVER (PARTITION BY slug, pos ORDER BY ci) - 1 AS i FROM cf),
tok AS (SELECT slug, pos, i, string_agg(ch, '' ORDER BY ci) AS word,
  arg_min(CASE WHEN ci + 1 < ntag - 1 THEN coalesce({TAG_LIST}[lt[2] + 1], 'X') ELSE 'X' END, ci) AS tag
  FROM cw GROUP BY slug, pos, i)"""
DECODE_WORDS = f"WITH {SEG_CTE}\nSELECT slug, pos, i, word FROM tok"
TAG_WORDS = f"WITH {SEG_CTE}\nSELECT slug, pos, i, word, tag FROM tok"
KEEP_TOK = (f"NOT list_contains({_list(PUNCT_TAGS)}, tag) AND NOT list_contains({_list(STOP_WORDS)}, word)"
            f" AND NOT (length(word) = 1 AND NOT list_contains({_list(VERB_TAGS)}, tag))")
KEPT_CTE = f"""kept AS (SELECT slug, pos, word, tag,
  row_number() OVER (PARTITION BY slug, pos ORDER BY i) - 1 AS i FROM tok WHERE {KEEP_TOK})"""
KEEP_TOKENS = f"WITH {SEG_CTE},\n{KEPT_CTE}\nSELECT slug, pos, i, word, tag FROM kept"


def bm25_tagged() -> str:
    q = bm25(1)
    body = q[q.index("g AS (SELECT slug, pos"):]
    docs = """docs AS (SELECT l.slug, l.pos, coalesce(list(k.word ORDER BY k.i) FILTER (WHERE k.word IS NOT NULL), []) AS words
  FROM (SELECT slug, pos FROM l) l LEFT JOIN kept k ON l.slug = k.slug AND l.pos = k.pos GROUP BY l.slug, l.pos)"""
    return f"WITH {SEG_CTE},\n{KEPT_CTE},\n{docs},\n{body}"


LIST_STORES = f"WITH {REVIEWS}\nSELECT slug, count(*) AS reviews FROM reviews GROUP BY slug ORDER BY slug"


def _unescape(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


PAGE_CARDS = f"""WITH li AS (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS items FROM pages),
c AS (SELECT page_id, unnest(items) AS li, generate_subscripts(items, 1) - 1 AS card FROM li)
SELECT page_id, CAST(card AS INTEGER) AS card,
  {_strip(_unescape("regexp_extract(li, '<a[^>]*>([^<]*)</a>', 1)"))} AS text,
  {_unescape("regexp_extract(li, '<a[^>]*href=\"([^\"]*)\"', 1)")} AS href,
  CAST(len(regexp_extract_all(li, '<a[ >]')) AS INTEGER) AS links
FROM c"""


# straight from the documents: what the cards were made of, inner cards behind their outer one
PAGE_REVIEWS = f"""WITH d AS (
  SELECT source AS slug, CAST(floor(doc_id / 320) AS BIGINT) AS page, doc_id, 0 AS inner_card,
    concat('u', doc_id % 19) AS name,
    CASE WHEN doc_id % 41 = 0 THEN 0 ELSE 1 + doc_id % 5 END AS rating,
    CASE WHEN doc_id % 3 = 2 THEN {_strip("concat('translated ', text)")} ELSE '' END AS tr,
    CASE WHEN doc_id % 3 = 1 OR doc_id % 6 = 2 THEN {_strip('text')} ELSE '' END AS tx,
    concat(1 + doc_id % 11, ' 個月前') AS date,
    CASE WHEN doc_id % 11 = 5 THEN '業主回應 感謝 & 歡迎' ELSE '' END AS owner_reply,
    doc_id % 3 + CASE WHEN doc_id % 29 = 0 THEN 1 ELSE 0 END AS photos FROM documents
  UNION ALL
  SELECT source, CAST(floor(doc_id / 320) AS BIGINT), doc_id, 1, 'inner', 0, '', '', '', '', 1
  FROM documents WHERE doc_id % 29 = 0),
r AS (SELECT *, page * 4294967296 + row_number() OVER (PARTITION BY slug, page ORDER BY doc_id, inner_card) - 1 AS pos,
        CASE WHEN tx <> '' THEN tx ELSE tr END AS text FROM d),
reviews AS (SELECT slug, CAST(pos AS BIGINT) AS pos, name, CAST(rating AS INT) AS rating, text,
    CASE WHEN tr <> '' AND tr <> text THEN tr ELSE '' END AS text_translated,
    CASE WHEN regexp_matches(text, '[\\x{{3040}}-\\x{{309F}}\\x{{30A0}}-\\x{{30FF}}]') THEN 'ja'
         WHEN regexp_matches(text, '[\\x{{AC00}}-\\x{{D7AF}}]') THEN 'ko'
         WHEN regexp_full_match(replace(text, chr(10), ''), '{EN}+') THEN 'en' ELSE 'zh' END AS lang,
    date, owner_reply, CAST(photos AS INT) AS photos FROM r),
{PAYLOADS},
{PAYLOAD_FILTER_CTE},
{POSTS_CTE},
{MATCH_CTE}
SELECT reviews.*, m.date_abs, m.timestamp_us FROM reviews JOIN matched m USING (slug, pos)"""


# --- chart, buckets, scoring ---------------------------------------------------
WORD_FREQ_CHART = f"""WITH w AS ({WORD_FREQ}), c AS (SELECT * FROM w WHERE rank <= 30)
SELECT slug, rank, word, count, count(*) OVER (PARTITION BY slug) - rank AS bar FROM c"""
YEARLY_BUCKETS = f"""{PRE},
p AS (SELECT rating, slug, CASE WHEN left(date_abs, 4) BETWEEN '2018' AND '2022' THEN '2018-2022'
      ELSE left(date_abs, 4) END AS period FROM cleaned WHERE {HAS.format(x='date_abs')})
SELECT slug, period, count(*) AS reviews, {rr('sum(rating)', 'count(rating)', 2)} AS avg_rating
FROM p GROUP BY slug, period"""
# runs of letters, of digits and of white space; any other character alone
SCORE_LABELS = f"""WITH {REVIEWS},
t AS (SELECT slug, pos, regexp_extract_all(text, '(?s)\\pL+|[\\p{{Nd}}²³¹]+|[\\s\\pZ\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x0B]+|.') AS w
      FROM reviews WHERE {HAS.format(x='text')})
SELECT slug, pos, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM t"""

SCORE_HEADS = f"""WITH {REVIEWS},
t AS (SELECT slug, pos, regexp_extract_all(text, '(?s)\\pL+|[\\p{{Nd}}²³¹]+|[\\s\\pZ\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x0B]+|.') AS w
      FROM reviews WHERE {HAS.format(x='text')}),
x AS (SELECT slug, pos, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM t)
SELECT *, CASE WHEN regexp_matches(word, '^\\pL') THEN 'letter' WHEN regexp_matches(word, '^[\\p{{Nd}}²³¹]') THEN 'digit'
  WHEN regexp_matches(word, '^[\\s\\pZ\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x0B]') THEN 'space' ELSE 'other' END AS tag FROM x"""
PERIOD_RATINGS = f"""{PRE},
d AS (SELECT slug, rating, TRY_CAST(date_abs AS DATE) AS day FROM cleaned WHERE {HAS.format(x='date_abs')}),
p AS (SELECT DISTINCT year(day) AS y FROM d WHERE day IS NOT NULL)
SELECT slug, y || '-' || (y + 3) AS period, count(*) AS reviews, {rr('sum(rating)', 'count(rating)', 2)} AS avg_rating
FROM d JOIN p ON day BETWEEN make_date(y, 7, 1) AND make_date(y + 3, 6, 30) GROUP BY slug, y"""
LISTED_DOCS = f"""WITH {REVIEWS},
{CLEANED},
stop AS (SELECT list(DISTINCT w) AS l FROM (SELECT unnest(regexp_extract_all(text, '\\p{{L}}+')) AS w FROM benchmark)),
k AS (SELECT slug, pos, list_filter(regexp_extract_all(text, '\\p{{L}}+'), {KEEP}) AS words
      FROM cleaned WHERE {HAS.format(x='text')}),
e AS (SELECT slug, pos, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM k),
o AS (SELECT slug, pos, list(word ORDER BY i) AS words FROM e
      WHERE word NOT IN (SELECT unnest(l) FROM stop) GROUP BY slug, pos)
SELECT k.slug, k.pos, coalesce(len(o.words), 0) AS n_words,
  sha256(coalesce(array_to_string(o.words, ' '), '')) AS words_sha256
FROM k LEFT JOIN o ON k.pos = o.pos AND k.slug IS NOT DISTINCT FROM o.slug"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query key."""
    return {
        "bm25_unigram": bm25(1),
        "bm25_2gram": bm25(2),
        "bm25_3gram": bm25(3),
        "word_freq": WORD_FREQ,
        "corpus_stats": CORPUS_STATS,
        "doc_freq": DOC_FREQ,
        "reply_echo": REPLY_ECHO,
        "min_docs_guard": MIN_DOCS_GUARD,
        "neg_reviews": NEG_REVIEWS,
        "rating_summary": RATING_SUMMARY,
        "rating_hist": RATING_HIST,
        "monthly": MONTHLY,
        "trend": TREND,
        "neg_word_freq": NEG_WORD_FREQ,
        "summary": SUMMARY,
        "chart_manifest": CHART_MANIFEST,
        "bm25_chart": bm25_chart(),
        "neg_chart": NEG_CHART,
        "payload_filter": PAYLOAD_FILTER,
        "payload_posts": PAYLOAD_POSTS,
        "match_dates": MATCH_DATES,
        "match_metrics": MATCH_METRICS,
        "scalar_ingest": SCALAR_INGEST,
        "detect_lang": DETECT_LANG,
        "slugify": SLUGIFY,
        "compare_stores": COMPARE_STORES,
        "compare_rollup": COMPARE_ROLLUP,
        "sentiment_share": SENTIMENT_SHARE,
        "photo_share": PHOTO_SHARE,
        "yearly": YEARLY,
        "first_last_year": FIRST_LAST_YEAR,
        "keyword_counts": KEYWORD_COUNTS,
        "neg_ratio": NEG_RATIO,
        "shared_neg_words": SHARED_NEG_WORDS,
        "sample_reviews": SAMPLE_REVIEWS,
        "tokenize": TOKENIZE,
        "ngrams": NGRAMS,
        "decode_words": DECODE_WORDS,
        "tag_words": TAG_WORDS,
        "keep_tokens": KEEP_TOKENS,
        "bm25_tagged": bm25_tagged(),
        "list_stores": LIST_STORES,
        "page_cards": PAGE_CARDS,
        "page_reviews": PAGE_REVIEWS,
        "word_freq_chart": WORD_FREQ_CHART,
        "yearly_buckets": YEARLY_BUCKETS,
        "score_labels": SCORE_LABELS,
        "score_heads": SCORE_HEADS,
        "period_ratings": PERIOD_RATINGS,
        "listed_docs": LISTED_DOCS,
    }
