"""Line dedup by site-relative frequency.

A line is boilerplate on a host when it stands on more than ``ratio`` of the
host's pages (and on ``min_pages`` of them at least).  Pages are rows; a line
counts once a page.  Counting moves only line hashes, pre-summed per map task,
so a line or host that a third of all pages share is no hot key.

The ratio is half of a tenth: what a template puts on a tenth of a host's pages
has to go from every such host, and its count scatters by chance, so a ratio at
a tenth itself would drop it on some hosts and keep it on others.  Half the share
is sqrt(n) / 6 standard deviations below for a host of n pages (3.7 at 500).
The ratio is relative to one host: a passage copied to a few pages of many hosts
is not boilerplate of any and stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import fresh, saved

RATIO = 0.05
MIN_PAGES = 5
BROADCAST_BYTES = 32 << 20
# Unicode white space; Java's and RE2's regexes both read this
INK = r"[^\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _ink(line: Column) -> Column:
    """Whether a line holds anything but white space."""
    return line.rlike(INK)


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text",
                ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): the hashes of every host's boilerplate lines.

    A host has at most (lines per page / ratio) of them.
    """
    pages = docs.select(
        F.col(host).alias("host"),
        F.array_distinct(F.transform(F.filter(_lines(F.col(text)), _ink), lambda x: F.xxhash64(x))).alias("all"))
    per_line = (pages.select("host", F.explode("all").alias("line"))
                .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
                .filter(F.col("n") >= min_pages))
    totals = docs.groupBy(F.col(host).alias("h")).agg(F.count(F.lit(1)).alias("total"))
    return (per_line.join(totals, F.col("host").eqNullSafe(F.col("h")))
            .filter(F.col("n") > F.lit(ratio) * F.col("total"))
            .groupBy("host").agg(F.collect_set("line").alias("lines")))


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text",
               ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines cut out of ``text``, and n_lines, n_dropped.

    Lines are what newlines separate, compared byte for byte; blank lines (Unicode white
    space alone, so also the carriage return that a CRLF text leaves) stay.
    A page all of whose lines are boilerplate keeps its text (n_dropped 0):
    such pages are copies, which the near-dedup decides on.  A null text stays
    null (n_lines 0); a null host is a host of its own.  Other columns stay, but for
    older n_lines and n_dropped, which are replaced.  An empty table stays empty.
    """
    marks = saved(boilerplate(docs, host, text, ratio, min_pages), "lines")
    size = marks.agg(F.sum(F.size("lines") * 8 + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:                      # measured, not guessed
        marks = F.broadcast(marks)
    same, marked, split, kept = fresh(docs, "host_of", "marked", "split", "kept")
    marks = marks.select(F.col("host").alias(same), F.col("lines").alias(marked))
    mine = F.col(kept)
    out = (docs.join(marks, F.col(host).eqNullSafe(F.col(same)), "left")
           .withColumn(split, _lines(F.col(text)))
           .withColumn(kept, F.when(F.col(marked).isNull(), F.col(split)).otherwise(
               F.filter(split, lambda x: ~_ink(x) | ~F.array_contains(F.col(marked), F.xxhash64(x)))))
           .withColumn(kept, F.when(F.exists(mine, _ink), mine).otherwise(F.col(split))))
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(split))
    lost = F.when(F.col(text).isNull(), 0).otherwise(F.size(split) - F.size(mine))
    cut = F.when(F.size(mine) < F.size(split), F.array_join(mine, "\n")).otherwise(F.col(text))
    n_lines, n_dropped = fresh(docs, "n_new", "n_lost")
    out = out.withColumns({n_lines: n.cast("long"), n_dropped: lost.cast("long"), text: cut})
    own = [f"`{c}`" for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*own, F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"))


ORACLE_SQL = f"""
WITH l AS (
  SELECT d.doc_id, d.source, d.text, u.i, string_split(d.text, chr(10))[u.i] AS line
  FROM documents d, unnest(range(1, len(string_split(d.text, chr(10))) + 1)) AS u(i)),
tot AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
freq AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM l WHERE regexp_matches(line, '{INK}')
         GROUP BY source, line),
bad AS (SELECT f.source, f.line FROM freq f JOIN tot t ON f.source IS NOT DISTINCT FROM t.source
        WHERE f.n >= {MIN_PAGES} AND f.n > {RATIO} * t.total),
marked AS (SELECT l.*, b.line IS NOT NULL AS bad
           FROM l LEFT JOIN bad b ON b.source IS NOT DISTINCT FROM l.source AND b.line = l.line),
kept AS (
  SELECT doc_id, any_value(source) AS source, any_value(text) AS text, count(*) AS n_lines,
    count(*) FILTER (bad) AS n_bad, bool_or(NOT bad AND regexp_matches(line, '{INK}')) AS has_own,
    string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad) AS cut
  FROM marked GROUP BY doc_id)
SELECT doc_id, source, n_lines::BIGINT AS n_lines,
  (CASE WHEN has_own THEN n_bad ELSE 0 END)::BIGINT AS n_dropped,
  CASE WHEN has_own AND n_bad > 0 THEN cut ELSE text END AS text
FROM kept
"""


def op8(spark, docs: DataFrame) -> DataFrame:
    """Query op8: (doc_id, source, n_lines, n_dropped, text) of every document."""
    return drop_lines(docs.select("doc_id", "source", "text")).select(
        "doc_id", "source", "n_lines", "n_dropped", "text")
