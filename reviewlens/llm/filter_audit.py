"""Filter interaction audit by contractions of a contingency tensor.

Every document fails or passes each of five filters.  How many documents fall into
each of the 2 x 2 x 2 x 2 x 2 cells is all that any order of the filters depends
on: Spark counts the cells of every part in one pass, and each of the 120 orders'
steps is a contraction of that tensor which picks pass, fail or all along each axis.

The texts are read once and never shuffled.  Sameness of texts is decided on
SHA-256 digests: rows are first summed by (digest, id, part), so a text or id that a
third of all rows share is a few rows before any join, and the join back is on
(digest, smallest id), which no group of copies makes hot.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import saved, table

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
PASS, FAIL, ALL = 0, 1, 2
_PICK = np.array([[1, 0], [0, 1], [1, 1]], np.int64)             # weights of (passing, failing) documents
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_failures(rows: DataFrame, text: str) -> dict[str, Column]:
    """What A to D find wrong, over columns ``n_words`` and ``n_distinct`` of ``rows``."""
    t = F.col(text)
    return {
        "A": F.col("n_words") < 200,
        "B": F.col("n_distinct").cast("long") * 100 < F.col("n_words").cast("long") * 50,
        "C": F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long") * 100 > F.length(t).cast("long") * 3,
        "D": t.rlike("[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cell, n, good, toxic): the non-empty cells of every part's tensor.

    ``cell`` numbers the cell with filter A's bit first.  ``docs`` needs doc_id, text
    and lang, ``labels`` doc_id, quality and toxic; other columns are not looked at.  A
    null text is empty, a null lang the part ''.  E compares doc_ids only, so repeated
    rows of one doc_id do not fail each other, and rows without doc_id fail nobody,
    pass E and have no label.  A document is good (toxic) if any of its label rows
    says 1.  An empty table has no parts.
    """
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("part"), F.col("doc_id").alias("id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    rows = rows.select("part", "id", "text", F.size("words").alias("n_words"),
                       F.size(F.array_distinct("words")).alias("n_distinct"))
    bits = F.lit(0)
    for name, fails in text_failures(rows, "text").items():
        bits = bits + F.when(fails, 1 << (len(FILTERS) - 1 - FILTERS.index(name))).otherwise(0)
    rows = (rows.select("part", "id", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("bits"))
            .groupBy("digest", "id", "part", "bits").agg(F.count(F.lit(1)).alias("n")))
    rows = saved(rows, "audit")
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = (labels.groupBy(F.col("doc_id").alias("id"))
             .agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("is_good"),
                  F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("is_toxic")))
    named = (rows.filter(F.col("id").isNotNull()).join(first.filter(F.col("id").isNotNull()), ["digest", "id"], "left")
             .join(marks, "id", "left")
             .select("part", "n", (F.col("bits") + F.when(F.col("first"), 0).otherwise(1)).alias("cell"),
                     F.coalesce("is_good", F.lit(0)).alias("is_good"), F.coalesce("is_toxic", F.lit(0)).alias("is_toxic")))
    nameless = rows.filter(F.col("id").isNull()).select(
        "part", "n", F.col("bits").alias("cell"), F.lit(0).alias("is_good"), F.lit(0).alias("is_toxic"))
    return (named.unionByName(nameless).groupBy("part", "cell")
            .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("is_good")).alias("good"),
                 F.sum(F.col("n") * F.col("is_toxic")).alias("toxic")))


def _contract(tensors: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """(measure, step) sums of ``tensors`` (measure, 2, 2, 2, 2, 2) where step s takes
    ``picks[s, axis]`` (PASS, FAIL or ALL) along each axis."""
    w = _PICK[picks]
    return np.einsum("mabcde,sa,sb,sc,sd,se->ms", tensors, *(w[:, k] for k in range(picks.shape[1])), optimize=True)


def steps(tensors: np.ndarray) -> pd.DataFrame:
    """All orders' steps of one part; ``tensors`` holds the counts of all, good and
    toxic documents as (3, 2, 2, 2, 2, 2)."""
    n = len(FILTERS)
    orders = list(itertools.permutations(range(n)))
    at = np.array([o[k] for o in orders for k in range(n)])      # the filter of each step
    row = np.arange(len(at))
    here = np.full((len(at), n), ALL)
    for s, o in enumerate(orders):
        for k in range(n):
            here[s * n + k, list(o[:k])] = PASS
    kept, alone, any_order = here.copy(), np.full_like(here, PASS), np.full_like(here, ALL)
    kept[row, at] = PASS
    for picks in (here, alone, any_order):
        picks[row, at] = FAIL
    removed, good, toxic = _contract(tensors, here)
    count = tensors[:1]
    return pd.DataFrame({
        "filter_order": np.repeat(["".join(FILTERS[k] for k in o) for o in orders], n),
        "step": np.tile(np.arange(1, n + 1), len(orders)).astype(np.int32),
        "kept": _contract(count, kept)[0], "removed": removed,
        "redundant": _contract(count, any_order)[0] - removed, "unique_fails": _contract(count, alone)[0],
        "good_lost": good, "toxic_lost": toxic,
        "shapley": np.bincount(at, removed, n).astype(np.int64)[at]})


def _of_part(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    tensors = np.zeros((3, 1 << len(FILTERS)), np.int64)
    tensors[:, part["cell"].to_numpy()] = part[["n", "good", "toxic"]].to_numpy().T
    out = steps(tensors.reshape(3, *[2] * len(FILTERS)))
    out.insert(0, "part", key[0])
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step (see ``cells`` for odd rows):
    documents kept after the step, removed by it, redundant (removed before),
    failing its filter alone, good and toxic ones lost, and the filter's removals
    summed over all orders.  A part is at most 32 cells, so a task's group is bounded.
    """
    return cells(docs, labels).groupBy("part").applyInPandas(_of_part, SCHEMA)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
f AS (
  SELECT doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT f.*, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
      FROM f LEFT JOIN l ON l.doc_id = f.doc_id),
g AS (SELECT part, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS bits, count(*) AS n,
        count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM x GROUP BY ALL),
y AS (SELECT part, n, good, toxic, [k.k for k in [{'k': 'A', 'v': bits.A}, {'k': 'B', 'v': bits.B}, {'k': 'C', 'v': bits.C},
        {'k': 'D', 'v': bits.D}, {'k': 'E', 'v': bits.E}] if k.v] AS fails FROM g),
abc AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS z),
o AS (SELECT p.z || q.z || r.z || s.z || u.z AS filter_order FROM abc p, abc q, abc r, abc s, abc u
      WHERE len(list_distinct([p.z, q.z, r.z, s.z, u.z])) = 5),
st AS (SELECT filter_order, i::INT AS step, filter_order[i] AS flt, string_split(filter_order[:i - 1], '') AS before
       FROM o, unnest([1, 2, 3, 4, 5]) AS v(i)),
m AS (SELECT st.filter_order, st.step, st.flt, y.*, list_contains(fails, flt) AS bad,
        list_has_any(fails, before) AS gone FROM st, y),
r AS (
  SELECT part, filter_order, step, flt, coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0) AS kept,
    coalesce(sum(n) FILTER (bad AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (bad AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (bad AND len(fails) = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (bad AND NOT gone), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (bad AND NOT gone), 0) AS toxic_lost FROM m GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, flt))::BIGINT AS shapley FROM r
"""


def op11(spark, sf_dir: str) -> DataFrame:
    """Query op11: the audit of five filters over all ``documents``, per language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
