"""Connected components of a link table by alternating large and small stars.

Every step is a grouped minimum and a join, so a node with very many links is
pre-aggregated per map task and its join rows can be split by the skew-join
rule.  Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import discard, saved


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v."""
    if large:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # a neighbour above u is linked to u's smallest neighbour
        out = (e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(m, "u")
               .select(F.col("w").alias("u"), F.col("m").alias("v")))
    else:
        m = e.groupBy("u").agg(F.min("v").alias("m"))
        out = (e.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(m.select("u", F.col("m").alias("v"))))
    return out.filter("u <> v").distinct()


def _digest(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long; null ends and
    loops are ignored; repeated edges count once).  component is the smallest
    node that links lead to.  An empty table gives an empty result.
    """
    e = (edges.filter("a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = saved(e, "edges")
    last = _digest(e)
    while last[0]:
        step = saved(_star(_star(e, True), False), "star")
        now = _digest(step)
        discard(e)
        e = step
        if now == last:
            break
        last = now
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.unionByName(roots)
