"""Document fingerprints by winnowing.

A text's tokens (runs of non-space characters, cut after 16;
ideographs, kana and Thai, Lao, Burmese and Khmer characters one by one) are hashed, k consecutive tokens give one rolling
polynomial hash, and the minimum of every window of w hashes is kept with its
position, the rightmost where hashes tie.  Any run of w + k - 1 tokens that two
texts share leaves a common hash in both fingerprints.

Everything is array functions inside the row.  A hash and its position share
one long: 31 bits of hash above 31 bits that fall as the position grows, so a
window's minimum is a plain ``least`` and ties go to the right.  Each step is a
column of its own: the next one then reads a stored array, not its expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.common import saved, text_or_empty
from reviewlens.llm.hashing import UNSPACED

K = 4                       # both are powers of two: sums and minima double their reach
W = 8
# scripts written without spaces: each character is a token, so an inserted one shifts nothing (as
# ranges of code points, which the pattern tests faster than names of scripts)
ALONE = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in UNSPACED)
TOKEN = rf"[!-~[^\s{ALONE}]]{{1,16}}|[{ALONE}]"    # printable ASCII is asked first
_P = (1 << 31) - 1          # mask of the rolling hash (polynomial modulo 2**31)
_C = 1_000_003              # its base
_ALL = 1 << 30              # more elements than an array holds


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp", k: int = K, w: int = W) -> DataFrame:
    """``df`` with ``out``: array<long> of the kept hash and position pairs, in
    the order of positions (see ``hashes`` and ``positions``).

    Fewer than k tokens make one hash of all of them; fewer than w hashes make
    one window; a null or empty text has an empty fingerprint.
    """
    h = f"_{out}_h"
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    df = df.withColumn(h, tokens).withColumn(h, F.transform(h, lambda x: F.xxhash64(x).bitwiseAND(F.lit(_P))))
    df = df.withColumn(f"{h}n", F.size(h))
    step, base = 1, _C
    while step < k:                                  # hash of 2 * step tokens from two of step
        c = F.lit(base)
        df = df.withColumn(h, F.zip_with(h, F.slice(h, step + 1, _ALL), lambda a, b: (
            a * c + F.coalesce(b, F.lit(0))).bitwiseAND(F.lit(_P))))
        step, base = step * 2, base * base & _P
    df = df.withColumn(h, F.transform(
        F.slice(h, 1, F.greatest(F.col(f"{h}n") - (k - 1), F.lit(1))),
        lambda x, i: F.shiftleft(x, 31).bitwiseOR(F.lit(_P) - i)))
    step = 1
    while step < w:                                  # minimum of 2 * step hashes from two of step
        df = df.withColumn(h, F.zip_with(h, F.slice(h, step + 1, _ALL), lambda a, b: F.least(a, b)))
        step *= 2
    windows = F.greatest(F.size(h) - (w - 1), F.lit(1))
    return df.withColumn(out, F.array_distinct(F.slice(h, 1, windows))).drop(h, f"{h}n")


def hashes(fp: Column) -> Column:
    return F.array_distinct(F.transform(fp, lambda x: F.shiftright(x, 31)))


def positions(fp: Column) -> Column:
    """The token position of each kept hash."""
    return F.transform(fp, lambda x: F.lit(_P) - x.bitwiseAND(F.lit(_P)))


def printed(fp: Column) -> Column:
    """'hash:position' of all kept hashes, hashes in hex, comma-joined."""
    return F.array_join(F.transform(fp, lambda x: F.concat(
        F.hex(F.shiftright(x, 31)), F.lit(":"), (F.lit(_P) - x.bitwiseAND(F.lit(_P))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        both / (F.size(a) + F.size(b) - both))


def neighbours(nodes: DataFrame) -> DataFrame:
    """For every row of ``nodes`` (k, doc_id, sha, n) also k_prev and n_prev: the
    row before it in descending (doc_id, sha), cyclic; null ids come last.

    Rows are dealt by range, the order inside a part is a window over that part
    (about 100,000 narrow rows), and only one row a part meets in one task.
    """
    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() // 100_000)
    order = [F.col("doc_id").desc_nulls_last(), F.col("sha")]
    dealt = saved(nodes.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "order")
    inside = Window.partitionBy("part").orderBy(*order)
    rows = dealt.withColumns({"k_prev": F.lag("k").over(inside), "n_prev": F.lag("n").over(inside)})
    ends = dealt.groupBy("part").agg(F.max(F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), "sha", "k", "n")).alias("e")) \
        .select("part", F.col("e.k").alias("k_end"), F.col("e.n").alias("n_end"))
    line = Window.orderBy("part")                    # one row a part
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("k_end").over(line), F.last("k_end").over(whole)).alias("k_end"),
                       F.coalesce(F.lag("n_end").over(line), F.last("n_end").over(whole)).alias("n_end"))
    return rows.join(ends, "part").select(
        "k", "doc_id", "n", F.coalesce("k_prev", "k_end").alias("k_prev"),
        F.coalesce("n_prev", "n_end").alias("n_prev"))


def op2(spark, docs: DataFrame) -> DataFrame:
    """Query op2: fingerprints of every text and of its edited text.

    The edited text ends in the beginning of the next document (descending
    doc_id; null ids last; equal ids by the text's SHA-256; repeated rows count
    as one document).  Each text moves once, half of it a second time, to the
    document before it.  An empty table gives no rows; a single document is its
    own next.
    """
    text = text_or_empty()
    rows = docs.select("doc_id", text.alias("text")).withColumn("sha", F.sha2("text", 256))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("sha"))
    nodes = saved(rows.select(key.alias("k"), "doc_id", "sha", F.length("text").cast("long").alias("n")), "nodes")
    single = nodes.distinct()
    repeated = nodes.count() > single.count()
    plan = neighbours(single)
    # texts move without their fingerprints: both readers of this shuffle compute them, which costs less than moving
    dealt = with_fingerprint(rows.select(key.alias("k"), "text").join(plan, "k"))
    heads = dealt.select(
        F.col("k_prev").alias("k"),
        F.substring(F.col("text"), F.lit(1), F.floor(F.col("n_prev") / 2).cast("int")).alias("_head"),
        hashes(F.col("fp")).cast("array<int>").alias("_next"))
    if repeated:
        heads = heads.dropDuplicates(["k"])
    keep = (F.col("n") - F.floor(F.col("n") / 2)).cast("int")
    both = dealt.select("k", "doc_id", "n", "text", "fp").join(heads, "k") \
        .withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), keep), "_head"))
    both = with_fingerprint(both.drop("text", "_head"), "edited", "edited_fp")
    both = both.withColumns({"_own": hashes(F.col("fp")), "_edited": hashes(F.col("edited_fp"))})
    return both.select(
        "doc_id", F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("fp")).alias("fingerprint"), printed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("_own").cast("array<int>"), F.col("_next")).alias("near_next"))
