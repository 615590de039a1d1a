"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 63-bit ring; a key belongs to the next
point clockwise.  A shard takes rows only up to its bound; rows beyond it walk
on clockwise to the next shard with room.  With ``epsilon`` = 0 the bounds add
up to the number of rows, so all shards hold the same number of rows, at most
one apart.

The walk needs only the number of keys on each arc between two points: at most
shards x vnodes counts reach the driver, whatever the input's size.  Which rows
of an arc overflow follows from a row's rank on its arc, counted on Spark in
cells of an arc (a cell holds about ``CELL_ROWS`` rows).
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.common import saved

RING_BITS = 63
TABLE_BITS = 11          # the ring look-up table has 2**11 equal sections
CELL_ROWS = 50_000


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """The ring's points (position, shard) in order."""
    pts = []
    for s in range(shards):
        for v in range(vnodes):
            h = hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest()
            pts.append((int.from_bytes(h, "big") >> 1, s))
    return sorted(pts)


def ring_sections(points: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(section, lo, hi, arc): the parts of arcs in each equal section of the
    ring, ends included; at most 2**TABLE_BITS + len(points) rows."""
    width = 1 << (RING_BITS - TABLE_BITS)
    pos = [p for p, _ in points]
    rows = []
    for c in range(1 << TABLE_BITS):
        lo, end = c * width, (c + 1) * width - 1
        while lo <= end:
            i = bisect.bisect_left(pos, lo)
            hi = min(end, pos[i]) if i < len(pos) else end
            rows.append((c, lo, hi, i % len(pos)))
            lo = hi + 1
    return rows


def bounds(n: int, shards: int, epsilon: float) -> list[int]:
    """Rows each shard may take."""
    if epsilon > 0:
        return [-(-int(n * (1 + epsilon) + 0.999999) // shards)] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def place(points: list[tuple[int, int]], counts: dict[int, int],
          room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from_rank, to_rank, shard, first_slot) for every run of an arc's rows.

    Each arc first fills its own shard; what overflows continues clockwise.
    """
    room, used, runs = list(room), [0] * len(room), []

    def take(arc: int, at: int, shard: int, n: int) -> None:
        runs.append((arc, at, at + n, shard, used[shard]))
        used[shard] += n
        room[shard] -= n

    over = []
    for arc, (_, shard) in enumerate(points):
        n = counts.get(arc, 0)
        own = min(n, room[shard])
        if own:
            take(arc, 0, shard, own)
        if n > own:
            over.append((arc, own, n))
    for arc, at, n in over:
        k = arc
        while at < n:
            k = (k + 1) % len(points)
            shard = points[k][1]
            if got := min(n - at, room[shard]):
                take(arc, at, shard, got)
                at += got
    return runs


def shard_rows(df: DataFrame, key: Column, tie: list[Column], shards: int = 24,
               vnodes: int = 64, epsilon: float = 0.0) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in a shard).

    ``key`` decides the place on the ring; ``tie`` (columns of the row's
    content) orders equal keys and spreads a key that very many rows share.
    Null keys hash like any value.  Rows that agree in all of them are
    interchangeable.  An empty table gives no rows.  ``df`` should be narrow:
    it is written once to the shared folder and shuffled once.
    """
    spark = df.sparkSession
    points = ring(shards, vnodes)
    table = F.broadcast(spark.createDataFrame(      # bounded: sections + shards * vnodes rows
        ring_sections(points), "_sec long, _lo long, _hi long, _arc int"))
    pos = F.shiftrightunsigned(F.xxhash64(key), 1)
    keyed = (df.withColumns({"_pos": pos, "_mix": F.xxhash64(key, *tie)})
             .withColumn("_sec", F.shiftright("_pos", RING_BITS - TABLE_BITS))
             .join(table, "_sec")
             .filter("_pos between _lo and _hi")
             .drop("_sec", "_lo", "_hi"))
    keyed = saved(keyed, "ring")
    counts = {r._arc: r.n for r in keyed.groupBy("_arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())                        # bounded: one row per arc
    cells = -(-n // (len(points) * CELL_ROWS)) or 1
    keyed = keyed.withColumn("_cell", F.pmod("_mix", F.lit(cells)))
    first = (keyed.groupBy("_arc", "_cell").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_first", F.sum("_n").over(
                 Window.partitionBy("_arc").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)))
             .select("_arc", "_cell", F.coalesce("_first", F.lit(0)).alias("_first")))
    runs = F.broadcast(spark.createDataFrame(       # bounded: about arcs + shards rows
        place(points, counts, bounds(n, shards, epsilon)),
        "_arc int, _from long, _to long, shard int, _slot long"))
    order = Window.partitionBy("_arc", "_cell").orderBy("_pos", "_mix")
    return (keyed.withColumn("_in", F.row_number().over(order) - 1)
            .join(first, ["_arc", "_cell"])
            .withColumn("_rank", F.col("_first") + F.col("_in"))
            .join(runs, "_arc")
            .filter("_rank >= _from and _rank < _to")
            .withColumn("slot", F.col("_slot") + F.col("_rank") - F.col("_from"))
            .drop(*[c for c in ("_pos", "_mix", "_arc", "_cell", "_in", "_first", "_rank", "_from", "_to", "_slot")]))


def op7(spark, docs: DataFrame, shards: int = 24, vnodes: int = 64) -> DataFrame:
    """Query op7: every document's shard and slot; ``law`` is 'rows'.

    size is the text's UTF-8 bytes (null text: none) plus 8, text_crc32 the
    CRC-32 of these bytes.  Only doc_id, size and CRC move; texts are read once.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    out = shard_rows(rows, F.col("doc_id"), [F.col("text_crc32"), F.col("size")], shards, vnodes)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
