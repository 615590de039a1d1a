"""Bounded-space online packing of tokenized documents.

Each partition keeps ``OPEN`` windows.  A document's full windows leave at once;
its rest goes where it fits best, and when it fits nowhere the fullest window is
emitted to make room.  What is open at the end (at most ``OPEN`` windows a
partition) is merged over groups of ``FAN_IN`` partitions, level by level.
Pieces are emitted as rows; nothing but the open windows is held.
"""

from __future__ import annotations

import base64
import bisect
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import saved, ship_package, text_or_empty, tidy
from reviewlens.llm.hashing import slices

SIZE = 1024
OPEN = 64
FAN_IN = 64
END_ID = 0
CACHE = 250_000               # words whose ids a worker keeps

_CUT = re.compile(r" (?=\S)")
_RISKY = re.compile(r" (?:\s|$)")
_ENCODERS: dict = {}


class Words(dict):
    """Word -> ids as little-endian 32-bit bytes, encoded when first asked for."""

    def __init__(self, encode, prefix: str):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode(self.prefix + word))
        if sys.byteorder == "big":
            ids.byteswap()
        self[word] = out = ids.tobytes()
        return out


class Encoder:
    """Token ids of the tokenizer in ``path``, as bytes, words from a bounded cache.

    The byte-level split never joins a character and a following " x" (space and
    non-space), so texts are cut there and each word is encoded once.  With
    ``ranks`` (the same vocabulary as a rank file) words are encoded from that,
    which gives the same ids at a third of the time; a word that holds the text
    of a special token always goes through the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # a task has one core
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        slow = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
        encode = slow
        if ranks:
            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
            special = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or "(?!)")
            encode = lambda t: slow(t) if special.search(t) else fast(t)
        self.first, self.later = Words(encode, ""), Words(encode, " ")

    def forget(self) -> None:
        """Empties the cache, so that an idle worker keeps the vocabulary alone."""
        self.first.clear()
        self.later.clear()

    def encode(self, text: str) -> bytes:
        parts = _CUT.split(text) if _RISKY.search(text) else text.split(" ")
        for cache in (self.first, self.later):
            if len(cache) > CACHE:
                cache.clear()
        head = self.first[parts[0]]
        return head + b"".join(map(self.later.__getitem__, parts[1:]))


def encoder(*files: str) -> Encoder:
    if files not in _ENCODERS:
        _ENCODERS[files] = Encoder(*files)
    return _ENCODERS[files]


class Windows:
    """``count`` open windows of ``size`` tokens; best fit, fullest out."""

    def __init__(self, size: int, count: int):
        self.size, self.count = size, count
        self.free: list[tuple[int, int]] = []        # (room, window) in order
        self.inside: dict[int, list] = {}
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def put(self, piece: tuple, length: int) -> list[tuple[int, list]]:
        """Place a piece; returns the windows that this closes."""
        out = []
        k = bisect.bisect_left(self.free, (length, -1))
        if k < len(self.free):
            room, w = self.free.pop(k)
        else:
            if len(self.free) == self.count:
                _, fullest = self.free.pop(0)
                out.append((fullest, self.inside.pop(fullest)))
            room, w = self.size, self.new()
            self.inside[w] = []
        self.inside[w].append((piece, self.size - room, length))
        if room == length:
            out.append((w, self.inside.pop(w)))
        else:
            bisect.insort(self.free, (room - length, w))
        return out


_PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "part long, win long, offset long, open boolean")


def _pack_partition(files: tuple, size: int, count: int, keep_ids: bool):
    names = [c.split()[0] for c in _PIECE.split(", ")] + ["ids"] * keep_ids
    kinds = [pa.int64()] * 8 + [pa.bool_()] + [pa.list_(pa.int32())] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(*files), TaskContext.get().partitionId()
        win, rows = Windows(size, count), []

        def emit(w: int, pieces: list, still_open: bool) -> None:
            for (doc, start, total, crc, ids), offset, length in pieces:
                rows.append((doc, start, length, crc, total, part, w, offset, still_open) + ((ids,) if keep_ids else ()))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
            rows.clear()
            return out

        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts, 2 << 20):
                for doc, text in zip(docs.slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist(), strict=True):
                    ids = enc.encode(text) + END_ID.to_bytes(4, "little")
                    total = len(ids) // 4
                    for start in range(0, total, size):
                        cut = ids[4 * start:4 * (start + size)]
                        length = len(cut) // 4
                        piece = (doc, start, total, zlib.crc32(cut), list(array("I", cut)) if keep_ids else None)
                        if length == size:
                            emit(win.new(), [(piece, 0, length)], False)
                        else:
                            for w, pieces in win.put(piece, length):
                                emit(w, pieces, False)
                if len(rows) > 20_000:
                    yield flush()
        for w, pieces in win.inside.items():
            emit(w, pieces, True)
        yield flush()
        enc.forget()
        tidy()

    return run


def _merge_group(size: int, last: bool):
    """Best-fit decreasing over the open windows of one group of partitions."""
    import pandas as pd

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fill = rows.groupby(["part", "win"])["length"].sum().sort_values(ascending=False, kind="stable")
        free, base, made, used = [], {}, 0, {}
        for name, length in fill.items():
            k = bisect.bisect_left(free, (length, -1))
            if k < len(free):
                room, b = free.pop(k)
            else:
                room, b, made = size, made, made + 1
            base[name] = (b, size - room)
            used[b] = size - room + length
            bisect.insort(free, (room - length, b))
        at = [base[p] for p in zip(rows["part"], rows["win"], strict=True)]
        rows = rows.assign(offset=rows["offset"] + [o for _, o in at], win=[b for b, _ in at], part=key[0])
        # a window that is nearly full is done; the rest goes on to the next level
        return rows.assign(open=[not last and used[b] < size - size // 64 for b in rows["win"]])

    return run


def pack(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, key: str = "doc_id",
         text: str = "text", size: int = SIZE, open_windows: int = OPEN, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, with ``keep_ids``, the ids (array<int>).

    Every document is its token ids and one id 0; a null or empty text is that
    id alone.  Repeated rows are packed each; a null key stays null; other
    columns are not read.  An empty table gives no rows.  Partitions are those
    of the scan, so a lost task packs the same rows again in the same way.
    """
    ship_package(docs.sparkSession)
    schema = _PIECE + ", ids array<int>" * keep_ids
    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    pieces = saved(rows.mapInArrow(_pack_partition((path, ranks, pattern), size, open_windows, keep_ids), schema), "pieces")
    number = lambda level: F.lit(level << 56) + F.shiftleft(F.col("part"), 28) + F.col("win")
    done = [pieces.filter("not open").withColumn("sequence_id", number(0))]
    left = pieces.filter("open")
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    level = 0
    while True:
        level += 1
        parts = -(-parts // FAN_IN)
        group = F.floor(F.col("part") / FAN_IN).cast("long").alias("g")
        merged = left.groupBy(group).applyInPandas(_merge_group(size, parts == 1), schema)
        if parts == 1:
            done.append(merged.withColumn("sequence_id", number(level)))
            break
        merged = saved(merged, "merged")
        done.append(merged.filter("not open").withColumn("sequence_id", number(level)))
        left = merged.filter("open")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("part", "win", "open")


def op5(spark, docs: DataFrame) -> DataFrame:
    """Query op5: the pieces of all documents, without the ids themselves."""
    import public_tokenizers as given
    return pack(docs, given.path("byte_bpe_50k.json"), given.path("byte_bpe_50k.tiktoken"), given.PATTERN,
                keep_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
