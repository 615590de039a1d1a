"""Periodic runs of words, found by multi-scale minimizers.

A run is a stretch of words with smallest period q and at least ``MIN_REPEATS``
times q (and ``MIN_WORDS``) words which no neighbouring word extends.  At scale K (32,
64, 128, ...) the hashes of all K-grams are looked at through windows of K/2 + 4
starts, and the minima of the windows are kept.  A run of period q in (K/2, K] holds
two windows q apart, whose contents are equal, so their minima are equal K-grams
q apart; and no equal K-gram lies between these, as by Fine and Wilf's theorem the
run's period would then be smaller.  So the pairs of neighbouring equal minimizers
at a distance in (K/2, K] hold a seed of every run, a linear number of them in all.
Seeds are extended by comparing words, exactly.  Lags up to 16 are scanned directly.

A task takes texts in slices of some MB; its arrays are a small multiple of a slice
or of the longest text.  Nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import fresh, ship_package
from reviewlens.llm.hashing import mix, slices

MIN_REPEATS = 4
MIN_WORDS = 6
SHORT = 16                                           # lags scanned directly
SPACE = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (maximal runs without ASCII white space) of all texts, and the
    number of words before each text and after the last; null counts as empty."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, off = lists.flatten(), np.asarray(lists.offsets, np.int64)
    off = off - off[0]
    full = np.asarray(pc.greater(pc.binary_length(words), 0))    # white space at either end leaves empty pieces
    return words.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[off]


def _windowed(x: np.ndarray, width: int, take) -> np.ndarray:
    """``take`` (minimum or maximum) over every window of ``width`` values."""
    size = 1
    while size * 2 <= width:
        x = take(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return take(x[:len(x) - rest], x[rest:]) if rest else x


def _same(x: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words agree from positions a < b on, to the right (step 1) or left (-1)."""
    most = len(x) - b if step > 0 else a + 1
    done, size = 0, 32
    while done < most:
        size = min(size, most - done)
        if step > 0:
            eq = x[a + done:a + done + size] == x[b + done:b + done + size]
        else:
            eq = (x[a - done - size + 1:a - done + 1] == x[b - done - size + 1:b - done + 1])[::-1]
        wrong = int(eq.argmin())
        if not eq[wrong]:
            return done + wrong
        done += size
        size *= 4
    return done


def _primitive(x: np.ndarray, start: int, q: int) -> bool:
    """Whether no proper divisor of q is a period of the run of period q at ``start``."""
    rest, f, block = q, 2, x[start:start + 2 * q]
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            d = q // f
            if np.array_equal(block[:q], block[d:d + q]):
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def _seeds(h: np.ndarray, width: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of neighbouring equal minimizers ``low`` to ``high`` apart."""
    least = _windowed(h, width, np.minimum)
    pad = np.zeros(width - 1, h.dtype)
    at = np.flatnonzero(_windowed(np.concatenate([pad, least, pad]), width, np.maximum) == h)
    at = at[np.argsort(h[at], kind="stable")]
    gap = np.diff(at)
    ok = (h[at[1:]] == h[at[:-1]]) & (gap >= low) & (gap <= high)
    return at[:-1][ok], gap[ok]


def runs_of(x: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``x``: texts of word numbers side by
    side, the longest first, each closed by a number of its own; ``ends`` has where
    each closes."""
    out = []
    for q in range(1, min(SHORT, len(x) - 1) + 1):
        least = max(MIN_WORDS, MIN_REPEATS * q) - q
        off = np.flatnonzero(x[:-q] != x[q:])
        off = np.concatenate([[-1], off, [len(x) - q]])
        for k in np.flatnonzero(np.diff(off) > least):
            start = int(off[k]) + 1
            if _primitive(x, start, q):
                out.append((start, int(off[k + 1]) - start + q, q))
    sizes = np.diff(np.concatenate([[-1], ends])) - 1
    h, size = mix(x.astype(np.uint64) + np.uint64(1)), 1
    while True:
        low = max(size // 2, SHORT) + 1
        texts = int(np.searchsorted(-sizes, -MIN_REPEATS * low, "right"))
        if not texts:                                # no text holds a run of this scale
            return out
        h = h[:int(ends[texts - 1]) + 1]
        if size > SHORT:
            at, gap = _seeds(h, 3 * low - size + 1, low, size)
            order = np.lexsort((at, gap))
            last, covered = 0, -1
            for m, q in zip(at[order].tolist(), gap[order].tolist()):
                if q == last and m < covered:
                    continue
                start = m - _same(x, m - 1, m + q - 1, -1)
                covered = m + _same(x, m, m + q, 1)
                last = q
                if covered + q - start >= max(MIN_WORDS, MIN_REPEATS * q) and _primitive(x, start, q):
                    out.append((start, covered + q - start, q))
        h = mix(h[:-size] + np.uint64(0x9E3779B97F4A7C15) * h[size:])
        size *= 2


def _keep(n: int, runs) -> np.ndarray:
    """Marks the words that no run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        step[start + q] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) == 0


def find(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(runs by start and period, text without repeated periods) of every text."""
    words, off = split_words(texts)
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    ids = np.asarray(words.dictionary_encode().indices, np.int64) if len(words) else np.zeros(0, np.int64)
    ends = np.cumsum(n[order] + 1) - 1
    place = np.arange(len(ids)) + np.repeat((ends - n[order])[np.argsort(order)] - off[:-1], n)
    x = np.arange(len(ids) + len(n)) + len(ids)      # numbers that stand for no word
    x[place] = ids
    found = [[] for _ in n]
    if len(ids):
        for start, length, q in runs_of(x, ends):
            k = int(np.searchsorted(ends, start))
            found[order[k]].append((start - int(ends[k] - n[order[k]]), length, q))
    keep = np.ones(len(ids), bool)
    for i, r in enumerate(found):
        if r:
            r.sort(key=lambda t: (t[0], t[2]))
            keep[off[i]:off[i + 1]] = _keep(int(n[i]), r)
    kept = words.filter(pa.array(keep))
    cut = np.concatenate([[0], np.cumsum(keep)])[off]
    lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), kept)
    return (pa.array([[{"start": a, "length": b, "period": q} for a, b, q in r] for r in found], _RUNS),
            pc.binary_join(lists, " "))


def runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period; by start, then period) and
    ``collapsed`` (the words that no run repeats, joined by one space).

    A null or empty text has no runs and collapses to the empty text.  Words are compared
    byte for byte.  Other columns stay as they are, but for older ones called runs or
    collapsed, which are replaced; rows are independent, so repeated rows and ties
    give equal results, and an empty table stays empty.
    """
    ship_package(docs.sparkSession)
    own = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    docs = docs.select(*(f"`{c}`" for c in own))

    def of_batches(batches):
        for batch in batches:
            texts = batch.column(own.index(text))
            for a, b in slices(texts, SLICE_BYTES):
                found, collapsed = find(texts.slice(a, b - a))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, found, collapsed], [*own, "runs", "collapsed"])

    schema = (docs.withColumn("runs", F.lit(None).cast("array<struct<start: long, length: long, period: long>>"))
              .withColumn("collapsed", F.lit(None).cast("string")).schema)
    return docs.mapInArrow(of_batches, schema)


def plant(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the query's planted runs: of a tenth of the documents,
    chosen by crc32 of the id, the words from a on repeat the p words at a.  A null id
    or a text without words is left as it is."""
    words, a, p = fresh(docs, "words", "a", "p")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    chosen = F.when(h % 10 == 0, F.array_remove(F.split("text", SPACE), ""))
    n = F.size(words)
    repeated = F.slice(F.flatten(F.array_repeat(F.slice(F.col(words), F.col(a) + 1, F.col(p)), F.ceil((n - F.col(a)) / F.col(p)).cast("int"))),
                       F.lit(1), n - F.col(a))
    return (docs.withColumn(words, chosen)
            .withColumn(a, F.when(n > 0, (g % n).cast("int")))
            .withColumn(p, (F.floor((n - F.col(a)) / (3 + g % 8)) + 1).cast("int"))
            .withColumn("text", F.when(F.col(p).isNotNull(), F.array_join(F.concat(F.slice(F.col(words), F.lit(1), F.col(a)), repeated), " "))
                        .otherwise(F.col("text")))
            .drop(words, a, p))


def op12(spark, docs: DataFrame) -> DataFrame:
    """Query op12: the runs of every document (a tenth with planted ones), the run of greatest
    length over period, and digests of all runs and of the collapsed text."""
    found = runs(plant(docs.select("doc_id", "text"))).drop("text")
    ahead = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]       # noqa: E731
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)),
                       lambda top, r: F.when(ahead(r, top), r).otherwise(top))
    found = found.withColumn("best", best)
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.expr("(1000 * best.length) div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
