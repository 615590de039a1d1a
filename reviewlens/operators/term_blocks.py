"""Corpus BM25 over blocks: term counts leave a task packed, not one row a term.

A row of a term and its sums takes some 33 bytes of shuffle after Spark's compression, and
nearly every n-gram of two or more words is a row of its own.  Here a task counts the terms
of a chunk of documents over Arrow buffers and sends them as blocks, one for each bucket of
terms: columns of whole numbers in as many byte planes as they need, and the terms as text,
compressed together.  Every term of every document is in a block; the buckets are merged and
scored one by one.  The counts and sums are those of ``terms.term_freq`` and
``terms.bm25_terms``, to the last bit.

A block of a chunk, bucket and n holds
  stores   slug, n_docs, avgdl of each store in it
  lone     terms of one document of the chunk: store, pos, dl, f, first_i (their share of the
           score follows from f, dl and avgdl, and takes less room so)
  shared   terms of more documents: store, first_pos, first_i, df, tf and the sums of shares
  terms    lone ones first, each ended by a line feed
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.session import ship_package

WHOLE, REST = 1 << 20, 1 << 30       # see terms.exact_parts

# Words (in Arrow buffers) that are counted at once, some 16 MB of text, and text whose terms of
# one n are merged at once: what a Python worker holds follows these, not the table.
CHUNK_BYTES = 24 << 20
BUCKET_BYTES = 8 << 20
PIECE = 1 << 18                      # n-grams of a chunk that are sorted at once

# pos of a document without one: after every other, and told from them by its first_i
NO_POS, NO_FIRST = (1 << 63) - 1, (1 << 31) - 1

HEAD = struct.Struct("<IIIIQ")       # n, stores, lone terms, shared terms, bytes of terms
LEVEL = 3                            # of zstd
OUT_ROWS = 1 << 16
MERGED = ("slug string, n int, term string, df long, tf long, n_docs long, "
          "first_pos long, first_i int, whole long, rest long")


def norm_parts(f: np.ndarray, dl: np.ndarray, avgdl: np.ndarray, k1: float, b: float) -> tuple[np.ndarray, np.ndarray]:
    """A document's share of a score as two whole numbers, in the operations of ``bm25_terms``."""
    f = f.astype(np.float64)
    scaled = f * (k1 + 1.0) / (f + k1 * ((1.0 - b) + b * dl.astype(np.float64) / avgdl)) * float(WHOLE)
    whole = np.floor(scaled)
    return whole.astype(np.int64), np.floor((scaled - whole) * float(REST)).astype(np.int64)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Index of the first of each run of equal rows."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


# -- packing -----------------------------------------------------------------

def _pack(*cols: np.ndarray) -> bytes:
    """Columns of non-negative numbers: a byte for the width, then the planes of bytes."""
    out = []
    for c in cols:
        c = np.ascontiguousarray(c).astype(np.uint64)
        w = (int(c.max(initial=0)).bit_length() + 7) // 8
        out += [bytes([w]), c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes()]
    return b"".join(out)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n:self.at]

    def ints(self, n: int, k: int) -> list[np.ndarray]:
        out = []
        for _ in range(k):
            w = self.take(1)[0]
            full = np.zeros((n, 8), np.uint8)
            full[:, :w] = np.frombuffer(self.take(n * w), np.uint8).reshape(w, n).T
            out.append(full.view("<i8").reshape(n))
        return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, signs in the lowest bit."""
    d = np.diff(x, prepend=np.int64(0))
    return (d << 1) ^ (d >> 63)


def _unsteps(z: np.ndarray) -> np.ndarray:
    u = z.view(np.uint64)
    return np.cumsum((u >> np.uint64(1)).view(np.int64) ^ -(z & 1))


def _compress(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + pa.Codec("zstd", LEVEL).compress(data, asbytes=True)


def _decompress(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], struct.unpack("<Q", data[:8])[0], asbytes=True)


# -- counting a chunk of documents -------------------------------------------

def _keys(t: pa.Table) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """Stores, positions (``NO_POS`` for none), which have none, first rows of the documents of sorted rows."""
    slug = t.column("slug").combine_chunks().dictionary_encode()
    pos = t.column("pos").combine_chunks()
    none = pos.is_null().to_numpy(zero_copy_only=False)
    pos = pos.fill_null(NO_POS).to_numpy(zero_copy_only=False)
    return slug, pos, none, _starts(slug.indices.to_numpy(), pos, none)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Tables of some ``limit`` bytes of words; rows of one document stay together."""
    held, size, full = [], 0, limit
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("words").nbytes
        if size >= full:
            t = pa.Table.from_batches(held).combine_chunks()
            cut = int(_keys(t)[-1][-1])
            if cut:
                yield t.slice(0, cut)
            # copied, so that rows given away are not kept by the others
            rest = t.take(np.arange(cut, t.num_rows))
            held, size = rest.to_batches(), rest.column("words").nbytes
            full = max(limit, 2 * size)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _hashes(values: pa.Array) -> np.ndarray:
    """The same number for the same string in every task: its bytes as digits to an odd base."""
    values = pa.concat_arrays([values, pa.array([""], values.type)])     # at offset 0, never empty
    offsets = np.frombuffer(values.buffers()[1], np.int32)[:len(values)].astype(np.int64)
    sizes = np.diff(offsets)
    digits = np.frombuffer(values.buffers()[2] or b"", np.uint8)[:offsets[-1]].astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, 0x100000001B3, np.uint64))
    digits *= powers[np.arange(len(digits)) - np.repeat(offsets[:-1], sizes)]
    total = np.append(np.uint64(0), np.cumsum(digits))
    return total[offsets[1:]] - total[offsets[:-1]]


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _blocks(t: pa.Table, ns: tuple[int, ...], k1: float, b: float, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, block) of the documents of ``t``: (slug, pos, words, levels), sorted by slug and pos."""
    slug, pos, none, docs = _keys(t)
    words = t.column("words").combine_chunks()
    lens = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    vocab, ids = coded.dictionary.cast(pa.string()), coded.indices
    if ids.null_count or pc.any(pc.match_substring_regex(vocab, r"[ \n]|^$")).as_py():
        raise ValueError("words of blocks are not null, not empty and without spaces or line feeds")
    ids = ids.to_numpy()
    n_rows, n_vocab = len(lens), max(len(vocab), 1)
    row_of = np.repeat(np.arange(n_rows, dtype=np.int32), lens)
    row_end = np.cumsum(lens)
    doc_of = np.zeros(n_rows, np.int32)
    doc_of[docs[1:]] = 1
    doc_of = np.cumsum(doc_of, dtype=np.int32)
    one_row = len(docs) == n_rows                        # of each document
    doc_store = slug.indices.to_numpy()[docs]
    doc_pos, doc_none = pos[docs], none[docs]

    stores = slug.dictionary.cast(pa.string())
    store_row = np.zeros(len(stores), np.int64)
    store_row[doc_store[::-1]] = docs[::-1]
    levels = [{x["n"]: x for x in row} for row in t.column("levels").take(store_row).to_pylist()]
    store_hash, word_hash = _hashes(stores), _hashes(vocab)
    names = [s.encode() for s in stores.to_pylist()]
    ended = pc.binary_join_element_wise(vocab, pa.scalar("\n"), "")

    for level, n in enumerate(ns):
        n_docs = np.array([x[n]["n_docs"] for x in levels], np.int64)
        avgdl = np.array([x[n]["avgdl"] for x in levels], np.float64)
        row_dl = np.maximum(lens - n + 1, 0)

        # where the n-grams begin, by bucket, else in the order of the texts
        at = np.flatnonzero(row_end[row_of] - np.arange(len(ids)) >= n).astype(np.int32)
        bucket = np.empty(len(at), np.uint16 if buckets <= 1 << 16 else np.int64)
        for lo in range(0, len(at), PIECE):
            x = at[lo:lo + PIECE]
            h = store_hash[doc_store[doc_of[row_of[x]]]] + np.uint64(n)
            for j in range(n):
                h = _mixed(h, word_hash[ids[x + j]])
            bucket[lo:lo + PIECE] = _mixed(h, h >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        at, bucket = at[order], bucket[order]
        del order
        begins = _starts(bucket)
        ends = np.append(begins[1:], len(at))

        lo = 0
        while lo < len(begins):                          # some buckets at once
            hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + PIECE, "right")))
            span = slice(begins[lo], ends[hi - 1])
            lo = hi
            x = at[span]
            # every n-gram as one number, sorted; equal ones keep their order, so documents do
            code, size = ids[x].astype(np.int64), n_vocab
            for j in range(1, n):
                if size * n_vocab >= 1 << 62:
                    known, code = np.unique(code, return_inverse=True)
                    size = len(known)
                code = code * n_vocab + ids[x + j]
                size *= n_vocab
            order = np.argsort(code, kind="stable")
            code, x, home = code[order], x[order], bucket[span][order]

            # a term of a document
            row = row_of[x]
            doc = doc_of[row]
            first = _starts(code, doc)
            f = _sizes(first, len(x))
            i, dl = x - (row_end - lens)[row], row_dl[row]
            if one_row:
                i, dl = i[first], dl[first]
            else:                                        # as the plain plan: of the rows with the term
                i, dl = np.minimum.reduceat(i, first), np.maximum.reduceat(dl, first)
            code, doc, x, home = code[first], doc[first], x[first], home[first]
            i = np.where(doc_none[doc], NO_FIRST, i)
            store = doc_store[doc]
            whole, rest = norm_parts(f, dl, avgdl[store], k1, b)

            # a term of a store
            term = _starts(code, store)
            df = _sizes(term, len(code))
            tf, whole, rest = (np.add.reduceat(c, term) for c in (f, whole, rest))
            x, home, store, place, i, dl = (c[term] for c in (x, home, store, doc_pos[doc], i, dl))

            # by bucket, terms of one document first, in the order of the texts
            lone = df == 1
            order = np.argsort(((2 * home.astype(np.int64) + np.where(lone, 0, 1)) << 32) | x, kind="stable")
            x, home, store, place, i, dl, df, tf, whole, rest, lone = (
                c[order] for c in (x, home, store, place, i, dl, df, tf, whole, rest, lone))
            parts = [vocab.take(pa.array(ids[x + j])) for j in range(n - 1)] + [ended.take(pa.array(ids[x + n - 1]))]
            text = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
            offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset:]
            data = memoryview(text.buffers()[2])
            tops = _starts(home)
            for u, v in zip(tops, np.append(tops[1:], len(home))):
                mid = u + int(np.count_nonzero(lone[u:v]))
                used, here = np.unique(store[u:v], return_inverse=True)
                a, z = slice(u, mid), slice(mid, v)
                terms = data[offsets[u]:offsets[v]]
                found = [names[s] for s in used]
                yield level * buckets + int(home[u]), _compress(b"".join((
                    HEAD.pack(n, len(used), mid - u, v - mid, len(terms)),
                    _pack(np.array([len(c) for c in found]), n_docs[used]), b"".join(found), avgdl[used].astype("<f8").tobytes(),
                    _pack(here[:mid - u], _steps(place[a]), dl[a], tf[a], i[a]),
                    _pack(here[mid - u:], _steps(place[z]), i[z], df[z], tf[z], whole[z], rest[z]),
                    terms)))


def _counted(ns: tuple[int, ...], k1: float, b: float, buckets: int, limit: int) -> Callable:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, limit):
            held, size = [], 0

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int32()),
                                                   pa.array([x[1] for x in held], pa.binary())], names=["bucket", "block"])

            for row in _blocks(t, ns, k1, b, buckets):
                held.append(row)
                size += len(row[1])
                if size >= 4 << 20:
                    yield flush()
                    held, size = [], 0
            if held:
                yield flush()

    return counted


# -- merging a bucket --------------------------------------------------------

def _strings(data: bytes) -> pa.Array:
    """Terms of a text that ends each with a line feed."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 10)
    offsets = np.append(0, ends - np.arange(len(ends))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(raw[raw != 10].tobytes()))


def _merge(blocks: Iterator[bytes], k1: float, b: float, top: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (``MERGED``) of the terms of one bucket.  With ``top``, those that are surely not
    among the first ``top`` of their store are left out."""
    known: dict[bytes, int] = {}
    docs_of: list[int] = []
    n, cols, terms = 0, [], []
    for data in blocks:
        r = _Reader(_decompress(data))
        n, n_stores, n_lone, n_shared, n_terms = HEAD.unpack(r.take(HEAD.size))
        lens, n_docs = r.ints(n_stores, 2)
        ids = []
        for size, docs in zip(lens.tolist(), n_docs.tolist()):
            name = r.take(size)
            if name not in known:
                known[name] = len(known)
                docs_of.append(docs)
            ids.append(known[name])
        ids = np.array(ids, np.int32)
        avgdl = np.frombuffer(r.take(8 * n_stores), "<f8")
        store, pos, dl, f, i = r.ints(n_lone, 5)
        whole, rest = norm_parts(f, dl, avgdl[store], k1, b)
        # counts of a chunk fit 32 bits
        cols.append((ids[store], _unsteps(pos), i.astype(np.int32), np.ones(n_lone, np.int32), f.astype(np.int32), whole, rest))
        store, pos, i, df, tf, whole, rest = r.ints(n_shared, 7)
        cols.append((ids[store], _unsteps(pos), i.astype(np.int32), df.astype(np.int32), tf.astype(np.int32), whole, rest))
        terms.append(r.take(n_terms))
    text = _strings(b"".join(terms))
    del terms
    store, pos, i, df, tf, whole, rest = (np.concatenate(c) for c in zip(*cols))
    del cols
    coded = text.dictionary_encode()
    text, term = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    key = term * len(known) + store
    order = np.argsort(key, kind="stable")               # nearly sorted: numbers follow first sight
    key = key[order]
    first = _starts(key)
    store, term = (x[order[first]] for x in (store, term))
    pos, i, df, tf, whole, rest = (x[order] for x in (pos, i, df, tf, whole, rest))
    if len(first) < len(key):
        of = np.repeat(np.arange(len(first)), _sizes(first, len(key)))
        low = np.minimum.reduceat(pos, first)
        i = np.minimum.reduceat(np.where(pos == low[of], i, NO_FIRST), first)
        pos = low
        df, tf, whole, rest = (np.add.reduceat(x, first, dtype=np.int64) for x in (df, tf, whole, rest))
    n_docs = np.array(docs_of, np.int64)[store]

    keep = np.arange(len(store)) if top is None else _first(store, n_docs, df, whole, rest, pos, i, top)
    slugs = pa.array([k.decode() for k in known], pa.string())
    none = i == NO_FIRST
    for lo in range(0, len(keep), OUT_ROWS):
        at = keep[lo:lo + OUT_ROWS]
        yield pa.RecordBatch.from_arrays([
            slugs.take(pa.array(store[at])), pa.array(np.full(len(at), n, np.int32)),
            text.take(pa.array(term[at])).cast(pa.string()), pa.array(df[at], pa.int64()), pa.array(tf[at], pa.int64()), pa.array(n_docs[at]),
            pa.array(pos[at], mask=none[at]), pa.array(i[at].astype(np.int32), mask=none[at]),
            pa.array(whole[at]), pa.array(rest[at])], names=[c.split()[0] for c in MERGED.split(", ")])


def _first(store, n_docs, df, whole, rest, pos, i, top: int) -> np.ndarray:
    """Rows that may be among the first ``top`` of their store.

    Scores here may differ from Spark's in the last bits, so all above a hair under the
    score of the ``top``-th stay, and of equal ones (same df and sums: equal scores there
    too) the first ``top`` by appearance.
    """
    score = np.log((n_docs - df + 0.5) / (df + 0.5) + 1.0) * ((whole + rest / float(REST)) / float(WHOLE))
    order = np.lexsort((-score, store))
    begins = _starts(store[order])
    sizes = _sizes(begins, len(order))
    bound = score[order[begins + np.minimum(sizes, top) - 1]]
    order = order[score[order] >= np.repeat(bound * (1.0 - 1e-9), sizes)]
    order = order[np.lexsort((i[order], pos[order], rest[order], whole[order], df[order], store[order]))]
    begins = _starts(store[order], df[order], whole[order], rest[order])
    rank = np.arange(len(order)) - np.repeat(begins, _sizes(begins, len(order)))
    return order[rank < top]


def _merged(k1: float, b: float, top: int | None) -> Callable:
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _merge((x for batch in batches for x in batch.column("block").to_pylist()), k1, b, top)

    return merged


# -- plan --------------------------------------------------------------------

def merged_terms(docs: DataFrame, stats: DataFrame, ns: tuple[int, ...], k1: float, b: float,
                 n_bytes: int, top: int | None = None) -> DataFrame:
    """(``MERGED``) of every term of ``docs`` that has a store.

    ``docs``: (slug, pos, words), dealt out so that rows of one (slug, pos) are in one
    partition; words are letter runs.  ``stats`` (``stats_from_docs``) is broadcast.
    ``n_bytes`` of text set the number of buckets.
    """
    spark = docs.sparkSession
    ship_package(spark)
    buckets = max(4 * spark.sparkContext.defaultParallelism, -(-n_bytes // BUCKET_BYTES))
    levels = stats.groupBy("slug").agg(F.collect_list(F.struct("n", "n_docs", "avgdl")).alias("levels"))
    rows = (docs.select("slug", F.col("pos").cast("long").alias("pos"), "words").join(F.broadcast(levels), "slug")
            .select("slug", "pos", "words", "levels")
            .sortWithinPartitions("slug", F.asc_nulls_last("pos")))
    blocks = rows.mapInArrow(_counted(tuple(ns), k1, b, buckets, CHUNK_BYTES), "bucket int, block binary")
    return blocks.groupBy("bucket").applyInArrow(_merged(k1, b, top), MERGED)
