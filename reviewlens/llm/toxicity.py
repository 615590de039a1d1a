"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words' 64-bit hashes.  The machine has a weight and a
factor vector for each of at most ``TERMS`` terms: those that tell the labels
apart beyond chance, the ``CONTEXT`` most frequent ones, and those that tell
them apart among the texts that hold a word of the first kind, such as mentions
of a group, which are neutral alone.  The product of two factor vectors is the
weight of the pair, so two words can count together more or less than they do
alone.

It is fitted on a bounded sample of labelled rows (``SAMPLE``, the smallest
hashes of doc_id); every text is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import crc_class, saved, ship_package, tidy
from reviewlens.llm.hashing import distinct, slices, words

SAMPLE = 20_000
TERMS = 4_096
CONTEXT = 32
LEAST_DOCS = 3
LEAST_Z2 = 20.0             # squared z of a term's positives: 3 of 3 toxic passes up to a share of 13 %
PAIR_Z2 = 4.0               # squared z, two standard deviations, of a term's positives beside a telling toxic one
FACTORS = 8
EPOCHS = 12
STEPS = 1_500               # at least, so that a small sample is learnt as far as a large one
THRESHOLD = 0.3
_FILTER_BITS = 22


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, terms): the distinct word hashes of every text."""
    for batch in batches:
        for a, b in slices(batch.column(2), 1 << 20):
            h, row, _ = distinct(*words(batch.column(2).slice(a, b - a)))
            off = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                 pa.ListArray.from_arrays(pa.array(off), pa.array(h.astype(np.int64)))], names=["doc_id", "toxic", "terms"])
    tidy()


class Machine:
    """w0 + sum of w + half of (sum of v) squared less the sum of v squared."""

    def __init__(self, w0: float, keys: np.ndarray, w: np.ndarray, v: np.ndarray):
        order = np.argsort(keys)
        self.w0, self.keys, self.w, self.v = w0, keys[order], w[order], v[order]
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[(self.keys & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def score(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        h, row = words(texts)
        maybe = self.seen[(h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)]
        h, row = h[maybe], row[maybe]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        own = self.keys[at] == h
        at, row = at[own], row[own]
        pair = np.unique(row * len(self.keys) + at)
        at, row = pair % len(self.keys), pair // len(self.keys)
        z = np.full(n, self.w0) + np.bincount(row, self.w[at], n)
        for k in range(self.v.shape[1]):
            f = self.v[at, k]
            s = np.bincount(row, f, n)
            z += 0.5 * (s * s - np.bincount(row, f * f, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], y: np.ndarray, terms: int, factors: int = FACTORS, epochs: int = EPOCHS,
        rate: float = 0.1, ridge: float = 1.0, batch: int = 128) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss, AdaGrad, fixed seed; the penalty stands against all rows
    together.  rows: the term numbers of each text."""
    decay = ridge / len(rows)
    epochs = max(epochs, -(-STEPS * batch // len(rows)))
    rng = np.random.default_rng(7)
    prior = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    w0, w = float(np.log(prior / (1 - prior))), np.zeros(terms)
    v = rng.normal(0, 0.01, (terms, factors))
    g0, gw, gv = 1e-8, np.full(terms, 1e-8), np.full((terms, factors), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            n = np.array([len(rows[i]) for i in part])
            idx = np.concatenate([rows[i] for i in part]) if n.sum() else np.zeros(0, np.int64)
            who = np.repeat(np.arange(len(part)), n)
            vi = v[idx]
            s = np.zeros((len(part), factors))
            np.add.at(s, who, vi)
            q = np.zeros((len(part), factors))
            np.add.at(q, who, vi * vi)
            z = w0 + np.bincount(who, w[idx], len(part)) + 0.5 * (s * s - q).sum(1)
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
            d0 = err.mean()
            g0 += d0 * d0
            w0 -= rate * d0 / np.sqrt(g0)
            uniq, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, err[who], len(uniq)) / len(part) + decay * w[uniq]
            gw[uniq] += dw * dw
            w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            dv = np.zeros((len(uniq), factors))
            np.add.at(dv, inv, err[who, None] * (s[who] - vi))
            dv = dv / len(part) + decay * v[uniq]
            gv[uniq] += dv * dv
            v[uniq] -= 0.1 * rate * dv / np.sqrt(gv[uniq])
    return w0, w, v


def _partners(flat: DataFrame, telling: DataFrame, found: set[int], terms: int) -> set[int]:
    """Terms of ``flat`` (row, toxic, term) that raise the share of toxic rows among
    those that hold one of ``telling``; as many as fit beside ``found``."""
    company = saved(flat.join(F.broadcast(telling), "term", "left_semi").select("row", "toxic").distinct(), "company")
    n, pos = company.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or pos in (0, n) or len(found) >= terms:
        return set()
    share = pos / n
    z2 = F.pow(F.col("p") - F.col("d") * share, 2) / (F.col("d") * share * (1 - share))
    best = (flat.join(company.select("row"), "row", "left_semi")
            .groupBy("term").agg(F.count(F.lit(1)).alias("d"), F.sum("toxic").cast("double").alias("p"))
            .filter((F.col("d") >= LEAST_DOCS) & (F.col("p") > F.col("d") * share) & (z2 >= PAIR_Z2))
            .orderBy(z2.desc(), "term").limit(terms).select("term").collect())  # bounded: ``terms``
    return set([r.term for r in best if r.term not in found][:terms - len(found)])


def train(docs: DataFrame, labels: DataFrame, use: Column, sample: int = SAMPLE, terms: int = TERMS) -> Machine | None:
    """The machine learnt from labelled rows for which ``use`` holds; None when
    there are none or only one class.

    At most ``sample`` label rows are broadcast to find their texts; term
    counts are Spark aggregates over the sample; at most ``terms`` + 1 rows of
    the model reach the driver.
    """
    import pandas as pd
    spark = docs.sparkSession
    ship_package(spark)
    chosen = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(use)
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    chosen = saved(chosen, "labels")
    texts = (docs.select("doc_id", "text").filter("text is not null")
             .join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text"))    # bounded: ``sample`` rows
    # rows that repeat a doc_id count once (with different texts, one of them), so the fit stays bounded
    seen = saved(texts.mapInArrow(_terms, "doc_id long, toxic int, terms array<long>")
                 .groupBy(F.col("doc_id").alias("row")).agg(F.max("toxic").alias("toxic"), F.min("terms").alias("terms")), "terms")
    n, pos = seen.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not pos or pos == n:
        return None
    flat = seen.select("row", "toxic", F.explode("terms").alias("term"))
    share = pos / n
    z2 = F.pow(F.col("p") - F.col("d") * share, 2) / (F.col("d") * share * (1 - share))
    counts = saved(flat.groupBy("term").agg(F.count(F.lit(1)).alias("d"), F.sum("toxic").cast("double").alias("p"))
                   .filter(F.col("d") >= LEAST_DOCS), "counts")
    telling = counts.filter(z2 >= LEAST_Z2).orderBy(z2.desc(), "term").limit(terms - CONTEXT).select("term")
    common = counts.orderBy(F.col("d").desc(), "term").limit(CONTEXT).select("term")
    found = {r.term for r in telling.union(common).collect()}                   # bounded: ``terms``
    found |= _partners(flat, telling.join(counts.filter(F.col("p") > F.col("d") * share), "term").select("term"),
                       found, terms)
    keys = np.array(sorted(found), np.int64)
    if not len(keys):
        return None
    table = spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)], "term long, no long")
    few = (flat.join(F.broadcast(table), "term").groupBy("row").agg(F.sort_array(F.collect_list("no")).alias("nos"))
           .join(seen.select("row", "toxic"), "row", "right")
           .select("row", "toxic", F.coalesce("nos", F.array().cast("array<long>")).alias("nos")))

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row")
        w0, w, v = fit([np.asarray(x, np.int64) for x in part["nos"]], part["toxic"].to_numpy(float), len(keys))
        return pd.DataFrame({"no": range(-1, len(w)), "w": [w0, *w], "v": [[]] + [list(x) for x in v]})

    model = few.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "no long, w double, v array<double>").collect()
    model = sorted(model, key=lambda r: r.no)                                   # bounded: ``terms`` + 1
    return Machine(model[0].w, keys.astype(np.uint64), np.array([r.w for r in model[1:]]),
                   np.array([r.v for r in model[1:]]))


def scores(docs: DataFrame, model: Machine | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): one row per row of ``docs``.

    A null or empty text has the score of no terms; without a model all scores
    are 0.  Repeated rows get equal scores; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if model is None:
        return rows.select("key", F.lit(0.0).alias("score"))
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(model.score(batch.column(1).slice(a, b - a)))],
                    names=["key", "score"])
        tidy()

    return rows.mapInArrow(run, "key long, score double")


def op9(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Query op9: (doc_id, held_out, score, predicted) of every document."""
    model = train(docs, labels, crc_class(F.col("doc_id"), 4) != 2)
    return scores(docs, model).select(
        F.col("key").alias("doc_id"), (crc_class(F.col("key"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score ``THRESHOLD`` or more; all columns stay."""
    model = train(docs, labels, crc_class(F.col("doc_id"), 4) != 2)
    if model is None:
        return docs
    ship_package(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at), 1 << 20):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(model.score(part.column(at)) < THRESHOLD))
        tidy()

    return docs.mapInArrow(run, docs.schema)
