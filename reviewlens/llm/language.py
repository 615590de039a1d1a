"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (n = 1, 2, 3: a
blended spectrum, presence only) that both hold, over the root of the product
of their own numbers.  N-grams are hashed into ``DIM`` bits.  Nystroem
landmarks stand for the training texts, a kernel ridge regression of one
language against the rest is solved in their space, and texts are scored by
matrix products of whole batches.

It is fitted on at most ``PER_LANG`` texts a language and ``SAMPLE`` in all;
every text is scored, whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.common import crc_class, saved, ship_package
from reviewlens.llm.hashing import slices

DIM_BITS = 14
DIM = 1 << DIM_BITS
GRAMS = 3
LANDMARKS = 128
PER_LANG = 400
SAMPLE = 6_000
PIECE = 64                  # input partitions whose rows of a language are cut to ``PER_LANG`` together
RIDGE = 1e-3
ROWS = 256                  # texts in one matrix product
UNKNOWN = "und"

_MULT = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SHIFT = np.uint64(64 - DIM_BITS)


def presence(text: str) -> np.ndarray:
    """The hashed n-grams that the lower-cased text holds (bool, DIM)."""
    out = np.zeros(DIM, bool)
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    g = c
    for n in range(GRAMS):
        if n:
            g = (g[:-1] << np.uint64(21)) ^ c[n:]
        out[((g + np.uint64(n + 1)) * _MULT[n % 3]) >> _SHIFT] = True
    return out


class Model:
    def __init__(self, marks: np.ndarray, weight: np.ndarray, langs: list[str]):
        self.bits = np.packbits(marks, axis=1)
        self.weight, self.langs = weight, langs

    def matrix(self) -> np.ndarray:
        m = np.unpackbits(self.bits, axis=1).astype(np.float32)
        return (m / np.sqrt(np.maximum(m.sum(1, keepdims=True), 1))).T.copy()

    def predict(self, x: np.ndarray, marks: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return (x @ marks / norm) @ self.weight


def fit(x: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """``x``: the presence bits of every text.  Landmarks are spread evenly over the
    languages, first come first."""
    names = sorted(set(langs))
    each = max(2, landmarks // len(names))
    pick = [i for n in names for i in [j for j, g in enumerate(langs) if g == n][:each]]
    xf = x.astype(np.float32)
    norm = np.sqrt(np.maximum(xf.sum(1), 1))
    k = (xf @ xf[pick].T) / norm[:, None] / norm[pick][None, :]
    vals, vecs = np.linalg.eigh(k[pick].astype(float))
    good = vals > 1e-6 * vals.max()
    root = vecs[:, good] / np.sqrt(vals[good])
    phi = k @ root
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = np.array([1.0 / langs.count(g) for g in langs])         # every language weighs the same
    a = (phi * share[:, None]).T @ phi + ridge * np.eye(phi.shape[1])
    w = np.linalg.solve(a, (phi * share[:, None]).T @ y)
    return Model(x[pick], (root @ w).astype(np.float32), names)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, r, bits): the presence bits of every text, packed."""
    for batch in batches:
        for a, b in slices(batch.column(3), 4 << 20):
            texts = pc.utf8_lower(batch.column(3).slice(a, b - a)).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(a, b - a) for i in range(3)),
                 pa.array([np.packbits(presence(t)).tobytes() for t in texts], pa.binary())],
                names=["doc_id", "lang", "r", "bits"])


def train(docs: DataFrame, use: Column, per_lang: int = PER_LANG, sample: int = SAMPLE) -> Model | None:
    """The model learnt from texts with a language for which ``use`` holds;
    None when there are none.

    A doc_id counts once a language, however many rows repeat it (with different texts,
    one of them).  Texts become ``DIM`` bits where they lie; the fit gets at most
    ``sample`` rows of bits.
    """
    import pandas as pd
    ship_package(docs.sparkSession)
    by = Window.partitionBy("lang").orderBy("h", "doc_id")
    split = Window.partitionBy("lang", "piece").orderBy("h", "doc_id")
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).filter(use)
    rows = (known.select("doc_id", "lang").distinct()
            .select("doc_id", "lang", F.xxhash64("doc_id").alias("h"),
                    F.floor(F.spark_partition_id() / PIECE).alias("piece")))
    # the first rows of a language are among the first rows of its pieces, however these are cut; every
    # task keeps ``per_lang`` rows of a language before they move, so a piece is at most PIECE x per_lang rows
    rows = rows.withColumn("r", F.row_number().over(split)).filter(F.col("r") <= per_lang)
    chosen = saved(rows.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= per_lang)
                   .orderBy("r", "lang").limit(sample).select("doc_id", "lang", "r"), "chosen")
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])   # bounded: ``sample`` rows
    few = (texts.select("doc_id", "lang", "r", "text").mapInArrow(_bits, "doc_id long, lang string, r int, bits binary")
           .groupBy("doc_id", "lang", "r").agg(F.min("bits").alias("bits")))

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["r", "lang"])
        x = np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for b in part["bits"]]).astype(bool)
        return pd.DataFrame({"model": [pickle.dumps(fit(x, list(part["lang"])))]})

    got = few.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "model binary").collect()
    return pickle.loads(got[0].model) if got else None           # bounded: LANDMARKS x DIM bits


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score), one row per row of ``docs``.

    A text that is null or without a letter is 'und' with score 0, as is every
    text when there is no model.  Ties go to the first language by name.
    Repeated rows get equal results; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if model is None:
        return rows.select("key", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, names = model.matrix(), np.array(model.langs, object)
        for batch in batches:
            for a, b in slices(batch.column(1), 4 << 20):
                texts = pc.utf8_lower(batch.column(1).slice(a, b - a)).to_pylist()
                langs, score = [], []
                for at in range(0, len(texts), ROWS):
                    part = texts[at:at + ROWS]
                    x = np.zeros((len(part), DIM), np.float32)
                    for i, t in enumerate(part):
                        if t:
                            x[i] = presence(t)
                    z = model.predict(x, marks)
                    best = z.argmax(1)
                    known = [bool(t) and any(map(str.isalpha, t)) for t in part]
                    conf = np.clip((z[np.arange(len(part)), best] + 1) / 2, 0, 1)
                    langs += [str(names[j]) if k else UNKNOWN for j, k in zip(best, known, strict=True)]
                    score += [float(c) if k else 0.0 for c, k in zip(conf, known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                    names=["key", "lang_pred", "score"])

    return rows.mapInArrow(run, "key long, lang_pred string, score double")


def op10(spark, docs: DataFrame) -> DataFrame:
    """Query op10: (doc_id, held_out, lang_pred, score) of every document."""
    model = train(docs, crc_class(F.col("doc_id"), 3) != 1)
    return predict(docs, model).select(
        F.col("key").alias("doc_id"), (crc_class(F.col("key"), 3) == 1).alias("held_out"), "lang_pred", "score")
