"""Near-duplicate documents by ProbMinHash.

A text is its five-word shingles.  Every shingle is a Poisson process with its
weight as rate; each arrival picks a register, and the register keeps the
earliest arrival's shingle.  A process ends as soon as its next arrival is later
than every register's.  Equal registers estimate the probability Jaccard
similarity.  Bands of registers propose pairs, the estimate drops hopeless ones,
and the shingle sets themselves decide: a link is a Jaccard similarity of
distinct shingles of 0.8 or more.

There are two signatures: with weights of 1, whose probability Jaccard is the
plain one of distinct shingles, so it bounds the links that can be missed
whatever repeats; and with weights of 1 + ln(count).  Either one proposes a pair
and either one keeps it.  The same arrivals make both, so they are equal where no
shingle repeats, and the second is kept only for texts where one does.

Equal texts are one node from the start.  In a band's bucket every member meets
three hubs; members that the links found so far don't already connect are
compared all with all.  Where the bucket is large, that happens in blocks, which
also hold the shingle sets of members whose registers agree, so that only links
leave a block.  So members of one class are not paired off, and no proposed link
between classes is left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import discard, fresh, saved, ship_package, tidy
from reviewlens.llm.components import components
from reviewlens.llm.hashing import distinct, mix, shingles, slices

WORDS = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 5                    # 25 bands of 5: a pair at 0.8 shares a band with probability 0.99995
SLACK = 0.14                # a pair is dropped below an estimate of 0.66: 4 standard deviations under 0.8
SMALL = 32                  # members of a bucket that a plain join pairs off
_BAND_BITS = 8              # up to 256 bands
BLOCK = 512                 # members of a larger bucket compared in one task with as many others
BLOCK_SHINGLES = 2_000_000  # shingles of those members (16 MB), so that long texts make smaller blocks
_CHUNK = 4096               # shingles compared at once
SLICE_BYTES = 1 << 20       # of text shingled at once; a longer text is a slice of its own
_ARRIVALS = 1 << 17         # processes run at once


def _arrive(first: np.ndarray, keep: np.ndarray, h: np.ndarray, row: np.ndarray, weight: np.ndarray,
            n: int, registers: int) -> None:
    """Runs the processes of ``h`` against the registers' earliest arrivals so far."""
    t = np.zeros(len(h))
    k = 0
    while len(h):
        k += 1
        r = mix(h + np.uint64(k * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        t = t - np.log(u) / weight
        at = row.astype(np.int64) * registers + (mix(r) % np.uint64(registers)).astype(np.int64)
        early = t < first[at]
        np.minimum.at(first, at[early], t[early])
        won = early.copy()
        won[early] = t[early] == first[at[early]]
        keep[at[won]] = h[won]
        late = first.reshape(n, registers).max(axis=1)
        alive = t < late[row]
        h, row, weight, t = h[alive], row[alive], weight[alive], t[alive]


def signatures(h: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """(n, registers) of int32: the registers of rows 0 .. n - 1, from distinct
    shingle hashes ``h`` of ``row`` with weights.  Rows without shingles: 0."""
    first = np.full(n * registers, np.inf)
    keep = np.zeros(n * registers, np.uint64)
    for at in range(0, len(h), _ARRIVALS):           # later processes end sooner, as registers are filled
        part = slice(at, at + _ARRIVALS)
        _arrive(first, keep, h[part], row[part], weight[part], n, registers)
    return (mix(keep) & np.uint64(0x7FFFFFFF)).astype(np.int32).reshape(n, registers)


def _sign(words: int, registers: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for a, b in slices(texts, SLICE_BYTES):
                h, row, count = distinct(*shingles(texts.slice(a, b - a), words))
                sig = signatures(h, row, np.ones(len(h)), b - a, registers)
                n = np.bincount(row, minlength=b - a)
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, (b - a) * registers + 1, registers, dtype=np.int32)), pa.array(sig.ravel()))
                again = np.zeros(b - a, bool)        # texts in which a shingle repeats
                again[row[count > 1]] = True
                own, place = again[row], np.cumsum(again) - 1
                few = signatures(h[own], place[row[own]], 1 + np.log(count[own]), int(again.sum()), registers)
                off = np.concatenate([[0], np.cumsum(again) * registers]).astype(np.int32)
                weighted = pa.ListArray.from_arrays(pa.array(off), pa.array(few.ravel()), mask=pa.array(~again))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in ("id", "sha")]
                    + [pa.array(n.astype(np.int64)), flat, weighted], names=["id", "sha", "n", "sig", "wsig"])
        tidy()
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            ids = batch.column(batch.schema.get_field_index("id"))
            for a, b in slices(texts, SLICE_BYTES):
                h, row, _ = distinct(*shingles(texts.slice(a, b - a), words))
                off = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.ListArray.from_arrays(pa.array(off), pa.array(h.astype(np.int64)))],
                    names=["id", "set"])
        tidy()
    return run


def _hopeful(pairs: DataFrame, sigs: DataFrame, registers: int, similarity: float) -> DataFrame:
    """Pairs (a, b) whose registers agree often enough in either signature."""
    s = sigs.select("id", "sig", "wsig")
    least = int(registers * (similarity - SLACK))
    equal = lambda x, y: F.size(F.filter(F.zip_with(x, y, lambda u, v: u == v), lambda e: e))
    weighted = F.when(F.col("w1").isNotNull() | F.col("w2").isNotNull(),
                      equal(F.coalesce("w1", "s1"), F.coalesce("w2", "s2")) >= least).otherwise(False)
    return (pairs.join(s.withColumnsRenamed({"id": "a", "sig": "s1", "wsig": "w1"}), "a")
            .join(s.withColumnsRenamed({"id": "b", "sig": "s2", "wsig": "w2"}), "b")
            .filter((equal("s1", "s2") >= least) | weighted).select("a", "b"))


def _registers(rows: pd.DataFrame) -> list[np.ndarray]:
    """The members' registers with weights of 1 and, if any member has other ones, with its weights."""
    plain = np.stack(rows["sig"].to_numpy())
    if rows["wsig"].isna().all():
        return [plain]
    return [plain, np.stack([s if w is None else w for s, w in zip(rows["sig"], rows["wsig"])])]


def _agreeing(band: int, one: pd.DataFrame, two: pd.DataFrame, bands: int, registers: int,
              least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs in different classes that agree in ``least``
    registers of either signature, for the first band that a pair shares; other
    buckets skip it."""
    left, right = _registers(one), _registers(two)
    hope = np.zeros((len(one), len(two)), bool)
    for k in range(max(len(left), len(right))):
        x, y = left[min(k, len(left) - 1)], right[min(k, len(right) - 1)]
        same = np.zeros(hope.shape, np.int16)
        for r in range(registers):
            same += x[:, r, None] == y[None, :, r]
        hope |= same >= least
    hope &= one["c"].to_numpy()[:, None] != two["c"].to_numpy()[None, :]
    i, j = np.nonzero(hope & (one["id"].to_numpy()[:, None] != two["id"].to_numpy()[None, :]))
    shared = np.zeros((len(i), bands), bool)         # buckets hold both signatures' bands
    for x, y in itertools.product(left, right):
        shared |= (x[i] == y[j]).reshape(len(i), bands, registers // bands).all(2)
    here = shared.argmax(1) == (band & ((1 << _BAND_BITS) - 1))
    return i[here], j[here]


def _shared(left: list, right: list) -> np.ndarray:
    """(left, right) counts of the values that two lists of sets have in common."""
    def flat(sets: list) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(v) for v in sets])

    (h1, r1), (h2, r2) = flat(left), flat(right)
    common = np.intersect1d(h1, h2)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(common):
        return out

    def placed(h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        hit = common[at] == h
        at, r = at[hit], r[hit]
        order = np.argsort(at, kind="stable")
        return at[order], r[order]

    sides = [(*placed(h1, r1), len(left)), (*placed(h2, r2), len(right))]
    for low in range(0, len(common), _CHUNK):
        marks = []
        for at, r, n in sides:
            s, e = np.searchsorted(at, [low, low + _CHUNK])
            m = np.zeros((n, _CHUNK), np.float32)
            m[r[s:e], at[s:e] - low] = 1
            marks.append(m)
        out += marks[0] @ marks[1].T
    return out


def _across(state: DataFrame, sigs: DataFrame, texts: DataFrame, words: int, bands: int, registers: int,
            similarity: float) -> DataFrame:
    """Links (a, b) between members (band, id, c, n, total) in different classes.

    A bucket is dealt in blocks of some ``BLOCK`` members and ``BLOCK_SHINGLES``
    shingles, two blocks to a task.  A first pass names the members whose
    registers agree with some other member's; a second pass brings those
    members' shingle sets to the same blocks, compares the agreeing pairs there
    and emits one link for every two classes that a block connects.  Pairs
    that are no links never leave a task.
    """
    least = int(registers * (similarity - SLACK))

    def sides(key: tuple, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        rows = rows.sort_values("id")
        return rows[rows["own"] == key[1]], rows[rows["own"] == key[2]]

    def name(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one, two = sides(key, rows)
        if not len(one) or not len(two):
            return rows.iloc[:0][["band", "i", "j", "id", "c", "own"]]
        i, j = _agreeing(key[0], one, two, bands, registers, least)
        at = np.union1d(one.index.to_numpy()[i], two.index.to_numpy()[j])
        return rows.loc[at, ["band", "i", "j", "id", "c", "own"]]

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one, two = sides(key, rows)
        if not len(one) or not len(two):
            return pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
        i, j = _agreeing(key[0], one, two, bands, registers, least)
        left, right = one["set"].tolist(), two["set"].tolist()
        size = np.array([len(v) for v in left])[i] + np.array([len(v) for v in right])[j]
        both = _shared(left, right)[i, j]
        link = both >= similarity * (size - both)
        found = pd.DataFrame({"a": one["id"].to_numpy()[i[link]], "b": two["id"].to_numpy()[j[link]],
                              "ca": one["c"].to_numpy()[i[link]], "cb": two["c"].to_numpy()[j[link]]})
        return found.drop_duplicates(["ca", "cb"])[["a", "b"]]

    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_SHINGLES))
    dealt = (state.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("id", "band"), blocks)})
             .select("band", "id", "c", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
             .select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "c", "own"))
    sig = sigs.select("id", "sig", "wsig")
    named = saved(dealt.join(sig, "id").groupBy("band", "i", "j").applyInPandas(
        name, "band long, i long, j long, id long, c long, own long"), "named")
    need = saved(named.select("id").distinct(), "need")
    sets = saved(texts.join(need, "id", "left_semi").select("id", "text")
                 .mapInArrow(_sets(words), "id long, set array<long>").distinct(), "block-sets")
    out = saved(named.join(sig, "id").join(sets, "id").groupBy("band", "i", "j")
                .applyInPandas(compare, "a long, b long"), "block-links")
    discard(named, need, sets)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs whose sets of distinct shingles have the Jaccard similarity asked for.

    Only texts that stand in a pair are shingled again.  Their ids are written
    first, so that the planner knows the list's size: under its threshold for
    broadcasts no text is shuffled, over it texts and ids meet in a shuffle.
    """
    need = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    need = saved(need, "need")
    sets = saved(texts.join(need, "id", "left_semi").select("id", "text")
                 .mapInArrow(_sets(words), "id long, set array<long>"), "sets")
    both = F.size(F.array_intersect("x", "y"))
    out = saved(pairs.join(sets.withColumnsRenamed({"id": "a", "set": "x"}), "a")
                .join(sets.withColumnsRenamed({"id": "b", "set": "y"}), "b")
                .withColumn("both", both)
                .filter(F.col("both") >= similarity * (F.size("x") + F.size("y") - F.col("both")))
                .select("a", "b"), "links")
    discard(need, sets)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                    similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, sha, class_id, rep, kept) for every row of ``docs``.

    rep is the smallest key with the same text, class_id the smallest key that
    links lead to, kept whether the row has that key (and its text).  A null
    text counts as empty; texts without a word link only with equal texts.  A
    null key can represent nothing: such a row takes the class of an equal
    text with a key, or has none and is kept.  Texts that share a key count as
    one node; repeated rows are kept or not together.  Other columns are not
    read; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    registers = bands * rows
    base = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = saved(base.withColumn("sha", F.sha2("text", 256)).mapInArrow(
        _sign(words, registers), "id long, sha string, n long, sig array<int>, wsig array<int>"), "signed")
    reps = signed.groupBy("sha").agg(F.min("id").alias("rep"))
    nodes = saved(signed.filter("id is not null and n > 0").select("id", "sha", "n", "sig", "wsig")
                  .join(reps.withColumnRenamed("sha", "_sha"), (F.col("sha") == F.col("_sha")) & (F.col("id") == F.col("rep")))
                  .groupBy("id", "sha").agg(F.first("sig").alias("sig"), F.first("wsig").alias("wsig"), F.first("n").alias("n")), "nodes")
    # the registers of copies aren't read again
    named = saved(signed.select("id", "sha"), "named")
    discard(signed)
    reps = named.groupBy("sha").agg(F.min("id").alias("rep"))
    sigs = nodes.groupBy("id").agg(F.min(F.struct("sig", "wsig")).alias("s"), F.max("n").alias("size")) \
        .select("id", "s.sig", "s.wsig", "size")
    band = lambda sig: F.array(*[                    # noqa: E731; the low bits hold the band's number
        F.shiftleft(F.xxhash64(*[F.get(sig, F.lit(b * rows + r)) for r in range(rows)]), _BAND_BITS) + b
        for b in range(bands)])
    spread = nodes.select("id", F.explode(F.when(F.col("wsig").isNull(), band("sig")).otherwise(
        F.array_union(band("sig"), band("wsig")))).alias("band"))
    # a text in the middle of its group shares buckets with most of it: the best hub
    sizes = spread.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowd = saved(spread.join(sizes, "band"), "crowd")
    middle = crowd.groupBy("id").agg(F.sum("n").alias("m"))
    members = saved(crowd.join(middle, "id").select("band", "id", "m"), "members")
    discard(crowd)
    hubs = members.groupBy("band").agg(F.max(F.struct("m", "id")).alias("h1"), F.min("id").alias("h2"),
                                       F.min(F.struct(F.xxhash64("id"), "id")).alias("h3")) \
        .select("band", F.array_distinct(F.array("h1.id", "h2", "h3.id")).alias("hubs"))

    def pairs(df: DataFrame) -> DataFrame:
        return df.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    near = pairs(members.join(hubs, "band").select(F.col("id").alias("x"), F.explode("hubs").alias("y")))
    near = saved(_hopeful(near, sigs, registers, similarity), "near")
    links = _verified(near, base, words, similarity)
    # what the hubs left unconnected: pairs of members in different classes
    class_of = saved(components(links), "classes")
    state = (members.select("band", "id").join(class_of, F.col("id") == F.col("node"), "left")
             .select("band", "id", F.coalesce("component", "id").alias("c")))
    loose = state.groupBy("band").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 < c2").select("band")
    state = saved(state.join(loose, "band", "left_semi"), "loose")
    discard(members)
    counts = (state.join(sigs.select("id", "size"), "id").groupBy("band")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")))
    state = state.join(counts, "band")
    small = state.filter(F.col("n") <= SMALL).select("band", "id", "c")
    rest = (small.withColumnsRenamed({"id": "x", "c": "cx"}).join(
        small.withColumnsRenamed({"id": "y", "c": "cy"}), "band").filter("x < y and cx <> cy"))
    rest = _hopeful(pairs(rest).join(near, ["a", "b"], "left_anti"), sigs, registers, similarity)
    rest = saved(rest, "rest")
    discard(near)
    more = _verified(rest, base, words, similarity).unionByName(
        _across(state.filter(F.col("n") > SMALL), sigs, base, words, bands, registers, similarity))
    discard(nodes, rest)
    if not more.isEmpty():
        class_of = saved(components(links.unionByName(more)), "classes")
    out = (named.join(reps, "sha")
           .join(class_of, F.col("rep") == F.col("node"), "left")
           .withColumn("class_id", F.coalesce("component", "rep")))
    kept = F.coalesce(F.col("id") == F.col("class_id"), F.col("class_id").isNull())
    return out.select("id", "sha", "rep", "class_id", kept.alias("kept"))


def op4(spark, docs: DataFrame) -> DataFrame:
    """Query op4: (doc_id, rep, class_id, kept) of every document."""
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "rep", "class_id", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) without all but one document of each class.

    Of repeated rows with the kept key and text one stays; rows without a key follow
    ``near_duplicates``.  Other columns may have any names; an empty table stays empty.
    """
    id_, sha_ = fresh(docs, "id", "sha")
    found = near_duplicates(docs).filter("kept").select(F.col("id").alias(id_), F.col("sha").alias(sha_))
    again = found.groupBy(id_, sha_).count().filter((F.col("count") > 1) & F.col(id_).isNotNull()).limit(1)
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    out = docs.join(found.distinct(), F.col("doc_id").eqNullSafe(F.col(id_)) & (sha == F.col(sha_)), "left_semi")
    if not again.isEmpty():
        null_id = out.filter("doc_id is null")
        out = out.filter("doc_id is not null").withColumn(sha_, sha).dropDuplicates(["doc_id", sha_]).drop(sha_)
        out = out.unionByName(null_id)
    return out
