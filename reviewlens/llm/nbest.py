"""N-best segmentation with a SentencePiece vocabulary.

A text's lattice has an edge for every piece that stands in it.  A forward
Viterbi pass gives the best score up to every position; a backward A* search
from the end uses these scores as exact heuristics, so whole segmentations come
off the heap in the order of their scores.

No piece goes on after a character with a space mark, so the lattice falls apart
before each run of marks.  There the text is cut; the forward pass runs on each
part (once per worker for equal parts) and keeps its two best scores.  The
result is that of the whole lattice: in the N best segmentations of the text,
only the N - 1 parts whose second best costs least can differ from their best,
and these parts the A* search segments N times.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import ship_package, tidy
from reviewlens.llm.hashing import slices

N_BEST = 4
SPACE = "▁"
CACHE = 600_000             # parts whose best segmentation a worker keeps
LONG_PART = 2_000             # characters from which a part goes through the pass on its own
_INF = float("inf")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MODELS: dict = {}


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class Lattice:
    """The pieces in a text, by the position they end at, and the best score up to each position."""

    def __init__(self, model: Model, text: str):
        n = len(text)
        self.ends: list[list] = [[] for _ in range(n + 1)]
        self.best = best = [0.0] + [-_INF] * n
        get, unknown = model.prefixes.get, model.unknown
        for i in range(n):
            at, single = best[i], False
            for j in range(i + 1, n + 1):
                hit = get(text[i:j])
                if hit is None:
                    break
                if hit:
                    single |= j == i + 1
                    self.ends[j].append((i, hit[0], hit[1]))
                    best[j] = max(best[j], at + hit[1])
            if not single:                           # a character without a piece: its bytes or <unk>
                self.ends[i + 1].append((i, model.fallback(text[i]), unknown))
                best[i + 1] = max(best[i + 1], at + unknown)

    def paths(self) -> Iterator[tuple[float, list[int]]]:
        """(score, ids) of all segmentations, best first.  Among equal scores the
        search goes on with what it found last, so ties don't widen it."""
        best, ends = self.best, self.ends
        heap = [(-best[-1], 0, len(best) - 1, 0.0, None)]
        count = 0
        while heap:
            f, _, pos, done, path = heapq.heappop(heap)
            if not pos:
                ids = []
                while path:
                    ids += path[0]
                    path = path[1]
                yield -f, ids
                continue
            for start, ids, score in ends[pos]:
                count -= 1
                g = done + score
                heapq.heappush(heap, (-(best[start] + g), count, start, g, (ids, path)))


class Model:
    """A piece vocabulary with scores, read with the public library."""

    def __init__(self, path: str):
        import sentencepiece
        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, self.byte, self.names = {}, {}, []
        for i in range(lib.vocab_size()):
            name = lib.id_to_piece(i)
            self.names.append(name)
            if lib.is_byte(i):
                self.byte[int(name[1:-1], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.pieces[name] = ((i,), lib.get_score(i))
        self.unknown = min(s for _, s in self.pieces.values()) - 10
        self.prefixes = {p[:k]: () for p in self.pieces for k in range(1, len(p))} | self.pieces
        self.longest = max(map(len, self.pieces))
        self.by_hash = {}                            # piece length -> sorted hashes, their scores and ids
        for size in range(1, self.longest + 1):
            rows = sorted((_hash(p), v[1], v[0][0]) for p, v in self.pieces.items() if len(p) == size) or [(0, -_INF, 0)]
            keys = np.array([r[0] for r in rows], np.uint64)
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two pieces of one length share a hash")
            self.by_hash[size] = keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.int32)
        self.spelling = [bytes([int(name[1:-1], 16)]) if lib.is_byte(i) else name.encode() for i, name in enumerate(self.names)]
        self.words_only = not any(q == SPACE and p != SPACE for w in self.pieces for p, q in itertools.pairwise(w))
        probe = "Ａ ﬁ  é\t \n "
        self.plain = lib.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        self.cache: dict[str, tuple] = {}
        self.found: dict[tuple, list] = {}

    def fallback(self, char: str) -> tuple[int, ...]:
        if len(self.byte) == 256:
            return tuple(self.byte[b] for b in char.encode("utf-8", "replace"))
        return (self.lib.unk_id(),)

    def normalize(self, text: str) -> str:
        """The model's own normalisation; short cut where it only marks spaces."""
        if not text:
            return ""
        return SPACE + text.replace(" ", SPACE) if self.plain else self.lib.normalize(text)

    def parts(self, normal: str) -> list[str]:
        """The text cut where a space mark follows another character - no piece spans that."""
        if not self.words_only:
            return [normal] if normal else []
        found = normal.split(SPACE)
        if "" not in found[1:]:
            out = [SPACE + x for x in found[1:]]
            return [found[0]] + out if found[0] else out
        out, marks = ([found[0]] if found[0] else []), 0
        for x in found[1:]:
            marks += 1
            if x:
                out.append(SPACE * marks + x)
                marks = 0
        return out + ([SPACE * marks] if marks else [])

    def viterbi(self, parts: list[str]) -> None:
        """Puts (ids of the best segmentation as bytes, its score, what the second
        best costs) of every part into the cache; parts of one length go through
        the forward pass together."""
        by_length: dict[int, list[str]] = {}
        for p in parts:
            by_length.setdefault(len(p), []).append(p)
        for n, group in by_length.items():
            if n > LONG_PART:
                for p in group:
                    self._alone(p)
                continue
            step = max(1, (1 << 17) // n)
            for a in range(0, len(group), step):
                self._forward(group[a:a + step], n)

    def _forward(self, group: list[str], n: int) -> None:
        codes = np.frombuffer("".join(group).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64).reshape(-1, n)
        hashed, scores = codes + np.uint64(1), {}
        number = np.full((min(n, self.longest) + 1, len(group), n), -1, np.int32)   # ids by size and start
        for size in range(1, min(n, self.longest) + 1):
            if size > 1:
                hashed = hashed[:, :n - size + 1] * _BASE + codes[:, size - 1:] + np.uint64(1)
            keys, values, numbers = self.by_hash[size]
            at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            own = keys[at] == hashed
            scores[size] = np.where(own, values[at], self.unknown if size == 1 else -_INF)
            number[size, :, :n - size + 1] = np.where(own, numbers[at], -1)
        best = np.full((n + 1, len(group)), -_INF)
        best[0] = 0.0
        second, back = np.full_like(best, -_INF), np.zeros(best.shape, np.int64)
        for j in range(1, n + 1):
            top, nxt, how = best[j], second[j], back[j]
            for size in range(min(j, self.longest), 0, -1):
                s = scores[size][:, j - size]
                v = best[j - size] + s
                more = v > top
                nxt[:] = np.maximum(nxt, np.where(more, np.maximum(top, second[j - size] + s), v))
                how[more] = size
                np.maximum(top, v, out=top)
        with np.errstate(invalid="ignore"):
            cost = best[n] - second[n]
        # back from the ends of all parts at once; -2 stands where a part has begun already
        row, pos, steps = np.arange(len(group)), np.full(len(group), n), []
        while pos.any():
            size = back[pos, row]
            start = pos - size
            steps.append(np.where(pos > 0, number[size, row, np.maximum(start, 0)], -2))
            pos = np.where(pos > 0, start, 0)
        ids = np.stack(steps[::-1], 1)
        strange = (ids == -1).any(1).tolist()        # a character without a piece on the best path
        used = ids != -2
        raw = ids[used].astype(np.uint32).tobytes()
        off = np.concatenate([[0], np.cumsum(used.sum(1))]) * 4
        for k, (p, a, b, total, c) in enumerate(zip(group, off[:-1].tolist(), off[1:].tolist(), best[n].tolist(),
                                                    cost.tolist(), strict=True)):
            self.cache[p] = (self._spelled(p, back[:, k].tolist()) if strange[k] else raw[a:b], total, c)

    def _alone(self, part: str) -> None:
        """The same for one long part, such as a text without spaces, in time linear in its length."""
        n = len(part)
        best, second, back = [0.0] + [-_INF] * n, [-_INF] * (n + 1), [0] * (n + 1)

        def reach(i: int, j: int, score: float) -> None:
            v = best[i] + score
            if v > best[j]:
                second[j] = max(second[j], best[j], second[i] + score)
                best[j], back[j] = v, j - i
            else:
                second[j] = max(second[j], v)

        get = self.prefixes.get
        for i in range(n):
            single = False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                hit = get(part[i:j])
                if hit is None:
                    break
                if hit:
                    single |= j == i + 1
                    reach(i, j, hit[1])
            if not single:
                reach(i, i + 1, self.unknown)
        self.cache[part] = self._spelled(part, back), best[n], best[n] - second[n] if second[n] > -_INF else _INF

    def _spelled(self, part: str, steps: list[int]) -> bytes:
        """The ids of a part whose best segmentation spells out characters."""
        at, ids = len(part), []
        while at:
            piece = part[at - steps[at]:at]
            ids.append(self.pieces[piece][0] if piece in self.pieces else self.fallback(piece))
            at -= steps[at]
        return array("I", itertools.chain.from_iterable(reversed(ids))).tobytes()

    def part(self, part: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a part."""
        if len(self.found) > CACHE // 20:
            self.found.clear()
        if (part, n) not in self.found:
            self.found[part, n] = list(itertools.islice(Lattice(self, part).paths(), n))
        return self.found[part, n]

    def n_best(self, texts: pa.Array | list, n: int) -> list[list[tuple[float, bytes]]]:
        """The n best (score, ids as 32-bit bytes) of every text; an empty text has one, without ids.

        Texts whose words stand one space apart are cut and numbered as a whole batch, and
        Python sees each distinct word once; others are cut one by one.
        """
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        filled = pc.fill_null(texts, "")
        odd = pc.equal(pc.binary_length(filled), 0)
        for test in (pc.match_substring(filled, "  "), pc.starts_with(filled, " "), pc.ends_with(filled, " "),
                     pc.match_substring(filled, SPACE)):
            odd = pc.or_(odd, test)
        odd = np.asarray(odd) if self.plain and self.words_only else np.ones(len(texts), bool)
        out: list = [None] * len(texts)
        if not odd.all():
            for i, found in zip(np.flatnonzero(~odd).tolist(), self._spaced(filled.filter(pa.array(~odd)), n), strict=True):
                out[i] = found
        for i in np.flatnonzero(odd).tolist():
            parts = self.parts(self.normalize(filled[i].as_py()))
            best = self._best(parts)
            ids = [b[0] for b in best]
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            out[i] = self._combine(parts.__getitem__, np.array([b[2] for b in best]), math.fsum(b[1] for b in best),
                                   b"".join(ids), off, n)
        return out

    def _best(self, parts: list[str]) -> list[tuple]:
        """The cache's rows of parts, which it gets first where they are missing."""
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        got = list(map(cache.get, parts))
        if None in got:
            self.viterbi(list({p for p, g in zip(parts, got, strict=True) if g is None}))
            got = list(map(cache.__getitem__, parts))
        return got

    def _spaced(self, texts: pa.Array, n: int) -> Iterator[list[tuple[float, bytes]]]:
        """The n best of texts whose words stand one space apart."""
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten().dictionary_encode()
        off = np.asarray(lists.offsets, np.int64)
        off, no = off - off[0], np.asarray(words.indices, np.int64)
        names = [SPACE + w for w in words.dictionary.to_pylist()]
        ids, scores, costs = zip(*self._best(names), strict=True)
        scores, costs = np.array(scores), np.array(costs)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, first = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(size) - size
        many = size[no]
        at = np.concatenate([[0], np.cumsum(many)])
        raw = pool[np.repeat(first[no] - at[:-1], many) + np.arange(at[-1])].tobytes()
        totals = np.add.reduceat(scores[no], off[:-1]).tolist()
        at *= 4
        for k, total in enumerate(totals):
            a, b = int(off[k]), int(off[k + 1])
            own = at[a:b + 1]
            yield self._combine(lambda i, a=a: names[no[a + i]], costs[no[a:b]], total, raw[own[0]:own[-1]], own - own[0], n)

    def _combine(self, part_at, costs: np.ndarray, total: float, best: bytes, off: np.ndarray, n: int) -> list[tuple[float, bytes]]:
        """The n best of a text from its parts: ``best`` holds the ids of the best one, part i
        from byte off[i] on; the others are that one with some parts exchanged."""
        free = np.argsort(costs, kind="stable")[:n - 1] if len(costs) < 64 else np.argpartition(costs, n - 1)[:n - 1]
        combos = [(0.0, ())]
        for k in free.tolist():
            if costs[k] < _INF:
                own = self.part(part_at(k), n)
                combos = sorted([(c + own[0][0] - s, picks + ((k, i),)) for c, picks in combos for s, i in own],
                                key=lambda x: x[0])[:n]
        out = []
        for cost, picks in combos:
            line, at = [], 0
            for k, i in sorted(picks, key=lambda x: x[0]):
                line += [best[at:off[k]], array("I", i).tobytes()]
                at = off[k + 1]
            out.append((total - cost, b"".join([*line, best[at:]])))
        return out

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, bytes as UTF-8, space marks as spaces,
        without the mark the model put in front."""
        text = b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def normal_text(self, text: str | None) -> str:
        """What decoding the ids of a text has to give: its normal form with spaces for marks."""
        normal = self.normalize(text or "").replace(SPACE, " ")
        return normal[1:] if normal.startswith(" ") else normal


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, n: int = N_BEST, key: str = "doc_id", text: str = "text",
           keep_ids: bool = True, check: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, n_found, scores (array<double>, best
    first), n_ids and ids_crc32 (of the ids as little-endian 32-bit numbers) per
    segmentation and, with ``keep_ids``, ids (array<array<int>>).  With ``check`` the best
    segmentation is decoded again: decoded_sha256 (of the decoded text, UTF-8) and
    round_trip, whether that is the normalised text.

    A null or empty text has one segmentation without ids, of score 0.  A text
    may have fewer than n.  Ties come in a fixed order.  Repeated rows get equal
    results; a null key stays null; other columns are not read.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = "key long, n_found int, scores array<double>, n_ids array<long>, ids_crc32 array<long>" \
        + ", ids array<array<int>>" * keep_ids + ", decoded_sha256 string, round_trip boolean" * check

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for a, b in slices(batch.column(1), 4 << 20):
                found = m.n_best(batch.column(1).slice(a, b - a), n)
                cols = [batch.column(0).slice(a, b - a), pa.array([len(f) for f in found], pa.int32()),
                        pa.array([[s for s, _ in f] for f in found], pa.list_(pa.float64())),
                        pa.array([[len(i) // 4 for _, i in f] for f in found], pa.list_(pa.int64())),
                        pa.array([[zlib.crc32(i) for _, i in f] for f in found], pa.list_(pa.int64()))]
                if keep_ids:
                    cols.append(pa.array([[list(array("I", i)) for _, i in f] for f in found],
                                         pa.list_(pa.list_(pa.int32()))))
                if check:
                    again = [m.decode(array("I", f[0][1])) for f in found]
                    same = [d == m.normal_text(t) for d, t in zip(again, batch.column(1).slice(a, b - a).to_pylist(), strict=True)]
                    cols += [pa.array([hashlib.sha256(d.encode()).hexdigest() for d in again]), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=[
                    "key", "n_found", "scores", "n_ids", "ids_crc32"] + ["ids"] * keep_ids + ["decoded_sha256", "round_trip"] * check)
        tidy()

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, key: str = "key", ids: str = "ids") -> DataFrame:
    """(key, text) of id lists (array<int>; null: null)."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            text = [None if i is None else m.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["key", "text"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(ids).cast("array<int>").alias("ids")) \
        .mapInArrow(run, "key long, text string")


def op6(spark, docs: DataFrame) -> DataFrame:
    """Query op6: the four best segmentations of every document, as digests, the best one
    decoded again."""
    import public_tokenizers as given
    return encode(docs, given.path("piece_bpe_32k.model"), keep_ids=False, check=True).withColumnRenamed("key", "doc_id")
