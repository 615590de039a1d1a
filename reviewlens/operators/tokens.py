"""Model labels -> words and tags, and the distributed scoring hook.

A segmentation model predicts one label per character, with a start-marker
prediction first and an end-marker prediction last.  Label 0 opens a new word;
any other label extends the open word.  The tag of a word is the tag-model
label of its first character.  Decoding is in-row: batches of texts and labels go
through numpy as Arrow buffers (no step per character or word), and no shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from reviewlens.config import UNKNOWN_TAG
from reviewlens.session import ship_package


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chars(text) -> Column:
    """The code points of a string as an array of one-character strings."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit("(?s)."), 0)


def _flat(arrays: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """An integer list array as (first, size, values, valid): where each row starts in
    ``values`` and how many it has there, -1 for a null row.  Null values become -1;
    ``valid`` tells them apart, and is None without any."""
    bounds = arrays.offsets.to_numpy().astype(np.int64)
    size = np.where(arrays.is_null().to_numpy(zero_copy_only=False), -1, np.diff(bounds))
    values, valid = arrays.values.slice(bounds[0], bounds[-1] - bounds[0]), None
    if values.null_count:
        valid = values.is_valid().to_numpy(zero_copy_only=False)
        values = values.fill_null(-1)
    return bounds[:-1] - bounds[0], size, values.to_numpy(zero_copy_only=False), valid


# bytes of text that are decoded at once (a longer text goes alone)
DECODE_BYTES = 1 << 20


def _pieces(decode: Callable[..., pa.Array], batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """``decode`` of batches of texts and what belongs to them, each taken and given back in
    pieces of at most ``DECODE_BYTES`` of text, so that neither its working arrays (some 30
    bytes a character) nor its results follow the size of a batch."""
    for text, *rest in batches:
        ends = np.cumsum(pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(text):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + DECODE_BYTES, side="right")))
            yield decode(*[a.slice(start, stop - start) for a in (text, *rest)])
            start = stop


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] numbers), then the same of each next row."""
    before = np.cumsum(size) - size
    return np.arange(size.sum(), dtype=np.int64) + np.repeat(first - before, size)


def _ship() -> None:
    """Decoding functions are pickled by module name, so the workers need this package."""
    ship_package(SparkSession.active())


class _Starts:
    """Word starts of a batch of texts, found over all its characters at once.

    Character i (0-based) uses label i + 1, and only characters that have a label (all
    but the two markers) are decoded.  A word is a slice of its text's bytes, so the
    words of a batch are one copy of those bytes with the places of the cuts.
    """

    def __init__(self, text: pa.Array, labels: pa.Array):
        text = text.cast(pa.string()).fill_null("")
        bounds = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
        data = text.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        data = data[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        chars = np.flatnonzero((data & 0xC0) != 0x80)               # where a code point begins
        at = np.searchsorted(chars, bounds)                         # the first one of each text
        length = np.diff(at)
        first, size, values, _ = _flat(labels)
        self.null = (size < 0) & (length > 0)                       # no labels for a text
        self.span = np.where(size < 0, 0, np.clip(np.minimum(length, size - 2), 0, None))
        row = np.repeat(np.arange(len(text)), self.span)
        index = _ranges(np.zeros(len(text), np.int64), self.span)   # of a character in its text
        opens = (index == 0) | (values[first[row] + index + 1] == 0)
        self.row, self.index = row[opens], index[opens]
        self.count = np.bincount(self.row, minlength=len(text))
        edge = np.append(chars, len(data))
        begin, end = edge[at[:-1]], edge[at[:-1] + self.span]       # the decoded bytes of each text
        cut = edge[at[self.row] + self.index]
        kept = end - begin
        moved = (np.cumsum(kept) - kept) - begin                    # once the rest is left out
        if kept.sum() < len(data):
            data = data[_ranges(begin, kept)]
        offsets = np.append(cut + moved[self.row], kept.sum()).astype(np.int32)
        self.words = pa.StringArray.from_buffers(len(self.row), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))

    def lists(self, values: pa.Array) -> pa.Array:
        """One list per text from one value per word; null where a text has no labels."""
        offsets = pa.array(np.append(0, np.cumsum(self.count)).astype(np.int32), mask=np.append(self.null, False))
        return pa.ListArray.from_arrays(offsets, values)


def word_starts(text, labels) -> Column:
    """0-based start index of every word.

    Character i (0-based) uses label i + 1; only characters that have a label
    (all but the two markers) are decoded.
    """
    def one(t: pa.Array, lab: pa.Array) -> pa.Array:
        s = _Starts(t, lab)
        s.null[:] = False
        return s.lists(pa.array(s.index.astype(np.int32)))

    _ship()

    @F.arrow_udf(TY.ArrayType(TY.IntegerType()))
    def _starts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _pieces(one, batches)

    return _starts(_c(text), _c(labels))


def _whole(text: Column, labels: Column, short: str) -> Column:
    """``labels``, checked to reach the end of the text."""
    if short == "cut":
        return labels
    if short != "error":
        raise ValueError("short must be 'error' or 'cut'")
    missing = F.size(labels) < F.length(text) + 2
    return F.when(F.coalesce(missing, F.lit(False)) & labels.isNotNull() & (F.length(text) > 0), F.raise_error(F.concat(
        F.lit("labels end before the text: "), F.size(labels).cast("string"), F.lit(" labels for "),
        F.length(text).cast("string"), F.lit(" characters and two markers")))).otherwise(labels)


def _decoded(text, labels, short: str) -> Column:
    def one(t: pa.Array, lab: pa.Array) -> pa.Array:
        s = _Starts(t, lab)
        return s.lists(s.words)

    _ship()

    @F.arrow_udf(TY.ArrayType(TY.StringType()))
    def _words(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _pieces(one, batches)

    t = F.coalesce(_c(text), F.lit(""))
    return _words(t, _whole(t, _c(labels), short))


def decode_words(text, labels, short: str = "cut") -> Column:
    """Words of ``text`` from per-character segmentation labels (in order).

    ``short`` says what becomes of a text whose labels end before it does:
    "cut" leaves out the characters beyond them, "error" stops the query.
    """
    return _decoded(text, labels, short)


def _id2label_map(id2label: dict) -> Column:
    kv = []
    for k, v in sorted(id2label.items()):
        kv += [F.lit(int(k)), F.lit(v)]
    return F.create_map(*kv)


def _tag_at(tag_labels: Column, idx: Column, mapping: Column) -> Column:
    """Tag name of label ``idx``; ``X`` when unknown or at the end marker."""
    name = F.try_element_at(mapping, F.get(tag_labels, idx))
    return F.when(idx < F.size(tag_labels) - 1, F.coalesce(name, F.lit(UNKNOWN_TAG))) \
            .otherwise(F.lit(UNKNOWN_TAG))


def segment(text, ws_labels, tag_labels, id2label: dict, short: str = "cut") -> Column:
    """``array<struct<word,tag>>`` from segmentation and tagging labels of one text.

    ``short`` as in ``decode_words``; a word beyond the tagging labels has the unknown tag.
    """
    known = sorted((int(k), v) for k, v in id2label.items())
    codes = np.array([k for k, _ in known], np.int64)
    names = pa.array([*[v for _, v in known], UNKNOWN_TAG], pa.string())

    def one(t: pa.Array, lab: pa.Array, tags: pa.Array) -> pa.Array:
        s = _Starts(t, lab)
        first, size, values, valid = _flat(tags)
        name = np.full(len(s.row), len(codes))
        reach = np.flatnonzero(s.index < size[s.row] - 2)            # words that have a tag label
        if len(codes) and len(reach):
            at = (first[s.row] + s.index + 1)[reach]
            place = np.searchsorted(codes, values[at]).clip(max=len(codes) - 1)
            hit = codes[place] == values[at]
            if valid is not None:
                hit &= valid[at]
            name[reach] = np.where(hit, place, len(codes))
        tag = names.take(pa.array(name, mask=size[s.row] < 0))
        return s.lists(pa.StructArray.from_arrays([s.words, tag], ["word", "tag"]))

    _ship()

    @F.arrow_udf(TY.ArrayType(TY.StructType([TY.StructField("word", TY.StringType()),
                                             TY.StructField("tag", TY.StringType())])))
    def _segment(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _pieces(one, batches)

    t = F.coalesce(_c(text), F.lit(""))
    return _segment(t, _whole(t, _c(ws_labels), short), _c(tag_labels))


def tag_words(words, tag_labels, id2label: dict) -> Column:
    """Tags for an already segmented word list (offsets from cumulative lengths).

    The running offset is threaded through ``aggregate``; prefer ``segment``
    when the segmentation labels are at hand, which reuses the word starts.
    """
    mapping = _id2label_map(id2label)
    tl = _c(tag_labels)
    init = F.struct(F.lit(1).alias("idx"), F.array().cast("array<string>").alias("tags"))
    acc = F.aggregate(_c(words), init, lambda a, w: F.struct(
        (a["idx"] + F.length(w)).alias("idx"),
        F.array_append(a["tags"], _tag_at(tl, a["idx"], mapping)).alias("tags")))
    return acc["tags"]


def tokens_table(df: DataFrame, id2label: dict, text: str = "text", ws: str = "ws",
                 tag: str = "tag", short: str = "error") -> DataFrame:
    """(slug, pos, tokens) from a labelled table (slug, pos, text, ws, tag).

    No text is lost unseen: labels that end before their text are an error,
    unless ``short="cut"`` asks for the labelled part.
    """
    return df.select("slug", "pos", segment(F.col(text), F.col(ws), F.col(tag), id2label, short).alias("tokens"))


def explode_tokens(tokens: DataFrame, col: str = "tokens") -> DataFrame:
    """(slug, pos, i, word, tag): one row per token."""
    # The outer form evaluates a computed array once per row (the inner form
    # re-evaluates interpreted array expressions); its empty-array row has a
    # NULL position and is dropped.
    x = tokens.select("slug", "pos", F.posexplode_outer(col).alias("i", "t")).where(F.col("i").isNotNull())
    return x.select("slug", "pos", "i", F.col("t.word").alias("word"), F.col("t.tag").alias("tag"))


# --- scoring hook -------------------------------------------------------------

def _windows(n: int, max_len: int) -> list[tuple[int, int, int]]:
    """(start, from, to): windows of ``max_len`` characters that overlap by half,
    and the characters that each one labels: those nearer to its middle than to
    any other window's."""
    if n <= max_len:
        return [(0, 0, n)]
    half = max_len // 2
    starts = [*range(0, n - max_len, max(1, max_len - half)), n - max_len]
    cuts = [0, *[(b + a + max_len + 1) // 2 for a, b in zip(starts, starts[1:])], n]
    return list(zip(starts, cuts, cuts[1:]))


# characters whose labels a Python worker holds at once (a longer text goes alone)
CHUNK_CHARS = 1 << 18


def _chunks(texts: pa.Array) -> Iterator[list[str]]:
    """``texts`` in order (null: empty), cut into lists of at most ``CHUNK_CHARS`` characters;
    only one list's strings are Python's at a time."""
    out, size = [], 0
    for t in texts:
        t = t.as_py() or ""
        if out and size + len(t) > CHUNK_CHARS:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


def score_heads(df: DataFrame, loader: Callable[[], Callable[[list[str]], dict[str, list[list[int]]]]],
                heads=("ws", "tag"), text: str = "text", max_len: int = 510, batch_size: int = 64) -> DataFrame:
    """Add one array of per-character labels for each of ``heads``, all from one pass.

    ``loader()`` is called once per Python worker and returns a function that
    maps a batch of strings (each at most ``max_len`` characters) to a label list
    per string for every head, with a start-marker and end-marker prediction
    around the character predictions.  Long texts are scored in windows that
    overlap by half, and a character takes its label from the window in which it
    stands furthest from an edge, so no word is cut where a window ends;
    ``max_len`` must be 3 or more.  Windows of similar length go into one batch,
    so that a model pads little.  The results are arrays of len(text) + 2 labels.
    Rows travel to Python as Arrow batches (iterator Arrow UDF); a batch is labelled
    and given back in chunks of ``CHUNK_CHARS`` characters, so beside the batch itself a
    worker's memory does not follow its rows.
    """
    if max_len < 3:
        raise ValueError("max_len must be at least 3")
    ship_package(df.sparkSession)
    heads = list(heads)

    def _label(model, texts: list[str]) -> pa.Array:
        """Labels of ``texts``, a struct of one list per head for each text."""
        pieces, owner = [], []
        for row, t in enumerate(texts):
            for start, lo, hi in _windows(len(t), max_len):
                pieces.append(t[start:start + max_len])
                owner.append((row, lo - start, hi - start))
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        preds: dict[str, list] = {h: [None] * len(pieces) for h in heads}
        for i in range(0, len(order), batch_size):
            part = order[i:i + batch_size]
            got = model([pieces[j] for j in part])
            for h in heads:
                for j, p in zip(part, got[h], strict=True):
                    preds[h][j] = np.array(p, dtype=np.int32)
        out = []
        for h in heads:
            merged: list[np.ndarray] = []
            size = np.zeros(len(texts) + 1, np.int64)
            for k, ((row, lo, hi), p) in enumerate(zip(owner, preds[h])):
                first = k == 0 or owner[k - 1][0] != row
                last = k + 1 == len(owner) or owner[k + 1][0] != row
                # the markers come from a text's first and last window
                got = [p[[0]]] * first + [p[1 + lo:1 + hi]] + [p[[-1]]] * last
                merged += got
                size[row + 1] += sum(map(len, got))
            out.append(pa.ListArray.from_arrays(pa.array(np.cumsum(size).astype(np.int32)), pa.array(np.concatenate(merged))))
        return pa.StructArray.from_arrays(out, heads)

    @F.arrow_udf(TY.StructType([TY.StructField(h, TY.ArrayType(TY.IntegerType())) for h in heads]))
    def _score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = loader()
        for batch in batches:
            for texts in _chunks(batch):
                yield _label(model, texts)

    scored = _score(F.col(text))
    return df.withColumns({h: scored[h] for h in heads})


def score_labels(df: DataFrame, loader: Callable[[], Callable[[list[str]], list[list[int]]]],
                 text: str = "text", out: str = "labels", max_len: int = 510,
                 batch_size: int = 64) -> DataFrame:
    """``score_heads`` for a model with one head: adds its labels as ``out``."""
    def one_head():
        model = loader()
        return lambda batch: {out: model(batch)}

    return score_heads(df, one_head, (out,), text, max_len, batch_size)


def script_run_loader() -> Callable[[list[str]], list[list[int]]]:
    """A model-free labeller: a word starts where the character class changes.

    Classes are letters, digits, whitespace and everything else (each such
    character is its own word).  Useful as a stand-in scorer and in tests.
    """
    def cls(ch: str) -> int:
        if ch.isalpha():
            return 1
        if ch.isdigit():
            return 2
        if ch.isspace():
            return 3
        return 4

    def model(batch: list[str]) -> list[list[int]]:
        out = []
        for t in batch:
            labels = [1]
            prev = None
            for ch in t:
                c = cls(ch)
                labels.append(0 if (prev is None or c != prev or c == 4) else 1)
                prev = c
            labels.append(1)
            out.append(labels)
        return out

    return model


# tags of the character classes that the model-free labellers tell apart
CLASS_TAGS = {1: "letter", 2: "digit", 3: "space", 4: "other"}


def script_run_heads() -> Callable[[list[str]], dict[str, list[list[int]]]]:
    """A model-free labeller with two heads: word starts as ``script_run_loader``
    gives them, and the class of every character (``CLASS_TAGS``)."""
    starts = script_run_loader()

    def cls(ch: str) -> int:
        return 1 if ch.isalpha() else 2 if ch.isdigit() else 3 if ch.isspace() else 4

    def model(batch: list[str]) -> dict[str, list[list[int]]]:
        return {"ws": starts(batch), "tag": [[0, *map(cls, t), 0] for t in batch]}

    return model
