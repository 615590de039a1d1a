"""Word and shingle hashes of many texts at once, as numpy arrays.

Texts stay Arrow buffers: a word's hash is a difference of running polynomial
sums over the bytes, so no Python string is made for it.  The sums start anew with
every chunk of some 256 KiB, so tables and temporaries have a fixed size whatever the
text; a word across chunks is put together from its parts.  What grows with a text is
its lists of words and shingles, some 24 bytes a word.

A word is a run of Unicode letters, digits and combining marks.  Ideographs, kana
and the letters and marks of Thai, Lao, Burmese and Khmer, which are written
without spaces, are each a word of their own.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_R = np.uint64(0x9E3779B97F4A7C15)                   # odd, so it has an inverse modulo 2**64
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_WORD = np.zeros(256, bool)                          # ASCII letters and digits
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
UNSPACED = ((0x0E01, 0x0E4E), (0x0E81, 0x0EDF), (0x1000, 0x109F), (0x1780, 0x17DD), (0x3005, 0x3007), (0x3021, 0x3029),
            (0x3031, 0x309F), (0x30A1, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF),
            (0xFF66, 0xFF9F), (0x16FE4, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFD))
_CHUNK = 1 << 18                                     # bytes hashed, or shingles made, at once


@functools.cache
def _classes() -> np.ndarray:
    """Of every code point: 1 part of a word, 2 a word of its own, else 0."""
    out = np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(0x110000)], np.uint8)
    for a, b in UNSPACED:
        out[a:b + 1] *= 2
    return out


def _wide(b: np.ndarray, in_word: np.ndarray) -> np.ndarray:
    """Marks the bytes of non-ASCII word characters in ``in_word``; (from, to) of
    the characters that are words of their own."""
    at = np.flatnonzero(b >= 0xC0)                   # first bytes
    size = 2 + (b[at] >= 0xE0) + (b[at] >= 0xF0).astype(np.int64)
    code = b[at] & (0x7F >> size)
    code = code.astype(np.int64)
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << 6 | b[at[more] + k] & 0x3F
    kind = _classes()[code]
    in_word[b >= 128] = np.repeat(kind > 0, size)
    own = kind == 2
    return np.stack([at[own], at[own] + size[own]])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (a public constant set)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse, for one chunk."""
    out = []
    for r in (_R, _RINV):
        p = np.full(_CHUNK + 1, r, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out


def slices(texts: pa.Array, most_bytes: int = 4 << 20):
    """(from, to) row ranges of about ``most_bytes``; one text is never cut."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield at, to
        at = to


def _parts(b: np.ndarray, borders: np.ndarray, goes_on: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """(from, to) of the words in a chunk of whole characters, whether the first goes
    on from before the chunk (as it may if ``goes_on``) and whether the last may go
    on behind it; texts begin at ``borders``."""
    in_word = _WORD[b]
    alone = _wide(b, in_word)
    begin = in_word.copy()
    begin[1:] &= ~in_word[:-1]
    begin[0] &= not goes_on
    begin[alone[0]] = True
    after = alone[1][alone[1] < len(b)]
    begin[after] |= in_word[after]
    begin[borders] |= in_word[borders]               # texts lie side by side: a word never spans two
    last = bool(in_word[-1]) and not (alone.shape[1] and alone[1][-1] == len(b))
    first = bool(in_word[0]) and not begin[0]
    stop = in_word.copy()
    stop[:-1] &= ~in_word[1:] | begin[1:]
    begin[0] |= first
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1, first, last


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word (see the module), in order, of the lower-cased
    text; null counts as empty."""
    arr = pc.fill_null(pc.utf8_lower(texts), "").cast(pa.large_string())
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    off = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    n = int(off[-1] - off[0])
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    b = np.frombuffer(arr.buffers()[2], np.uint8, n, int(off[0]))
    off = off - off[0]
    up, down = _powers()
    total = np.zeros(_CHUNK + 1, np.uint64)
    hashes, rows, at = [], [], 0
    held = None                                      # (sum, bytes, row) of a word that may go on
    while at < n:
        to = min(n, at + _CHUNK)
        while to < n and b[to] & 0xC0 == 0x80:       # characters stay whole
            to -= 1
        c = b[at:to]
        borders = off[np.searchsorted(off, at):np.searchsorted(off, to)] - at
        goes_on = held is not None and not (len(borders) and borders[0] == 0)
        s, e, first, last = _parts(c, borders, goes_on)
        np.cumsum((c.astype(np.uint64) + np.uint64(1)) * up[:len(c)], out=total[1:len(c) + 1], dtype=np.uint64)
        h = (total[e] - total[s]) * down[s]
        row = (np.searchsorted(off, at + s, "right") - 1).astype(np.int32)
        before = 0                                   # bytes of the first word in earlier chunks
        if first:
            before = held[1]
            h[0] = (held[0] + pow(int(_R), before, 1 << 64) * int(h[0])) & 0xFFFFFFFFFFFFFFFF
        elif held is not None:
            h, row = np.append(np.uint64(held[0]), h), np.append(np.int32(held[2]), row)
        held = None
        if last and to < n:
            held = (int(h[-1]), int(e[-1] - s[-1]) + (before if len(s) == 1 else 0), int(row[-1]))
            h, row = h[:-1], row[:-1]
        hashes.append(mix(h))
        rows.append(row)
        at = to
    return np.concatenate(hashes), np.concatenate(rows)


def shingles(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words; a text with fewer words has
    one shingle of all its words, a text without words none."""
    h, row = words(texts)
    n = len(h)
    if not n:
        return h, row
    coef = [mix(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(size)]
    hashes, rows = [], []
    for at in range(0, n - size + 1, _CHUNK):
        to = min(n - size + 1, at + _CHUNK)
        keep = row[at:to] == row[at + size - 1:to + size - 1]
        total = np.zeros(to - at, np.uint64)
        for k in range(size):
            total += h[at + k:to + k] * coef[k]
        hashes.append(mix(total[keep]))
        rows.append(row[at:to][keep])
    count = np.bincount(row, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):                                   # few words: a shingle of all of them
        at = np.searchsorted(row, short)
        t = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            t += np.where(k < count[short], h[np.minimum(at + k, n - 1)] * coef[k], np.uint64(0))
        hashes.append(mix(t + count[short].astype(np.uint64)))
        rows.append(short.astype(np.int32))
    return np.concatenate(hashes), np.concatenate(rows)


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, count) of the distinct hashes of each row, by row and hash."""
    if len(row) and (row == row[0]).all():           # a long text on its own: no permutations
        h = np.sort(h)
    else:
        order = np.argsort(h)
        order = order[np.argsort(row[order], kind="stable")]
        h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], row[at], np.diff(np.append(at, len(h)))
