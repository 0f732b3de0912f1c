"""Numpy kernels on Arrow text columns: words, their hashes, and shingles, for many documents at once.

Memory is bounded by taking a batch in slices of about SLICE_BYTES of text (a longer text is a slice alone).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STRIP = np.zeros(256, bool)
_STRIP[[ord(c) for c in "!\"'()*,-./:;?[]_`{}"]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = np.asarray(x, np.uint64) + np.uint64((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of P and of its inverse modulo 2**64."""
    if "p" not in _powers or len(_powers["p"]) < n:
        m = max(n, SLICE_BYTES + 1)
        for name, base in (("p", _P), ("q", _Q)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["p"][:n], _powers["q"][:n]


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each starts (one more at the end). Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return body, at - at[0]


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts) of runs of rows with at most limit bytes, or of one row."""
    body, at = utf8(texts)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, lo + 60_000, n)
        yield lo, hi, body[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_bounds(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross texts."""
    inside = ~_IS_SPACE[body]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = at[:-1] < at[1:]
    first[at[:-1][full]] = inside[at[:-1][full]]
    last[at[1:][full] - 1] = inside[at[1:][full] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, at))
    return starts, ends, np.repeat(np.arange(len(at) - 1), counts)


def stripped(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without ASCII punctuation at both ends; a word of punctuation alone stays whole."""
    s, e = starts.copy(), ends.copy()
    while (m := (s < e) & _STRIP[body[np.minimum(s, len(body) - 1)]]).any():
        s[m] += 1
    while (m := (s < e) & _STRIP[body[np.maximum(e - 1, 0)]]).any():
        e[m] -= 1
    bare = s >= e
    s[bare], e[bare] = starts[bare], ends[bare]
    return s, e


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes, with A-Z lower-cased if asked. Spans may overlap."""
    p, q = powers(len(body) + 1)
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((LOWER[body] if lower else body).astype(np.uint64).__iadd__(np.uint64(1)) * p[: len(body)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts], 1) ^ mix((ends - starts).astype(np.uint64), 2)


def shingles(rows: np.ndarray, hashes: np.ndarray, n: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct runs of n words of each row, sorted by row and hash; a row with fewer words has its
    whole sequence as one, a row without words has none."""
    counts = np.bincount(rows, minlength=n_rows)
    short = counts[rows] < n
    m = len(hashes)
    parts_r, parts_h = [], []
    if m >= n:
        same = rows[: m - n + 1] == rows[n - 1 :]
        h = hashes[: m - n + 1].copy()
        for k in range(1, n):
            h = mix(h, 3) + hashes[k : m - n + 1 + k] * np.uint64(2 * k + 1)
        parts_r.append(rows[: m - n + 1][same])
        parts_h.append(mix(h[same], 4))
    if short.any():
        r, hs = rows[short], hashes[short]
        place = np.arange(m)[short] - np.searchsorted(rows, r)
        total = np.zeros(n_rows, np.uint64)
        np.add.at(total, r, mix(hs, 5) * (2 * place.astype(np.uint64) + np.uint64(1)))
        few = np.flatnonzero((counts > 0) & (counts < n))
        parts_r.append(few)
        parts_h.append(mix(total[few], 6) ^ counts[few].astype(np.uint64))
    if not parts_r:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    r, h = np.concatenate(parts_r), np.concatenate(parts_h)
    order = np.argsort(h)
    order = order[np.argsort(r[order].astype(np.uint16), kind="stable")]
    r, h = r[order], h[order]
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[fresh], h[fresh]


class HashIndex:
    """Positions of 64-bit hashes among given distinct ones: an open-addressed table, probed for many at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.asarray(keys, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(2 * len(self.keys) + 2))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(self.keys)), self._home(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The position of each hash, -1 where it is not among the keys."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int32)
        at = self._home(h)
        found = self.slots[at]
        left = np.flatnonzero((found >= 0) & (self.keys[found] != h))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found[left] = self.slots[at[left]]
            f = found[left]
            left = left[(f >= 0) & (self.keys[f] != h[left])]
        return found
