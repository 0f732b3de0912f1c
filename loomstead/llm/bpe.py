"""Byte-level BPE encoding and decoding by a pair occurrence index.

A task takes its partition in slices of a few megabytes. The words of a slice that it has not met are laid end to end as byte symbols,
and an index maps the rank of every adjacent pair that has a merge to all its positions. Active ranks are taken in ascending order:
the positions of a rank are merged from left to right, places where a symbol has gone since are passed over, and the pairs that the new
symbols make are put into the lists of their ranks. A new pair's rank is always above the one that made it (a vocabulary in which that
does not hold is refused), so one ascending pass settles all words at once, whatever their number, and each word gets the merges that
it would get alone. Words met before are looked up; a task remembers at most `REMEMBERED` of them.

`encode` and `decode` are columns, so they go wherever an expression goes; nothing is shuffled. Token ids are binary: little-endian
unsigned 32-bit integers, the form that training files take; `ids_array` gives them as an array.

The vocabulary is a file in the JSON form of the tokenizers library, with the byte-level pre-tokenizer and decoder and without normalizer;
other kinds are refused. Its path is a parameter and must be readable on every executor. It is read once in each Python worker.

Defined results: null text is taken as empty and has no tokens; null ids decode to the empty text. Added tokens in a text (such as
an end-of-text mark) become their own ids, longest first where two begin at one place, and decode to themselves. Ids that
the vocabulary has not got decode to nothing; bytes that are no UTF-8 decode to U+FFFD as the library's lossy decoding does. Texts of any
length are encoded whole. Equal rows give equal results; rows keep all their other columns, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Fixed value: how byte-level BPE parts a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII alone, which Python's own engine parts in half the time.
ASCII_WORDS = WORDS.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace("A-Za-z+", "[A-Za-z]+").replace("?0-9+", "?[0-9]+")
#: Characters of text that are handled at once, and bytes of new words that are indexed at once (a longer word is a slice alone).
SLICE, INDEXED = 8_000_000, 3_000_000
#: Words that a task remembers, and the longest that it does.
REMEMBERED, REMEMBERED_BYTES = 500_000, 256
#: Positions of a rank from which on it is applied to all at once.
_MANY = 150
#: Between words, and where a symbol was.
_GAP, _GONE = -1, -2


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in vocabulary files: itself where it is printable Latin-1, else the next letter from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Vocabulary:
    """Merges by pair, with their ranks; the bytes of each id; added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, before, decoder = held["model"], held["pre_tokenizer"] or {}, held["decoder"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or held["normalizer"] or before.get("type") != "ByteLevel" or decoder.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        ids = model["vocab"]
        self.of_byte = np.array([ids[letters[b]] for b in range(256)], np.int32)
        bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        self.merges: list[tuple[int, int, int]] = []
        self.rank_of: dict[int, int] = {}  # left << 32 | right
        made = {i: -1 for i in self.of_byte.tolist()}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, new = ids[left], ids[right], ids[left + right]
            if a not in made or b not in made or made.setdefault(new, rank) != rank:
                raise ValueError(f"merge {rank} comes before what it is made of, or makes a token again: {path}")
            self.merges.append((a, b, new))
            self.rank_of[a << 32 | b] = rank
        self.added = {t["content"]: t["id"] for t in held["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in held["added_tokens"]):
            raise ValueError(f"added tokens that take in their surroundings: {path}")
        bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.bytes_at = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.keys = np.array(sorted(self.rank_of), np.int64)
        self.key_ranks = np.array([self.rank_of[k] for k in self.keys.tolist()], np.int32)
        self.added_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.words, self.ascii_words = regex.compile(WORDS), re.compile(ASCII_WORDS, re.ASCII)
        self.known: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or -1."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.key_ranks[at], -1)

    def merged(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word, by the pair occurrence index over all of them. A rank with many positions is applied to all of
        them at once, one with few of them in a loop; both work on the same arrays."""
        rank_of, merges = self.rank_of, self.merges
        text = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        n = len(text) + len(words)
        symbols = array("i", bytes(4 * n))
        sym = np.frombuffer(symbols, np.int32)
        gaps = ends + np.arange(len(words))
        sym[:] = _GAP
        sym[np.delete(np.arange(n), gaps)] = self.of_byte[text]
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        aft, bef = np.frombuffer(after, np.int32), np.frombuffer(before, np.int32)
        index: dict[int, list[int]] = {}
        active: list[int] = []

        def enter(places: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            """Puts pairs that have a merge into the lists of their ranks."""
            ranks = self._ranks(left, right)
            has = np.flatnonzero(ranks >= 0)
            order = has[np.argsort(ranks[has], kind="stable")]
            ranks, places = ranks[order], places[order].tolist()
            first = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]).tolist() if len(ranks) else []
            for a, z in zip(first, [*first[1:], len(places)]):
                r = int(ranks[a])
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r] += places[a:z]

        enter(np.arange(n - 1), sym[:-1], sym[1:])
        while active:
            rank = heapq.heappop(active)
            left, right, new = merges[rank]
            places = index.pop(rank)
            if len(places) >= _MANY and left != right:  # such pairs don't overlap
                i = np.sort(np.array(places, np.int32))
                i = i[np.r_[True, i[1:] != i[:-1]]]
                j = aft[i]
                i = i[(sym[i] == left) & (j < n)]
                i = i[sym[aft[i]] == right]
                j = aft[i]
                sym[i], sym[j] = new, _GONE
                k = aft[j]
                aft[i] = k
                inside = k < n
                bef[k[inside]] = i[inside]
                fresh = np.full(len(i), new)
                enter(i[inside], fresh[inside], sym[k[inside]])
                h = bef[i]
                inside = h >= 0
                enter(h[inside], sym[h[inside]], fresh[inside])
                continue
            places.sort()
            for i in places:
                j = after[i]
                if symbols[i] != left or j >= n or symbols[j] != right:
                    continue
                symbols[i], symbols[j] = new, _GONE
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (r := rank_of.get(new << 32 | symbols[k] & 0xFFFFFFFF)) is not None:
                        if r not in index:
                            index[r] = []
                            heapq.heappush(active, r)
                        index[r].append(i)
                h = before[i]
                if h >= 0 and (r := rank_of.get(symbols[h] << 32 | new)) is not None:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(active, r)
                    index[r].append(h)
        packed = sym[sym >= 0].astype("<u4").tobytes()
        stop = (4 * np.cumsum(sym >= 0)[gaps]).tolist()
        return [packed[a:z] for a, z in zip([0, *stop], stop)]

    def _learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of new words, indexed some megabytes at a time."""
        found, batch, size = {}, [], 0

        def settle():
            found.update(zip(batch, self.merged([w.encode() for w in batch]) if batch else []))

        for w in words:
            if batch and size + len(w) > INDEXED:
                settle()
                batch, size = [], 0
            batch.append(w)
            size += len(w) if w.isascii() else 4 * len(w)
        settle()
        return found

    def _pieces(self, text: str) -> Iterator[tuple[str, str | None]]:
        """Text between added tokens, each with the token after it."""
        at = 0
        for m in self.added_pattern.finditer(text) if any(t in text for t in self.added) else ():
            yield text[at : m.start()], m.group()
            at = m.end()
        yield text[at:], None

    def _encode_slice(self, texts: list[str]) -> list[bytes]:
        parted = [[((self.ascii_words if piece.isascii() else self.words).findall(piece), mark) for piece, mark in self._pieces(t)] for t in texts]
        every = set(chain.from_iterable(words for pieces in parted for words, _ in pieces))
        fresh = self._learn(every - self.known.keys())
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {w: self.known[w] for w in every & self.known.keys()}
        self.known |= fresh
        out = []
        for pieces in parted:
            packed = []
            for words, mark in pieces:
                packed += map(self.known.__getitem__, words)
                if mark is not None:
                    packed.append(self.added[mark].to_bytes(4, "little"))
            out.append(b"".join(packed))
        for w in fresh:
            if len(w) > REMEMBERED_BYTES:
                del self.known[w]
        if len(self.known) > REMEMBERED:
            self.known = {}
        return out

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        out, held, size = [], [], 0
        for t in texts:
            if held and size + len(t) > SLICE:
                out += self._encode_slice(held)
                held, size = [], 0
            held.append(t)
            size += len(t)
        return out + (self._encode_slice(held) if held else [])

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4")
        ids = ids[ids < len(self.bytes_at)]
        return b"".join(map(self.bytes_at.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(text: Column, path: str) -> Column:
    """Token ids of a text, packed."""

    @arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array(vocabulary(path).encode(t or "" for t in texts.to_pylist()), pa.binary())

    return packed(text)


def decode(ids: Column, path: str) -> Column:
    """The text of packed token ids, added tokens included."""

    @arrow_udf("string")
    def text(packed: pa.Array) -> pa.Array:
        v = vocabulary(path)
        return pa.array([v.decode(p.as_py() or b"") for p in packed], pa.string())

    return text(ids)


def n_tokens(ids: Column) -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("long")


def ids_array(ids: Column) -> Column:
    """Packed ids as array<long>, by Spark's own functions. ids: a column that holds them, as lambdas take no Python functions."""
    nth = lambda i, k: F.conv(F.hex(F.substring(ids, i * 4 + k + 1, F.lit(1))), 16, 10).cast("long")
    each = lambda i: nth(i, 0) + nth(i, 1) * 256 + nth(i, 2) * 65536 + nth(i, 3) * 16777216
    n = n_tokens(ids).cast("int")
    return F.when(n == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), each))
