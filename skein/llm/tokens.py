"""Byte-level BPE ids of whole texts, with the tokenizers library.

The pre-tokeniser of a byte-level BPE never lets a piece cross certain places:
before a space that follows anything and precedes a non-space, between a
letter and punctuation other than an apostrophe, around a single line feed
between non-spaces. Before that the library takes added tokens out of a text
and goes on with the parts between. Texts are cut at all these places into units, equal units are found by
64-bit hashes in a table of bounded size that lives as long as the Python
worker, and only units not met before go through the library.
"""

from __future__ import annotations

import os
import re

import numpy as np

from skein.llm.common import forgets
from skein.llm.hashing import BYTE, SPACE, span_hashes

TABLE_BITS = 21
#: Above this many units those stay that were met again since the last such time.
MOST_UNITS = 1 << 20
#: Longer units are not kept.
LONGEST = 64
#: New units given to the library at once: what it returns takes over a kilobyte a unit.
LEARNT = 1 << 12

_ASCII = np.arange(256)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_WIDE = SPACE.copy()
_WIDE[28:32] = True  # white space for some definitions only
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True
_SOLID = np.zeros(256, bool)  # ASCII that is no white space
_SOLID[33:127] = True
#: First bytes of characters that are no white space for sure.
_NEXT = _SOLID.copy()
_NEXT[[*range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin; every row's start is among them (also of empty rows)."""
    n = len(data)
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    if n:
        back = np.empty(n, np.uint8)
        back[0], back[1:] = 0, data[:-1]
        back[begin[:n]] = 0
        ahead = np.empty(n, np.uint8)
        ahead[-1], ahead[:-1] = 0, data[1:]
        ahead[begin[1:]] = 0
        latin = np.zeros(n, bool)  # the byte before ends a letter of U+00C0 to U+00FF
        latin[2:] = (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        latin[1:] &= ~begin[1:n]
        latin[2:] &= ~begin[1 : n - 1] if n > 2 else True
        letter = _LETTER[back] | latin
        begin[:n] |= (data == 32) & _NEXT[ahead]
        begin[:n] |= _PUNCT[data] & letter
        feed = (data == 10) & (letter | _SOLID[back]) & _NEXT[ahead]
        begin[:n] |= feed
        begin[1:] |= feed
    return np.flatnonzero(begin[:n])


class UnitEncoder:
    """Encodes slices of texts; one of them lives in each Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The first in the text is taken, of those the longest.
        added = sorted((t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)
        self.value = np.zeros(1 << TABLE_BITS, np.int32)
        self.start = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.again = np.zeros(1 << 16, bool)
        self.units = self.used = 0

    def shrink(self) -> None:
        """Drops the units that were not met again; all, where that is few."""
        slots = np.flatnonzero(self.keys)
        number = self.value[slots]
        keep = self.again[number]
        h, number = self.keys[slots[keep]], number[keep]
        if 2 * len(h) > MOST_UNITS:
            self.clear()
            return
        start, count = self.start[number], self.count[number]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(start - total[:-1], count) + np.arange(total[-1])]
        self.clear()
        self._add(h, ids, count)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the known units, -1 for others."""
        mask = np.int64((1 << TABLE_BITS) - 1)
        slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.value[slot], np.int32(-1))
        left = np.flatnonzero((key != h) & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            key = self.keys[slot[left]]
            hit = key == h[left]
            out[left[hit]] = self.value[slot[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def insert(self, h: np.ndarray, number: np.ndarray) -> None:
        mask = np.int64((1 << TABLE_BITS) - 1)
        slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.value[slot[put]] = h[put], number[put]
            rest = np.ones(len(h), bool)
            rest[put] = False
            left = left[rest[left]]
            slot[left] = (slot[left] + 1) & mask

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        raw = data.tobytes()
        for k in range(0, len(h), LEARNT):
            some = slice(k, k + LEARNT)
            texts = [raw[a:b].decode() for a, b in zip(starts[some].tolist(), ends[some].tolist())]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for e in ids for x in e), np.uint32, int(count.sum()))
            self._add(h[some], flat, count)

    def _add(self, h: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.units + len(count) > len(self.start):
            self.start, self.count, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.again))
        number = np.arange(self.units, self.units + len(count))
        self.pool[self.used : self.used + len(flat)] = flat
        self.count[number], self.again[number] = count, False
        self.start[number] = self.used + np.cumsum(count) - count
        self.units, self.used = self.units + len(count), self.used + len(flat)
        self.insert(h, number.astype(np.int32))

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where units begin; each occurrence of an added token is a unit of its own."""
        if self.added is None or not self.added.search(data):
            return unit_starts(data, offsets)
        spans = [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for m in self.added.finditer(data, a, b)]
        begin, end = np.array(spans, np.int64).reshape(-1, 2).T
        found = unit_starts(data, np.unique(np.concatenate([offsets, begin, end])))
        return found[np.searchsorted(begin, found) <= np.searchsorted(end, found, side="right")]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and their offsets in them."""
        starts = self.starts(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        h = span_hashes(BYTE[data], starts, ends) | np.uint64(1)
        if self.units > MOST_UNITS:
            self.shrink()
        number = self.find(h)
        new = np.flatnonzero(number < 0)
        self.again[number[number >= 0]] = True
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            first = new[first]
            long = ends[first] - starts[first] > LONGEST
            self.learn(data, starts[first[~long]], ends[first[~long]], h[first[~long]])
            number[new] = self.find(h[new])
        start, count = self.start[number], self.count[number]
        pool, own = self.pool[: self.used], np.flatnonzero(number < 0)
        if len(own):  # long units, each by itself
            raw = data.tobytes()
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([raw[starts[i] : ends[i]].decode() for i in own], add_special_tokens=False)]
            count[own] = [len(x) for x in ids]
            start[own] = self.used + np.cumsum(count[own]) - count[own]
            pool = np.concatenate([pool, np.array([x for e in ids for x in e], np.uint32)])
        total = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(start - total[:-1], count)
        at += np.arange(total[-1])
        return pool[at], total[np.searchsorted(starts, offsets)]


_ENCODERS: dict[str, UnitEncoder] = {}


forgets(_ENCODERS.clear)


def encoder(path: str) -> UnitEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]
