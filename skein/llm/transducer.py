"""Token counts of whole texts by finite-state transducers compiled from a byte-level BPE.

Two deterministic transducers stand one behind the other.

The splitter reads classes of characters (letter, number, white space, ...,
with a look at the next one) and tells before which characters a piece begins.
It has STATES states. Slices of texts are cut into chunks of equal length,
whatever lies at their ends; all chunks are read at once from every state,
which gives each chunk's map from states to states; the maps are composed by a
parallel prefix scan (log steps of doubling reach), which gives each chunk's
true first state; a second reading marks the pieces.

The merger reads the bytes of a piece. The encodings of a text's prefixes
differ in their last tokens only: a sequence of tokens is the encoding if and
only if each token encodes itself and no two neighbours would have merged
across their border. So it is enough to know, for every suffix that may still
grow into a token, the last token before that suffix and how many tokens came
since: that is the state, of finitely many. Each transition carries the change
of the number of tokens, which may be negative. States and transitions are
compiled as they are met and kept, up to MOST_ARCS, as long as the Python
worker lives. Long pieces are cut into chunks: each is read from the state
that the chunk before would leave when read alone, which is right but for a
few; where it isn't, the chunk's map is extended by the state that comes.

Edge cases: a null or empty text has no tokens and no bytes; added tokens that
stand in a text count as one, as the library's default has it; rows that
repeat a doc_id are counted each by itself; doc_id may be null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import begin, forgets, string_slices
from skein.llm.hashing import BYTE, span_hashes

#: Characters of a chunk of the splitter, bytes of a chunk of a long piece.
CHUNK, LONG = 64, 64
#: Transitions of the merger that are kept.
MOST_ARCS = 1 << 19
#: Bias of a field that may be negative.
ZERO = 1 << 15
#: Pieces that go through the merger at once.
AT_ONCE = 1 << 16

# Classes of characters, with what follows where it matters.
END, LETTER, ONE, TWO, NUMBER, OTHER, APOSTROPHE, SPACE_SOLID, SPACE, BLANK_SOLID, BLANK = range(11)
# States of the splitter: a new piece must begin; in letters, numbers, others; an apostrophe that
# began a piece; one letter before the end of a short form; a space before a solid; in white space.
NEW, IN_LETTERS, IN_NUMBERS, IN_OTHERS, QUOTED, SHORT, SPACED, BLANKS = range(8)
STATES = 8


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and whether a piece begins before the character."""
    first = {END: NEW, LETTER: IN_LETTERS, ONE: IN_LETTERS, TWO: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOSTROPHE: QUOTED, SPACE_SOLID: SPACED, SPACE: BLANKS, BLANK_SOLID: NEW, BLANK: BLANKS}
    goes_on = {(s, c): IN_LETTERS for s in (IN_LETTERS, SPACED) for c in (LETTER, ONE, TWO)}
    goes_on |= {(s, NUMBER): IN_NUMBERS for s in (IN_NUMBERS, SPACED)}
    goes_on |= {(s, c): IN_OTHERS for s in (IN_OTHERS, SPACED, QUOTED) for c in (OTHER, APOSTROPHE)}
    goes_on |= {(QUOTED, ONE): NEW, (QUOTED, TWO): SHORT} | {(SHORT, c): NEW for c in (LETTER, ONE, TWO)}
    goes_on |= {(BLANKS, c): BLANKS for c in (SPACE, BLANK)}
    step, starts = np.zeros((STATES, 11), np.uint8), np.ones((STATES, 11), bool)
    for s in range(STATES):
        for c in range(11):
            step[s, c], starts[s, c] = goes_on.get((s, c), first[c]), (s, c) not in goes_on
    return step, starts


STEP, STARTS = _splitter()


def entry_states(classes: np.ndarray) -> np.ndarray:
    """The splitter's state before each character of chunks x CHUNK classes; the first chunk begins in NEW."""
    chunks = len(classes)
    flat, wide = STEP.T.reshape(-1), classes.astype(np.uint16) * np.uint16(STATES)
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint16)[:, None], (STATES, chunks)).copy()
    for k in range(CHUNK):
        maps = flat[maps + wide[:, k]].astype(np.uint16)
    # Prefix scan: after each step a chunk's map spans twice as many chunks before it.
    reach = 1
    while reach < chunks:
        maps[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach], axis=0)
        reach *= 2
    state = np.concatenate([np.full(1, NEW, np.uint16), maps[NEW, :-1]])
    out = np.empty(classes.shape, np.uint8)
    for k in range(CHUNK):
        out[:, k] = state
        state = flat[state + wide[:, k]].astype(np.uint16)
    return out


def _byte_characters() -> dict[str, int]:
    """Characters that stand for bytes in vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """The transducer of a piece's bytes. Tokens are numbered: bytes, then the merges by rank."""

    def __init__(self, merges: list):
        of = _byte_characters()
        number = {bytes([b]): b for b in range(256)}
        self.pair: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(256)), list(range(256))
        names = list(number)
        for m in merges:
            a, b = (bytes(of[c] for c in part) for part in (m.split(" ") if isinstance(m, str) else m))
            if a + b in number or a not in number or b not in number:
                raise ValueError("merges that make a token twice, or of parts that come later, are not supported")
            number[a + b] = len(names)
            names.append(a + b)
            self.pair[number[a], number[b]] = number[a + b]
            self.left.append(number[a])
            self.right.append(number[b])
        self._stable: dict[int, bool] = {}
        # A trie of the tokens that encode themselves.
        self.child: dict[int, int] = {}
        self.token, self.grows = [-1], [False]
        whole = [True] * 256
        for t in range(256, len(names)):
            a, b = self.left[t], self.right[t]
            whole.append(whole[a] and whole[b] and not self._crosses(a, b, t))
        for t, name in enumerate(names):
            if whole[t]:
                node = 0
                for byte in name:
                    self.grows[node] = True
                    at = node << 8 | byte
                    if at not in self.child:
                        self.child[at] = len(self.token)
                        self.token.append(-1)
                        self.grows.append(False)
                    node = self.child[at]
                self.token[node] = t
        self.clear()

    def _crosses(self, x: int, y: int, top: int) -> bool:
        """Whether a part at the end of x merges with one at the start of y before these go into x and y (and those into top).

        Of equal merges the one further left comes first.
        """
        a, into = x, top
        while True:
            b, until = y, top
            while True:
                m = self.pair.get((a, b))
                if m is not None and m < into and m <= until and m != top:
                    return True
                if b < 256:
                    break
                b, until = self.left[b], b
            if a < 256:
                return False
            a, into = self.right[a], a

    def stable(self, x: int, y: int) -> bool:
        at = x << 32 | y
        if at not in self._stable:
            self._stable[at] = not self._crosses(x, y, 1 << 62)
        return self._stable[at]

    def clear(self) -> None:
        self._stable.clear()
        # A state: 8 bytes for each suffix that may grow, with its node in the trie, the token before it + 1, and
        # how many tokens came since + ZERO (fewer than none, where a token has taken in those before it).
        self.states: list[bytes] = [struct.pack("Q", ZERO)]
        self.numbers = {self.states[0]: 0}
        self.bits, self.arcs = 12, 0
        self._table()

    def _table(self) -> None:
        """An open-addressed table of the transitions: state << 8 | byte to next state << 8 | change of the count + 128."""
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds transitions that are not in the table; it is half full at most."""
        self.arcs += len(keys)
        if 2 * self.arcs > len(self.keys):
            some = self.keys >= 0
            keys, values = np.concatenate([keys, self.keys[some]]), np.concatenate([values, self.values[some]])
            self.bits = (2 * self.arcs).bit_length()
            self._table()
        slot, left, mask = self._slots(keys), np.arange(len(keys)), (1 << self.bits) - 1
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            left = left[rest[left]]
            slot[left] = (slot[left] + 1) & mask

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Values of the transitions, -1 for those not compiled."""
        slot = self._slots(keys)
        key = self.keys[slot]
        out = np.where(key == keys, self.values[slot], -1)
        left = np.flatnonzero((key != keys) & (key >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            key = self.keys[slot[left]]
            hit = key == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (key >= 0)]
        return out

    def _compile(self, key: int) -> int:
        """The transition of state << 8 | byte."""
        byte, grown, last, change = key & 255, [], 0, 0
        for packed in memoryview(self.states[key >> 8]).cast("Q"):
            node, before, since = packed >> 40, packed >> 16 & 0xFFFFFF, (packed & 0xFFFF) - ZERO
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            token = self.token[to]
            if not last and token >= 0 and (not before or self.stable(before - 1, token)):
                last, change = token + 1, 1 - since
            if self.grows[to]:
                grown.append(to << 40 | before << 16 | since + ZERO)
        state = struct.pack(f"{len(grown) + 1}Q", *[x + change for x in grown], last << 16 | ZERO)
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number << 8 | change + 128

    def read(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after the spans and the changes of the counts: one byte of all spans at a time."""
        order = np.argsort(starts - ends, kind="stable")
        at, length = starts[order], (ends - starts)[order]
        now, count = state[order].astype(np.int64), np.zeros(len(starts), np.int64)
        for k in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -k, side="left"))
            keys = now[:live] << 8 | data[at[:live] + k]
            found = self._find(keys)
            new = found < 0
            if new.any():
                some, which = np.unique(keys[new], return_inverse=True)
                made = np.array([self._compile(x) for x in some.tolist()], np.int64)
                found[new] = made[which]
                self._insert(some, made)
            now[:live] = found >> 8
            count[:live] += (found & 255) - 128
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return now[back], count[back]

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of tokens of the pieces."""
        out = np.zeros(len(starts), np.int64)
        short, long = np.flatnonzero(ends - starts <= LONG), np.flatnonzero(ends - starts > LONG)
        for low in range(0, len(short), AT_ONCE):
            self._bound()
            part = short[low : low + AT_ONCE]
            out[part] = self.read(data, starts[part], ends[part], np.zeros(len(part), np.int64))[1]
        if len(long):
            self._bound()
            out[long] = self._count_long(data, starts[long], ends[long])
        return out

    def _bound(self) -> None:
        if self.arcs > MOST_ARCS:
            self.clear()

    def _count_long(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        chunks = -(-(ends - starts) // LONG)
        piece = np.repeat(np.arange(len(starts)), chunks)
        first = np.cumsum(chunks) - chunks
        a = starts[piece] + (np.arange(len(piece)) - first[piece]) * LONG
        b = np.minimum(a + LONG, ends[piece])
        alone, _ = self.read(data, a, b, np.zeros(len(a), np.int64))
        entry = np.concatenate([[0], alone[:-1]])
        entry[first] = 0
        leaves, count = self.read(data, a, b, entry)
        out = np.add.reduceat(count, first)
        # Composition of the maps: where a chunk comes into another state than it was read from, its map is extended.
        fits = np.concatenate([[True], entry[1:] == leaves[:-1]])
        fits[first] = True
        for p in np.flatnonzero(~np.logical_and.reduceat(fits, first)).tolist():
            at = slice(int(first[p]), int(first[p] + chunks[p]))
            out[p] = self._compose(data[starts[p] : ends[p]].tobytes(), entry[at].tolist(), leaves[at].tolist(), count[at].tolist())
        return out

    def _compose(self, raw: bytes, entry: list[int], leaves: list[int], count: list[int]) -> int:
        total, state = 0, 0
        arcs: dict[int, int] = {}
        for k in range(len(entry)):
            if entry[k] == state:
                total, state = total + count[k], leaves[k]
                continue
            for byte in raw[k * LONG : (k + 1) * LONG]:
                key = state << 8 | byte
                arc = arcs.get(key)
                if arc is None:
                    arc = arcs[key] = self._compile(key)
                total += (arc & 255) - 128
                state = arc >> 8
        return total


class TokenCounter:
    """Both transducers, for a tokenizer file; one lives in each Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only a byte-level BPE without prefix space and normaliser is compiled")
        self.tokenizer = Tokenizer.from_file(path)
        self.merger = Merger(model["merges"])
        # The first in the text is taken, of those the longest.
        added = sorted((t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.classes = np.full(0x110000, 255, np.uint8)

    def _class(self, code: int) -> int:
        """Asks the library: what goes on in a piece of letters, numbers or others is of its kind."""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        if code == 0x27:
            return APOSTROPHE
        for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(split(before + chr(code))) == 1:
                return kind
        return SPACE if code == 0x20 else BLANK

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin; offsets: bounds of texts without added tokens."""
        head = (data & 0xC0) != 0x80
        at = np.flatnonzero(head)
        code = data[at].astype(np.int32)
        wide = np.flatnonzero(code >= 0x80)
        if len(wide):
            lead, start = code[wide], at[wide]
            size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
            value = lead & (0x7F >> size)
            for k in (1, 2, 3):
                more = size > k
                value[more] = value[more] << 6 | (data[start[more] + k] & 0x3F)
            code[wide] = value
        kind = self.classes[code]
        if (kind == 255).any():
            for c in np.unique(code[kind == 255]).tolist():
                self.classes[c] = self._class(c)
            kind = self.classes[code]
        # A mark between texts; then what each character's class needs to know of the next one.
        begin = np.searchsorted(at, offsets[1:])
        where = begin + np.arange(len(begin))
        kind, code = np.insert(kind, begin, END), np.insert(code, begin, 0)
        after, follows = np.append(kind[1:], END), np.append(code[1:], 0)
        blank = (kind == SPACE) | (kind == BLANK)
        solid = (after != SPACE) & (after != BLANK) & (after != END)
        kind = np.where(blank & solid, kind - np.uint8(1), kind)
        kind[np.isin(code, [ord(c) for c in "stmd"])] = ONE
        two = ((code == ord("r")) | (code == ord("v"))) & (follows == ord("e")) | (code == ord("l")) & (follows == ord("l"))
        kind[two] = TWO
        n = len(kind)
        padded = np.zeros(-(-n // CHUNK) * CHUNK, np.uint8)
        padded[:n] = kind
        starts = STARTS[entry_states(padded.reshape(-1, CHUNK)).reshape(-1)[:n], kind]
        return at[np.delete(starts, where)]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Numbers of tokens of the texts."""
        bounds, inside = offsets, None
        extra = np.zeros(len(offsets) - 1, np.int64)
        if self.added is not None and self.added.search(data):
            spans = [(m.start(), m.end(), i) for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())) for m in self.added.finditer(data, a, b)]
            if spans:
                begin, end, row = np.array(spans, np.int64).T
                extra = np.bincount(row, minlength=len(extra))
                bounds, inside = np.unique(np.concatenate([offsets, begin, end])), (begin, end)
        if not len(data):
            return extra
        starts = self.pieces(data, bounds)
        ends = np.append(starts[1:], len(data))
        if inside is not None:
            keep = np.searchsorted(inside[0], starts, side="right") == np.searchsorted(inside[1], starts, side="right")
            starts, ends = starts[keep], ends[keep]
        _, first, which = np.unique(span_hashes(BYTE[data], starts, ends), return_index=True, return_inverse=True)
        count = self.merger.count(data, starts[first], ends[first])[which]
        upto = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, offsets)]
        return np.diff(upto) + extra


_COUNTERS: dict[str, TokenCounter] = {}


forgets(_COUNTERS.clear)


def counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(documents: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every text; no shuffle."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("token counts")
        counted = counter(tokenizer)
        for batch in batches:
            for a, b, data, offsets in string_slices(batch.column(1)):
                n = counted.count(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(counts, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
