"""Cutting a text where no token can cross, so that tokens are cached by piece.

For byte-level BPE with ``public_tokenizers.PATTERN``, a run of white space and the run of other characters after it
are split alike in every context.  ``pieces`` returns these runs of a text as cache keys:

* a key that starts with a space is literal: the run is ``key[1:]``;
* a key that starts with a newline is literal, too: white space that ends a text.  No quick key starts with a newline, so
  such a run is never taken for the white space between two lines or words;
* any other key stands for one space and the key (the common case, so no string is built for it).

A known key that starts with a space thus ends in other characters, and a text whose quick keys are all known is cut right.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from .common import mix

#: The 25 characters of Unicode's White_Space, which ``\s`` means in the tokenizers' patterns, each spelled out, so that
#: the string serves as a set and inside a regex class.
WHITE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
         "\u2028\u2029\u202f\u205f\u3000")
_RUN = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_WHITE = frozenset(WHITE)
#: Entries of each of the two generations of a worker's cache; longer keys are not kept.
CACHE_ENTRIES, CACHE_CHARS = 120_000, 48


class Crossed(Exception):
    """A quick piece begins or ends with white space, so it isn't one run."""


def quick_pieces(text: str) -> list[str]:
    """Keys for a text whose runs of white space are single spaces and newlines; ``run_of`` finds out if not."""
    out = []
    for i, line in enumerate(text.split("\n")):
        first, *rest = line.split(" ")
        out.append((" \n" if i else " ") + first)
        out += rest
    return out


def slow_pieces(text: str) -> list[str]:
    out = [" " + run for run in _RUN.findall(text)]
    if out and out[-1][-1] in _WHITE:
        out[-1] = "\n" + out[-1][1:]
    return out


#: The white space that is one byte in UTF-8, and the UTF-8 bytes of the rest as numbers of three bytes (first byte highest).
_WHITE_BYTE = np.zeros(256, bool)
_WHITE_BYTE[[ord(c) for c in WHITE if ord(c) < 128]] = True
_WHITE_WIDE = np.array([int.from_bytes(c.encode(), "big") for c in WHITE if ord(c) >= 128])


def cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts ``buf[offsets[i]:offsets[i + 1]]`` (UTF-8) begin, and ``len(buf)``.

    A text is cut before each space or newline that begins a run of white space, so a piece is literal: whole runs of white space with
    the characters after them, or the white space that ends a text.  It is split alike in every context.
    """
    at = np.flatnonzero((buf == 0x20) | (buf == 0x0A))
    at = at[at > 0]
    before = buf[at - 1]
    inside = _WHITE_BYTE[before]
    # such white space has two bytes or three; the character before a cut is in the same text or makes no difference
    wide = np.flatnonzero(before >= 0x80)
    if len(wide):
        i = at[wide]
        two = buf[i - 1] | buf[np.maximum(i - 2, 0)].astype(np.int64) << 8
        inside[wide] = np.isin(two, _WHITE_WIDE) | np.isin(two | buf[np.maximum(i - 3, 0)].astype(np.int64) << 16, _WHITE_WIDE)
    begins = np.zeros(len(buf) + 1, bool)
    begins[at[~inside]] = True
    begins[offsets] = True
    return np.flatnonzero(begins)


#: The bytes of a run in a ``RunTable``: four words, the last byte is their number.
SHORT = 31
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def run_words(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of at most ``SHORT`` bytes as rows of four words, equal for equal runs only; longer runs have no use of theirs."""
    padded = np.concatenate([buf, np.zeros(SHORT + 1, np.uint8)])
    word_at = np.ndarray(len(buf) + 25, "<u8", padded, strides=(1,))
    out = np.empty((len(starts), 4), np.uint64)
    for k in range(4):
        out[:, k] = word_at[starts + 8 * k] & _FIRST_BYTES[np.clip(sizes - 8 * k, 0, 8)]
    out[:, 3] |= np.minimum(sizes, SHORT).astype(np.uint64) << np.uint64(56)
    return out


class RunTable:
    """Ids of short runs for one worker, in arrays: a hash gives two slots to look in, the bytes decide.

    ``ids[at[e] : at[e] + count[e]]`` are the ids of entry ``e``.  When ``most`` entries or 16 times as many ids are held, those found since
    the last time stay, half of ``most`` at most.
    """

    def __init__(self, most: int):
        self.most, self.n, self.n_ids = most, 0, 0
        self.slots = np.full(1 << (2 * most).bit_length(), -1, np.int32)
        self.words, self.at, self.count = np.zeros((1, 4), np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.hit, self.ids = np.zeros(1, bool), np.zeros(1, np.uint32)

    def _slots(self, words: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            h = mix(words[:, 0] * _FACTORS[0] + words[:, 1] * _FACTORS[1] + words[:, 2] * _FACTORS[2] + words[:, 3] * _FACTORS[3])
        low = np.uint64(len(self.slots) - 1)
        return [(x & low).astype(np.int64) for x in (h, h >> np.uint64(32))]

    def find(self, words: np.ndarray) -> np.ndarray:
        """Entry of each run, or -1."""
        first, second = self._slots(words)
        out = self._same(self.slots[first], words)
        rest = np.flatnonzero(out < 0)
        out[rest] = self._same(self.slots[second[rest]], words[rest])
        self.hit[out[out >= 0]] = True
        return out

    def _same(self, entry: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The entries that have these bytes, -1 for others."""
        held = self.words[entry]
        held ^= words
        differs = held[:, 0] | held[:, 1] | held[:, 2] | held[:, 3]
        entry[differs != 0] = -1
        return entry

    def append(self, ids: np.ndarray) -> int:
        """Put ids where entries can point to; where they begin."""
        first = self.n_ids
        self.n_ids += len(ids)
        self.ids = _room(self.ids, self.n_ids)
        self.ids[first : self.n_ids] = ids
        return first

    def add(self, words: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        """New entries; an entry whose two slots are taken drives out the one in the second."""
        a, z = self.n, self.n + len(words)
        self.words, self.at, self.count, self.hit = (_room(x, z) for x in (self.words, self.at, self.count, self.hit))
        self.words[a:z], self.at[a:z], self.count[a:z], self.hit[a:z], self.n = words, at, count, False, z
        first, second = self._slots(words)
        entry = np.arange(a, z, dtype=np.int32)
        free = self.slots[first] < 0
        self.slots[first[free]] = entry[free]
        rest = self.slots[first] != entry
        self.slots[second[rest]] = entry[rest]

    def turn(self) -> None:
        if self.n < self.most and self.n_ids < 16 * self.most:
            return
        stay = np.flatnonzero(self.hit[: self.n])[-(self.most // 2) :]
        words, at, count = self.words[stay], self.at[stay], self.count[stay]
        ids, now = ranges(self.ids, at, count), np.cumsum(count) - count
        self.slots[:] = -1
        self.n = self.n_ids = 0
        self.append(ids)
        self.add(words, now, count)


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """The array, or a longer copy, with place for ``n`` rows."""
    if n <= len(array):
        return array
    out = np.empty((max(n, len(array) + len(array) // 2), *array.shape[1:]), array.dtype)
    out[: len(array)] = array
    return out


def ranges(array: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``array[at[i] : at[i] + count[i]]`` for each i, one after another."""
    places = np.repeat(at - (np.cumsum(count) - count), count)
    places += np.arange(len(places))
    return array[places]


def run_of(key: str) -> str:
    return key[1:] if key[:1] in (" ", "\n") else " " + key


def check(key: str) -> None:
    """Raise ``Crossed`` unless the quick key is one whole run."""
    if not key or key[-1] in _WHITE:
        raise Crossed
    if key[0] in _WHITE:
        inner = key[2:] if key.startswith(" \n") else key[1:] if key[0] == " " else ""
        if not inner or inner[0] in _WHITE:
            raise Crossed


class Recent:
    """A bounded cache: when the newer generation is full it becomes the older one, whose entries move up on use."""

    def __init__(self, most: int = CACHE_ENTRIES):
        self.new, self.old, self.most = {}, {}, most

    def turn(self) -> None:
        if len(self.new) >= self.most:
            self.new, self.old = {}, self.new

    def get(self, key):
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.new[key] = value
        return value


def _none_at(found: list) -> list[int]:
    out, j = [], -1
    try:
        while True:
            j = found.index(None, j + 1)
            out.append(j)
    except ValueError:
        return out


class PieceCache:
    """Results by piece for one worker; ``solve`` gets runs and returns their results."""

    def __init__(self, solve: Callable[[list[str]], list], entries: int = CACHE_ENTRIES):
        self.solve, self.recent = solve, Recent(entries)

    def _older(self, mine: list[str], found: list) -> list[int]:
        """Fill in what the older generation knows, which moves up; the places that stay unknown."""
        known, old, places = self.recent.new, self.recent.old, []
        for j in _none_at(found):
            value = old.get(mine[j])
            if value is None:
                places.append(j)
            else:
                found[j] = known[mine[j]] = value
        return places

    def look_up(self, texts: list[str]) -> list[list]:
        """For each text, the results of its pieces in order."""
        self.recent.turn()
        known = self.recent.new
        out, again, fresh = [], [], {}
        for at, t in enumerate(texts):
            mine = quick_pieces(t) if t else []
            found = list(map(known.get, mine))
            if None in found:
                places = self._older(mine, found)
                try:
                    for j in places:
                        check(mine[j])
                except Crossed:
                    mine = slow_pieces(t)
                    found = list(map(known.get, mine))
                    places = self._older(mine, found)
                new = [mine[j] for j in places]
                fresh.update(dict.fromkeys(new))
                again.append((at, places, new))
            out.append(found)
        todo = list(fresh)
        known.update(zip(todo, self.solve([run_of(k) for k in todo]), strict=True))
        for at, places, new in again:
            found = out[at]
            for j, k in zip(places, new, strict=True):
                found[j] = known[k]
        for k in todo:
            if len(k) > CACHE_CHARS:
                del known[k]
        return out
