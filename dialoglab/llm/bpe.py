"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A pre-token starts as single bytes.  Leaf i of the tree holds the rank of the pair that starts at byte i (none: no
rank) together with i, every inner node the smaller of its children, so the root is the leftmost pair of the lowest rank.  A merge
changes three leaves: the pair itself, the one before it and the part that vanished; each is a point update of
log n nodes, so a pre-token of n bytes takes n log n steps however long it is.  Words of like length are merged together: their
trees are the rows of one array, and a step takes the root of each row, merges, and updates the rows level by level: whole levels of
small trees, which are neighbouring numbers, and only the changed nodes of large ones.

Words repeat, so a worker keeps the ids of recent ones, up to a fixed number; Spark deals the documents, one Arrow
batch at a time, nothing is shuffled.

Defined cases: NULL text counts as empty, which has no ids; special strings are ordinary text; the rows of ``docs`` are taken one by one,
so repeated rows repeat; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .pieces import CACHE_CHARS, WHITE, PieceCache, Recent

#: Entries of the caches of runs and words; most words are whole runs, so fewer of them are kept.
RUN_ENTRIES, WORD_ENTRIES = 60_000, 20_000
NO_PAIR = 1 << 62
#: How a pattern begins for which words of letters are told without it.
LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+|"
_POSITION = (1 << 32) - 1


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def word_pattern(pattern: str):
    """The tokenizers' pattern with white space as Unicode defines it."""
    import regex

    inside = pattern.replace(r"[^\s", f"[^{WHITE}")
    return regex.compile(inside.replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: lowest rank first, leftmost among equal ranks."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # neighbours of the live parts
    size = 1 << max(0, n - 1).bit_length()
    tree = [NO_PAIR] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    while (low := tree[1]) != NO_PAIR:
        i = low & _POSITION
        gone = after[i]
        end = after[gone]
        after[i] = end
        points = [(gone, NO_PAIR)]
        if end < n:
            before[end] = i
            r = get(piece[i : after[end]])
            points.append((i, NO_PAIR if r is None else r << 32 | i))
        else:
            points.append((i, NO_PAIR))
        if (p := before[i]) >= 0:
            r = get(piece[p:end])
            points.append((p, NO_PAIR if r is None else r << 32 | p))
        for at, value in points:
            at += size
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                a, b = tree[at], tree[at ^ 1]
                low = a if a < b else b
                at >>= 1
                if tree[at] == low:
                    break
                tree[at] = low
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class PairTable:
    """What every pair of tokens merges to: an open table of first << 32 | second, with the ranks beside it."""

    EMPTY = -1
    _MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = array("q"), array("q")
        get = ranks.get
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a = get(token[:i])
                if a is not None and (b := get(token[i:])) is not None:
                    keys.append(a << 32 | b)
                    values.append(r)
        keys, values = np.frombuffer(keys, np.int64), np.frombuffer(values, np.int64)
        bits = max(4, (3 * len(keys)).bit_length())  # at most a third is taken
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, self.EMPTY, np.int64), np.zeros(1 << bits, np.int32)
        left, place = np.arange(len(keys)), self._place(keys)
        while len(left):  # the first of those that want a free place gets it
            free = np.flatnonzero(self.keys[place] == self.EMPTY)
            _, first = np.unique(place[free], return_index=True)
            won = free[first]
            self.keys[place[won]], self.ranks[place[won]] = keys[left[won]], values[left[won]]
            left, place = np.delete(left, won), np.delete(place, won)
            place = (place + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self._MIX) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair merges, and the rank of what it becomes."""
        place = self._place(keys)
        there = self.keys[place]
        left = np.flatnonzero((there != keys) & (there != self.EMPTY))
        while len(left):
            place[left] = (place[left] + 1) & self.mask
            now = self.keys[place[left]]
            there[left] = now
            left = left[(now != keys[left]) & (now != self.EMPTY)]
        return there == keys, self.ranks[place]


class Trees:
    """``merge_bytes`` for many pre-tokens at once."""

    #: Words of one array: so many, or so few that a row at a time is faster.  Leaves of a tree whose levels are updated whole.
    MOST, LEAST, WHOLE = 1 << 12, 24, 32

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.table = PairTable(ranks)
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)

    def _pairs(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves of the pairs (a, b) that start at ``at``."""
        known, rank = self.table.find((a << 32 | b).ravel())
        return np.where(known.reshape(a.shape), rank.reshape(a.shape).astype(np.int64) << 32 | at, NO_PAIR)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, 4 bytes each."""
        out: list[bytes] = [b""] * len(words)
        sizes: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            else:
                sizes.setdefault(max(0, len(w) - 1).bit_length(), []).append(k)
        for bits, own in sizes.items():
            most = max(self.LEAST, self.MOST * 8 >> bits)
            for i in range(0, len(own), most):
                part = own[i : i + most]
                if len(part) < self.LEAST:
                    for k in part:
                        out[k] = np.array(merge_bytes(words[k], self.ranks), "<i4").tobytes()
                else:
                    for k, ids in zip(part, self._merge([words[k] for k in part], 1 << bits), strict=True):
                        out[k] = ids
        return out

    @staticmethod
    def _levels(tree: np.ndarray, size: int) -> np.ndarray:
        """Update every inner node from the leaves."""
        level = size
        while level > 1:
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
            level //= 2
        return tree

    def _merge(self, words: list[bytes], size: int) -> list[bytes]:
        """Rows of one array: ``size`` leaves hold every pair of a word."""
        count = np.fromiter(map(len, words), np.int64, len(words))
        n, wide = len(words), size + 2
        place = np.arange(wide)
        token = np.full((n, wide), -1, np.int64)
        token[place[None, :] < count[:, None]] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        live = place[None, :] < count[:, None]
        tree = np.full((n, 2 * size), NO_PAIR, np.int64)
        tree[:, size:] = np.where(live[:, 1 : size + 1], self._pairs(token[:, :size], token[:, 1 : size + 1], place[None, :size]), NO_PAIR)
        self._levels(tree, size)
        # places in the arrays as they lie in memory
        flat_tree, flat_token, flat_after, flat_before, flat_live = (x.reshape(-1) for x in (tree, token, after, before, live))
        row = np.arange(n)
        while True:
            low = flat_tree[2 * size * row + 1]
            some = np.flatnonzero(low != NO_PAIR)
            if not len(some):
                break
            row, low = row[some], low[some]
            base, leaf = wide * row, 2 * size * row + size
            i, made = low & _POSITION, low >> 32
            gone = flat_after[base + i]
            end = flat_after[base + gone]
            flat_after[base + i] = end
            flat_token[base + i] = made
            flat_live[base + gone] = False
            flat_before[base + end] = i  # the column behind a word's end is never read
            first = flat_before[base + i]
            at_gone = np.minimum(gone, size - 1)  # a word's last byte has no pair of its own
            flat_tree[leaf + at_gone] = np.where(gone < size, NO_PAIR, flat_tree[leaf + at_gone])
            # the pairs with the part behind and with the one before, where there are such
            behind, ahead = np.flatnonzero(end < count[row]), np.flatnonzero(first >= 0)
            a = np.concatenate((made[behind], flat_token[(base + first)[ahead]]))
            b = np.concatenate((flat_token[(base + end)[behind]], made[ahead]))
            found = self._pairs(a, b, np.concatenate((i[behind], first[ahead])))
            flat_tree[leaf + i] = NO_PAIR
            flat_tree[(leaf + i)[behind]] = found[: len(behind)]
            flat_tree[(leaf + first)[ahead]] = found[len(behind) :]
            if size <= self.WHOLE:
                if 2 * len(row) < len(tree):  # rows that are done aren't updated
                    tree[row] = self._levels(tree[row], size)
                else:
                    self._levels(tree, size)
                continue
            nodes = [size + at_gone, size + i, size + np.where(first >= 0, first, i)]
            level = size
            while level > 1:
                level //= 2
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[row, x] = np.minimum(tree[row, 2 * x], tree[row, 2 * x + 1])
        raw = token[live].astype("<i4").tobytes()
        ends = (4 * np.cumsum(live.sum(1))).tolist()
        return [raw[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]


class Encoder:
    """Ids of texts by a rank file; one for each worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.words = word_pattern(pattern)
        # of such a pattern, letters with at most a space before them are a word, and signs behind them another
        self.plain = re.compile(r"( ?[A-Za-z]+)([!-&(-/:-@\[-`{-~]*)").fullmatch if pattern.startswith(LETTERS) else lambda run: None
        self.trees = Trees(self.ranks)
        self.merged = Recent(WORD_ENTRIES)
        self.cache = PieceCache(self._runs, RUN_ENTRIES)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, r in self.ranks.items():
            tokens[r] = token
        self.tokens = tokens

    def _runs(self, runs: list[str]) -> list[bytes]:
        """Ids of each run, 4 bytes each: joined faster and held in less memory than numbers."""
        self.merged.turn()
        plain, find = self.plain, self.words.findall
        cut = [(m[1], m[2]) if (m := plain(run)) and m[2] else (run,) if m else find(run) for run in runs]
        new, old = self.merged.new, self.merged.old
        known, todo = {}, {}
        for own in cut:
            if len(own) == 1:  # the run's own entry holds its ids
                todo[own[0]] = None
                continue
            for w in own:
                if w not in known and (ids := new.get(w) or old.get(w)) is not None:
                    known[w] = new[w] = ids
                elif w not in known:
                    todo[w] = True
        for (w, part), ids in zip(todo.items(), self.trees.merge([w.encode() for w in todo]), strict=True):
            known[w] = ids
            if part and len(w) <= CACHE_CHARS:
                new[w] = ids
        return [known[own[0]] if len(own) == 1 else b"".join(map(known.__getitem__, own)) for own in cut]

    def raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(parts), "<i4") for parts in self.cache.look_up(texts)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x in self.raw(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (the bytes that the ids stand for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for a, z in chunks(texts):
                ids = enc.raw(texts[a:z])
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                flat = np.concatenate(ids)
                decoded = [enc.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
                     pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def digest(encoded: DataFrame) -> DataFrame:
    """Token count and SHA-256 of the ids (decimal, joined by commas) and of the decoded bytes."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
