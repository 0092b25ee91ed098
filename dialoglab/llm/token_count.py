"""Token counts by rank-synchronous array merging.

The model (a sentencepiece BPE with byte fallback) joins the two neighbouring symbols whose union has the best score,
leftmost first, until none is left.  Here a batch of distinct pre-tokens lies in one ragged array of symbol ids (a row
each, filled up at the end); every round looks up the rank of all neighbouring pairs, takes each row's lowest-rank pair and
merges all rows at once; rows without a pair leave.  A row of over ``LONG`` symbols is an array of its own, whose pairs lie in
lists by rank, and all of its lowest-rank pairs merge in one round.  What survives is counted; a character that the vocabulary
lacks never merges and counts as its UTF-8 bytes.

A pre-token is a run of spaces with the other characters after it: no piece has a space after another character,
so no merge crosses.  A worker keeps the counts of recent pre-tokens, up to a fixed number.  A run of over ``LONG`` characters
is cut before that where no piece has the two characters side by side.

Defined cases: NULL text counts as empty: no bytes, no tokens; special strings are ordinary text, as by the
library's default; repeated rows repeat; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .pieces import CACHE_CHARS, Recent

SPACE_MARK = "▁"
LONG = 512
NO_RANK = np.iinfo(np.int32).max
_RUN = re.compile(" *[^ ]+| +")


class Merger:
    """Pair ranks of a model and the merging of batches."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        skip = (sp.is_control, sp.is_unknown, sp.is_byte, sp.is_unused)
        ids = [i for i in range(sp.get_piece_size()) if not any(f(i) for f in skip)]
        self.ids = {sp.id_to_piece(i): i for i in ids}
        score = {i: sp.get_score(i) for i in ids}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.chars = {p: i for p, i in self.ids.items() if len(p) == 1}
        self.size = sp.get_piece_size()
        pairs: dict[int, tuple[int, int]] = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = (order[score[i]], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()] + [NO_RANK], np.int32)
        self.union = np.array([pairs[k][1] for k in self.keys.tolist()] + [-1], np.int32)
        self.side_by_side = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.recent = Recent()
        self.plain_newline = "\n" not in self.chars

    def symbols(self, run: str) -> tuple[list[int], int]:
        """Symbol ids (-1: not in the vocabulary) and the tokens that byte fallback adds to one for each."""
        get = self.chars.get
        out = [get(c, -1) for c in run.replace(" ", SPACE_MARK)]
        more = 0
        if -1 in out:
            more = sum(len(c.encode()) - 1 for c, i in zip(run, out, strict=True) if i < 0)
        return out, more

    def _pair_at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys))

    def merge_rows(self, rows: list[list[int]]) -> np.ndarray:
        """Surviving symbols of each row; a round merges every row's leftmost lowest-rank pair."""
        count = np.fromiter(map(len, rows), np.int64, len(rows))
        if not len(self.keys):
            return count
        width = int(count.max(initial=0))
        live = np.flatnonzero(count > 1)
        sym = np.full((len(live), max(width, 1)), -2, np.int32)
        lens = count[live]
        inside = np.arange(sym.shape[1]) < lens[:, None]
        sym[inside] = np.fromiter((s for i in live for s in rows[i]), np.int32, int(lens.sum()))
        while len(live):
            pair = self._pair_at(sym[:, :-1], sym[:, 1:])
            rank = self.rank[pair]
            at = rank.argmin(axis=1)
            row = np.arange(len(live))
            found = rank[row, at] != NO_RANK
            if not found.all():
                sym, live, at, pair = sym[found], live[found], at[found], pair[found]
                row = np.arange(len(live))
                if not len(live):
                    break
            sym[row, at] = self.union[pair[row, at]]
            place = np.arange(sym.shape[1] - 1)
            sym = np.take_along_axis(sym, place + (place > at[:, None]), axis=1)
            count[live] -= 1
            if sym.shape[1] < 2:
                break
        return count

    def merge_long(self, symbols: list[int]) -> int:
        """Surviving symbols of one long row.  Its pairs lie in lists by rank; a round merges all pairs of the lowest rank at once.

        Of pairs that overlap, the first, third, ... of a chain merge.  Where a merge makes a pair of the same or a lower rank, that
        pair comes before what is farther right, so the round ends there and the rest of its list waits.
        """
        n = len(symbols)
        sym = np.array([-2, *symbols, -2], np.int32)  # nothing joins the ends
        after, before = np.arange(1, n + 3), np.arange(-1, n + 1)
        alive, waiting, order = np.ones(n + 2, bool), {}, []

        def rank_of(at: np.ndarray) -> np.ndarray:
            return self.rank[self._pair_at(sym[at], sym[after[at]])]

        def wait(at: np.ndarray, rank: np.ndarray) -> None:
            known = rank != NO_RANK
            at, rank = at[known], rank[known]
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            starts = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1]))) if len(at) else at
            for r, part in zip(rank[starts].tolist(), np.split(at, starts[1:]), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(order, r)
                waiting[r].append(part)

        everywhere = np.arange(1, n)
        wait(everywhere, rank_of(everywhere))
        left = n
        while order:
            low = heapq.heappop(order)
            at = np.unique(np.concatenate(waiting.pop(low)))
            at = at[alive[at]]
            at = at[rank_of(at) == low]
            if not len(at):
                continue
            index = np.arange(len(at))
            chain = np.concatenate(([True], after[at[:-1]] != at[1:]))
            all_at, at = at, at[(index - np.maximum.accumulate(np.where(chain, index, 0))) % 2 == 0]
            gone = after[at]
            union = self.union[self._pair_at(sym[at], sym[gone])]
            ahead = before[at]
            joined = np.concatenate(([False], gone[:-1] == ahead[1:]))  # what is to the left has just been merged
            behind = np.where(joined, np.concatenate((union[:1], union[:-1])), sym[ahead])
            early = (self.rank[self._pair_at(behind, union)] <= low) | (self.rank[self._pair_at(union, sym[after[gone]])] <= low)
            if early.any():
                end = int(early.argmax()) + 1
                at, gone, union = at[:end], gone[:end], union[:end]
            sym[at], alive[gone] = union, False
            left -= len(at)
            after[at] = after[gone]
            before[after[at]] = at
            fresh = np.unique(np.concatenate((at, before[at])))
            wait(fresh, rank_of(fresh))
            if early.any():
                rest = all_at[all_at > at[-1]]
                wait(rest, np.full(len(rest), low, np.int32))
        return left

    def counts(self, runs: list[str]) -> list[int]:
        """Tokens of each run."""
        out, rows, owner = [0] * len(runs), [], []
        for k, run in enumerate(runs):
            parts = [run]
            if len(run) > LONG:
                marked = run.replace(" ", SPACE_MARK)
                cuts = [0, *(i for i in range(1, len(run)) if marked[i - 1 : i + 1] not in self.side_by_side), len(run)]
                parts = [run[a:b] for a, b in zip(cuts, cuts[1:])]
            for p in parts:
                sym, more = self.symbols(p)
                out[k] += more
                if len(sym) > LONG:
                    out[k] += self.merge_long(sym)
                else:
                    rows.append(sym)
                    owner.append(k)
        order = sorted(range(len(rows)), key=lambda r: len(rows[r]))
        at = 0
        while at < len(order):  # rows of like length together, so that little of an array is filling
            top, end = max(8, 2 * len(rows[order[at]])), at
            while end < len(order) and len(rows[order[end]]) <= top and (end - at) * top < 1 << 20:
                end += 1
            for r, c in zip(order[at:end], self.merge_rows([rows[r] for r in order[at:end]]).tolist(), strict=True):
                out[owner[r]] += c
            at = end
        return out

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text.  Keys: a run, without its space if that is a single one; else with a space before it."""
        self.recent.turn()
        known, old = self.recent.new, self.recent.old
        keys, fresh = [], set()
        for t in texts:
            mine: list[str] = []
            for i, line in enumerate(t.split("\n") if self.plain_newline else [t]) if t else ():
                line = line.replace(SPACE_MARK, " ")
                first, *rest = line.split(" ") if i else ("", *line.split(" "))
                if "" in rest:
                    mine += [" " + r for r in _RUN.findall(line if i else " " + line)]
                else:
                    if first:
                        mine.append(" " + first)
                    mine += rest
            keys.append(mine)
            fresh.update(k for k in mine if k not in known)
        todo = []
        for k in fresh:
            if k in old:
                known[k] = old[k]
            else:
                todo.append(k)
        known.update(zip(todo, self.counts([k[1:] if k[0] == " " else " " + k for k in todo]), strict=True))
        breaks = [t.count("\n") if self.plain_newline else 0 for t in texts]
        out = [sum(map(known.__getitem__, mine)) + n for mine, n in zip(keys, breaks, strict=True)]
        for k in todo:
            if len(k) > CACHE_CHARS:
                del known[k]
        return out


@lru_cache(maxsize=2)
def _merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    @F.arrow_udf("bigint")
    def tokens(column: pa.Array) -> pa.Array:
        merger = _merger(path)
        texts = [t or "" for t in column.to_pylist()]
        return pa.array([n for a, z in chunks(texts, 2 << 20) for n in merger.count_texts(texts[a:z])], pa.int64())

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens.asNondeterministic()(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
