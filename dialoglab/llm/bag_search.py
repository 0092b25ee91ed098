"""Ranked lexical search with deduplicated bags.

Of a document only the items' terms matter, how often each occurs (tf), and a length factor m, so documents with the same
tf vector and the same m score alike for every item.

1. Each text is cut into terms once; its bag, the (term, tf) pairs of the items' vocabulary in ascending order, is written with its
   number of terms n.  Document counts come from that table.
2. m follows from n and the corpus' totals.  A task gathers its documents into classes of equal (m, bag), each with its
   ``k`` smallest doc_ids: equal scores are ranked by doc_id, so no other member of a class can be among an item's ``k`` best.
   (A class is forwarded when the task holds too many; it then goes in several pieces, which meet again.)
3. Classes are dealt by their hash; in a task equal hashes stand together, bags are compared byte by byte, pieces of a class
   become one, and the class is scored once, against the inverted lists of the items' terms.  A task passes on each item's
   ``k`` best, classes expanded to their members by ascending doc_id, and a window over (item, score) ends the search.

Texts are never shuffled, a class that holds a third of all rows sends one piece for each task, and the items come in blocks of
at most ``BLOCK_BYTES`` of text, each with its own passes, so that the vocabulary that every task gets is bounded.

Defined cases: NULL or empty text has no terms; a document with no term of the vocabulary isn't scored; a NULL doc_id comes last
among equal scores; repeated documents are ranked one by one; items equal in id and text are one item; an item without terms has no
rows; empty tables give an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from .common import stage_table, utf8

#: Bytes of the items' texts that are searched for in one go.
BLOCK_BYTES = 8 << 20
#: Bytes of bags that a task holds while it gathers classes; products that are made at once.
HELD_BYTES, PRODUCTS = 64 << 20, 1 << 21
#: Letters and digits of ASCII and all bytes of other characters are kept, A-Z become a-z, the rest separates terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def bags(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """doc_id, n (terms with repeats) and bag: pairs of little-endian uint32 (term, tf) by ascending term."""
    get = vocabulary.get

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, out = [], []
            for t in utf8(b.column(1)):
                words = terms(t)
                count = Counter(map(get, words))
                count.pop(None, None)
                n.append(len(words))
                out.append(np.array(sorted(count.items()), "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "bag"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, bag binary")


def document_counts(bag: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term; each task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            raw = b"".join(x for x in b.column(0).to_pylist())
            total += np.bincount(np.frombuffer(raw, "<u4")[::2], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in bag.select("bag").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def classes(bag: DataFrame, m: tuple[int, int], k: int) -> DataFrame:
    """Pieces of classes: hash, m, bag and the ``k`` smallest doc_ids (NULL last) of a task's documents in the class."""
    n_docs, n_terms = m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list] = {}
        size = 0
        for b in batches:
            for d, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not x:
                    continue
                key = (25 + 75 * n * n_docs // n_terms, x)
                own = held.get(key)
                if own is None:
                    held[key] = own = []
                    size += len(x) + 200
                own.append(d)
                if len(own) >= 8 * k:
                    own[:] = smallest(own, k)
            if size > HELD_BYTES:
                yield from pieces(held)
                held, size = {}, 0
        yield from pieces(held)

    def pieces(held: dict) -> Iterator[pa.RecordBatch]:
        keys = list(held)
        for a in range(0, len(keys), 8192):
            own = keys[a : a + 8192]
            h = np.array([xxhash.xxh3_64_intdigest(x, length) for length, x in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array([length for length, _ in own], pa.int64()), pa.array([x for _, x in own], pa.binary()),
                 pa.array([smallest(held[x], k) for x in own], pa.list_(pa.int64()))], ["hash", "m", "bag", "members"])

    return bag.select("doc_id", "n", "bag").mapInArrow(run, "hash bigint, m bigint, bag binary, members array<bigint>")


def smallest(ids: list, k: int) -> list:
    return sorted(ids, key=lambda d: (d is None, d or 0))[:k]


class Items:
    """Inverted lists: for each term of the vocabulary the items that hold it, how often, and the term's weight."""

    def __init__(self, bags_: list[Counter], vocabulary: dict[bytes, int]):
        pairs = sorted((vocabulary[t], i, c) for i, bag in enumerate(bags_) for t, c in bag.items())
        term, self.item, self.times = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.first = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        self.n, self.most = len(bags_), max(sum(bag.values()) for bag in bags_)
        self.weight = np.zeros(len(vocabulary), np.int64)

    def weigh(self, n_docs: int, df: np.ndarray) -> None:
        self.weight[:] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()]

    def scores(self, of: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, count: int) -> np.ndarray:
        """Scores of ``count`` classes for every item; entry j says that class of[j], whose factor is m[j], holds term[j] tf[j] times."""
        part = self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        length = self.first[term + 1] - self.first[term]
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) + np.repeat(self.first[term] - ends + length, length)
        cell = np.repeat(of * self.n, length) + self.item[at]
        value = np.repeat(part, length) * self.times[at]
        add = lambda x: np.bincount(cell, x, count * self.n).astype(np.int64)
        if int(self.weight.max()) * 1_000_000 * self.most < 1 << 52:
            total = add(value)
        else:  # sums of doubles would be rounded, so the halves are added up
            total = (add(value >> 32) << 32) + add(value & 0xFFFFFFFF)
        return total.reshape(count, self.n)


def score_classes(batches: Iterator[pa.RecordBatch], items: Items, k: int) -> Iterator[pa.RecordBatch]:
    """Join the pieces of each class, score it once, and keep each item's ``k`` best members."""
    best = V.Best(items.n, k)
    ready: list[tuple[int, bytes, list]] = []
    size = 0
    hash_, group = None, {}

    def flush() -> None:
        nonlocal size
        length = np.array([len(x) // 8 for _, x, _ in ready])
        entries = np.frombuffer(b"".join(x for _, x, _ in ready), "<u4").astype(np.int64).reshape(-1, 2)
        of = np.repeat(np.arange(len(ready)), length)
        s = items.scores(of, entries[:, 0], entries[:, 1], np.repeat(np.array([m for m, _, _ in ready]), length), len(ready)).T
        least = np.array([V.NO_ID if x[0] is None else x[0] for _, _, x in ready])
        item, c = np.nonzero((s > 0) & best.better(s, least))
        if len(item):
            found = s[item, c]
            if len(item) > 4 * k * items.n:  # classes come in any order: first only those that the best k of them leave in
                cut = np.partition(s, max(0, len(ready) - k), axis=1)[:, max(0, len(ready) - k)]
                stay = found >= cut[item]
                item, c, found = item[stay], c[stay], found[stay]
            members = [ready[j][2] for j in c.tolist()]
            many = np.array([len(x) for x in members])
            ids, null = V.ids_of(pa.array([d for x in members for d in x], pa.int64()))
            best.add(np.repeat(item, many), np.repeat(found, many), ids, null)
        ready.clear()
        size = 0

    def close() -> None:
        nonlocal size
        for (m, bag), members in group.items():
            ready.append((m, bag, members))
            entries = np.frombuffer(bag, "<u4")[::2].astype(np.int64)
            size += items.n + int((items.first[entries + 1] - items.first[entries]).sum())
            if size >= PRODUCTS:
                flush()
        group.clear()

    for b in batches:
        for h, m, bag, members in zip(*(b.column(c).to_pylist() for c in ("hash", "m", "bag", "members")), strict=True):
            if h != hash_:
                close()
                hash_ = h
            old = group.get((m, bag))
            group[m, bag] = members if old is None else smallest(old + members, k)
    close()
    if ready:
        flush()
    item, score, ids, null = best.entries()
    yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), V.nullable(ids, null), pa.array(score)], ["item", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents that score highest for each item."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("t")).where("t IS NOT NULL").distinct()
    kind = asked.schema["item_id"].dataType.simpleString()
    total = asked.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = None
    for i in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == i).collect()
        found = search_block(docs, [r for r in own if terms(r.t.encode())], kind, k, doc_id, text)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint") if out is None else out


def search_block(docs: DataFrame, own: list, kind: str, k: int, doc_id: str, text: str) -> DataFrame | None:
    spark = docs.sparkSession
    if not own:
        return None
    counted = [Counter(terms(r.t.encode())) for r in own]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
    lists = Items(counted, vocabulary)
    bag = stage_table(bags(docs, vocabulary, doc_id, text), "bags")
    n_docs, n_terms = bag.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    lists.weigh(n_docs, document_counts(bag, len(vocabulary)))
    dealt = classes(bag, (n_docs, n_terms), k).repartition("hash").sortWithinPartitions("hash")
    met = dealt.mapInArrow(lambda it: score_classes(it, lists, k), "item int, doc_id bigint, score bigint")
    w = Window.partitionBy("item").orderBy(*V.key_order(F.col("score"), "doc_id"))
    top = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(own)], f"item int, item_id {kind}")
    return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
