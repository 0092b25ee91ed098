"""N-gram Jaccard join by T-occurrence search (DivideSkip), and the groups that its links make.

A document's set holds the hashes of its distinct word n-grams.  Two sets A and B link when ``den * |A & B| >= num * |A | B|``,
which is the same as an overlap of at least T(|A|, |B|) = ceil(num * (|A| + |B|) / (num + den)).  Equal sets are one node, so
copies are never compared.  The join is exact (up to 64-bit hashes of n-grams); nothing is sampled or capped.

1. ``sets``: one row per document: size, a 128-bit name of its set and a sketch: the parities of one to two buckets an element.
   The sets are not written.
2. Sets on their own.  Elements that no other set has count as differences with any partner, so a set with over D of
   them links with nothing.  Where ranges (see 3) are short, that is below a similarity of about 0.88, the elements with an even
   hash (a lower bound is enough) go to partitions that tell which occur in one set only, and such sets leave.
   Without this, texts that share passages would make blocks of a large part of the corpus.
3. Blocks.  Linked sets differ in at most D = (den - num) * (|A| + |B|) / (num + den) elements.  Cut the hash space into D + 1
   ranges and at least one range holds the same elements in both, so the signature of a range (range number and a hash of its
   elements) is a key that linked sets share.  There are some more ranges than that, so that a set nearly always uses more
   than D of them and need not sign the empty ones (which many sets share); a set that doesn't signs them all.  D is fixed for a band of sizes; a set signs for its own band and for the next,
   where its larger partners are.  Signatures leave the tasks packed by partition, and each partition tells which sets have an
   equal one.  In a larger corpus more unrelated sets do, by one passage that they share, so sets with an equal signature are compared
   by their sketches: those that differ in more than D parities differ in more than D elements.  The pairs that remain are mostly links,
   whose connected components are the blocks: linked sets are always in one.
   Copies of the most frequent sets sign once (an exact rule on a bounded list), so hot copies make no hot signature.
4. Search.  A large block is dealt into runs of about ``RUN_GRAMS`` elements and ``RUN_SETS`` sets of like size; each pair of runs
   whose sizes can link is a piece of work of bounded memory, so a large block is spread over tasks.  One run becomes inverted lists (n-gram -> sets, ascending); each
   set of the other is a query with threshold T for its smallest possible partner: the longest lists are put aside, the
   short ones are merged with a heap that skips ahead where T can't be reached, and the surviving candidates are
   looked up in the long lists by binary search.  Those that reach their own T are links.
5. A task passes on the links that join new sets (a forest) and the number of links of each set, not all pairs;
   components of the forests are the groups.

Defined cases: NULL or empty text has an empty set, links with nothing and is its own group; fewer than n words make one n-gram of
all; rows with a NULL doc_id link like others, and a group's id is its smallest doc_id that isn't NULL; repeated rows
are equal sets; an empty table gives an empty result; other columns are kept by ``one_of_each`` and never read.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bitmap, chunks, in_bitmap, maybe_in, mix, null_safe, probe_columns, stage_table, utf8

#: Elements (8 bytes each) of a run of sets.
RUN_GRAMS = 400_000
RUN_SETS = 512
#: Signatures (16 bytes each) of a partition, about.
PART_SIGNATURES = 1 << 20
#: Sets with an equal signature that are compared at a time with as many others, and the largest sketch.
SKETCH_RUN, SKETCH_BITS = 2048, 1 << 17
#: Elements of a partition, about, where elements are compared; done where a range has fewer than SHORT_RANGE elements.
PART_GRAMS, SHORT_RANGE = 1 << 20, 8
#: The most frequent sets of which only one document signs, and the least number of their documents.
HOT_SETS, HOT_COPIES = 10_000, 8


class Measure:
    """Jaccard similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.first = [1]  # smallest size of each band; next band: sizes that cannot link with the band before

    def least_overlap(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))

    def least_size(self, a: int) -> int:
        """Of a partner of a set of ``a``."""
        return -(-self.num * a // self.den)

    def most_size(self, a: int) -> int:
        """Of a partner of a set of ``a``."""
        return self.den * a // self.num

    def band(self, size: int) -> int:
        while self.first[-1] <= size:
            self.first.append(self.first[-1] * self.den // self.num + 1)
        return bisect_left(self.first, size + 1) - 1

    def top(self, band: int) -> int:
        """The largest size of a band."""
        while len(self.first) < band + 2:
            self.band(self.first[-1])
        return self.first[band + 1] - 1

    def most_different(self, a: int, b: int) -> int:
        """Elements in just one of two linked sets."""
        return (self.den - self.num) * (a + b) // (self.num + self.den)

    def ranges(self, band: int) -> int:
        """Parts of the hash space for pairs whose larger set is in the band; spare ones make up for empty ranges."""
        d = self.most_different(self.top(band), self.top(band))
        return d + 3 + (d + 1) // 12 if d else 1


def gram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text (lower-cased A-Z)."""
    w = Words(texts, lower=True)
    grams, at = w.grams(n)
    owner = w.doc[at]
    few = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(few):
        ends = np.cumsum(w.counts)
        with np.errstate(over="ignore"):
            extra = []
            for d in few:
                h = np.uint64(w.counts[d])
                for x in w.hashes[ends[d] - w.counts[d] : ends[d]]:
                    h = mix(np.array([h * np.uint64(0x9E3779B97F4A7C15) + x]))[0]
                extra.append(h)
        grams, owner = np.concatenate((grams, np.array(extra, np.uint64))), np.concatenate((owner, few))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    if len(grams):
        new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])))
        grams, owner = grams[new], owner[new]
    return np.split(grams, np.searchsorted(owner, np.arange(1, len(texts)))) if texts else []


def set_name(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little")


def sketch(s: np.ndarray) -> bytes:
    """Parities of the elements in one to two buckets an element (a power of two): two sets differ in at least as many elements."""
    bits = max(64, min(SKETCH_BITS, 1 << (len(s) - 1).bit_length()))
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def node(name: bytes) -> int:
    """64 bits of a set's name, for the graph that makes blocks (a clash merely joins two blocks)."""
    return int.from_bytes(name[:8], "big", signed=True)


def signatures(s: np.ndarray, measure: Measure) -> np.ndarray:
    """Keys of which linked sets share at least one."""
    out, band = [], measure.band(len(s))
    for b in (band, band + 1):
        m = measure.ranges(b)
        with np.errstate(over="ignore"):
            part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            content = np.add.reduceat(mix(s + np.uint64(b)), start)
            used = part[start]
            # partners differ in fewer ranges than are used here: one of these is alike, empty ones needn't be signed
            if len(used) <= measure.most_different(len(s), min(measure.top(b), measure.most_size(len(s)))):
                full = np.zeros(m, np.uint64)
                full[used.astype(np.int64)] = content
                used, content = np.arange(m, dtype=np.uint64), full
            out.append(mix(content + mix(used + np.uint64(b << 40))))
    return np.concatenate(out)


def sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, name (16 bytes; empty sets: NULL), text_hash, sketch (empty sets: NULL)."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column(1))
            for a, z in chunks(texts):
                own = gram_sets(texts[a:z], n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a), pa.array([len(s) for s in own], pa.int64()),
                     pa.array([set_name(s) if len(s) else None for s in own], pa.binary()), b.column(2).slice(a, z - a),
                     pa.array([sketch(s) if len(s) else None for s in own], pa.binary())],
                    ["doc_id", "n_shingles", "name", "text_hash", "sketch"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, name binary, text_hash bigint, sketch binary")


def _packed(docs: DataFrame, n: int, parts: int, hot: dict[bytes, object], keys_of, words=None, bits: int = 0) -> DataFrame:
    """(part, keys, owners, nodes): the keys that ``keys_of`` gives for each set, packed by partition.

    One row for each partition and chunk of texts; ``owners`` has a bit for each key, set where the next one of ``nodes`` begins.  A
    partition keeps 32 bits of a key, as it holds few: different keys may seem equal, equal ones always do.  With a bitmap
    (``words``), only documents whose doc_id may be in it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # at most HOT_SETS entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = shared.value
        for b in batches:
            if words is not None:
                b = b.filter(pa.array(in_bitmap(words.value, b.column(2).to_numpy(), b.column(3).to_numpy())))
            ids, texts = b.column(0).to_pylist(), utf8(b.column(1))
            for a, z in chunks(texts, 2 << 20):
                keys, own = [], []
                for i, s in zip(ids[a:z], gram_sets(texts[a:z], n), strict=True):
                    if not len(s):
                        continue
                    name = set_name(s)
                    if name in signer and signer[name] != i:
                        continue
                    keys.append(keys_of(s))
                    own.append(node(name))
                if not keys:
                    continue
                key = np.concatenate(keys)
                owner = np.repeat(np.arange(len(own), dtype=np.uint32), [len(k) for k in keys])
                part = (mix(key) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                key, owner, nodes = key[order], owner[order], np.array(own, np.int64)
                rows = []
                for p in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                    own_ = owner[cuts[p] : cuts[p + 1]]  # ascending
                    new = np.concatenate(([True], own_[1:] != own_[:-1]))
                    rows.append((p, (key[cuts[p] : cuts[p + 1]] >> np.uint64(32)).astype("<u4").tobytes(), np.packbits(new).tobytes(),
                                 nodes[own_[new]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                    ["part", "keys", "owners", "nodes"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *(
        [p.alias(f"p{i}") for i, p in enumerate(probe_columns(F.col("doc_id"), bits))] if words is not None else []))
    return rows.mapInArrow(run, "part int, keys binary, owners binary, nodes binary")


def _unpacked(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, nodes) of a packed row."""
    key, new, nodes = (np.frombuffer(b.column(k)[i].as_buffer(), t) for k, t in ((1, "<u4"), (2, np.uint8), (3, "<i8")))
    return key.copy(), nodes[np.cumsum(np.unpackbits(new, count=len(key)), dtype=np.int64) - 1]


def _alone(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, nodes, counts): how many of a set's keys in this partition no other set has, packed by bucket of the set."""
    keys, nodes, many = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, bool)
    wait: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def fold() -> None:
        nonlocal keys, nodes, many, wait, waiting
        k = np.concatenate([keys, *(x for x, _ in wait)])
        v = np.concatenate([nodes, *(x for _, x in wait)])
        m = np.concatenate([many, np.zeros(len(k) - len(keys), bool)])
        order = np.argsort(k, kind="stable")
        k, v, m = k[order], v[order], m[order]
        new = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.empty(0, bool)
        first = np.flatnonzero(new)
        other = m | (v != v[new][np.cumsum(new) - 1])
        keys, nodes = k[new], v[new]
        many = np.logical_or.reduceat(other, first) if len(first) else m
        wait, waiting = [], 0

    for b in batches:
        for i in range(b.num_rows):
            wait.append(_unpacked(b, i))
            waiting += len(wait[-1][0])
            if waiting > max(1 << 19, len(keys) // 2):
                fold()
    fold()
    node_, n = np.unique(nodes[~many], return_counts=True)
    bucket = (mix(node_.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    some = np.flatnonzero(cuts[1:] > cuts[:-1])
    node_, n = node_[order], n[order].astype("<i8")
    yield pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.array([node_[cuts[p] : cuts[p + 1]].tobytes() for p in some], pa.binary()),
         pa.array([n[cuts[p] : cuts[p + 1]].tobytes() for p in some], pa.binary())], ["bucket", "nodes", "counts"])


def _own_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, own_n): the sums of a task's buckets, one row for each set."""
    nodes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        x = [nodes, *(np.frombuffer(v.as_buffer(), "<i8") for v in b.column(1))]
        y = [counts, *(np.frombuffer(v.as_buffer(), "<i8") for v in b.column(2))]
        nodes, at = np.unique(np.concatenate(x), return_inverse=True)
        counts = np.zeros(len(nodes), np.int64)
        np.add.at(counts, at, np.concatenate(y))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(counts)], ["node", "own_n"])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """nodes: the sets with an equal signature, ascending, once for all signatures of the partition that the same sets have."""
    sigs, firsts = np.empty(0, np.uint32), np.empty(0, np.int64)
    more_s, more_n = [], []  # other sets with a signature that was there
    wait_s: list[np.ndarray] = []
    wait_n: list[np.ndarray] = []
    waiting = 0

    def flush() -> None:
        nonlocal sigs, firsts, wait_s, wait_n, waiting
        s, x = np.concatenate([sigs, *wait_s]), np.concatenate([firsts, *wait_n])
        order = np.argsort(s, kind="stable")  # what was there comes first
        s, x = s[order], x[order]
        new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.empty(0, bool)
        head = x[new][np.cumsum(new) - 1] if len(s) else x
        odd = head != x
        more_s.append(s[odd])
        more_n.append(x[odd])
        sigs, firsts, wait_s, wait_n, waiting = s[new], x[new], [], [], 0

    for b in batches:
        for i in range(b.num_rows):
            sig, own = _unpacked(b, i)
            wait_s.append(sig)
            wait_n.append(own)
            waiting += len(sig)
            if waiting > max(1 << 19, len(sigs) // 2):
                flush()
    flush()
    s, x = np.concatenate(more_s), np.concatenate(more_n)
    shared = np.unique(s)
    s, x = np.concatenate((s, shared)), np.concatenate((x, firsts[np.searchsorted(sigs, shared)]))
    order = np.lexsort((x, s))
    s, x = s[order], x[order]
    if len(s):
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (x[1:] != x[:-1])))
        s, x = s[new], x[new]
    seen: set[bytes] = set()
    out: list[bytes] = []
    size = 0
    for group in np.split(x, np.flatnonzero(s[1:] != s[:-1]) + 1) if len(s) else []:
        key = hashlib.blake2b(packed := group.astype("<i8").tobytes(), digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        out.append(packed)
        if (size := size + len(packed)) > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["nodes"])
            out, size = [], 0
    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["nodes"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, side, node): what is compared at a time: a group, or for a large one each pair of its runs."""

    def rows(w: list, side: list, node_: list) -> pa.RecordBatch:
        n = [len(x) for x in node_]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(w, np.int64), n)), pa.array(np.repeat(np.array(side, np.int32), n)),
             pa.array(np.concatenate(node_) if node_ else np.empty(0, np.int64))], ["w", "side", "node"])

    w, side, node_, held = [], [], [], 0
    for b in batches:
        for packed in b.column(0):
            group = np.frombuffer(packed.as_buffer(), "<i8")
            name = hashlib.blake2b(packed.as_buffer(), digest_size=8)
            runs = [group[k : k + SKETCH_RUN] for k in range(0, len(group), SKETCH_RUN)]
            for i in range(len(runs)):
                for j in range(i, len(runs)):
                    key = name.copy()
                    key.update(b"%d,%d" % (i, j))
                    for k in {i, j}:
                        w.append(int.from_bytes(key.digest(), "little", signed=True))
                        side.append(int(k != i))
                        node_.append(runs[k])
                        held += len(runs[k])
                    if held > 1 << 16:
                        yield rows(w, side, node_)
                        w, side, node_, held = [], [], [], 0
    yield rows(w, side, node_)


def near(sketches: list[bytes], sizes: list[int], sides: list[int], measure: Measure) -> list[tuple[int, int]]:
    """Pairs that may be links by their sketches and sizes, as a forest that joins what they join.

    If there are two sides, only sets of different sides are compared.
    """
    size, side = np.array(sizes, np.int64), np.array(sides)
    of = np.array([len(x) for x in sketches])
    lengths = np.unique(of).tolist()
    at = {m: np.flatnonzero(of == m) for m in lengths}
    place = np.zeros(len(size), np.int64)
    level: dict[tuple[int, int], np.ndarray] = {}  # sketches of one length, folded to a shorter one
    for m in lengths:
        place[at[m]] = np.arange(len(at[m]))
        x = np.frombuffer(b"".join(sketches[i] for i in at[m].tolist()), np.uint64).reshape(len(at[m]), -1)
        while True:
            level[m, x.shape[1] * 8] = x
            if x.shape[1] * 8 <= lengths[0]:
                break
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    two = len(np.unique(side)) > 1
    open_ = {m: np.arange(len(at[m])) for m in lengths}  # not yet in a tree
    edges: list[tuple[int, int]] = []
    todo: list[int] = []
    begun, first = np.zeros(len(size), bool), 0
    while True:
        if not todo:
            while first < len(size) and begun[first]:
                first += 1
            if first == len(size):
                return edges
            begun[first] = True
            todo.append(first)
            m = int(of[first])
            open_[m] = open_[m][open_[m] != place[first]]
        q = todo.pop()
        for m, rest in open_.items():
            if not len(rest):
                continue
            other = at[m][rest]
            fit = (measure.den * np.minimum(size[other], size[q]) >= measure.num * np.maximum(size[other], size[q]))
            if two:
                fit &= side[other] != side[q]
            some = np.flatnonzero(fit)
            if not len(some):
                continue
            short = min(m, int(of[q]))
            differ = np.bitwise_count(level[m, short][rest[some]] ^ level[int(of[q]), short][place[q]]).sum(axis=1, dtype=np.int64)
            some = some[differ <= (measure.den - measure.num) * (size[other[some]] + size[q]) // (measure.num + measure.den)]
            found = other[some].tolist()
            edges += [(q, i) for i in found]
            todo += found
            begun[found] = True
            open_[m] = np.delete(rest, some)


def _near(batches: Iterator[pa.RecordBatch], measure: Measure) -> Iterator[pa.RecordBatch]:
    """Rows (w, side, node, size, sketch), sorted by w, to edges (a, b) between sets that may be linked."""

    def solve(held: list[tuple]) -> list[tuple[int, int]]:
        return [(held[i][2], held[j][2]) for i, j in near([r[4] for r in held], [r[3] for r in held], [r[1] for r in held], measure)]

    def result(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        e = np.array(edges, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    held: list[tuple] = []
    edges: list[tuple[int, int]] = []
    for b in batches:
        for row in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
            if held and held[0][0] != row[0]:
                edges += solve(held)
                held = []
                if len(edges) > 50_000:
                    yield result(edges)
                    edges = []
            held.append(row)
    if held:
        edges += solve(held)
    yield result(edges)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable over the edges, for every node that has one.

    Alternating large-star and small-star steps; each step's edges are written to the shared folder.  Copies of a hot node
    are pre-aggregated by ``min`` in each task.
    """
    e = stage_table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "edges")
    before = None
    while True:
        # large star: each node's larger neighbours go to its smallest one
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, both["u"] == low["w"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        # small star: each node and its smaller neighbours go to the smallest one
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        j = large.join(low, large["u"] == low["w"])
        small = j.select("v", F.col("m")).unionByName(low.select(F.col("w").alias("v"), "m")).filter("v != m").distinct()
        e = stage_table(small.select(F.col("v").alias("u"), F.col("m").alias("v")), "edges")
        # done when no node is both a root and below one, and no node has two roots
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        if state == before:
            break
        before = state
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root")))


# --- T-occurrence search inside a task -------------------------------------------------------------


class InvertedLists:
    """n-gram -> ascending set numbers, for sets sorted by size."""

    def __init__(self, own: list[np.ndarray]):
        self.sizes = [len(s) for s in own]
        grams = np.concatenate(own) if own else np.empty(0, np.uint64)
        number = np.repeat(np.arange(len(own)), self.sizes)
        order = np.argsort(grams, kind="stable")
        self.post = number[order]
        self.keys, self.start = np.unique(grams[order], return_index=True)
        self.start = np.append(self.start, len(grams))

    def lists(self, query: np.ndarray, below: int) -> list[np.ndarray]:
        """The query's lists, cut before set number ``below``, without empty ones."""
        at = np.searchsorted(self.keys, query)
        here = at < len(self.keys)
        here[here] = self.keys[at[here]] == query[here]
        at = at[here]
        out = []
        for i in at.tolist():
            x = self.post[self.start[i] : self.start[i + 1]]
            if below < len(self.sizes):
                x = x[: np.searchsorted(x, below)]
            if len(x):
                out.append(x)
        return out


def t_occurrence(lists: list[np.ndarray], t: int) -> list[tuple[int, int]]:
    """(set number, occurrences) of all that are on at least ``t`` of the lists, by DivideSkip."""
    if t < 1 or len(lists) < t:
        return []
    lists = sorted(lists, key=len)
    longest = len(lists[-1])
    aside = min(t - 1, int(t / (0.01 * np.log2(longest + 1) + 1)))
    short, long_ = lists[: len(lists) - aside], lists[len(lists) - aside :]
    need = t - aside
    found, counts = _merge_skip([x.tolist() for x in short], need)
    if not found:
        return []
    ids, total = np.array(found), np.array(counts)
    for k, x in enumerate(long_):  # binary search in the long lists
        at = np.searchsorted(x, ids)
        total += x[np.minimum(at, len(x) - 1)] == ids
        if k % 16 == 15:
            fit = total + (len(long_) - 1 - k) >= t
            if not fit.all():
                ids, total = ids[fit], total[fit]
                if not len(ids):
                    return []
    fit = total >= t
    return list(zip(ids[fit].tolist(), total[fit].tolist(), strict=True))


def _merge_skip(lists: list[list[int]], need: int) -> tuple[list[int], list[int]]:
    """Heap merge that skips what can't occur ``need`` times."""
    heap = [(x[0], k, 0) for k, x in enumerate(lists)]
    heapq.heapify(heap)
    ids, counts = [], []
    while len(heap) >= need:
        top, same = heap[0][0], []
        while heap and heap[0][0] == top:
            same.append(heapq.heappop(heap))
        if len(same) >= need:
            ids.append(top)
            counts.append(len(same))
            for _, k, i in same:
                if i + 1 < len(lists[k]):
                    heapq.heappush(heap, (lists[k][i + 1], k, i + 1))
            continue
        while heap and len(same) < need - 1:
            same.append(heapq.heappop(heap))
        if not heap:
            break
        goal = heap[0][0]
        for _, k, i in same:
            if (i := bisect_left(lists[k], goal, i)) < len(lists[k]):
                heapq.heappush(heap, (lists[k][i], k, i))
    return ids, counts


class Forest:
    """Union-find over small numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def links(index: list[np.ndarray], queries: list[np.ndarray] | None, measure: Measure) -> Iterator[tuple[int, int]]:
    """(number in the index, number of the query) of all linked pairs; None: the index against itself.

    Index sets are sorted by size; queries may have any size.
    """
    inverted = InvertedLists(index)
    for q, s in enumerate(index if queries is None else queries):
        most = measure.most_size(len(s))
        below = q if queries is None else bisect_left(inverted.sizes, most + 1)
        first = bisect_left(inverted.sizes, measure.least_size(len(s)), 0, below)
        if first >= below:
            continue
        lists = inverted.lists(s, below)
        if first:
            lists = [y for x in lists if len(y := x[np.searchsorted(x, first) :])]
        for k, n in t_occurrence(lists, measure.least_overlap(len(s), inverted.sizes[first])):
            if n >= measure.least_overlap(len(s), inverted.sizes[k]):
                yield k, q


def _search(batches: Iterator[pa.RecordBatch], measure: Measure) -> Iterator[pa.RecordBatch]:
    """Rows (block, i, j, run, size, name, copies, grams), sorted: all sets of two runs of a block follow each other."""

    def solve(rows: list[tuple]) -> tuple[list, list, list]:
        (_, i, j), rows = rows[0][:3], sorted(rows, key=lambda r: (r[3], r[4], r[5]))
        own = [np.frombuffer(r[7], np.uint64) for r in rows]
        cut = sum(r[3] == i for r in rows)
        forest, n = Forest(len(rows)), [0] * len(rows)
        edges = []
        found = links(own, None, measure) if i == j else links(own[:cut], own[cut:], measure)
        for a, b in found:
            b += 0 if i == j else cut
            n[a] += rows[b][6]
            n[b] += rows[a][6]
            if forest.join(a, b):
                edges.append((rows[a][5], rows[b][5]))
        return edges, [r[5] for r, k in zip(rows, n, strict=True) if k], [k for k in n if k]

    def result(edges: list, names: list, counts: list) -> pa.RecordBatch:
        a = [x for x, _ in edges] + names
        b = [y for _, y in edges] + [None] * len(names)
        k = [0] * len(edges) + counts
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(k, pa.int64())], ["a", "b", "n"])

    held: list[tuple] = []
    out: tuple[list, list, list] = ([], [], [])
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(8)]
        for row in zip(*cols, strict=True):
            if held and held[0][:3] != row[:3]:
                for x, y in zip(out, solve(held), strict=True):
                    x += y
                held = []
                if len(out[0]) + len(out[1]) > 50_000:
                    yield result(*out)
                    out = ([], [], [])
            held.append(row)
    if held:
        for x, y in zip(out, solve(held), strict=True):
            x += y
    yield result(*out)


def jaccard_groups(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, bits: int = 1 << 23, first: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (documents linked directly, copies included), name, text_hash.

    With ``first`` also the least (no_id, id, text) of the group: its smallest doc_id (NULL last), then its smallest text_hash.
    """
    measure = Measure(num, den)
    own = stage_table(sets(docs.select("doc_id", "text"), n), "sets")
    nodes = stage_table(own.filter("name IS NOT NULL").groupBy("name").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"),
        *[F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("text"))).alias("first")] * first),
        "nodes")
    hot = {r.name: r.first_id for r in nodes.filter(F.col("copies") >= HOT_COPIES).filter("first_id IS NOT NULL")
           .orderBy(F.desc("copies"), "name").limit(HOT_SETS).collect()}
    hot = {bytes(k): v for k, v in hot.items()}

    as_long = F.expr("cast(conv(hex(substring(name, 1, 8)), 16, -10) AS bigint)")  # node()
    total = nodes.agg(F.sum("size")).first()[0] or 0

    # sets that have too many elements of their own link with nothing
    words = None
    if num + den < SHORT_RANGE * 2 * (den - num):
        parts = max(8, int(total / 2 / PART_GRAMS) + 1)
        halves = _packed(docs, n, parts, hot, lambda s: s[s & np.uint64(1) == 0])
        packed_n = halves.repartitionById(parts, "part").mapInArrow(lambda it: _alone(it, parts), "bucket int, nodes binary, counts binary")
        own_n = packed_n.repartitionById(parts, "bucket").mapInArrow(_own_counts, "node bigint, own_n bigint")
        most = F.floor((den - num) * (F.col("size") + F.floor(F.col("size") * den / num)) / (num + den))
        left = nodes.select("first_id", "size", as_long.alias("node")).join(own_n, "node", "left").filter(F.coalesce("own_n", F.lit(0)) <= most)
        left = stage_table(left.select("first_id", "size"), "left")
        words = docs.sparkSession.sparkContext.broadcast(bitmap(left, F.col("first_id"), bits))
        total = left.agg(F.sum("size")).first()[0] or 0

    # blocks
    per_gram = 2.8 * 2 * (den - num) / (num + den)
    parts = max(8, int(total * per_gram / PART_SIGNATURES) + 1)
    packed = _packed(docs, n, parts, hot, lambda s: signatures(s, measure), words, bits)
    alike = packed.repartitionById(parts, "part").mapInArrow(_chains, "nodes binary").distinct()
    work = alike.mapInArrow(_compared, "w bigint, side int, node bigint").join(nodes.select(as_long.alias("node"), "size", "sketch"), "node")
    work = work.select("w", "side", "node", "size", "sketch").repartition("w").sortWithinPartitions("w")
    may = work.mapInArrow(lambda it: _near(it, measure), "a bigint, b bigint")
    blocks = stage_table(components(may, "a", "b"), "blocks")

    # the sets of blocks, again from the texts of one document each
    members = nodes.drop("sketch").withColumn("node", as_long)
    members = stage_table(members.join(blocks, "node").select("name", "first_id", "copies", "size", F.col("root").alias("block")), "members")
    words = docs.sparkSession.sparkContext.broadcast(bitmap(members, F.col("first_id"), bits))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[
        p.alias(f"p{i}") for i, p in enumerate(probe_columns(F.col("doc_id"), bits))])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = np.flatnonzero(in_bitmap(words.value, b.column(2).to_numpy(), b.column(3).to_numpy()))
            texts = utf8(b.column(1).take(pa.array(some)))
            for a, z in chunks(texts):
                got = [s for s in gram_sets(texts[a:z], n) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_name(s) for s in got], pa.binary()), pa.array([s.tobytes() for s in got], pa.binary()),
                     pa.array([measure.band(len(s)) for s in got], pa.int32())], ["g_name", "grams", "band"])

    found = rows.mapInArrow(again, "g_name binary, grams binary, band int").join(
        members, F.col("g_name") == members["name"]).dropDuplicates(["name"]).drop("g_name", "first_id")

    # runs of a block: one, or for a large block some for each band of sizes, dealt by a hash; pairs of runs that can link
    found = stage_table(found, "grams")
    keys = found.select("name", "block", "size", "copies", "band")
    whole = keys.groupBy(F.col("block").alias("w_block")).agg(F.sum("size").alias("w_size"), F.count(F.lit(1)).alias("w_n"))
    whole = whole.filter((F.col("w_size") > RUN_GRAMS) | (F.col("w_n") > RUN_SETS))
    per_band = keys.groupBy(F.col("block").alias("b_block"), F.col("band").alias("b_band")).agg(
        F.greatest(F.ceil(F.sum("size") / RUN_GRAMS), F.ceil(F.count(F.lit(1)) / RUN_SETS)).alias("subs"))
    per_band = per_band.join(whole, F.col("b_block") == F.col("w_block")).select("b_block", "b_band", "subs")
    placed = keys.join(per_band, (F.col("block") == F.col("b_block")) & (F.col("band") == F.col("b_band")), "left")
    sub = F.pmod(F.xxhash64("name"), F.col("subs"))
    run = F.when(F.col("subs").isNull(), F.lit(0)).otherwise(1 + F.col("band").cast("long") * (1 << 40) + sub).cast("long")
    placed = stage_table(placed.select("name", "block", "size", "copies", run.alias("run")), "runs")
    spans = placed.groupBy("block", "run").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    x, y = spans.alias("x"), spans.alias("y")
    tasks = x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.run") <= F.col("y.run"))
                   & (F.col("x.hi") * den >= F.col("y.lo") * num) & (F.col("y.hi") * den >= F.col("x.lo") * num))
    tasks = tasks.select(F.col("x.block").alias("t_block"), F.col("x.run").alias("i"), F.col("y.run").alias("j"))
    sides = tasks.select("t_block", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("t_run"))
    several = placed.join(sides, (placed["block"] == sides["t_block"]) & (placed["run"] == sides["t_run"])).select(
        F.col("block"), "i", "j", "run", "size", "name", "copies")
    full = several.join(found.select(F.col("name").alias("f_name"), "grams"), F.col("name") == F.col("f_name")).select(
        "block", "i", "j", "run", "size", "name", "copies", "grams")
    done = full.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j").mapInArrow(
        lambda it: _search(it, measure), "a binary, b binary, n bigint")
    done = stage_table(done, "links")

    # groups
    groups = stage_table(components(done.filter("b IS NOT NULL"), "a", "b"), "groups")
    n_links = done.filter("b IS NULL").groupBy(F.col("a").alias("l_name")).agg(F.sum("n").alias("n_links"))
    named = nodes.join(groups, nodes["name"] == groups["node"], "left").select(
        "name", "first_id", "copies", F.coalesce("root", "name").alias("root"), *["first"] * first)
    ids = named.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("component_id"), *[F.min("first").alias("least")] * first)
    named = named.join(ids, named["root"] == ids["r"]).join(n_links, F.col("name") == F.col("l_name"), "left")
    named = named.select(F.col("name").alias("m_name"), F.col("component_id").alias("c"),
                         (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), *[F.col("least").alias("first")] * first)
    out = own.join(named, own["name"] == named["m_name"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("c")).alias("component_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "name", "text_hash", *["first"] * first)


def one_of_each(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, bits: int = 1 << 23) -> DataFrame:
    """``docs`` with one document for each group; documents with empty sets all stay.

    The one with the smallest doc_id (NULL last) stays, among equal ids the one with the smallest hash of the text, and of rows
    equal in both any one.  Rows go by doc_id and that hash, so a text of another group under the same doc_id isn't touched.
    Only rows that a bitmap lets through are joined.
    """
    text = F.xxhash64(F.col("text").cast("string"))
    found = jaccard_groups(docs, n, num, den, first=True).filter("n_links > 0")
    stays = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text"))
    linked = found.groupBy(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__gone_text"), stays.alias("__stays")).agg(
        F.count(F.lit(1)).alias("__n"))
    gone = stage_table(linked.filter("NOT __stays OR __n > 1"), "gone")
    repeated = gone.filter("__stays")
    words = docs.sparkSession.sparkContext.broadcast(bitmap(gone, F.xxhash64("__gone", "__gone_text"), bits))
    marked = docs.withColumn("__text", text)
    marked = marked.withColumn("__maybe", maybe_in(words, F.xxhash64("doc_id", "__text"), bits))
    keys = [("doc_id", "__gone"), ("__text", "__gone_text")]
    rest = null_safe(marked.filter("__maybe"), gone, keys, "left_anti")
    out = marked.filter("NOT __maybe").select(*docs.columns).unionByName(rest.select(*docs.columns))
    if not repeated.isEmpty():
        once = null_safe(marked.filter("__maybe"), repeated, keys, "left_semi").dropDuplicates(["doc_id", "__text"])
        out = out.unionByName(once.select(*docs.columns))
    return out
