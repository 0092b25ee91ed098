"""Hard-negative mining over length buckets with coordinate pruning.

Rows are dealt by descending length into parts and, in a part, into buckets of at most ``BLOCK_ROWS`` rows.  A bucket holds for
each coordinate the list of its rows sorted by that coordinate of their unit vectors.  An anchor a with threshold t needs only

* buckets whose largest length l has |a| l >= t; as the buckets come by descending length, the others are a suffix;
* in such a bucket, rows whose unit vector lies within the angle acos(t / (|a| l)) of the anchor's, so that a coordinate f of
  theirs lies between the cosines of that angle added to and taken from the angle between the anchor and the axis f.  For the
  ``FOCUS`` coordinates in which the anchor is largest these feasible ranges are cut from the sorted lists, the
  shortest one gives the candidates, the other ranges thin them out, and only what is left is verified by its exact score.

Where even the shortest range holds most of a bucket, the anchors that see it so are verified together in one product.

First the positives: the best rows of the anchor's label; its own bucket gives the first threshold.  Then, for each positive with
score p, the negatives: the best rows of other labels with low * p <= 100 * score <= high * p.  Their first threshold is the band's lower
end.  All thresholds rise as rows are found.

Defined cases: see ``vectors`` for vectors that take no part; rows with a NULL label take none either; labels are integers; rows
with the anchor's id are its own; an anchor row gets results of its own, also if rows repeat; NULL ids count as candidates and come
last among equal scores; bands of a negative score are empty; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from .common import stage_table

#: Coordinates whose feasible ranges are intersected.
FOCUS = 4
#: A shortest range that holds more than this share of its bucket is verified by one product for all such anchors.
WIDE = 0.25
#: Unit vectors are rounded; ranges are widened by so much.
SLACK = 1e-5


def build_index(rows: DataFrame, parts: int) -> DataFrame:
    """part, block, l2 (largest squared length), ids, labels, vecs, lists (a coordinate's rows in ascending order, uint16)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, b in enumerate(V.blocks_of(batches, None, V.BLOCK_ROWS)):
            n = b.num_rows
            lists = np.argsort(units(V.matrix(b.column("vec"), np.float32)), axis=0, kind="stable").T.astype("<u2")
            whole = lambda c: pa.ListArray.from_arrays([0, n], b.column(c))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([b.column("norm2").to_numpy().max()]),
                 whole("id"), whole("label"), whole("vec"), pa.array([lists.tobytes()], pa.binary())],
                ["part", "block", "l2", "ids", "labels", "vecs", "lists"])

    dealt = V.in_parts(rows, parts, [F.col("norm2").desc()])
    packed = dealt.mapInArrow(pack, "part int, block int, l2 bigint, ids array<bigint>, labels array<bigint>, vecs array<binary>, lists binary")
    return stage_table(packed, "buckets")


def units(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors; a vector of length 0 stays."""
    length = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    return (x / np.where(length > 0, length, 1)[:, None]).astype(np.float32)


class Bucket:
    def __init__(self, row: dict):
        self.l2 = row["l2"]
        self.ids, self.null = V.ids_of(pa.array(row["ids"], pa.int64()))
        self.labels = np.array(row["labels"], np.int64)
        self.vecs = V.matrix(row["vecs"])
        n, dim = self.vecs.shape
        self.lists = np.frombuffer(row["lists"], "<u2").reshape(dim, n)
        self.unit = units(self.vecs)
        self.sorted = np.take_along_axis(self.unit.T, self.lists, axis=1)

    def ranges(self, unit: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, ...]:
        """For anchors with a unit vector and an angle each: focus coordinates, lower and upper ends, and places in the lists."""
        n, dim = self.unit.shape
        k = min(FOCUS, dim, unit.shape[1])
        focus = np.argsort(-np.abs(unit[:, :dim]), axis=1, kind="stable")[:, :k]
        axis = np.arccos(np.clip(np.take_along_axis(unit, focus, 1).astype(np.float64), -1, 1))
        low = np.cos(np.minimum(axis + angle[:, None], np.pi)) - SLACK
        high = np.cos(np.maximum(axis - angle[:, None], 0)) + SLACK
        first, last = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
        for f in np.unique(focus):
            at = focus == f
            first[at] = np.searchsorted(self.sorted[f], low[at], "left")
            last[at] = np.searchsorted(self.sorted[f], high[at], "right")
        return focus, low, high, first, last

    def candidates(self, unit: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """(anchors that have to see the whole bucket, candidates of each other anchor that has any)."""
        n, dim = self.unit.shape
        if not dim or not len(unit) or not unit.shape[1]:
            return np.arange(len(unit)), {}
        focus, low, high, first, last = self.ranges(unit, angle)
        best = (last - first).argmin(1)
        size = (last - first)[np.arange(len(unit)), best]
        few = {}
        for i in np.flatnonzero((size > 0) & (size <= WIDE * n)):
            j = best[i]
            rows = self.lists[focus[i, j], first[i, j] : last[i, j]]
            for o in range(focus.shape[1]):
                if o != j:
                    x = self.unit[rows, focus[i, o]]
                    rows = rows[(x >= low[i, o]) & (x <= high[i, o])]
            if len(rows):
                few[int(i)] = rows
        return np.flatnonzero(size > WIDE * n), few

    def scored(self, vecs: np.ndarray, a2: np.ndarray, length: np.ndarray, tau: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, rows, scores[anchor, row]) of all that may reach the anchors' thresholds."""
        reach = length * np.sqrt(float(self.l2))
        live = np.flatnonzero(reach * (1 + 1e-9) + 1 >= tau)
        if not len(live):
            return
        kind = V.exact_type(int(a2[live].max()), self.l2)
        mine, own = self.vecs.astype(kind), vecs.astype(kind)
        cos = np.where(reach[live] > 0, tau[live] / np.where(reach[live] > 0, reach[live], 1), -1.0)
        pruned = cos > 0  # a threshold of 0 or less excludes no direction, and rows shorter than the bucket's longest neither
        some = live[pruned]
        whole, few = self.candidates(units(vecs[some]), np.arccos(np.clip(cos[pruned], -1, 1)))
        everything = np.concatenate((live[~pruned], some[whole])).astype(int)
        rows = np.arange(len(mine))
        for a in range(0, len(everything), 128):
            at = everything[a : a + 128]
            yield at, rows, V.products(own[at], mine)
        for i, r in few.items():
            yield some[i : i + 1], r, V.products(own[some[i] : some[i] + 1], mine[r])


def _anchors(some: pa.RecordBatch) -> tuple:
    vecs = V.matrix(some.column("vec"))
    a2 = some.column("norm2").to_numpy()
    return some.column("anchor_id").to_numpy(), some.column("label").to_numpy(), vecs, a2, np.sqrt(a2.astype(float))


def seeds(index: DataFrame, every: int, k: int) -> DataFrame:
    """The anchors, with the threshold for positives that their own bucket gives."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, null = V.ids_of(b.column("ids")[i].values)
                at = np.flatnonzero((ids % every == 0) & ~null)
                if not len(at):
                    continue
                block = Bucket({c: b.column(c)[i].as_py() for c in ("l2", "ids", "labels", "vecs", "lists")})
                for a in range(0, len(at), V.SEEKERS):
                    own = at[a : a + V.SEEKERS]
                    vecs = block.vecs[own]
                    a2 = (vecs.astype(np.int64) ** 2).sum(1)
                    best = V.Best(len(own), k)
                    positives(block, best, best.score[:, -1].copy(), ids[own], block.labels[own], vecs, a2, np.sqrt(a2.astype(float)))
                    part, number = int(b.column("part")[i].as_py()), int(b.column("block")[i].as_py())
                    key = (part << 32) + number * V.BLOCK_ROWS + own
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key, pa.int64()), pa.array(ids[own]), pa.array(block.labels[own]), pa.array(a2),
                         pa.array([v.astype("<i4").tobytes() for v in vecs], pa.binary()), pa.array(best.score[:, -1])],
                        ["key", "anchor_id", "label", "norm2", "vec", "tau"])

    return index.mapInArrow(find, "key bigint, anchor_id bigint, label bigint, norm2 bigint, vec binary, tau bigint")


def positives(block: Bucket, best: V.Best, tau: np.ndarray, own: np.ndarray, label: np.ndarray, vecs: np.ndarray, a2: np.ndarray,
              length: np.ndarray) -> None:
    """Offer a bucket's rows of the anchors' labels that score at least ``tau``."""
    for at, rows, s in block.scored(vecs, a2, length, np.maximum(tau, best.score[:, -1]).astype(float)):
        ids, null = block.ids[rows], block.null[rows]
        fits = (block.labels[rows][None, :] == label[at, None]) & ((ids[None, :] != own[at, None]) | null[None, :])
        r, c = np.nonzero(fits & (s >= tau[at, None]) & best.better(s, ids, at))
        best.add(at[r], s[r, c], ids[c], null[c])


def find_positives(held: list[Bucket], some: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    own, label, vecs, a2, length = _anchors(some)
    best, tau = V.Best(len(own), k), some.column("tau").to_numpy()
    for block in held:  # by descending length
        positives(block, best, tau, own, label, vecs, a2, length)
    row, score, ids, null = best.entries()
    if len(row):
        yield pa.RecordBatch.from_arrays([some.column("key").take(pa.array(row)), V.nullable(ids, null), pa.array(score)],
                                         ["key", "positive_id", "positive_score"])


def find_negatives(held: list[Bucket], some: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """``some`` has a list of bands [lowest, highest] for each anchor."""
    own, label, vecs, a2, length = _anchors(some)
    lowest, highest = some.column("lowest").to_pylist(), some.column("highest").to_pylist()
    width = max(map(len, lowest))
    low = np.array([x + [V.NO_ID] * (width - len(x)) for x in lowest], np.int64)  # a band that no score reaches
    high = np.array([x + [V.NO_SCORE] * (width - len(x)) for x in highest], np.int64)
    best = [V.Best(len(own), k) for _ in range(width)]
    for block in held:
        need = np.min([np.maximum(low[:, j], best[j].score[:, -1]) for j in range(width)], axis=0)
        for at, rows, s in block.scored(vecs, a2, length, need.astype(float)):
            ids, null = block.ids[rows], block.null[rows]
            other = block.labels[rows][None, :] != label[at, None]
            for j in range(width):
                fits = other & (s >= low[at, j, None]) & (s <= high[at, j, None])
                r, c = np.nonzero(fits & best[j].better(s, ids, at))
                best[j].add(at[r], s[r, c], ids[c], null[c])
    for j in range(width):
        row, score, ids, null = best[j].entries()
        if len(row):
            yield pa.RecordBatch.from_arrays([some.column("key").take(pa.array(row)), pa.array([j] * len(row), pa.int32()), V.nullable(ids, null),
                                              pa.array(score)], ["key", "place", "negative_id", "negative_score"])


def mine(df: DataFrame, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, every: int = 100, scale: int = 256,
         name: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; ``low`` and ``high`` are percentages of the positive's score.
    """
    df = df.where(F.col(label).isNotNull())
    n, dim = V.extent(df, vector)
    rows = V.integer_vectors(df, name, vector, scale, label)
    index = build_index(rows, V.part_count(df, n, dim))
    parts = (index.agg(F.max("part")).first()[0] or 0) + 1
    g = V.runs_of(parts)
    # at most RUNS rows
    lengths = {r[0]: r[1] for r in index.groupBy(F.floor(F.col("part") / g).cast("int")).agg(F.max("l2")).collect()}
    blocks = index.select("part", "block", "l2", "ids", "labels", "vecs", "lists")

    def visits(seekers: DataFrame, threshold: str) -> DataFrame:
        """The runs of parts with rows long enough for the threshold."""
        ends = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(float(v)).alias("l2")) for r, v in sorted(lengths.items())])
        t = F.col(threshold).cast("double")
        reach = lambda x: (t <= 0) | (x["l2"] * F.col("norm2") * (1 + 1e-9) + 1 >= t * t)
        found = F.transform(F.filter(ends, reach), lambda x: x["run"])
        return V.to_parts(seekers.withColumn("runs", found), parts)

    anchors = stage_table(seeds(index, every, n_positives), "anchors")
    if not lengths:
        return df.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    met = V.meet(blocks, visits(anchors, "tau"), parts, ["norm2", "key"], Bucket, lambda h, s: find_positives(h, s, n_positives),
                 "key bigint, positive_id bigint, positive_score bigint")
    order = V.key_order(F.col("positive_score"), "positive_id")
    first = met.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1).where(F.col("place") < n_positives)
    first = stage_table(first, "positives")
    score = F.col("positive_score")
    # band ends as integers: the smallest s with low * p <= 100 * s and the largest with 100 * s <= high * p
    bands = first.withColumn("lo", -F.floor(-F.lit(low).cast("decimal(20,0)") * score / 100).cast("long")).withColumn(
        "hi", F.floor(F.lit(high).cast("decimal(20,0)") * score / 100).cast("long"))
    # an empty band (of a score below 0) must not lower what the anchor's other bands need
    bands = bands.withColumn("lo", F.when(F.col("lo") <= F.col("hi"), F.col("lo")).otherwise(F.lit(V.NO_ID))).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("place", "lo", "hi"))).alias("bands"))
    seekers = anchors.drop("tau").join(bands, "key").select(
        "key", "anchor_id", "label", "norm2", "vec", F.array_min("bands.lo").alias("least"), F.col("bands.lo").alias("lowest"),
        F.col("bands.hi").alias("highest"))
    met = V.meet(blocks, visits(seekers, "least"), parts, ["norm2", "key"], Bucket, lambda h, s: find_negatives(h, s, n_negatives),
                 "key bigint, place int, negative_id bigint, negative_score bigint")
    w = Window.partitionBy("key", "place").orderBy(*V.key_order(F.col("negative_score"), "negative_id"))
    top = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_negatives)
    return top.join(first, ["key", "place"]).join(anchors.select("key", "anchor_id"), "key").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
