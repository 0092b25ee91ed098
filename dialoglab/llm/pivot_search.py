"""Exact top-k search by inner product over a pivot-distance index.

Each vector is keyed by its nearest pivot and its distance to it.  Rows are dealt into ranges of (pivot, distance) and written as
blocks: annuli around a pivot, of at most ``BLOCK_ROWS`` rows.  Of a vector x in an annulus [lo, hi] around p the triangle
inequality says |q - x| >= max(lo - |q - p|, |q - p| - hi, 0), and as q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, that bounds its score from above.

A query starts in the annulus that it lies in itself: the k-th best score there is its first threshold.  It then visits the parts
that a directory of bounded size can't exclude; in a part the annuli are expanded in the order of their distance from the
queries, each raising the thresholds, until no bound reaches one.  Bounds only exclude; scores are exact integers.

Pivots are the centres of a few rounds of k-means over a sample of at most ``SAMPLE`` rows (the smallest hashes); they
decide how much is pruned, never what is found.

Defined cases: see ``vectors`` for vectors that take no part; every row whose id is divisible by ``every`` is a query and gets a list of its
own, also if rows repeat; rows with the query's id are its own and no candidates; candidates with a NULL id count and come last
among equal scores; an empty table gives an empty result; other columns are never read.
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

#: Rows from which the pivots are made; pivots at most, and bytes that they may take in a task.
SAMPLE, PIVOTS, PIVOT_BYTES = 4096, 1024, 8 << 20
#: Distances are rounded; bounds are widened by this share of the vectors' lengths.
SLACK = 1e-6


def choose_pivots(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """About sqrt(n / 512) centres, as a matrix."""
    some = [bytes(r.vec) for r in rows.select("vec").orderBy(F.xxhash64("vec", "row"), "row").limit(SAMPLE).collect()]
    if not some:
        return np.zeros((0, 1))
    x = V.matrix(some, np.float64)
    k = max(1, min(len(x), PIVOTS, PIVOT_BYTES // (8 * dim), int((n / 512) ** 0.5)))
    at = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(4):
        near = distances(x, at).argmin(1)
        total = np.zeros_like(at)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=k)
        at[count > 0] = total[count > 0] / count[count > 0, None]
    return at


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = min(x.shape[1], pivots.shape[1])
    rest = (x[:, d:] ** 2).sum(1)[:, None] + (pivots[:, d:] ** 2).sum(1)[None, :]
    a, b = x[:, :d], pivots[:, :d]
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T) + rest
    return np.sqrt(np.maximum(square, 0))


def upper_bound(q2: np.ndarray, d: np.ndarray, lo: np.ndarray, hi: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Largest score that a vector of an annulus may have; rows are queries, columns annuli (d: their pivots' distances)."""
    slack = SLACK * (1 + np.sqrt(q2)[:, None] + np.sqrt(x2)[None, :])
    gap = np.maximum(np.maximum(lo[None, :] - d, d - hi[None, :]) - slack, 0)
    by_angle = np.sqrt(q2)[:, None] * np.sqrt(x2)[None, :]
    both = q2[:, None] + x2[None, :]
    return np.minimum((both - gap**2) / 2, by_angle) + 1 + 1e-9 * both


def build_index(rows: DataFrame, pivots: np.ndarray, parts: int) -> DataFrame:
    """part, block, pivot, lo, hi, x2 (largest squared length), ids, vecs."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, V.BLOCK_ROWS):
                part = b.slice(a, V.BLOCK_ROWS)
                d = distances(V.matrix(part.column("vec"), np.float64), pivots)
                p = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p])],
                                                 [*part.schema.names, "pivot", "dist"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, b in enumerate(V.blocks_of(batches, "pivot", V.BLOCK_ROWS)):
            d = b.column("dist").to_numpy()
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([k], pa.int32()), b.column("pivot").slice(0, 1), pa.array([d.min()]), pa.array([d.max()]),
                 pa.array([b.column("norm2").to_numpy().max()]), pa.ListArray.from_arrays([0, n], b.column("id")),
                 pa.ListArray.from_arrays([0, n], b.column("vec"))], ["part", "block", "pivot", "lo", "hi", "x2", "ids", "vecs"])

    keyed = rows.select("id", "row", "vec", "norm2").mapInArrow(near, "id bigint, row bigint, vec binary, norm2 bigint, pivot int, dist double")
    packed = V.in_parts(keyed, parts, [F.col("pivot"), F.col("dist")]).mapInArrow(
        pack, "part int, block int, pivot int, lo double, hi double, x2 bigint, ids array<bigint>, vecs array<binary>")
    return stage_table(packed, "annuli")


class Annulus:
    def __init__(self, row: dict):
        self.pivot, self.lo, self.hi, self.x2 = row["pivot"], row["lo"], row["hi"], row["x2"]
        self.ids, self.null = V.ids_of(pa.array(row["ids"], pa.int64()))
        self.vecs = V.matrix(row["vecs"])

    def scores(self, q: np.ndarray, q2: int) -> np.ndarray:
        kind = V.exact_type(q2, self.x2)
        return V.products(q.astype(kind), self.vecs.astype(kind))

    def offer(self, best: V.Best, rows: np.ndarray, own: np.ndarray, q: np.ndarray, q2: int) -> None:
        """Hold some queries against every vector of the annulus, 256 at a time."""
        for a in range(0, len(rows), 256):
            at = rows[a : a + 256]
            s = self.scores(q[at], q2)
            r, c = np.nonzero(best.better(s, self.ids, at) & ((self.ids[None, :] != own[at, None]) | self.null[None, :]))
            best.add(at[r], s[r, c], self.ids[c], self.null[c])


def seeds(index: DataFrame, pivots: np.ndarray, divisor: int, k: int, directory: list) -> DataFrame:
    """The queries, with the threshold that their own annulus gives and the runs of parts that they have to visit."""
    run, pivot, lo, hi, x2 = (np.array(c, t) for c, t in zip(zip(*directory, strict=True), (int, int, float, float, float), strict=True))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, null = V.ids_of(b.column("ids")[i].values)
                at = np.flatnonzero((ids % divisor == 0) & ~null)
                if not len(at):
                    continue
                block = Annulus({c: b.column(c)[i].as_py() for c in ("pivot", "lo", "hi", "x2", "ids", "vecs")})
                for a in range(0, len(at), V.SEEKERS):
                    own = at[a : a + V.SEEKERS]
                    q = block.vecs[own]
                    q2 = (q.astype(np.int64) ** 2).sum(1)
                    best = V.Best(len(own), k)
                    block.offer(best, np.arange(len(own)), ids[own], q, int(q2.max()))
                    tau, tau_id = best.score[:, -1], best.id[:, -1]
                    d = distances(q.astype(np.float64), pivots)
                    visit = upper_bound(q2.astype(float), d[:, pivot], lo, hi, x2) >= tau[:, None]
                    found = [np.unique(run[v]).astype(np.int32) for v in visit]
                    ends = np.cumsum([0, *map(len, found)])
                    part, number = int(b.column("part")[i].as_py()), int(b.column("block")[i].as_py())
                    key = (part << 32) + number * V.BLOCK_ROWS + own
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key, pa.int64()), pa.array(ids[own]), pa.array([block.pivot] * len(own), pa.int32()),
                         pa.array(d[:, block.pivot]), pa.array([v.astype("<i4").tobytes() for v in q], pa.binary()), pa.array(tau), pa.array(tau_id),
                         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))],
                        ["key", "query_id", "pivot", "dist", "vec", "tau", "tau_id", "runs"])

    return index.mapInArrow(find, "key bigint, query_id bigint, pivot int, dist double, vec binary, tau bigint, tau_id bigint, runs array<int>")


def expand(held: list[Annulus], some: pa.RecordBatch, pivots: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Expand a part's annuli for some queries, nearest first, until no bound reaches a threshold."""
    q = V.matrix(some.column("vec"))
    own = some.column("query_id").to_numpy()
    q2 = (q.astype(np.int64) ** 2).sum(1)
    best = V.Best(len(q), k)
    first, first_id = some.column("tau").to_numpy(), some.column("tau_id").to_numpy()
    lo, hi, x2 = (np.array([getattr(h, c) for h in held], float) for c in ("lo", "hi", "x2"))
    d = distances(q.astype(np.float64), pivots)[:, [h.pivot for h in held]]
    bound = upper_bound(q2.astype(float), d, lo, hi, x2)
    order = np.argsort(-bound.max(0), kind="stable")
    rest = np.maximum.accumulate(bound[:, order][:, ::-1], axis=1)[:, ::-1]
    floor_ = Floor(best, first, first_id)
    for j, at in enumerate(order):
        if (rest[:, j] < floor_.tau()).all():
            break
        rows = np.flatnonzero(bound[:, at] >= floor_.tau())
        if len(rows):
            held[at].offer(floor_, rows, own, q, int(q2.max()))
    row, score, ids, null = best.entries()
    if len(row):
        yield pa.RecordBatch.from_arrays([some.column("key").take(pa.array(row)), some.column("query_id").take(pa.array(row)), V.nullable(ids, null),
                                          pa.array(score)], ["key", "query_id", "vec_id", "score"])


class Floor:
    """A ``Best`` that also keeps out what an earlier threshold (score, id) rules out."""

    def __init__(self, best: V.Best, tau: np.ndarray, tau_id: np.ndarray):
        self.best, self.first, self.first_id, self.add = best, tau, tau_id, best.add

    def tau(self) -> np.ndarray:
        return np.maximum(self.first, self.best.score[:, -1])

    def better(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        t, t_id = self.first[rows, None], self.first_id[rows, None]
        return self.best.better(scores, ids, rows) & ((scores > t) | (scores == t) & (ids[None, :] <= t_id))


def top_k(df: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, name: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all other rows for each row whose id is divisible by ``every``."""
    spark = df.sparkSession
    n, dim = V.extent(df, vector)
    rows = V.integer_vectors(df, name, vector, scale)
    pivots = choose_pivots(rows, n, dim)
    none = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not len(pivots):
        return none
    parts = V.part_count(df, n, dim)
    index = build_index(rows, pivots, parts)
    parts = index.agg(F.max("part")).first()[0] + 1
    g = V.runs_of(parts)
    # at most RUNS + PIVOTS rows: parts are ranges of (pivot, distance)
    directory = [tuple(r) for r in index.groupBy(F.floor(F.col("part") / g).cast("int").alias("run"), "pivot")
                 .agg(F.min("lo"), F.max("hi"), F.max("x2")).collect()]
    queries = stage_table(seeds(index, pivots, every, k, directory), "queries")
    blocks = index.select("part", "block", "pivot", "lo", "hi", "x2", "ids", "vecs")
    met = V.meet(blocks, V.to_parts(queries, parts), parts, ["pivot", "dist"], Annulus,
                 lambda held, some: expand(held, some, pivots, k), "key bigint, query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("key").orderBy(*V.key_order(F.col("score"), "vec_id"))
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
