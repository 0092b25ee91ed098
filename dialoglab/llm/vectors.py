"""Integer vectors in blocks, and seekers that stream past them: what the two vector searches share.

A search index is a table of blocks.  Its rows are range-partitioned by the search's own order, so that one range (``part``)
holds at most about ``part_rows`` rows whatever the key: a running number breaks ties, so copies of one vector fall into many
parts.  ``meet`` brings each part's blocks to a task of its own and streams the seekers that have to visit the part past them; neither
side is ever held whole, and the index isn't copied.

Components become floor(scale * x).  A vector takes no part if it is NULL, holds a NULL or non-finite component, or is longer than
2^31 (its products might not fit a long).  Vectors of different lengths count as filled up with zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = float(1 << 62)
NO_SCORE = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max
#: Rows and bytes of a part's vectors, which one task holds; rows of a block; entries of a directory, which every task gets.
PART_ROWS, PART_BYTES, BLOCK_ROWS, RUNS = 65_536, 16 << 20, 4096, 2048
#: Seekers that are held against a block at once.
SEEKERS = 512


def integer_vectors(df: DataFrame, name: str, vector: str, scale: int, label: str | None = None) -> DataFrame:
    """id (long), vec (little-endian int32), norm2 (long), row (a running number) and, if asked for, label (long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(0)
            lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lens)
            flat = col.flatten()
            x = np.asarray(flat.fill_null(np.nan).to_numpy(zero_copy_only=False), np.float64)
            with np.errstate(all="ignore"):
                x = np.floor(scale * x)
                fine = np.isfinite(x)
                x = np.where(fine, x, 0)
                wide = np.abs(x) >= 1 << 31
                x[wide] = 0
                square = np.concatenate(([0], np.cumsum((x.astype(np.int64) ** 2).view(np.uint64), dtype=np.uint64)))
                about = np.concatenate(([0.0], np.cumsum(x * x)))
                bad = np.concatenate(([0], np.cumsum(~fine | wide)))
                per = lambda total: total[ends] - total[ends - lens]
                norm2 = per(square)
            good = (per(bad) == 0) & ~col.is_null().to_numpy(zero_copy_only=False)
            # sums of a whole batch are rounded, so vectors near the limit are added up on their own
            for i in np.flatnonzero(good & (per(about) > LONGEST / 4)):
                good[i] = (x[ends[i] - lens[i] : ends[i]] ** 2).sum() <= LONGEST
            raw = x.astype("<i4").tobytes()
            at = np.flatnonzero(good)
            vecs = [raw[4 * (ends[i] - lens[i]) : 4 * ends[i]] for i in at]
            rest = pa.RecordBatch.from_arrays([b.column(j) for j in range(1, b.num_columns)], names).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(vecs, pa.binary()), pa.array(norm2[at].astype(np.int64))],
                                             [*names, "vec", "norm2"])

    names = ["id", "row"] + ["label"] * bool(label)
    rows = df.select(F.col(vector).cast("array<double>").alias("v"), F.col(name).cast("long").alias("id"),
                     F.monotonically_increasing_id().alias("row"), *([F.col(label).cast("long").alias("label")] if label else []))
    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names) + ", vec binary, norm2 bigint")


def extent(df: DataFrame, vector: str) -> tuple[int, int]:
    """Rows and the largest number of components."""
    n, dim = df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    return n, max(1, dim)


def part_count(df: DataFrame, n: int, dim: int) -> int:
    """Parts of bounded size; on a small input enough of them to keep all cores busy."""
    rows = max(1, min(PART_ROWS, PART_BYTES // (4 * dim)))
    return max(-(-n // rows), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // 2048)), 1)


def matrix(vecs: list[bytes] | pa.Array, dtype=np.int32) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    vecs = vecs.to_pylist() if isinstance(vecs, pa.Array) else vecs
    dim = max(map(len, vecs), default=0) // 4
    if all(len(v) == 4 * dim for v in vecs):
        return np.frombuffer(b"".join(vecs), "<i4").reshape(len(vecs), dim).astype(dtype)
    return np.stack([np.pad(np.frombuffer(v, "<i4"), (0, dim - len(v) // 4)) for v in vecs]).astype(dtype)


def exact_type(a2: int, b2: int) -> type:
    """The fastest type in which the products of vectors of squared lengths a2 and b2 are exact (every partial sum is below |a||b|)."""
    most = float(a2) * float(b2)
    return np.float32 if most < 2.0**47 else np.float64 if most < 2.0**105 else np.int64


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b, both of an exact type."""
    d = min(a.shape[1], b.shape[1])
    return a[:, :d] @ b[:, :d].T


class Best:
    """The k best entries of each of n rows: score descending, then id ascending, NULL ids last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NO_SCORE, np.int64)
        self.id = np.full((n, k), NO_ID, np.int64)
        self.null = np.ones((n, k), bool)

    def add(self, row: np.ndarray, score: np.ndarray, id_: np.ndarray, null: np.ndarray) -> None:
        if not len(row):
            return
        rows = np.unique(row)
        row = np.concatenate((np.repeat(rows, self.k), row))
        score = np.concatenate((self.score[rows].ravel(), score.astype(np.int64)))
        id_ = np.concatenate((self.id[rows].ravel(), id_))
        null = np.concatenate((self.null[rows].ravel(), null))
        order = np.lexsort((null, id_, ~score, row))
        row = row[order]
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
        top = order[place < self.k]  # each row has its k old entries at least
        self.score[rows] = score[top].reshape(-1, self.k)
        self.id[rows] = id_[top].reshape(-1, self.k)
        self.null[rows] = null[top].reshape(-1, self.k)

    def better(self, scores: np.ndarray, ids: np.ndarray, rows: slice | np.ndarray = slice(None)) -> np.ndarray:
        """Which of ``scores`` (rows by candidates) may still enter."""
        last, last_id = self.score[rows, -1][:, None], self.id[rows, -1][:, None]
        return (scores > last) | (scores == last) & (ids[None, :] <= last_id)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, score, id, null) of all that was found."""
        row, at = np.nonzero(self.score > NO_SCORE)
        return row, self.score[row, at], self.id[row, at], self.null[row, at]


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, NULL as the largest number, and which are NULL."""
    return (pc.fill_null(column, NO_ID).to_numpy(zero_copy_only=False).astype(np.int64),
            column.is_null().to_numpy(zero_copy_only=False))


def nullable(ids: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=null)


def in_parts(rows: DataFrame, parts: int, order: list[Column]) -> DataFrame:
    """Ranges of about equal size by ``order``, ties dealt by the running number of the row."""
    return rows.repartitionByRange(parts, *order, "row").sortWithinPartitions(*order, "row")


def blocks_of(batches: Iterator[pa.RecordBatch], same: str | None, rows: int) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``rows`` rows, and of one value of ``same``, across the batches of a task."""
    held: list[pa.RecordBatch] = []
    n, key = 0, None

    def full() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        keys = b.column(same).to_numpy(zero_copy_only=False) if same else np.zeros(b.num_rows)
        a = 0
        while a < b.num_rows:
            if held and (n >= rows or keys[a] != key):
                yield full()
                held, n = [], 0
            key = keys[a]
            other = np.flatnonzero(keys[a : a + rows - n] != key)
            z = a + (other[0] if len(other) else min(rows - n, b.num_rows - a))
            held.append(b.slice(a, z - a))
            n, a = n + z - a, z
    if held:
        yield full()


def meet(blocks: DataFrame, seekers: DataFrame, parts: int, order: list[str], open_block: Callable, search: Callable, schema: str) -> DataFrame:
    """Stream ``seekers`` past the blocks of their parts.

    ``blocks`` has part, block and more, ``seekers`` part and more, among it ``order``, in which they come.  ``open_block(row)``
    makes of a block what the task holds while the part lasts; ``search(held, batch)`` yields results for some seekers.
    """
    own = [c for c in blocks.columns if c not in ("part", "block")]
    more = [c for c in seekers.columns if c != "part"]
    kind = seekers.select(F.struct(*more).alias("s")).schema["s"].dataType
    b = blocks.select("part", F.lit(0).alias("kind"), "block", F.struct(*own).alias("b"), F.lit(None).cast(kind).alias("s"))
    s = seekers.select("part", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("block"),
                       F.lit(None).cast(b.schema["b"].dataType).alias("b"), F.struct(*more).alias("s"))
    # a task for each part: by a hash of the number, some tasks would get several parts and others none
    dealt = b.union(s).repartitionById(parts, "part").sortWithinPartitions("part", "kind", "block", *[f"s.{c}" for c in order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            of, is_seeker = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero((of[1:] != of[:-1]) | (is_seeker[1:] != is_seeker[:-1])) + 1
            for a, z in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if z == a:
                    continue
                if of[a] != part:
                    part, held = of[a], []
                if not is_seeker[a]:
                    for i in range(a, z):
                        held.append(open_block(batch.column(3)[i].as_py()))
                elif held:
                    some = pa.RecordBatch.from_struct_array(batch.column(4).slice(a, z - a))
                    for i in range(0, some.num_rows, SEEKERS):
                        yield from search(held, some.slice(i, SEEKERS))

    return dealt.mapInArrow(run, schema)


def runs_of(parts: int) -> int:
    """Parts that share an entry of the directory."""
    return -(-parts // RUNS)


def to_parts(seekers: DataFrame, parts: int) -> DataFrame:
    """One row for each part of the ``runs`` (array<int>) that a seeker has to visit."""
    g = runs_of(parts)
    each = seekers.withColumn("__run", F.explode("runs")).drop("runs")
    in_run = F.sequence(F.col("__run") * g, F.least(F.col("__run") * g + g - 1, F.lit(parts - 1)))
    return each.withColumn("part", F.explode(in_run)).drop("__run")


def key_order(best: Column, name: str) -> list[Column]:
    return [best.desc(), F.col(name).asc_nulls_last()]
