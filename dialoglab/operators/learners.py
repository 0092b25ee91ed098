"""Logistic regressions over hashed words, many outputs in one pass (the learner behind M2 and M3).

Texts become blocks of sparse rows once (hashed words, all targets beside them), written to the shared folder.  A
*column* is one regression: a target and a regularisation, so the labels of a measure are columns, and so are the runs of a
search over regularisations.  Every pass over the blocks evaluates one trial point of each column: the tasks add up the
loss and gradient of all columns over the train rows and count the right answers over the validation rows, the sums
are added up by slices of the gradient in further tasks, and one vector a column reaches the driver.  There each column
takes its own L-BFGS step with its own line search; a pass serves all of them.

An accepted point is an epoch of its column.  With a ``state`` folder each pass is saved there, and a run that was cut
off goes on behind the last saved pass and gives the same numbers: sums are added up in a fixed order.

A word weighs (1 + log tf) * IDF, and rows have length 1.  IDF weights and lengths aren't written into the blocks but follow from what
the train rows say about the words, so the blocks are written once.
"""

from __future__ import annotations

import io
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Places that hashed words share; more of them merge fewer words, and make weights and gradients longer.
NUM_FEATURES = 1 << 16
#: Rows of a block; slices of a gradient; pairs that L-BFGS remembers.
BLOCK_ROWS, SLICES, MEMORY = 512, 8, 8
_WORD = re.compile(r"\w+")
_BLOCK = "split string, ids array<string>, y binary, ends binary, cols binary, tf binary, by_col binary"


def _hashed(text: str, num_features: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of a text's words and how often each is taken."""
    counts = Counter(_WORD.findall(text.lower()))
    places = np.fromiter((zlib.crc32(w.encode()) for w in counts), np.int64, len(counts)) % num_features
    cols, at = np.unique(places, return_inverse=True)
    return cols.astype(np.int32), np.bincount(at, list(counts.values()), len(cols)).astype(np.float64) if len(cols) else np.empty(0)


def write_blocks(data: DataFrame, text: str | Column, targets: Column, id_col: str = "id", split_col: str = "split",
                 num_features: int = NUM_FEATURES) -> DataFrame:
    """Blocks of rows of one split each; ``targets`` is an array of 0/1.  Rows without targets or split are left out."""
    text = F.col(text) if isinstance(text, str) else text
    rows = data.where(targets.isNotNull() & F.col(split_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(split_col).alias("split"), targets.cast("array<tinyint>").alias("y"),
        F.coalesce(text, F.lit("")).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def full(split: str, own: list) -> pa.RecordBatch:
            cols, tf = [u for _, _, u, _ in own], [n for _, _, _, n in own]
            ends = np.cumsum([len(u) for u in cols]).astype("<i4")
            cols, tf = np.concatenate(cols).astype("<i4"), (1 + np.log(np.concatenate(tf))).astype("<f4")
            raw = (np.array([y for _, y, _, _ in own], np.int8), ends, cols, tf, np.argsort(cols, kind="stable").astype("<i4"))
            return pa.RecordBatch.from_arrays([pa.array([split]), pa.array([[i for i, _, _, _ in own]], pa.list_(pa.string())),
                                               *[pa.array([x.tobytes()], pa.binary()) for x in raw]],
                                              ["split", "ids", "y", "ends", "cols", "tf", "by_col"])

        for b in batches:
            for row in zip(*(b.column(k) for k in range(4)), strict=True):  # one text at a time, of which numbers are held
                i, s, y, t = (x.as_py() for x in row)
                own = held.setdefault(s, [])
                own.append((i, y, *_hashed(t, num_features)))
                if len(own) >= BLOCK_ROWS:
                    yield full(s, held.pop(s))
        for s, own in held.items():
            yield full(s, own)

    path = scratch_path(data.sparkSession, "blocks")
    rows.mapInArrow(pack, _BLOCK).write.parquet(path)
    return data.sparkSession.read.schema(_BLOCK).parquet(path)


class Block:
    """One block with its sparse products."""

    def __init__(self, batch: pa.RecordBatch, i: int, place: np.ndarray, idf: np.ndarray):
        """``idf`` has an entry of 0 for words that no train row holds."""
        get = lambda c, t: np.frombuffer(batch.column(c)[i].as_py(), t)
        self.split, self.ids = batch.column("split")[i].as_py(), batch.column("ids")[i]
        ends = get("ends", "<i4")
        self.n = len(ends)
        self.y = get("y", np.int8).reshape(self.n, -1)
        self.at = place[get("cols", "<i4")]
        self.by_col = get("by_col", "<i4")
        self.lengths = np.diff(ends, prepend=0)
        x = get("tf", "<f4") * idf[self.at]
        self.rows = np.repeat(np.arange(self.n), self.lengths)
        norm = np.sqrt(np.bincount(self.rows, x * x, self.n))
        self.x = x / np.where(norm > 0, norm, 1)[self.rows]

    def margins(self, u: np.ndarray) -> np.ndarray:
        """Rows times weights; the last row of ``u`` is the intercept, the one before stands for unknown words."""
        out = np.zeros((self.n, u.shape[1]))
        some = np.flatnonzero(self.lengths)
        if len(some):
            starts = np.cumsum(self.lengths)[some] - self.lengths[some]
            out[some] = np.add.reduceat(u[self.at] * self.x[:, None], starts, axis=0)
        return out + u[-1]

    def transposed(self, r: np.ndarray, into: np.ndarray) -> None:
        """Add the gradient of the weights for the rows' residuals."""
        if not len(self.at):
            return
        at = self.at[self.by_col]
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        into[at[starts]] += np.add.reduceat(r[self.rows[self.by_col]] * self.x[self.by_col, None], starts, axis=0)


def added_up(partials: DataFrame, slices: int) -> list[np.ndarray]:
    """Sums of (part, slice, values) by slice, in the order of the parts; one vector a slice reaches the driver."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for b in batches:
            for s, v in zip(b.column("slice").to_pylist(), b.column("vals").to_pylist(), strict=True):
                x = np.frombuffer(v, "<f8")
                if s != key:
                    if held is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["slice", "vals"])
                    key, held = s, x.copy()
                else:
                    held += x
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["slice", "vals"])

    dealt = partials.repartition(slices, "slice").sortWithinPartitions("slice", "part")
    found = {r.slice: np.frombuffer(r.vals, "<f8") for r in dealt.mapInArrow(total, "slice int, vals binary").collect()}
    return [found.get(s) for s in range(slices)]


def _sliced(part: int, values: np.ndarray, slices: int) -> Iterator[pa.RecordBatch]:
    for s, x in enumerate(np.array_split(values, slices)):
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([s], pa.int32()), pa.array([np.ascontiguousarray(x, "<f8").tobytes()], pa.binary())],
                                         ["part", "slice", "vals"])


_PARTIAL = "part int, slice int, vals binary"


@dataclass
class Features:
    """What the train rows say about the words: where a hashed word stands among those that occur, and its IDF weight."""

    place: np.ndarray
    idf: np.ndarray
    n_train: int


def features(blocks: DataFrame, train: str, num_features: int = NUM_FEATURES) -> Features:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(num_features + 1)
        for b in batches:
            for cols, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                df[:-1] += np.bincount(np.frombuffer(cols, "<i4"), minlength=num_features)
                df[-1] += len(ends) // 4
        yield from _sliced(TaskContext.get().partitionId(), df, SLICES)

    parts = added_up(blocks.where(F.col("split") == train).select("cols", "ends").mapInArrow(count, _PARTIAL), SLICES)
    df = np.concatenate([p for p in parts if p is not None]) if parts[0] is not None else np.zeros(num_features + 1)
    n, df = int(df[-1]), df[:-1]
    active = np.flatnonzero(df)
    place = np.full(num_features, len(active), np.int32)
    place[active] = np.arange(len(active))
    return Features(place, np.log((n + 1) / (df[active] + 1)), n)


@dataclass
class Fit:
    """Weights by column (the last row is the intercept), and by column the epochs with their score."""

    weights: np.ndarray
    best: np.ndarray
    epochs: list[tuple[int, int, float]] = field(default_factory=list)
    counts: np.ndarray | None = None


class Learner:
    """L-BFGS for all columns in step; ``targets[c]`` is the place of column c's target, ``regs[c]`` its regularisation."""

    def __init__(self, blocks: DataFrame, known: Features, targets: Sequence[int], regs: Sequence[float], train: str = "train",
                 valid: str = "valid", thresholds: Sequence[float] = (0.5,), tol: float = 1e-4):
        self.blocks, self.known, self.train, self.valid = blocks, known, train, valid
        self.targets, self.regs, self.tol = list(targets), np.array(regs, float), tol
        self.thresholds = list(thresholds)
        self.size, self.columns = len(known.idf) + 1, len(self.targets)
        self.shared = blocks.sparkSession.sparkContext.broadcast((known.place, np.append(known.idf, 0.0)))
        shape = (self.size, self.columns)
        self.w, self.g = np.zeros(shape), np.zeros(shape)
        self.f = np.full(self.columns, np.inf)
        self.step, self.epoch = np.ones(self.columns), np.zeros(self.columns, int)
        self.pairs: list[list] = [[] for _ in range(self.columns)]
        self.done = np.zeros(self.columns, bool)
        self.counts = np.zeros((len(self.thresholds), 4, self.columns))
        self.best, self.best_score = np.zeros(shape), np.full(self.columns, -np.inf)
        self.epochs: list[tuple[int, int, float]] = []

    def folded(self, w: np.ndarray) -> np.ndarray:
        """With a row for unknown words before the intercept."""
        return np.concatenate((w[:-1], np.zeros((1, w.shape[1])), w[-1:]))

    def evaluate(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(losses, gradients, validation counts tp fp fn right by threshold) at a trial point of each column."""
        sc = self.blocks.sparkSession.sparkContext
        u, place = sc.broadcast(self.folded(w)), self.shared
        targets, train, valid, thresholds, columns = self.targets, self.train, self.valid, self.thresholds, self.columns
        limits = [np.log(t / (1 - t)) for t in thresholds]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad = np.zeros(u.value.shape)
            loss, counts = np.zeros(columns), np.zeros((len(limits), 4, columns))
            for b in batches:
                for i in range(b.num_rows):
                    block = Block(b, i, *place.value)
                    m, y = block.margins(u.value), block.y[:, targets]
                    if block.split == train:
                        loss += (np.logaddexp(0, m) - y * m).sum(0)
                        r = 0.5 * (1 + np.tanh(m / 2)) - y
                        block.transposed(r, grad)
                        grad[-1] += r.sum(0)
                    elif block.split == valid:
                        for k, limit in enumerate(limits):
                            p = m >= limit
                            counts[k] += [(p & (y == 1)).sum(0), (p & (y != 1)).sum(0), (~p & (y == 1)).sum(0), (p == (y == 1)).sum(0)]
            yield from _sliced(TaskContext.get().partitionId(), np.concatenate((grad.ravel(), loss, counts.ravel())), SLICES)

        wanted = self.blocks.where(F.col("split").isin(train, valid))
        total = np.concatenate(added_up(wanted.mapInArrow(run, _PARTIAL), SLICES))
        u.unpersist()
        a = (self.size + 1) * columns
        raw, loss, counts = total[:a].reshape(-1, columns), total[a : a + columns], total[a + columns :].reshape(self.counts.shape)
        n = max(1, self.known.n_train)
        grad = np.concatenate((raw[:-2], raw[-1:])) / n
        grad[:-1] += self.regs * w[:-1]
        return loss / n + 0.5 * self.regs * (w[:-1] ** 2).sum(0), grad, counts

    def direction(self, c: int) -> np.ndarray:
        q, back = self.g[:, c].copy(), []
        for s, y, rho in reversed(self.pairs[c]):
            a = rho * s.dot(q)
            q -= a * y
            back.append(a)
        if self.pairs[c]:
            s, y, rho = self.pairs[c][-1]
            q /= rho * y.dot(y)
        for (s, y, rho), a in zip(self.pairs[c], reversed(back), strict=True):
            q += (a - rho * y.dot(q)) * s
        return -q

    def move(self, c: int) -> np.ndarray:
        p = self.direction(c)
        return p if self.pairs[c] else p / (0.5 + self.regs[c])  # rows have length 1 beside the intercept, so this is no longer than 1 / curvature

    def accept(self, c: int, w: np.ndarray, f: float, g: np.ndarray, counts: np.ndarray) -> None:
        """Column c moves to w, which is its next epoch."""
        if np.isfinite(self.f[c]):
            s, y = w - self.w[:, c], g - self.g[:, c]
            if s.dot(y) > 1e-12 * np.sqrt(s.dot(s) * y.dot(y)):
                self.pairs[c] = [*self.pairs[c], (s, y, 1 / s.dot(y))][-MEMORY:]
            self.epoch[c] += 1
            tp, fp, fn, right = counts[0]
            n = tp + fp + fn + max(0.0, right - tp)  # with 0/1 answers micro-F1 is accuracy
            score = right / n if n else 0.0
            self.epochs.append((c, int(self.epoch[c]), float(score)))
            if score > self.best_score[c]:
                self.best_score[c], self.best[:, c] = score, w
        self.w[:, c], self.f[c], self.g[:, c], self.step[c] = w, f, g, 1.0
        self.counts[:, :, c] = counts
        if np.sqrt(g.dot(g)) <= self.tol * max(1.0, np.sqrt(w.dot(w))):
            self.done[c] = True

    def one_pass(self) -> list[tuple]:
        """Evaluate a trial point of each column; (column, accepted, f, w, g, counts) of those that are still running."""
        live = np.flatnonzero(~self.done)
        trial = self.w.copy()
        moves = {}
        for c in live:
            if np.isfinite(self.f[c]):
                moves[c] = self.move(c)
                trial[:, c] += self.step[c] * moves[c]
        f, g, counts = self.evaluate(trial)
        rows = []
        for c in live:
            down = self.g[:, c].dot(moves[c]) if c in moves else 0.0
            ok = c not in moves or f[c] <= self.f[c] + 1e-4 * self.step[c] * down
            rows.append((int(c), bool(ok), float(f[c]), trial[:, c].copy(), g[:, c].copy(), counts[:, :, c].copy()))
        return rows

    def take(self, rows: list[tuple]) -> None:
        for c, ok, f, w, g, counts in rows:
            if ok:
                self.accept(c, w, f, g, counts)
            else:
                # the lowest point of the parabola through both values and the slope, within bounds
                t, down = self.step[c], self.g[:, c].dot(self.move(c))
                bend = f - self.f[c] - down * t
                self.step[c] = t * min(0.5, max(0.01, -down * t / (2 * bend))) if bend > 0 and np.isfinite(bend) else t / 2
                if self.step[c] < 1e-9:  # no further descent in floating point
                    self.done[c] = True

    def fit(self, passes: int = 40, state: str | None = None) -> Fit:
        """At most ``passes`` passes, those that ``state`` holds included."""
        spark = self.blocks.sparkSession
        begun = 0
        if state:
            while begun < passes and (rows := load_pass(spark, state, begun)) is not None:
                self.take(rows)
                begun += 1
        for k in range(begun, passes):
            if self.done.all():
                break
            rows = self.one_pass()
            if state:
                save_pass(spark, state, k, rows)
            self.take(rows)
        never = ~np.isfinite(self.best_score)
        self.best[:, never] = self.w[:, never]
        return Fit(self.w, self.best, sorted(self.epochs), self.counts)


def save_pass(spark: SparkSession, state: str, k: int, rows: list[tuple]) -> None:
    def packed(x: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.save(out, x)
        return out.getvalue()

    cells = [(c, ok, f, *(bytearray(packed(x)) for x in (w, g, counts))) for c, ok, f, w, g, counts in rows]
    table = spark.createDataFrame(cells, "c int, ok boolean, f double, w binary, g binary, counts binary")
    table.coalesce(1).write.mode("overwrite").parquet(f"{state}/pass={k:05d}")


def load_pass(spark: SparkSession, state: str, k: int) -> list[tuple] | None:
    """A saved pass, or None where there is no complete one."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.text(f"{state}/pass={k:05d}/_SUCCESS").count()
        rows = spark.read.parquet(f"{state}/pass={k:05d}").collect()
    except AnalysisException:
        return None
    back = lambda x: np.load(io.BytesIO(bytes(x)))
    return [(r.c, r.ok, r.f, back(r.w), back(r.g), back(r.counts)) for r in sorted(rows, key=lambda r: r.c)]


def probabilities(blocks: DataFrame, learner: Learner, weights: np.ndarray, split: str) -> DataFrame:
    """(id, column, y, prob) of every row of a split."""
    sc = blocks.sparkSession.sparkContext
    u, place, targets = sc.broadcast(learner.folded(weights)), learner.shared, learner.targets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = Block(b, i, *place.value)
                p = 0.5 * (1 + np.tanh(block.margins(u.value) / 2))
                k = len(targets)
                ids = block.ids.values.take(pa.array(np.repeat(np.arange(block.n), k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(k, dtype=np.int32), block.n)),
                                                  pa.array(block.y[:, targets].astype(np.int32).ravel()), pa.array(p.ravel())], ["id", "c", "y", "prob"])

    return blocks.where(F.col("split") == split).mapInArrow(run, "id string, c int, y int, prob double")
