"""Small helpers shared by the operators of this subpackage.

Word hashing: a word's hash is ``sum(T[byte] * M[position in word])`` mod 2^64,
finished with the splitmix64 mixer, so a whole batch of texts is hashed with a
handful of numpy passes.  64-bit hashes stand for words, lines and shingles;
two different ones collide with probability 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: White space of the contracts: ``[\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACE.encode()
#: Texts are handled in chunks of about so many bytes inside a task (one text is never cut).
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back (cuts lineage, survives lost executors)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def null_safe(left: DataFrame, right: DataFrame, pairs: Iterable[tuple[str, str]], how: str) -> DataFrame:
    """Equi-join in which NULL matches NULL."""
    cond = None
    for a, b in pairs:
        c = left[a].eqNullSafe(right[b])
        cond = c if cond is None else cond & c
    return left.join(right, cond, how)


def gapless(df: DataFrame, group: str, order: list[Column], spread: Column, slot: str, buckets: int = 256) -> DataFrame:
    """Append ``slot``: 0, 1, 2 ... inside each value of ``group``, with no task holding a whole group.

    ``spread`` is a long that deals the rows of a group over ``buckets`` windows; the rows are counted by
    (group, bucket) and the running offsets of that small table are joined back.
    """
    b = df.withColumn("__b", F.pmod(spread, F.lit(buckets)).cast("int"))
    n = b.groupBy(group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    off = n.select(
        F.col(group).alias("__g"), F.col("__b").alias("__ob"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o")
    )
    j = null_safe(b, off, [(group, "__g"), ("__b", "__ob")], "inner")
    w = Window.partitionBy(group, "__b").orderBy(*order)
    return j.withColumn(slot, F.col("__o") + F.row_number().over(w) - 1).drop("__b", "__g", "__ob", "__o")


# --- a bounded Bloom bitmap of keys, built by Spark ------------------------------------------------


def bitmap(df: DataFrame, key: Column, bits: int = 1 << 23, probes: list[Column] | None = None) -> np.ndarray:
    """Bloom bitmap (two probes) of the values of ``key``: at most ``bits``/8 bytes, whatever the input.

    It may let other rows through, so it only goes before an exact join, to keep most texts out of its shuffle.
    ``probes``: other probe positions than those of ``probe_columns``.
    """
    words = bits // 32
    probes = F.explode(F.array(*(probes or probe_columns(key, bits))))
    rows = (
        df.select(probes.alias("p"))
        .groupBy(F.shiftright("p", 5).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1, cast(pmod(p, 32) AS int))")).alias("m"))
        .collect()  # at most bits/32 rows
    )
    out = np.zeros(words, np.uint32)
    for r in rows:
        out[r.w] = r.m & 0xFFFFFFFF
    return out


def probe_columns(key: Column, bits: int = 1 << 23) -> list[Column]:
    """The two probe positions of ``key``; give them to a task beside the text."""
    return [F.pmod(F.xxhash64(key, F.lit(s)), F.lit(bits)) for s in (1, 2)]


def in_bitmap(words: np.ndarray, *probes: np.ndarray) -> np.ndarray:
    hit = np.ones(len(probes[0]), bool)
    for p in probes:
        p = p.astype(np.int64)
        hit &= (words[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1
    return hit


def maybe_in(words, key: Column, bits: int = 1 << 23, probes: list[Column] | None = None) -> Column:
    """Whether ``key`` may be in a broadcast bitmap (some others are, too)."""

    @F.arrow_udf("boolean")
    def maybe(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(words.value, a.to_numpy(), b.to_numpy()))

    return maybe.asNondeterministic()(*(probes or probe_columns(key, bits)))


# --- hashing in tasks ------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _stream(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_RAW = _stream(256, 1000)
_RAW[_IS_SPACE] = 0
_LOWER = _RAW.copy()
_LOWER[65:91] = _RAW[97:123]
_PLACE = _stream(4096, 5000) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = _stream(n * 2, 5000) | np.uint64(1)
    return _PLACE


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: hashes, positions and the text each belongs to."""

    def __init__(self, texts: list[bytes], lower: bool):
        joined = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(joined, np.uint8)
        self.lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(self.lens + 1)))
        word = ~_IS_SPACE[self.buf]
        edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
        self.word_bytes = word
        self.starts, ends = edge[0::2], edge[1::2]
        self.sizes = ends - self.starts
        if len(self.starts):
            spans = np.diff(self.starts, append=len(self.buf))
            # one entry for each byte: short integers, and no array is kept longer than it is needed
            short = np.int32 if len(self.buf) < 1 << 31 else np.int64
            place = np.arange(self.starts[0], len(self.buf), dtype=short)
            place -= np.repeat(self.starts.astype(short), spans)
            # only word bytes count, so places beyond a word's end are never used: they are set to 0
            place[place >= np.repeat(self.sizes.astype(short), spans)] = 0
            terms = _places(int(self.sizes.max()))[place]
            del place
            with np.errstate(over="ignore"):
                terms *= (_LOWER if lower else _RAW)[self.buf[self.starts[0] :]]
                total = np.add.reduceat(terms, self.starts - self.starts[0])
                self.hashes = mix(total + self.sizes.astype(np.uint64))
        else:
            self.hashes = np.empty(0, np.uint64)
        self.counts = np.diff(np.searchsorted(self.starts, self.offsets))
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have their flag set."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every window of ``n`` words that lies in one text."""
        m = len(self.hashes) - n + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys = _stream(n, 9000) | np.uint64(1)
        with np.errstate(over="ignore"):
            total = self.hashes[:m] * keys[0]
            for i in range(1, n):
                total = total + self.hashes[i : i + m] * keys[i]
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return mix(total[at]), at


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def utf8(column) -> list[bytes]:
    """Texts of an Arrow column as bytes; NULL counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
