"""Line dedup by a sharded minimal perfect hash over distinct line hashes.

Every document gives the hashes of its distinct line keys (64 bits each); Spark counts documents by hash, with
partial sums in every task, so a line that a third of the documents share is a few rows by then.  Hashes are dealt into shards
by their top bits, and one task for each shard builds a minimal perfect hash over all its distinct hashes (levels of bit arrays: a
key that is alone on its bit in a level gets the bit's rank as its slot, the others go to the next level) with two arrays by slot: an
8-bit fingerprint and the count, cut off at 255 (about 2.5 bytes a line in all).

The index grows with the corpus, so it is never broadcast.  The documents' line hashes go to their shard and probe its arrays in
the stream behind the shard's row: no task holds a shard's probes, and a hot line's probes are spread over ``SALTS`` copies of its
shard.  Every probe is of an indexed line, so the answer is exact.  Hashes to drop come back as one list a document.

Lists don't travel to the texts, nor texts to the lists: every task gets a bitmap of the hashes to drop, of a fixed size.  It lets some
other lines through, which are known, as all lines' hashes are: a document that has one goes by its list in a join, all others are
cut by the bitmap where they are read, or pass as they are if another bitmap says that they have no list.  So few texts are moved while the
bitmap has room; a corpus that fills it has all of its texts joined with their lists.

A row's key is a hash of its doc_id and text, so rows without an id, or with one id, are no hot group.  Rows whose keys agree get one
list; every hash in a list is of a line that many documents have, so the list is right for each of them.

Two keys are taken for one when their 64-bit hashes agree.  Defined cases: NULL or empty text is one empty line; keys of
fewer than ``min_chars`` code points are never dropped; a row counts as a document, so repeated rows count; an empty table
gives an empty result; other columns are kept by ``drop_common_lines`` and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, SPACE_BYTES, bitmap, in_bitmap, maybe_in, mix, probe_columns, stage_table, utf8

MIN_CHARS = 1
MIN_DOCS = 10
SHARD_KEYS = 1 << 18
SALTS = 4
#: Bits of a level for each key that reaches it.
LEVEL_BITS = 2.0
MAX_LEVELS = 40


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE_BYTES).lower()  # bytes.lower() changes A-Z alone


def key_hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


class PerfectHash:
    """A minimal perfect hash of 64-bit keys, with the fingerprint and count arrays behind it."""

    def __init__(self, levels: list[np.ndarray], ranks: list[np.ndarray], marks: np.ndarray, counts: np.ndarray):
        self.levels, self.ranks, self.marks, self.counts = levels, ranks, marks, counts

    @staticmethod
    def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(bits)

    @staticmethod
    def _marks(keys: np.ndarray) -> np.ndarray:
        return (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(56)).astype(np.uint8)

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray) -> PerfectHash:
        """``keys`` are distinct; ``counts`` below 256."""
        levels, left = [], keys
        while len(left):
            if len(levels) == MAX_LEVELS:
                raise ValueError("keys are not distinct")
            bits = max(64, int(LEVEL_BITS * len(left)) + 63 & ~63)
            at = PerfectHash._place(left, len(levels), bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at.astype(np.int64)]]
        out = PerfectHash(levels, [], np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.uint8))
        out._rank()
        slot = out.slots(keys)
        out.marks[slot], out.counts[slot] = PerfectHash._marks(keys), counts
        return out

    def _rank(self) -> None:
        """Set bits before each byte of a level (all levels before it included)."""
        before, self.ranks = 0, []
        for bits in self.levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            run = np.cumsum(ones)
            self.ranks.append(run - ones + before)
            before += int(run[-1]) if len(run) else 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that certainly weren't indexed."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_):
                break
            at = self._place(keys[open_], level, 8 * len(bits)).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            here = bits[byte] >> bit & 1 == 1
            below = np.bitwise_count(bits[byte] & ((np.uint8(1) << bit) - np.uint8(1)))
            out[open_[here]] = (ranks[byte] + below)[here]
            open_ = open_[~here]
        return out

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Counts of the keys; 0 where slot or fingerprint says that a key wasn't indexed."""
        slot = self.slots(keys)
        if not len(self.marks):
            return np.zeros(len(keys), np.uint8)
        fits = (slot >= 0) & (self.marks[slot] == self._marks(keys))
        return np.where(fits, self.counts[slot], 0)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.marks), len(self.levels), *map(len, self.levels)], "<i8")
        return b"".join([head.tobytes(), *(x.tobytes() for x in self.levels), self.marks.tobytes(), self.counts.tobytes()])

    @staticmethod
    def from_bytes(raw: bytes) -> PerfectHash:
        n, n_levels = np.frombuffer(raw, "<i8", 2).tolist()
        sizes = np.frombuffer(raw, "<i8", n_levels, 16)
        at, levels = 16 + 8 * n_levels, []
        for s in sizes.tolist():
            levels.append(np.frombuffer(raw, np.uint8, s, at))
            at += s
        out = PerfectHash(levels, [], np.frombuffer(raw, np.uint8, n, at), np.frombuffer(raw, np.uint8, n, at + n))
        out._rank()
        return out


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def row_key() -> Column:
    """The same for the same doc_id and text, in whichever task a row is read."""
    return F.xxhash64(F.col("doc_id"), _text())


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, h): the hashes of each document's distinct line keys."""
    rows = docs.select(row_key().alias("row"), _text().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, owner = [], []
            for i, t in enumerate(utf8(b.column(1))):
                keys = {line_key(x) for x in t.split(b"\n")}
                own = {key_hash(k) for k in keys if _long_enough(k, min_chars)}
                flat += own
                owner += [i] * len(own)
                if len(flat) > 200_000:
                    yield _pairs(b.column(0), owner, flat)
                    flat, owner = [], []
            yield _pairs(b.column(0), owner, flat)

    return rows.mapInArrow(run, "row bigint, h bigint")


def _pairs(rows: pa.Array, owner: list[int], hashes: list[int]) -> pa.RecordBatch:
    h = np.array(hashes, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([rows.take(pa.array(owner, pa.int64())), pa.array(h)], ["row", "h"])


def build_index(counts: DataFrame, bits: int) -> DataFrame:
    """(shard, arrays) from (h, n): one perfect hash for each shard, the shard being the top ``bits`` of h."""
    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)

    def build(table: pa.Table) -> pa.Table:
        keys = table.column("h").to_numpy().view(np.uint64)
        made = PerfectHash.build(keys, np.minimum(table.column("n").to_numpy(), 255).astype(np.uint8))
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "arrays": [made.to_bytes()]})

    return counts.select(shard.alias("shard"), "h", "n").groupBy("shard").applyInArrow(build, "shard int, arrays binary")


def _shard_bits(n: int, shard_keys: int) -> int:
    return max(0, (max(1, n) // shard_keys).bit_length())


def common_lines(pairs: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, salts: int = SALTS) -> DataFrame:
    """(row, h): of the lines of ``line_hashes``, those to drop."""
    if not 1 <= min_docs <= 255:
        raise ValueError("counts are kept in 8 bits")
    counts = stage_table(pairs.groupBy("h").agg(F.least(F.count(F.lit(1)), F.lit(255)).alias("n")), "counts")
    bits = _shard_bits(counts.count(), shard_keys)
    index = stage_table(build_index(counts, bits), "index")

    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    copies = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "arrays")
    stream = copies.select("shard", "salt", "arrays", F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("h")).unionByName(
        pairs.select(shard.alias("shard"), F.pmod("row", F.lit(salts)).cast("int").alias("salt"),
                     F.lit(None).cast("binary").alias("arrays"), "row", "h"))
    # an index row sorts before the probes of its shard and salt
    dealt = stream.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("arrays").isNull())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: PerfectHash | None = None
        for b in batches:
            new = np.flatnonzero(b.column(2).is_valid().to_numpy(zero_copy_only=False))
            h = b.column(4).fill_null(0).to_numpy().view(np.uint64)
            keep = np.zeros(len(h), bool)
            for a, z in zip([-1, *new.tolist()], [*new.tolist(), len(h)], strict=True):
                if a >= 0:
                    here = PerfectHash.from_bytes(b.column(2)[a].as_py())
                if z > a + 1:
                    keep[a + 1 : z] = here.count(h[a + 1 : z]) >= min_docs
            rows = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column(3).take(rows), b.column(4).take(rows)], ["row", "h"])

    return stage_table(dealt.mapInArrow(probe, "row bigint, h bigint"), "hits")


def _probes(h: Column, bits: int) -> list[Column]:
    """A line's hash is spread evenly, so its two halves say its places in a bitmap."""
    return [F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits))]


def in_lines(words: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether hashes (as long) may be in a bitmap of ``_probes``."""
    return in_bitmap(words, h % bits, (h.view(np.uint64) >> np.uint64(32)).astype(np.int64) % bits)


def unsure_rows(pairs: DataFrame, hits: DataFrame, marks, bits: int) -> DataFrame:
    """Keys of rows with a line that the broadcast bitmap ``marks`` of the lines to drop lets through, though it stays."""
    seen = pairs.where(maybe_in(marks, F.col("h"), bits, _probes(F.col("h"), bits))).select("row", F.lit(1).alias("n"))
    rows = seen.unionByName(hits.select("row", F.lit(-1).alias("n"))).groupBy("row").agg(F.sum("n").alias("n"))
    return rows.where("n > 0").select("row")


_CUT = "struct<text:string,n_lines:bigint,n_dropped:bigint>"


def _struct(kept: list[bytes], lines: list[int], gone: list[int]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())],
                                      ["text", "n_lines", "n_dropped"])


def _cut_by(texts: list[bytes], marks: np.ndarray, bits: int, min_chars: int) -> pa.Array:
    """Texts without the lines that a bitmap has, which holds for texts of which it lets no other line through."""
    lines = [t.split(b"\n") for t in texts]
    drop = iter(in_lines(marks, np.array([key_hash(line_key(x)) for own in lines for x in own], np.uint64).view(np.int64), bits).tolist())
    # short lines aren't known to be let through or not
    left = [[x for x, d in zip(own, drop, strict=False) if not (d and _long_enough(line_key(x), min_chars))] for own in lines]
    return _struct([b"\n".join(x) for x in left], [*map(len, lines)], [len(x) - len(y) for x, y in zip(lines, left, strict=True)])


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, bits: int = 1 << 23,
                      shard_keys: int = SHARD_KEYS, salts: int = SALTS) -> DataFrame:
    """``docs`` with ``__kept_text``, ``__n_lines`` (before) and ``__n_dropped`` appended."""
    context = docs.sparkSession.sparkContext
    pairs = stage_table(line_hashes(docs, min_chars), "lines")
    hits = common_lines(pairs, min_docs, shard_keys, salts)
    drops = stage_table(hits.groupBy("row").agg(F.collect_set("h").alias("drop")), "drops")
    words = context.broadcast(bitmap(drops, F.col("row"), bits))
    marks = context.broadcast(bitmap(drops.select(F.explode("drop").alias("h")), F.col("h"), bits, _probes(F.col("h"), bits)))
    unsure = context.broadcast(bitmap(unsure_rows(pairs, hits, marks, bits), F.col("row"), bits))

    @F.arrow_udf("struct<sure:boolean,cut:" + _CUT + ">")
    def cut_marked(a: pa.Array, b: pa.Array, text: pa.Array) -> pa.Array:
        """Whether a row needs no list, and what is left of it if it has lines to drop."""
        rows = a.to_numpy(), b.to_numpy()
        sure = ~in_bitmap(unsure.value, *rows)
        at = np.flatnonzero(in_bitmap(words.value, *rows) & sure)
        cuts = [_struct([], [], [])]
        for some in np.array_split(at, 1 + text.nbytes // CHUNK_BYTES):
            cuts.append(_cut_by(utf8(text.take(pa.array(some))), marks.value, bits, min_chars))
        place = np.zeros(len(text), np.int64)
        place[at] = np.arange(len(at))
        mask = np.ones(len(text), bool)
        mask[at] = False
        return pa.StructArray.from_arrays([pa.array(sure), pa.concat_arrays(cuts).take(pa.array(place, mask=mask))], ["sure", "cut"])

    @F.arrow_udf(_CUT)
    def cut(text: pa.Array, drop: pa.Array) -> pa.Array:
        kept, n_lines, gone = [], [], []
        for t, d in zip(utf8(text), drop.to_pylist(), strict=True):
            lines = t.split(b"\n")
            if d:
                d = {x & (1 << 64) - 1 for x in d}
                left = [x for x in lines if not (_long_enough(k := line_key(x), min_chars) and key_hash(k) in d)]
            else:
                left = lines
            kept.append(b"\n".join(left))
            n_lines.append(len(lines))
            gone.append(len(lines) - len(left))
        return _struct(kept, n_lines, gone)

    text = _text()
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    keyed = docs.withColumn("__row", row_key())
    same = F.struct(text.alias("text"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    rest = keyed.withColumn("__marked", cut_marked.asNondeterministic()(*probe_columns(F.col("__row"), bits), text)).filter("__marked.sure")
    rest = rest.select(*docs.columns, F.coalesce("__marked.cut", same).alias("__cut"))
    d = drops.select(F.col("row").alias("__drop_row"), F.col("drop").alias("__drop"))
    # the lists grow with the corpus: one plan at every size
    hit = keyed.filter(maybe_in(unsure, F.col("__row"), bits)).join(d.hint("merge"), F.col("__row") == F.col("__drop_row"), "left")
    hit = hit.withColumn("__cut", cut.asNondeterministic()(text, F.col("__drop")))
    out = rest.unionByName(hit.select(*docs.columns, "__cut"))
    return out.select(*docs.columns, F.col("__cut.text").alias("__kept_text"), F.col("__cut.n_lines").alias("__n_lines"),
                      F.col("__cut.n_dropped").alias("__n_dropped"))


def line_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    out = drop_common_lines(docs.select("doc_id", "text"), **how)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
                      F.sha2(F.col("__kept_text").cast("binary"), 256).alias("kept_sha256"))
