"""Token ids in files of range-coded blocks (static rANS with shared frequency tables).

Format, two Parquet tables in one folder, so that any store that Spark writes to will do:

* ``sections``: (part, section, first, n_ids, freq, blocks, doc_ids, lengths).  A section holds the ids of whole documents, about
  ``SECTION_IDS`` of them, in ascending doc_id order by (part, section, place).  ``freq`` is the frequency table that its
  blocks share: the ids that occur, with frequencies that sum to 2^20.  ``blocks`` cut the section's ids every ``BLOCK_IDS``: id k of
  a block is in lane k mod ``lanes``; the lanes share one stream of 32-bit words, and ``states`` holds each lane's 64-bit
  state, the checkpoint from which the block is decoded without any other.  ``crc32`` is held against the
  decoded ids.  ``first`` is the place of the section's first id in its part;
* ``parts``: (part, start, n_ids): the ids before each part, one row for each task that wrote.

The texts are range-partitioned by doc_id once and tokenized once: a task holds the ids of one section (4 bytes each),
counts them, and encodes them with their own table.  Nothing but the table of parts passes through one task, and
sections are decoded wherever Spark reads them.

Defined cases: NULL text counts as empty and has the end id alone; NULL doc_id comes first; rows equal in doc_id
are ordered by their text's hash; an empty table gives files without sections; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import chunks, utf8
from .pieces import CACHE_CHARS, CACHE_ENTRIES, SHORT, WHITE, Recent, RunTable, cuts, ranges, run_words

SCALE = 20
LOW = np.uint64(1 << 31)
SECTION_IDS = 1 << 21
BLOCK_IDS = 1 << 18
LANES = 1024
END_ID = 0

_U = np.uint64
_SECTION = ("part int, section int, first bigint, n_ids bigint, freq binary, blocks array<struct<lanes:int,n_ids:bigint,"
            "states:binary,words:binary,crc32:bigint>>, doc_ids array<{id}>, lengths array<bigint>")
#: Runs that go through the library in one string, or in one call.
JOINED = 2000
#: Runs that are looked up at a time.
FOUND_RUNS = 1 << 16


class Encoder:
    """Ids of texts by a byte-level tokenizer file; runs are looked up, new ones go through the library.

    The texts of a chunk stay one buffer, whose runs are looked up and whose ids are put in order by numpy; only new and long runs become
    Python objects.

    Tokens never cross from one run into the next, so new runs are put into one string, which saves the library's cost for
    each call, and the bytes that the tokens stand for tell where a run's tokens end; if one doesn't end with its run, the runs go one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)  # a letter of such a token is a byte
        # white space first, none last, and no beginning of an added token
        begins = "".join(re.escape(t.content[0]) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.joins = re.compile(f"[{WHITE}][^{begins}]*[^{WHITE}{begins}]").fullmatch
        self.table, self.recent = RunTable(8 * CACHE_ENTRIES), Recent()

    def _each(self, runs: list[str]) -> list[list[int]]:
        calls = (self.tokenizer.encode_batch_fast(runs[i : i + JOINED], add_special_tokens=False) for i in range(0, len(runs), JOINED))
        return [e.ids for call in calls for e in call]

    def _solve(self, runs: list[str]) -> list[bytes]:
        """Ids of each run, 4 bytes each."""
        out: list[bytes] = [b""] * len(runs)
        alone = [k for k, r in enumerate(runs) if self.joins(r) is None]
        for k, ids in zip(alone, self._each([runs[k] for k in alone]), strict=True):
            out[k] = np.array(ids, "<u4").tobytes()
        single = set(alone)
        rest = [k for k in range(len(runs)) if k not in single]
        groups = [rest[i : i + JOINED] for i in range(0, len(rest), JOINED)]
        for g in groups:
            ids = np.array(self._each(["".join([runs[k] for k in g])])[0], "<u4")
            ends = np.cumsum([len(runs[k].encode()) for k in g])
            at_byte = np.cumsum(self.width[ids])
            cut = np.searchsorted(at_byte, ends) + 1
            if cut[-1] != len(ids) or (at_byte[cut - 1] != ends).any():  # a token crosses from one run into the next
                for k, own in zip(g, self._each([runs[k] for k in g]), strict=True):
                    out[k] = np.array(own, "<u4").tobytes()
                continue
            raw, at = ids.tobytes(), 0
            for k, end in zip(g, (4 * cut).tolist(), strict=True):
                out[k] = raw[at:end]
                at = end
        return out

    def _look_up(self, runs: list[bytes]) -> list[bytes]:
        """Ids of runs that are not in the table, 4 bytes each; the runs differ."""
        self.recent.turn()
        found = [self.recent.get(r) if len(r) > SHORT else None for r in runs]
        fresh = [k for k, ids in enumerate(found) if ids is None]
        texts = [runs[k].decode() for k in fresh]
        for k, text, ids in zip(fresh, texts, self._solve(texts), strict=True):
            found[k] = ids
            if len(runs[k]) > SHORT and len(text) <= CACHE_CHARS:
                self.recent.new[runs[k]] = ids
        return found

    def _ids(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the runs that begin at ``at`` (its last item is the end), one after another, and how many each run has."""
        self.table.turn()
        starts, sizes = at[:-1] - at[0], np.diff(at)
        buf = buf[at[0] : at[-1]]
        words = run_words(buf, starts, sizes)
        entry = self.table.find(words)
        new = np.flatnonzero((entry < 0) | (sizes > SHORT))
        first, count = self.table.at[entry], self.table.count[entry]
        if len(new):
            raw, seen = buf.tobytes(), {}
            which = np.array([seen.setdefault(raw[a:z], len(seen)) for a, z in zip(starts[new].tolist(), (starts + sizes)[new].tolist())])
            found = self._look_up(list(seen))
            own_count = np.fromiter(map(len, found), np.int64, len(found)) >> 2
            own_first = self.table.append(np.frombuffer(b"".join(found), "<u4")) + np.cumsum(own_count) - own_count
            first[new], count[new] = own_first[which], own_count[which]
            some = np.unique(which, return_index=True)[1]
            some = some[sizes[new[some]] <= SHORT]
            self.table.add(words[new[some]], own_first[which[some]], own_count[which[some]])
        return ranges(self.table.ids, first, count), count

    def encode(self, texts: list[str] | list[bytes]) -> list[np.ndarray]:
        """Ids of each text (as a string or in UTF-8) and the end id."""
        raw = [t.encode() if isinstance(t, str) else t for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        buf = np.frombuffer(b"".join(raw), np.uint8)
        at = cuts(buf, offsets)
        parts = [self._ids(buf, at[i : i + FOUND_RUNS + 1]) for i in range(0, len(at) - 1, FOUND_RUNS)]
        before = np.concatenate(([0], np.cumsum(np.concatenate([np.empty(0, np.int64), *(n for _, n in parts)]))))
        ends = before[np.searchsorted(at, offsets[1:])]
        ids = np.insert(np.concatenate([np.empty(0, "<u4"), *(x for x, _ in parts)]), ends, END_ID)
        ends += np.arange(1, len(ends) + 1)
        return [ids[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Encoder(path)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^SCALE, in proportion to the counts; at least 1 for each id that occurs, else 0."""
    some = np.flatnonzero(counts)
    if len(some) > 1 << SCALE:
        raise ValueError("more ids than slots")
    room = (1 << SCALE) - len(some)
    c = counts[some].astype(np.int64)
    out = np.zeros(len(counts), np.int64)
    out[some] = 1 + (c.astype(np.float64) * (room / c.sum())).astype(np.int64)
    out[some[c.argmax()]] += (1 << SCALE) - out.sum()
    return out


def pack_table(freq: np.ndarray) -> bytes:
    """The ids that occur (as steps) and their frequencies."""
    some = np.flatnonzero(freq)
    steps = np.diff(some, prepend=0).astype("<u4")
    return zlib.compress(steps.tobytes() + freq[some].astype("<u4").tobytes(), 1)


def unpack_table(raw: bytes) -> np.ndarray:
    steps, freq = np.split(np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64), 2)
    out = np.zeros(int(steps.sum()) + 1, np.int64)
    out[np.cumsum(steps)] = freq
    return out


class Rans:
    """Coder for one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    def encode(self, ids: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """(states of the lanes, words in the order in which they are read)."""
        x, out = np.full(lanes, LOW, np.uint64), []
        shift, half = _U(SCALE), _U(32)
        for t in range((len(ids) - 1) // lanes, -1, -1):
            s = ids[t * lanes : (t + 1) * lanes]
            f, c, y = self.freq[s], self.cum[s], x[: len(s)]
            full = y >= f << _U(63 - SCALE)
            if full.any():
                out.append((y[full] & _U(0xFFFFFFFF)).astype(np.uint32))
                y = np.where(full, y >> half, y)
            q = y // f
            x[: len(s)] = (q << shift) + (y - q * f) + c
        out.reverse()
        return x, np.concatenate(out) if out else np.empty(0, np.uint32)

    def decode(self, states: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        lanes, x, at = len(states), states.copy(), 0
        out = np.empty(n, np.uint32)
        shift, low, half = _U(SCALE), _U((1 << SCALE) - 1), _U(32)
        for t in range(0, n, lanes):
            y = x[: min(lanes, n - t)]
            slot = y & low
            s = self.slots[slot]
            out[t : t + len(y)] = s
            y = self.freq[s] * (y >> shift) + slot - self.cum[s]
            thin = np.flatnonzero(y < LOW)
            if len(thin):
                y[thin] = y[thin] << half | words[at : at + len(thin)].astype(np.uint64)
                at += len(thin)
            x[: len(y)] = y
        return out


def write_ids(docs: DataFrame, path: str, folder: str, section_ids: int = SECTION_IDS, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` by the tokenizer file ``path`` into ``folder``."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = _encoder(path), TaskContext.get().partitionId()
        held: list[tuple[object, np.ndarray]] = []
        section = first = size = 0
        schema = None

        def full() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            freq = scaled(np.bincount(ids))
            rans, blocks = Rans(freq), []
            for a in range(0, len(ids), block_ids):
                own = ids[a : a + block_ids]
                states, words = rans.encode(own, max(1, min(LANES, len(own) // 128)))
                blocks.append({"lanes": len(states), "n_ids": len(own), "states": states.astype("<u8").tobytes(),
                               "words": words.astype("<u4").tobytes(), "crc32": zlib.crc32(own.astype("<u4").tobytes())})
            row = {"part": part, "section": section, "first": first, "n_ids": len(ids), "freq": pack_table(freq), "blocks": blocks,
                   "doc_ids": [d for d, _ in held], "lengths": [len(x) for _, x in held]}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for b in batches:
            block = pa.struct([("lanes", pa.int32()), ("n_ids", pa.int64()), ("states", pa.binary()), ("words", pa.binary()),
                               ("crc32", pa.int64())])
            schema = pa.schema([("part", pa.int32()), ("section", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                                ("freq", pa.binary()), ("blocks", pa.list_(block)), ("doc_ids", pa.list_(b.column(0).type)),
                                ("lengths", pa.list_(pa.int64()))])
            names, texts = b.column(0).to_pylist(), utf8(b.column(1))
            for a, z in chunks(texts):
                for pair in zip(names[a:z], enc.encode(texts[a:z]), strict=True):
                    held.append(pair)
                    size += len(pair[1])
                    if size >= section_ids:
                        yield full()
                        section, first, size, held = section + 1, first + size, 0, []
        if held:
            yield full()

    kind = rows.schema["doc_id"].dataType.simpleString()
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, _SECTION.format(id=kind)).write.option("compression", "none").parquet(f"{folder}/sections")
    parts = spark.read.parquet(f"{folder}/sections").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # one row for each task that wrote
    parts.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("start"), "n_ids").coalesce(1).write.parquet(f"{folder}/parts")


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids, from the files alone; a wrong checksum fails the read."""
    sections = spark.read.parquet(f"{folder}/sections")
    kind = sections.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in ("part", "section", "first", "freq", "blocks", "lengths")}
                rans, found = Rans(unpack_table(row["freq"])), []
                for k, x in enumerate(row["blocks"]):
                    ids = rans.decode(np.frombuffer(x["states"], "<u8"), np.frombuffer(x["words"], "<u4"), x["n_ids"])
                    if zlib.crc32(ids.astype("<u4").tobytes()) != x["crc32"]:
                        raise ValueError(f"part {row['part']}, section {row['section']}, block {k}: checksum differs")
                    found.append(ids)
                ids = np.concatenate(found).astype("<u4")
                raw = memoryview(ids).cast("B")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                cols = [pa.array([row["part"]] * len(ends), pa.int32()), b.column("doc_ids")[i].values,
                        pa.array(starts + row["first"], pa.int64()), pa.array(row["lengths"], pa.int64()),
                        pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["part", "doc_id", "place", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = f"part int, doc_id {kind}, place bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    parts = spark.read.parquet(f"{folder}/parts").select(F.col("part").alias("p"), "start")
    docs = sections.mapInArrow(run, schema)
    return docs.join(parts, docs["part"] == parts["p"]).select(
        "doc_id", (F.col("start") + F.col("place")).alias("start"), *names[3:])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write the ids of ``docs`` to a new folder in the shared scratch folder and read them back."""
    folder = scratch_path(docs.sparkSession, "ids")
    write_ids(docs, path, folder)
    return read_ids(docs.sparkSession, folder, with_ids=False)
