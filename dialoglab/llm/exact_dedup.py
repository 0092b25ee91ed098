"""Exact dedup with a cuckoo-filter index of live digests.

Two texts are equal when they are identical after deleting white space (``[\\x20\\x09-\\x0D]``); of equal texts the
row with the most code points, then the smallest doc_id, stays.

1. Spark computes each text's SHA-256 (32 bytes) and length; no text moves after that.
2. ``LiveIndex`` in every input task: a cuckoo filter of 16-bit fingerprints over the live digests.  A hit is verified
   against the full digests stored in the two buckets; a true hit merges into the stored entry, a false one is inserted.
   An index that holds ``max_live`` digests passes its oldest half on and *deletes* them from the filter, so memory is
   bounded.  Copies meet here first: a group with a third of all rows leaves a task as a few entries.
3. The entries are dealt by digest into shares of about ``MAX_LIVE`` at most; the same index merges each.  A filter
   that overflows is rebuilt at twice the size from the stored digests.
4. Every row joins its digest's verdict (16-byte group, AQE splits a hot one; nothing is collected).

Defined cases: NULL text counts as empty, all empty texts are one group; NULL doc_id ranks after every other; rows
equal in doc_id too are copies, ``exact_dedup`` marks them all kept if their doc_id stays, ``drop_copies`` keeps just one
row; an empty table gives an empty result; other columns are kept by ``drop_copies`` and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, in_bitmap, maybe_in, probe_columns, stage_table

#: Digests that a task's index holds at most.
MAX_LIVE = 200_000
SLOTS = 4
MAX_KICKS = 64


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four, each beside its full digest (the key a hit is verified against)."""

    def __init__(self, buckets: int = 1024):
        self.resize(buckets)

    def resize(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table: list[list[tuple[int, bytes]]] = [[] for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little")
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995 + 1)) & self.mask

    def hit(self, digest: bytes) -> bool:
        """What the fingerprints say; may be a false positive."""
        mark, a, b = self._places(digest)
        return any(m == mark for m, _ in self.table[a]) or any(m == mark for m, _ in self.table[b])

    def verified(self, digest: bytes) -> bool:
        """A hit, held against the stored digests of its two buckets."""
        mark, a, b = self._places(digest)
        for place in (a, b):
            for m, key in self.table[place]:
                if m == mark and key == digest:
                    return True
        return False

    def insert(self, digest: bytes) -> None:
        waiting = [digest]
        while waiting:
            if (left := self._put(waiting.pop())) is not None:  # overflow: rebuild from the stored digests
                waiting += [left, *(key for bucket in self.table for _, key in bucket)]
                self.resize(2 * (self.mask + 1))

    def _put(self, digest: bytes) -> bytes | None:
        """None, or the digest that found no place."""
        mark, a, b = self._places(digest)
        for place in (a, b):
            if len(self.table[place]) < SLOTS:
                self.table[place].append((mark, digest))
                return None
        place, entry = a, (mark, digest)
        for kick in range(MAX_KICKS):
            bucket = self.table[place]
            bucket.append(entry)
            entry = bucket.pop(kick % SLOTS)
            place = self._other(place, entry[0])
            if len(self.table[place]) < SLOTS:
                self.table[place].append(entry)
                return None
        return entry[1]

    def delete(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for place in (a, b):
            if (mark, digest) in self.table[place]:
                self.table[place].remove((mark, digest))
                return True
        return False


class LiveIndex:
    """digest -> [length of the best row, its doc_id, rows], found through the cuckoo filter."""

    def __init__(self):
        self.filter, self.live = CuckooFilter(), {}

    def add(self, digest: bytes, length: int, doc_id, n: int) -> None:
        if self.filter.hit(digest) and self.filter.verified(digest):
            best = self.live[digest]
            # the longer row; of equal length the smaller id, NULL last
            if length > best[0] or length == best[0] and doc_id is not None and (best[1] is None or doc_id < best[1]):
                best[0], best[1] = length, doc_id
            best[2] += n
        else:
            self.filter.insert(digest)
            self.live[digest] = [length, doc_id, n]

    def remove(self, digest: bytes) -> list[int] | None:
        """Take a digest out of the index (it is no longer live)."""
        if not (self.filter.hit(digest) and self.filter.delete(digest)):
            return None
        return self.live.pop(digest)

    def __len__(self) -> int:
        return len(self.live)


_ENTRY = "digest binary, length bigint, best_id {id}, n bigint"


def _batch(entries: list[tuple[bytes, list]], schema: pa.Schema) -> pa.RecordBatch:
    cols = [[k for k, _ in entries], *([v[i] for _, v in entries] for i in range(3))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema.names)


def merge_entries(batches: Iterator[pa.RecordBatch], max_live: int | None) -> Iterator[pa.RecordBatch]:
    """Entries of a task, merged through its index; with ``max_live`` the oldest half leaves a full index."""
    index, schema = LiveIndex(), None
    for b in batches:
        schema = b.schema
        for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            index.add(*row)
            if max_live and len(index) >= max_live:
                oldest = list(index.live)[: max_live // 2]
                yield _batch([(k, index.remove(k)) for k in oldest], schema)
    keys = list(index.live)
    for i in range(0, len(keys), 10_000):
        yield _batch([(k, index.live[k]) for k in keys[i : i + 10_000]], schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, SHA-256 of the normalised text, code points of the original text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.regexp_replace(text, r"[ \t-\r]+", "")
    return docs.select(F.col("doc_id").alias("doc_id"), F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"),
                       F.char_length(text).cast("long").alias("length"))


def verdicts(keyed: DataFrame, max_live: int = MAX_LIVE) -> DataFrame:
    """One row per digest: the doc_id that stays (NULL if no row has one), its length and the number of rows."""
    rows = keyed.select("digest", "length", F.col("doc_id").alias("best_id"), F.lit(1).cast("long").alias("n"))
    entry = _ENTRY.format(id=rows.schema["best_id"].dataType.simpleString())
    local = rows.mapInArrow(lambda it: merge_entries(it, max_live), entry)
    # so many shares that a task's index holds about MAX_LIVE digests at most, whatever the input
    shares = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), keyed.count() // MAX_LIVE + 1)
    return local.repartition(shares, "digest").mapInArrow(lambda it: merge_entries(it, None), entry)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: keep_id, group_size, kept, text_sha256."""
    keyed = stage_table(digests(docs), "digests")
    v = stage_table(verdicts(keyed), "verdicts").select(
        F.col("digest").alias("v_digest"), F.col("best_id").alias("keep_id"), F.col("length").alias("keep_length"), F.col("n").alias("group_size"))
    j = keyed.join(v, keyed["digest"] == v["v_digest"])
    # a shorter row with the keeper's id isn't the keeper
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length"))
    return j.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """``docs`` without the copies: one whole row of each group of equal texts stays.

    Digests are compared first, without texts.  Rows whose digest occurs once pass by a bitmap of the digests that occur more often,
    and of the others only rows that a second bitmap takes for the keeper of their group go on, so copies leave
    where they are read.  Bitmaps only ever let too many through: a join with the keepers decides.
    """
    keyed = stage_table(digests(docs), "digests")
    many = stage_table(verdicts(keyed).filter("n > 1"), "verdicts")
    spark = docs.sparkSession
    often = spark.sparkContext.broadcast(bitmap(many, F.col("digest"), bits))
    # rows that only seem to belong to a group are keepers, too
    alone = keyed.filter(maybe_in(often, F.col("digest"), bits)).join(many.select("digest"), "digest", "left_anti")
    keepers = stage_table(many.select("digest", F.col("best_id").alias("id"), "length").unionByName(
        alone.select("digest", F.col("doc_id").alias("id"), "length")), "keepers")
    chosen = spark.sparkContext.broadcast(bitmap(keepers, F.xxhash64("digest", "id", "length"), bits))

    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(F.regexp_replace(text, r"[ \t-\r]+", "").cast("binary"), 256))
    marked = docs.withColumn("__digest", digest).withColumn("__length", F.char_length(text).cast("long"))

    @F.arrow_udf("struct<often:boolean,chosen:boolean>")
    def seems(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        hits = [pa.array(in_bitmap(w.value, x.to_numpy(), y.to_numpy())) for w, x, y in ((often, a, b), (chosen, c, d))]
        return pa.StructArray.from_arrays(hits, ["often", "chosen"])

    # both bitmaps in one call: two would take a Python worker each for every task
    probes = [*probe_columns(F.col("__digest"), bits), *probe_columns(F.xxhash64("__digest", "doc_id", "__length"), bits)]
    marked = marked.withColumn("__seems", seems.asNondeterministic()(*probes))
    single = marked.filter("NOT __seems.often").select(*docs.columns)
    v = keepers.select(F.col("digest").alias("__v"), F.col("id").alias("__id"), F.col("length").alias("__best"))
    rest = marked.filter("__seems.often AND __seems.chosen")
    best = rest.join(v, (rest["__digest"] == v["__v"]) & rest["doc_id"].eqNullSafe(v["__id"]) & (rest["__length"] == v["__best"]), "left_semi")
    # rows equal in doc_id and length too: one of them
    return single.unionByName(best.dropDuplicates(["__digest"]).select(*docs.columns))
