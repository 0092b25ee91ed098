"""Quoted CSV in which fields span lines, read by many tasks from one file, with exact record numbers.

A reader that cuts a file into ranges doesn't know whether a range begins inside a quoted field.  Here Spark's text
scan cuts the files (so any store that it reads will do) and tells for each line the range it is from:

1. each range is counted once: its lines, its quotes, and how many records begin in it if it begins outside a field, and if
   it begins inside one.  These are a few numbers for a range, whatever its size;
2. quotes up to a range, odd or even, say which of the two holds; running sums over that small table number the records;
3. the ranges are read again, each knowing where it stands, and cut into records.  A record that a range doesn't end is
   put together from the tail of one range and the heads of the following ones, which alone are shuffled.

Lines are never shuffled while the table of ranges is small enough for Spark to broadcast it (it decides by the size);
beyond that both sides are shuffled by range and sorted back.

Rules of a file (RFC 4180): fields that hold the separator, quotes or newlines are quoted, quotes inside are doubled, and quotes occur
in quoted fields only.  Lines end with ``\\n`` or ``\\r\\n``; ``\\r\\n`` inside a field becomes ``\\n``, as in Spark's own reader; blank
lines between records count for nothing.  Rows with too few fields are filled up with empty ones, surplus fields are dropped.
A file that ends inside a field ends that field.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path) -> DataFrame:
    """Every line with its file, its range and its place in the task's order."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("i"), "value")


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Runs of rows of one range."""
    files, blocks = batch.column(0), batch.column(1).to_numpy()
    edge = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1
    if batch.num_rows > 1:  # ranges of two files may begin at the same place
        other = pc.not_equal(files.slice(1), files.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        edge = np.union1d(edge, np.flatnonzero(other) + 1)
    for a, z in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
        if z > a:
            yield files[a].as_py(), int(blocks[a]), batch.slice(a, z - a)


def _odd(values: pa.Array) -> np.ndarray:
    return pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, quotes, and the records that begin there from outside and from inside a field."""
    held: dict[tuple[str, int], np.ndarray] = {}

    def full() -> pa.RecordBatch:
        keys, numbers = list(held), np.array(list(held.values()), np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in keys], pa.string()), pa.array([b for _, b in keys], pa.int64()),
                                           *map(pa.array, numbers.T)], ["file", "block", "quotes", "outside", "inside"])

    for batch in batches:
        for file, block, part in _segments(batch):
            own = held.get((file, block))
            if own is None:
                if len(held) >= 1024:
                    yield full()
                    held.clear()
                own = held[file, block] = np.zeros(3, np.int64)
            quotes = _odd(part.column(3))
            before = own[0] + np.cumsum(quotes) - quotes
            blank = pc.is_in(part.column(3), pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
            for at, inside in ((1, 0), (2, 1)):
                own[at] += int((((before + inside) % 2 == 0) & ~blank).sum())
            own[0] += int(quotes.sum())
    if held:
        yield full()


def _ranges(lines: DataFrame, header: bool) -> DataFrame:
    """file, block, inside (whether the range begins in a field), first (number of its first own record) and owner (the range whose record it continues)."""
    counts = lines.mapInArrow(_count, "file string, block bigint, quotes bigint, outside bigint, inside bigint")
    # a range is counted by one task, but maybe in two pieces
    each = counts.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.sum("outside").alias("outside"), F.sum("inside").alias("inside"))
    up_to = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = each.select("file", "block", (F.coalesce(F.sum("quotes").over(up_to), F.lit(0)) % 2 == 1).alias("in_field"), "outside", "inside")
    known = known.select("file", "block", "in_field", F.when(F.col("in_field"), F.col("inside")).otherwise(F.col("outside")).alias("n"))
    known = known.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0))).withColumn(
        "owner", F.last(F.when(F.col("n") > 0, F.col("block")), ignorenulls=True).over(up_to))
    head = F.lit(int(header))
    files = known.groupBy("file").agg(F.greatest(F.sum("n") - head, F.lit(0)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each file
    offsets = files.select(F.col("file").alias("f"), earlier.alias("offset"))
    return known.join(offsets, known["file"] == offsets["f"]).select(
        F.col("file").alias("r_file"), F.col("block").alias("r_block"), "in_field", "owner",
        (F.col("offset") + F.col("before") - head).alias("first"), (F.col("before") == 0).alias("begins"))


class _Cutter:
    """Cuts the lines of one range into records; what the range doesn't end is left over as ``tail``."""

    def __init__(self, first: int, in_field: bool):
        self.number, self.odd, self.open = first, in_field, []
        self.is_head = in_field
        self.head: list[str] | None = [] if in_field else None

    def feed(self, values: list[str], quotes: np.ndarray) -> tuple[list[int], list[str]]:
        numbers, records = [], []
        for v, q in zip(values, (quotes % 2 == 1).tolist(), strict=True):
            if self.is_head:
                self.head.append(v)
                if q:
                    self.is_head = False
                continue
            if not self.open and not q:
                if v and v != "\r":
                    numbers.append(self.number)
                    records.append(v)
                    self.number += 1
                continue
            self.open.append(v)
            if q and len(self.open) > 1:
                numbers.append(self.number)
                records.append("\n".join(self.open))
                self.number += 1
                self.open = []
        return numbers, records


def _fields(records: list[str], sep: str) -> list[list[str]]:
    csv.field_size_limit((1 << 31) - 1)
    clean = [(r[:-1] if r.endswith("\r") else r).replace("\r\n", "\n") for r in records]
    if any("\r" in r for r in clean):  # the parser takes a lone \r for the end of a line
        mark = next(c for c in map(chr, range(0xE000, 0xF8FF)) if not any(c in r for r in clean))
        return [[x.replace(mark, "\r") for x in row] for row in csv.reader((r.replace("\r", mark) for r in clean), delimiter=sep)]
    return list(csv.reader(clean, delimiter=sep))


def _cut(batches: Iterator[pa.RecordBatch], fragments: bool, sep: str) -> Iterator[pa.RecordBatch]:
    """Whole records (line_no, lead, fields), or the ``fragments`` of the others (file, owner, block, line_no, lead, text); a file's first record leads."""
    key, cutter, owner, first = None, None, None, None

    def left() -> Iterator[pa.RecordBatch]:
        rows = []
        if fragments and cutter is not None:
            if cutter.head is not None:
                rows.append((key[0], owner, key[1], None, None, "\n".join(cutter.head)))
            if cutter.open:
                rows.append((key[0], key[1], key[1], cutter.number, cutter.number == first, "\n".join(cutter.open)))
        if rows:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             ["file", "owner", "block", "line_no", "lead", "text"])

    for batch in batches:
        for file, block, part in _segments(batch):
            if (file, block) != key:
                yield from left()
                key = (file, block)
                owner, number = part.column("owner")[0].as_py(), part.column("first")[0].as_py()
                first = number if part.column("begins")[0].as_py() else None
                cutter = _Cutter(number, part.column("in_field")[0].as_py())
            numbers, records = cutter.feed(part.column(3).to_pylist(), _odd(part.column(3)))
            if records and not fragments:
                if block == 0 and records[0].startswith("\ufeff"):
                    records[0] = records[0][1:]
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([n == first for n in numbers]),
                                                  pa.array(_fields(records, sep), pa.list_(pa.string()))], ["line_no", "lead", "fields"])
    yield from left()


def read_records(spark: SparkSession, path, header: bool = True, sep: str = ",") -> DataFrame:
    """(line_no, fields) of every record: its number over all files in the order of their names, from 0, and its fields.

    With ``header`` the first record of each file isn't one.
    """
    lines = _lines(spark, path)
    ranges = _ranges(lines, header)
    placed = lines.join(ranges, (lines["file"] == ranges["r_file"]) & (lines["block"] == ranges["r_block"])).select(
        "file", "block", "i", "value", "in_field", "owner", "first", "begins").sortWithinPartitions("file", "block", "i")
    whole = placed.mapInArrow(lambda it: _cut(it, False, sep), "line_no bigint, lead boolean, fields array<string>")
    pieces = placed.mapInArrow(lambda it: _cut(it, True, sep),
                               "file string, owner bigint, block bigint, line_no bigint, lead boolean, text string")
    # the tail of a range and the heads behind it: one record, which is one output row
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n")
    joined = pieces.groupBy("file", "owner").agg(F.max("line_no").alias("line_no"), F.max("lead").alias("lead"), text.alias("text"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = [_fields([t], sep)[0] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fields, pa.list_(pa.string()))], ["line_no", "lead", "fields"])

    broken = joined.select("line_no", "lead", "text").mapInArrow(parse, "line_no bigint, lead boolean, fields array<string>")
    both = whole.unionByName(broken)
    return (both.where(~F.col("lead")) if header else both).select("line_no", "fields")


def read_split_csv(spark: SparkSession, path, columns: Sequence[str], header: bool = True, sep: str = ",",
                   number: str | None = None) -> DataFrame:
    """The records as string columns, missing fields empty; ``number`` names a column for the record's number."""
    fields = [F.coalesce(F.get("fields", F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(columns)]
    return read_records(spark, path, header, sep).select(*([F.col("line_no").alias(number)] if number else []), *fields)


def number_lines(spark: SparkSession, path) -> DataFrame:
    """(line_no, value) of plain text lines, numbered over all files in the order of their names, from 0."""
    lines = _lines(spark, path)
    n = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("least"))
    files = n.groupBy("file").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each file
    up_to = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = files.select(F.col("file").alias("f"), before.alias("before"))
    placed = n.withColumn("up_to", up_to).join(offset, F.col("file") == F.col("f")).select(
        F.col("file").alias("r_file"), F.col("block").alias("r_block"), (F.col("before") + F.col("up_to") - F.col("least")).alias("shift"))
    # the lines of a range are read by one task in a row, so their running numbers have no gaps
    return lines.join(placed, (lines["file"] == placed["r_file"]) & (lines["block"] == placed["r_block"])).select(
        (F.col("i") + F.col("shift")).alias("line_no"), "value")
