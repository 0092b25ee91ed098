"""Quoted CSV read by ranges: equal to Python's csv module at any range size, numbered exactly; alignment by position."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from dialoglab.operators import joins as J
from dialoglab.sources import csv_split
from dialoglab.sources import readers as S

CELLS = ["", "a", "plain text", "two\nlines", 'a "quoted" word', '"', '""', "\n", "\n\n\n", "x,y", "é漢🙂", "long " * 30, "tail\n", "\r\nwin", " pad ", "a\rb", "0",
         "\"\n\"", "many\n" * 40]


def rows(seed, n, width=3):
    rng = random.Random(seed)
    return [[rng.choice(CELLS) for _ in range(width - 1)] + [f"r{i}"] for i in range(n)]


def write(path, table, end="\n", last=True):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(table)
    text = out.getvalue()
    path.write_bytes((text if last else text.removesuffix(end)).encode())
    return str(path)


@pytest.fixture
def ranges(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def got(df):
    return [r.fields for r in sorted(df.collect(), key=lambda r: r.line_no)]


def plain(table):
    return [[c.replace("\r\n", "\n") for c in r] for r in table]


@pytest.mark.parametrize("size", ["17b", "101b", "1k", "128m"])
@pytest.mark.parametrize("end,last", [("\n", True), ("\r\n", True), ("\n", False), ("\r\n", False)])
def test_any_range_size(spark, tmp_path, ranges, size, end, last):
    table = rows(len(size), 60)
    path = write(tmp_path / "a.csv", [["x", "y", "z"], *table], end, last)
    ranges(size)
    out = csv_split.read_records(spark, path)
    found = out.collect()
    assert sorted(r.line_no for r in found) == list(range(60))
    assert [r.fields for r in sorted(found, key=lambda r: r.line_no)] == plain(table)


def test_a_field_over_many_ranges(spark, tmp_path, ranges):
    """One field covers whole ranges; the next record begins and ends behind it; the last is never closed."""
    table = [["1", "line\n" * 500, "a"], ["2", "b", "c"], ["3", "x\n" * 300, "d"]]
    path = write(tmp_path / "a.csv", table)
    with open(path, "a") as f:
        f.write('4,"open\nto the end')
    ranges("64b")
    assert got(csv_split.read_records(spark, path, header=False)) == [*table, ["4", "open\nto the end"]]


@pytest.mark.parametrize("size", ["40b", "128m"])
def test_many_files(spark, tmp_path, ranges, size):
    """Numbers go on from file to file; each has a header, one has nothing else, one is empty, blank lines count for nothing."""
    parts = [rows(1, 9), [], rows(2, 14)]
    for k, part in enumerate(parts):
        write(tmp_path / f"part-{k}.csv", [["head\nline", "y", "z"], *part])
    (tmp_path / "part-3.csv").write_bytes(b"")
    (tmp_path / "part-4.csv").write_bytes(b'\xef\xbb\xbf"x",y,z\r\n\r\n\r\n1,2,3\n\n4\n5,6,7,8\n')
    ranges(size)
    want = plain(parts[0]) + plain(parts[2]) + [["1", "2", "3"], ["4"], ["5", "6", "7", "8"]]
    assert got(csv_split.read_records(spark, str(tmp_path))) == want
    short = csv_split.read_split_csv(spark, str(tmp_path), ["a", "b", "c"], number="n").where("n >= 24").orderBy("n").collect()
    assert [tuple(r) for r in short] == [(24, "4", "", ""), (25, "5", "6", "7")]


@pytest.mark.parametrize("size", ["90b", "128m"])
def test_readers_by_ranges_equal_one_task(spark, tmp_path, ranges, size):
    table = [[c.replace("\r", "") for c in r] for r in rows(9, 50, 5)]
    path = write(tmp_path / "a.csv", [S.LABELLED_COLUMNS, *table])
    ranges(size)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(S.read_labelled_csv(spark, path, multi_line="split")) == key(S.read_labelled_csv(spark, path))
    assert key(S.read_text_column_csv(spark, path, 1, True, "split")) == key(S.read_text_column_csv(spark, path, 1, True))
    numbered = S.read_text_column_csv(spark, path, 1, True, "split", ids="line").collect()
    assert {int(r.id): r.dialogue for r in numbered} == {i: r[1].strip(" \t\n\r\f\x0b") for i, r in enumerate(table)}
    with pytest.raises(ValueError):
        S.read_text_column_csv(spark, path, 1, True, ids="line")
    with pytest.raises(ValueError):
        S.read_labelled_csv(spark, path, number="n")


@pytest.mark.parametrize("size", ["30b", "128m"])
def test_equal_threads_have_ids_of_their_own(spark, tmp_path, ranges, size):
    line = '{"reddit_thread": [{"text": "title\\nbody"}, {"text": "same"}]}\n'
    (tmp_path / "a.jsonl").write_text(line * 3 + "\n" + line)
    (tmp_path / "b.jsonl").write_text(line)
    ranges(size)
    out = S.read_thread_jsonl(spark, str(tmp_path), ids="line").collect()
    assert sorted(int(r.id) for r in out) == [0, 1, 2, 4, 5] and len({r.dialogue for r in out}) == 1
    assert len({r.id for r in S.read_thread_jsonl(spark, str(tmp_path)).collect()}) == 1


def test_repeated_ids_are_reported(spark):
    gold = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 1), (None, 0)], "id string, y int")
    preds = spark.createDataFrame([("a", 1), ("b", 0)], "id string, p int")
    assert [tuple(r) for r in J.repeated_ids(gold).collect()] == [("a", 2)]
    assert J.join_predictions(gold, preds).count() == 3
    with pytest.raises(Exception, match="share a value of id"):
        J.join_predictions(gold, preds, unique=True).count()
    assert J.join_predictions(gold.where("y = 1"), preds, unique=True).count() == 2


def test_alignment_by_position(spark, tmp_path, ranges):
    left, right = rows(3, 40), rows(4, 37)
    a, b = write(tmp_path / "a.csv", [["x", "y", "z"], *left]), write(tmp_path / "b.csv", [["u", "v", "w"], *right])
    ranges("50b")
    one = csv_split.read_split_csv(spark, a, ["x", "y", "z"], number="line_no")
    two = csv_split.read_split_csv(spark, b, ["u", "v", "w"], number="line_no")
    out = J.align_by_position(one, two).orderBy("line_no").collect()
    assert [list(r)[1:] for r in out] == [x + y for x, y in zip(plain(left), plain(right), strict=False)]
    with pytest.raises(ValueError):
        J.align_by_position(one, one)


def test_lines_are_not_shuffled(spark, tmp_path):
    """Ranges are counted and joined back; only what crosses them is grouped."""
    path = write(tmp_path / "a.csv", [["x", "y", "z"], *rows(3, 40)])
    df = csv_split.read_records(spark, path)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("Initial Plan")[0]
    assert df.agg(F.count(F.lit(1))).first()[0] == 40
