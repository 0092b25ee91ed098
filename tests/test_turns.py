"""Dialogues from a stream of turns equal those of the batch read, whatever the order of arrival."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dialoglab.session import scratch_path
from dialoglab.sources.readers import assemble_dialogues
from dialoglab.streaming import turns as TU

START = dt.datetime(2024, 5, 1, 12, 0, 0)


def run(spark, folder, out, log, **how):
    TU.start_dialogue_stream(spark, f"{folder}/*", out, log, max_files_per_trigger=1, **how).awaitTermination()
    return TU.closed_dialogues(spark, out)


def write(spark, folder, n, rows):
    spark.createDataFrame(rows, TU.TURN_SCHEMA).coalesce(1).write.parquet(f"{folder}/part={n}")


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_within_the_watermark(spark, seed):
    r = random.Random(seed)
    turns = [(f"d{d}", t, r.choice(["hi", " @USER you ", "", None]), START + dt.timedelta(seconds=40 * d + 30 * t))
             for d in range(12) for t in range(r.randint(1, 6))]
    turns += [turns[0], (None, 1, "no id", START), ("d0", 99, "no time", None)]
    r.shuffle(turns)
    folder, out, log = (scratch_path(spark, x) for x in ("turns", "out", "log"))
    for i in range(3):
        write(spark, folder, i, turns[i::3])
    assert run(spark, folder, out, log, silence="5 minutes", late="1 hour").count() == 0  # nothing is closed yet
    TU.heartbeat(spark, "2024-05-02 00:00:00").write.parquet(f"{folder}/part=3")
    got = run(spark, folder, out, log, silence="5 minutes", late="1 hour")  # goes on where it stopped
    batch = spark.createDataFrame(turns, TU.TURN_SCHEMA).filter("id IS NOT NULL AND at IS NOT NULL")
    want = assemble_dialogues(batch, "id", "turn", "text")
    assert sorted(map(tuple, got.select("id", "dialogue").collect())) == sorted(map(tuple, want.collect()))
    assert run(spark, folder, out, log, silence="5 minutes", late="1 hour").count() == want.count()  # once only


def test_silence_closes_and_too_late_is_dropped(spark):
    folder, out, log = (scratch_path(spark, x) for x in ("turns", "out", "log"))
    minute = dt.timedelta(minutes=1)
    how = {"silence": "10 minutes", "late": "30 minutes"}
    write(spark, folder, 0, [("a", 1, "one", START), ("a", 3, "three", START + 12 * minute)])
    run(spark, folder, out, log, **how)
    write(spark, folder, 1, [("a", 2, "two", START + 6 * minute), ("b", 1, "far", START + 120 * minute)])  # joins both halves of a
    run(spark, folder, out, log, **how)
    write(spark, folder, 2, [("a", 4, "too late", START + 13 * minute), ("a", 5, "again", START + 125 * minute)])
    run(spark, folder, out, log, **how)
    TU.heartbeat(spark, "2024-05-02 00:00:00").write.parquet(f"{folder}/part=3")
    got = run(spark, folder, out, log, **how).orderBy("began")
    assert [(r.id, r.dialogue) for r in got.collect()] == [
        ("a", "Turn 1: one\nTurn 2: two\nTurn 3: three"), ("b", "Turn 1: far"), ("a", "Turn 5: again")]
    first = got.first()
    assert (first.began, first.ended) == (START, START + 12 * minute)
    assert got.filter(F.col("ended") < F.col("began")).count() == 0
