"""S4 as turns arrive: dialogues put together from a stream of turns (Structured Streaming).

Turns ``(id, turn, text, at)`` of a dialogue meet in a session window of their event time ``at``: it stays open while turns come within
``silence`` of each other, and is closed, and its dialogue given out once, when the watermark (the latest time seen less ``late``)
has passed its end.  Until then turns are taken in any order of arrival; a turn that comes later than that is dropped, as in
every watermarked stream.  An id that speaks again after it was closed begins a new dialogue, told by ``began``.

State is the open dialogues alone, dealt by id.  Closed ones are written once (append mode, the file sink's log), so a query that is
restarted with its checkpoint folder gives each dialogue exactly once.  Time moves on with turns only; where they
may stop, the source sends a :func:`heartbeat`, a row without an id, which opens no dialogue.  Turns without an id or time are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import lines_in_order, turn_line

TURN_SCHEMA = "id string, turn bigint, text string, at timestamp"


def heartbeat(spark: SparkSession, at: str) -> DataFrame:
    """A row that moves the watermark to ``at`` (less the stream's ``late``)."""
    return spark.range(1).select(F.lit(None).cast("string").alias("id"), F.lit(None).cast("bigint").alias("turn"),
                                 F.lit(None).cast("string").alias("text"), F.lit(at).cast("timestamp").alias("at"))


def dialogue_stream(turns: DataFrame, silence: str, late: str, prefix: str = "Turn ",
                    remove: Sequence[str] = ("@USER",)) -> DataFrame:
    """Streaming S4: ``turns`` -> ``(id, began, ended, dialogue)``, each dialogue once, when it is closed."""
    # a plain filter would be pushed below the watermark, which would then never see a heartbeat; one with a random part stays
    spoken = F.when(F.rand(0) + 1 > 0, F.col("id").isNotNull())
    rows = turns.withWatermark("at", late).filter(spoken)
    rows = rows.select("id", "at", F.col("turn").cast("bigint").alias("_t"), turn_line("turn", "text", prefix, remove).alias("_line"))
    closed = rows.groupBy("id", F.session_window("at", silence).alias("w")).agg(
        lines_in_order("_t", "_line").alias("dialogue"), F.max("at").alias("ended"))
    return closed.select("id", F.col("w.start").alias("began"), "ended", "dialogue")


def start_dialogue_stream(spark: SparkSession, source_dir: str, target_dir: str, checkpoint: str, silence: str = "30 minutes",
                          late: str = "2 hours", available_now: bool = True, max_files_per_trigger: int = 64) -> StreamingQuery:
    """Watch ``source_dir`` for parquet files of turns and append closed dialogues to ``target_dir``."""
    stream = spark.readStream.schema(TURN_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
    w = (dialogue_stream(stream, silence, late).writeStream.format("parquet").outputMode("append")
         .option("path", target_dir).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def closed_dialogues(spark: SparkSession, target_dir: str) -> DataFrame:
    """The dialogues given out so far."""
    return spark.read.schema("id string, began timestamp, ended timestamp, dialogue string").parquet(target_dir)
