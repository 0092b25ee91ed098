"""Incremental evaluation of model answers as they arrive (Structured Streaming).

Model answers come in one batch of files at a time (M1 writes them; an
external service may too).  The row-wise operators (P11) are stateless and
work unchanged on a streaming DataFrame; the confusion counts (E2) are a
streaming aggregation whose state is one row per (model, setting).  Gold
labels are a static table joined to the stream (stream-static join).
Every micro-batch writes the full, current confusion table as a new version (complete
output mode through ``foreachBatch``), so readers always find a finished one; the caller
names the checkpoint folder, and a query restarted with it resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.labels import parse_yes_no
from ..operators.evaluation import confusion_binary

RESPONSE_SCHEMA = "id string, model string, setting string, response string"


def confusion_stream(responses: DataFrame, gold: DataFrame, mode: str = "substring") -> DataFrame:
    """Streaming E2: ``responses`` (streaming) x ``gold`` (static ``id, y``) -> running tn/fp/fn/tp."""
    parsed = responses.select("id", "model", "setting", parse_yes_no("response", mode).alias("p"))
    return confusion_binary(parsed.join(gold.select("id", "y"), "id"))


def start_confusion_stream(spark: SparkSession, source_dir: str, gold: DataFrame, target_dir: str,
                           checkpoint: str, available_now: bool = True,
                           max_files_per_trigger: int = 64) -> StreamingQuery:
    """Watch ``source_dir`` for parquet answer files and keep ``target_dir`` up to date (see :func:`current_confusion`)."""
    stream = (spark.readStream.schema(RESPONSE_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    counts = confusion_stream(stream, gold)

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target_dir}/version={batch_id}")  # a retried batch writes its own again

    w = (counts.writeStream.outputMode("complete").foreachBatch(publish)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()



def current_confusion(spark: SparkSession, target_dir: str) -> DataFrame:
    """The newest finished version."""
    all_ = spark.read.parquet(target_dir)
    return all_.filter(F.col("version") == all_.select(F.max("version")).scalar()).drop("version")
