"""Streaming E2 over answer files equals the batch E2 over the same answers."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from dialoglab.functions.labels import binarize_label, parse_yes_no
from dialoglab.operators.evaluation import confusion_binary
from dialoglab.plans import fixtures as fx
from dialoglab.session import scratch_path
from dialoglab.streaming.responses import current_confusion, start_confusion_stream


def test_confusion_stream_matches_batch(spark):
    resp = fx.fx_responses(spark, SF_SMALL)
    gold = fx.fx_gold(spark, SF_SMALL).select("id", binarize_label("manipulative").alias("y"))
    src, out = scratch_path(spark, "answers"), scratch_path(spark, "confusion")
    # answers arrive in two batches of files
    resp.filter(F.col("model") == "model_a").write.parquet(f"{src}/part=a")
    resp.filter(F.col("model") == "model_b").write.parquet(f"{src}/part=b")
    q = start_confusion_stream(spark, f"{src}/*", gold, out, scratch_path(spark, "stream"), max_files_per_trigger=1)
    q.awaitTermination(300)
    got = sorted(tuple(r) for r in current_confusion(spark, out).select("model", "setting", "tn", "fp", "fn", "tp").collect())
    batch = resp.select("id", "model", "setting", parse_yes_no("response").alias("p")).join(gold, "id")
    want = sorted(tuple(r) for r in confusion_binary(batch).select("model", "setting", "tn", "fp", "fn", "tp").collect())
    assert got == want and len(got) == 4
