"""Zero-shot prompt evaluation, end to end, on a labelled dialogue CSV.

    python examples/prompt_evaluation.py <labelled.csv | folder> <out_dir>

read -> exact seeded split -> messages -> batch scoring (a user model; the
keyword stub here) -> answers written once -> parse -> join -> metrics.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import dialoglab as dl  # noqa: E402
from dialoglab.operators.scoring import keyword_stub  # noqa: E402


def run(spark: SparkSession, src: str, out_dir: str, make_model=None):
    gold = dl.read_labelled_csv(spark, src)
    split = dl.split_exact(gold.select("id", "dialogue", "manipulative"), (0.6, 0.2, 0.2), seed=17)
    test = split.filter(F.col("split") == "test")
    # dialogues are cut to the model's input length, and the messages are what the model gets
    cut = test.select("id", dl.truncate_tokens("dialogue", 4096, "last").alias("dialogue"))
    prompts = dl.zeroshot_messages(cut, "binary")
    answers = dl.batch_score(prompts, make_model or keyword_stub(), "messages", "response", keep=("id",))
    # model answers are expensive and not repeatable: write them once, evaluate the stored copy
    answers.withColumn("model", F.lit("stub")).withColumn("setting", F.lit("zeroshot")) \
        .write.mode("overwrite").parquet(f"{out_dir}/answers")
    stored = spark.read.parquet(f"{out_dir}/answers")
    pred = stored.select("id", "model", "setting", dl.parse_yes_no("response").alias("p"))
    y = test.select("id", dl.binarize_label("manipulative").alias("y"))
    joined = dl.join_predictions(y, pred)
    dl.response_quality(joined).write.mode("overwrite").json(f"{out_dir}/quality")
    metrics = dl.binary_metrics(joined)
    metrics.write.mode("overwrite").json(f"{out_dir}/metrics")
    return metrics


if __name__ == "__main__":
    from dialoglab.session import get_spark

    run(get_spark(), sys.argv[1], sys.argv[2]).show(truncate=False)
