"""Corpus statistics of a labelled dialogue CSV, as tables.

    python examples/corpus_statistics.py <labelled.csv | folder> <out_dir>

label frequencies, label co-occurrence, technique x vulnerability counts,
turn / token statistics and the class balance of an exact split.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import dialoglab as dl  # noqa: E402


def run(spark: SparkSession, src: str, out_dir: str) -> dict:
    gold = dl.read_labelled_csv(spark, src).withColumn("dataset", F.lit("corpus"))
    tables = {
        "technique_counts": dl.label_counts(gold, "technique"),
        "vulnerability_counts": dl.label_counts(gold, "vulnerability"),
        "technique_cooccurrence": dl.label_cooccurrence(gold, "technique", "technique"),
        "vulnerability_cooccurrence": dl.label_cooccurrence(gold, "vulnerability", "vulnerability"),
        "technique_x_vulnerability": dl.label_cross_cooccurrence(gold),
        "turns": dl.turn_stats(gold),
        "tokens": dl.token_stats(gold, extra=True),
        "split_balance": dl.dataset_summary(dl.split_exact(gold.select("id", "dataset", "manipulative"))),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{out_dir}/{name}")
    return tables


if __name__ == "__main__":
    from dialoglab.session import get_spark

    for name, df in run(get_spark(), sys.argv[1], sys.argv[2]).items():
        print(name)
        df.show(truncate=False)
