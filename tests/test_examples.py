"""The example scripts run end to end on a labelled CSV written from the fixture table."""

import os
import sys

from pyspark.sql import functions as F

from conftest import SF_SMALL
from dialoglab.plans import fixtures as fx
from dialoglab.session import scratch_path
from dialoglab.sources import writers as W

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "examples"))


def _labelled_csv(spark):
    gold = fx.fx_gold(spark, SF_SMALL).select(
        F.col("id").alias("ID"), F.col("dialogue").alias("Dialogue"), F.col("manipulative").alias("Manipulative"),
        F.col("technique").alias("Technique"), F.col("vulnerability").alias("Vulnerability"))
    return W.write_csv(gold, scratch_path(spark, "example-src"))


def test_prompt_evaluation_example(spark):
    import prompt_evaluation

    m = prompt_evaluation.run(spark, _labelled_csv(spark), scratch_path(spark, "example-out")).collect()
    assert len(m) == 1 and 0.0 <= m[0].accuracy <= 1.0


def test_corpus_statistics_example(spark):
    import corpus_statistics

    tables = corpus_statistics.run(spark, _labelled_csv(spark), scratch_path(spark, "example-out"))
    assert tables["technique_cooccurrence"].count() == 121
    assert tables["technique_x_vulnerability"].count() == 55
