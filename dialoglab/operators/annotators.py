"""Gold labels from three annotators.

The annotation table is wide (one row per dialogue, three column groups),
so consensus, majority, label votes and agreement are all row-wise
expressions: no shuffle at all.  G1 gives the long form for anyone who
wants to aggregate per annotator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import split_labels

K = (1, 2, 3)


def unpivot_annotators(df: DataFrame, id_col: str = "id") -> DataFrame:
    """G1: one row per (dialogue, annotator); a blank vote or confidence is NULL."""
    parts = []
    for k in K:
        parts += [
            f"{k}",
            f"annotator_{k}",
            f"TRY_CAST(manipulative_{k} AS INT)",
            f"technique_{k}",
            f"victim_{k}",
            f"vulnerability_{k}",
            f"marks_{k}",
            f"TRY_CAST(confidence_{k} AS INT)",
        ]
    stack = f"stack(3, {', '.join(parts)}) AS (annotator_no, annotator, manipulative, " \
            "technique, victim, vulnerability, marks, confidence)"
    return df.select(F.col(id_col).alias("id"), F.expr(stack))


def _n_manip() -> Column:
    return sum(F.coalesce(F.col(f"manipulative_{k}") == "1", F.lit(False)).cast("int") for k in K)


def gold_labels(df: DataFrame, version: str = "consensus", id_col: str = "id") -> DataFrame:
    """``consensus`` keeps dialogues where all three agree; ``majority`` keeps all."""
    n = _n_manip()
    if version == "consensus":
        agree = (F.col("manipulative_1") == F.col("manipulative_2")) & (F.col("manipulative_2") == F.col("manipulative_3"))
        agree = agree & F.col("manipulative_1").isin("0", "1")  # three blanks are no consensus
        return df.filter(agree).select(F.col(id_col).alias("id"), F.col("manipulative_1").alias("manipulative"))
    if version == "majority":
        return df.select(F.col(id_col).alias("id"), F.when(n >= 2, "1").otherwise("0").alias("manipulative"))
    raise ValueError("version must be consensus or majority")


def vote_labels(df: DataFrame, measure: str = "technique", min_votes: int = 2, id_col: str = "id") -> DataFrame:
    """A label is gold when at least ``min_votes`` annotators gave it (each annotator once)."""
    lists = [F.array_distinct(split_labels(f"{measure}_{k}")) for k in K]
    cand = F.array_distinct(F.concat(*lists))
    votes = F.transform(cand, lambda lab: F.struct(
        lab.alias("label"), sum(F.array_contains(x, lab).cast("bigint") for x in lists).alias("n_votes")))
    kept = F.filter(votes, lambda s: s["n_votes"] >= min_votes)
    return df.select(F.col(id_col).alias("id"), F.explode(kept).alias("v")).select("id", "v.label", "v.n_votes")


def annotator_agreement(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Share of the three annotators on the majority side, and the mean of the confidences given.

    As in G3, a blank vote counts on the ``0`` side; a blank confidence is left out (all blank: NULL).
    """
    n = _n_manip()
    given = [F.col(f"confidence_{k}").try_cast("double") for k in K]
    total = sum(F.coalesce(c, F.lit(0.0)) for c in given)
    count = sum(c.isNotNull().cast("int") for c in given)
    conf = F.when(count > 0, total / count)
    return df.select(
        F.col(id_col).alias("id"),
        F.round(F.greatest(n, 3 - n) / 3.0, 6).alias("agreement"),
        F.round(conf, 6).alias("mean_confidence"),
    )
