"""Aligning predictions with gold labels.

The original scripts pair predictions and targets by list position; here
they are matched on the dialogue id (an equi-join Spark can plan as a
broadcast or shuffled hash/sort-merge join, with AQE splitting skewed keys).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_predictions(gold: DataFrame, preds: DataFrame, id_col: str = "id", unique: bool = False) -> DataFrame:
    """Inner equi-join of gold rows with prediction rows on ``id``.

    A gold id that occurs n times meets its predictions n times.  ``unique=True`` fails on such ids instead (one more
    count by id, of the id column alone); :func:`repeated_ids` lists them.
    """
    if unique:
        n = repeated_ids(gold, id_col).select(F.count(F.lit(1))).scalar()
        gold = gold.where(F.when(n > 0, F.raise_error(F.lit(f"gold rows share a value of {id_col}"))).otherwise(F.lit(True)))
    return gold.join(preds, id_col, "inner")


def repeated_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, n)`` of every id that more than one row has (NULL is no id)."""
    return df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def align_by_position(gold: DataFrame, preds: DataFrame, number: str = "line_no") -> DataFrame:
    """Row k of one file with row k of the other, as the original scripts pair their lists.

    Both sides carry the record's exact number (``read_labelled_csv(..., multi_line="split", number=...)`` and the like).  Rows
    of the longer side without a partner are left out, as ``zip`` does; other columns with one name on both sides are an error.
    """
    both = (set(gold.columns) & set(preds.columns)) - {number}
    if both:
        raise ValueError(f"columns on both sides: {sorted(both)}")
    return gold.join(preds, number, "inner")


def unanswered(gold: DataFrame, preds: DataFrame, by: Sequence[str] = ("model", "setting"),
               id_col: str = "id") -> DataFrame:
    """Per prediction group, how many gold ids got no prediction.

    ``n_gold`` minus the distinct gold ids answered in the group: one left join on the id
    and a count per group, no (gold x group) product.  Groups are the ones
    present in ``preds``, also those that answered no gold id at all.
    """
    by = list(by)
    n_gold = gold.select(F.count_distinct(id_col)).scalar()
    known = gold.select(F.col(id_col).alias("_gold_id")).distinct()
    rows = preds.select(*by, id_col).join(known, F.col(id_col) == F.col("_gold_id"), "left")
    per_group = rows.groupBy(*by).agg(F.count_distinct("_gold_id").alias("_answered"))
    return per_group.select(*by, (n_gold - F.col("_answered")).cast("bigint").alias("n_unanswered"))


def unanswered_ids(gold: DataFrame, preds: DataFrame, id_col: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """Gold rows without any prediction (anti-join); with ``by``, for each group of predictions.

    The table of groups is one row per model and setting; every gold row is repeated for each of them, which is
    the size of a complete answer file.
    """
    by = list(by)
    if not by:
        return gold.join(preds.select(id_col), id_col, "left_anti")
    groups = preds.select(F.struct(*by).alias("g")).distinct().agg(F.collect_list("g")).scalar()
    each = gold.withColumn("_g", F.explode(groups)).select("*", *[F.col(f"_g.{c}").alias(c) for c in by]).drop("_g")
    cond = each[id_col] == preds[id_col]
    for c in by:
        cond = cond & each[c].eqNullSafe(preds[c])
    return each.join(preds, cond, "left_anti")
