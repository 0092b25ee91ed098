"""Evaluation (E1-E8): confusion counts and library-convention metrics.

Every metric is one hash aggregate of conditional counts (map-side partial
aggregation, so a hot ``model`` key costs nothing extra) followed by
arithmetic on the few resulting rows.  Conventions:

* positive class is 1; precision / recall are 0 when their denominator is 0;
* binary micro-F1 equals accuracy; binary macro-F1 averages the F1 of the
  classes present in gold or prediction;
* multi-label micro metrics pool the counts of all labels, macro-F1
  averages all labels (0 for a label with no gold and no prediction),
  accuracy is the exact match of the whole vector;
* rows whose prediction is unusable (-1, or an empty label list) are left
  out of gold and prediction alike; no processed rows -> NULL metrics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import labels_for
from ..plans.ranking import running_sums

ROUND = 6


def _by(by: str | Sequence[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def _safe(num: Column, den: Column) -> Column:
    """num / den, 0.0 when den is 0."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def _r(c: Column) -> Column:
    return F.round(c, ROUND)


def _cnt(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def response_quality(df: DataFrame, by=("model", "setting"), y: str = "y", p: str = "p") -> DataFrame:
    """Totals, corrupted and processed rows, gold / predicted class counts over processed rows."""
    ok = F.col(p) != -1
    return df.groupBy(*_by(by)).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_total"),
        _cnt(~ok).alias("n_corrupted"),
        _cnt(ok).alias("n_processed"),
        _cnt(ok & (F.col(y) == 1)).alias("n_gold_pos"),
        _cnt(ok & (F.col(y) == 0)).alias("n_gold_neg"),
        _cnt(ok & (F.col(p) == 1)).alias("n_pred_pos"),
        _cnt(ok & (F.col(p) == 0)).alias("n_pred_neg"),
    )


def confusion_binary(df: DataFrame, by=("model", "setting"), y: str = "y", p: str = "p") -> DataFrame:
    """Tn, fp, fn, tp over processed rows (always the full 2x2)."""
    ok = F.col(p) != -1
    yy, pp = F.col(y) == 1, F.col(p) == 1
    return df.groupBy(*_by(by)).agg(
        _cnt(ok & ~yy & ~pp).alias("tn"),
        _cnt(ok & ~yy & pp).alias("fp"),
        _cnt(ok & yy & ~pp).alias("fn"),
        _cnt(ok & yy & pp).alias("tp"),
    )


def metrics_from_confusion(cm: DataFrame, by: Sequence[str]) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    present1 = (tp + fp + fn) > 0
    present0 = (tn + fp + fn) > 0
    f1_1 = _safe(2 * tp, 2 * tp + fp + fn)
    f1_0 = _safe(2 * tn, 2 * tn + fp + fn)
    n_present = present1.cast("int") + present0.cast("int")
    macro = _safe(F.when(present1, f1_1).otherwise(0.0) + F.when(present0, f1_0).otherwise(0.0), n_present)
    acc = (tp + tn).cast("double") / n.cast("double")
    live = n > 0
    return cm.select(
        *by,
        F.when(live, _r(_safe(tp, tp + fp))).alias("precision"),
        F.when(live, _r(_safe(tp, tp + fn))).alias("recall"),
        F.when(live, _r(acc)).alias("accuracy"),
        F.when(live, _r(acc)).alias("micro_f1"),
        F.when(live, _r(macro)).alias("macro_f1"),
    )


def binary_metrics(df: DataFrame, by=("model", "setting"), y: str = "y", p: str = "p") -> DataFrame:
    """Precision, recall, accuracy, micro-F1, macro-F1."""
    return metrics_from_confusion(confusion_binary(df, by, y, p), _by(by))


def multilabel_long(df: DataFrame, measure: str, y: str = "y", p: str = "p", by=None,
                    skip_empty: bool = True) -> DataFrame:
    """(by.., label, y, p, _row, _exact) rows; ``y`` / ``p`` are 0/1 arrays in vector order.

    Rows whose prediction is empty (all zero) get ``p = -1`` on every label,
    which the confusion counts skip.  The processed-row test is folded into
    the aggregates rather than applied as a filter, so the optimizer has no
    predicate to push below joins into the (possibly large) expressions that
    produced ``p``.  ``_row`` marks one exploded row per processed input row
    and ``_exact`` whether its whole vector matched, so row-level accuracy
    comes out of the same single aggregation as the per-label counts.

    ``skip_empty=False`` keeps all-zero predictions (a classifier's valid
    "no label" answer) instead of treating them as unusable answers.
    """
    vocab = F.array(*[F.lit(x) for x in labels_for(measure)])
    ok = F.array_contains(F.col(p), 1) if skip_empty else F.lit(True)
    z = df.select(*_by(by), ok.alias("_ok"), (F.col(y) == F.col(p)).alias("_eq"),
                  F.posexplode(F.arrays_zip(F.col(y).alias("y"), F.col(p).alias("p"))).alias("pos", "yp"))
    return z.select(*_by(by), F.element_at(vocab, F.col("pos") + 1).alias("label"),
                    F.col("yp.y").alias("y"), F.when(F.col("_ok"), F.col("yp.p")).otherwise(F.lit(-1)).alias("p"),
                    (F.col("_ok") & (F.col("pos") == 0)).alias("_row"), F.col("_eq").alias("_exact"))


def _multilabel_counts(df: DataFrame, measure: str, y: str, p: str, by, skip_empty: bool = True) -> DataFrame:
    long = multilabel_long(df, measure, y, p, by, skip_empty)
    ok = F.col("p") != -1
    yy, pp = F.col("y") == 1, F.col("p") == 1
    return long.groupBy(*_by(by), "label").agg(
        _cnt(ok & ~yy & ~pp).alias("tn"), _cnt(ok & ~yy & pp).alias("fp"),
        _cnt(ok & yy & ~pp).alias("fn"), _cnt(ok & yy & pp).alias("tp"),
        _cnt(F.col("_row")).alias("_rows"), _cnt(F.col("_row") & F.col("_exact")).alias("_exact_rows"),
    )


def confusion_multilabel(df: DataFrame, measure: str, y: str = "y", p: str = "p", by=None,
                         skip_empty: bool = True) -> DataFrame:
    """Per label tn, fp, fn, tp over processed rows (non-empty prediction unless ``skip_empty=False``)."""
    return _multilabel_counts(df, measure, y, p, by, skip_empty).select(*_by(by), "label", "tn", "fp", "fn", "tp")


def multilabel_metrics(df: DataFrame, measure: str, y: str = "y", p: str = "p", by=None,
                       skip_empty: bool = True) -> DataFrame:
    """E5: micro precision / recall / F1, macro-F1 over all labels, exact-match accuracy.

    One pass over the data: the per-label counts carry the row-level
    exact-match counts, and the roll-up runs on the per-label table.
    """
    b = _by(by)
    per_label = _multilabel_counts(df, measure, y, p, by, skip_empty).withColumn(
        "f1", _safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    )
    pooled = per_label.groupBy(*b).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("f1").alias("macro"),
        F.sum("_rows").alias("_rows"), F.sum("_exact_rows").alias("_exact_rows"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    live = F.col("_rows") > 0  # no processed rows -> NULL metrics

    def m(c: Column) -> Column:
        return F.when(live, _r(c))

    return pooled.select(
        *b,
        m(_safe(tp, tp + fp)).alias("precision"),
        m(_safe(tp, tp + fn)).alias("recall"),
        m(F.col("_exact_rows") / F.col("_rows")).alias("accuracy"),
        m(_safe(2 * tp, 2 * tp + fp + fn)).alias("micro_f1"),
        m(F.col("macro")).alias("macro_f1"),
    )


def per_label_metrics(df: DataFrame, measure: str, y: str = "y", p: str = "p", by=None,
                      skip_empty: bool = True) -> DataFrame:
    """Precision and recall of every label."""
    cm = confusion_multilabel(df, measure, y, p, by, skip_empty)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cm.select(*_by(by), "label", _r(_safe(tp, tp + fp)).alias("precision"),
                     _r(_safe(tp, tp + fn)).alias("recall"))


def pooled_auc(long: DataFrame, mode: str = "thresholded", y: str = "y", score: str = "score",
               threshold: float = 0.5, by=None) -> DataFrame:
    """Micro (pooled) ROC-AUC over all (row, label) pairs, per ``by`` group.

    ``thresholded``: the score is first turned into 0/1 by sigmoid >= threshold,
    which makes the AUC (TPR + TNR) / 2.  ``score``: the true AUC of the raw
    scores, ties counted one half, computed from the histogram of distinct
    scores with exact running sums (no single-partition sort of the pairs).
    """
    b = _by(by)
    if mode == "thresholded":
        pred = ((F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(score)))) >= F.lit(threshold)).cast("int")
        cm = confusion_binary(long.withColumn("_p", pred), b, y, "_p")
        tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
        auc = (_safe(tp, tp + fn) + _safe(tn, tn + fp)) / 2
        return cm.select(*b, F.lit("thresholded").alias("mode"), _r(auc).alias("auc"))
    if mode == "score":
        hist = long.groupBy(*b, F.col(score).cast("double").alias("v")).agg(
            _cnt(F.col(y) == 1).alias("pos"), _cnt(F.col(y) != 1).alias("neg")
        )
        cum = running_sums(hist, "v", ["neg"], partition_cols=b)
        total = cum.groupBy(*b).agg(
            F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5)).alias("w"),
            F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        )
        auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("w") / (F.col("P") * F.col("N")))
        return total.select(*b, F.lit("score").alias("mode"), _r(auc).alias("auc"))
    raise ValueError("mode must be thresholded or score")


def leaderboard_multilabel(df: DataFrame, measure: str, by=("train_data", "model"), y: str = "y", p: str = "p") -> DataFrame:
    """E8, label form: E5 for every combination with its ``measure``, ranked by macro-F1 (one row per combination)."""
    m = multilabel_metrics(df, measure, y, p, by).withColumn("measure", F.lit(measure))
    return m.withColumn("rank", F.rank().over(Window.orderBy(F.col("macro_f1").desc_nulls_last())).cast("bigint"))


def leaderboard(df: DataFrame, by=("model", "setting"), y: str = "y", p: str = "p") -> DataFrame:
    """E3 for every combination, ranked by macro-F1 (the tiny result table is ranked)."""
    m = binary_metrics(df, by, y, p)
    w = Window.orderBy(F.col("macro_f1").desc_nulls_last())  # one row per combination
    return m.withColumn("rank", F.rank().over(w).cast("bigint"))
