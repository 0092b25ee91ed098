"""Scoring and models (M1-M6), re-aimed at Spark.

* M1 runs a user-supplied batch function inside ``mapInPandas`` (Arrow
  batches), built once per task; M6 uses numpy inside tasks for partial Gram
  matrices and one eigen-decomposition per group.
* M2 / M3 are logistic regressions over hashed TF-IDF words, fitted by
  :mod:`dialoglab.operators.learners`: every label or run in the same passes.
* M5 / M6 aggregate per (group, dimension) with map-side partials; M6 fits
  a PCA per group from the group's mean and covariance (a d x d summary,
  independent of the row count) and projects rows with JVM expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions.vocab import labels_for
from ..operators.evaluation import ROUND
from ..plans.ranking import join_groups
from . import learners
from .learners import NUM_FEATURES

# --------------------------------------------------------------------------
# M1 batch scoring
# --------------------------------------------------------------------------


def keyword_stub(keywords: Sequence[str] = ("the ", "que "), yes: str = "Yes.", no: str = "No."):
    """A stand-in model for tests: answers ``yes`` when any keyword occurs (case-insensitive)."""
    kws = [k.lower() for k in keywords]

    def make() -> Callable[[pd.Series], pd.Series]:
        def fn(texts: pd.Series) -> pd.Series:
            low = texts.fillna("").str.lower()
            hit = pd.Series(False, index=texts.index)
            for k in kws:
                hit |= low.str.contains(k, regex=False)
            return hit.map({True: yes, False: no})

        return fn

    return make


def batch_score(
    df: DataFrame,
    make_fn: Callable[[], Callable[[pd.Series], pd.Series]],
    input_col: str,
    output_col: str = "response",
    output_type: str = "string",
    keep: Sequence[str] = ("id",),
    batch_rows: int = 64,
    num_partitions: int | None = None,
) -> DataFrame:
    """M1: call ``make_fn()`` once per task, then score ``batch_rows`` rows at a time.

    ``num_partitions`` spreads the rows evenly over that many tasks first
    (bounding the work, and the model copies, per task).  Responses of a real
    model are expensive and not repeatable: write the result (parquet)
    before evaluating it, or Spark may call the model again.
    """
    keep = list(keep)
    schema = Ty.StructType(
        [df.schema[c] for c in keep] + [Ty.StructField(output_col, Ty.DataType.fromDDL(output_type))]
    )

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        fn = make_fn()
        for pdf in batches:
            for start in range(0, len(pdf), batch_rows):
                part = pdf.iloc[start:start + batch_rows]
                out = part[keep].copy()
                out[output_col] = list(fn(part[input_col]))
                yield out

    src = df.select(*keep, input_col)
    if num_partitions:
        src = src.repartition(num_partitions)
    return src.mapInPandas(run, schema)


# --------------------------------------------------------------------------
# M2 / M3 classifiers
# --------------------------------------------------------------------------


def _fit_runs(data: DataFrame, text_col: str, label_col: str, id_col: str, split_col: str, splits: Sequence[str],
              reg_params: Sequence[float], epochs: int, num_features: int, state: str | None):
    """One column for each regularisation, all of them in the same passes."""
    y = F.when(F.col(label_col).isNotNull(), F.array(F.col(label_col).cast("int")))
    blocks = learners.write_blocks(data, text_col, y, id_col, split_col, num_features)
    known = learners.features(blocks, splits[0], num_features)
    learner = learners.Learner(blocks, known, [0] * len(reg_params), reg_params, splits[0], splits[1])
    return blocks, learner, learner.fit(epochs + 1, state)  # the first pass evaluates the starting point


def train_binary(data: DataFrame, text_col: str = "text", label_col: str = "label", id_col: str = "id",
                 split_col: str = "split", splits: Sequence[str] = ("train", "valid", "test"),
                 reg_params: Sequence[float] = (0.0001, 0.01, 0.1), max_iter: int = 15,
                 num_features: int = NUM_FEATURES, state: str | None = None) -> DataFrame:
    """M2: train by epochs, keep the run and epoch with the best validation accuracy (= micro-F1), score test.

    A run is a regularisation; all runs share the passes over ``data``, which is one labelled table with its split in
    ``split_col`` and is read once.  ``state`` names a shared folder in which each epoch is saved and from which a run that was cut
    off goes on (:mod:`dialoglab.operators.learners`).  Ties: the first run listed, then its earliest epoch.
    """
    blocks, learner, fit = _fit_runs(data, text_col, label_col, id_col, split_col, splits, reg_params, max_iter, num_features, state)
    run = max(range(len(reg_params)), key=lambda c: (learner.best_score[c], -c))
    scored = learners.probabilities(blocks, learner, fit.best, splits[2]).where(F.col("c") == run)
    return scored.select("id", "y", (F.col("prob") >= 0.5).cast("int").alias("p"))


def train_epochs(data: DataFrame, text_col: str = "text", label_col: str = "label", id_col: str = "id",
                 split_col: str = "split", splits: Sequence[str] = ("train", "valid", "test"),
                 reg_params: Sequence[float] = (0.0001, 0.01, 0.1), max_iter: int = 15,
                 num_features: int = NUM_FEATURES, state: str | None = None) -> DataFrame:
    """M2 / M4: ``(run, epoch, f1)`` of every epoch of the same training, for :func:`best_run`."""
    _, _, fit = _fit_runs(data, text_col, label_col, id_col, split_col, splits, reg_params, max_iter, num_features, state)
    rows = [(f"reg={reg_params[c]:g}", e, round(s, ROUND)) for c, e, s in fit.epochs]
    return data.sparkSession.createDataFrame(rows, "run string, epoch bigint, f1 double")


def train_multilabel(data: DataFrame, measure: str = "technique", text_col: str = "text", labels_col: str = "labels",
                     id_col: str = "id", split_col: str = "split", splits: Sequence[str] = ("train", "valid", "test"),
                     reg: float = 0.01, max_iter: int = 30, thresholds: Sequence[float] = (0.3, 0.4, 0.5),
                     tol: float = 1e-3, num_features: int = NUM_FEATURES, state: str | None = None) -> DataFrame:
    """M3: one independent logistic regression for each label, all fitted in the same passes over one table.

    The probability from which a label is given is chosen on the validation rows (best micro-F1 over all labels, highest
    threshold on ties).  ``labels_col`` holds a 0/1 array in vector order.  Output ``(id, label, y, p)`` of the test rows.
    """
    vocab = labels_for(measure)
    blocks = learners.write_blocks(data, text_col, F.col(labels_col), id_col, split_col, num_features)
    known = learners.features(blocks, splits[0], num_features)
    learner = learners.Learner(blocks, known, range(len(vocab)), [reg] * len(vocab), splits[0], splits[1], thresholds, tol)
    fit = learner.fit(max_iter + 1, state)
    tp, fp, fn = (fit.counts[:, k].sum(1) for k in range(3))
    f1 = 2 * tp / np.maximum(1, 2 * tp + fp + fn)
    best = max(range(len(thresholds)), key=lambda k: (f1[k], thresholds[k]))
    label = F.element_at(F.lit(list(vocab)), F.col("c") + 1)
    return learners.probabilities(blocks, learner, fit.weights, splits[2]).select(
        "id", label.alias("label"), "y", (F.col("prob") >= thresholds[best]).cast("int").alias("p"))


# --------------------------------------------------------------------------
# M4 best run
# --------------------------------------------------------------------------


def best_run(metrics: DataFrame, run_col: str = "run", epoch_col: str = "epoch", score_col: str = "f1",
             by: Sequence[str] = ()) -> DataFrame:
    """M4: the (run, epoch) with the highest score; ties -> lowest run, then lowest epoch."""
    key = F.struct((-F.col(score_col)).alias("s"), F.col(run_col).alias("r"), F.col(epoch_col).alias("e"))
    row = F.min_by(F.struct(F.col(run_col).alias(run_col), F.col(epoch_col).alias(epoch_col),
                            F.col(score_col).alias(score_col)), key)
    scored = metrics.filter(F.col(score_col).isNotNull())
    return scored.groupBy(*by).agg(row.alias("_b")).select(*by, "_b.*")


# --------------------------------------------------------------------------
# M5 standardisation, M6 2-d projection
# --------------------------------------------------------------------------


def standardize(df: DataFrame, by: str | Sequence[str] = "class", vec_col: str = "embedding",
                id_col: str = "id", many_groups: bool = False) -> DataFrame:
    """M5: z-score per group and dimension (population stdev; a zero stdev counts as 1).

    Output ``(id, pos, z)``.  Statistics are a (group, dimension) hash aggregate with partial sums in each task,
    gathered into one row per group that is brought to the vectors (``many_groups``: more than fit a broadcast).
    """
    by = [by] if isinstance(by, str) else list(by)
    long = df.select(*by, F.posexplode(vec_col).alias("pos", "x"))
    long = long.withColumn("x", F.col("x").cast("double"))
    stats = long.groupBy(*by, "pos").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    # one entry for each dimension
    groups = stats.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "mu", sd.alias("sd")))).alias("_st"))
    rows = join_groups(df.select(F.col(id_col).alias("id"), *by, F.col(vec_col).alias("_v")), groups, by, many_groups)
    z = F.zip_with("_v", "_st", lambda x, st: F.round((x.cast("double") - st["mu"]) / st["sd"], ROUND))
    return rows.select("id", F.posexplode(z).alias("pos", "z")).select("id", F.col("pos").cast("bigint").alias("pos"), "z")


def _gram_partials(df: DataFrame, by: list[str], vec_col: str) -> DataFrame:
    """Per task and group: n, sum(x) and sum(x x^T) as long rows ``(by.., k, v)``.

    ``k = -1`` is the row count, ``0 <= k < d`` the sums, ``d + i*d + j`` the
    Gram entries.  The matrices are pre-aggregated inside each task before
    the shuffle, and the shuffle is keyed by (group, k), so even a group that
    holds most rows is summed by many tasks.
    """
    by_fields = [df.schema[c] for c in by]
    schema = Ty.StructType(by_fields + [Ty.StructField("k", Ty.LongType()), Ty.StructField("v", Ty.DoubleType())])

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        acc: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(by, sort=False, dropna=False):
                x = np.stack(part[vec_col].to_numpy()).astype(np.float64)
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                n, s, g = acc.get(key, (0, 0.0, 0.0))
                acc[key] = (n + len(x), s + x.sum(axis=0), g + x.T @ x)
        for key, (n, s, g) in acc.items():
            vals = np.concatenate([[float(n)], s, np.ravel(g)])
            out = pd.DataFrame({"k": np.arange(-1, len(vals) - 1, dtype=np.int64), "v": vals})
            for c, kv in zip(by, key):
                out.insert(0, c, kv)
            yield out[[*by, "k", "v"]]

    return df.select(*by, vec_col).mapInPandas(run, schema)


def project_2d(df: DataFrame, by: str | Sequence[str] = "class", vec_col: str = "embedding",
               id_col: str = "id", many_groups: bool = False) -> DataFrame:
    """M6: 2-d coordinates, with a PCA fitted separately for every group.

    1. partial Gram matrices per task (numpy), summed per (group, entry);
    2. eigen-decomposition of each group's covariance in ``applyInPandas``
       (input: the d + d^2 summary entries of one group, not its rows);
    3. projection of every row with ``zip_with``/``aggregate`` in the JVM.
    Signs are fixed so that the largest loading of each component is positive.
    """
    by = [by] if isinstance(by, str) else list(by)
    summed = _gram_partials(df, by, vec_col).groupBy(*by, "k").agg(F.sum("v").alias("v"))
    by_fields = [df.schema[c] for c in by]
    comp_schema = Ty.StructType(by_fields + [
        Ty.StructField("mu", Ty.ArrayType(Ty.DoubleType())),
        Ty.StructField("pc1", Ty.ArrayType(Ty.DoubleType())),
        Ty.StructField("pc2", Ty.ArrayType(Ty.DoubleType())),
    ])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        vals = pdf.sort_values("k")["v"].to_numpy(dtype=np.float64)
        n = vals[0]
        d = int(round((-1 + np.sqrt(1 + 4 * (len(vals) - 1))) / 2))
        s = vals[1:1 + d]
        g = vals[1 + d:].reshape(d, d)
        mu = s / n
        cov = (g - n * np.outer(mu, mu)) / max(n - 1.0, 1.0)
        w, v = np.linalg.eigh(cov)
        order = np.argsort(w)[::-1]
        comps = []
        for k in order[:2]:
            c = v[:, k]
            if c[np.argmax(np.abs(c))] < 0:
                c = -c
            comps.append(c.tolist())
        while len(comps) < 2:
            comps.append([0.0] * d)
        return pd.DataFrame([[*[None if pd.isna(row[c]) else row[c] for c in by], mu.tolist(), comps[0], comps[1]]],
                            columns=[*by, "mu", "pc1", "pc2"])

    comps = summed.groupBy(*by).applyInPandas(fit, comp_schema)  # d + d^2 rows per group
    rows = join_groups(df.select(F.col(id_col).alias("id"), *by, vec_col), comps, by, many_groups)

    def dot(vec, mu, pc):
        centred = F.zip_with(vec, mu, lambda a, b: a.cast("double") - b)
        return F.aggregate(F.zip_with(centred, pc, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)

    return rows.select(
        "id", *by,
        dot(F.col(vec_col), F.col("mu"), F.col("pc1")).alias("x"),
        dot(F.col(vec_col), F.col("mu"), F.col("pc2")).alias("y"),
    )
