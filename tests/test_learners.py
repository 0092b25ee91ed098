"""The learner's numbers: against separate fits, against a plain optimum, cut off and resumed, in step with many columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoglab.functions.vocab import labels_for
from dialoglab.operators import learners as Lr
from dialoglab.operators import scoring as M

WORDS = ["pay", "you", "never", "always", "please", "listen", "river", "boat", "blame", "fault", "sorry", "thanks", "dinner", "late", "home", "work"]
D = 64


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ws = [rng.choice(WORDS) for _ in range(rng.randint(0, 25))]
        y = [int(("blame" in ws) != (rng.random() < 0.1)), int(ws.count("pay") + ws.count("late") > 2), int(rng.random() < 0.3)]
        out.append((str(i), " ".join(ws), y, ["train", "train", "train", "valid", "test"][i % 5]))
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "id string, text string, labels array<int>, split string").repartition(parts, "id")


def dense(rows):
    """Row vectors by the stated rule: (1 + log tf) * idf, length 1."""
    tf = np.zeros((len(rows), D))
    for i, (_, t, _, _) in enumerate(rows):
        for w, c in Counter(re.findall(r"\w+", t.lower())).items():
            tf[i, zlib.crc32(w.encode()) % D] += c
    tf = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0)
    train = np.array([r[3] == "train" for r in rows])
    df = (tf[train] > 0).sum(0)
    x = tf * np.where(df > 0, np.log((train.sum() + 1) / (df + 1)), 0)
    norm = np.sqrt((x**2).sum(1))
    return x / np.where(norm > 0, norm, 1)[:, None], train, df > 0


def learn(spark, rows, targets, regs, passes=200, tol=1e-8, state=None, parts=3):
    blocks = Lr.write_blocks(frame(spark, rows, parts), "text", F.col("labels"), num_features=D)
    known = Lr.features(blocks, "train", D)
    learner = Lr.Learner(blocks, known, targets, regs, tol=tol)
    return learner, learner.fit(passes, state)


def test_same_coefficients_as_separate_fits(spark):
    """All labels in the same passes give what one pyspark.ml fit for each label gives."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    rows = corpus()
    x, train, active = dense(rows)
    _, fit = learn(spark, rows, range(3), [0.01] * 3)
    train_rows = [(Vectors.dense(v.tolist()), *map(float, r[2])) for v, r, t in zip(x, rows, train, strict=True) if t]
    table = spark.createDataFrame(train_rows, ["x", "y0", "y1", "y2"])
    for c in range(3):
        one = LogisticRegression(featuresCol="x", labelCol=f"y{c}", regParam=0.01, standardization=False, maxIter=500, tol=1e-12).fit(table)
        assert np.abs(fit.weights[:-1, c] - one.coefficients.toArray()[active]).max() < 1e-4
        assert abs(fit.weights[-1, c] - one.intercept) < 1e-4


def test_columns_do_not_disturb_each_other(spark):
    """Other columns and another partitioning change nothing; each regularisation finds its own optimum."""
    rows = corpus(200, 5)
    _, many = learn(spark, rows, [0, 0, 1], [0.001, 0.1, 0.01])
    x, train, active = dense(rows)
    x = x[train][:, active]
    for c, (target, reg) in enumerate([(0, 0.001), (0, 0.1), (1, 0.01)]):
        _, alone = learn(spark, rows, [target], [reg], parts=1)
        assert np.abs(alone.weights[:, 0] - many.weights[:, c]).max() < 1e-5
        y = np.array([r[2][target] for r in rows])[train]
        w, b = many.weights[:-1, c], many.weights[-1, c]
        r = 1 / (1 + np.exp(-(x @ w + b))) - y
        assert np.abs(x.T @ r / len(y) + reg * w).max() < 1e-6 and abs(r.mean()) < 1e-6


def test_cut_off_and_resumed(spark, tmp_path):
    """A run that stops after some passes and goes on gives the same table and weights, to the last bit."""
    rows = corpus()
    whole = learn(spark, rows, [0, 1], [0.01, 0.0001], passes=12)
    state = str(tmp_path / "state")
    learn(spark, rows, [0, 1], [0.01, 0.0001], passes=5, state=state)
    (tmp_path / "state" / "pass=00005").mkdir()  # a pass that was being written when the job died
    again = learn(spark, rows, [0, 1], [0.01, 0.0001], passes=12, state=state)
    assert again[1].epochs == whole[1].epochs and len(whole[1].epochs) > 6
    assert (again[1].weights == whole[1].weights).all() and (again[1].best == whole[1].best).all()
    done = Lr.load_pass(spark, state, 11)
    assert done is None or len(done) <= 2


def test_best_run_ranks_real_epochs(spark):
    """The scores are those of the validation rows under each epoch's weights; best_run finds the first of the highest."""
    rows = corpus()
    data = frame(spark, rows).withColumn("label", F.col("labels")[0])
    table = M.train_epochs(data, reg_params=(0.0001, 0.5), max_iter=10, num_features=D)
    cells = [tuple(r) for r in table.collect()]
    assert {r for r, _, _ in cells} == {"reg=0.0001", "reg=0.5"}
    for run in {r for r, _, _ in cells}:
        own = [e for r, e, _ in cells if r == run]
        assert own == list(range(1, len(own) + 1))
    best = M.best_run(table).first()
    top = max(s for _, _, s in cells)
    assert (best.run, best.epoch, best.f1) == min((r, e, s) for r, e, s in cells if s == top) and top > 0.8
    out = M.train_binary(data, reg_params=(0.0001, 0.5), max_iter=10, num_features=D).collect()
    assert sorted(int(r.id) for r in out) == [i for i in range(400) if i % 5 == 4]
    assert all(r.y == rows[int(r.id)][2][0] for r in out)
    assert sum(r.y == r.p for r in out) / len(out) > 0.8


def test_multilabel_threshold_and_rows(spark):
    rows = corpus()
    vocab = labels_for("technique")
    wide = [(i, t, y + [0] * (len(vocab) - 3), s) for i, t, y, s in rows]
    out = M.train_multilabel(frame(spark, wide), num_features=D, reg=0.001).collect()
    assert len(out) == 80 * len(vocab) and {r.label for r in out} == set(vocab)
    by = {(r.id, r.label): r for r in out}
    assert all(by[i, vocab[c]].y == y[c] for i, _, y, s in wide if s == "test" for c in range(len(vocab)))
    right = [r.y == r.p for r in out if r.label == vocab[0]]
    assert sum(right) / len(right) > 0.8
    assert not any(r.p for r in out if r.label in vocab[3:])  # labels that no train row has


@pytest.mark.parametrize("rows", [[], [("1", "a b", [1, 0, 1], "valid")], [("1", None, [1, 0, 1], "train"), ("2", "", [0, 0, 0], "train"), ("3", "x", None, "train"),
                                                                         ("4", "pay", [1, 1, 1], None), (None, "late pay", [1, 0, 0], "test")]])
def test_rows_with_nothing_to_learn(spark, rows):
    learner, fit = learn(spark, rows, range(3), [0.01] * 3, passes=5)
    assert np.isfinite(fit.weights).all() and all(math.isfinite(s) for _, _, s in fit.epochs)
    assert learner.known.n_train == sum(s == "train" and y is not None for _, _, y, s in rows)
    out = Lr.probabilities(learner.blocks, learner, fit.weights, "test").collect()
    assert len(out) == 3 * sum(r[3] == "test" for r in rows)


def test_a_text_is_held_as_its_places_and_counts():
    from collections import Counter
    from zlib import crc32

    text = "b a A c_1 é, " * 3000 + " ".join(f"w{i}" for i in range(500))
    cols, tf = Lr._hashed(text, 64)
    want = Counter()
    for w, n in Counter(Lr._WORD.findall(text.lower())).items():
        want[crc32(w.encode()) % 64] += n
    assert dict(zip(cols.tolist(), tf.tolist(), strict=True)) == want and cols.tolist() == sorted(want)
    assert cols.nbytes + tf.nbytes <= 12 * 64
    assert [len(x) for x in Lr._hashed("", 64)] == [0, 0]
