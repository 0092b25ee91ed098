"""Properties: exact sizes, partition independence, symmetry, monotonicity, identities."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from dialoglab.operators import evaluation as E
from dialoglab.operators import sampling as R
from dialoglab.operators import scoring as M
from dialoglab.operators import stats as A
from dialoglab.plans import fixtures as fx
from dialoglab.plans.ranking import exact_rank, running_sums, seeded_key, seeded_rank


@pytest.fixture(scope="module")
def docs(spark):
    return fx.fx_corpora(spark, SF_SMALL).select("id", "dataset").cache()


def test_split_sizes_exact_and_disjoint(docs):
    s = R.split_exact(docs).groupBy("split").count().collect()
    n = docs.count()
    sizes = {r.split: r["count"] for r in s}
    assert sizes["train"] == int(0.6 * n) and sizes["valid"] == int(0.2 * n)
    assert sum(sizes.values()) == n
    assert R.split_exact(docs).select("id").distinct().count() == n


@pytest.mark.parametrize("k", [1, 3, 7])
def test_split_independent_of_partitioning(docs, k):
    base = sorted(tuple(r) for r in R.split_exact(docs).select("id", "split").collect())
    other = sorted(tuple(r) for r in R.split_exact(docs.repartition(k)).select("id", "split").collect())
    assert base == other


def test_bucketed_rank_equals_global_row_number(docs):
    ours = seeded_rank(docs, "id", 5).select("id", "_rank")
    w = Window.orderBy(seeded_key("id", 5), F.col("id"))
    ref = docs.select("id", F.row_number().over(w).alias("_rank"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, ref.collect()))


def test_grouped_rank_equals_window(docs):
    ours = seeded_rank(docs, "id", 3, partition_cols=["dataset"]).select("id", "_rank", "_group_n")
    w = Window.partitionBy("dataset").orderBy(seeded_key("id", 3), F.col("id"))
    ref = docs.select("id", F.row_number().over(w).alias("_rank"),
                      F.count("*").over(Window.partitionBy("dataset")).alias("_group_n"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, ref.collect()))


def test_exact_rank_with_coarse_buckets_and_skew(spark):
    # one key holds half the rows: the rank must still be exact
    df = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("v"))
    ours = exact_rank(df, [F.col("v"), F.col("id")], F.floor(F.col("v") / 100)).select("id", "_rank")
    ref = df.select("id", F.row_number().over(Window.orderBy("v", "id")).alias("_rank"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, ref.collect()))


def test_running_sums_match_brute_force(spark):
    rng = np.random.default_rng(3)
    vals = rng.normal(size=300).round(2)
    hist = spark.createDataFrame([(float(v), int(c)) for v, c in zip(*np.unique(vals, return_counts=True))],
                                 "v double, c bigint")
    got = {r.v: r.c_below for r in running_sums(hist, "v", ["c"], n_buckets=16).collect()}
    for v in got:
        assert got[v] == int((vals < v).sum())


def test_sample_sizes(docs):
    n = docs.count()
    assert R.sample_cap(docs, n=50, seed=1).count() == min(50, n)
    assert R.sample_cap(docs, n=10 * n, seed=1).count() == n
    h = {r.split: r["count"] for r in R.holdout(docs, 0.2, seed=42).groupBy("split").count().collect()}
    assert h["test"] == int(np.ceil(0.2 * n))
    per = {r.dataset: r["count"] for r in R.sample_per_group(docs, "dataset", n=30).groupBy("dataset").count().collect()}
    full = {r.dataset: r["count"] for r in docs.groupBy("dataset").count().collect()}
    assert per == {k: min(30, v) for k, v in full.items()}


def test_balance_classes_equal_sizes(spark):
    g = fx.fx_gold(spark, SF_SMALL).select("id", "manipulative")
    counts = {r.manipulative: r["count"] for r in R.balance_classes(g, "manipulative").groupBy("manipulative").count().collect()}
    assert len(set(counts.values())) == 1


def test_cooccurrence_symmetric_zero_diagonal(spark):
    g = fx.fx_gold(spark, SF_SMALL)
    m = {(r.label_a, r.label_b): r.n for r in A.label_cooccurrence(g, "technique", "technique").collect()}
    assert len(m) == 121
    for (a, b), n in m.items():
        assert m[(b, a)] == n
        if a == b:
            assert n == 0


def test_ccdf_starts_at_one_and_falls(spark):
    c = fx.fx_corpora(spark, SF_SMALL)
    rows = A.ccdf(c, F.size(F.split("dialogue", "\n")), "dataset").orderBy("dataset", "value").collect()
    by = {}
    for r in rows:
        by.setdefault(r.dataset, []).append(r)
    for pts in by.values():
        assert pts[0].p_first == 1.0
        firsts = [p.p_first for p in pts]
        assert firsts == sorted(firsts, reverse=True)
        assert all(p.p_last <= p.p_first for p in pts)


def test_summary_splits_add_up(spark):
    g = R.split_exact(fx.fx_gold(spark, SF_SMALL).select("id", "manipulative")).withColumn("dataset", F.lit("x"))
    rows = {r.split: r for r in A.dataset_summary(g).collect()}
    assert sum(rows[s].n for s in ("train", "valid", "test")) == rows["all"].n
    assert sum(rows[s].n_pos for s in ("train", "valid", "test")) == rows["all"].n_pos


def test_micro_f1_equals_accuracy(spark):
    from dialoglab.plans.catalog import binary_predictions

    for r in E.binary_metrics(binary_predictions(spark, SF_SMALL)).collect():
        assert r.micro_f1 == r.accuracy


def test_thresholded_auc_equals_score_auc_of_thresholded_scores(spark):
    lg = fx.fx_logits(spark, SF_SMALL).select("y", F.col("logit").alias("score"))
    thr = E.pooled_auc(lg, "thresholded").first().auc
    binar = lg.select("y", ((1 / (1 + F.exp(-F.col("score")))) >= 0.5).cast("double").alias("score"))
    assert E.pooled_auc(binar, "score").first().auc == pytest.approx(thr, abs=1e-6)


def test_project_2d_matches_numpy_per_group(spark):
    emb = fx.fx_embeddings(spark, SF_SMALL)
    got = {r.id: (r.x, r.y) for r in M.project_2d(emb, "class").collect()}
    pdf = emb.toPandas()
    for _, part in pdf.groupby("class"):
        x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
        mu = x.mean(axis=0)
        w, v = np.linalg.eigh(np.cov(x, rowvar=False))
        comps = []
        for k in np.argsort(w)[::-1][:2]:
            c = v[:, k]
            comps.append(-c if c[np.argmax(np.abs(c))] < 0 else c)
        proj = (x - mu) @ np.stack(comps).T
        for i, pid in enumerate(part["id"]):
            assert got[pid] == pytest.approx(tuple(proj[i]), abs=1e-6)


def test_models_learn_and_predict_held_out_rows(spark):
    """Texts whose labels follow from their words: held-out scores far above chance, every test row once."""
    from dialoglab.functions.vocab import labels_for
    from dialoglab.operators import scoring as M

    words = ["river", "stone", "cloud", "lamp", "tree", "wheel", "glass", "paper"]
    ids = spark.range(600).select(F.col("id"), *[(F.pmod(F.xxhash64("id", F.lit(j)), F.lit(2)) == 0).cast("int").alias(f"b{j}")
                                                 for j in range(8)])
    text = F.concat_ws(" ", F.lit("the dialogue goes on"), *[F.when(F.col(f"b{j}") == 1, F.lit(w)) for j, w in enumerate(words)])
    vocab = labels_for("vulnerability")
    data = ids.select(F.col("id").cast("string").alias("id"), text.alias("text"), F.col("b0").alias("label"),
                      F.array(*[F.col(f"b{j}") for j in range(len(vocab))]).alias("labels"))
    data = R.split_exact(data, seed=3)
    n_test = data.filter("split = 'test'").count()
    out = M.train_binary(data, num_features=1 << 12).collect()
    assert len({r.id for r in out}) == len(out) == n_test
    assert sum(r.y == r.p for r in out) / len(out) > 0.95
    ml = M.train_multilabel(data, "vulnerability", num_features=1 << 12).collect()
    assert len(ml) == n_test * len(vocab) and {r.label for r in ml} == set(vocab)
    assert sum(r.y == r.p for r in ml) / len(ml) > 0.95


def test_cuts_with_null_and_repeated_ids(spark):
    rows = [(None if i % 4 == 0 else str(i % 37), i, ["a", "b", None][i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, v long, g string").repartition(5)
    sizes = {r.split: r["count"] for r in R.split_exact(df).groupBy("split").count().collect()}
    assert sizes == {"train": 180, "valid": 60, "test": 60}
    assert R.sample_cap(df, 70).count() == 70 and R.sample_cap(df, 9999).count() == 300
    assert {r.split: r["count"] for r in R.holdout(df).groupBy("split").count().collect()} == {"test": 60, "train": 240}
    assert [r["count"] for r in R.sample_per_group(df, "g", 7).groupBy("g").count().collect()] == [7, 7, 7]
    few = df.filter("g IS NOT NULL OR v < 30")
    assert [r["count"] for r in R.balance_classes(few, "g").groupBy("g").count().collect()] == [10, 10, 10]
    picked = R.select_examples(df.fillna({"g": "x"}), "g", {"a": 2, "x": 1}).collect()
    assert sorted((r.g, r.example_no) for r in picked) == [("a", 1), ("a", 2), ("x", 1)]
    assert R.split_exact(df.limit(0)).count() == 0
    # the same rows whatever the partitioning
    one = {r.v for r in R.sample_cap(df.coalesce(1), 70).collect()}
    assert one == {r.v for r in R.sample_cap(df.repartition(7), 70).collect()}


def test_null_groups_in_group_statistics(spark):
    from dialoglab.operators import scoring as M

    df = spark.createDataFrame([(str(i), None if i % 2 else "1", [float(i), float(i * i % 7), 1.0]) for i in range(12)],
                               "id string, class string, embedding array<double>")
    assert M.standardize(df, "class").count() == 36
    assert M.project_2d(df, "class").count() == 12


def test_no_shared_folder_on_a_cluster_is_an_error(monkeypatch):
    from dialoglab import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


@pytest.mark.parametrize("n_buckets", [2, 5, 16, 1024])
def test_two_level_bucket_equals_full_count(spark, n_buckets):
    import math

    from dialoglab.plans.ranking import quantile_bucket, two_level_bucket

    rng = np.random.default_rng(n_buckets)
    bounds = sorted(rng.integers(0, 50, size=n_buckets - 1).astype(float).tolist())
    step = max(1, math.isqrt(n_buckets))
    coarse = [bounds[(k + 1) * step - 1] for k in range((n_buckets - 1) // step)]
    df = spark.createDataFrame([(float(v),) for v in range(-1, 52)], "v double")
    b = F.array(*[F.lit(x) for x in bounds]) if bounds else F.array().cast("array<double>")
    c = F.array(*[F.lit(x) for x in coarse]) if coarse else F.array().cast("array<double>")
    rows = df.select(quantile_bucket(F.col("v"), b).alias("a"), two_level_bucket(F.col("v"), b, c, step).alias("t")).collect()
    assert all(r.a == r.t for r in rows)
