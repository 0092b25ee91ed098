"""Corpus statistics.

Counting is always explode -> hash aggregate (partial aggregation before
the shuffle), and zero-filled grids are built by exploding literal label
arrays (no join against a generated cartesian product).  Windows only run
over already-aggregated histograms.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.labels import canonicalize_labels, split_labels, unknown_labels
from ..functions.vocab import EMOTIONS, labels_for

ROUND = 6


def _by(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def _grid(spark: SparkSession, a_name: str, a_vals: Sequence[str], b_name: str, b_vals: Sequence[str]) -> DataFrame:
    """All (a, b) pairs of two small literal lists, built by two explodes."""
    return (
        spark.range(1)
        .select(F.explode(F.array(*[F.lit(x) for x in a_vals])).alias(a_name))
        .select(a_name, F.explode(F.array(*[F.lit(x) for x in b_vals])).alias(b_name))
    )


def dataset_summary(df: DataFrame, by=("dataset", "split"), label_col: str = "manipulative",
                    totals: bool = True) -> DataFrame:
    """A1: rows, positives, negatives and pos:neg ratio (NULL without negatives).

    With ``totals`` the last grouping column is rolled up into an ``all`` row
    (one pass with ``rollup``).
    """
    by = _by(by)
    aggs = [
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.count_if(F.col(label_col) == "1").cast("bigint").alias("n_pos"),
        F.count_if(F.col(label_col) == "0").cast("bigint").alias("n_neg"),
    ]
    if totals and by:
        g = df.rollup(*by).agg(*aggs, F.grouping_id().alias("_gid"))
        g = g.filter(F.col("_gid") <= 1).withColumn(by[-1], F.when(F.col("_gid") == 1, F.lit("all")).otherwise(F.col(by[-1])))
        g = g.drop("_gid")
    else:
        g = df.groupBy(*by).agg(*aggs)
    ratio = F.when(F.col("n_neg") > 0, F.round(F.col("n_pos") / F.col("n_neg"), ROUND))
    return g.withColumn("ratio", ratio)


def label_counts(df: DataFrame, col: str = "technique", by=None) -> DataFrame:
    """A2: how often every label occurs (empty lists skipped), most frequent first, then by label."""
    b = _by(by)
    ex = df.select(*b, F.explode(split_labels(col)).alias("label"))
    counts = ex.groupBy(*b, "label").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return counts.orderBy(*b, F.desc("n"), "label")


def compare_datasets(corpora, col: str = "technique") -> DataFrame:
    """Label counts of several labelled corpora stacked with a ``dataset`` column.

    ``corpora`` maps names to tables, or is one table that already has a ``dataset`` column (one scan).  Corpora
    are unioned first (no shuffle) and counted in one aggregation.
    """
    from ..sources.readers import union_corpora

    if isinstance(corpora, DataFrame):
        return label_counts(corpora, col, by="dataset")
    return label_counts(union_corpora(corpora, cols=(col,)), col, by="dataset")


def unknown_label_counts(df: DataFrame, col: str, measure: str) -> DataFrame:
    """Labels outside the vocabulary (in neither spelling) and how many rows have them: what A3 and A4 leave out."""
    bad = F.array_distinct(unknown_labels(split_labels(col), measure))
    return df.select(F.explode(bad).alias("label")).groupBy("label").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def _known(col: str, measure: str, strict: bool) -> Column:
    """A row's labels in gold spelling; others fail the job (``strict``) or are left out."""
    labs = split_labels(col)
    known = F.filter(canonicalize_labels(labs, "gold"), lambda x: F.array_contains(F.lit(labels_for(measure)), x))
    if not strict:
        return known
    bad = unknown_labels(labs, measure)
    return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("unknown label: "), F.array_join(bad, ",")))).otherwise(known)


def label_cooccurrence(df: DataFrame, col: str, measure: str, strict: bool = False) -> DataFrame:
    """A3: symmetric label x label count of dialogues having both labels; zero diagonal; full grid.

    Pairs are formed inside each row (no self-join); a label counts once per row in either spelling.
    Labels outside the vocabulary go before pairs are made (``strict``: they fail the job), so a row makes at most
    L(L-1) pairs for a vocabulary of L; :func:`unknown_label_counts` reports them.
    """
    labs = F.array_distinct(_known(col, measure, strict))
    pairs = F.flatten(F.transform(labs, lambda a: F.transform(F.filter(labs, lambda b: b != a),
                                                                lambda b: F.struct(a.alias("label_a"), b.alias("label_b")))))
    counts = (df.select(F.explode(pairs).alias("p")).select("p.*")
              .groupBy("label_a", "label_b").agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    vocab = labels_for(measure)
    grid = _grid(df.sparkSession, "label_a", vocab, "label_b", vocab)
    return grid.join(counts, ["label_a", "label_b"], "left").select(
        "label_a", "label_b", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def label_cross_cooccurrence(df: DataFrame, tech_col: str = "technique", vul_col: str = "vulnerability",
                             strict: bool = False) -> DataFrame:
    """A4: technique x vulnerability counts over rows where both lists are non-empty (repeats counted).

    Labels outside the vocabularies are treated as in A3.
    """
    both = df.filter((F.coalesce(F.col(tech_col), F.lit("")) != "") & (F.coalesce(F.col(vul_col), F.lit("")) != ""))
    ex = both.select(F.explode(_known(tech_col, "technique", strict)).alias("label_a"),
                     _known(vul_col, "vulnerability", strict).alias("_v"))
    ex = ex.select("label_a", F.explode("_v").alias("label_b"))
    counts = ex.groupBy("label_a", "label_b").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    grid = _grid(df.sparkSession, "label_a", labels_for("technique"), "label_b", labels_for("vulnerability"))
    return grid.join(counts, ["label_a", "label_b"], "left").select(
        "label_a", "label_b", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def token_stats(df: DataFrame, by="dataset", text_col: str = "dialogue", tags="person",
                extra: bool = False, rule: str = "runs") -> DataFrame:
    """A5: mean number of tokens per dialogue after removing speaker tags.

    ``tags`` is a tag style or list of tags for all corpora, or maps a corpus (value of ``by``) to its own; corpora
    that the map lacks keep their text.  ``extra`` adds min, max and approximate quartiles (one pass, mergeable sketches);
    ``rule`` is that of ``count_tokens``.
    """
    if isinstance(tags, Mapping):
        text = F.col(text_col)
        for name, own in tags.items():
            text = F.when(F.col(_by(by)[0]).eqNullSafe(F.lit(name)), T.strip_speakers(text_col, own)).otherwise(text)
    else:
        text = T.strip_speakers(text_col, tags) if tags else F.col(text_col)
    n = T.count_tokens(text, rule)
    aggs = [F.round(F.avg(n), ROUND).alias("mean")]
    if extra:
        aggs += [F.min(n).alias("min"), F.max(n).alias("max"),
                 F.percentile_approx(n, [0.25, 0.5, 0.75], 10000).alias("quartiles")]
    return df.groupBy(*_by(by)).agg(*aggs)


def turn_stats(df: DataFrame, by="dataset", text_col: str = "dialogue",
               constant: int | Mapping[str, int] | None = None) -> DataFrame:
    """Mean and sample standard deviation of lines per dialogue.

    ``constant``: a fixed count with stdev 0 instead, for every corpus or (as a map) for some corpora (values of ``by``).
    """
    fixed = F.lit(None).cast("double")
    if isinstance(constant, Mapping):
        for name, k in constant.items():
            fixed = F.when(F.col(_by(by)[0]).eqNullSafe(F.lit(name)), F.lit(float(k))).otherwise(fixed)
    elif constant is not None:
        fixed = F.lit(float(constant))
    n = T.count_lines(text_col)
    out = df.groupBy(*_by(by)).agg(F.round(F.avg(n), ROUND).alias("mean"), F.round(F.stddev_samp(n), ROUND).alias("stdev"))
    return out.select(*_by(by), F.coalesce(fixed, "mean").alias("mean"),
                      F.when(fixed.isNotNull(), F.lit(0.0)).otherwise(F.col("stdev")).alias("stdev"))


def ccdf(df: DataFrame, value: str | Column, by="dataset", method: str = "window") -> DataFrame:
    """CCDF points per distinct value.

    Sorted values v_0..v_{n-1} get 1 - i/n.  For a distinct value v:
    ``p_first`` = 1 - count(< v)/n (its first point), ``p_last`` =
    1 - (count(<= v) - 1)/n (its last point).  Work runs on the histogram of
    distinct values, never on the rows.  ``method='window'`` runs one window
    per group over that histogram (right for counts such as turns or tokens,
    whose distinct values are bounded by the longest dialogue);
    ``method='buckets'`` uses the exact bucketed running sums, for value
    columns with very many distinct values.
    """
    by = _by(by)
    v = F.col(value) if isinstance(value, str) else value
    hist = df.groupBy(*by, v.alias("value")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    if method == "window":
        before = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        lt = F.coalesce(F.sum("n").over(before), F.lit(0))
        out = hist.select(*by, "value", "n", lt.alias("_lt"), total.alias("_tot"))
    elif method == "buckets":
        from ..plans.ranking import null_safe_join, running_sums

        cum = running_sums(hist, "value", ["n"], partition_cols=by)
        totals = hist.groupBy(*by).agg(F.sum("n").alias("_tot"))  # one row per group
        out = null_safe_join(cum, totals, by) if by else cum.withColumn("_tot", hist.select(F.sum("n")).scalar())
        out = out.select(*by, "value", "n", F.col("n_below").alias("_lt"), "_tot")
    else:
        raise ValueError("method must be window or buckets")
    return out.select(
        *by, "value", "n",
        F.round(1 - F.col("_lt") / F.col("_tot"), ROUND).alias("p_first"),
        F.round(1 - (F.col("_lt") + F.col("n") - 1) / F.col("_tot"), ROUND).alias("p_last"),
    )


def emotion_distribution(df: DataFrame, emotion_col: str = "emotion", class_col: str = "class",
                         classes: Sequence[str] = ("1", "0")) -> DataFrame:
    """Emotion x class counts on the fixed emotion order; absent cells are 0."""
    counts = df.groupBy(F.col(emotion_col).alias("emotion"), F.col(class_col).alias("class")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))
    grid = _grid(df.sparkSession, "emotion", EMOTIONS, "class", list(classes))
    return grid.join(counts, ["emotion", "class"], "left").select(
        "emotion", "class", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def emotion_distribution_wide(df: DataFrame, emotion_col: str = "emotion", class_col: str = "class",
                              classes: Sequence[str] = ("1", "0")) -> DataFrame:
    """A8 (wide form): one row per emotion in the fixed order, one count column per class.

    The pivot values are given, so Spark needs no extra job to find them.
    """
    long = emotion_distribution(df, emotion_col, class_col, classes)
    wide = long.groupBy("emotion").pivot("class", list(classes)).agg(F.sum("n"))
    order = F.array_position(F.array(*[F.lit(e) for e in EMOTIONS]), F.col("emotion"))
    return wide.orderBy(order).select("emotion", *[F.col(f"`{c}`").cast("bigint").alias(c) for c in classes])


def emotion_counts(df: DataFrame, by="dataset", emotion_col: str = "emotion") -> DataFrame:
    """A8 (corpus form): plain emotion counts per corpus."""
    return df.groupBy(*_by(by), F.col(emotion_col).alias("emotion")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def split_label_share(df: DataFrame, tech_col: str = "technique", vul_col: str = "vulnerability",
                      split_col: str = "split", splits: Sequence[str] = ("train", "valid", "test")) -> DataFrame:
    """Label x split counts and the share of each split within a label.

    Rows with either list empty are left out; the label set is the set seen
    in the train split; absent (label, split) cells are 0.
    """
    both = df.filter((F.coalesce(F.col(tech_col), F.lit("")) != "") & (F.coalesce(F.col(vul_col), F.lit("")) != ""))
    ex = both.select(F.col(split_col).alias("split"),
                     F.explode(F.concat(split_labels(tech_col), split_labels(vul_col))).alias("label"))
    wide = ex.groupBy("label").agg(*[F.count_if(F.col("split") == s).cast("bigint").alias(f"_n{i}")
                                     for i, s in enumerate(splits)])
    total = sum(F.col(f"_n{i}") for i in range(len(splits)))
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"_n{i}").alias("n"))
                                for i, s in enumerate(splits)]))
    full = wide.filter("_n0 > 0").select("label", total.alias("_total"), cells.alias("c"))
    return full.select("label", "c.split", "c.n", F.round(F.col("c.n") / F.col("_total"), ROUND).alias("share"))
