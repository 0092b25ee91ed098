"""How far annotators can be relied on: chance-corrected agreement, and gold labels weighted by reliability.

Both take the wide annotation table of three column groups (see :mod:`dialoglab.operators.annotators`); a blank vote is a missing
cell.  Agreement is one aggregate over the rows.  Reliability is estimated over *patterns*, the distinct combinations of
(annotator, vote) with their counts, which are far fewer than dialogues; each round reads the patterns once and gives
the driver one row for each annotator.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import split_labels
from ..session import checkpoint_dir
from .annotators import K

#: Annotators that the driver holds rates for.
MAX_ANNOTATORS = 100_000
#: Distinct label sets that the expected disagreement compares (all sets over 11 labels are 2,048).
MAX_SETS = 4096


def alpha(df: DataFrame, measure: str = "manipulative") -> DataFrame:
    """Krippendorff's alpha, one row ``(n_units, n_votes, observed, expected, alpha)``.

    Disagreement is 0 or 1 for ``manipulative`` and the Jaccard distance of the label sets for ``technique`` and ``vulnerability``
    (there an empty list of an annotator who voted is the empty set).  Votes of dialogues with fewer than two are left out.
    Without any expected disagreement (one value throughout) alpha is NULL.
    """
    voted = [F.col(f"manipulative_{k}").isin("0", "1") for k in K]
    if measure == "manipulative":
        cells = [F.array(F.col(f"manipulative_{k}")) for k in K]
    else:
        cells = [F.array_sort(F.array_distinct(split_labels(f"{measure}_{k}"))) for k in K]
    votes = F.filter(F.array(*[F.when(v, c) for v, c in zip(voted, cells, strict=True)]), lambda x: x.isNotNull())
    units = df.select(votes.alias("v")).where(F.size("v") >= 2)
    # an ordered pair of votes of a unit with m votes weighs 1 / (m - 1)
    pairs = F.aggregate("v", F.lit(0.0), lambda acc, a: F.aggregate("v", acc, lambda inner, b: inner + _distance(a, b)))
    # at most one row for each set of labels
    sets = units.select(F.explode("v").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    few = sets.limit(MAX_SETS + 1).agg(F.collect_list(F.struct("s", "n")).alias("all"))
    every = few.select(F.when(F.size("all") <= MAX_SETS, F.col("all")).otherwise(
        F.raise_error(F.lit(f"more than {MAX_SETS} label sets")))).scalar()
    chance = sets.withColumn("all", every).select(
        "n", (F.col("n") * F.aggregate("all", F.lit(0.0), lambda acc, x: acc + x["n"] * _distance(F.col("s"), x["s"]))).alias("e"))
    expected = chance.agg(F.sum("e").alias("e"), F.sum("n").alias("n")).select(F.struct("e", "n")).scalar()
    out = units.agg(F.count(F.lit(1)).alias("n_units"), F.sum(pairs / (F.size("v") - 1)).alias("o")).withColumn("c", expected)
    n = F.col("c.n")
    observed, by_chance = F.col("o") / n, F.col("c.e") / n / (n - 1)
    return out.select("n_units", F.coalesce(n, F.lit(0)).cast("bigint").alias("n_votes"), F.round(observed, 6).alias("observed"),
                      F.round(by_chance, 6).alias("expected"), F.round(F.when(by_chance > 0, 1 - observed / by_chance), 6).alias("alpha"))


def _distance(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def _votes() -> Column:
    """The row's (annotator, vote) pairs in order; blank votes and unnamed annotators are left out."""
    cell = lambda k: F.when(F.col(f"manipulative_{k}").isin("0", "1") & F.col(f"annotator_{k}").isNotNull(), F.struct(
        F.col(f"annotator_{k}").alias("a"), F.col(f"manipulative_{k}").cast("int").alias("v")))
    return F.array_sort(F.array_compact(F.array(*[cell(k) for k in K])))


def estimate_rates(df: DataFrame, rounds: int = 50, tol: float = 1e-7) -> tuple[float, dict[str, tuple[float, float, int]]]:
    """EM over the votes: the share of positives, and for each annotator the rate of right votes on positives and on negatives.

    The first posterior is the share of positive votes; a rate has one right and one wrong vote added, so that none is 0 or 1.
    Returns (share, {annotator: (sensitivity, specificity, votes)}).
    """
    checkpoint_dir(df.sparkSession)
    patterns = df.select(_votes().alias("votes")).where(F.size("votes") > 0).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    positives = F.aggregate("votes", F.lit(0.0), lambda acc, x: acc + x["v"])
    each = patterns.withColumn("p", positives / F.size("votes"))
    share, rates = 0.5, {}
    for _ in range(rounds):
        cells = each.select(F.explode("votes").alias("x"), "n", "p").groupBy("x.a").agg(
            F.sum(F.col("n") * F.col("p")).alias("pos"), F.sum(F.col("n") * F.col("p") * F.col("x.v")).alias("hit"),
            F.sum(F.col("n") * (1 - F.col("p"))).alias("neg"), F.sum(F.col("n") * (1 - F.col("p")) * (1 - F.col("x.v"))).alias("right"),
            F.sum("n").alias("n"))
        rows = cells.orderBy("a").limit(MAX_ANNOTATORS + 1).collect()  # one for each annotator
        if len(rows) > MAX_ANNOTATORS:
            raise ValueError(f"more than {MAX_ANNOTATORS} annotators")
        total = each.agg(F.sum(F.col("n") * F.col("p")).alias("p"), F.sum("n").alias("n")).first()
        if not rows:
            return share, {}
        old, share = share, (total.p + 1) / (total.n + 2)
        before, rates = rates, {r.a: ((r.hit + 1) / (r.pos + 2), (r.right + 1) / (r.neg + 2), r.n) for r in rows}
        each = with_probability(patterns, share, rates)
        if before and abs(share - old) < tol and all(abs(x - y) < tol for a, r in rates.items() for x, y in zip(r[:2], before[a][:2], strict=True)):
            break
    return share, rates


def with_probability(rows: DataFrame, share: float, rates: dict[str, tuple[float, float, int]]) -> DataFrame:
    """``p``: the posterior of a positive label from the row's ``votes``; annotators without rates say nothing."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(a, [[math.log(1 - s), math.log(s)], [math.log(t), math.log(1 - t)]]) for a, (s, t, _) in rates.items()],
                                  "a string, l array<array<double>>")
    # one entry for each annotator, evaluated once
    placed = rows.withColumn("_logs", table.agg(F.map_from_entries(F.collect_list(F.struct("a", "l")))).scalar())
    say = lambda acc, x, side: acc + F.coalesce(F.get(F.get(F.try_element_at("_logs", x["a"]), F.lit(side)), x["v"]), F.lit(0.0))
    pos = F.aggregate("votes", F.lit(math.log(share)), lambda acc, x: say(acc, x, 0))
    neg = F.aggregate("votes", F.lit(math.log(1 - share)), lambda acc, x: say(acc, x, 1))
    return placed.withColumn("p", 1 / (1 + F.exp(neg - pos))).drop("_logs")


def annotator_reliability(df: DataFrame, rounds: int = 50) -> DataFrame:
    """``(annotator, n_votes, sensitivity, specificity)`` of every annotator, by EM."""
    _, rates = estimate_rates(df, rounds)
    rows = [(a, n, round(s, 6), round(t, 6)) for a, (s, t, n) in rates.items()]
    return df.sparkSession.createDataFrame(rows, "annotator string, n_votes bigint, sensitivity double, specificity double")


def reliable_labels(df: DataFrame, id_col: str = "id", rounds: int = 50) -> DataFrame:
    """G3 with annotators weighted by reliability: ``(id, manipulative, probability)``; without votes the probability is NULL.

    The rates come from :func:`estimate_rates`; each row's probability follows from its own votes, where it is.
    """
    share, rates = estimate_rates(df, rounds)
    rows = df.select(F.col(id_col).alias("id"), _votes().alias("votes"))
    out = with_probability(rows, share, rates).select("id", F.when(F.size("votes") > 0, F.col("p")).alias("p"))
    return out.select("id", F.when(F.col("p") >= 0.5, "1").when(F.col("p").isNotNull(), "0").alias("manipulative"),
                      F.round("p", 6).alias("probability"))
