"""Splits and samples with exact, repeatable sizes.

Rows are ordered by ``md5('<seed>:<id>')``.  :func:`~dialoglab.plans.ranking.seeded_cuts`
finds the keys at the ranks where a sample or split ends; each row is then
compared with them where it is, so neither rows nor texts are shuffled: the cuts of up to
``MAX_GROUPS`` groups are broadcast, and more need ``many_groups=True``, which shuffles rows.  The
sizes follow the Python conventions of the original scripts (``int(r * n)`` for
splits, ``ceil(r * n)`` for a hold-out test set), computed in DOUBLE exactly
like Python does.  Results do not depend on the input partitioning.

NULL ids and NULL groups count like any other value.  Rows with the same id are told
apart by a hash of the row; rows that are equal in every column stay together.
``tie_cols=()`` promises unique ids that are never NULL: then the cuts read the
id column alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import join_groups, order_key, seeded_cuts


def _cut(df: DataFrame, id_col: str, seed: int, ranks: dict, tie_cols: Sequence[str] | None) -> DataFrame:
    """``df`` with its key ``_k`` and the boundary keys of the whole table as columns."""
    keyed = df.withColumn("_k", order_key(df, id_col, seed, tie_cols))
    cuts = seeded_cuts(keyed, "_k", ranks)
    bounds = cuts.select(F.struct(*ranks).alias("c")).scalar()
    return keyed.withColumn("_cuts", bounds)


def split_exact(
    df: DataFrame,
    ratios: Sequence[float] = (0.6, 0.2, 0.2),
    seed: int = 17,
    id_col: str = "id",
    names: Sequence[str] = ("train", "valid", "test"),
    tie_cols: Sequence[str] | None = None,
) -> DataFrame:
    """Seeded shuffle, then the first ``int(r0*n)`` rows, the next ``int(r1*n)``, the rest."""
    n = F.col("_n").cast("double")
    cut1 = F.floor(n * F.lit(float(ratios[0])))
    cut2 = cut1 + F.floor(n * F.lit(float(ratios[1])))
    out = _cut(df, id_col, seed, {"a": cut1, "b": cut2}, tie_cols)
    split = (
        F.when(F.col("_k") <= F.col("_cuts.a"), F.lit(names[0]))
        .when(F.col("_k") <= F.col("_cuts.b"), F.lit(names[1]))
        .otherwise(F.lit(names[2]))
    )
    return out.withColumn("split", split).drop("_k", "_cuts")


def sample_cap(df: DataFrame, n: int = 5000, seed: int = 42, id_col: str = "id",
               tie_cols: Sequence[str] | None = None) -> DataFrame:
    """R2: if there are at least ``n`` rows keep exactly ``n`` of them (seeded), else all."""
    out = _cut(df, id_col, seed, {"a": F.lit(n)}, tie_cols)
    return out.filter(F.col("_k") <= F.col("_cuts.a")).drop("_k", "_cuts")


def holdout(df: DataFrame, test_size: float = 0.2, seed: int = 42, id_col: str = "id",
            tie_cols: Sequence[str] | None = None) -> DataFrame:
    """Seeded hold-out; the test part has ``ceil(test_size * n)`` rows."""
    out = _cut(df, id_col, seed, {"a": F.ceil(F.col("_n").cast("double") * F.lit(float(test_size)))}, tie_cols)
    return out.withColumn("split", F.when(F.col("_k") <= F.col("_cuts.a"), F.lit("test")).otherwise(F.lit("train"))
                          ).drop("_k", "_cuts")


def _first_of_groups(df: DataFrame, by: list[str], rank, seed: int, id_col: str,
                     tie_cols: Sequence[str] | None, many_groups: bool) -> DataFrame:
    """The rows of each group up to ``rank``; the cuts (one row per group) are brought to the rows."""
    keyed = df.withColumn("_k", order_key(df, id_col, seed, tie_cols))
    cuts = seeded_cuts(keyed, "_k", {"_cut": rank}, by, many_groups=many_groups)
    return join_groups(keyed, cuts, by, many_groups).filter(F.col("_k") <= F.col("_cut")).drop("_cut")


def balance_classes(df: DataFrame, label_col: str, seed: int = 0, id_col: str = "id",
                    tie_cols: Sequence[str] | None = None, many_groups: bool = False) -> DataFrame:
    """Every class (NULL is one) sampled down to the size of the smallest class, without replacement."""
    smallest = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).select(F.min("n")).scalar()
    return _first_of_groups(df, [label_col], smallest, seed, id_col, tie_cols, many_groups).drop("_k").select(*df.columns)


def sample_per_group(df: DataFrame, by: str | Sequence[str], n: int = 500, seed: int = 11,
                     id_col: str = "id", tie_cols: Sequence[str] | None = None, many_groups: bool = False) -> DataFrame:
    """Exactly ``n`` rows per group (all rows of a smaller group)."""
    by = [by] if isinstance(by, str) else list(by)
    return _first_of_groups(df, by, F.lit(n), seed, id_col, tie_cols, many_groups).select(*df.columns)


def select_examples(
    train: DataFrame,
    label_col: str | None = "manipulative",
    k_by_class: Mapping[str, int] | int = None,
    seed: int = 0,
    id_col: str = "id",
    tie_cols: Sequence[str] | None = None,
    many_groups: bool = False,
) -> DataFrame:
    """Few-shot examples - ``k`` rows per class (or ``k`` rows of any class), never more.

    Adds ``example_no`` (1-based order inside the class), used to order the
    examples in prompts.  Only the rows up to the cuts (about k of them) are
    numbered; they carry their own text, nothing is joined back by id.
    """
    if k_by_class is None:
        k_by_class = {"1": 2, "0": 1}
    if label_col is None:  # k rows of any class
        k = k_by_class if isinstance(k_by_class, int) else sum(k_by_class.values())
        out = _cut(train, id_col, seed, {"a": F.lit(k)}, tie_cols)
        near, limit, order = out.filter(F.col("_k") <= F.col("_cuts.a")).drop("_cuts"), F.lit(k), Window.partitionBy()
    else:
        if isinstance(k_by_class, int):  # the same k for every class
            limit = F.lit(k_by_class)
        else:
            kmap = F.create_map(*[x for c, k in k_by_class.items() for x in (F.lit(str(c)), F.lit(int(k)))])
            limit = F.coalesce(F.try_element_at(kmap, F.col(label_col).cast("string")), F.lit(0))
        near = _first_of_groups(train, [label_col], limit, seed, id_col, tie_cols, many_groups)
        order = Window.partitionBy(label_col)
    near = near.withColumn("example_no", F.row_number().over(order.orderBy("_k")))
    return near.filter(F.col("example_no") <= limit).drop("_k").select(*train.columns, "example_no")
