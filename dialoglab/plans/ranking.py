"""Exact global ranks, cuts and running sums without a single-partition window.

A global ``row_number()`` over the whole input forces every row through one
task.  Samples and splits only need to know whether a row lies before a given
rank, so :func:`seeded_cuts` finds the *key at that rank* instead:

1. count rows per (group, bucket) of a repeatable key - a hash aggregate with
   map-side partials; the bucket is the key's first 4 hex digits (65,536);
2. running totals over the count table name the bucket that holds each rank;
3. only the keys of those buckets are ranked, which gives the boundary keys.

The caller compares each row's key with the boundary: a map-side expression,
so no row (and no text) moves.  :func:`exact_rank` numbers every row by the
same two-level scheme where the rank itself is wanted.  NULL groups and NULL
ids are values like any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# 16^4 = 65,536 buckets: at 10^11 rows that is ~1.5M rows per window task.
DEFAULT_HEX_DIGITS = 4


def seeded_key(id_col: str | Column, seed: int) -> Column:
    """Repeatable pseudo-random order key: ``md5('<seed>:<id>')``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def null_safe_join(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on equally named columns in which NULL matches NULL; ``right``'s copies are dropped."""
    names = {c: f"_ns_{c}" for c in cols}
    right = right.select(*[F.col(c).alias(names[c]) if c in names else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[names[c]])
    return left.join(right, cond, how).drop(*names.values())


#: Groups whose one row each is broadcast to the rows; operators take ``many_groups=True`` beyond that.
MAX_GROUPS = 4096


def join_groups(df: DataFrame, groups: DataFrame, by: Sequence[str], many_groups: bool = False) -> DataFrame:
    """``df`` with its group's row of ``groups`` (one row for each group, NULL being one).

    At most ``MAX_GROUPS`` rows are broadcast, so the rows of ``df`` stay where they are; more groups fail the query.  With ``many_groups`` the join is left to Spark, which shuffles both sides unless ``groups`` is small.
    """
    if many_groups:
        return null_safe_join(df, groups, by)
    few = groups.limit(MAX_GROUPS + 1).withColumn("_groups", F.count(F.lit(1)).over(Window.partitionBy()))  # over so many rows at most
    # the check is made on the side of the groups: a filter above an outer join would turn it into an inner one
    too_many = F.raise_error(F.lit(f"more than {MAX_GROUPS} groups: use many_groups=True")).cast("boolean")
    few = few.where(F.when(F.col("_groups") <= MAX_GROUPS, F.lit(True)).otherwise(too_many)).drop("_groups")
    return null_safe_join(df, F.broadcast(few), by)


def order_key(df: DataFrame, id_col: str, seed: int, tie_cols: Sequence[str] | None = None) -> Column:
    """A string without NULLs that orders rows like ``md5('<seed>:<id>')``.

    Rows without an id are keyed by a hash of the row; rows with the same id are
    ordered by that hash.  It covers ``tie_cols`` (default: all columns); give
    ``()`` for ids that are unique and never NULL, so that only the id is read.
    Rows that are equal in all of these are interchangeable and stay together.
    """
    cols = [c for c in (df.columns if tie_cols is None else tie_cols)]
    row = F.lpad(F.lower(F.hex(F.xxhash64(*[F.col(c) for c in cols]))), 16, "0") if cols else F.lit("")
    own = F.coalesce(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), F.concat(F.lit(f"{seed}:null:"), row))
    return F.concat(F.md5(own), row)


def seeded_cuts(keyed: DataFrame, key_col: str, ranks: dict[str, Column], partition_cols: Sequence[str] = (),
                hex_digits: int = DEFAULT_HEX_DIGITS, many_groups: bool = False) -> DataFrame:
    """One row per group (one row without groups): for each name in ``ranks`` the key at that rank.

    A rank is an expression over ``_n``, the number of rows of the group; ranks beyond it mean
    the last row, ranks below 1 give ``''``, which no key is below.
    """
    parts = list(partition_cols)
    b = keyed.select(*parts, F.col(key_col).alias("_k"), F.substring(F.col(key_col), 1, hex_digits).alias("_bkt"))
    counts = b.groupBy(*parts, "_bkt").agg(F.count(F.lit(1)).alias("_bn"))
    w = Window.partitionBy(*parts)
    run = counts.select(*parts, "_bkt", "_bn", F.sum("_bn").over(w).alias("_n"),
                        F.sum("_bn").over(w.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"))
    cuts = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.least(r.cast("bigint"), F.col("_n")).alias("rank"))
                               for k, r in ranks.items()]))
    edge = run.select(*parts, "_bkt", "_bn", "_upto", cuts.alias("_c")).filter(
        (F.col("_c.rank") > F.col("_upto") - F.col("_bn")) & (F.col("_c.rank") <= F.col("_upto")))
    edge = edge.select(*parts, "_bkt", F.col("_c.name").alias("_name"),
                       (F.col("_c.rank") - F.col("_upto") + F.col("_bn")).alias("_want"))
    if not parts:
        edge = F.broadcast(edge)  # one row for each rank asked for
    elif not many_groups:  # one for each group and rank; join_groups fails where there are more
        edge = F.broadcast(edge.limit((MAX_GROUPS + 1) * len(ranks)))
    inside = null_safe_join(b, edge, [*parts, "_bkt"])
    nth = F.row_number().over(Window.partitionBy(*parts, "_name").orderBy("_k"))
    at = inside.withColumn("_i", nth).filter(F.col("_i") == F.col("_want"))
    return at.groupBy(*parts).agg(*[F.coalesce(F.max(F.when(F.col("_name") == k, F.col("_k"))), F.lit("")).alias(k)
                                    for k in ranks])


def exact_rank(
    df: DataFrame,
    order_cols: Sequence[Column | str],
    bucket: Column,
    partition_cols: Sequence[str] = (),
    rank_col: str = "_rank",
    total_col: str | None = "_group_n",
    max_buckets: int | None = 16**DEFAULT_HEX_DIGITS,
) -> DataFrame:
    """Append a 1-based rank (and optionally the group size) to ``df``.

    ``bucket`` must be non-decreasing in ``order_cols`` within a group.
    ``max_buckets`` is the proven upper bound of distinct bucket values; when
    given and there is no grouping, the offset table (<= max_buckets rows) is
    broadcast.  With grouping columns the join is left to AQE, which only
    broadcasts after checking the runtime size.
    """
    parts = list(partition_cols)
    b = df.withColumn("_bkt", bucket)
    counts = b.groupBy(*parts, "_bkt").agg(F.count(F.lit(1)).alias("_bn"))
    before = Window.partitionBy(*parts).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    cols = [*parts, "_bkt", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off")]
    if total_col:
        cols.append(F.sum("_bn").over(Window.partitionBy(*parts)).alias(total_col))
    offsets = counts.select(*cols)
    if not parts and max_buckets is not None:
        offsets = F.broadcast(offsets)
    joined = null_safe_join(b, offsets, [*parts, "_bkt"])
    inner = Window.partitionBy(*parts, "_bkt").orderBy(*order_cols)
    return joined.withColumn(rank_col, F.col("_off") + F.row_number().over(inner)).drop("_bkt", "_off")


def hash_bucket(key: Column, hex_digits: int = DEFAULT_HEX_DIGITS) -> Column:
    return F.substring(key, 1, hex_digits)


def seeded_rank(
    df: DataFrame,
    id_col: str,
    seed: int,
    partition_cols: Sequence[str] = (),
    rank_col: str = "_rank",
    total_col: str | None = "_group_n",
    hex_digits: int = DEFAULT_HEX_DIGITS,
) -> DataFrame:
    """Rank rows by ``md5(seed:id)`` (NULL ids and ties by a hash of the row) inside each group - the seeded shuffle."""
    keyed = df.withColumn("_key", order_key(df, id_col, seed))
    out = exact_rank(
        keyed,
        [F.col("_key"), F.col(id_col)],
        hash_bucket(F.col("_key"), hex_digits),
        partition_cols,
        rank_col,
        total_col,
        max_buckets=16**hex_digits,
    )
    return out.drop("_key")


def quantile_bucket(value: Column, bounds: Column) -> Column:
    """Number of bounds strictly below ``value`` - monotone in ``value``.

    Wrapped in ``coalesce`` so that the optimizer does not infer a NOT NULL
    filter on it and push the bound search below the aggregation.
    """
    return F.coalesce(F.size(F.filter(bounds, lambda b: b < value)), F.lit(0))


def two_level_bucket(value: Column, bounds: Column, coarse: Column, step: int) -> Column:
    """``quantile_bucket`` with about ``2 * step`` comparisons instead of ``size(bounds)``.

    ``coarse[k]`` is ``bounds[(k+1)*step]`` (1-based).  If ``c`` coarse bounds are
    below ``value``, the first ``c*step`` bounds are below it too (the array is
    sorted), and only the next ``step`` bounds need a look.
    """
    c = F.coalesce(F.size(F.filter(coarse, lambda b: b < value)), F.lit(0))
    segment = F.slice(bounds, c * step + 1, F.lit(step))
    return c * step + F.coalesce(F.size(F.filter(segment, lambda b: b < value)), F.lit(0))


def running_sums(
    hist: DataFrame,
    value_col: str,
    sum_cols: Sequence[str],
    n_buckets: int = 1024,
    partition_cols: Sequence[str] = (),
) -> DataFrame:
    """Exact cumulative sums of ``sum_cols`` over ascending ``value_col`` (per group).

    ``hist`` should already hold one row per (group, distinct value).  Adds
    ``<c>_below`` (sum over strictly smaller values in the same group) for
    every ``c``.  The bucket bounds are approximate quantiles of all values,
    computed as a scalar subquery (an array of ``n_buckets - 1`` numbers), so
    buckets stay balanced whatever the value distribution; results are exact
    because the running offset of each (group, bucket) is summed from the
    true per-bucket totals.  The offset window runs over at most
    groups x ``n_buckets`` rows; without groups that table is broadcast.
    """
    from ..session import checkpoint_dir

    parts = list(partition_cols)
    # the histogram feeds three branches (bounds, bucket totals, rows): write it
    # once to the shared checkpoint folder instead of recomputing it from the data
    checkpoint_dir(hist.sparkSession)
    hist = hist.checkpoint(eager=True)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    step = max(1, math.isqrt(n_buckets))
    # bounds and every step-th bound, computed once inside the scalar subquery
    q = hist.select(F.percentile_approx(F.col(value_col).cast("double"), probs, 10000).alias("b"))
    n_coarse = (n_buckets - 1) // step
    q = q.select(F.struct("b", F.transform(F.sequence(F.lit(1), F.lit(max(n_coarse, 1))),
                                           lambda k: F.element_at("b", k * step)).alias("c")).alias("bc"))
    if n_coarse == 0:
        q = q.select(F.struct(F.col("bc.b").alias("b"), F.array().cast("array<double>").alias("c")).alias("bc"))
    b = hist.withColumn("_bc", q.scalar())
    v = F.col(value_col).cast("double")
    b = b.withColumn("_bkt", two_level_bucket(v, F.col("_bc.b"), F.col("_bc.c"), step)).drop("_bc")
    totals = b.groupBy(*parts, "_bkt").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    before = Window.partitionBy(*parts).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *parts, "_bkt", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sum_cols]
    )
    if not parts:
        offsets = F.broadcast(offsets)  # <= n_buckets rows
    joined = null_safe_join(b, offsets, [*parts, "_bkt"])
    inner = Window.partitionBy(*parts, "_bkt").orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
    out = joined
    for c in sum_cols:
        out = out.withColumn(f"{c}_below", F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(inner), F.lit(0)))
    return out.drop("_bkt", *[f"_o_{c}" for c in sum_cols])
