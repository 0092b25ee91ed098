"""Writers (S7) and the fixture files the source round trips use.

Files go under the cluster's shared checkpoint folder (see
:func:`dialoglab.session.scratch_path`), never a machine-local temp folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def write_results(df: DataFrame, path: str, fmt: str = "csv", partition_by: str | Sequence[str] | None = "dataset",
                  mode: str = "overwrite") -> str:
    """Write a result table as CSV (with header), JSON lines or parquet, one folder per dataset."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        (w.option("header", True).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError("fmt must be csv, json or parquet")
    return path


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> str:
    """CSV the way Python's ``csv`` module writes it: doubled quotes, quoted newlines."""
    (df.write.mode("overwrite").option("header", header).option("sep", sep).option("quote", '"')
     .option("escape", '"').option("emptyValue", '""').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_threads(turns: DataFrame, path: str, id_col: str, turn_col: str, text_col: str, with_id: bool = True) -> str:
    """Group turns into ``{"id":..., <THREAD_FIELD>:[{"text":...}, ...]}`` JSON lines (``with_id=False``: the posts alone)."""
    from .readers import THREAD_FIELD

    g = turns.groupBy(F.col(id_col).cast("string").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("t"), F.col(text_col).alias("text")))),
                    lambda x: F.struct(x["text"].alias("text"))).alias(THREAD_FIELD))
    (g if with_id else g.drop("id")).write.mode("overwrite").json(path)
    return path


def new_path(df: DataFrame, name: str) -> str:
    return scratch_path(df.sparkSession, name)
