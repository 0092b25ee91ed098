"""Every registered query against its DuckDB oracle (the driver's check, on sf0.001)."""

import math

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from dialoglab.plans.catalog import QUERIES
from dialoglab.plans.oracle import ORACLE


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle_or_is_a_model():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only == {"train_binary", "train_multilabel", "train_epochs", "best_training_run", "project_2d", "project_neighbours",
                         "match_key_phrases_lemmas", "annotator_reliability", "truncate_pieces", "truncate_model_tokens"}
    assert set(ORACLE) <= set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rel = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    want = _rows(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    assert got == want


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["model", "setting", "precision", "recall", "accuracy", "micro_f1", "macro_f1"]
    assert len(rows) == 4
