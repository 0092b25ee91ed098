"""The registered queries: names, columns, and their SQL."""

import duckdb
import pytest
from conftest import SF_SMALL

import __spark_entry__ as entry
from dialoglab.llm.queries import ORACLE, QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= entry.queries().keys() and ORACLE.keys() <= entry.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, SF_SMALL)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    want = con.sql(ORACLE[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name,first", [("op1_kd_tree_sharding", ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]),
                                        ("op4_license_paragraph_classifier", ["doc_id", "n_paragraphs"]),
                                        ("op10_hypergeometric_mixing", ["doc_id", "size", "source_size", "target", "taken"])])
def test_columns_and_rows(spark, name, first):
    out = QUERIES[name](spark, SF_SMALL)
    assert out.columns[: len(first)] == first and out.count() == 200
