"""Fixtures: rows with everything that can go wrong, an empty table, the smallest driver table."""

import pytest
from conftest import SF_SMALL
from pyspark.sql import types as T

#: Columns whose names the operators use for results or inside.
CLASHING = ["size", "shard", "kept", "n", "h", "name", "node", "block", "run", "digest", "ids", "target", "draws", "s_target", "n_words"]

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in CLASHING],
])


def _rows():
    prose = ("The quick brown fox jumps over the lazy dog while seven small birds sing a long and merry song about "
             "rivers that run from the hills down to the wide and quiet sea")
    near = prose.replace("merry", "sad")
    other = "Alle meine Entchen schwimmen auf dem See, Köpfchen in das Wasser, Schwänzchen in die Höh und so fort bis morgen"
    texts = [
        prose, prose, prose + " ", prose.replace(" ", "\n"), near, near.upper(), prose + "\nshared line\n" + other,
        other, other + "\nshared line", other.replace("See", "Meer"), "", None, None, " \t\n\x0b\x0c\r ", "a", "a", "a b", "A  B", "b a",
        "x" * 3000, "word " * 400, "é漢🙂 ½    ﬁ \x00 ▁ <|endoftext|> <s>", "### *** $$$ %%% one two three four five six seven eight",
        "one two three four five six seven eight nine ten ### ||| ||| ||| ###", "line\n" * 30 + prose, "\n".join(f"Row {i} of many" for i in range(200)),
        "Released under the MIT License.\n" + prose, prose + "\nLICENSED UNDER THE APACHE LICENSE, VERSION 2.0", "He lost his driving license.",
    ]
    texts += [f"{prose} and number {i}\nshared line\n  SHARED LINE  " for i in range(12)]
    langs, sources = ["en", "de", None], ["s1", "s10", "s2", None, "zero"]
    rows = [(i, t, langs[i % 3], sources[i % 4]) for i, t in enumerate(texts)]
    rows += [(None, prose, "en", "s1"), (None, "no id here at all, none", None, None), (3, texts[3], "en", "s1"), (3, "same id, other text", "en", "s1")]
    rows += [rows[7], rows[7]]  # repeated rows
    rows += [(100, "", "en", "zero"), (101, None, "en", "zero")]
    return [(*r, None if r[1] is None else len(r[1]), *["clash"] * len(CLASHING)) for r in rows]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")
