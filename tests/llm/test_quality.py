"""The thresholds of the quality rules adapt to each source."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from dialoglab.llm import quality


def limits(docs):
    measured = docs.select("lang", "source", quality.text_stats("text").alias("__q"))
    rows = quality.thresholds(quality.sketches(measured, "__q")).collect()
    return {(r["__lang"], r["__source"]): r["__limits"].asDict() for r in rows}


def test_floors_decide_in_few_groups(spark):
    found = limits(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert len(found) == 80
    for name, (kind, _, _, _, floor, _) in quality.RULES.items():
        high = [x[f"{name}_high"] for x in found.values()]
        floored = [abs(h - floor) < 1e-12 for h in high] if kind != "range" else [
            x[f"{name}_high"] - x[f"{name}_low"] < 2 * floor + 1e-9 + 0.01 for x in found.values()]
        assert sum(floored) < 0.1 * len(found), name
    assert len({round(x["symbols_per_word_high"], 6) for x in found.values()}) > 20
    assert len({round(x["chars_per_word_high"], 6) for x in found.values()}) > 20


def corpus(spark):
    """Long plain prose in one source, short marked-up lines in another, a third that is mostly junk."""
    words = "the river runs down from hills to sea and back with small boats on it".split()
    prose = lambda n, k: " ".join(words[(i * k) % len(words)] + str(random.Random(k * 1000 + i).randrange(50)) for i in range(n))
    rows = [(i, prose(400 + i, i + 2), "en", "books") for i in range(120)]
    rows += [(1000 + i, prose(25, i + 2) + (" # | <b>" if i % 2 else ""), "en", "wiki") for i in range(120)]
    rows += [(2000 + i, prose(40, i + 2).replace(" ", "### ") if i % 5 else prose(60, i + 2), "en", "spam") for i in range(100)]
    rows += [(3000 + i, prose(300, i + 9), "de", "books") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), rows


def test_sources_differ_and_junk_is_bounded_by_the_language(spark):
    docs, rows = corpus(spark)
    found = limits(docs)
    high = {k[1]: v["symbols_per_word_high"] for k, v in found.items() if k[0] == "en"}
    assert high["books"] < high["wiki"] / 2
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept >= {r[0] for r in rows if r[3] != "spam"}
    assert not kept & {r[0] for r in rows if r[3] == "spam" and "###" in r[1]}
    assert kept >= {r[0] for r in rows if r[3] == "spam" and "###" not in r[1]}


def test_small_corpus_against_the_plain_version(spark):
    docs, rows = corpus(spark)
    want = brute.quality([r for r in rows], quality.RULES, quality.SKETCH_ERROR, quality.MIN_GROUP)
    got = {r.doc_id: r.kept for r in quality.quality_report(docs).collect()}
    assert got == {w[0]: w[-1] for w in want}


def test_repeated_lines_have_limits_of_their_own(spark):
    """Where many documents repeat lines, more of it is ordinary; far more is not."""
    line = lambda i: " ".join(str(random.Random(i * 9 + j).randrange(10**6)) for j in range(6))
    body = [[line(1000 * d + i) for i in range(30)] for d in range(100)]
    rows = [(d, "\n".join(x + [f"end {d}"] * (1 + d % 4)), "en", "lists") for d, x in enumerate(body)]
    rows += [(500 + d, "\n".join(x), "en", "prose") for d, x in enumerate(body)]
    rows.append((900, "\n".join(x + "\nagain" for x in body[0][:12]), "en", "prose"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = limits(docs)
    assert found["en", "lists"]["repeated_lines_high"] == pytest.approx(0.3, abs=0.1)
    report = quality.quality_report(docs).where(~F.col("base_failed")).collect()
    assert [r.doc_id for r in report if not r.kept] == [900] and len(report) == 201
