"""Quality rules with adaptive thresholds (one mergeable quantile sketch per language and source).

Fixed rules (``base_failed``): fewer than 10 words, or over a fifth of the words in repeated 5-word windows.
The rest is judged against its own (lang, source): quantiles of each measure come from a log-bucket sketch
(relative error 1 %), whose bucket counts simply add up, so the sketch of a language is the sum of its sources'
and the result never depends on partitioning.  ``RULES`` names how a limit follows from the quantiles:

* ``times``: reach times an upper quantile.  Symbols are counted with one more symbol and 20 more words, so that the measure isn't 0 for
  almost all documents: the limit then follows the lengths of a source's documents, and a short one without symbols stays;
* ``range``: two quantiles, widened by reach times their difference;
* ``positive``: reach times an upper quantile of the documents in which the measure isn't 0, as repeated lines are rare in most
  sources; sources with fewer than ``MIN_POSITIVE`` of them take their language's.

A floor keeps sources without any spread from rejecting ordinary documents.  Where a group is mostly junk its quantiles are junk, so a
group's limits reach no further than ``cap`` times its language's, and a language's than ``cap`` times those of all.

Defined cases: NULL or empty text has no words and fails the base rules; NULL lang or source is a group of its
own; groups with fewer than ``min_group`` documents use their language's sketch, small languages the sketch of
all; repeated rows are judged one by one and alike; an empty table gives an empty result; other columns of
``docs`` are kept by ``keep_good`` and never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Words, chunks, null_safe, stage_table, utf8

MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
#: Half the ratio between two bucket borders of the sketch, less 1.
SKETCH_ERROR = 0.01
MIN_GROUP = 50
MIN_POSITIVE = 20
#: measure: kind, lower and upper quantile in percent, reach, floor (of the limit, or of the room beside a range), cap
RULES = {
    "symbols_per_word": ("times", None, 75, 8.0, 0.04, 2.0),
    "chars_per_word": ("range", 10, 90, 6.0, 1.0, 1.5),
    "repeated_lines": ("positive", None, 90, 3.0, 0.3, 1.5),
}

_STATS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_lines:bigint,n_dup_lines:bigint,n_repeat_words:bigint>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True


def _chunk_stats(texts: list[bytes]) -> list[np.ndarray]:
    w = Words(texts, lower=False)
    chars = w.per_text(w.word_bytes & ((w.buf & 0xC0) != 0x80))
    symbols = w.per_text(_IS_SYMBOL[w.buf])
    lines, dups = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    space = SPACE.encode()
    for i, t in enumerate(texts):
        own = [x for x in t.split(b"\n") if x.strip(space)]
        lines[i], dups[i] = len(own), len(own) - len(set(own))
    covered = np.zeros(len(w.hashes) + 1, np.int64)
    grams, at = w.grams(5)
    if len(grams):
        with np.errstate(over="ignore"):  # windows of different texts must not meet
            keyed = grams + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(keyed, kind="stable")
        same = keyed[order][1:] == keyed[order][:-1]
        twice = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 5, -1)
    repeated = np.cumsum(covered)[:-1] > 0
    n_rep = np.bincount(w.doc[repeated], minlength=len(texts))
    return [w.counts, chars, symbols, lines, dups, n_rep]


def _stats(column: pa.Array) -> pa.Array:
    texts = utf8(column)
    parts = [_chunk_stats(texts[a:b]) for a, b in chunks(texts, 1 << 19)]
    names = [x.split(":")[0] for x in _STATS[7:-1].split(",")]
    arrays = [pa.array(np.concatenate([p[i] for p in parts]) if parts else [], pa.int64()) for i in range(len(names))]
    return pa.StructArray.from_arrays(arrays, names)


def text_stats(text: Column | str) -> Column:
    """The counts of a text as a struct (see ``_STATS``), Arrow batch by Arrow batch."""

    def stats(column: pa.Array) -> pa.Array:
        return _stats(column)

    # "nondeterministic" keeps the optimizer from evaluating it once more in a filter
    return F.arrow_udf(stats, _STATS).asNondeterministic()(text)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])


def _measures(s: Column) -> dict[str, Column]:
    words, lines = F.greatest(s["n_words"], F.lit(1)), F.greatest(s["n_lines"], F.lit(1))
    return {
        "symbols_per_word": (s["n_symbols"] + 1) / (s["n_words"] + 20),
        "chars_per_word": s["word_chars"] / words,
        "repeated_lines": s["n_dup_lines"] / lines,
    }


_GAMMA = math.log((1 + SKETCH_ERROR) / (1 - SKETCH_ERROR))
_NONE = -(1 << 30)  # bucket of 0


def sketches(measured: DataFrame, stats: str) -> DataFrame:
    """(lang, source, measure, bucket, n) of the documents that pass the base rules."""
    good = measured.filter(~base_failed(F.col(stats)))
    each = F.explode(F.array(*[
        F.struct(F.lit(k).alias("measure"),
                 F.when(v > 0, F.ceil(F.log(v) / _GAMMA).cast("int")).otherwise(F.lit(_NONE)).alias("bucket"))
        for k, v in _measures(F.col(stats)).items()
    ]))
    return (good.select("lang", "source", each.alias("m")).select("lang", "source", "m.*")
            .groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n")))


def _limits(sketch: DataFrame, by: list[str], at: str) -> DataFrame:
    """Per group: ``at`` = struct(n, <measure>_low, <measure>_high ...) from the merged sketch; NULL where it says too little."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "measure")  # a few thousand buckets at most
    zero = F.coalesce(F.sum(F.when(F.col("bucket") == _NONE, F.col("n"))).over(w), F.lit(0))
    run = merged.select(*by, "measure", "bucket", F.sum("n").over(w).alias("all"), zero.alias("zero"),
                        F.sum("n").over(w.orderBy("bucket")).alias("upto"))
    value = lambda b: F.when(b == _NONE, F.lit(0.0)).otherwise(
        2 * F.exp(b * _GAMMA) / (math.exp(_GAMMA) + 1))

    def quantile(name: str, percent: int, skip: Column) -> Column:
        """Value at the rank of ``percent`` behind the ``skip`` smallest."""
        reached = 100 * (F.col("upto") - skip) >= percent * (F.col("all") - skip)
        return value(F.min(F.when((F.col("measure") == name) & (F.col("upto") > skip) & reached, F.col("bucket"))))

    cols = [F.max("all").alias("n")]
    for name, (kind, lower, upper, reach, floor, _) in RULES.items():
        high = quantile(name, upper, F.col("zero") if kind == "positive" else F.lit(0))
        low = F.lit(float("-inf"))
        if kind == "range":
            first = quantile(name, lower, F.lit(0))
            room = F.greatest(reach * (high - first), F.lit(floor))
            low, high = first - room, high + room
        else:
            high = F.when(high.isNotNull(), F.greatest(reach * high, F.lit(floor)))
            if kind == "positive":
                high = F.when(F.max(F.when(F.col("measure") == name, F.col("all") - F.col("zero"))) >= MIN_POSITIVE, high)
        cols += [low.alias(f"{name}_low"), high.alias(f"{name}_high")]
    made = run.groupBy(*by).agg(*cols)
    return made.select(*by, F.struct(*[c for c in made.columns if c not in by]).alias(at))


def _within(inner: str, outer: str, enough: Column) -> Column:
    """The limits of ``inner`` where it has ``enough`` rows, no further than ``cap`` times those of ``outer``; else those of ``outer``."""
    out = []
    for name, (kind, _, _, _, _, cap) in RULES.items():
        low, high = F.col(inner)[f"{name}_low"], F.col(inner)[f"{name}_high"]
        o_low, o_high = F.col(outer)[f"{name}_low"], F.col(outer)[f"{name}_high"]
        use = enough & high.isNotNull()
        # greatest and least skip what isn't known
        low = F.greatest(low, o_low / cap) if kind == "range" else low
        out += [F.when(use, low).otherwise(o_low).alias(f"{name}_low"),
                F.when(use, F.least(high, o_high * cap)).otherwise(o_high).alias(f"{name}_high")]
    return F.struct(F.when(enough, F.col(inner)["n"]).otherwise(F.col(outer)["n"]).alias("n"), *out)


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row for each (lang, source) of the sketch: the limits that hold there and where they come from."""
    own = _limits(sketch, ["lang", "source"], "own")
    lang = _limits(sketch, ["lang"], "by_lang").withColumnRenamed("lang", "l_lang")
    every = _limits(sketch, [], "by_all")
    j = null_safe(own, lang, [("lang", "l_lang")], "left").drop("l_lang")
    j = j.withColumn("by_all", every.select("by_all").scalar())
    enough = lambda c: F.col(c)["n"] >= min_group
    level = F.when(enough("own"), "source").when(enough("by_lang"), "lang").otherwise("all")
    j = j.withColumn("__level", level).withColumn("by_lang", _within("by_lang", "by_all", enough("by_lang")))
    # a language with too few rows has the limits of all by now
    return j.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), _within("own", "by_lang", enough("own")).alias("__limits"),
                    "__level")


def judge(measured: DataFrame, stats: str, limits: DataFrame) -> DataFrame:
    """Append ``__kept``, ``__limits`` and ``__level`` to ``measured``."""
    j = null_safe(measured, limits, [("lang", "__lang"), ("source", "__source")], "left")
    fine = F.lit(True)
    for name, v in _measures(F.col(stats)).items():
        # no limit is known where hardly any document of the whole corpus is positive
        fine = fine & (v >= F.col("__limits")[f"{name}_low"]) & F.coalesce(v <= F.col("__limits")[f"{name}_high"], F.lit(True))
    return j.withColumn("__kept", ~base_failed(F.col(stats)) & F.coalesce(fine, F.lit(True)))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``kept`` and the limits' level (source, lang, all)."""
    measured = stage_table(docs.select("doc_id", "lang", "source", text_stats("text").alias("__q")), "quality")
    limits = stage_table(thresholds(sketches(measured, "__q")), "limits")
    out = judge(measured, "__q", limits)
    return out.select("doc_id", "__q.n_words", "__q.word_chars", "__q.n_symbols", "__q.n_dup_lines", "__q.n_repeat_words",
                      base_failed(F.col("__q")).alias("base_failed"), F.col("__kept").alias("kept"),
                      F.col("__level").alias("limits_from"))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows: all columns as they were.

    The texts are measured twice (once for the sketches, once to judge), which is cheaper than writing them out.
    """
    narrow = docs.select("lang", "source", text_stats("text").alias("__q"))
    limits = stage_table(thresholds(stage_table(sketches(narrow, "__q"), "sketch")), "limits")
    out = judge(docs.withColumn("__q", text_stats("text")), "__q", limits)
    return out.filter("__kept").select(*[out[c] for c in docs.columns])
