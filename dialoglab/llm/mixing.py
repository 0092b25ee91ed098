"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes are words.  A source's target is its weighted share of all words, but at most ``CAP`` times its own; the excess
   is shared again by weight.  Solved in closed form over the table of sources (water level by running sums).
2. The documents of a source are dealt by a hash into blocks of about equal words, and its blocks are permuted.  With
   target / words = f, every block is drawn floor(f) times, and then the first blocks of the permutation until the
   target is reached; the block in which it is reached gives the first documents of a second permutation.  So a
   source's quota of block draws is exact, and its words end within half a document of the target.
3. Splitting tree: all draws start at the root.  At each node a random permutation of its draws sends the first
   part left: a multivariate hypergeometric draw of how many blocks of each source either side gets.  The counts
   of the two sides add up to the node's exactly.  The leaves are the output shards, with exact quotas by source.
4. The shards take each source's permuted blocks in turn, as many as their quotas say: disjoint within a pass.
5. Inside a shard, rows are ordered by a seeded hash.

DataFrame functions only; seeds are fixed, so reruns agree.  There are at most ``MAX_BLOCKS`` blocks and one for each
source; a hot source is spread over its blocks.  The table of sources and the root of the tree (about ``CAP`` draws for each
block and source) are each ordered in one task, so the number of sources is assumed to be bounded, whatever the rows.

Defined cases: NULL or empty text has size 0 and is never taken; NULL source is a source of its own, last in order;
rows equal in doc_id and text are taken alike; an empty table gives an empty result; other columns are kept by
``mixture`` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, null_safe, stage_table

CAP = 3
SHARDS = 16
BLOCK_WORDS = 50_000
MAX_BLOCKS = 1 << 16
SEED = 20240501


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text (NULL: 0): each word with the space after it becomes one letter."""
    short = F.regexp_replace(F.ltrim(text, F.lit(SPACE)), r"[^ \t-\r]+[ \t-\r]*", "w")
    return F.coalesce(F.length(short), F.lit(0)).cast("long")


def has_words(text: Column) -> Column:
    """Whether ``word_count`` is above 0, without a copy of the text for the pattern."""
    return F.coalesce(F.ltrim(text, F.lit(SPACE)) != "", F.lit(False))


def _hash() -> Column:
    crc = F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))
    return F.xxhash64(F.lit(SEED), F.col("doc_id"), crc)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__size": word_count(F.col("text")), "__h": _hash()})


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    With the sources ordered by cap / weight, the first ones stop at their caps; the first one whose share of
    what is left lies below its cap sets the level for itself and all after it.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    w = w.withColumn("top", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(before), F.lit(0.0)))
    w = w.withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    share = F.col("left") / F.col("rest")
    level = F.first(F.when(share * F.col("weight") <= F.col("top"), share), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, 0))
    w = w.withColumn("level", level)
    return w.select("source", "source_size", F.coalesce(F.col("level") * F.col("weight"), F.col("top")).alias("target"))


def _in_blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` (source, __h, ...) with ``__block`` and their source's columns as ``__s_...``."""
    s = sources.select(*[F.col(c).alias(f"__s_{c}") for c in sources.columns])
    return null_safe(rows, s, [("source", "__s_source")], "inner").withColumn(
        "__block", F.pmod(F.xxhash64(F.lit(SEED + 1), "__h"), F.col("__s_n_blocks")))


def mix_tables(rows: DataFrame, cap: int = CAP, shards: int = SHARDS, block_words: int = BLOCK_WORDS
               ) -> tuple[DataFrame, DataFrame]:
    """From (source, __size, __h): the sources with their targets, and the blocks with their draws."""
    sizes = rows.groupBy("source").agg(F.sum("__size").alias("source_size"))
    src = targets(sizes, cap)
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    src = src.withColumn("passes", F.floor(f + 1e-9).cast("int"))
    src = src.withColumn("part", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    each = F.greatest(F.lit(float(block_words)), F.sum("source_size").over(Window.partitionBy()) / MAX_BLOCKS)
    src = src.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / each)).cast("long"))
    src = stage_table(src, "sources")

    placed = _in_blocks(rows.filter("__size > 0"), src)
    perm = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(SEED + 2), "block"), "block")
    blocks = (
        placed.groupBy("source", F.col("__block").alias("block"), F.col("__s_passes").alias("passes"), F.col("__s_part").alias("part"))
        .agg(F.sum("__size").alias("words"))
        .withColumn("place", F.row_number().over(perm))
        .withColumn("before", F.sum("words").over(perm) - F.col("words"))
    )
    blocks = stage_table(blocks, "blocks")
    # the block in which the target is reached: documents of a second permutation up to the nearest sum
    edge = blocks.filter("part > before AND part < before + words").select(
        F.col("source").alias("e_source"), F.col("block").alias("e_block"), (F.col("part") - F.col("before")).alias("need"))
    inside = null_safe(placed, edge, [("source", "e_source"), ("__block", "e_block")], "inner")
    upto = F.sum("__size").over(Window.partitionBy("source", "__block").orderBy("__h").rowsBetween(Window.unboundedPreceding, 0))
    last = (inside.withColumn("upto", upto).filter(F.col("upto") - F.col("__size") / 2 <= F.col("need"))
            .groupBy(F.col("source").alias("e_source"), F.col("__block").alias("e_block")).agg(F.max("__h").alias("last_h")))
    taken = null_safe(blocks, last, [("source", "e_source"), ("block", "e_block")], "left").select(
        "source", "block", "place", "passes", "last_h", (F.col("part") >= F.col("before") + F.col("words")).alias("whole"))
    return src, stage_table(_deal(taken, shards), "draws")


def _deal(taken: DataFrame, shards: int) -> DataFrame:
    """(source, block, passes, last_h, draws: array of (pass, shard)) by the splitting tree."""
    times = F.col("passes") + (F.col("whole") | F.col("last_h").isNotNull()).cast("int")
    drawn = taken.withColumn("pass", F.explode(F.expr("sequence(1, passes + 1)"))).filter(F.col("pass") <= times)
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("pass", "place")))
    node = drawn.select("source", "k", F.lit(1).alias("node"))
    parts, depth = {1: shards}, 0
    while any(n > 1 for n in parts.values()):
        depth += 1
        share = F.lit(1.0)
        for at, n in parts.items():
            share = F.when(F.col("node") == at, F.lit((n // 2) / n if n > 1 else 1.0)).otherwise(share)
        perm = Window.partitionBy("node").orderBy(F.xxhash64(F.lit(SEED + 10 + depth), "source", "k"), "source", "k")
        left = F.row_number().over(perm) <= F.round(share * F.count(F.lit(1)).over(Window.partitionBy("node")))
        node = node.select("source", "k", (F.col("node") * 2 + F.when(left, 0).otherwise(1)).alias("node"))
        parts = {2 * at + side: n for at, m in parts.items()
                 for side, n in enumerate((m // 2, m - m // 2) if m > 1 else (1,))}
    shard = F.lit(None).cast("int")
    for i, at in enumerate(sorted(parts)):
        shard = F.when(F.col("node") == at, F.lit(i)).otherwise(shard)
    # the leaves hold counts by source; a source's draws, in permuted order, go to the shards in turn
    turn = Window.partitionBy("source").orderBy("shard", "k0")
    quota = node.select(F.col("source").alias("q_source"), shard.alias("shard"), F.col("k").alias("k0"), "source").select(
        "q_source", "shard", F.row_number().over(turn).alias("q_k"))
    j = null_safe(drawn, quota, [("source", "q_source"), ("k", "q_k")], "inner")
    return j.groupBy("source", "block", "passes", "last_h").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("draws"))


def _assign(rows: DataFrame, src: DataFrame, draws: DataFrame) -> DataFrame:
    """Append ``__shards``: the output shard of each time that a row is taken, and its source's columns."""
    d = draws.select(*[F.col(c).alias(f"__d_{c}") for c in draws.columns])
    j = null_safe(_in_blocks(rows, src), d, [("source", "__d_source"), ("__block", "__d_block")], "left")
    mine = F.filter("__d_draws", lambda x: (x["pass"] <= F.col("__d_passes")) | F.col("__d_last_h").isNull()
                    | (F.col("__h") <= F.col("__d_last_h")))
    return j.withColumn("__shards", F.when((F.col("__size") > 0) & F.col("__d_draws").isNotNull(),
                                           F.transform(mine, lambda x: x["shard"]))
                        .otherwise(F.array().cast("array<int>")))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """One row per document: size, source_size, target, taken words and the output shards it goes to."""
    rows = stage_table(_keyed(docs.select("doc_id", "source", "text")).drop("text"), "words")
    out = _assign(rows, *mix_tables(rows, **how))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__s_source_size").alias("source_size"),
                      F.col("__s_target").alias("target"),
                      (F.col("__size") * F.size("__shards")).cast("long").alias("taken"), F.col("__shards").alias("shards"))


def mixture(docs: DataFrame, spread: int = 16, **how) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, with ``__shard`` and ``__order`` appended.

    Rows are dealt by (shard, ``spread`` parts of it) and each part is in the order of its seeded hash.
    """
    # words are counted once, for the tables; here it only matters whether a text has any
    keyed = docs.withColumns({"__size": has_words(F.col("text")).cast("long"), "__h": _hash()})
    narrow = stage_table(_keyed(docs.select("doc_id", "source", "text")).select("source", "__size", "__h"), "words")
    out = _assign(keyed, *mix_tables(narrow, **how))
    out = out.select(*[out[c] for c in docs.columns], F.col("__h"), F.posexplode("__shards").alias("__time", "__shard"))
    out = out.withColumn("__order", F.xxhash64(F.lit(SEED + 3), "__h", "__time")).drop("__h", "__time")
    return out.repartition(F.col("__shard"), F.pmod("__order", F.lit(spread))).sortWithinPartitions("__shard", "__order")
