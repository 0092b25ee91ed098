"""K-d tree sharding: shards of near equal bytes that are compact in the documents' metadata.

The tree is built level by level.  A node that stands for k shards is split where floor(k/2)/k of its bytes lie below,
along its widest dimension (spread in the node against spread in the whole table; ties: the first dimension), until
a node's bytes reach the target of one shard.  The weighted medians of all nodes of a level are found together by
refining histograms: ``groupBy(node, bin)`` sums bytes, the bin that holds the median is cut into bins again,
until it weighs little or holds one coordinate.  The driver sees at most ``shards * BINS`` sums, and the tree (shards - 1
thresholds) is an expression, so rows are dealt without a join.

A coordinate is a long: 31 bits of the dimension's value (strings: their first bytes in order; NULL: lowest) and 32 bits
of a hash of doc_id and text, which splits values that many rows share, a hot source included.

Law ``bytes``: shards are near equal in bytes.  Equal texts are not kept together, since one group of copies may hold
a third of all rows.  Defined cases: NULL text has no bytes and the CRC-32 of the empty text; rows equal in doc_id and
text are inseparable; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless, stage_table

ROW_BYTES = 16
BINS = 1024
#: A bin is not refined further when it weighs less than this part of a shard.
FINE = 0.002


def text_prefix(c: Column) -> Column:
    """A string's first 3 bytes, in byte order, as a number below 2^31; NULL: 0."""
    three = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 3)), 6, "0")
    return F.coalesce(F.conv(three, 16, 10).cast("long") * 64 + 1, F.lit(0))


def tail_prefix(c: Column) -> Column:
    """Like ``text_prefix`` for the last 3 bytes, for names that differ only at the end (``src1``, ``src2``)."""
    return text_prefix(F.substring(c, -3, 3))


def size_scale(c: Column) -> Column:
    """A size on a log scale below 2^31."""
    return F.floor(F.log2(F.greatest(c, F.lit(1)).cast("double") + 1) * (1 << 25)).cast("long")


def _node(tree: dict[int, tuple[int, int]], n: int, leaves: dict[int, int]) -> Column:
    """The node (or, at a leaf, minus the shard less 1) of a row as one nested expression."""
    if n in leaves:
        return F.lit(-1 - leaves[n])
    if n not in tree:
        return F.lit(n)
    dim, cut = tree[n]
    return F.when(F.col(f"x{dim}") <= cut, _node(tree, 2 * n, leaves)).otherwise(_node(tree, 2 * n + 1, leaves))


def kd_tree(points: DataFrame, n_dims: int, shards: int) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
    """Split thresholds {node: (dimension, last coordinate on the left)} and {leaf: shard} over (x0 .., w)."""
    tree: dict[int, tuple[int, int]] = {}
    parts, first, leaves = {1: shards}, {1: 0}, {}
    whole: list[int] | None = None
    while open_nodes := [n for n in parts if n not in tree and n not in leaves]:
        for n in open_nodes:
            if parts[n] == 1:
                leaves[n] = first[n]
        open_nodes = [n for n in open_nodes if n not in leaves]
        if not open_nodes:
            break
        node = _node(tree, 1, leaves)
        rows = (
            points.withColumn("node", node).filter("node > 0").groupBy("node")
            .agg(F.sum("w").alias("w"), *[f(f"x{d}").alias(f"{f.__name__}{d}") for d in range(n_dims) for f in (F.min, F.max)])
            .collect()  # one row for each node
        )
        spans = {r.node: r for r in rows}
        if whole is None and rows:
            whole = [max(1, (rows[0][f"max{d}"] >> 32) - (rows[0][f"min{d}"] >> 32)) for d in range(n_dims)]
        state = {}
        for n in open_nodes:
            if n not in spans:  # no rows here: any cut will do
                tree[n] = (0, 0)
                continue
            r = spans[n]
            dim = max(range(n_dims), key=lambda d: (((r[f"max{d}"] >> 32) - (r[f"min{d}"] >> 32)) / whole[d], -d))
            state[n] = {"dim": dim, "lo": r[f"min{dim}"], "hi": r[f"max{dim}"], "below": 0,
                        "goal": r.w * (parts[n] // 2) / parts[n], "fine": FINE * r.w / parts[n]}
        while state:
            bins = _histogram(points, node, state)
            for n in list(state):
                s = state[n]
                width = max(1, -(-(s["hi"] - s["lo"] + 1) // BINS))
                run = s["below"]
                for b in sorted(bins.get(n, {})):
                    w = bins[n][b]
                    if run + w >= s["goal"]:
                        lo, hi = s["lo"] + b * width, min(s["hi"], s["lo"] + (b + 1) * width - 1)
                        break
                    run += w
                else:
                    lo, hi, w = s["hi"], s["hi"], 0
                if w <= s["fine"] or lo >= hi:  # cut on the nearer side of the bin
                    tree[n] = (s["dim"], hi if run + w - s["goal"] <= s["goal"] - run else lo - 1)
                    del state[n]
                else:
                    s.update(lo=lo, hi=hi, below=run)
        for n in open_nodes:
            left = parts[n] // 2
            parts[2 * n], parts[2 * n + 1] = left, parts[n] - left
            first[2 * n], first[2 * n + 1] = first[n], first[n] + left
    return tree, leaves


def _histogram(points: DataFrame, node: Column, state: dict[int, dict]) -> dict[int, dict[int, int]]:
    """Bytes by (node, bin) of the rows between each node's lo and hi."""
    b = F.lit(None).cast("long")
    for n, s in state.items():
        x, width = F.col(f"x{s['dim']}"), max(1, -(-(s["hi"] - s["lo"] + 1) // BINS))
        b = F.when((F.col("node") == n) & x.between(s["lo"], s["hi"]),
                   F.expr(f"(x{s['dim']} - {s['lo']}L) div {width}L")).otherwise(b)
    rows = (
        points.withColumn("node", node).filter(F.col("node").isin(list(state))).withColumn("b", b).filter("b IS NOT NULL")
        .groupBy("node", "b").agg(F.sum("w").alias("w")).collect()  # at most BINS sums for each open node
    )
    out: dict[int, dict[int, int]] = {}
    for r in rows:
        out.setdefault(r.node, {})[int(r.b)] = r.w
    return out


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None,
              dims: Mapping[str, Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; give the number of shards or the bytes that a shard should have.

    ``dims`` maps names to longs in [0, 2^31); by default source, language and size.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = F.encode(text, "UTF-8")
    size = F.octet_length(text).cast("long") + ROW_BYTES
    if dims is None:
        dims = {"source": tail_prefix(F.col("source").cast("string")), "lang": text_prefix(F.col("lang").cast("string")),
                "size": size_scale(size)}
    crc = F.crc32(raw)
    tie = F.xxhash64(F.col("doc_id"), crc).bitwiseAND(F.lit(0xFFFFFFFF))
    xs = [(F.coalesce(c, F.lit(0)) * F.lit(1 << 32) + tie).alias(f"x{i}") for i, c in enumerate(dims.values())]
    points = stage_table(docs.select("doc_id", size.alias("w"), crc.alias("text_crc32"), *xs), "points")
    if shards is None:
        total = points.agg(F.sum("w")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    tree, leaves = kd_tree(points, len(xs), shards)
    dealt = points.select("doc_id", F.col("w").alias("size"), "text_crc32",
                          (-1 - _node(tree, 1, leaves)).cast("int").alias("shard"))
    return gapless(dealt, "shard", [F.col("doc_id"), F.col("text_crc32")], F.xxhash64("doc_id"), "slot")
