"""Nearest neighbours by random-projection trees, and a two-dimensional layout that keeps them (M6 beside its PCA).

* Vectors become integers, ``floor(scale * x)``; rows of a group with equal integers are one *node*, so copies are never each
  other's rivals and a group of copies is one node, however large.
* A tree deals the nodes of a group to leaves.  A round splits every leaf of over ``leaf`` nodes up to ``DEPTH`` levels deep at medians
  along random directions; medians come from about ``SAMPLE`` nodes of the leaf, chosen by hash, and every node is dealt by them.
  Rounds go on until all leaves are small, so a leaf is bounded and a group is as many leaves as it needs.
* In a leaf all distances are exact; the best ``k`` of all trees remain.  Trees are added until the recall, measured against
  brute force for about ``QUERIES`` nodes of the table, reaches ``recall``.  The more nodes, the more cuts part neighbours: where
  ``most_trees`` can't reach it, all nodes of a group are compared, a block of them in a task, which the others stream past.
* The layout begins with the group's PCA.  An epoch pulls each node and its neighbours together and pushes nodes off a
  sample of at most ``PUSHERS`` nodes of the group, drawn anew for each epoch.  Forces are added up as integers, so that the
  order of the sums doesn't matter and reruns agree.

Work is dealt by leaf, by block and by node, never by group.  For the layout nodes are dealt to blocks by hash.  The edges of a block's nodes, at most
``k`` each, stay where they are through all epochs; a node's position goes once to every block that has an edge to it, and what
a block's edges pull at a node comes back added up, hubs included.  State goes to the shared folder after each epoch, as positions and the
blocks that want them.

Defined cases: rows whose vector is NULL, empty, or has a NULL or non-finite component are no nodes and get NULL
positions; a NULL group is a group; vectors of different length in one group are laid out apart; rows with one id each get
the position of their own vector; a group of one node lies at its PCA position (0, 0); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import join_groups
from ..session import scratch_path
from .scoring import project_2d

#: Levels that a round adds to a tree; nodes that its medians come from; rounds after which splitting has failed.
DEPTH, SAMPLE, ROUNDS = 6, 2048, 40
#: Nodes whose neighbours are checked by brute force; nodes of a group that push in an epoch.
QUERIES, PUSHERS = 200, 256
#: Components of a block of nodes that all others of the group are compared with, and nodes of it at a time.
ALL_CELLS, ALL_ROWS = 1 << 21, 256
#: Nodes of a block of the layout, and blocks at least.
BLOCK, BLOCKS = 1 << 14, 8
#: Strength of a pull: with more of it neighbours overshoot each other.
PULL = 0.4
#: A unit of the integers that forces are added up in.
UNIT = float(1 << 30)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ~bad, F.lit(False))


def _with_node(df: DataFrame, by: Sequence[str], vec_col: str, scale: int) -> DataFrame:
    """``_g`` (group and length), ``_vec`` (integers as doubles) and ``_node``; all NULL where the vector is unusable."""
    whole = F.when(_usable(F.col(vec_col)), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("double")))
    df = df.withColumn("_vec", whole)
    group = F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(by)], F.size("_vec").alias("n")))
    df = df.withColumn("_g", F.when(F.col("_vec").isNotNull(), F.md5(group)))
    return df.withColumn("_node", F.when(F.col("_vec").isNotNull(), F.md5(F.concat_ws(":", "_g", F.col("_vec").cast("string")))))


def nodes(df: DataFrame, by: str | Sequence[str] = "class", vec_col: str = "embedding", scale: int = 4096) -> DataFrame:
    """node, g, vec: the distinct integer vectors of every group."""
    by = [by] if isinstance(by, str) else list(by)
    keyed = _with_node(df.select(*by, vec_col), by, vec_col, scale).where(F.col("_node").isNotNull())
    return keyed.groupBy(F.col("_node").alias("node")).agg(F.first("_g").alias("g"), F.first("_vec").alias("vec"))


# ---------------------------------------------------------------- trees


def _directions(leaf: str, d: int, levels: int) -> np.ndarray:
    return np.random.default_rng([zlib.crc32(leaf.encode()), len(leaf)]).standard_normal((d, levels))


def _stacked(vecs: pd.Series) -> np.ndarray:
    return np.stack(vecs.to_numpy()).astype(np.float64)


def _shortest(points: DataFrame) -> DataFrame:
    """Vectors in the shortest type that holds all their integers: trees carry them through every round."""
    far = points.agg(F.max(F.greatest(F.abs(F.array_max("vec")), F.abs(F.array_min("vec"))))).first()[0] or 0.0
    kind = "smallint" if far < 1 << 15 else "int" if far < 1 << 31 else "double"
    return points.withColumn("vec", F.col("vec").cast(f"array<{kind}>"))


def _split(many: DataFrame, sizes: DataFrame, leaf: int) -> DataFrame:
    """The nodes of leaves that are too large, dealt to smaller ones: one round."""
    chosen = many.where(F.pmod(F.xxhash64("node", "tree", "at"), F.lit(1 << 30)) * F.col("n") < float(SAMPLE) * (1 << 30))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        name, n = pdf["at"].iloc[0], int(pdf["n"].iloc[0])
        levels = min(DEPTH, max(1, int(np.ceil(np.log2(n / leaf)))))
        along = _stacked(pdf["vec"]) @ _directions(name, len(pdf["vec"].iloc[0]), levels)
        cuts, place = np.zeros(2**levels - 1), np.zeros(len(along), np.int64)
        for level in range(levels):
            for p in range(2**level):
                mine = along[place == p, level]
                cuts[2**level - 1 + p] = np.median(mine) if len(mine) else 0.0
            place = 2 * place + (along[:, level] > cuts[2**level - 1 + place])
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "at": [name], "cuts": [cuts.tolist()]})

    cuts = chosen.groupBy("tree", "at").applyInPandas(fit, "tree int, at string, cuts array<double>")
    dealt = many.join(cuts, ["tree", "at"], "left")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = pdf["at"].to_numpy(dtype=object).copy()
            for name, rows in pdf.groupby("at", sort=False).indices.items():
                cuts = pdf["cuts"].iloc[rows[0]]
                if cuts is None:  # nothing of the leaf was chosen: another round draws again
                    at[rows] = name + "/"
                    continue
                levels = int(np.log2(len(cuts) + 1))
                along = _stacked(pdf["vec"].iloc[rows]) @ _directions(name, len(pdf["vec"].iloc[rows[0]]), levels)
                place = np.zeros(len(rows), np.int64)
                for level in range(levels):
                    place = 2 * place + (along[:, level] > np.asarray(cuts)[2**level - 1 + place])
                at[rows] = [f"{name}/{p}" for p in place.tolist()]
            yield pdf.assign(at=at)[["tree", "at", "node", "vec"]]

    kind = many.schema["vec"].dataType.simpleString()
    return dealt.mapInPandas(deal, f"tree int, at string, node string, vec {kind}")


def _leaves(points: DataFrame, trees: range, leaf: int) -> DataFrame:
    """tree, at, node, vec: every node once in each tree, in leaves of at most ``leaf`` nodes."""
    spread = points.select(F.explode(F.array(*[F.lit(t) for t in trees])).alias("tree"), "g", "node", "vec")
    rows = spread.select("tree", F.concat_ws(":", F.lit("tree"), "tree", "g").alias("at"), "node", "vec")
    small: list[DataFrame] = []
    for _ in range(ROUNDS):
        sizes = rows.groupBy("tree", "at").agg(F.count(F.lit(1)).alias("n"))
        large = _kept(sizes.where(F.col("n") > leaf), "large-leaves")
        small.append(rows.join(large, ["tree", "at"], "left_anti"))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, small)
        rows = _kept(_split(rows.join(large, ["tree", "at"]), large, leaf), "split-leaves")
    raise RuntimeError(f"leaves of over {leaf} nodes after {ROUNDS} rounds")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """u, near: the ``k`` nearest as (d2, v), ties by v; at most ``k`` for each tree come together."""
    return pairs.groupBy("u").agg(F.slice(F.array_sort(F.collect_set(F.struct("d2", "v"))), 1, k).alias("near"))


def _nearest(x: np.ndarray, y: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices into ``y`` and squared distances of the ``k`` nearest of each row of ``x``; ties by name."""
    d2 = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)
    if len(y) > k:
        edge = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
        rank = np.argsort(np.argsort(names))
        order = np.lexsort((np.broadcast_to(rank, d2.shape), np.where(d2 <= edge, d2, np.inf)), axis=1)[:, :k]
    else:
        order = np.argsort(d2, axis=1, kind="stable")
    return order, np.take_along_axis(d2, order, axis=1)


def _in_leaf(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, names, out = _stacked(pdf["vec"]), pdf["node"].to_numpy(), []
        for a in range(0, len(x), 512):
            at, d2 = _nearest(x[a : a + 512], x, names, k + 1)
            u = np.repeat(names[a : a + 512], at.shape[1])
            v = names[at.ravel()]
            out.append(pd.DataFrame({"u": u, "v": v, "d2": d2.ravel()})[u != v])
        return pd.concat(out)

    return run


def brute_force(points: DataFrame, k: int, queries: int = QUERIES) -> DataFrame:
    """u, near: the true neighbours of about ``queries`` nodes, chosen by hash.

    They alone reach the driver and every task; a task compares them with its nodes of their group and passes on the best of each.
    """
    total = points.count()
    wanted = points.where(F.pmod(F.xxhash64(F.lit("query"), "node"), F.lit(1 << 30)) * float(max(total, 1)) < float(queries) * (1 << 30))
    asked = sorted((r.g, r.node, r.vec) for r in wanted.collect())
    groups: dict[str, list[int]] = {}
    for i, (g, _, _) in enumerate(asked):
        groups.setdefault(g, []).append(i)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, rows in pdf.groupby("g", sort=False).indices.items():
                if g not in groups:
                    continue
                y, names = np.stack(pdf["vec"].iloc[rows].to_numpy()), pdf["node"].iloc[rows].to_numpy()
                x, own = np.array([asked[i][2] for i in groups[g]]), np.array([asked[i][1] for i in groups[g]], object)
                at, d2 = _nearest(x, y, names, k + 1)
                u, v = np.repeat(own, at.shape[1]), names[at.ravel()]
                yield pd.DataFrame({"u": u, "v": v, "d2": d2.ravel()})[u != v]

    return _best(points.select("g", "node", "vec").mapInPandas(run, "u string, v string, d2 double"), k)


def recall(graph: DataFrame, truth: DataFrame) -> float:
    """Share of the true neighbours that the graph has; a neighbour as near as the last true one counts as found."""
    found = truth.withColumnRenamed("near", "want").join(graph, "u", "left")
    far = F.element_at("want", -1)["d2"]
    hits = F.least(F.size("want"), F.coalesce(F.size(F.filter("near", lambda x: x["d2"] <= far)), F.lit(0)))
    row = found.where(F.size("want") > 0).agg(F.sum(hits).alias("hits"), F.sum(F.size("want")).alias("all")).first()
    return float(row["hits"]) / row["all"] if row["all"] else 1.0


class _Nearest:
    """The ``k`` nearest of a block of nodes among those that stream past, ties by name; memory for the block and a batch."""

    def __init__(self, names: np.ndarray, x: np.ndarray, k: int):
        self.names, self.k = names, k + 1  # a node itself comes, too
        self.x = np.hstack((x, (x * x).sum(1)[:, None], np.ones((len(x), 1))))
        self.best = [(np.empty(0, np.int64), np.empty(0), np.empty(0, object))] * -(-len(x) // ALL_ROWS)  # place, d2, name
        self.edge = np.full(len(x), np.inf)

    def add(self, names: np.ndarray, y: np.ndarray) -> None:
        y = np.hstack((-2 * y, np.ones((len(y), 1)), (y * y).sum(1)[:, None])).T
        for b, a in enumerate(range(0, len(self.x), ALL_ROWS)):
            d2 = self.x[a : a + ALL_ROWS] @ y  # sums of integers: exact in any order
            edge = self.edge[a : a + ALL_ROWS]
            if len(names) > self.k and np.isinf(edge).any():
                edge = np.minimum(edge, np.partition(d2, self.k - 1, axis=1)[:, self.k - 1])
            row, col = np.nonzero(d2 <= edge[:, None])
            if not len(row):
                continue
            place, dist, name = (np.concatenate(c) for c in zip(self.best[b], (row, d2[row, col], names[col]), strict=True))
            order = np.lexsort((name, dist, place))
            place, dist, name = place[order], dist[order], name[order]
            start = np.flatnonzero(np.diff(place, prepend=-1))
            rank = np.arange(len(place)) - np.repeat(start, np.diff(start, append=len(place)))
            self.edge[a + place[rank == self.k - 1]] = dist[rank == self.k - 1]
            keep = rank < self.k
            self.best[b] = place[keep], dist[keep], name[keep]

    def result(self) -> pa.RecordBatch:
        place = np.concatenate([p + b * ALL_ROWS for b, (p, _, _) in enumerate(self.best)])
        dist, name = (np.concatenate([x[c] for x in self.best]) for c in (1, 2))
        other = self.names[place] != name
        place, dist, name = place[other], dist[other], name[other]
        start = np.flatnonzero(np.diff(place, prepend=-1))
        near = pa.ListArray.from_arrays(pa.array(np.append(start, len(place)), pa.int32()),
                                        pa.StructArray.from_arrays([pa.array(np.maximum(dist, 0.0)), pa.array(name, pa.string())], ["d2", "v"]))
        return pa.RecordBatch.from_arrays([pa.array(self.names[place[start]], pa.string()), near], ["u", "near"])


def all_pairs(points: DataFrame, k: int) -> DataFrame:
    """u, near: the ``k`` nearest of every node, each compared with all of its group.

    Quadratic in a group; a block of nodes is a task's work, and the group's nodes go to each of its blocks.
    """
    cells = F.sum(F.size("vec").cast("long"))
    blocks = points.groupBy("g").agg(F.ceil(cells / ALL_CELLS).cast("int").alias("blocks"))
    rows = points.select("g", "node", "vec").join(blocks, "g")
    own = F.pmod(F.xxhash64(F.lit("all"), "node"), F.col("blocks")).cast("int")
    sides = rows.select("g", own.alias("b"), F.lit(False).alias("past"), "node", "vec").unionByName(
        rows.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.lit(True).alias("past"), "node", "vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, block = None, [], None
        for batch in batches:
            g, b, past = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (b[1:] != b[:-1]) | (past[1:] != past[:-1])) + 1
            for a, z in zip([0, *cuts], [*cuts, len(g)], strict=True):
                if a == z:
                    continue
                if key != (g[a], b[a]):
                    if block is not None:
                        yield block.result()
                    key, own, block = (g[a], b[a]), [], None
                names = batch.column(3).slice(a, z - a).to_numpy(zero_copy_only=False)
                x = batch.column(4).slice(a, z - a).flatten().to_numpy().astype(np.float64).reshape(z - a, -1)
                if not past[a]:
                    own.append((names, x))
                    continue
                if block is None and own:
                    block = _Nearest(*(np.concatenate(c) for c in zip(*own, strict=True)), k)
                    own = []
                if block is not None:
                    block.add(names, x)
        if block is not None:
            yield block.result()

    sides = sides.repartition("g", "b").sortWithinPartitions("g", "b", "past")
    return sides.mapInArrow(run, "u string, near array<struct<d2: double, v: string>>")


def neighbour_graph(points: DataFrame, k: int = 15, leaf: int = 1024, trees: int = 6, most_trees: int = 48,
                    at_least: float = 0.9, exact: bool = False) -> tuple[DataFrame, float]:
    """(u, near) of all nodes and the measured recall.  ``trees`` at a time are grown until it is ``at_least``; a graph that
    misses it with ``most_trees`` is an error (larger leaves or more trees reach it).  With ``exact`` it is none: as soon as the trees so
    far tell that ``most_trees`` will miss it, all pairs are compared."""
    if k < 1 or leaf <= k:
        raise ValueError("k must be positive and below the size of a leaf")
    truth = _kept(brute_force(points, k), "true-neighbours")
    short = _shortest(points)
    pairs, reached = None, 0.0
    for first in range(0, most_trees, trees):
        grown = _leaves(short, range(first, min(first + trees, most_trees)), leaf).select("tree", "at", "node", "vec")
        fresh = grown.groupBy("tree", "at").applyInPandas(_in_leaf(k), "u string, v string, d2 double")
        both = fresh if pairs is None else fresh.unionByName(pairs.select("u", F.inline("near")))
        pairs = _kept(_best(both, k), "neighbours")
        if (reached := recall(pairs, truth)) >= at_least:
            return pairs, reached
        # if each tree finds a like share of what is missing
        if exact and (1 - reached) ** (most_trees / min(first + trees, most_trees)) > 1 - at_least:
            break
    if exact:
        pairs = _kept(all_pairs(short, k), "neighbours")
        if (reached := recall(pairs, truth)) >= at_least:
            return pairs, reached
    raise RuntimeError(f"recall {reached:.3f} with {most_trees} trees is below {at_least}")


# ---------------------------------------------------------------- layout


def _start(points: DataFrame) -> DataFrame:
    """node, g, n, x, y: the PCA of the group, at most 10 away from its middle on either axis.

    Sums over integers are exact in any order, so the PCA is the same in every run.
    """
    flat = project_2d(points.select("node", "g", "vec"), "g", "vec", "node", many_groups=True)
    size = flat.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("_far"))
    return flat.join(size, "g").select(
        F.col("id").alias("node"), "g", "n", *[F.when(F.col("_far") > 0, F.col(c) * 10 / F.col("_far")).otherwise(0.0).alias(c) for c in "xy"])


def _edges(graph: DataFrame) -> DataFrame:
    """u, v, w: a node's nearest weighs 1, others less the farther they are; a node's weights add up to 1."""
    near = graph.where(F.size("near") > 0).select("u", "near", F.sqrt(F.col("near")[0]["d2"]).alias("first"),
                                                    F.sqrt(F.element_at("near", -1)["d2"]).alias("last"))
    far = near.select("u", "first", F.greatest(F.col("last") - F.col("first"), F.lit(1e-9)).alias("span"), F.explode("near").alias("e"))
    w = F.exp(-(F.sqrt("e.d2") - F.col("first")) / F.col("span"))
    one = far.select("u", F.col("e.v").alias("v"), w.alias("w"))
    total = graph.select("u", "near").join(one.groupBy("u").agg(F.sum(F.round(F.col("w") * UNIT).cast("long")).alias("_all")), "u")
    return one.join(total.select("u", "_all"), "u").select("u", "v", (F.col("w") * UNIT / F.col("_all")).alias("w"))


def _placed(start: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positions with ``nid`` (block << 32 | number in the block) and ``to`` (the blocks that want them), and the edges
    ``(b, u, v, w)`` between such numbers, dealt by the block of ``u``."""
    spark = start.sparkSession
    blocks = max(BLOCKS, -(-start.count() // BLOCK))
    b = F.pmod(F.xxhash64(F.lit("block"), "node"), F.lit(blocks))
    at = start.withColumn("_b", b).withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("node")))
    at = _kept(at.withColumn("nid", F.shiftleft("_b", 32) + F.col("_i")).drop("_b", "_i"), "numbered")
    ids = at.select("node", "nid")
    e = edges.join(ids.select(F.col("node").alias("u"), F.col("nid").alias("_u")), "u")
    e = e.join(ids.select(F.col("node").alias("v"), F.col("nid").alias("_v")), "v")
    e = _kept(e.select(F.shiftright("_u", 32).cast("int").alias("b"), F.col("_u").alias("u"), F.col("_v").alias("v"), "w"), "block-edges")
    wants = e.select(F.explode(F.array("u", "v")).alias("nid"), "b").groupBy("nid").agg(F.array_sort(F.collect_set("b")).alias("to"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return at.join(wants, "nid", "left"), e.repartition(parts, "b")


def _pulls():
    """What the edges of a block pull at their ends: (nid, fx, fy, n), integers, one row a node."""

    def run(edges: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if not len(edges):
            return pd.DataFrame({"nid": [], "fx": [], "fy": [], "n": []}).astype(np.int64)
        order = np.argsort(at["nid"].to_numpy())
        names, x, y = (at[c].to_numpy()[order] for c in ("nid", "x", "y"))
        u, v = (np.searchsorted(names, edges[c].to_numpy()) for c in "uv")
        dx, dy = x[v] - x[u], y[v] - y[u]
        pull = 2 * PULL * edges["w"].to_numpy() / (1 + dx * dx + dy * dy)
        ends = np.concatenate((u, v))
        order = np.argsort(ends, kind="stable")
        starts = np.flatnonzero(np.diff(ends[order], prepend=-1))
        out = {"nid": names[ends[order][starts]]}
        for c, d in (("fx", dx), ("fy", dy)):
            f = _rounded(pull * d * UNIT)
            out[c] = np.add.reduceat(np.concatenate((f, -f))[order], starts)
        return pd.DataFrame(out | {"n": np.diff(starts, append=len(ends))})

    return run


def _rounded(x: np.ndarray) -> np.ndarray:
    """Halves away from zero, as the integers of SQL's ``round``."""
    whole = np.trunc(x)
    return (whole + np.sign(x) * (np.abs(x - whole) >= 0.5)).astype(np.int64)


def _epoch(k: int, epochs: int, pushes: int, many_groups: bool) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Positions and edges to positions after one more epoch.  Its number is a column, and the columns are built once, so that
    all epochs share their expressions and generated code."""
    epoch, step = F.col("epoch"), 1.0 - F.col("epoch") / epochs
    # what pulls at a hub grows with its edges, so it is spread over them
    total = [(F.sum(c) / UNIT / F.greatest(F.sum("n") / (2.0 * k), F.lit(1.0))).alias(c) for c in ("fx", "fy")]
    drawn = F.pmod(F.xxhash64("node", epoch), F.lit(1 << 30)) * F.col("n") <= float(PUSHERS) * (1 << 30)
    others = F.array_sort(F.collect_list(F.struct("node", "x", "y"))).alias("others")
    draw = F.transform(F.sequence(F.lit(1), F.lit(pushes)),
                       lambda j: F.get("others", F.pmod(F.xxhash64("node", epoch, j), F.greatest(F.size("others"), F.lit(1))).cast("int")))

    def push(c: str) -> Column:
        def force(o: Column) -> Column:
            d2 = (F.col("x") - o["x"]) * (F.col("x") - o["x"]) + (F.col("y") - o["y"]) * (F.col("y") - o["y"])
            one = 2 * (F.col(c) - o[c]) / ((0.1 + d2) * (1 + d2))
            return F.coalesce(F.greatest(F.lit(-4.0), F.least(F.lit(4.0), one)), F.lit(0.0))

        return F.coalesce(F.aggregate("drawn", F.lit(0.0), lambda acc, o: acc + force(o)), F.lit(0.0)) / pushes

    def moved(c: str) -> Column:
        by = F.coalesce(F.col(f"f{c}"), F.lit(0.0)) + push(c)
        return (F.col(c) + step * F.greatest(F.lit(-4.0), F.least(F.lit(4.0), by))).alias(c)

    out = ["nid", "to", "node", "g", "n", (epoch + 1).alias("epoch"), moved("x"), moved("y")]
    draw, pulls_of = draw.alias("drawn"), _pulls()

    def run(at: DataFrame, edges: DataFrame) -> DataFrame:
        sent = at.select(F.explode("to").alias("b"), "nid", "x", "y")
        one = edges.groupBy("b").cogroup(sent.groupBy("b")).applyInPandas(pulls_of, "nid bigint, fx bigint, fy bigint, n bigint")
        pulls = one.groupBy("nid").agg(*total)
        pushers = at.where(drawn).groupBy("g").agg(others)
        # the group's sample comes last: before a shuffle every node would carry it along
        rows = join_groups(at.join(pulls, "nid", "left"), pushers, ["g"], many_groups)
        return rows.select("*", draw).select(*out)

    return run


def layout(points: DataFrame, graph: DataFrame, k: int = 15, epochs: int = 20, pushes: int = 5, many_groups: bool = False) -> DataFrame:
    """node, x, y from a graph of at most ``k`` neighbours a node.  Steps get shorter with each epoch."""
    edges = _kept(_edges(graph), "edges")
    at, edges = _placed(_start(points).withColumn("epoch", F.lit(0)), edges)
    at, edges = _kept(at, "positions"), edges.persist(StorageLevel.MEMORY_AND_DISK)
    step = _epoch(k, epochs, pushes, many_groups)
    for _ in range(epochs):
        at = _kept(step(at, edges), "positions")
    edges.unpersist()
    return at.select("node", "x", "y")


def project_neighbours(df: DataFrame, by: str | Sequence[str] = "class", vec_col: str = "embedding", id_col: str = "id",
                       k: int = 15, epochs: int = 20, scale: int = 4096, many_groups: bool = False, **trees) -> DataFrame:
    """M6: id, the group and x, y of every row, near to what its vector is near to.  ``trees`` go to ``neighbour_graph``."""
    by = [by] if isinstance(by, str) else list(by)
    points = _kept(nodes(df, by, vec_col, scale), "nodes")
    graph, _ = neighbour_graph(points, k, **{"exact": True} | trees)
    placed = layout(points, graph, k, epochs, many_groups=many_groups).withColumnRenamed("node", "_node")
    rows = _with_node(df.select(F.col(id_col).alias("id"), *by, vec_col), by, vec_col, scale)
    return rows.select("id", *by, "_node").join(placed, "_node", "left").select("id", *by, "x", "y")
