"""Nearest neighbours by trees and their layout, against numpy."""

import numpy as np
import pandas as pd
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from dialoglab.operators import neighbours as N
from dialoglab.plans import fixtures as fx

SCHEMA = "id string, class string, embedding array<double>"


def clusters(n, d=12, kinds=6, seed=3):
    """Points near ``kinds`` centres, with three directions of their own each."""
    rng = np.random.default_rng(seed)
    kind = rng.integers(kinds, size=n)
    x = rng.normal(size=(kinds, d))[kind] * 6 + rng.normal(size=(n, 3)) @ rng.normal(size=(3, d))
    return kind, x


def frame(spark, x, groups=None):
    return spark.createDataFrame([(str(i), None if groups is None else groups[i], v.tolist()) for i, v in enumerate(x)], SCHEMA)


def true_neighbours(points, k):
    rows = points.collect()
    x, g = np.array([r.vec for r in rows]), np.array([r.g for r in rows])
    out = {}
    for i, r in enumerate(rows):
        d2 = ((x - x[i]) ** 2).sum(1)
        d2[g != g[i]] = np.inf
        d2[i] = np.inf
        near = sorted((d, rows[j].node) for j, d in enumerate(d2) if d < np.inf)[:k]
        out[r.node] = near
    return out


def test_graph_of_small_leaves_against_brute_force(spark):
    """Leaves so small that trees take two rounds: every distance is exact, and recall is what was measured."""
    _, x = clusters(1500)
    points = N._kept(N.nodes(frame(spark, x, ["a" if i % 3 else None for i in range(len(x))])), "t")
    graph, reached = N.neighbour_graph(points, k=5, leaf=14, trees=8)
    want, got = true_neighbours(points, 5), {r.u: [(e.d2, e.v) for e in r.near] for r in graph.collect()}
    assert got.keys() == want.keys()
    hits = np.mean([len(set(got[u]) & set(want[u])) / 5 for u in want])
    assert reached >= 0.9 and hits >= 0.85
    vec = {r.node: np.array(r.vec) for r in points.collect()}
    assert all(d == ((vec[u] - vec[v]) ** 2).sum() for u, near in got.items() for d, v in near)
    assert all(near == sorted(near) and len({v for _, v in near}) == 5 for near in got.values())


def test_leaves_hold_every_node_once(spark):
    _, x = clusters(700)
    points = N._kept(N.nodes(frame(spark, x)), "t")
    leaves = N._leaves(points, range(2), 16)
    rows = leaves.groupBy("tree", "at").agg(F.collect_list("node").alias("nodes")).collect()
    assert max(len(r.nodes) for r in rows) <= 16
    every = sorted(r.node for r in points.collect())
    for t in (0, 1):
        assert sorted(n for r in rows if r.tree == t for n in r.nodes) == every


def test_sampled_truth_is_brute_force(spark):
    points = N._kept(N.nodes(fx.fx_embeddings(spark, SF_SMALL)), "t")
    want = true_neighbours(points, 4)
    got = {r.u: [(e.d2, e.v) for e in r.near] for r in N.brute_force(points, 4, queries=60).collect()}
    assert 20 < len(got) < 120
    assert all(want[u] == near for u, near in got.items())


def test_missed_recall_is_an_error(spark):
    points = N.nodes(fx.fx_embeddings(spark, SF_SMALL))
    with pytest.raises(RuntimeError, match="recall"):
        N.neighbour_graph(points, k=5, leaf=8, trees=1, most_trees=1)


def test_trees_that_miss_the_recall_are_followed_by_all_pairs(spark, monkeypatch):
    """As in a table of so many nodes that no allowed number of trees reaches it."""
    monkeypatch.setattr(N, "ALL_CELLS", 300)  # several blocks in a group
    monkeypatch.setattr(N, "ALL_ROWS", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rng = np.random.default_rng(2)
        x = np.unique(np.concatenate((rng.integers(0, 3, (300, 5)) / 4096, rng.normal(size=(200, 5)))), axis=0)  # many ties
        rows = frame(spark, x, ["a" if i % 3 else None for i in range(len(x))]).collect()
        rows += [("alone", "b", [1.0] * 5), ("copy", rows[0][1], rows[0][2])]
        df = spark.createDataFrame(rows, SCHEMA)
        points = N._kept(N.nodes(df), "t")
        df = df.union(spark.createDataFrame([("short", "a", [1.0]), ("shorter", "a", [2.0])], SCHEMA))
        want = {u: near for u, near in true_neighbours(points, 4).items() if near}
        graph, reached = N.neighbour_graph(points, k=4, leaf=6, trees=1, most_trees=1, exact=True)
        assert reached == 1.0
        assert {r.u: [(e.d2, e.v) for e in r.near] for r in graph.collect()} == want
        assert N.project_neighbours(df, k=4, epochs=2, leaf=6, trees=1, most_trees=1).where("x IS NULL").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_layout_keeps_neighbours_better_than_pca(spark):
    kind, x = clusters(400, kinds=8)
    points = N._kept(N.nodes(frame(spark, x)), "t")
    graph = N._kept(N.neighbour_graph(points, k=10)[0], "t")
    want = true_neighbours(points, 10)

    def kept(rows):
        names = [r.node for r in rows]
        xy = np.array([(r.x, r.y) for r in rows])
        near = np.argsort(((xy[:, None] - xy[None]) ** 2).sum(2) + np.diag([1e18] * len(xy)), axis=1)[:, :10]
        return np.mean([len({names[j] for j in near[i]} & {v for _, v in want[u]}) / 10 for i, u in enumerate(names)])

    first = N.layout(points, graph, 10).collect()
    assert kept(first) > kept(N._start(points).collect()) + 0.05
    assert sorted(first) == sorted(N.layout(points.repartition(5), graph.repartition(3), 10).collect())


def test_rows_that_are_no_nodes_copies_and_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), "a", v.tolist()) for i, v in enumerate(rng.normal(size=(40, 4)))]
    rows += [("copy", "a", rows[0][2]), ("0", "a", rows[1][2]), (None, None, [1.0, 2.0]), ("n1", None, [3.0, 4.0]), ("n2", None, [3.0, 5.0]),
             ("null", "a", None), ("empty", "a", []), ("hole", "a", [1.0, None, 2.0, 3.0]), ("nan", "a", [float("nan")] * 4),
             ("inf", "a", [float("inf")] * 4), ("short", "a", [1.0]), ("alone", "b", [1.0, 1.0])]
    out = N.project_neighbours(spark.createDataFrame(rows, SCHEMA), k=3, epochs=3).collect()
    assert len(out) == len(rows)
    at = {}
    for r in out:
        at.setdefault(r.id, []).append((r.x, r.y))
    assert at["copy"][0] in at["0"] and at["1"][0] in at["0"]
    assert all(at[i] == [(None, None)] for i in ("null", "empty", "hole", "nan", "inf"))
    assert at["alone"] == [(0.0, 0.0)] and at["short"] == [(0.0, 0.0)]
    assert all(x is not None and np.isfinite([x, y]).all() for i in (None, "n1", "n2", "5") for x, y in at[i])
    empty = N.project_neighbours(spark.createDataFrame([], SCHEMA), epochs=1)
    assert empty.columns == ["id", "class", "x", "y"] and empty.collect() == []


def test_pulls_of_a_block_with_a_hub():
    rng = np.random.default_rng(8)
    names = np.array([3, 7, 1 << 33, (1 << 33) + 1, 9], np.int64)
    at = pd.DataFrame({"b": 0, "nid": names, "x": rng.normal(size=5), "y": rng.normal(size=5)}).sample(frac=1, random_state=1)
    edges = pd.DataFrame({"b": 0, "u": names[[0, 1, 2, 3, 1]], "v": names[[2, 2, 0, 2, 3]], "w": rng.random(5)})
    want: dict = {}
    place = {r.nid: (r.x, r.y) for r in at.itertuples()}
    for e in edges.itertuples():
        dx, dy = (place[e.v][c] - place[e.u][c] for c in (0, 1))
        pull = 2 * N.PULL * e.w / (1 + dx * dx + dy * dy)
        for node, sign in ((e.u, 1), (e.v, -1)):
            x, y, n = want.get(node, (0, 0, 0))
            want[node] = (x + sign * round(pull * dx * N.UNIT), y + sign * round(pull * dy * N.UNIT), n + 1)
    got = N._pulls()(edges, at)
    assert {r.nid: (r.fx, r.fy, r.n) for r in got.itertuples()} == want
    assert not len(N._pulls()(edges.iloc[:0], at))
    assert N._rounded(np.array([0.5, -0.5, 1.5, -2.5, 0.49999999999999994, 3.0])).tolist() == [1, -1, 2, -3, 0, 3]


def test_vectors_travel_in_the_shortest_type(spark):
    def kind(*rows):
        return N._shortest(spark.createDataFrame([("a", list(r)) for r in rows], "node string, vec array<double>")).schema["vec"].dataType.elementType.simpleString()

    assert [kind((1.0, -32767.0)), kind((1.0,), (40000.0,)), kind((3e9,)), kind()] == ["smallint", "int", "double", "smallint"]


def test_an_epoch_shuffles_no_samples_and_no_edges(spark):
    """The group's sample joins after the last shuffle, and edges that are dealt by their block stay there."""
    start = spark.createDataFrame([(f"n{i}", "g", 40, float(i % 7), float(i % 5), 0) for i in range(40)], "node string, g string, n bigint, x double, y double, epoch int")
    edges = spark.createDataFrame([(f"n{i}", f"n{(i * 3 + 1) % 40}", 1.0) for i in range(40)], "u string, v string, w double")
    at, dealt = N._placed(start, edges)
    dealt = dealt.persist()
    dealt.count()
    out = N._epoch(15, 20, 5, False)(at, dealt)
    assert out.count() == 40 and out.where("x IS NULL OR to IS NULL").count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert "nid#" not in joins[0] and "nid#" in joins[1], plan
    cached = out._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0].splitlines()[-1]
    assert "Exchange" not in cached
    dealt.unpersist()
