"""Hard negatives, lexical search and top-k search against plain versions: messy rows, ties, copies, empty tables, pruning."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from messy import empty, messy, small  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import functions as F

from dialoglab.llm import bag_search, hard_negatives, pivot_search
from dialoglab.llm import vectors as V

SCHEMA = "vec_id bigint, embedding array<double>, label int, rank int, score string, part string, key string"
NAN, INF = float("nan"), float("inf")


def whole(v, scale):
    """Integer components, or None for a vector that takes no part."""
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    out = [math.floor(scale * x) for x in v]
    return out if sum(x * x for x in out) <= 2**62 else None


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def last(i):
    return (i is None, i or 0)


def plain_top(rows, k, every, scale):
    ok = [(i, w) for i, v, _ in rows if (w := whole(v, scale)) is not None]
    out = []
    for q, v in ok:
        if q is not None and q % every == 0:
            found = sorted((-dot(v, x), last(i), i) for i, x in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(found)]
    return sorted(out, key=repr)


def plain_negatives(rows, every, scale, n_pos=5, n_neg=10, low=30, high=90):
    ok = [(i, w, y) for i, v, y in rows if y is not None and (w := whole(v, scale)) is not None]
    out = []
    for a, v, y in ok:
        if a is None or a % every:
            continue
        ranked = sorted((-dot(v, x), last(i), i, z) for i, x, z in ok if i != a)
        for p, _, pos, _ in [r for r in ranked if r[3] == y][:n_pos]:
            band = [r for r in ranked if r[3] != y and low * -p <= 100 * -r[0] <= high * -p][:n_neg]
            out += [(a, pos, k + 1, n, -p, -s) for k, (s, _, n, _) in enumerate(band)]
    return sorted(out, key=repr)


def messy_rows():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 6))
    rows = [(i, (base[i % 60] + 0.3 * rng.normal(size=6)).tolist(), i % 3) for i in range(240)]
    rows += [(1000 + i, base[3].tolist(), i % 2) for i in range(60)]  # copies: ties by id
    rows += [(2000, None, 1), (2001, [1.0, None, 2.0], 1), (2002, [NAN] * 6, 1), (2003, [INF, 0.0], 0), (2004, [], 1), (2010, [], 0),
             (2005, [0.0] * 6, 1), (2006, [2.0, 1.0], 1), (2007, [1.0] * 9, 0), (2008, (-base[3]).tolist(), 1), (2009, base[4].tolist(), None),
             (None, base[3].tolist(), 1), (None, base[5].tolist(), 0), (2020, [1e30] * 6, 1), (2030, [3e6, 2e6, -1e6, 0.0, 0.0, 5.0], 0),
             (2040, [4e6, -2e6], 0), (2050, [4e5, 1e5], 1), (-10, base[7].tolist(), 1), (-20, base[9].tolist(), -4)]
    rows += [rows[10], rows[20], rows[20], (30, base[1].tolist(), 0)]  # repeated rows, one id with two vectors
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(5)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_top_k_on_messy_rows(spark):
    rows = messy_rows()
    assert got(pivot_search.top_k(frame(spark, rows), k=7, every=10, scale=1024)) == plain_top(rows, 7, 10, 1024)


def test_top_k_takes_all_if_fewer(spark):
    rows = messy_rows()[:8]
    out = got(pivot_search.top_k(frame(spark, rows), k=10, every=4, scale=1024))
    assert len(out) == 2 * 7 and out == plain_top(rows, 10, 4, 1024)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(3, [1.0], 1)]])
def test_no_results(spark, rows):
    df = frame(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
    top, neg = pivot_search.top_k(df, every=2), hard_negatives.mine(df, every=2)
    assert top.columns == ["query_id", "rank", "vec_id", "score"] and top.count() == 0
    assert neg.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and neg.count() == 0


@pytest.mark.parametrize("low,high", [(30, 90), (-50, 70), (0, 100)])
def test_negatives_on_messy_rows(spark, low, high):
    rows = messy_rows()
    assert got(hard_negatives.mine(frame(spark, rows), every=10, low=low, high=high)) == plain_negatives(rows, 10, 256, low=low, high=high)


@pytest.fixture(scope="module")
def clusters():
    """Over several blocks and parts: tight clusters of different lengths, a third of all rows copies of one vector."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 12)) * rng.uniform(0.2, 3, size=(40, 1))
    x = centre[rng.integers(0, 40, 14_000)] + 0.02 * rng.normal(size=(14_000, 12))
    x[rng.permutation(14_000)[:4700]] = centre[0]
    return x, rng.integers(0, 4, 14_000)


def test_searches_over_many_blocks(spark, clusters):
    x, y = clusters
    df = spark.createDataFrame(((i, v.tolist(), int(c), 0, "", "", "") for i, (v, c) in enumerate(zip(x, y, strict=True))), SCHEMA)
    top = pivot_search.top_k(df, k=5, every=500, scale=1024).collect()
    q = np.floor(1024 * x).astype(np.int64)
    want = []
    for i in range(0, len(x), 500):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:5]
        want += [(i, r + 1, j, s[j]) for r, j in enumerate(order)]
    assert sorted(map(tuple, top)) == want
    q = np.floor(256 * x).astype(np.int64)
    want = []
    for i in range(0, len(x), 1000):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i]
        for p in [j for j in order if y[j] == y[i]][:5]:
            band = [j for j in order if y[j] != y[i] and 30 * s[p] <= 100 * s[j] <= 90 * s[p]][:10]
            want += [(i, p, r + 1, j, s[p], s[j]) for r, j in enumerate(band)]
    assert got(hard_negatives.mine(df, every=1000)) == sorted(want, key=repr)


def test_bounds_hold_and_prune(clusters):
    x = np.floor(1024 * clusters[0][::7]).astype(np.int64)
    pivots = x[:50:5].astype(float)
    d = pivot_search.distances(x.astype(float), pivots)
    near = d.argmin(1)
    x2 = (x**2).sum(1)
    for p in range(len(pivots)):
        own = near == p
        if own.any():
            lo, hi = d[own, p].min(), d[own, p].max()
            bound = pivot_search.upper_bound(x2.astype(float), d[:, [p]], np.array([lo]), np.array([hi]), np.array([float(x2[own].max())]))
            assert (bound[:, 0] >= (x @ x[own].T).max(1)).all()
    x = np.random.default_rng(1).normal(size=(2000, 12)) * 0.15 + np.eye(12)[np.arange(2000) % 12]
    x = np.floor(1024 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    x2 = (x**2).sum(1)
    row = {"l2": int(x2.max()), "ids": list(range(len(x))), "labels": [0] * len(x), "vecs": [v.astype("<i4").tobytes() for v in x],
           "lists": np.argsort(hard_negatives.units(x), axis=0, kind="stable").T.astype("<u2").tobytes()}
    bucket = hard_negatives.Bucket(row)
    a = x[:64]
    a2 = (a**2).sum(1)
    s = a @ x.T
    tau = np.sort(s, axis=1)[:, -20].astype(float)
    seen, products = set(), 0
    for at, rows, score in bucket.scored(a, a2, np.sqrt(a2.astype(float)), tau):
        assert (score == s[np.ix_(at, rows)]).all()
        seen |= {(i, j) for i in at.tolist() for j in np.asarray(rows).tolist()}
        products += score.size
    assert {(i, j) for i, j in zip(*np.nonzero(s >= tau[:, None]), strict=True)} <= seen
    assert products < 0.8 * s.size


def test_best_keeps_the_order():
    best = V.Best(2, 3)
    best.add(np.array([0, 0, 1]), np.array([5, 5, -1]), np.array([9, 2, 4]), np.zeros(3, bool))
    best.add(np.array([0, 0, 0]), np.array([5, 7, 5]), np.array([2, 1, V.NO_ID]), np.array([False, False, True]))
    assert best.score[0].tolist() == [7, 5, 5] and best.id[0].tolist() == [1, 2, 2]
    assert [x.tolist() for x in best.entries()][0] == [0, 0, 0, 1]


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain_search(docs, items, k):
    own = [(d, Counter(w), len(w)) for d, t in docs if (w := plain_terms(t))]
    n_docs, total = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for i, text in {(i, t) for i, t in items}:
        asked = [t for t in plain_terms(text) if df[t]]
        found = []
        for d, c, n in own:
            m = 25 + 75 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if s > 0:
                found.append((-s, last(d), d))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(params=["messy", "empty", "small"])
def docs(request):
    return request.getfixturevalue(request.param)


ITEMS = [(1, "The quick brown FOX, the quick fox"), (2, "Entchen Köpfchen, morgen!"), (3, None), (4, ""), (5, "zzzz nothing of it"), (6, "word a b 漢🙂"),
         (None, "merry song"), (7, "shared line row 12"), (7, "line"), (1, "The quick brown FOX, the quick fox"), (8, "-- ,;. \x00"), (9, "license " * 50)]


def test_lexical_search(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    some = [w for w in (" ".join((t or "").split()[:12]) for _, t in rows[:20]) if w]
    items = ITEMS + [(100 + i, w) for i, w in enumerate(some)]
    asked = spark.createDataFrame([(*x, "clash") for x in items], "item_id bigint, text string, doc_id string")
    want = plain_search(rows, items, 10)
    assert got(bag_search.search(docs, asked)) == want
    # blocks of items, each with its own vocabulary, change nothing
    assert got(bag_search.search(docs, asked, block_bytes=600)) == want


def test_each_part_is_met_in_a_task_of_its_own(spark):
    """Also if a fifth of the seekers visit one part; parts without blocks or seekers give nothing."""
    parts = 13
    blocks = spark.range(parts - 1).select(F.col("id").cast("int").alias("part"), F.lit(0).alias("block"), "id")
    visits = spark.range(1, 200).select(F.when(F.col("id") % 5 == 0, 3).otherwise(F.col("id") % parts).cast("int").alias("part"), F.col("id").alias("key"))

    def search(held, some):
        n = some.num_rows
        columns = [pa.array([held[0]["id"]] * n), pa.array([TaskContext.get().partitionId()] * n), some.column("key")]
        yield pa.RecordBatch.from_arrays(columns, ["part", "task", "key"])

    rows = V.meet(blocks, visits, parts, ["key"], lambda row: row, search, "part bigint, task bigint, key bigint").collect()
    assert {(r.part, r.task) for r in rows} == {(i, i) for i in range(parts - 1)}
    want = [(3 if i % 5 == 0 else i % parts, i) for i in range(1, 200)]
    assert sorted((r.part, r.key) for r in rows) == sorted(x for x in want if x[0] < parts - 1)


def test_lexical_search_without_items(spark, small):
    asked = spark.createDataFrame([(3, None)], "item_id bigint, text string")
    assert bag_search.search(small, asked).count() == 0


def test_classes_are_scored_once_and_expanded(spark):
    """Hundreds of copies in many tasks are one class; the smallest ids are ranked, NULL last."""
    rows = [(1000 - i, "alpha beta gamma") for i in range(600)] + [(None, "alpha beta gamma")] * 3 + [(5000, "alpha delta"), (5001, "epsilon")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    items = spark.createDataFrame([(1, "beta"), (2, "delta alpha")], "item_id bigint, text string")
    assert got(bag_search.search(docs, items)) == plain_search(rows, [(1, "beta"), (2, "delta alpha")], 10)
    bag = bag_search.bags(docs, {b"alpha": 0, b"beta": 1}, "doc_id", "text")
    pieces = bag_search.classes(bag, (605, 1800), 10).collect()
    assert len({(r.m, bytes(r.bag)) for r in pieces}) == 2 and max(len(r.members) for r in pieces) <= 10 and len(pieces) <= 10


def test_large_sums_are_exact():
    lists = bag_search.Items([Counter({b"a": 3, b"b": 1}), Counter({b"b": 1 << 21})], {b"a": 0, b"b": 1})
    lists.weight[:] = [12345, 6789]
    s = lists.scores(np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([2, 5, 1]), np.array([80, 80, 33]), 2)
    part = lambda tf, m: 10**9 * tf // (1000 * tf + 8 * m)
    assert s.tolist() == [[12345 * part(2, 80) * 3 + 6789 * part(5, 80), 6789 * part(5, 80) << 21], [6789 * part(1, 33), 6789 * part(1, 33) << 21]]
