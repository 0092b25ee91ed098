"""Chance-corrected agreement and reliability by EM against plain versions."""

import math
import random

import pytest

from conftest import SF_SMALL
from dialoglab.operators import reliability as Q
from dialoglab.plans.catalog import QUERIES
from dialoglab.plans.fixtures import fx_annotations

COLUMNS = ["id"] + [f"{f}_{k}" for k in (1, 2, 3) for f in ("annotator", "manipulative", "technique")]


def table(seed=1, n=300):
    """Annotators of known quality; a tenth of the votes is blank, lists may be empty or repeat a label."""
    rng = random.Random(seed)
    good = {f"A{i}": 0.95 - 0.08 * (i % 6) for i in range(8)}
    rows = []
    for i in range(n):
        truth = int(rng.random() < 0.6)
        row = [str(i)]
        for a in rng.sample(sorted(good), 3):
            v = truth if rng.random() < good[a] else 1 - truth
            blank = rng.random() < 0.1
            labels = rng.sample(["Denial", "Evasion", "Accusation"], rng.randint(0, 2)) if v else []
            row += [a, "" if blank else str(v), ",".join(labels + labels[:1])]
        rows.append(tuple(row))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS)).repartition(4)


def plain_alpha(rows, sets):
    jaccard = lambda a, b: 0.0 if not a | b else 1 - len(a & b) / len(a | b)
    units = []
    for r in rows:
        cells = [r[1 + 3 * k : 4 + 3 * k] for k in range(3)]
        votes = [frozenset(x for x in t.split(",") if x) if sets else frozenset([v]) for _, v, t in cells if v in ("0", "1")]
        if len(votes) >= 2:
            units.append(votes)
    every = [v for u in units for v in u]
    n = len(every)
    observed = sum(sum(jaccard(a, b) for a in u for b in u) / (len(u) - 1) for u in units) / n
    expected = sum(jaccard(a, b) for a in every for b in every) / n / (n - 1)
    return len(units), n, observed, expected, 1 - observed / expected


@pytest.mark.parametrize("measure", ["manipulative", "technique"])
def test_alpha(spark, measure):
    rows = table()
    got = Q.alpha(frame(spark, rows), measure).first()
    assert [pytest.approx(x, abs=2e-6) for x in plain_alpha(rows, measure == "technique")] == list(got)


def test_alpha_without_disagreement_or_votes(spark):
    same = [(str(i), "a", "1", "Denial", "b", "1", "Denial", "c", "", "") for i in range(4)]
    assert list(Q.alpha(frame(spark, same)).first()) == [4, 8, 0.0, 0.0, None]
    none = [("1", "a", "", "", "b", "1", "", "c", "", "")]
    assert Q.alpha(frame(spark, none)).first().alpha is None


def plain_em(rows, rounds=50, tol=1e-7):
    units = [sorted((r[1 + 3 * k], int(r[2 + 3 * k])) for k in range(3) if r[2 + 3 * k] in ("0", "1")) for r in rows]
    units = [u for u in units if u]
    p = [sum(v for _, v in u) / len(u) for u in units]
    share, rates = 0.5, {}
    for _ in range(rounds):
        cells = {}
        for u, x in zip(units, p, strict=True):
            for a, v in u:
                c = cells.setdefault(a, [0.0] * 4)
                for k, y in enumerate((x, x * v, 1 - x, (1 - x) * (1 - v))):
                    c[k] += y
        old, share = share, (sum(p) + 1) / (len(p) + 2)
        before, rates = rates, {a: ((c[1] + 1) / (c[0] + 2), (c[3] + 1) / (c[2] + 2)) for a, c in cells.items()}
        p = []
        for u in units:
            pos, neg = math.log(share), math.log(1 - share)
            for a, v in u:
                s, t = rates[a]
                pos += math.log(s if v else 1 - s)
                neg += math.log(1 - t if v else t)
            p.append(1 / (1 + math.exp(neg - pos)))
        if before and abs(share - old) < tol and all(abs(x - y) < tol for a in rates for x, y in zip(rates[a], before[a], strict=True)):
            break
    return share, rates


def test_em_against_a_plain_version(spark):
    rows = table()
    share, rates = plain_em(rows)
    got_share, got = Q.estimate_rates(frame(spark, rows))
    assert got_share == pytest.approx(share, abs=1e-6)
    assert {a: pytest.approx(r[:2], abs=1e-6) for a, r in got.items()} == rates
    assert rates["A0"][0] > rates["A5"][0]  # the better annotator is found to be better


def test_labels_follow_the_reliable_annotators(spark):
    """Two poor annotators against a good one: the vote goes one way, the estimate the other."""
    rng = random.Random(7)
    rows = []
    for i in range(400):
        truth = int(rng.random() < 0.5)
        say = lambda q: str(truth if rng.random() < q else 1 - truth)  # noqa: B023, E731
        rows.append((str(i), "good", say(0.98), "", "fair", say(0.9), "", f"poor{i % 2}", say(0.52), ""))
    rows += [("x", "good", "1", "", "poor0", "0", "", "poor1", "0", ""), ("y", "good", "", "", "fair", "", "", "poor1", "", "")]
    out = {r.id: r for r in Q.reliable_labels(frame(spark, rows)).collect()}
    assert out["x"].manipulative == "1" and out["x"].probability > 0.8
    assert out["y"].manipulative is None and out["y"].probability is None
    assert len(out) == len(rows)


def test_registered_query_against_the_plain_version(spark):
    ann = fx_annotations(spark, SF_SMALL).select(*COLUMNS).collect()
    share, rates = plain_em([tuple(r) for r in ann], rounds=20)
    got = {r.annotator: (r.sensitivity, r.specificity) for r in QUERIES["annotator_reliability"](spark, SF_SMALL).collect()}
    assert {a: pytest.approx(r, abs=2e-6) for a, r in rates.items()} == got
