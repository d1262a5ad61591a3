"""Hard negatives against brute force over Python integers."""

import math
import random

import numpy as np
import pytest

from glyphline.llm import hard_negatives as hn
from glyphline.llm import topk_search
from tests.conftest import compare_with_duckdb

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, anchor_id int"


def _brute(rows, anchors, positives=5, negatives=5, percent=80):
    """Rows as ``mine`` returns them; rows and anchors are (id, label, weights)."""
    out = []
    for i, lab, a in {(i, lab, tuple(w)) for i, lab, w in anchors}:
        scored = sorted((-sum(x * y for x, y in zip(a, w)), j, other) for j, other, w in rows if j != i)
        for s, p, _ in [x for x in scored if x[2] == lab][:positives]:
            fits = [x for x in scored if x[2] != lab and percent * -s <= 100 * -x[0] <= 100 * -s]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(fits[:negatives])]
    return sorted(out)


def _compare(spark, rows, is_anchor, **how):
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    good = hn.quantize(table)
    q = [(r.id, r.label, r.weights) for r in good.collect()]
    picked = good.where(is_anchor)
    mine = [(r.id, r.label, r.weights) for r in picked.collect()]
    got = hn.mine(good, picked, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = _brute(q, mine, **{k: v for k, v in how.items() if k != "batch"})
    assert sorted(map(tuple, got.collect())) == want
    return want


@pytest.fixture
def rows():
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(4)]
    out = [(i, [c + rng.gauss(0, 0.7) for c in centres[i % 4]], rng.choice((i % 4, 9))) for i in range(600)]
    out += [(600 + i, out[i][1], (out[i][2] + 1) % 10) for i in range(40)]  # copies of other labels: ties
    out += [(20, out[20][1], out[20][2]), (700, None, 1), (701, [1.0, None], 1), (702, [math.nan] * 24, 1), (703, [math.inf], 1), (704, [1.0] * 24, None), (None, [1.0] * 24, 1)]
    out += [(705, [], 2), (706, [0.5, 0.25], 1), (707, [0.0] * 24, 3), (708, [1e300, 1.0], 1), (709, [1.0] * 40, 2)]
    return out


def test_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 64)
    monkeypatch.setattr(hn, "TILE", 7)
    monkeypatch.setattr(hn, "PAIRS", 100)
    assert len(_compare(spark, rows, "id % 20 = 0 or id > 700")) > 300
    assert _compare(spark, rows, "id % 20 = 0", batch=9, positives=2, negatives=3, percent=50)
    monkeypatch.setattr(hn, "SEED_ROWS", 40)
    monkeypatch.setattr(hn, "FIT_ROWS", 10)
    monkeypatch.setattr(hn, "ROTATED", 16)
    assert _compare(spark, rows, "id % 20 = 0", percent=0)


def test_hot_vector_and_odd_tables(spark):
    same = [(i, [0.5, 0.5, 0.1], i % 2) for i in range(300)]  # one vector for all
    assert len(_compare(spark, same, "id % 100 = 0")) == 75
    assert _compare(spark, [(1, [-1.0], 0), (2, [1.0], 0), (3, [0.5], 1)], "id = 1") == []  # scores below zero
    assert _compare(spark, [(1, [1.0], 0), (2, [1.0], 1)], "id = 1") == []  # no positive
    assert _compare(spark, [(1, [1.0], 0), (2, [0.0], 0), (3, [0.0], 1)], "id = 1") == [(1, 2, 1, 3, 0, 0)]
    assert _compare(spark, same, "id < 0") == []
    assert _compare(spark, [(None, None, None)], "true") == []
    large = [(i, [(-1) ** i * 2.0**20 * (i + 1), 2.0**21], i % 3) for i in range(20)]  # products beyond 2^53
    assert any(abs(r[4]) > 1 << 53 for r in _compare(spark, large, "id % 2 = 0"))


def test_bounds_hold(rows):
    """Partial products and what is left of the lengths bound every product, at every cut."""
    whole = np.array([[math.floor(256 * x) for x in v] for _, v, _ in rows[:300]], np.int64)
    rng = np.random.default_rng(1)
    rotation = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    cuts = hn._cuts(24)
    r, slack = hn._Rotated(whole, rotation, cuts), hn._slack(rotation, 24)
    exact = whole @ whole.T
    for n, c in enumerate(cuts):
        room = np.multiply.outer(r.rest[n], r.rest[n]) + slack * np.multiply.outer(r.length, r.length)
        part = r.turned[:, :c] @ r.turned[:, :c].T
        assert (part + room >= exact).all() and (part - room <= exact).all()


def test_query_against_sql(spark):
    got, want = compare_with_duckdb(spark, "op12_hard_negatives")
    assert got == want


def test_huge_components_take_no_part(spark):
    rows = [(1, [1e300]), (2, [1e300]), (3, [2.0**22, 2.0**22]), (4, [2.0**22]), (5, [2.0**24])]
    good = topk_search.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r.query_id, r.vec_id): r.score for r in topk_search.top_k(good, good, 5).collect()}
    assert got == {(3, 4): 1 << 60, (4, 3): 1 << 60}
