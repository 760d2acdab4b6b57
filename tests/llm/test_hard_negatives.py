from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm.hard_negatives import CoverTree, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rank string"


def brute(rows, positives=5, negatives=3):
    """All rows against all anchors, with Python's own integers."""
    kept = []
    for place, (i, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((i, [math.floor(256 * x) for x in vector], label, place))
    out = []
    for i, v, label, place in kept:
        if i is None or i % 50:
            continue

        def scored(same):
            found = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, p, j) for j, w, other, p in kept
                     if len(w) == len(v) and p != place and (other == label) == same]
            return sorted(found)

        for score, _, _, _, j in scored(True)[:positives]:
            ps = -score
            window = [x for x in scored(False) if 50 * ps <= -100 * x[0] <= 95 * ps][:negatives]
            out += [(i, j, rank + 1, x[4], ps, -x[0]) for rank, x in enumerate(window)]
    return sorted(out, key=str)


def sample(seed, dimension=16, n=700, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dimension)) * 0.3
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.standard_normal(dimension) * rng.choice([0.0, 0.01, 0.1, 0.3])
        rows.append((i, v.tolist(), int(rng.integers(labels))))
    same = rows[0][1]
    rows += [(50 * k, same, 1) for k in range(3)] + [(1000 + k, same, k % 2) for k in range(300)]
    rows += [(None, same, 1), (None, same, 2), (5000, None, 1), (5050, same, None), (5100, [float("nan")] * dimension, 1),
             (5150, [None] + same[1:], 1), (5200, [float("inf")] + same[1:], 1), (5250, [0.0] * dimension, 1), (5300, same[:3], 1),
             (5301, same[:3], 1), (5302, same[:3], 2), (5350, [], 1), (5351, [], 1), (5352, [], 2), (5400, [-x for x in same], 3)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"group_rows": 100, "anchor_group": 7, "cell_rows": 33}])
def test_equals_brute_force(spark, sizes):
    rows = sample(1)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = hard_negatives(df, F.col("vec_id") % 50 == 0, **sizes).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_windows_of_zero_and_negative_scores(spark):
    rows = [(0, [0.01, 0.0], 1), (1, [0.0, 1.0], 1), (2, [-1.0, 0.0], 1), (3, [0.0, 2.0], 2), (4, [-0.3, 1.0], 2), (5, [0.9, 0.0], 1), (6, [0.7, 0.2], 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = hard_negatives(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_huge_components_do_not_crash(spark):
    rows = [(0, [1e300, 1.0], 1), (1, [1e9, 2.0], 1), (2, [1e300, 0.0], 2), (50, [3e7, 1.0], 1), (3, [2.5e7, 1.0], 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {(r["anchor_id"], r["positive_id"], r["negative_id"]): r["negative_score"] for r in hard_negatives(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == {k: v for k, v in got.items() if abs(v) <= (2**63 - 1) // 100}


def test_cover_tree_covers_and_bounds():
    rng = np.random.default_rng(0)
    vectors = np.floor(256 * (rng.standard_normal((40, 8))[rng.integers(40, size=2000)] + rng.standard_normal((2000, 8)) * 0.05))
    tree = CoverTree(vectors)
    assert len(tree.leaves) > 10
    seen = []
    for node, (a, b) in enumerate(tree.children):
        members = tree.order[tree.first[node]:tree.last[node]]
        assert tree._distances(tree.centre[node], members).max() <= tree.radius[node]
        if a == b:
            seen += members.tolist()
            assert (np.diff(members) > 0).all()
        else:
            assert sorted(members) == sorted(m for c in range(a, b) for m in tree.order[tree.first[c]:tree.last[c]])
            # members of a child lie within half the radius of its centre
            assert max(tree.radius[a:b]) <= tree.radius[node] / 2 + 1e-9
    assert sorted(seen) == list(range(2000))
    anchors = rng.standard_normal((5, 8)) * 256
    for node in range(len(tree.centre)):
        members = tree.order[tree.first[node]:tree.last[node]]
        middle = anchors @ vectors[tree.centre[node]]
        reach = np.sqrt((anchors * anchors).sum(axis=1)) * tree.radius[node]
        products = anchors @ vectors[members].T
        assert (products <= (middle + reach)[:, None] + 1e-6).all() and (products >= (middle - reach)[:, None] - 1e-6).all()


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(df, F.col("vec_id") % 50 == 0).collect() == []
    no_anchor = spark.createDataFrame([(1, [1.0], 1, "x")], SCHEMA)
    assert hard_negatives(no_anchor, F.col("vec_id") % 50 == 0).collect() == []
