from __future__ import annotations

import numpy as np
import pytest

from tablelens.llm.caps import cap_components, decode


def brute(rows, cosine=0.98):
    """(id, links, component) per row."""
    units = []
    for _, vector, label in rows:
        fit = label is not None and vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector)
        units.append(np.array(vector, float) / np.linalg.norm(np.array(vector, float)) if fit else None)
    n = len(rows)
    near = [[a != b and rows[a][2] == rows[b][2] and units[a] is not None and units[b] is not None
             and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine for b in range(n)] for a in range(n)]
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            todo += [b for b in range(n) if near[x][b] and b not in seen and not seen.add(b)]
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        out.append((str(rows[a][0]), sum(near[a]), min(ids) if ids else None))
    return sorted(out, key=str)


def sample(seed=3, dimension=32):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (1, 2):
        for _ in range(40):
            centre = rng.standard_normal(dimension)
            for _ in range(rng.integers(1, 5)):
                v = centre + rng.standard_normal(dimension) * rng.choice([0.0, 0.05, 0.12, 0.3])
                rows.append((i, (v * rng.choice([1.0, 3.0])).astype(np.float32).tolist(), label))
                i += 1
    crowd = rng.standard_normal(dimension)
    for _ in range(60):
        rows.append((i, (crowd + rng.standard_normal(dimension) * 0.06).astype(np.float32).tolist(), 1))
        i += 1
    same = rows[0][1]
    return rows + [(i + k, same, 1) for k in range(20)] + [(i + 30, same, 2), (i + 31, same, None), (i + 32, None, 1), (i + 33, [], 1), (i + 34, [0.0] * dimension, 1),
            (i + 35, [float("nan")] * dimension, 1), (i + 36, [float("inf")] + same[1:], 1), (i + 37, [None] + same[1:], 1), (i + 38, same[:5], 1), (None, same, 1),
            (0, same, 1), (i + 39, [1e-30] * dimension, 2), (i + 40, [1e30] * dimension, 2), (i + 41, [3.0], 1), (i + 42, [5.0], 1)]


@pytest.mark.parametrize("block", [1024, 16])
def test_links_and_components_equal_brute_force(spark, block):
    rows = sample()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = sorted(((str(r["id"]), r["n_links"], r["component"]) for r in cap_components(df, block=block).collect()), key=str)
    want = brute(rows)
    assert len(got) == len(want)
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.99 * len(want)


def test_recall_at_the_threshold():
    """Pairs at a cosine of exactly 0.98 share a cap."""
    rng = np.random.default_rng(1)
    for points in (500, 5_000, 500_000):
        x = rng.standard_normal((400, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = rng.standard_normal(x.shape)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        y = 0.98 * x + np.sqrt(1 - 0.98 ** 2) * z
        shared = [bool(set(a.tolist()) & set(b.tolist())) for a, b in zip(decode(x, points), decode(y, points), strict=True)]
        assert np.mean(shared) >= 0.99, (points, np.mean(shared))


def test_empty_table(spark):
    assert cap_components(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
