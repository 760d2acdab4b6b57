"""Profile states of parts add up to the state of the whole."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tablelens.operators.profile import column_profile
from tablelens.operators.states import DISTINCT_ERROR, RANK_ERROR, column_states, merged_states, state_profile

EXACT = ["row_count", "non_null_count", "null_count", "min_value", "max_value", "mean", "std_dev", "min_string_length", "max_string_length",
         "avg_string_length"]


def test_parts_add_up(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 50) if i % 5 else None, f"t{rng.randrange(4000)}", None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "a long, x double, t string, nothing string")
    parts = [column_states(df.where(f"a % 3 = {k}")) for k in range(3)]
    # states survive being written, which is what they are for
    merged = merged_states(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    got = {r["physical_name"]: r for r in state_profile(merged).collect()}
    want = {r["physical_name"]: r for r in column_profile(df).collect()}
    for name in ("a", "x"):
        for c in EXACT:
            assert got[name][c] == pytest.approx(want[name][c], rel=1e-9), (name, c)
    for name, w in want.items():
        assert abs(got[name]["distinct_estimate"] - w["distinct_count"]) <= max(1, DISTINCT_ERROR * w["distinct_count"])
    values = np.sort([x for _, x, _, _ in rows if x is not None])
    for p, q in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
        assert abs(np.searchsorted(values, got["x"][q]) / len(values) - p) <= RANK_ERROR
    assert got["nothing"]["q50"] is None and got["nothing"]["distinct_estimate"] == 0


def test_empty_part(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "a long, t string")
    merged = merged_states(column_states(df).unionByName(column_states(df.limit(0))))
    got = {r["physical_name"]: r for r in state_profile(merged).collect()}
    assert (got["t"]["row_count"], got["t"]["null_count"], got["a"]["max_value"]) == (2, 1, 2.0)
    empty = {r["physical_name"]: r["row_count"] for r in state_profile(column_states(df.limit(0))).collect()}
    assert empty == {"a": 0, "t": 0}
