"""Column and dataset profiles against brute force on small frames."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tablelens.functions.parsing import timestamp
from tablelens.functions.text import as_text
from tablelens.operators import frequencies
from tablelens.operators.dataset import dataset_profile, duplicate_rows
from tablelens.operators.frequencies import column_frequencies, read_numbers
from tablelens.operators.profile import column_profile, column_statistics, custom_pattern_ratio, detect_patterns
from tablelens.operators.quantiles import quantile_ctes, slice_sql


def by_name(df):
    return {r["physical_name"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def profile(spark):
    long_text = "x" * 300 + " end"
    rows = [
        (f"k{i}", str(i - 50), f"{i * 1.5:.2f}" if i % 4 else None, "yes" if i % 3 else "no",
         f"2024-01-{i % 28 + 1:02d}", f"user{i % 7}@mail.org", long_text if i % 3 == 0 else "short", None)
        for i in range(100)
    ]
    df = spark.createDataFrame(
        rows, "`Row Id` string, whole string, part string, flag string, day string, mail string, body string, empty string")
    return by_name(column_profile(df, "t"))


def test_counts_and_ratios(profile):
    part = profile["part"]
    assert (part.row_count, part.null_count, part.non_null_count, part.distinct_count) == (100, 25, 75, 75)
    assert part.null_ratio == 0.25 and part.cardinality_ratio == 1.0 and part.duplicate_count == 0
    assert profile["mail"].duplicate_count == 93
    empty = profile["empty"]
    assert (empty.non_null_count, empty.cardinality_ratio, empty.mean, empty.sample_values) == (0, 0.0, None, [])
    assert len(empty.warnings) == 1


def test_numbers(profile):
    whole = profile["whole"]
    values = np.arange(100) - 50.0
    assert (whole.min_value, whole.max_value) == (-50.0, 49.0)
    assert whole.mean == pytest.approx(values.mean()) and whole.std_dev == pytest.approx(values.std(ddof=1))
    assert [whole.q25, whole.q50, whole.q75] == pytest.approx(list(np.percentile(values, [25, 50, 75])))
    assert whole.dominant_patterns == ["NUMERIC"]
    assert profile["part"].dominant_patterns == ["DECIMAL_2DP", "NUMERIC"]


def test_shapes(profile):
    assert profile["flag"].boolean_parse_ratio == 1.0
    assert profile["day"].datetime_parse_ratio == 1.0
    assert profile["day"].dominant_patterns == ["YYYY-MM-DD", "PHONE"]
    assert profile["mail"].dominant_patterns == ["EMAIL"]
    assert profile["Row Id"].normalized_key == "row_id"


def test_long_values_come_back_whole(profile):
    body = profile["body"]
    assert body.distinct_count == 2 and body.max_string_length == 304 and body.min_string_length == 5
    assert body.representative_values == ["short", "x" * 300 + " end"]


def test_long_values_sort_by_their_characters(spark):
    """One order for all lengths, and beginnings that many values share."""
    rng = random.Random(8)
    values = ["m" * n for n in (1, 255, 256, 257, 300, 2000)] + ["a" * 400, "z", "", "a" * 399 + "b", "é" * 300]
    values += ["same beginning " * 30 + f"{i:03d}" for i in rng.sample(range(200), 60)]
    rows = [(v, v[::-1]) for v in values] * 2 + [(values[-1], None)] * 3
    found = by_name(column_profile(spark.createDataFrame(rows, "a string, b string").repartition(7)))
    for name, column in (("a", 0), ("b", 1)):
        present = [r[column] for r in rows if r[column] is not None]
        counts = {v: present.count(v) for v in present}
        assert found[name].sample_values == sorted(counts, key=lambda v: v.encode())[:10]
        assert found[name].representative_values == sorted(counts, key=lambda v: (-counts[v], v.encode()))[:10]
        assert found[name].distinct_count == len(counts)


def test_top_values_and_samples(profile):
    assert profile["flag"].representative_values == ["yes", "no"]
    assert profile["whole"].sample_values == sorted(str(i - 50) for i in range(100))[:10]


def test_partitioning_does_not_matter(spark):
    df = spark.range(1000).selectExpr("id % 37 AS a", "string(id * 7 % 91) AS b", "double(id) / 3 AS c")
    one, many = (sorted(map(str, column_profile(df.repartition(n), "t").collect())) for n in (1, 16))
    def coarse(rows):
        return [r[:200] for r in rows]
    assert coarse(one) == coarse(many)


@pytest.mark.parametrize("threshold", [1 << 20, 0])
def test_quantiles_match_numpy(spark, threshold):
    rng = random.Random(3)
    data = {
        0: [rng.gauss(0, 1) * 10 ** rng.randint(-8, 8) for _ in range(400)],
        1: [5.0] * 300 + [float(i) for i in range(100)],
        2: [-1.0, 0.0, 1e-300, 1e300, 7.25],
        3: [42.0],
    }
    rows = [(pos, value, 1) for pos, values in data.items() for value in values]
    freq = spark.createDataFrame(rows, "pos int, num double, one int").groupBy("pos", "num").count()
    values = freq.selectExpr("pos", "num", "count AS cnt", f"{slice_sql('num')} AS slice")
    wanted = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    sql = f"""WITH v AS (SELECT * FROM {{values}}),
      s AS (SELECT pos, slice, sum(cnt) AS num_count, count(*) AS num_distinct, min(num) AS num_min, max(num) AS num_max
            FROM v GROUP BY pos, slice),
      {quantile_ctes('v', 's', wanted, threshold)} SELECT * FROM quantiles"""
    got = {r["pos"]: r["quantiles"] for r in spark.sql(sql, values=values).collect()}
    for pos, expected in data.items():
        assert got[pos] == pytest.approx(list(np.percentile(expected, [p * 100 for p in wanted])), rel=1e-12, abs=1e-300)


def test_slices_keep_order(spark):
    values = sorted([-1e300, -2.0, -1.0, -1e-9, 0.0, 1e-300, 1e-9, 1.0, 1.0000001, 2.0, 3.0, 1e300, float("inf"), float("-inf")])
    rows = spark.createDataFrame([(v,) for v in values], "x double").selectExpr("x", f"{slice_sql('x')} AS s").collect()
    slices = [r["s"] for r in sorted(rows, key=lambda r: r["x"])]
    assert slices == sorted(slices)


def test_number_reading(spark):
    texts = [" 5 ", "1e3", "-.5", "inf", "1d", "0x1F", "1_000", "1,000", "True", "12.", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    numbers = {r["num"] for r in read_numbers(column_frequencies(df)).collect()}
    assert numbers == {5.0, 1000.0, -0.5, float("inf"), 12.0}


def test_date_reading(spark):
    cases = {
        "2024-02-29": "2024-02-29", "2024-02-30": None, "2024-01-05 10:11:12": "2024-01-05", "01/31/2024": "2024-01-31",
        "31/01/2024": "2024-01-31", "20240115": "2024-01-15", "2024-01": "2024-01-01", "2024": "2024-01-01",
        "15.01.2024": "2024-01-15", "5 Mar 2024": "2024-03-05", "Mar 5, 2024": "2024-03-05", "5 Foo 2024": None,
        "01/02/2024 10:30": "2024-01-02", "31/01/2024 10:30:05": "2024-01-31", "2024/01/15 10:00:00": "2024-01-15", "2024-01-15T10:30Z": "2024-01-15",
        "2024-01-15T10:30:00.5+02:00": "2024-01-15", "15-Jan-2024": "2024-01-15", "15 January 2024": "2024-01-15", "January 15, 2024": "2024-01-15",
        "Janua 15, 2024": None, "12/31/69": "1969-12-31", "31/12/68": "2068-12-31", "5-Mar-2024 7:05": "2024-03-05", "2024 10:30": None,
        "2024/1/5": "2024-01-05", "12:30": None, "100": None, "12345": None, "9999-12-31": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", timestamp("t").cast("date").cast("string").alias("d")).collect()}
    assert got == cases


def test_mixed_formats_count_the_best_one(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-03 10:00:00",), ("x",)], "t string")
    assert column_statistics(df).first()["datetime_parse_ratio"] == 0.5


def test_nan_and_negative_zero(spark):
    df = spark.createDataFrame([(float("nan"),), (0.0,), (-0.0,), (1.5e9,), (0.00025,)], "x double")
    row = column_profile(df).first()
    assert (row.null_count, row.distinct_count) == (1, 3)
    assert row.sample_values == ["0.0", "0.00025", "1500000000.0"]


def test_typed_values_read_as_their_texts(spark):
    """Columns counted as numbers and times have the profile of their texts, also where texts are spelled specially."""
    rng = random.Random(5)
    whole = [0, 1, 2, -1, 1677, 1678, 2024, 2261, 2262, 9999, 9999999, 10000000, 16771231, 16780101, 20240230, 20240229, 22611231, 22620101,
             -20240229, 2**53 + 1, 2**63 - 1, -(2**63)] + [rng.randint(-(10**e), 10**e) for e in range(1, 19) for _ in range(8)]
    real = [0.0, -0.0, 1.0, 0.25, -0.25, 12.34, -12.34, 1e7, 9999999.99, 12345678.9, 1e15 + 0.125, 1e16, 1e-3, 1e-4, 1.5e-4, -2.5e-4, 9.9e-5,
            0.00012345678901234567, 0.00012345678901234569, 1e300, float("inf"), float("-inf"), float("nan"), None]
    real += [rng.gauss(0, 1) * 10 ** rng.randint(-6, 18) for _ in range(100)] + [round(rng.gauss(0, 1) * 10**5, 2) for _ in range(50)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # 02:30 comes twice on 2024-10-27
    try:
        df = spark.createDataFrame(
            [(w, real[i % len(real)], 1729984000 + 1800 * (i % 20)) for i, w in enumerate(whole)] + [(None, None, None)], "whole long, real double, at long"
        ).selectExpr("whole", "int(try_cast(whole AS int)) AS small", "real", "timestamp_seconds(at) AS clock",
                     "timestamp_micros(try_multiply(at, 999983)) AS micros", "timestamp_ntz '1677-01-01' + make_interval(at % 600) AS local",
                     "float(real) AS single", "whole > 5 AS flag")
        texts = df.select(*[as_text(df, name).alias(name) for name in df.columns])
        typed, text = (by_name(column_profile(d)) for d in (df, texts))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for name in df.columns:
        a, b = typed[name].asDict(), text[name].asDict()
        for field in a:
            if field == "dtype":
                continue
            assert a[field] == b[field] or a[field] == pytest.approx(b[field], rel=1e-12, nan_ok=True), (name, field)
    assert typed["clock"].distinct_count == 18


@pytest.mark.parametrize("share", [1, 3, 1024])
def test_bounded_lists_equal_sorted_ones(spark, monkeypatch, share):
    """What a share of the values rules out is never among the first ones, whatever the share."""
    monkeypatch.setattr(frequencies, "BOUND_SHARE", share)
    rng = random.Random(11)
    rows = [(int(rng.paretovariate(0.7)) % 5000, f"same beginning {rng.randint(0, 40000):06d}", rng.choice(["x" * 256, "x" * 300 + str(rng.randint(0, 30)), "y", "", None]),
             rng.choice([7, 8])) for _ in range(30000)]
    found = by_name(column_profile(spark.createDataFrame(rows, "a int, b string, c string, d long").repartition(5)))
    for column, name in enumerate("abcd"):
        counts = {}
        for row in rows:
            if row[column] is not None:
                counts[str(row[column])] = counts.get(str(row[column]), 0) + 1
        assert found[name].sample_values == sorted(counts)[:10]
        assert found[name].representative_values == sorted(counts, key=lambda v: (-counts[v], v))[:10]


def test_counted_values_are_read_four_times(spark):
    """Statistics, quantiles, bounds and lists read the counted values once each; numbers and times are counted untouched."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = column_profile(spark.range(100).selectExpr("id", "id / 7 AS part", "timestamp_seconds(id) AS at", "string(id) AS name"))
        lines = plan._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    final = [line for line in lines if "HashAggregate(keys=[pos" in line and "val#" in line and "functions=[count(1)" in line]
    assert 0 < len(final) <= 4
    counted = column_frequencies(spark.range(9).selectExpr("id", "timestamp_seconds(id) AS at"))
    below = counted._jdf.queryExecution().sparkPlan().toString().split("partial_count")[1]
    assert "timestamp_seconds" in below and "as string" not in below


def test_patterns(spark):
    df = spark.createDataFrame([("ab12",), ("ab",), ("xab1",), (None,)], "t string")
    assert custom_pattern_ratio(df, "t", "ab").first()[0] == pytest.approx(2 / 3)
    stamps = spark.createDataFrame([("2024-01-01 10:00:00",), ("x",)], "t string")
    found = {r["pattern"]: r["dominant"] for r in detect_patterns(stamps, "t").collect()}
    assert found["ISO_DATETIME"] and not found["EMAIL"]


def test_dataset_profile(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (1, "a", None), (2, "b" * 90, None), (2, "b" * 90, None), (3, None, None)],
        "`A b` int, `a-B` string, c string")
    row = dataset_profile(df).first()
    assert (row.row_count, row.duplicate_row_count, row.column_count) == (5, 2, 3)
    assert row.normalized_keys == ["a_b", "a_b_1", "c"] and row.duplicate_keys == ["a_b"]
    assert duplicate_rows(df, ["c"]).first()["duplicate_row_count"] == 4


def shape(df):
    """(file scans, expands, exchanges read again) of the plan as it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Scan parquet") or plan.count("FileScan"), plan.count("Expand "), plan.count("ReusedExchange")


def test_one_scan(spark):
    from tablelens.operators import cubes, hierarchy

    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    scans, expands, again = shape(cubes.cube_cells(lines, ["l_returnflag", "l_linestatus", "l_suppkey"], "l_quantity"))
    assert (scans, expands) == (1, 0) and again > 0
    assert shape(dataset_profile(lines))[0] == 1
    assert shape(hierarchy.validate_edges(lines, [("l_returnflag", "l_linestatus"), ("l_linestatus", "l_suppkey")]))[0] == 1
    assert shape(column_profile(lines.drop("l_returnflag", "l_linestatus")))[0] == 1


def test_empty_table_has_a_profile(spark):
    rows = column_profile(spark.createDataFrame([], "a string, b double")).collect()
    assert [(r.row_count, r.cardinality_ratio) for r in rows] == [(0, 0.0), (0, 0.0)]
