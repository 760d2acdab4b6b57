"""A catalogue gives what single runs give, from one shuffle of all cells."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tablelens.plans.catalogue import catalogue_profile, catalogue_run
from tablelens.plans.run import run

SF = "/root/testdata/sf0.001"
DOMAINS = {"customer": "Customer", "orders": "Payments", "nation": "Customer", "supplier": "Finance", "part": "Payments"}
METADATA = [{"dataset": "orders", "column_name": "o_orderkey", "mandatory": True, "expected_unique": True, "description": "key"},
            {"dataset": "customer", "column_name": "c_name", "mandatory": True},
            {"dataset": "part", "column_name": "nowhere", "expected_unique": True}]
RULES = [{"dataset": "orders", "rule_key": "positive", "type": "numeric_range", "target_role": "monetary_amount", "min_value": 0},
         {"dataset": "customer", "rule_key": "segment", "type": "allowed_values", "target_column": "c_mktsegment", "values": ["BUILDING"]},
         {"dataset": "orders", "rule_key": "known", "type": "allowed_values", "target_column": "o_custkey", "values_from": "in_credit"}]


@pytest.fixture(scope="module")
def tables(spark):
    return {name: spark.read.parquet(f"{SF}/{name}.parquet") for name in DOMAINS}


def rows(df, dataset):
    """Rows of a data set as JSON; the order of sums shows in the last digits of a double."""
    def digits(text):
        return float(f"{float(text):.11g}")

    df = df.where(F.col("dataset") == dataset)
    return sorted(json.dumps(json.loads(r.j, parse_float=digits), sort_keys=True) for r in df.select(F.to_json(F.struct(*df.columns)).alias("j")).collect())


def test_equals_single_runs(spark, tables):
    lists = {"in_credit": tables["customer"].where("c_acctbal >= 0").select("c_custkey")}
    got = catalogue_run(tables, DOMAINS, METADATA, RULES, value_lists=lists)
    known = got.rule_evaluations.where("rule_key = 'known'").first()
    assert known["error"] is None and 0 < known["pass_count"] < known["records_checked"]
    for dataset in ("customer", "orders", "part"):
        own = [{k: v for k, v in m.items() if k != "dataset"} for m in METADATA if m["dataset"] == dataset]
        one = run(tables[dataset], DOMAINS[dataset], dataset, own, [r for r in RULES if r["dataset"] == dataset], value_lists=lists)
        for name in ("column_profiles", "column_categories", "secondary_domains", "hierarchy_chains", "rule_evaluations",
                     "quality_assessments", "overall_quality", "readiness_assessments"):
            want = getattr(one, name)
            assert rows(getattr(got, name).select(want.columns), dataset) == rows(want, dataset), (dataset, name)


def test_counted_values_of_all_tables_are_read_four_times(spark, tables):
    """Statistics, quantiles, bounds and lists read the counted values of the catalogue once each."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = catalogue_profile(tables)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    final = [line for line in lines if "HashAggregate(keys=[pos" in line and "val#" in line and "functions=[count(1)" in line]
    assert 0 < len(final) <= 4


def test_one_shuffle_for_all_cells(tables):
    profile = catalogue_profile(tables)
    profile.collect()
    plan = profile._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # one scan per table for all statistics and lists; a second one only fetches long values, of which there are none
    partial = [line for line in plan.splitlines() if "HashAggregate(keys=[pos" in line and "partial_count(1)" in line and "val#" in line.split("functions")[0]]
    assert len(partial) == 1
