"""Registered queries next to their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest
from check_queries import compare, duck

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
# one query per operator family; tools/check_queries.py runs them all
NAMES = [
    "column_profile_orders", "column_profile_documents", "dataset_profile_lineitem", "normalize_names", "top_values_part",
    "labels_events", "label_variants_part", "categories_customer", "domain_scores_orders", "template_match_geo",
    "fd_edges_warning", "fd_conflicts", "hierarchy_chain_rejected", "rules_events", "rules_orders", "rule_review",
    "quality_overall", "readiness_orders", "chart_bar_mean", "chart_histogram", "cube_geo", "drill_down_orders",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, connection, name):
    _, problems = compare(spark, connection, SF, entry_module.queries()[name], entry_module.oracle_sql()[name])
    assert problems == []


def test_every_query_has_sql():
    assert set(entry_module.all_queries()) == set(entry_module.all_oracles())


def test_profile_shuffles_values_once(spark):
    """All branches of the statistics read one frequency shuffle."""
    from tablelens.operators.profile import column_statistics

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = column_statistics(spark.read.parquet(f"{SF}/orders.parquet"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") >= 2
