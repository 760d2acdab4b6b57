"""Published attempts, failures at every stage, and reading a run back whole."""

from __future__ import annotations

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from tablelens.errors import ProfileError
from tablelens.plans import run as plan
from tablelens.sources.results import list_suggestions, read_result, read_run, record_status, run_states, write_suggestions

METADATA = [{"column_name": "auth_status", "mandatory": True, "description": "outcome"}, {"column_name": "txn_id", "expected_unique": True}]


@pytest.fixture(scope="module")
def payments(spark):
    rows = [(f"T{i:04d}", ["EU", "AP", "AM"][i % 3], f"C{i % 60}", str(i % 40 + 0.5),
             f"2024-{i % 6 + 1:02d}-15", "approved" if i % 4 else None) for i in range(240)]
    rows.append(("T9999", "AM", "C0", "3.5", "2024-01-15", "approved"))
    return spark.createDataFrame(rows, "txn_id string, region string, country string, amount string, auth_date string, auth_status string")


def breaking(*_, **__):
    raise ProfileError("BROKEN", "on purpose")


@pytest.mark.parametrize("stage", [
    "check_domain", "column_profile", "hierarchy.examine_hierarchy", "rules.evaluate_rules", "charts.chart_data", "cubes.cubes", "third table"])
def test_a_failure_leaves_nothing_to_read(spark, payments, monkeypatch, stage):
    root = tempfile.mkdtemp(prefix="tablelens-test-")
    if stage == "third table":
        written = []

        def write(df, root, name, *more):
            written.append(name)
            return breaking() if len(written) == 3 else kept(df, root, name, *more)

        kept = plan.write_result
        monkeypatch.setattr(plan, "write_result", write)
    else:
        owner, _, name = stage.rpartition(".")
        monkeypatch.setattr(getattr(plan, owner) if owner else plan, name, breaking)
    with pytest.raises(ProfileError, match="BROKEN"):
        plan.run_and_write(spark, root, payments, "Payments", "pay", run_id="r1", metadata=METADATA)
    state = run_states(spark, root, "r1").first()
    assert (state.status, state.error_code) == ("failed", "BROKEN")
    for table in ("dataset_profiles", "column_profiles", "drill_down_cubes"):
        with pytest.raises(ProfileError, match="RUN_NOT_PUBLISHED"):
            read_result(spark, root, table, "r1")
    with pytest.raises(ProfileError, match="RUN_NOT_PUBLISHED"):
        read_run(spark, root, "r1")


def test_unreadable_source_and_unknown_domain_are_on_record(spark, payments):
    root = tempfile.mkdtemp(prefix="tablelens-test-")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        plan.run_and_write(spark, root, f"{root}/nowhere.parquet", "Payments", run_id="r1")
    with pytest.raises(ProfileError):
        plan.run_and_write(spark, root, payments, "Sports", run_id="r2")
    states = {r.run_id: (r.status, r.error_code) for r in run_states(spark, root).collect()}
    assert states == {"r1": ("failed", "PROCESSING_ERROR"), "r2": ("failed", "UNSUPPORTED_DOMAIN")}


def as_lists(df):
    return sorted(json.dumps(json.loads(r.j), sort_keys=True) for r in df.select(F.to_json(F.struct(*[c for c in df.columns if c != "run_id"])).alias("j")).collect())


def test_retry_publishes_and_reads_back_whole(spark, payments, monkeypatch):
    root = tempfile.mkdtemp(prefix="tablelens-test-")
    with monkeypatch.context() as patched:
        patched.setattr(plan.cubes, "cubes", breaking)
        with pytest.raises(ProfileError):
            plan.run_and_write(spark, root, payments, "Payments", "pay", run_id="007", metadata=METADATA)
    done = plan.run_and_write(spark, root, payments, "Payments", "pay", run_id="007", metadata=METADATA)
    state = run_states(spark, root, "007").first()
    assert (state.status, state.row_count, state.column_count) == ("completed", 241, 6)
    record = read_run(spark, root, "007").first().asDict(recursive=True)
    document = json.loads(record["json"])
    assert document["status"] == "completed" and document["row_count"] == 241
    for name, df in done.tables().items():
        if name == "quality_assessments":
            df = df.withColumn("display_score", F.round(F.col("score") * 100, 2))
        assert sorted(json.dumps(e, sort_keys=True) for e in document[name]) == as_lists(df), name
        assert len(record[name]) == df.count()
    assert [c["physical_name"] for c in document["column_profiles"]] == payments.columns
    # the conflict planted in the last row
    assert [(c["child_value"], c["parent_values"], c["parent_count"]) for c in document["hierarchy_conflicts"]] == [("C0", ["AM", "EU"], 2)]
    # a later failure hides nothing that is published
    record_status(spark, root, "007", "failed", "Payments", attempt="later")
    assert run_states(spark, root, "007").first().status == "failed"
    assert read_result(spark, root, "column_profiles", "007").count() == 6


def test_charts_of_templates_are_drawn(spark, payments):
    done = plan.run(payments, "Payments", "pay")
    specs = {r.chart_key: r for r in done.chart_specifications.collect()}
    assert specs["transaction_value_over_time"].dimension == "auth_date" and specs["transaction_value_over_time"].metric == "amount"
    assert "numeric_distribution" in {k.split("amount_")[-1] for k in specs} and "rule_violations_by_rule" in specs
    drawn = {r.chart_key for r in done.chart_data.select("chart_key").distinct().collect()}
    assert {"transaction_value_over_time", "amount_numeric_distribution", "rule_violations_by_rule"} <= drawn


def test_suggestions_are_written_and_listed(spark):
    root = tempfile.mkdtemp(prefix="tablelens-test-")
    rows = spark.createDataFrame([(1, "a", "non_null", "proposed"), (2, "b", "regex_match", "approved")],
                                 "suggestion_id int, rule_key string, type string, status string")
    write_suggestions(rows, root, "r1")
    record_status(spark, root, "r1", "completed", "Payments")
    found = read_result(spark, root, "rule_suggestions")
    assert [r.rule_key for r in list_suggestions(found, "r1", "approved").collect()] == ["b"]
    with pytest.raises(ValueError):
        write_suggestions(rows.drop("status"), root, "r1")
