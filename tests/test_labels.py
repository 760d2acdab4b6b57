"""Types, identifiers, roles, categories and domains on hand-made profiles."""

from __future__ import annotations

import pytest

from tablelens.operators import categories, labels

DEFAULTS = dict(
    dataset="d", row_count=100, non_null_count=100, null_count=0, null_ratio=0.0, distinct_count=60,
    cardinality_ratio=0.6, duplicate_count=40, sample_values=[], representative_values=[], min_value=None,
    max_value=None, datetime_parse_ratio=0.0, numeric_parse_ratio=0.0, boolean_parse_ratio=0.0, dominant_patterns=[],
)
SCHEMA = (
    "dataset string, pos int, physical_name string, normalized_key string, row_count bigint, non_null_count bigint, "
    "null_count bigint, null_ratio double, distinct_count bigint, cardinality_ratio double, duplicate_count bigint, "
    "sample_values array<string>, representative_values array<string>, min_value double, max_value double, "
    "datetime_parse_ratio double, numeric_parse_ratio double, boolean_parse_ratio double, dominant_patterns array<string>"
)


def profiles(spark, *columns):
    rows = []
    for pos, (name, changes) in enumerate(columns):
        row = {**DEFAULTS, "pos": pos, "physical_name": name, "normalized_key": name, **changes}
        rows.append(tuple(row[f.split()[0]] for f in SCHEMA.split(", ")))
    return spark.createDataFrame(rows, SCHEMA)


NUMERIC = dict(numeric_parse_ratio=1.0, min_value=-5.0, max_value=500.5)


def test_type_ladder(spark):
    cases = [
        ("a", dict(non_null_count=0), "unknown"),
        ("b", dict(boolean_parse_ratio=0.95, distinct_count=3), "boolean"),
        ("c", dict(numeric_parse_ratio=1.0, distinct_count=2, min_value=0.0, max_value=1.0), "boolean"),
        ("d", dict(datetime_parse_ratio=0.9, dominant_patterns=["YYYY-MM-DD", "PHONE"]), "date"),
        ("e", dict(datetime_parse_ratio=0.9, numeric_parse_ratio=1.0), "datetime"),
        ("f", dict(representative_values=["a@b.co"] * 4 + ["x"]), "email"),
        ("g", dict(dominant_patterns=["PHONE"]), "phone"),
        ("h", dict(dominant_patterns=["THREE_LETTER_CODE"], representative_values=["usd", "EUR", "GBP"]), "text"),
        ("i", dict(dominant_patterns=["THREE_LETTER_CODE"], distinct_count=3, representative_values=["USD", "EUR"]), "currency_code"),
        ("j", dict(dominant_patterns=["TWO_LETTER_CODE"], representative_values=["US", "DE", "XX"], distinct_count=3), "categorical"),
        ("k", dict(dominant_patterns=["THREE_LETTER_CODE"], representative_values=["USA", "DEU"], distinct_count=200), "country_code"),
        ("tax_rate", dict(numeric_parse_ratio=0.9, min_value=0.0, max_value=100.0), "percentage"),
        ("l", {**NUMERIC, "dominant_patterns": ["INTEGER"]}, "integer"),
        ("m", dict(numeric_parse_ratio=1.0, min_value=1.0, max_value=900.0, sample_values=["1", "2.5"]), "decimal"),
        ("n", dict(numeric_parse_ratio=1.0, min_value=1.0, max_value=900.0, sample_values=["1", "x"]), "integer"),
        ("o", NUMERIC, "decimal"),
        ("p", dict(cardinality_ratio=0.98), "identifier"),
        ("q", dict(cardinality_ratio=0.05, distinct_count=50), "categorical"),
        ("r", {}, "text"),
    ]
    typed = labels.refined_types(profiles(spark, *[(n, c) for n, c, _ in cases])).orderBy("pos").collect()
    assert [(r.physical_name, r.refined_type) for r in typed] == [
        (n, "text" if n == "h" else t) for n, _, t in cases]


def test_identifier_boundary(spark):
    df = labels.identifiers(labels.refined_types(profiles(
        spark,
        ("order_id", dict(cardinality_ratio=1.0, duplicate_count=0)),
        ("near", dict(cardinality_ratio=0.98, duplicate_count=2, numeric_parse_ratio=1.0, dominant_patterns=["INTEGER"])),
        ("sparse_id", dict(cardinality_ratio=1.0, null_ratio=0.2)),
        ("low", dict(cardinality_ratio=0.1)),
    )))
    got = [(r.physical_name, r.identifier_score, r.is_grain_key) for r in df.orderBy("pos").collect()]
    assert got == [("order_id", 0.9, True), ("near", 0.6, True), ("sparse_id", 0.5, False), ("low", 0.0, False)]
    assert labels.grain(df).first()["inferred_grain"] == "order_id + near"


def test_roles_and_decisions(spark):
    df = labels.label_columns(profiles(
        spark,
        ("settle_date", dict(datetime_parse_ratio=1.0)),
        ("fraud_flag", dict(boolean_parse_ratio=1.0, distinct_count=2)),
        ("item_count", NUMERIC),
        ("x1", {**NUMERIC, "cardinality_ratio": 0.01, "distinct_count": 5}),
        ("decline_reason", dict(cardinality_ratio=0.01, distinct_count=4)),
        ("city", dict(cardinality_ratio=0.01, distinct_count=4)),
        ("full_name", {}),
    ))
    got = [(r.candidate_semantic_type, r.candidate_role, r.candidate_confidence) for r in df.orderBy("pos").collect()]
    assert got == [
        ("settlement_date", "temporal_dimension", 0.88), ("fraud_flag", "flag", 0.85), ("count_metric", "metric", 0.85),
        ("numeric_category", "dimension", 0.7), ("description", "text_field", 0.78), ("city", "dimension", 0.8),
        ("name", "dimension", 0.75),
    ]
    decisions = spark.createDataFrame(
        [("d", "x1", "overridden", "grade", None, 0.7), ("d", "city", "maybe", "town", "metric", 0.4)],
        "dataset string, physical_name string, decision string, semantic_type string, role string, confidence double")
    decided = {r.physical_name: r for r in labels.confirmed_roles(df, decisions).collect()}
    assert (decided["x1"].confirmed_semantic_type, decided["x1"].confirmed_role) == ("grade", "dimension")
    assert (decided["city"].decision, decided["city"].confirmed_semantic_type) == ("unresolved", "city")
    assert decided["settle_date"].schema_confidence == pytest.approx(0.792)
    assert (decided["full_name"].decision, decided["full_name"].schema_confidence) == ("unresolved", 0.75)


def test_category_ties_and_gap(spark):
    df = labels.label_columns(profiles(spark, ("order_status", dict(cardinality_ratio=0.01, distinct_count=3)), ("zz", {})))
    got = {r.physical_name: r for r in categories.data_categories(df, "HR").collect()}
    assert got["order_status"].primary_category == "Transaction Data"
    assert got["order_status"].secondary_categories == ["Operational Data"]
    assert got["order_status"].category_confidence == 0.4
    assert (got["zz"].primary_category, got["zz"].category_confidence) == ("Master Data", 0.1)
    assert {r.physical_name: r.primary_category for r in categories.data_categories(df, "Unknown").collect()}["zz"] == "Operational Data"


def test_secondary_domain_thresholds(spark):
    base = [("c%d" % i, {}) for i in range(5)]
    strong = labels.label_columns(profiles(spark, ("settlement_date", dict(datetime_parse_ratio=1.0)), *base))
    row = categories.secondary_domain(strong, "Payments").first()
    assert (row.domain_name, row.status) == ("Settlement", "classified")
    assert row.confidence == pytest.approx(3.5 / 3.6)
    weak = labels.label_columns(profiles(spark, ("fraud", {}), *base))
    row = categories.secondary_domain(weak, "Payments").first()
    assert (row.domain_name, row.status) == (None, "unresolved") and row.candidates[0].name == "Fraud"
    evidence = categories.domain_evidence(strong, "Payments").where("domain_name = 'Settlement'").collect()
    assert {(r.signal, r.matched) for r in evidence} == {("name_keyword", "settlement"), ("semantic_role", "settlement_date")}
