"""Readiness for analytics, machine learning and language models.

Expressions over one row per data set: counts from the labelled profile joined
with the quality scores pivoted to columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.config.fixed_values import PARTIALLY_READY, READY

_USED = ["completeness", "validity", "consistency", "uniqueness", "semantic_quality"]

_ANALYTICS = (
    "least(100D, coalesce(completeness * 20, 0D) + coalesce(validity * 15, 0D) + coalesce(consistency * 15, 0D) "
    "+ CASE WHEN metrics >= 2 THEN 15D WHEN metrics >= 1 THEN 8D ELSE 0D END "
    "+ CASE WHEN dimensions >= 3 THEN 15D WHEN dimensions >= 1 THEN 8D ELSE 0D END "
    "+ if(keys > 0, 10D, 0D) + if(temporals > 0, 10D, 0D))"
)
_ML = (
    "greatest(0D, least(100D, coalesce(completeness * 20, 0D) + coalesce(consistency * 15, 0D) "
    "+ (columns - keys) / greatest(columns, 1) * 15 - if(keys / greatest(columns, 1) > 0.3, 10D, 0D) "
    "+ CASE WHEN rows >= 10000 THEN 15D WHEN rows >= 1000 THEN 10D WHEN rows >= 100 THEN 5D ELSE 0D END "
    "+ if(wide_features = 0, 10D, 5D) + coalesce(uniqueness * 10, 0D)))"
)
_LLM = (
    "greatest(0D, least(100D, CASE WHEN coverage >= 0.8 THEN 25D WHEN coverage >= 0.5 THEN 15D ELSE coverage * 25 END "
    "+ coalesce(semantic_quality * 20, 0D) + (1 - null_ratios / greatest(columns, 1)) * 15 + 15D "
    "+ sampled / greatest(columns, 1) * 10 + least(15D, coverage * 15)))"
)


def _notes(*entries: tuple[str, str, str]) -> str:
    """A list of coded notes: (code, condition, value)."""
    notes = ", ".join(
        f"if({condition}, named_struct('code', '{code}', 'value', CAST({value} AS double)), NULL)"
        for code, condition, value in entries
    )
    empty = "CAST(array() AS array<struct<code: string, value: double>>)"
    return f"array_compact(array({notes}))" if entries else empty


_ASSESSMENTS = [
    (
        "analytics_readiness", "analytics",
        _notes(("HIGH_COMPLETENESS", "completeness >= 0.9", "completeness"), ("USABLE_METRICS", "metrics >= 2", "metrics"),
               ("USABLE_DIMENSIONS", "dimensions >= 3", "dimensions"), ("IDENTIFIABLE_GRAIN", "keys > 0", "keys"),
               ("TEMPORAL_FIELDS_AVAILABLE", "temporals > 0", "temporals")),
        _notes(("NO_GRAIN_IDENTIFIED", "keys = 0", "NULL")),
        _notes(("ADD_TEMPORAL_FIELD", "temporals = 0", "NULL")),
        "analytics-v1",
    ),
    (
        "ml_readiness", "ml",
        _notes(("HIGH_COMPLETENESS", "completeness >= 0.9", "completeness"), ("ADEQUATE_ROW_COUNT", "rows >= 10000", "rows")),
        _notes(("IDENTIFIER_CONTAMINATION", "keys / greatest(columns, 1) > 0.3", "round(keys / greatest(columns, 1), 3)"),
               ("INSUFFICIENT_ROWS", "rows < 100", "rows")),
        _notes(("EXCLUDE_IDENTIFIER_FEATURES", "keys > 0 AND keys / greatest(columns, 1) <= 0.3", "NULL"),
               ("HIGH_CARDINALITY_FEATURES", "wide_features > 0", "wide_features")),
        "ml-v1",
    ),
    (
        "llm_readiness", "language",
        _notes(("HIGH_DESCRIPTION_COVERAGE", "coverage >= 0.8", "round(coverage, 3)")),
        _notes(("LOW_DESCRIPTION_COVERAGE", "coverage < 0.5", "round(coverage, 3)")),
        _notes(("ADD_COLUMN_DESCRIPTIONS", "coverage < 0.5", "NULL")),
        "llm-v1",
    ),
    ("overall_ai_readiness", "(analytics + ml + language) / 3", _notes(), _notes(), _notes(), "overall-v1"),
]


def readiness_facts(labelled: DataFrame, dimensions: DataFrame, described_columns: int | DataFrame = 0) -> DataFrame:
    """One row per data set with everything the scores are made of.

    ``described_columns`` is a number, or a relation ``(dataset, described)``.
    """
    facts = labelled.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("columns"),
        F.max("row_count").alias("rows"),
        F.count_if(F.col("candidate_role") == "metric").alias("metrics"),
        F.count_if(F.col("candidate_role") == "dimension").alias("dimensions"),
        F.count_if(F.col("candidate_role") == "temporal_dimension").alias("temporals"),
        F.count_if("is_grain_key").alias("keys"),
        F.count_if((F.col("cardinality_ratio") > 0.9) & ~F.col("is_grain_key")).alias("wide_features"),
        F.sum("null_ratio").alias("null_ratios"),
        F.count_if(F.size("sample_values") > 0).alias("sampled"),
    )
    scores = dimensions.groupBy("dataset").agg(*[
        F.max(F.when((F.col("dimension") == name) & (F.col("status") == "assessed"), F.col("score"))).alias(name)
        for name in _USED
    ])
    if isinstance(described_columns, DataFrame):
        facts = facts.join(described_columns, "dataset", "left").withColumn("described", F.coalesce("described", F.lit(0)))
    else:
        facts = facts.withColumn("described", F.lit(described_columns))
    return facts.join(scores, "dataset", "left").withColumn(
        "coverage", F.col("described") / F.greatest(F.col("columns"), F.lit(1)))


def readiness(labelled: DataFrame, dimensions: DataFrame, described_columns: int | DataFrame = 0) -> DataFrame:
    """Four rows per data set: score, status, strengths, blockers, advice."""
    scored = readiness_facts(labelled, dimensions, described_columns).selectExpr(
        "*", f"{_ANALYTICS} AS analytics", f"{_ML} AS ml", f"{_LLM} AS language")
    rows = ", ".join(
        f"named_struct('assessment_type', '{name}', 'raw', {score}, 'strengths', {strengths}, "
        f"'blocking_issues', {blockers}, 'recommendations', {advice}, 'weight_profile_version', '{version}')"
        for name, score, strengths, blockers, advice, version in _ASSESSMENTS
    )
    return scored.selectExpr("dataset", f"inline(array({rows}))").selectExpr(
        "dataset", "assessment_type", "round(raw, 2) AS score",
        f"CASE WHEN raw >= {READY}D THEN 'ready' WHEN raw >= {PARTIALLY_READY}D THEN 'partially_ready' "
        "ELSE 'not_ready' END AS status",
        "strengths", "blocking_issues", "recommendations", "weight_profile_version",
    )
