"""Quality dimensions and the overall score.

Every function returns rows of ``(dataset, dimension, score, status,
assessed_count, violation_count, reason)``.  A dimension nothing can be said
about has a null score, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.config.fixed_values import QUALITY_WEIGHTS, SEMANTIC_QUALITY_WEIGHTS

DIMENSIONS = [
    "completeness", "uniqueness", "validity", "conformity", "consistency", "business_rule_compliance",
    "timeliness", "integrity", "accuracy", "semantic_quality",
]
# Rule types each rule-based dimension looks at.
RULE_DIMENSIONS = {
    "validity": ["numeric_range", "allowed_values", "date_range"],
    "conformity": ["regex_match"],
    "consistency": ["column_comparison", "cross_field_equality", "cross_field_inequality"],
}
NEEDS = {
    "timeliness": "needs an expected recency",
    "integrity": "needs a reference table",
    "accuracy": "needs a trusted copy",
}


def _dimension(dimension: str, assessed: Column, violated: Column, present: Column, reason: str | Column) -> list[Column]:
    score = F.when(present & (assessed > 0), 1 - violated / assessed).when(present, F.lit(1.0))
    return [
        F.lit(dimension).alias("dimension"),
        score.cast("double").alias("score"),
        F.when(present, "assessed").otherwise("not_assessable").alias("status"),
        F.when(present, assessed).otherwise(F.lit(0)).cast("bigint").alias("assessed_count"),
        F.when(present, violated).otherwise(F.lit(0)).cast("bigint").alias("violation_count"),
        F.when(~present, reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
    ]


def _over_columns(profile: DataFrame, dimension: str, names: list[str] | DataFrame, violations: str) -> DataFrame:
    """1 - violations / rows over the named columns, by name or key.

    ``names`` is a list, or for many data sets a relation ``(dataset, column_name)``.
    """
    reason = F.lit("the named columns are not in the data set")
    if isinstance(names, list):
        named = F.col("physical_name").isin(names) | F.col("normalized_key").isin(names)
        asked = F.lit(bool(names))
    else:
        # the columns that callers named, a list per data set
        lists = names.groupBy("dataset").agg(F.collect_set("column_name").alias("asked_names"))
        profile = profile.join(F.broadcast(lists), "dataset", "left")
        named = F.coalesce(F.array_contains("asked_names", F.col("physical_name")) | F.array_contains("asked_names", F.col("normalized_key")), F.lit(False))
        asked = F.bool_or(F.col("asked_names").isNotNull())
    sums = profile.groupBy("dataset").agg(
        F.sum(F.when(named, F.col("row_count"))).alias("assessed"),
        F.sum(F.when(named, F.col(violations))).alias("violated"),
        F.count_if(named).alias("found"),
        (F.first(asked) if isinstance(names, list) else asked).alias("asked"),
    )
    return sums.select("dataset", *_dimension(
        dimension, F.col("assessed"), F.col("violated"), F.col("found") > 0,
        F.when(F.col("asked"), reason).otherwise(F.lit("no column is named for it"))))


def completeness(profile: DataFrame, mandatory: list[str] | DataFrame) -> DataFrame:
    return _over_columns(profile, "completeness", mandatory, "null_count")


def uniqueness(profile: DataFrame, expected_unique: list[str] | DataFrame) -> DataFrame:
    return _over_columns(profile, "uniqueness", expected_unique, "duplicate_count")


def rule_dimensions(rule_results: DataFrame, dataset: str | DataFrame = "dataset") -> DataFrame:
    """Validity, conformity, consistency and compliance, from one aggregation.

    ``dataset`` names the one data set, or is the ``(dataset)`` relation of many.
    """
    sound = F.col("error").isNull()
    conditions = {name: sound & F.col("rule_type").isin(kinds) for name, kinds in RULE_DIMENSIONS.items()}
    conditions["business_rule_compliance"] = sound & (F.col("records_checked") > 0)
    aggregates = [
        aggregate
        for name, condition in conditions.items()
        for aggregate in (
            F.sum(F.when(condition, F.col("records_checked"))).alias(f"{name}_checked"),
            F.sum(F.when(condition, F.col("fail_count"))).alias(f"{name}_failed"),
            F.count_if(condition).alias(f"{name}_rules"),
        )
    ]
    if isinstance(dataset, str):
        sums = rule_results.agg(*aggregates).withColumn("dataset", F.lit(dataset))
    else:
        # a data set without rules has a row too
        sums = dataset.select("dataset").distinct().join(rule_results.groupBy("dataset").agg(*aggregates), "dataset", "left")
        sums = sums.fillna(0, [f"{name}_rules" for name in conditions])
    rows = F.array(*[
        F.struct(*_dimension(name, F.col(f"{name}_checked"), F.col(f"{name}_failed"), F.col(f"{name}_rules") > 0,
                             "no rule of its kind was evaluated"))
        for name in conditions
    ])
    return sums.select("dataset", F.inline(rows))


def unassessable(profile: DataFrame) -> DataFrame:
    """Dimensions that need data the profile does not have."""
    rows = F.array(*[
        F.struct(*_dimension(name, F.lit(0), F.lit(0), F.lit(False), reason)) for name, reason in NEEDS.items()
    ])
    return profile.select("dataset").distinct().select("dataset", F.inline(rows))


def semantic_quality(decided: DataFrame, categories: DataFrame, domain: DataFrame, chain: DataFrame,
                     weights: dict | None = None) -> DataFrame:
    """Weighted mean of the confidences there are."""
    w = weights or SEMANTIC_QUALITY_WEIGHTS
    sides = [
        decided.groupBy("dataset").agg(F.avg("schema_confidence").alias("schema_intelligence_confidence")),
        categories.groupBy("dataset").agg(F.avg("category_confidence").alias("column_classification_confidence")),
        domain.select("dataset", F.when(F.col("domain_name").isNotNull(), F.col("confidence"))
                      .alias("secondary_domain_confidence")),
        chain.select("dataset", F.when(F.col("status") != "unresolved", F.col("average_confidence"))
                     .alias("hierarchy_confidence")),
    ]
    joined = sides[0]
    for side in sides[1:]:
        joined = joined.join(side, "dataset", "left")
    weighted = weight = assessed = F.lit(0.0)
    for name in SEMANTIC_QUALITY_WEIGHTS:
        known = F.col(name).isNotNull()
        component = w.get(name, 0.25)
        weighted = weighted + F.when(known, F.col(name) * component).otherwise(0.0)
        weight = weight + F.when(known, component).otherwise(0.0)
        assessed = assessed + F.when(known, 1.0).otherwise(0.0)
    return joined.select(
        "dataset", F.lit("semantic_quality").alias("dimension"),
        F.when(weight > 0, weighted / weight).alias("score"),
        F.when(weight > 0, "assessed").otherwise("not_assessable").alias("status"),
        assessed.cast("bigint").alias("assessed_count"), F.lit(0).cast("bigint").alias("violation_count"),
        F.when(~(weight > 0), "no confidence is known").alias("reason"),
    )


def quality_dimensions(profile: DataFrame, rule_results: DataFrame, semantic: DataFrame, mandatory: list[str] | DataFrame,
                       expected_unique: list[str] | DataFrame, dataset: str | DataFrame = "dataset") -> DataFrame:
    """All ten dimensions, with ``ord`` for their order; names as lists, or as relations of many data sets."""
    union = (
        completeness(profile, mandatory)
        .unionByName(uniqueness(profile, expected_unique))
        .unionByName(rule_dimensions(rule_results, dataset))
        .unionByName(unassessable(profile))
        .unionByName(semantic)
    )
    names = F.array(*[F.lit(name) for name in DIMENSIONS])
    return union.withColumn("ord", F.array_position(names, F.col("dimension")).cast("int"))


def overall_quality(dimensions: DataFrame, weights: dict | None = None) -> DataFrame:
    """Weighted mean over the assessed dimensions, per data set."""
    w = F.create_map(*[F.lit(v) for pair in (weights or QUALITY_WEIGHTS).items() for v in pair])
    assessed = (F.col("status") != "not_assessable") & F.col("score").isNotNull()
    weight = F.coalesce(w[F.col("dimension")], F.lit(0.0))

    def listed(condition: Column) -> Column:
        names = F.array_sort(F.collect_list(F.when(condition, F.struct("ord", "dimension"))))
        return F.transform(names, lambda e: e["dimension"])

    # at most ten rows a data set
    return dimensions.groupBy("dataset").agg(
        F.sum(F.when(assessed, weight * F.col("score"))).alias("weighted"),
        F.sum(F.when(assessed, weight)).alias("weight"),
        listed(assessed).alias("assessed_dimensions"),
        listed(~assessed).alias("excluded_dimensions"),
    ).withColumn("raw", F.when(F.col("weight") > 0, F.col("weighted") / F.col("weight"))).select(
        "dataset", F.round("raw", 4).alias("overall_score"), F.round(F.col("raw") * 100, 2).alias("display_score"),
        "assessed_dimensions", "excluded_dimensions",
    )
