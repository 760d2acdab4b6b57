"""Data categories and secondary domains, scored over the labelled columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.config import variant_values as variant
from tablelens.config.domains import domain_config
from tablelens.config.fixed_values import (
    CATEGORY_DOMAIN_BOOST,
    CATEGORY_NAME_WORDS,
    CATEGORY_SELECTION,
    CATEGORY_SEMANTIC_TYPES,
    CATEGORY_WEIGHTS,
    DOMAIN_CLASSIFIED,
    DOMAIN_NEEDS_REVIEW,
)
from tablelens.functions.text import sql_list, sql_string
from tablelens.operators.labels import words_sql

_DEFAULT_CATEGORY = (
    "CASE {role} WHEN 'temporal_dimension' THEN 'Time Series Data' WHEN 'identifier' THEN 'Master Data' "
    "ELSE 'Operational Data' END"
)


def _scores(domain: str, weights: dict) -> str:
    """An array of (score, first signal, category) per column.

    The terms add up in the order name, semantic type, role, domain, date.  On
    equal scores the category that was hit first wins.
    """
    name_words = dict(CATEGORY_NAME_WORDS)
    hit_semantic = " ".join(
        f"WHEN {words_sql('candidate_semantic_type', words)} THEN {sql_string(category)}"
        for category, words in CATEGORY_SEMANTIC_TYPES
    )
    hit_semantic = f"coalesce(CASE {hit_semantic} END, '')"
    boosted, strength = CATEGORY_DOMAIN_BOOST.get(domain.lower(), ("", "strong"))
    boost = weights["domain_context_boost" if strength == "strong" else "domain_context_boost_weak"]
    categories = [category for category, _ in CATEGORY_NAME_WORDS] + ["Time Series Data"]
    entries = []
    for i, category in enumerate(categories):
        role = {"Time Series Data": "temporal_dimension", "Master Data": "identifier"}.get(category)
        signals = [
            (words_sql("normalized_key", name_words.get(category, [])), weights["name_keyword_match"], i),
            (f"{hit_semantic} = {sql_string(category)}", weights["semantic_type_match"], 20),
            (f"candidate_role = '{role}'" if role else "false", weights["column_role_match"], 30),
            ("true" if category == boosted else "false", boost, 40),
            ("datetime_parse_ratio >= 0.9" if category == "Time Series Data" else "false",
             weights["datetime_parse_match"], 50),
        ]
        signals = [s for s in signals if s[0] != "false"]
        score = " + ".join(f"if({condition}, {weight}D, 0D)" for condition, weight, _ in signals)
        first = " ".join(f"WHEN {condition} THEN {order}" for condition, _, order in signals)
        entries.append(
            f"named_struct('score', -({score}), 'first', CASE {first} END, 'category', {sql_string(category)})")
    return f"array_sort(filter(array({', '.join(entries)}), e -> e.score < 0))"


def category_scores(labelled: DataFrame, domain: str, weights: dict | None = None) -> DataFrame:
    """``(dataset, physical_name, category, score)`` for every category hit."""
    scored = labelled.selectExpr(
        "dataset", "pos", "physical_name", f"inline({_scores(domain, {**CATEGORY_WEIGHTS, **(weights or {})})})")
    return scored.selectExpr("dataset", "pos", "physical_name", "category", "-score AS score")


def data_categories(labelled: DataFrame, domain: str, weights: dict | None = None,
                    selection: dict | None = None) -> DataFrame:
    """``primary_category``, ``secondary_categories`` and ``category_confidence`` per column."""
    s = {**CATEGORY_SELECTION, **(selection or {})}
    scores = _scores(domain, {**CATEGORY_WEIGHTS, **(weights or {})})
    top, second = "-get(scores, 0).score", "-get(scores, 1).score"
    kept = (
        f"filter(slice(scores, 2, greatest(size(scores) - 1, 0)), e -> -e.score >= ({top}) * "
        f"{s['secondary_min_ratio_of_primary']}D AND -e.score >= {s['secondary_min_absolute']}D)"
    )
    boosted = (
        f"if(size(scores) > 1 AND ({top}) - ({second}) > {s['confidence_gap_threshold']}D, "
        f"least(1D, least(1D, {top}) + {s['confidence_gap_boost']}D), least(1D, {top}))"
    )
    return labelled.selectExpr(
        "dataset", "pos", "physical_name", "candidate_role", f"{scores} AS scores",
    ).selectExpr(
        "dataset", "pos", "physical_name",
        f"CASE WHEN size(scores) = 0 THEN {_DEFAULT_CATEGORY.format(role='candidate_role')} "
        "ELSE get(scores, 0).category END AS primary_category",
        f"CASE WHEN size(scores) = 0 THEN CAST(array() AS array<string>) "
        f"ELSE transform(slice({kept}, 1, {s['max_secondary_categories']}), e -> e.category) END "
        "AS secondary_categories",
        f"CASE WHEN size(scores) = 0 THEN 0.5D ELSE round({boosted}, 3) END AS category_confidence",
    )


def data_categories_variant(labelled: DataFrame, domain: str) -> DataFrame:
    """The configurable variant: longer lists, weak and strong boosts, top three."""
    strong, weak = variant.CATEGORY_BOOSTS.get(domain, ([], []))
    entries = []
    count = len(variant.CATEGORY_KEYWORDS)
    boosted_order = {category: count + i for i, category in enumerate(strong + weak)}
    for i, (category, keywords, hints) in enumerate(variant.CATEGORY_KEYWORDS):
        role = {"Time Series Data": "temporal_dimension", "Master Data": "identifier"}.get(category)
        named = words_sql("normalized_key", keywords)
        hinted = words_sql("coalesce(candidate_semantic_type, '')", hints)
        in_role = f"candidate_role = '{role}'" if role else "false"
        own = f"if({named}, 0.4D, 0D) + if({hinted}, 0.5D, 0D) + if({in_role}, 0.3D, 0D)"
        boost = 0.2 if category in strong else 0.1 if category in weak else 0
        dated = "datetime_parse_ratio >= 0.9" if category == "Time Series Data" else "false"
        score = f"{own} + {boost}D + if({dated}, 0.4D, 0D)"
        order = f"CASE WHEN {own} > 0 THEN {i} ELSE {boosted_order.get(category, 2 * count)} END"
        entries.append(
            f"named_struct('score', -({score}), 'first', {order}, 'category', {sql_string(category)})")
    scores = f"array_sort(filter(array({', '.join(entries)}), e -> e.score < 0))"
    return labelled.selectExpr("dataset", "pos", "physical_name", "candidate_role", f"{scores} AS scores").selectExpr(
        "dataset", "pos", "physical_name",
        f"CASE WHEN size(scores) = 0 THEN {_DEFAULT_CATEGORY.format(role='candidate_role')} "
        "ELSE get(scores, 0).category END AS primary_category",
        "CASE WHEN size(scores) = 0 THEN CAST(array() AS array<string>) ELSE transform(filter(slice(scores, 2, 3), "
        "e -> -e.score >= -get(scores, 0).score * 0.5D AND -e.score >= 0.3D), e -> e.category) END AS secondary_categories",
        "CASE WHEN size(scores) = 0 THEN 0.4D ELSE least(1D, -get(scores, 0).score) END AS category_confidence",
    )


def domain_evidence(labelled: DataFrame, domain: str) -> DataFrame:
    """One row per column, secondary domain and signal that hit."""
    entries = []
    for i, (name, words) in enumerate(domain_config(domain)["secondary_domains"].items()):
        keywords = f"array{sql_list([k.lower() for k in words['keywords']])}"
        roles = f"array{sql_list([r.lower() for r in words['semantic_roles']])}"
        by_name = f"filter({keywords}, k -> contains(normalized_key, k))"
        by_role = (
            f"filter({roles}, r -> contains(lower(candidate_semantic_type), r) "
            "OR contains(r, lower(candidate_semantic_type)))"
        )
        by_value = (
            "flatten(transform(slice(representative_values, 1, 5), "
            f"v -> slice(filter({keywords}, k -> contains(lower(v), k)), 1, 1)))"
        )
        for signal, weight, found in (
            ("name_keyword", 1.5, by_name), ("semantic_role", 2.0, by_role), ("value_keyword", 0.5, by_value),
        ):
            entries.append(
                f"named_struct('domain_pos', {i}, 'domain_name', {sql_string(name)}, 'signal', '{signal}', "
                f"'matched', get({found}, 0), 'weight', {weight}D)"
            )
    return labelled.selectExpr(
        "dataset", "pos", "physical_name", f"inline(array({', '.join(entries)}))"
    ).where("matched IS NOT NULL")


def domain_scores(labelled: DataFrame, domain: str) -> DataFrame:
    """``(dataset, domain_name, score, rank)`` of every configured secondary domain."""
    names = list(domain_config(domain)["secondary_domains"])
    listed = ", ".join(f"named_struct('domain_pos', {i}, 'domain_name', {sql_string(n)})" for i, n in enumerate(names))
    sizes = labelled.groupBy("dataset").agg(F.count(F.lit(1)).alias("columns"))
    slots = sizes.selectExpr("dataset", "columns", f"inline(array({listed}))")
    sums = domain_evidence(labelled, domain).groupBy("dataset", "domain_name").agg(F.sum("weight").alias("total"))
    return slots.join(sums, ["dataset", "domain_name"], "left").selectExpr(
        "dataset", "domain_name", "domain_pos",
        "least(1D, coalesce(total, 0D) / greatest(columns * 4.0D * 0.15D, 1D)) AS score",
    ).selectExpr(
        "dataset", "domain_name", "score",
        "row_number() OVER (PARTITION BY dataset ORDER BY score DESC, domain_pos) AS rank",
    )


def secondary_domain(labelled: DataFrame, domain: str, classified: float = DOMAIN_CLASSIFIED,
                     needs_review: float = DOMAIN_NEEDS_REVIEW) -> DataFrame:
    """One row per data set: ``(domain_name, confidence, status, candidates)``."""
    if not domain_config(domain)["secondary_domains"]:
        return labelled.select("dataset").distinct().selectExpr(
            "dataset", "CAST(NULL AS string) AS domain_name", "0D AS confidence", "'unresolved' AS status",
            "CAST(array() AS array<struct<name: string, confidence: double>>) AS candidates")
    ranked = domain_scores(labelled, domain).groupBy("dataset").agg(
        F.expr("array_sort(collect_list(named_struct('rank', rank, 'name', domain_name, 'score', score)))").alias("r"))
    top = "r[0].score"
    bar = f"CASE WHEN {top} >= {classified}D THEN 2D WHEN {top} >= {needs_review}D THEN {needs_review}D ELSE 0D END"
    return ranked.selectExpr(
        "dataset",
        f"CASE WHEN {top} >= {classified}D THEN r[0].name END AS domain_name",
        f"{top} AS confidence",
        f"CASE WHEN {top} >= {classified}D THEN 'classified' WHEN {top} >= {needs_review}D THEN 'needs_review' "
        "ELSE 'unresolved' END AS status",
        f"transform(filter(slice(r, 1, 3), e -> e.score >= {bar} AND e.score > 0), "
        "e -> named_struct('name', e.name, 'confidence', round(e.score, 4))) AS candidates",
    )
