"""Registered queries: every operator over the given tables.

Lists are joined to text so that results compare by value in any engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.config.domains import chart_templates, domain_config
from tablelens.errors import ProfileError
from tablelens.functions.text import duplicate_column_keys, unique_column_keys
from tablelens.operators import categories, charts, cubes, dataset, hierarchy, labels, profile, quality, readiness, rules, states
from tablelens.operators.frequencies import column_frequencies, column_names, first_values, read_numbers, text_cells
from tablelens.plans import catalogue
from tablelens.plans import run as plan
from tablelens.sources.results import list_suggestions, read_result, read_run, record_status, write_suggestions
from tablelens.sources.settle import settled
from tablelens.sources.tables import check_domain, check_table, read_table

Query = Callable[[SparkSession, str], DataFrame]

# Missing values and text dates for tables that have none.
DIRTY_EVENTS = """
SELECT event_id, ts, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, props
FROM {events}
"""
GEO = """
SELECT c.c_custkey, c.c_name AS customer, n.n_name AS country, {region} AS region, c.c_acctbal AS balance
FROM {{customer}} c JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey
JOIN {{region}} r ON n.n_regionkey = r.r_regionkey
"""
CLEAN_REGION = "r.r_name"
WARNING_REGION = "CASE WHEN c.c_nationkey = 2 AND c.c_custkey % 2 = 0 THEN 'SPOILED' ELSE r.r_name END"
REJECTED_REGION = "CASE WHEN c.c_custkey % 40 = 0 THEN 'AFRICA' ELSE r.r_name END"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dirty_events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(DIRTY_EVENTS, events=table(spark, sf, "events"))


def geo(spark: SparkSession, sf: str, region: str = CLEAN_REGION) -> DataFrame:
    return spark.sql(GEO.format(region=region), customer=table(spark, sf, "customer"),
                     nation=table(spark, sf, "nation"), region=table(spark, sf, "region"))


# People with the kinds of columns that the labels tell apart; no row is left out.
PEOPLE = """
SELECT c_custkey, 'user' || CAST(c_custkey % 50 AS STRING) || '@mail' || CAST(c_nationkey AS STRING) || '.org' AS email,
       '+1 555 ' || lpad(CAST(c_custkey % 400 AS STRING), 7, '0') AS phone,
       CASE c_nationkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'JPY' END AS currency,
       CASE c_nationkey % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' WHEN 3 THEN 'FR' ELSE 'JP' END AS country,
       CASE c_nationkey % 3 WHEN 0 THEN 'USA' WHEN 1 THEN 'DEU' ELSE 'JPN' END AS land,
       c_custkey % 101 AS discount_rate,
       '2024-' || lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') || '-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') AS created_date,
       '2024-' || lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') || '-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || 'T10:30:00' AS updated_at,
       CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS active_flag,
       CASE WHEN c_nationkey < 0 THEN 'x' END AS nothing, c_mktsegment AS city_region,
       'tier ' || CAST(c_nationkey % 6 AS STRING) AS status_level, c_name AS remark_note
FROM {customer}
"""
CARDS = """
SELECT o_orderkey AS txn_key, floor(o_totalprice / 1000.0) * 1.0 AS amount, o_orderstatus AS auth_status, o_orderpriority AS channel,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS fraud_flag, o_orderdate AS authorization_date, CAST(NULL AS STRING) AS blank
FROM {orders}
"""


def people(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(PEOPLE, customer=table(spark, sf, "customer"))


def cards(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(CARDS, orders=table(spark, sf, "orders"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see, for what a query writes and reads again."""
    settled(spark.range(1))
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root}/tablelens-{uuid.uuid4().hex}"


def text_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates of orders written out in many ways."""
    return table(spark, sf, "orders").selectExpr(
        "date_format(o_orderdate, 'yyyy-MM-dd') AS iso_date",
        "date_format(o_orderdate, 'MM/dd/yyyy') AS us_date",
        "date_format(o_orderdate, 'dd.MM.yyyy') AS dotted_date",
        "date_format(o_orderdate, 'yyyyMMdd') AS plain_date",
        "date_format(o_orderdate, 'yyyy-MM') AS month_text",
        "date_format(o_orderdate, 'MM/dd/yyyy') || ' 10:30' AS us_minute",
        "date_format(o_orderdate, 'yyyy/MM/dd') || ' 10:00:00' AS slash_second",
        "date_format(o_orderdate, 'yyyy-MM-dd') || 'T10:30Z' AS iso_minute",
        "date_format(o_orderdate, 'dd-MMM-yyyy') AS short_name",
        "date_format(o_orderdate, 'MMMM d, yyyy') AS long_name",
        "date_format(o_orderdate, 'MM/dd/') || lpad(CAST(60 + o_orderkey % 20 AS STRING), 2, '0') AS short_year",
        "if(o_orderkey % 4 = 0, date_format(o_orderdate, 'dd-MMM-yyyy'), date_format(o_orderdate, 'MMMM d, yyyy')) AS two_ways",
        "o_orderpriority AS no_date",
    )


STATISTICS = [
    "physical_name", "row_count", "non_null_count", "null_count", "round(null_ratio, 6) AS null_ratio",
    "distinct_count", "round(cardinality_ratio, 6) AS cardinality_ratio", "duplicate_count",
    "round(min_value, 4) AS min_value", "round(max_value, 4) AS max_value", "round(mean, 4) AS mean",
    "round(median, 4) AS median", "round(std_dev, 4) AS std_dev", "round(q25, 4) AS q25", "round(q50, 4) AS q50",
    "round(q75, 4) AS q75", "bigint(min_string_length) AS min_string_length",
    "bigint(max_string_length) AS max_string_length", "round(avg_string_length, 4) AS avg_string_length",
    "round(numeric_parse_ratio, 6) AS numeric_parse_ratio", "round(boolean_parse_ratio, 6) AS boolean_parse_ratio",
]


LISTS = [
    "dtype", "array_join(sample_values, ' | ') AS sample_values", "array_join(representative_values, ' | ') AS representative_values",
    "round(datetime_parse_ratio, 6) AS datetime_parse_ratio", "array_join(dominant_patterns, ', ') AS dominant_patterns",
    "bigint(size(warnings)) AS warnings",
]


def whole_profile(df: DataFrame) -> DataFrame:
    """Every statistic and both value lists of every column."""
    return profile.column_profile(df)


def profile_query(source: Callable) -> Query:
    return lambda spark, sf: whole_profile(source(spark, sf)).selectExpr(*STATISTICS, *LISTS)


def listed_values(df: DataFrame, by: str) -> DataFrame:
    found = first_values(column_frequencies(df), text_cells(df), 10, (by,))
    names = column_names(df).select("pos", F.col("name").alias("physical_name"))
    return found.join(F.broadcast(names), "pos").selectExpr(
        "physical_name", "bigint(rn) AS position", "val AS value", "cnt AS occurrences")


def labelled(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The profile, one row per column, is settled; labels are projections over it."""
    return label(table(spark, sf, name), name)


def label(df: DataFrame, name: str = "dataset") -> DataFrame:
    return labels.label_columns(settled(profile.column_profile(df, name)))


LABELS = [
    "physical_name", "refined_type", "suggested_cast", "round(identifier_score, 3) AS identifier_score", "is_grain_key",
    "candidate_semantic_type", "candidate_role", "candidate_confidence", "decision", "round(schema_confidence, 4) AS schema_confidence",
]


def labels_query(name: str) -> Query:
    return lambda spark, sf: labels.confirmed_roles(labelled(spark, sf, name)).selectExpr(*LABELS)


def variants_query(name: str) -> Query:
    def query(spark, sf):
        found = labels.semantic_roles_variant(labels.refined_types_variant(labelled(spark, sf, name)).withColumnRenamed(
            "variant_confidence", "type_confidence"))
        return found.select("physical_name", "variant_type", "type_confidence", "variant_semantic_type",
                            "variant_role", "variant_confidence")
    return query


def categories_query(name: str, domain: str) -> Query:
    return lambda spark, sf: categories.data_categories(labelled(spark, sf, name), domain).selectExpr(
        "physical_name", "primary_category", "array_join(secondary_categories, ', ') AS secondary_categories",
        "category_confidence")


def rule_query(source: Callable, rule_list: list[dict]) -> Query:
    return lambda spark, sf: rules.evaluate_rules(source(spark, sf), rule_list).selectExpr(
        "rule_key", "rule_type", "records_checked", "pass_count", "fail_count", "round(score, 6) AS score",
        "array_join(target_columns, ', ') AS target_columns", "error IS NOT NULL AS failed")


def edges_query(region: str) -> Query:
    return lambda spark, sf: hierarchy.validate_edges(
        geo(spark, sf, region), [("region", "country"), ("country", "customer")]
    ).selectExpr(
        "parent_column", "child_column", "distinct_child_count", "mapped_child_count", "violating_child_count",
        "round(fd_consistency, 6) AS fd_consistency", "round(mapping_coverage, 6) AS mapping_coverage",
        "round(edge_confidence, 6) AS edge_confidence", "status")


def chain_query(region: str) -> Query:
    def query(spark, sf):
        df = geo(spark, sf, region)
        found = hierarchy.select_chain(df, [("geographic", ["region", "country", "customer"]), ("short", ["region", "country"])])
        return found.selectExpr(
            "status", "template_key", "array_join(level_columns, ' > ') AS levels", "edge_count",
            "round(average_confidence, 6) AS average_confidence", "rejected_edge_count")
    return query


def template_query(spark, sf):
    df = geo(spark, sf)
    found = hierarchy.template_matches(
        label(df), domain_config("Customer")["hierarchy_templates"])
    return found.selectExpr(
        "template_key", "bigint(priority) AS priority", "array_join(level_columns, ' > ') AS levels",
        "array_join(missing_concepts, ', ') AS missing", "round(match_ratio, 6) AS match_ratio", "bigint(rank) AS rank")


def conflicts_query(spark, sf):
    return hierarchy.edge_conflicts(geo(spark, sf, REJECTED_REGION), [("region", "country")]).selectExpr(
        "parent_column", "child_column", "child_value", "array_join(parent_values, ', ') AS parent_values",
        "bigint(parent_count) AS parent_count")


EVENT_RULES = [
    {"rule_key": "value_present", "type": "non_null", "target_column": "value"},
    {"rule_key": "value_range", "type": "numeric_range", "target_column": "value", "min_value": 0, "max_value": 100,
     "inclusive_min": False},
    {"rule_key": "known_type", "type": "allowed_values", "target_column": "event_type",
     "values": ["click", "view", "purchase"]},
    {"rule_key": "json_props", "type": "regex_match", "target_column": "props", "pattern": r"\{\"k\": [0-9]{2}\}"},
    {"rule_key": "user_unique", "type": "expected_unique", "target_column": "user_id"},
    {"rule_key": "type_unique", "type": "expected_unique", "target_column": "event_type"},
    {"rule_key": "purchase_value", "type": "conditional_required", "condition_column": "event_type",
     "condition_value": "purchase", "required_column": "value"},
]
ORDER_RULES = [
    {"rule_key": "keys_ordered", "type": "column_comparison", "left_column": "o_orderkey", "operator": ">=",
     "right_column": "o_custkey"},
    {"rule_key": "dates", "type": "date_range", "target_column": "o_orderdate", "min_date": "1996-01-01",
     "max_date": "1999-12-31"},
    {"rule_key": "same", "type": "cross_field_equality", "left_column": "o_orderkey", "right_column": "o_custkey"},
    {"rule_key": "different", "type": "cross_field_inequality", "left_column": "o_orderkey",
     "right_column": "o_custkey"},
    {"rule_key": "by_role", "type": "numeric_range", "target_role": "monetary_amount", "min_value": 0},
    {"rule_key": "no_column", "type": "non_null", "target_column": "missing"},
    {"rule_key": "no_pattern", "type": "regex_match", "target_column": "o_orderstatus"},
    {"rule_key": "bad_operator", "type": "column_comparison", "left_column": "o_orderkey", "operator": "~",
     "right_column": "o_custkey"},
    {"rule_key": "inactive", "type": "non_null", "target_column": "o_orderkey", "active": False},
]


def order_rules_query(spark, sf):
    found = rules.evaluate_rules(table(spark, sf, "orders"), ORDER_RULES, {"monetary_amount": "o_totalprice"})
    return found.selectExpr(
        "rule_key", "rule_type", "records_checked", "pass_count", "fail_count", "round(score, 6) AS score",
        "array_join(target_columns, ', ') AS target_columns", "error IS NOT NULL AS failed")


ORDER_LIST_RULES = [
    {"rule_key": "customer_in_credit", "type": "allowed_values", "target_column": "o_custkey", "values_from": "in_credit"},
    {"rule_key": "customer_known", "type": "allowed_values", "target_column": "o_custkey", "values_from": "customers",
     "values_column": "c_custkey"},
    {"rule_key": "customer_once", "type": "expected_unique", "target_column": "o_custkey"},
    {"rule_key": "short_list", "type": "allowed_values", "target_column": "o_orderstatus", "values": ["F", "O"]},
    {"rule_key": "price_listed", "type": "allowed_values", "target_column": "o_totalprice", "values_from": "prices"},
    {"rule_key": "no_list", "type": "allowed_values", "target_column": "o_custkey", "values_from": "nowhere"},
    {"rule_key": "no_list_column", "type": "allowed_values", "target_column": "o_custkey", "values_from": "customers",
     "values_column": "nothing"},
]
TEXT_LIST_RULES = [
    {"rule_key": "text_listed", "type": "allowed_values", "target_column": "text", "values_from": "texts"},
    {"rule_key": "text_once", "type": "expected_unique", "target_column": "text"},
    {"rule_key": "source_listed", "type": "allowed_values", "target_column": "source", "values_from": "texts",
     "values_column": "source"},
]


def list_rules_query(name: str, rule_list: list[dict], lists: Callable) -> Query:
    return lambda spark, sf: rules.evaluate_rules(table(spark, sf, name), rule_list, value_lists=lists(spark, sf)).selectExpr(
        "rule_key", "rule_type", "records_checked", "pass_count", "fail_count", "round(score, 6) AS score",
        "array_join(target_columns, ', ') AS target_columns", "error IS NOT NULL AS failed")


def order_lists(spark, sf):
    customers = table(spark, sf, "customer")
    return {
        "in_credit": customers.where("c_acctbal >= 0").select("c_custkey"),
        "customers": customers,
        # of few distinct values against many, with nulls and repeats among them
        "prices": table(spark, sf, "orders").selectExpr("if(o_orderkey % 3 = 0, o_totalprice, NULL)"),
    }


def text_lists(spark, sf):
    return {"texts": table(spark, sf, "documents").where("lang = 'en'").select("text", "source")}


def date_comparison_query(spark, sf):
    df = table(spark, sf, "orders").selectExpr(
        "date_format(o_orderdate, 'yyyy-MM-dd') AS ordered",
        "date_format(date_add(o_orderdate, int(o_orderkey % 3) - 1), 'yyyy-MM-dd') AS shipped")
    return rule_query(lambda s, f: df, [{"rule_key": "shipped_after", "type": "column_comparison",
                                         "left_column": "shipped", "operator": ">", "right_column": "ordered"}])(spark, sf)


def review_query(spark, sf):
    """Low-frequency rules reviewed in bulk: suggestions from events, reviews from users."""
    suggestions = table(spark, sf, "events").selectExpr(
        "event_id AS suggestion_id", "CASE WHEN event_type = 'click' THEN 'proposed' "
        "WHEN event_type = 'view' THEN 'approved' ELSE 'superseded' END AS status")
    reviews = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS suggestion_id", "CASE WHEN o_orderstatus = 'F' THEN 'approve' ELSE 'reject' END AS action",
        "o_orderpriority AS comment")
    reviewed, refused = rules.review_suggestions(suggestions, reviews)
    return reviewed.groupBy("status").agg(
        F.count(F.lit(1)).alias("rows"), F.count("comment").alias("comments"),
        F.count("rejection_reason").alias("reasons"),
    ).unionByName(refused.groupBy(F.col("code").alias("status")).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(0).cast("bigint").alias("comments"),
        F.lit(0).cast("bigint").alias("reasons")))


def quality_parts(spark, sf):
    df = dirty_events(spark, sf)
    return settled(whole_profile(df)), settled(rules.evaluate_rules(df, EVENT_RULES))


def dimensions_of(prof: DataFrame, results: DataFrame) -> DataFrame:
    return (
        quality.completeness(prof, ["value", "event_type"])
        .unionByName(quality.uniqueness(prof, ["event_id", "user_id"]))
        .unionByName(quality.rule_dimensions(results))
        .unionByName(quality.unassessable(prof))
        .withColumn("ord", F.array_position(F.array(*[F.lit(d) for d in quality.DIMENSIONS]), F.col("dimension")))
    )


def quality_query(spark, sf):
    return dimensions_of(*quality_parts(spark, sf)).selectExpr(
        "dimension", "round(score, 6) AS score", "status", "assessed_count", "violation_count")


def overall_query(spark, sf):
    return quality.overall_quality(dimensions_of(*quality_parts(spark, sf))).selectExpr(
        "overall_score", "display_score", "array_join(assessed_dimensions, ', ') AS assessed",
        "array_join(excluded_dimensions, ', ') AS excluded")


def semantic_quality_query(spark, sf):
    df = table(spark, sf, "orders")
    found = label(df)
    return quality.semantic_quality(
        labels.confirmed_roles(found), categories.data_categories(found, "Payments"),
        categories.secondary_domain(found, "Payments"),
        hierarchy.select_chain(df, [("order", ["o_orderstatus", "o_orderpriority"])]),
    ).selectExpr("dimension", "round(score, 6) AS score", "status", "assessed_count")


def readiness_query(spark, sf):
    df = table(spark, sf, "orders")
    found = label(df)
    results = rules.evaluate_rules(df, ORDER_RULES, {"monetary_amount": "o_totalprice"})
    dims = (
        quality.completeness(found, ["o_orderkey", "o_custkey"])
        .unionByName(quality.uniqueness(found, ["o_orderkey"]))
        .unionByName(quality.rule_dimensions(results))
    )
    return readiness.readiness(found, dims, 3).selectExpr(
        "assessment_type", "score", "status", "array_join(transform(strengths, s -> s.code), ', ') AS strengths",
        "array_join(transform(blocking_issues, s -> s.code), ', ') AS blocking_issues",
        "array_join(transform(recommendations, s -> s.code), ', ') AS recommendations")


def domain_query(name: str, domain: str) -> Query:
    def query(spark, sf):
        return categories.domain_scores(labelled(spark, sf, name), domain).selectExpr(
            "domain_name", "round(score, 6) AS score", "bigint(rank) AS rank")
    return query


def domain_decision_query(spark, sf):
    found = labelled(spark, sf, "customer")
    return categories.secondary_domain(found, "Customer").selectExpr(
        "domain_name", "round(confidence, 6) AS confidence", "status",
        "array_join(transform(candidates, c -> c.name), ', ') AS candidates")


def chart(function: Callable[..., DataFrame], name: str, *args) -> Query:
    return lambda spark, sf: function(table(spark, sf, name), *args).selectExpr(
        "bigint(position) AS position", "label", "value")


def missing_query(spark, sf):
    df = dirty_events(spark, sf)
    return charts.missing_values(whole_profile(df)).selectExpr("bigint(position) AS position", "label", "value")


def violations_query(spark, sf):
    return charts.rule_violations(rules.evaluate_rules(dirty_events(spark, sf), EVENT_RULES)).selectExpr(
        "bigint(position) AS position", "label", "value")


def candidate_query(spark, sf):
    return charts.chart_candidates(labelled(spark, sf, "orders"), quality=False).selectExpr(
        "chart_key", "category", "chart_type", "title", "dimension", "metric", "aggregation", "bigint(rank) AS rank")


def rank_query(spark, sf):
    df = table(spark, sf, "orders")
    found = label(df)
    specs = charts.chart_candidates(found, quality=False)
    return charts.rank_charts(specs.withColumn("has_data", F.lit(False)), found).selectExpr(
        "chart_key", "round(relevance, 6) AS relevance", "bigint(chart_rank) AS chart_rank")


def validate_query(spark, sf):
    df = table(spark, sf, "lineitem")
    # every column as the dimension of a bar, and one chart on a column that is not there
    specs = column_names(df).selectExpr(
        "dataset", "pos AS ord", "concat('by_', name) AS chart_key", "'bar' AS chart_type", "name AS dimension",
        "CASE WHEN pos = 0 THEN 'nowhere' ELSE 'l_quantity' END AS metric")
    return charts.validate_charts(specs, whole_profile(df)).selectExpr(
        "chart_key", "dimension", "bigint(size(warnings)) AS warnings")


def cube_query(source: Callable, levels: list[str], metric: str, **bounds) -> Query:
    return lambda spark, sf: cubes.cube_cells(source(spark, sf), levels, metric, **bounds).selectExpr(
        "bigint(level_depth) AS level_depth", "level_column", "array_join(map_values(path), ' > ') AS path", "label",
        "value", "count", "record_count")


def drill_query(spark, sf):
    levels = ["o_orderstatus", "o_orderpriority"]
    built = cubes.cubes(table(spark, sf, "orders"), levels, "o_totalprice")
    return cubes.drill_down(built, levels, {"o_orderstatus": "F"})


def names_query(spark, sf):
    """A catalogue of names as rows: the parts of a brand are its columns, and many are called alike."""
    return table(spark, sf, "part").selectExpr(
        "p_brand AS dataset", "int(p_partkey) AS pos", "concat(' ', upper(p_name), '--') AS name", "p_type AS dtype")


def normalize_query(spark, sf):
    return unique_column_keys(names_query(spark, sf)).selectExpr("dataset", "bigint(pos) AS pos", "name", "normalized_key")


def duplicate_keys_query(spark, sf):
    return duplicate_column_keys(names_query(spark, sf)).select("dataset", "base_key", "columns")


def evidence_query(spark, sf):
    """Why a column counts as an identifier, signal by signal."""
    return label(people(spark, sf)).selectExpr("physical_name", "inline(identifier_evidence)").selectExpr("physical_name", "signal", "value")


def decisions_query(spark, sf):
    """A reviewer's decisions: every third column of orders overridden, the next one left open, the rest unanswered."""
    found = labelled(spark, sf, "orders")
    decisions = found.where("pos % 3 < 2").selectExpr(
        "dataset", "physical_name", "CASE pos % 3 WHEN 0 THEN 'overridden' ELSE 'whatever' END AS decision",
        "CASE WHEN pos = 0 THEN 'order_number' END AS semantic_type", "CASE WHEN pos = 3 THEN 'dimension' END AS role", "0.5D AS confidence")
    return labels.confirmed_roles(found, settled(decisions)).selectExpr(
        "physical_name", "decision", "confirmed_semantic_type", "confirmed_role", "round(schema_confidence, 4) AS schema_confidence")


def described_query(spark, sf):
    df = table(spark, sf, "orders")
    metadata = [{"column_name": "o_orderkey", "mandatory": True, "expected_unique": True, "description": "key"},
                {"column_name": "o_totalprice", "description": "sum of the order"}, {"column_name": "nowhere", "mandatory": True}]
    return labels.described(label(df), plan.metadata_relation(spark, metadata, "dataset")).selectExpr(
        "physical_name", "description", "mandatory", "expected_unique", "refined_type")


def undomained_query(spark, sf):
    """Categories without a domain's boost, so that columns without any signal get the default of their role."""
    return categories.data_categories(label(people(spark, sf)), "Other").selectExpr(
        "physical_name", "primary_category", "array_join(secondary_categories, ', ') AS secondary_categories", "category_confidence")


def weighted_query(spark, sf):
    """Categories under other weights and limits."""
    found = categories.data_categories(labelled(spark, sf, "orders"), "Payments", {"name_keyword_match": 0.9, "column_role_match": 0.8},
                                       {"max_secondary_categories": 1, "secondary_min_ratio_of_primary": 0.1, "secondary_min_absolute": 0.1})
    return found.selectExpr("physical_name", "primary_category", "array_join(secondary_categories, ', ') AS secondary_categories",
                            "category_confidence")


def cards_domain_query(spark, sf):
    """Payment columns score every secondary domain apart, and none high enough to be sure."""
    found = label(cards(spark, sf))
    scores = categories.domain_scores(found, "Payments").selectExpr("dataset", "domain_name", "round(score, 6) AS score", "bigint(rank) AS rank")
    decided = categories.secondary_domain(found, "Payments").selectExpr(
        "dataset", "status AS decision", "array_join(transform(candidates, c -> c.name), ', ') AS candidates")
    return scores.join(F.broadcast(decided), "dataset").drop("dataset")


def unresolved_chain_query(spark, sf):
    df = table(spark, sf, "orders")
    found = hierarchy.select_chain(df, [("order", ["o_orderstatus", "o_orderpriority"]), ("one", ["o_orderstatus"])])
    return found.selectExpr("status", "template_key", "bigint(size(level_columns)) AS levels", "edge_count", "bigint(size(warnings)) AS warnings")


def build_query(spark, sf):
    """From templates to a chain, with the edges and the conflicts of the chain's own levels."""
    df = geo(spark, sf, WARNING_REGION)
    chain, edges, conflicts = hierarchy.examine_hierarchy(df, settled(label(df)), "Customer")
    found = chain.selectExpr("'chain' AS part", "status AS name", "array_join(level_columns, ' > ') AS value", "edge_count AS n")
    if edges is not None:
        found = found.unionByName(edges.selectExpr("'edge' AS part", "concat(parent_column, ' > ', child_column) AS name", "status AS value",
                                                   "violating_child_count AS n"))
        found = found.unionByName(conflicts.selectExpr("'conflict' AS part", "child_value AS name", "array_join(parent_values, ', ') AS value",
                                                       "bigint(parent_count) AS n"))
    return found


def loaded_rules_query(spark, sf):
    """Rules of the domain, with roles resolved to columns, and of a request; an unknown type is dropped."""
    df = cards(spark, sf)
    found = settled(label(df))
    roles = {r["candidate_semantic_type"]: r["physical_name"] for r in labels.role_map(found).collect()}
    asked = [{"rule_key": "blank", "type": "regex_match", "target_column": "blank", "pattern": "x"}, {"type": "nonsense"},
             {"type": "allowed_values", "target_column": "auth_status", "values": ["F", "O"]}]
    to_check = rules.domain_rules("Payments", "Fraud") + rules.request_rules(asked)
    return rules.evaluate_rules(df, to_check, roles).selectExpr(
        "rule_key", "rule_type", "records_checked", "pass_count", "round(score, 6) AS score",
        "array_join(target_columns, ', ') AS target_columns", "error IS NOT NULL AS failed")


def notes_query(spark, sf):
    """What readiness rests on: every strength, blocker and piece of advice with its value."""
    df = table(spark, sf, "orders")
    found = label(df)
    dims = quality.completeness(found, ["o_orderkey", "o_custkey"]).unionByName(quality.uniqueness(found, ["o_orderkey"]))
    rated = readiness.readiness(found, dims, 3)
    parts = [rated.selectExpr("assessment_type", f"'{kind}' AS kind", f"inline({kind})") for kind in ("strengths", "blocking_issues", "recommendations")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).selectExpr("assessment_type", "kind", "code", "round(value, 6) AS value")


def dispatch_query(spark, sf):
    """Charts of every kind through one entry; kinds without data of their own give none."""
    df, data = table(spark, sf, "orders"), None
    for key, kind, dimension, metric, aggregation in [
            ("donut", "donut", "o_orderstatus", None, "count"), ("stacked", "stacked_bar", "o_orderpriority", "o_totalprice", "sum"),
            ("line", "line", "o_orderdate", None, "count"), ("mean", "kpi", None, "o_totalprice", "mean"), ("box", "box", "o_orderstatus", None, "count"),
            ("lost", "bar", "nowhere", None, "count")]:
        part = charts.chart_data(df, {"chart_key": key, "chart_type": kind, "dimension": dimension, "metric": metric, "aggregation": aggregation})
        if part is not None:
            data = part if data is None else data.unionByName(part)
    return data.selectExpr("chart_key", "bigint(position) AS position", "label", "value")


def quality_chart_query(spark, sf):
    return charts.quality_scores(dimensions_of(*quality_parts(spark, sf))).selectExpr("bigint(position) AS position", "label", "value")


def template_charts_query(spark, sf):
    found = settled(label(cards(spark, sf)))
    domain = charts.template_charts(found, chart_templates("Payments")["domain"])
    common = charts.profiling_charts(found, chart_templates("Payments")["profiling"])
    return domain.unionByName(common).select("chart_key", "category", "chart_type", "title", "dimension", "metric", "aggregation")


def guards_query(spark, sf):
    """The code of every refusal, provoked with the orders at hand."""
    df, codes = table(spark, sf, "orders"), []
    for guard, provoke in [
            ("rows", lambda: check_table(df, max_rows=100)), ("columns", lambda: check_table(df, max_columns=5)),
            ("no rows", lambda: check_table(df.where("o_orderkey < 0"))), ("no columns", lambda: check_table(df.select())),
            ("size", lambda: read_table(spark, f"{sf}/orders.parquet", max_mb=1e-6)), ("format", lambda: read_table(spark, f"{sf}/orders.xlsx")),
            ("domain", lambda: check_domain("Sports")), ("none", lambda: check_table(df, max_rows=10**15, max_columns=6))]:
        try:
            provoke()
            codes.append((guard, "accepted"))
        except ProfileError as error:
            codes.append((guard, error.code))
    return spark.createDataFrame(codes, "guard string, code string")


def csv_query(spark, sf):
    """Customers written as CSV files with spellings of missing values, and read again as texts."""
    path = f"{shared_folder(spark)}/customers.csv"
    table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 5 = 0 THEN 'N/A' WHEN c_custkey % 7 = 0 THEN 'null' ELSE c_mktsegment || ', \"' || c_nationkey || '\"' END AS segment",
        "c_acctbal").write.csv(path, header=True, quote='"', escape='"')
    return read_table(spark, path).selectExpr("c_custkey", "segment", "c_acctbal")


def readback_query(spark, sf):
    """A run written, published and read back whole: rows per result table, and its state."""
    root = shared_folder(spark)
    done = plan.run_and_write(spark, root, table(spark, sf, "orders"), "Payments", "orders",
                              metadata=[{"column_name": "o_orderkey", "mandatory": True, "expected_unique": True}])
    suggested = table(spark, sf, "orders").selectExpr("o_orderkey AS suggestion_id", "o_orderstatus AS rule_key",
                                                      "if(o_orderkey % 3 = 0, 'proposed', 'rejected') AS status")
    write_suggestions(suggested, root, "suggested")
    record_status(spark, root, "suggested", "completed", "Payments")
    suggested = list_suggestions(read_result(spark, root, "rule_suggestions"), "suggested", "proposed")
    record = read_run(spark, root, done.run_id)
    sizes = ", ".join(f"named_struct('name', '{t}', 'n', bigint(size({t})))" for t in (
        "dataset_profiles", "column_profiles", "column_categories", "quality_assessments", "overall_quality", "readiness_assessments", "secondary_domains"))
    rows = record.selectExpr(f"inline(array({sizes}, named_struct('name', 'rows', 'n', row_count), named_struct('name', 'columns', 'n', bigint(column_count)), "
                             "named_struct('name', status, 'n', bigint(json IS NOT NULL))))")
    return rows.unionByName(suggested.groupBy().agg(F.count(F.lit(1)).alias("n")).selectExpr("'suggestions' AS name", "n"))


def merge_query(spark, sf):
    """States of two halves of lineitem merged: exact statistics, and whether the sketches keep to their errors.

    The exact distinct counts and ranks come from the values themselves.
    """
    df = table(spark, sf, "lineitem")
    halves = [states.column_states(df.where(f"l_orderkey % 2 = {k}")) for k in (0, 1)]
    found = settled(states.state_profile(states.merged_states(halves[0].unionByName(halves[1]))))
    freq = column_frequencies(df)
    exact = freq.groupBy("pos").agg(F.count("val").alias("distinct_count"))
    # rank of a sketched quartile among the numbers: values below it, and values up to it
    ranks = read_numbers(freq).join(F.broadcast(found.select("pos", "q25", "q50", "q75")), "pos").groupBy("pos").agg(
        F.sum("cnt").alias("n"), *[F.sum(F.when(F.col("num") < F.col(q), F.col("cnt")).otherwise(0)).alias(f"{q}_below") for q in ("q25", "q50", "q75")],
        *[F.sum(F.when(F.col("num") <= F.col(q), F.col("cnt")).otherwise(0)).alias(f"{q}_to") for q in ("q25", "q50", "q75")])
    near = " AND ".join(f"{q}_below / n <= {p} + {states.RANK_ERROR} AND {q}_to / n >= {p} - {states.RANK_ERROR}" for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)))
    return found.join(exact, "pos").join(ranks, "pos", "left").selectExpr(
        "physical_name", "row_count", "null_count", "num_count", "round(min_value, 4) AS min_value", "round(max_value, 4) AS max_value",
        "round(mean, 4) AS mean", "round(std_dev, 3) AS std_dev", "bigint(max_string_length) AS max_string_length", "round(avg_string_length, 4) AS avg_string_length",
        f"abs(distinct_estimate - distinct_count) <= greatest(1, distinct_count * {states.DISTINCT_ERROR}) AS distinct_within",
        f"coalesce({near}, true) AS quantiles_within")


def catalogue_query(spark, sf):
    """Six tables labelled together."""
    tables = {name: table(spark, sf, name) for name in ("customer", "orders", "lineitem", "part", "supplier", "nation")}
    return catalogue.catalogue_labels(tables).selectExpr(
        "dataset", "physical_name", "row_count", "distinct_count", "refined_type", "round(identifier_score, 3) AS identifier_score", "is_grain_key",
        "candidate_semantic_type", "candidate_role", "array_join(sample_values, ' | ') AS sample_values")


def dataset_query(name: str) -> Query:
    return lambda spark, sf: dataset.dataset_profile(table(spark, sf, name)).selectExpr(
        "row_count", "bigint(column_count) AS column_count", "duplicate_row_count", "data_bytes",
        "array_join(normalized_keys, ', ') AS normalized_keys")


def patterns_query(function: Callable, name: str, column: str) -> Query:
    return lambda spark, sf: function(table(spark, sf, name), column).selectExpr(
        "pattern", "matches", "round(share, 6) AS share", "dominant")


def warnings_query(spark, sf):
    return whole_profile(dirty_events(spark, sf)).selectExpr(
        "physical_name", "bigint(size(warnings)) AS warnings", "array_join(dominant_patterns, ', ') AS patterns")


def date_ratio_query(spark, sf):
    return whole_profile(text_dates(spark, sf)).selectExpr(
        "physical_name", "round(datetime_parse_ratio, 6) AS datetime_parse_ratio",
        "array_join(dominant_patterns, ', ') AS dominant_patterns")


def role_map_query(spark, sf):
    return labels.role_map(labelled(spark, sf, "lineitem")).selectExpr("candidate_semantic_type", "physical_name")


def grain_query(spark, sf):
    return labels.grain(labelled(spark, sf, "customer")).select("inferred_grain")


def all_queries() -> dict[str, Query]:
    duplicate_columns = ["event_type", "user_id"]
    return {
        "column_profile_orders": profile_query(lambda s, f: table(s, f, "orders")),
        "column_profile_lineitem": profile_query(lambda s, f: table(s, f, "lineitem")),
        "column_profile_documents": profile_query(lambda s, f: table(s, f, "documents")),
        "column_profile_dirty_events": profile_query(dirty_events),
        "column_profile_people": profile_query(people),
        "dataset_profile_lineitem": dataset_query("lineitem"),
        "dataset_profile_documents": dataset_query("documents"),
        "duplicate_rows_events": lambda spark, sf: dataset.duplicate_rows(
            table(spark, sf, "events"), duplicate_columns),
        "normalize_names": normalize_query,
        "duplicate_keys": duplicate_keys_query,
        "top_values_part": lambda spark, sf: listed_values(table(spark, sf, "part"), "frequency"),
        "sample_values_part": lambda spark, sf: listed_values(table(spark, sf, "part"), "value"),
        "datetime_ratio_text_dates": date_ratio_query,
        "pattern_counts_customer": patterns_query(profile.pattern_counts, "customer", "c_acctbal"),
        "pattern_detector_documents": patterns_query(profile.detect_patterns, "documents", "text"),
        "custom_pattern_supplier": lambda spark, sf: profile.custom_pattern_ratio(
            table(spark, sf, "supplier"), "s_name", "Supplier#[0-9]+1$").selectExpr("round(match_ratio, 6) AS match_ratio"),
        "profile_warnings": warnings_query,
        "labels_orders": labels_query("orders"),
        "labels_events": labels_query("events"),
        "labels_customer": labels_query("customer"),
        "labels_labels": labels_query("labels"),
        "label_variants_orders": variants_query("orders"),
        "label_variants_part": variants_query("part"),
        "grain_customer": grain_query,
        "role_map_lineitem": role_map_query,
        "categories_customer": categories_query("customer", "Customer"),
        "categories_orders": categories_query("orders", "Payments"),
        "category_variant_orders": lambda spark, sf: categories.data_categories_variant(
            labelled(spark, sf, "orders"), "Finance").selectExpr(
                "physical_name", "primary_category", "array_join(secondary_categories, ', ') AS secondary_categories",
                "round(category_confidence, 6) AS category_confidence"),
        "domain_scores_orders": domain_query("orders", "Payments"),
        "domain_decision_customer": domain_decision_query,
        "template_match_geo": template_query,
        "fd_edges_clean": edges_query(CLEAN_REGION),
        "fd_edges_warning": edges_query(WARNING_REGION),
        "fd_edges_rejected": edges_query(REJECTED_REGION),
        "fd_conflicts": conflicts_query,
        "hierarchy_chain_clean": chain_query(CLEAN_REGION),
        "hierarchy_chain_rejected": chain_query(REJECTED_REGION),
        "rules_events": rule_query(dirty_events, EVENT_RULES),
        "rules_orders": order_rules_query,
        "rule_date_comparison": date_comparison_query,
        "rules_value_lists_orders": list_rules_query("orders", ORDER_LIST_RULES, order_lists),
        "rules_value_lists_documents": list_rules_query("documents", TEXT_LIST_RULES, text_lists),
        "rule_review": review_query,
        "quality_dimensions": quality_query,
        "quality_overall": overall_query,
        "quality_semantic": semantic_quality_query,
        "readiness_orders": readiness_query,
        "chart_bar_sum": chart(charts.category_values, "lineitem", "l_suppkey", "l_extendedprice", "sum"),
        "chart_bar_mean": chart(charts.category_values, "orders", "o_orderpriority", "o_totalprice", "mean"),
        "chart_value_counts": chart(charts.category_values, "part", "p_brand"),
        "chart_line_month": chart(charts.month_values, "orders", "o_orderdate", "o_totalprice", "sum"),
        "chart_kpi": chart(charts.kpi_value, "lineitem", "l_extendedprice", "sum"),
        "chart_histogram": chart(charts.histogram, "orders", "o_totalprice"),
        "chart_missing_values": missing_query,
        "chart_rule_violations": violations_query,
        "chart_candidates": candidate_query,
        "chart_rank": rank_query,
        "chart_validate": validate_query,
        "cube_orders": cube_query(lambda s, f: table(s, f, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice"),
        "cube_geo": cube_query(geo, ["region", "country", "customer"], "balance"),
        "cube_lineitem": cube_query(lambda s, f: table(s, f, "lineitem"),
                                    ["l_returnflag", "l_linestatus", "l_suppkey"], "l_quantity"),
        "drill_down_orders": drill_query,
        "labels_people": lambda spark, sf: labels.confirmed_roles(label(people(spark, sf))).selectExpr(*LABELS),
        "labels_cards": lambda spark, sf: labels.confirmed_roles(label(cards(spark, sf))).selectExpr(*LABELS),
        "identifier_evidence_people": evidence_query,
        "confirmed_roles_orders": decisions_query,
        "described_columns_orders": described_query,
        "categories_without_domain": undomained_query,
        "categories_weighted": weighted_query,
        "domain_decision_cards": cards_domain_query,
        "hierarchy_chain_warning": chain_query(WARNING_REGION),
        "hierarchy_unresolved": unresolved_chain_query,
        "hierarchy_build_geo": build_query,
        "rules_loaded_cards": loaded_rules_query,
        "readiness_notes": notes_query,
        "chart_dispatch": dispatch_query,
        "chart_quality": quality_chart_query,
        "chart_templates_cards": template_charts_query,
        "table_guards": guards_query,
        "csv_customers": csv_query,
        "run_readback_orders": readback_query,
        "catalogue_labels": catalogue_query,
        "profile_merge_lineitem": merge_query,
    }
