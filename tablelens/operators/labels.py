"""Labels of a column: refined type, identifier, semantic role, decision.

Each is a projection over the profile; one job labels every column of every
data set in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.config import variant_values as variant
from tablelens.config.fixed_values import (
    COUNTRY_CODES_2,
    COUNTRY_CODES_3,
    CURRENCY_CODES,
    DESCRIPTION_WORDS,
    FLAG_SUB_TYPES,
    GEO_SUB_TYPES,
    GEO_WORDS,
    IDENTIFIER_CARDINALITY,
    IDENTIFIER_NAMES,
    IDENTIFIER_SUFFIXES,
    METRIC_SUB_TYPES,
    METRIC_WORDS,
    NAME_WORDS,
    PERCENTAGE_HINTS,
    SHAPE_PATTERNS,
    STATUS_SUB_TYPES,
    STATUS_WORDS,
    TEMPORAL_SUB_TYPES,
)
from tablelens.functions.text import sql_list, sql_string

_REGEX = dict(SHAPE_PATTERNS)


def words_sql(text: str, words) -> str:
    """``text`` contains one of ``words``; one expression for any list."""
    return f"exists(array{sql_list(words)}, w -> contains({text}, w))" if words else "false"


def segment_sql(key: str, words) -> str:
    """One of ``words`` is bounded by ``_`` or the ends of ``key``."""
    return f"exists(array{sql_list(words)}, w -> contains(concat('_', {key}, '_'), concat('_', w, '_')))"


def first_sub_type_sql(key: str, sub_types, default: str | None) -> str:
    whens = " ".join(f"WHEN {words_sql(key, words)} THEN {sql_string(name)}" for name, words in sub_types)
    return f"CASE {whens} ELSE {sql_string(default) if default else 'NULL'} END"


def _has(label: str) -> str:
    return f"array_contains(dominant_patterns, '{label}')"


def _share(condition: str) -> str:
    """Share of representative values meeting a condition on ``v``."""
    return f"size(filter(representative_values, v -> {condition})) / greatest(size(representative_values), 1)"


def _in_list(codes) -> str:
    return _share(f"upper(v) IN {sql_list(codes)}")


# R2 .. R14 in order; the first that holds names the type.
_WHOLE = (
    "min_value = floor(min_value) AND max_value = floor(max_value) "
    "AND forall(sample_values, v -> coalesce(try_cast(v AS double) = floor(try_cast(v AS double)), true))"
)
_TYPE_LADDER = [
    ("non_null_count = 0", "unknown"),
    ("boolean_parse_ratio >= 0.95 AND distinct_count <= 3", "boolean"),
    ("numeric_parse_ratio >= 0.95 AND distinct_count <= 2 AND min_value >= 0 AND max_value <= 1", "boolean"),
    (f"datetime_parse_ratio >= 0.90 AND ({_has('YYYY-MM-DD')} OR {_has('DATE_SLASH')})", "date"),
    ("datetime_parse_ratio >= 0.90", "datetime"),
    (f"{_has('EMAIL')} OR {_share('v RLIKE ' + sql_string(_REGEX['EMAIL']))} >= 0.8", "email"),
    (f"{_has('PHONE')} OR {_share('v RLIKE ' + sql_string(_REGEX['PHONE']))} >= 0.8", "phone"),
    (f"distinct_count <= 50 AND {_has('THREE_LETTER_CODE')} AND {_in_list(CURRENCY_CODES)} >= 0.7", "currency_code"),
    (f"distinct_count <= 250 AND {_has('TWO_LETTER_CODE')} AND {_in_list(COUNTRY_CODES_2)} >= 0.7", "country_code"),
    (f"distinct_count <= 250 AND {_has('THREE_LETTER_CODE')} AND {_in_list(COUNTRY_CODES_3)} >= 0.7", "country_code"),
    (
        "numeric_parse_ratio >= 0.90 AND min_value >= 0 AND max_value <= 100 "
        f"AND {words_sql('normalized_key', PERCENTAGE_HINTS)}",
        "percentage",
    ),
    (f"numeric_parse_ratio >= 0.90 AND ({_has('INTEGER')} OR NOT {_has('DECIMAL_2DP')} AND {_WHOLE})", "integer"),
    ("numeric_parse_ratio >= 0.90", "decimal"),
    (f"cardinality_ratio >= 0.98 AND non_null_count > 10 OR {_has('UUID')}", "identifier"),
    (
        "cardinality_ratio <= 0.05 AND distinct_count <= 50 OR distinct_count <= 20 AND non_null_count >= 50",
        "categorical",
    ),
]

# The type a column of each refined type is read as.
SUGGESTED_CASTS = {
    "integer": "bigint", "decimal": "double", "percentage": "double",
    "boolean": "boolean", "date": "date", "datetime": "timestamp",
}


def refined_types(profile: DataFrame) -> DataFrame:
    """Add ``refined_type`` and the ``suggested_cast``."""
    ladder = " ".join(f"WHEN {condition} THEN '{name}'" for condition, name in _TYPE_LADDER)
    casts = " ".join(f"WHEN '{name}' THEN '{cast}'" for name, cast in SUGGESTED_CASTS.items())
    return profile.selectExpr("*", f"CASE {ladder} ELSE 'text' END AS refined_type").selectExpr(
        "*", f"CASE refined_type {casts} ELSE 'string' END AS suggested_cast")


def refined_types_variant(profile: DataFrame, rules: dict | None = None) -> DataFrame:
    """The configurable ladder: adds ``variant_type`` and ``variant_confidence``."""
    r = {**variant.TYPE_RULES, **(rules or {})}
    date_only = " OR ".join(_has(label) for label in r["date_only_patterns"])
    dated = f"datetime_parse_ratio >= {r['datetime_min_ratio']} AND numeric_parse_ratio < 0.90"
    numeric = f"numeric_parse_ratio >= {r['numeric_min_ratio']}"
    low, high = r["percentage_range"]
    ladder = [
        ("non_null_count = 0", "unknown", 0.0),
        (f"boolean_parse_ratio >= {r['boolean_min_ratio']} AND distinct_count <= {r['boolean_max_distinct']}",
         "boolean", 0.92),
        (f"{dated} AND ({date_only})", "date", 0.90),
        (dated, "datetime", 0.88),
        (_has("EMAIL"), "email", 0.93),
        (f"{_share('v RLIKE ' + sql_string(_REGEX['EMAIL']))} >= {r['email_min_match']}", "email", 0.88),
        (_has("PHONE"), "phone", 0.88),
        (f"distinct_count <= {r['currency_max_distinct']} AND {_has('THREE_LETTER_CODE')} "
         f"AND {_in_list(CURRENCY_CODES)} >= {r['code_min_match']}", "currency_code", 0.90),
        (f"distinct_count <= {r['country_max_distinct']} AND {_has('TWO_LETTER_CODE')} "
         f"AND {_in_list(COUNTRY_CODES_2)} >= {r['code_min_match']}", "country_code", 0.89),
        (f"distinct_count <= {r['country_max_distinct']} AND {_has('THREE_LETTER_CODE')} "
         f"AND {_in_list(COUNTRY_CODES_3)} >= {r['code_min_match']}", "country_code", 0.89),
        (f"numeric_parse_ratio >= {r['percentage_min_numeric']} AND min_value >= {low} AND max_value <= {high} "
         f"AND {words_sql('normalized_key', PERCENTAGE_HINTS)}", "percentage", 0.85),
        (f"{numeric} AND {_has('INTEGER')}", "integer", 0.85),
        (f"{numeric} AND {_has('DECIMAL_2DP')}", "decimal", 0.85),
        (f"{numeric} AND min_value = floor(min_value) AND max_value = floor(max_value)", "integer", 0.78),
        (numeric, "decimal", 0.80),
        (f"cardinality_ratio >= {r['identifier_min_cardinality']} AND non_null_count >= {r['identifier_min_rows']}",
         "identifier", 0.85),
        (_has("UUID"), "identifier", 0.92),
        (f"cardinality_ratio <= {r['categorical_max_cardinality']} "
         f"AND distinct_count <= {r['categorical_max_distinct']}", "categorical", 0.80),
        (f"distinct_count <= {r['categorical_alt_max_distinct']} "
         f"AND non_null_count >= {r['categorical_alt_min_rows']}", "categorical", 0.75),
    ]
    whens = " ".join(f"WHEN {c} THEN named_struct('t', '{t}', 'c', {s}D)" for c, t, s in ladder)
    chosen = f"CASE {whens} ELSE named_struct('t', 'text', 'c', 0.6D) END"
    return (
        profile.selectExpr("*", f"{chosen} AS chosen")
        .selectExpr("*", "chosen.t AS variant_type", "chosen.c AS variant_confidence")
        .drop("chosen")
    )


_NAME_HINT = (
    "normalized_key RLIKE '(?i)(?:" + "|".join(IDENTIFIER_SUFFIXES) + ")$|^(?:" + "|".join(IDENTIFIER_NAMES) + ")$'"
)


def _signals(threshold: float) -> list[tuple[str, str, float, str]]:
    """(signal, condition, weight, evidence value), in the order they add up."""
    return [
        ("high_cardinality", f"non_null_count > 0 AND cardinality_ratio >= {threshold}", 0.50, "cardinality_ratio"),
        ("moderate_cardinality",
         f"non_null_count > 0 AND cardinality_ratio < {threshold} AND cardinality_ratio >= 0.90", 0.25,
         "cardinality_ratio"),
        ("low_null_ratio", "null_ratio <= 0.01", 0.10, "null_ratio"),
        ("high_null_ratio_penalty", "null_ratio > 0.10", -0.15, "null_ratio"),
        ("zero_duplicates", "duplicate_count = 0 AND non_null_count > 1", 0.15, "NULL"),
        ("uuid_pattern", _has("UUID"), 0.20, "NULL"),
        ("refined_type_identifier", "refined_type = 'identifier'", 0.10, "NULL"),
        ("name_hint", _NAME_HINT, 0.05, "NULL"),
        ("low_cardinality_disqualifies", "cardinality_ratio < 0.50 AND non_null_count > 10", -0.30,
         "cardinality_ratio"),
    ]


def identifiers(typed: DataFrame, threshold: float = IDENTIFIER_CARDINALITY) -> DataFrame:
    """Add ``identifier_score``, ``is_grain_key`` and ``identifier_evidence``."""
    signals = _signals(threshold)
    score = " + ".join(f"CASE WHEN {condition} THEN {weight}D ELSE 0D END" for _, condition, weight, _ in signals)
    evidence = ", ".join(
        f"CASE WHEN {condition} THEN named_struct('signal', '{name}', 'value', round(CAST({value} AS double), 4)) END"
        for name, condition, _, value in signals
    )
    return typed.selectExpr(
        "*", f"greatest(0D, least(1D, {score})) AS raw_score", f"array_compact(array({evidence})) AS identifier_evidence",
    ).selectExpr(
        "* EXCEPT (raw_score)", "round(raw_score, 3) AS identifier_score",
        f"raw_score >= 0.60D AND cardinality_ratio >= {threshold} AS is_grain_key",
    )


def grain(identified: DataFrame) -> DataFrame:
    """One row per data set: grain columns in order, and joined by ``+``."""
    return identified.groupBy("dataset").agg(
        F.expr("transform(array_sort(collect_list(CASE WHEN is_grain_key "
               "THEN named_struct('pos', pos, 'name', physical_name) END)), s -> s.name)").alias("grain_columns")
    ).selectExpr("*", "CASE WHEN size(grain_columns) > 0 THEN concat_ws(' + ', grain_columns) END AS inferred_grain")


def _role(semantic: str, role: str, confidence: float) -> str:
    return f"named_struct('semantic_type', {semantic}, 'role', '{role}', 'confidence', {confidence}D)"


def semantic_roles(identified: DataFrame) -> DataFrame:
    """Add ``candidate_semantic_type``, ``candidate_role`` and ``candidate_confidence``."""
    key = "normalized_key"
    description = words_sql(key, DESCRIPTION_WORDS)
    whole = "refined_type IN ('integer', 'decimal')"
    ladder = [
        ("is_grain_key", _role("'identifier'", "identifier", 0.90)),
        ("refined_type = 'date'",
         _role(first_sub_type_sql(key, TEMPORAL_SUB_TYPES, "date"), "temporal_dimension", 0.88)),
        ("refined_type = 'datetime'",
         _role(first_sub_type_sql(key, TEMPORAL_SUB_TYPES, "datetime"), "temporal_dimension", 0.88)),
        ("refined_type = 'boolean'", _role(first_sub_type_sql(key, FLAG_SUB_TYPES, "flag"), "flag", 0.85)),
        ("refined_type = 'email'", _role("'email_address'", "dimension", 0.92)),
        ("refined_type = 'phone'", _role("'phone_number'", "dimension", 0.88)),
        ("refined_type = 'currency_code'", _role("'currency_code'", "dimension", 0.93)),
        ("refined_type = 'country_code'", _role("'country_code'", "dimension", 0.91)),
        ("refined_type = 'percentage'", _role("'percentage'", "metric", 0.85)),
        (f"{whole} AND {words_sql(key, METRIC_WORDS)}",
         _role(first_sub_type_sql(key, METRIC_SUB_TYPES, "monetary_amount"), "metric", 0.85)),
        (f"{whole} AND cardinality_ratio <= 0.05 AND distinct_count <= 20",
         _role("'numeric_category'", "dimension", 0.70)),
        (whole, _role("'numeric_measure'", "metric", 0.65)),
        (f"refined_type IN ('categorical', 'text') AND {description}", _role("'description'", "text_field", 0.78)),
        (f"refined_type = 'categorical' AND {words_sql(key, STATUS_WORDS)}",
         _role(first_sub_type_sql(key, STATUS_SUB_TYPES, "status"), "dimension", 0.82)),
        (f"refined_type = 'categorical' AND {words_sql(key, GEO_WORDS)}",
         _role(first_sub_type_sql(key, GEO_SUB_TYPES, "geographic"), "dimension", 0.80)),
        ("refined_type = 'categorical'", _role("'dimension'", "dimension", 0.70)),
        (f"refined_type = 'text' AND {words_sql(key, NAME_WORDS)}", _role("'name'", "dimension", 0.75)),
        ("refined_type = 'text'", _role("'text'", "text_field", 0.50)),
    ]
    return _with_role(identified, ladder, "candidate")


def semantic_roles_variant(identified: DataFrame) -> DataFrame:
    """The configurable ladder, from ``refined_type``: adds ``variant_*`` role columns."""
    key = "normalized_key"
    metric = segment_sql(key, variant.METRIC_KEYWORDS)
    temporal_type = first_sub_type_sql(key, variant.TEMPORAL_SUB_TYPES, "datetime")
    flag = " ".join(
        f"WHEN contains({key}, '{w}') THEN "
        + ("'flag'" if w in variant.PLAIN_FLAG_KEYWORDS else f"'{w}_flag'")
        for w in variant.FLAG_KEYWORDS
    )
    suffix = " OR ".join(f"endswith({key}, '{s}')" for s in variant.TEMPORAL_SUFFIXES)
    ladder = [
        (f"is_grain_key AND NOT {metric}", _role("'identifier'", "identifier", 0.90)),
        ("refined_type IN ('date', 'datetime')", _role(temporal_type, "temporal_dimension", 0.88)),
        ("refined_type = 'boolean'", _role(f"CASE {flag} ELSE 'flag' END", "flag", 0.85)),
        (metric, _role(first_sub_type_sql(key, variant.METRIC_SUB_TYPES, "numeric_measure"), "metric", 0.85)),
        (words_sql(key, variant.TEMPORAL_KEYWORDS),
         _role(first_sub_type_sql(key, variant.TEMPORAL_SUB_TYPES, "date"), "temporal_dimension", 0.75)),
        (suffix, _role("'datetime'", "temporal_dimension", 0.72)),
        (words_sql(key, variant.TEXT_KEYWORDS), _role("'description'", "text_field", 0.78)),
        (words_sql(key, variant.DIMENSION_KEYWORDS),
         _role(first_sub_type_sql(key, variant.DIMENSION_SUB_TYPES, "dimension"), "dimension", 0.80)),
        ("refined_type IN ('integer', 'decimal') AND cardinality_ratio > 0.05",
         _role("'numeric_measure'", "metric", 0.65)),
        ("refined_type IN ('integer', 'decimal')", _role("'numeric_category'", "dimension", 0.65)),
        ("refined_type = 'categorical'", _role("'dimension'", "dimension", 0.70)),
        ("refined_type = 'text'", _role("'text'", "text_field", 0.50)),
    ]
    return _with_role(identified, ladder, "variant")


def _with_role(df: DataFrame, ladder, prefix: str) -> DataFrame:
    whens = " ".join(f"WHEN {condition} THEN {role}" for condition, role in ladder)
    unknown = _role("CAST(NULL AS string)", "unknown", 0.30)
    return df.selectExpr("*", f"CASE {whens} ELSE {unknown} END AS chosen").selectExpr(
        "* EXCEPT (chosen)",
        f"chosen.semantic_type AS {prefix}_semantic_type", f"chosen.role AS {prefix}_role",
        f"chosen.confidence AS {prefix}_confidence",
    )


def confirmed_roles(roles: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Add the decision on every candidate.

    ``decisions``: ``(dataset, physical_name, decision, semantic_type, role,
    confidence)`` from a reviewer.  Columns nobody decided on are confirmed
    from a confidence of 0.80 up, at nine tenths of it.
    """
    if decisions is None:
        answered, source = "false", roles
        for name in ("decision", "given_semantic_type", "given_role"):
            source = source.withColumn(name, F.lit(None).cast("string"))
        source = source.withColumn("given_confidence", F.lit(None).cast("double"))
    else:
        given = decisions.selectExpr(
            "dataset", "physical_name", "coalesce(decision, '') AS decision", "semantic_type AS given_semantic_type",
            "role AS given_role", "confidence AS given_confidence")
        answered, source = "decision IS NOT NULL", roles.join(F.broadcast(given), ["dataset", "physical_name"], "left")
    sure = "candidate_confidence >= 0.80D"
    overridden = "decision <=> 'overridden'"
    return source.selectExpr(
        "* EXCEPT (decision, given_semantic_type, given_role, given_confidence)",
        f"CASE WHEN NOT {answered} THEN if({sure}, 'confirmed', 'unresolved') "
        "WHEN decision IN ('confirmed', 'overridden', 'unresolved') THEN decision ELSE 'unresolved' END AS decision",
        f"CASE WHEN {overridden} THEN coalesce(nullif(given_semantic_type, ''), candidate_semantic_type) "
        "ELSE candidate_semantic_type END AS confirmed_semantic_type",
        f"CASE WHEN {overridden} THEN coalesce(nullif(given_role, ''), candidate_role) "
        "ELSE candidate_role END AS confirmed_role",
        f"CASE WHEN {answered} THEN given_confidence WHEN {sure} THEN candidate_confidence * 0.9D "
        "ELSE candidate_confidence END AS schema_confidence",
    )


def role_map(roles: DataFrame) -> DataFrame:
    """Semantic type to the last column that has it."""
    return roles.where("candidate_semantic_type IS NOT NULL").groupBy("dataset", "candidate_semantic_type").agg(
        F.max_by("physical_name", "pos").alias("physical_name"))


def label_columns(profile: DataFrame) -> DataFrame:
    """Type, identifier and role of every column in one projection chain."""
    return semantic_roles(identifiers(refined_types(profile)))


def described(labelled: DataFrame, metadata: DataFrame) -> DataFrame:
    """Attach caller metadata ``(dataset, physical_name, description, mandatory, expected_unique)``."""
    return labelled.join(F.broadcast(metadata), ["dataset", "physical_name"], "left")


