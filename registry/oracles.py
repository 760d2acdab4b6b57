"""The registered queries in DuckDB SQL, written from the definitions."""

from __future__ import annotations

from registry.queries import CARDS, CLEAN_REGION, PEOPLE, REJECTED_REGION, WARNING_REGION
from tablelens.config import fixed_values as fixed
from tablelens.config import variant_values as variant
from tablelens.config.domains import DOMAINS

COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "labels": ["doc_id", "quality", "toxic"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "people": ["c_custkey", "email", "phone", "currency", "country", "land", "discount_rate", "created_date", "updated_at", "active_flag",
               "nothing", "city_region", "status_level", "remark_note"],
    "cards": ["txn_key", "amount", "auth_status", "channel", "fraud_flag", "authorization_date", "blank"],
}
# Written out, so that a wrong weight in the library does not pass unseen.
QUALITY_WEIGHTS = {
    "completeness": 0.20, "uniqueness": 0.15, "validity": 0.15, "conformity": 0.10, "consistency": 0.15,
    "business_rule_compliance": 0.10, "timeliness": 0.05, "integrity": 0.03, "accuracy": 0.02, "semantic_quality": 0.05,
}
CHART_WEIGHTS = {
    "domain_relevance": 0.30, "data_availability": 0.25, "metric_validity": 0.15, "dimension_cardinality": 0.10, "temporal_coverage": 0.10,
}
DIRTY = (
    "(SELECT event_id, ts, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type, "
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, props FROM events)"
)
PEOPLE_SOURCE = f"({PEOPLE.format(customer='customer')})"
CARDS_SOURCE = f"({CARDS.format(orders='orders')})"
TYPES = {
    "orders": ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"],
    "lineitem": ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double", "string", "string", "timestamp_ntz"],
    "documents": ["bigint", "string", "string", "string", "bigint"],
    "events": ["bigint", "timestamp_ntz", "bigint", "string", "double", "string"],
    "people": ["bigint", "string", "string", "string", "string", "string", "bigint", "string", "string", "string", "string", "string", "string", "string"],
}
TEXT_DATES = (
    "(SELECT strftime(o_orderdate, '%Y-%m-%d') AS iso_date, strftime(o_orderdate, '%m/%d/%Y') AS us_date, "
    "strftime(o_orderdate, '%d.%m.%Y') AS dotted_date, strftime(o_orderdate, '%Y%m%d') AS plain_date, "
    "strftime(o_orderdate, '%Y-%m') AS month_text, strftime(o_orderdate, '%m/%d/%Y') || ' 10:30' AS us_minute, "
    "strftime(o_orderdate, '%Y/%m/%d') || ' 10:00:00' AS slash_second, strftime(o_orderdate, '%Y-%m-%d') || 'T10:30Z' AS iso_minute, "
    "strftime(o_orderdate, '%d-%b-%Y') AS short_name, strftime(o_orderdate, '%B %-d, %Y') AS long_name, "
    "strftime(o_orderdate, '%m/%d/') || lpad(CAST(60 + o_orderkey % 20 AS VARCHAR), 2, '0') AS short_year, "
    "CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%d-%b-%Y') ELSE strftime(o_orderdate, '%B %-d, %Y') END AS two_ways, "
    "o_orderpriority AS no_date FROM orders)"
)


def geo(region: str = CLEAN_REGION) -> str:
    return (
        f"(SELECT c.c_custkey, c.c_name AS customer, n.n_name AS country, {region} AS region, c.c_acctbal AS balance "
        "FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"
    )


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def matches(expression: str, pattern: str) -> str:
    return f"regexp_matches({expression}, {text(pattern)})"


def _int_year(v: str) -> str:
    return f"regexp_full_match({v}, '[0-9]{{4}}') AND try_cast({v} AS INT) BETWEEN 1678 AND 2261"


def _parsed(v: str, regex: str, fmt: str) -> str:
    return f"regexp_full_match({v}, '{regex}') AND year(try_strptime({v}, '{fmt}')) BETWEEN 1678 AND 2261"


DATE_TESTS = [
    _parsed("val", r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d"),
    r"regexp_full_match(val, '\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d+)?') AND year(try_cast(val AS TIMESTAMP)) BETWEEN 1678 AND 2261",
    _parsed("val", r"\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}", "%m/%d/%Y %H:%M"),
    _parsed("val", r"\d{4}/\d{1,2}/\d{1,2} \d{2}:\d{2}:\d{2}", "%Y/%m/%d %H:%M:%S"),
    _parsed("val", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}Z", "%Y-%m-%dT%H:%MZ"),
    _parsed("val", r"\d{1,2}-[A-Z][a-z]{2}-\d{4}", "%d-%b-%Y"),
    _parsed("val", r"[A-Z][a-z]{2,8} \d{1,2}, \d{4}", "%B %d, %Y"),
    _parsed("val", r"\d{1,2}/\d{1,2}/\d{2}", "%m/%d/%y"),
    _parsed("val", r"\d{1,2}/\d{1,2}/\d{4}", "%m/%d/%Y"),
    _parsed("val", r"\d{1,2}/\d{1,2}/\d{4}", "%d/%m/%Y"),
    _parsed("val", r"\d{1,2}\.\d{1,2}\.\d{4}", "%d.%m.%Y"),
    _parsed("val", r"\d{8}", "%Y%m%d"),
    _parsed("val", r"\d{4}-\d{2}", "%Y-%m"),
    _int_year("val"),
]
NUMBER = r"[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)"
BOOLEAN = "(" + ", ".join(text(w) for w in fixed.BOOLEAN_WORDS) + ")"


def profile_ctes(source: str, columns: list[str]) -> str:
    cells = " UNION ALL ".join(
        f"SELECT {i} AS pos, {text(c)} AS name, CAST({c} AS VARCHAR) AS val FROM {source}" for i, c in enumerate(columns))
    patterns = ", ".join(
        f"count(*) FILTER (WHERE {matches('val', regex)}) AS pattern{i}"
        for i, (_, regex) in enumerate(fixed.SHAPE_PATTERNS))
    dates = ", ".join(f"count(*) FILTER (WHERE {test}) AS date{i}" for i, test in enumerate(DATE_TESTS))
    listed = ", ".join(
        f"CASE WHEN pattern{i} > non_null_count * 0.5 THEN {{'n': -pattern{i}, 'i': {i}, 'l': {text(label)}}} END"
        for i, (label, _) in enumerate(fixed.SHAPE_PATTERNS))
    best_date = "greatest(" + ", ".join(f"date{i}" for i in range(len(DATE_TESTS))) + ")"

    def codes(values):
        return "(" + ", ".join(text(v) for v in values) + ")"

    regex = dict(fixed.SHAPE_PATTERNS)
    return f"""
    cells AS ({cells}),
    typed_cells AS (
      SELECT *, CASE WHEN regexp_full_match(trim(val), '{NUMBER}') THEN try_cast(trim(val) AS DOUBLE) END AS num FROM cells
    ),
    counts AS (
      SELECT pos, any_value(name) AS physical_name, count(*) AS row_count, count(val) AS non_null_count,
             count(*) - count(val) AS null_count, count(DISTINCT val) AS distinct_count, count(num) AS num_count,
             min(num) AS num_min, max(num) AS num_max, avg(num) AS num_mean,
             CASE WHEN count(num) = 1 THEN 0.0 ELSE stddev_samp(num) END AS num_std,
             quantile_cont(num, 0.25) AS num_q25, quantile_cont(num, 0.5) AS num_q50, quantile_cont(num, 0.75) AS num_q75,
             min(length(val)) AS min_string_length, max(length(val)) AS max_string_length,
             avg(length(val)) AS avg_string_length,
             count(*) FILTER (WHERE lower(trim(val)) IN {BOOLEAN}) AS booleans, {patterns}, {dates}
      FROM typed_cells GROUP BY pos
    ),
    rated AS (
      SELECT *, null_count / row_count AS null_ratio,
             CASE WHEN non_null_count > 0 THEN distinct_count / non_null_count ELSE 0.0 END AS cardinality_ratio,
             greatest(non_null_count - distinct_count, 0) AS duplicate_count,
             CASE WHEN non_null_count > 0 THEN num_count / non_null_count ELSE 0.0 END AS numeric_parse_ratio,
             CASE WHEN non_null_count > 0 THEN booleans / non_null_count ELSE 0.0 END AS boolean_parse_ratio,
             CASE WHEN non_null_count > 0 THEN {best_date} / non_null_count ELSE 0.0 END AS datetime_parse_ratio,
             list_transform(list_sort(list_filter([{listed}], lambda e: e IS NOT NULL))[1:5], lambda e: e.l) AS patterns
      FROM counts
    ),
    value_counts AS (
      SELECT pos, any_value(name) AS physical_name, val, count(*) AS n,
             row_number() OVER (PARTITION BY pos ORDER BY count(*) DESC, val) AS rn,
             row_number() OVER (PARTITION BY pos ORDER BY val) AS vn
      FROM cells WHERE val IS NOT NULL GROUP BY pos, val
    ),
    representative AS (
      SELECT pos, avg(CASE WHEN {matches('val', regex['EMAIL'])} THEN 1 ELSE 0 END) AS emails,
             avg(CASE WHEN {matches('val', regex['PHONE'])} THEN 1 ELSE 0 END) AS phones,
             avg(CASE WHEN upper(val) IN {codes(fixed.CURRENCY_CODES)} THEN 1 ELSE 0 END) AS currencies,
             avg(CASE WHEN upper(val) IN {codes(fixed.COUNTRY_CODES_2)} THEN 1 ELSE 0 END) AS countries2,
             avg(CASE WHEN upper(val) IN {codes(fixed.COUNTRY_CODES_3)} THEN 1 ELSE 0 END) AS countries3,
             list(lower(val) ORDER BY rn) FILTER (WHERE rn <= 5) AS top_values
      FROM value_counts WHERE rn <= 10 GROUP BY pos
    ),
    samples AS (
      SELECT pos, bool_and(coalesce(try_cast(val AS DOUBLE) = floor(try_cast(val AS DOUBLE)), true)) AS whole_samples
      FROM value_counts WHERE vn <= 10 GROUP BY pos
    ),
    prof AS (
      SELECT r.*, {best_key('physical_name')} AS key,
             CASE WHEN numeric_parse_ratio > 0.5 THEN num_min END AS min_value,
             CASE WHEN numeric_parse_ratio > 0.5 THEN num_max END AS max_value,
             coalesce(emails, 0) AS emails, coalesce(phones, 0) AS phones, coalesce(currencies, 0) AS currencies,
             coalesce(countries2, 0) AS countries2, coalesce(countries3, 0) AS countries3, top_values,
             coalesce(whole_samples, true) AS whole_samples
      FROM rated r LEFT JOIN representative USING (pos) LEFT JOIN samples USING (pos)
    )"""


def best_key(name: str) -> str:
    folded = f"trim(regexp_replace(lower({name}), '[^a-z0-9]+', '_', 'g'), '_')"
    return f"CASE WHEN {folded} = '' THEN 'column' ELSE {folded} END"


def statistics(source: str, columns: list[str], types: list[str]) -> str:
    dtype = cases([(f"pos = {i}", text(t)) for i, t in enumerate(types)], "''")

    def numeric(value):
        return f"CASE WHEN numeric_parse_ratio > 0.5 THEN round({value}, 4) END"

    return f"""WITH {profile_ctes(source, columns)}
    SELECT physical_name, row_count, non_null_count, null_count, round(null_ratio, 6) AS null_ratio, distinct_count,
           round(cardinality_ratio, 6) AS cardinality_ratio, duplicate_count, {numeric('num_min')} AS min_value,
           {numeric('num_max')} AS max_value, {numeric('num_mean')} AS mean, {numeric('num_q50')} AS median,
           {numeric('num_std')} AS std_dev, {numeric('num_q25')} AS q25, {numeric('num_q50')} AS q50,
           {numeric('num_q75')} AS q75, min_string_length, max_string_length,
           round(avg_string_length, 4) AS avg_string_length, round(numeric_parse_ratio, 6) AS numeric_parse_ratio,
           round(boolean_parse_ratio, 6) AS boolean_parse_ratio, {dtype} AS dtype, coalesce(smallest, '') AS sample_values,
           coalesce(frequent, '') AS representative_values, round(datetime_parse_ratio, 6) AS datetime_parse_ratio,
           array_to_string(patterns, ', ') AS dominant_patterns,
           (CASE WHEN null_ratio > 0.5 THEN 1 ELSE 0 END + CASE WHEN cardinality_ratio > 0.98 AND non_null_count > 10 THEN 1 ELSE 0 END)::BIGINT AS warnings
    FROM rated LEFT JOIN (
      SELECT pos, string_agg(val, ' | ' ORDER BY vn) FILTER (WHERE vn <= 10) AS smallest,
             string_agg(val, ' | ' ORDER BY rn) FILTER (WHERE rn <= 10) AS frequent FROM value_counts GROUP BY pos) USING (pos)"""


def has(label: str) -> str:
    return f"list_contains(patterns, '{label}')"


def words(key: str, values) -> str:
    return matches(key, "|".join(values))


def cases(branches, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {otherwise} END"


def sub_type(sub_types, default: str) -> str:
    return cases([(words("key", w), text(n)) for n, w in sub_types], text(default))


def label_ctes(source: str, columns: list[str]) -> str:
    types = cases([
        ("non_null_count = 0", "'unknown'"),
        ("boolean_parse_ratio >= 0.95 AND distinct_count <= 3", "'boolean'"),
        ("numeric_parse_ratio >= 0.95 AND distinct_count <= 2 AND min_value >= 0 AND max_value <= 1", "'boolean'"),
        (f"datetime_parse_ratio >= 0.9 AND ({has('YYYY-MM-DD')} OR {has('DATE_SLASH')})", "'date'"),
        ("datetime_parse_ratio >= 0.9", "'datetime'"),
        (f"{has('EMAIL')} OR emails >= 0.8", "'email'"),
        (f"{has('PHONE')} OR phones >= 0.8", "'phone'"),
        (f"distinct_count <= 50 AND {has('THREE_LETTER_CODE')} AND currencies >= 0.7", "'currency_code'"),
        (f"distinct_count <= 250 AND ({has('TWO_LETTER_CODE')} AND countries2 >= 0.7 "
         f"OR {has('THREE_LETTER_CODE')} AND countries3 >= 0.7)", "'country_code'"),
        (f"numeric_parse_ratio >= 0.9 AND min_value >= 0 AND max_value <= 100 AND {words('key', fixed.PERCENTAGE_HINTS)}",
         "'percentage'"),
        (f"numeric_parse_ratio >= 0.9 AND ({has('INTEGER')} OR (NOT {has('DECIMAL_2DP')} AND min_value = floor(min_value) "
         "AND max_value = floor(max_value) AND whole_samples))", "'integer'"),
        ("numeric_parse_ratio >= 0.9", "'decimal'"),
        (f"(cardinality_ratio >= 0.98 AND non_null_count > 10) OR {has('UUID')}", "'identifier'"),
        ("(cardinality_ratio <= 0.05 AND distinct_count <= 50) OR (distinct_count <= 20 AND non_null_count >= 50)",
         "'categorical'"),
    ], "'text'")
    score = (
        "(CASE WHEN non_null_count > 0 AND cardinality_ratio >= 0.98 THEN 0.5::DOUBLE "
        "WHEN non_null_count > 0 AND cardinality_ratio >= 0.9 THEN 0.25::DOUBLE ELSE 0::DOUBLE END "
        "+ CASE WHEN null_ratio <= 0.01 THEN 0.1::DOUBLE WHEN null_ratio > 0.1 THEN -0.15::DOUBLE ELSE 0::DOUBLE END "
        "+ CASE WHEN duplicate_count = 0 AND non_null_count > 1 THEN 0.15::DOUBLE ELSE 0::DOUBLE END "
        f"+ CASE WHEN {has('UUID')} THEN 0.2::DOUBLE ELSE 0::DOUBLE END "
        "+ CASE WHEN refined_type = 'identifier' THEN 0.1::DOUBLE ELSE 0::DOUBLE END "
        "+ CASE WHEN regexp_matches(key, '(_id|_key|_uuid|_guid|_code|_number|_num|_no|_ref)$|^(id|key|uuid|guid|code|number)$') "
        "THEN 0.05::DOUBLE ELSE 0::DOUBLE END "
        "+ CASE WHEN cardinality_ratio < 0.5 AND non_null_count > 10 THEN -0.3::DOUBLE ELSE 0::DOUBLE END)"
    )
    numeric = "refined_type IN ('integer', 'decimal')"
    roles = [
        ("is_grain_key", "'identifier'", "identifier", 0.90),
        ("refined_type = 'date'", sub_type(fixed.TEMPORAL_SUB_TYPES, "date"), "temporal_dimension", 0.88),
        ("refined_type = 'datetime'", sub_type(fixed.TEMPORAL_SUB_TYPES, "datetime"), "temporal_dimension", 0.88),
        ("refined_type = 'boolean'", sub_type(fixed.FLAG_SUB_TYPES, "flag"), "flag", 0.85),
        ("refined_type = 'email'", "'email_address'", "dimension", 0.92),
        ("refined_type = 'phone'", "'phone_number'", "dimension", 0.88),
        ("refined_type = 'currency_code'", "'currency_code'", "dimension", 0.93),
        ("refined_type = 'country_code'", "'country_code'", "dimension", 0.91),
        ("refined_type = 'percentage'", "'percentage'", "metric", 0.85),
        (f"{numeric} AND {words('key', fixed.METRIC_WORDS)}", sub_type(fixed.METRIC_SUB_TYPES, "monetary_amount"), "metric", 0.85),
        (f"{numeric} AND cardinality_ratio <= 0.05 AND distinct_count <= 20", "'numeric_category'", "dimension", 0.70),
        (numeric, "'numeric_measure'", "metric", 0.65),
        (f"refined_type IN ('categorical', 'text') AND {words('key', fixed.DESCRIPTION_WORDS)}", "'description'", "text_field", 0.78),
        (f"refined_type = 'categorical' AND {words('key', fixed.STATUS_WORDS)}", sub_type(fixed.STATUS_SUB_TYPES, "status"), "dimension", 0.82),
        (f"refined_type = 'categorical' AND {words('key', fixed.GEO_WORDS)}", sub_type(fixed.GEO_SUB_TYPES, "geographic"), "dimension", 0.80),
        ("refined_type = 'categorical'", "'dimension'", "dimension", 0.70),
        (f"refined_type = 'text' AND {words('key', fixed.NAME_WORDS)}", "'name'", "dimension", 0.75),
        ("refined_type = 'text'", "'text'", "text_field", 0.50),
    ]
    return f"""{profile_ctes(source, columns)},
    typed AS (SELECT *, {types} AS refined_type FROM prof),
    scored AS (SELECT *, least(1, greatest(0, {score})) AS raw_score FROM typed),
    identified AS (SELECT *, round(raw_score, 3) AS identifier_score,
                          raw_score >= 0.6 AND cardinality_ratio >= 0.98 AS is_grain_key FROM scored),
    labelled AS (
      SELECT *, {cases([(c, s) for c, s, _, _ in roles], 'NULL')} AS semantic_type,
             {cases([(c, text(r)) for c, _, r, _ in roles], "'unknown'")} AS role,
             {cases([(c, f'{n}::DOUBLE') for c, _, _, n in roles], '0.3::DOUBLE')} AS confidence
      FROM identified
    )"""


def labels(name: str, source: str | None = None) -> str:
    cast = cases([(f"refined_type = '{t}'", f"'{c}'") for t, c in [
        ("integer", "bigint"), ("decimal", "double"), ("percentage", "double"), ("boolean", "boolean"), ("date", "date"),
        ("datetime", "timestamp")]], "'string'")
    return f"""WITH {label_ctes(source or name, COLUMNS[name])}
    SELECT physical_name, refined_type, {cast} AS suggested_cast, identifier_score, is_grain_key,
           semantic_type AS candidate_semantic_type, role AS candidate_role, confidence AS candidate_confidence,
           CASE WHEN confidence >= 0.8 THEN 'confirmed' ELSE 'unresolved' END AS decision,
           round(CASE WHEN confidence >= 0.8 THEN confidence * 0.9 ELSE confidence END, 4) AS schema_confidence
    FROM labelled"""


def variants(name: str) -> str:
    numeric = "numeric_parse_ratio >= 0.9"
    dated = "datetime_parse_ratio >= 0.9 AND numeric_parse_ratio < 0.9"
    types = [
        ("non_null_count = 0", "unknown", 0.0),
        ("boolean_parse_ratio >= 0.95 AND distinct_count <= 3", "boolean", 0.92),
        (f"{dated} AND ({has('YYYY-MM-DD')} OR {has('DATE_SLASH')} OR {has('MM/DD/YYYY')})", "date", 0.90),
        (dated, "datetime", 0.88),
        (has("EMAIL"), "email", 0.93), ("emails >= 0.8", "email", 0.88), (has("PHONE"), "phone", 0.88),
        (f"distinct_count <= 50 AND {has('THREE_LETTER_CODE')} AND currencies >= 0.7", "currency_code", 0.90),
        (f"distinct_count <= 250 AND {has('TWO_LETTER_CODE')} AND countries2 >= 0.7", "country_code", 0.89),
        (f"distinct_count <= 250 AND {has('THREE_LETTER_CODE')} AND countries3 >= 0.7", "country_code", 0.89),
        (f"{numeric} AND min_value >= 0 AND max_value <= 100 AND {words('key', fixed.PERCENTAGE_HINTS)}", "percentage", 0.85),
        (f"{numeric} AND {has('INTEGER')}", "integer", 0.85), (f"{numeric} AND {has('DECIMAL_2DP')}", "decimal", 0.85),
        (f"{numeric} AND min_value = floor(min_value) AND max_value = floor(max_value)", "integer", 0.78),
        (numeric, "decimal", 0.80),
        ("cardinality_ratio >= 0.98 AND non_null_count >= 10", "identifier", 0.85), (has("UUID"), "identifier", 0.92),
        ("cardinality_ratio <= 0.05 AND distinct_count <= 50", "categorical", 0.80),
        ("distinct_count <= 20 AND non_null_count >= 50", "categorical", 0.75),
    ]
    bounded = f"regexp_matches(key, '(^|_)({'|'.join(variant.METRIC_KEYWORDS)})(_|$)')"
    flags = cases([(matches("key", w), "'flag'" if w in ("flag", "is_", "has_") else f"'{w}_flag'")
                   for w in variant.FLAG_KEYWORDS], "'flag'")
    roles = [
        (f"is_grain_key AND NOT {bounded}", "'identifier'", "identifier", 0.90),
        ("refined_type IN ('date', 'datetime')", sub_type(variant.TEMPORAL_SUB_TYPES, "datetime"), "temporal_dimension", 0.88),
        ("refined_type = 'boolean'", flags, "flag", 0.85),
        (bounded, sub_type(variant.METRIC_SUB_TYPES, "numeric_measure"), "metric", 0.85),
        (words("key", variant.TEMPORAL_KEYWORDS), sub_type(variant.TEMPORAL_SUB_TYPES, "date"), "temporal_dimension", 0.75),
        ("regexp_matches(key, '(_at|_dt|_date|_time|_ts)$')", "'datetime'", "temporal_dimension", 0.72),
        (words("key", variant.TEXT_KEYWORDS), "'description'", "text_field", 0.78),
        (words("key", variant.DIMENSION_KEYWORDS), sub_type(variant.DIMENSION_SUB_TYPES, "dimension"), "dimension", 0.80),
        ("refined_type IN ('integer', 'decimal') AND cardinality_ratio > 0.05", "'numeric_measure'", "metric", 0.65),
        ("refined_type IN ('integer', 'decimal')", "'numeric_category'", "dimension", 0.65),
        ("refined_type = 'categorical'", "'dimension'", "dimension", 0.70),
        ("refined_type = 'text'", "'text'", "text_field", 0.50),
    ]
    return f"""WITH {label_ctes(name, COLUMNS[name])}
    SELECT physical_name, {cases([(c, text(t)) for c, t, _ in types], "'text'")} AS variant_type,
           {cases([(c, f'{n}::DOUBLE') for c, _, n in types], '0.6::DOUBLE')} AS type_confidence,
           {cases([(c, s) for c, s, _, _ in roles], 'NULL')} AS variant_semantic_type,
           {cases([(c, text(r)) for c, _, r, _ in roles], "'unknown'")} AS variant_role,
           {cases([(c, f'{n}::DOUBLE') for c, _, _, n in roles], '0.3::DOUBLE')} AS variant_confidence
    FROM labelled"""


def category_rows(domain: str, name_weight: float = 0.4, role_weight: float = 0.3) -> str:
    """(pos, category, weight, order) for every signal that hits."""
    rows = [
        f"SELECT pos, {text(c)} AS category, {name_weight} AS w, {i} AS o FROM labelled WHERE {words('key', w)}"
        for i, (c, w) in enumerate(fixed.CATEGORY_NAME_WORDS)
    ]
    hit = cases([(words("semantic_type", w), text(c)) for c, w in fixed.CATEGORY_SEMANTIC_TYPES], "NULL")
    rows.append(f"SELECT pos, {hit} AS category, 0.5 AS w, 20 AS o FROM labelled WHERE ({hit}) IS NOT NULL")
    rows.append(f"SELECT pos, 'Time Series Data', {role_weight}, 30 FROM labelled WHERE role = 'temporal_dimension'")
    rows.append(f"SELECT pos, 'Master Data', {role_weight}, 30 FROM labelled WHERE role = 'identifier'")
    if domain.lower() in fixed.CATEGORY_DOMAIN_BOOST:
        boost, strength = fixed.CATEGORY_DOMAIN_BOOST[domain.lower()]
        rows.append(f"SELECT pos, {text(boost)}, {0.2 if strength == 'strong' else 0.1}, 40 FROM labelled")
    rows.append("SELECT pos, 'Time Series Data', 0.4, 50 FROM labelled WHERE datetime_parse_ratio >= 0.9")
    return " UNION ALL ".join(rows)


def categories_ctes(name: str, domain: str, source: str | None = None, weights: tuple = (0.4, 0.3), limits: tuple = (0.5, 0.3, 3)) -> str:
    return f"""{label_ctes(source or name, COLUMNS[name])},
    signals AS ({category_rows(domain, *weights)}),
    summed AS (SELECT pos, category, sum(w::DOUBLE ORDER BY o) AS score, min(o) AS o FROM signals GROUP BY pos, category),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY round(score, 9) DESC, o) AS rn FROM summed),
    best AS (
      SELECT pos, max(category) FILTER (WHERE rn = 1) AS primary_category, max(score) FILTER (WHERE rn = 1) AS top,
             max(score) FILTER (WHERE rn = 2) AS second FROM ranked GROUP BY pos
    ),
    extra AS (
      SELECT pos, string_agg(category, ', ' ORDER BY rn) AS secondary_categories FROM (
        SELECT r.*, row_number() OVER (PARTITION BY r.pos ORDER BY rn) AS kept FROM ranked r JOIN best USING (pos)
        WHERE rn BETWEEN 2 AND 1000 AND score >= top * {limits[0]} - 1e-12 AND score >= {limits[1]} - 1e-12
      ) WHERE kept <= {limits[2]} GROUP BY pos
    ),
    classified AS (
      SELECT pos, physical_name, coalesce(primary_category, 'Operational Data') AS primary_category,
             coalesce(secondary_categories, '') AS secondary_categories,
             round(CASE WHEN top IS NULL THEN 0.5 WHEN second IS NOT NULL AND top - second > 0.3::DOUBLE THEN least(1, least(1, top) + 0.1::DOUBLE)
                        ELSE least(1, top) END, 3)::DOUBLE AS category_confidence
      FROM labelled LEFT JOIN best USING (pos) LEFT JOIN extra USING (pos)
    )"""


def categories(name: str, domain: str, *more) -> str:
    return f"""WITH {categories_ctes(name, domain, *more)}
    SELECT physical_name, primary_category, secondary_categories, category_confidence FROM classified"""


def category_variant(name: str, domain: str) -> str:
    strong, weak = variant.CATEGORY_BOOSTS[domain]
    rows = []
    for i, (c, keywords, hints) in enumerate(variant.CATEGORY_KEYWORDS):
        rows.append(f"SELECT pos, {text(c)} AS category, 0.4 AS w, {i} AS o FROM labelled WHERE {words('key', keywords)}")
        if hints:
            rows.append(f"SELECT pos, {text(c)}, 0.5, {i} FROM labelled WHERE {words('semantic_type', hints)}")
    at = {c: i for i, (c, _, _) in enumerate(variant.CATEGORY_KEYWORDS)}
    rows.append(f"SELECT pos, 'Time Series Data', 0.3, {at['Time Series Data']} FROM labelled WHERE role = 'temporal_dimension'")
    rows.append(f"SELECT pos, 'Master Data', 0.3, {at['Master Data']} FROM labelled WHERE role = 'identifier'")
    for i, c in enumerate(strong + weak):
        rows.append(f"SELECT pos, {text(c)}, {0.2 if c in strong else 0.1}, {20 + i} FROM labelled")
    rows.append("SELECT pos, 'Time Series Data', 0.4, 40 FROM labelled WHERE datetime_parse_ratio >= 0.9")
    return f"""WITH {label_ctes(name, COLUMNS[name])},
    signals AS ({' UNION ALL '.join(rows)}),
    summed AS (SELECT pos, category, sum(w::DOUBLE ORDER BY o) AS score, min(o) AS o FROM signals GROUP BY pos, category),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY round(score, 9) DESC, o) AS rn FROM summed),
    best AS (SELECT pos, max(category) FILTER (WHERE rn = 1) AS primary_category, max(score) FILTER (WHERE rn = 1) AS top
             FROM ranked GROUP BY pos),
    extra AS (SELECT pos, string_agg(category, ', ' ORDER BY rn) AS secondary_categories FROM ranked JOIN best USING (pos)
              WHERE rn BETWEEN 2 AND 4 AND score >= top * 0.5 - 1e-12 AND score >= 0.3 - 1e-12 GROUP BY pos)
    SELECT physical_name, primary_category, coalesce(secondary_categories, '') AS secondary_categories,
           round(least(1, top), 6)::DOUBLE AS category_confidence
    FROM labelled JOIN best USING (pos) LEFT JOIN extra USING (pos)"""


def domain_ctes(name: str, domain: str, source: str | None = None) -> str:
    secondary = DOMAINS[domain]["secondary_domains"]
    rows = []
    for i, (d, w) in enumerate(secondary.items()):
        keyword = words("key", w["keywords"])
        roles = " OR ".join(f"contains(semantic_type, {text(r)}) OR contains({text(r)}, semantic_type)" for r in w["semantic_roles"])
        values = words("v", w["keywords"])
        rows.append(
            f"SELECT {i} AS dp, {text(d)} AS domain_name, CASE WHEN {keyword} THEN 1.5 ELSE 0 END "
            f"+ CASE WHEN semantic_type IS NOT NULL AND ({roles}) THEN 2.0 ELSE 0 END "
            f"+ CASE WHEN len(list_filter(coalesce(top_values, []), lambda v: {values})) > 0 THEN 0.5 ELSE 0 END AS w FROM labelled")
    return f"""{label_ctes(source or name, COLUMNS[name])},
    evidence AS ({' UNION ALL '.join(rows)}),
    domain_scores AS (
      SELECT domain_name, dp, least(1.0, sum(w)::DOUBLE / greatest(count(*) * 4.0 * 0.15, 1.0))::DOUBLE AS score
      FROM evidence GROUP BY domain_name, dp
    ),
    ranked_domains AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, dp) AS rank FROM domain_scores)"""


def domain_scores(name: str, domain: str) -> str:
    return f"WITH {domain_ctes(name, domain)} SELECT domain_name, round(score, 6) AS score, rank FROM ranked_domains"


DOMAIN_DECISION = f"""WITH {domain_ctes('customer', 'Customer')},
top AS (SELECT * FROM ranked_domains WHERE rank = 1)
SELECT CASE WHEN score >= 0.75 THEN domain_name END AS domain_name, round(score, 6) AS confidence,
       CASE WHEN score >= 0.75 THEN 'classified' WHEN score >= 0.5 THEN 'needs_review' ELSE 'unresolved' END AS status,
       coalesce(CASE WHEN score >= 0.75 THEN '' ELSE (
         SELECT string_agg(r.domain_name, ', ' ORDER BY r.rank) FROM ranked_domains r
         WHERE r.rank <= 3 AND r.score > 0 AND r.score >= CASE WHEN top.score >= 0.5 THEN 0.5 ELSE 0 END) END, '') AS candidates
FROM top"""


def edge_sql(source: str, edges) -> str:
    parts = []
    for parent, child in edges:
        parts.append(f"""SELECT '{parent}' AS parent_column, '{child}' AS child_column, count(*) AS distinct_child_count,
          count(*) FILTER (WHERE parents > 0) AS mapped_child_count, count(*) FILTER (WHERE parents > 1) AS violating_child_count
          FROM (SELECT {child}, count(DISTINCT {parent}) AS parents FROM {source} WHERE {child} IS NOT NULL GROUP BY {child})""")
    return f"""(SELECT *, fd_consistency * mapping_coverage AS edge_confidence,
      CASE WHEN mapping_coverage < 0.9 THEN 'rejected' WHEN fd_consistency >= 0.98 THEN 'accepted'
           WHEN fd_consistency >= 0.9 THEN 'retained_with_warning' ELSE 'rejected' END AS status
      FROM (SELECT *, 1 - violating_child_count / distinct_child_count AS fd_consistency,
                   mapped_child_count / distinct_child_count AS mapping_coverage FROM ({' UNION ALL '.join(parts)})))"""


def edges(region: str) -> str:
    return f"""SELECT parent_column, child_column, distinct_child_count, mapped_child_count, violating_child_count,
      round(fd_consistency, 6) AS fd_consistency, round(mapping_coverage, 6) AS mapping_coverage,
      round(edge_confidence, 6) AS edge_confidence, status
      FROM {edge_sql(geo(region), [('region', 'country'), ('country', 'customer')])}"""


def chain(region: str) -> str:
    """Two edges: the longest run of edges not rejected, the first of equal length."""
    return f"""WITH e AS (SELECT *, CASE WHEN child_column = 'country' THEN 0 ELSE 1 END AS p
                         FROM {edge_sql(geo(region), [('region', 'country'), ('country', 'customer')])}),
    f AS (SELECT max(status) FILTER (WHERE p = 0) AS s0, max(status) FILTER (WHERE p = 1) AS s1,
                 max(edge_confidence) FILTER (WHERE p = 0) AS c0, max(edge_confidence) FILTER (WHERE p = 1) AS c1 FROM e)
    SELECT CASE WHEN (s0 <> 'rejected' AND s0 = 'retained_with_warning') OR (s1 = 'retained_with_warning' )
                THEN 'partial' WHEN s0 = 'rejected' AND s1 = 'rejected' THEN 'unresolved' ELSE 'accepted' END AS status,
           CASE WHEN s0 = 'rejected' AND s1 = 'rejected' THEN NULL ELSE 'geographic' END AS template_key,
           CASE WHEN s0 = 'rejected' AND s1 = 'rejected' THEN '' WHEN s0 = 'rejected' THEN 'country > customer'
                WHEN s1 = 'rejected' THEN 'region > country' ELSE 'region > country > customer' END AS levels,
           CAST((s0 <> 'rejected')::INT + (s1 <> 'rejected')::INT AS BIGINT) AS edge_count,
           round(CASE WHEN s0 = 'rejected' AND s1 = 'rejected' THEN 0.0 WHEN s0 = 'rejected' THEN c1 WHEN s1 = 'rejected' THEN c0
                      ELSE (c0 + c1) / 2 END, 6)::DOUBLE AS average_confidence,
           CAST((s0 = 'rejected')::INT + (s1 = 'rejected')::INT AS BIGINT) AS rejected_edge_count
    FROM f"""


# The customer columns hold country, region and a grain key; the segment
# template finds nothing.
TEMPLATES = f"""WITH {label_ctes(geo(), ['c_custkey', 'customer', 'country', 'region', 'balance'])},
concepts(t, template_key, priority, levels, p, concept) AS (VALUES
  (0, 'customer_geographic', 100, 4, 0, 'region'), (0, 'customer_geographic', 100, 4, 1, 'country'),
  (0, 'customer_geographic', 100, 4, 2, 'city'), (0, 'customer_geographic', 100, 4, 3, 'branch'),
  (1, 'customer_segment_tier', 80, 3, 0, 'segment'), (1, 'customer_segment_tier', 80, 3, 1, 'tier'),
  (1, 'customer_segment_tier', 80, 3, 2, 'sub_tier')),
pairs AS (
  SELECT c.*, l.pos, l.physical_name,
         CASE WHEN l.key = concept THEN 1 WHEN contains(l.key, concept) OR contains(concept, l.key) THEN 2
              WHEN contains(coalesce(l.semantic_type, ''), concept) THEN 3
              WHEN list_has_any(string_split(concept, '_'), string_split(l.key, '_')) THEN 4 END AS strategy
  FROM concepts c, labelled l WHERE NOT l.is_grain_key
),
firsts AS (SELECT *, row_number() OVER (PARTITION BY t, p ORDER BY strategy NULLS LAST, pos) AS rn FROM pairs),
found AS (SELECT t, template_key, priority, levels, p, concept, CASE WHEN strategy IS NOT NULL THEN physical_name END AS name
          FROM firsts WHERE rn = 1),
used AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY t, name ORDER BY p) = 1 THEN name END AS taken FROM found),
summed AS (
  SELECT t, template_key, priority, coalesce(string_agg(taken, ' > ' ORDER BY p) FILTER (WHERE taken IS NOT NULL), '') AS levels,
         coalesce(string_agg(concept, ', ' ORDER BY p) FILTER (WHERE taken IS NULL), '') AS missing,
         count(taken) / max(levels) AS match_ratio FROM used GROUP BY t, template_key, priority
)
SELECT template_key, CAST(priority AS BIGINT) AS priority, levels, missing, round(match_ratio, 6) AS match_ratio,
       row_number() OVER (ORDER BY match_ratio DESC, priority DESC, t) AS rank FROM summed"""

CONFLICTS = f"""WITH pairs AS (SELECT DISTINCT country, region FROM {geo(REJECTED_REGION)}),
bad AS (SELECT country, count(*) AS n, row_number() OVER (ORDER BY country) AS rn FROM pairs GROUP BY country HAVING count(*) > 1),
kept AS (SELECT p.*, n, row_number() OVER (PARTITION BY p.country ORDER BY region) AS prn
         FROM pairs p JOIN bad USING (country) WHERE bad.rn <= 5)
SELECT 'region' AS parent_column, 'country' AS child_column, country AS child_value,
       string_agg(region, ', ' ORDER BY region) AS parent_values, max(n) AS parent_count
FROM kept WHERE prn <= 5 GROUP BY country"""


def rule_row(key, kind, checked, passed, columns, score=None, failed="false") -> str:
    return (
        f"SELECT '{key}' AS rule_key, '{kind}' AS rule_type, CAST({checked} AS BIGINT) AS records_checked, "
        f"CAST({passed} AS BIGINT) AS pass_count, '{columns}' AS target_columns, {failed} AS failed FROM src")


def rules(source: str, rows: list[str]) -> str:
    return f"""WITH src AS (SELECT * FROM {source}), results AS ({' UNION ALL '.join(rows)})
    SELECT rule_key, rule_type, records_checked, pass_count, records_checked - pass_count AS fail_count,
           round(CASE WHEN failed THEN 0.0 WHEN records_checked = 0 THEN 1.0 ELSE pass_count / records_checked END, 6)::DOUBLE AS score,
           target_columns, failed FROM results"""


EVENT_ROWS = [
    rule_row("value_present", "non_null", "count(*)", "count(value)", "value"),
    rule_row("value_range", "numeric_range", "count(value)", "count(*) FILTER (WHERE value > 0 AND value <= 100)", "value"),
    rule_row("known_type", "allowed_values", "count(event_type)",
             "count(*) FILTER (WHERE event_type IN ('click', 'view', 'purchase'))", "event_type"),
    rule_row("json_props", "regex_match", "count(props)",
             "count(*) FILTER (WHERE regexp_matches(props, '^\\{\"k\": [0-9]{2}\\}'))", "props"),
    rule_row("user_unique", "expected_unique", "count(*)", "count(DISTINCT user_id)", "user_id"),
    rule_row("type_unique", "expected_unique", "count(*)", "count(DISTINCT event_type) + max((event_type IS NULL)::INT)", "event_type"),
    rule_row("purchase_value", "conditional_required", "count(*) FILTER (WHERE event_type = 'purchase')",
             "count(value) FILTER (WHERE event_type = 'purchase')", "event_type, value"),
]
ORDER_ROWS = [
    rule_row("keys_ordered", "column_comparison", "count(*)", "count(*) FILTER (WHERE o_orderkey >= o_custkey)", "o_orderkey, o_custkey"),
    rule_row("dates", "date_range", "count(o_orderdate)",
             "count(*) FILTER (WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31')", "o_orderdate"),
    rule_row("same", "cross_field_equality", "count(*)", "count(*) FILTER (WHERE o_orderkey = o_custkey)", "o_orderkey, o_custkey"),
    rule_row("different", "cross_field_inequality", "count(*)", "count(*) FILTER (WHERE o_orderkey <> o_custkey)", "o_orderkey, o_custkey"),
    rule_row("by_role", "numeric_range", "count(o_totalprice)", "count(*) FILTER (WHERE o_totalprice >= 0)", "o_totalprice"),
] + [rule_row(k, t, "0 * count(*)", "0", "", failed="true") for k, t in [
    ("no_column", "non_null"), ("no_pattern", "regex_match"), ("bad_operator", "column_comparison")]]

ORDER_LIST_ROWS = [
    rule_row("customer_in_credit", "allowed_values", "count(o_custkey)",
             "count(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0))", "o_custkey"),
    rule_row("customer_known", "allowed_values", "count(o_custkey)",
             "count(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM customer))", "o_custkey"),
    rule_row("customer_once", "expected_unique", "count(*)", "count(DISTINCT o_custkey)", "o_custkey"),
    rule_row("short_list", "allowed_values", "count(o_orderstatus)", "count(*) FILTER (WHERE o_orderstatus IN ('F', 'O'))", "o_orderstatus"),
    rule_row("price_listed", "allowed_values", "count(o_totalprice)",
             "count(*) FILTER (WHERE o_totalprice IN (SELECT o_totalprice FROM orders WHERE o_orderkey % 3 = 0))", "o_totalprice"),
    rule_row("no_list", "allowed_values", "0 * count(*)", "0", "", failed="true"),
    rule_row("no_list_column", "allowed_values", "0 * count(*)", "0", "", failed="true"),
]
TEXT_LIST_ROWS = [
    rule_row("text_listed", "allowed_values", "count(text)",
             "count(*) FILTER (WHERE text IN (SELECT text FROM documents WHERE lang = 'en'))", "text"),
    rule_row("text_once", "expected_unique", "count(*)", "count(DISTINCT text) + max((text IS NULL)::INT)", "text"),
    rule_row("source_listed", "allowed_values", "count(source)",
             "count(*) FILTER (WHERE source IN (SELECT source FROM documents WHERE lang = 'en'))", "source"),
]

REVIEW = """WITH s AS (
  SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'proposed' WHEN event_type = 'view' THEN 'approved'
         ELSE 'superseded' END AS status FROM events),
r AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'approve' ELSE 'reject' END AS action FROM orders),
j AS (SELECT s.id, s.status, r.action, s.status = 'proposed' AND r.action IS NOT NULL AS ok FROM s LEFT JOIN r USING (id))
SELECT CASE WHEN NOT ok THEN status WHEN action = 'approve' THEN 'approved' ELSE 'rejected' END AS status, count(*) AS rows,
       count(*) FILTER (WHERE ok AND action = 'approve') AS comments, count(*) FILTER (WHERE ok AND action = 'reject') AS reasons
FROM j GROUP BY 1
UNION ALL SELECT * FROM (SELECT 'INVALID_RULE_TRANSITION', count(*), 0, 0 FROM j WHERE action IS NOT NULL AND NOT ok HAVING count(*) > 0)
UNION ALL SELECT * FROM (SELECT 'RULE_SUGGESTION_NOT_FOUND', count(*), 0, 0 FROM r WHERE id NOT IN (SELECT id FROM s) HAVING count(*) > 0)"""


def quality_ctes() -> str:
    def over_rules(condition):
        return (f"SELECT sum(records_checked) AS a, sum(records_checked - pass_count) AS v FROM results WHERE {condition}")

    return f"""src AS (SELECT * FROM {DIRTY}), results AS ({' UNION ALL '.join(EVENT_ROWS)}),
    dims AS (
      SELECT 1 AS ord, 'completeness' AS dimension, 2 * count(*) AS a, 2 * count(*) - count(value) - count(event_type) AS v FROM src
      UNION ALL SELECT 2, 'uniqueness', 2 * count(*), 2 * count(*) - count(DISTINCT event_id) - count(DISTINCT user_id) FROM src
      UNION ALL SELECT 3, 'validity', a, v FROM ({over_rules("rule_type IN ('numeric_range', 'allowed_values', 'date_range')")})
      UNION ALL SELECT 4, 'conformity', a, v FROM ({over_rules("rule_type = 'regex_match'")})
      UNION ALL SELECT 5, 'consistency', a, v FROM ({over_rules("rule_type IN ('column_comparison')")})
      UNION ALL SELECT 6, 'business_rule_compliance', a, v FROM ({over_rules("records_checked > 0")})
      UNION ALL SELECT 7, 'timeliness', NULL, NULL UNION ALL SELECT 8, 'integrity', NULL, NULL
      UNION ALL SELECT 9, 'accuracy', NULL, NULL
    ),
    scored AS (SELECT *, 1 - v / a AS score, CASE WHEN a IS NULL THEN 'not_assessable' ELSE 'assessed' END AS status FROM dims)"""


QUALITY = f"""WITH {quality_ctes()}
SELECT dimension, round(score, 6) AS score, status, CAST(coalesce(a, 0) AS BIGINT) AS assessed_count,
       CAST(coalesce(v, 0) AS BIGINT) AS violation_count FROM scored"""
_WEIGHT = cases([(f"dimension = '{d}'", str(w)) for d, w in QUALITY_WEIGHTS.items()], "0")
OVERALL = f"""WITH {quality_ctes()},
total AS (SELECT sum(score * ({_WEIGHT})::DOUBLE) FILTER (WHERE score IS NOT NULL) / sum(({_WEIGHT})::DOUBLE) FILTER (WHERE score IS NOT NULL) AS s,
                 string_agg(dimension, ', ' ORDER BY ord) FILTER (WHERE score IS NOT NULL) AS assessed,
                 string_agg(dimension, ', ' ORDER BY ord) FILTER (WHERE score IS NULL) AS excluded FROM scored)
SELECT round(s, 4) AS overall_score, round(s * 100, 2) AS display_score, assessed, excluded FROM total"""

SEMANTIC = f"""WITH {categories_ctes('orders', 'Payments')},
{domain_ctes('orders', 'Payments').replace(label_ctes('orders', COLUMNS['orders']) + ',', '', 1)},
parts AS (
  SELECT 0.30 AS w, avg(CASE WHEN confidence >= 0.8 THEN confidence * 0.9 ELSE confidence END) AS c FROM labelled
  UNION ALL SELECT 0.25, avg(category_confidence) FROM classified
  UNION ALL SELECT 0.25, max(score) FILTER (WHERE score >= 0.75) FROM ranked_domains WHERE rank = 1
  UNION ALL SELECT 0.20, max(edge_confidence) FILTER (WHERE status <> 'rejected')
            FROM {edge_sql('orders', [('o_orderstatus', 'o_orderpriority')])}
)
SELECT 'semantic_quality' AS dimension, round(sum(w::DOUBLE * c) FILTER (WHERE c IS NOT NULL) / sum(w::DOUBLE) FILTER (WHERE c IS NOT NULL), 6) AS score,
       'assessed' AS status, count(c) AS assessed_count FROM parts"""

READINESS = f"""WITH {label_ctes('orders', COLUMNS['orders'])},
src AS (SELECT * FROM orders), results AS ({' UNION ALL '.join(ORDER_ROWS)}),
f AS (
  SELECT count(*) AS columns, max(row_count) AS rows, count(*) FILTER (WHERE role = 'metric') AS metrics,
         count(*) FILTER (WHERE role = 'dimension') AS dimensions, count(*) FILTER (WHERE role = 'temporal_dimension') AS temporals,
         count(*) FILTER (WHERE is_grain_key) AS keys,
         count(*) FILTER (WHERE cardinality_ratio > 0.9 AND NOT is_grain_key) AS wide,
         sum(null_ratio) / count(*) AS nulls, count(*) FILTER (WHERE non_null_count > 0) / count(*) AS sampled,
         3 / count(*) AS coverage,
         1 - sum(null_count) FILTER (WHERE physical_name IN ('o_orderkey', 'o_custkey')) / (2 * max(row_count)) AS comp,
         1 - max(duplicate_count) FILTER (WHERE physical_name = 'o_orderkey') / max(row_count) AS uniq,
         (SELECT sum(pass_count) / sum(records_checked) FROM results WHERE rule_type IN ('numeric_range', 'date_range')) AS valid,
         (SELECT sum(pass_count) / sum(records_checked) FROM results WHERE NOT failed
          AND rule_type IN ('column_comparison', 'cross_field_equality', 'cross_field_inequality')) AS cons
  FROM labelled
),
g AS (
  SELECT *, least(100, comp * 20 + valid * 15 + cons * 15 + CASE WHEN metrics >= 2 THEN 15 WHEN metrics >= 1 THEN 8 ELSE 0 END
           + CASE WHEN dimensions >= 3 THEN 15 WHEN dimensions >= 1 THEN 8 ELSE 0 END
           + CASE WHEN keys > 0 THEN 10 ELSE 0 END + CASE WHEN temporals > 0 THEN 10 ELSE 0 END) AS analytics,
         least(100, greatest(0, comp * 20 + cons * 15 + (columns - keys) / columns * 15 - CASE WHEN keys / columns > 0.3 THEN 10 ELSE 0 END
           + CASE WHEN rows >= 10000 THEN 15 WHEN rows >= 1000 THEN 10 WHEN rows >= 100 THEN 5 ELSE 0 END
           + CASE WHEN wide = 0 THEN 10 ELSE 5 END + uniq * 10)) AS ml,
         least(100, greatest(0, CASE WHEN coverage >= 0.8 THEN 25 WHEN coverage >= 0.5 THEN 15 ELSE coverage * 25 END
           + (1 - nulls) * 15 + 15 + sampled * 10 + least(15, coverage * 15))) AS llm
  FROM f
),
h AS (
  SELECT 'analytics_readiness' AS assessment_type, analytics AS s,
         concat_ws(', ', CASE WHEN comp >= 0.9 THEN 'HIGH_COMPLETENESS' END, CASE WHEN metrics >= 2 THEN 'USABLE_METRICS' END,
                   CASE WHEN dimensions >= 3 THEN 'USABLE_DIMENSIONS' END, CASE WHEN keys > 0 THEN 'IDENTIFIABLE_GRAIN' END,
                   CASE WHEN temporals > 0 THEN 'TEMPORAL_FIELDS_AVAILABLE' END) AS strengths,
         CASE WHEN keys = 0 THEN 'NO_GRAIN_IDENTIFIED' ELSE '' END AS blocking_issues,
         CASE WHEN temporals = 0 THEN 'ADD_TEMPORAL_FIELD' ELSE '' END AS recommendations FROM g
  UNION ALL SELECT 'ml_readiness', ml, concat_ws(', ', CASE WHEN comp >= 0.9 THEN 'HIGH_COMPLETENESS' END, CASE WHEN rows >= 10000 THEN 'ADEQUATE_ROW_COUNT' END),
         concat_ws(', ', CASE WHEN keys / columns > 0.3 THEN 'IDENTIFIER_CONTAMINATION' END, CASE WHEN rows < 100 THEN 'INSUFFICIENT_ROWS' END),
         concat_ws(', ', CASE WHEN keys > 0 AND keys / columns <= 0.3 THEN 'EXCLUDE_IDENTIFIER_FEATURES' END,
                   CASE WHEN wide > 0 THEN 'HIGH_CARDINALITY_FEATURES' END) FROM g
  UNION ALL SELECT 'llm_readiness', llm, CASE WHEN coverage >= 0.8 THEN 'HIGH_DESCRIPTION_COVERAGE' ELSE '' END,
         CASE WHEN coverage < 0.5 THEN 'LOW_DESCRIPTION_COVERAGE' ELSE '' END,
         CASE WHEN coverage < 0.5 THEN 'ADD_COLUMN_DESCRIPTIONS' ELSE '' END FROM g
  UNION ALL SELECT 'overall_ai_readiness', (analytics + ml + llm) / 3, '', '', '' FROM g
)
SELECT assessment_type, round(s, 2)::DOUBLE AS score,
       CASE WHEN s >= 80 THEN 'ready' WHEN s >= 60 THEN 'partially_ready' ELSE 'not_ready' END AS status,
       strengths, blocking_issues, recommendations FROM h"""


def top_groups(source: str, dimension: str, value: str) -> str:
    return f"""WITH g AS (SELECT CAST({dimension} AS VARCHAR) AS label, {value} AS raw FROM {source}
                         WHERE {dimension} IS NOT NULL GROUP BY 1),
    r AS (SELECT row_number() OVER (ORDER BY raw DESC, label) AS position, label, round(raw, 2)::DOUBLE AS value FROM g)
    SELECT * FROM r WHERE position <= 15"""


HISTOGRAM = """WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, least(20, greatest(5, count(*) // 10)) AS bins FROM orders),
slots AS (SELECT i AS bin, lo + (i - 1) * ((hi - lo) / bins) AS low,
                 CASE WHEN i = bins THEN hi ELSE lo + i * ((hi - lo) / bins) END AS high, bins FROM s, range(1, 21) t(i) WHERE i <= bins),
n AS (SELECT bin, count(o_totalprice) AS n FROM slots LEFT JOIN orders ON o_totalprice >= low
      AND (o_totalprice < high OR (bin = bins AND o_totalprice <= high)) GROUP BY bin)
SELECT bin AS position, printf('%.1f', low) || '-' || printf('%.1f', high) AS label, n::DOUBLE AS value FROM slots JOIN n USING (bin)"""

DATE_TEXTS = ["iso_date", "us_date", "dotted_date", "plain_date", "month_text", "us_minute", "slash_second", "iso_minute", "short_name",
              "long_name", "short_year", "two_ways", "no_date"]

CANDIDATES = f"""WITH {label_ctes('orders', COLUMNS['orders'])},
f AS (SELECT min_by(physical_name, pos) FILTER (WHERE role = 'metric') AS m, min_by(physical_name, pos) FILTER (WHERE role = 'dimension') AS d,
             min_by(distinct_count, pos) FILTER (WHERE role = 'dimension') AS dn,
             min_by(physical_name, pos) FILTER (WHERE role = 'temporal_dimension') AS t FROM labelled),
two AS (SELECT *, row_number() OVER (ORDER BY pos) AS dno FROM labelled WHERE role = 'dimension'),
p AS (SELECT min_by(physical_name, pos) FILTER (WHERE dno <= 2 AND distinct_count BETWEEN 2 AND 10) AS pie FROM two),
c AS (
  SELECT 1 AS o, m || '_over_time' AS chart_key, 'line' AS chart_type, m || ' Over Time' AS title, t AS dimension, m AS metric, 'sum' AS aggregation
  FROM f WHERE t IS NOT NULL AND m IS NOT NULL
  UNION ALL SELECT 2, m || '_by_' || d, 'bar', m || ' by ' || d, d, m, 'sum' FROM f WHERE d IS NOT NULL AND m IS NOT NULL AND dn <= 30
  UNION ALL SELECT 3, pie || '_distribution', 'pie', pie || ' Distribution', pie, NULL, 'count' FROM p WHERE pie IS NOT NULL
  UNION ALL SELECT 4, m || '_kpi', 'kpi', 'Total ' || m, NULL, m, 'sum' FROM f WHERE m IS NOT NULL
),
kept AS (SELECT *, row_number() OVER (ORDER BY o) AS rank FROM c)"""

VALIDATE = f"""WITH {profile_ctes('lineitem', COLUMNS['lineitem'])}
SELECT 'by_' || physical_name AS chart_key, physical_name AS dimension, CASE WHEN distinct_count > 30 THEN 1 ELSE 0 END::BIGINT AS warnings
FROM rated WHERE pos > 0"""


def cube(source: str, levels: list[str], metric: str) -> str:
    """Each depth grouped on its own and joined to its parents."""
    parts = []
    for depth, level in enumerate(levels):
        above = levels[:depth]
        path = " || ' > ' || ".join(f"CAST({c} AS VARCHAR)" for c in above) or "''"
        order = ", ".join(f"CAST({c} AS VARCHAR)" for c in above) or "1"
        keys = ", ".join(above)
        not_null = " AND ".join(f"{c} IS NOT NULL" for c in above) or "true"
        parents = (
            f"SELECT {path} AS path, count(*) AS record_count, row_number() OVER (ORDER BY {order}) AS rn "
            f"FROM {source} WHERE {not_null} {'GROUP BY ' + keys if above else ''}")
        parts.append(f"""SELECT {depth} AS level_depth, '{level}' AS level_column, path, label, round(total, 2)::DOUBLE AS value, n AS count, record_count
          FROM (SELECT c.*, record_count, row_number() OVER (PARTITION BY path ORDER BY label) AS ln
                FROM (SELECT {path} AS path, CAST({level} AS VARCHAR) AS label, count({metric}) AS n, sum({metric}) AS total
                      FROM {source} WHERE {not_null} AND {level} IS NOT NULL GROUP BY {', '.join(above + [level])}
                      HAVING count({metric}) >= 5) c
                JOIN (SELECT * FROM ({parents}) WHERE rn <= 50 AND (record_count >= 5 OR {str(depth == 0).lower()})) p USING (path))
          WHERE ln <= 100""")
    return f"SELECT CAST(level_depth AS BIGINT) AS level_depth, * EXCLUDE (level_depth) FROM ({' UNION ALL '.join(parts)})"


def patterns(source: str, column: str, pairs, comparison: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{label}' AS pattern, count(*) FILTER (WHERE {matches('v', regex)}) AS matches, count(v) AS n FROM src"
        for label, regex in pairs)
    return f"""WITH src AS (SELECT CAST({column} AS VARCHAR) AS v FROM {source}), m AS ({rows})
    SELECT pattern, matches, round(matches / n, 6) AS share, matches / n {comparison} 0.5 AS dominant FROM m"""


def _volume(name: str) -> str:
    cells = " + ".join(f"strlen(CAST({c} AS VARCHAR))" for c in COLUMNS[name])
    keys = ", ".join(COLUMNS[name])
    return f"""SELECT count(*) AS row_count, CAST({len(COLUMNS[name])} AS BIGINT) AS column_count,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {name})) AS duplicate_row_count,
      CAST(sum({cells}) AS BIGINT) AS data_bytes, '{keys}' AS normalized_keys FROM {name}"""


NAMES = f"""names AS (SELECT p_brand AS dataset, CAST(p_partkey AS INT) AS pos, ' ' || upper(p_name) || '--' AS name FROM part),
keyed AS (SELECT *, {best_key('name')} AS k FROM names)"""

_SIGNALS = [
    ("high_cardinality", "non_null_count > 0 AND cardinality_ratio >= 0.98", "cardinality_ratio"),
    ("moderate_cardinality", "non_null_count > 0 AND cardinality_ratio < 0.98 AND cardinality_ratio >= 0.9", "cardinality_ratio"),
    ("low_null_ratio", "null_ratio <= 0.01", "null_ratio"), ("high_null_ratio_penalty", "null_ratio > 0.1", "null_ratio"),
    ("zero_duplicates", "duplicate_count = 0 AND non_null_count > 1", "NULL"), ("uuid_pattern", has("UUID"), "NULL"),
    ("refined_type_identifier", "refined_type = 'identifier'", "NULL"),
    ("name_hint", "regexp_matches(key, '(_id|_key|_uuid|_guid|_code|_number|_num|_no|_ref)$|^(id|key|uuid|guid|code|number)$')", "NULL"),
    ("low_cardinality_disqualifies", "cardinality_ratio < 0.5 AND non_null_count > 10", "cardinality_ratio"),
]
EVIDENCE = f"WITH {label_ctes(PEOPLE_SOURCE, COLUMNS['people'])} " + " UNION ALL ".join(
    f"SELECT physical_name, '{name}' AS signal, round(CAST({value} AS DOUBLE), 4) AS value FROM labelled WHERE {condition}" for name, condition, value in _SIGNALS)

DECISIONS = f"""WITH {label_ctes('orders', COLUMNS['orders'])}
SELECT physical_name, CASE pos % 3 WHEN 0 THEN 'overridden' WHEN 1 THEN 'unresolved' ELSE CASE WHEN confidence >= 0.8 THEN 'confirmed' ELSE 'unresolved' END END AS decision,
       CASE WHEN pos = 0 THEN 'order_number' ELSE semantic_type END AS confirmed_semantic_type, CASE WHEN pos = 3 THEN 'dimension' ELSE role END AS confirmed_role,
       round(CASE WHEN pos % 3 < 2 THEN 0.5 WHEN confidence >= 0.8 THEN confidence * 0.9 ELSE confidence END, 4)::DOUBLE AS schema_confidence FROM labelled"""
DESCRIBED = f"""WITH {label_ctes('orders', COLUMNS['orders'])}
SELECT physical_name, CASE physical_name WHEN 'o_orderkey' THEN 'key' WHEN 'o_totalprice' THEN 'sum of the order' END AS description,
       CASE physical_name WHEN 'o_orderkey' THEN true WHEN 'o_totalprice' THEN false END AS mandatory,
       CASE physical_name WHEN 'o_orderkey' THEN true WHEN 'o_totalprice' THEN false END AS expected_unique, refined_type FROM labelled"""
CARDS_DOMAIN = f"""WITH {domain_ctes('cards', 'Payments', CARDS_SOURCE)}, top AS (SELECT * FROM ranked_domains WHERE rank = 1)
SELECT r.domain_name, round(r.score, 6) AS score, r.rank,
       CASE WHEN top.score >= 0.75 THEN 'classified' WHEN top.score >= 0.5 THEN 'needs_review' ELSE 'unresolved' END AS decision,
       coalesce(CASE WHEN top.score >= 0.75 THEN '' ELSE (
         SELECT string_agg(x.domain_name, ', ' ORDER BY x.rank) FROM ranked_domains x
         WHERE x.rank <= 3 AND x.score > 0 AND x.score >= CASE WHEN top.score >= 0.5 THEN 0.5 ELSE 0 END) END, '') AS candidates
FROM ranked_domains r, top"""
UNRESOLVED = f"""SELECT CASE WHEN status = 'rejected' THEN 'unresolved' ELSE 'accepted' END AS status, NULL::VARCHAR AS template_key, 0::BIGINT AS levels,
       0::BIGINT AS edge_count, 1::BIGINT AS warnings FROM {edge_sql('orders', [('o_orderstatus', 'o_orderpriority')])}"""
BUILT = f"""WITH e AS (SELECT * FROM {edge_sql(geo(WARNING_REGION), [('region', 'country')])}), c AS ({CONFLICTS.replace(geo(REJECTED_REGION), geo(WARNING_REGION))})
SELECT 'chain' AS part, CASE status WHEN 'rejected' THEN 'unresolved' WHEN 'retained_with_warning' THEN 'partial' ELSE 'accepted' END AS name,
       'region > country' AS value, 1::BIGINT AS n FROM e
UNION ALL SELECT 'edge', parent_column || ' > ' || child_column, status, violating_child_count FROM e
UNION ALL SELECT 'conflict', child_value, parent_values, parent_count FROM c"""
LOADED = f"""WITH src AS (SELECT * FROM {CARDS_SOURCE})
SELECT 'settlement_after_authorization' AS rule_key, 'column_comparison' AS rule_type, 0::BIGINT AS records_checked, 0::BIGINT AS pass_count,
       0.0::DOUBLE AS score, '' AS target_columns, true AS failed
UNION ALL SELECT 'amount_positive', 'numeric_range', count(amount), count(*) FILTER (WHERE amount > 0),
       round(count(*) FILTER (WHERE amount > 0) / count(amount), 6)::DOUBLE, 'amount', false FROM src
UNION ALL SELECT 'blank', 'regex_match', count(blank), 0::BIGINT, 1.0::DOUBLE, 'blank', false FROM src
UNION ALL SELECT 'request_rule_1', 'allowed_values', count(auth_status), count(*) FILTER (WHERE auth_status IN ('F', 'O')),
       round(count(*) FILTER (WHERE auth_status IN ('F', 'O')) / count(auth_status), 6)::DOUBLE, 'auth_status', false FROM src"""
_FACTS = f"""WITH {label_ctes('orders', COLUMNS['orders'])}, f AS (
  SELECT count(*) AS columns, max(row_count) AS rows, count(*) FILTER (WHERE role = 'metric') AS metrics,
         count(*) FILTER (WHERE role = 'dimension') AS dimensions, count(*) FILTER (WHERE role = 'temporal_dimension') AS temporals,
         count(*) FILTER (WHERE is_grain_key) AS keys, count(*) FILTER (WHERE cardinality_ratio > 0.9 AND NOT is_grain_key) AS wide, 3 / count(*) AS coverage,
         1 - sum(null_count) FILTER (WHERE physical_name IN ('o_orderkey', 'o_custkey')) / (2 * max(row_count)) AS comp FROM labelled)"""
_NOTES = [
    ("analytics_readiness", "strengths", "HIGH_COMPLETENESS", "comp >= 0.9", "comp"), ("analytics_readiness", "strengths", "USABLE_METRICS", "metrics >= 2", "metrics"),
    ("analytics_readiness", "strengths", "USABLE_DIMENSIONS", "dimensions >= 3", "dimensions"), ("analytics_readiness", "strengths", "IDENTIFIABLE_GRAIN", "keys > 0", "keys"),
    ("analytics_readiness", "strengths", "TEMPORAL_FIELDS_AVAILABLE", "temporals > 0", "temporals"),
    ("analytics_readiness", "blocking_issues", "NO_GRAIN_IDENTIFIED", "keys = 0", "NULL"), ("analytics_readiness", "recommendations", "ADD_TEMPORAL_FIELD", "temporals = 0", "NULL"),
    ("ml_readiness", "strengths", "HIGH_COMPLETENESS", "comp >= 0.9", "comp"), ("ml_readiness", "strengths", "ADEQUATE_ROW_COUNT", "rows >= 10000", "rows"),
    ("ml_readiness", "blocking_issues", "IDENTIFIER_CONTAMINATION", "keys / columns > 0.3", "round(keys / columns, 3)"),
    ("ml_readiness", "blocking_issues", "INSUFFICIENT_ROWS", "rows < 100", "rows"),
    ("ml_readiness", "recommendations", "EXCLUDE_IDENTIFIER_FEATURES", "keys > 0 AND keys / columns <= 0.3", "NULL"),
    ("ml_readiness", "recommendations", "HIGH_CARDINALITY_FEATURES", "wide > 0", "wide"),
    ("llm_readiness", "strengths", "HIGH_DESCRIPTION_COVERAGE", "coverage >= 0.8", "round(coverage, 3)"),
    ("llm_readiness", "blocking_issues", "LOW_DESCRIPTION_COVERAGE", "coverage < 0.5", "round(coverage, 3)"),
    ("llm_readiness", "recommendations", "ADD_COLUMN_DESCRIPTIONS", "coverage < 0.5", "NULL"),
]
NOTES = f"{_FACTS} " + " UNION ALL ".join(
    f"SELECT '{a}' AS assessment_type, '{k}' AS kind, '{c}' AS code, round(CAST({v} AS DOUBLE), 6) AS value FROM f WHERE {w}" for a, k, c, w, v in _NOTES)
DISPATCH = f"""SELECT 'donut' AS chart_key, * FROM ({top_groups('orders', 'o_orderstatus', 'count(*)')})
UNION ALL SELECT 'stacked', * FROM ({top_groups('orders', 'o_orderpriority', 'sum(o_totalprice)')})
UNION ALL SELECT 'line', position, label, value FROM (SELECT row_number() OVER (ORDER BY label) AS position, label, n::DOUBLE AS value
  FROM (SELECT strftime(o_orderdate, '%Y-%m') AS label, count(*) AS n FROM orders GROUP BY 1)) WHERE position <= 100
UNION ALL SELECT 'mean', 1::BIGINT, 'o_totalprice', round(avg(o_totalprice), 2) FROM orders"""
QUALITY_CHART = f"""WITH {quality_ctes()} SELECT row_number() OVER (ORDER BY ord) AS position, dimension AS label, round(score * 100, 1)::DOUBLE AS value
FROM scored WHERE score IS NOT NULL"""
# Two roles at most: the second takes the best column that the first did not.
CHART_TEMPLATES = f"""WITH {label_ctes(CARDS_SOURCE, COLUMNS['cards'])},
roles(t, r, role) AS (VALUES (0, 0, 'temporal_dimension'), (0, 1, 'transaction_identifier'), (1, 0, 'temporal_dimension'), (1, 1, 'monetary_amount'),
  (2, 0, 'status_dimension'), (3, 0, 'decline_reason'), (4, 0, 'channel_dimension'), (4, 1, 'fraud_flag')),
fits AS (
  SELECT * FROM (SELECT t, r, pos, physical_name AS name, numeric_parse_ratio > 0.5 AS number, CASE WHEN coalesce(semantic_type, '') = x.role THEN 1
    WHEN l.role = x.role THEN 2 WHEN key = x.role THEN 3
    WHEN contains(coalesce(semantic_type, ''), x.role) OR (contains(x.role, coalesce(semantic_type, '')) AND coalesce(semantic_type, '') <> '') THEN 4
    WHEN contains(key, x.role) THEN 5 END AS fit FROM roles x, labelled l) WHERE fit IS NOT NULL),
a AS (SELECT * FROM fits WHERE r = 0 QUALIFY row_number() OVER (PARTITION BY t ORDER BY fit, pos) = 1),
b AS (SELECT fits.* FROM fits JOIN a ON fits.t = a.t AND fits.name <> a.name WHERE fits.r = 1 QUALIFY row_number() OVER (PARTITION BY fits.t ORDER BY fits.fit, fits.pos) = 1),
specs(t, chart_key, chart_type, aggregation, title, n) AS (VALUES
  (0, 'transaction_volume_over_time', 'line', 'count', 'Transaction Volume Over Time', 2), (1, 'transaction_value_over_time', 'line', 'sum', 'Transaction Value Over Time', 2),
  (2, 'payment_outcome_distribution', 'pie', 'count', 'Payment Outcome Distribution', 1), (3, 'authorization_decline_reasons', 'bar', 'count', 'Authorization Decline Reasons', 1),
  (4, 'fraud_rate_by_channel', 'bar', 'mean', 'Fraud Rate by Channel', 2)),
whole AS (
  SELECT s.*, a.name AS first, b.name AS second,
         CASE WHEN aggregation IN ('sum', 'mean') THEN CASE WHEN b.number THEN b.name WHEN a.number THEN a.name END END AS metric
  FROM specs s JOIN a USING (t) LEFT JOIN b USING (t) WHERE n = 1 OR b.name IS NOT NULL)
SELECT chart_key, 'business' AS category, chart_type, title, CASE WHEN first IS DISTINCT FROM metric THEN first ELSE second END AS dimension, metric, aggregation FROM whole
UNION ALL SELECT * FROM (VALUES ('missing_values_by_column', 'profiling', 'bar', 'Missing Values by Column', NULL, NULL, 'value'),
  ('quality_score_by_dimension', 'quality', 'bar', 'Quality Score by Dimension', NULL, NULL, 'value'),
  ('rule_violations_by_rule', 'quality', 'bar', 'Rule Violations by Rule', NULL, NULL, 'value'))
UNION ALL SELECT physical_name || '_numeric_distribution', 'profiling', 'histogram', physical_name || ' Distribution', NULL, physical_name, 'value'
  FROM labelled WHERE role = 'metric'"""
GUARDS = """SELECT * FROM (VALUES ('columns', 'DATASET_COLUMN_LIMIT_EXCEEDED'), ('no rows', 'NO_DATA_ROWS'), ('no columns', 'EMPTY_DATASET'),
  ('size', 'FILE_SIZE_EXCEEDED'), ('format', 'UNSUPPORTED_FILE_TYPE'), ('domain', 'UNSUPPORTED_DOMAIN'), ('none', 'accepted')) AS g(guard, code)
UNION ALL SELECT 'rows', CASE WHEN count(*) > 100 THEN 'DATASET_ROW_LIMIT_EXCEEDED' ELSE 'accepted' END FROM orders"""
CSV_ROWS = """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN NULL
  ELSE c_mktsegment || ', "' || CAST(c_nationkey AS VARCHAR) || '"' END AS segment, CAST(c_acctbal AS VARCHAR) AS c_acctbal FROM customer"""
READBACK = """SELECT * FROM (VALUES ('dataset_profiles', 1::BIGINT), ('column_profiles', 6), ('column_categories', 6), ('quality_assessments', 10), ('overall_quality', 1),
  ('readiness_assessments', 4), ('secondary_domains', 1), ('columns', 6), ('completed', 1)) AS t(name, n)
UNION ALL SELECT 'rows', count(*) FROM orders UNION ALL SELECT 'suggestions', count(*) FROM orders WHERE o_orderkey % 3 = 0"""
# The sketches' columns say whether their errors are as stated.
MERGED = f"""WITH {profile_ctes('lineitem', COLUMNS['lineitem'])}
SELECT physical_name, row_count, null_count, num_count, round(num_min, 4) AS min_value, round(num_max, 4) AS max_value, round(num_mean, 4) AS mean,
       round(num_std, 3) AS std_dev, max_string_length, round(avg_string_length, 4) AS avg_string_length, true AS distinct_within, true AS quantiles_within FROM rated"""
CATALOGUE = " UNION ALL ".join(f"""SELECT '{name}' AS dataset, * FROM (WITH {label_ctes(name, COLUMNS[name])},
  listed AS (SELECT pos, string_agg(val, ' | ' ORDER BY vn) AS sample_values FROM value_counts WHERE vn <= 10 GROUP BY pos)
  SELECT physical_name, row_count, distinct_count, refined_type, identifier_score, is_grain_key, semantic_type AS candidate_semantic_type, role AS candidate_role,
         sample_values FROM labelled LEFT JOIN listed USING (pos))""" for name in ("customer", "orders", "lineitem", "part", "supplier", "nation"))


VALUE_LIST = """WITH {ctes} SELECT physical_name, {rank} AS position, val AS value, n AS occurrences FROM value_counts WHERE {rank} <= 10"""
DETECTOR = [(label, fixed.DETECTOR_PATTERNS.get(label, regex)) for label, regex in fixed.SHAPE_PATTERNS]
DATE_COMPARE = rules(
    "(SELECT strftime(o_orderdate, '%Y-%m-%d') AS ordered, strftime(o_orderdate + to_days(CAST(o_orderkey % 3 - 1 AS INT)), '%Y-%m-%d') AS shipped FROM orders)",
    [rule_row("shipped_after", "column_comparison", "count(*)", "count(*) FILTER (WHERE shipped > ordered)", "shipped, ordered")])


def all_oracles() -> dict[str, str]:
    w = CHART_WEIGHTS
    return {
        "column_profile_orders": statistics("orders", COLUMNS["orders"], TYPES["orders"]),
        "column_profile_lineitem": statistics("lineitem", COLUMNS["lineitem"], TYPES["lineitem"]),
        "column_profile_documents": statistics("documents", COLUMNS["documents"], TYPES["documents"]),
        "column_profile_dirty_events": statistics(DIRTY, COLUMNS["events"], TYPES["events"]),
        "column_profile_people": statistics(PEOPLE_SOURCE, COLUMNS["people"], TYPES["people"]),
        "dataset_profile_lineitem": _volume("lineitem"),
        "dataset_profile_documents": _volume("documents"),
        "duplicate_rows_events": "SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT event_type, "
                                 "user_id FROM events)) AS duplicate_row_count FROM events",
        "normalize_names": f"WITH {NAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, k ORDER BY pos) - 1 AS n FROM keyed) "
                           "SELECT dataset, CAST(pos AS BIGINT) AS pos, name, CASE WHEN n > 0 THEN k || '_' || n ELSE k END AS normalized_key FROM r",
        "duplicate_keys": f"WITH {NAMES} SELECT dataset, k AS base_key, count(*) AS columns FROM keyed GROUP BY dataset, k HAVING count(*) > 1",
        "top_values_part": VALUE_LIST.format(ctes=profile_ctes("part", COLUMNS["part"]), rank="rn"),
        "sample_values_part": VALUE_LIST.format(ctes=profile_ctes("part", COLUMNS["part"]), rank="vn"),
        "datetime_ratio_text_dates": f"WITH {profile_ctes(TEXT_DATES, DATE_TEXTS)} SELECT physical_name, "
                                     "round(datetime_parse_ratio, 6) AS datetime_parse_ratio, "
                                     "array_to_string(patterns, ', ') AS dominant_patterns FROM rated",
        "pattern_counts_customer": patterns("customer", "c_acctbal", fixed.SHAPE_PATTERNS, ">"),
        "pattern_detector_documents": patterns("documents", "text", DETECTOR, ">="),
        "custom_pattern_supplier": "SELECT round(avg(CASE WHEN regexp_matches(s_name, '^(Supplier#[0-9]+1$)') THEN 1 ELSE 0 END), 6) "
                                   "AS match_ratio FROM supplier",
        "profile_warnings": f"WITH {profile_ctes(DIRTY, COLUMNS['events'])} SELECT physical_name, "
                            "(CASE WHEN null_ratio > 0.5 THEN 1 ELSE 0 END + CASE WHEN cardinality_ratio > 0.98 AND non_null_count > 10 "
                            "THEN 1 ELSE 0 END)::BIGINT AS warnings, array_to_string(patterns, ', ') AS patterns FROM rated",
        "labels_orders": labels("orders"),
        "labels_events": labels("events"),
        "labels_customer": labels("customer"),
        "labels_labels": labels("labels"),
        "label_variants_orders": variants("orders"),
        "label_variants_part": variants("part"),
        "grain_customer": f"WITH {label_ctes('customer', COLUMNS['customer'])} SELECT string_agg(physical_name, ' + ' ORDER BY pos) "
                          "AS inferred_grain FROM labelled WHERE is_grain_key",
        "role_map_lineitem": f"WITH {label_ctes('lineitem', COLUMNS['lineitem'])} SELECT semantic_type AS candidate_semantic_type, "
                             "max_by(physical_name, pos) AS physical_name FROM labelled WHERE semantic_type IS NOT NULL GROUP BY 1",
        "categories_customer": categories("customer", "Customer"),
        "categories_orders": categories("orders", "Payments"),
        "category_variant_orders": category_variant("orders", "Finance"),
        "domain_scores_orders": domain_scores("orders", "Payments"),
        "domain_decision_customer": DOMAIN_DECISION,
        "template_match_geo": TEMPLATES,
        "fd_edges_clean": edges(CLEAN_REGION),
        "fd_edges_warning": edges(WARNING_REGION),
        "fd_edges_rejected": edges(REJECTED_REGION),
        "fd_conflicts": CONFLICTS,
        "hierarchy_chain_clean": chain(CLEAN_REGION),
        "hierarchy_chain_rejected": chain(REJECTED_REGION),
        "rules_events": rules(DIRTY, EVENT_ROWS),
        "rules_value_lists_orders": rules("orders", ORDER_LIST_ROWS),
        "rules_value_lists_documents": rules("documents", TEXT_LIST_ROWS),
        "rules_orders": rules("orders", ORDER_ROWS),
        "rule_date_comparison": DATE_COMPARE,
        "rule_review": REVIEW,
        "quality_dimensions": QUALITY,
        "quality_overall": OVERALL,
        "quality_semantic": SEMANTIC,
        "readiness_orders": READINESS,
        "chart_bar_sum": top_groups("lineitem", "l_suppkey", "sum(l_extendedprice)"),
        "chart_bar_mean": top_groups("orders", "o_orderpriority", "avg(o_totalprice)"),
        "chart_value_counts": top_groups("part", "p_brand", "count(*)"),
        "chart_line_month": "WITH g AS (SELECT strftime(o_orderdate, '%Y-%m') AS label, sum(o_totalprice) AS raw FROM orders GROUP BY 1), "
                            "r AS (SELECT row_number() OVER (ORDER BY label) AS position, label, round(raw, 2) AS value FROM g) "
                            "SELECT * FROM r WHERE position <= 100",
        "chart_kpi": "SELECT 1::BIGINT AS position, 'l_extendedprice' AS label, round(sum(l_extendedprice), 2) AS value FROM lineitem",
        "chart_histogram": HISTOGRAM,
        "chart_missing_values": f"WITH {profile_ctes(DIRTY, COLUMNS['events'])} SELECT row_number() OVER (ORDER BY null_ratio DESC, pos) "
                                "AS position, physical_name AS label, round(null_ratio * 100, 1) AS value FROM rated WHERE null_ratio > 0",
        "chart_rule_violations": f"WITH r AS ({rules(DIRTY, EVENT_ROWS)}) SELECT row_number() OVER (ORDER BY fail_count DESC, rule_key) "
                                 "AS position, rule_key AS label, fail_count::DOUBLE AS value FROM r",
        "chart_candidates": f"{CANDIDATES} SELECT chart_key, 'business' AS category, chart_type, title, dimension, metric, aggregation, rank "
                            "FROM kept WHERE rank <= 3",
        "chart_rank": f"""{CANDIDATES},
            relevant AS (
              SELECT k.chart_key, rank, ({w['domain_relevance']} + CASE WHEN mp.null_ratio < 0.5 THEN {w['data_availability']}
                     WHEN mp.null_ratio IS NOT NULL THEN {w['data_availability']} * 0.3 ELSE 0 END
                     + coalesce({w['metric_validity']} * mp.numeric_parse_ratio, 0)
                     + CASE WHEN dp.distinct_count BETWEEN 2 AND 20 THEN {w['dimension_cardinality']}
                            WHEN dp.distinct_count <= 50 THEN {w['dimension_cardinality']} * 0.5 ELSE 0 END
                     + CASE WHEN dp.datetime_parse_ratio > 0.9 THEN {w['temporal_coverage']} ELSE 0 END)
                     * CASE WHEN metric IS NOT NULL AND row_number() OVER (PARTITION BY metric ORDER BY rank) > 1 THEN 0.6 ELSE 1 END
                     * CASE WHEN dimension IS NOT NULL AND row_number() OVER (PARTITION BY dimension ORDER BY rank) > 1 THEN 0.7 ELSE 1 END AS s
              FROM kept k LEFT JOIN labelled mp ON k.metric = mp.physical_name LEFT JOIN labelled dp ON k.dimension = dp.physical_name
              WHERE rank <= 3)
            SELECT chart_key, round(s::DOUBLE, 6) AS relevance, row_number() OVER (ORDER BY s DESC, rank) AS chart_rank FROM relevant""",
        "chart_validate": VALIDATE,
        "cube_orders": cube("orders", ["o_orderstatus", "o_orderpriority"], "o_totalprice"),
        "cube_geo": cube(geo(), ["region", "country", "customer"], "balance"),
        "cube_lineitem": cube("lineitem", ["l_returnflag", "l_linestatus", "l_suppkey"], "l_quantity"),
        "drill_down_orders": f"SELECT 'o_orderpriority' AS current_level, NULL::VARCHAR AS next_level, label, value, count "
                             f"FROM ({cube('orders', ['o_orderstatus', 'o_orderpriority'], 'o_totalprice')}) "
                             "WHERE level_depth = 1 AND path = 'F'",
        "labels_people": labels("people", PEOPLE_SOURCE),
        "labels_cards": labels("cards", CARDS_SOURCE),
        "identifier_evidence_people": EVIDENCE,
        "confirmed_roles_orders": DECISIONS,
        "described_columns_orders": DESCRIBED,
        "categories_without_domain": categories("people", "Other", PEOPLE_SOURCE),
        "categories_weighted": categories("orders", "Payments", None, (0.9, 0.8), (0.1, 0.1, 1)),
        "domain_decision_cards": CARDS_DOMAIN,
        "hierarchy_chain_warning": chain(WARNING_REGION),
        "hierarchy_unresolved": UNRESOLVED,
        "hierarchy_build_geo": BUILT,
        "rules_loaded_cards": LOADED,
        "readiness_notes": NOTES,
        "chart_dispatch": DISPATCH,
        "chart_quality": QUALITY_CHART,
        "chart_templates_cards": CHART_TEMPLATES,
        "table_guards": GUARDS,
        "csv_customers": CSV_ROWS,
        "run_readback_orders": READBACK,
        "catalogue_labels": CATALOGUE,
        "profile_merge_lineitem": MERGED,
    }
