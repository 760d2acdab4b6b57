"""Declarative rules, evaluated together in one pass over the table.

A rule is a dict (``rule_key``, ``type`` and the type's parameters).  All rules
of row-local type become pairs of conditional counts in a single aggregation.
Uniqueness and long lists of allowed values are decided once per distinct value,
both on one table of value counts.  No user text is run as code: the types are a
fixed list, patterns and short lists enter as literals, long lists and those that
are tables (``values_from``) are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.config.domains import domain_config
from tablelens.functions.parsing import numeric_value, starts_with_match, timestamp_value
from tablelens.functions.text import as_text
from tablelens.operators.frequencies import column_frequencies, inline_value

RULE_TYPES = [
    "non_null", "expected_unique", "regex_match", "allowed_values", "numeric_range", "date_range",
    "column_comparison", "conditional_required", "cross_field_equality", "cross_field_inequality",
]
COMPARISONS = {
    ">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}
#: Lists of allowed values that are longer do not enter the plan as literals.
LITERAL_VALUES = 1000
RESULT_SCHEMA = (
    "dataset string, ord int, rule_key string, rule_type string, records_checked bigint, pass_count bigint, "
    "fail_count bigint, score double, target_columns array<string>, error string"
)


def domain_rules(domain: str, secondary_domain: str | None = None) -> list[dict]:
    """Configured rules of a domain that apply to the secondary domain."""
    kept = []
    for rule in domain_config(domain)["business_rules"]:
        only = rule.get("secondary_domains") or []
        if rule.get("type") in RULE_TYPES and not (secondary_domain and only and secondary_domain not in only):
            kept.append({"source": "domain_configuration", **rule})
    return kept


def request_rules(rules: list[dict] | None) -> list[dict]:
    """Caller's rules; unknown types are dropped."""
    kept: list[dict] = []
    for rule in rules or []:
        if rule.get("type") in RULE_TYPES:
            kept.append({"rule_key": f"request_rule_{len(kept)}", "source": "request", **rule})
    return kept


class _Skip(Exception):
    """The rule cannot be evaluated; the message becomes its error."""


def _resolve(df: DataFrame, rule: dict, role_map: dict, prefix: str) -> str | None:
    name = rule.get(f"{prefix}_column")
    if name not in df.columns:
        name = role_map.get(rule.get(f"{prefix}_role"))
    return name if name in df.columns else None


def _target(df: DataFrame, rule: dict, role_map: dict) -> str:
    name = _resolve(df, rule, role_map, "target")
    if name is None:
        raise _Skip("target column not found")
    return name


def _bounded(value: Column, low, high, inclusive_low: bool, inclusive_high: bool) -> Column:
    inside = value.isNotNull()
    if low is not None:
        inside = inside & (value >= low if inclusive_low else value > low)
    if high is not None:
        inside = inside & (value <= high if inclusive_high else value < high)
    return inside


def _compile(df: DataFrame, rule: dict, role_map: dict) -> tuple[list[str], Column, Column]:
    """(columns, checked aggregate, passed aggregate) of a row-local rule."""
    kind = rule["type"]
    if kind == "non_null":
        name = _target(df, rule, role_map)
        return [name], F.count(F.lit(1)), F.count(as_text(df, name))
    if kind == "regex_match":
        name = _target(df, rule, role_map)
        if not rule.get("pattern"):
            raise _Skip("no pattern given")
        text = as_text(df, name)
        return [name], F.count(text), F.count_if(starts_with_match(text, rule["pattern"]))
    if kind == "allowed_values":
        name = _target(df, rule, role_map)
        text = as_text(df, name)
        return [name], F.count(text), F.count_if(text.isin([str(v) for v in rule.get("values", [])]))
    if kind == "numeric_range":
        name = _target(df, rule, role_map)
        value = numeric_value(df, name)
        inside = _bounded(value, rule.get("min_value"), rule.get("max_value"),
                          rule.get("inclusive_min", True), rule.get("inclusive_max", True))
        return [name], F.count(value), F.count_if(inside)
    if kind == "date_range":
        name = _target(df, rule, role_map)
        value = timestamp_value(df, name)
        low, high = (F.lit(v).cast("timestamp") if v is not None else None
                     for v in (rule.get("min_date"), rule.get("max_date")))
        return [name], F.count(value), F.count_if(_bounded(value, low, high, True, True))
    if kind == "column_comparison":
        left, right = _resolve(df, rule, role_map, "left"), _resolve(df, rule, role_map, "right")
        if left is None or right is None:
            raise _Skip("a compared column was not found")
        operator = rule.get("operator", ">=")
        if operator not in COMPARISONS:
            raise _Skip(f"unsupported operator {operator}")
        compare = COMPARISONS[operator]
        numbers = numeric_value(df, left), numeric_value(df, right)
        times = timestamp_value(df, left), timestamp_value(df, right)
        # more than half the left side not numeric: compare as dates
        dated = F.count(F.lit(1)) - F.count(numbers[0]) > F.count(F.lit(1)) * 0.5

        def both(pair):
            return pair[0].isNotNull() & pair[1].isNotNull()

        checked = F.when(dated, F.count_if(both(times))).otherwise(F.count_if(both(numbers)))
        passed = F.when(dated, F.count_if(compare(*times))).otherwise(F.count_if(compare(*numbers)))
        return [left, right], checked, passed
    if kind == "conditional_required":
        condition, required = rule.get("condition_column"), rule.get("required_column")
        if condition not in df.columns:
            raise _Skip("condition column not found")
        if required not in df.columns:
            raise _Skip("required column not found")
        applies = as_text(df, condition) == F.lit(str(rule.get("condition_value")))
        return ([condition, required], F.count_if(applies),
                F.count_if(applies & as_text(df, required).isNotNull()))
    left, right = rule.get("left_column"), rule.get("right_column")
    if left not in df.columns or right not in df.columns:
        raise _Skip("a compared column was not found")
    a, b = as_text(df, left), as_text(df, right)
    same = a == b
    return [left, right], F.count_if(a.isNotNull() & b.isNotNull()), F.count_if(
        same if kind == "cross_field_equality" else ~same)


def _score(kind: Column) -> Column:
    """Share passed; with nothing to check 1.0, or 0.0 where all rows count."""
    empty = F.when(kind.isin("non_null", "expected_unique"), 0.0).otherwise(1.0)
    return F.when(F.col("records_checked") > 0, F.col("pass_count") / F.col("records_checked")).otherwise(empty)


def _value_list(spark: SparkSession, rule: dict, value_lists: dict[str, DataFrame]) -> DataFrame | None:
    """The allowed values as a relation ``(text)``; None if they enter as literals."""
    name = rule.get("values_from")
    if name is not None:
        values = value_lists.get(name)
        column = None if values is None else rule.get("values_column", values.columns[0])
        if values is None or column not in values.columns:
            raise _Skip("value list not found")
        return values.select(as_text(values, column).alias("text"))
    values = rule.get("values", [])
    return spark.createDataFrame([(str(v),) for v in values], "text string") if len(values) > LITERAL_VALUES else None


def _listed_counts(freq: DataFrame, listed: list[tuple[int, int, DataFrame]]) -> DataFrame:
    """``(ord, records_checked, pass_count)`` of lists ``(ord, pos, values)``; each distinct value is looked up once."""
    # out of a generator, so that no null filter on them goes below the aggregation all branches share
    values = freq.selectExpr("pos", "cnt", "inline(array(named_struct('val', val, 'digest', coalesce(digest, ''))))")
    places = freq.sparkSession.createDataFrame([(i, pos) for i, pos, _ in listed], "ord int, pos int")
    known = None
    for i, _, allowed in listed:
        part = inline_value(allowed.where("text IS NOT NULL")).selectExpr(f"{i} AS ord", "val", "coalesce(digest, '') AS digest")
        known = part if known is None else known.unionByName(part)
    known = known.distinct().withColumn("known", F.lit(True))
    # one row per rule on the broadcast side; the lists are joined by their size
    asked = values.where("val IS NOT NULL").join(F.broadcast(places), "pos")
    return asked.join(known, ["ord", "val", "digest"], "left").groupBy("ord").agg(
        F.sum("cnt").alias("records_checked"), F.sum(F.when(F.col("known"), F.col("cnt")).otherwise(0)).alias("pass_count"))


def evaluate_rules(df: DataFrame, rules: list[dict], role_map: dict[str, str] | None = None,
                   dataset: str = "dataset", value_lists: dict[str, DataFrame] | None = None) -> DataFrame:
    """One result row per active rule, in rule order (``ord``).

    The allowed values of a rule may be a table: ``values_from`` names one of
    ``value_lists``, ``values_column`` its column, else the first.  Values are
    compared in text form, whole; nulls and repeats in a list mean nothing.
    """
    spark, role_map = df.sparkSession, role_map or {}
    local, unique, listed, errors = [], [], [], []
    for i, rule in enumerate(r for r in rules if r.get("active", True)):
        try:
            if rule["type"] == "expected_unique":
                unique.append((i, rule, _target(df, rule, role_map)))
            elif rule["type"] == "allowed_values" and (values := _value_list(spark, rule, value_lists or {})) is not None:
                listed.append((i, rule, _target(df, rule, role_map), values))
            else:
                local.append((i, rule, *_compile(df, rule, role_map)))
        except _Skip as skip:
            errors.append((dataset, i, rule["rule_key"], rule["type"], 0, 0, 0, 0.0, [], str(skip)))

    parts = [spark.createDataFrame(errors, RESULT_SCHEMA)]
    if local:
        counted = df.agg(*[
            aggregate.alias(f"{label}{i}")
            for i, _, _, checked, passed in local
            for label, aggregate in (("checked", checked), ("passed", passed))
        ])
        rows = F.array(*[
            F.struct(
                F.lit(i).alias("ord"), F.lit(rule["rule_key"]).alias("rule_key"), F.lit(rule["type"]).alias("rule_type"),
                F.col(f"checked{i}").alias("records_checked"), F.col(f"passed{i}").alias("pass_count"),
                F.array(*[F.lit(c) for c in columns]).alias("target_columns"),
            )
            for i, rule, columns, _, _ in local
        ])
        parts.append(_finished(counted.select(F.inline(rows)), dataset))
    by_value = [r[:3] for r in unique + listed]
    if by_value:
        position = {name: i for i, name in enumerate(df.columns)}
        freq = column_frequencies(df, sorted({name for _, _, name in by_value}))
        wanted = "ord int, rule_key string, rule_type string, pos int, target_columns array<string>"
        # a missing value is a value to uniqueness: its first row passes
        once = freq.groupBy("pos").agg(F.sum("cnt").alias("records_checked"), F.count(F.lit(1)).alias("pass_count"))
        looked_up = _listed_counts(freq, [(i, position[name], values) for i, _, name, values in listed]) if listed else None
        for of, counts, key in ((unique, once, "pos"), ([r[:3] for r in listed], looked_up, "ord")):
            if of:
                asked = spark.createDataFrame([(i, rule["rule_key"], rule["type"], position[name], [name]) for i, rule, name in of], wanted)
                counted = asked.join(F.broadcast(counts), key, "left").fillna(0, ["records_checked", "pass_count"])
                parts.append(_finished(counted, dataset))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _finished(counted: DataFrame, dataset: str) -> DataFrame:
    return counted.select(
        F.lit(dataset).alias("dataset"), "ord", "rule_key", "rule_type", "records_checked", "pass_count",
        (F.col("records_checked") - F.col("pass_count")).alias("fail_count"),
        _score(F.col("rule_type")).alias("score"), "target_columns", F.lit(None).cast("string").alias("error"),
    )


def review_suggestions(suggestions: DataFrame, reviews: DataFrame, order_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply ``(suggestion_id, action, comment)`` to suggestions.

    Only a proposed suggestion can be approved or rejected.  Of several reviews
    of one suggestion the first in ``order_by`` (a column such as their time;
    ties and no such column: by action, then comment) decides and the others are
    refused.  Returns the suggestions after review and the transitions refused.
    """
    allowed = F.col("action").isin("approve", "reject")
    place = F.struct(*([F.col(order_by)] if order_by else []), F.col("action"), F.col("comment"))
    # equal reviews are one row with their number; the first review is a minimum, merged before the shuffle
    reviews = reviews.groupBy("suggestion_id", "action", "comment", place.alias("place")).agg(F.count(F.lit(1)).alias("times"))
    first = reviews.where(allowed).groupBy("suggestion_id").agg(F.min("place").alias("place"))
    first = first.select("suggestion_id", "place", F.col("place.action").alias("action"), F.col("place.comment").alias("comment"))
    joined = suggestions.join(first, "suggestion_id", "left")
    allowed = (F.col("status") == "proposed") & allowed
    new = F.when(F.col("action") == "approve", "approved").otherwise("rejected")
    reviewed = joined.select(
        *[c for c in suggestions.columns if c != "status"],
        F.when(allowed, new).otherwise(F.col("status")).alias("status"),
        F.when(allowed & (F.col("action") == "approve"), F.col("comment")).alias("comment"),
        F.when(allowed & (F.col("action") == "reject"), F.col("comment")).alias("rejection_reason"),
    )
    reviewed_at = first.select("suggestion_id", F.col("place").alias("decisive"))
    both = suggestions.select("suggestion_id", "status").join(reviews, "suggestion_id").join(reviewed_at, "suggestion_id", "left")
    applied = F.coalesce((F.col("status") == "proposed") & (F.col("place") == F.col("decisive")), F.lit(False))
    over = F.explode(F.array_repeat(F.lit(1), (F.col("times") - applied.cast("int")).cast("int")))
    # after the decision the suggestion is no longer proposed
    decided = F.when(F.col("decisive.action") == "approve", "approved").when(F.col("decisive.action") == "reject", "rejected")
    status = F.when(F.col("status") == "proposed", F.coalesce(decided, F.col("status"))).otherwise(F.col("status"))
    refused = both.where("action IS NOT NULL").select(
        "suggestion_id", status.alias("status"), "action", F.lit("INVALID_RULE_TRANSITION").alias("code"), over.alias("n")).drop("n")
    missing = reviews.join(suggestions, "suggestion_id", "left_anti").select(
        "suggestion_id", F.lit(None).cast("string").alias("status"), "action",
        F.lit("RULE_SUGGESTION_NOT_FOUND").alias("code"), F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("n")).drop("n")
    return reviewed, refused.unionByName(missing)
