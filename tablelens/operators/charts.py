"""Charts: which ones to draw, and the aggregates behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.config.fixed_values import CHART_LIMIT, CHART_MAX_POINTS, CHART_WEIGHTS
from tablelens.functions.parsing import month, numeric_sql, numeric_value, timestamp_value
from tablelens.functions.text import as_text, sql_string

CATEGORICAL = ("bar", "pie", "donut", "stacked_bar")
SPEC_SCHEMA = (
    "ord int, chart_key string, category string, chart_type string, title string, dimension string, "
    "metric string, aggregation string, current_level string, next_level string, rank int"
)


def category_values(df: DataFrame, dimension: str, metric: str | None = None, aggregation: str = "count",
                    limit: int = CHART_LIMIT) -> DataFrame:
    """``(position, label, value)``: the top groups of a dimension."""
    label = as_text(df, dimension).alias("label")
    if metric is None:
        grouped = df.select(label).where("label IS NOT NULL").groupBy("label")
        value = F.count(F.lit(1))
    else:
        grouped = df.select(label, numeric_value(df, metric).alias("x")).where("label IS NOT NULL").groupBy("label")
        # a group without numbers sums to 0 and has no mean; both are drawn as 0
        value = {"sum": F.sum("x"), "mean": F.avg("x")}.get(aggregation, F.count("x"))
    totals = grouped.agg(value.cast("double").alias("raw"))
    # a sum without numbers is 0 and sorts as such; a missing mean sorts last
    if aggregation == "sum":
        totals = totals.fillna(0.0, ["raw"])
    top = totals.orderBy(F.col("raw").desc_nulls_last(), "label").limit(limit)
    return top.selectExpr(
        "int(row_number() OVER (ORDER BY raw DESC NULLS LAST, label)) AS position", "label",
        "coalesce(round(raw, 2), 0D) AS value")


def month_values(df: DataFrame, dimension: str, metric: str | None = None, aggregation: str = "count",
                 limit: int = CHART_MAX_POINTS) -> DataFrame:
    """``(position, label, value)``: one point per month that occurs."""
    months = month(timestamp_value(df, dimension)).alias("label")
    if metric is None:
        points = df.select(months).where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("raw"))
    else:
        value = F.coalesce(F.sum("x"), F.lit(0.0)) if aggregation == "sum" else F.count("x")
        points = df.select(months, numeric_value(df, metric).alias("x")).where("label IS NOT NULL").groupBy("label").agg(
            value.alias("raw"))
    return points.orderBy("label").limit(limit).selectExpr(
        "int(row_number() OVER (ORDER BY label)) AS position", "label", "round(double(raw), 2) AS value")


def kpi_value(df: DataFrame, metric: str, aggregation: str = "sum", title: str | None = None) -> DataFrame:
    value = numeric_value(df, metric)
    total = {"mean": F.avg(value), "count": F.count(value)}.get(aggregation, F.coalesce(F.sum(value), F.lit(0.0)))
    return df.agg(F.round(total.cast("double"), 2).alias("value")).select(
        F.lit(1).alias("position"), F.lit(title or metric).alias("label"), "value")


def _one_decimal(x: str) -> str:
    """``%.1f`` rounding the binary value, as C and Python print it.

    Tenths of a binary fraction are exact in double arithmetic here, so ties
    are true ties and go to even.
    """
    whole, tenths = f"floor(abs({x}))", f"bigint(rint((abs({x}) - floor(abs({x}))) * 10))"
    return (
        f"CASE WHEN abs({x}) < 1e15 THEN concat(if({x} < 0, '-', ''), "
        f"string(bigint({whole}) + {tenths} DIV 10), '.', string({tenths} % 10)) ELSE format_string('%.1f', {x}) END"
    )


_HISTOGRAM = """
WITH spread AS (
  SELECT *, if(lo = hi, lo - 0.5D, lo) AS first, if(lo = hi, hi + 0.5D, hi) AS last,
         int(least(20L, greatest(5L, n DIV 10))) AS bins
  FROM (SELECT min(x) AS lo, max(x) AS hi, count(x) AS n FROM {values})
  WHERE n > 0
),
slots AS (
  SELECT bin, first + (bin - 1) * ((last - first) / bins) AS low,
         if(bin = bins, last, first + bin * ((last - first) / bins)) AS high
  FROM (SELECT *, explode(sequence(1, bins)) AS bin FROM spread)
),
-- the spread is one row, read back as scalars
placed AS (
  SELECT x, (SELECT first FROM spread) AS first, (SELECT last FROM spread) AS last, (SELECT bins FROM spread) AS bins
  FROM {values} WHERE x IS NOT NULL
),
rough AS (
  SELECT x, first, last, bins, least(int(floor((x - first) / (last - first) * bins)), bins - 1) AS i FROM placed
),
-- rounding may put a value one bin off its printed edges; the edges decide
exact AS (
  SELECT 1 + CASE WHEN x < first + i * ((last - first) / bins) THEN i - 1
                  WHEN i < bins - 1 AND x >= first + (i + 1) * ((last - first) / bins) THEN i + 1
                  ELSE i END AS bin
  FROM rough
),
counts AS (SELECT bin, count(*) AS n FROM exact GROUP BY bin)
SELECT s.bin AS position, concat(LOW_LABEL, '-', HIGH_LABEL) AS label, double(coalesce(c.n, 0L)) AS value
FROM slots s LEFT JOIN counts c ON s.bin = c.bin
""".replace("LOW_LABEL", _one_decimal("s.low")).replace("HIGH_LABEL", _one_decimal("s.high"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """``(position, label, value)`` of equal-width bins, empty ones included."""
    values = df.selectExpr(f"{numeric_sql(df, column)} AS x")
    return df.sparkSession.sql(_HISTOGRAM, values=values)


def missing_values(profile: DataFrame, limit: int = CHART_LIMIT) -> DataFrame:
    """Columns with nulls, worst first, in percent."""
    return profile.where("null_ratio > 0").orderBy(F.desc("null_ratio"), "pos").limit(limit).selectExpr(
        "int(row_number() OVER (ORDER BY null_ratio DESC, pos)) AS position", "physical_name AS label",
        "round(null_ratio * 100, 1) AS value")


def quality_scores(dimensions: DataFrame) -> DataFrame:
    return dimensions.where("status = 'assessed' AND score IS NOT NULL").selectExpr(
        "int(row_number() OVER (ORDER BY ord)) AS position", "dimension AS label", "round(score * 100, 1) AS value")


def rule_violations(rule_results: DataFrame) -> DataFrame:
    return rule_results.where("error IS NULL").selectExpr(
        "int(row_number() OVER (ORDER BY fail_count DESC, rule_key)) AS position", "rule_key AS label",
        "double(fail_count) AS value")


def chart_candidates(labelled: DataFrame, levels: list[str] | None = None, missing: bool = True,
                     quality: bool = True, max_charts: int = 5, business: int = 3, profiling: int = 2) -> DataFrame:
    """Up to ``max_charts`` chart specifications for one data set.

    Built from the first metric, dimension and time column; all conditions are
    expressions over one row made from the labelled profile.
    """
    columns = (
        "transform(array_sort(collect_list(CASE WHEN candidate_role = '{role}' THEN named_struct('pos', pos, "
        "'name', physical_name, 'distinct', distinct_count) END)), c -> named_struct('name', c.name, 'distinct', c.distinct))"
    )
    roles = labelled.groupBy("dataset").agg(
        F.expr(columns.format(role="metric")).alias("m"),
        F.expr(columns.format(role="dimension")).alias("d"),
        F.expr(columns.format(role="temporal_dimension")).alias("t"),
        F.expr("count_if(null_ratio > 0)").alias("with_nulls"),
    )
    levels = levels or []
    top, below = (levels + [None, None])[:2]
    level = f"'{top}'" if top else "NULL"
    next_level = f"'{below}'" if below else "NULL"
    metric, dimension, time = "get(m, 0).name", "get(d, 0).name", "get(t, 0).name"
    pie = "get(filter(slice(d, 1, 2), c -> c.distinct BETWEEN 2 AND 10), 0).name"

    def spec(condition, key, category, kind, title, dim, met, aggregation, current="NULL", following="NULL"):
        return (
            f"if({condition}, named_struct('chart_key', {key}, 'category', '{category}', 'chart_type', '{kind}', "
            f"'title', {title}, 'dimension', string({dim}), 'metric', string({met}), 'aggregation', '{aggregation}', "
            f"'current_level', string({current}), 'next_level', string({following})), NULL)"
        )

    business_specs = [
        spec(f"{time} IS NOT NULL AND {metric} IS NOT NULL", f"concat({metric}, '_over_time')", "business", "line",
             f"concat({metric}, ' Over Time')", time, metric, "sum"),
        spec(f"{dimension} IS NOT NULL AND {metric} IS NOT NULL AND get(d, 0).distinct <= 30",
             f"concat({metric}, '_by_', {dimension})", "business", "bar", f"concat({metric}, ' by ', {dimension})",
             dimension, metric, "sum"),
        spec(f"{pie} IS NOT NULL", f"concat({pie}, '_distribution')", "business", "pie",
             f"concat({pie}, ' Distribution')", pie, "NULL", "count"),
        spec(f"{metric} IS NOT NULL", f"concat({metric}, '_kpi')", "business", "kpi", f"concat('Total ', {metric})",
             "NULL", metric, "sum"),
        spec(f"{str(len(levels) >= 2).lower()} AND {metric} IS NOT NULL", f"concat('metric_by_', {level})", "business",
             "bar", f"concat({metric}, ' by ', {level})", level, metric, "sum", level, next_level),
    ]
    profiling_specs = [
        spec(f"{str(missing).lower()} AND with_nulls > 0", "'missing_values_by_column'", "profiling", "bar",
             "'Missing Values by Column (%)'", "NULL", "NULL", "value"),
        spec(str(quality).lower(), "'quality_score_by_dimension'", "quality", "bar", "'Quality Score by Dimension'",
             "NULL", "NULL", "value"),
    ]
    chosen = (
        f"slice(concat(slice(array_compact(array({', '.join(business_specs)})), 1, {business}), "
        f"slice(array_compact(array({', '.join(profiling_specs)})), 1, {profiling})), 1, {max_charts})"
    )
    return roles.selectExpr("dataset", f"posexplode({chosen}) AS (ord, c)").selectExpr(
        "dataset", "ord", "c.*", "ord + 1 AS rank")


def _matches_role(role: str) -> str:
    """How well a column ``c`` plays a template's role: 1 best, null not at all."""
    name = f"'{role}'"
    return (
        f"CASE WHEN c.semantic = {name} THEN 1 WHEN c.role = {name} THEN 2 WHEN c.key = {name} THEN 3 "
        f"WHEN contains(c.semantic, {name}) OR contains({name}, c.semantic) AND c.semantic != '' THEN 4 "
        f"WHEN contains(c.key, {name}) THEN 5 END"
    )


def template_charts(labelled: DataFrame, templates: list[dict], levels: list[str] | None = None) -> DataFrame:
    """Chart specifications of the templates whose roles the columns can play.

    A role takes, in the template's order, the column that plays it best (same
    semantic type, same role, same key, part of either; then table order) and
    that no earlier role of the chart has taken.  A template with a role left
    over gives no chart.  ``hierarchy_dimension`` is the top level of the chosen
    hierarchy.  Everything is an expression over one row per data set.
    """
    # one data set's columns: as many entries as the table has columns
    columns = labelled.groupBy("dataset").agg(F.expr(
        "array_sort(collect_list(named_struct('pos', pos, 'name', physical_name, 'key', normalized_key, 'role', candidate_role, "
        "'semantic', lower(coalesce(candidate_semantic_type, '')), 'numeric', numeric_parse_ratio > 0.5))) AS columns"))
    top = f"'{levels[0]}'" if levels else "CAST(NULL AS string)"
    specs = []
    for place, template in enumerate(templates):
        taken = "CAST(array() AS array<string>)"
        for role in template.get("required_roles", []):
            free = "filter(columns, c -> NOT array_contains(taken, c.name))"
            ranked = f"transform({free}, c -> named_struct('fit', {_matches_role(role)}, 'pos', c.pos, 'name', c.name))"
            best = f"array_min(filter({ranked}, r -> r.fit IS NOT NULL)).name"
            found = f"coalesce({top}, {best})" if role == "hierarchy_dimension" else best
            taken = f"get(transform(array({taken}), taken -> concat(taken, array({found}))), 0)"
        specs.append(
            f"named_struct('place', {place}, 'chart_key', '{template['key']}', 'category', '{template['category']}', "
            f"'chart_type', '{template['chart_type']}', 'aggregation', '{template.get('aggregation', 'value')}', "
            f"'title', {sql_string(template['title_template'])}, 'roles', {len(template.get('required_roles', []))}, 'taken', {taken})")
    if not specs:
        specs = ["CAST(NULL AS struct<place: int, chart_key: string, category: string, chart_type: string, aggregation: string, "
                 "title: string, roles: int, taken: array<string>>)"]
    found = columns.selectExpr("dataset", "columns", f"inline(filter(array({', '.join(specs)}), s -> s IS NOT NULL))")
    found = found.where("size(array_compact(taken)) = roles")
    # the value drawn is the last column taken that is a number; a count needs none, a distribution nothing else
    numeric = "filter(columns, c -> c.numeric AND array_contains(taken, c.name)).name"
    metric = ("CASE WHEN chart_type = 'histogram' THEN get(taken, 0) WHEN aggregation IN ('sum', 'mean') "
              f"THEN get(filter(reverse(taken), t -> array_contains({numeric}, t)), 0) END")
    return found.withColumn("metric", F.expr(metric)).selectExpr(
        "dataset", "place AS ord", "chart_key", "category", "chart_type",
        f"replace(title, '{{hierarchy_level}}', coalesce({top}, '')) AS title",
        "CASE WHEN chart_type != 'histogram' THEN get(filter(taken, t -> NOT t <=> metric), 0) END AS dimension", "metric", "aggregation",
        f"CASE WHEN array_contains(taken, {top}) THEN {top} END AS current_level",
        f"CASE WHEN array_contains(taken, {top}) THEN {sql_string(levels[1]) if levels and len(levels) > 1 else 'CAST(NULL AS string)'} END AS next_level",
    )


def profiling_charts(labelled: DataFrame, templates: list[dict]) -> DataFrame:
    """The charts any table has: those of the whole profile once, distributions once per measured column."""
    whole = [t for t in templates if "{column_name}" not in t["title_template"]]
    each = [t for t in templates if "{column_name}" in t["title_template"]]
    empty = "CAST(NULL AS string)"
    rows = None
    for kind, source in ((whole, labelled.select("dataset").distinct().selectExpr("dataset", "0 AS pos", f"{empty} AS name")),
                         (each, labelled.where("candidate_role = 'metric'").selectExpr("dataset", "pos", "physical_name AS name"))):
        for template in kind:
            place = templates.index(template)
            part = source.selectExpr(
                "dataset", f"1000 * {place + 1} + pos AS ord",
                f"concat_ws('_', name, '{template['key']}') AS chart_key", f"'{template['category']}' AS category",
                f"'{template['chart_type']}' AS chart_type",
                f"replace({sql_string(template['title_template'])}, '{{column_name}}', coalesce(name, '')) AS title",
                f"{empty} AS dimension", "name AS metric", "'value' AS aggregation", f"{empty} AS current_level", f"{empty} AS next_level")
            rows = part if rows is None else rows.unionByName(part)
    return rows


def chart_data(df: DataFrame, spec: dict) -> DataFrame | None:
    """Data of one chart; None for a chart without data of its own."""
    kind, dimension, metric = spec["chart_type"], spec.get("dimension"), spec.get("metric")
    aggregation = spec.get("aggregation", "count")
    known = set(df.columns)
    if kind in CATEGORICAL and dimension in known:
        data = category_values(df, dimension, metric if metric in known else None, aggregation)
    elif kind == "line" and dimension in known:
        data = month_values(df, dimension, metric if metric in known else None, aggregation)
    elif kind == "kpi" and metric in known:
        data = kpi_value(df, metric, aggregation, spec.get("title"))
    elif kind == "histogram" and (metric or dimension) in known:
        data = histogram(df, metric or dimension)
    else:
        return None
    return data.select(F.lit(spec["chart_key"]).alias("chart_key"), "position", "label", "value")


def rank_charts(specs: DataFrame, profile: DataFrame, weights: dict | None = None) -> DataFrame:
    """Add ``relevance`` and ``chart_rank``; a repeated column costs relevance.

    ``specs``: ``(dataset, ord, chart_key, category, metric, dimension,
    current_level, has_data)``.
    """
    w = {**CHART_WEIGHTS, **(weights or {})}
    columns = profile.select(
        "dataset", F.col("physical_name").alias("name"), "null_ratio", "numeric_parse_ratio", "distinct_count",
        "datetime_parse_ratio")
    metrics = columns.selectExpr("dataset", "name AS metric", "null_ratio AS metric_nulls",
                                 "numeric_parse_ratio AS metric_numeric")
    dimensions = columns.selectExpr("dataset", "name AS dimension", "distinct_count AS dimension_distinct",
                                    "datetime_parse_ratio AS dimension_dates")
    joined = specs.join(F.broadcast(metrics), ["dataset", "metric"], "left").join(
        F.broadcast(dimensions), ["dataset", "dimension"], "left")
    score = (
        f"if(category = 'business', {w['domain_relevance']}D, {w['domain_relevance']}D * 0.5D)"
        f" + CASE WHEN metric_nulls < 0.5 THEN {w['data_availability']}D"
        f" WHEN metric_nulls IS NOT NULL THEN {w['data_availability']}D * 0.3D"
        f" WHEN has_data THEN {w['data_availability']}D ELSE 0D END"
        f" + coalesce({w['metric_validity']}D * metric_numeric, 0D)"
        f" + CASE WHEN dimension_distinct BETWEEN 2 AND 20 THEN {w['dimension_cardinality']}D"
        f" WHEN dimension_distinct <= 50 THEN {w['dimension_cardinality']}D * 0.5D ELSE 0D END"
        f" + if(dimension_dates > 0.9, {w['temporal_coverage']}D, 0D)"
        f" + if(current_level IS NOT NULL, {w['hierarchy_compatibility']}D, 0D)"
    )
    seen_metric = "metric IS NOT NULL AND row_number() OVER (PARTITION BY dataset, metric ORDER BY ord) > 1"
    seen_dimension = "dimension IS NOT NULL AND row_number() OVER (PARTITION BY dataset, dimension ORDER BY ord) > 1"
    return joined.selectExpr(
        *[f"`{c}`" for c in specs.columns],
        f"({score}) * if({seen_metric}, 0.6D, 1D) * if({seen_dimension}, 0.7D, 1D) AS relevance",
    ).selectExpr("*", "int(row_number() OVER (PARTITION BY dataset ORDER BY relevance DESC, ord)) AS chart_rank")


def validate_charts(specs: DataFrame, profile: DataFrame, max_bar: int = 30, max_pie: int = 10) -> DataFrame:
    """Drop charts on unknown columns, attach warnings to the others."""
    columns = profile.select("dataset", F.col("physical_name").alias("name"), "distinct_count")
    joined = specs.join(
        F.broadcast(columns.selectExpr("dataset", "name AS metric", "distinct_count AS metric_distinct")),
        ["dataset", "metric"], "left",
    ).join(
        F.broadcast(columns.selectExpr("dataset", "name AS dimension", "distinct_count AS dimension_distinct")),
        ["dataset", "dimension"], "left",
    )
    checks = [
        ("chart_type = 'line' AND dimension IS NULL", "'needs a time or ordered dimension'"),
        ("chart_type = 'scatter' AND (metric IS NULL OR dimension IS NULL)", "'needs two numeric fields'"),
        (f"chart_type IN ('pie', 'donut') AND dimension_distinct > {max_pie}",
         f"concat('dimension has ', dimension_distinct, ' values, {max_pie} at most advised')"),
        (f"chart_type = 'bar' AND dimension_distinct > {max_bar}",
         f"concat('dimension has ', dimension_distinct, ' values, {max_bar} at most')"),
        ("chart_type = 'kpi' AND metric IS NULL", "'needs a metric'"),
    ]
    listed = ", ".join(f"if({condition}, {text}, NULL)" for condition, text in checks)
    return joined.where(
        "(metric IS NULL OR metric_distinct IS NOT NULL) AND (dimension IS NULL OR dimension_distinct IS NOT NULL)"
    ).selectExpr(*[f"`{c}`" for c in specs.columns], f"array_compact(array({listed})) AS warnings")
