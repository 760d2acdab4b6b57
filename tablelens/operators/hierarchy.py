"""Dimension hierarchies: template matching and functional dependencies.

An edge parent -> child is sound when every child value has one parent value.
A child violates it if the smallest and the largest hash of its parents differ,
so all edges are checked by one aggregation per (edge, child) that combines
map-side and never holds a pair.  Parents themselves are fetched for the few
children that are shown as conflicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.config.domains import domain_config
from tablelens.config.fixed_values import FD_ACCEPTED, FD_MIN_COVERAGE, FD_WARNING, MAX_CONFLICT_SAMPLES
from tablelens.functions.text import as_text_sql, sql_string
from tablelens.sources.settle import settled

EDGE_KEYS = ["edge", "parent_column", "child_column"]


def match_templates(labelled: DataFrame, templates: list[dict]) -> DataFrame:
    """One row per data set, template and concept, with the column found.

    A concept takes the first column, in table order, of the first strategy
    that finds any: same key, one name inside the other, concept inside the
    semantic type, a word in common.  Grain keys are no levels.  A column an
    earlier concept took leaves the later one without.
    """
    concepts = ", ".join(
        f"named_struct('template_pos', {t}, 'template_key', {sql_string(template.get('key', 'unknown'))}, "
        f"'priority', {template.get('priority', 0)}, 'levels', {len(template['levels'])}, "
        f"'concept_pos', {c}, 'concept', "
        f"{sql_string(concept.lower().replace(' ', '_').replace('-', '_'))})"
        for t, template in enumerate(templates)
        for c, concept in enumerate(template.get("levels", []))
    )
    # one data set's columns: as many entries as the table has columns
    columns = labelled.where("NOT is_grain_key").groupBy("dataset").agg(
        F.expr("array_sort(collect_list(named_struct('pos', pos, 'key', normalized_key, 'name', physical_name, "
               "'type', lower(coalesce(candidate_semantic_type, '')))))").alias("columns"))
    strategy = (
        "CASE WHEN c.key = concept THEN 1 WHEN contains(c.key, concept) OR contains(concept, c.key) THEN 2 "
        "WHEN contains(c.type, concept) THEN 3 "
        "WHEN arrays_overlap(split(concept, '[_ ]+'), split(c.key, '[_ ]+')) THEN 4 END"
    )
    ranked = f"transform(columns, c -> named_struct('strategy', {strategy}, 'pos', c.pos, 'name', c.name))"
    found = columns.selectExpr("dataset", "columns", f"inline(array({concepts}))").selectExpr(
        "dataset", "template_pos", "template_key", "priority", "levels", "concept_pos", "concept",
        f"array_min(filter({ranked}, r -> r.strategy IS NOT NULL)).name AS found",
    )
    first = "row_number() OVER (PARTITION BY dataset, template_pos, found ORDER BY concept_pos) = 1"
    return found.selectExpr("*", f"CASE WHEN {first} THEN found END AS physical_name").drop("found")


def template_matches(labelled: DataFrame, templates: list[dict]) -> DataFrame:
    """One row per template, best first: levels found, missing concepts, ratio."""
    matched = match_templates(labelled, templates).groupBy("dataset", "template_pos", "template_key", "priority").agg(
        F.expr("transform(array_sort(collect_list(CASE WHEN physical_name IS NOT NULL THEN "
               "named_struct('p', concept_pos, 'name', physical_name) END)), e -> e.name)").alias("level_columns"),
        F.expr("transform(array_sort(collect_list(CASE WHEN physical_name IS NULL THEN "
               "named_struct('p', concept_pos, 'concept', concept) END)), e -> e.concept)").alias("missing_concepts"),
        (F.count("physical_name") / F.max("levels")).alias("match_ratio"),
    )
    order = Window.partitionBy("dataset").orderBy(F.desc("match_ratio"), F.desc("priority"), "template_pos")
    return matched.withColumn("rank", F.row_number().over(order)).drop("template_pos")


def edge_values(df: DataFrame, edges: list[tuple[str, str]]) -> DataFrame:
    """``(edge, child, parent)`` of every row with a child, for all edges at once."""
    entries = ", ".join(
        f"named_struct('edge', {i}, 'child', {as_text_sql(df, child)}, 'parent', {as_text_sql(df, parent)})"
        for i, (parent, child) in enumerate(edges)
    )
    return df.selectExpr(f"inline(array({entries}))").where("child IS NOT NULL")


def edge_children(df: DataFrame, edges: list[tuple[str, str]]) -> DataFrame:
    """``(edge, child, mapped, violates)``: one row per child value.

    Two hashes of the parent, so that different parents pass for one only if
    both agree, 128 bits in all.
    """
    hashed = edge_values(df, edges).selectExpr(
        "edge", "child", "if(parent IS NULL, NULL, xxhash64(parent)) AS a", "if(parent IS NULL, NULL, xxhash64(parent, 1)) AS b")
    return hashed.groupBy("edge", "child").agg(
        F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"),
    ).selectExpr("edge", "child", "a0 IS NOT NULL AS mapped", "coalesce(a0 != a1 OR b0 != b1, false) AS violates")


def _edge_names(df: DataFrame, edges: list[tuple[str, str]]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(i, parent, child) for i, (parent, child) in enumerate(edges)], "edge int, parent_column string, child_column string")


def validate_edges(df: DataFrame, edges: list[tuple[str, str]], accepted: float = FD_ACCEPTED,
                   warning: float = FD_WARNING, min_coverage: float = FD_MIN_COVERAGE,
                   samples: int = MAX_CONFLICT_SAMPLES) -> DataFrame:
    """One row per ``(parent, child)`` edge with its counts, ratios and status.

    ``conflict_children`` lists the first violating children, from the same pass.
    """
    children = edge_children(df, edges)
    counts = children.groupBy("edge").agg(
        F.count(F.lit(1)).alias("distinct_child_count"),
        F.count_if("mapped").alias("mapped_child_count"),
        F.count_if("violates").alias("violating_child_count"),
    )
    by_child = Window.partitionBy("edge").orderBy("child")
    # at most so many children an edge; naming mapped keeps the aggregation the same as above
    shown = (
        children.where(F.when(F.col("mapped") & F.col("violates"), F.col("violates")))
        .withColumn("rn", F.row_number().over(by_child))
        .where(F.col("rn") <= samples)
        .groupBy("edge").agg(F.sort_array(F.collect_list("child")).alias("conflict_children"))
    )
    return (
        _edge_names(df, edges).join(F.broadcast(counts), "edge", "left").join(F.broadcast(shown), "edge", "left")
        .fillna(0, ["distinct_child_count", "mapped_child_count", "violating_child_count"])
        .withColumn("conflict_children", F.coalesce("conflict_children", F.expr("CAST(array() AS array<string>)")))
        .selectExpr(
            "*",
            "if(distinct_child_count > 0, 1 - violating_child_count / distinct_child_count, 1D) AS fd_consistency",
            "if(distinct_child_count > 0, mapped_child_count / distinct_child_count, 0D) AS mapping_coverage",
        )
        .selectExpr(
            "*", "fd_consistency * mapping_coverage AS edge_confidence",
            f"CASE WHEN mapping_coverage < {min_coverage} THEN 'rejected' "
            f"WHEN fd_consistency >= {accepted} THEN 'accepted' "
            f"WHEN fd_consistency >= {warning} THEN 'retained_with_warning' ELSE 'rejected' END AS status",
        )
    )


def conflict_parents(df: DataFrame, checked: DataFrame, edges: list[tuple[str, str]], samples: int = MAX_CONFLICT_SAMPLES) -> DataFrame:
    """The violating children that ``validate_edges`` lists, each with its first parents.

    ``checked``: its result, whose ``edge`` numbers ``edges``.  Without a
    violating child the scan is dropped at run time.  Limits rank inside the
    tasks before any shuffle, so a child with a million parents is not gathered.
    """
    # at most ``samples`` children an edge: bounded by the number of edges
    wanted = checked.selectExpr(*EDGE_KEYS, "posexplode(conflict_children) AS (place, child)")
    pairs = edge_values(df, edges).where("parent IS NOT NULL").join(F.broadcast(wanted), ["edge", "child"])
    pairs = pairs.groupBy(*EDGE_KEYS, "place", "child", "parent").agg(F.count(F.lit(1)).alias("rows"))
    counted = pairs.groupBy("edge", "place").agg(F.count(F.lit(1)).alias("parent_count"))
    by_parent = Window.partitionBy("edge", "place").orderBy("parent")
    first = (
        pairs.where(F.col("rows") > 0)
        .withColumn("parent_rn", F.row_number().over(by_parent))
        .where(F.col("parent_rn") <= samples)
        .groupBy(*EDGE_KEYS, "place", "child").agg(F.sort_array(F.collect_list("parent")).alias("parent_values"))
    )
    return first.join(F.broadcast(counted), ["edge", "place"]).select(
        *EDGE_KEYS, (F.col("place") + 1).alias("rn"), F.col("child").alias("child_value"), "parent_values", "parent_count")


def edge_conflicts(df: DataFrame, edges: list[tuple[str, str]], samples: int = MAX_CONFLICT_SAMPLES) -> DataFrame:
    """The first violating children per edge, each with its first parents."""
    return conflict_parents(df, validate_edges(df, edges, samples=samples), edges, samples)


def _chain_edges(matches: list[tuple[str, list[str]]]) -> list[tuple[str, str]]:
    """All (parent, child) edges between neighbouring levels, each once."""
    return sorted({(levels[e], levels[e + 1]) for _, levels in matches for e in range(len(levels) - 1)})


def select_chain(df: DataFrame, matches: list[tuple[str, list[str]]], dataset: str = "dataset", **thresholds) -> DataFrame:
    """The best chain as one row.

    ``matches``: ``(template_key, level columns)``, best template first.  Within
    a template the longest run of edges not rejected counts, the first of equal
    length.  Between templates: longer, then more confident, then better
    matched.  A chain has two levels at least.
    """
    edges = _chain_edges(matches)
    checked = validate_edges(df, edges, **thresholds) if edges else None
    return chain_of(df.sparkSession, matches, checked, dataset)


def chain_of(spark, matches: list[tuple[str, list[str]]], checked: DataFrame | None, dataset: str = "dataset") -> DataFrame:
    """``select_chain`` over edges that are checked already."""
    viable = [(key, levels) for key, levels in matches if len(levels) >= 2]
    places = [
        (t, key, levels, e, levels[e], levels[e + 1])
        for t, (key, levels) in enumerate(viable)
        for e in range(len(levels) - 1)
    ]
    base = spark.range(1).select(F.lit(dataset).alias("dataset"))
    reason = "no template matches two columns" if not viable else "no two levels hold together"
    if not places or checked is None:
        return _unresolved(base, reason)
    positioned = spark.createDataFrame(
        places, "template int, template_key string, levels array<string>, edge_pos int, "
                "parent_column string, child_column string")
    in_template = Window.partitionBy("template").orderBy("edge_pos")
    edges = positioned.join(F.broadcast(checked.drop("edge", "conflict_children")), ["parent_column", "child_column"]).withColumn(
        "island", F.sum(F.when(F.col("status") == "rejected", 1).otherwise(0)).over(in_template))
    rejected = edges.groupBy("template").agg(F.count_if(F.col("status") == "rejected").alias("rejected_edge_count"))
    segments = edges.where("status <> 'rejected'").groupBy("template", "template_key", "levels", "island").agg(
        F.count(F.lit(1)).alias("edge_count"),
        F.min("edge_pos").alias("first"),
        F.avg("edge_confidence").alias("average_confidence"),
        F.count_if(F.col("status") == "retained_with_warning").alias("warned"),
        F.expr("transform(array_sort(collect_list(CASE WHEN status = 'retained_with_warning' THEN named_struct("
               "'p', edge_pos, 'w', concat(parent_column, ' <- ', child_column, ': ', violating_child_count, "
               "' children with several parents')) END)), e -> e.w)").alias("warnings"),
    )
    best_segment = Window.partitionBy("template").orderBy(F.desc("edge_count"), "first")
    candidates = segments.withColumn("rn", F.row_number().over(best_segment)).where("rn = 1").join(
        F.broadcast(rejected), "template")
    # one row per template
    best = candidates.agg(F.expr(
        "max_by(struct(*), struct(edge_count, average_confidence, -template))").alias("c"))
    empty = "CAST(array() AS array<string>)"
    return best.selectExpr(
        f"{sql_string(dataset)} AS dataset",
        "CASE WHEN c IS NULL THEN 'unresolved' WHEN c.warned > 0 THEN 'partial' ELSE 'accepted' END AS status",
        "c.template_key AS template_key",
        f"if(c IS NULL, {empty}, slice(c.levels, c.first + 1, int(c.edge_count) + 1)) AS level_columns",
        "coalesce(c.edge_count, 0L) AS edge_count",
        "coalesce(c.average_confidence, 0D) AS average_confidence",
        "coalesce(c.rejected_edge_count, 0L) AS rejected_edge_count",
        f"if(c IS NULL, array({sql_string(reason)}), c.warnings) AS warnings",
    )


def _unresolved(base: DataFrame, reason: str) -> DataFrame:
    return base.selectExpr(
        "dataset", "'unresolved' AS status", "CAST(NULL AS string) AS template_key",
        "CAST(array() AS array<string>) AS level_columns", "0L AS edge_count", "0D AS average_confidence",
        "0L AS rejected_edge_count", f"array({sql_string(reason)}) AS warnings",
    )


def examine_hierarchy(df: DataFrame, labelled: DataFrame, domain: str,
                      dataset: str = "dataset") -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Match the domain's templates, check their edges, choose one chain: (chain, edges, conflicts).

    All edges of all templates are checked in one pass, settled, and read by the
    chain, by the report of its own edges and by the conflicts of these.
    """
    spark, templates = df.sparkSession, domain_config(domain)["hierarchy_templates"]
    if not templates:
        return _unresolved(spark.range(1).select(F.lit(dataset).alias("dataset")), "no template configured"), None, None
    # a handful of rows: one per configured template
    found = template_matches(labelled, templates).orderBy("rank").select("template_key", "level_columns").collect()
    matches = [(m["template_key"], list(m["level_columns"])) for m in found]
    edges = _chain_edges(matches)
    if not edges:
        return chain_of(spark, matches, None, dataset), None, None
    checked = settled(validate_edges(df, edges))
    chain = settled(chain_of(spark, matches, checked, dataset))
    levels = list(chain.first()["level_columns"])
    own = list(zip(levels, levels[1:], strict=False))
    if not own:
        return chain, None, None
    places = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(own)], "place int, parent_column string, child_column string")
    reported = checked.join(F.broadcast(places), ["parent_column", "child_column"]).withColumn("edge", F.col("place")).drop("place")
    return chain, reported, conflict_parents(df, reported, own)


def build_hierarchy(df: DataFrame, labelled: DataFrame, domain: str, dataset: str = "dataset") -> DataFrame:
    """The chain alone; see ``examine_hierarchy``."""
    return examine_hierarchy(df, labelled, domain, dataset)[0]
