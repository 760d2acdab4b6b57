"""Many tables at once: one job counts the values of all of them.

The cells of all tables go through one shuffle, told apart by a position that
runs through the whole catalogue.  Labels, roles, rules and metadata are
relations keyed by data set, so what follows the counting costs one job for a
catalogue and not one per table.  Only the checks of hierarchies, which look at
columns of one table side by side, are planned per table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.config.fixed_values import MAX_SAMPLE_VALUES
from tablelens.operators import categories, hierarchy, labels, quality, readiness, rules
from tablelens.operators.frequencies import count_values, has_long_text, text_cells, typed_form
from tablelens.operators.profile import profile_of
from tablelens.sources.settle import settled
from tablelens.sources.tables import check_domain, check_table

ROLE_PREFIXES = ("target", "left", "right")


@dataclass
class Catalogue:
    """Results of all data sets; every table has a column ``dataset``."""

    column_profiles: DataFrame
    grains: DataFrame
    role_maps: DataFrame
    column_categories: DataFrame
    secondary_domains: DataFrame
    hierarchy_chains: DataFrame
    rule_evaluations: DataFrame
    quality_assessments: DataFrame
    overall_quality: DataFrame
    readiness_assessments: DataFrame


def _together(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def catalogue_profile(tables: dict[str, DataFrame], max_values: int = MAX_SAMPLE_VALUES) -> DataFrame:
    """The profile of every column of every table, by ``(dataset, pos)``; one job, one shuffle of the cells."""
    spark, names, cells, texts, offset = next(iter(tables.values())).sparkSession, [], [], [], 0
    for dataset, df in tables.items():
        names += [(dataset, i, name, dtype, offset + i) for i, (name, dtype) in enumerate(df.dtypes)]
        cells.append(typed_form(df, offset=offset))
        long_cells = text_cells(df, offset)
        texts += [] if long_cells is None else [long_cells]
        offset += len(df.columns)
    long_texts = any(has_long_text(df, name) for df in tables.values() for name in df.columns)
    relation = spark.createDataFrame(names, "dataset string, pos int, name string, dtype string, cell_pos int")
    return profile_of(relation, count_values(_together(cells), long_texts), _together(texts) if texts else None, max_values)


def catalogue_labels(tables: dict[str, DataFrame]) -> DataFrame:
    """Type, identifier and role of every column of every table."""
    return labels.label_columns(catalogue_profile(tables))


def catalogue_metadata(spark: SparkSession, metadata: list[dict] | None) -> DataFrame:
    """``(dataset, column_name, description, mandatory, expected_unique)`` of dicts with these keys."""
    rows = [(m["dataset"], m["column_name"], m.get("description"), bool(m.get("mandatory")), bool(m.get("expected_unique")))
            for m in metadata or []]
    return spark.createDataFrame(rows, "dataset string, column_name string, description string, mandatory boolean, expected_unique boolean")


def resolve_rules(asked: dict[str, list[dict]], role_maps: DataFrame) -> dict[str, list[dict]]:
    """Rules of each data set with their roles replaced by columns.

    One join of (data set, role) with the role maps of all data sets; what comes
    to the driver is bounded by the number of rules.
    """
    wanted = [(dataset, i, prefix, rule[f"{prefix}_role"])
              for dataset, some in asked.items() for i, rule in enumerate(some) for prefix in ROLE_PREFIXES if rule.get(f"{prefix}_role")]
    if not wanted:
        return asked
    roles = role_maps.sparkSession.createDataFrame(wanted, "dataset string, place int, prefix string, candidate_semantic_type string")
    found = roles.join(role_maps, ["dataset", "candidate_semantic_type"]).select("dataset", "place", "prefix", "physical_name").collect()
    columns = {(r["dataset"], r["place"], r["prefix"]): r["physical_name"] for r in found}
    out = {}
    for dataset, some in asked.items():
        out[dataset] = [
            {**rule, **{f"{p}_column": columns[dataset, i, p] for p in ROLE_PREFIXES
                        if (dataset, i, p) in columns and not rule.get(f"{p}_column")}}
            for i, rule in enumerate(some)]
    return out


def catalogue_run(tables: dict[str, DataFrame], domains: dict[str, str], metadata: list[dict] | None = None,
                  request_rules: list[dict] | None = None, decisions: DataFrame | None = None,
                  value_lists: dict[str, DataFrame] | None = None) -> Catalogue:
    """Profile, label, check and score a catalogue.

    ``domains`` names the domain of every table; entries of ``metadata`` and
    ``request_rules`` name theirs in ``dataset``; ``value_lists`` are tables that
    rules name in ``values_from``.  The results are those of a ``run`` of each table.
    """
    spark = next(iter(tables.values())).sparkSession
    for dataset, df in tables.items():
        check_domain(domains[dataset])
        check_table(df)
    labelled = settled(catalogue_labels(tables))
    notes = catalogue_metadata(spark, metadata)
    decided = labels.described(labels.confirmed_roles(labelled, decisions), notes.withColumnRenamed("column_name", "physical_name"))

    # as many parts as there are domains in use, four at most
    parts = [(domain, labelled.where(F.col("dataset").isin([d for d in tables if domains[d] == domain]))) for domain in sorted(set(domains[d] for d in tables))]
    category_result = _together([categories.data_categories(part, domain) for domain, part in parts])
    domain_result = settled(_together([categories.secondary_domain(part, domain) for domain, part in parts]))
    chain = _together([hierarchy.examine_hierarchy(df, labelled.where(F.col("dataset") == dataset), domains[dataset], dataset)[0]
                       for dataset, df in tables.items()])

    secondary = {r["dataset"]: r["domain_name"] for r in domain_result.select("dataset", "domain_name").collect()}
    asked = {d: rules.domain_rules(domains[d], secondary.get(d)) + rules.request_rules([r for r in request_rules or [] if r.get("dataset") == d])
             for d in tables}
    role_maps = settled(labels.role_map(labelled))
    resolved = resolve_rules(asked, role_maps)
    # one job for the rules of all tables
    rule_results = settled(_together([rules.evaluate_rules(df, resolved[d], {}, d, value_lists) for d, df in tables.items()]))

    semantic = quality.semantic_quality(decided, category_result, domain_result, chain)
    dimensions = settled(quality.quality_dimensions(
        labelled, rule_results, semantic, notes.where("mandatory").select("dataset", "column_name"),
        notes.where("expected_unique").select("dataset", "column_name"), labelled.select("dataset").distinct()))
    described = notes.where("description != ''").groupBy("dataset").agg(F.count(F.lit(1)).alias("described"))
    return Catalogue(
        column_profiles=decided, grains=labels.grain(labelled), role_maps=role_maps, column_categories=category_result,
        secondary_domains=domain_result, hierarchy_chains=chain, rule_evaluations=rule_results, quality_assessments=dimensions,
        overall_quality=quality.overall_quality(dimensions), readiness_assessments=readiness.readiness(labelled, dimensions, described),
    )
