"""A complete run: profile, label, check, score, chart and write."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.config.domains import chart_templates
from tablelens.operators import categories, charts, cubes, hierarchy, labels, quality, readiness, rules
from tablelens.operators.dataset import dataset_profile
from tablelens.operators.profile import column_profile
from tablelens.sources.results import record_status, write_result
from tablelens.sources.settle import settled
from tablelens.sources.tables import check_domain, check_table, read_table


@dataclass
class ProfileRun:
    """The result tables of one run; all but the table itself are small."""

    run_id: str
    dataset: str
    domain: str
    dataset_profiles: DataFrame
    column_profiles: DataFrame
    secondary_domains: DataFrame
    column_categories: DataFrame
    hierarchy_chains: DataFrame
    rule_evaluations: DataFrame
    quality_assessments: DataFrame
    overall_quality: DataFrame
    readiness_assessments: DataFrame
    chart_specifications: DataFrame
    chart_data: DataFrame | None = None
    drill_down_cubes: DataFrame | None = None
    hierarchy_edges: DataFrame | None = None
    hierarchy_conflicts: DataFrame | None = None
    levels: list[str] = field(default_factory=list)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: value for f in fields(self)
                if isinstance(value := getattr(self, f.name), DataFrame)}

    def write(self, root: str) -> None:
        """Write all tables as a new attempt and publish it."""
        spark, attempt = self.column_profiles.sparkSession, f"a{uuid.uuid4().hex}"
        with recorded(spark, root, self.run_id, attempt, self.domain, self.dataset) as state:
            self._write_attempt(root, attempt, state)

    def _write_attempt(self, root: str, attempt: str, state: dict) -> None:
        for name, df in self.tables().items():
            write_result(df, root, name, self.run_id, ["level_depth"] if name == "drill_down_cubes" else None, attempt)
        size = self.dataset_profiles.select("row_count", "column_count").first()
        named = self.secondary_domains.select("domain_name").first()
        state.update(row_count=size["row_count"], column_count=size["column_count"], secondary_domain=named["domain_name"] if named else None)


class recorded:
    """Status rows around an attempt: pending, processing, then completed or failed with its code.

    The row that says ``completed`` comes last and publishes the attempt.
    """

    def __init__(self, spark: SparkSession, root: str, run_id: str, attempt: str, domain: str, source: str):
        self.place, self.about, self.state = (spark, root, run_id), {"domain": domain, "source": source, "attempt": attempt}, {}

    def __enter__(self) -> dict:
        record_status(*self.place, "pending", **self.about)
        record_status(*self.place, "processing", **self.about)
        return self.state

    def __exit__(self, kind, error, trace) -> None:
        if error is None:
            record_status(*self.place, "completed", **self.about, **self.state)
        elif isinstance(error, Exception):
            record_status(*self.place, "failed", **self.about, error_code=getattr(error, "code", "PROCESSING_ERROR"), error_message=str(error))


def run_and_write(spark: SparkSession, root: str, source: DataFrame | str, domain: str, dataset: str = "dataset",
                  run_id: str | None = None, read_options: dict | None = None, **inputs) -> ProfileRun:
    """Read, run and write under one record, so that a failure anywhere is on it.

    ``source`` is a table or the path of one.  A failed run may be tried again
    under its ``run_id``; until an attempt completes nobody reads any of it.
    """
    run_id, attempt = run_id or str(uuid.uuid4()), f"a{uuid.uuid4().hex}"
    with recorded(spark, root, run_id, attempt, domain, dataset) as state:
        df = read_table(spark, source, **(read_options or {})) if isinstance(source, str) else source
        done = run(df, domain, dataset, run_id=run_id, **inputs)
        done._write_attempt(root, attempt, state)
    return done


def metadata_relation(spark: SparkSession, metadata: list[dict] | None, dataset: str) -> DataFrame:
    rows = [(dataset, m["column_name"], m.get("description"), bool(m.get("mandatory")), bool(m.get("expected_unique")))
            for m in metadata or []]
    return spark.createDataFrame(
        rows, "dataset string, physical_name string, description string, mandatory boolean, expected_unique boolean")


def chart_specs(labelled: DataFrame, domain: str, levels: list[str]) -> DataFrame:
    """The charts of a table: those of its columns' roles, then those of the domain's and the common templates.

    A chart the roles already give is not drawn a second time.
    """
    templates = chart_templates(domain)
    own = charts.chart_candidates(labelled, levels).drop("rank").withColumn("source", F.lit(0))
    more = charts.template_charts(labelled, templates["domain"], levels).withColumn("source", F.lit(1))
    common = charts.profiling_charts(labelled, templates["profiling"]).withColumn("source", F.lit(2))
    every = own.unionByName(more).unionByName(common)
    # a few dozen rows a data set
    return every.selectExpr(
        "*", "row_number() OVER (PARTITION BY dataset, chart_key ORDER BY source, ord) AS again",
    ).where("again = 1").selectExpr(
        "* EXCEPT (again, source, ord)", "int(row_number() OVER (PARTITION BY dataset ORDER BY source, ord)) - 1 AS ord",
    ).selectExpr("*", "ord + 1 AS rank")


def run(df: DataFrame, domain: str, dataset: str = "dataset", metadata: list[dict] | None = None,
        request_rules: list[dict] | None = None, decisions: DataFrame | None = None,
        run_id: str | None = None, cube_bounds: dict | None = None, value_lists: dict[str, DataFrame] | None = None) -> ProfileRun:
    """Profile a table end to end.

    The profile (one row per column) is settled once; labels, quality and
    readiness are projections over it.  Only names that decide which jobs to
    build come to the driver: roles, chain levels, chart specifications.
    ``cube_bounds`` are the bounds of ``cube_cells``, ``value_lists`` the tables
    that rules name in ``values_from``.
    """
    check_domain(domain)
    check_table(df)
    return run_labelled(df, settled(labels.label_columns(column_profile(df, dataset))), domain, dataset, metadata, request_rules,
                        decisions, run_id, cube_bounds, value_lists)


def run_labelled(df: DataFrame, labelled: DataFrame, domain: str, dataset: str, metadata: list[dict] | None = None,
                 request_rules: list[dict] | None = None, decisions: DataFrame | None = None,
                 run_id: str | None = None, cube_bounds: dict | None = None, value_lists: dict[str, DataFrame] | None = None) -> ProfileRun:
    """``run`` from a labelled profile on."""
    spark = df.sparkSession
    metadata = metadata or []
    mandatory = [m["column_name"] for m in metadata if m.get("mandatory")]
    unique = [m["column_name"] for m in metadata if m.get("expected_unique")]
    described = sum(1 for m in metadata if m.get("description"))

    grain = labels.grain(labelled)
    decided = labels.described(labels.confirmed_roles(labelled, decisions), metadata_relation(spark, metadata, dataset))
    domain_result = settled(categories.secondary_domain(labelled, domain))
    category_result = categories.data_categories(labelled, domain)
    chain, edges, conflicts = hierarchy.examine_hierarchy(df, labelled, domain, dataset)

    named = domain_result.select("domain_name").first()
    secondary = named["domain_name"] if named else None
    role_map = {r["candidate_semantic_type"]: r["physical_name"] for r in labels.role_map(labelled).collect()}
    to_check = rules.domain_rules(domain, secondary) + rules.request_rules(request_rules)
    rule_results = settled(rules.evaluate_rules(df, to_check, role_map, dataset, value_lists))

    semantic = quality.semantic_quality(decided, category_result, domain_result, chain)
    dimensions = settled(quality.quality_dimensions(labelled, rule_results, semantic, mandatory, unique, dataset))

    levels = list(chain.select("level_columns").first()["level_columns"])
    specs = settled(chart_specs(labelled, domain, levels))
    data = None
    for spec in specs.orderBy("ord").collect():
        spec = spec.asDict()
        if spec["chart_key"] == "missing_values_by_column":
            part = charts.missing_values(labelled)
        elif spec["chart_key"] == "quality_score_by_dimension":
            part = charts.quality_scores(dimensions)
        elif spec["chart_key"] == "rule_violations_by_rule":
            part = charts.rule_violations(rule_results)
        else:
            part = charts.chart_data(df, spec)
        if part is not None:
            part = part.select(F.lit(spec["chart_key"]).alias("chart_key"), "position", "label", "value")
            data = part if data is None else data.unionByName(part)

    metric = labelled.where("candidate_role = 'metric'").orderBy("pos").select("physical_name").first()
    built = len(levels) >= 2 and metric is not None
    return ProfileRun(
        run_id=run_id or str(uuid.uuid4()), dataset=dataset, domain=domain,
        dataset_profiles=settled(dataset_profile(df, dataset).join(grain.select("dataset", "inferred_grain"), "dataset", "left")),
        column_profiles=decided,
        secondary_domains=domain_result,
        column_categories=category_result,
        hierarchy_chains=chain,
        rule_evaluations=rule_results,
        quality_assessments=dimensions,
        overall_quality=quality.overall_quality(dimensions),
        readiness_assessments=readiness.readiness(labelled, dimensions, described),
        chart_specifications=specs,
        chart_data=data,
        drill_down_cubes=cubes.cubes(df, levels, metric["physical_name"], **(cube_bounds or {})) if built else None,
        hierarchy_edges=edges,
        hierarchy_conflicts=conflicts,
        levels=levels,
    )
