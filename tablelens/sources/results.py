"""Result tables: one Parquet directory each, partitioned by run and attempt.

A run may be tried several times.  Each attempt writes into folders of its own,
which nobody reads until one row in the table ``runs`` says that it completed:
that row publishes all tables of the attempt at once.  A reader takes, for every
run, the attempt that completed last; what a failed attempt left is never seen.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.errors import ProfileError

TABLES = [
    "runs", "dataset_profiles", "column_profiles", "secondary_domains", "column_categories", "hierarchy_chains",
    "hierarchy_edges", "hierarchy_conflicts", "quality_assessments", "overall_quality", "readiness_assessments",
    "chart_specifications", "chart_data", "rule_evaluations", "rule_suggestions", "drill_down_cubes",
]
STATUS_ORDER = ["pending", "processing", "completed", "failed"]
FIRST_ATTEMPT = "first"


def _folder(root: str, table: str, run_id: str, attempt: str | None) -> str:
    """The folder of an attempt, as Spark itself names partitions."""
    def escaped(value: str) -> str:
        return re.sub(r"[^\w .-]", lambda c: f"%{ord(c[0]):02X}", value)

    return f"{root}/{table}/run_id={escaped(run_id)}" + (f"/attempt={escaped(attempt)}" if attempt is not None else "")


def write_result(df: DataFrame, root: str, table: str, run_id: str, extra_partitions: list[str] | None = None,
                 attempt: str = FIRST_ATTEMPT) -> None:
    """Write the rows of one attempt to a result table; an attempt written again replaces its rows.

    Status rows are the exception: they add up.
    """
    if table not in TABLES:
        raise ValueError(f"unknown result table {table}")
    if table == "quality_assessments":
        df = df.withColumn("display_score", F.round(F.col("score") * 100, 2))
    # rows keep the run's name: of a folder's name Spark would make a number where it can
    df = df.drop("run_id", "attempt").withColumn("run_key", F.lit(run_id))
    if table == "runs":
        df.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(_folder(root, table, run_id, None))
        return
    # the folder is replaced whole, with partitions that this writing no longer has
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*extra_partitions) if extra_partitions else writer).parquet(_folder(root, table, run_id, attempt))


def _named(df: DataFrame) -> DataFrame:
    """Rows under the run's own name."""
    return df.drop("run_id").withColumnRenamed("run_key", "run_id")


def record_status(spark: SparkSession, root: str, run_id: str, status: str, domain: str, source: str = "",
                  row_count: int | None = None, column_count: int | None = None,
                  secondary_domain: str | None = None, error_code: str | None = None,
                  error_message: str | None = None, attempt: str = FIRST_ATTEMPT) -> None:
    """Append a status row; the newest row of a run is its state, a completed one publishes its attempt."""
    if status not in STATUS_ORDER:
        raise ValueError(f"unknown status {status}")
    row = spark.range(1).select(
        F.lit(status).alias("status"), F.current_timestamp().alias("at"),
        F.lit(STATUS_ORDER.index(status)).alias("step"), F.lit(domain).alias("primary_domain"),
        F.lit(source).alias("source"), F.lit(row_count).cast("bigint").alias("row_count"),
        F.lit(column_count).cast("int").alias("column_count"),
        F.lit(secondary_domain).cast("string").alias("secondary_domain"),
        F.lit(error_code).cast("string").alias("error_code"),
        F.lit(error_message).cast("string").alias("error_message"),
    )
    write_result(row, root, "runs", run_id, attempt=attempt)


def run_rows(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """All status rows, of one run or of every run."""
    return _named(spark.read.parquet(f"{root}/runs" if run_id is None else _folder(root, "runs", run_id, None)))


def run_states(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """The newest status row of every run; of rows of one instant, the later step."""
    rows = run_rows(spark, root, run_id)
    newest = F.max_by(F.struct(*[c for c in rows.columns if c != "run_id"]), F.struct("at", "step")).alias("r")
    return rows.groupBy("run_id").agg(newest).select("run_id", "r.*")


def published(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """``(run_id, attempt)``: the attempt of each run that completed last."""
    done = run_rows(spark, root, run_id).where("status = 'completed'")
    return done.groupBy("run_id").agg(F.max_by("attempt", "at").alias("attempt"))


def read_result(spark: SparkSession, root: str, table: str, run_id: str | None = None) -> DataFrame:
    """A result table as far as it is published; one run's rows come from its own partition alone.

    """
    if table == "runs":
        return run_rows(spark, root, run_id)
    if run_id is not None:
        taken = published(spark, root, run_id).first()
        if taken is None:
            raise ProfileError("RUN_NOT_PUBLISHED", f"no attempt of run {run_id!r} has completed", {"run_id": run_id})
        # the run's own folder: no other is listed
        return _named(spark.read.parquet(_folder(root, table, run_id, taken["attempt"])))
    # attempts, which are partitions, prune at run time, however many runs there are
    rows = _named(spark.read.parquet(f"{root}/{table}"))
    return rows.join(published(spark, root), ["run_id", "attempt"], "left_semi").drop("attempt")


def _orderable(field: T.StructField) -> str:
    """A column as it can be sorted and written as JSON: no maps, and null for what is no number."""
    name = f"`{field.name}`"
    if isinstance(field.dataType, T.MapType):
        return f"map_entries({name}) AS {name}"
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return f"if(isnan({name}) OR abs({name}) = double('infinity'), CAST(NULL AS double), {name}) AS {name}"
    return name


def _existing(spark: SparkSession, root: str, table: str, run_id: str) -> DataFrame | None:
    try:
        return read_result(spark, root, table, run_id)
    except ProfileError:
        raise
    except Exception as error:
        # a table that no run has written yet
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


# What the rows of a table are listed by.
_LISTED_BY = {
    "column_profiles": ["pos"], "column_categories": ["pos"], "quality_assessments": ["ord"], "readiness_assessments": ["assessment_type"],
    "chart_specifications": ["ord"], "chart_data": ["chart_key", "position"], "rule_evaluations": ["ord"], "rule_suggestions": ["suggestion_id"],
    "hierarchy_edges": ["edge"], "hierarchy_conflicts": ["edge", "rn"], "drill_down_cubes": ["level_depth"],
}


def read_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """All results of a published run as one row: its state, and a list of structs per table.

    Every table is read from the run's own partition, and a run's tables are
    bounded by the columns, rules and charts of one table and the bounds of its
    cubes.  ``json`` holds the same as one JSON document.
    """
    record = run_states(spark, root, run_id).drop("step", "attempt")
    held = []
    for table in TABLES[1:]:
        rows = _existing(spark, root, table, run_id)
        if rows is None:
            continue
        fields = [f for f in rows.schema.fields if f.name != "run_id"]
        keys = [f"`{c}`" for c in _LISTED_BY.get(table, []) if c in rows.columns]
        own = ", ".join(f"'{f.name}', `{f.name}`" for f in fields)
        back = ", ".join(f"'{f.name}', " + (f"map_from_entries(e.own.`{f.name}`)" if isinstance(f.dataType, T.MapType) else f"e.own.`{f.name}`")
                         for f in fields)
        entry = f"struct({', '.join([*keys, f'named_struct({own}) AS own'])})"
        listed = rows.selectExpr("run_id", *[_orderable(f) for f in fields]).groupBy("run_id").agg(
            F.expr(f"transform(array_sort(collect_list({entry})), e -> named_struct({back}))").alias(table))
        record = record.join(listed, "run_id", "left")
        held.append(table)
    document = F.to_json(F.struct(*[F.col(c) for c in record.columns]))
    return record.withColumn("json", document)


def write_suggestions(suggestions: DataFrame, root: str, run_id: str, attempt: str = FIRST_ATTEMPT) -> None:
    """Rule suggestions of a run: ``(suggestion_id, rule_key, type, ..., status)``."""
    for needed in ("suggestion_id", "status"):
        if needed not in suggestions.columns:
            raise ValueError(f"suggestions need a column {needed}")
    write_result(suggestions, root, "rule_suggestions", run_id, attempt=attempt)


def list_suggestions(suggestions: DataFrame, run_id: str | None = None, status: str | None = None) -> DataFrame:
    if run_id is not None:
        suggestions = suggestions.where(F.col("run_id") == run_id)
    return suggestions if status is None else suggestions.where(F.col("status") == status)
