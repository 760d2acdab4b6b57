"""Text forms of column values: canonical text, missing tokens, column keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablelens.config.fixed_values import MISSING_TOKENS

def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def sql_string(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_list(values) -> str:
    return "(" + ", ".join(sql_string(v) for v in values) + ")"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def double_text_sql(value: str) -> str:
    """Plain decimal notation for magnitudes a CSV would spell out.

    ``cast(double as string)`` switches to ``1.0E7`` at 1e7 and ``1.0E-4``
    below 1e-3; a decimal cast keeps the same shortest digits unspoiled.
    """
    size = f"abs({value})"
    spelled = rf"regexp_replace(string(CAST({value} AS decimal(38,18))), '(\\.[0-9]+?)0+$', '$1')"
    return (
        f"CASE WHEN {size} >= 1e7 AND {size} < 1e16 OR {size} >= 1e-4 AND {size} < 1e-3 "
        f"THEN {spelled} ELSE string({value}) END"
    )


def as_text_sql(df: DataFrame, name: str) -> str:
    """The value of a column as a text expression; NaN counts as missing."""
    dtype = df.schema[name].dataType
    column = quoted(name)
    if isinstance(dtype, T.StringType):
        return column
    if isinstance(dtype, T.DoubleType):
        # adding 0.0 folds -0.0 into 0.0, as equality does
        return f"CASE WHEN NOT isnan({column}) THEN {double_text_sql(f'({column} + 0D)')} END"
    if isinstance(dtype, T.FloatType):
        return f"CASE WHEN NOT isnan({column}) THEN string({column} + 0F) END"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return f"to_json({column})"
    return f"string({column})"


def as_text(df: DataFrame, name: str) -> Column:
    return F.expr(as_text_sql(df, name))


def null_if_missing(value: Column) -> Column:
    """Null for every spelling of a missing value."""
    return F.when(~value.isin(*MISSING_TOKENS), value)


def column_key(name: Column) -> Column:
    """Lower-case key with runs of other characters folded to one ``_``."""
    key = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(key == "", F.lit("column")).otherwise(key)


def unique_column_keys(names: DataFrame) -> DataFrame:
    """Add ``normalized_key`` to a ``(dataset, pos, name)`` relation.

    The first column of a key keeps it, later ones get ``_1``, ``_2``, ...
    """
    keyed = names.withColumn("base_key", column_key(F.col("name")))
    repeat = F.row_number().over(Window.partitionBy("dataset", "base_key").orderBy("pos")) - 1
    return keyed.withColumn(
        "normalized_key",
        F.when(repeat > 0, F.concat_ws("_", "base_key", repeat.cast("string"))).otherwise(F.col("base_key")),
    )


def duplicate_column_keys(names: DataFrame) -> DataFrame:
    """Keys more than one column of a dataset maps to."""
    keyed = names.withColumn("base_key", column_key(F.col("name")))
    return keyed.groupBy("dataset", "base_key").agg(F.count(F.lit(1)).alias("columns")).where("columns > 1")
