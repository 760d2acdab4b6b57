"""Dataset-level profile: size, duplicate rows, data volume, all from one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.text import as_text, quoted, unique_column_keys
from tablelens.operators.frequencies import column_names


def _row_key(df: DataFrame, name: str) -> Column:
    """A column as grouping key: texts and bytes by digest, nested values by that of their text."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.unhex(F.sha2(F.col(quoted(name)).cast("binary"), 256))
    if isinstance(dtype, (T.MapType, T.ArrayType, T.StructType)):
        return F.unhex(F.sha2(F.to_json(F.col(quoted(name))), 256))
    return F.col(quoted(name))


def row_bytes(df: DataFrame) -> Column:
    """Bytes of all values of a row in text form."""
    cells = [F.coalesce(F.octet_length(as_text(df, name)), F.lit(0)).cast("bigint") for name in df.columns]
    total = cells[0]
    for cell in cells[1:]:
        total = total + cell
    return total


def row_groups(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(copies, data_bytes)``: one row per distinct row of the table; null equals null."""
    columns = columns or df.columns
    keys = [f"k{i}" for i in range(len(columns))]
    keyed = df.select(*[_row_key(df, name).alias(key) for key, name in zip(keys, columns, strict=True)], row_bytes(df).alias("bytes"))
    return keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.sum("bytes").alias("data_bytes"))


def row_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, rows beyond the first of each distinct row, and bytes of all values in text form."""
    return row_groups(df, columns).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_row_count"),
        F.coalesce(F.sum("data_bytes"), F.lit(0)).alias("data_bytes"),
    )


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of each distinct row."""
    return row_counts(df, columns).select("row_count", "duplicate_row_count")


def dataset_profile(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """One row: rows, columns, duplicate rows, volume (stands in for a memory estimate), column keys."""
    keys = unique_column_keys(column_names(df, dataset)).groupBy("dataset").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "normalized_key"))), lambda s: s["normalized_key"])
        .alias("normalized_keys"),
        F.array_sort(F.collect_set(F.when(F.col("normalized_key") != F.col("base_key"), F.col("base_key"))))
        .alias("duplicate_keys"),
    )
    # one row per side, joined on the dataset name
    return (
        row_counts(df).select(F.lit(dataset).alias("dataset"), "*")
        .join(keys, "dataset")
        .withColumn("column_count", F.lit(len(df.columns)))
    )
