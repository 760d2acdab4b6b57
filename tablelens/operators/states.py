"""Mergeable profile states: new data is added without reading the old again.

A state is one row per column with exact counts and sums, and two of Spark's own
sketches as binary columns: HyperLogLog for distinct values, KLL for quantiles.
States of parts (days, partitions, sources) add up to the state of the whole;
counts, sums, extremes and lengths are exact whatever the parts, distinct counts
and quantiles hold within the sketches' stated errors, and a standard deviation
loses digits where the mean is large beside it.

This is the path for data that keeps coming; ``column_profile`` is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.parsing import number_sql
from tablelens.operators.frequencies import column_names, long_form

#: Bits of the HyperLogLog; its standard error is 1.04 / sqrt(2 ** bits), about 1.6 % at 12.
DISTINCT_BITS = 12
#: Items a KLL sketch keeps; its rank error is about 1.33 % at 200 and falls with it.
QUANTILE_ITEMS = 400
#: Three standard errors of a distinct count, relative, and the error of a quantile's rank.
DISTINCT_ERROR = 3 * 1.04 / 2 ** (DISTINCT_BITS / 2)
RANK_ERROR = 0.01
QUARTILES = (0.25, 0.5, 0.75)

_SUMS = ["row_count", "non_null_count", "num_count", "num_sum", "num_squares", "length_sum"]
_LEAST, _MOST = ["num_min", "length_min"], ["num_max", "length_max"]


def column_states(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """One row per column: counts, sums, extremes and the sketches of its values.

    One scan and one aggregation that combines map-side; what is shuffled is a
    few kilobytes per column and task.
    """
    cells = long_form(df).withColumn("num", F.expr(number_sql("text")))
    found = cells.groupBy("pos").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("text").alias("non_null_count"), F.count("num").alias("num_count"),
        F.sum("num").alias("num_sum"), F.sum(F.col("num") * F.col("num")).alias("num_squares"),
        F.sum(F.char_length("text")).alias("length_sum"), F.min("num").alias("num_min"), F.min(F.char_length("text")).alias("length_min"),
        F.max("num").alias("num_max"), F.max(F.char_length("text")).alias("length_max"),
        F.hll_sketch_agg("text", F.lit(DISTINCT_BITS)).alias("distinct_sketch"),
        F.kll_sketch_agg_double("num", F.lit(QUANTILE_ITEMS)).alias("quantile_sketch"),
    )
    return column_names(df, dataset).join(F.broadcast(found), "pos", "left")


def merged_states(states: DataFrame) -> DataFrame:
    """States of parts as the states of the whole, by data set and column name."""
    sums = [F.sum(c).alias(c) for c in _SUMS] + [F.min(c).alias(c) for c in _LEAST] + [F.max(c).alias(c) for c in _MOST]
    return states.groupBy("dataset", "name").agg(
        F.min("pos").alias("pos"), F.max_by("dtype", "pos").alias("dtype"), *sums,
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch", F.lit(QUANTILE_ITEMS)).alias("quantile_sketch"),
    )


def state_profile(states: DataFrame) -> DataFrame:
    """The statistics a state holds: exact ones, and ``distinct_estimate``, ``q25``, ``q50``, ``q75``."""
    numbers = F.col("num_count") > 0
    spread = F.col("num_squares") - F.col("num_sum") * F.col("num_sum") / F.col("num_count")
    quantile = [F.when(numbers, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(p))).alias(f"q{round(100 * p)}") for p in QUARTILES]
    return states.select(
        "dataset", "pos", F.col("name").alias("physical_name"), F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("non_null_count", F.lit(0)).alias("non_null_count"),
        (F.coalesce("row_count", F.lit(0)) - F.coalesce("non_null_count", F.lit(0))).alias("null_count"),
        F.coalesce("num_count", F.lit(0)).alias("num_count"),
        F.col("num_min").alias("min_value"), F.col("num_max").alias("max_value"),
        F.when(numbers, F.col("num_sum") / F.col("num_count")).alias("mean"),
        F.when(F.col("num_count") == 1, 0.0).when(numbers, F.sqrt(F.greatest(spread, F.lit(0.0)) / (F.col("num_count") - 1))).alias("std_dev"),
        F.col("length_min").alias("min_string_length"), F.col("length_max").alias("max_string_length"),
        (F.col("length_sum") / F.nullif(F.col("non_null_count"), F.lit(0))).alias("avg_string_length"),
        F.coalesce(F.hll_sketch_estimate("distinct_sketch"), F.lit(0)).alias("distinct_estimate"), *quantile,
    )
