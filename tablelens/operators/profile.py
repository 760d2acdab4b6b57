"""Column profile: one row per column with every statistic the labels need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.config.fixed_values import MAX_SAMPLE_VALUES
from tablelens.functions.parsing import (
    BOOLEAN_BIT,
    DATE_BITS,
    FLAG_BITS,
    PATTERN_BITS,
    PATTERN_LABELS,
    detector_patterns,
    starts_with_match,
)
from tablelens.functions.text import as_text, sql_list, unique_column_keys
from tablelens.operators.frequencies import (
    column_frequencies,
    column_names,
    first_values,
    read_numbers,
    read_values,
    text_cells,
)
from tablelens.operators.quantiles import center_sql, quantile_ctes, slice_sql

MAX_PATTERNS = 5


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0.0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def ratio_sql(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {part} / {whole} ELSE 0D END"


def dominant_sql(counts: str, labels: list[str], total: str, limit: int = MAX_PATTERNS) -> str:
    """Labels of more than half the values, most frequent first, list order on ties."""
    names = f"array{sql_list(labels)}"
    entries = f"transform({counts}, (n, i) -> named_struct('n', -n, 'i', i, 'label', {names}[i]))"
    kept = f"filter({entries}, e -> {ratio_sql('-e.n', total)} > 0.5D)"
    return f"transform(slice(array_sort({kept}), 1, {limit}), e -> e.label)"


def _bits_sql(bits: slice) -> str:
    return f"slice(shape_counts, {bits.start + 1}, {bits.stop - bits.start})"


_QUANTILES = f"""
numbers AS (SELECT *, {slice_sql('num')} AS slice FROM {{numbers}}),
slices AS (
  SELECT pos, slice, sum(num_count) AS num_count, sum(num_distinct) AS num_distinct, min(num_min) AS num_min, max(num_max) AS num_max
  FROM sums GROUP BY pos, slice
),
{quantile_ctes('numbers', 'slices')},"""
_SUMMED = ["pos", "slice", "flags", "row_count", "null_count", "distinct_count", "num_count", "num_distinct", "num_min", "num_max",
           "num_sum", "num_spread", "length_min", "length_max", "length_sum"]
_STATISTICS = f"""
WITH sliced AS (SELECT *, {slice_sql('num')} AS slice FROM {{read}}),
values AS (SELECT *, num - {center_sql('slice')} AS off FROM sliced),
-- per column, numeric slice and shape: a few thousand rows a column
summed AS (
  SELECT pos, slice, flags,
         sum(cnt) AS row_count,
         sum(if(length IS NULL, cnt, 0L)) AS null_count,
         sum(if(length IS NULL, 0L, 1L)) AS distinct_count,
         sum(if(num IS NULL, 0L, cnt)) AS num_count,
         sum(if(num IS NULL, 0L, 1L)) AS num_distinct,
         min(num) AS num_min, max(num) AS num_max,
         sum(num * cnt) AS num_sum,
         -- deviations from a value of the slice itself lose no digits
         sum(off * off * cnt) AS num_spread,
         min(length) AS length_min, max(length) AS length_max, sum(length * cnt) AS length_sum
  FROM values GROUP BY pos, slice, flags
),
-- out of a generator, so that the statistics and the slices share one shuffle of them
sums AS (
  SELECT inline(array(named_struct({', '.join(f"'{name}', {name}" for name in _SUMMED)}))) FROM summed
),
QUANTILE_CTES
centered AS (
  SELECT *, sum(num_sum) OVER (PARTITION BY pos) / nullif(sum(num_count) OVER (PARTITION BY pos), 0) AS mean,
         num_sum / nullif(num_count, 0) AS slice_mean
  FROM sums
),
shapes AS (
  SELECT pos, flags, sum(row_count) AS row_count, sum(null_count) AS null_count,
         sum(distinct_count) AS distinct_count, sum(num_count) AS num_count, sum(length_sum) AS length_sum,
         min(num_min) AS num_min, max(num_max) AS num_max, max(mean) AS mean,
         min(length_min) AS length_min, max(length_max) AS length_max,
         sum(num_spread
             - num_count * (slice_mean - {center_sql('slice')}) * (slice_mean - {center_sql('slice')})
             + num_count * (slice_mean - mean) * (slice_mean - mean)) AS deviations
  FROM centered GROUP BY pos, flags
),
-- a column has a handful of shapes, whatever its size
columns AS (
  SELECT pos, sum(row_count) AS row_count, sum(null_count) AS null_count, sum(distinct_count) AS distinct_count,
         sum(num_count) AS num_count, sum(length_sum) AS length_sum, min(num_min) AS num_min, max(num_max) AS num_max,
         max(mean) AS mean, min(length_min) AS length_min, max(length_max) AS length_max,
         sum(deviations) AS deviations, collect_list(named_struct('flags', flags, 'n', row_count)) AS shapes
  FROM shapes GROUP BY pos
),
counted AS (
  SELECT c.*, c.row_count - c.null_count AS non_null_count, q.quantiles,
         transform(sequence(0, {FLAG_BITS - 1}), bit ->
           aggregate(filter(c.shapes, e -> getbit(e.flags, bit) = 1), 0L, (added, e) -> added + e.n)) AS shape_counts
  FROM columns c LEFT JOIN quantiles q ON c.pos = q.pos
),
rated AS (
  SELECT *, {ratio_sql('num_count', 'non_null_count')} AS numeric_parse_ratio,
         {ratio_sql('null_count', 'row_count')} AS null_ratio,
         {ratio_sql('distinct_count', 'non_null_count')} AS cardinality_ratio
  FROM counted
)
SELECT pos, row_count, non_null_count, null_count, null_ratio, distinct_count, cardinality_ratio,
       greatest(non_null_count - distinct_count, 0L) AS duplicate_count,
       if(numeric_parse_ratio > 0.5, num_min, NULL) AS min_value,
       if(numeric_parse_ratio > 0.5, num_max, NULL) AS max_value,
       if(numeric_parse_ratio > 0.5, mean, NULL) AS mean,
       if(numeric_parse_ratio > 0.5, quantiles[1], NULL) AS median,
       CASE WHEN numeric_parse_ratio > 0.5 AND num_count = 1 THEN 0D
            WHEN numeric_parse_ratio > 0.5 THEN sqrt(greatest(deviations, 0D) / (num_count - 1)) END AS std_dev,
       if(numeric_parse_ratio > 0.5, quantiles[0], NULL) AS q25,
       if(numeric_parse_ratio > 0.5, quantiles[1], NULL) AS q50,
       if(numeric_parse_ratio > 0.5, quantiles[2], NULL) AS q75,
       length_min AS min_string_length, length_max AS max_string_length,
       length_sum / nullif(non_null_count, 0) AS avg_string_length,
       {ratio_sql(f'array_max({_bits_sql(DATE_BITS)})', 'non_null_count')} AS datetime_parse_ratio,
       numeric_parse_ratio,
       {ratio_sql(f'shape_counts[{BOOLEAN_BIT}]', 'non_null_count')} AS boolean_parse_ratio,
       {dominant_sql(_bits_sql(PATTERN_BITS), PATTERN_LABELS, 'non_null_count')} AS dominant_patterns,
       array_compact(array(
         if(null_ratio > 0.5, concat('null ratio ', format_number(null_ratio * 100, 2), '%'), NULL),
         if(cardinality_ratio > 0.98 AND non_null_count > 10, 'almost every value differs', NULL))) AS warnings
FROM rated
"""


def column_statistics(df: DataFrame) -> DataFrame:
    """Counts, ratios, numeric and length statistics per ``pos``."""
    return statistics_of(column_frequencies(df))


def statistics_of(freq: DataFrame) -> DataFrame:
    """``column_statistics`` of a frequency table."""
    return freq.sparkSession.sql(
        _STATISTICS.replace("QUANTILE_CTES", _QUANTILES), read=read_values(freq), numbers=read_numbers(freq))


_LISTS = """
SELECT pos,
       transform(array_sort(collect_list(if(by = 'value', named_struct('rn', rn, 'val', val), NULL))), e -> e.val)
         AS sample_values,
       transform(array_sort(collect_list(if(by = 'frequency', named_struct('rn', rn, 'val', val), NULL))), e -> e.val)
         AS representative_values
FROM {values} GROUP BY pos
"""


_PROFILE = """
SELECT n.dataset, n.pos, n.name AS physical_name, n.normalized_key, n.dtype,
       coalesce(s.row_count, 0L) AS row_count, coalesce(s.non_null_count, 0L) AS non_null_count,
       coalesce(s.null_count, 0L) AS null_count, coalesce(s.null_ratio, 0D) AS null_ratio,
       coalesce(s.distinct_count, 0L) AS distinct_count, coalesce(s.cardinality_ratio, 0D) AS cardinality_ratio,
       coalesce(s.duplicate_count, 0L) AS duplicate_count,
       coalesce(l.sample_values, array()) AS sample_values,
       coalesce(l.representative_values, array()) AS representative_values,
       s.min_value, s.max_value, s.mean, s.median, s.std_dev, s.q25, s.q50, s.q75,
       s.min_string_length, s.max_string_length, s.avg_string_length,
       coalesce(s.datetime_parse_ratio, 0D) AS datetime_parse_ratio,
       coalesce(s.numeric_parse_ratio, 0D) AS numeric_parse_ratio,
       coalesce(s.boolean_parse_ratio, 0D) AS boolean_parse_ratio,
       coalesce(s.dominant_patterns, array()) AS dominant_patterns, coalesce(s.warnings, array()) AS warnings
FROM {names} n LEFT JOIN {stats} s ON n.cell_pos = s.pos LEFT JOIN {lists} l ON n.cell_pos = l.pos
"""


def profile_of(names: DataFrame, freq: DataFrame, texts: DataFrame | None, max_values: int = MAX_SAMPLE_VALUES) -> DataFrame:
    """The full profile of all named columns: one row each, keyed ``(dataset, pos)``.

    ``names`` is ``(dataset, pos, name, dtype, cell_pos)``; ``cell_pos`` is the
    position under which ``freq`` and ``texts`` know the column.  The name list
    decides which rows exist, so an empty table has a profile.
    """
    spark = freq.sparkSession
    # a list holds whole values, however long, so it is joined by size and not broadcast
    lists = spark.sql(_LISTS, values=first_values(freq, texts, max_values))
    return spark.sql(_PROFILE, names=unique_column_keys(names), stats=F.broadcast(statistics_of(freq)), lists=lists)


def column_profile(df: DataFrame, dataset: str = "dataset", max_values: int = MAX_SAMPLE_VALUES) -> DataFrame:
    """The full profile of a table: one row per column, keyed ``(dataset, pos)``."""
    names = column_names(df, dataset).withColumn("cell_pos", F.col("pos"))
    return profile_of(names, column_frequencies(df), text_cells(df), max_values)


def pattern_counts(df: DataFrame, column: str) -> DataFrame:
    """Matches per shape pattern: ``(pattern, matches, share, dominant)``."""
    return _pattern_shares(df, column, None, 0.5, inclusive=False)


def detect_patterns(df: DataFrame, column: str, min_ratio: float = 0.5, inclusive: bool = True) -> DataFrame:
    """The stand-alone detector: looser ISO datetime, ratio bound included."""
    return _pattern_shares(df, column, detector_patterns(), min_ratio, inclusive)


def _pattern_shares(df, column, patterns, min_ratio, inclusive) -> DataFrame:
    from tablelens.config.fixed_values import SHAPE_PATTERNS

    patterns = patterns or SHAPE_PATTERNS
    # equal values match equally, so patterns run once per distinct value
    counted = df.select(as_text(df, column).alias("text")).where("text is not null").groupBy("text").agg(
        F.count(F.lit(1)).alias("cnt"))
    sums = counted.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"),
        *[F.coalesce(F.sum(F.when(F.col("text").rlike(regex), F.col("cnt"))), F.lit(0)).alias(f"m{i}")
          for i, (_, regex) in enumerate(patterns)],
    )
    rows = F.array(*[
        F.struct(F.lit(label).alias("pattern"), F.col(f"m{i}").alias("matches"))
        for i, (label, _) in enumerate(patterns)
    ])
    share = ratio(F.col("matches"), F.col("n"))
    return (
        sums.select("n", F.inline(rows))
        .withColumn("share", share)
        .withColumn("dominant", (share >= min_ratio) if inclusive else (share > min_ratio))
        .drop("n")
    )


def custom_pattern_ratio(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Share of non-null values whose start matches ``pattern``."""
    text = as_text(df, column)
    matched = F.count(F.when(starts_with_match(text, pattern), 1))
    return df.agg(ratio(matched, F.count(text)).alias("match_ratio"))
