"""The value-frequency table every column statistic is computed from.

``column_frequencies`` turns a table into one row per column and distinct
value.  It is the only step that shuffles data in proportion to the input, and
it combines map-side first, so a value holding a third of all rows arrives as
one partial count per task.

Whole numbers, doubles and times are counted as what they are: writing every
cell as text would cost more than counting it, so only distinct values get one.

Values longer than ``INLINE_CHARS`` would drag whole documents through that
shuffle.  They are read where they are scanned and travel as their beginning and
a SHA-256 digest, next to the readings taken from the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablelens.functions.parsing import flags_sql, long_flags_sql, number_sql, real_flags_sql, whole_flags_sql
from tablelens.functions.text import as_text_sql, double_text_sql, quoted

INLINE_CHARS = 256
# one value in so many is looked at first, to learn how far the first values of a column can reach
BOUND_SHARE = 1024


def column_names(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """The ``(dataset, pos, name, dtype)`` relation of a table's columns."""
    rows = [(dataset, i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "dataset string, pos int, name string, dtype string")


def long_form(df: DataFrame, columns: list[str] | None = None, offset: int = 0) -> DataFrame:
    """``(pos, text)``: one row per cell, nulls kept; ``offset`` is added to positions.

    ``pos`` cannot be null and says so: no join on it then plants a null filter
    below the aggregation that the branches of a profile share.
    """
    columns = columns or df.columns
    position = {name: i + offset for i, name in enumerate(df.columns)}
    wide = df.selectExpr(*[f"{as_text_sql(df, name)} AS `{position[name]}`" for name in columns])
    return wide.unpivot([], wide.columns, "column", "text").selectExpr("coalesce(int(column), -1) AS pos", "text")


# how a cell travels while it is counted: one of these holds it, ``val`` as text
_KEYS = {"val": "string", "whole": "bigint", "real": "double", "moment": "timestamp_ntz"}


def _typed_sql(df: DataFrame, name: str) -> dict[str, str]:
    """The keys that hold a column; equal keys have equal texts and different ones different texts."""
    dtype, column = df.schema[name].dataType, quoted(name)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return {"whole": f"bigint({column})"}
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        # two times of a zone may share the text that a clock shows
        return {"moment": f"CAST({column} AS timestamp_ntz)"}
    if isinstance(dtype, T.DoubleType):
        # spelled out with 18 decimals, two of these may share a text
        tiny = f"(abs({column}) >= 1e-4 AND abs({column}) < 1e-3)"
        return {"val": f"CASE WHEN {tiny} THEN {as_text_sql(df, name)} END",
                "real": f"CASE WHEN NOT isnan({column}) AND NOT {tiny} THEN {column} + 0D END"}
    return {"val": as_text_sql(df, name)}


def typed_form(df: DataFrame, columns: list[str] | None = None, offset: int = 0) -> DataFrame:
    """``long_form`` for counting: ``(pos, val, whole, real, moment)``, all null for a missing value."""
    wide, cells = [], []
    for i, name in enumerate(df.columns):
        if columns is None or name in columns:
            held = _typed_sql(df, name)
            wide.append(f"{i + offset} AS `pos{i}`")
            wide += [f"CAST({held.get(key, 'NULL')} AS {dtype}) AS `{key}{i}`" for key, dtype in _KEYS.items()]
            cells.append("(" + ", ".join(f"`{key}{i}`" for key in ("pos", *_KEYS)) + ")")
    keys = ", ".join(_KEYS)
    unpivoted = f"SELECT * FROM {{wide}} UNPIVOT INCLUDE NULLS ((pos, {keys}) FOR column IN ({', '.join(cells)}))"
    return df.sparkSession.sql(unpivoted, wide=df.selectExpr(*wide)).selectExpr("coalesce(pos, -1) AS pos", *_KEYS)


_LONG = f"char_length(text) > {INLINE_CHARS}"
# what travels for a long value beside its beginning: its digest and the readings of the whole text
_LONG_PARTS = {
    "digest": ("sha2(text, 256)", "string"),
    "long_num": (number_sql("text"), "double"),
    "long_flags": (long_flags_sql("text"), "bigint"),
    "long_length": ("char_length(text)", "int"),
}


def inline_value(texts: DataFrame) -> DataFrame:
    """``(val, digest)`` as a frequency table has them, of a relation with ``text``."""
    return texts.selectExpr(f"left(text, {INLINE_CHARS}) AS val", f"CASE WHEN {_LONG} THEN {_LONG_PARTS['digest'][0]} END AS digest")


def count_values(cells: DataFrame, long_texts: bool = True) -> DataFrame:
    """Frequencies of ``typed_form`` cells; see ``column_frequencies``."""
    if long_texts:
        # one key for all of them: an entry of the maps that count stays small
        parts = ", ".join(f"'{name}', {part.replace('text', 'val')}" for name, (part, _) in _LONG_PARTS.items())
        long = f"CASE WHEN char_length(val) > {INLINE_CHARS} THEN named_struct({parts}) END AS long"
        cells = cells.selectExpr("pos", f"left(val, {INLINE_CHARS}) AS val", *list(_KEYS)[1:], long)
    counted = cells.groupBy("pos", *_KEYS, *(["long"] if long_texts else [])).agg(F.count(F.lit(1)).alias("cnt"))
    long_parts = [f"{f'long.{name}' if long_texts else f'CAST(NULL AS {dtype})'} AS {name}" for name, (_, dtype) in _LONG_PARTS.items()]
    return counted.selectExpr(
        "pos", f"coalesce(val, string(whole), {double_text_sql('real')}, string(moment)) AS val",
        *list(_KEYS)[1:], *long_parts, "cnt")


def column_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column and distinct value, with its count ``cnt``.

    ``val`` is the value, null if missing; of a long one it is the beginning,
    and ``digest`` tells it from others that begin alike.  ``whole``, ``real``
    and ``moment`` hold it too where the column's type is one of theirs.
    """
    return count_values(typed_form(df, columns), any(has_long_text(df, name) for name in columns or df.columns))


def has_long_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.StringType, T.ArrayType, T.MapType, T.StructType))


# the number a value is, from its type if that tells
_NUM = (f"CASE WHEN digest IS NOT NULL THEN long_num WHEN whole IS NOT NULL THEN double(whole) WHEN real IS NOT NULL THEN real "
        f"WHEN moment IS NULL THEN {number_sql('val')} END")


def read_values(freq: DataFrame) -> DataFrame:
    """``(pos, cnt, num, flags, length)`` of a frequency table.

    The readings come out of a generator: filters on them, which Spark infers
    freely, then stay above the aggregation that all branches share.
    """
    flags = (f"CASE WHEN digest IS NOT NULL THEN long_flags WHEN whole IS NOT NULL THEN {whole_flags_sql('whole', 'val')} "
             f"WHEN real IS NOT NULL THEN {real_flags_sql('val')} ELSE {flags_sql('val')} END")
    read = f"named_struct('num', {_NUM}, 'flags', {flags}, 'length', if(digest IS NULL, char_length(val), long_length))"
    return freq.selectExpr("pos", "cnt", f"inline(array({read}))")


def read_numbers(freq: DataFrame) -> DataFrame:
    """``(pos, cnt, num)`` of the values that are numbers."""
    return freq.selectExpr("pos", "cnt", f"inline(array(named_struct('num', {_NUM})))").where("num IS NOT NULL")


_BY = {"frequency": "cnt", "value": "0L"}


def ranked_values(freq: DataFrame, k: int, orders: tuple[str, ...] = ("frequency",)) -> DataFrame:
    """Candidates for the ``k`` first values per column and order: ``(by, pos, rank, val, digest, cnt)``.

    ``"frequency"``: most frequent first, ties by value.  ``"value"``: smallest
    first (a distributed table has no first rows).  Long values with one
    beginning share a rank here; ``first_values`` orders them by the rest.

    Of a fixed share of the values the ``k``-th is found first.  What comes after
    it cannot be among the first ``k`` of all and is dropped before anything is
    sorted; a column too small for such a bound is sorted whole.  The limit is
    applied in every task before the shuffle.
    """
    order = Window.partitionBy("pos", "by").orderBy(F.col("weight").desc(), F.col("val").asc(), F.col("digest").isNotNull().asc())

    def listed(condition: str) -> DataFrame:
        # naming cnt keeps the filter above the aggregation, so that these branches
        # and the statistics share one shuffle
        return freq.where(f"if({condition}, cnt, 0L) > 0").select("pos", "val", "digest", "cnt")

    by = ", ".join(f"named_struct('by', '{name}', 'weight', {_BY[name]})" for name in orders)
    share = listed(f"val IS NOT NULL AND pmod(xxhash64(val, digest), {BOUND_SHARE}) = 0").selectExpr("*", f"inline(array({by}))")
    # one row per column
    bounds = share.withColumn("rn", F.row_number().over(order)).where(F.col("rn") == k).groupBy("pos").agg(
        *[F.max(F.when(F.col("by") == name, F.col(c))).alias(f"{name}_{c}") for name in orders for c in ("weight", "val")])
    within = {name: f"({name}_val IS NULL OR {_BY[name]} > {name}_weight OR {_BY[name]} = {name}_weight AND val <= {name}_val)" for name in orders}
    by = ", ".join(f"named_struct('by', if({within[name]}, '{name}', NULL), 'weight', {_BY[name]})" for name in orders)
    return (
        listed("val IS NOT NULL").join(F.broadcast(bounds), "pos", "left").where(" OR ".join(within.values()))
        .selectExpr("pos", "val", "digest", "cnt", f"inline(array({by}))").where("by IS NOT NULL")
        .withColumn("rank", F.rank().over(order))
        .where(F.col("rank") <= k)
        .select("by", "pos", "rank", "val", "digest", "cnt")
    )


def first_values(freq: DataFrame, texts: DataFrame | None, k: int, orders: tuple[str, ...] = ("frequency", "value")) -> DataFrame:
    """The ``k`` first values per column and order: ``(pos, by, rn, val, cnt)``.

    One order for values of any length: by their characters, whole.  Candidates
    that are long are fetched by a second scan of ``texts`` (the ``(pos, text)``
    cells), for their beginnings alone, of which a list has at most ``k``.  The
    scan is dropped at run time if there are none.  Of values that share a
    beginning at the end of a list all are fetched, so the list is exact.
    """
    candidates = ranked_values(freq, k, orders)
    if texts is not None:
        # out of a generator, so that both uses of the candidates share their shuffle
        fields = ", ".join(f"'{name}', {name}" for name in candidates.columns)
        candidates = candidates.selectExpr(f"inline(array(named_struct({fields})))")
        wanted = candidates.where("digest IS NOT NULL").select("pos", "val").distinct()
        full = (
            texts.where(_LONG)
            .withColumn("val", F.left("text", F.lit(INLINE_CHARS)))
            .join(F.broadcast(wanted), ["pos", "val"])
            .select("pos", F.sha2("text", 256).alias("digest"), "text")
            .groupBy("pos", "digest")
            .agg(F.min("text").alias("text"))
        )
        candidates = candidates.join(full, ["pos", "digest"], "left").withColumn("val", F.coalesce("text", "val"))
    order = Window.partitionBy("pos", "by").orderBy("rank", "val")
    return (
        candidates.withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= k)
        .select("pos", "by", "rn", "val", "cnt")
    )


def text_cells(df: DataFrame, offset: int = 0) -> DataFrame | None:
    """``(pos, text)`` of the columns that may hold long values; None if there is no such column."""
    names = [name for name in df.columns if has_long_text(df, name)]
    return long_form(df, names, offset) if names else None
