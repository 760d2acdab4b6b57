"""Drill-down cubes: sums at every depth of a hierarchy.

One grouping by all levels shuffles the table once; every depth above is summed
from its groups, and cells and their parents read the same exchange.  Groups
under the minimum size are suppressed so that no cell describes a few rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.config.fixed_values import MAX_CUBE_LABELS, MAX_CUBE_PATHS, MIN_CUBE_GROUP
from tablelens.errors import ProfileError
from tablelens.functions.parsing import numeric_value
from tablelens.functions.text import as_text, sql_string


def cube_cells(df: DataFrame, levels: list[str], metric: str, min_group: int = MIN_CUBE_GROUP,
               max_paths: int = MAX_CUBE_PATHS, max_labels: int = MAX_CUBE_LABELS) -> DataFrame:
    """One row per cube cell: ``(level_depth, level_column, path, label, value, count, record_count)``.

    ``path`` maps the levels above to their values; ``record_count`` is the
    number of rows under the path.  At most ``max_paths`` paths per depth and
    ``max_labels`` labels per path are kept, in order of their values; both
    limits are part of what a cube is.
    """
    count = len(levels)
    keys = [f"level{i}" for i in range(count)]
    values = df.select(*[as_text(df, name).alias(key) for name, key in zip(levels, keys, strict=True)],
                       numeric_value(df, metric).alias("x"))
    base = values.groupBy(*keys).agg(
        F.count("x").alias("count"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("total"), F.count(F.lit(1)).alias("rows"))

    def at_depth(depth: int) -> DataFrame:
        """One row per path of so many levels."""
        if depth == count:
            return base
        sums = [F.sum(c).alias(c) for c in ("count", "total", "rows")]
        return base.groupBy(*keys[:depth]).agg(*sums) if depth else base.agg(*sums)

    def whole(depth: int, condition: Column) -> Column:
        """A path without missing values that meets a condition.

        Naming all three sums keeps the filter above the groups and their
        columns the same, so that all readers of a grouping share its exchange.
        """
        named = (F.col("count") <= F.col("rows")) & ((F.abs("total") >= 0) | F.isnan("total")) & condition
        for key in keys[:depth]:
            named = named & F.col(key).isNotNull()
        return F.when(named, F.col("rows")) > 0

    cells = None
    for depth, level in enumerate(levels):
        above = keys[:depth]
        # the first paths of a depth are its parents; the top has one, the table itself
        first = at_depth(depth).where(whole(depth, F.lit(True)))
        if depth:
            first = first.orderBy(*above).limit(max_paths).where(F.col("rows") >= min_group)
        # one row at the top meets all cells by a number that is 0 everywhere; names that cannot be null spare the
        # join a filter below the grouping, which would make it another one
        named = [F.coalesce(key, F.lit("")).alias(f"path{i}") for i, key in enumerate(above)]
        named.append(F.coalesce(F.least("rows", F.lit(0)), F.lit(0)).alias("place"))
        met_by = [*(f"path{i}" for i in range(depth)), "place"]
        parents = first.select(*named, F.col("rows").alias("record_count"))
        part = at_depth(depth + 1).where(whole(depth + 1, F.col("count") >= min_group))
        by_label = Window.partitionBy(*met_by).orderBy("label")
        part = (
            part.select(*named, F.col(keys[depth]).alias("label"), "total", "count")
            # at most max_paths rows
            .join(F.broadcast(parents), met_by)
            .withColumn("rank", F.row_number().over(by_label))
            .where(F.col("rank") <= max_labels)
            .select(
                F.lit(depth).alias("level_depth"), F.lit(level).alias("level_column"),
                F.map_from_arrays(F.array(*[F.lit(c) for c in levels[:depth]]).cast("array<string>"), F.array(*met_by[:-1]).cast("array<string>")).alias("path"),
                "label", F.round("total", 2).alias("value"), "count", "record_count",
            )
        )
        cells = part if cells is None else cells.unionByName(part)
    return cells


def cubes(df: DataFrame, levels: list[str], metric: str, **bounds) -> DataFrame:
    """One row per cube: depth, path and its list of cells."""
    return cube_cells(df, levels, metric, **bounds).groupBy(
        "level_depth", "level_column", F.to_json("path").alias("path_json"), "record_count",
    ).agg(
        # at most max_labels cells
        F.sort_array(F.collect_list(F.struct("label", "value", "count"))).alias("cells"),
    ).select(
        "level_column", "level_depth", F.from_json("path_json", "map<string,string>").alias("path"), "cells",
        F.lit(metric).alias("metric_column"), F.lit("sum").alias("aggregation"), "record_count",
    )


def drill_down(cube_rows: DataFrame, levels: list[str], path: dict[str, str]) -> DataFrame:
    """Cells one level below the selected path."""
    for name in path:
        if name not in levels:
            raise ProfileError("INVALID_DRILL_DOWN_PATH", f"{name} is no level of the hierarchy",
                               {"column": name, "hierarchy": levels})
    depth = len(path)
    if depth >= len(levels):
        raise ProfileError("DRILL_DOWN_LEAF_REACHED", "there is no level below the path",
                           {"depth": depth, "max_levels": len(levels)})
    selected = cube_rows.where(F.col("level_column") == levels[depth])
    for name, value in path.items():
        selected = selected.where(F.col("path").getItem(name) == value)
    below = levels[depth + 1] if depth + 1 < len(levels) else None
    return selected.selectExpr("inline(cells)").selectExpr(
        f"{sql_string(levels[depth])} AS current_level",
        f"{sql_string(below) if below else 'CAST(NULL AS string)'} AS next_level", "label", "value", "count")
