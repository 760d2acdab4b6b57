"""Mixing sources to target weights.

Sizes are summed per source; targets follow from the weights; the repetition
rate of a source is its target over its size.  A document is emitted
floor(rate) times, plus one more copy by a Bernoulli draw whose probability is
the fraction.  A draw is a hash of the document and a seed, so reruns agree.
Each source uses the one of a few fixed seeds whose draws come nearest to its
target, which all are tried in one aggregation.

Special cases: null texts have size zero; a null source is a source of its own
and comes last; documents of size zero are drawn like others and add nothing;
equal rows share a draw; sources of no size get target and rate zero; an
empty table gives an empty mix; other columns are carried along, and those with
the name of a column written here are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import broadcast_if_small, cut, free_name, quoted, without, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
SEEDS = 32


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order (null last) take the weights in turn and share
    the whole size; a target stops at `most` times its source's size, and the
    excess is shared by weight among the rest until none is above.  In the
    order of size per weight, the first sources are the ones that stop: the
    share per unit of weight after k stops is what is left over the weight that
    is left, and the smallest k whose next source stays below its limit holds.
    The table has one row per source and is small; its windows run in one task.
    """
    turn = "array(" + ", ".join(f"{w}D" for w in weights) + ")"
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.expr(f"element_at({turn}, int((place - 1) % {len(weights)}) + 1)"))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    steps = ranked.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
    ).withColumn("share", F.col("left") / F.col("weight_left"))
    fits = F.when(F.col("share") * F.col("weight") <= F.col("most"), F.struct((F.col("most") / F.col("weight")).alias("r"), "place", "share"))
    level = steps.withColumn("level", F.min(fits).over(whole)["share"])
    stops = F.col("level").isNull() | (F.col("level") * F.col("weight") >= F.col("most"))
    return level.select("source", "source_size", F.when(stops, F.col("most")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _document_key(id_col: str, text_col: str) -> Column:
    text = F.md5(F.coalesce(quoted(text_col), F.lit("")))
    return F.concat_ws(":", F.coalesce(quoted(id_col).cast("string"), F.lit("null")), text)


def _draw(key: Column, seed: Column) -> Column:
    """A number from 0 up to 1 that a document's key and a seed decide."""
    digits = F.substring(F.md5(F.concat_ws(":", seed.cast("string"), key)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def _planned(docs: DataFrame, name: str, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...],
             most: int, seeds: int) -> DataFrame:
    """The table with one more column: a struct of size, source_size, target and copies."""
    key = _document_key(id_col, text_col)
    slim = cut(docs.select(quoted(source_col).alias("source"), word_count(quoted(text_col)).alias("size"), key.alias("key")))
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most))))
    rates = cut(targets.withColumn("rate", F.coalesce(rate, F.lit(0.0))))

    # what each seed would draw in each source
    fraction = F.col("p.rate") - F.floor("p.rate")
    drawn = _with_source(slim, "source", rates, "p").groupBy("source").agg(
        F.first(fraction * F.col("p.source_size")).alias("wanted"),
        *[F.sum(F.when(_draw(F.col("key"), F.lit(s)) < fraction, F.col("size")).otherwise(0)).alias(f"s{s}") for s in range(seeds)])
    tries = F.array(*[F.struct(F.abs(F.col(f"s{s}") - F.col("wanted")).alias("off"), F.lit(s).alias("seed")) for s in range(seeds)])
    chosen = drawn.select("source", F.array_min(tries)["seed"].alias("seed"))
    plan = cut(rates.join(chosen.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))

    held = free_name(docs, "__plan")
    at = lambda field: F.col(held)[field]
    extra = _draw(key, at("seed")) < at("rate") - F.floor(at("rate"))
    count = F.least(F.floor(at("rate")).cast("int") + extra.cast("int"), F.lit(most))
    row = F.struct(word_count(quoted(text_col)).alias("size"), at("source_size").alias("source_size"),
                   at("target").alias("target"), count.alias("copies"))
    return _with_source(docs, source_col, plan, held).withColumn(name, row).drop(held)


def _with_source(df: DataFrame, source_col: str, per_source: DataFrame, name: str) -> DataFrame:
    """The row of a table with one row per source, put beside each row as a struct."""
    key = free_name(df, "__source")
    right = per_source.select(F.col("source").alias(key), F.struct("*").alias(name))
    return df.join(broadcast_if_small(right), quoted(source_col).eqNullSafe(F.col(key))).drop(key)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, seeds: int = SEEDS) -> DataFrame:
    """The table with size, source_size, target and `copies`, how often each document is emitted."""
    name = free_name(docs, "__mix")
    out = _planned(docs, name, id_col, text_col, source_col, weights, most, seeds)
    return without(out, ["size", "source_size", "target", "copies"]).select("*", f"{name}.*").drop(name)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, seeds: int = SEEDS) -> DataFrame:
    """The documents as the mix emits them: each row as often as its copies, columns as before."""
    name = free_name(docs, "__mix")
    out = _planned(docs, name, id_col, text_col, source_col, weights, most, seeds)
    taken = out.where(F.col(name)["copies"] > 0).withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name)["copies"])))
    return taken.select([quoted(c) for c in docs.columns])
