"""What several operators share: words, cut lineage, connected components."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.sources.settle import settled as cut  # noqa: F401  one way to cut lineage in the library

# Words are runs of anything but ASCII white space; bytes.split() cuts at the same characters.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text as long; a null text has none."""
    single = F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)))
    return F.when(single == "", F.lit(0)).otherwise(F.size(F.split(single, " +"))).cast("long")


def quoted(name: str) -> Column:
    """Column of that very name, dots and back ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The table without columns an operator is about to write under these names."""
    gone = {n.lower() for n in names}
    return df.select([quoted(c) for c in df.columns if c.lower() not in gone])


def broadcast_if_small(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """The table, marked for broadcast if its measured size in text form stays below the bound.

    For tables that are cheap to read (checkpointed).  A larger one is left to
    an ordinary join.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16)).first()[0] or 0
    return F.broadcast(df) if size <= most_bytes else df


def raw_bytes(values: pa.Array) -> Iterable[bytes]:
    """UTF-8 bytes of each value, one at a time; null is empty."""
    return (v.as_py() or b"" for v in values)


def give_back() -> None:
    """Hand freed memory back to the system.

    Workers live on between stages; what the allocators of Arrow and C keep for
    later would add up to the memory of all stages.
    """
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


#: Links of a node that one task joins, at least; nodes with more are hubs, whose links are split.
HUB_LINKS = 1 << 16
#: Hubs there can be at most, which are broadcast (16 bytes each).
MOST_HUBS = 1 << 18


def _meet_lowest(rows: DataFrame, low: DataFrame, hub: int) -> DataFrame:
    """Rows (u, v) with `low` of their u, from (u, low, links); a hub's rows are dealt to several tasks."""
    parts = low.select("u", "low", F.greatest(F.ceil(F.col("links") / hub), F.lit(1)).cast("int").alias("parts"))
    hubs = parts.where("parts > 1").select("u", "parts")
    spread = rows.join(F.broadcast(hubs), "u", "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("v"), F.col("parts"))).otherwise(F.lit(0)).cast("int")
    spread = spread.select("u", "v", part.alias("part"))
    copies = parts.select("u", "low", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return spread.join(copies, ["u", "part"])


def components(links: DataFrame, a: str, b: str, hub_links: int | None = None) -> DataFrame:
    """Connected components of undirected links: (node, component), component the smallest node.

    Alternates the two star operations: every node hands its larger, then its
    smaller neighbours to its smallest one, until nothing moves.  Rounds grow
    with the logarithm of the longest chain.  A node with very many neighbours
    is one partial minimum per task, and its links are joined in parts of
    `hub_links`, which grow with all links so that there are at most MOST_HUBS
    such nodes.  Nodes are longs; links to oneself and null ends are ignored.
    Nodes without a link do not appear.
    """
    u, v = F.col("u"), F.col("v")
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), quoted(a).alias("x"), quoted(b).alias("y"))
    edges = cut(ends.where("x IS NOT NULL AND y IS NOT NULL AND x != y").select("u", "v").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v"))).first()
        if state == before or state[0] == 0:
            return edges.select(u.alias("node"), v.alias("component"))
        before = state
        # both ends of every link count, so at most this many nodes have more links than a hub
        hub = max(hub_links or HUB_LINKS, 2 * state[0] // MOST_HUBS)
        both = edges.union(edges.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"), F.count("*").alias("links"))
        large = _meet_lowest(both.where(v > u), low, hub).select(v.alias("u"), F.col("low").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("links"))
        small = _meet_lowest(large, low, hub).select(v.alias("u"), F.col("low").alias("v"))
        small = small.union(low.select("u", F.col("low").alias("v")))
        edges = cut(small.where("u != v").distinct())
