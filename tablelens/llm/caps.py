"""Near-duplicate embeddings by spherical-cap filters.

A filter is a cap: all unit vectors whose product with the filter's direction
reaches a threshold.  Directions form structured random product codes (parts of
a vector each have a small random code, a direction is one word of each), so
list-decoding finds all caps a vector lies in without going through all
directions.  Vectors that share a cap (and a label) are compared exactly, in
double precision; a pair is counted in the first cap that holds both.  Vectors
at a cosine of 0.98 share a cap with a probability that the number of caps per
vector sets; `tests/llm/test_caps.py` measures the recall.

Equal vectors are one point with a count.  A cap with very many points is cut
into blocks, and pairs of blocks are separate groups; a group gives back one row
per point (links counted, the smallest point it hangs together with), not pairs.

Special cases: vectors that are null, empty, all zero or hold a null or
non-finite component, and those without a label, link with nothing and are
classes of their own; so are vectors of different lengths to each other; equal
rows link with each other; a null id names no class while there is another; extra
columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import broadcast_if_small, components, cut, quoted

COSINE = 0.98
#: Expected caps per vector, dealt over so many independent codes.
CAPS, CODES = 15, 5
#: Points aimed at per cap; more points in a label mean smaller caps.
CAP_POINTS = 64
#: Points of a group, at most, on each of its two sides.
BLOCK = 1024
SEED = 20240607


def cap_plan(points: int, caps: int = CAPS, codes: int = CODES) -> tuple[int, int, float]:
    """(parts of a code, words per part, threshold in standard deviations) for so many points."""
    share = min(0.05, CAP_POINTS / max(points, 1))
    directions = max(1.0, caps / codes / share)
    parts = 2 if directions <= 1 << 18 else 3
    return parts, max(2, round(directions ** (1 / parts))), NormalDist().inv_cdf(1 - share)


def _code(dimension: int, parts: int, size: int, code: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation and the words of each part, unit length over all parts together."""
    rng = np.random.default_rng([SEED, dimension, parts, size, code])
    rotation = np.linalg.qr(rng.standard_normal((dimension, dimension)))[0]
    words = []
    for columns in np.array_split(np.arange(dimension), parts):
        w = rng.standard_normal((size, len(columns)))
        norm = np.sqrt((w * w).sum(axis=1, keepdims=True))
        words.append(w / np.where(norm == 0, 1, norm) * np.sqrt(len(columns) / dimension))
    return rotation, words


def decode(vectors: np.ndarray, points: int, caps: int = CAPS, codes: int = CODES) -> list[np.ndarray]:
    """Caps that hold each unit vector, in order, and per code the nearest one."""
    dimension = vectors.shape[1]
    parts, size, deviations = cap_plan(points, caps, codes)
    parts = min(parts, dimension)
    least = deviations / np.sqrt(dimension)
    rows, found = [], []
    for code in range(codes):
        rotation, words = _code(dimension, parts, size, code)
        turned = vectors @ rotation
        columns = np.array_split(np.arange(dimension), parts)
        scores = [turned[:, c] @ w.T for c, w in zip(columns, words, strict=True)]
        # what the later parts can still add at best
        rest = [sum((s.max(axis=1) for s in scores[k + 1:]), np.zeros(len(vectors))) for k in range(parts)]
        row, name, sofar = np.arange(len(vectors)), np.full(len(vectors), code, np.int64), np.zeros(len(vectors))
        # the nearest direction counts in any case, so no vector is without a cap
        nearest = name
        for s in scores:
            nearest = nearest * size + s.argmax(axis=1)
        rows.append(row)
        found.append(nearest)
        for k, s in enumerate(scores):
            total = sofar[:, None] + s[row]
            kept, word = np.nonzero(total + rest[k][row][:, None] >= least)
            row, name, sofar = row[kept], name[kept] * size + word, total[kept, word]
        rows.append(row)
        found.append(name)
    both = np.unique(np.stack((np.concatenate(rows), np.concatenate(found)), axis=1), axis=0)
    return np.split(both[:, 1], np.searchsorted(both[:, 0], np.arange(1, len(vectors))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows of doubles, scaled to unit length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # scaled first, so that squares of very large or small components stay in range
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _cap_lists(caps: int, codes: int):
    @F.arrow_udf("array<long>")
    def of(vectors: pa.Array, points: pa.Array) -> pa.Array:
        out: list = [None] * len(vectors)
        counts, lengths = points.to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy(zero_copy_only=False)
        for n, d in {(int(a), int(b)) for a, b in zip(counts, lengths, strict=True)}:
            same = np.flatnonzero((counts == n) & (lengths == d))
            for at in range(0, len(same), 512):
                some = same[at:at + 512]
                for i, found in zip(some.tolist(), decode(_matrix(vectors.take(pa.array(some))), n, caps, codes), strict=True):
                    out[i] = found
        return pa.array(out, pa.list_(pa.int64()))

    return of


def _labels(linked: np.ndarray) -> np.ndarray:
    """Smallest index each row hangs together with, from a symmetric link matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        near = np.where(linked, label[None, :], n).min(axis=1)
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


FOUND = "node long, links long, root long"


def _compare(cosine: float):
    def of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compare the points of each group; rows come ordered by group."""
        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            names = batch.column("bucket").to_pylist()
            at = 0
            while at < len(names):
                end = at
                while end < len(names) and names[end] == names[at]:
                    end += 1
                if names[at] != name and held:
                    yield from _one_group(held, cosine)
                    held = []
                name = names[at]
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield from _one_group(held, cosine)

    return of_groups


def _one_group(batches: list[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    group = pa.Table.from_batches(batches).combine_chunks()
    if group.num_rows < 2:
        return
    side = group["side"].to_numpy()
    nodes, copies = group["node"].to_numpy(), group["copies"].to_numpy()
    vectors = _matrix(group["vector"].combine_chunks() if isinstance(group["vector"], pa.ChunkedArray) else group["vector"])
    own = group["cap"][0].as_py()
    lists = group["caps"].combine_chunks() if isinstance(group["caps"], pa.ChunkedArray) else group["caps"]
    lower = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(group.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    row, lower = row[lower < own], lower[lower < own]
    linked = vectors @ vectors.T >= cosine
    np.fill_diagonal(linked, False)
    if side.any():
        # two blocks: only pairs across
        linked &= side[:, None] != side[None, :]
    if not linked.any():
        return
    # pairs that an earlier cap holds too are counted there
    names, where = np.unique(lower, return_inverse=True)
    earlier = np.zeros((group.num_rows, len(names)), np.float32)
    earlier[row, where] = 1
    counted = linked & (earlier @ earlier.T == 0) if len(names) else linked
    links = counted @ copies.astype(np.float64)
    order = np.argsort(nodes, kind="stable")
    label = np.empty(group.num_rows, np.int64)
    label[order] = order[_labels(linked[np.ix_(order, order)])]
    some = np.flatnonzero(linked.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some].astype(np.int64)), pa.array(nodes[label[some]])],
                                     names=["node", "links", "root"])


def cap_components(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   cosine: float = COSINE, caps: int = CAPS, codes: int = CODES, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component) per row."""
    own = rows.select(quoted(id_col).alias("id"), quoted(vector_col).alias("vector"), quoted(label_col).cast("string").alias("label"))
    finite = "label IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0 AND " \
             "forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vector, x -> x != 0)"
    own = own.withColumn("fit", F.coalesce(F.expr(finite), F.lit(False)))
    # a point is a label with a vector; 64 bits name it, 64 more make sure
    named = own.where("fit").withColumns({"node": F.xxhash64("label", "vector"), "again": F.xxhash64("vector", "label")})
    points = named.groupBy("node", "again").agg(F.count("*").alias("copies"), F.min("id").alias("least"),
                                                 F.first("label").alias("label"), F.first("vector").alias("vector"))
    points = cut(points.withColumn("length", F.size("vector")))
    sizes = points.groupBy("label", "length").agg(F.count("*").alias("points"))
    # sizes by powers of two: few plans, and the same caps if a few points come
    sizes = cut(sizes.withColumn("points", F.pow(F.lit(2.0), F.ceil(F.log2("points"))).cast("long")))
    held = points.join(broadcast_if_small(sizes), ["label", "length"])
    held = cut(held.withColumn("caps", _cap_lists(caps, codes)("vector", "points")).select("node", "copies", "label", "length", "vector", "caps"))

    spread = held.select("*", F.explode("caps").alias("cap"))
    full = cut(spread.groupBy("label", "length", "cap").count().where(F.col("count") > block)
               .select("label", "length", "cap", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    spread = spread.join(broadcast_if_small(full), ["label", "length", "cap"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("node", "cap"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = spread.withColumn("mine", mine).withColumn("other", other)
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    bucket = F.concat_ws(":", "label", "length", "cap", low, high)
    grouped = spread.select(bucket.alias("bucket"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", "copies", "vector", "caps", "cap")
    found = grouped.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_compare(cosine), FOUND)
    found = cut(found)

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select("node", "root"), "node", "root").withColumnRenamed("component", "top")
    each = points.select("node", "again", "copies", "least").join(joined, "node", "left").withColumn("top", F.coalesce("top", "node"))
    least = each.groupBy("top").agg(F.min("least").alias("component"))
    each = each.join(least, "top").join(links, "node", "left")
    each = each.select("node", "again", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    alone = own.where("NOT fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return named.select("id", "node", "again").join(each, ["node", "again"]).select("id", "n_links", "component").union(alone)
