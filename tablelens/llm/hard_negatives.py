"""Hard negatives by exact inner-product search in cover trees.

Scores are inner products of quantised vectors, floor(256 x) per component.  An
anchor's positives are the first rows of its label; for each positive, the
negatives are the first rows of other labels whose score lies in a window below
the positive's.

Rows are dealt into cells, and each cell becomes a cover tree over its vectors
augmented by one coordinate that gives all of them the same norm.  A node's
covering radius bounds the inner products of everything below it: an anchor q finds
them within |q| r of the node centre's.  Levels halve the radius; a node that a level
would not part any more is a leaf.  The descent opens nodes best bound first, skips
those that lie outside all windows of an anchor or below what it already holds,
and compares leaves exactly.

On Spark, groups of anchors meet groups of cells: anchors are copied once per
group of cells and rows once per group of anchors, both groups of bounded size,
and a task reads its cells one after another, holding one tree and the best rows
so far.  Positives are searched among rows of the same label only.  A label with a
third of all rows is many cells like any other.

Special cases: rows with a null label, a null vector or a null or non-finite
component take no part; vectors are compared with those of their own length;
repeated rows and repeated ids count each; ties go to the smaller id, a null id
last; a row is no positive of itself, but of an equal row; a null id is no anchor
unless the condition says so; empty tables give no row; other columns do no harm.
Components beyond 1e100 and scores beyond 9.2e16 are held there, with their sign.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import broadcast_if_small, cut, quoted

#: Rows of a cell, at most; points of a node that is not parted further.
CELL_ROWS, LEAF_ROWS = 2048, 64
#: Anchors that descend side by side.
SIDE_BY_SIDE = 512
#: Anchors of a group, and rows of one group of cells: what a task reads at most.
ANCHOR_GROUP = GROUP_ROWS = 1 << 16
#: Groups of cells that few rows are still parted into.
LEAST_GROUPS = 32
#: Rows the pivots are fitted on, a bounded sample; they only set the order of rows.
PIVOTS = 64
SCALE = 256
MOST_COMPONENT = 1e100
MOST_SCORE = (2**63 - 1) // 100
_EXACT = 2.0**52
_SPARE = 1e-9


class CoverTree:
    """Cover tree over the rows of one cell.

    Nodes come level by level: `centre` is a row, `first`/`last` delimit the node's
    rows in `order`, `radius` covers them in the augmented space.  A leaf has no
    children; the rows of a leaf are kept by ascending place in the cell.
    """

    def __init__(self, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        n = len(vectors)
        squares = (vectors * vectors).sum(axis=1)
        # the added coordinate gives every row the largest norm
        self.points = np.column_stack((vectors, np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0.0))))
        self.order = np.arange(n)
        self.centre, self.first, self.last, self.radius = [], [], [], []
        self.children: list[tuple[int, int]] = []
        if n:
            self._add(0, 0, n)
        node = 0
        while node < len(self.centre):
            self.children[node] = self._part(node, leaf_rows)
            node += 1
        self.centre, self.radius = np.array(self.centre, np.int64), np.array(self.radius)
        self.leaves = [k for k, (a, b) in enumerate(self.children) if a == b]

    def _distances(self, centre: int, rows: np.ndarray) -> np.ndarray:
        apart = self.points[rows] - self.points[centre]
        return np.sqrt((apart * apart).sum(axis=1))

    def _add(self, centre: int, first: int, last: int) -> None:
        self.centre.append(centre)
        self.first.append(first)
        self.last.append(last)
        self.radius.append(float(self._distances(centre, self.order[first:last]).max()))
        self.children.append((0, 0))

    def _part(self, node: int, leaf_rows: int) -> tuple[int, int]:
        """Children of a node: a net of half its radius over its rows."""
        first, last, reach = self.first[node], self.last[node], self.radius[node] / 2
        if last - first <= leaf_rows or self.radius[node] == 0:
            return 0, 0
        rest, groups = self.order[first:last], []
        centre = self.centre[node]
        while len(rest):
            near = self._distances(centre, rest) <= reach
            groups.append((centre, rest[near]))
            rest = rest[~near]
            # a net of very many centres would bound nothing: the node stays whole
            if len(groups) * 4 > last - first:
                return 0, 0
            if len(rest):
                centre = int(rest[0])
        begin, at = len(self.centre), first
        for centre, rows in groups:
            self.order[at:at + len(rows)] = np.sort(rows)
            self._add(centre, at, at + len(rows))
            at += len(rows)
        return begin, len(self.centre)


def _product(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as longs, held within MOST_SCORE."""
    if not anchors.shape[1]:
        return np.zeros((len(anchors), len(rows)), np.int64)
    largest = np.sqrt((anchors * anchors).sum(axis=1)).max(initial=0.0) * np.sqrt((rows * rows).sum(axis=1)).max(initial=0.0)
    if largest < _EXACT:
        # whole numbers whose sums a double holds
        return (anchors @ rows.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(anchors) @ whole(rows).T, -MOST_SCORE, MOST_SCORE).astype(np.int64)


class Best:
    """The k first rows found so far for each search, by score, then id, then row."""

    def __init__(self, searches: int, k: int):
        self.k = k
        self.score = np.full((searches, k), np.iinfo(np.int64).min)
        self.id = np.zeros((searches, k), np.int64)
        self.nameless = np.ones((searches, k), bool)
        self.row = np.full((searches, k), -1, np.int64)

    def least(self) -> np.ndarray:
        """The score of the last row held; rows below it are of no use."""
        return self.score[:, -1]

    def add(self, searches: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, nameless: np.ndarray, rows: np.ndarray) -> None:
        """Scores (searches x rows, where they fit) of rows that come by id."""
        low = np.iinfo(np.int64).min
        scores = np.where(fits, scores, low)
        bound = self.least()[searches]
        if scores.shape[1] > self.k:
            bound = np.maximum(bound, np.partition(scores, -self.k, axis=1)[:, -self.k])
        equal = fits & (scores == bound[:, None])
        # of the rows at the bound, the first ones by id; this cell has no use for more
        taken = fits & (scores > bound[:, None]) | equal & (np.cumsum(equal, axis=1) <= self.k)
        at, place = np.nonzero(taken)
        if not len(at):
            return
        touched, slot = np.unique(at, return_inverse=True)
        held = searches[touched]
        name = np.concatenate((slot, np.repeat(np.arange(len(touched)), self.k)))
        score = np.concatenate((scores[at, place], self.score[held].ravel()))
        own = np.concatenate((ids[place], self.id[held].ravel()))
        none = np.concatenate((nameless[place], self.nameless[held].ravel()))
        row = np.concatenate((rows[place], self.row[held].ravel()))
        order = np.lexsort((row, own, none, row < 0, -np.maximum(score, low + 1), name))
        name = name[order]
        rank = np.arange(len(order)) - np.searchsorted(name, name)
        first = order[rank < self.k]
        shape = (len(touched), self.k)
        self.score[held], self.id[held] = score[first].reshape(shape), own[first].reshape(shape)
        self.nameless[held], self.row[held] = none[first].reshape(shape), row[first].reshape(shape)


class Searches:
    """A group of anchors with one or more windows of scores each.

    Without windows (`low` and `high` null) rows of the anchor's own label are
    wanted, otherwise rows of other labels within a window.
    """

    def __init__(self, table: pa.Table, k: int):
        self.row = table["row"].to_numpy()
        self.codes: dict[str, int] = {}
        self.labels = np.array([self.codes.setdefault(v, len(self.codes)) for v in table["label"].to_pylist()], np.int64)
        self.vectors = _matrix(table["vector"])
        self.norm = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        windows = table["low"].to_pylist()
        self.same = windows[0] is None
        wide = max((len(w) for w in windows), default=1) if not self.same else 1
        self.low = np.full((len(windows), wide), -MOST_SCORE)
        self.high = np.full((len(windows), wide), MOST_SCORE)
        if not self.same:
            self.low, self.high = self.high, self.low
            for i, (low, high) in enumerate(zip(windows, table["high"].to_pylist(), strict=True)):
                self.low[i, :len(low)], self.high[i, :len(high)] = low, high
            # a window without scores is never met
            none = self.low > self.high
            self.low[none], self.high[none] = MOST_SCORE, -MOST_SCORE
        self.best = [Best(len(windows), k) for _ in range(wide)]

    def descend(self, cell: pa.Table) -> None:
        """Search one cell, whose rows come by id."""
        vectors = _matrix(cell["vector"])
        ids, nameless = cell["id"].fill_null(0).to_numpy(), cell["id"].is_null().to_numpy()
        rows, labels = cell["row"].to_numpy(), np.array([self.codes.get(v, -1) for v in cell["label"].to_pylist()], np.int64)
        tree = CoverTree(vectors)
        for at in range(0, len(self.row), SIDE_BY_SIDE):
            self._descend(np.arange(at, min(at + SIDE_BY_SIDE, len(self.row))), tree, vectors, ids, nameless, rows, labels)

    def _wanted(self, some: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Anchors (of some) for whom scores between two bounds can matter."""
        wanted = np.zeros(low.shape, bool)
        for j, best in enumerate(self.best):
            shape = (len(some),) + (1,) * (low.ndim - 1)
            least = np.maximum(self.low[some, j], best.least()[some]).reshape(shape)
            wanted |= (high >= least) & (low <= self.high[some, j].reshape(shape))
        return wanted

    def _descend(self, some, tree, vectors, ids, nameless, rows, labels) -> None:
        anchors, norm = self.vectors[some], self.norm[some][:, None]
        bounds = np.full((len(tree.centre), len(some), 2), np.nan)
        # nodes come level by level, so bounds are known when a child is looked at
        open_nodes, leaves = [0], []
        while open_nodes:
            centre = tree.centre[open_nodes]
            product = anchors @ vectors[centre].T
            reach = norm * tree.radius[open_nodes][None, :]
            spare = _SPARE * (np.abs(product) + reach) + 1
            low = np.clip(product - reach - spare, -MOST_SCORE, MOST_SCORE)
            high = np.clip(product + reach + spare, -MOST_SCORE, MOST_SCORE)
            wanted = self._wanted(some, low, high)
            following = []
            for k, node in enumerate(open_nodes):
                if not wanted[:, k].any():
                    continue
                bounds[node, :, 0], bounds[node, :, 1] = low[:, k], high[:, k]
                a, b = tree.children[node]
                if a == b:
                    leaves.append((-high[wanted[:, k], k].max(), node))
                following += range(a, b)
            open_nodes = following
        for _, node in sorted(leaves):
            # what other leaves gave may have made this one useless
            use = self._wanted(some, bounds[node, :, 0], bounds[node, :, 1])
            chosen = some[use]
            if not len(chosen):
                continue
            members = tree.order[tree.first[node]:tree.last[node]]
            scores = _product(self.vectors[chosen], vectors[members])
            alike = labels[members][None, :] == self.labels[chosen][:, None]
            if self.same:
                alike &= rows[members][None, :] != self.row[chosen][:, None]
            else:
                alike = ~alike
            for j, best in enumerate(self.best):
                fits = alike & (scores >= self.low[chosen, j][:, None]) & (scores <= self.high[chosen, j][:, None])
                if fits.any():
                    best.add(chosen, scores, fits, ids[members], nameless[members], rows[members])

    def found(self) -> Iterator[pa.RecordBatch]:
        for j, best in enumerate(self.best):
            at, k = np.nonzero(best.row >= 0)
            if len(at):
                ids = pa.array(best.id[at, k], mask=best.nameless[at, k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(self.row[at]), pa.array(np.full(len(at), j, np.int32)), pa.array(best.row[at, k]), ids, pa.array(best.score[at, k])],
                    names=["anchor", "window", "row", "id", "score"])


FOUND = "anchor long, window int, row long, id long, score long"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as rows of doubles."""
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, int, pa.Table]]:
    """(bucket, kind, rows) of neighbouring rows alike in both, at most so many at a time for rows to search in."""
    held: list[pa.RecordBatch] = []
    key, size = None, 0
    for batch in batches:
        buckets, kinds = batch.column("bucket").to_pylist(), batch.column("kind").to_pylist()
        at = 0
        while at < len(buckets):
            own = (buckets[at], kinds[at])
            if held and (own != key or own[1] == 1 and size >= most):
                yield *key, pa.Table.from_batches(held)
                held, size = [], 0
            key, end = own, at + 1
            while end < len(buckets) and (buckets[end], kinds[end]) == own and (own[1] == 0 or size + end - at < most):
                end += 1
            held.append(batch.slice(at, end - at))
            size += end - at
            at = end
    if held:
        yield *key, pa.Table.from_batches(held)


def _search(k: int, cell_rows: int):
    def of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Search each bucket: its anchors come first, then its rows, which are cut into cells."""
        bucket, searches = None, None
        for name, kind, rows in _runs(batches, cell_rows):
            if name != bucket:
                if searches is not None:
                    yield from searches.found()
                bucket, searches = name, None
            if kind == 0:
                searches = Searches(rows, k)
            elif searches is not None:
                # a cell's rows by id, so that of equal scores the first is the one wanted
                order = np.lexsort((rows["row"].to_numpy(), rows["id"].fill_null(0).to_numpy(), rows["id"].is_null().to_numpy()))
                searches.descend(rows.take(pa.array(order)))
        if searches is not None:
            yield from searches.found()

    return of_groups


def _nearest(pivots: np.ndarray):
    @F.arrow_udf("int")
    def of(vectors: pa.Array) -> pa.Array:
        """The pivot nearest to each vector; 0 for vectors of another length."""
        fit = np.flatnonzero(vectors.value_lengths().to_numpy(zero_copy_only=False) == pivots.shape[1])
        out = np.zeros(len(vectors), np.int32)
        if len(fit) and len(pivots):
            own = _matrix(pa.chunked_array([vectors.take(pa.array(fit))]))
            out[fit] = ((pivots * pivots).sum(axis=1) - 2 * (own @ pivots.T)).argmin(axis=1)
        return pa.array(out)

    return of


def _prepared(rows: DataFrame, anchors: Column, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(row, id, label, length, vector, is_anchor, pivot) of the rows that take part."""
    named = rows.select(quoted(id_col).cast("long").alias("id"), quoted(label_col).cast("string").alias("label"),
                        quoted(vector_col).cast("array<double>").alias("raw"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # beyond 2**50, a component times 256 is whole, and may be more than a long holds
    held = F.transform("raw", lambda x: F.greatest(F.least(x * SCALE, F.lit(MOST_COMPONENT)), F.lit(-MOST_COMPONENT)))
    whole = F.transform(held, lambda x: F.when(F.abs(x) < 2.0**58, F.floor(x).cast("double")).otherwise(x))
    kept = named.where(F.col("label").isNotNull() & F.col("raw").isNotNull() & finite).select(
        "id", "label", F.size("raw").alias("length"), whole.alias("vector"), "is_anchor")
    sample = [r["vector"] for r in kept.orderBy(F.xxhash64("vector"), "id").limit(PIVOTS).select("vector").collect()]
    length = len(sample[0]) if sample else 0
    alike = [v for v in sample if len(v) == length]
    pivots = np.array(alike, float).reshape(len(alike), length)
    # rows are numbered and settled before anything refers to their numbers
    return cut(kept.withColumn("pivot", _nearest(pivots)("vector")).withColumn("row", F.monotonically_increasing_id()))


def _split(of: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(of), F.col(parts))


def _searched(anchors: DataFrame, rows: DataFrame, keys: list[str], k: int, group_rows: int, anchor_group: int, cell_rows: int) -> DataFrame:
    """The k first rows per anchor and window, among rows that agree with it in the keys."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    wanted = anchors.groupBy(*keys).agg(F.count("*").alias("anchors"))
    parts = F.greatest(F.ceil(F.col("rows") / group_rows), F.least(F.ceil(F.col("rows") / (2 * cell_rows)), F.lit(LEAST_GROUPS)))
    grid = cut(sizes.join(wanted, keys).select(
        *keys, parts.cast("long").alias("row_parts"), F.ceil(F.col("anchors") / anchor_group).cast("long").alias("anchor_parts")))
    buckets = grid.agg(F.sum(F.col("row_parts") * F.col("anchor_parts"))).first()[0] or 1
    grid = broadcast_if_small(grid)
    bucket = F.concat_ws(":", "r", "a", *keys)
    none = F.lit(None).cast("array<long>")
    left = (anchors.join(grid, keys).withColumn("a", _split("row", "anchor_parts"))
            .withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_parts") - 1)))
            .select(bucket.alias("bucket"), F.lit(0).alias("kind"), F.lit(0).alias("pivot"), "row", F.lit(None).cast("long").alias("id"), "label", "vector", "low", "high"))
    right = (rows.join(grid, keys).withColumn("r", _split("row", "row_parts"))
             .withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("anchor_parts") - 1)))
             .select(bucket.alias("bucket"), F.lit(1).alias("kind"), "pivot", "row", "id", "label", "vector", none.alias("low"), none.alias("high")))
    # the work is in the comparisons, not in the bytes: one part per bucket
    both = left.union(right).repartition(min(int(buckets), 1 << 16), "bucket").sortWithinPartitions("bucket", "kind", "pivot", "row")
    found = both.mapInArrow(_search(k, cell_rows), FOUND)
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, group_rows: int = GROUP_ROWS,
                   anchor_group: int = ANCHOR_GROUP, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors a condition names."""
    own = _prepared(rows, anchors, id_col, vector_col, label_col)
    sizes = {"group_rows": group_rows, "anchor_group": anchor_group, "cell_rows": cell_rows}
    none = F.lit(None).cast("array<long>")
    asked = own.where("is_anchor").select("row", "label", "length", "vector", none.alias("low"), none.alias("high"))
    near = cut(_searched(asked, own, ["length", "label"], positives, **sizes))
    # at most so many positives an anchor: one list each, by rank
    ranked = near.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("near"))
    # the least and the largest whole score of a window, by division of longs
    low = F.expr(f"transform(near, p -> (p.score * {low_percent} + pmod(-(p.score * {low_percent}), 100L)) DIV 100)")
    high = F.expr(f"transform(near, p -> (p.score * {high_percent} - pmod(p.score * {high_percent}, 100L)) DIV 100)")
    windows = own.where("is_anchor").join(ranked, "row").select("row", "label", "length", "vector", low.alias("low"), high.alias("high"))
    far = _searched(windows, own, ["length"], negatives, **sizes)

    positive = near.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = own.where("is_anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return far.join(positive, ["anchor", "window"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
