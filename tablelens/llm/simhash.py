"""Near-duplicates by SimHash and multi-index hashing.

A text's fingerprint has 64 bits; a bit is 1 if more than half of the hashes of
its word shingles (repeats included) have it set.  Fingerprints that differ in
few bits link.  They are found by multi-index hashing: cut into segments such
that linked fingerprints differ by at most one bit in some segment, the index
table holds every segment value, each fingerprint probes the small Hamming ball
around its own segment values, and whatever the table returns is verified over
all 64 bits.

What happens in special cases: a null text counts as empty; a text with fewer
words than a shingle is hashed whole; one without words has fingerprint zero,
which links like any other; equal rows each keep a row of their own; ids may be
null (they never become a component's name while it has another id); other
columns of the table are not read, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import components, cut, free_name, give_back, quoted, raw_bytes

HASH_SEED = 42
#: Shingles hashed at a time: bounds memory for texts of any length.
BLOCK = 1 << 16
#: A segment value with more fingerprints than this is not compared pair by pair.
FULL_BUCKET = 64


def _shingle_hashes(text: bytes, size: int):
    """Blocks of shingle hashes of one text."""
    parts = text.lower().split()
    if not parts:
        return
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    count = max(1, len(parts) - size + 1)
    starts, ends = starts[:count].tolist(), ends[min(size, len(parts)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, count, BLOCK):
        spans = zip(starts[at:at + BLOCK], ends[at:at + BLOCK], strict=True)
        yield np.array([digest(joined[s:e], HASH_SEED) for s, e in spans], np.uint64)


def simhash(text: bytes, size: int) -> int:
    """Fingerprint of one text as a signed 64-bit integer."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in _shingle_hashes(text, size):
        total += len(hashes)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    chosen = np.packbits(2 * ones > total, bitorder="little") if total else np.zeros(8, np.uint8)
    return int(chosen.view(np.int64)[0])


def fingerprint(text: Column, size: int) -> Column:
    """Fingerprint of a text column as long."""

    @F.arrow_udf("long")
    def of(values: pa.Array) -> pa.Array:
        found = pa.array((simhash(v, size) for v in raw_bytes(values)), pa.int64(), size=len(values))
        give_back()
        return found

    return of(text.cast("binary"))


def _segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of segments of which one differs by one bit at most."""
    count = (distance + 2) // 2
    edges = [64 * i // count for i in range(count + 1)]
    return list(zip(edges, [b - a for a, b in zip(edges, edges[1:])]))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _ball(bits: list[int], distance: int) -> list[int]:
    """XOR masks of all subsets of `distance` bits at most."""
    return [_signed(sum(1 << i for i in chosen)) for n in range(distance + 1) for chosen in combinations(bits, n)]


def fingerprint_links(fingerprints: DataFrame, distance: int = 2, full_bucket: int = FULL_BUCKET) -> DataFrame:
    """Pairs (a, b) of different fingerprints at most `distance` bits apart.

    `fingerprints` has the column fp, without repeats.  Every pair is found at
    least once.  A pair that differs in one bit of a segment is found from the
    fingerprint that has a zero there, so only zero bits are flipped.  Segment
    values shared by more than `full_bucket` fingerprints are not joined pair
    by pair: whoever probes one goes through the Hamming ball of the remaining
    bits and looks for equality, which costs a fixed number of probes each and
    returns links only.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3 bits")
    tables, probes, moved, balls = [], [], [], []
    for k, (first, bits) in enumerate(_segments(distance)):
        key = f"(shiftrightunsigned(fp, {first}) & {_signed((1 << bits) - 1)}L)"
        outside = [i for i in range(64) if not first <= i < first + bits]
        tables.append(f"named_struct('segment', {k}, 'key', {key})")
        # -1 is the segment value itself, the others flip one zero bit
        probes.append(f"""transform(sequence(-1, {bits - 1 if distance else -1}), i -> named_struct('segment', {k}, 'key',
            CASE WHEN i < 0 THEN {key} WHEN {key} & shiftleft(1L, i) = 0 THEN {key} | shiftleft(1L, i) END,
            'used', int(i >= 0)))""")
        # the fingerprint with this segment set to the probed value, and what may differ beside it
        kept = _signed(~(((1 << bits) - 1) << first) & ((1 << 64) - 1))
        moved.append(f"WHEN segment = {k} THEN (a & {kept}L) | shiftleft(key, {first})")
        for used in range(min(distance, 1) + 1):
            masks = ", ".join(f"{m}L" for m in _ball(outside, distance - used))
            balls.append(f"WHEN segment = {k} AND used = {used} THEN array({masks})")
    table = fingerprints.selectExpr("fp", f"explode(array({', '.join(tables)})) AS t").selectExpr("fp", "t.segment", "t.key")
    full = table.groupBy("segment", "key").count().where(F.col("count") > full_bucket).select("segment", "key")
    probe = fingerprints.selectExpr("fp AS a", f"explode(concat({', '.join(probes)})) AS p")
    probe = probe.selectExpr("a", "p.segment", "p.key", "p.used").where("key IS NOT NULL")

    ordinary = probe.join(table.join(full, ["segment", "key"], "left_anti"), ["segment", "key"])
    verified = ordinary.where(f"(used = 1 OR a < fp) AND bit_count(a ^ fp) <= {distance}")
    crowded = probe.join(full, ["segment", "key"]).selectExpr(
        "a", "used", f"CASE {' '.join(moved)} END AS moved", f"explode(CASE {' '.join(balls)} END) AS mask")
    around = crowded.selectExpr("a", "used", "moved ^ mask AS fp")
    met = around.join(fingerprints.select("fp"), "fp").where("used = 1 OR a < fp")
    return verified.selectExpr("a", "fp AS b").union(met.selectExpr("a", "fp AS b"))


def _grouped(each: DataFrame, distance: int, full_bucket: int) -> DataFrame:
    """Rows (id, fp, ...) with `root`, equal for all rows that links hold together, and `component`.

    Rows with equal fingerprints are one node, so copies cost nothing beyond
    their fingerprint.
    """
    nodes = cut(each.groupBy("fp").agg(F.min("id").alias("least_id")))
    links = fingerprint_links(nodes.select("fp"), distance, full_bucket)
    joined = components(links, "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = nodes.join(joined, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component"))
    return each.join(rooted.join(least, "root").select("fp", "root", "component"), "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       distance: int = 2, full_bucket: int = FULL_BUCKET) -> DataFrame:
    """(id, fp long, component) for every row: component is the smallest id reachable by links."""
    each = cut(docs.select(quoted(id_col).alias("id"), fingerprint(quoted(text_col), shingle).alias("fp")))
    return _grouped(each, distance, full_bucket).select("id", "fp", "component")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 distance: int = 2, full_bucket: int = FULL_BUCKET) -> DataFrame:
    """One row of each group stays: that of the smallest id (null last), of several the one of the smallest hash.

    Only ids, fingerprints and two hashes of each row are grouped; the rows
    themselves move once, to meet the hashes of those that stay.
    """
    comparable = [F.to_json(quoted(f.name)) if "map<" in f.dataType.simpleString() else quoted(f.name) for f in docs.schema.fields]
    first, second = free_name(docs, "__row"), free_name(docs, "__row2")
    hashes = [F.xxhash64(*comparable).alias(first), F.xxhash64(F.lit(1), *comparable).alias(second)]
    each = cut(docs.select(quoted(id_col).alias("id"), fingerprint(quoted(text_col), shingle).alias("fp"), *hashes))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", first, second)).alias("best")
    stays = _grouped(each, distance, full_bucket).groupBy("root").agg(best).select(f"best.{first}", f"best.{second}")
    # equal rows have equal hashes, and one of them is enough
    met = docs.select("*", *hashes).join(stays, [first, second])
    return met.dropDuplicates([first, second]).select([quoted(c) for c in docs.columns])


def hex_digits(fp: Column) -> Column:
    """16 lower-case hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
