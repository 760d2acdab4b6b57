from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tablelens.llm.common import components
from tablelens.llm.simhash import fingerprint_links, hex_digits, simhash, simhash_components


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, distance):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


TEXTS = ["", None, "one", "One two", "a b c", "A  b\tc", "É a b c d e", "a b c d e f g h", "a b c d e f g h", " \n ",
         "x " * 200_000, "a\x0bb\x0cc d", "a b c d"]


def test_fingerprints_equal_the_definition():
    for text in TEXTS:
        assert simhash((text or "").encode(), 3) % (1 << 64) == brute_fingerprint(text), text and text[:20]


@pytest.mark.parametrize("distance,full", [(0, 64), (1, 3), (2, 64), (2, 2), (3, 64), (3, 4)])
def test_links_equal_brute_force(spark, distance, full):
    rng = random.Random(distance)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    values = set(centres)
    for _ in range(150):
        v = rng.choice(sorted(values))
        for _ in range(rng.randrange(1, 4)):
            v ^= 1 << rng.choice([rng.randrange(64), rng.randrange(4), 63])
        values.add(v)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    links = fingerprint_links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"), distance, full)
    got = {frozenset(r) for r in links.collect()}
    want = {frozenset((signed[a], signed[b])) for a in values for b in values
            if a != b and (a ^ b).bit_count() <= distance}
    assert got == want


def test_components_of_rows(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for i in range(60):
        parts = rng.choice(base).split()
        parts[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((100 + i, " ".join(parts)))
    rows += [(None, "a b c"), (100, rows[-1][1]), (100, rows[-1][1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, component int")
    got = simhash_components(df, full_bucket=3).select("id", hex_digits("fp").alias("f"), "component").collect()
    prints = {t: brute_fingerprint(t) for _, t in rows}
    roots = brute_components(set(prints.values()), 2)
    least = {}
    for i, t in rows:
        if i is not None:
            least[roots[prints[t]]] = min(i, least.get(roots[prints[t]], i))
    want = sorted([str((i, f"{prints[t]:016x}", least[roots[prints[t]]])) for i, t in rows])
    assert sorted(str(tuple(r)) for r in got) == want


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hubs_are_split(spark):
    """A star of many links, chains and cycles; whatever counts as a hub, components are the same."""
    links = [(0, i) for i in range(1, 3001)] + [(5000 + i, 5001 + i) for i in range(40)] + [(9000, 9001), (9001, 9002), (9002, 9000), (3000, 7000), (8000, 8000), (None, 1)]
    df = spark.createDataFrame(links, "a long, b long")
    want = {**{i: 0 for i in [*range(3001), 7000]}, **{5000 + i: 5000 for i in range(41)}, 9000: 9000, 9001: 9000, 9002: 9000}
    for hub in (None, 100, 7):
        got = {r["node"]: r["component"] for r in components(df, "a", "b", hub_links=hub).collect()}
        assert {n: got.get(n, n) for n in want} == want and set(got) <= set(want)


def test_a_hub_is_dealt_to_many_tasks(spark):
    from tablelens.llm.common import _meet_lowest

    rows = spark.range(1, 20001).selectExpr("0L AS u", "id AS v")
    low = rows.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("links"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        met = _meet_lowest(rows, low, 1000)
        sizes = [r["n"] for r in met.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 20000 and met.where("low != 1").count() == 0
        assert max(sizes) < 12000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
