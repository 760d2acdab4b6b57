from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm.language_model import _Filter, _answer, _bits, levels, scores


def brute_base(rows, held):
    tokens = [((t or "").encode().lower().split() + [b" "]) for _, t in rows]
    counts = Counter(w for words, h in zip(tokens, held, strict=True) if not h for w in words)
    total, distinct = sum(counts.values()), len(counts)
    return [(len(words), sum(w in counts for w in words), total,
             sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)) for words in tokens]


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 100_000])
def test_base_scores_equal_brute_force(spark, odd_rows, chunk_bytes):
    rng = random.Random(1)
    rows = odd_rows + [(100 + i, " ".join(rng.choices(["The", "the", "cat", "sat", "on", "mat", "é"], k=30))) for i in range(60)]
    held = [i is not None and i % 3 == 0 for i, _ in rows]
    df = spark.createDataFrame([(*r, 1, h) for r, h in zip(rows, held, strict=True)], "doc_id long, text string, score int, h boolean")
    got = scores(df, F.col("h"), chunk_bytes=chunk_bytes).collect()
    want = sorted((str(i), h, *b[:3], round(b[3], 6)) for (i, _), h, b in zip(rows, held, brute_base(rows, held), strict=True))
    assert sorted((str(r["id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] <= 1e-9 and math.isfinite(r["score"]) for r in got)


def test_order_of_words_matters(spark):
    rng = random.Random(2)
    following = {w: rng.sample(range(200), 3) for w in range(200)}

    def walk(n):
        w, out = rng.randrange(200), []
        for _ in range(n):
            out.append(f"w{w}")
            w = rng.choice(following[w])
        return " ".join(out)

    rows = [(i, walk(100), i % 5 == 1) for i in range(300)]
    got = scores(spark.createDataFrame(rows, "doc_id long, text string, h boolean"), F.col("h")).where("held_out").collect()
    assert sum(r["score"] for r in got) > 0.7 * sum(r["base_score"] for r in got)  # log10: nearer to zero is better
    assert all(r["score"] > r["base_score"] for r in got)


def test_nothing_to_learn_from(spark):
    got = scores(spark.createDataFrame([(1, "a b", True), (2, None, True)], "doc_id long, text string, h boolean"), F.col("h")).collect()
    assert {(r["id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got} == {(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)}
    assert scores(spark.createDataFrame([], "doc_id long, text string"), F.lit(False)).collect() == []


def brute_score(rows, held, spread=1.5, power=0.9):
    """log10 probabilities from exact word and pair counts; a pair counts as the power of two below."""
    tokens = [(t or "").encode().lower().split() + [b" "] for _, t in rows]
    learnt = [words for words, h in zip(tokens, held, strict=True) if not h]
    counts = Counter(w for words in learnt for w in words)
    pairs = Counter(p for words in learnt for p in zip([None] + words, words))
    total, distinct = sum(counts.values()), len(counts)
    scored = []
    for words in tokens:
        whole = 0.0
        for before, word in zip([None] + words, words):
            seen, both = len(learnt) if before is None else counts[before], pairs[before, word]
            plain = (counts[word] + 0.5) / (total + 0.5 * (distinct + 1))
            if seen:
                weight = seen / (seen + spread * seen ** power)
                after = 2 ** (both.bit_length() - 1) / seen if both else 0.0
                plain = weight * after + (1 - weight) * plain
            whole += math.log10(plain)
        scored.append(whole)
    return scored


@pytest.mark.parametrize("most_filter_bytes", [1 << 26, 0])
def test_scores_equal_brute_force(spark, odd_rows, most_filter_bytes):
    """With so many bits an entry, the filter holds no pair by accident; broadcast and probed where it lies."""
    rng = random.Random(5)
    some = [f"w{i}" for i in range(40)] + ["The", "the", "é"]
    rows = odd_rows + [(100 + i, " ".join(rng.choices(some, weights=range(1, 44), k=rng.randrange(80)))) for i in range(150)]
    held = [i is not None and i % 5 == 1 for i, _ in rows]
    df = spark.createDataFrame([(*r, h) for r, h in zip(rows, held, strict=True)], "doc_id long, text string, h boolean").repartition(3)
    got = scores(df, F.col("h"), chunk_bytes=2000, most_filter_bytes=most_filter_bytes, bits_per_entry=2048).collect()
    want = sorted((str(i), round(x, 6)) for (i, _), x in zip(rows, brute_score(rows, held), strict=True))
    assert sorted((str(r["id"]), round(r["score"], 6)) for r in got) == want


def test_both_ways_read_the_same_filter(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(500)], k=200)), i % 5 == 1) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h boolean").repartition(4)
    one, other = ({r["id"]: r["score"] for r in scores(df, F.col("h"), chunk_bytes=10_000, most_filter_bytes=most).collect()}
                  for most in (1 << 26, 0))
    assert one == other


def test_levels_and_probes():
    assert levels(np.array([1, 2, 3, 4, 7, 8, 1 << 40]), 2.0).tolist() == [1, 2, 2, 3, 3, 4, 41]
    rng = np.random.default_rng(1)
    pairs, size = np.unique(rng.integers(0, 1 << 40, 3000).astype(np.uint64)), 1 << 15
    level = rng.integers(1, 6, len(pairs))
    bits = np.zeros(size, bool)
    for k in range(1, 6):
        for places in _bits(pairs[level >= k], k, size):
            bits[places] = True
    got = _Filter({0: np.packbits(bits, bitorder="little").tobytes()}, 8).levels(pairs)
    assert (got >= level).all()  # no false negatives
    assert (got == level).mean() > 0.5


@pytest.mark.parametrize("often", [1, 64])
def test_a_segment_holds_all_its_pairs(often):
    import zlib

    import pyarrow as pa

    from tablelens.llm.language_model import _five_bytes, _packed

    pairs = np.arange(5000, dtype=np.uint64)
    none = np.zeros(0, np.uint64).tobytes()
    asked = pa.table({"slice": pa.array([0], pa.int32()), "chunk": pa.array([0], pa.int64()), "words": [none], "counts": [_packed(np.zeros(0, np.int64))],
                      "pairs": [_five_bytes(pairs)], "pair_counts": [_packed(np.full(5000, often, np.int64))]})
    answer = _answer(2.0, 4.5)(asked).to_pylist()[0]
    level = levels(np.array([often]), 2.0)[0]
    assert answer["filter_bytes"] == len(zlib.decompress(answer["filter"])) == 1 + int(5000 * level * 4.5) // 8
    assert (_Filter({0: zlib.decompress(answer["filter"])}, 8).levels(pairs) >= level).all()
