from __future__ import annotations

import random

import zstandard
from pyspark.sql import functions as F

from tablelens.llm import toxicity


def made(n, seed):
    """Ordinary words with, in every fourth text, insults among them."""
    rng = random.Random(seed)
    syllables = ["tha", "re", "ing", "en", "or", "ed", "sti", "ou", "ble", "nd"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(rng.randrange(30, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2 + len(words) // 40):
                words[rng.randrange(len(words))] = rng.choice(["jerkface", "dumbo", "vilescum", "hateyou"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = made(1200, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic").where("doc_id % 3 != 0"), per_class=300)
    got = docs.where("doc_id % 3 = 0").select("toxic", toxicity.score(F.col("text"), model).alias("s")).collect()
    found = [r["toxic"] for r in got if r["s"] >= 0.3]
    assert sum(found) >= 0.9 * sum(r["toxic"] for r in got) and sum(found) >= 0.9 * len(found)
    again = toxicity.train(docs.repartition(5), docs.select("doc_id", "toxic").where("doc_id % 3 != 0"), per_class=300)
    assert again == model


def test_odd_rows_and_missing_labels(spark, odd_rows):
    rows = made(200, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    odd = spark.createDataFrame([(*r, "x") for r in odd_rows], "doc_id long, text string, score string")
    labels = docs.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (1, None), (2, 7), (99999, 1)], "doc_id long, toxic int"))
    model = toxicity.train(docs.select("doc_id", "text").union(odd.select("doc_id", "text")), labels)
    got = odd.select(toxicity.score(F.col("text"), model).alias("s")).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["s"] <= 1 for r in got)
    for some in (labels.where("toxic = 0"), labels.where("false")):
        blind = toxicity.train(docs, some)
        assert {r["s"] for r in odd.select(toxicity.score(F.col("text"), blind).alias("s")).collect()} == {blind.constant}
    assert toxicity.train(docs.where("false"), labels).weights == ()


def test_one_text_of_an_id_counts(spark):
    rows = made(300, 4)
    docs = spark.createDataFrame([(i // 2, t, x) for i, t, x in rows], "doc_id long, text string, toxic int")
    labels = docs.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    models = [toxicity.train(docs.repartition(n).orderBy(F.rand(n)), labels) for n in (1, 7)]
    assert models[0] == models[1] and models[0].weights


def test_distances_equal_plain_compression(spark):
    """Every window compressed anew with each dictionary."""
    rows = made(400, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    known = toxicity._distances(model.ordinary, model.toxic)
    settings = zstandard.ZstdCompressionParameters(
        compression_level=9, strategy=zstandard.STRATEGY_BTLAZY2, min_match=4, window_log=16, hash_log=14,
        chain_log=14, search_log=4, target_length=32, write_content_size=0, write_dict_id=0, write_checksum=0)

    def size(content, window):
        held = zstandard.ZstdCompressionDict(content + toxicity.CARRIER + toxicity.TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress(window))

    for part in [b"jerkface", b"dumbo", b"thaing", b"zzzz", b"x" * 64, "é".encode(), b"vilescumthe"]:
        window = toxicity.CARRIER + b" " + part + b" " + toxicity.TAIL
        assert known[part] == size(model.ordinary, window) - size(model.ordinary + model.toxic, window)
    assert known[b"jerkface"] >= toxicity.THRESHOLDS[0] > known[b"thaing"]
