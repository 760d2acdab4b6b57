"""From raw documents to encoded training data, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again before the next one; all but the last return the columns of
documents.  Tables other than documents are read from sf_dir.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm import mixing, pieces, quality, simhash, toxicity
from tablelens.llm.common import cut
from tablelens.llm.queries import TOXIC_FROM, fold, table

#: Bytes of text a task hands to Python at a time; Spark's own 64 MB are held several times over on the way.
BATCH_BYTES = 8 << 20
#: Learned models and sampling by digests: no SQL over the tables gives these rows.
ORACLE_SQL = None


def small_batches(spark: SparkSession) -> None:
    """Long texts in few-megabyte batches, so that a task's memory does not depend on their length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def leave_out_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labelled documents at hand."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(~fold("doc_id", 4, 2))
    model = toxicity.train(docs, labels)
    return docs.where(toxicity.score(F.col("text"), model) < TOXIC_FROM)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.accepted(docs, "v1")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    small_batches(spark)
    return simhash.deduplicated(docs, shingle=3, distance=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether decoding gives its text back."""
    small_batches(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    done = docs.select("doc_id", "lang", "source", pieces.coded(F.col("text"), path).alias("c"))
    return done.select("doc_id", "lang", "source", F.size("c.piece_ids").cast("long").alias("n_pieces"), "c.piece_ids", "c.round_trip")


STAGES = [
    ("toxicity", leave_out_toxic),
    ("quality rules", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is settled before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
