"""A training-corpus pipeline over ``documents``: each stage is one operator, and what it decides takes effect.

1. language ID drops documents whose language it rejects; it learns from all labelled
   documents of its input outside the held-out fold;
2. exact dedup leaves one document of each group of equal texts;
3. SimHash near-dedup leaves one document of each component;
4. mixing repeats, keeps or drops documents so that sources approach their target weights, and
   lays them out in shards, shuffled;
5. SentencePiece encoding gives each document its sampled piece ids, and the text decoded from them.

Null text counts as empty: it has no language, so the first stage drops it. Repeated
rows are merged by the second; rows that repeat an id with different texts are documents
of their own there, and stay or go together in the third. Extra columns may have any name:
all but the last stage keep them. Texts of any length are read whole. Empty input passes
through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm import exact, langid, mixing, pieces, simhash
from maskloom.runtime import remove, shared_dir

ORACLE_SQL = None  # the classifier, the fingerprints and the sampled pieces have no SQL form


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.keep_known(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), decoded_col="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids",
                        "decoded", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result written and read again before the next; what a
    stage has read is deleted once the next has written its own, but for the last input."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            remove(spark, f"{folder}/{number - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
