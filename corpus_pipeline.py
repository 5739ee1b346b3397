"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on whatever the stage before has kept; all but the
last return the columns of documents. Results between stages are stored.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import packing, pii, simhash, toxicity
from quarry.llm.common import materialize
from quarry.llm.tables import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores at a half or more go. It learns from the labelled rows of
    documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.reject(docs, toxicity.learn(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return simhash.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048: one row a piece, with its place."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), public_tokenizers.PATTERN, outputs=("ids_crc32",))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("personal_data", mask_personal_data), ("packing", pack)]

#: SQL can't express the grammar's and the tagger's training.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
