"""A training corpus from raw documents, in stages that each read what the last one wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, minhash, mixing, pii, toxicity
from tidemill.llm.frames import shared_dir
from tidemill.llm.queries import TOKENIZER, table

TOXIC = 0.5  # documents that score so much or more go


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney models, trained on the labelled ones, do not call toxic.

    Null and empty texts score as no evidence; repeated rows stay or go
    together; an empty table stays empty, without labels too.
    """
    fitted = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, fitted, keep=tuple(docs.columns)).where(F.col("score") < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates.

    Texts without words are no group's, and all stay; rows that share an id, or
    have none, are told apart by their texts.
    """
    return minhash.distinct_documents(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by its kind; n_chars follows the text. A null text stays null, with a null n_chars."""
    masked = pii.mask(docs, keep=tuple(docs.columns))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources reach their share of words.

    Documents without words take no part and are left out; null sources are one.
    """
    return mixing.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian uint32) of every document; none for null and empty texts."""
    return bpe.encode(docs, TOKENIZER, keep=("doc_id", "lang", "source")).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

# Trained models, components and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
    return docs
