"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, debruijn, fingerprints, minhash, mixing, oracles, pii, quality, suffixes, toxicity, urls

TOKENIZER = "public:byte_bpe_50k.json"
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The banding and verification of ``op5_fingerprints``: each document's class of near fingerprints."""
    return fingerprints.near_classes(op5_fingerprints(spark, sf_dir))


def op6_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.deduplicate(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op8_mixing_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_mixing_full(spark, sf_dir).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op3_quality`` counts, whatever the field makes of the lines."""
    return op3_quality(spark, sf_dir).drop("content_share", "kept")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that ``op5_fingerprints`` compares."""
    return op5_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets that ``op8_mixing`` meets."""
    return op8_mixing_full(spark, sf_dir).groupBy("source").agg(F.max("source_size").alias("source_size"), F.round(F.max("target"), 3).alias("target"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_suffixes": op2_suffixes,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_fingerprints": op5_fingerprints,
    "op6_debruijn": op6_debruijn,
    "op7_pii": op7_pii,
    "op8_mixing": op8_mixing,
    "op9_minhash": op9_minhash,
    "op10_urls": op10_urls,
    "fingerprint_classes": fingerprint_classes,
    "quality_base": quality_base,
    "edited_texts": edited_texts,
    "mixing_targets": mixing_targets,
}

SQL: dict[str, str] = {
    "op2_suffixes": oracles.SUFFIXES,
    "quality_base": oracles.QUALITY_BASE,
    "edited_texts": oracles.EDITED,
    "mixing_targets": oracles.TARGETS,
    "op6_debruijn": oracles.DEBRUIJN,
    "op9_minhash": oracles.MINHASH,
    "op10_urls": oracles.urls_sql(URL_RULES),
}
