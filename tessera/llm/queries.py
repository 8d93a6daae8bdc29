"""Registered queries of the operators, and DuckDB SQL where it can express them.

Every query reads its whole tables and whole texts with production parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, exact_dedup, fingerprints, langid, license_scan, mixing, near_dedup, pii, quality, secret_scan, sql, token_counts, whitening
from .common import shared_dir, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rollup = token_counts.Rollup(spark, shared_dir(spark, "token-counts"))
    rollup.apply("words-1", token_counts.word_inserts(docs, "words-1"))
    rollup.apply("byte-bpe-50k-1", token_counts.bpe_inserts(docs, tokenizer, "byte-bpe-50k-1"))
    return rollup.totals()


def token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted as white-space words, one language's revised to the words of the
    stricter tokenizer, one source deleted, and one batch replayed."""
    docs = table(spark, sf_dir, "documents")
    rollup = token_counts.Rollup(spark, shared_dir(spark, "token-rollup"))
    first, strict = token_counts.white_space_inserts(docs, "mixed"), token_counts.word_inserts(docs.where("lang = 'en'"), "mixed")
    rollup.apply("load", first)
    both = strict.unionByName(first.where("lang = 'en'").withColumns({"old_tokens": F.col("tokens"), "tokens": F.lit(None).cast("long")}))
    changed = both.groupBy(*token_counts.KEYS).agg(F.sum("tokens").alias("tokens"), F.sum("old_tokens").alias("old_tokens"))  # nulls are groups
    rollup.apply("revise", changed.withColumn("op", F.lit("revise")))
    gone = token_counts.white_space_inserts(docs.where("source = 'src1' AND lang <> 'en'"), "mixed").withColumn("op", F.lit("delete"))
    rollup.apply("delete", gone)
    rollup.apply("load", first)
    return rollup.totals()


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dedup.near_classes(table(spark, sf_dir, "documents"))
    return classes.select(F.col("id").alias("doc_id"), "class_id", "class_size", "n_links", "kept")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.drop("items")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"), metadata=("n_chars",)))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents known as good are twice, those known as bad half as likely as others."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), quality=quality_weights(spark, sf_dir))
    return mixed.withColumnRenamed("id", "doc_id")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.describe(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_report(table(spark, sf_dir, "documents"))


def queries() -> dict:
    import corpus_pipeline

    own = (op1_license_scan, op2_exact_dedup, op3_token_counts, op4_near_dedup, op5_secret_scan, op6_decontamination, op7_quality, op8_pii, op9_language_id, op10_source_mix, op11_document_fingerprints, op12_embedding_whitening, op13_source_divergence, token_rollup)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return sql.SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
