"""A training corpus from documents: each stage works on all rows that the stage before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegraph_spark.llm import bpe, decontaminate, langid, neardup, secrets
from codegraph_spark.llm.common import ROW_DOC, ROW_HASH, cut, ensure_checkpoint_dir, row_identity


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no recognisable language (null, or no letter); a missing label becomes the predicted one.

    Each row is judged by its own text; null and repeated ids change nothing.
    """
    found = langid.identify(docs, langid.learn(docs)).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) one row stays.

    It is the row with the smallest id; a null id comes after all others, and rows of one id are ordered by a hash of the row.
    Of rows that are equal in every column one stays. Rows with the same id and other texts are judged each by its own text.
    """
    named = docs.select("*", F.col("doc_id").cast("long").alias(ROW_DOC), F.xxhash64(*docs.columns).alias(ROW_HASH))
    groups = cut(neardup.near_copy_components(named))
    kept = groups.groupBy("component").agg(F.min(F.struct(F.col(ROW_DOC).isNull().alias("none"), ROW_DOC, ROW_HASH)).alias("kept"))
    kept = cut(kept.select(F.coalesce(f"kept.{ROW_DOC}", F.lit(-(2**63))).alias(ROW_DOC), f"kept.{ROW_HASH}"))
    identity = [F.coalesce(ROW_DOC, F.lit(-(2**63))).alias(ROW_DOC), F.col(ROW_HASH)]
    repeated = cut(groups.groupBy(*identity).agg(F.count("*").alias("n")).where("n > 1").join(kept, [ROW_DOC, ROW_HASH], "left_semi").drop("n"))
    gone = groups.select(*identity).join(kept, [ROW_DOC, ROW_HASH], "left_anti")
    rest = named.withColumn(ROW_DOC, identity[0]).join(gone, [ROW_DOC, ROW_HASH], "left_anti")
    if not repeated.isEmpty():  # rows that are equal in every column: only these are grouped
        many = rest.join(repeated, [ROW_DOC, ROW_HASH], "left_semi").dropDuplicates([ROW_DOC, ROW_HASH])
        rest = rest.join(repeated, [ROW_DOC, ROW_HASH], "left_anti").unionByName(many)
    return rest.select(docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more is in passages of a benchmark.

    Each row is judged by its own text, also where ids are null or repeated; equal rows stay or go together.
    """
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), identity=True)
    gone = found.where("contaminated").select(ROW_DOC, ROW_HASH).distinct()
    named = docs.select("*", *row_identity(F.col("doc_id"), F.col("text")))
    return named.join(gone, [ROW_DOC, ROW_HASH], "left_anti").select(docs.columns)


def secret_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by its kind, row by row; null and repeated ids change nothing."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian 32-bit integers) of each document, and the digest of what they decode to, row by row; null and repeated ids pass through."""
    coded = bpe.encode(docs)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language), ("simhash_near_dedup", near_copies), ("benchmark_decontamination", benchmark_free), ("secret_scan", secret_free), ("byte_bpe", tokens)]

#: SQL has no string kernels, near-copy components or BPE; tests hold the near-copy stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder, read again by the next."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}-{name}")
        docs = spark.read.parquet(f"{folder}/{n}-{name}")
    return docs
