"""Queries from texts to claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text as t
from claimloom.operators.claims import extract_claims
from claimloom.plans import fragments as sql
from claimloom.registry import CORE
from claimloom.session import table

FROM_DOCS = sql.claims("documents", "doc_id", "doc_id", "text")
_FROM_CHUNKS = sql.claims("(SELECT DISTINCT chunk_id, document_id, text, start_char FROM document_chunks)", "document_id", "chunk_id", "text")


def _doc_claims(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return extract_claims(docs.withColumn("chunk_id", F.col("doc_id")), "doc_id", "chunk_id", "text").withColumnRenamed("doc_id", "document_id")


def _chunk_claims(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "document_chunks").select("chunk_id", "document_id", "text", "start_char").distinct()
    return extract_claims(chunks, "document_id", "chunk_id", "text", "start_char")


@CORE.query(
    "claims_by_type",
    FROM_DOCS + f"SELECT claim_type, cue_category, count(*) AS n_claims, count(DISTINCT document_id) AS n_documents, {sql.mean_rounded('confidence', 3, 4)} AS mean_confidence FROM claims GROUP BY ALL",
)
def claims_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Claims, documents and mean confidence by type and cue."""
    return _doc_claims(spark, d).groupBy("claim_type", "cue_category").agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_distinct("document_id").alias("n_documents"), t.mean_rounded("confidence", 3, 4).alias("mean_confidence")
    )


@CORE.query(
    "chunk_claims",
    _FROM_CHUNKS + f"SELECT document_id, chunk_id, 'claim_' || {sql.digest('document_id', 'chunk_id', 'normalized_text')} AS claim_id, text, normalized_text, claim_type, cue_category, confidence FROM claims",
)
def chunk_claims(spark: SparkSession, d: str) -> DataFrame:
    """All candidate claims of the chunks with their ids."""
    return _chunk_claims(spark, d).select("document_id", "chunk_id", "claim_id", "text", "normalized_text", "claim_type", "cue_category", "confidence")


@CORE.query(
    "chunk_claim_offsets",
    sql.placed_claims("(SELECT DISTINCT chunk_id, document_id, text, start_char FROM document_chunks)", "document_id", "chunk_id", "text", "start_char")
    + f"SELECT chunk_id, 'claim_' || {sql.digest('document_id', 'chunk_id', 'normalized_text')} AS claim_id, sentence_index, source_start_char, source_end_char FROM placed",
)
def chunk_claim_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each claim stands in its document."""
    return _chunk_claims(spark, d).select("chunk_id", "claim_id", "sentence_index", "source_start_char", "source_end_char")


_MAJORITY = """
, counts AS (SELECT document_id, claim_type, count(*) AS n FROM claims GROUP BY ALL)
SELECT document_id, arg_min(claim_type, (-n, claim_type)) AS claim_type, max(n) AS n FROM counts GROUP BY document_id"""


@CORE.query("majority_claim_type", FROM_DOCS + _MAJORITY)
def majority_claim_type(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent claim type of each document, ties by name."""
    n = _doc_claims(spark, d).groupBy("document_id", "claim_type").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("document_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "claim_type")).alias("b"))
    return best.select("document_id", F.col("b.claim_type").alias("claim_type"), (-F.col("b.m")).alias("n"))


@CORE.query(
    "family_representatives",
    f"""WITH c AS (SELECT DISTINCT claim_id, document_id, text, confidence FROM extracted_claims),
f AS (SELECT *, {sql.fingerprint('text')} AS print FROM c)
SELECT print AS canonical_fingerprint, 'family_' || {sql.digest('print')} AS family_id, arg_min(claim_id, (-coalesce(confidence, 0), length(text), claim_id)) AS representative_claim_id,
  count(*) AS evidence_count, count(DISTINCT document_id) AS independent_source_count_proxy, {sql.mean_rounded('confidence', 3, 3)} AS confidence_summary
FROM f WHERE print <> '' GROUP BY print""",
)
def family_representatives(spark: SparkSession, d: str) -> DataFrame:
    """Claims with one fingerprint: representative, members, sources and mean confidence."""
    c = table(spark, d, "extracted_claims").select("claim_id", "document_id", "text", "confidence").distinct().withColumn("print", t.fingerprint("text")).filter("print <> ''")
    order = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("a"), F.length("text").alias("b"), F.col("claim_id").alias("c"))
    return c.groupBy(F.col("print").alias("canonical_fingerprint")).agg(
        F.min(order).alias("o"), F.count(F.lit(1)).alias("evidence_count"), F.count_distinct("document_id").alias("independent_source_count_proxy"), t.mean_rounded("confidence", 3, 3).alias("confidence_summary")
    ).select("canonical_fingerprint", t.stable_id("family", "canonical_fingerprint").alias("family_id"), F.col("o.c").alias("representative_claim_id"), "evidence_count", "independent_source_count_proxy", "confidence_summary")
