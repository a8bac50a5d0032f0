"""Queries on references between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.references import orphan_references
from claimloom.registry import CORE
from claimloom.session import table

#: referring table, its row id, its key, and the kind of record the key names
REFERENCES = (
    ("extracted_relations", "relation_id", "target_claim", "claim"),
    ("source_spans", "span_id", "source_id", "source"),
    ("document_chunks", "chunk_id", "document_id", "document"),
)
#: kind of record, its table and key
RECORDS = (
    ("claim", "extracted_claims", "claim_id"),
    ("source", "source_documents", "source_id"),
    ("document", "source_documents", "document_id"),
)


def faulty_references(spark: SparkSession, d: str) -> DataFrame:
    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    refs = union([
        table(spark, d, t).select(F.lit(t).alias("ref_table"), F.col(i).alias("row_id"), F.lit(kind).alias("kind"), F.col(k).alias("key"), F.col("ingested_at").alias("at"))
        for t, i, k, kind in REFERENCES
    ])
    parents = union([table(spark, d, t).select(F.lit(kind).alias("kind"), F.col(k).alias("key"), F.col("ingested_at").alias("at")) for kind, t, k in RECORDS])
    withdrawn = table(spark, d, "withdrawn_records").select(F.col("record_kind").alias("kind"), F.col("record_key").alias("key"), F.col("withdrawn_at").alias("at"))
    return orphan_references(refs, parents, withdrawn)


_FAULTS = """
WITH refs AS (
  SELECT 'extracted_relations' AS referring_table, relation_id AS row_id, 'claim' AS kind, target_claim AS k, ingested_at FROM extracted_relations
  UNION ALL SELECT 'source_spans', span_id, 'source', source_id, ingested_at FROM source_spans
  UNION ALL SELECT 'document_chunks', chunk_id, 'document', document_id, ingested_at FROM document_chunks),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY referring_table, row_id ORDER BY ingested_at NULLS LAST, k NULLS LAST) AS rn FROM refs) WHERE rn = 1 AND k IS NOT NULL),
parents AS (
  SELECT kind, k, min(ingested_at) AS p_at FROM (
    SELECT 'claim' AS kind, claim_id AS k, ingested_at FROM extracted_claims
    UNION ALL SELECT 'source', source_id, ingested_at FROM source_documents
    UNION ALL SELECT 'document', document_id, ingested_at FROM source_documents) GROUP BY kind, k),
gone AS (SELECT record_kind AS kind, record_key AS k, min(withdrawn_at) AS w_at FROM withdrawn_records GROUP BY ALL),
faults AS (
  SELECT f.referring_table, f.row_id, f.k AS bad_key, f.ingested_at,
    CASE WHEN p.k IS NULL THEN 'missing' WHEN g.w_at <= f.ingested_at THEN 'deleted' WHEN p.p_at > f.ingested_at THEN 'late' END AS fault
  FROM firsts f LEFT JOIN parents p ON f.kind = p.kind AND f.k = p.k LEFT JOIN gone g ON f.kind = g.kind AND f.k = g.k)
"""


@CORE.query("p6_found", _FAULTS + "SELECT referring_table, row_id, bad_key, fault FROM faults WHERE fault IS NOT NULL")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """One row for each faulty reference."""
    return faulty_references(spark, d).select(F.col("ref_table").alias("referring_table"), "row_id", F.col("key").alias("bad_key"), "fault")


@CORE.query(
    "p6_by_month",
    _FAULTS + "SELECT referring_table, strftime(ingested_at, '%Y-%m') AS month, fault, count(*) AS n FROM faults WHERE fault IS NOT NULL GROUP BY ALL",
)
def p6_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Faulty references per table, month and fault."""
    return (
        faulty_references(spark, d)
        .groupBy(F.col("ref_table").alias("referring_table"), F.date_format("at", "yyyy-MM").alias("month"), "fault")
        .agg(F.count(F.lit(1)).alias("n"))
    )
