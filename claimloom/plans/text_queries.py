"""Queries on text functions, chunks and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text as t
from claimloom.operators.chunking import chunk_documents, section_paths
from claimloom.plans import fragments as sql
from claimloom.registry import CORE
from claimloom.session import table
from claimloom.sources.files import media_type


@CORE.query("fingerprints", f"SELECT DISTINCT claim_id, {sql.fingerprint('text')} AS fingerprint, len(list_distinct({sql.tokens('text')})) AS n_tokens FROM extracted_claims")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of claims."""
    return table(spark, d, "extracted_claims").select("claim_id", t.fingerprint("text").alias("fingerprint"), F.size(F.array_distinct(t.fingerprint_tokens("text"))).alias("n_tokens")).distinct()


NORM = r"regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"


@CORE.query("normalised_documents", f"SELECT doc_id, sha256({NORM}) AS text_hash, length({NORM}) AS n_chars FROM documents")
def normalised_documents(spark: SparkSession, d: str) -> DataFrame:
    """Hash and length of the normalised texts."""
    n = table(spark, d, "documents").select("doc_id", t.normalize_text("text").alias("x"))
    return n.select("doc_id", F.sha2("x", 256).alias("text_hash"), F.length("x").alias("n_chars"))


@CORE.query("nfkc_documents")
def nfkc_documents(spark: SparkSession, d: str) -> DataFrame:
    """Hash of the texts normalised after NFKC."""
    return table(spark, d, "documents").select("doc_id", F.sha2(t.normalize_text("text", True), 256).alias("text_hash"))


@CORE.query("slugs", f"SELECT DISTINCT title, coalesce(nullif(substr(array_to_string(regexp_extract_all({sql.fold('title')}, '[a-z0-9]+'), '_'), 1, 48), ''), 'unknown') AS slug FROM source_documents WHERE title IS NOT NULL")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of titles."""
    return table(spark, d, "source_documents").filter("title is not null").select("title", t.safe_slug("title").alias("slug")).distinct()


@CORE.query("media_types", "SELECT CASE WHEN ends_with(lower(file_name), '.txt') THEN 'text/plain' WHEN ends_with(lower(file_name), '.md') THEN 'text/markdown' WHEN ends_with(lower(file_name), '.jsonl') THEN 'application/x-ndjson' WHEN ends_with(lower(file_name), '.pdf') THEN 'application/pdf' ELSE 'application/octet-stream' END AS inferred, count(*) AS n FROM source_documents GROUP BY 1")
def media_types(spark: SparkSession, d: str) -> DataFrame:
    """Media types as the file names tell."""
    suffix = F.lower(F.regexp_extract("file_name", r"(\.[^.]*)$", 1))
    return table(spark, d, "source_documents").groupBy(media_type(suffix).alias("inferred")).agg(F.count(F.lit(1)).alias("n"))


@CORE.query("iso_times", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE date_trunc('second', ts) - CASE WHEN event_id % 3 = 1 THEN INTERVAL 0 HOUR ELSE INTERVAL 2 HOUR END END AS instant FROM events")
def iso_times(spark: SparkSession, d: str) -> DataFrame:
    """Instants of ISO strings with Z, with an offset, and (null) without a zone."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, iso).when(F.col("event_id") % 3 == 1, F.concat(iso, F.lit("Z"))).otherwise(F.concat(iso, F.lit("+02:00")))
    return table(spark, d, "events").select("event_id", t.iso_timestamp(text).cast("timestamp_ntz").alias("instant"))


@CORE.query("json_props", "SELECT event_type, count(*) AS n, sum(TRY_CAST(props ->> '$.k' AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """A field of the events' JSON summed."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@CORE.query("summaries", f"SELECT DISTINCT claim_id, substr({sql.SQUEEZE.format(x='text')}, 1, 280) AS neutral_summary, 'Source-grounded note: ' || substr({sql.SQUEEZE.format(x='text')}, 1, 280) AS teaching_note FROM extracted_claims")
def summaries(spark: SparkSession, d: str) -> DataFrame:
    """Views of a claim's text."""
    s = F.substring(t.squeeze("text"), 1, 280)
    return table(spark, d, "extracted_claims").select("claim_id", s.alias("neutral_summary"), F.concat(F.lit("Source-grounded note: "), s).alias("teaching_note")).distinct()


@CORE.query("document_chunks_made", sql.chunks() + f"SELECT 'chunk_' || {sql.digest('document_id', 'chunk_index', 'a', 'z', 'piece')} AS chunk_id, document_id, chunk_index::INTEGER AS chunk_index, piece AS text, a AS start_char, z AS end_char, path AS section_path FROM chunks")
def document_chunks_made(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all source documents."""
    return chunk_documents(table(spark, d, "source_documents"))


@CORE.query("chunk_sections", sql.chunks() + "SELECT document_id, array_to_string(path, ' > ') AS section, count(*) AS n FROM chunks GROUP BY ALL")
def chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by section of the source documents."""
    return section_paths(table(spark, d, "source_documents"))


@CORE.query("chunk_slices", "SELECT count(*) AS n, sum(CASE WHEN substr(d.text, c.start_char + 1, c.end_char - c.start_char) = c.text THEN 1 ELSE 0 END)::BIGINT AS n_equal FROM (SELECT DISTINCT chunk_id, document_id, text, start_char, end_char FROM document_chunks) c JOIN (SELECT document_id, min(text) AS text FROM source_documents GROUP BY 1) d USING (document_id)")
def chunk_slices(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks are the slice of their document that their offsets say."""
    c = table(spark, d, "document_chunks").select("chunk_id", "document_id", F.col("text").alias("c"), "start_char", "end_char").distinct()
    docs = table(spark, d, "source_documents").groupBy("document_id").agg(F.min("text").alias("text"))
    same = F.substr("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) == F.col("c")
    return c.join(docs, "document_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(same, 1).otherwise(0)).alias("n_equal"))


@CORE.query("token_overlap", f"""WITH c AS (SELECT DISTINCT claim_id, list_distinct({sql.tokens('text')}) AS a, list_distinct({sql.tokens('normalized_text')}) AS b FROM extracted_claims)
SELECT claim_id, CASE WHEN len(coalesce(a, [])) = 0 AND len(coalesce(b, [])) = 0 THEN 1.0::DOUBLE WHEN len(coalesce(a, [])) = 0 OR len(coalesce(b, [])) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS jaccard FROM c""")
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of each claim's two texts."""
    empty = F.array().cast("array<string>")
    c = table(spark, d, "extracted_claims").select("claim_id", F.coalesce(F.array_distinct(t.fingerprint_tokens("text")), empty).alias("a"), F.coalesce(F.array_distinct(t.fingerprint_tokens("normalized_text")), empty).alias("b")).distinct()
    return c.select("claim_id", F.round(t.jaccard("a", "b"), 6).alias("jaccard"))
