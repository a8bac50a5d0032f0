"""Queries through sources, sinks and streams: what is written and read again is what it was."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text as t
from claimloom.operators import controls, records, tensors
from claimloom.operators.audits import union_all
from claimloom.plans import fragments as sql
from claimloom.plans.capsule_queries import capsules_once
from claimloom.plans.claim_queries import FROM_DOCS
from claimloom.plans.control_queries import BASE, related_capsules
from claimloom.plans.text_queries import NORM
from claimloom.registry import CORE
from claimloom.session import is_file, scratch_path, table
from claimloom.sources import bundles, files, packages
from claimloom.streaming import claims as stream


def _source_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Source documents as files of three kinds, with their metadata beside them: Markdown, text, and JSON lines of a record and a broken line."""
    one = table(spark, d, "source_documents").filter("document_id is not null and text is not null").groupBy("document_id").agg(F.min_by(F.struct("text", "title", "authors", "published_at", "license", "source_url", "domains"), F.struct("ingested_at", "text")).alias("r")).select("document_id", "r.*")
    kind = F.length("text") % 3
    suffix = F.when(kind == 0, ".md").when(kind == 1, ".txt").otherwise(".jsonl")
    record = F.concat(F.to_json(F.struct("text", "title")), F.lit("\n{broken\n"))
    own = one.select(
        F.concat(F.lit("/d/"), "document_id", suffix).alias("path"), F.encode(F.when(kind == 2, record).otherwise(F.col("text")), "utf-8").alias("content"), F.concat("document_id", suffix).alias("file_name"), F.col("document_id").alias("stem"), suffix.alias("suffix"),
        F.concat(F.lit("/d/"), "document_id").alias("base"),
        F.struct(
            F.when(kind != 2, F.col("title")).alias("title"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), F.col("published_at").cast("date").alias("publication_date"), "license", "source_url",
            F.coalesce("domains", F.array().cast("array<string>")).alias("domain"), F.lit(None).cast("date").alias("temporal_cutoff"),
        ).alias("meta"),
    )
    return own.drop("base", "meta"), own.select("base", "meta")


_FILES = f"""WITH o AS (SELECT document_id, arg_min({{'x': text, 't': title, 'p': published_at, 'l': license}}, (coalesce(ingested_at, TIMESTAMP '0001-01-01'), text)) AS r FROM source_documents WHERE document_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
n AS (SELECT document_id, r.x AS text, r.t AS title, r.p AS p, r.l AS l, length(r.x) % 3 AS kind FROM o), f AS (SELECT *, {NORM} AS norm FROM n)
"""


@CORE.query("file_documents", _FILES + """SELECT '/d/' || document_id || CASE kind WHEN 0 THEN '.md' WHEN 1 THEN '.txt' ELSE '.jsonl' END AS source_path, CASE kind WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'text/plain' ELSE 'application/x-ndjson' END AS media_type, sha256(norm) AS normalized_text_sha256, length(norm) AS text_length,
CASE WHEN kind = 2 THEN coalesce(nullif(title, ''), document_id || ' 1') ELSE coalesce(title, replace(document_id, '_', ' ')) END AS title, date_trunc('day', p)::TIMESTAMP AS published_at, coalesce(l, 'unknown') AS license FROM f WHERE norm <> ''""")
def file_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents read from files with their metadata."""
    docs, _ = files.documents_from(*_source_files(spark, d), unicode_form=False)
    return docs.select("source_path", "media_type", "normalized_text_sha256", "text_length", "title", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "license")


@CORE.query("file_warnings", _FILES + "SELECT 'invalid_jsonl_source_record' AS code, count(*) AS n FROM f WHERE kind = 2 HAVING count(*) > 0 UNION ALL SELECT 'empty_source', count(*) FROM f WHERE kind <> 2 AND norm = '' HAVING count(*) > 0")
def file_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Warnings of those files."""
    return files.documents_from(*_source_files(spark, d), unicode_form=False)[1].groupBy("code").agg(F.count(F.lit(1)).alias("n"))


_RECORDS = "WITH c AS (SELECT DISTINCT * FROM capsules) SELECT ids.capsule_id AS capsule_id, claim.canonical_text AS canonical_text, coalesce(len(provenance_sources), 0) AS n_sources, extraction_confidence FROM c"


def _told(df: DataFrame) -> DataFrame:
    return df.select("ids.capsule_id", "claim.canonical_text", F.greatest(F.coalesce(F.size("provenance_sources"), F.lit(0)), F.lit(0)).alias("n_sources"), "extraction_confidence")


@CORE.query("stream_round_trip", _RECORDS)
def stream_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Capsules written as a stream of canonical JSON and read again."""
    c, path = capsules_once(spark, d), scratch_path(spark, "stream")
    packages.write_stream(c, path)
    return _told(packages.read_stream(spark, path, c.schema))


@CORE.query("record_table_round_trip", _RECORDS)
def record_table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Capsules written as a table of records and read again."""
    c, path = capsules_once(spark, d), scratch_path(spark, "records")
    packages.write_record_table(c, path)
    return _told(packages.read_record_table(spark, path, c.schema))


@CORE.query("package_contents", """WITH m AS (SELECT DISTINCT split_name, capsule_id FROM split_members WHERE split_name IS NOT NULL AND capsule_id IS NOT NULL), k AS (SELECT DISTINCT ids.capsule_id AS id FROM capsules)
SELECT 'capsules' AS part, count(*) AS n FROM (SELECT DISTINCT * FROM capsules) UNION ALL SELECT 'sources', count(DISTINCT s.source_id) FROM (SELECT unnest(provenance_sources) AS s FROM capsules) UNION ALL SELECT 'relations', count(DISTINCT relation_id) FROM extracted_relations WHERE relation_id IS NOT NULL
UNION ALL SELECT 'splits', count(*) FROM m UNION ALL SELECT 'unknown_split_id', count(DISTINCT capsule_id) FROM m WHERE capsule_id NOT IN (SELECT id FROM k)""")
def package_contents(spark: SparkSession, d: str) -> DataFrame:
    """A package written and validated: its parts, and the issues found."""
    c, path = capsules_once(spark, d), scratch_path(spark, "package")
    splits = table(spark, d, "split_members").filter("split_name is not null and capsule_id is not null")
    relations = table(spark, d, "extracted_relations").filter("relation_id is not null").dropDuplicates(["relation_id"])
    packages.write_package(c, splits, path, relations)
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    parts = [count(n, spark.read.text(f"{path}/data/{n}")) for n in ("capsules", "sources", "relations")]
    issues = packages.validate_package(spark, path, c.schema).groupBy(F.col("issue").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return union_all([*parts, count("splits", spark.read.schema("capsule_id string").json(f"{path}/splits")), issues])


@CORE.query("bundle_contents", "WITH c AS (SELECT DISTINCT * FROM capsules) SELECT unnest(['claim', 'masks', 'temporal']) AS name, count(*) AS n_rows, 0 AS n_issues FROM c")
def bundle_contents(spark: SparkSession, d: str) -> DataFrame:
    """Feature groups written as a bundle, validated, and opened again."""
    c, path = capsules_once(spark, d), scratch_path(spark, "bundle")
    groups = {"claim": tensors.claim_group(c), "temporal": tensors.temporal_group(c), "masks": tensors.masks(c)}
    bundles.write_bundle({n: (g, "capsule_id") for n, g in groups.items()}, path)
    issues = bundles.validate_bundle(spark, path, tuple(groups)).groupBy(F.col("subject").alias("name")).agg(F.count(F.lit(1)).alias("n_issues"))
    return bundles.table_counts(bundles.open_bundle(spark, path)).join(issues, "name", "left").select("name", "n_rows", F.coalesce("n_issues", F.lit(0)).alias("n_issues"))


@CORE.query("streamed_claims", FROM_DOCS + "SELECT claim_type, count(*) AS n FROM claims GROUP BY 1")
def streamed_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of a stream of documents, read until its files end, by type."""
    path, out, marks = f"{d}/documents.parquet", scratch_path(spark, "claims"), scratch_path(spark, "marks")
    folder, glob = (posixpath.dirname(path), posixpath.basename(path)) if is_file(spark, path) else (path, "*.parquet")
    found = stream.claim_stream(stream.read_documents(spark, folder, glob=glob))
    stream.write_claims(found, out, marks).awaitTermination()
    return spark.read.schema(found.schema).parquet(out).groupBy("claim_type").agg(F.count(F.lit(1)).alias("n"))


@CORE.query("negatives_of_capsules", BASE + ", g2 AS (SELECT sf, count(*) AS n FROM rel WHERE relation_type = 'near_but_distinct_from' GROUP BY 1) SELECT id AS capsule_id, coalesce(g2.n, 0) AS n_negatives FROM c LEFT JOIN g2 ON g2.sf = c.fam")
def negatives_of_capsules(spark: SparkSession, d: str) -> DataFrame:
    """Capsules with the claims said to be near but distinct as their negatives."""
    c = related_capsules(spark, d)
    near = c.select(F.col("ids.claim_family_id").alias("source_family_id"), F.explode("relations").alias("r")).filter("r.relation_type = 'near_but_distinct_from'").select("source_family_id", F.col("r.relation_id").alias("pool_id"), F.col("r.target_family").alias("target_family_id")).distinct()
    return records.with_negatives(capsules_once(spark, d), near).select("ids.capsule_id", F.size("negatives").alias("n_negatives"))


@CORE.query("provider_confidence", f"SELECT provider_id, coalesce({sql.mean_rounded('c', 3, 3)}, 0) AS mean_confidence FROM (SELECT raw_id, any_value(provider_id) AS provider_id, TRY_CAST(any_value(CASE WHEN json_valid(payload) THEN payload ->> '$.confidence' END) AS DOUBLE) AS c FROM raw_claims GROUP BY raw_id) GROUP BY 1")
def provider_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Mean confidence of each provider; 0 without any."""
    c = F.try_variant_get(F.try_parse_json("payload"), "$.confidence", "double")
    raw = table(spark, d, "raw_claims").dropDuplicates(["raw_id"]).select("provider_id", c.alias("c"))
    return raw.groupBy("provider_id").agg(F.coalesce(t.mean_rounded("c", 3, 3), F.lit(0.0)).alias("mean_confidence"))


@CORE.query("text_modes", "WITH c AS (SELECT DISTINCT * FROM capsules) SELECT ids.capsule_id AS capsule_id, coalesce(len(claim.canonical_text), 0) AS n_inputs, coalesce(len(claim.canonical_text), 0) AS n_labels FROM c")
def text_modes(spark: SparkSession, d: str) -> DataFrame:
    """Text columns put in place of a mode's own."""
    ids = F.split(F.coalesce("claim.canonical_text", F.lit("")), "")
    rows = capsules_once(spark, d).select("ids.capsule_id", F.when(F.coalesce("claim.canonical_text", F.lit("")) != "", ids).otherwise(F.array().cast("array<string>")).alias("flat_text_input_ids"))
    return controls.with_text_mode(rows, "flat_text").select("capsule_id", F.size("text_input_ids").alias("n_inputs"), F.size("text_labels").alias("n_labels"))
