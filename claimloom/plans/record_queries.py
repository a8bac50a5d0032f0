"""Queries on record transforms, controls, aliases, negatives and observables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.functions import text as t
from claimloom.operators import geometry, records
from claimloom.operators.ordering import first_occurrence_index, keep_best, permuted
from claimloom.plans import fragments as sql
from claimloom.plans.capsule_queries import capsules_once
from claimloom.registry import CORE
from claimloom.session import table
from claimloom.sources import files, packages


@CORE.query("text_aliases", """WITH a AS (SELECT trim(claim.canonical_text) AS k, max(ids.claim_family_id) AS family FROM capsules WHERE claim.canonical_text IS NOT NULL GROUP BY 1)
SELECT DISTINCT claim_id, family FROM extracted_claims LEFT JOIN a ON trim(text) = k""")
def text_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Claims with the family of the capsule that has their text."""
    caps = table(spark, d, "capsules").select(F.col("claim.canonical_text").alias("ct"), F.col("ids.claim_family_id").alias("f"))
    return records.aliased(table(spark, d, "extracted_claims").select("claim_id", "text"), "text", caps, "ct", "f", "family").select("claim_id", "family").distinct()


@CORE.query("resolved_relations", """WITH c AS (SELECT claim_id, min(document_id) AS target_document FROM extracted_claims GROUP BY 1) SELECT DISTINCT relation_id, source_claim, target_claim, target_document FROM extracted_relations JOIN c ON target_claim = claim_id""")
def resolved_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations whose target exists, with its document; others are dropped."""
    c = table(spark, d, "extracted_claims").groupBy("claim_id").agg(F.min("document_id").alias("target_document"))
    r = table(spark, d, "extracted_relations").select("relation_id", "source_claim", "target_claim").distinct()
    return records.resolved(r, c.withColumnRenamed("claim_id", "target_claim"), "target_claim")


@CORE.query("dense_relation_targets", """WITH i AS (SELECT claim_id, row_number() OVER (ORDER BY f, claim_id) - 1 AS index FROM (SELECT claim_id, min(ingested_at) AS f FROM extracted_claims GROUP BY 1))
SELECT DISTINCT relation_id, coalesce(index, -1) AS target_index FROM extracted_relations LEFT JOIN i ON target_claim = claim_id""")
def dense_relation_targets(spark: SparkSession, d: str) -> DataFrame:
    """Relation targets as dense indices, -1 for those that don't exist."""
    i = first_occurrence_index(table(spark, d, "extracted_claims"), "claim_id", "ingested_at")
    r = table(spark, d, "extracted_relations").select("relation_id", F.col("target_claim").alias("claim_id")).distinct()
    return r.join(i, "claim_id", "left").select("relation_id", F.coalesce("index", F.lit(-1)).alias("target_index"))


@CORE.query("first_traces", "SELECT provider_id, month, arg_min(raw_id, (received_at, raw_id)) AS raw_id FROM (SELECT *, strftime(received_at, '%Y-%m') AS month FROM raw_claims) GROUP BY ALL")
def first_traces(spark: SparkSession, d: str) -> DataFrame:
    """The first raw claim of each provider and month."""
    r = table(spark, d, "raw_claims").select("provider_id", F.date_format("received_at", "yyyy-MM").alias("month"), "raw_id", "received_at")
    return keep_best(r, ["provider_id", "month"], F.struct("received_at", "raw_id")).select("provider_id", "month", "raw_id")


@CORE.query("popularity_control", """WITH c AS (SELECT DISTINCT * FROM capsules) SELECT ids.capsule_id AS capsule_id, coalesce(len(provenance_sources), 0)::INTEGER AS source_count_proxy, count(*) OVER (PARTITION BY ids.claim_family_id) AS claim_family_frequency_proxy, range(1, coalesce(len(provenance_sources), 0) + 1) AS source_indices FROM c""")
def popularity_control(spark: SparkSession, d: str) -> DataFrame:
    """Capsules reduced to counts."""
    return records.popularity_control(capsules_once(spark, d))


@CORE.query("gold_candidates", "SELECT DISTINCT 'gold_' || ids.claim_family_id AS candidate_id, ids.capsule_id AS capsule_id, claim.canonical_text AS canonical_text, strftime(temporal.valid_as_of, '%Y-%m-%dT%H:%M:%S') AS temporal_cutoff_review, false AS human_verified_reference FROM capsules")
def gold_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Rows for review."""
    return records.gold_candidates(capsules_once(spark, d)).select("candidate_id", "capsule_id", "canonical_text", "temporal_cutoff_review", "human_verified_reference")


@CORE.query("provider_tasks", f"SELECT f AS family, task FROM (SELECT DISTINCT ids.claim_family_id AS f FROM capsules), (SELECT unnest([{sql.quoted(records.TASKS)}]) AS task)")
def provider_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of every family."""
    return records.provider_tasks(table(spark, d, "capsules").select(F.col("ids.claim_family_id").alias("family")).distinct(), "family")


@CORE.query("padded_vectors", "SELECT vec_id, len(list_concat(embedding::DOUBLE[], list_transform(range(16), lambda x: 0.0::DOUBLE))) AS n, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def padded_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors filled up to width 80."""
    e = table(spark, d, "embeddings").select("vec_id", records.padded(F.col("embedding").cast("array<double>"), 80).alias("p"))
    return e.select("vec_id", F.size("p").alias("n"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@CORE.query("frequency_strip", "SELECT claim_id, 0.0::DOUBLE AS relation_degree, c AS confidence FROM (SELECT DISTINCT claim_id, coalesce(confidence, -1) AS c FROM extracted_claims)")
def frequency_strip(spark: SparkSession, d: str) -> DataFrame:
    """Features with those on frequency zeroed."""
    m = F.create_map(F.lit("relation_degree"), F.length("text").cast("double"), F.lit("confidence"), F.coalesce("confidence", F.lit(-1.0)))
    c = table(spark, d, "extracted_claims").select("claim_id", records.without_frequencies(m).alias("m"))
    return c.select("claim_id", F.col("m.relation_degree").alias("relation_degree"), F.col("m.confidence").alias("confidence")).distinct()


@CORE.query("negative_types", "SELECT coalesce(map_extract_value(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in records.NEGATIVE_TYPES.items()) + "}, p), p) AS negative_type, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1.0 WHEN value IS NOT NULL THEN 0.5 ELSE -1 END)::DOUBLE AS hardness FROM (SELECT *, CASE event_type WHEN 'click' THEN 'temporal_distractor' WHEN 'view' THEN 'same_topic_unrelated' ELSE event_type END AS p FROM events) GROUP BY 1")
def negative_types(spark: SparkSession, d: str) -> DataFrame:
    """Events taken as negative records: types and summed hardness."""
    e = table(spark, d, "events")
    p = F.when(F.col("event_type") == "click", "temporal_distractor").when(F.col("event_type") == "view", "same_topic_unrelated").otherwise(F.col("event_type"))
    wrong = F.col("event_type") == "error"
    h = records.hardness(F.when(~wrong & F.col("value").isNotNull(), 0.5), disagreement=wrong)
    return e.groupBy(records.negative_type(p).alias("negative_type")).agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("hardness"))


@CORE.query("loop_observables", """WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT vec_id, unnest(e) AS v, unnest(range(64)) AS i FROM m)
SELECT vec_id, round(sqrt(sum(pow(v - CASE WHEN i % 9 = 0 THEN 1 ELSE 0 END, 2))), 5) AS holonomy_norm, round(sum(CASE WHEN i % 9 = 0 THEN v ELSE 0 END) / 8, 5) AS trace_normalized FROM x GROUP BY vec_id""")
def loop_observables(spark: SparkSession, d: str) -> DataFrame:
    """Norm and trace of vectors read as 8 x 8 transports."""
    o = table(spark, d, "embeddings").select("vec_id", geometry.loop_observables("embedding").alias("o"))
    return o.select("vec_id", F.round("o.holonomy_norm", 5).alias("holonomy_norm"), F.round("o.trace_normalized", 5).alias("trace_normalized"))


@CORE.query("loop_spectra", """WITH m AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings), t AS (SELECT vec_id, (a + d) / 2 AS h, (a + d) * (a + d) / 4 - (a * d - b * c) AS q, a * d - b * c AS det FROM m),
e AS (SELECT vec_id, CASE WHEN q >= 0 THEN abs(h + sqrt(abs(q))) ELSE sqrt(det) END AS x, CASE WHEN q >= 0 THEN abs(h - sqrt(abs(q))) ELSE sqrt(det) END AS y FROM t) SELECT vec_id, round((x + y) / 2, 5) AS spectrum_abs_mean, round(greatest(x, y), 5) AS spectrum_abs_max FROM e""")
def loop_spectra(spark: SparkSession, d: str) -> DataFrame:
    """Absolute eigenvalues of 2 x 2 transports, for which SQL has a formula."""
    o = table(spark, d, "embeddings").select("vec_id", geometry.loop_observables(F.slice("embedding", 1, 4)).alias("o"))
    return o.select("vec_id", F.round("o.spectrum_abs_mean", 5).alias("spectrum_abs_mean"), F.round("o.spectrum_abs_max", 5).alias("spectrum_abs_max"))


@CORE.query("path_consistency", """WITH m AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT label, vec_id, unnest(e) AS v, unnest(range(len(e))) AS i FROM m)
SELECT label, round(sum(v) / max(n), 5) AS spread FROM (SELECT label, i, var_pop(v) AS v FROM x GROUP BY ALL) JOIN (SELECT label, max(len(e)) AS n FROM m GROUP BY 1) USING (label) GROUP BY label""")
def path_consistency(spark: SparkSession, d: str) -> DataFrame:
    """How far the transports of one label are from their mean, per entry."""
    return geometry.path_spread(table(spark, d, "embeddings"), "label", "embedding").withColumn("spread", F.round("spread", 5))


@CORE.query("permuted_edges", """WITH e AS (SELECT relation_id, min(source_claim) AS src, min(target_claim) AS dst FROM extracted_relations WHERE target_claim IS NOT NULL GROUP BY 1), s AS (SELECT *, row_number() OVER (ORDER BY relation_id) - 1 AS slot FROM e),
r AS (SELECT dst AS moved, row_number() OVER (ORDER BY sha256(concat_ws(':', '5', slot::VARCHAR, dst)), slot) - 1 AS slot FROM s) SELECT relation_id, src, moved AS dst FROM s JOIN r USING (slot)""")
def permuted_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with their targets shuffled, so that all degrees stay."""
    e = table(spark, d, "extracted_relations").filter("target_claim is not null").groupBy("relation_id").agg(F.min("source_claim").alias("src"), F.min("target_claim").alias("dst"))
    return permuted(e, ["relation_id"], "dst", 5, "dst")


@CORE.query("recent_outputs", "SELECT DISTINCT raw_id, provider_id, received_at FROM raw_claims ORDER BY received_at DESC, raw_id LIMIT 30")
def recent_outputs(spark: SparkSession, d: str) -> DataFrame:
    """The thirty newest raw claims."""
    r = table(spark, d, "raw_claims").select("raw_id", "provider_id", F.col("received_at").cast("timestamp_ntz").alias("received_at")).distinct()
    return files.tail(r, "received_at", 30, "raw_id")


@CORE.query("missing_targets", """WITH c AS (SELECT DISTINCT * FROM capsules) SELECT target, count(*) AS n FROM (SELECT unnest(['provenance', 'domains', 'communities', 'confidence', 'family_label']) AS target, unnest([coalesce(len(provenance_sources), 0) = 0, coalesce(len(context.domains), 0) = 0, coalesce(len(context.communities), 0) = 0, extraction_confidence IS NULL, claim.family_label IS NULL]) AS gone FROM c) WHERE gone GROUP BY 1""")
def missing_targets(spark: SparkSession, d: str) -> DataFrame:
    """How many capsules lack each target."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    checks = {"provenance": none("provenance_sources"), "domains": none("context.domains"), "communities": none("context.communities"), "confidence": F.col("extraction_confidence").isNull(), "family_label": F.col("claim.family_label").isNull()}
    gone = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return capsules_once(spark, d).select(F.explode(gone).alias("target")).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@CORE.query("vote_distribution", "SELECT DISTINCT claim_id, coalesce(confidence, 0) AS selected, greatest(0, round(1 - coalesce(confidence, 0), 6)) AS abstain FROM extracted_claims")
def vote_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Confidence and abstention of each claim."""
    c = F.coalesce("confidence", F.lit(0.0))
    return table(spark, d, "extracted_claims").select("claim_id", c.alias("selected"), F.greatest(F.lit(0.0), F.round(1 - c, 6)).alias("abstain")).distinct()


@CORE.query("list_changes", """WITH m AS (SELECT capsule_id, split_name, max(listed_at) AS ts FROM split_members WHERE split_name IN ('validation', 'test') GROUP BY ALL), a AS (SELECT capsule_id, strftime(ts, '%Y') AS h FROM m WHERE split_name = 'validation'), b AS (SELECT capsule_id, strftime(ts, '%Y') AS h FROM m WHERE split_name = 'test')
SELECT coalesce(a.capsule_id, b.capsule_id) AS file, CASE WHEN a.capsule_id IS NULL THEN 'added' WHEN b.capsule_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (capsule_id) WHERE a.h IS DISTINCT FROM b.h""")
def list_changes(spark: SparkSession, d: str) -> DataFrame:
    """Two lists held against each other as hash tables are: an id added, removed or listed in another year."""
    m = table(spark, d, "split_members").groupBy("split_name", F.col("capsule_id").alias("file")).agg(F.date_format(F.max("listed_at"), "yyyy").alias("sha256"))
    a, b = [m.filter(F.col("split_name") == s).select("file", "sha256") for s in ("validation", "test")]
    return packages.compare_hashes(a, b)


@CORE.query("file_roles", "SELECT document_id, CASE suffix WHEN '.md' THEN 'text/markdown' WHEN '.txt' THEN 'text/plain' WHEN '.jsonl' THEN 'application/x-ndjson' WHEN '.pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS media_type, sha256(text) AS sha256, length(text) AS n_chars FROM (SELECT DISTINCT document_id, lower(regexp_extract(file_name, '(\\.[^.]*)$', 1)) AS suffix, text FROM source_documents)")
def file_roles(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows of documents."""
    s = table(spark, d, "source_documents").select("document_id", F.lower(F.regexp_extract("file_name", r"(\.[^.]*)$", 1)).alias("suffix"), "text").distinct()
    return s.select("document_id", files.media_type("suffix").alias("media_type"), F.sha2("text", 256).alias("sha256"), F.length("text").alias("n_chars"))


@CORE.query("capsule_adapter", f"""SELECT DISTINCT ids.capsule_id AS capsule_id, 'axc:sha256:' || sha256(coalesce(claim.canonical_text, '')) AS text_id, 'claimfam:' || coalesce(nullif(substr(array_to_string(regexp_extract_all({sql.fold('claim.canonical_text')}, '[a-z0-9]+'), '_'), 1, 48), ''), 'unknown') || ':' || {sql.digest('ids.claim_family_id', 'claim.canonical_text')} AS family_ref FROM capsules WHERE claim.canonical_text IS NOT NULL""")
def capsule_adapter(spark: SparkSession, d: str) -> DataFrame:
    """Typed public ids of capsules."""
    c = table(spark, d, "capsules").filter("claim.canonical_text is not null").select("ids.capsule_id", "ids.claim_family_id", "claim.canonical_text")
    return c.select("capsule_id", F.concat(F.lit("axc:sha256:"), F.sha2("canonical_text", 256)).alias("text_id"), F.concat(F.lit("claimfam:"), t.safe_slug("canonical_text"), F.lit(":"), t.stable_hash("claim_family_id", "canonical_text")).alias("family_ref")).distinct()


@CORE.query("ranked_negatives", "SELECT user_id, event_id, r FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS r FROM events) WHERE r <= 3")
def ranked_negatives(spark: SparkSession, d: str) -> DataFrame:
    """The three events of each user with the largest values; Spark limits groups before the shuffle."""
    w = W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("user_id", "event_id", "r")
