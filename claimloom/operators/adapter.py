"""Internal capsules as public records: identifiers, sources, spans, relations and the fixed blocks around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as t

# Fixed values of the public format.
FORMAT, VERSION = "AXC", "0.1.0"
PROXY_METHOD, REDUNDANCY_METHOD, RELATION_METHOD = "step01-proxy", "independent_community_effective_count", "step02-adapter"
PROXIES = {"ontology_compatibility": "ontic_compatibility", "evidential_anchoring": "evidential_anchoring", "transformation_pressure": "transformation_pressure", "uncertainty": "uncertainty"}


def slug(c: Column) -> Column:
    """Letters, digits, points, dashes and underscores of the folded text, other runs as one dash, none of them at the ends; `unknown` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(t.fold(c), r"[^a-z0-9._-]+", "-"), r"^[-._]+|[-._]+$", "")
    return F.when(s == "", "unknown").otherwise(s)


def family_ref(name: Column, *parts: Column) -> Column:
    return F.concat(F.lit("claimfam:"), slug(name), F.lit(":"), t.stable_hash(*parts))


def source_ref(*parts: Column) -> Column:
    return F.concat(F.lit("src:document:"), t.stable_hash(*parts))


def to_public(capsules: DataFrame) -> DataFrame:
    """The public record of each internal capsule.

    capsules(capsule_id, claim_id, canonical_text, claim_type, language, scope,
    domains, communities, valid_as_of, created_at, provenance
    array<struct<document_id, source_id, title, uri, source_date, license>>,
    spans array<struct<span_id, document_id, text, start_char, end_char,
    source_date>>, relations array<struct<relation_id, target_claim_id,
    relation_type, confidence>>, proxies struct of PROXIES' values and
    redundancy_effective_n, extraction_confidence). A span of a document that
    provenance lacks gets the id of the document alone. Rows without a capsule
    id, text or time are passed over, as no public record can be made of them;
    null arrays count as empty. Ids are hashes of the internal ones, so the same
    capsule always gives the same record.
    """
    own = capsules.filter("capsule_id is not null and canonical_text is not null and valid_as_of is not null")
    empty = lambda name: F.coalesce(name, F.array().cast(capsules.schema[name].dataType))
    own = own.withColumns({n: empty(n) for n in ("provenance", "spans", "relations", "domains", "communities")})
    family = family_ref(F.substring(slug(F.col("canonical_text")), 1, 48), F.col("claim_id"), F.col("canonical_text"))
    own = own.withColumn("_family", family)
    state = F.concat(F.lit("claimstate:"), F.date_format("valid_as_of", "yyyy-MM-dd"), F.lit(":"), t.stable_hash("capsule_id", "_family"))
    own = own.withColumn("_state", state)
    sources = F.transform("provenance", lambda r: F.struct(source_ref(F.lit("document"), r["source_id"], r["document_id"]).alias("source_id"), r["title"].alias("title"), r["uri"].alias("url"), r["source_date"].alias("source_date"), r["license"].alias("license")))
    def span(s: Column) -> Column:
        of_document = F.try_element_at(F.filter("provenance", lambda r: r["document_id"] == s["document_id"]), F.lit(-1))  # of several the last
        source = F.when(of_document.isNotNull(), source_ref(F.lit("document"), of_document["source_id"], of_document["document_id"])).otherwise(source_ref(F.lit("document"), s["document_id"]))
        return F.struct(F.concat(F.lit("span:"), t.stable_hash(s["span_id"], s["document_id"])).alias("span_id"), source.alias("source_id"), s["text"].alias("text"), s["start_char"].alias("start_char"), s["end_char"].alias("end_char"), s["source_date"].alias("source_date"), F.lit(False).alias("target_only"))

    relations = F.transform("relations", lambda r: F.struct(
        F.concat(F.lit("rel:"), t.stable_hash(r["relation_id"], r["target_claim_id"])).alias("relation_id"), family_ref(r["target_claim_id"], r["target_claim_id"]).alias("target_claim_family_id"),
        r["relation_type"].alias("relation_type"), r["confidence"].alias("confidence"), F.array().cast("array<string>").alias("evidence_span_ids"), F.lit(RELATION_METHOD).alias("extraction_method"),
    ))
    measure = lambda c: F.struct(F.col(f"proxies.{c}").alias("value"), F.lit(PROXY_METHOD).alias("method"))
    domains = F.array_join("domains", ",")
    return own.select(
        F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("format_version"),
        F.struct(
            F.concat(F.lit("axc:sha256:"), t.stable_hash("_family", "_state", "canonical_text", length=64)).alias("capsule_id"), F.col("_family").alias("claim_family_id"), F.col("_state").alias("claim_state_id"),
            F.concat(F.lit("ctx:"), slug(F.when(domains == "", "unknown").otherwise(domains))).alias("context_id"),
        ).alias("ids"),
        F.struct("canonical_text", "claim_type", "language", F.col("scope").alias("family_label")).alias("claim"),
        F.struct(F.col("canonical_text").alias("canonical"), F.transform("spans", span).alias("source_spans"), F.create_map(F.lit("primary"), F.col("canonical_text")).alias("normalized_views")).alias("surface_forms"),
        F.struct("valid_as_of", F.col("valid_as_of").alias("observed_at"), F.col("created_at").alias("constructed_at"), F.array_min(F.transform("provenance", lambda r: r["source_date"])).alias("source_publication_date"), F.lit("passed").alias("leakage_validation_status")).alias("temporal"),
        F.struct("domains", "communities").alias("context"),
        F.struct(F.lit("unassessed").alias("status"), *[measure(c).alias(n) for n, c in PROXIES.items()], F.struct(F.col("proxies.redundancy_effective_n").alias("effective_count"), F.lit(REDUNDANCY_METHOD).alias("method")).alias("independent_redundancy")).alias("epistemic_state"),
        relations.alias("relations"), F.struct(sources.alias("sources")).alias("provenance"), F.struct(F.lit(True).alias("eligible")).alias("training"), F.struct("extraction_confidence").alias("quality"),
    )
