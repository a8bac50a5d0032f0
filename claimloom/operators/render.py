"""Capsules as text, side channels, ablations and dataset metrics.

All are projections over the nested capsule; arms are one table with an arm
column, so that metrics and audits of all arms are one grouped pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as t


def flat_text() -> Column:
    return F.trim(F.coalesce("claim.canonical_text", F.lit("")))


def titles() -> Column:
    """The titles of a capsule's sources that aren't empty."""
    return F.array_compact(F.transform(F.coalesce("provenance_sources", F.array().cast(_SOURCES)), lambda s: F.when(F.coalesce(s["title"], F.lit("")) != "", s["title"])))


_SOURCES = "array<struct<source_id:string,title:string,source_date:timestamp,license:string,target_only:boolean>>"


def line(label: str, value: Column) -> Column:
    """`label: value`, null for an empty value."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))


def context_lines() -> list[Column]:
    return [line("Context", F.col("ids.context_id")), line("Domains", F.array_join("context.domains", ", "))]


def structured_text() -> Column:
    return F.concat_ws("\n", line("Claim", F.col("claim.canonical_text")), *context_lines(), line("Sources", F.array_join(titles(), "; ")))


def capsule_text() -> Column:
    return F.concat_ws("\n", line("Claim", F.col("claim.canonical_text")), line("Type", F.col("claim.claim_type")), line("Sources", F.array_join(titles(), "; ")), *context_lines())


def n_sources() -> Column:
    return F.greatest(F.coalesce(F.size("provenance_sources"), F.lit(0)), F.lit(0))


ARMS = ("flat_text", "structured_text", "capsule_text", "no_provenance", "no_context", "popularity_control")


def arms(capsules: DataFrame) -> DataFrame:
    """capsule_id, arm, text, n_sources, has_context, context_id, claim_family_id, one row for each capsule and arm.

    capsules has one row for each id. no_provenance drops the sources,
    no_context the context; popularity_control adds counts of sources and of
    the family's capsules to the text.
    """
    families = capsules.groupBy("ids.claim_family_id").agg(F.count(F.lit(1)).alias("_freq"))
    base = capsules.join(families, F.col("ids.claim_family_id").eqNullSafe(F.col("claim_family_id")), "left").drop("claim_family_id")
    no_prov = F.concat_ws("\n", line("Claim", F.col("claim.canonical_text")), *context_lines())
    no_ctx = F.concat_ws("\n", line("Claim", F.col("claim.canonical_text")), line("Sources", F.array_join(titles(), "; ")))
    popular = F.concat_ws("\n", line("Claim", F.col("claim.canonical_text")), F.concat(F.lit("source_count_proxy: "), n_sources()), F.concat(F.lit("claim_family_frequency_proxy: "), F.col("_freq")))
    texts = {"flat_text": flat_text(), "structured_text": structured_text(), "capsule_text": capsule_text(), "no_provenance": no_prov, "no_context": no_ctx, "popularity_control": popular}
    has_context = F.col("context").isNotNull()
    rows = F.array(*[
        F.struct(F.lit(a).alias("arm"), texts[a].alias("text"), (F.lit(0) if a == "no_provenance" else n_sources()).alias("n_sources"), (F.lit(False) if a in ("no_context", "popularity_control") else has_context).alias("has_context"))
        for a in ARMS
    ])
    return base.select(F.col("ids.capsule_id").alias("capsule_id"), F.col("ids.claim_family_id").alias("claim_family_id"), F.col("ids.context_id").alias("context_id"), F.explode(rows).alias("x")).select("capsule_id", "x.*", "context_id", "claim_family_id")


def arm_metrics(rendered: DataFrame) -> DataFrame:
    """Per arm: records, characters, tokens (words between white space), empty texts, sources, contexts and families."""
    tokens = F.size(F.filter(F.split(t.squeeze("text"), " "), lambda w: w != ""))
    with_tokens = rendered.withColumn("_t", tokens)
    return with_tokens.groupBy("arm").agg(
        F.count(F.lit(1)).alias("record_count"), F.sum(F.length("text")).alias("total_rendered_characters"), F.sum("_t").alias("total_token_count"), F.round(F.sum("_t") / F.count(F.lit(1)), 6).alias("average_token_count"),
        F.max("_t").alias("max_token_count"), F.count_if(F.trim("text") == "").alias("empty_text_count"), F.sum("n_sources").alias("provenance_source_count"), F.round(F.sum("n_sources") / F.count(F.lit(1)), 6).alias("average_sources_per_capsule"),
        F.count_if("has_context").alias("context_count"), F.count_distinct(F.when(F.col("has_context"), F.col("context_id"))).alias("unique_context_count"), F.count_distinct("claim_family_id").alias("unique_claim_family_count"),
    )
