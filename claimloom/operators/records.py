"""Record-level transforms: aliases, controls, negatives, padding, review rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of negative pools and the types they stand for.
NEGATIVE_TYPES = {
    "relation_hard_negative": "hard_relation_negative",
    "same_topic_unrelated": "same_context_unrelated",
    "near_but_distinct_claim": "near_claim_negative",
    "provenance_distractor_source": "provenance_negative",
    "temporal_distractor": "temporal_negative",
    "provider_disagreement_case": "provider_disagreement_negative",
}


def negative_type(raw: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in NEGATIVE_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, raw), raw, F.lit("unknown"))


def hardness(*scores: Column, disagreement: Column) -> Column:
    """The first score there is; 1 for a disagreement, else -1."""
    return F.coalesce(*scores, F.when(disagreement, 1.0), F.lit(-1.0))


def aliased(rows: DataFrame, text: str, aliases: DataFrame, alias_text: str, alias_id: str, name: str) -> DataFrame:
    """rows with name, the alias id of the row with the same trimmed text, of several the last; null where there is none."""
    last = aliases.filter(F.col(alias_text).isNotNull()).groupBy(F.trim(alias_text).alias("_t")).agg(F.max(alias_id).alias(name))
    return rows.withColumn("_t", F.trim(text)).join(last, "_t", "left").drop("_t")


def padded(values: Column | str, width: int, missing: float = 0.0) -> Column:
    """An array cut or filled to width."""
    v = F.coalesce(values, F.array().cast("array<double>"))
    return F.slice(F.concat(v, F.array_repeat(F.lit(missing), width)), 1, width)


def without_frequencies(features: Column | str) -> Column:
    """A map of numbers with those of names on degree, frequency or count set to 0."""
    return F.transform_values(features, lambda k, v: F.when(F.lower(k).rlike("degree|frequency|count"), 0.0).otherwise(v))


def popularity_control(capsules: DataFrame) -> DataFrame:
    """capsule_id, source_count_proxy, claim_family_frequency_proxy, source_indices: what is left of a capsule when only counts stay."""
    n = F.greatest(F.coalesce(F.size("provenance_sources"), F.lit(0)), F.lit(0))
    freq = capsules.groupBy(F.col("ids.claim_family_id").alias("_f")).agg(F.count(F.lit(1)).alias("claim_family_frequency_proxy"))
    out = capsules.join(freq, F.col("ids.claim_family_id").eqNullSafe(F.col("_f")))
    return out.select("ids.capsule_id", n.alias("source_count_proxy"), "claim_family_frequency_proxy", F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")).alias("source_indices"))


def gold_candidates(capsules: DataFrame) -> DataFrame:
    """Rows for human review, nothing reviewed yet."""
    return capsules.select(
        F.concat(F.lit("gold_"), "ids.claim_family_id").alias("candidate_id"), "ids.claim_family_id", "ids.capsule_id", "claim.canonical_text", F.date_format("temporal.valid_as_of", "yyyy-MM-dd'T'HH:mm:ss").alias("temporal_cutoff_review"),
        F.lit(False).alias("human_verified_reference"), F.lit(False).alias("evaluation_reference"),
    )


TASKS = ("claim_extraction", "epistemic_proxy", "structured_views")


def provider_tasks(families: DataFrame, key: str) -> DataFrame:
    """key, task: every family with each of the tasks."""
    return families.select(key, F.explode(F.array(*[F.lit(x) for x in TASKS])).alias("task"))


def with_negatives(capsules: DataFrame, negatives: DataFrame) -> DataFrame:
    """capsules with negatives, the rows of negatives(source_family_id, pool_id, ...) of their family by pool_id; an empty array where there are none."""
    rest = [c for c in negatives.columns if c not in ("source_family_id", "pool_id")]
    own = negatives.filter("source_family_id is not null").groupBy(F.col("source_family_id").alias("_f")).agg(F.array_sort(F.collect_list(F.struct("pool_id", *rest))).alias("negatives"))
    return capsules.join(own, F.col("ids.claim_family_id") == F.col("_f"), "left").drop("_f").withColumn("negatives", F.coalesce("negatives", F.array()))


def disagreements(records: DataFrame, family: str, decision: str) -> DataFrame:
    """family, disagreement_count: how many of a family's task records took one provider's output over another's."""
    return records.groupBy(family).agg(F.count_if(F.coalesce(F.startswith(F.col(decision), F.lit("selected_")), F.lit(False))).alias("disagreement_count"))


def resolved(relations: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """relations whose key exists in targets, with the target's columns; those that lead nowhere are dropped. targets has one row a key."""
    return relations.join(targets, key)
