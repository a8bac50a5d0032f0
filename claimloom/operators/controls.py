"""Control arms: capsules changed in one respect, and what text, side channels and audits make of them.

An arm is a table of whole capsules with an arm column; all arms are one union,
so that rendering, features and audits of every arm are one pass over it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.operators import audits
from claimloom.operators.ordering import permuted, with_position
from claimloom.operators.providers import epistemic_proxies
from claimloom.operators.records import without_frequencies
from claimloom.operators.render import context_lines, flat_text, line, n_sources, titles

ARMS = (
    "flat_text", "structured_text", "capsule_text", "capsule_no_provenance", "capsule_no_relations", "capsule_no_context", "capsule_no_side_channels",
    "context_shuffle", "provenance_shuffle", "popularity_frequency_control", "temporal_holdout", "relation_ablation",
)
RELATIONS = "array<struct<relation_id:string,target_family:string,relation_type:string,confidence:double>>"


def with_relations(capsules: DataFrame, claims: DataFrame, relations: DataFrame) -> DataFrame:
    """capsules with relations, those of the claims whose trimmed text a capsule of their family has.

    claims(claim_id, text), relations(relation_id, source_claim, target_claim,
    relation_type, confidence). Of several families with one text the last
    counts; a target that no capsule has the text of has a null family; types
    are read without case and outer blanks; repeated rows of an id are one.
    Capsules without relations have an empty array.
    """
    families = capsules.filter("claim.canonical_text is not null").groupBy(F.trim("claim.canonical_text").alias("_t")).agg(F.max("ids.claim_family_id").alias("family"))
    of_claim = claims.filter("claim_id is not null and text is not null").groupBy("claim_id", F.trim("text").alias("_t")).agg(F.count(F.lit(1)).alias("_n")).join(families, "_t").groupBy("claim_id").agg(F.max("family").alias("family"))
    one = relations.filter("relation_id is not null").groupBy("relation_id").agg(F.min(F.struct("source_claim", "target_claim", F.trim(F.lower("relation_type")).alias("relation_type"), "confidence")).alias("r")).select("relation_id", "r.*")
    placed = one.join(of_claim.toDF("source_claim", "source_family"), "source_claim").join(of_claim.toDF("target_claim", "target_family"), "target_claim", "left")
    grouped = placed.groupBy("source_family").agg(F.array_sort(F.collect_list(F.struct("relation_id", "target_family", "relation_type", "confidence"))).alias("relations"))  # of one family's records
    return capsules.join(grouped, F.col("ids.claim_family_id") == F.col("source_family"), "left").drop("source_family").withColumn("relations", F.coalesce("relations", F.array().cast(RELATIONS)))


def lower_median_time(capsules: DataFrame) -> Column:
    """The lower median of the capsules' times, a one-row query's value as a literal; null without any."""
    times = with_position(capsules.select(F.col("temporal.valid_as_of").alias("at")).filter("at is not null").withColumn("u", F.monotonically_increasing_id()), ["at", "u"], "p")
    n = F.broadcast(times.agg(F.count(F.lit(1)).alias("n")))  # one row
    row = times.join(n, F.col("p") == F.greatest(F.lit(0), F.floor(F.col("n") / 2) - 1)).select(F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()
    return F.lit(row and row[0]).cast("timestamp")


def arms(capsules: DataFrame, seed: int = 13, cutoff: Column | None = None) -> DataFrame:
    """Every capsule in each of the ARMS: arm, and the capsule's columns.

    capsules(ids, claim, temporal, context, provenance_sources, relations), one
    row for each id. Shuffles move whole contexts, or single sources with each
    capsule keeping as many as it had, by seed; the holdout has the capsules
    later than cutoff (by default the lower median time) and those without one.
    """
    cols = ["ids", "claim", "temporal", "context", "provenance_sources", "relations"]
    base = capsules.select(*cols)
    cutoff = lower_median_time(base) if cutoff is None else cutoff
    null = lambda name: F.lit(None).cast(base.schema[name].dataType)
    none, no_context = F.array().cast(base.schema["relations"].dataType), {"context": null("context"), "ids": F.col("ids").withField("context_id", F.lit(None).cast("string"))}
    key = F.col("ids.capsule_id").alias("_k")
    moved = permuted(base.select(key, F.struct("context", F.col("ids.context_id").alias("id")).alias("_c")), ["_k"], "_c", seed, F.col("_c.id"))
    contexts = base.join(moved, F.col("ids.capsule_id") == F.col("_k")).withColumns({"context": F.col("_c.context"), "ids": F.col("ids").withField("context_id", F.col("_c.id"))})
    each = base.select(key, F.posexplode("provenance_sources").alias("_p", "_s"))
    sources = permuted(each, ["_k", "_p"], "_s", seed, F.col("_s.source_id")).groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_p", "_s"))).alias("_s"))  # of one capsule
    provenance = base.join(sources, F.col("ids.capsule_id") == F.col("_k"), "left").withColumn("provenance_sources", F.coalesce(F.transform("_s", lambda x: x["_s"]), "provenance_sources"))
    made = {
        "capsule_no_provenance": base.withColumn("provenance_sources", null("provenance_sources")), "capsule_no_relations": base.withColumn("relations", none), "capsule_no_context": base.withColumns(no_context),
        "context_shuffle": contexts, "provenance_shuffle": provenance, "popularity_frequency_control": base.withColumns({"relations": none, **no_context}),
        "temporal_holdout": base.filter(F.coalesce(F.col("temporal.valid_as_of") > cutoff, F.lit(True))), "relation_ablation": base.withColumn("relations", none),
    }
    return reduce(DataFrame.unionByName, [made.get(a, base).select(F.lit(a).alias("arm"), *cols) for a in ARMS])


def n_relations() -> Column:
    return F.greatest(F.coalesce(F.size("relations"), F.lit(0)), F.lit(0))


def side_channels() -> Column:
    """Eight numbers of a capsule beside its text: compatibility, anchoring, pressure, redundancy, uncertainty, relations, sources, geometry.

    The epistemic ones are the proxies that counts give; what a capsule of this
    shape cannot have (compatibility, geometry) is 0.
    """
    p = epistemic_proxies(n_sources(), n_relations(), F.lit(0))
    zero = F.lit(0.0)
    return F.array(zero, p["evidential_anchoring"], p["transformation_pressure"], p["independent_redundancy"], p["uncertainty"], n_relations().cast("double"), n_sources().cast("double"), zero)


def rendered(arms: DataFrame) -> DataFrame:
    """capsule_id, arm, text, side_channels of arms. Side channels are null in the arm without them; the popularity control has the claim and counts only."""
    frequency = arms.filter("arm = 'flat_text'").groupBy(F.col("ids.claim_family_id").alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    own = arms.join(frequency, F.col("ids.claim_family_id").eqNullSafe(F.col("_f")), "left")
    claim, sources = line("Claim", F.col("claim.canonical_text")), line("Sources", F.array_join(titles(), "; "))
    links = line("Relations", F.array_join(F.transform("relations", lambda r: F.concat(F.coalesce(r["relation_type"], F.lit("?")), F.lit(" -> "), F.coalesce(r["target_family"], F.lit("?")))), "; "))
    whole = F.concat_ws("\n", claim, line("Type", F.col("claim.claim_type")), links, sources, *context_lines())
    counts = F.concat_ws("\n", flat_text(), F.concat(F.lit("Source count proxy: "), n_sources()), F.concat(F.lit("Claim-family frequency proxy: "), F.coalesce("_n", F.lit(0))))
    arm = F.col("arm")
    text = F.when(arm == "flat_text", flat_text()).when(arm == "structured_text", F.concat_ws("\n", claim, *context_lines(), sources)).when(arm == "popularity_frequency_control", counts).otherwise(whole)
    return own.select(F.col("ids.capsule_id").alias("capsule_id"), "arm", text.alias("text"), F.when(arm != "capsule_no_side_channels", side_channels()).alias("side_channels"))


def arm_findings(arms: DataFrame, fields: dict[str, str], strict: bool = False) -> DataFrame:
    """arm, audit, severity, message, record_id, path, value: the audit suite over every arm at once, rendered texts included. strict raises on an error."""
    tagged = arms.withColumn("ids", F.col("ids").withField("capsule_id", F.concat("arm", F.lit("\n"), "ids.capsule_id")))
    texts = rendered(arms).select(F.concat("arm", F.lit("\n"), "capsule_id").alias("id"), "text")
    every = audits.union_all([audits.required_fields(tagged, fields), audits.temporal_leakage(tagged), audits.provenance_integrity(tagged), audits.capsule_relation_integrity(tagged), audits.context_integrity(tagged), audits.target_exposure(texts, "id", "text")])
    parts = F.split("record_id", "\n", 2)
    found = every.select(parts[0].alias("arm"), "audit", "severity", "message", parts[1].alias("record_id"), "path", "value")
    return audits.checked(found) if strict else found


# The control transforms of experiment batches.
TRANSFORMS = ("none", "context_shuffle", "provider_shuffle", "provenance_shuffle", "no_provenance", "no_relations", "no_context", "geometry_off", "popularity_frequency_control")
_ROTATED = {"context_shuffle": "lateral_context", "provider_shuffle": "provider_context", "provenance_shuffle": "provenance"}
_CLEARED = {"no_provenance": ("provenance",), "no_relations": ("relations", "relation_neighborhoods"), "no_context": ("lateral_context",)}
_COUNTED = ("relations", "relation_neighborhoods", "epistemic_state")


def transformed(records: DataFrame, transform: str, order: str, batch: int = 32) -> DataFrame:
    """records with the groups of one control transform changed; targets and masks, being no groups, stay.

    Groups are map columns, those of _ROTATED, _CLEARED and _COUNTED that
    records has. Shuffles move a group on by one within micro-batches of `batch`
    records in order; clearing leaves empty maps; the popularity control sets
    features on degree, frequency and count to 0. none and geometry_off change
    nothing here.
    """
    if transform not in TRANSFORMS:
        raise ValueError(transform)
    if transform in _ROTATED and _ROTATED[transform] in records.columns:
        group = _ROTATED[transform]
        placed = with_position(records, [order], "_p").withColumn("_b", F.floor(F.col("_p") / batch))
        w = W.partitionBy("_b").orderBy("_p")  # `batch` rows
        return placed.withColumn(group, F.coalesce(F.lead(group).over(w), F.first(group).over(w))).select(*records.columns)
    for group in _CLEARED.get(transform, ()):
        if group in records.columns:
            records = records.withColumn(group, F.create_map().cast(records.schema[group].dataType))
    if transform == "popularity_frequency_control":
        records = records.withColumns({g: without_frequencies(g) for g in _COUNTED if g in records.columns})
    return records


TEXT_MODES = ("flat_text", "structured_text", "capsule_text")


def with_text_mode(records: DataFrame, mode: str) -> DataFrame:
    """records whose text columns are those of a mode: its ids as inputs, labels and targets, its attention as mask, where there are any."""
    if mode not in TEXT_MODES:
        raise ValueError(mode)
    own = {f"{mode}_input_ids": ("text_input_ids", "text_labels", "text_projection_targets"), f"{mode}_attention_mask": ("text_attention_mask", "text_loss_mask")}
    return records.withColumns({name: F.coalesce(c, name) if name in records.columns else F.col(c) for c, names in own.items() if c in records.columns for name in names})
