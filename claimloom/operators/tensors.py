"""Vocabularies, feature groups and masks of capsules, as nested columns.

Nulls stay nulls inside the engine; the sentinels -1 come in at the sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.functions import text as t
from claimloom.operators.ordering import with_position

UNKNOWN = 1
# The ids every vocabulary starts with.
SPECIAL = ("<pad>", "<unk>")


def vocabulary(values: DataFrame) -> DataFrame:
    """category, value, idx of values(category, value): the special ones first, then the distinct values in order.

    Categories are few, values of one may be many; only distinct values are
    numbered, category by category. Nulls and blanks are no values.
    """
    seen = values.filter("category is not null and value is not null and trim(value) <> ''").filter(~F.col("value").isin(*SPECIAL)).select("category", "value").distinct()
    placed = with_position(seen, ["category", "value"], "_p")
    starts = placed.groupBy("category").agg(F.min("_p").alias("_s"))
    own = placed.join(F.broadcast(starts), "category").select("category", "value", (F.col("_p") - F.col("_s") + len(SPECIAL)).alias("idx"))  # one row a category
    special = starts.select("category", F.posexplode(F.array(*[F.lit(s) for s in SPECIAL])).alias("idx", "value")).select("category", "value", F.col("idx").cast("long").alias("idx"))
    return special.unionByName(own)


def encoded(rows: DataFrame, value: str, category: str, vocab: DataFrame, name: str) -> DataFrame:
    """rows with name, the index of the value in its category; unknown and null ones have UNKNOWN."""
    v = vocab.filter(F.col("category") == category).select(F.col("value").alias(value), F.col("idx").alias(name))
    return rows.join(v, value, "left").fillna(UNKNOWN, [name])


def capsule_values(capsules: DataFrame) -> DataFrame:
    """category, value of what capsules have."""
    one = lambda c, p: capsules.select(F.lit(c).alias("category"), F.col(p).alias("value"))
    return (
        one("claim_type", "claim.claim_type").unionByName(one("language", "claim.language")).unionByName(one("leakage_status", "temporal.leakage_validation_status"))
        .unionByName(capsules.select(F.lit("domain").alias("category"), F.explode("context.domains").alias("value")))
        .unionByName(capsules.select(F.lit("community").alias("category"), F.explode("context.communities").alias("value")))
    )


def seconds_or_missing(c: Column | str) -> Column:
    return F.coalesce(F.unix_timestamp(c), F.lit(-1))


def temporal_group(capsules: DataFrame) -> DataFrame:
    """Unix seconds of the capsule's times, the delta from publication to observation, and its masks."""
    pub, obs = F.unix_timestamp("temporal.source_publication_date"), F.unix_timestamp("temporal.observed_at")
    return capsules.select(
        F.col("ids.capsule_id").alias("capsule_id"), seconds_or_missing("temporal.valid_as_of").alias("valid_as_of"), seconds_or_missing("temporal.observed_at").alias("observed_at"),
        seconds_or_missing("temporal.source_publication_date").alias("source_publication_date"), F.coalesce(obs - pub, F.lit(-1)).alias("publication_delta"),
        F.coalesce(F.exists("provenance_sources", lambda s: F.coalesce(s["target_only"], F.lit(False))), F.lit(False)).cast("int").alias("target_only_mask"),
    )


def claim_group(capsules: DataFrame) -> DataFrame:
    """Hash references and length features of the claim."""
    text = F.coalesce("claim.canonical_text", F.lit(""))
    return capsules.select(
        F.col("ids.capsule_id").alias("capsule_id"), t.stable_int64("ids.capsule_id").alias("capsule_ref"), t.stable_int64("ids.claim_family_id").alias("family_ref"),
        F.size(F.filter(F.split(t.squeeze(text), " "), lambda w: w != "")).alias("n_words"), F.length(text).alias("n_chars"),
    )


def masks(capsules: DataFrame) -> DataFrame:
    """0/1 columns: which targets a capsule has, and so which losses it takes part in."""
    has = lambda c: c.cast("int")
    sources = has(F.coalesce(F.size("provenance_sources") > 0, F.lit(False)))
    text = has(F.coalesce("claim.canonical_text", F.lit("")) != "")
    return capsules.select(
        F.col("ids.capsule_id").alias("capsule_id"), sources.alias("available_provenance_targets"), text.alias("available_text_targets"),
        has(F.col("extraction_confidence").isNotNull()).alias("available_epistemic_targets"), text.alias("loss_mask_text_projection"), sources.alias("loss_mask_provenance_recovery"),
        has(F.col("extraction_confidence").isNotNull()).alias("loss_mask_uncertainty_calibration"), F.lit(1).alias("loss_mask_temporal_prediction"),
    )


def ragged_sources(capsules: DataFrame) -> DataFrame:
    """Ragged group: for each capsule the references of its sources in order, their number and where they start in the flat array."""
    rows = capsules.select(F.col("ids.capsule_id").alias("capsule_id"), F.transform(F.coalesce("provenance_sources.source_id", F.array().cast("array<string>")), lambda s: F.coalesce(t.stable_int64(s), F.lit(-1).cast("bigint"))).alias("refs"))
    sized = rows.withColumn("n", F.size("refs").cast("bigint"))
    return with_position(sized, ["capsule_id"], "record_index", F.col("n"), "start_offset").select("capsule_id", "record_index", "refs", "n", "start_offset")


def relation_group(capsules: DataFrame, vocab: DataFrame, families: DataFrame) -> DataFrame:
    """Ragged group of capsules(ids, relations): for each capsule its relations' types, targets and confidences in order, and where they start.

    vocab gives relation types their index (unknown ones UNKNOWN), families
    (family, index) targets theirs; a target without one has -1, and so has a
    confidence that is missing. mask says whether there are any.
    """
    rows = capsules.select(F.col("ids.capsule_id").alias("capsule_id"), F.posexplode_outer("relations").alias("_k", "_r"))
    types = vocab.filter("category = 'relation_type'").select(F.col("value").alias("_type"), F.col("idx").alias("_t"))
    coded = rows.select("capsule_id", "_k", F.col("_r.relation_type").alias("_type"), F.col("_r.target_family").alias("_target"), F.coalesce("_r.confidence", F.lit(-1.0)).alias("_c"))
    coded = coded.join(types, "_type", "left").join(families.select(F.col("family").alias("_target"), F.col("index").alias("_i")), "_target", "left")
    one = F.when(F.col("_k").isNotNull(), F.struct("_k", F.coalesce("_t", F.lit(UNKNOWN)).alias("t"), F.coalesce("_i", F.lit(-1)).alias("i"), F.col("_c").alias("c")))
    own = coded.groupBy("capsule_id").agg(F.array_sort(F.collect_list(one)).alias("a"))  # of one capsule
    of = lambda f: F.transform("a", lambda x: x[f])
    sized = own.select("capsule_id", of("t").alias("relation_types"), of("i").alias("relation_targets"), of("c").alias("relation_confidences"), F.size("a").cast("bigint").alias("n"))
    return with_position(sized, ["capsule_id"], "record_index", F.col("n"), "start_offset").withColumn("mask", (F.col("n") > 0).cast("int"))


def relation_values(capsules: DataFrame) -> DataFrame:
    """category, value of the capsules' relation types."""
    return capsules.select(F.lit("relation_type").alias("category"), F.explode("relations.relation_type").alias("value"))


def epistemic_group(proxies: DataFrame, methods: dict[str, Column], missing: float = -1.0) -> DataFrame:
    """capsule_id and for each proxy its value, its confidence (missing, as proxies have none) and a reference to the basis it rests on.

    proxies(capsule_id, one column for each of methods); a null value is missing
    and has no basis. methods names each proxy's method.
    """
    columns = []
    for name, method in methods.items():
        columns += [F.coalesce(name, F.lit(missing)).alias(f"{name}_value"), F.lit(missing).alias(f"{name}_confidence"), F.when(F.col(name).isNotNull(), t.stable_int64(F.lit("proxy_basis"), method)).otherwise(F.lit(-1).cast("bigint")).alias(f"{name}_basis")]
    return proxies.select("capsule_id", *columns)


GEOMETRY_SLOTS = ("curvature_score", "holonomy_norm", "trace_summary", "spectrum_summary", "context_lability")


def geometry_group(capsules: DataFrame, observables: Column | None = None, missing: float = -1.0) -> DataFrame:
    """capsule_id, geometry_enabled and the GEOMETRY_SLOTS; without observables (a map) all slots are missing."""
    slot = lambda n: F.lit(missing) if observables is None else F.coalesce(F.try_element_at(observables, F.lit(n)), F.lit(missing))
    return capsules.select(F.col("ids.capsule_id").alias("capsule_id"), F.lit(0 if observables is None else 1).alias("geometry_enabled"), *[slot(n).alias(n) for n in GEOMETRY_SLOTS])


def target_group(capsules: DataFrame, sources: DataFrame) -> DataFrame:
    """Ragged targets of capsules: the dense indices of their sources(source_id, index) in order, -1 for those without, their number and offset, and the uncertainty target."""
    rows = capsules.select(F.col("ids.capsule_id").alias("capsule_id"), "extraction_confidence", F.posexplode_outer("provenance_sources").alias("_k", "_s")).withColumn("source_id", F.col("_s.source_id"))
    coded = rows.join(sources.select("source_id", F.col("index").alias("_i")), "source_id", "left")
    one = F.when(F.col("_k").isNotNull(), F.struct("_k", F.coalesce("_i", F.lit(-1)).alias("i")))
    own = coded.groupBy("capsule_id").agg(F.array_sort(F.collect_list(one)).alias("a"), F.max("extraction_confidence").alias("c"))  # of one capsule
    sized = own.select("capsule_id", F.transform("a", lambda x: x["i"]).alias("provenance_target_ids"), F.size("a").cast("bigint").alias("n"), F.coalesce(1.0 - F.col("c"), F.lit(-1.0)).alias("uncertainty_target"))
    return with_position(sized, ["capsule_id"], "record_index", F.col("n"), "start_offset")


def metadata_group(capsules: DataFrame, record: Column, evaluation_references: int = 0, packaged: bool = False) -> DataFrame:
    """capsule_id, record_index in the order of ids, source_format_idx, a reference to the record's canonical form, and the number of evaluation references."""
    rows = capsules.select(F.col("ids.capsule_id").alias("capsule_id"), t.stable_int64(record).alias("input_record_hash"))
    return with_position(rows, ["capsule_id"], "record_index").select("capsule_id", "record_index", F.lit(int(packaged)).alias("source_format_idx"), "input_record_hash", F.lit(evaluation_references).alias("evaluation_reference_count"))


def fitted_tokens(texts: DataFrame, order: str, text: str, specials: tuple[str, ...] = SPECIAL) -> DataFrame:
    """token, idx of a white-space tokenizer: lower-cased tokens numbered as they are first met, after the special ones."""
    words = texts.select(F.col(order).alias("_o"), F.posexplode(F.filter(F.split(t.squeeze(F.lower(text)), " "), lambda w: w != "")).alias("_k", "token"))
    first = words.groupBy("token").agg(F.min(F.struct("_o", "_k")).alias("_f"))
    placed = with_position(first, ["_f"], "_p")
    return placed.select("token", (F.col("_p") + len(specials)).alias("idx"))


def encoded_texts(texts: DataFrame, key: str, text: str, vocab: DataFrame, length: int) -> DataFrame:
    """key, ids, attention: token ids cut or padded with 0 to length; unknown tokens have UNKNOWN."""
    words = texts.select(key, F.posexplode_outer(F.filter(F.split(t.squeeze(F.lower(text)), " "), lambda w: w != "")).alias("_k", "token")).filter(F.col("_k").isNull() | (F.col("_k") < length))
    coded = words.join(vocab, "token", "left").withColumn("idx", F.coalesce("idx", F.lit(UNKNOWN)))
    ids = coded.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "idx")))).alias("a")).select(key, F.transform("a", lambda x: x["idx"]).alias("a"))
    return ids.select(key, F.concat("a", F.array_repeat(F.lit(0).cast("bigint"), F.lit(length) - F.size("a"))).alias("ids"), F.concat(F.array_repeat(F.lit(1), F.size("a")), F.array_repeat(F.lit(0), F.lit(length) - F.size("a"))).alias("attention"))


def longest(texts: DataFrame, text: str, least: int) -> int:
    """The number of tokens of the longest text, or least where that is more."""
    n = F.size(F.filter(F.split(t.squeeze(F.lower(text)), " "), lambda w: w != ""))
    return max(least, texts.agg(F.max(n)).first()[0] or 0)
