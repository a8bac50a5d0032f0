"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import components, dedup, mixing, oracles, overlap, pieces, pii, postings, splits
from claimloom.registry import Registry
from claimloom.session import table

LLM = Registry()


# 3 Duplicates hidden by formatting differences


def _record_keys(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "extracted_claims").select(F.lit("extracted_claims").alias("record_set"), F.col("claim_id").alias("id"), dedup.text_key("text").alias("key"))
    capsules = table(spark, d, "capsules").select(F.lit("capsules").alias("record_set"), F.col("ids.capsule_id").alias("id"), dedup.text_key(F.col("claim.canonical_text")).alias("key"))
    raw = table(spark, d, "raw_claims").select(F.lit("raw_claims").alias("record_set"), F.col("raw_id").alias("id"), dedup.json_key("payload").alias("key"))
    return claims.unionByName(capsules).unionByName(raw)


@LLM.query("p3_found", oracles.P3_FOUND)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each id but the smallest of its record."""
    return dedup.collapse_copies(_record_keys(spark, d)).filter("id <> first_id").select("record_set", "first_id", F.col("id").alias("copy_id"))


@LLM.query("p3_records", oracles.P3_RECORDS)
def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """One row for each record with its number of copies."""
    return dedup.copy_counts(dedup.collapse_copies(_record_keys(spark, d)))


# 4 Splitting oversized items at natural boundaries


@LLM.query("p4_found", "SELECT DISTINCT chunk_id FROM document_chunks WHERE length(text) > 1200")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that had to be cut."""
    return pieces.split_oversized(table(spark, d, "document_chunks")).filter("piece_index = 0").select("chunk_id")


@LLM.query("p4_pieces")
def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all oversized chunks."""
    return pieces.split_oversized(table(spark, d, "document_chunks"))


@LLM.query("p4_cuts", oracles.P4_CUTS)
def p4_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Where the oversized chunks were cut, in places of their own text."""
    found = pieces.split_oversized(table(spark, d, "document_chunks").withColumn("start_char", F.lit(0)))
    return found.select("chunk_id", "piece_index", F.col("start_char").alias("from_char"), F.col("end_char").alias("to_char"))


# 5 Consolidating pairwise matches into groups


def _family_pairs(spark: SparkSession, d: str) -> DataFrame:
    rel = table(spark, d, "extracted_relations")
    kind = F.lower(F.regexp_replace("relation_type", r"^\s+|\s+$", ""))
    pairs = rel.filter(kind == "same_claim_family_as").select(F.col("source_claim").alias("a"), F.col("target_claim").alias("b"))
    pairs = pairs.filter("a is not null and b is not null and a <> b").distinct()
    known = table(spark, d, "extracted_claims").select("claim_id").distinct()
    return pairs.join(known.withColumnRenamed("claim_id", "a"), "a", "left_semi").join(known.withColumnRenamed("claim_id", "b"), "b", "left_semi")


@LLM.query("p5_found", oracles.P5_FOUND)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of every claim linked to another."""
    return components.group_ids(_family_pairs(spark, d)).select("group_id", F.col("name").alias("claim_id"))


# 1 Splits that keep related records together


def _capsule_links(spark: SparkSession, d: str, capsules: DataFrame | None = None) -> DataFrame:
    caps = table(spark, d, "capsules") if capsules is None else capsules
    records = caps.select(F.col("ids.capsule_id").alias("record_id"), F.col("ids.claim_family_id").alias("family"), F.col("provenance_sources.source_id").alias("sources"))
    authors = table(spark, d, "source_documents").select("source_id", F.explode("authors").alias("author"))
    return splits.record_links(records, authors)


def _split_all(spark: SparkSession, d: str) -> splits.SplitState:
    return splits.update_splits(splits.SplitState.empty(spark), _capsule_links(spark, d))


def _two_batches(spark: SparkSession, d: str) -> splits.SplitState:
    """The state after the capsules came in two batches, those without a time or before 2024 first."""
    caps = table(spark, d, "capsules")
    early = F.coalesce(F.col("temporal.constructed_at") < F.lit("2024-01-01").cast("timestamp"), F.lit(True))
    state = splits.SplitState.empty(spark)
    for part in (caps.filter(early), caps.filter(~early)):
        state = splits.update_splits(state, _capsule_links(spark, d, part))
    return state


@LLM.query("p1_found", oracles.P1_FOUND)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of every capsule tied to a source."""
    return splits.source_groups(_split_all(spark, d)).select("group_id", F.col("record_id").alias("capsule_id"))


@LLM.query("p1_splits")
def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every capsule."""
    return splits.record_splits(_split_all(spark, d)).select(F.col("record_id").alias("capsule_id"), "component_id", "split")


@LLM.query("p1_components", oracles.P1_COMPONENTS)
def p1_components(spark: SparkSession, d: str) -> DataFrame:
    """How many components of each size the capsules form."""
    return _split_all(spark, d).components.filter("n_records > 0").groupBy("n_records").agg(F.count(F.lit(1)).alias("n_components"))


@LLM.query("p1_shares")
def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share each split was to have and has of the capsules."""
    return _shares(spark, _split_all(spark, d))


def _shares(spark: SparkSession, state: splits.SplitState) -> DataFrame:
    want = spark.createDataFrame(list(splits.SHARES) + [(splits.QUARANTINE, 0.0)], "split string, target_share double")
    n = state.components.groupBy("split").agg(F.sum("n_records").alias("n_records"), F.count(F.lit(1)).alias("n_components"), F.max("n_records").alias("largest_component"))
    total = state.components.agg(F.sum("n_records").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return want.join(n, "split", "left").crossJoin(F.broadcast(total)).select(  # the total is one row
        "split", "target_share", zero("n_records").alias("n_records"), zero("n_components").alias("n_components"), zero("largest_component").alias("largest_component"), F.coalesce(F.try_divide(zero("n_records"), "total"), F.lit(0.0)).alias("share")
    )


@LLM.query("p1_two_batches")
def p1_two_batches(spark: SparkSession, d: str) -> DataFrame:
    """Shares after two batches."""
    return _shares(spark, _two_batches(spark, d))


@LLM.query("p1_conflicts")
def p1_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The merges quarantined in the second batch: which component could not join which, and the splits that met."""
    return _two_batches(spark, d).conflicts


# 2 Same or near-same records across splits


def _listed_capsules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    records = table(spark, d, "capsules").select(F.col("ids.capsule_id").alias("record_id"), F.col("ids.claim_family_id").alias("family"), F.col("claim.canonical_text").alias("text"))
    return records, table(spark, d, "split_members").select(F.col("split_name").alias("split"), F.col("capsule_id").alias("record_id"))


@LLM.query("p2_found", oracles.P2_FOUND)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of capsules that recur across an evaluation split and train."""
    return overlap.cross_split_pairs(*_listed_capsules(spark, d)).select(F.col("split").alias("eval_split"), F.col("a").alias("capsule_a"), F.col("b").alias("capsule_b"))


@LLM.query("p2_classes", oracles.P2_CLASSES)
def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """The linked classes with their numbers of capsules on both sides; copies are not expanded."""
    return overlap.cross_split(*_listed_capsules(spark, d)).counts().withColumnRenamed("split", "eval_split")


@LLM.query("p2_by_source", oracles.P2_BY_SOURCE)
def p2_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Pairs per evaluation split and source of either capsule; a pair counts once for each of its sources, under null if it has none."""
    of = table(spark, d, "capsules").select(F.col("ids.capsule_id").alias("record_id"), F.explode("provenance_sources.source_id").alias("grp"))
    found = overlap.cross_split(*_listed_capsules(spark, d)).pairs_by_group(of)
    return found.select(F.col("split").alias("eval_split"), F.col("grp").alias("source_id"), "n_pairs")


@LLM.query("p2_overlap")
def p2_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The overlap fraction of every capsule listed in an evaluation split."""
    return overlap.overlap_fractions(*_listed_capsules(spark, d)).withColumnRenamed("record_id", "capsule_id").withColumnRenamed("split", "eval_split")


# 7 Evaluation texts leaking into training text


@LLM.query("p7_found", oracles.P7_FOUND)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the evaluation items they hold twelve or more words in a row of."""
    return postings.find_passages(postings.build_index(table(spark, d, "documents")), table(spark, d, "eval_items"))


@LLM.query("p7_items")
def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """For every evaluation item the documents that leak it, word for word and nearly."""
    index, items = postings.build_index(table(spark, d, "documents")), table(spark, d, "eval_items")
    exact = postings.find_passages(index, items).withColumn("exact", F.lit(1))
    near = postings.find_passages(index, items, slop=postings.SLOP).withColumn("near", F.lit(1))
    found = exact.join(near, ["doc_id", "item_id"], "full").groupBy("item_id").agg(
        F.count("exact").alias("n_exact"), F.count(F.when(F.col("exact").isNull(), 1)).alias("n_only_near")
    )
    return items.select("item_id", "split_name").distinct().join(found, "item_id", "left").fillna(0, ["n_exact", "n_only_near"])


# 8 Mixing sources to target weights


@LLM.query("p8_mixture")
def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture to target shares, one row for each time a document occurs in it."""
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


@LLM.query("p8_shares")
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share each source was to have and has."""
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _entropy_of(targets: DataFrame) -> float:
    """The entropy of the target shares."""
    own = targets.filter("target_share > 0")
    return own.agg((-F.sum(F.col("target_share") * F.log("target_share")) / F.sum("target_share") + F.log(F.sum("target_share")))).first()[0] or 0.0


@LLM.query("p8_tempered")
def p8_tempered(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the mixture by temperature that is as even as the target shares are, with the same limits on repetition."""
    targets = table(spark, d, "mix_targets")
    return mixing.mixture(table(spark, d, "documents"), targets, entropy=_entropy_of(targets))[1]


# 9 Personal information inside free text


@LLM.query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Kind and place of each piece of personal information."""
    return pii.find_personal(table(spark, d, "documents"), table(spark, d, "known_names"))


@LLM.query("p9_redacted")
def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The documents with typed placeholders."""
    docs = table(spark, d, "documents")
    return pii.redact(docs, pii.find_personal(docs, table(spark, d, "known_names")))
