"""Queries on similar claims, relations, pools and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import graphs, similarity
from claimloom.operators.ordering import with_position
from claimloom.plans import fragments as sql
from claimloom.plans.substrate import build_families, build_first_seen
from claimloom.registry import CORE
from claimloom.session import table

_SETS = f"s AS (SELECT id, list_distinct({sql.tokens('text')}) AS ts FROM f WHERE len({sql.tokens('text')}) > 0), tok AS (SELECT id, unnest(ts) AS w FROM s), shared AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM tok a JOIN tok b ON a.w = b.w AND a.id <> b.id GROUP BY ALL), j AS (SELECT a, b, k, k / (len(x.ts) + len(y.ts) - k) AS jac, k / len(y.ts) AS ev FROM shared JOIN s x ON a = x.id JOIN s y ON b = y.id)\n"
_ITEMS = "WITH f AS (SELECT item_id AS id, item_text AS text FROM eval_items), " + _SETS


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("family_id"), F.col("item_text").alias("text"), "released_at", "split_name")


def _families(spark: SparkSession, d: str) -> DataFrame:
    """The claim families of all source documents."""
    return build_families(table(spark, d, "source_documents")).select("family_id", F.col("canonical_claim_text").alias("text"), "domains", "first_seen")


@CORE.query("similar_claims", f"WITH f AS (SELECT DISTINCT {sql.fingerprint('text')} AS id, {sql.fingerprint('text')} AS text FROM extracted_claims), " + _SETS + "SELECT a, b, round(jac, 6) AS jaccard FROM j WHERE a < b AND jac >= 0.8")
def similar_claims(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different claim fingerprints with a Jaccard of 0.8 or more."""
    from claimloom.functions import text as t

    fp = table(spark, d, "extracted_claims").select(t.fingerprint("text").alias("fp")).filter("fp <> ''").distinct().withColumn("text", F.col("fp"))
    return similarity.jaccard_pairs(similarity.token_sets(fp, "fp", "text"), "fp", 0.8).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@CORE.query("claim_families")
def claim_families(spark: SparkSession, d: str) -> DataFrame:
    """The family of every claim."""
    return similarity.claim_families(table(spark, d, "extracted_claims"))


def _cue(which: int) -> str:
    parts = []
    for cues, name, c in similarity.RELATION_RULES:
        test = " OR ".join(f"contains(lower(x.text), '{q}')" for q in cues)
        parts.append(f"WHEN {test} THEN {repr(name) if which == 1 else c}")
    return "CASE " + " ".join(parts) + (" WHEN jac >= 0.28 THEN 'related' END" if which == 1 else " WHEN jac >= 0.28 THEN round(least(0.46::DOUBLE, 0.28::DOUBLE + jac), 3) END")


_RELATED = _ITEMS + f", r AS (SELECT a AS source, b AS target, {_cue(1)} AS relation_type, {_cue(2)}::DOUBLE AS confidence, jac FROM j JOIN f x ON a = x.id WHERE ev >= 0.2 OR jac >= 0.18)\n"


@CORE.query("relation_candidates", _RELATED + "SELECT source, target, relation_type, round(confidence, 3) AS confidence FROM r WHERE relation_type IS NOT NULL")
def relation_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Typed relations between evaluation items, by overlap alone."""
    return similarity.relation_candidates(_items(spark, d), edit=False).select("source", "target", "relation_type", F.round("confidence", 3).alias("confidence"))


@CORE.query("relation_candidates_edit")
def relation_candidates_edit(spark: SparkSession, d: str) -> DataFrame:
    """Typed relations between claim families, with the edit similarity too."""
    return similarity.relation_candidates(_families(spark, d)).select("source", "target", "relation_type", "confidence")


@CORE.query("hard_negatives")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """The pool of overlapping evaluation items without a relation of any type. SQL cannot say the edit similarity, so brute force in the tests stands in for it."""
    return similarity.hard_negatives(_items(spark, d)).select("source", "target", F.round("jaccard", 6).alias("jaccard"))


@CORE.query("near_but_distinct")
def near_but_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The pool of alike but distinct claim families."""
    return similarity.near_but_distinct(_families(spark, d))


@CORE.query("family_hard_negatives")
def family_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """The pool of overlapping claim families without a relation of any type."""
    return similarity.hard_negatives(_families(spark, d)).select("source", "target", F.round("jaccard", 6).alias("jaccard"))


@CORE.query("family_same_topic_unrelated")
def family_same_topic_unrelated(spark: SparkSession, d: str) -> DataFrame:
    """The pool of claim families of one domain that hardly overlap and have no relation."""
    return similarity.same_topic_unrelated(_families(spark, d)).select("source", "target", F.round("jaccard", 6).alias("jaccard"))


@CORE.query("family_temporal_distractors")
def family_temporal_distractors(spark: SparkSession, d: str) -> DataFrame:
    """The pool of pairs of a claim family and one first seen later."""
    return similarity.later_pairs(build_first_seen(table(spark, d, "source_documents")).withColumnRenamed("family_id", "source"), "source", "first_seen", "later")


@CORE.query("temporal_distractors", "SELECT l.item_id AS source, r.item_id AS later FROM eval_items l JOIN eval_items r ON r.released_at > l.released_at ORDER BY 1, 2 LIMIT 200")
def temporal_distractors(spark: SparkSession, d: str) -> DataFrame:
    """The pool of pairs of an item and one released later."""
    return similarity.later_pairs(_items(spark, d).withColumnRenamed("family_id", "source"), "source", "released_at", "later")


@CORE.query("provenance_distractors", """WITH c AS (SELECT DISTINCT ids.capsule_id AS id, list_transform(coalesce(provenance_sources, []), lambda x: x.source_id) AS s FROM capsules)
SELECT l.id AS source, r.id AS distractor FROM c l JOIN c r ON l.id <> r.id AND NOT list_has_any(l.s, r.s) ORDER BY 1, 2 LIMIT 200""")
def provenance_distractors(spark: SparkSession, d: str) -> DataFrame:
    """The pool of pairs of capsules without a source in common."""
    c = table(spark, d, "capsules").select("ids.capsule_id", F.coalesce("provenance_sources.source_id", F.array().cast("array<string>")).alias("s")).distinct()
    return similarity.disjoint_pairs(c.withColumnRenamed("capsule_id", "source"), "source", "s", "distractor")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_relations").select(F.col("source_claim").alias("src"), F.col("target_claim").alias("dst")).filter("src is not null and dst is not null").distinct()


_E = "WITH e AS (SELECT DISTINCT source_claim AS src, target_claim AS dst FROM extracted_relations WHERE source_claim IS NOT NULL AND target_claim IS NOT NULL)\n"


@CORE.query("relation_degrees", _E + "SELECT c.claim_id, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in, round(ln(1 + coalesce(o.n, 0)), 6) AS log_out FROM (SELECT DISTINCT claim_id FROM extracted_claims) c LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY 1) o ON c.claim_id = o.src LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY 1) i ON c.claim_id = i.dst")
def relation_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Degrees of all claims, zero where there are none."""
    g = graphs.degrees(_edges(spark, d))
    c = table(spark, d, "extracted_claims").select("claim_id").distinct().join(g, F.col("claim_id") == F.col("node"), "left").fillna(0, ["n_out", "n_in"])
    return c.select("claim_id", "n_out", "n_in", F.round(F.log1p("n_out"), 6).alias("log_out"))


@CORE.query("two_cycles", _E + "SELECT x.src AS a, x.dst AS b FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst")
def two_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Claims that point at each other."""
    return graphs.two_cycles(_edges(spark, d))


@CORE.query("triangles", _E + "SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src WHERE x.src < x.dst AND x.src < y.dst AND x.dst <> y.dst")
def triangles(spark: SparkSession, d: str) -> DataFrame:
    """Directed cycles of three."""
    return graphs.triangles(_edges(spark, d))


@CORE.query("hyperedge_pairs", """WITH h AS (SELECT DISTINCT ids.capsule_id AS capsule_id, unnest(provenance_sources).source_id AS s FROM capsules)
SELECT a.capsule_id, a.s AS src, b.s AS dst FROM h a JOIN h b ON a.capsule_id = b.capsule_id AND a.s <> b.s""")
def hyperedge_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The sources of each capsule tied pairwise."""
    c = table(spark, d, "capsules").select("ids.capsule_id", F.col("provenance_sources.source_id").alias("m")).distinct()
    return graphs.expand_hyperedges(c, "capsule_id", "m")


@CORE.query("graph_nodes", "WITH n AS (SELECT DISTINCT ids.capsule_id AS r, unnest(['claim', 'context', 'family', 'state']) AS node_type, unnest([ids.capsule_id, ids.context_id, ids.claim_family_id, ids.claim_state_id]) AS node_id FROM capsules) SELECT node_type, count(*) AS n, count(DISTINCT node_id) AS n_distinct FROM n GROUP BY 1")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the record graph by type."""
    return graphs.graph_nodes(table(spark, d, "capsules").dropDuplicates()).groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("node_id").alias("n_distinct"))


@CORE.query("context_transitions", """WITH c AS (SELECT DISTINCT ids.capsule_id AS id, context.domains[1] AS domain, context.communities[1] AS community, claim.language AS language FROM capsules), b AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 32 AS batch FROM c),
p AS (SELECT CASE WHEN x.domain IS DISTINCT FROM y.domain THEN 'domain' WHEN x.community IS DISTINCT FROM y.community THEN 'community' WHEN x.language IS DISTINCT FROM y.language THEN 'language' END AS changed FROM b x JOIN b y ON x.batch = y.batch AND x.id <> y.id)
SELECT changed, count(*) AS n FROM p WHERE changed IS NOT NULL GROUP BY 1""")
def context_transitions(spark: SparkSession, d: str) -> DataFrame:
    """How often records of one micro-batch differ, by the first field that does."""
    c = table(spark, d, "capsules").select(F.col("ids.capsule_id").alias("id"), F.get("context.domains", F.lit(0)).alias("domain"), F.get("context.communities", F.lit(0)).alias("community"), F.col("claim.language").alias("language")).distinct()
    b = with_position(c, ["id"], "p").withColumn("batch", F.floor(F.col("p") / 32))
    return graphs.transitions(b, "batch", "id", ["domain", "community", "language"]).groupBy("changed").agg(F.count(F.lit(1)).alias("n"))
