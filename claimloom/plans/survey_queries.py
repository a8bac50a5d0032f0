"""Queries on graph batches, contexts, budgets, effects, cascades and the smaller parts of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import controls, graphs, metrics, providers
from claimloom.operators.ordering import keep_best, with_position
from claimloom.operators.records import disagreements
from claimloom.plans.capsule_queries import capsules_once
from claimloom.plans.control_queries import ARMS_SQL, related_capsules
from claimloom.registry import CORE
from claimloom.session import table
from claimloom.sources import files, packages


@CORE.query("first_documents", "SELECT DISTINCT file_name, source_path, document_id FROM source_documents ORDER BY file_name, source_path, document_id LIMIT 20")
def first_documents(spark: SparkSession, d: str) -> DataFrame:
    """The sample of the first twenty documents by file name."""
    own = table(spark, d, "source_documents").select("file_name", "source_path", "document_id").distinct()
    return files.first_files(own, 20, "file_name", "document_id")


@CORE.query("context_stream", "WITH c AS (SELECT DISTINCT ids, context FROM capsules) SELECT ids.context_id AS context_id, arg_max(coalesce(array_to_string(context.domains, '|'), ''), ids.capsule_id) AS domains FROM c WHERE ids.context_id IS NOT NULL GROUP BY 1")
def context_stream(spark: SparkSession, d: str) -> DataFrame:
    """One row for each context of the capsules."""
    return packages.context_metadata(capsules_once(spark, d)).select("context_id", F.coalesce(F.array_join("domains", "|"), F.lit("")).alias("domains"))


@CORE.query("star_edges", """WITH c AS (SELECT DISTINCT * FROM capsules), e AS (SELECT ids.capsule_id AS record_id, unnest(['claim_context', 'claim_family', 'claim_state']) AS edge_type, unnest([ids.context_id, ids.claim_family_id, ids.claim_state_id]) AS dst FROM c) SELECT record_id, edge_type, record_id AS src, dst FROM e WHERE dst IS NOT NULL""")
def star_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges from each record's claim."""
    return graphs.star_edges(capsules_once(spark, d))


@CORE.query("source_incidence", """WITH h AS (SELECT DISTINCT ids.capsule_id AS h, list_transform(list_filter(coalesce(provenance_sources, []), lambda x: x.source_id IS NOT NULL), lambda x: x.source_id) AS m FROM capsules), u AS (SELECT h, unnest(m) AS n, unnest(range(len(m))) AS k FROM h), f AS (SELECT h, n, min(k) AS k FROM u GROUP BY ALL)
SELECT h AS hyperedge, n AS node, (row_number() OVER (PARTITION BY h ORDER BY k) - 1)::INTEGER AS role FROM f QUALIFY count(*) OVER (PARTITION BY h) >= 2""")
def source_incidence(spark: SparkSession, d: str) -> DataFrame:
    """Capsules as hyperedges over their sources."""
    c = table(spark, d, "capsules").select("ids.capsule_id", F.col("provenance_sources.source_id").alias("m")).distinct()
    return graphs.incidence(c, "capsule_id", "m")


@CORE.query("loops_of_batches", """WITH e AS (SELECT DISTINCT source_claim AS a, target_claim AS b FROM extracted_relations WHERE source_claim < target_claim), i AS (SELECT claim_id, (row_number() OVER (ORDER BY claim_id) - 1) // 256 AS batch FROM (SELECT DISTINCT claim_id FROM extracted_claims WHERE claim_id IS NOT NULL))
SELECT batch, a, b FROM e JOIN i ON i.claim_id = a QUALIFY row_number() OVER (PARTITION BY batch ORDER BY a, b) <= 32""")
def loops_of_batches(spark: SparkSession, d: str) -> DataFrame:
    """The first 32 edges back and forth of each batch of 256 claims."""
    ids = with_position(table(spark, d, "extracted_claims").select("claim_id").filter("claim_id is not null").distinct(), ["claim_id"], "p").select(F.col("claim_id").alias("a"), F.floor(F.col("p") / 256).alias("batch"))
    e = table(spark, d, "extracted_relations").select(F.col("source_claim").alias("a"), F.col("target_claim").alias("b")).filter("a < b").distinct()
    return graphs.loops_of_batches(e.join(ids, "a"), "batch", ["a", "b"], 32).select("batch", "a", "b")


@CORE.query("best_candidates", """SELECT source_claim, arg_min(target_claim, (-coalesce(confidence, -1), target_claim)) AS target_claim FROM extracted_relations WHERE source_claim IS NOT NULL AND target_claim IS NOT NULL GROUP BY 1""")
def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Of each claim's relations the target with the highest confidence, of equals the smallest."""
    r = table(spark, d, "extracted_relations").filter("source_claim is not null and target_claim is not null").select("source_claim", "target_claim", F.coalesce("confidence", F.lit(-1.0)).alias("c"))
    return keep_best(r, ["source_claim"], F.struct(-F.col("c"), "target_claim")).select("source_claim", "target_claim")


_EV = "WITH m AS (SELECT event_type AS arm_id, count(*) AS n, count(DISTINCT user_id) AS u, max(event_id) AS s FROM events GROUP BY 1)\n"


def _arm_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("arm_id")).agg(F.count(F.lit(1)).alias("total"), F.count_distinct("user_id").alias("trainable"), F.max("event_id").alias("final_step")).withColumns({"records_seen": F.col("total"), "tokens_seen": F.lit(None).cast("long")})


@CORE.query("arm_budgets", _EV + "SELECT arm_id, n AS parameters, u AS trainable_parameters, s AS step_count, n AS records_seen, 0 AS tokens_seen, (2.0 * n * greatest(s, 1))::DOUBLE AS estimated_flops FROM m")
def arm_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Budget rows, an arm for each type of event."""
    return metrics.budgets(_arm_totals(spark, d)).select("arm_id", "parameters", "trainable_parameters", "step_count", "records_seen", "tokens_seen", "estimated_flops")


@CORE.query("fairness_flags", _EV + "SELECT x AS measure, round(v::DOUBLE, 6) AS spread, a AS allowed, v <= a AS fair FROM (SELECT unnest(['parameters', 'estimated_flops']) AS x, unnest([(max(n) - min(n)) / greatest(abs(min(n)), 1), (max(2.0 * n * greatest(s, 1)) - min(2.0 * n * greatest(s, 1))) / greatest(abs(min(2.0 * n * greatest(s, 1))), 1)]) AS v, unnest([0.05, 0.1])::DOUBLE AS a FROM m)")
def fairness_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether the arms' budgets are near enough to each other."""
    return metrics.fairness_flags(metrics.budgets(_arm_totals(spark, d)), {"parameters": 0.05, "estimated_flops": 0.1}).withColumn("spread", F.round("spread", 6))


@CORE.query("control_effects", """WITH s AS (SELECT event_type AS t, avg(value) / 1000 AS v FROM events GROUP BY 1), a AS (SELECT row_number() OVER (ORDER BY t) AS k, v FROM s) SELECT round(max(v) FILTER (k = 1) - coalesce(max(v) FILTER (k = 2), 0), 6) AS geometry_on_minus_off_delta, round(max(v) FILTER (k = 1) - coalesce(max(v) FILTER (k = 3), 0), 6) AS context_shuffle_degradation,
round(max(v) FILTER (k = 1) - coalesce(max(v) FILTER (k = 4), 0), 6) AS geometry_signal_vs_popularity_control FROM a""")
def control_effects(spark: SparkSession, d: str) -> DataFrame:
    """What the controls cost the geometry arm, types of events standing in for the arms in order."""
    names = F.array(*[F.lit(n) for n in (metrics.GEOMETRY_ARM, *metrics.CONTROL_EFFECTS.values())])
    s = with_position(table(spark, d, "events").groupBy("event_type").agg((F.avg("value") / 1000).alias("structured_epistemic_score")), ["event_type"], "p")
    e = metrics.control_effects(s.select(F.get(names, F.col("p").cast("int")).alias("arm_id"), "structured_epistemic_score").filter("arm_id is not null"))
    return e.select(*[F.round(c, 6).alias(c) for c in e.columns])


_RAWQ = """WITH r AS (SELECT DISTINCT raw_id, provider_id, payload FROM raw_claims), q AS (SELECT provider_id, md5(coalesce(CASE WHEN json_valid(payload) THEN payload ->> '$.text' END, raw_id)) AS k, payload, CASE WHEN json_valid(payload) THEN TRY_CAST(payload ->> '$.confidence' AS DOUBLE) END AS c, NOT json_valid(payload) AS w, CASE WHEN json_valid(payload) THEN payload ->> '$.claim_type' END AS y, raw_id FROM r),
p AS (SELECT k, arg_min((payload, c, w, y), raw_id) AS x FROM q WHERE provider_id = 'provider_a' GROUP BY 1), s AS (SELECT k, arg_min((payload, c, w, y), raw_id) AS x FROM q WHERE provider_id <> 'provider_a' GROUP BY 1),
g AS (SELECT p.k, p.x AS px, CASE WHEN coalesce(p.x[2] < 0.72, false) OR p.x[3] OR coalesce(p.x[4] = 'causal_claim', false) THEN s.x END AS sx, (coalesce(p.x[2] < 0.72, false))::INT + p.x[3]::INT + (coalesce(p.x[4] = 'causal_claim', false))::INT AS n FROM p LEFT JOIN s USING (k)),
m AS (SELECT k, n, CASE WHEN sx IS NULL THEN 'single_provider' WHEN px[1] = sx[1] THEN 'provider_outputs_equivalent' WHEN coalesce(sx[2], 0) > coalesce(px[2], 0) THEN 'selected_escalation' ELSE 'selected_primary' END AS decision FROM g)
"""


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    """provider_a's claims and, for those that ask for it, what another provider said of the same text."""
    parsed = providers.parsed_claims(table(spark, d, "raw_claims").select("raw_id", "provider_id", "payload").distinct())
    raw = parsed.join(table(spark, d, "raw_claims").select("raw_id", "payload").distinct(), "raw_id").withColumn("k", F.md5(F.coalesce("text", "raw_id")))
    one = lambda df: keep_best(df.select("k", "raw_id", F.col("payload").alias("output"), "confidence", F.lit(0).alias("n_keys"), (~F.col("valid")).alias("warned"), "claim_type"), ["k"], F.col("raw_id")).drop("raw_id")
    return providers.cascade(one(raw.filter("provider_id = 'provider_a'")), one(raw.filter("provider_id <> 'provider_a'")).select("k", "output", "confidence", "n_keys"), "k", "warned", "claim_type")


@CORE.query("cascade_decisions", _RAWQ + "SELECT k AS key, decision, round(least(1, n / 3), 6) AS escalation_score FROM m")
def cascade_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Which provider's output stands for each text."""
    return _cascade(spark, d).select(F.col("k").alias("key"), "decision", F.round("escalation_score", 6).alias("escalation_score"))


@CORE.query("cascade_counts", _RAWQ + "SELECT count(*) AS total, count(*) FILTER (n > 0) AS escalated, round(count(*) FILTER (n > 0) / count(*), 3) AS escalation_rate, count(*) FILTER (decision LIKE 'selected_%') AS disagreements FROM m")
def cascade_counts(spark: SparkSession, d: str) -> DataFrame:
    """Escalations and disagreements of the cascade."""
    return metrics.cascade_counts(_cascade(spark, d), "decision", F.size("reasons") > 0)


@CORE.query("disagreement_counts", _RAWQ + "SELECT substr(k, 1, 1) AS family, count(*) FILTER (decision LIKE 'selected_%') AS disagreement_count FROM m GROUP BY 1")
def disagreement_counts(spark: SparkSession, d: str) -> DataFrame:
    """Disagreements by group of texts."""
    return disagreements(_cascade(spark, d).withColumn("family", F.substring("k", 1, 1)), "family", "decision")


@CORE.query("arm_canonicality", ARMS_SQL + "SELECT arm, count(*) AS n, count(*) FILTER (text IS NOT NULL AND ts IS NOT NULL AND coalesce(len(src), 0) > 0 AND context IS NOT NULL) AS n_canonical FROM arms GROUP BY 1")
def arm_canonicality(spark: SparkSession, d: str) -> DataFrame:
    """How many records of each arm are still whole records."""
    arms = controls.arms(related_capsules(spark, d))
    whole = F.col("claim.canonical_text").isNotNull() & F.col("temporal.valid_as_of").isNotNull() & F.coalesce(F.size("provenance_sources") > 0, F.lit(False)) & F.col("context").isNotNull()
    return arms.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("n_canonical"))


@CORE.query("curriculum", "SELECT i AS step, 1.0::DOUBLE AS text_projection, round(greatest(0.1, (i + 1) / 500), 6) AS structured, round((i + 1) / 500, 6) AS geometry FROM range(500) r(i)")
def curriculum(spark: SparkSession, d: str) -> DataFrame:
    """Multipliers of the losses over five hundred steps."""
    m = metrics.curriculum(F.col("id"), 500, "linear_complexity_ramp")
    return spark.range(500).select(F.col("id").alias("step"), *[F.round(m[n], 6).alias(n) for n in ("text_projection", "structured", "geometry")])
