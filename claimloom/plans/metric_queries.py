"""Queries on metrics, vectors, provider outputs and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text as t
from claimloom.operators import metrics, providers, vectors
from claimloom.plans import fragments as sql
from claimloom.registry import CORE
from claimloom.session import table

_PRED = "CASE WHEN l_shipdate > TIMESTAMP '1998-06-01' THEN 'N' WHEN l_quantity > 25 THEN 'R' ELSE 'A' END"
_LI = f"WITH p AS (SELECT l_returnflag AS t, {_PRED} AS p, l_discount > 0 AS m, l_tax, l_discount FROM lineitem)\n"


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("l_shipdate") > F.lit("1998-06-01").cast("timestamp"), "N").when(F.col("l_quantity") > 25, "R").otherwise("A")
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("t"), p.alias("p"), (F.col("l_discount") > 0).alias("m"), "l_tax", "l_discount")


@CORE.query("masked_metrics", _LI + "SELECT round(sum((t = p AND m)::INT) / greatest(sum(m::INT), 1), 6) AS accuracy, round(sum(pow(l_tax - l_discount, 2) * m::INT) / greatest(sum(m::INT), 1), 6) AS mse, round(sum(abs(l_tax - l_discount) * m::INT) / greatest(sum(m::INT), 1), 6) AS mae FROM p")
def masked_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, squared and absolute error over the rows a mask leaves."""
    p = _predictions(spark, d)
    err = F.col("l_tax") - F.col("l_discount")
    return p.agg(*[F.round(metrics.masked_mean(x, F.col("m")), 6).alias(n) for n, x in (("accuracy", (F.col("t") == F.col("p")).cast("double")), ("mse", err * err), ("mae", F.abs(err)))])


@CORE.query("macro_f1", _LI + ", l AS (SELECT DISTINCT t AS l FROM p WHERE m), f AS (SELECT l, 2 * count(*) FILTER (t = l AND p = l) / (count(*) FILTER (t = l) + count(*) FILTER (p = l)) AS f1 FROM p, l WHERE m GROUP BY l) SELECT round(avg(f1), 6) AS macro_f1 FROM f")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    """Mean F1 over the labels among the targets."""
    return metrics.macro_f1(_predictions(spark, d), "t", "p", F.col("m")).select(F.round("macro_f1", 6).alias("macro_f1"))


_NEAR = """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query, q.label AS ql, e.vec_id AS neighbour, e.label AS el, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS similarity FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, neighbour) AS rank FROM s)
"""


def _nearest(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vectors.nearest(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", k)


@CORE.query("nearest_vectors", _NEAR + "SELECT query, neighbour, rank::INTEGER AS rank, round(similarity, 6) AS similarity FROM r WHERE rank <= 10")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, among all."""
    return _nearest(spark, d, 10).select("query", "neighbour", "rank", F.round("similarity", 6).alias("similarity"))


@CORE.query("neighbour_ranking", _NEAR + ", f AS (SELECT query, min(CASE WHEN ql = el AND rank <= 20 THEN rank END) AS first FROM r GROUP BY query) SELECT round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_at_5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM f")
def neighbour_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 5 and reciprocal rank of the first neighbour with the query's label, among twenty."""
    label = table(spark, d, "embeddings").select("vec_id", "label")
    n = _nearest(spark, d, 20).join(label.toDF("query", "ql"), "query").join(label.toDF("neighbour", "el"), "neighbour")
    first = n.groupBy("query").agg(F.min(F.when(F.col("ql") == F.col("el"), F.col("rank"))).alias("first"))
    recall, mrr = metrics.ranking(first, "first", 5)
    return first.agg(recall, mrr).select(F.round("recall_at_5", 6).alias("recall_at_5"), F.round("mrr", 6).alias("mrr"))


@CORE.query("scaled_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: sign(x) * ln(1 + abs(x::DOUBLE)) / 32)), 6) AS total, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS best FROM embeddings")
def scaled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Scaled features summed, and the place of the largest."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + t.scaled(x)), 6).alias("total"), (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("best"))


@CORE.query("label_pooling", "SELECT label, i::INTEGER AS i, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL")
def label_pooling(spark: SparkSession, d: str) -> DataFrame:
    """Element-wise mean vector of each label."""
    return table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


_RAW = "WITH r AS (SELECT DISTINCT raw_id, provider_id, payload, json_valid(payload) AS valid FROM raw_claims), p AS (SELECT raw_id, provider_id, valid, CASE WHEN valid THEN payload ->> '$.text' END AS text, CASE WHEN valid THEN payload ->> '$.claim_type' END AS claim_type, CASE WHEN valid THEN TRY_CAST(payload ->> '$.confidence' AS DOUBLE) END AS confidence FROM r)\n"


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return providers.parsed_claims(table(spark, d, "raw_claims").dropDuplicates(["raw_id"]))


@CORE.query("parsed_raw_claims", _RAW + "SELECT raw_id, valid, text, claim_type, confidence FROM p")
def parsed_raw_claims(spark: SparkSession, d: str) -> DataFrame:
    """Raw claims as rows, broken ones marked."""
    return _parsed(spark, d).select("raw_id", "valid", "text", "claim_type", "confidence")


@CORE.query("escalations", _RAW + f"SELECT provider_id, count(*) AS n, count(*) FILTER (confidence < {providers.MIN_CONFIDENCE} OR NOT valid OR claim_type = 'causal_claim') AS escalated, count(*) FILTER (confidence < {providers.MIN_CONFIDENCE}) AS low_confidence FROM p GROUP BY provider_id")
def escalations(spark: SparkSession, d: str) -> DataFrame:
    """How many outputs of each provider ask for a second opinion."""
    p = _parsed(spark, d)
    reasons, _ = providers.escalation(F.col("confidence"), ~F.col("valid"), F.col("claim_type"))
    p = p.withColumn("reasons", reasons)
    return p.groupBy("provider_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("reasons") > 0).alias("escalated"), F.count_if(F.array_contains("reasons", "low_confidence")).alias("low_confidence"))


@CORE.query(
    "merged_outputs",
    _RAW + f""", o AS (SELECT {sql.fingerprint('text')} AS k, provider_id, min((-coalesce(confidence, 0), raw_id, claim_type)) AS m FROM p WHERE valid AND text IS NOT NULL GROUP BY ALL),
x AS (SELECT a.k, a.m[1] AS pc, b.m[1] AS sc, a.m[3] AS po, b.m[3] AS so FROM (SELECT * FROM o WHERE provider_id = 'provider_a') a LEFT JOIN (SELECT * FROM o WHERE provider_id = 'provider_b') b USING (k))
SELECT k AS request, CASE WHEN so IS NULL THEN 'single_provider' WHEN po = so THEN 'provider_outputs_equivalent' WHEN -sc > -pc THEN 'selected_escalation' ELSE 'selected_primary' END AS decision FROM x""",
)
def merged_outputs(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of two providers' outputs on one text."""
    p = _parsed(spark, d).filter("valid and text is not null").withColumn("k", t.fingerprint("text"))
    o = p.groupBy("k", "provider_id").agg(F.min(F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), "raw_id", "claim_type")).alias("m"))
    side = lambda name: o.filter(F.col("provider_id") == name).select("k", F.col("m.claim_type").alias("output"), (-F.col("m.c")).alias("confidence"), F.lit(1).alias("n_keys"))
    return providers.merge_outputs(side("provider_a"), side("provider_b"), "k").select(F.col("k").alias("request"), "decision")


@CORE.query("cache_hits", """WITH r AS (SELECT DISTINCT raw_id, provider_id, payload FROM raw_claims), h AS (SELECT raw_id, provider_id, 'sha256:' || sha256(payload) AS h FROM r), c AS (SELECT DISTINCT h FROM h WHERE provider_id = 'provider_a')
SELECT provider_id, count(*) AS n, count(c.h) AS hits FROM h LEFT JOIN c USING (h) GROUP BY provider_id""")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Requests that provider_a's answers would serve."""
    r = table(spark, d, "raw_claims").select("raw_id", "provider_id", "payload").distinct().withColumn("h", providers.request_hash("payload"))
    r = r.withColumnRenamed("h", "request_hash")
    cache = r.filter("provider_id = 'provider_a'").select("request_hash", F.col("raw_id").alias("output"))
    answers, _ = providers.replay_or_run(r.withColumnRenamed("payload", "input"), cache, lambda texts: texts, "cache_only")
    return r.join(answers.filter("cached").select("request_hash", F.lit(1).alias("hit")), "request_hash", "left").groupBy("provider_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))


@CORE.query("answered_requests", """WITH r AS (SELECT DISTINCT raw_id, provider_id, payload FROM raw_claims), h AS (SELECT provider_id, payload, 'sha256:' || sha256(payload) AS h FROM r), c AS (SELECT DISTINCT h FROM h WHERE provider_id = 'provider_a')
SELECT DISTINCT h AS request_hash, CASE WHEN h IN (SELECT h FROM c) THEN 'known' ELSE upper(substr(payload, 1, 20)) END AS output, h IN (SELECT h FROM c) AS cached FROM h""")
def answered_requests(spark: SparkSession, d: str) -> DataFrame:
    """Every payload answered, from provider_a's answers or by a provider that is run."""
    r = table(spark, d, "raw_claims").select("raw_id", "provider_id", "payload").distinct().select("provider_id", F.col("payload").alias("input"), providers.request_hash("payload").alias("request_hash"))
    cache = r.filter("provider_id = 'provider_a'").select("request_hash", F.lit("known").alias("output"))
    return providers.replay_or_run(r, cache, lambda texts: texts.str.slice(0, 20).str.upper())[0]


@CORE.query("epistemic_proxies", """WITH c AS (SELECT DISTINCT ids.capsule_id AS capsule_id, coalesce(len(provenance_sources), 0)::DOUBLE AS s, coalesce(len(context.communities), 0)::DOUBLE AS r FROM capsules)
SELECT capsule_id, round(least(0.85, 0.35 + 0.1 * s), 3) AS evidential_anchoring, round(greatest(0.2, least(0.9, 0.7 - 0.05 * s)), 3) AS uncertainty, round(least(0.6, r / 10.0), 3) AS transformation_pressure FROM c""")
def epistemic_proxies(spark: SparkSession, d: str) -> DataFrame:
    """Proxies from the number of sources and communities."""
    c = table(spark, d, "capsules").dropDuplicates()
    p = providers.epistemic_proxies(F.greatest(F.coalesce(F.size("provenance_sources"), F.lit(0)), F.lit(0)), F.greatest(F.coalesce(F.size("context.communities"), F.lit(0)), F.lit(0)), F.lit(0))
    return c.select("ids.capsule_id", *[p[k].alias(k) for k in ("evidential_anchoring", "uncertainty", "transformation_pressure")])


@CORE.query("quality_tiers", """WITH l AS (SELECT capsule_id, count(DISTINCT split_name) - 1 AS g, bool_or(split_name = 'temporal_holdout') AS v FROM split_members GROUP BY 1), c AS (SELECT DISTINCT ids.capsule_id AS capsule_id, extraction_confidence AS conf, CASE WHEN coalesce(len(provenance_sources), 0) = 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(len(context.domains), 0) = 0 THEN 1 ELSE 0 END AS w FROM capsules)
SELECT CASE WHEN coalesce(v, false) THEN 'gold' WHEN w > 1 OR conf < 0.2 THEN 'quarantine' WHEN conf >= 0.72 AND coalesce(g, 0) = 0 THEN 'silver' ELSE 'bronze' END AS quality_tier, count(*) AS n FROM c LEFT JOIN l USING (capsule_id) GROUP BY 1""")
def quality_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Capsules by quality tier; those of the temporal holdout count as reviewed, those in several lists as disputed."""
    c = table(spark, d, "capsules").dropDuplicates().withColumn("capsule_id", F.col("ids.capsule_id"))
    lists = table(spark, d, "split_members").groupBy("capsule_id").agg((F.count_distinct("split_name") - 1).alias("g"), F.bool_or(F.col("split_name") == "temporal_holdout").alias("v"))
    w = (F.coalesce(F.size("provenance_sources"), F.lit(0)) <= 0).cast("int") + (F.coalesce(F.size("context.domains"), F.lit(0)) <= 0).cast("int")
    tier = providers.quality_tier(F.col("extraction_confidence"), w, F.coalesce("g", F.lit(0)), F.coalesce("v", F.lit(False)))
    return c.join(lists, "capsule_id", "left").groupBy(tier.alias("quality_tier")).agg(F.count(F.lit(1)).alias("n"))


@CORE.query("learning_rate", "SELECT i AS step, round(CASE WHEN i < 100 THEN i / 100 ELSE greatest(0.0, (1000 - i) / 900) END, 6) AS factor FROM range(1000) r(i)")
def learning_rate(spark: SparkSession, d: str) -> DataFrame:
    """Warm-up and decay over a thousand steps."""
    return spark.range(1000).select(F.col("id").alias("step"), F.round(metrics.warmup_decay(F.col("id"), 100, 1000), 6).alias("factor"))


_ARM = "WITH a AS (SELECT event_type AS arm, avg(value) / 1000 AS accuracy, avg(value) / 20 AS ce FROM events GROUP BY 1)\n"


def _arms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("arm")).agg((F.avg("value") / 1000).alias("accuracy"), (F.avg("value") / 20).alias("ce"))


@CORE.query("arm_scores", _ARM + "SELECT arm, round(greatest(0, accuracy + 1 / greatest(exp(least(ce, 20)), 1)), 6) AS text_score FROM a")
def arm_scores(spark: SparkSession, d: str) -> DataFrame:
    """Text score of each arm."""
    return _arms(spark, d).select("arm", F.round(metrics.text_score(F.col("accuracy"), F.col("ce"), F.lit(None).cast("double")), 6).alias("text_score"))


@CORE.query("arm_comparison", _ARM + "SELECT x.arm AS left_arm, y.arm AS right_arm, round(y.accuracy - x.accuracy, 6) AS delta FROM a x JOIN a y ON x.arm < y.arm")
def arm_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of arms compared; there are a few arms."""
    a = _arms(spark, d).select("arm", "accuracy")
    l, r = a.toDF("left_arm", "l"), a.toDF("right_arm", "r")
    return l.join(r, F.col("left_arm") < F.col("right_arm")).select("left_arm", "right_arm", F.round(F.col("r") - F.col("l"), 6).alias("delta"))


@CORE.query("fairness", _ARM + "SELECT round((max(accuracy) - min(accuracy)) / greatest(abs(min(accuracy)), 1), 6) AS spread FROM a")
def fairness(spark: SparkSession, d: str) -> DataFrame:
    """Relative spread between arms."""
    return _arms(spark, d).agg(F.round(metrics.relative_spread(F.min("accuracy"), F.max("accuracy")), 6).alias("spread"))
