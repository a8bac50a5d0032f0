"""Queries on positions, windows, splits, ranges and keys over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.functions import text as t
from claimloom.operators.ordering import first_occurrence_index, hash_split, keep_best, permuted, with_position
from claimloom.plans import fragments as sql
from claimloom.registry import CORE
from claimloom.session import table


@CORE.query("first_occurrence_index", "SELECT user_id, row_number() OVER (ORDER BY f, user_id) - 1 AS index FROM (SELECT user_id, min(event_id) AS f FROM events WHERE user_id IS NOT NULL GROUP BY user_id)")
def first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """Dense index of users by first event."""
    return first_occurrence_index(table(spark, d, "events"), "user_id", "event_id")


@CORE.query("csr_offsets", "SELECT o_orderkey, n, coalesce(sum(n) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)")
def csr_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Ragged offsets: how many values stand before each order's."""
    sizes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, d, "orders").select("o_orderkey").join(sizes, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))
    return with_position(rows, ["o_orderkey"], "p", F.col("n"), "start_offset").select("o_orderkey", "n", "start_offset")


_SPLIT = """
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('13:' || o_orderkey), o_orderkey) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderkey FROM orders)),
raw AS (SELECT DISTINCT n, unnest(['train', 'validation', 'test']) AS s, unnest([0.8, 0.1, 0.1]) * n AS x, unnest([1, 2, 3]) AS k FROM o),
base AS (SELECT *, floor(x) AS f, row_number() OVER (ORDER BY x - floor(x) DESC, s DESC) AS r FROM raw),
cnt AS (SELECT s, k, f + CASE WHEN r <= n - (SELECT sum(f) FROM base) THEN 1 ELSE 0 END AS c FROM base),
edges AS (SELECT s, k, sum(c) OVER (ORDER BY k) AS hi FROM cnt)
SELECT o_orderkey, (SELECT arg_min(s, k) FROM edges WHERE p < hi) AS split FROM o"""


@CORE.query("largest_remainder_split", _SPLIT)
def largest_remainder_split(spark: SparkSession, d: str) -> DataFrame:
    """Orders dealt to splits in hash order."""
    return hash_split(table(spark, d, "orders"), "o_orderkey", {"train": 0.8, "validation": 0.1, "test": 0.1}, 13)


@CORE.query(
    "permuted_contexts",
    """WITH c AS (SELECT ids.capsule_id AS capsule_id, min(ids.context_id) AS context_id FROM capsules GROUP BY 1),
s AS (SELECT *, row_number() OVER (ORDER BY capsule_id) - 1 AS slot FROM c),
r AS (SELECT context_id AS moved, row_number() OVER (ORDER BY sha256(concat_ws(':', '13', slot::VARCHAR, coalesce(context_id, ''))), slot) - 1 AS slot FROM s)
SELECT capsule_id, moved AS context_id FROM s JOIN r USING (slot)""",
)
def permuted_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The control that shuffles contexts among capsules."""
    c = table(spark, d, "capsules").groupBy("ids.capsule_id").agg(F.min("ids.context_id").alias("context_id"))
    return permuted(c, ["capsule_id"], "context_id", 13, "context_id")


@CORE.query(
    "permuted_provenance",
    """WITH c AS (SELECT ids.capsule_id AS capsule_id, any_value(provenance_sources) AS p FROM capsules GROUP BY 1),
e AS (SELECT capsule_id, unnest(p).source_id AS source_id, unnest(range(len(p))) AS k FROM c),
s AS (SELECT *, row_number() OVER (ORDER BY capsule_id, k) - 1 AS slot FROM e),
r AS (SELECT source_id AS moved, row_number() OVER (ORDER BY sha256(concat_ws(':', '13', slot::VARCHAR, coalesce(source_id, ''))), slot) - 1 AS slot FROM s)
SELECT capsule_id, k::INTEGER AS k, moved AS source_id FROM s JOIN r USING (slot)""",
)
def permuted_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The control that shuffles sources among capsules, each keeping as many as it had."""
    c = table(spark, d, "capsules").groupBy("ids.capsule_id").agg(F.first("provenance_sources").alias("p"))
    e = c.select("capsule_id", F.posexplode("p").alias("k", "s")).select("capsule_id", "k", F.col("s.source_id").alias("source_id"))
    return permuted(e, ["capsule_id", "k"], "source_id", 13, "source_id")


@CORE.query(
    "lower_median_cutoff",
    "WITH v AS (SELECT strftime(temporal.valid_as_of, '%Y-%m-%dT%H:%M:%S') AS x FROM capsules WHERE temporal.valid_as_of IS NOT NULL), r AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS p, count(*) OVER () AS n FROM v) SELECT x AS cutoff FROM r WHERE p = greatest(0, n // 2 - 1)",
)
def lower_median_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """The lower median of the capsules' times, compared as ISO strings."""
    v = table(spark, d, "capsules").select(F.date_format("temporal.valid_as_of", "yyyy-MM-dd'T'HH:mm:ss").alias("x")).filter("x is not null").withColumn("u", F.monotonically_increasing_id())
    placed = with_position(v, ["x", "u"], "p")
    n = F.broadcast(placed.agg(F.count(F.lit(1)).alias("n")))  # one row
    return placed.join(n, F.col("p") == F.greatest(F.lit(0), F.floor(F.col("n") / 2) - 1)).select(F.col("x").alias("cutoff"))


@CORE.query(
    "batch_rotation",
    """WITH b AS (SELECT event_id, event_type, (row_number() OVER (ORDER BY event_id) - 1) // 32 AS batch FROM events)
SELECT event_id, batch, coalesce(lead(event_type) OVER w, first_value(event_type) OVER w) AS shuffled_type FROM b WINDOW w AS (PARTITION BY batch ORDER BY event_id)""",
)
def batch_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Micro-batches of 32 events in order, values moved on by one within each."""
    b = with_position(table(spark, d, "events").select("event_id", "event_type"), ["event_id"], "p").withColumn("batch", F.floor(F.col("p") / 32))
    w = W.partitionBy("batch").orderBy("event_id")  # 32 rows
    return b.select("event_id", "batch", F.coalesce(F.lead("event_type").over(w), F.first("event_type").over(w)).alias("shuffled_type"))


@CORE.query("ring_edges", """WITH b AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 32 AS batch FROM events)
SELECT batch, event_id AS src, coalesce(lead(event_id) OVER w, first_value(event_id) OVER w) AS dst FROM b WINDOW w AS (PARTITION BY batch ORDER BY event_id)""")
def ring_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each record of a batch tied to the next, the last to the first."""
    b = with_position(table(spark, d, "events").select("event_id"), ["event_id"], "p").withColumn("batch", F.floor(F.col("p") / 32))
    w = W.partitionBy("batch").orderBy("event_id")
    return b.select("batch", F.col("event_id").alias("src"), F.coalesce(F.lead("event_id").over(w), F.first("event_id").over(w)).alias("dst"))


@CORE.query(
    "adjacent_smoothness",
    "WITH s AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dv FROM events) SELECT user_id, count(dv) AS n, round(coalesce(sum(dv * dv), 0), 3) AS energy FROM s GROUP BY user_id",
)
def adjacent_smoothness(spark: SparkSession, d: str) -> DataFrame:
    """Squared steps between a user's values in time order."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, d, "events").select("user_id", (F.col("value") - F.lag("value").over(w)).alias("dv"))
    return s.groupBy("user_id").agg(F.count("dv").alias("n"), F.round(F.coalesce(F.sum(F.col("dv") * F.col("dv")), F.lit(0.0)), 3).alias("energy"))


_REL = "trim(lower(relation_type))"


@CORE.query(
    "best_relations",
    f"""SELECT source_claim, target_claim, {_REL} AS relation_type, arg_min(relation_id, (-coalesce(confidence, -1), relation_id)) AS relation_id, max(coalesce(confidence, -1)) AS confidence
FROM extracted_relations WHERE target_claim IS NOT NULL AND relation_type IS NOT NULL GROUP BY 1, 2, 3""",
)
def best_relations(spark: SparkSession, d: str) -> DataFrame:
    """Of each source, target and type the relation with the highest confidence, of equals the smallest id."""
    r = table(spark, d, "extracted_relations").filter("target_claim is not null and relation_type is not null")
    r = r.select("source_claim", "target_claim", F.trim(F.lower("relation_type")).alias("relation_type"), "relation_id", F.coalesce("confidence", F.lit(-1.0)).alias("confidence"))
    return keep_best(r, ["source_claim", "target_claim", "relation_type"], F.struct(-F.col("confidence"), "relation_id"))


@CORE.query("family_frequency", "SELECT DISTINCT ids.capsule_id AS capsule_id, count(*) OVER (PARTITION BY ids.claim_family_id) AS family_frequency FROM (SELECT DISTINCT ids FROM capsules)")
def family_frequency(spark: SparkSession, d: str) -> DataFrame:
    """How many capsules share each capsule's family."""
    c = table(spark, d, "capsules").select("ids.capsule_id", "ids.claim_family_id").distinct()
    n = c.groupBy("claim_family_id").agg(F.count(F.lit(1)).alias("family_frequency"))
    return c.join(n, c["claim_family_id"].eqNullSafe(n["claim_family_id"])).select("capsule_id", "family_frequency")


@CORE.query("reference_to_missing", "SELECT DISTINCT m.split_name, m.capsule_id FROM split_members m ANTI JOIN (SELECT ids.capsule_id AS capsule_id FROM capsules) c ON m.capsule_id = c.capsule_id")
def reference_to_missing(spark: SparkSession, d: str) -> DataFrame:
    """Listed capsules that do not exist."""
    return table(spark, d, "split_members").select("split_name", "capsule_id").distinct().join(table(spark, d, "capsules").select("ids.capsule_id"), "capsule_id", "left_anti")


@CORE.query("split_filter", "SELECT DISTINCT ids.capsule_id AS capsule_id, claim.claim_type AS claim_type FROM capsules WHERE ids.capsule_id IN (SELECT capsule_id FROM split_members WHERE split_name = 'train')")
def split_filter(spark: SparkSession, d: str) -> DataFrame:
    """Capsules of the train list."""
    ids = table(spark, d, "split_members").filter("split_name = 'train'").select("capsule_id")
    return table(spark, d, "capsules").select("ids.capsule_id", "claim.claim_type").join(ids, "capsule_id", "left_semi").distinct()


@CORE.query("split_masks", """WITH c AS (SELECT DISTINCT ids.capsule_id AS capsule_id FROM capsules), m AS (SELECT DISTINCT split_name, capsule_id FROM split_members)
SELECT capsule_id, max(CASE WHEN split_name = 'train' THEN 1 ELSE 0 END) AS train, max(CASE WHEN split_name = 'validation' THEN 1 ELSE 0 END) AS validation, max(CASE WHEN split_name = 'test' THEN 1 ELSE 0 END) AS test, max(CASE WHEN split_name = 'temporal_holdout' THEN 1 ELSE 0 END) AS temporal_holdout
FROM c LEFT JOIN m USING (capsule_id) GROUP BY capsule_id""")
def split_masks(spark: SparkSession, d: str) -> DataFrame:
    """A 0/1 column for each list."""
    c = table(spark, d, "capsules").select("ids.capsule_id").distinct()
    m = table(spark, d, "split_members").select("split_name", "capsule_id").distinct()
    return c.join(m, "capsule_id", "left").groupBy("capsule_id").agg(*[F.max((F.coalesce("split_name", F.lit("")) == s).cast("int")).alias(s) for s in ("train", "validation", "test", "temporal_holdout")])


@CORE.query("temporal_holdout", """SELECT CASE WHEN valid_as_of <= TIMESTAMP '2024-01-01' THEN 'train' ELSE 'holdout' END AS split, count(*) AS n FROM (SELECT DISTINCT ids.capsule_id, temporal.valid_as_of AS valid_as_of FROM capsules) GROUP BY 1""")
def temporal_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Capsules up to the cutoff to train, later ones and those without a time to the holdout."""
    c = table(spark, d, "capsules").select("ids.capsule_id", "temporal.valid_as_of").distinct()
    return c.groupBy(F.when(F.col("valid_as_of") <= F.lit("2024-01-01").cast("timestamp"), "train").otherwise("holdout").alias("split")).agg(F.count(F.lit(1)).alias("n"))


@CORE.query("later_family_counts", """WITH f AS (SELECT ids.claim_family_id AS family, min(temporal.valid_as_of) AS first_seen FROM capsules WHERE temporal.valid_as_of IS NOT NULL GROUP BY 1)
SELECT family, first_seen, (SELECT count(*) FROM f) - rank() OVER (ORDER BY first_seen) - (count(*) OVER (PARTITION BY first_seen) - 1) AS n_later FROM f""")
def later_family_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many families were first seen after each: the range join on time, counted without forming its pairs."""
    f = table(spark, d, "capsules").filter("temporal.valid_as_of is not null").groupBy(F.col("ids.claim_family_id").alias("family")).agg(F.min("temporal.valid_as_of").alias("first_seen"))
    times = f.groupBy("first_seen").agg(F.count(F.lit(1)).alias("n"))
    placed = with_position(times, ["first_seen"], "p", F.col("n"), "before")
    total = F.broadcast(times.agg(F.sum("n").alias("total")))  # one row
    return f.join(placed.crossJoin(total).select("first_seen", (F.col("total") - F.col("before") - F.col("n")).alias("n_later")), "first_seen").select("family", "first_seen", "n_later")


@CORE.query("stable_ids", f"""SELECT DISTINCT claim_id, {sql.digest('document_id', 'chunk_id', 'text')} AS stable_hash, 'span_' || {sql.digest('claim_id', 'document_id')} AS span_id,
('0x' || {sql.digest('claim_id', length=15)})::BIGINT AS ref FROM extracted_claims""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids and integer references by hash."""
    c = table(spark, d, "extracted_claims")
    return c.select("claim_id", t.stable_hash("document_id", "chunk_id", "text").alias("stable_hash"), t.stable_id("span", "claim_id", "document_id").alias("span_id"), t.stable_int64("claim_id").alias("ref")).distinct()


@CORE.query("running_revenue", "SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey), 2) AS upto FROM orders")
def running_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Running total of order prices in cents over the whole table."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    placed = with_position(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), ["o_orderdate", "o_orderkey"], "p", cents, "b")
    return placed.select("o_orderkey", F.round((F.col("b") + F.round(F.col("o_totalprice") * 100).cast("bigint")) / 100, 2).alias("upto"))
