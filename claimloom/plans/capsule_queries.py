"""Queries on capsules: audits, rendering, arms, vocabularies, feature groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text as t
from claimloom.operators import audits, render, tensors
from claimloom.plans import fragments as sql
from claimloom.registry import CORE
from claimloom.session import table
from claimloom.sources import packages



def capsules_once(spark: SparkSession, d: str) -> DataFrame:
    """Capsules with repeated rows taken once."""
    return table(spark, d, "capsules").dropDuplicates()


_C = "WITH c AS (SELECT DISTINCT * FROM capsules), s AS (SELECT ids.capsule_id AS id, temporal.valid_as_of AS v, unnest(provenance_sources) AS s, unnest(range(len(provenance_sources))) AS k FROM c)\n"


@CORE.query("audit_temporal_leakage", _C + "SELECT 'temporal_leakage' AS audit, 'error' AS severity, id AS record_id, 'provenance_sources[' || k || '].source_date' AS path FROM s WHERE s.source_date > v AND NOT coalesce(s.target_only, false)")
def audit_temporal_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Sources dated after the capsule's time."""
    return audits.temporal_leakage(capsules_once(spark, d)).select("audit", "severity", "record_id", "path")


@CORE.query(
    "audit_provenance",
    _C + """SELECT id AS record_id, 'provenance_sources[' || k || '].' || f AS path, message, severity FROM (
 SELECT id, k, unnest(['source_id', 'title', 'source_date']) AS f, unnest(['source without source_id', 'source without title', 'source without source_date']) AS message, unnest(['error', 'warning', 'warning']) AS severity, unnest([s.source_id IS NULL, s.title IS NULL, s.source_date IS NULL]) AS bad FROM s) WHERE bad
UNION ALL SELECT ids.capsule_id, 'provenance_sources', 'no sources', 'warning' FROM c WHERE coalesce(len(provenance_sources), 0) = 0""",
)
def audit_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Missing sources and missing parts of sources."""
    return audits.provenance_integrity(capsules_once(spark, d)).select("record_id", "path", "message", "severity")


@CORE.query(
    "audit_splits",
    """WITH m AS (SELECT split_name, capsule_id, count(*) AS n FROM split_members GROUP BY ALL), k AS (SELECT DISTINCT ids.capsule_id AS capsule_id FROM capsules)
SELECT 'listed repeatedly' AS message, capsule_id AS record_id, split_name AS path, n::VARCHAR AS value FROM m WHERE n > 1
UNION ALL SELECT 'in several lists', capsule_id, 'splits', count(*)::VARCHAR FROM m GROUP BY capsule_id HAVING count(*) > 1
UNION ALL SELECT 'unknown id', capsule_id, split_name, NULL FROM m WHERE capsule_id NOT IN (SELECT capsule_id FROM k)""",
)
def audit_splits(spark: SparkSession, d: str) -> DataFrame:
    """Repeated, ambiguous and unknown ids of the published lists."""
    return audits.split_integrity(table(spark, d, "split_members"), table(spark, d, "capsules")).select("message", "record_id", "path", "value")


@CORE.query(
    "audit_relations",
    """WITH r AS (SELECT DISTINCT relation_id, source_claim, target_claim, relation_type FROM extracted_relations)
SELECT relation_id AS record_id, 'target_claim' AS path, 'error' AS severity FROM r WHERE target_claim IS NULL UNION ALL SELECT relation_id, 'source_claim', 'error' FROM r WHERE source_claim IS NULL
UNION ALL SELECT relation_id, 'relation_type', 'warning' FROM r WHERE relation_type IS NULL""",
)
def audit_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations that lack an end or a type."""
    return audits.relation_integrity(table(spark, d, "extracted_relations")).select("record_id", "path", "severity")


REQUIRED = {"claim.canonical_text": "error", "claim.claim_type": "error", "claim.language": "warning", "claim.family_label": "warning", "temporal.valid_as_of": "error", "temporal.leakage_validation_status": "warning", "ids.claim_family_id": "error"}


@CORE.query(
    "audit_required_fields",
    "WITH c AS (SELECT DISTINCT * FROM capsules)\n" + "\nUNION ALL ".join(f"SELECT ids.capsule_id AS record_id, '{p}' AS path, '{s}' AS severity FROM c WHERE trim(coalesce({p}::VARCHAR, '')) = ''" for p, s in REQUIRED.items()),
)
def audit_required_fields(spark: SparkSession, d: str) -> DataFrame:
    """Null and blank required fields."""
    return audits.required_fields(capsules_once(spark, d), REQUIRED).select("record_id", "path", "severity")


_TREE = """WITH r AS (SELECT raw_id AS rid, any_value(payload) AS p FROM raw_claims GROUP BY 1), t AS (SELECT rid, j.fullkey AS k, j.key AS n FROM (SELECT rid, p::JSON AS p FROM r WHERE json_valid(p)) q, json_tree(q.p) AS j WHERE j.key IS NOT NULL AND j.fullkey NOT LIKE '%]')
"""


@CORE.query("audit_forbidden_keys", _TREE + f"SELECT 'forbidden_keys' AS audit, 'error' AS severity, 'forbidden key' AS message, rid AS record_id, k AS path, n AS value FROM t WHERE lower(n) IN ({sql.quoted(audits.VALIDATOR_FORBIDDEN_KEYS)})")
def audit_forbidden_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of raw claims, at any depth, that no record may carry."""
    return audits.forbidden_keys(table(spark, d, "raw_claims").dropDuplicates(["raw_id"]), "raw_id", "payload")


@CORE.query("audit_named_keys", _TREE + "SELECT n AS value, count(*) AS n FROM t WHERE lower(n) IN ('notes', 'start_char') GROUP BY 1")
def audit_named_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key audit with names that raw claims do carry, so that there is something to find."""
    raw = table(spark, d, "raw_claims").dropDuplicates(["raw_id"])
    return audits.forbidden_keys(raw, "raw_id", "payload", ("notes", "start_char")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@CORE.query("text_markers", "SELECT doc_id::VARCHAR AS record_id, m AS value FROM (SELECT doc_id, text, unnest(['truth labels', 'telescope']) AS m FROM documents) WHERE contains(lower(text), m)")
def text_markers(spark: SparkSession, d: str) -> DataFrame:
    """The marker audit with markers that documents do show."""
    return audits.target_exposure(table(spark, d, "documents"), "doc_id", "text", ("truth labels", "telescope")).select("record_id", "value")


@CORE.query("raw_claim_keys", _TREE + "SELECT regexp_replace(replace(k, '\"', ''), '\\[\\d+\\]', '[]', 'g') AS path, count(*) AS n FROM t GROUP BY 1")
def raw_claim_keys(spark: SparkSession, d: str) -> DataFrame:
    """How often each key occurs in the raw claims, by its path without places in lists."""
    keys = audits.json_keys(table(spark, d, "raw_claims").dropDuplicates(["raw_id"]), "raw_id", "payload")
    return keys.groupBy(F.regexp_replace("path", r"\[\d+\]", "[]").alias("path")).agg(F.count(F.lit(1)).alias("n"))


@CORE.query(
    "audit_target_exposure",
    "SELECT doc_id::VARCHAR AS record_id, m AS value FROM (SELECT doc_id, text, unnest([" + sql.quoted(audits.TARGET_MARKERS) + "]) AS m FROM documents) WHERE contains(lower(text), m)",
)
def audit_target_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Documents that show a target marker."""
    return audits.target_exposure(table(spark, d, "documents"), "doc_id", "text").select("record_id", "value")


@CORE.query("audit_summary", _C + """, f AS (
SELECT 'error' AS severity FROM s WHERE s.source_date > v AND NOT coalesce(s.target_only, false)
UNION ALL SELECT 'error' FROM s WHERE s.source_id IS NULL UNION ALL SELECT 'warning' FROM s WHERE s.title IS NULL UNION ALL SELECT 'warning' FROM s WHERE s.source_date IS NULL
UNION ALL SELECT 'warning' FROM c WHERE coalesce(len(provenance_sources), 0) = 0 UNION ALL SELECT 'warning' FROM c WHERE coalesce(len(context.domains), 0) = 0)
SELECT count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM f""")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    """Findings by severity."""
    c = capsules_once(spark, d)
    return audits.severity_counts(audits.union_all([audits.temporal_leakage(c), audits.provenance_integrity(c), audits.context_integrity(c)]))


@CORE.query("record_validity", """SELECT DISTINCT ids.capsule_id AS capsule_id, CASE WHEN coalesce(axc_format, '') <> 'AXC' THEN 'format' WHEN coalesce(format_version, '') <> '0.1.0' THEN 'version' WHEN claim.canonical_text IS NULL OR temporal.valid_as_of IS NULL OR coalesce(len(provenance_sources), 0) = 0 THEN 'schema' END AS issue FROM capsules""")
def record_validity(spark: SparkSession, d: str) -> DataFrame:
    """The first fault of each capsule, null for valid ones."""
    c = table(spark, d, "capsules")
    complete = F.col("claim.canonical_text").isNotNull() & F.col("temporal.valid_as_of").isNotNull() & F.coalesce(F.size("provenance_sources") > 0, F.lit(False))
    return c.select("ids.capsule_id", audits.record_issue(F.col("axc_format"), F.col("format_version"), F.lit(False), complete).alias("issue")).distinct()


_TITLES = "array_to_string(list_filter(list_transform(coalesce(provenance_sources, []), lambda x: x.title), lambda x: coalesce(x, '') <> ''), '; ')"
_line = lambda label, v: f"CASE WHEN coalesce({v}, '') <> '' THEN '{label}: ' || {v} END"
_CTX = _line("Context", "ids.context_id") + ", " + _line("Domains", "array_to_string(context.domains, ', ')")
_TEXTS = {
    "flat_text": "trim(coalesce(claim.canonical_text, ''))",
    "structured_text": f"concat_ws(chr(10), {_line('Claim', 'claim.canonical_text')}, {_CTX}, {_line('Sources', _TITLES)})",
    "capsule_text": f"concat_ws(chr(10), {_line('Claim', 'claim.canonical_text')}, {_line('Type', 'claim.claim_type')}, {_line('Sources', _TITLES)}, {_CTX})",
    "no_provenance": f"concat_ws(chr(10), {_line('Claim', 'claim.canonical_text')}, {_CTX})",
    "no_context": f"concat_ws(chr(10), {_line('Claim', 'claim.canonical_text')}, {_line('Sources', _TITLES)})",
    "popularity_control": f"concat_ws(chr(10), {_line('Claim', 'claim.canonical_text')}, 'source_count_proxy: ' || coalesce(len(provenance_sources), 0), 'claim_family_frequency_proxy: ' || freq)",
}
_ARMS = "WITH c AS (SELECT *, count(*) OVER (PARTITION BY ids.claim_family_id) AS freq FROM (SELECT DISTINCT * FROM capsules)), arms AS (\n" + "\nUNION ALL ".join(
    f"SELECT ids.capsule_id AS capsule_id, '{a}' AS arm, {x} AS text, {'0' if a == 'no_provenance' else 'coalesce(len(provenance_sources), 0)'} AS n_sources, {'false' if a in ('no_context', 'popularity_control') else 'context IS NOT NULL'} AS has_context, ids.context_id AS context_id, ids.claim_family_id AS claim_family_id FROM c"
    for a, x in _TEXTS.items()
) + ")\n"
_NTOK = "len(list_filter(string_split(" + sql.SQUEEZE.format(x="text") + ", ' '), lambda w: w <> ''))"


@CORE.query("rendered_arms", _ARMS + "SELECT capsule_id, arm, text, n_sources FROM arms")
def rendered_arms(spark: SparkSession, d: str) -> DataFrame:
    """Every capsule as text, in every arm."""
    return render.arms(capsules_once(spark, d)).select("capsule_id", "arm", "text", "n_sources")


@CORE.query(
    "arm_metrics",
    _ARMS + f"""SELECT arm, count(*) AS record_count, sum(length(text))::BIGINT AS total_rendered_characters, sum({_NTOK})::BIGINT AS total_token_count, round(sum({_NTOK}) / count(*), 6) AS average_token_count, max({_NTOK}) AS max_token_count,
count(*) FILTER (trim(text) = '') AS empty_text_count, sum(n_sources)::BIGINT AS provenance_source_count, round(sum(n_sources) / count(*), 6) AS average_sources_per_capsule, count(*) FILTER (has_context) AS context_count,
count(DISTINCT CASE WHEN has_context THEN context_id END) AS unique_context_count, count(DISTINCT claim_family_id) AS unique_claim_family_count FROM arms GROUP BY arm""",
)
def arm_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Dataset metrics of every arm in one pass."""
    return render.arm_metrics(render.arms(capsules_once(spark, d)))


_VALUES = """WITH c AS (SELECT DISTINCT * FROM capsules), v AS (SELECT 'claim_type' AS category, claim.claim_type AS value FROM c UNION ALL SELECT 'language', claim.language FROM c UNION ALL SELECT 'leakage_status', temporal.leakage_validation_status FROM c
UNION ALL SELECT 'domain', unnest(context.domains) FROM c UNION ALL SELECT 'community', unnest(context.communities) FROM c),
s AS (SELECT DISTINCT category, value FROM v WHERE value IS NOT NULL AND trim(value) <> '' AND value NOT IN ('<pad>', '<unk>')),
vocab AS (SELECT category, value, row_number() OVER (PARTITION BY category ORDER BY value) + 1 AS idx FROM s UNION ALL SELECT category, unnest(['<pad>', '<unk>']), unnest([0, 1]) FROM (SELECT DISTINCT category FROM s))
"""


@CORE.query("vocabulary", _VALUES + "SELECT category, value, idx FROM vocab")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Vocabularies of what capsules have."""
    return tensors.vocabulary(tensors.capsule_values(capsules_once(spark, d)))


@CORE.query("lateral_context", _VALUES + """SELECT c.ids.capsule_id AS capsule_id, coalesce(d.idx, 1) AS domain_idx, coalesce(m.idx, 1) AS community_idx, coalesce(y.idx, 1) AS claim_type_idx FROM c
LEFT JOIN vocab d ON d.category = 'domain' AND d.value = c.context.domains[1] LEFT JOIN vocab m ON m.category = 'community' AND m.value = c.context.communities[1] LEFT JOIN vocab y ON y.category = 'claim_type' AND y.value = c.claim.claim_type""")
def lateral_context(spark: SparkSession, d: str) -> DataFrame:
    """First domain, first community and type of each capsule as vocabulary indices."""
    c = capsules_once(spark, d)
    vocab = tensors.vocabulary(tensors.capsule_values(c))
    rows = c.select("ids.capsule_id", F.get("context.domains", F.lit(0)).alias("d"), F.get("context.communities", F.lit(0)).alias("m"), F.col("claim.claim_type").alias("y"))
    for value, category, name in (("d", "domain", "domain_idx"), ("m", "community", "community_idx"), ("y", "claim_type", "claim_type_idx")):
        rows = tensors.encoded(rows, value, category, vocab, name)
    return rows.select("capsule_id", "domain_idx", "community_idx", "claim_type_idx")


@CORE.query("temporal_group", """SELECT DISTINCT ids.capsule_id AS capsule_id, coalesce(floor(epoch(temporal.valid_as_of))::BIGINT, -1) AS valid_as_of, coalesce(floor(epoch(temporal.observed_at))::BIGINT, -1) AS observed_at, coalesce(floor(epoch(temporal.source_publication_date))::BIGINT, -1) AS source_publication_date,
coalesce(floor(epoch(temporal.observed_at))::BIGINT - floor(epoch(temporal.source_publication_date))::BIGINT, -1) AS publication_delta, CASE WHEN len(list_filter(coalesce(provenance_sources, []), lambda x: coalesce(x.target_only, false))) > 0 THEN 1 ELSE 0 END AS target_only_mask FROM capsules""")
def temporal_group(spark: SparkSession, d: str) -> DataFrame:
    """Times as seconds with sentinels."""
    return tensors.temporal_group(capsules_once(spark, d))


@CORE.query("claim_group", f"""SELECT DISTINCT ids.capsule_id AS capsule_id, ('0x' || {sql.digest('ids.capsule_id', length=15)})::BIGINT AS capsule_ref, ('0x' || {sql.digest('ids.claim_family_id', length=15)})::BIGINT AS family_ref,
len(list_filter(string_split({sql.SQUEEZE.format(x="coalesce(claim.canonical_text, '')")}, ' '), lambda w: w <> '')) AS n_words, length(coalesce(claim.canonical_text, '')) AS n_chars FROM capsules""")
def claim_group(spark: SparkSession, d: str) -> DataFrame:
    """References and lengths of claims."""
    return tensors.claim_group(capsules_once(spark, d))


@CORE.query("mask_summary", """WITH c AS (SELECT DISTINCT * FROM capsules) SELECT sum((coalesce(len(provenance_sources), 0) > 0)::INT)::BIGINT AS available_provenance_targets, sum((coalesce(claim.canonical_text, '') <> '')::INT)::BIGINT AS available_text_targets, sum((extraction_confidence IS NOT NULL)::INT)::BIGINT AS available_epistemic_targets, count(*) AS loss_mask_temporal_prediction FROM c""")
def mask_summary(spark: SparkSession, d: str) -> DataFrame:
    """Column sums of the masks."""
    m = tensors.masks(capsules_once(spark, d))
    return m.agg(*[F.sum(c).alias(c) for c in ("available_provenance_targets", "available_text_targets", "available_epistemic_targets", "loss_mask_temporal_prediction")])


@CORE.query("ragged_sources", f"""WITH c AS (SELECT DISTINCT ids.capsule_id AS capsule_id, coalesce(provenance_sources, []) AS p FROM capsules)
SELECT capsule_id, row_number() OVER (ORDER BY capsule_id) - 1 AS record_index, list_transform(p, lambda x: ('0x' || {sql.digest('x.source_id', length=15)})::BIGINT) AS refs, len(p) AS n, coalesce(sum(len(p)) OVER (ORDER BY capsule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset FROM c""")
def ragged_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources of capsules as a ragged array with offsets."""
    return tensors.ragged_sources(capsules_once(spark, d))


_WORDS = "WITH w AS (SELECT item_id, unnest(ws) AS token, unnest(range(len(ws))) AS k FROM (SELECT item_id, list_filter(string_split(" + sql.SQUEEZE.format(x="lower(item_text)") + ", ' '), lambda x: x <> '') AS ws FROM eval_items)), f AS (SELECT token, min((item_id, k)) AS f FROM w GROUP BY token), v AS (SELECT token, row_number() OVER (ORDER BY f) + 1 AS idx FROM f)\n"


@CORE.query("fitted_tokens", _WORDS + "SELECT token, idx FROM v")
def fitted_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A white-space tokenizer's vocabulary, in order of first occurrence."""
    return tensors.fitted_tokens(table(spark, d, "eval_items"), "item_id", "item_text")


@CORE.query("encoded_items", _WORDS + ", e AS (SELECT item_id, list(idx ORDER BY k) AS a FROM w JOIN v USING (token) WHERE k < 64 GROUP BY item_id) SELECT item_id, array_to_string(list_concat(a, list_transform(range(64 - len(a)), lambda x: 0)), ' ') AS ids, len(a) AS n FROM e")
def encoded_items(spark: SparkSession, d: str) -> DataFrame:
    """Items as 64 token ids."""
    items = table(spark, d, "eval_items")
    e = tensors.encoded_texts(items, "item_id", "item_text", tensors.fitted_tokens(items, "item_id", "item_text"), 64)
    return e.select("item_id", F.array_join("ids", " ").alias("ids"), F.aggregate("attention", F.lit(0), lambda a, x: a + x).alias("n"))


@CORE.query("encoded_items_whole", _WORDS + ", e AS (SELECT item_id, list(idx ORDER BY k) AS a FROM w JOIN v USING (token) GROUP BY item_id), m AS (SELECT greatest(128, max(len(a))) AS m FROM e) SELECT item_id, array_to_string(list_concat(a, list_transform(range(m - len(a)), lambda x: 0)), ' ') AS ids, len(a) AS n FROM e, m")
def encoded_items_whole(spark: SparkSession, d: str) -> DataFrame:
    """Items as token ids without loss: 128 of them, the compile default, or as many as the longest item has."""
    items = table(spark, d, "eval_items")
    vocab = tensors.fitted_tokens(items, "item_id", "item_text")
    e = tensors.encoded_texts(items, "item_id", "item_text", vocab, tensors.longest(items, "item_text", 128))
    return e.select("item_id", F.array_join("ids", " ").alias("ids"), F.aggregate("attention", F.lit(0), lambda a, x: a + x).alias("n"))


@CORE.query("distinct_sources", "WITH e AS (SELECT id, unnest(p) AS s, unnest(range(len(p))) AS k FROM (SELECT DISTINCT ids.capsule_id AS id, provenance_sources AS p FROM capsules)) SELECT s.source_id AS source_id, arg_max(coalesce(s.title, '') || '|' || coalesce(s.license, ''), (id, k)) AS metadata FROM e WHERE s.source_id IS NOT NULL GROUP BY 1")
def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    """One metadata row for each source of the capsules, the last in the order of capsules and places."""
    s = packages.source_metadata(capsules_once(spark, d))
    return s.select("source_id", F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("license", F.lit(""))).alias("metadata"))


@CORE.query("license_counts", "SELECT coalesce(license, 'unknown') AS license, count(DISTINCT document_id) AS n FROM source_documents GROUP BY 1")
def license_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents by licence."""
    return table(spark, d, "source_documents").groupBy(F.coalesce("license", F.lit("unknown")).alias("license")).agg(F.count_distinct("document_id").alias("n"))


@CORE.query("license_status", """SELECT source_id, CASE WHEN bool_or(lower(coalesce(license, 'unknown')) IN ('restricted', 'proprietary')) THEN 'restricted' WHEN NOT bool_or(lower(coalesce(license, 'unknown')) = 'unknown') THEN 'known' ELSE 'unknown' END AS status FROM source_documents WHERE source_id IS NOT NULL GROUP BY source_id""")
def license_status(spark: SparkSession, d: str) -> DataFrame:
    """What the licences of a source's documents come to."""
    lic = F.lower(F.coalesce("license", F.lit("unknown")))
    g = table(spark, d, "source_documents").filter("source_id is not null").groupBy("source_id").agg(F.bool_or(lic.isin("restricted", "proprietary")).alias("r"), F.bool_or(lic == "unknown").alias("u"))
    return g.select("source_id", F.when(F.col("r"), "restricted").when(~F.col("u"), "known").otherwise("unknown").alias("status"))


@CORE.query("document_cutoff", "SELECT CASE WHEN published_at > TIMESTAMP '2024-06-01' THEN 'post_cutoff_source_excluded' ELSE 'kept' END AS outcome, count(*) AS n FROM (SELECT DISTINCT document_id, published_at FROM source_documents) GROUP BY 1")
def document_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Documents kept and set aside at a cutoff; undated ones are kept."""
    docs = table(spark, d, "source_documents").select("document_id", "published_at").distinct()
    return docs.groupBy(F.when(F.col("published_at") > F.lit("2024-06-01").cast("timestamp"), "post_cutoff_source_excluded").otherwise("kept").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@CORE.query("source_registry", f"""SELECT DISTINCT document_id, source_id, license, raw_sha256 AS raw_hash, normalized_text_sha256 AS normalized_hash, CASE WHEN ends_with(source_path, '.md') THEN 'markdown' WHEN ends_with(source_path, '.txt') THEN 'text' ELSE 'other' END AS source_type, 'ref_' || {sql.digest('source_id', 'document_id')} AS registry_id FROM source_documents""")
def source_registry(spark: SparkSession, d: str) -> DataFrame:
    """Registry rows of the source documents."""
    kind = F.when(F.endswith("source_path", F.lit(".md")), "markdown").when(F.endswith("source_path", F.lit(".txt")), "text").otherwise("other")
    return table(spark, d, "source_documents").select("document_id", "source_id", "license", F.col("raw_sha256").alias("raw_hash"), F.col("normalized_text_sha256").alias("normalized_hash"), kind.alias("source_type"), t.stable_id("ref", "source_id", "document_id").alias("registry_id")).distinct()
