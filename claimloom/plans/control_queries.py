"""Queries on control arms, their audits, control transforms, feature groups, public records and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import adapter, controls, metrics, providers, tensors
from claimloom.operators.ordering import first_occurrence_index
from claimloom.plans import fragments as sql
from claimloom.plans.capsule_queries import REQUIRED, capsules_once
from claimloom.registry import CORE
from claimloom.session import table


def related_capsules(spark: SparkSession, d: str) -> DataFrame:
    """Capsules with the relations of the claims whose text they have."""
    return controls.with_relations(capsules_once(spark, d), table(spark, d, "extracted_claims"), table(spark, d, "extracted_relations"))


BASE = """WITH c0 AS (SELECT DISTINCT * FROM capsules), fam AS (SELECT trim(claim.canonical_text) AS t, max(ids.claim_family_id) AS f FROM c0 WHERE claim.canonical_text IS NOT NULL GROUP BY 1),
oc AS (SELECT claim_id, max(f) AS f FROM extracted_claims JOIN fam ON trim(text) = t WHERE claim_id IS NOT NULL GROUP BY 1),
one AS (SELECT DISTINCT relation_id, source_claim, target_claim, trim(lower(relation_type)) AS relation_type, confidence FROM extracted_relations),
rel AS (SELECT s.f AS sf, one.relation_id, t.f AS tf, relation_type, confidence FROM one JOIN oc s ON s.claim_id = source_claim LEFT JOIN oc t ON t.claim_id = target_claim),
g AS (SELECT sf, list({'id': relation_id, 'f': tf, 'y': relation_type, 'c': confidence} ORDER BY relation_id) AS r FROM rel GROUP BY 1),
c AS (SELECT ids.capsule_id AS id, ids.claim_family_id AS fam, ids.context_id AS ctx, claim.canonical_text AS text, claim.claim_type AS kind, temporal.valid_as_of AS ts, context AS context, provenance_sources AS src, coalesce(r, []) AS rel FROM c0 LEFT JOIN g ON sf = ids.claim_family_id),
slots AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS slot FROM c),
ctxm AS (SELECT ctx AS mctx, context AS mcontext, row_number() OVER (ORDER BY sha256(concat_ws(':', '13', slot::VARCHAR, coalesce(ctx, ''))), slot) - 1 AS slot FROM slots),
se AS (SELECT *, row_number() OVER (ORDER BY id, k) - 1 AS slot FROM (SELECT id, unnest(src) AS s, unnest(range(len(src))) AS k FROM c)),
sm AS (SELECT s AS ms, row_number() OVER (ORDER BY sha256(concat_ws(':', '13', slot::VARCHAR, coalesce(s.source_id, ''))), slot) - 1 AS slot FROM se),
sn AS (SELECT id, list(ms ORDER BY k) AS msrc FROM se JOIN sm USING (slot) GROUP BY id),
cut AS (SELECT ts AS cutoff FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS p, count(*) OVER () AS n FROM c WHERE ts IS NOT NULL) WHERE p = greatest(0, n // 2 - 1)),
freq AS (SELECT fam, count(*) AS n FROM c GROUP BY 1)
"""
_ALL = "id, fam, ctx, text, kind, ts, context, src, rel"


def _arm(name: str, source: str = "c", where: str = "", **changed: str) -> str:
    cols = ", ".join(f"{changed[x]} AS {x}" if x in changed else f"{source.split()[0]}.{x}" for x in _ALL.split(", "))
    return f"SELECT '{name}' AS arm, {cols} FROM {source}{where}"


_NONE = {"ctx": "NULL::VARCHAR", "context": "NULL"}
ARMS_SQL = BASE + ", arms AS (" + "\nUNION ALL ".join([
    *[_arm(a) for a in ("flat_text", "structured_text", "capsule_text", "capsule_no_side_channels")], _arm("capsule_no_provenance", src="NULL"), _arm("capsule_no_relations", rel="[]"), _arm("relation_ablation", rel="[]"),
    _arm("capsule_no_context", **_NONE), _arm("popularity_frequency_control", rel="[]", **_NONE), _arm("temporal_holdout", where=", cut WHERE c.ts > cutoff OR c.ts IS NULL"),
    _arm("context_shuffle", "slots JOIN ctxm USING (slot)", ctx="mctx", context="mcontext"), _arm("provenance_shuffle", "c LEFT JOIN sn USING (id)", src="coalesce(msrc, c.src)"),
]).replace("c.id AS id", "c.id") + ")\n"
_line = lambda label, v: f"CASE WHEN coalesce({v}, '') <> '' THEN '{label}: ' || {v} END"
_CLAIM, _CTX = _line("Claim", "text"), _line("Context", "ctx") + ", " + _line("Domains", "array_to_string(context.domains, ', ')")
_SOURCES = _line("Sources", "array_to_string(list_filter(list_transform(coalesce(src, []), lambda x: x.title), lambda x: coalesce(x, '') <> ''), '; ')")
_LINKS = _line("Relations", "array_to_string(list_transform(rel, lambda x: coalesce(x.y, '?') || ' -> ' || coalesce(x.f, '?')), '; ')")
_TEXT = f"""CASE arm WHEN 'flat_text' THEN trim(coalesce(text, '')) WHEN 'structured_text' THEN concat_ws(chr(10), {_CLAIM}, {_CTX}, {_SOURCES})
 WHEN 'popularity_frequency_control' THEN concat_ws(chr(10), trim(coalesce(text, '')), 'Source count proxy: ' || coalesce(len(src), 0), 'Claim-family frequency proxy: ' || coalesce(n, 0))
 ELSE concat_ws(chr(10), {_CLAIM}, {_line('Type', 'kind')}, {_LINKS}, {_SOURCES}, {_CTX}) END"""
_S, _R = "coalesce(len(src), 0)::DOUBLE", "len(rel)::DOUBLE"
_SIDE = f"CASE WHEN arm <> 'capsule_no_side_channels' THEN [0.0, round(least(0.85, 0.35 + 0.1 * {_S}), 3), round(least(0.6, {_R} / 10.0), 3), {_S}, round(greatest(0.2, least(0.9, 0.7 - 0.05 * {_S})), 3), {_R}, {_S}, 0.0]::DOUBLE[] END"


@CORE.query("control_arms", ARMS_SQL + f"SELECT arm, id AS capsule_id, {_TEXT} AS text, {_SIDE} AS side_channels FROM arms LEFT JOIN freq ON freq.fam IS NOT DISTINCT FROM arms.fam")
def control_arms(spark: SparkSession, d: str) -> DataFrame:
    """Every capsule in all twelve arms: text and side channels."""
    return controls.rendered(controls.arms(related_capsules(spark, d)))


_REQ = {"claim.canonical_text": "text", "claim.claim_type": "kind", "temporal.valid_as_of": "ts", "ids.claim_family_id": "fam"}
_FOUND = ARMS_SQL + ", texts AS (SELECT arm, " + _TEXT + """ AS t FROM arms LEFT JOIN freq ON freq.fam IS NOT DISTINCT FROM arms.fam), s AS (SELECT arm, ts, unnest(src) AS s FROM arms), r AS (SELECT arm, unnest(rel) AS r FROM arms), f AS (
""" + "\nUNION ALL ".join([
    *[f"SELECT arm, 'required_fields' AS audit, '{REQUIRED[p]}' AS severity FROM arms WHERE trim(coalesce({x}::VARCHAR, '')) = ''" for p, x in _REQ.items()],
    "SELECT arm, 'temporal_leakage', 'error' FROM s WHERE s.source_date > ts AND NOT coalesce(s.target_only, false)",
    *[f"SELECT arm, 'provenance_integrity', '{v}' FROM s WHERE s.{x} IS NULL" for x, v in (("source_id", "error"), ("title", "warning"), ("source_date", "warning"))],
    "SELECT arm, 'provenance_integrity', 'warning' FROM arms WHERE coalesce(len(src), 0) = 0", "SELECT arm, 'context_integrity', 'warning' FROM arms WHERE coalesce(len(context.domains), 0) = 0",
    *[f"SELECT arm, 'relation_integrity', 'warning' FROM r WHERE r.{x} IS NULL" for x in ("f", "y")],
    "SELECT arm, 'future_target_exposure', 'error' FROM (SELECT arm, t, unnest(['future_summary', 'future_label', 'target_timestamp', 'target_only', 'ground_truth', 'answer_key']) AS m FROM texts) WHERE contains(lower(t), m)",
]) + ")\n"


@CORE.query("arm_audits", _FOUND + "SELECT arm, audit, severity, count(*) AS n FROM f GROUP BY ALL")
def arm_audits(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the audit suite in each arm."""
    fields = {p: REQUIRED[p] for p in _REQ}
    return controls.arm_findings(controls.arms(related_capsules(spark, d)), fields).groupBy("arm", "audit", "severity").agg(F.count(F.lit(1)).alias("n"))


@CORE.query("capsule_relations", BASE + "SELECT id AS capsule_id, unnest(rel).id AS relation_id, unnest(rel).f AS target_family, unnest(rel).y AS relation_type FROM c")
def capsule_relations(spark: SparkSession, d: str) -> DataFrame:
    """The relations of each capsule with the family they lead to."""
    return related_capsules(spark, d).select("ids.capsule_id", F.explode("relations").alias("r")).select("capsule_id", "r.relation_id", "r.target_family", "r.relation_type")


_B = """b AS (SELECT id, coalesce(len(src), 0)::DOUBLE AS s, len(rel)::DOUBLE AS r, coalesce(len(context.domains), 0)::DOUBLE AS dm, n::DOUBLE AS n, (row_number() OVER (ORDER BY id) - 1) // 32 AS batch FROM c JOIN freq ON freq.fam IS NOT DISTINCT FROM c.fam),
m AS (SELECT *, coalesce(lead(dm) OVER w, first_value(dm) OVER w) AS dm1, coalesce(lead(s) OVER w, first_value(s) OVER w) AS s1 FROM b WINDOW w AS (PARTITION BY batch ORDER BY id))
"""


@CORE.query("control_transforms", BASE + ", " + _B + """SELECT t AS transform, id AS capsule_id, CASE t WHEN 'context_shuffle' THEN dm1 WHEN 'no_context' THEN NULL ELSE dm END AS n_domains, CASE t WHEN 'provenance_shuffle' THEN s1 WHEN 'no_provenance' THEN NULL ELSE s END AS n_sources,
CASE t WHEN 'no_relations' THEN NULL WHEN 'popularity_frequency_control' THEN 0 ELSE r END AS relation_count, CASE t WHEN 'popularity_frequency_control' THEN 0 ELSE n END AS family_frequency FROM m, (SELECT unnest([""" + sql.quoted(controls.TRANSFORMS) + "]) AS t)")
def control_transforms(spark: SparkSession, d: str) -> DataFrame:
    """Capsules' feature groups under each control transform of an experiment."""
    c = related_capsules(spark, d)
    freq = c.groupBy(F.col("ids.claim_family_id").alias("_f")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    size = lambda x: F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)).cast("double")
    one = lambda k, v: F.create_map(F.lit(k), v)
    groups = c.join(freq, F.col("ids.claim_family_id").eqNullSafe(F.col("_f"))).select(
        F.col("ids.capsule_id").alias("capsule_id"), one("n_domains", size("context.domains")).alias("lateral_context"), one("n_sources", size("provenance_sources")).alias("provenance"),
        one("relation_count", size("relations")).alias("relations"), one("family_frequency", F.col("_n")).alias("epistemic_state"),
    )
    of = lambda g, k: F.try_element_at(g, F.lit(k)).alias(k)
    parts = [controls.transformed(groups, x, "capsule_id").select(F.lit(x).alias("transform"), "capsule_id", of("lateral_context", "n_domains"), of("provenance", "n_sources"), of("relations", "relation_count"), of("epistemic_state", "family_frequency")) for x in controls.TRANSFORMS]
    return reduce(DataFrame.unionByName, parts)


@CORE.query("relation_group", BASE + """, v AS (SELECT y, row_number() OVER (ORDER BY y) + 1 AS idx FROM (SELECT DISTINCT unnest(rel).y AS y FROM c) WHERE trim(coalesce(y, '')) <> ''), i AS (SELECT fam, row_number() OVER (ORDER BY m, fam) - 1 AS ix FROM (SELECT fam, min(id) AS m FROM c WHERE fam IS NOT NULL GROUP BY 1)),
e AS (SELECT id, unnest(rel) AS r, unnest(range(len(rel))) AS k FROM c), q AS (SELECT id, list(coalesce(v.idx, 1) ORDER BY k) AS tys, list(coalesce(i.ix, -1) ORDER BY k) AS gs FROM e LEFT JOIN v ON v.y = r.y LEFT JOIN i ON i.fam = r.f GROUP BY id)
SELECT c.id AS capsule_id, coalesce(tys, []) AS relation_types, coalesce(gs, []) AS relation_targets, len(rel) AS n, row_number() OVER (ORDER BY c.id) - 1 AS record_index, coalesce(sum(len(rel)) OVER (ORDER BY c.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset, (len(rel) > 0)::INT AS mask FROM c LEFT JOIN q USING (id)""")
def relation_group(spark: SparkSession, d: str) -> DataFrame:
    """Relations of capsules as a ragged group."""
    c = related_capsules(spark, d)
    families = first_occurrence_index(c.select(F.col("ids.claim_family_id").alias("family"), F.col("ids.capsule_id").alias("o")), "family", "o")
    return tensors.relation_group(c, tensors.vocabulary(tensors.relation_values(c)), families).drop("relation_confidences")


_METHOD = "step01-proxy"


@CORE.query("epistemic_group", BASE + f""", p AS (SELECT id, round(least(0.85, 0.35 + 0.1 * {_S}), 3) AS a, round(greatest(0.2, least(0.9, 0.7 - 0.05 * {_S})), 3) AS u, round(least(0.6, {_R} / 10.0), 3) AS p FROM c), h AS (SELECT ('0x' || substr(sha256('proxy_basis' || chr(31) || '{_METHOD}'), 1, 15))::BIGINT AS b)
SELECT id AS capsule_id, a AS evidential_anchoring_value, -1.0::DOUBLE AS evidential_anchoring_confidence, b AS evidential_anchoring_basis, u AS uncertainty_value, -1.0::DOUBLE AS uncertainty_confidence, b AS uncertainty_basis, p AS transformation_pressure_value, -1.0::DOUBLE AS transformation_pressure_confidence, b AS transformation_pressure_basis FROM p, h""")
def epistemic_group(spark: SparkSession, d: str) -> DataFrame:
    """Proxies of capsules with confidence and basis."""
    names = ("evidential_anchoring", "uncertainty", "transformation_pressure")
    p = providers.epistemic_proxies(controls.n_sources(), controls.n_relations(), F.lit(0))
    rows = related_capsules(spark, d).select("ids.capsule_id", *[p[n].alias(n) for n in names])
    return tensors.epistemic_group(rows, {n: F.lit(_METHOD) for n in names})


@CORE.query("target_group", BASE + """, e AS (SELECT id, unnest(src).source_id AS s, unnest(range(len(src))) AS k FROM c), i AS (SELECT s, row_number() OVER (ORDER BY m, s) - 1 AS ix FROM (SELECT s, min(id) AS m FROM e WHERE s IS NOT NULL GROUP BY 1)), q AS (SELECT id, list(coalesce(ix, -1) ORDER BY k) AS t FROM e LEFT JOIN i USING (s) GROUP BY id)
SELECT c.id AS capsule_id, coalesce(t, []) AS provenance_target_ids, coalesce(len(src), 0) AS n, row_number() OVER (ORDER BY c.id) - 1 AS record_index, coalesce(sum(coalesce(len(src), 0)) OVER (ORDER BY c.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset,
round(coalesce(1 - x.extraction_confidence, -1), 6) AS uncertainty_target FROM c LEFT JOIN q USING (id) JOIN c0 x ON x.ids.capsule_id = c.id""")
def target_group(spark: SparkSession, d: str) -> DataFrame:
    """Sources to recover and the uncertainty to predict."""
    c = capsules_once(spark, d)
    sources = c.select(F.explode("provenance_sources.source_id").alias("source_id"), F.col("ids.capsule_id").alias("o"))
    return tensors.target_group(c, first_occurrence_index(sources, "source_id", "o")).withColumn("uncertainty_target", F.round("uncertainty_target", 6))


@CORE.query("metadata_group", f"SELECT ids.capsule_id AS capsule_id, row_number() OVER (ORDER BY ids.capsule_id) - 1 AS record_index, 0 AS source_format_idx, ('0x' || {sql.digest('ids.capsule_id', 'claim.canonical_text', length=15)})::BIGINT AS input_record_hash, 300 AS evaluation_reference_count FROM (SELECT DISTINCT ids, claim FROM capsules)")
def metadata_group(spark: SparkSession, d: str) -> DataFrame:
    """Positions and references of records."""
    record = F.concat_ws("\x1f", "ids.capsule_id", "claim.canonical_text")
    return tensors.metadata_group(capsules_once(spark, d), record, table(spark, d, "eval_items").select("item_id").distinct().count())


@CORE.query("geometry_group", "SELECT DISTINCT ids.capsule_id AS capsule_id, 0 AS geometry_enabled, " + ", ".join(f"-1.0::DOUBLE AS {n}" for n in tensors.GEOMETRY_SLOTS) + " FROM capsules")
def geometry_group(spark: SparkSession, d: str) -> DataFrame:
    """Geometry slots of capsules, which have none."""
    return tensors.geometry_group(capsules_once(spark, d))


def _internal(spark: SparkSession, d: str) -> DataFrame:
    """Capsules in the internal shape: sources as provenance, spans by capsule, relations by claim family."""
    spans = table(spark, d, "source_spans").filter("span_id is not null and capsule_id is not null").groupBy("span_id", "capsule_id").agg(F.min(F.struct(F.col("source_id").alias("document_id"), "text", "start_char", "end_char", "source_date")).alias("s"))
    spans = spans.groupBy("capsule_id").agg(F.array_sort(F.collect_list(F.struct("span_id", "s.document_id", "s.text", "s.start_char", "s.end_char", "s.source_date"))).alias("spans"))  # of one capsule
    c = related_capsules(spark, d)
    p = providers.epistemic_proxies(controls.n_sources(), controls.n_relations(), F.lit(0))
    own = c.select(
        F.col("ids.capsule_id").alias("capsule_id"), F.col("ids.claim_family_id").alias("claim_id"), "claim.canonical_text", "claim.claim_type", "claim.language", F.col("claim.family_label").alias("scope"), "context.domains", "context.communities", "temporal.valid_as_of", F.col("temporal.constructed_at").alias("created_at"),
        F.transform("provenance_sources", lambda s: F.struct(s["source_id"].alias("document_id"), s["source_id"].alias("source_id"), s["title"].alias("title"), F.lit(None).cast("string").alias("uri"), s["source_date"].alias("source_date"), s["license"].alias("license"))).alias("provenance"),
        F.transform(F.filter("relations", lambda r: r["target_family"].isNotNull()), lambda r: F.struct(r["relation_id"].alias("relation_id"), r["target_family"].alias("target_claim_id"), r["relation_type"].alias("relation_type"), r["confidence"].alias("confidence"))).alias("relations"),
        F.struct(F.lit(0.5).alias("ontic_compatibility"), p["evidential_anchoring"].alias("evidential_anchoring"), p["transformation_pressure"].alias("transformation_pressure"), p["uncertainty"].alias("uncertainty"), p["independent_redundancy"].alias("redundancy_effective_n")).alias("proxies"),
        "extraction_confidence",
    )
    return own.join(spans, "capsule_id", "left")


def _slug(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace({sql.fold(x)}, '[^a-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), ''), 'unknown')"


def _src(*parts: str) -> str:
    return f"'src:document:' || {sql.digest(chr(39) + 'document' + chr(39), *parts)}"


@CORE.query("public_records", BASE + f""", u AS (SELECT c.*, y.temporal.constructed_at AS made, 'claimfam:' || {_slug(f"substr({_slug('c.text')}, 1, 48)")} || ':' || {sql.digest('c.fam', 'c.text')} AS pf FROM c JOIN c0 y ON y.ids.capsule_id = c.id WHERE c.text IS NOT NULL AND c.ts IS NOT NULL),
w AS (SELECT *, 'claimstate:' || strftime(ts, '%Y-%m-%d') || ':' || {sql.digest('id', 'pf')} AS ps FROM u),
sp AS (SELECT capsule_id, span_id, any_value(source_id) AS s FROM source_spans WHERE span_id IS NOT NULL AND capsule_id IS NOT NULL GROUP BY 1, 2),
sl AS (SELECT capsule_id, list({{'a': 'span:' || {sql.digest('span_id', 's')}, 'b': {_src('coalesce(s, NULL)', 's')}}} ORDER BY span_id) AS spans, list(s ORDER BY span_id) AS docs FROM sp GROUP BY 1)
SELECT 'axc:sha256:' || {sql.digest('pf', 'ps', 'w.text', length=64)} AS capsule_id, pf AS claim_family_id, ps AS claim_state_id, 'ctx:' || {_slug("coalesce(nullif(array_to_string(context.domains, ','), ''), 'unknown')")} AS context_id,
list_transform(coalesce(src, []), lambda x: {_src('x.source_id', 'x.source_id')}) AS source_ids, list_min(list_transform(coalesce(src, []), lambda x: x.source_date)) AS source_publication_date, list_transform(coalesce(spans, []), lambda x: x.a) AS span_ids,
list_transform(range(1, len(coalesce(docs, [])) + 1), lambda i: CASE WHEN list_contains(list_transform(coalesce(src, []), lambda x: x.source_id), docs[i]) THEN {_src('docs[i]', 'docs[i]')} ELSE {_src('docs[i]')} END) AS span_sources,
list_transform(list_filter(rel, lambda x: x.f IS NOT NULL), lambda x: 'rel:' || {sql.digest('x.id', 'x.f')}) AS relation_ids, list_transform(list_filter(rel, lambda x: x.f IS NOT NULL), lambda x: 'claimfam:' || {_slug('x.f')} || ':' || {sql.digest('x.f')}) AS relation_targets
FROM w LEFT JOIN sl ON sl.capsule_id = w.id""")
def public_records(spark: SparkSession, d: str) -> DataFrame:
    """Capsules as public records: the identifiers of every part."""
    r = adapter.to_public(_internal(spark, d))
    return r.select(
        "ids.*", F.col("provenance.sources.source_id").alias("source_ids"), F.col("temporal.source_publication_date").alias("source_publication_date"), F.col("surface_forms.source_spans.span_id").alias("span_ids"), F.col("surface_forms.source_spans.source_id").alias("span_sources"),
        F.col("relations.relation_id").alias("relation_ids"), F.col("relations.target_claim_family_id").alias("relation_targets"),
    )


_LONG = "WITH m AS (SELECT event_type AS arm_id, unnest([" + sql.quoted(tuple(sorted({*metrics.SCORES.values()}))) + "]) AS name, unnest(range(" + str(len({*metrics.SCORES.values()})) + ")) AS k, v FROM (SELECT event_type, avg(value) / 1000 AS v FROM events GROUP BY 1)), w AS (SELECT arm_id, name, v * (k % 5 + 1) AS x FROM m)\n"


def _run_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Exported metrics in long form, an arm for each type of event."""
    names = F.array(*[F.lit(n) for n in sorted({*metrics.SCORES.values()})])
    v = table(spark, d, "events").groupBy(F.col("event_type").alias("arm_id")).agg((F.avg("value") / 1000).alias("v"))
    return v.select("arm_id", "v", F.posexplode(names).alias("k", "name")).select("arm_id", "name", (F.col("v") * (F.col("k") % 5 + 1)).alias("value"))


_PIVOT = "p AS (SELECT arm_id, " + ", ".join(f"max(x) FILTER (name = '{n}') AS {s}" for s, n in metrics.SCORES.items()) + " FROM w GROUP BY 1)\n"


@CORE.query("run_scores", _LONG + ", " + _PIVOT + """SELECT arm_id, round(relation_type_accuracy, 6) AS relation_type_accuracy, round(provenance_mrr, 6) AS provenance_mrr, round(expected_calibration_error, 6) AS expected_calibration_error, round(temporal_stability_prediction, 6) AS temporal_stability_prediction,
round(temporal_stability_prediction / 4, 6) AS structured_epistemic_score, 1.0::DOUBLE AS geometry_evidence_score, round(greatest(0, token_accuracy + 1 / greatest(exp(least(text_cross_entropy, 20)), 1)), 6) AS text_projection_score, CASE WHEN temporal_leakage_count = 0 AND future_target_mask_violation_count = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS audit_compliance_score FROM p""")
def run_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every arm of a run."""
    s = metrics.run_scores(_run_metrics(spark, d))
    six = lambda c: F.round(c, 6).alias(c)
    return s.select("arm_id", six("relation_type_accuracy"), six("provenance_mrr"), six("expected_calibration_error"), six("temporal_stability_prediction"), six("structured_epistemic_score"), six("geometry_evidence_score"), six("text_projection_score"), "audit_compliance_score")


@CORE.query("delta_outcomes", _LONG + ", " + _PIVOT + """, d AS (SELECT x.arm_id AS left_arm, y.arm_id AS right_arm, round((y.token_accuracy - x.token_accuracy) * 20, 6) AS delta FROM p x JOIN p y ON x.arm_id <> y.arm_id)
SELECT left_arm, right_arm, CASE WHEN delta <= -0.2 THEN 'kill_branch' WHEN delta >= 0.01 THEN 'proceed' WHEN delta > 0 THEN 'proceed_with_caution' WHEN delta > -0.01 THEN 'inconclusive' ELSE 'redesign' END AS outcome FROM d""")
def delta_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What the difference between every two arms says; there are a few arms."""
    s = metrics.run_scores(_run_metrics(spark, d)).select("arm_id", "token_accuracy")
    l, r = s.toDF("left_arm", "l"), s.toDF("right_arm", "r")
    return l.join(r, F.col("left_arm") != F.col("right_arm")).select("left_arm", "right_arm", metrics.delta_outcome(F.round((F.col("r") - F.col("l")) * 20, 6), F.lit(True)).alias("outcome"))


@CORE.query("best_scores", _LONG + ", " + _PIVOT + "SELECT s AS score, round(b, 6) AS best, b > 0 AS present, b >= 0.01 AS viable FROM (SELECT unnest(['token_accuracy', 'provenance_mrr']) AS s, unnest([max(token_accuracy), max(provenance_mrr)]) AS b FROM p)")
def best_scores(spark: SparkSession, d: str) -> DataFrame:
    """The best of two scores over all arms."""
    return metrics.best_scores(metrics.run_scores(_run_metrics(spark, d)), ["token_accuracy", "provenance_mrr"]).withColumn("best", F.round("best", 6))
