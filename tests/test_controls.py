"""Control arms, their audits, transforms, feature groups and public records on small cases."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from claimloom.operators import adapter, audits, controls, metrics, tensors

SCHEMA = """ids struct<capsule_id:string,claim_family_id:string,claim_state_id:string,context_id:string>, claim struct<canonical_text:string,claim_type:string,language:string,family_label:string>,
temporal struct<valid_as_of:timestamp>, context struct<domains:array<string>,communities:array<string>>, provenance_sources array<struct<source_id:string,title:string,source_date:timestamp,license:string,target_only:boolean>>, extraction_confidence double, arm int"""


def at(year):
    return dt.datetime(year, 1, 1)


def capsules(spark):
    rows = []
    for i, (year, sources) in enumerate([(2020, ["s1", "s2"]), (2022, []), (2024, ["s3"]), (None, None), (2021, ["s1"])]):
        src = None if sources is None else [(s, f"T {s}", at(2023), None, None) for s in sources]
        rows.append(((f"c{i}", f"f{i // 2}", None, f"x{i}"), (f"text {i} " if i else None, "t", "en", None), (year and at(year),), ([f"d{i}"], None) if i != 1 else None, src, 0.5 if i else None, 0))
    return spark.createDataFrame(rows, SCHEMA)


def related(spark):
    claims = spark.createDataFrame([("k1", "text 1"), ("k2", " text 2 "), ("k3", "text 3"), ("k9", "elsewhere"), (None, "text 1"), ("k1", "text 1")], "claim_id string, text string")
    relations = spark.createDataFrame([("r1", "k1", "k2", " Supports", 0.5), ("r2", "k1", "k9", None, None), ("r3", "k9", "k1", "supports", 0.1), ("r1", "k1", "k2", " Supports", 0.5), (None, "k1", "k2", "x", 0.1), ("r4", "k3", None, "extends", 0.2)], "relation_id string, source_claim string, target_claim string, relation_type string, confidence double")
    return controls.with_relations(capsules(spark), claims, relations)


def test_relations_of_capsules(spark):
    got = {r["ids"]["capsule_id"]: [tuple(x) for x in r["relations"]] for r in related(spark).collect()}
    f0 = [("r1", "f1", "supports", 0.5), ("r2", None, None, None)]
    assert got == {"c0": f0, "c1": f0, "c2": [("r4", None, "extends", 0.2)], "c3": [("r4", None, "extends", 0.2)], "c4": []}


def test_arms(spark):
    c = related(spark)
    got = {}
    for r in controls.arms(c).collect():
        got.setdefault(r["arm"], {})[r["ids"]["capsule_id"]] = r
    base = {r["ids"]["capsule_id"]: r for r in c.collect()}
    assert set(got) == set(controls.ARMS) and all(set(x) == set(base) for a, x in got.items() if a != "temporal_holdout")
    assert set(got["temporal_holdout"]) == {"c1", "c2", "c3"}  # after 2021, the lower median of 2020, 2021, 2022, 2024, or without a time
    assert all(r["relations"] == [] for a in ("capsule_no_relations", "relation_ablation", "popularity_frequency_control") for r in got[a].values())
    assert all(r["provenance_sources"] is None for r in got["capsule_no_provenance"].values()) and all(r["context"] is None and r["ids"]["context_id"] is None for r in got["capsule_no_context"].values())
    shuffled = got["context_shuffle"]
    assert sorted(r["ids"]["context_id"] for r in shuffled.values()) == [f"x{i}" for i in range(5)] and any(shuffled[k]["ids"]["context_id"] != base[k]["ids"]["context_id"] for k in base)
    assert all((r["context"] and r["context"]["domains"][0][1:]) == (r["ids"]["context_id"][1:] if r["ids"]["context_id"] != "x1" else None) for r in shuffled.values())  # whole contexts move
    moved = got["provenance_shuffle"]
    assert all(len(moved[k]["provenance_sources"] or []) == len(base[k]["provenance_sources"] or []) for k in base)
    flat = lambda x: sorted(s["source_id"] for r in x.values() for s in r["provenance_sources"] or [])
    assert flat(moved) == flat(base)
    other = controls.arms(c, seed=14).filter("arm = 'context_shuffle'")
    assert {r["ids"]["capsule_id"]: r["ids"]["context_id"] for r in other.collect()} != {k: r["ids"]["context_id"] for k, r in shuffled.items()}
    assert controls.arms(c.filter("false")).count() == 0


def test_rendered_arms(spark):
    got = {(r["arm"], r["capsule_id"]): r for r in controls.rendered(controls.arms(related(spark))).collect()}
    assert got["capsule_text", "c2"]["text"] == "Claim: text 2 \nType: t\nRelations: extends -> ?\nSources: T s3\nContext: x2\nDomains: d2"
    assert got["capsule_no_relations", "c2"]["text"] == "Claim: text 2 \nType: t\nSources: T s3\nContext: x2\nDomains: d2"
    assert got["popularity_frequency_control", "c2"]["text"] == "text 2\nSource count proxy: 1\nClaim-family frequency proxy: 2" and got["flat_text", "c0"]["text"] == ""
    assert got["capsule_no_side_channels", "c2"]["side_channels"] is None and got["capsule_text", "c2"]["side_channels"] == [0.0, 0.45, 0.1, 1.0, 0.65, 1.0, 1.0, 0.0]
    assert got["relation_ablation", "c2"]["side_channels"][5] == 0.0


def test_arm_audits(spark):
    arms = controls.arms(related(spark))
    found = controls.arm_findings(arms, {"claim.canonical_text": "error"})
    n = {(r["arm"], r["audit"]): r["n"] for r in found.groupBy("arm", "audit").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n["capsule_text", "temporal_leakage"] == 3 and ("capsule_no_provenance", "temporal_leakage") not in n and n["capsule_no_context", "context_integrity"] == 5 and n["capsule_text", "context_integrity"] == 1
    assert n["capsule_text", "relation_integrity"] == 2 + 2 + 1 + 1 and ("relation_ablation", "relation_integrity") not in n
    assert {r["record_id"] for r in found.collect()} <= {f"c{i}" for i in range(5)}
    with pytest.raises(audits.AuditError):
        controls.arm_findings(arms, {"claim.canonical_text": "error"}, strict=True)
    clean = arms.filter("ids.capsule_id = 'c3' and arm = 'flat_text'")
    assert controls.arm_findings(clean, {}, strict=True).filter("severity = 'error'").count() == 0


def test_control_transforms(spark):
    rows = spark.createDataFrame([(i, {"v": i}, {"p": i}, {"s": i}, {"relation_count": 2.0, "weight": 3.0}, i) for i in range(5)], "id int, lateral_context map<string,int>, provider_context map<string,int>, provenance map<string,int>, relations map<string,double>, target int")
    run = lambda x: {r["id"]: r for r in controls.transformed(rows, x, "id", batch=3).collect()}
    assert [run("context_shuffle")[i]["lateral_context"]["v"] for i in range(5)] == [1, 2, 0, 4, 3] and [run("provider_shuffle")[i]["provider_context"]["p"] for i in range(5)] == [1, 2, 0, 4, 3]
    assert run("no_provenance")[1]["provenance"] == {} == run("no_relations")[1]["relations"] == run("no_context")[1]["lateral_context"]
    assert run("popularity_frequency_control")[1]["relations"] == {"relation_count": 0.0, "weight": 3.0}
    assert run("none") == run("geometry_off") == {r["id"]: r for r in rows.collect()} and all(run(x)[i]["target"] == i for x in controls.TRANSFORMS for i in range(5))
    with pytest.raises(ValueError):
        controls.transformed(rows, "other", "id")


def test_text_mode(spark):
    df = spark.createDataFrame([([1], [1], [9], [9]), (None, None, [9], [9])], "flat_text_input_ids array<int>, flat_text_attention_mask array<int>, text_input_ids array<int>, text_loss_mask array<int>")
    a, b = sorted(controls.with_text_mode(df, "flat_text").collect(), key=lambda r: r["text_input_ids"])
    assert a["text_input_ids"] == a["text_labels"] == a["text_projection_targets"] == [1] == a["text_loss_mask"] and b["text_input_ids"] == [9]
    with pytest.raises(ValueError):
        controls.with_text_mode(df, "other")


def test_feature_groups(spark):
    c = related(spark)
    vocab = tensors.vocabulary(tensors.relation_values(c))
    families = spark.createDataFrame([("f1", 0), ("f0", 1)], "family string, index long")
    got = {r["capsule_id"]: r for r in tensors.relation_group(c, vocab, families).collect()}
    assert got["c0"]["relation_types"] == [3, 1] and got["c0"]["relation_targets"] == [0, -1] and got["c0"]["relation_confidences"] == [0.5, -1.0]
    assert [got[f"c{i}"]["start_offset"] for i in range(5)] == [0, 2, 4, 5, 6] and [got[f"c{i}"]["mask"] for i in range(5)] == [1, 1, 1, 1, 0]
    t = {r["capsule_id"]: r for r in tensors.target_group(c, spark.createDataFrame([("s1", 0), ("s3", 1)], "source_id string, index long")).collect()}
    assert t["c0"]["provenance_target_ids"] == [0, -1] and t["c3"]["provenance_target_ids"] == [] and t["c0"]["uncertainty_target"] == -1.0 and t["c4"]["start_offset"] == 3
    g = tensors.geometry_group(c, F.create_map(F.lit("holonomy_norm"), F.lit(2.0))).first()
    assert g["holonomy_norm"] == 2.0 and g["curvature_score"] == -1.0 and g["geometry_enabled"] == 1
    e = tensors.epistemic_group(spark.createDataFrame([("c", 0.5), ("d", None)], "capsule_id string, u double"), {"u": F.lit("m")}).orderBy("capsule_id").collect()
    assert e[0]["u_value"] == 0.5 and e[0]["u_confidence"] == -1.0 and e[0]["u_basis"] > 0 and tuple(e[1]) == ("d", -1.0, -1.0, -1)


def test_public_records(spark):
    df = spark.createDataFrame(
        [("cap", "claim", "A Text.", "t", "en", None, ["x y", "z"], None, at(2024), at(2025), [("d1", "s0", "T", None, at(2023), None), ("d2", "s2", None, None, at(2022), None), ("d1", "s1", "T", None, at(2023), None)], [("p1", "d1", "A", 0, 1, None), ("p2", "d9", "B", None, None, None)], [("r", "other", "supports", 0.5)], (0.5, 0.4, 0.1, 0.3, 2.0), 0.9), ("bad", "c", None, "t", "en", None, None, None, at(2024), None, None, None, None, None, None)],
        "capsule_id string, claim_id string, canonical_text string, claim_type string, language string, scope string, domains array<string>, communities array<string>, valid_as_of timestamp, created_at timestamp, provenance array<struct<document_id:string,source_id:string,title:string,uri:string,source_date:timestamp,license:string>>, "
        "spans array<struct<span_id:string,document_id:string,text:string,start_char:int,end_char:int,source_date:timestamp>>, relations array<struct<relation_id:string,target_claim_id:string,relation_type:string,confidence:double>>, proxies struct<ontic_compatibility:double,evidential_anchoring:double,transformation_pressure:double,uncertainty:double,redundancy_effective_n:double>, extraction_confidence double",
    )
    h = lambda *p, n=24: hashlib.sha256("\x1f".join(p).encode()).hexdigest()[:n]
    (r,) = adapter.to_public(df).collect()
    family = f"claimfam:a-text:{h('claim', 'A Text.')}"
    state = f"claimstate:2024-01-01:{h('cap', family)}"
    assert tuple(r["ids"]) == (f"axc:sha256:{h(family, state, 'A Text.', n=64)}", family, state, "ctx:x-y-z")
    assert [s["source_id"] for s in r["provenance"]["sources"]] == [f"src:document:{h('document', x, y)}" for x, y in (("s0", "d1"), ("s2", "d2"), ("s1", "d1"))]
    assert [s["source_id"] for s in r["surface_forms"]["source_spans"]] == [f"src:document:{h('document', 's1', 'd1')}", f"src:document:{h('document', 'd9')}"] and r["surface_forms"]["source_spans"][0]["span_id"] == f"span:{h('p1', 'd1')}"
    assert r["relations"][0]["target_claim_family_id"] == f"claimfam:other:{h('other')}" and r["temporal"]["source_publication_date"] == at(2022) and r["epistemic_state"]["uncertainty"]["value"] == 0.3


def test_scores(spark):
    m = [("A", "relation_prediction_relation_accuracy", 0.5), ("A", "loss_relation_prediction", 0.2), ("A", "loss_provenance_recovery", 0.4), ("A", "stability_temporal_stability_accuracy", 0.6), ("A", "geometry_auxiliary_geometry_observable_loss", 0.3), ("A", "geometry_auxiliary_geometry_regularization", 2.0), ("B", "stability_temporal_temporal_leakage_count", 1.0), (None, "x", 1.0), ("B", "other", None)]
    s = {r["arm_id"]: r for r in metrics.run_scores(spark.createDataFrame(m, "arm_id string, name string, value double")).collect()}
    assert s["A"]["relation_type_accuracy"] == 0.5 and s["A"]["structured_epistemic_score"] == pytest.approx((0.8 + 0.6 + 0.0 + 0.6) / 4) and s["A"]["geometry_evidence_score"] == pytest.approx(0.68) and s["A"]["transport_consistency_score"] == 0.0
    assert s["A"]["audit_compliance_score"] == 1.0 and s["B"]["audit_compliance_score"] == 0.0 and s["B"]["structured_epistemic_score"] == 0.0 and set(s) == {"A", "B"}
    d = spark.createDataFrame([(x,) for x in (-0.3, -0.2, -0.05, -0.01, -0.005, 0.0, 0.005, 0.01)] + [(None,)], "d double")
    assert [r[0] for r in d.select(metrics.delta_outcome(F.col("d"), F.lit(True))).collect()] == ["kill_branch", "kill_branch", "redesign", "redesign", "inconclusive", "inconclusive", "proceed_with_caution", "proceed", "inconclusive"]
    assert d.select(metrics.delta_outcome(F.col("d"), F.lit(False)).alias("x")).distinct().collect()[0][0] == "inconclusive"
    best = {r["score"]: tuple(r)[1:] for r in metrics.best_scores(spark.createDataFrame([("A", 0.2, None), ("B", 0.1, None)], "arm_id string, x double, y double"), ["x", "y"]).collect()}
    assert best == {"x": (0.2, True, True), "y": (0.0, False, False)}
    k = spark.createDataFrame([("single_provider", False), ("selected_primary", True), ("selected_escalation", True)], "d string, e boolean")
    assert tuple(metrics.cascade_counts(k, "d", F.col("e")).first()) == (3, 2, 0.667, 2)
    assert tuple(metrics.cascade_counts(k.filter("false"), "d", F.col("e")).first()) == (0, 0, 0.0, 0)
