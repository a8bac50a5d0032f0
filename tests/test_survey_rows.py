from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from claimloom.operators import graphs, metrics, providers, records, similarity
from claimloom.plans import capsule_queries
from claimloom.sources import packages

from .test_operators import _print
from .test_substrate_queries import _relation


def test_same_topic_unrelated(spark, rows):
    words = [f"w{i}" for i in range(12)]
    data = [(f"f{i:02d}", " ".join(words[(i * k) % 12] for k in range(1, 7)) + (" supports" if i % 4 == 0 else ""), [["a"], ["b"], ["a", "b"], None, []][i % 5]) for i in range(24)]
    data += [("f90", "supports m1 m2", ["a"]), ("f91", "m1 n1 n2 n3 n4", ["a"]), ("f92", "other words", ["a"])]  # f90 to f91: typed by evidence, overlap 1/7
    df = spark.createDataFrame(data, "family_id string, text string, domains array<string>")
    want, typed = [], []
    for (a, x, d), (b, y, e) in itertools.combinations(data, 2):
        s, g = set(_print(x).split()), set(_print(y).split())
        if set(d or ()) & set(e or ()) and len(s & g) / len(s | g) < 0.18:
            (typed if _relation(x, y) else want).append((a, b))
    assert ("f90", "f91") in typed and ("f90", "f92") in want
    assert rows(similarity.same_topic_unrelated(df), "source", "target") == want[:200]
    assert rows(similarity.same_topic_unrelated(df, 3), "source", "target") == want[:3]


def test_rows_of_the_survey(spark, rows):
    caps = spark.createDataFrame([(("c1", "f1"),), (("c2", "f2"),), (("c3", None),)], "ids struct<capsule_id:string,claim_family_id:string>")
    neg = spark.createDataFrame([("f1", "p2", 0.2), ("f1", "p1", None), ("f9", "p3", 0.1), (None, "p4", 0.1)], "source_family_id string, pool_id string, score double")
    assert {r["ids"]["capsule_id"]: [tuple(n) for n in r["negatives"]] for r in records.with_negatives(caps, neg).collect()} == {"c1": [("p1", None), ("p2", 0.2)], "c2": [], "c3": []}
    tasks = spark.createDataFrame([("f1", "selected_primary"), ("f1", "selected_escalation"), ("f1", "single_provider"), ("f2", None)], "f string, d string")
    assert rows(records.disagreements(tasks, "f", "d")) == [("f1", 2), ("f2", 0)]
    m = spark.createDataFrame([("A", 10, 5, 3, 7, 9), ("B", 10, None, 0, None, None)], "arm_id string, total int, trainable int, final_step int, records_seen int, tokens_seen int")
    assert rows(metrics.budgets(m)) == [("A", 10, 5, 3, 7, 9, 7, 0.0, 60.0, "local_runtime"), ("B", 10, 0, 0, 0, 0, 0, 0.0, 20.0, "local_runtime")]
    s = spark.createDataFrame([(metrics.GEOMETRY_ARM, 0.75), ("D_structured_native_no_geometry", 0.5), ("H_structured_native_context_shuffle", None)], "arm_id string, structured_epistemic_score double")
    assert rows(metrics.control_effects(s)) == [(0.25, 0.75, 0.75)]
    assert rows(metrics.control_effects(s.filter("false"))) == [(0.0, 0.0, 0.0)]


def test_whole_items_are_encoded(spark, tmp_path):
    sizes = {"a": 1, "b": 65, "c": 98, "d": 130}
    spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(n))) for k, n in sizes.items()], "item_id string, item_text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    got = {r["item_id"]: (r["n"], len(r["ids"].split())) for r in capsule_queries.encoded_items_whole(spark, str(tmp_path)).collect()}
    assert got == {k: (n, 130) for k, n in sizes.items()}


def test_record_graph(spark, rows):
    c = spark.createDataFrame([(("c1", "f1", None, "x1"), ["s1", "s2", "s1", None]), (("c2", None, "t2", "x1"), ["s3"]), ((None, "f", "t", "x"), None)], "ids struct<capsule_id:string,claim_family_id:string,claim_state_id:string,context_id:string>, m array<string>")
    assert rows(graphs.star_edges(c)) == [("c1", "claim_context", "c1", "x1"), ("c1", "claim_family", "c1", "f1"), ("c2", "claim_context", "c2", "x1"), ("c2", "claim_state", "c2", "t2")]
    assert rows(graphs.incidence(c.select("ids.capsule_id", "m"), "capsule_id", "m")) == [("c1", "s1", 0), ("c1", "s2", 1)]
    loops = spark.createDataFrame([(0, i) for i in range(9, -1, -1)] + [(1, 5)], "batch int, k int")
    assert rows(graphs.loops_of_batches(loops, "batch", ["k"], 3)) == [(0, 0), (0, 1), (0, 2), (1, 5)] and graphs.loops_of_batches(loops.filter("false"), "batch", ["k"]).count() == 0


def test_fairness_flags(spark, rows):
    b = spark.createDataFrame([("a", 100, None), ("b", 104, None)], "arm string, p long, q long")
    assert rows(metrics.fairness_flags(b, {"p": 0.05, "q": 0.0})) == [("p", 0.04, 0.05, True), ("q", 0.0, 0.0, True)]
    assert rows(metrics.fairness_flags(b, {"p": 0.01}), "fair") == [(False,)] and rows(metrics.fairness_flags(b.filter("false"), {"p": 0.0}), "fair") == [(True,)]


def test_cascade(spark, rows):
    p = spark.createDataFrame([("1", "x", 0.9, 1, False, "a"), ("2", "x", 0.5, 1, False, "a"), ("3", "x", None, 1, True, "causal_claim"), ("4", "x", 0.1, 1, False, "a")], "k string, output string, confidence double, n_keys int, w boolean, y string")
    s = spark.createDataFrame([("1", "y", 1.0, 1), ("2", "y", 0.8, 1), ("3", "x", 0.2, 1)], "k string, output string, confidence double, n_keys int")
    got = providers.cascade(p, s, "k", "w", "y").withColumn("n", F.size("reasons"))
    assert rows(got, "k", "decision", "output", "n") == [("1", "single_provider", "x", 0), ("2", "selected_escalation", "y", 1), ("3", "provider_outputs_equivalent", "x", 2), ("4", "single_provider", "x", 1)]


def test_metadata_of_packages(spark, rows):
    c = spark.createDataFrame([(("c1", "x"), (["a"], None), [("s", "old"), ("s", "new")]), (("c2", "x"), (["b"], None), [("r", "one"), (None, "no")]), (("c3", None), None, None)], "ids struct<capsule_id:string,context_id:string>, context struct<domains:array<string>,communities:array<string>>, provenance_sources array<struct<source_id:string,title:string>>")
    assert rows(packages.source_metadata(c)) == [("r", "one"), ("s", "new")]
    assert [tuple(r) for r in packages.context_metadata(c).collect()] == [("x", ["b"], None)]
