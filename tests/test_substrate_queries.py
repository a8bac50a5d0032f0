from __future__ import annotations

import difflib
import itertools
import os
import time

import pytest
from pyspark.sql import functions as F

from claimloom import session
from claimloom.operators import similarity
from claimloom.operators.claims import extract_claims
from claimloom.operators.similarity import RELATION_RULES
from claimloom.plans import graph_queries, substrate, substrate_queries

from .conftest import DATA
from .test_operators import _print


def _relation(source, target):
    """(type, confidence) of an ordered pair of texts, by the rule itself, or None."""
    fs, ft = _print(source), _print(target)
    s, g = set(fs.split()), set(ft.split())
    jaccard, evidence = len(s & g) / max(1, len(s | g)), len(s & g) / max(1, len(g))
    if evidence < 0.2 and jaccard < 0.18:
        return None
    for cues, name, c in RELATION_RULES:
        if any(q in source.lower() for q in cues):
            return name, c
    if jaccard >= 0.28 or 0.7 * jaccard + 0.3 * difflib.SequenceMatcher(None, fs, ft).ratio() >= 0.44:
        return "related", round(min(0.46, 0.28 + jaccard), 3)
    return None


def test_built_capsules_keep_relations(spark):
    families = {r["family_id"]: r["canonical_claim_text"] for r in substrate_queries.built_families(spark, DATA).collect()}
    want = {(a, b, *r) for a, b in itertools.permutations(families, 2) if (r := _relation(families[a], families[b]))}
    text = {t: f for f, t in families.items()}
    got = [(text[c["canonical_text"]], r["target_family_id"], r["relation_type"], round(r["confidence"], 3)) for c in substrate_queries.built_capsules(spark, DATA).collect() for r in c["relations"]]
    assert len(got) == len(set(got)) and want == set(got) and want


def test_pools_of_all_families(spark, rows):
    families = {r["family_id"]: (r["canonical_claim_text"], r["first_seen"]) for r in substrate_queries.built_families(spark, DATA).collect()}
    pairs = list(itertools.permutations(sorted(families), 2))
    related = {(a, b): r for a, b in pairs if (r := _relation(families[a][0], families[b][0]))}
    got = rows(graph_queries.relation_candidates_edit(spark, DATA))
    assert {(a, b, k, round(c, 3)) for a, b, k, c in got} == {(*p, *r) for p, r in related.items()} and len(got) == len(related)
    prints = {f: _print(x) for f, (x, _) in families.items()}
    jac = {(a, b): len(x & y) / len(x | y) for a, b in pairs for x, y in [(set(prints[a].split()), set(prints[b].split()))]}
    assert rows(graph_queries.family_hard_negatives(spark, DATA), "source", "target") == [p for p in pairs if 0.18 <= jac[p] <= 0.55 and p not in related][:200]
    alike = [(a, b) for a, b in pairs if a < b and 0.42 <= 0.7 * jac[a, b] + 0.3 * difflib.SequenceMatcher(None, prints[a], prints[b]).ratio() < 0.72]
    assert rows(graph_queries.near_but_distinct(spark, DATA), "a", "b") == alike[:200]
    seen = {f: at for f, (_, at) in families.items()}
    assert rows(graph_queries.family_temporal_distractors(spark, DATA)) == [(a, b) for a, b in pairs if seen[a] and seen[b] and seen[b] > seen[a]][:200]


def test_hard_negatives_have_no_relation(spark, rows, tmp_path):
    base = "alpha beta gamma delta epsilon zeta eta theta".split()
    texts = {"a": " ".join(base), "b": " ".join(base[:3] + ["one", "two", "three", "four", "five"]), "c": "supports " + " ".join(base[:3] + ["six", "seven", "eight", "nine"]), "d": " ".join(base[:3] + ["ten", "x1", "x2", "x3", "x4"])}
    texts["e"] = " ".join(base[:3] + base[4:5] + ["eleven", "twelve", "epsilom", "zeto", "etaa", "thetb"])  # alike by edit
    spark.createDataFrame([(k, x, None, "s") for k, x in texts.items()], "item_id string, item_text string, released_at timestamp, split_name string").write.parquet(str(tmp_path / "eval_items.parquet"))
    want = []
    for a, b in itertools.permutations(sorted(texts), 2):
        x, y = (set(_print(texts[k]).split()) for k in (a, b))
        if 0.18 <= len(x & y) / len(x | y) <= 0.55 and not _relation(texts[a], texts[b]):
            want.append((a, b))
    kinds = {r[0] for a, b in itertools.permutations(texts, 2) if (r := _relation(texts[a], texts[b]))}
    assert "supports" in kinds and "related" in kinds
    got = rows(graph_queries.hard_negatives(spark, str(tmp_path)), "source", "target")
    assert got == want and want


def test_families_leave_only_themselves_on_disk(spark):
    """No shuffle file outlives the scratch table it was made for, and of the scratch tables only the families stay."""
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle_")}

    before = shuffled()
    session.scratch(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    root = session._root(spark).removeprefix("file:")
    tables = set(os.listdir(root))
    families = substrate_queries.built_families(spark, DATA)
    assert [x.split("-")[0] for x in set(os.listdir(root)) - tables] == ["families"] and families.count()


@pytest.mark.parametrize("query", [graph_queries.near_but_distinct, graph_queries.family_temporal_distractors])
def test_pools_keep_no_claims_on_disk(spark, query):
    session.scratch(spark.range(1)).count()
    root = session._root(spark).removeprefix("file:")
    tables = set(os.listdir(root))
    assert query(spark, DATA).count() and {x.split("-")[0] for x in set(os.listdir(root)) - tables} <= {"families", "blocks", "block", "pairs"}


@pytest.mark.parametrize("query", [graph_queries.near_but_distinct, graph_queries.family_temporal_distractors])
def test_families_are_written_when_claims_are_gone(spark, monkeypatch, query):
    """Texts, claims, positions and places are off the disk before the families' own shuffle begins."""
    session.scratch(spark.range(1)).count()
    root = session._root(spark).removeprefix("file:")
    before, there = set(os.listdir(root)), []

    def written(df, name="t"):
        if name == "families":
            there.extend(x.split("-")[0] for x in set(os.listdir(root)) - before)
        return session.scratch(df, name)

    monkeypatch.setattr(substrate, "scratch", written)
    assert query(spark, DATA).count() and there and set(there) <= {"members", "of_documents", "dates"}


def test_families_shuffle_texts_once(spark, tmp_path):
    """Of long texts no more is shuffled than each once: not for the documents' dates, nor with their claims."""
    def shuffled():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}

    noise = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.sha2(F.concat("document_id", i.cast("string")), 256)), "")
    session.table(spark, DATA, "source_documents").withColumn("text", F.concat("text", F.lit("\n\n"), noise)).write.parquet(str(tmp_path / "source_documents.parquet"))
    texts, before = session.table(spark, str(tmp_path), "source_documents").agg(F.sum(F.length("text"))).first()[0], shuffled()
    assert substrate_queries.built_families(spark, str(tmp_path)).count() and sum(n for k, n in shuffled().items() if k not in before) < 1.5 * texts


def test_temporal_pool_writes_no_texts(spark, tmp_path, monkeypatch):
    """No table that is written on the way has a text of documents or claims, and texts are shuffled a share at a time."""
    def shuffled():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}

    noise = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.sha2(F.concat("document_id", i.cast("string")), 256)), "")
    session.table(spark, DATA, "source_documents").withColumn("text", F.concat("text", F.lit("\n\n"), noise)).write.parquet(str(tmp_path / "source_documents.parquet"))
    texts, before, columns = session.table(spark, str(tmp_path), "source_documents").agg(F.sum(F.length("text"))).first()[0], shuffled(), set()

    def written(df, name="t"):
        columns.update(df.columns)
        return session.scratch(df, name)

    monkeypatch.setattr(substrate, "scratch", written)
    monkeypatch.setattr(similarity, "scratch", written)
    assert graph_queries.family_temporal_distractors(spark, str(tmp_path)).count()
    assert columns and not columns & {"text", "canonical_claim_text", "normalized_text"}
    assert max(n for k, n in shuffled().items() if k not in before) < 0.7 * texts


def test_first_seen_of_families(spark):
    """The families and their first_seen are those of build_families: with repeated documents, equal claims in several, ties, and no dates."""
    heat, cold, same = "Heat causes a loss of tension in long copper wires.", "Cold causes a loss of colour in old maple leaves.", "heat CAUSES a loss of tension in long copper wires!"
    near = "Heat causes a loss of tension in long copper tubes."
    docs = [
        ("a", f"{heat} {cold}", 2, "2021-05-01"), ("a", f"{heat} {heat}", 1, "2022-05-01"), ("a", f"{heat} {heat}", 1, "2023-05-01"), ("b", f"{same}\n\n{near}", 1, "2021-01-01"), ("c", cold, 1, None), ("d", "", 1, "2020-01-01"),
        (None, heat, 1, "1999-01-01"), ("e", None, 1, "1999-01-01"), ("f", f"# Head\n\n{cold}\n{near}", 1, "1677-01-01"), ("g", cold, 1, "9999-12-31"), ("h", f"{near} {heat}", 1, "2024-01-01"),
    ]
    df = spark.createDataFrame(docs, "document_id string, text string, ingested_at int, seen string").select(
        "document_id", "text", "ingested_at", F.col("seen").cast("timestamp").alias("published_at"), F.lit("known").alias("license"), F.array(F.lit("x")).alias("domains"), F.lit(None).cast("timestamp").alias("temporal_cutoff_at"),
    )
    for frame, extra in ((df, {}), (df.withColumn("published_at", F.col("published_at").cast("timestamp_ntz")), {"cutoff": "2022-01-01", "chunk_chars": 60, "overlap": 9})):
        got, want = (sorted(tuple(r) for r in f.select("family_id", F.col("first_seen").cast("string")).collect()) for f in (substrate.build_first_seen(frame, **extra), substrate.build_families(frame, **extra)))
        assert got == want and {r[1] for r in got} == {"1677-01-01 00:00:00"}
    assert substrate.build_first_seen(df.limit(0)).count() == 0


def test_claims_of_a_chunk_count_once(spark):
    text = "Heat causes a loss of tension in wires. Cold causes a loss of colour in leaves. HEAT causes a loss of tension in wires."
    chunks = spark.createDataFrame([("d", "c1", text, 5), ("d", "c2", text, 300), ("e", "c3", None, 0)], "document_id string, chunk_id string, text string, start_char int")
    all_ = extract_claims(chunks, "document_id", "chunk_id", "text", "start_char")
    for start in ("start_char", None):
        got = extract_claims(chunks, "document_id", "chunk_id", "text", start, once=True)
        assert got.count() == 4 and {r["claim_id"] for r in got.collect()} == {r["claim_id"] for r in all_.collect()} and all_.count() == 6
        assert sorted((r["chunk_id"], r["sentence_index"], r["text"][:4]) for r in got.collect()) == [("c1", 0, "Heat"), ("c1", 1, "Cold"), ("c2", 0, "Heat"), ("c2", 1, "Cold")]
