from __future__ import annotations

import json
import shutil

import pytest
from pyspark.sql import functions as F

from claimloom.operators import audits
from claimloom.plans.substrate import build_substrate
from claimloom.sources import files, packages
from claimloom.streaming import claims as stream

from .conftest import DATA


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "docs"
    (d / "sub").mkdir(parents=True)
    (d / "a_note.md").write_text("# Title\r\n\r\nThe  enzyme causes a strong decay of the sample here.\n")
    (d / "a_note.meta.json").write_text(json.dumps({"title": "Note A", "authors": ["X", " "], "publication_date": "2024-01-15", "domain": ["physics"], "license": "CC0"}))
    (d / "sub" / "b_two.txt").write_text("ﬁne text")
    (d / "empty.txt").write_text("  \n")
    (d / "bad.txt").write_bytes(b"\xff\xfe\xff")
    (d / "x.pdf").write_bytes(b"%PDF")
    (d / "lines.jsonl").write_text('{"text": "one", "title": "T1", "license": null}\n{broken\n\n{"text": 5}\n{"text": "two"}\n')
    (d / "lines.meta.json").write_text(json.dumps({"license": "MIT", "temporal_cutoff": "2026-01-01"}))
    return str(d)


def test_read_documents(spark, folder):
    docs, warnings = files.read_documents(spark, folder)
    got = {r["title"]: r for r in docs.collect()}
    assert set(got) == {"Note A", "b two", "T1", "lines 5"}
    a = got["Note A"]
    assert a["text"] == "# Title\n\nThe enzyme causes a strong decay of the sample here." and a["authors"] == ["X"] and a["published_at"].year == 2024 and a["media_type"] == "text/markdown"
    assert got["b two"]["text"] == "fine text" and got["b two"]["license"] == "unknown"
    assert got["T1"]["license"] == "unknown" and got["lines 5"]["license"] == "MIT" and got["T1"]["temporal_cutoff_at"].year == 2026
    assert sorted(r["code"] for r in warnings.collect()) == ["empty_source", "invalid_jsonl_source_record", "invalid_jsonl_source_record", "invalid_utf8", "pdf_reader_unavailable"]
    assert files.file_hashes(spark, folder).count() == 8


def test_split_files_and_markdown(spark, tmp_path, rows):
    d = tmp_path / "s"
    d.mkdir()
    (d / "train.json").write_text('["a", "b"]')
    (d / "test.json").write_text('{"capsule_ids": ["c"]}')
    (d / "more.json").write_text('{"ids": ["f"]}')
    (d / "hold.jsonl").write_text('"d"\n{"capsule_id": "e"}\n')
    (d / "val.txt").write_text("g\n\n h \n")
    assert rows(files.read_split_ids(spark, str(d))) == sorted([("train", "a"), ("train", "b"), ("test", "c"), ("more", "f"), ("hold", "d"), ("hold", "e"), ("val", "g"), ("val", "h")], key=str)
    m = tmp_path / "r.md"
    m.write_text("# R\n| field_name | type |\n| --- | --- |\n| `a` | x |\n\n## Claim Types\n\n- `one`\n- `two` more\n## Other\n- `three`\n")
    assert [r["cells"] for r in files.markdown_table(spark, str(m), "field_name").collect()] == [["a", "x"]]
    assert rows(files.markdown_list(spark, str(m))) == [("Claim Types", "one"), ("Claim Types", "two"), ("Other", "three")]


def test_packages(spark, tmp_path, rows):
    caps = spark.read.parquet(f"{DATA}/capsules.parquet").dropDuplicates()
    members = spark.read.parquet(f"{DATA}/split_members.parquet").join(caps.select(F.col("ids.capsule_id").alias("capsule_id")), "capsule_id", "left_semi")
    path = str(tmp_path / "p")
    manifest = packages.write_package(caps, members, path)
    assert manifest["n_capsules"] == caps.count()
    back = packages.read_stream(spark, f"{path}/data/capsules", caps.schema)
    assert packages.content_hash(back.withColumn("_id", F.col("ids.capsule_id")), "_id") == manifest["content_hash"]
    assert packages.validate_package(spark, path, caps.schema).count() == 0
    target = next((tmp_path / "p" / "data" / "sources").glob("part-*"))
    target.write_text(target.read_text() + "\n")
    for crc in (tmp_path / "p" / "data" / "sources").glob(".*.crc"):
        crc.unlink()
    assert [r["issue"] for r in packages.validate_package(spark, path, caps.schema).collect()] == ["changed_file"]
    shutil.rmtree(tmp_path / "p" / "data" / "sources")
    assert {r["issue"] for r in packages.validate_package(spark, path, caps.schema).collect()} == {"missing_file"}
    with pytest.raises(Exception):
        packages.write_package(caps, members, path)


def test_hash_compare_and_upsert(spark, rows):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "file string, sha256 string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "4")], "file string, sha256 string")
    assert rows(packages.compare_hashes(a, b)) == [("w", "added"), ("y", "changed"), ("z", "removed")]
    assert rows(packages.upsert(a, b, "file")) == [("w", "4"), ("x", "1"), ("y", "9"), ("z", "3")]


def test_canonical_json(spark):
    df = spark.createDataFrame([(1, ("z", None, [("q", 2)]))], "b int, a struct<y:string,x:string,l:array<struct<n:string,m:int>>>")
    assert df.select(packages.canonical_json(df)).first()[0] == '{"a":{"l":[{"m":2,"n":"q"}],"y":"z"},"b":1}'


def test_forbidden_keys(spark, rows):
    df = spark.createDataFrame([("1", '{"a": [{"Is_True": 1}]}'), ("2", "{broken"), ("3", None), ("4", '{"ok": 1}')], "id string, p string")
    assert rows(audits.forbidden_keys(df, "id", "p"), "record_id", "path", "value") == [("1", "$.a[0].Is_True", "Is_True")]


def test_streaming_equals_batch(spark, tmp_path, rows):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    shutil.copy(f"{DATA}/documents.parquet", src / "one.parquet")
    s = stream.claim_stream(stream.read_documents(spark, str(src)))
    stream.write_claims(s, out, ck).awaitTermination(120)
    first = spark.read.parquet(out).count()
    assert first > 0
    stream.write_claims(stream.claim_stream(stream.read_documents(spark, str(src))), out, ck).awaitTermination(120)
    assert spark.read.parquet(out).count() == first  # nothing twice
    batch = stream.claim_stream(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert rows(spark.read.parquet(out), "claim_id") == rows(batch, "claim_id")
    log = stream.upsert_log(stream.read_documents(spark, str(src)).select("doc_id"), str(tmp_path / "log"), str(tmp_path / "ck2"))
    log.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "log")).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_substrate(spark):
    docs = spark.read.parquet(f"{DATA}/source_documents.parquet")
    s = build_substrate(docs, cutoff="2024-01-01")
    n_late = docs.filter("published_at > timestamp'2024-01-01'").select("document_id").distinct().count()
    assert s.warnings.count() == n_late and s.documents.filter("published_at > timestamp'2024-01-01'").count() == 0
    caps = s.capsules
    assert caps.count() == s.families.count() > 0
    assert caps.filter("size(provenance_sources) = 0").count() == 0
    assert s.families.agg(F.sum("evidence_count")).first()[0] == s.claims.count()
    assert s.relations.filter("source = target").count() == 0
