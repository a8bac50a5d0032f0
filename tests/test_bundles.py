"""Bundles, artifact hashes and PDF sources."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claimloom.sources import bundles, pdf


def test_bundles(spark, tmp_path, rows):
    a = spark.createDataFrame([("x", [1, 2], None), ("y", None, 0.5)], "id string, v array<int>, w double")
    b = spark.range(5).toDF("k")
    path = str(tmp_path / "bundle")
    bundles.write_bundle({"a": (a, "id"), "b": (b, "k")}, path)
    with pytest.raises(FileExistsError):
        bundles.write_bundle({"a": (a, "id")}, path)
    opened = bundles.open_bundle(spark, path)
    assert set(opened) == {"a", "b"} and rows(opened["a"]) == rows(a) and opened["a"].schema == a.schema
    assert bundles.validate_bundle(spark, path, ("a", "b")).count() == 0
    assert rows(bundles.validate_bundle(spark, path, ("a", "c"))) == [("missing_table", "c"), ("unexpected_table", "b")]
    b.withColumn("k", F.col("k") + 1).write.mode("overwrite").parquet(f"{path}/tables/b")
    a.limit(1).write.mode("overwrite").parquet(f"{path}/tables/a")
    assert rows(bundles.validate_bundle(spark, path)) == [("changed_content", "b"), ("changed_row_count", "a")]
    assert rows(bundles.validate_bundle(spark, str(tmp_path / "no")), "issue") == [("missing_manifest",)]
    bundles.write_bundle({"a": (a.filter("false"), "id")}, path, force=True, form="json")
    assert bundles.open_bundle(spark, path, "json")["a"].count() == 0 and bundles.validate_bundle(spark, path, form="json").count() == 0
    assert rows(bundles.table_counts({"a": a, "b": b})) == [("a", 2), ("b", 5)]


def test_hashes_of_a_run(spark, tmp_path, rows):
    for n, x in (("a.json", "1"), ("w.pt", "2"), ("sub/b.txt", "3")):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(x)
    h = bundles.reproducibility_hashes(spark, str(tmp_path))
    assert rows(h, "file") == [("a.json",), ("sub/b.txt",)]
    one = bundles.folder_hash(h)
    assert one == bundles.folder_hash(h.repartition(3))
    (tmp_path / "a.json").write_text("9")
    assert one != bundles.folder_hash(bundles.reproducibility_hashes(spark, str(tmp_path)))
    ids = {bundles.run_id("h", ["a", "b"], 13), bundles.run_id("h", ["b", "a"], 13), bundles.run_id("h", ["a", "b"], 14)}
    assert len(ids) == 3 and all(len(i) == len("falsification_") + 16 for i in ids)


def test_pdf(spark, tmp_path, rows):
    for n in ("good_one", "broken", "blank"):
        (tmp_path / f"{n}.pdf").write_bytes(n.encode())
    (tmp_path / "good_one.meta.json").write_text('{"license": "CC0"}')

    def pages(content):
        if content == b"broken":
            raise ValueError("no")
        return ["", ValueError("page")] if content == b"blank" else ["first  page", "", "second"]

    docs, warnings = pdf.read_pdf_documents(spark, str(tmp_path), enabled=True, pages=pages)
    assert rows(docs, "title", "text", "page_number", "license", "media_type") == [("good one p. 1", "first page", 1, "CC0", "application/pdf"), ("good one p. 3", "second", 3, "CC0", "application/pdf")]
    assert len({r["document_id"] for r in docs.collect()}) == 2
    assert rows(warnings, "code") == [("pdf_no_extractable_text",), ("pdf_page_empty",), ("pdf_page_empty",), ("pdf_page_extract_failed",), ("pdf_reader_failed",)]
    docs, warnings = pdf.read_pdf_documents(spark, str(tmp_path))
    assert docs.count() == 0 and rows(warnings, "code") == [("pdf_reader_disabled",)] * 3
    with pytest.raises(pdf.ReaderUnavailable):
        pdf.read_pdf_documents(spark, str(tmp_path), required=True)
