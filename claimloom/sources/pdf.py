"""PDF files to documents, a page each, where a library for it is there."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text as t
from claimloom.sources.files import binary_files, document_rows, sidecars


class ReaderUnavailable(RuntimeError):
    """PDF files are to be read and cannot be."""


def library_pages() -> Callable[[bytes], list[str | Exception]] | None:
    """A function from a file's bytes to the text of each page, by pypdf; None where that is not installed."""
    try:
        import pypdf
    except ImportError:
        return None

    def pages(content: bytes) -> list[str | Exception]:
        out: list[str | Exception] = []
        for page in pypdf.PdfReader(io.BytesIO(content)).pages:
            try:
                out.append(page.extract_text() or "")
            except Exception as error:  # a broken page is one warning, not a failed task
                out.append(error)
        return out

    return pages


def read_pdf_documents(spark: SparkSession, path: str, enabled: bool = False, required: bool = False, pages: Callable[[bytes], list[str | Exception]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, warnings: code, message, path) of the .pdf files under path, a document for each page with text.

    Unless enabled, or without a library (pages stands in for it), every file
    gives a warning and no document, and if required an error is raised.
    A file that cannot be parsed, a page that fails or is empty, and a file
    without any text give a warning each.
    """
    files = binary_files(spark, path, "*.pdf")
    pages = pages or library_pages()
    if not enabled or pages is None:
        code = "pdf_reader_unavailable" if enabled else "pdf_reader_disabled"
        if required:
            raise ReaderUnavailable(code)
        return document_rows(files.limit(0).select("path", F.lit("").alias("record_key"), F.col("content").alias("raw"), F.lit("").alias("text"), F.lit("").alias("title"), F.lit("").alias("reader_name"), "file_name", "suffix"), sidecars(spark, path)), files.select(F.lit(code).alias("code"), F.lit("no PDF reader").alias("message"), "path")

    def extract(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for where, content in zip(pdf["path"], pdf["content"]):
                try:
                    texts = pages(content)
                except Exception as error:
                    rows.append((where, 0, None, "pdf_reader_failed", str(error)))
                    continue
                rows += [(where, n, None, "pdf_page_extract_failed", str(x)) if isinstance(x, Exception) else (where, n, x, None, None) for n, x in enumerate(texts, 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "raw_text", "code", "message"]).astype({"page": "int32"})

    found = files.select("path", "content").mapInPandas(extract, "path string, page int, raw_text string, code string, message string").withColumn("text", t.normalize_text("raw_text", True))
    good = found.filter("text <> ''")
    own = good.join(files, "path").select(
        "path", F.concat("path", F.lit("#page="), "page").alias("record_key"), F.concat("content", F.encode(F.concat(F.lit("#page="), "page"), "utf-8")).alias("raw"), "text",
        F.concat(F.replace("stem", F.lit("_"), F.lit(" ")), F.lit(" p. "), "page").alias("title"), F.lit("pdf:pypdf").alias("reader_name"), "file_name", "suffix", F.col("page").alias("page_number"),
    )
    broken = found.filter("code is not null").select("code", "message", "path")
    empty = found.filter("text = ''").select(F.lit("pdf_page_empty").alias("code"), F.concat(F.lit("page "), "page").alias("message"), "path")
    without = files.select("path").join(good.select("path").distinct(), "path", "left_anti").join(found.filter("code = 'pdf_reader_failed'").select("path"), "path", "left_anti")
    return document_rows(own, sidecars(spark, path)), broken.unionByName(empty).unionByName(without.select(F.lit("pdf_no_extractable_text").alias("code"), F.lit("no text in any page").alias("message"), "path"))
