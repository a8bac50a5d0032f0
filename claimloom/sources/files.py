"""Source files to documents: plain text, Markdown and JSON lines with metadata beside them.

Files are read as binary, so a row is a file; nothing fails in a task: what
can't be read becomes a warning row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text as t

READER_VERSION = "0.1.0"
SIDECAR = "title string, authors array<string>, publication_date date, license string, source_url string, domain array<string>, temporal_cutoff date"
_RECORD = "text string, title string, authors array<string>, publication_date date, license string, source_url string, domain array<string>"


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, content, file_name, stem, suffix of the files under a folder, or of one file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    name = F.element_at(F.split("path", "/"), -1)
    return reader.load(path).select("path", "content").withColumn("file_name", name).withColumns({"stem": F.regexp_replace("file_name", r"\.[^.]*$", ""), "suffix": F.lower(F.regexp_extract("file_name", r"(\.[^.]*)$", 1))})


def media_type(suffix: Column | str) -> Column:
    s = F.col(suffix) if isinstance(suffix, str) else suffix
    return F.when(s == ".txt", "text/plain").when(s.isin(".md", ".markdown"), "text/markdown").when(s == ".jsonl", "application/x-ndjson").when(s == ".pdf", "application/pdf").otherwise("application/octet-stream")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of every file."""
    return binary_files(spark, path).select("path", F.sha2("content", 256).alias("sha256"))


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """base (the path without its suffix) and meta, the metadata of x.meta.json; blank items of lists are left out."""
    files = binary_files(spark, path, "*.meta.json")
    meta = F.from_json(F.col("content").cast("string"), SIDECAR)
    clean = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    return files.select(F.regexp_replace("path", r"\.meta\.json$", "").alias("base"), meta.alias("meta")).withColumn("meta", F.col("meta").withField("authors", clean(F.col("meta.authors"))).withField("domain", clean(F.col("meta.domain"))))


def _document(rows: DataFrame) -> DataFrame:
    """The document row from path, record_key, raw, text, title, meta, reader_name, file_name, suffix."""
    text_hash = F.sha2("text", 256)
    midnight = lambda c: F.col(c).cast("timestamp")
    return rows.select(
        t.stable_id("doc", "record_key", text_hash).alias("document_id"), t.stable_id("src", "record_key", F.sha2("raw", 256)).alias("source_id"), F.col("path").alias("source_path"), "file_name",
        media_type("suffix").alias("media_type"), F.sha2("raw", 256).alias("raw_sha256"), text_hash.alias("normalized_text_sha256"), "text", F.length("text").alias("text_length"), "title",
        F.coalesce("meta.authors", F.array().cast("array<string>")).alias("authors"), midnight("meta.publication_date").alias("published_at"), F.coalesce("meta.license", F.lit("unknown")).alias("license"),
        F.col("meta.source_url").alias("source_url"), F.coalesce("meta.domain", F.array().cast("array<string>")).alias("domains"), midnight("meta.temporal_cutoff").alias("temporal_cutoff_at"),
        (F.col("page_number") if "page_number" in rows.columns else F.lit(None).cast("int")).alias("page_number"), "reader_name", F.lit(READER_VERSION).alias("reader_version"),
    )


def document_rows(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Document rows of rows(path, record_key, raw, text, title, reader_name, file_name, suffix, and page_number if any) with the metadata of the sidecar of their name, whose title goes before theirs."""
    own = rows.withColumn("base", F.regexp_replace("path", r"\.[^./]*$", "")).join(meta, "base", "left")
    return _document(own.withColumn("title", F.coalesce("meta.title", "title")))


def _warning(rows: DataFrame, code: str, message: Column) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), message.alias("message"), "path")


def read_documents(spark: SparkSession, path: str, unicode_form: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, warnings) of the files under path.

    .txt, .md and .markdown are one document each, .jsonl one for each line
    with a string `text`. Bytes that aren't UTF-8, blank texts, broken lines
    and other suffixes give a warning. A document's metadata is that of the
    sidecar with its name, a JSON record's own fields go before it where the
    record has the key. Hidden sidecar files themselves are no sources.
    """
    return documents_from(binary_files(spark, path).filter(~F.endswith("file_name", F.lit(".meta.json"))), sidecars(spark, path), unicode_form)


def documents_from(files: DataFrame, meta: DataFrame, unicode_form: bool = True) -> tuple[DataFrame, DataFrame]:
    """read_documents of files(path, content, file_name, stem, suffix) that are rows already, with their metadata(base, meta)."""
    joined = files.withColumn("base", F.regexp_replace("path", r"\.[^./]*$", "")).join(meta, "base", "left")
    decoded = joined.withColumn("raw_text", F.try_validate_utf8(F.col("content").cast("string")))
    plain = decoded.filter(F.col("suffix").isin(".txt", ".md", ".markdown"))
    plain = plain.withColumn("text", t.normalize_text("raw_text", unicode_form))
    from_plain = plain.filter("text <> ''").select(
        "path", F.col("path").alias("record_key"), F.col("content").alias("raw"), "text", F.coalesce("meta.title", F.replace("stem", F.lit("_"), F.lit(" "))).alias("title"), "meta",
        F.concat(F.lit("plain-text:"), F.substr("suffix", F.lit(2))).alias("reader_name"), "file_name", "suffix",
    )
    lines = decoded.filter("suffix = '.jsonl'").select("path", "stem", "file_name", "suffix", "meta", F.posexplode(F.split("raw_text", "\n")).alias("i", "line")).filter("trim(line) <> ''")
    variant = F.try_parse_json("line")
    parsed = lines.withColumn("v", variant).withColumn("is_text", F.coalesce(F.schema_of_variant(F.variant_get("v", "$.text", "variant")) == "STRING", F.lit(False)))
    # only those keys of the record that are there count, also with null
    rec = F.from_json("line", _RECORD)
    keys = F.coalesce(F.json_object_keys("line"), F.array().cast("array<string>"))
    pick = lambda k: F.when(F.array_contains("keys", k), F.col(f"rec.{k}")).otherwise(F.col(f"meta.{k}"))
    good = parsed.filter("is_text").withColumns({"rec": rec, "keys": keys}).withColumn("text", t.normalize_text("rec.text", unicode_form)).filter("text <> ''")
    number = F.col("i") + 1
    from_lines = good.select(
        "path", F.concat("path", F.lit("#L"), number).alias("record_key"), F.col("line").cast("binary").alias("raw"), "text",
        F.coalesce(F.nullif("rec.title", F.lit("")), "meta.title", F.concat("stem", F.lit(" "), number)).alias("title"),
        F.struct(pick("title").alias("title"), pick("authors").alias("authors"), pick("publication_date").alias("publication_date"), pick("license").alias("license"), pick("source_url").alias("source_url"), pick("domain").alias("domain"), F.col("meta.temporal_cutoff").alias("temporal_cutoff")).alias("meta"),
        F.lit("jsonl:text-record").alias("reader_name"), "file_name", "suffix",
    )
    warnings = (
        _warning(decoded.filter(F.col("raw_text").isNull()), "invalid_utf8", F.lit("not UTF-8"))
        .unionByName(_warning(plain.filter("text = ''"), "empty_source", F.lit("no text")))
        .unionByName(_warning(parsed.filter("not is_text"), "invalid_jsonl_source_record", F.concat(F.lit("line "), number, F.lit(" is no JSON record with a string text"))))
        .unionByName(_warning(files.filter("suffix = '.pdf'"), "pdf_reader_unavailable", F.lit("no PDF reader")))
        .unionByName(_warning(files.filter(~F.col("suffix").isin(".txt", ".md", ".markdown", ".jsonl", ".pdf")), "unsupported_source", F.lit("no reader for this suffix")))
    )
    return _document(from_plain).unionByName(_document(from_lines)), warnings


def read_split_ids(spark: SparkSession, path: str) -> DataFrame:
    """split (the file's stem) and id of split files: .txt lines, .jsonl strings or records, .json lists or records with capsule_ids or ids."""
    f = binary_files(spark, path).withColumn("body", F.col("content").cast("string"))
    txt = f.filter("suffix = '.txt'").select("stem", F.explode(F.split("body", "\n")).alias("id")).withColumn("id", F.trim("id"))
    jl = f.filter("suffix = '.jsonl'").select("stem", F.explode(F.split("body", "\n")).alias("l")).filter("trim(l) <> ''")
    own = F.coalesce(F.try_variant_get(F.try_parse_json("l"), "$.capsule_id", "string"), F.try_variant_get(F.try_parse_json("l"), "$.id", "string"), F.when(F.startswith(F.trim("l"), F.lit('"')), F.try_variant_get(F.try_parse_json("l"), "$", "string")))
    v = F.try_parse_json("body")
    js = f.filter("suffix = '.json'").select("stem", F.explode(F.coalesce(F.try_variant_get(v, "$.capsule_ids", "array<string>"), F.try_variant_get(v, "$.ids", "array<string>"), F.try_variant_get(v, "$", "array<string>"))).alias("id"))
    every = txt.unionByName(jl.select("stem", own.alias("id"))).unionByName(js)
    return every.filter("id is not null and id <> ''").select(F.col("stem").alias("split"), "id")


def markdown_table(spark: SparkSession, path: str, first_header: str) -> DataFrame:
    """row, cells of a Markdown table whose header begins with first_header; cells without back ticks, in order."""
    lines = binary_files(spark, path).select("path", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("row", "line")).withColumn("line", F.trim("line")).filter("line like '|%|'")
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda c: F.trim(F.replace(c, F.lit("`"), F.lit(""))))
    rows = lines.withColumn("cells", cells)
    return rows.filter((F.col("cells")[0] != first_header) & ~F.startswith(F.col("cells")[0], F.lit("---"))).select("path", "row", "cells")


def markdown_list(spark: SparkSession, path: str) -> DataFrame:
    """heading, value of `- \\`value\\`` items under level-two headings, in order."""
    whole = binary_files(spark, path).select("path", F.explode(F.split(F.col("content").cast("string"), r"(?m)^## ")).alias("section"))
    heading = F.trim(F.regexp_extract("section", r"\A([^\n]*)", 1))
    return whole.select(heading.alias("heading"), F.explode(F.regexp_extract_all("section", F.lit(r"(?m)^\s*- `([^`]*)`"), F.lit(1))).alias("value"))


def tail(df: DataFrame, order: str, n: int, *ties: str) -> DataFrame:
    """The last n rows by order, of equals the first by ties; kept from the first step on, so no task sorts the table."""
    return df.orderBy(F.desc(order), *ties).limit(n)


def first_files(documents: DataFrame, n: int, name: str = "file_name", *ties: str) -> DataFrame:
    """The first n documents by file name, of equals the first by path, then by ties."""
    return documents.orderBy(name, "source_path", *ties).limit(n)
