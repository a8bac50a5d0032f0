"""Capsule streams and dataset packages: write, read, hash, validate."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.operators.audits import union_all
from claimloom.sources.files import file_hashes


def _rebuilt(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_rebuilt(c[f.name], f.dataType).alias(f.name) for f in sorted(dt.fields, key=lambda f: f.name)]))
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _rebuilt(x, dt.elementType))
    return c


def canonical_json(df: DataFrame) -> Column:
    """Each row as JSON with sorted keys at every depth, nulls left out."""
    return F.to_json(F.struct(*[_rebuilt(F.col(f"`{n}`"), df.schema[n].dataType).alias(n) for n in sorted(df.columns)]))


def write_stream(df: DataFrame, path: str, order: str | None = None) -> None:
    """One canonical JSON record a line; with order the lines are sorted over the whole stream."""
    rows = df.select(canonical_json(df).alias("value"), *([F.col(order).alias("_o")] if order else []))
    if order:
        rows = rows.orderBy("_o").drop("_o")
    rows.write.mode("errorifexists").text(path)


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of a stream; a line that doesn't parse fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def content_hash(df: DataFrame, key: str) -> str:
    """SHA-256 over the rows' hashes in key order: the same for the same rows, however they are stored."""
    hashed = df.select(F.col(key).alias("k"), F.sha2(canonical_json(df), 256).alias("h"))
    # hashes of hashes by prefix, so that no task holds more than its part of them
    parts = hashed.groupBy(F.substring(F.sha2(F.col("k").cast("string"), 256), 1, 3).alias("p")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    row = parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256)).first()  # at most 4,096
    return row[0]


def source_metadata(capsules: DataFrame) -> DataFrame:
    """The distinct sources of the capsules by source_id, of more than one row the last in the order of capsules and places."""
    s = capsules.select(F.col("ids.capsule_id").alias("_c"), F.posexplode("provenance_sources").alias("_k", "_s")).filter("_s.source_id is not null")
    return s.groupBy("_s.source_id").agg(F.max_by("_s", F.struct("_c", "_k")).alias("_s")).select("_s.*")


def context_metadata(capsules: DataFrame) -> DataFrame:
    """context_id, domains, communities of the distinct contexts of the capsules, of more than one row the last in the order of capsules."""
    c = capsules.filter("ids.context_id is not null").select("ids.context_id", F.col("ids.capsule_id").alias("_c"), "context.domains", "context.communities")
    return c.groupBy("context_id").agg(F.max_by(F.struct("domains", "communities"), "_c").alias("_s")).select("context_id", "_s.*")


def write_package(capsules: DataFrame, splits: DataFrame, path: str, relations: DataFrame | None = None) -> dict:
    """A package: data/capsules, data/sources, data/relations, splits, manifests, and a hash of every file.

    Capsules with one row each; splits(split_name, capsule_id). Sources are the
    distinct ones of the capsules, of more than one row the last in order.
    Refuses to write where a package is.
    """
    spark = capsules.sparkSession
    write_stream(capsules, f"{path}/data/capsules")
    sources = source_metadata(capsules)
    write_stream(sources, f"{path}/data/sources", "source_id")
    if relations is not None:
        write_stream(relations, f"{path}/data/relations", "relation_id")
    splits.select("split_name", "capsule_id").distinct().write.partitionBy("split_name").json(f"{path}/splits")
    manifest = {"format": "package", "n_capsules": capsules.count(), "n_sources": sources.count(), "content_hash": content_hash(capsules.withColumn("_id", F.col("ids.capsule_id")), "_id")}
    hashes = _data_hashes(spark, path)
    hashes.write.json(f"{path}/manifests/hashes")
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifests/manifest")
    return manifest


def _data_hashes(spark: SparkSession, path: str) -> DataFrame:
    found = file_hashes(spark, f"{path}/data").unionByName(file_hashes(spark, f"{path}/splits"))
    rel = F.regexp_extract("path", r"/((?:data|splits)/.*)$", 1)
    return found.select(rel.alias("file"), "sha256").filter(~F.col("file").rlike(r"(^|/)[._][^/]*$"))


def validate_package(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Issues of a package: changed and missing files, unknown split ids, and nothing else when it is whole.

    Returns issue, subject.
    """
    stated = spark.read.schema("file string, sha256 string").json(f"{path}/manifests/hashes")
    found = _data_hashes(spark, path).toDF("file", "now")
    both = stated.join(found, "file", "full")
    capsules = read_stream(spark, f"{path}/data/capsules", schema)
    splits = spark.read.schema("capsule_id string").json(f"{path}/splits")
    unknown = splits.join(capsules.select("ids.capsule_id").distinct(), "capsule_id", "left_anti").distinct()
    kind = F.when(F.col("now").isNull(), "missing_file").when(F.col("sha256").isNull(), "unlisted_file").when(F.col("now") != F.col("sha256"), "changed_file")
    return union_all([
        both.select(kind.alias("issue"), F.col("file").alias("subject")).filter("issue is not null"),
        unknown.select(F.lit("unknown_split_id").alias("issue"), F.col("capsule_id").alias("subject")),
    ])


def compare_hashes(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, change of two hash tables(file, sha256): added, removed or changed."""
    j = a.toDF("file", "ha").join(b.toDF("file", "hb"), "file", "full")
    change = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "removed").when(F.col("ha") != F.col("hb"), "changed")
    return j.select("file", change.alias("change")).filter("change is not null")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with their keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


INSPECTION = ("capsule_id", "claim_family_id", "claim_type", "valid_as_of", "canonical_text")


def write_record_table(capsules: DataFrame, path: str) -> None:
    """Capsules as Parquet with a few flat string columns to look at and the whole record as canonical JSON."""
    flat = {"capsule_id": "ids.capsule_id", "claim_family_id": "ids.claim_family_id", "claim_type": "claim.claim_type", "valid_as_of": "temporal.valid_as_of", "canonical_text": "claim.canonical_text"}
    capsules.select(*[F.col(p).cast("string").alias(n) for n, p in flat.items()], canonical_json(capsules).alias("record_json")).write.mode("errorifexists").parquet(path)


def read_record_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of such a table; only record_json is read."""
    return spark.read.parquet(path).select(F.from_json("record_json", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
