"""Bundles of feature groups and artifact sets: tables written side by side with a manifest of schemas, counts and hashes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.operators.audits import union_all
from claimloom.session import path_exists, remove_path
from claimloom.sources.files import file_hashes
from claimloom.sources.packages import content_hash

ISSUES = "issue string, subject string"


def _manifest_rows(spark: SparkSession, path: str) -> list:
    return spark.read.schema("name string, key string, n_rows long, sha256 string, table_schema string").json(f"{path}/manifest").collect()  # one row a table


def write_bundle(tables: dict[str, tuple[DataFrame, str]], path: str, force: bool = False, form: str = "parquet") -> list[tuple]:
    """Write each table (with the name of its key column) under path/tables/name, then the manifest: name, key, rows, content hash, schema.

    Refuses to write where a bundle is, unless forced; the manifest comes last,
    so that a bundle without one was not finished. form is parquet or json.
    Returns the manifest's rows.
    """
    if not tables:
        raise ValueError("a bundle has at least one table")
    spark = next(iter(tables.values()))[0].sparkSession
    if path_exists(spark, path):
        if not force:
            raise FileExistsError(path)
        remove_path(spark, path)
    rows = []
    for name, (df, key) in sorted(tables.items()):
        df.write.format(form).save(f"{path}/tables/{name}")
        written = spark.read.schema(df.schema).format(form).load(f"{path}/tables/{name}")
        rows.append((name, key, written.count(), content_hash(written, key), df.schema.json()))
    spark.createDataFrame(rows, "name string, key string, n_rows long, sha256 string, table_schema string").coalesce(1).write.json(f"{path}/manifest")
    return rows


def open_bundle(spark: SparkSession, path: str, form: str = "parquet") -> dict[str, DataFrame]:
    """The tables of a bundle by name; nothing of them is read until it is used."""
    return {r["name"]: spark.read.schema(T.StructType.fromJson(json.loads(r["table_schema"]))).format(form).load(f"{path}/tables/{r['name']}") for r in _manifest_rows(spark, path)}


def validate_bundle(spark: SparkSession, path: str, expected: tuple[str, ...] = (), form: str = "parquet") -> DataFrame:
    """issue, subject of a bundle: no manifest, a table that is missing or was not expected, other numbers of rows or other contents; nothing when it is whole."""
    if not path_exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([("missing_manifest", path)], ISSUES)
    stated = _manifest_rows(spark, path)
    names = {r["name"] for r in stated}
    found = [("missing_table", n) for n in expected if n not in names] + [("unexpected_table", n) for n in sorted(names) if expected and n not in expected]
    tables = open_bundle(spark, path, form)
    for r in stated:
        if not path_exists(spark, f"{path}/tables/{r['name']}"):
            found.append(("missing_table", r["name"]))
        elif tables[r["name"]].count() != r["n_rows"]:
            found.append(("changed_row_count", r["name"]))
        elif content_hash(tables[r["name"]], r["key"]) != r["sha256"]:
            found.append(("changed_content", r["name"]))
    return spark.createDataFrame(found, ISSUES)


def reproducibility_hashes(spark: SparkSession, path: str, without: tuple[str, ...] = (".pt",)) -> DataFrame:
    """file (below path) and sha256 of every file of a run, weights left out."""
    hashes = file_hashes(spark, path).select(F.regexp_extract("path", r"^(?:file:)?/*" + path.lstrip("/") + r"/*(.*)$", 1).alias("file"), "sha256")
    for suffix in without:
        hashes = hashes.filter(~F.endswith("file", F.lit(suffix)))
    return hashes.filter(~F.col("file").rlike(r"(^|/)[._][^/]*$"))


def folder_hash(hashes: DataFrame) -> str:
    """One hash of file hashes(file, sha256): the same whatever order they were read in."""
    return content_hash(hashes, "file")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name and n_rows of tables, in one plan."""
    return union_all([df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n, df in sorted(tables.items())])


def run_id(input_hash: str, arms: list[str], seed: int) -> str:
    """The id of a run, from its input, its arms in order and its seed."""
    canonical = json.dumps({"arms": arms, "input_hash": input_hash, "seed": seed}, sort_keys=True)
    return "falsification_" + hashlib.sha256(canonical.encode()).hexdigest()[:16]
