"""Audits as findings in one long form: audit, severity, message, record_id, path, value.

Every check is a narrow projection or one join on a key, never an exception in
a task; findings of several audits are a bag union.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Key names no record may carry; the validator's list and the audits' list differ.
VALIDATOR_FORBIDDEN_KEYS = ("truth", "is_true", "true", "is_correct", "correct", "ground_truth", "label_truth", "label_correct", "factuality_label")
AUDIT_FORBIDDEN_KEYS = ("truth", "is_true", "correct", "is_correct", "factuality", "ground_truth", "label_truth", "proven_true")
# What a text for prediction must not show.
TARGET_MARKERS = ("future_summary", "future_label", "target_timestamp", "target_only", "ground_truth", "answer_key")
FORMATS = ("AXC",)
FORMAT_VERSIONS = ("0.1.0",)


def findings(df: DataFrame, audit: str, severity: str, message: str, record_id: Column | str, path: Column | str, value: Column | str | None = None) -> DataFrame:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    v = F.lit(None).cast("string") if value is None else c(value).cast("string")
    return df.select(F.lit(audit).alias("audit"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), c(record_id).alias("record_id"), c(path).alias("path"), v.alias("value"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def temporal_leakage(capsules: DataFrame) -> DataFrame:
    """Sources dated after the capsule's valid_as_of, unless they are targets only; null times leak nothing."""
    s = capsules.select(F.col("ids.capsule_id").alias("id"), F.col("temporal.valid_as_of").alias("v"), F.posexplode("provenance_sources").alias("k", "s"))
    late = s.filter((F.col("s.source_date") > F.col("v")) & ~F.coalesce("s.target_only", F.lit(False)))
    return findings(late, "temporal_leakage", "error", "source dated after valid_as_of", "id", F.concat(F.lit("provenance_sources["), F.col("k"), F.lit("].source_date")), "s.source_date")


def required_fields(capsules: DataFrame, fields: dict[str, str]) -> DataFrame:
    """fields: column path and severity; one finding for each null or blank one, none without fields."""
    if not fields:
        return findings(capsules.limit(0), "required_fields", "error", "missing", "ids.capsule_id", F.lit(""))
    checks = F.array(*[F.when(F.coalesce(F.trim(F.col(p).cast("string")), F.lit("")) == "", F.struct(F.lit(p).alias("p"), F.lit(s).alias("s"))) for p, s in fields.items()])
    bad = capsules.select(F.col("ids.capsule_id").alias("id"), F.explode(F.array_compact(checks)).alias("x"))
    return bad.select(F.lit("required_fields").alias("audit"), F.col("x.s").alias("severity"), F.lit("missing").alias("message"), F.col("id").alias("record_id"), F.col("x.p").alias("path"), F.lit(None).cast("string").alias("value"))


def provenance_integrity(capsules: DataFrame) -> DataFrame:
    """Capsules without sources (warning), sources without an id (error), a title or a date (warning)."""
    none = capsules.filter(F.coalesce(F.size("provenance_sources"), F.lit(0)) <= 0).select(F.col("ids.capsule_id").alias("id"))
    s = capsules.select(F.col("ids.capsule_id").alias("id"), F.posexplode("provenance_sources").alias("k", "s"))
    at = lambda f: F.concat(F.lit("provenance_sources["), F.col("k"), F.lit(f"].{f}"))
    return union_all([
        findings(none, "provenance_integrity", "warning", "no sources", "id", F.lit("provenance_sources")),
        *[findings(s.filter(F.col(f"s.{f}").isNull()), "provenance_integrity", sev, f"source without {f}", "id", at(f)) for f, sev in (("source_id", "error"), ("title", "warning"), ("source_date", "warning"))],
    ])


def context_integrity(capsules: DataFrame) -> DataFrame:
    none = capsules.filter(F.coalesce(F.size("context.domains"), F.lit(0)) <= 0)
    return findings(none, "context_integrity", "warning", "no domains", "ids.capsule_id", F.lit("context.domains"))


def split_integrity(members: DataFrame, capsules: DataFrame) -> DataFrame:
    """Ids listed more than once in a list, in more than one list, or that no capsule has."""
    known = capsules.select(F.col("ids.capsule_id").alias("capsule_id")).distinct()
    twice = members.groupBy("split_name", "capsule_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = members.select("split_name", "capsule_id").distinct().groupBy("capsule_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    unknown = members.select("split_name", "capsule_id").distinct().join(known, "capsule_id", "left_anti")
    return union_all([
        findings(twice, "split_integrity", "warning", "listed repeatedly", "capsule_id", "split_name", "n"),
        findings(several, "split_integrity", "error", "in several lists", "capsule_id", F.lit("splits"), "n"),
        findings(unknown, "split_integrity", "error", "unknown id", "capsule_id", "split_name"),
    ])


def relation_integrity(relations: DataFrame) -> DataFrame:
    r = relations.select("relation_id", "source_claim", "target_claim", "relation_type").distinct()
    return union_all([findings(r.filter(F.col(f).isNull()), "relation_integrity", sev, f"relation without {f}", "relation_id", F.lit(f)) for f, sev in (("source_claim", "error"), ("target_claim", "error"), ("relation_type", "warning"))])


def capsule_relation_integrity(capsules: DataFrame) -> DataFrame:
    """Relations inside capsules without a target (warning) or a type (warning)."""
    r = capsules.select(F.col("ids.capsule_id").alias("id"), F.posexplode("relations").alias("k", "r"))
    at = lambda f: F.concat(F.lit("relations["), F.col("k"), F.lit(f"].{f}"))
    return union_all([findings(r.filter(F.col(f"r.{f}").isNull()), "relation_integrity", "warning", f"relation without {f}", "id", at(f)) for f in ("target_family", "relation_type")])


class AuditError(ValueError):
    """An audit found errors."""


def checked(found: DataFrame) -> DataFrame:
    """The findings, or an AuditError that names the first error among them."""
    worst = found.filter("severity = 'error'").orderBy("audit", "record_id", "path").limit(1).collect()
    if worst:
        raise AuditError(f"{worst[0]['audit']}: {worst[0]['message']} ({worst[0]['record_id']})")
    return found


def severity_counts(found: DataFrame) -> DataFrame:
    """One row: errors, warnings and infos, zero where there are none."""
    return found.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "info")])


def json_keys(payloads: DataFrame, record_id: str, payload: str) -> DataFrame:
    """record_id, path, key: every object key of every JSON payload, at any depth; broken or null payloads have none."""

    def walk(v: object, path: str) -> Iterator[tuple[str, str]]:
        if isinstance(v, dict):
            for k, x in v.items():
                yield f"{path}.{k}", k
                yield from walk(x, f"{path}.{k}")
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from walk(x, f"{path}[{i}]")

    def make(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for rid, p in zip(pdf[record_id], pdf[payload]):
                try:
                    value = json.loads(p) if p is not None else None
                except (ValueError, RecursionError):
                    continue
                rows.extend((rid, path, key) for path, key in walk(value, "$"))
            yield pd.DataFrame(rows, columns=["record_id", "path", "key"])

    return payloads.select(record_id, payload).mapInPandas(make, "record_id string, path string, key string")


def forbidden_keys(payloads: DataFrame, record_id: str, payload: str, names: tuple[str, ...] = VALIDATOR_FORBIDDEN_KEYS) -> DataFrame:
    """Findings for keys that no record may carry, without regard to case."""
    bad = json_keys(payloads, record_id, payload).filter(F.lower("key").isin(*names))
    return findings(bad, "forbidden_keys", "error", "forbidden key", "record_id", "path", "key")


def record_issue(fmt: Column, version: Column, forbidden: Column, complete: Column) -> Column:
    """The first fault of a record, in the order of the checks; null for a valid one."""
    return F.when(forbidden, "forbidden_key").when(~F.coalesce(fmt, F.lit("")).isin(*FORMATS), "format").when(~F.coalesce(version, F.lit("")).isin(*FORMAT_VERSIONS), "version").when(~complete, "schema")


def target_exposure(texts: DataFrame, record_id: str, text: str, markers: tuple[str, ...] = TARGET_MARKERS) -> DataFrame:
    """Findings for target markers in texts, one for each marker and text."""
    hits = F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(F.lower(F.col(text)), m))
    return findings(texts.select(record_id, F.explode(hits).alias("m")), "future_target_exposure", "error", "text shows a target marker", F.col(record_id).cast("string"), F.lit(text), "m")
