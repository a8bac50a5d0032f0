"""Provider outputs: parsing, cache, escalation gate, merge, epistemic proxies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.session import scratch

MIN_CONFIDENCE = 0.72
HIGH_IMPACT = ("causal_claim",)


def parsed_claims(raw: DataFrame) -> DataFrame:
    """raw_id, provider_id, valid, text, claim_type, confidence, n_spans of raw claims; broken JSON is not valid and has nulls."""
    v = F.try_parse_json("payload")
    get = lambda p, kind: F.try_variant_get("_v", p, kind)
    return raw.withColumn("_v", v).select(
        "raw_id", "provider_id", F.col("_v").isNotNull().alias("valid"), get("$.text", "string").alias("text"), get("$.claim_type", "string").alias("claim_type"),
        get("$.confidence", "double").alias("confidence"), F.coalesce(F.size(get("$.source_spans", "array<variant>")), F.lit(0)).alias("n_spans"),
    )


def escalation(confidence: Column, warned: Column, claim_type: Column, least: float = MIN_CONFIDENCE, high_impact: tuple[str, ...] = HIGH_IMPACT) -> tuple[Column, Column]:
    """Reasons to ask a second provider, and the score: a third for each."""
    reasons = F.array_compact(F.array(F.when(confidence < least, "low_confidence"), F.when(warned, "provider_warning"), F.when(claim_type.isin(*high_impact), "high_impact_claim_type")))
    return reasons, F.least(F.lit(1.0), F.size(reasons) / 3.0)


def merge_outputs(primary: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """key, decision, confidence, output of primary(key, output, confidence, n_keys) and second, one row a key each.

    Without a second output the first stands; equal outputs are equivalent;
    else the higher confidence (null counts as 0) wins, then more keys, then
    the first.
    """
    p, s = [d.select(key, *[F.col(c).alias(f"{x}_{c}") for c in ("output", "confidence", "n_keys")]) for d, x in ((primary, "p"), (second, "s"))]
    j = p.join(s, key, "left")
    pc, sc = F.coalesce("p_confidence", F.lit(0.0)), F.coalesce("s_confidence", F.lit(0.0))
    alone = F.col("s_output").isNull()
    takes_second = (sc > pc) | ((sc == pc) & (F.col("s_n_keys") > F.col("p_n_keys")))
    decision = F.when(alone, "single_provider").when(F.col("p_output") == F.col("s_output"), "provider_outputs_equivalent").when(takes_second, "selected_escalation").otherwise("selected_primary")
    return j.select(key, decision.alias("decision"), F.when(decision == "selected_escalation", F.col("s_confidence")).otherwise(F.col("p_confidence")).alias("confidence"), F.when(decision == "selected_escalation", F.col("s_output")).otherwise(F.col("p_output")).alias("output"))


def cascade(primary: DataFrame, second: DataFrame, key: str, warned: str, claim_type: str) -> DataFrame:
    """merge_outputs of primary(key, output, confidence, n_keys, warned, claim_type) and those rows of second whose primary output asks for a second opinion; with reasons and score of the escalation."""
    reasons, score = escalation(F.col("confidence"), F.col(warned), F.col(claim_type))
    gated = primary.withColumns({"reasons": reasons, "escalation_score": score})
    asked = second.join(gated.filter(F.size("reasons") > 0).select(key), key, "left_semi")
    return merge_outputs(primary, asked, key).join(gated.select(key, "reasons", "escalation_score"), key)


def request_hash(*parts: str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x1f", *parts), 256))


def replay_or_run(requests: DataFrame, cache: DataFrame, run: Callable[[pd.Series], pd.Series], mode: str = "live") -> tuple[DataFrame, DataFrame]:
    """(answers, new cache rows) of requests(request_hash, input) against cache(request_hash, output).

    live takes cached answers and runs the rest, cache_only answers null for
    what isn't cached, refresh runs all. Each distinct request is run once (and
    again only where a task is repeated after a failure): what the provider said
    is written before it is used in either result.
    """
    if mode not in ("live", "cache_only", "refresh"):
        raise ValueError(mode)
    distinct = requests.groupBy("request_hash").agg(F.min("input").alias("input"))
    known = cache.groupBy("request_hash").agg(F.min("output").alias("output"))
    hits = distinct.join(known, "request_hash", "left") if mode != "refresh" else distinct.withColumn("output", F.lit(None).cast("string"))

    def call(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(output=run(pdf["input"]))[["request_hash", "output"]]

    missed = hits.filter("output is null").select("request_hash", "input")
    fresh = scratch(missed.mapInPandas(call, "request_hash string, output string"), "answers") if mode != "cache_only" else missed.select("request_hash", F.lit(None).cast("string").alias("output"))
    answers = hits.filter("output is not null").select("request_hash", "output", F.lit(True).alias("cached")).unionByName(fresh.withColumn("cached", F.lit(False)))
    return answers, fresh.filter("output is not null")


def epistemic_proxies(n_sources: Column, n_relations: Column, n_disagreements: Column) -> dict[str, Column]:
    """Deterministic stand-ins from counts."""
    s, r, g = [c.cast("double") for c in (n_sources, n_relations, n_disagreements)]
    return {
        "evidential_anchoring": F.round(F.least(F.lit(0.85), 0.35 + 0.1 * s), 3),
        "uncertainty": F.round(F.greatest(F.lit(0.2), F.least(F.lit(0.9), 0.7 - 0.05 * s + 0.08 * g)), 3),
        "transformation_pressure": F.round(F.least(F.lit(0.6), r / 10.0), 3),
        "independent_redundancy": s,
    }


def quality_tier(confidence: Column, warnings: Column, disagreements: Column, reviewed: Column, low: float = 0.2, silver: float = 0.72) -> Column:
    return F.when(reviewed, "gold").when((warnings > 1) | (confidence < low), "quarantine").when((confidence >= silver) & (disagreements == 0), "silver").otherwise("bronze")


def python_provider(target: str) -> Callable[[pd.Series], pd.Series]:
    """A provider by `module:function` of a text, for replay_or_run; it is imported where it runs."""
    module, _, name = target.partition(":")
    if not module or not name:
        raise ValueError("a provider is named module:function")

    def run(texts: pd.Series) -> pd.Series:
        import importlib

        return texts.map(getattr(importlib.import_module(module), name))

    return run
