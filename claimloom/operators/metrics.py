"""Evaluation metrics as aggregates over exported rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked_mean(x: Column, mask: Column) -> Column:
    """Mean of x where mask is 1; 0 when nothing is."""
    m = mask.cast("double")
    return F.coalesce(F.sum(x * m), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(m), F.lit(0.0)), F.lit(1.0))


def confusion(df: DataFrame, target: str, predicted: str, mask: Column) -> DataFrame:
    return df.filter(mask).groupBy(F.col(target).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def macro_f1(df: DataFrame, target: str, predicted: str, mask: Column) -> DataFrame:
    """One row: the mean F1 over labels that occur as targets; from the confusion counts, whose size is that of the label set squared."""
    c = confusion(df, target, predicted, mask)
    both = c.select(F.col("t").alias("label"), (F.col("n") * (F.col("t") == F.col("p")).cast("long")).alias("tp"), F.col("n").alias("as_t"), F.lit(0).cast("long").alias("as_p")).unionByName(
        c.select(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("as_t"), F.col("n").alias("as_p"))
    )
    f1 = both.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("as_t").alias("as_t"), F.sum("as_p").alias("as_p")).filter("as_t > 0")
    return f1.agg(F.coalesce(F.avg(2 * F.col("tp") / (F.col("as_t") + F.col("as_p"))), F.lit(0.0)).alias("macro_f1"))


def ranking(df: DataFrame, rank: str, k: int) -> list[Column]:
    """Recall at k and mean reciprocal rank from the rank of the target, null where it is never met."""
    r = F.col(rank)
    return [F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}"), F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr")]


def relative_spread(low: Column, high: Column) -> Column:
    return (high - low) / F.greatest(F.abs(low), F.lit(1.0))


def text_score(accuracy: Column, cross_entropy: Column, perplexity: Column) -> Column:
    """Accuracy plus the inverse perplexity, which is exp(cross entropy), 20 at most in the exponent, where it isn't given."""
    ppl = F.coalesce(perplexity, F.exp(F.least(cross_entropy, F.lit(20.0))))
    return F.greatest(F.lit(0.0), accuracy + 1.0 / F.greatest(ppl, F.lit(1.0)))


def structured_score(relation_loss: Column, provenance_loss: Column, proxy_loss: Column, stability: Column) -> Column:
    one = lambda x: 1.0 - F.coalesce(x, F.lit(1.0))
    return F.greatest(F.lit(0.0), (one(relation_loss) + one(provenance_loss) + one(proxy_loss) + F.coalesce(stability, F.lit(0.0))) / 4.0)


def warmup_decay(step: Column, warmup: int, total: int) -> Column:
    """Learning-rate factor: linear up to warmup, then linear down to 0 at total."""
    up = step / max(1, warmup)
    down = F.greatest(F.lit(0.0), (F.lit(total) - step) / max(1, total - warmup))
    return F.when(step < warmup, up).otherwise(down)


CURRICULUM = ("text_projection", "structured", "relations", "provenance", "geometry")


def curriculum(step: Column, total: int, schedule: str = "none", bounds: tuple[int, ...] = ()) -> dict[str, Column]:
    """Multipliers of the loss families at a step: all 1, a linear ramp (text always 1, structured ones at least 0.1), or by phases with relations from the second and geometry from the third."""
    one = F.lit(1.0)
    if schedule == "none":
        return dict.fromkeys(CURRICULUM, one)
    progress = (step + 1) / float(max(total, 1))
    if schedule == "linear_complexity_ramp":
        ramp = F.greatest(F.lit(0.1), progress)
        return dict(zip(CURRICULUM, (one, ramp, ramp, ramp, progress)))
    phase = F.lit(0)
    for i, b in enumerate(bounds):
        phase = F.when(step >= b, i).otherwise(phase)
    later = lambda n: F.when(phase >= n, 1.0).otherwise(0.0)
    return dict(zip(CURRICULUM, (one, one, later(1), later(1), later(2))))


def availability_masked(loss: Column, available: Column) -> Column:
    """A record takes part in a loss when both masks say so; a null mask says no."""
    return F.coalesce(loss, F.lit(0)).cast("boolean") & F.coalesce(available, F.lit(0)).cast("boolean")


def budgets(metrics: DataFrame) -> DataFrame:
    """Budget rows of metrics(arm_id, total, trainable, final_step, records_seen, tokens_seen); what is missing counts as 0, and wall-clock is 0 as in the original."""
    n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    return metrics.select(
        "arm_id", n("total").alias("parameters"), n("trainable").alias("trainable_parameters"), n("final_step").alias("step_count"), n("records_seen").alias("records_seen"), n("tokens_seen").alias("tokens_seen"), n("records_seen").alias("structured_records_seen"),
        F.lit(0.0).alias("wall_clock_seconds"), (F.lit(2.0) * n("total") * F.greatest(n("final_step"), F.lit(1))).alias("estimated_flops"), F.lit("local_runtime").alias("hardware"),
    )


# The arms whose difference from the geometry arm is a control effect.
GEOMETRY_ARM = "E_structured_native_geometry"
CONTROL_EFFECTS = {"geometry_on_minus_off_delta": "D_structured_native_no_geometry", "context_shuffle_degradation": "H_structured_native_context_shuffle", "geometry_signal_vs_popularity_control": "J_popularity_frequency_control"}


def control_effects(scores: DataFrame) -> DataFrame:
    """One row of the effects from scores(arm_id, structured_epistemic_score), one row an arm; a missing arm or score counts as 0."""
    of = lambda arm: F.coalesce(F.max(F.when(F.col("arm_id") == arm, F.col("structured_epistemic_score"))), F.lit(0.0))
    return scores.agg(*[(of(GEOMETRY_ARM) - of(arm)).alias(name) for name, arm in CONTROL_EFFECTS.items()])


# What each score is read from, by its name in the exported metrics; a metric that is missing counts as 0.
SCORES = {
    "relation_type_accuracy": "relation_prediction_relation_accuracy", "relation_macro_f1": "relation_prediction_relation_macro_f1", "relation_micro_f1": "relation_prediction_relation_micro_f1",
    "support_contradiction_f1": "relation_prediction_relation_macro_f1", "hard_negative_accuracy": "relation_prediction_hard_negative_accuracy", "relation_target_recall_at_k": "relation_prediction_relation_accuracy",
    "source_recall_at_1": "provenance_recovery_source_recall_at_1", "source_recall_at_k": "provenance_recovery_source_recall_at_k", "span_recall_at_k": "provenance_recovery_span_recovery_recall", "provenance_mrr": "provenance_recovery_mean_reciprocal_rank",
    "uncertainty_brier": "uncertainty_calibration_uncertainty_brier", "expected_calibration_error": "uncertainty_calibration_expected_calibration_error",
    "temporal_holdout_loss": "loss_stability_temporal", "temporal_stability_prediction": "stability_temporal_stability_accuracy", "future_target_mask_violation_count": "stability_temporal_future_target_mask_violation_count",
    "temporal_leakage_count": "stability_temporal_temporal_leakage_count", "text_cross_entropy": "text_projection_text_cross_entropy", "token_accuracy": "text_projection_token_accuracy",
}


def run_scores(metrics: DataFrame) -> DataFrame:
    """One row of scores for each arm of metrics(arm_id, name, value), a row a metric.

    Beside SCORES: the structured score (missing losses count as 1), geometry
    evidence and transport consistency, the text score, and 1 or 0 for the
    audit, by whether anything leaked. Nulls are missing; of several values of
    a metric the largest counts.
    """
    wanted = sorted({*SCORES.values(), "loss_relation_prediction", "loss_provenance_recovery", "loss_epistemic_proxy", "geometry_auxiliary_geometry_observable_loss", "geometry_auxiliary_geometry_regularization", "text_projection_text_perplexity"})
    wide = metrics.filter("arm_id is not null").groupBy("arm_id").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"_{i}") for i, n in enumerate(wanted)])
    raw = {n: F.col(f"_{i}") for i, n in enumerate(wanted)}
    get = lambda n: F.coalesce(raw[n], F.lit(0.0))
    observed, regular = get("geometry_auxiliary_geometry_observable_loss"), get("geometry_auxiliary_geometry_regularization")
    evidence = F.greatest(F.lit(0.0), 1.0 - observed - 0.01 * regular)
    clean = (get(SCORES["temporal_leakage_count"]) == 0) & (get(SCORES["future_target_mask_violation_count"]) == 0)
    return wide.select(
        "arm_id", *[get(n).alias(s) for s, n in SCORES.items()],
        structured_score(raw["loss_relation_prediction"], raw["loss_provenance_recovery"], raw["loss_epistemic_proxy"], get("stability_temporal_stability_accuracy")).alias("structured_epistemic_score"),
        evidence.alias("geometry_evidence_score"), evidence.alias("geometry_observable_stability"), F.greatest(F.lit(0.0), 1.0 - regular).alias("transport_consistency_score"),
        text_score(get(SCORES["token_accuracy"]), get(SCORES["text_cross_entropy"]), raw["text_projection_text_perplexity"]).alias("text_projection_score"), clean.cast("double").alias("audit_compliance_score"),
    )


# Differences that decide on a branch.
LEAST_GAIN, KILLING_LOSS = 0.01, -0.20


def delta_outcome(delta: Column, fair: Column, gain: float = LEAST_GAIN, loss: float = KILLING_LOSS) -> Column:
    """What a controlled difference says of a branch; nothing unless the comparison was fair and the difference is known."""
    said = F.when(delta <= loss, "kill_branch").when(delta >= gain, "proceed").when(delta > 0, "proceed_with_caution").when(delta > -gain, "inconclusive").otherwise("redesign")
    return F.when(fair & delta.isNotNull(), said).otherwise("inconclusive")


def best_scores(scores: DataFrame, columns: list[str], gain: float = LEAST_GAIN) -> DataFrame:
    """score, best, present, viable: over all arms the best of each score, whether it is more than 0 and whether it is enough to go on; one row each, 0 without arms."""
    best = scores.agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in columns])
    rows = best.select(F.explode(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).alias("best")) for c in columns])).alias("x")).select("x.*")
    return rows.select("score", "best", (F.col("best") > 0).alias("present"), (F.col("best") >= gain).alias("viable"))


def cascade_counts(decisions: DataFrame, decision: str, escalated: Column) -> DataFrame:
    """One row: outputs, how many were escalated, the rate (3 digits), and disagreements, where one provider's output was taken over the other's."""
    n = F.count(F.lit(1))
    return decisions.agg(n.alias("total"), F.count_if(escalated).alias("escalated"), F.round(F.coalesce(F.try_divide(F.count_if(escalated), n), F.lit(0.0)), 3).alias("escalation_rate"), F.count_if(F.startswith(F.col(decision), F.lit("selected_"))).alias("disagreements"))


def fairness_flags(budgets: DataFrame, columns: dict[str, float]) -> DataFrame:
    """measure, spread, allowed, fair: the relative spread of each measure over all arms against what is allowed; an empty table is fair."""
    spread = budgets.agg(*[F.coalesce(relative_spread(F.min(c), F.max(c)), F.lit(0.0)).alias(c) for c in columns])
    rows = spread.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("spread"), F.lit(float(x)).alias("allowed")) for c, x in columns.items()])).alias("x")).select("x.*")
    return rows.withColumn("fair", F.col("spread") <= F.col("allowed"))
