"""Positions and running sums over a whole table, without one task that sees all rows.

Rows are range-partitioned by the order, numbered within their partition, and
shifted by the number (or sum) of the partitions before, a table of one row a
partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.session import scratch


def with_position(df: DataFrame, order: list[Column | str], name: str = "position", value: Column | None = None, total: str = "before") -> DataFrame:
    """df with each row's position from 0 in the order; with a value also the sum of the values before the row.

    The order should leave no ties; rows that tie come in any order. Nulls come
    first. A null value counts as 0. An empty table stays empty.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumns({"_pid": F.spark_partition_id(), "_local": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    if value is not None:
        ranged = ranged.withColumn("_value", F.coalesce(value, F.lit(0)))
    kept = scratch(ranged, "ranged")
    aggs = [F.count(F.lit(1)).alias("_n")] + ([F.sum("_value").alias("_s")] if value is not None else [])
    parts = kept.groupBy("_pid").agg(*aggs)  # one row a partition
    upto = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    shifts = parts.withColumn("_shift", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    if value is not None:
        shifts = shifts.withColumn("_sum_shift", F.coalesce(F.sum("_s").over(upto), F.lit(0)))
    out = kept.join(F.broadcast(shifts.drop("_n", *(["_s"] if value is not None else []))), "_pid").withColumn(name, F.col("_local") + F.col("_shift"))
    if value is not None:
        within = W.partitionBy("_pid").orderBy("_local").rowsBetween(W.unboundedPreceding, -1)
        out = out.withColumn(total, F.coalesce(F.sum("_value").over(within), F.lit(0)) + F.col("_sum_shift"))
    return out.drop("_pid", "_local", "_shift", "_sum_shift", "_value")


def first_occurrence_index(df: DataFrame, key: str, order: Column | str, name: str = "index") -> DataFrame:
    """key and its index from 0 in the order of first occurrence; null keys have none."""
    firsts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    return with_position(firsts, ["_first", key], name).select(key, name)


def keep_best(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of each key that is least by order; combined before the shuffle, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def hash_split(ids: DataFrame, key: str, ratios: dict[str, float], seed: int) -> DataFrame:
    """key and split: ids in the order of SHA-256(seed:id), then of the id, dealt to splits by largest remainders.

    Each split gets the whole part of its ratio of all ids; what remains goes
    one each to the largest fractions, of equal ones the later name. ids are
    distinct and not null.
    """
    whole = sum(ratios.values())
    if not ratios or whole <= 0:
        raise ValueError("ratios must sum to more than 0")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    placed = with_position(ids.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_h", order), ["_h", key], "_p")
    n = placed.count()
    raw = {s: r / whole * n for s, r in ratios.items()}
    counts = {s: int(x) for s, x in raw.items()}
    for s in sorted(ratios, key=lambda s: (raw[s] - counts[s], s), reverse=True)[: n - sum(counts.values())]:
        counts[s] += 1
    split, edge = None, 0
    for s, c in counts.items():
        edge += c
        hit = F.col("_p") < edge
        split = F.when(hit, s) if split is None else split.when(hit, s)
    return placed.select(key, split.alias("split"))


def permuted(df: DataFrame, slot_order: list[Column | str], payload: str, seed: int, hint: Column | str) -> DataFrame:
    """df with payload moved among its rows: the row at position i gets the payload of rank i by SHA-256(seed:position:hint).

    If that leaves every payload in place, all move by seed mod n, or by one.
    Hints and positions make the order total. One row keeps its payload.
    """
    slots = scratch(with_position(df.withColumn("_hint", (F.col(hint) if isinstance(hint, str) else hint).cast("string")), slot_order, "_slot"), "slots")
    ranked = with_position(
        slots.select(F.col("_slot").alias("_from"), F.col(payload).alias("_payload"), F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("_slot").cast("string"), F.coalesce("_hint", F.lit(""))), 256).alias("_h")),
        ["_h", "_from"], "_rank",
    )
    ranked = scratch(ranked, "ranked")
    n = slots.count()
    if n > 1 and ranked.filter("_from <> _rank").isEmpty():
        ranked = ranked.withColumn("_rank", F.pmod(F.col("_rank") - ((seed % n) or 1), F.lit(n)))
    moved = ranked.select(F.col("_rank").alias("_slot"), F.col("_payload").alias(payload))
    return slots.drop(payload, "_hint").join(moved, "_slot").drop("_slot")
