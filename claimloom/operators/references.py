"""References to records that do not exist.

Keys are dictionary-encoded to integers, referenced and known keys become
bitmaps per key range and period, reference AND-NOT parent leaves the suspects,
and only the surviving bits are decoded back to keys and rows.

Scale: the dictionary and the bitmaps come from aggregations combined before
their shuffles; a hot key counts once per table and period, however many rows
refer to it. A group of the bitmap step holds one range of 32,768 keys, so its
size does not grow with the data. Rows are joined only to surviving keys; those
of a hot key join a broadcast of its one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators.skew import hot_keys, lookup_join_on
from claimloom.session import scratch

_RANGE_BITS = 15  # 32,768 keys a range: one bitmap of 4 KB
_SPARSE = 2048  # up to so many bits a bitmap is kept as a list of positions
_NO_PERIOD = -1


def pack_bits(bitmap: bytes) -> bytes:
    """A bitmap, compressed: positions as 16-bit numbers where few bits are set, else the words themselves."""
    bits = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))
    return b"s" + bits.astype("<u2").tobytes() if len(bits) <= _SPARSE else b"d" + bytes(bitmap)


def unpack_bits(packed: bytes) -> np.ndarray:
    """The bits of a compressed bitmap as booleans."""
    out = np.zeros(1 << _RANGE_BITS, bool)
    if packed[:1] == b"s":
        out[np.frombuffer(packed[1:], "<u2")] = True
    else:
        bits = np.unpackbits(np.frombuffer(packed[1:], np.uint8), bitorder="little").astype(bool)
        out[: len(bits)] = bits
    return out


def _month(c: Column) -> Column:
    return F.coalesce(F.year(c) * 12 + F.month(c) - 1, F.lit(_NO_PERIOD)).cast("int")


def _suspects_of_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """The suspect bits of one range of keys."""
    bits = [unpack_bits(b) for b in pdf["bits"]]
    role, period, ref_table = pdf["role"].tolist(), pdf["period"].tolist(), pdf["ref_table"].tolist()
    none = np.zeros(1 << _RANGE_BITS, bool)
    arrivals = [(p, b) for r, p, b in zip(role, period, bits) if r == "parent"]
    withdrawals = [(p, b) for r, p, b in zip(role, period, bits) if r == "withdrawn"]
    known = none.copy()
    for _, b in arrivals:
        known |= b
    rows: list[tuple[str, int, np.ndarray]] = []
    for r, p, ref, name in zip(role, period, bits, ref_table):
        if r != "ref":
            continue
        before, gone = none.copy(), none.copy()
        for q, b in arrivals:
            if q < p:
                before |= b
        for q, b in withdrawals:
            if q <= p:
                gone |= b
        left = ref & ~known  # no such record at all
        left |= ref & known & (~before | gone)  # came or went in this period or on the wrong side of it
        if left.any():
            rows.append((name, p, np.flatnonzero(left)))
    base = int(pdf["bucket"].iloc[0]) << _RANGE_BITS
    return pd.DataFrame(
        {
            "ref_table": np.repeat([n for n, _, _ in rows], [len(x) for *_, x in rows]).astype(object) if rows else [],
            "period": np.repeat([p for _, p, _ in rows], [len(x) for *_, x in rows]).astype("int32") if rows else np.array([], "int32"),
            "code": base + np.concatenate([x for *_, x in rows]).astype("int64") if rows else np.array([], "int64"),
        }
    )


def orphan_references(refs: DataFrame, parents: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """The faulty references of refs.

    refs(ref_table, row_id, kind, key, at), parents(kind, key, at),
    withdrawn(kind, key, at). For each ref_table and row_id the row with the
    earliest at counts (a null at comes last; of rows at the same time the one
    with the smallest key, null last). A null key refers to nothing and gives no
    row. A key in no row of its kind is `missing`; else one withdrawn at or
    before the row's time is `deleted`; else one whose earliest time is after
    the row's is `late`. A null time of the row makes it neither deleted nor
    late; parents without any time are there from the start. Repeated rows
    count once; empty tables give no rows. Other columns are ignored.

    Returns ref_table, row_id, key, fault, at.
    """
    order = F.struct(F.col("at").isNull(), F.col("at"), F.col("key").isNull(), F.col("key"))
    first = scratch(
        refs.groupBy("ref_table", "row_id", "kind")
        .agg(F.min(order).alias("_o"))
        .select("ref_table", "row_id", "kind", F.col("_o.key").alias("key"), F.col("_o.at").alias("at"))
        .filter("key is not null")
        .withColumn("period", _month(F.col("at"))),
        "refs",
    )
    known = parents.filter("key is not null").groupBy("kind", "key").agg(F.min("at").alias("p_at"), F.lit(True).alias("is_parent"))
    gone = withdrawn.filter("key is not null").groupBy("kind", "key").agg(F.min("at").alias("w_at"))
    referred = first.select("kind", "key").distinct()

    def side(df: DataFrame) -> DataFrame:
        missing = {"p_at": "timestamp", "is_parent": "boolean", "w_at": "timestamp"}
        times = {"p_at": parents.schema["at"].dataType, "w_at": withdrawn.schema["at"].dataType}
        return df.select("kind", "key", *[F.col(c) if c in df.columns else F.lit(None).cast(times.get(c, t)).alias(c) for c, t in missing.items()])

    # Dense codes: the aggregation leaves each key in one task, which numbers its keys; the written table fixes them.
    dictionary = scratch(
        side(known).unionByName(side(gone)).unionByName(side(referred))
        .groupBy("kind", "key")
        .agg(F.min("p_at").alias("p_at"), F.max("is_parent").alias("is_parent"), F.min("w_at").alias("w_at"))
        .withColumn("code", F.monotonically_increasing_id()),
        "dictionary",
    )
    ref_bits = (
        first.select("ref_table", "kind", "key", "period").distinct()
        .join(dictionary.select("kind", "key", "code"), ["kind", "key"])
        .select(F.lit("ref").alias("role"), "ref_table", "period", "code")
    )
    parent_bits = dictionary.filter("is_parent").select(F.lit("parent").alias("role"), F.lit("").alias("ref_table"), _month(F.col("p_at")).alias("period"), "code")
    # a parent without a time is there from the start
    parent_bits = parent_bits.withColumn("period", F.when(F.col("period") == _NO_PERIOD, F.lit(0)).otherwise(F.col("period")))
    gone_bits = dictionary.filter("w_at is not null").select(F.lit("withdrawn").alias("role"), F.lit("").alias("ref_table"), _month(F.col("w_at")).alias("period"), "code")

    @F.pandas_udf("binary")
    def packed(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(pack_bits)

    bitmaps = (
        ref_bits.unionByName(parent_bits).unionByName(gone_bits)
        .groupBy(F.shiftright("code", _RANGE_BITS).alias("bucket"), "role", "ref_table", "period")
        .agg(F.expr(f"bitmap_construct_agg(code & {(1 << _RANGE_BITS) - 1})").alias("bits"))
        .withColumn("bits", packed("bits"))
    )
    suspects = bitmaps.groupBy("bucket").applyInPandas(_suspects_of_range, "ref_table string, period int, code long")
    decoded = suspects.join(dictionary, "code").select("ref_table", "period", "kind", "key", "p_at", "is_parent", "w_at")
    fault = (
        F.when(F.col("is_parent").isNull(), "missing")
        .when(F.col("w_at") <= F.col("at"), "deleted")
        .when(F.col("p_at") > F.col("at"), "late")
    )
    on = ["ref_table", "kind", "key", "period"]
    hot = scratch(hot_keys(first, on), "hot")
    return (
        lookup_join_on(first, scratch(decoded, "suspects"), on, hot)
        .withColumn("fault", fault)
        .filter("fault is not null")
        .select("ref_table", "row_id", "key", "fault", "at")
    )
