"""Duplicates hidden by formatting: white space, case, punctuation, field order.

Hot canonical keys are found exactly from partial counts and salted into a
two-level aggregation; all others take a one-level shuffle. The record with the
smallest identifier represents its copies.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions.words import words, words_digest
from claimloom.operators.skew import HOT_ROWS, HOT_SHARE, hot_keys, salt
from claimloom.session import scratch

SALTS = 64


@F.pandas_udf(T.BinaryType())
def text_key(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Digest of a text's words; null for a null text."""
    for s in it:
        yield s.map(lambda t: None if t is None else words_digest(t))


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _number(x: Decimal) -> str:
    x = x.normalize()
    return "0" if x == 0 else str(x)


def _canonical(v: object) -> object:
    if isinstance(v, dict):
        return {"o": [[k, _canonical(v[k])] for k in sorted(v) if v[k] is not None]}
    if isinstance(v, list):
        return {"l": [_canonical(x) for x in v]}
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        return {"n": _number(v)}
    return {"w": words(v)}


def canonical_json(payload: str) -> str | None:
    """One form for all payloads with the same fields; None if it isn't valid JSON.

    Fields may stand in any order at any depth; a null field counts as absent;
    strings are the same when they have the same words, numbers when they have
    the same value; lists keep their order.
    """
    try:
        value = json.loads(payload, parse_float=Decimal, parse_int=Decimal, parse_constant=_no_constant)
        return json.dumps(_canonical(value), ensure_ascii=True, separators=(",", ":"))
    except (ValueError, ArithmeticError, RecursionError):
        return None


@F.pandas_udf(T.BinaryType())
def json_key(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Digest of a payload's canonical form; null for a null or broken payload."""

    def key(p: str | None) -> bytes | None:
        c = None if p is None else canonical_json(p)
        return None if c is None else hashlib.blake2b(c.encode(), digest_size=16).digest()

    for s in it:
        yield s.map(key)


def collapse_copies(records: DataFrame, share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame:
    """Each record with the representative of its copies.

    records(record_set, id, key): rows with a null id or key are no records and
    are passed over; repeated rows of one id and key are one. Other columns are
    ignored. Returns record_set, id, first_id, with first_id the smallest id of
    the same record_set and key; an empty table gives no rows.

    A key is hot when it has more than `share` of all rows and more than `least`
    rows. Hot keys are counted exactly; there are at most 1 / share of them, so
    they and their representatives may be broadcast. Their rows never meet in
    one task: they are grouped by key and salt, then by key.
    """
    rows = scratch(records.select("record_set", "id", "key").filter("id is not null and key is not null"), "keys")
    hot = scratch(hot_keys(rows, ["record_set", "key"], share, least), "hot")
    hot_flag = F.broadcast(hot.select("record_set", "key"))
    on = ["record_set", "key"]

    hot_rows = rows.join(hot_flag, on, "left_semi")
    firsts = (
        hot_rows.groupBy(*on, salt(SALTS, "id").alias("_salt")).agg(F.min("id").alias("first_id"))
        .groupBy(*on).agg(F.min("first_id").alias("first_id"))
    )
    from_hot = hot_rows.distinct().join(F.broadcast(firsts), on).select("record_set", "id", "first_id")

    # One shuffle: the distinct and the window both use the partitioning by key.
    cold = rows.join(hot_flag, on, "left_anti").repartition("record_set", "key").distinct()
    from_cold = cold.selectExpr("record_set", "id", "min(id) over (partition by record_set, key) as first_id")
    return from_hot.unionByName(from_cold)


def copy_counts(collapsed: DataFrame) -> DataFrame:
    """record_set, first_id and n_copies: the identifiers that the record stands for, its own included."""
    return collapsed.groupBy("record_set", "first_id").agg(F.count(F.lit(1)).alias("n_copies"))
