"""Joins and groupings that survive a key holding a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has more than this part of all rows, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 512
#: ... and more than so many rows; smaller groups fit in any task.
HOT_ROWS = 64


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame:
    """Keys with more than share of all rows and more than least rows, counted exactly.

    Counts are combined before the shuffle. The result has at most 1 / share
    rows, whatever the size of the input, so that it may be broadcast.
    Null keys are counted like any other key.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return (
        counts.filter(F.col("_n") > least)
        .join(F.broadcast(total), F.col("_n") > F.col("_total") * F.lit(share))  # one row
        .select(*keys, "_n")
    )


def hot_values(df: DataFrame, key: str, share: float = HOT_SHARE, least: int = HOT_ROWS) -> list:
    """The hot keys of one column, nulls left out, on the driver: at most 1 / share of them. df should be a written table."""
    total = df.count()
    if total <= least:
        return []
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return sorted(r[0] for r in counts.filter(F.col("_n") > max(least, total * share)).select(key).collect())


def hot_of_counts(counts: DataFrame, key: str, n: str = "n", share: float = HOT_SHARE, least: int = HOT_ROWS) -> list:
    """The hot keys of a written table of counts (key, n), on the driver: at most 1 / share of them."""
    total = counts.agg(F.sum(n).alias("_total"))
    hot = counts.filter((F.col(n) > least) & F.col(key).isNotNull()).join(F.broadcast(total), F.col(n) > F.col("_total") * F.lit(share))  # one row
    return sorted(r[0] for r in hot.select(key).collect())


def lookup_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "left") -> DataFrame:
    """left joined to right, whose key is unique, with hot keys of left kept out of the shuffle.

    hot comes from hot_values(left, key) and so is of a bounded length; its part
    of right, one row each, is broadcast. Other keys take a shuffled merge join,
    whatever the sizes. how is left, inner, left_semi or left_anti. A null key
    matches nothing.
    """
    if not hot:
        return left.join(right.hint("merge"), key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = left.filter(is_hot).join(F.broadcast(right.filter(F.col(key).isin(hot))), key, how)  # at most len(hot) rows
    return few.unionByName(left.filter(~is_hot).join(right.hint("merge"), key, how))


def lookup_join_on(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """lookup_join for a key of several columns without nulls. hot comes from hot_keys(left, keys), so it is of a bounded size; pass it written."""
    few = F.broadcast(hot.select(*keys))  # at most 1 / share rows
    marked = left.join(few.withColumn("_hot", F.lit(True)), keys, "left")
    a = marked.filter("_hot").drop("_hot").join(F.broadcast(right.join(few, keys, "left_semi")), keys, how)
    return a.unionByName(marked.filter("_hot is null").drop("_hot").join(right.hint("merge"), keys, how))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, salts: int = 16) -> DataFrame:
    """Inner join of two sides that may both repeat a key, with hot keys split over several tasks.

    hot comes from hot_keys of the larger side, so it is of a bounded size and
    broadcast. Rows of a hot key on the left are dealt to `salts` parts, those
    on the right are copied to each; others stay in one part.
    """
    flags = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))  # at most 1 / share rows
    row = reduce(lambda a, b: F.concat(a, b), [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in left.columns if c not in keys], F.lit(""))
    a = left.join(flags, keys, "left").withColumn("_salt", F.when(F.col("_hot"), salt(salts, row)).otherwise(F.lit(0).cast("long"))).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    b = right.join(flags, keys, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return a.join(b.hint("merge"), [*keys, "_salt"]).drop("_salt")


def salt(n: int, *spread: Column | str) -> Column:
    """A number below n from the given columns, the same on every run."""
    return F.pmod(F.xxhash64(*spread), F.lit(n))
