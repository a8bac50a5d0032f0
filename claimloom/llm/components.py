"""Groups from pairs: connected components by contraction.

Two ways, both over integer vertices and written tables:
randomly contracted graphs, where each vertex hooks to the neighbour that comes
first in a fresh hash order, and least-label hooking with pointer jumping.
Each round writes the contraction's mapping and the edges that remain, and the
mappings are composed from the last to the first, so that the work shrinks
with the graph. Links, vertices and groups stay in tables; all that comes to
the driver is counts and the few hot vertices (operators/skew.py), whose rows
are relabelled without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.skew import hot_of_counts, hot_values, lookup_join
from claimloom.session import release, scratch, scratch_scope


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def _hash_hook(edges: DataFrame, round_no: int) -> DataFrame:
    """v, r, n: of each vertex and its neighbours the one that is first in this round's hash order, and the vertex's degree; written."""
    seen = F.min(F.struct(F.xxhash64(F.lit(round_no), "b").alias("h"), F.col("b").alias("v"))).alias("m")
    own = F.struct(F.xxhash64(F.lit(round_no), "a").alias("h"), F.col("a").alias("v"))
    return scratch(_both_ways(edges).groupBy("a").agg(seen, F.count(F.lit(1)).alias("n")).select(F.col("a").alias("v"), F.least("m", own)["v"].alias("r"), "n"), "map")


def _least_hook(edges: DataFrame, round_no: int) -> DataFrame:
    """v, r, n: of each vertex and its neighbours the least, followed further by two pointer jumps, and the vertex's degree; written.

    A jump replaces the pointer by the pointer's own: p(v) = p(p(v)). Pointers
    only go down, so each round's mapping is a forest, and wherever a jump stops
    short the edges still hold the pieces together for the next round.
    """
    p = scratch(_both_ways(edges).groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("v"), F.least("a", "m").alias("r"), "n"), "pointers")
    for _ in range(2):
        jumped = scratch(relabelled(p, "r", p, hot_values(p, "r")), "pointers")
        release(p)
        p = jumped
    return p


def relabelled(rows: DataFrame, column: str, labels: DataFrame, hot: list, keep: bool = False) -> DataFrame:
    """rows with each value of a column replaced by its label of labels(v, r); with keep, values without one stay. hot are the hot values of the column."""
    order = rows.columns
    named = labels.select(F.col("v").alias(column), F.col("r").alias("_label"))
    joined = lookup_join(rows, named, column, hot, "left" if keep else "inner")
    label = F.coalesce("_label", column) if keep else F.col("_label")
    return joined.withColumn(column, label).select(*order)


def contract(edges: DataFrame, hook: Callable[[DataFrame, int], DataFrame]) -> DataFrame | None:
    """v, r for every vertex of edges(a, b), r one vertex of its component; None without edges.

    In every round the vertex that is last in the round's order is no
    neighbour's choice, so the graph shrinks and the rounds end by themselves.
    """
    current = scratch(edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not current.isEmpty():
        m = hook(current, len(maps))
        maps.append(m)
        hot = hot_of_counts(m, "v")
        relinked = relabelled(relabelled(current, "a", m, hot), "b", m, hot).filter("a <> b")
        nxt = scratch(relinked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        release(current)
        current = nxt
    release(current)
    if not maps:
        return None
    # the last mapping holds the final roots; earlier ones are followed into it
    whole = maps[-1]
    for m in reversed(maps[:-1]):
        further = scratch(relabelled(m.select("v", "r"), "r", whole, hot_values(m, "r"), keep=True), "map")
        release(whole, m)
        whole = further
    return whole


def numbered(names: DataFrame, column: str) -> DataFrame:
    """column, v: the distinct non-null names with a number each, fixed in a written table."""
    return scratch(names.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("v", F.monotonically_increasing_id()), "names")


def edges_of(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links (a, b) of names (a written table) as edges of their numbers names(name, v); a name without a number takes its link with it."""
    on = lambda rows, c: lookup_join(rows, names.select(F.col("name").alias(c), F.col("v").alias(f"v{c}")), c, hot_values(links, c), "inner").drop(c)
    return on(on(links.select("a", "b"), "a"), "b").select(F.col("va").alias("a"), F.col("vb").alias("b"))


def linked_groups(pairs: DataFrame, method: str = "random") -> DataFrame:
    """A root for every name that pairs link to another.

    pairs(a, b) of strings, in either order and repeated at will. A null on one
    side or a name paired with itself links nothing. Other columns are ignored.
    Returns name and root (a number, the same for all names linked directly or
    through others); an empty table gives no rows. method is `random` for
    random contraction or `jump` for pointer jumping.
    """
    links = scratch(pairs.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    names = numbered(links.select(F.explode(F.array("a", "b")).alias("name")), "name")
    roots = contract(edges_of(links, names), HOOKS[method])
    release(links)
    if roots is None:
        return pairs.sparkSession.createDataFrame([], "name string, root long")
    return names.join(roots.select("v", "r").hint("merge"), "v").select("name", F.col("r").alias("root"))


HOOKS = {"random": _hash_hook, "jump": _least_hook}


def group_ids(pairs: DataFrame) -> DataFrame:
    """name and group_id, the smallest name of its group, by random contraction of the pairs' graph; written, and all tables on the way deleted."""
    with scratch_scope() as keep:
        groups = scratch(linked_groups(pairs, "random"), "groups")
        least = scratch(groups.groupBy("root").agg(F.min("name").alias("group_id"), F.count(F.lit(1)).alias("n")), "least")
        return keep(scratch(lookup_join(groups, least.drop("n"), "root", hot_of_counts(least, "root"), "inner").select("group_id", "name"), "group_ids"))
