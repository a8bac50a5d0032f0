"""Splits that keep related records together, batch after batch.

The state is three persisted tables: keys (key, component_id), in which every
record is a key of its own, components (component_id, split, n_records) and
conflicts, the merges that were quarantined. A batch links keys with each
other. Components that hold records given out keep their split and their
records, whatever comes. New keys first form components among themselves, by
pointer jumping; one that touches given-out components of a single split joins
them, and merges them into one; one that touches several splits can be in none
without a leak, so the merge is quarantined: its new records get the split
`quarantine`, the components it touches stay as they are, and what met is
written to conflicts. The rest is new and fills the splits that are furthest
below their share. A component without any record has no split (null) and binds
nothing: it counts as new when its first record comes.

Scale: keys, links and components are shuffled tables throughout; hubs and large
components are looked up apart (operators/skew.py). Only the largest new
components, at most 1 / LARGE_SHARE of them, are placed on the driver; all
others are placed by a distributed running sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.llm.components import HOOKS, contract, edges_of, relabelled
from claimloom.operators.skew import hot_of_counts, hot_values, lookup_join
from claimloom.session import scratch, scratch_scope

SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
QUARANTINE = "quarantine"
#: A new component with more than this part of the new records is placed on the driver, largest first.
LARGE_SHARE = 1 / 1000
_BUCKETS = 1024


#: What the key of a record starts with.
RECORD = "r:"


@dataclass
class SplitState:
    """keys(key, component_id), components(component_id, split, n_records), conflicts(component_id, split, met_id, met_split)."""

    keys: DataFrame
    components: DataFrame
    conflicts: DataFrame
    empty_state: bool = False

    @staticmethod
    def empty(spark: SparkSession) -> SplitState:
        none = lambda schema: spark.createDataFrame([], schema)
        return SplitState(none("key string, component_id string"), none("component_id string, split string, n_records long"), none("component_id string, split string, met_id string, met_split string"), True)

    def save(self, path: str) -> None:
        for name in ("keys", "components", "conflicts"):
            getattr(self, name).write.mode("errorifexists").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SplitState:
        return SplitState(*[spark.read.parquet(f"{path}/{name}") for name in ("keys", "components", "conflicts")])


def _place(new: DataFrame, deficits: dict[str, float], seed: int) -> DataFrame:
    """component_id, split, n_records for new(component_id, n_records): fill the splits' deficits, counted in records."""
    total = new.agg(F.sum("n_records")).first()[0] or 0
    large = [(r[0], r[1]) for r in new.filter(F.col("n_records") > total * LARGE_SHARE).select("component_id", "n_records").collect()]  # at most 1 / LARGE_SHARE
    left = dict(deficits)
    placed = []
    for cid, n in sorted(large, key=lambda x: (-x[1], x[0])):
        split = max(left, key=lambda s: left[s])
        left[split] -= n
        placed.append((cid, split, n))
    spark = new.sparkSession
    large_rows = spark.createDataFrame(placed, "component_id string, split string, n_records long")
    small = new.filter(F.col("n_records") <= total * LARGE_SHARE).withColumn("_h", F.xxhash64(F.lit(seed), "component_id")).withColumn("_b", F.pmod("_h", F.lit(_BUCKETS)))
    # a running sum over all small components in hash order: bucket by bucket, then within each bucket
    before = small.groupBy("_b").agg(F.sum("n_records").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_b")) - F.col("_n"))  # _BUCKETS rows
    inside = W.partitionBy("_b").orderBy("_h", "component_id")
    rank = F.col("_before") + F.sum("n_records").over(inside) - F.col("n_records") / 2
    need = {s: max(0.0, x) for s, x in left.items()}
    room, rest = sum(need.values()), total - sum(n for _, n in large)
    if not room:  # the large ones filled every split: the rest follows the shares
        need, room = {s: max(1e-9, deficits[s]) for s in left}, sum(max(1e-9, deficits[s]) for s in left)
    names, edges, edge = list(need), [], 0.0
    for s in names[:-1]:
        edge += need[s] * rest / room
        edges.append(edge)
    split = F.lit(names[-1])
    for s, edge in reversed(list(zip(names, edges))):
        split = F.when(F.col("_rank") < edge, s).otherwise(split)
    small_rows = small.join(F.broadcast(before.select("_b", "_before")), "_b").withColumn("_rank", rank).select("component_id", split.alias("split"), "n_records")
    return large_rows.unionByName(small_rows)


def _vertices(links: DataFrame, state: SplitState) -> tuple[DataFrame, DataFrame]:
    """(keys: key, v), (vertices: v, name, old, split, n_records), both written.

    A vertex is a new key, or a component known before. Only components whose
    records were given out have a split here.
    """
    met = links.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    is_record = F.startswith(F.col("key"), F.lit(RECORD)).cast("long")
    if state.empty_state:
        own = scratch(met.select(F.monotonically_increasing_id().alias("v"), F.col("key").alias("name"), F.lit(False).alias("old"), F.lit(None).cast("string").alias("split"), is_record.alias("n_records")), "vertices")
        return own.select(F.col("name").alias("key"), "v"), own
    known = scratch(met.join(state.keys.hint("merge"), "key", "left"), "met")
    fresh = known.filter("component_id is null").select(F.col("key").alias("name"), F.lit(False).alias("old"), F.lit(None).cast("string").alias("split"), is_record.alias("n_records"))
    touched = known.filter("component_id is not null").select("component_id").distinct().join(state.components.hint("merge"), "component_id")
    old = touched.select(F.col("component_id").alias("name"), F.lit(True).alias("old"), F.when(F.col("n_records") > 0, F.col("split")).alias("split"), "n_records")
    vertices = scratch(fresh.unionByName(old).select(F.monotonically_increasing_id().alias("v"), "name", "old", "split", "n_records"), "vertices")
    of_old = vertices.filter("old").select(F.col("name").alias("component_id"), "v")
    keyed = lookup_join(known, of_old, "component_id", hot_values(known, "component_id"), "inner").select("key", "v")
    return scratch(keyed.unionByName(vertices.filter("not old").select(F.col("name").alias("key"), "v")), "keyed"), vertices


def update_splits(state: SplitState, links: DataFrame, shares: tuple[tuple[str, float], ...] = SHARES, seed: int = 7) -> SplitState:
    """The state after a batch.

    links(a, b): keys that must share a split, in any order, repeated at will; a
    link of a key with itself only brings the key in. Keys that start with
    RECORD are records; each counts once, however often and in however many
    batches it comes. Links with a null link nothing. A component that grows or
    merges keeps the smallest id of those it had; new ones are named by their
    smallest key. An empty batch leaves the state as it is.

    The state's tables are written; all others of the batch are deleted.
    """
    with scratch_scope() as keep:
        after = _updated(state, links, shares, seed)
        keep(after.keys, after.components, after.conflicts)
    return after


def _updated(state: SplitState, links: DataFrame, shares: tuple[tuple[str, float], ...], seed: int) -> SplitState:
    links = scratch(links.select("a", "b").filter("a is not null and b is not null").distinct(), "links")
    keyed, vertices = _vertices(links, state)
    edges = edges_of(links, keyed.withColumnRenamed("key", "name"))
    touch = conflicts = None
    if state.empty_state:
        root = contract(edges, HOOKS["jump"])
    else:
        edges = scratch(edges.filter("a <> b").distinct(), "edges")
        fixed = scratch(vertices.filter("split is not null").select("v", "split"), "fixed")
        # an edge with the split its ends were given; a vertex of another batch may be a hub
        ends = lookup_join(edges, fixed.toDF("a", "sa"), "a", hot_values(edges, "a"), "left")
        ends = scratch(lookup_join(ends, fixed.toDF("b", "sb"), "b", hot_values(edges, "b"), "left").select("a", "b", "sa", "sb"), "ends")
        inner = contract(ends.filter("sa is null and sb is null").select("a", "b"), HOOKS["jump"])
        # which given-out components a new one touches
        across = ends.filter("(sa is null) <> (sb is null)").select(
            F.when(F.col("sa").isNull(), F.col("a")).otherwise(F.col("b")).alias("f"), F.when(F.col("sa").isNull(), F.col("b")).otherwise(F.col("a")).alias("met"), F.coalesce("sa", "sb").alias("split")
        )
        across = scratch(across, "across")
        touch = across if inner is None else relabelled(across, "f", inner, hot_values(across, "f"), keep=True)
        touch = scratch(touch.distinct(), "touch")
        one = touch.groupBy("f").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
        both = scratch(touch.join(one.hint("merge"), "f"), "both")
        direct = ends.filter("sa is not null and sb is not null")
        joins = both.filter("lo = hi").select(F.col("f").alias("a"), F.col("met").alias("b")).unionByName(direct.filter("sa = sb").select("a", "b"))
        outer = contract(joins, HOOKS["jump"])
        clash = both.filter("lo <> hi").select("f", F.lit(QUARANTINE).alias("split"), "met", F.col("split").alias("met_split")).unionByName(direct.filter("sa <> sb").select(F.col("a").alias("f"), F.col("sa").alias("split"), F.col("b").alias("met"), F.col("sb").alias("met_split")))
        conflicts = scratch(clash.distinct(), "clash")
        root = inner if outer is None else outer if inner is None else scratch(relabelled(inner, "r", outer, hot_values(inner, "r"), keep=True).select("v", "r").unionByName(outer.join(inner.select("v").hint("merge"), "v", "left_anti").select("v", "r")), "roots")
    placed = vertices.withColumn("root", F.col("v")) if root is None else vertices.join(root.select("v", F.col("r")).hint("merge"), "v", "left").withColumn("root", F.coalesce("r", "v")).drop("r")
    if conflicts is not None:  # a quarantined component has a split from here on
        placed = placed.join(conflicts.filter(F.col("split") == QUARANTINE).select(F.col("f").alias("root"), F.lit(QUARANTINE).alias("_q")).distinct().hint("merge"), "root", "left")
        placed = placed.withColumn("split", F.when(F.col("split").isNull(), F.col("_q")).otherwise(F.col("split"))).drop("_q")
    placed = scratch(placed, "placed")
    named = F.min(F.struct((~F.col("old")).alias("fresh"), "name"))["name"]
    merged = scratch(placed.groupBy("root").agg(named.alias("component_id"), F.max("split").alias("kept"), F.sum("n_records").alias("n_records"), F.count(F.lit(1)).alias("n")), "merged")
    # what is given out so far, after this batch's growth of existing components
    now = merged.filter("kept is not null").select("component_id", F.col("kept").alias("split"), "n_records")
    if not state.empty_state:
        gone = placed.filter("old").select(F.col("name").alias("component_id"))
        now = now.unionByName(state.components.join(gone.hint("merge"), "component_id", "left_anti").select("component_id", F.when(F.col("n_records") > 0, F.col("split")).alias("split"), "n_records"))
    standing = scratch(now, "standing")
    given = {r[0]: r[1] for r in standing.groupBy("split").agg(F.sum("n_records")).collect()}  # one row a split
    fresh = merged.filter("kept is null and n_records > 0").select("component_id", "n_records")
    none = merged.filter("kept is null and n_records = 0").select("component_id", F.lit(None).cast("string").alias("split"), "n_records")
    in_all = sum(n for s, n in given.items() if s in dict(shares)) + (fresh.agg(F.sum("n_records")).first()[0] or 0)
    deficits = {s: share * in_all - given.get(s, 0) for s, share in shares}
    components = scratch(standing.unionByName(_place(fresh, deficits, seed)).unionByName(none), "components")
    ids = lookup_join(placed, merged.select("root", "component_id"), "root", hot_of_counts(merged, "root"), "inner").select("v", "name", "old", "component_id")
    new_keys = ids.filter("not old").select(F.col("name").alias("key"), "component_id")
    if state.empty_state:
        return SplitState(scratch(new_keys, "keys"), components, state.conflicts)
    ids = scratch(ids, "ids")
    new_keys = ids.filter("not old").select(F.col("name").alias("key"), "component_id")
    moved = ids.filter("old and name <> component_id").select(F.col("name").alias("component_id"), F.col("component_id").alias("now"))
    old_keys = lookup_join(state.keys, moved, "component_id", hot_values(state.keys, "component_id"), "left").select("key", F.coalesce("now", "component_id").alias("component_id"))
    # v of a component is its own; f may be the root of a new one
    at = ids.select("v", "component_id")
    said = conflicts.join(at.toDF("f", "component_id").hint("merge"), "f").join(at.toDF("met", "met_id").hint("merge"), "met").select("component_id", "split", "met_id", "met_split")
    return SplitState(scratch(old_keys.unionByName(new_keys), "keys"), components, scratch(state.conflicts.unionByName(said.distinct()), "conflicts"))


_NOBODY = ("", "unknown", "anonymous", "n/a", "staff")  # fixed values: names that name nobody


def record_links(records: DataFrame, entity_authors: DataFrame) -> DataFrame:
    """Links of records(record_id, family, sources) and entity_authors(source_id, author).

    Keys are r:record, f:family, s:source and a:author. A record is tied to its
    family and its sources, a source to its authors; a record with neither
    family nor source is tied to itself. Authors are the same when they differ
    only in case or white space; names that name nobody link nothing. Repeated
    rows of one id are one record with all their ties; null ids are passed over.
    """
    keys = F.array_compact(
        F.concat(
            F.array(F.concat(F.lit("f:"), "family")),
            F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda s: F.concat(F.lit("s:"), s)),
        )
    )
    own = records.filter("record_id is not null").select(F.concat(F.lit(RECORD), "record_id").alias("a"), keys.alias("keys"))
    ties = own.select("a", F.explode(F.when(F.size("keys") > 0, F.col("keys")).otherwise(F.array("a"))).alias("b"))
    author = F.lower(F.upper(F.trim(F.regexp_replace("author", r"(?U)\s+", " "))))  # upper first, so that ß is ss
    named = entity_authors.select("source_id", author.alias("author")).filter(F.col("source_id").isNotNull() & F.col("author").isNotNull() & ~F.col("author").isin(*_NOBODY))
    written = named.select(F.concat(F.lit("s:"), "source_id").alias("a"), F.concat(F.lit("a:"), "author").alias("b"))
    return ties.unionByName(written)


def record_components(state: SplitState) -> DataFrame:
    """record_id, component_id of all records of the state."""
    return state.keys.filter(F.startswith(F.col("key"), F.lit(RECORD))).select(F.expr(f"substr(key, {len(RECORD) + 1})").alias("record_id"), "component_id")


def record_splits(state: SplitState) -> DataFrame:
    """record_id, component_id and split of all records of the state."""
    own = record_components(state)
    return lookup_join(own, state.components.select("component_id", "split"), "component_id", hot_values(own, "component_id"), "inner").select("record_id", "component_id", "split")


def source_groups(state: SplitState) -> DataFrame:
    """record_id and group_id, the smallest source of its component; records tied to no source give no row."""
    sources = state.keys.filter(F.startswith(F.col("key"), F.lit("s:"))).select("component_id", F.expr("substr(key, 3)").alias("source_id"))
    least = sources.groupBy("component_id").agg(F.min("source_id").alias("group_id"))
    own = record_components(state)
    return lookup_join(own, least, "component_id", hot_values(own, "component_id"), "inner").select("group_id", "record_id")
