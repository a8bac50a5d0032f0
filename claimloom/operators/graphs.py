"""Edges, degrees, short cycles, hyperedges and context transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_out, n_in of edges(src, dst); null ends count for nobody."""
    ends = edges.filter("src is not null").select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.filter("dst is not null").select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def two_cycles(edges: DataFrame) -> DataFrame:
    """a, b with a < b that point at each other; edges(src, dst) distinct."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.filter("src < dst").join(back, ["src", "dst"]).select(F.col("src").alias("a"), F.col("dst").alias("b"))


def triangles(edges: DataFrame) -> DataFrame:
    """a, b, c of every directed cycle of three, once, its least node first.

    Only edges whose ends have both an edge in and one out can close a cycle,
    so the two-path join starts from those.
    """
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    ab = e.toDF("a", "b").filter("a < b")
    bc = e.toDF("b", "c")
    ca = e.toDF("c", "a")
    return ab.join(bc, "b").filter("a < c").join(ca, ["c", "a"]).select("a", "b", "c")


def expand_hyperedges(rows: DataFrame, key: str, members: str) -> DataFrame:
    """key, src, dst: both directions between the distinct members of each row's array, which is one record's own."""
    m = F.array_distinct(F.filter(F.col(members), lambda x: x.isNotNull()))
    own = rows.select(key, m.alias("m")).filter(F.size("m") >= 2)
    return own.select(key, "m", F.explode("m").alias("src")).select(key, "src", F.explode(F.filter("m", lambda x: x != F.col("src"))).alias("dst"))


def graph_nodes(capsules: DataFrame) -> DataFrame:
    """record_id, node_type, node_id: a node for the record's claim, context, family and publication time."""
    nodes = F.array(*[F.struct(F.lit(kind).alias("node_type"), F.col(c).cast("string").alias("node_id")) for kind, c in (("claim", "ids.capsule_id"), ("context", "ids.context_id"), ("family", "ids.claim_family_id"), ("state", "ids.claim_state_id"))])
    return capsules.select(F.col("ids.capsule_id").alias("record_id"), F.explode(nodes).alias("n")).select("record_id", "n.*")


def transitions(rows: DataFrame, batch: str, key: str, fields: list[str]) -> DataFrame:
    """batch, src, dst, changed: for each ordered pair of a batch (a bounded number of rows) the first field in which they differ; pairs that agree in all give none."""
    a = rows.select(batch, F.col(key).alias("src"), *[F.col(f).alias(f"{f}_a") for f in fields])
    b = rows.select(batch, F.col(key).alias("dst"), *[F.col(f).alias(f"{f}_b") for f in fields])
    changed = F.coalesce(*[F.when(~F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b")), F.lit(f)) for f in fields])
    return a.join(b, batch).filter("src <> dst").select(batch, "src", "dst", changed.alias("changed")).filter("changed is not null")


# The edges that tie a record's claim to what it belongs to.
STAR = (("claim_context", "ids.context_id"), ("claim_family", "ids.claim_family_id"), ("claim_state", "ids.claim_state_id"))


def star_edges(capsules: DataFrame) -> DataFrame:
    """record_id, edge_type, src, dst: three edges from each record's claim to its context, family and state; a null end gives none."""
    edges = F.array(*[F.struct(F.lit(kind).alias("edge_type"), F.col(c).cast("string").alias("dst")) for kind, c in STAR])
    own = capsules.select(F.col("ids.capsule_id").alias("record_id"), F.explode(edges).alias("e")).filter("e.dst is not null and record_id is not null")
    return own.select("record_id", "e.edge_type", F.col("record_id").alias("src"), "e.dst")


def incidence(rows: DataFrame, key: str, members: str) -> DataFrame:
    """hyperedge, node, role of each row's distinct members in order, role being the place; rows of fewer than two members are no hyperedges."""
    m = F.array_distinct(F.filter(F.col(members), lambda x: x.isNotNull()))
    own = rows.select(F.col(key).alias("hyperedge"), m.alias("m")).filter(F.size("m") >= 2)
    return own.select("hyperedge", F.posexplode("m").alias("role", "node")).select("hyperedge", "node", "role")


#: loops that a batch keeps
LOOPS = 128


def loops_of_batches(loops: DataFrame, batch: str, order: list[str], most: int = LOOPS) -> DataFrame:
    """The first `most` loops of each batch by order, which should leave no ties; the limit is the feature, and applied before the shuffle too."""
    w = W.partitionBy(batch).orderBy(*order)
    return loops.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")
