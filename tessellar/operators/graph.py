"""Edge tables: connected components, longest-path ranks, duplicate groups, derived relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_ws
from ..sources.shared import cut, discard

MAX_ROUNDS = 60


def _lowered(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the smallest of u's partners and u."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): each node with an edge, and the smallest node it reaches either way.

    Alternating large and small stars. Minima are combined on the map side and joined back, so a hub's edges stay
    spread (adaptive execution splits a hot join key). Each round's edges are written to the shared folder.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = cut(now, "edges"), None
    for _ in range(MAX_ROUNDS):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _lowered(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _lowered(large)
        small = near.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        old, now = now, cut(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        discard(old)
        # order-free digest of the edge set
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == mark:
            break
        mark = (seen["n"], seen["s"])
    else:
        raise RuntimeError("components did not settle")
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def ranks(edges: DataFrame, bound: int | None = None) -> DataFrame:
    """edges (older, newer) -> (node, rank): steps of the longest path that leads to it. Each turn relaxes all edges at
    once, until nothing changes. No rank exceeds the nodes of its component (so a cycle ends), nor `bound` if given."""
    nodes = edges.select(F.col("older").alias("node")).unionByName(edges.select(F.col("newer").alias("node"))).distinct()
    if bound is None:
        parts = components(edges.select(F.col("older").alias("a"), F.col("newer").alias("b")))
        sizes = parts.join(parts.groupBy("component").agg(F.count("*").alias("most")), "component").select("node", "most")
        limits = nodes.join(sizes, "node", "left").withColumn("most", F.coalesce("most", F.lit(1).cast("bigint")))
    else:
        limits = nodes.withColumn("most", F.lit(bound).cast("bigint"))
    now = cut(limits.withColumn("rank", F.lit(0).cast("bigint")), "ranks")
    while True:
        step = edges.join(now, edges["older"] == now["node"]).groupBy(F.col("newer").alias("node")).agg((F.max("rank") + 1).alias("r"))
        new = cut(now.join(step, "node", "left").select("node", "most", F.least(F.greatest("rank", F.coalesce("r", F.lit(0))), "most").alias("rank")), "ranks")
        changed = new.join(now.select("node", F.col("rank").alias("was")), "node").filter("rank <> was").limit(1).count()
        discard(now)
        now = new
        if not changed:
            return now.select("node", "rank")


def linked_duplicates(rows: DataFrame, key: Column, identity: str) -> DataFrame:
    """(identity, primary, copies): every member of a group of equals keeps its row and names the smallest member."""
    k = rows.select(F.col(identity), F.sha2(key, 256).alias("k"))
    groups = k.groupBy("k").agg(F.min(identity).alias("primary"), F.count("*").alias("copies")).filter("copies > 1")
    return k.join(groups, "k").select(identity, "primary", "copies")


def same_content(rows: DataFrame, text: str, identity: str) -> DataFrame:
    return linked_duplicates(rows, norm_ws(F.col(text)), identity)


def mirrored(edges: DataFrame) -> DataFrame:
    """supersedes edges (a, b) and their superseded_by mirrors, no self relations: (from_id, to_id, relation)."""
    e = edges.filter("a <> b").distinct()
    return e.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit("supersedes").alias("relation")).unionByName(e.select(F.col("b").alias("from_id"), F.col("a").alias("to_id"), F.lit("superseded_by").alias("relation")))


def status_from_edges(nodes: DataFrame, relations: DataFrame, identity: str) -> DataFrame:
    """superseded where a node stands on the from side of a superseded_by edge, else as it was."""
    gone = relations.filter("relation = 'superseded_by'").select(F.col("from_id").alias(identity), F.lit(True).alias("_gone")).distinct()
    return nodes.join(gone, identity, "left").withColumn("version_status", F.when(F.col("_gone"), "superseded").otherwise(F.col("version_status"))).drop("_gone")


def orphans(files: DataFrame, roots: list[DataFrame], on: str) -> DataFrame:
    """Files that no root refers to."""
    out = files
    for r in roots:
        out = out.join(r.select(on).distinct(), on, "left_anti")
    return out
