"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins over the edge table, written to
the shared folder; no component is ever gathered in one place, and a node with
very many edges is only the hot side of a join that adaptive execution splits.

The driver plans, tracks and keeps for a while what every query exchanges or
broadcasts, so there are few queries: edges that are stars already take no round,
and known components are joined, not found again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _minimum(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _shape(edges: DataFrame) -> tuple[int, int]:
    """Nodes of ``edges(u, v)``, and those among them that keep the edges from being stars around their ``v``."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("n"))
    return tuple(nodes.agg(F.count("*"), F.count_if(F.col("n") > 1)).first())


def connected_components(edges: DataFrame, scratch: Scratch, labels: DataFrame | None = None) -> DataFrame:
    """``edges(a, b)`` to ``(node, label)``: label is the smallest node reachable.

    Only nodes that an edge to another node touches are returned.  Repeated
    edges, self-loops and an empty table are allowed; edges with a null end are
    ignored.  ``labels``: the result for other edges, which count as well.
    """
    if labels is not None:
        for end in ("a", "b"):
            known = labels.select(F.col("node").alias(end), F.col("label").alias("l"))
            edges = edges.join(known, end, "left").withColumn(end, F.coalesce("l", end)).drop("l")
    now = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", few=True
    )
    nodes, wrong = _shape(now)
    if labels is not None and not nodes:
        return labels
    while wrong:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _minimum(both)
        # large-star: neighbours above u move to the smallest node around u
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.where("u <> v").distinct()
        # small-star: u and its neighbours below move to the smallest of them
        low = _minimum(large)
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = scratch.save(small, "edges", few=True)
        scratch.drop(now)
        now = after
        _, wrong = _shape(now)
    found = now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
    if labels is None:
        return found
    # the nodes found are labels, or nodes that no edge touched before
    nodes = labels.unionByName(found.select("node", F.col("node").alias("label"))).distinct()
    moved = found.select(F.col("node").alias("label"), F.col("label").alias("new"))
    return scratch.save(nodes.join(moved, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "components", few=True)
