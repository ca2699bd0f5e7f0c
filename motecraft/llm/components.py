"""Connected components of an undirected graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """`node`, `component` (the smallest node reachable) for every node of `edges` (`a`, `b`).

    Each round points every node at the smallest node next to it, follows that pointer once more, and replaces the ends
    of the edges by what they point at; edges within one node vanish and equal ones merge, until none is left. Rounds are
    written to the shared folder, so that neither lineage nor a lost executor undoes them, and nothing but "is it empty"
    comes to the driver.
    """
    left = materialize(_between(edges))
    pairs = left.select(F.col("a").alias("node"), F.col("b").alias("near"))
    found = None
    while not left.isEmpty():
        pairs = left.select(F.col("a").alias("node"), F.col("b").alias("near")).union(left.select("b", "a"))
        first = materialize(pairs.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("to")))
        second = first.select(F.col("node").alias("to"), F.col("to").alias("further"))
        pointer = materialize(first.join(second, "to").select("node", F.col("further").alias("to")))
        a, b = (pointer.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        left = materialize(_between(left.join(a, "a").join(b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))))
        if found is None:
            found = pointer.select("node", F.col("to").alias("component"))
        else:
            moved = pointer.select(F.col("node").alias("component"), "to")
            found = materialize(found.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
    return pairs.select("node", F.col("near").alias("component")) if found is None else found


def _between(edges: DataFrame) -> DataFrame:
    """Distinct edges between different nodes, the smaller end first."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
