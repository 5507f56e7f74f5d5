"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def connected_components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    In each round every node points to its smallest neighbour, pointers are followed once
    more, and the graph is contracted along them; paths shrink by two thirds a round. Every
    round's tables are written, so a lost executor costs one round at most.
    """
    edges = work.save(edges.where("a <> b").select("a", "b").distinct(), f"{name}-edges-0")
    labels, step = None, 0
    while not edges.isEmpty():
        step += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        far = near.select(F.col("node").alias("to"), F.col("to").alias("on"))
        jump = work.save(near.join(far, "to").select("node", F.col("on").alias("to")), f"{name}-jump-{step}")
        side = lambda c: jump.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        next_edges = (
            edges.join(side("a"), "a").join(side("b"), "b")
            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
            .where("a <> b").distinct()
        )
        edges = work.save(next_edges, f"{name}-edges-{step}")
        if labels is None:  # all nodes have an edge in the first round
            labels = jump.select("node", F.col("to").alias("component"))
        else:
            moved = labels.join(side("component"), "component", "left")
            moved = moved.select("node", F.coalesce("component_to", "component").alias("component"))
            labels = work.save(moved, f"{name}-labels-{step}")
            work.drop(f"{name}-edges-{step - 1}")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
