"""Connected components by contraction, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.shared import cut, packed


def components(edges: DataFrame, rounds: int = 60, most: int = 1 << 20) -> DataFrame:
    """node, component for each node of the edges (a, b: long); component is one of its nodes.

    Each round, a node joins the node of lowest hashed rank within two steps (a star falls together
    at once), and the edges are redrawn between those joined; a hash with another seed each round
    makes the number of rounds logarithmic. Neither a node's neighbours nor a component are ever
    gathered: hot nodes are minima with partial aggregation. What each round leaves goes to the
    checkpoint folder, in parts as its rows ask for; what it looks up is broadcast if it can have
    `most` rows at most, else shuffled.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, first = None, 0
    for k in range(rounds):
        n = edges.count()
        if not n:
            break
        first = first or n
        edges = packed(edges, n)
        looked = F.broadcast if 2 * n <= most else lambda df: df  # an edge has two nodes
        rank = F.struct(F.xxhash64("b", F.lit(k)).alias("rank"), F.col("b").alias("node"))
        both = edges.select(F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")])))
        near = packed(both.groupBy("a").agg(F.min(rank).alias("m")).withColumnRenamed("a", "b"), 2 * n)
        joins = cut(packed(both.join(looked(near), "b").groupBy("a").agg(F.min("m").alias("m")).select(F.col("a").alias("node"), F.col("m.node").alias("to")), 2 * n))
        to = lambda c: looked(joins.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")))
        edges = edges.join(to("a"), "a").join(to("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).where("a <> b").distinct()
        edges = cut(packed(edges, n))
        if labels is None:
            labels = joins.withColumnRenamed("to", "component")
        else:
            labels = labels.join(to("component"), "component", "left").select("node", F.coalesce("component_to", "component").alias("component"))
            labels = cut(packed(labels, 2 * first))
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("a").alias("component")) if labels is None else labels
