"""Connected components of a link table, as joins and aggregations that cut their lineage in each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _roots(parents: DataFrame) -> DataFrame:
    """Pointers followed to their ends: each round doubles the distance. Pointers lead to smaller numbers, so they end."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = written(parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), (F.coalesce("grand", "parent") != F.col("parent")).alias("moved")), "roots")
        discard(parents)
        parents = jumped.drop("moved")
        parents.scratch = jumped.scratch
        if jumped.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node reachable, itself included.

    In each round every node points to its smallest neighbour if that is smaller, pointers are followed to their
    ends, and links are replaced by links between the ends. Nodes with links halve at least, so rounds grow as the
    logarithm of the number of nodes. Only aggregations and joins: a node with very many links is pre-aggregated.
    """
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    labels = None
    while labels is None or not links.isEmpty():
        both = links.union(links.select("b", "a")).toDF("node", "other")
        parents = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent"))
        parents = _roots(written(parents, "parents"))
        if labels is None:
            labels = written(parents.select("node", F.col("parent").alias("root")), "labels")
        else:
            step = parents.select(F.col("node").alias("root"), F.col("parent").alias("to"))
            old, labels = labels, written(labels.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
            discard(old)
        ends = links
        for c in ("a", "b"):
            ends = ends.join(parents.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_end")), c)
        old, links = links, written(ends.where("a_end != b_end").select(F.least("a_end", "b_end").alias("a"), F.greatest("a_end", "b_end").alias("b")).distinct(), "links")
        discard(old, parents)
    return labels
