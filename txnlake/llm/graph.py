"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlake.llm.common import beside
from txnlake.plans.groups import durable


def _to_roots(parents: DataFrame, rows: int) -> DataFrame:
    """``parents`` (node, up; up <= node, roots point at themselves; ``rows`` at most) with every node pointing at its root.

    Each step doubles the length of the ways, so a chain of n nodes takes log2(n) steps.
    """
    while True:
        up = parents.select(F.col("node").alias("mid"), F.col("up").alias("over"))
        stepped = durable(parents.join(beside(up, rows), F.col("up") == F.col("mid")).select("node", "up", "over"))
        moved = not stepped.filter("over < up").isEmpty()
        parents = stepped.select("node", F.col("over").alias("up"))
        if not moved:
            return parents


def components(links: DataFrame) -> DataFrame:
    """Smallest node of the component of every node in ``links`` (a, b): columns node, label.

    Every node hooks onto its smallest neighbour, hooks are followed to their roots, and what links different
    roots is worked on further; every round at least halves the components that aren't done. All is joins and
    grouped minima of the links, so a hub is summed up before the shuffle, and nothing is gathered but tables of few rows.
    """
    edges = durable(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels, rows = None, edges.count()  # every node is an end of a row of ``edges``, so none of the tables has more
    while labels is None or rows:
        hooks = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        roots = _to_roots(durable(hooks.select("node", F.least("node", "low").alias("up"))), rows)
        if labels is None:
            labels = roots.withColumnRenamed("up", "label")
        else:
            moved = labels.join(beside(roots, rows), F.col("label") == roots["node"], "left")
            labels = durable(moved.select(labels["node"], F.coalesce("up", "label").alias("label")))
        left = roots.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        right = roots.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        between = edges.join(beside(left, rows), "a").join(beside(right, rows), "b").filter("ra <> rb")
        edges = durable(between.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        rows = edges.count()
    return labels
