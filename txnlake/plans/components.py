"""Connected components of links, by stars in rounds.

Every round links the neighbours of a node to its smallest neighbour, first the greater ones, then the smaller ones. The
least node of a component draws near by doubling, so a chain of n nodes takes about log2(n) rounds. A round is two grouped
minima, which are summed up before the shuffle, and two joins; nothing is gathered, whatever the size of a hub.

Before the first round each task joins up what its own links connect, some at a time. Only the smallest nodes of these
pieces, where two pieces have a node in common, go through the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlake.plans.groups import durable


def _stars(links: DataFrame) -> DataFrame:
    """Every node's greater neighbours, linked to the smallest of all of its neighbours and itself."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low"))
    greater = both.filter("b > a").join(least, "a")
    return greater.select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()


def _small_stars(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node itself, linked to the smallest of them; ``links`` have a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("low"))
    smaller = links.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return smaller.union(least.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()


#: Links that a task joins up at a time.
LINKS_AT_ONCE = 500_000


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of some links with the smallest node that they connect it to."""
    root: dict[int, int] = {}
    count = 0

    def find(x: int) -> int:
        up = root.setdefault(x, x)
        while up != root[up]:
            root[x] = root[up]
            x, up = up, root[root[up]]
        return up

    def told() -> pa.RecordBatch:
        nodes = list(root)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            if a < b:
                root[b] = a
            else:
                root[a] = b
        count += batch.num_rows
        if count >= LINKS_AT_ONCE:
            yield told()
            root.clear()
            count = 0
    if root:
        yield told()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: list | None = None) -> DataFrame:
    """The smallest node of its component for every node that ``links`` (a, b; any order) name: columns node, label.

    ``rounds``, a list, gets one entry for each round.
    """
    pieces = durable(links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_pieces, "node long, root long"))
    low = durable(pieces.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high")))
    # Pieces meet in the nodes that have more than one root.
    shared = pieces.join(low.filter("low < high").select("node", "low"), "node")
    now = durable(shared.filter("root > low").select(F.col("root").alias("a"), F.col("low").alias("b")).distinct())
    mark, before = _mark(now), None
    while mark != before:
        before = mark
        now = durable(_small_stars(_stars(now)))
        mark = _mark(now)
        if rounds is not None:
            rounds.append(mark)
    labels = now.groupBy(F.col("a").alias("low")).agg(F.min("b").alias("label"))
    return durable(low.join(labels, "low", "left").select("node", F.coalesce("label", "low").alias("label")))
