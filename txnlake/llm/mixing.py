"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document has a key -ln(u) / w, with u a hash of its id in (0, 1) and w its quality weight. A source gives
as many whole epochs as its target holds; the rest of its budget goes to the documents with the smallest keys,
whose sizes are summed in key order until the budget is met. Keys are uniform after the map 1 - exp(-key), so
sums by bucket find where a source is cut, and only that one bucket is ever sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txnlake.llm.common import unit_hash, whole_row, word_count
from txnlake.plans.groups import durable

#: Weights of the sources in code-point order, repeated for as many sources as there are.
PATTERN = (5.0, 2.0, 1.0)
#: No source is taken more often than this.
MAX_EPOCHS = 3
SEED = "mix-1"
#: Buckets of sample keys for each source; one of them is sorted.
BUCKETS = 16_384
#: Characters of markup noise, which lower a document's quality weight.
NOISE = "#*$%&|<>"
LEAST_WEIGHT = 0.05
#: Plans of up to this many sources, one small row each, are sent to all executors; longer ones are joined.
BROADCAST_SOURCES = 50_000


def quality_weight(text: Column, size: Column) -> Column:
    """Words for each word or noise character, at least ``LEAST_WEIGHT``; 1 for texts without words."""
    noise = F.char_length(text) - F.char_length(F.translate(text, NOISE, ""))
    weight = size / (size + F.coalesce(noise, F.lit(0)))
    return F.when(size > 0, F.greatest(weight, F.lit(LEAST_WEIGHT))).otherwise(F.lit(1.0))


def share_out(rows: list[tuple[str | None, int]], pattern=PATTERN, most: int = MAX_EPOCHS) -> list[tuple[str | None, int, float]]:
    """(source, size, target) of sources with sizes: all sizes shared by weight, none above ``most`` times its own.

    What a full source can't take is shared among the others by weight, until none is above.
    """
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    weights = [pattern[i % len(pattern)] for i in range(len(rows))]
    target, free, left = [0.0] * len(rows), set(range(len(rows))), float(sum(n for _, n in rows))
    while free:
        whole = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / whole > most * rows[i][1]]
        if not full:
            for i in free:
                target[i] = left * weights[i] / whole
            break
        for i in full:
            target[i] = float(most * rows[i][1])
        left -= sum(target[i] for i in full)
        free -= set(full)
    return [(s, n, t) for (s, n), t in zip(rows, target, strict=True)]


def keyed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with size, key and bucket of every row, as columns _size, _key, _bucket."""
    size = word_count(F.col("text"))
    with_size = docs.withColumn("_size", size)
    weight = quality_weight(F.col("text"), F.col("_size"))
    out = with_size.withColumn("_key", -F.log(unit_hash(F.col("doc_id"), seed)) / weight)
    return out.withColumn("_bucket", F.least(((1 - F.exp(-F.col("_key"))) * BUCKETS).cast("int"), F.lit(BUCKETS - 1)))


def cuts(slim: DataFrame) -> tuple[DataFrame, bool]:
    """The plan and whether it is short: one row for each source of ``slim`` (source, doc_id, _size, _key, _bucket): source_size, target, epochs, cut.

    ``cut`` is the (key, doc_id) of the last document that the fraction of an epoch takes; null takes none. The
    document at the edge is taken if that brings the source nearer to its target. Documents with equal key and
    id are taken together.
    """
    spark = slim.sparkSession
    # One row for each source reaches the driver: as many as there are names of sources.
    sizes = [(r["source"], r["n"] or 0) for r in slim.groupBy("source").agg(F.sum("_size").alias("n")).collect()]
    plan = [(s, n, t, min(MAX_EPOCHS, math.floor(t / n)) if n else 0) for s, n, t in share_out(sizes)]
    plan = [(*p, p[2] - p[1] * p[3]) for p in plan]
    few = len(plan) <= BROADCAST_SOURCES
    goal = spark.createDataFrame(plan, "source string, source_size long, target double, epochs int, budget double")
    small = F.broadcast if few else (lambda df: df)

    sums = slim.groupBy("source", "_bucket").agg(F.sum("_size").alias("n"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))  # at most BUCKETS rows a source
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    edge = (
        sums.join(small(goal), same(sums, goal))
        .filter((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("n") > F.col("budget")))
        .groupBy(sums["source"]).agg(F.min_by(F.struct("_bucket", "before"), "_bucket").alias("e"))
        .select(F.col("source").alias("edge_source"), F.col("e._bucket").alias("edge_bucket"), F.col("e.before").alias("edge_before"))
    )
    at_edge = slim.join(small(edge), slim["source"].eqNullSafe(edge["edge_source"]) & (slim["_bucket"] == edge["edge_bucket"]))
    at_edge = at_edge.groupBy("source", "edge_before", "_key", "doc_id").agg(F.sum("_size").alias("n"))
    upto = Window.partitionBy("source").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = at_edge.withColumn("sum", F.col("edge_before") + F.sum("n").over(upto))
    taken = at_edge.join(small(goal.select(F.col("source").alias("s"), "budget")), at_edge["source"].eqNullSafe(F.col("s")))
    taken = taken.filter(F.col("sum") - F.col("n") / 2 <= F.col("budget")).groupBy("source").agg(F.max(F.struct("_key", "doc_id")).alias("last"))
    taken = taken.withColumnRenamed("source", "taken_source")
    out = goal.join(edge.drop("edge_before"), goal["source"].eqNullSafe(edge["edge_source"]), "left")
    whole = out.join(taken, out["source"].eqNullSafe(taken["taken_source"]), "left")
    return whole.select(F.col("source").alias("_source"), "source_size", "target", "epochs", "edge_bucket", "last"), few


def copies(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """``rows`` (with _key, _bucket) with source_size, target and _copies, how often the mix takes a row."""
    joined = rows.join(F.broadcast(plan) if few else plan, rows["source"].eqNullSafe(plan["_source"]))
    own, last = F.struct(F.col("_key"), F.col("doc_id")), F.struct(F.col("last._key"), F.col("last.doc_id"))
    below = (F.col("_bucket") < F.col("edge_bucket")) | (
        (F.col("_bucket") == F.col("edge_bucket")) & F.col("last").isNotNull() & (own <= last))
    once = F.when(F.col("epochs") >= MAX_EPOCHS, 0).otherwise(F.when(F.coalesce(below, F.lit(False)), 1).otherwise(0))
    return joined.withColumn("_copies", F.col("epochs") + once).drop("_source", "epochs", "edge_bucket", "last")


def mix_table(docs: DataFrame) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken.

    Null texts have size 0 and are taken with size 0. Null ids share one key, and are taken together. A null
    source is a source, the last one. An empty table gives an empty result; a source without words gets target 0.
    """
    slim = durable(keyed(docs.select("doc_id", "source", "text")).select("doc_id", "source", "_size", "_key", "_bucket"))
    return copies(slim, *cuts(slim)).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` with its columns, each as often as the mix takes it."""
    slim = durable(keyed(docs.select("doc_id", "source", "text")).select("doc_id", "source", "_size", "_key", "_bucket"))
    rows = copies(keyed(docs.select(whole_row(docs), "doc_id", "source", "text")), *cuts(slim)).filter(F.col("_copies") > 0)
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
