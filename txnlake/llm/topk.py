"""Exact top-k inner products by the threshold algorithm over sorted lists, one for each dimension.

Vectors are dealt into blocks of bounded size, and each block gets its sorted lists once. A query walks the lists
of a block from the end that its component favours, a stretch of ranks at a time, scores every vector it meets
in full, and stops when the bound of what it hasn't met, the sum over dimensions of the query's component times
the value where its walk stands, can't beat its kth best score. Queries visit blocks in rounds: all of them one
block first, then the others with the kth score they already have, so most walks are short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txnlake.plans.groups import durable

SCALE = 256
#: Vectors in a block, and queries that a task brings to one.
BLOCK, QUERIES = 8_192, 512
#: Ranks of the first stretch of a walk; each next one is twice as long.
STRETCH = 64
#: Whole numbers below this are exact in a double, and so are sums of products below it.
EXACT = 2**53


class Lists:
    """The sorted lists of a block of whole-number vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.ranked = np.argsort(self.vectors, axis=0, kind="stable")  # ascending, by dimension
        self.values = np.take_along_axis(self.vectors, self.ranked, axis=0)

    def best(self, query: np.ndarray, own: int | None, k: int, floor: float) -> tuple[list[int], list[int]]:
        """Scores and ids of the ``k`` best vectors of the block other than ``own``; those below ``floor`` may be left out."""
        n, dims = self.vectors.shape
        seen = np.zeros(n, dtype=bool)
        if own is not None:
            seen[np.searchsorted(self.ids, own, "left"):np.searchsorted(self.ids, own, "right")] = True
        used = np.flatnonzero(query != 0)
        up = query[used] > 0
        scores, rows = np.zeros(0, dtype=query.dtype), np.zeros(0, dtype=np.int64)
        depth, stretch = 0, STRETCH
        while depth < n:
            if not len(used):
                fresh = np.flatnonzero(~seen)  # all scores are 0
                depth = n
            else:
                end = min(n, depth + stretch)
                high, low = used[up], used[~up]
                met = np.zeros(n, dtype=bool)
                met[self.ranked[n - end:n - depth, high].reshape(-1)] = True
                met[self.ranked[depth:end, low].reshape(-1)] = True
                fresh = np.flatnonzero(met & ~seen)
                depth, stretch = end, 2 * stretch
            seen[fresh] = True
            scores = np.concatenate([scores, self.vectors[fresh] @ query])
            rows = np.concatenate([rows, fresh])
            keep = np.lexsort((rows, -scores))[:k]
            scores, rows = scores[keep], rows[keep]
            if depth < n:
                bound = (query[used] * np.where(up, self.values[n - depth, used], self.values[depth - 1, used])).sum()
                least = max(floor, scores[-1]) if len(scores) == k else floor
                # What ties with the kth score may still win by its id, so only a smaller bound ends the walk.
                if bound < least:
                    break
        return [int(x) for x in scores], self.ids[rows].tolist()


def _numbers(lists: list, dims: int) -> np.ndarray:
    """Rows of equal length, shorter vectors filled up with 0; whole numbers in doubles where that is exact."""
    out = np.zeros((len(lists), dims))
    for i, v in enumerate(lists):
        out[i, :len(v)] = v
    return out


def _block_best(k: int):
    def work(_, vectors: Iterator[pd.DataFrame] | pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(vectors) or not len(queries):
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        dims = max(map(len, [*vectors.v, *queries.v]))
        block, asked = _numbers(list(vectors.v), dims), _numbers(list(queries.v), dims)
        top = float(np.abs(block).max(initial=0)) * float(np.abs(asked).max(initial=0)) * max(1, dims)
        if top >= EXACT:  # Python's whole numbers
            whole = np.frompyfunc(int, 1, 1)
            block, asked = whole(block), whole(asked)
        lists = Lists(vectors.vec_id.to_numpy(), block)
        out = []
        for i, (query_id, floor) in enumerate(zip(queries.vec_id, queries.floor, strict=True)):
            scores, ids = lists.best(asked[i], query_id, k, -math.inf if math.isnan(floor) else floor)
            out += [(query_id, v, max(-(2**63), min(2**63 - 1, s))) for s, v in zip(scores, ids, strict=True)]
        return pd.DataFrame(out, columns=names).astype("int64")

    return work


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def whole_vectors(df: DataFrame, vector: str) -> DataFrame:
    """vec_id and ``v``, floor(256 * x) of every component; vectors null or with null or non-finite components are left out."""
    x = F.col(vector).cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf)))
    return df.filter(F.col("vec_id").isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE).cast("double")).alias("v"))


def top_k(df: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The ``k`` best inner products of each query row against all rows of other ids: query_id, rank, vec_id, score.

    ``df`` needs vec_id and ``vector``; ``is_query`` is a condition on vec_id. Ties go to the smaller vec_id. Rows
    without an id or a usable vector take no part; vectors of unequal length are compared as if filled up with
    0. Of repeated ids each row is a candidate, and a repeated query id is one query, its smallest vector. Scores
    beyond a long are its ends.
    """
    rows = whole_vectors(df, vector)
    total = rows.count()
    blocks = max(1, math.ceil(total / block))
    # Placed by a hash of the whole row: blocks are near equal whatever repeats, and reruns agree.
    placed = durable(rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v", F.lit("block")), F.lit(blocks)).cast("int")))
    queries = placed.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    # Queries come to each block in parts of bounded size.
    parts = max(1, math.ceil(queries.count() / QUERIES))
    queries = durable(queries.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), F.lit(parts)).cast("int")))

    def visit(asked: DataFrame, wanted: DataFrame) -> DataFrame:
        """Best of every block for the queries that visit it; ``asked``: vec_id, v, part, floor, block."""
        vectors = placed.join(wanted, "block").select("vec_id", "v", "block", "part")
        return vectors.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(
            _block_best(k), "query_id long, vec_id long, score long")

    spark = df.sparkSession
    none = F.lit(None).cast("double").alias("floor")
    home = F.pmod(F.col("part"), F.lit(blocks)).cast("int")
    pairs = spark.range(parts).select(F.col("id").cast("int").alias("part"))
    first = durable(_ranked(visit(queries.select("vec_id", "v", "part", none, home.alias("block")), pairs.select("part", home.alias("block"))), k))
    if blocks == 1:
        found = first
    else:
        floors = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
        others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        asked = queries.join(floors, "vec_id", "left").select("vec_id", "v", "part", "floor", others).filter(F.col("block") != home)
        rest = visit(asked, pairs.select("part", others).filter(F.col("block") != home))
        found = _ranked(first.select("query_id", "vec_id", "score").unionByName(rest), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
