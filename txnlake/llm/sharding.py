"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns points on a ring. A row starts at the first point clockwise of the hash of its key; a shard that
has reached its bound passes what still comes to the next point clockwise. How many rows of which arc a full
shard passes on depends on counts only, so the ring is settled on one count for each arc (a bounded number,
whatever the input), and each row then looks up its rank in its arc.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txnlake.llm.common import q, whole_row

#: Virtual nodes of a shard. More points make the shards' arcs more alike, so fewer rows overflow.
VNODES = 128
#: The points lie on 2 ** POINT_BITS places, which cut the ring into arcs.
POINT_BITS = 16
#: Arcs are halved until one holds about this many rows; ranking an arc is one task's work.
ROWS_PER_ARC = 200_000


def ring_points(shards: int, vnodes: int) -> dict[int, int]:
    """Place on the ring -> shard. Where two virtual nodes meet, the smaller shard stays, so that a new one takes nothing there."""
    points: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.md5(f"shard-{shard}-{v}".encode()).digest()
            points.setdefault(int.from_bytes(digest[:8], "big") >> (64 - POINT_BITS), shard)
    return points


def settle(counts: dict[int, int], points: dict[int, int], bounds: list[int], more_bits: int = 0) -> list[tuple[int, int, int, int, int]]:
    """Run the ring on counts of rows by arc: (arc, first rank, end rank, shard, first slot) of every piece.

    All that waits at a point is offered to its shard in ring order; what exceeds the bound goes on to the next
    point clockwise in the next round. If the bounds add up to the rows, a lap places everything.
    """
    places = sorted(points)
    owners = [points[p] for p in places]
    used, out, at = [0] * len(bounds), [], 0
    waiting: dict[int, list[tuple[int, int, int]]] = {}
    for arc in sorted(counts):
        while at < len(places) and places[at] < arc >> more_bits:
            at += 1
        waiting.setdefault(at % len(places), []).append((arc, 0, counts[arc]))
    while waiting:
        moved: dict[int, list[tuple[int, int, int]]] = {}
        for point in sorted(waiting):
            shard = owners[point]
            for arc, lo, hi in sorted(waiting[point]):
                take = min(hi - lo, bounds[shard] - used[shard])
                if take:
                    out.append((arc, lo, lo + take, shard, used[shard]))
                    used[shard] += take
                if lo + take < hi:
                    moved.setdefault((point + 1) % len(owners), []).append((arc, lo + take, hi))
        waiting = moved
    return out


def assign_shards(
    df: DataFrame, key: str, shards: int, ties: list[str] = (), vnodes: int = VNODES, slack: float = 0.0, rows_per_arc: int = ROWS_PER_ARC
) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    With ``slack`` 0 the bounds of the shards add up to the rows exactly: counts are at most one apart. With
    ``slack`` s a shard takes up to ceil((1 + s) * rows / shards).

    Rows of an arc are ranked by position, key and then ``ties``; rows equal in all of these are interchangeable.
    Null keys share one position. An empty table gives an empty result. Columns named shard or slot are replaced.
    The driver gets one count for each arc: 2 ** 16, or rows / ``rows_per_arc`` if that is more.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    total = df.count()
    more = max(0, math.ceil(math.log2(max(1, total / rows_per_arc))) - POINT_BITS)

    def arc_of(position: Column) -> Column:
        return F.shiftrightunsigned(position, 64 - POINT_BITS - more).cast("long")

    hashed = F.xxhash64(F.col(q(key)))
    counts = {r["arc"]: r["count"] for r in df.select(arc_of(hashed).alias("arc")).groupBy("arc").count().collect()}
    share, over = divmod(total, shards)
    bounds = [share + (s < over) for s in range(shards)] if slack == 0 else [math.ceil((1 + slack) * total / shards)] * shards
    pieces = spark.createDataFrame(
        settle(counts, ring_points(shards, vnodes), bounds, more), "piece_arc long, lo long, hi long, shard int, base long")

    rows = df.select(whole_row(df), hashed.alias("pos")).withColumn("arc", arc_of(F.col("pos")))
    order = Window.partitionBy("arc").orderBy("pos", *[F.col("_row")[c] for c in (key, *ties)])
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    # The pieces are bounded by the arcs, not by the rows.
    on = (F.col("arc") == F.col("piece_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return ranked.join(F.broadcast(pieces), on).select("_row.*", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Documents in ``shards`` shards of equal counts: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Null texts count as empty: 16 bytes. Repeated rows are rows of their own. ``law`` is 'rows': counts at most
    one apart; ``grown_shard`` is null, for where a row goes depends on the other rows, too.
    """
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return assign_shards(slim, "doc_id", shards, ties=["text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
