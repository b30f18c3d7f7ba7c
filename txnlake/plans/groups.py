"""Ordered work over groups of any size.

A window partitioned by a key puts the whole group into one task. That is the right plan
while every group is small, and the wrong one when a single account holds a third of a
100 TB table. Each helper here measures the largest group first. Small groups run as plain
windows; larger ones are cut into equal blocks of consecutive rows, worked on in parallel
and stitched together through per-block totals. Both ways give the same rows.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_TASK_CONF = "spark.txnlake.rowsPerTask"
DEFAULT_ROWS_PER_TASK = 1_000_000
PLAIN_PERCENTILE_ROWS = 1_000_000
SKETCH_ACCURACY = 1_000


def rows_per_task(spark: SparkSession) -> int:
    """Largest number of rows one ordered group may bring to a task."""
    return int(spark.conf.get(ROWS_PER_TASK_CONF, str(DEFAULT_ROWS_PER_TASK)))


_LOCAL_DIRS: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the cluster names it; a local session may do without."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="txnlake-")
    return _LOCAL_DIRS[context.applicationId]


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = os.path.join(work_dir(spark), f"txnlake-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """The rows dealt out evenly, about ``rows`` to a task and to all cores, before work that is heavy per row.

    How a scan is split says little: a row group lies in one task whole, and the other splits of its file are empty. Rows
    are therefore counted by task (a scan without columns), and a table that lies evenly stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    by_task = df.groupBy(F.spark_partition_id().alias("_task")).agg(F.count("*").alias("_n"))
    total, largest = by_task.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    if largest <= min(rows, max(2 * total // cores, rows // 100)):
        return df
    return df.repartition(max(cores, -(-total // rows)))


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition on ``keys`` in which NULL equals NULL."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def attach(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-key columns of ``side`` (one row per key) onto ``df``; NULL keys match."""
    renamed = side.select([F.col(c).alias(f"_k_{c}" if c in keys else c) for c in side.columns])
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys])
    return df.join(renamed, cond, how).drop(*[f"_k_{k}" for k in keys])


def fits(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    """True when no group of ``keys`` (the whole table for no keys) has more than ``limit`` rows."""
    limit = limit or rows_per_task(df.sparkSession)
    if not keys:
        return df.count() <= limit
    return df.groupBy(*keys).count().filter(F.col("count") > limit).isEmpty()


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    amount: Column | None = None,
    out: str = "_pos",
    small: bool | None = None,
) -> DataFrame:
    """Running sum of ``amount`` (default 1: the exact row number) within ``keys``.

    ``order`` must be unique within a group. A group too large for one task is range-split on
    (keys, order): Spark samples the bounds, so slices are even whatever the skew.
    """
    amount = F.lit(1).cast("long") if amount is None else amount
    if small is None:
        small = fits(df, keys)
    if small:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(amount).over(frame))

    limit = rows_per_task(df.sparkSession)
    slices = max(2, math.ceil(2 * df.count() / limit))
    ranged = df.withColumn("_amount", amount).repartitionByRange(slices, *[F.col(k) for k in keys], *order)
    tagged = durable(ranged.withColumn("_slice", F.spark_partition_id()))
    group = ["_slice", *keys]
    totals = tagged.groupBy(*group).agg(F.sum("_amount").alias("_slice_total"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_slice_total").over(before), F.lit(0)))
    frame = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = tagged.withColumn("_inside", F.sum("_amount").over(frame))
    return (
        attach(inside, offsets.drop("_slice_total"), group)
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_amount", "_slice", "_before", "_inside")
    )


def row_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "_pos", small: bool | None = None
) -> DataFrame:
    """Exact 1-based row number within ``keys``; ``order`` must be unique there."""
    return running_total(df, keys, order, None, out, small)


def over_history(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    back: int,
    build: Callable[[DataFrame, Window], DataFrame],
    small: bool | None = None,
) -> DataFrame:
    """Apply ``build(df, window)``, whose frames reach at most ``back`` rows backwards.

    Large groups become blocks of equal size by exact row number; the last ``back`` rows of a
    block are copied into the next one, so every frame is complete inside its block.
    """
    if small is None:
        small = fits(df, keys)
    if small:
        return build(df, Window.partitionBy(*keys).orderBy(*order))
    size = max(rows_per_task(df.sparkSession), back)
    placed = row_position(df, keys, order, "_pos", small=False)
    block = F.floor((F.col("_pos") - 1) / size)
    is_tail = (F.col("_pos") - 1) % size >= size - back
    spread = placed.withColumn("_home", block).withColumn(
        "_part", F.explode(F.when(is_tail, F.array(block, block + 1)).otherwise(F.array(block)))
    )
    built = build(spread, Window.partitionBy(*keys, "_part").orderBy("_pos"))
    return built.filter(F.col("_part") == F.col("_home")).drop("_pos", "_home", "_part")


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str], small: bool | None = None
) -> DataFrame:
    """Replace NULLs in ``columns`` by the last non-NULL value before them in ``order``."""
    if small is None:
        small = fits(df, keys)
    if small:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(frame) for c in columns})
    size = rows_per_task(df.sparkSession)
    placed = durable(
        row_position(df, keys, order, "_pos", small=False).withColumn("_part", F.floor((F.col("_pos") - 1) / size))
    )
    group = [*keys, "_part"]
    ends = placed.groupBy(*group).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_pos"))).alias(f"_end_{c}") for c in columns]
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*group, *[F.last(f"_end_{c}", True).over(earlier).alias(f"_carry_{c}") for c in columns])
    frame = Window.partitionBy(*group).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    filled = attach(placed, carried, group)
    return filled.withColumns(
        {c: F.coalesce(F.last(c, True).over(frame), F.col(f"_carry_{c}")) for c in columns}
    ).drop("_pos", "_part", *[f"_carry_{c}" for c in columns])


def percentiles(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float], small: bool | None = None
) -> DataFrame:
    """Exact linear-interpolated percentiles: one row per key, columns ``<column>_p<i>``.

    Groups that fit one task use the built-in ``percentile``. Beyond that the values are
    counted first (a hot value becomes one row), ranked by a running total, and only the
    values standing at the wanted ranks are kept.
    """
    if small is None:
        small = fits(df, keys)
    if small:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        packed = df.groupBy(*keys).agg(*[F.percentile(c, wanted).alias(c) for c in columns])
        return packed.select(
            *keys, *[F.col(c)[i].alias(f"{c}_p{i}") for c in columns for i in range(len(probs))]
        )
    result = None
    for column in columns:
        part = _ranked_percentiles(df.select(*keys, column), keys, column, probs)
        if result is None:
            result = part
        elif keys:
            result = attach(result, part, keys)
        else:
            result = result.withColumn("_one", F.lit(1)).join(part.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return result


def _ranked_percentiles(df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float]) -> DataFrame:
    value = F.col(column).cast("double")
    counted = durable(
        df.filter(F.col(column).isNotNull()).groupBy(*keys, value.alias("_v")).agg(F.count("*").alias("_n"))
    )
    ranked = running_total(counted, keys, [F.col("_v")], F.col("_n"), "_upto")
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    if keys:
        ranked = attach(ranked, sizes, keys)
    else:
        ranked = ranked.withColumn("_size", F.lit(sizes.first()["_size"]).cast("long"))
    aggs, outs = [], []
    for i, p in enumerate(probs):
        spot = (F.col("_size") - 1) * F.lit(float(p))
        for name, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            here = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
            aggs.append(F.max(F.when(here, F.col("_v"))).alias(f"_{name}{i}"))
        aggs.append(F.max(spot - F.floor(spot)).alias(f"_f{i}"))
        outs.append(
            ((1 - F.col(f"_f{i}")) * F.col(f"_lo{i}") + F.col(f"_f{i}") * F.col(f"_hi{i}")).alias(f"{column}_p{i}")
        )
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *outs)


def plain_percentiles(df: DataFrame) -> bool:
    """True for a table small enough to bring all its distinct values to one task."""
    return fits(df, [], min(PLAIN_PERCENTILE_ROWS, rows_per_task(df.sparkSession)))


def column_percentiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list]:
    """Exact percentiles of whole columns as driver scalars, for use as literal bounds in filters.

    A larger table is scanned for approximate percentiles first. They bracket each wanted rank so
    closely that only a sliver of the values needs ranking; everything below is just counted.
    """
    if plain_percentiles(df):
        row = percentiles(df, [], columns, probs, small=True).first()
    else:
        row = _bracketed_percentiles(df, columns, probs) or percentiles(df, [], columns, probs, small=False).first()
    return {c: [row[f"{c}_p{i}"] for i in range(len(probs))] for c in columns}


def _bracketed_percentiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, float | None] | None:
    """Percentiles from values between approximate neighbours; None should a rank fall outside."""
    value = {c: F.col(c).cast("double") for c in columns}
    asked = [min(max(p + side, 0.0), 1.0) for p in probs for side in (-2 / SKETCH_ACCURACY, 2 / SKETCH_ACCURACY)]
    near = df.agg(
        *[F.count(v).alias(f"{c}|n") for c, v in value.items()],
        *[F.percentile_approx(v, asked, SKETCH_ACCURACY).alias(f"{c}|q") for c, v in value.items()],
    ).first()
    spots, result = [], {}
    for c in columns:
        for i, p in enumerate(probs):
            result[f"{c}_p{i}"] = None
            if near[f"{c}|n"]:
                spots.append((c, i, (near[f"{c}|n"] - 1) * p, near[f"{c}|q"][2 * i], near[f"{c}|q"][2 * i + 1]))
    if not spots:
        return result
    below = df.agg(*[F.count_if(value[c] < low).alias(f"b{s}") for s, (c, _, _, low, _) in enumerate(spots)]).first()
    held = [
        F.when(value[c].between(low, high), F.struct(F.lit(s).alias("_spot"), value[c].alias("_v")))
        for s, (c, _, _, low, high) in enumerate(spots)
    ]
    near_any = reduce(lambda a, b: a | b, [value[c].between(low, high) for c, _, _, low, high in spots])
    inside = df.filter(near_any).select(F.explode(F.array_compact(F.array(*held))).alias("x"))
    counted = durable(inside.groupBy("x._spot", "x._v").agg(F.count("*").alias("_n")))
    ranked = running_total(counted, ["_spot"], [F.col("_v")], F.col("_n"), "_upto")
    wanted = F.lit(False)
    for s, (_, _, spot, _, _) in enumerate(spots):
        for rank in {math.floor(spot) - below[f"b{s}"], math.ceil(spot) - below[f"b{s}"]}:
            wanted = wanted | ((F.col("_spot") == s) & (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")))
    found = ranked.filter(wanted).collect()
    for s, (c, i, spot, _, _) in enumerate(spots):
        ends = []
        for rank in (math.floor(spot), math.ceil(spot)):
            at = rank - below[f"b{s}"]
            ends += [r["_v"] for r in found if r["_spot"] == s and r["_upto"] - r["_n"] <= at < r["_upto"]]
        if len(ends) != 2:
            return None
        share = spot - math.floor(spot)
        result[f"{c}_p{i}"] = (1 - share) * ends[0] + share * ends[1]
    return result
