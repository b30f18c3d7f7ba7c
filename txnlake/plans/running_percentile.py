"""Percentile of all earlier values, for groups of any size.

Three ways, by the size of the group:

* up to ``SMALL_GROUP`` rows: the built-in ``percentile`` over a growing frame, which sorts the
  frame anew for every row;
* up to ``BLOCK_ROWS`` rows: one task keeps the values of the group in order and adds row by row;
* beyond: the group is cut twice, by time into blocks of consecutive rows and by value into bins,
  both of equal size by exact row number. For a block, the wanted percentile of "everything
  earlier" can only fall among few values: those within a block's length of the wanted rank.
  Only those values travel to the block's task, so the total work stays linear in the number of
  rows and no task sees more than a few blocks' worth of them.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlake.plans.groups import attach, durable, null_safe, row_position, rows_per_task

SMALL_GROUP = 500
BLOCK_ROWS = 20_000


def running_percentile(
    df: DataFrame, value: str, p: float, keys: Sequence[str], order: Sequence[Column],
    out: str = "running_pct", seen: str = "earlier_rows", exact: bool = True,
) -> DataFrame:
    """Adds the ``p`` percentile of ``value`` over earlier rows of the group, and their number.

    ``order`` must be unique within a group. NULL and NaN count as rows but not as values, whichever
    way a group takes; infinities are values. ``exact=False`` takes Spark's approximate percentile over the same frame.
    """
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        plain = df.withColumn("_plain", F.when(~F.isnan(value), F.col(value)))
        return _running_percentile(plain, "_plain", p, keys, order, out, seen, exact).drop("_plain")
    return _running_percentile(df, value, p, keys, order, out, seen, exact)


def _running_percentile(df, value, p, keys, order, out, seen, exact) -> DataFrame:
    limit = rows_per_task(df.sparkSession)
    small, block = min(SMALL_GROUP, limit), min(BLOCK_ROWS, limit)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    if not exact:
        return _by_window(df, value, p, keys, order, out, seen, exact)
    found = sizes.agg(
        F.max("_n").alias("largest"), F.count_if((F.col("_n") > small) & (F.col("_n") <= block)).alias("warm")
    ).first()
    largest = found["largest"] or 0
    if largest <= small:
        return _by_window(df, value, p, keys, order, out, seen, exact)
    if not keys:
        way = _by_group if largest <= block else _by_blocks
        return way(df, value, p, keys, order, out, seen, largest)
    over_small, over_block = sizes.filter(F.col("_n") > small), sizes.filter(F.col("_n") > block)
    warm = over_small.filter(F.col("_n") <= block)
    result = _by_window(_only(df, over_small, keys, "left_anti"), value, p, keys, order, out, seen, exact)
    if found["warm"]:
        result = result.unionByName(_by_group(_only(df, warm, keys, "left_semi"), value, p, keys, order, out, seen, block))
    if largest > block:
        result = result.unionByName(_by_blocks(_only(df, over_block, keys, "left_semi"), value, p, keys, order, out, seen, largest))
    return result


def _only(df: DataFrame, sizes: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Rows whose key is (left_semi) or is not (left_anti) listed."""
    listed = sizes.select(*keys)
    return df.join(listed, null_safe(df, listed, keys), how)


def _by_window(df, value, p, keys, order, out, seen, exact) -> DataFrame:
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    v = F.col(value).cast("double")
    at = F.percentile(v, F.lit(p)) if exact else F.percentile_approx(v, p).cast("double")
    return df.withColumns({out: at.over(frame), seen: F.count(F.lit(1)).over(frame)})


def _answers(fed: DataFrame, group: Sequence[str], p: float, out: str) -> DataFrame:
    """The percentile before each own row of a block, next to the block's candidate values.

    ``_base`` earlier values lie below the candidates, ``_before`` is the number of all earlier ones.
    """
    kinds = {f.name: f.dataType for f in fed.schema.fields}
    schema = T.StructType([T.StructField(k, kinds[k]) for k in group])
    schema = schema.add("_pos", T.LongType()).add(out, T.DoubleType())
    listed = list(group)

    def one_block(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf[pdf["_own"]].sort_values("_pos")
        ranked = sorted(pdf.loc[~pdf["_own"], "_v"])
        base = 0 if pd.isna(pdf["_base"].iloc[0]) else int(pdf["_base"].iloc[0])
        count = int(pdf["_before"].iloc[0])
        found = []
        for v in mine["_v"]:
            if count:
                spot = (count - 1) * p
                low, high = math.floor(spot), math.ceil(spot)
                a, b = ranked[low - base], ranked[high - base]
                found.append(a if low == high else (high - spot) * a + (spot - low) * b)
            else:
                found.append(None)
            if not pd.isna(v):
                insort(ranked, v)
                count += 1
        return mine[[*listed, "_pos"]].assign(**{out: pd.Series(found, index=mine.index, dtype="float64")})

    return fed.groupBy(*group, "_block").applyInPandas(one_block, schema)


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """One constant key stands in for "the whole table"."""
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(1)), ["_all"])


def _by_group(df, value, p, keys, order, out, seen, largest) -> DataFrame:
    keyed, group = _keyed(df, keys)
    placed = row_position(keyed, group, order, "_pos", small=True)
    fed = placed.select(
        *group, "_pos", F.lit(0).alias("_block"), F.col(value).cast("double").alias("_v"), F.lit(True).alias("_own"),
        F.lit(None).cast("long").alias("_base"), F.lit(0).cast("long").alias("_before"),
    )
    joined = attach(placed, _answers(fed, group, p, out), [*group, "_pos"])
    return joined.withColumn(seen, F.col("_pos") - 1).drop("_pos", "_all")


def _by_blocks(df, value, p, keys, order, out, seen, largest) -> DataFrame:
    size = max(min(BLOCK_ROWS, rows_per_task(df.sparkSession)), math.isqrt(largest) + 1)
    keyed, group = _keyed(df, keys)
    placed = durable(
        row_position(keyed, group, order, "_pos").withColumn("_block", F.floor((F.col("_pos") - 1) / size))
    )
    values = placed.filter(F.col(value).isNotNull()).select(*group, "_pos", "_block", F.col(value).cast("double").alias("_v"))
    binned = durable(
        row_position(values, group, [F.col("_v"), F.col("_pos")], "_rank").withColumn(
            "_bin", F.floor((F.col("_rank") - 1) / size)
        )
    )
    wanted = durable(_candidate_bins(placed, binned, group, value, p))
    candidates = _candidates(wanted, binned, group, size, largest)
    facts = wanted.groupBy(*group, "_block").agg(F.min("_below").alias("_base"))
    earlier = _block_counts(placed, group, value).select(*group, "_block", "_before")
    own = placed.select(*group, "_block", "_pos", F.col(value).cast("double").alias("_v"), F.lit(True).alias("_own"))
    fed = own.unionByName(candidates.withColumns({"_pos": F.lit(0).cast("long"), "_own": F.lit(False)}))
    fed = attach(attach(fed, facts, [*group, "_block"]), earlier, [*group, "_block"])
    joined = attach(placed, _answers(fed, group, p, out), [*group, "_pos"]).withColumn(seen, F.col("_pos") - 1)
    return joined.drop("_pos", "_block", "_all")


def _block_counts(placed: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Values in each block and in all blocks before it."""
    counts = placed.groupBy(*group, "_block").agg(F.count(value).alias("_mine"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_mine").over(before), F.lit(0)))


def _candidate_bins(placed, binned, group, value, p) -> DataFrame:
    """(block, bin, values below the bin) for the bins that may hold a block's percentiles."""
    blocks = _block_counts(placed, group, value)
    cells = binned.groupBy(*group, "_block", "_bin").agg(F.count("*").alias("_n"))
    bins = cells.groupBy(*group).agg(F.max("_bin").alias("_last_bin"))
    grid = attach(blocks, bins, group, "inner").withColumn(
        "_bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last_bin")))
    )
    dense = attach(grid, cells, [*group, "_block", "_bin"])
    up_to_block = Window.partitionBy(*group, "_bin").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = dense.withColumn("_earlier", F.coalesce(F.sum("_n").over(up_to_block), F.lit(0)))
    up_to_bin = Window.partitionBy(*group, "_block").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = earlier.withColumn("_through", F.sum("_earlier").over(up_to_bin))
    lowest = F.floor((F.greatest(F.col("_before"), F.lit(1)) - 1) * p) - F.col("_mine")
    highest = F.floor((F.col("_before") + F.col("_mine")) * p) + 1
    below = F.col("_through") - F.col("_earlier")
    # The bin that holds rank max(lowest, 0) up to the one that holds `highest`.
    useful = (F.col("_earlier") > 0) & (F.col("_through") > F.greatest(lowest, F.lit(0))) & (below <= highest)
    return ranked.filter(useful).select(*group, "_block", "_bin", below.alias("_below"))


def _candidates(wanted, binned, group, size, largest) -> DataFrame:
    """The values of the candidate bins that came before the block.

    The middle bins are wanted by nearly every block, so their rows are salted by the block
    they came from.
    """
    salts = max(1, math.isqrt(largest // size + 1))
    left = binned.withColumn("_salt", F.col("_block") % salts).withColumnRenamed("_block", "_from")
    right = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    right = right.select(*[F.col(c).alias(f"_w{c}") for c in [*group, "_block", "_bin", "_salt"]])
    on = [left[c].eqNullSafe(right[f"_w{c}"]) for c in group]
    on += [left["_bin"] == right["_w_bin"], left["_salt"] == right["_w_salt"], left["_from"] < right["_w_block"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(right, cond).select(*group, F.col("_w_block").alias("_block"), "_v")
