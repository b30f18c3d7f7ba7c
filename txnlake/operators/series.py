"""Time series: grains, moving averages, spikes, top periods, performance figures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlake.functions import text
from txnlake.functions.fixed_values import DATE_NAME_PARTS, TABLE_DATE_FORMATS
from txnlake.operators.clean import columns_of
from txnlake.plans.groups import attach, column_percentiles, durable, over_history, row_position, running_total

KINDS: dict[str, Callable[[Column], Column]] = {
    "sum": lambda v: F.coalesce(F.sum(v), F.lit(0)),
    "mean": F.avg,
    "count": F.count,
    "min": F.min,
    "max": F.max,
}


def aggregation(kind: str | Callable[[Column], Column], value: str) -> tuple[str, Column]:
    """(output name, aggregate) for a named kind or any ``Column -> Column`` aggregate."""
    if callable(kind):
        return f"{value}_{getattr(kind, '__name__', 'agg')}", kind(F.col(value))
    if kind not in KINDS:
        raise ValueError(f"unknown aggregation: {kind}")
    return f"{value}_{kind}", KINDS[kind](F.col(value))


def validate_series(df: DataFrame, date_column: str | None = None) -> tuple[DataFrame, str]:
    """The table with a timestamp column and that column's name; rows without a valid date go."""
    if date_column is None:
        typed = columns_of(df, T.TimestampType, T.TimestampNTZType, T.DateType)
        named = [c for c in columns_of(df, T.StringType) if any(p in c.lower() for p in DATE_NAME_PARTS)]
        if not typed and not named:
            raise ValueError("no date column found")
        date_column = (typed or named)[0]
    if date_column not in df.columns:
        raise ValueError(f"no such column: {date_column}")
    if date_column not in columns_of(df, T.TimestampType, T.TimestampNTZType):
        raw = F.col(date_column)
        as_text = raw.cast("string")
        parsed = F.coalesce(raw.try_cast("timestamp"), text.parse_timestamp(as_text, TABLE_DATE_FORMATS))
        df = df.withColumn(date_column, parsed)
    valid = df.filter(F.col(date_column).isNotNull())
    if valid.isEmpty():
        raise ValueError("no rows with a valid date")
    return valid, date_column


def summarize_by_hour(df: DataFrame, value: str, ts: str, kind="sum") -> DataFrame:
    """All 24 hours of the day; hours without rows show 0."""
    name, agg = aggregation(kind, value)
    found = df.groupBy(F.hour(ts).alias("_h")).agg(agg.cast("double").alias(name), F.count("*").alias("transaction_count"))
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return (
        hours.join(found, hours.hour == found["_h"], "left")
        .select("hour", F.coalesce(name, F.lit(0.0)).alias(name), F.coalesce("transaction_count", F.lit(0)).cast("long").alias("transaction_count"))
        .orderBy("hour")
    )


def summarize_by_day(df: DataFrame, value: str, ts: str, kind="sum") -> DataFrame:
    """One row per date that occurs, with the name of its weekday."""
    name, agg = aggregation(kind, value)
    return (
        df.groupBy(F.to_date(ts).alias("date"))
        .agg(agg.alias(name), F.count("*").alias("transaction_count"))
        .withColumn("day_of_week", F.date_format("date", "EEEE"))
        .orderBy("date")
    )


def summarize_by_month(df: DataFrame, value: str, ts: str, kind="sum") -> DataFrame:
    """One row per month that occurs."""
    name, agg = aggregation(kind, value)
    first = F.trunc(F.to_date(ts), "MM")
    return (
        df.groupBy(first.alias("_first"))
        .agg(agg.alias(name), F.count("*").alias("transaction_count"))
        .select(
            F.date_format("_first", "yyyy-MM").alias("year_month"), name, "transaction_count",
            F.year("_first").alias("year"), F.month("_first").alias("month"),
            F.date_format("_first", "MMMM").alias("month_name"),
        )
        .orderBy("year_month")
    )


def weekday_profile(df: DataFrame, value: str, ts: str) -> DataFrame:
    """Mean number of rows and mean total per day, by weekday, Monday first."""
    days = summarize_by_day(df, value, ts)
    return (
        days.groupBy(F.weekday("date").alias("weekday"), "day_of_week")
        .agg(F.avg("transaction_count").alias("avg_count"), F.avg(f"{value}_sum").alias("avg_total"))
        .orderBy("weekday")
    )


def peak_hours(df: DataFrame, value: str, ts: str, n: int = 5) -> DataFrame:
    """The ``n`` busiest and quietest hours by total; rank 1 is the peak / the lowest hour."""
    hours = summarize_by_hour(df, value, ts)
    name = f"{value}_sum"
    sides = []
    for side, order in (("busiest", [F.desc(name), "hour"]), ("quietest", [F.asc(name), "hour"])):
        rank = F.row_number().over(Window.orderBy(*order))
        sides.append(hours.select(F.lit(side).alias("side"), rank.alias("rank"), "hour", name, "transaction_count"))
    return sides[0].unionByName(sides[1]).filter(F.col("rank") <= n)


def peak_months(df: DataFrame, value: str, ts: str) -> DataFrame:
    """Best and worst month and the mean monthly total, as one row."""
    name = f"{value}_sum"
    months = summarize_by_month(df, value, ts)
    low_key = F.struct(F.col(name), F.col("year_month"))
    high_key = F.struct(F.col(name), -F.col("year") * 12 - F.col("month"))
    return months.agg(
        F.max_by("year_month", high_key).alias("best_month"), F.max(name).alias("best_total"),
        F.min_by("year_month", low_key).alias("worst_month"), F.min(name).alias("worst_total"),
        F.avg(name).alias("mean_total"),
    )


def moving_averages(
    df: DataFrame, value: str, order: Sequence[str], windows: Sequence[int] = (7, 14, 30),
    partition: Sequence[str] = (), small: bool | None = None,
) -> DataFrame:
    """Trailing means over the last n rows (fewer at the start): ``<value>_ma<n>``.

    ``small=True`` says the series is one row per day or month and needs no size check.
    """

    def build(d: DataFrame, w) -> DataFrame:
        return d.withColumns({f"{value}_ma{n}": F.avg(value).over(w.rowsBetween(-(n - 1), 0)) for n in windows})

    return over_history(df, partition, [F.col(c) for c in order], max(windows), build, small)


def pct_change(
    df: DataFrame, value: str, order: Sequence[str], partition: Sequence[str] = (), small: bool | None = None
) -> DataFrame:
    """Change against the row before in percent; NULL at the start and on a zero base."""

    def build(d: DataFrame, w) -> DataFrame:
        before = F.lag(value).over(w)
        return d.withColumn(f"{value}_pct_change", (F.try_divide(F.col(value).cast("double"), before) - 1) * 100)

    return over_history(df, partition, [F.col(c) for c in order], 1, build, small)


def trends(
    df: DataFrame, value: str, order: Sequence[str], window: int = 7, partition: Sequence[str] = (),
    small: bool | None = None,
) -> DataFrame:
    """Moving average and its change from row to row."""
    ma = f"{value}_ma{window}"

    def build(d: DataFrame, w) -> DataFrame:
        now = F.avg(value).over(w.rowsBetween(-(window - 1), 0))
        earlier = F.avg(value).over(w.rowsBetween(-window, -1))
        return d.withColumns({ma: now, f"{value}_trend": F.when(F.lag(F.lit(1)).over(w).isNotNull(), now - earlier)})

    return over_history(df, partition, [F.col(c) for c in order], window, build, small)


def cumulative_spend(df: DataFrame, value: str, ts: str) -> DataFrame:
    """Monthly totals with their running sum."""
    months = summarize_by_month(df, value, ts).select("year_month", F.col(f"{value}_sum").alias("total"))
    return running_total(months, [], [F.col("year_month")], F.col("total"), "cumulative", small=True)


def growth_rate(df: DataFrame, value: str, ts: str, tie: str, keys: Sequence[str] = ()) -> DataFrame:
    """(last − first) / first · 100 along time; NULL on a zero base."""
    at = F.struct(F.col(ts), F.col(tie))
    return df.groupBy(*keys).agg(
        F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value")
    ).withColumn(
        "growth_rate", F.try_divide((F.col("last_value") - F.col("first_value")).cast("double"), F.col("first_value")) * 100
    )


def performance_indicators(df: DataFrame, value: str, ts: str, tie: str) -> DataFrame:
    """Count, total, mean, median, population std, range, CV, date range, quartiles, growth: one row."""
    v = F.col(value).cast("double")
    q1, q2, q3 = column_percentiles(df, [value], [0.25, 0.5, 0.75])[value]
    at = F.struct(F.col(ts), F.col(tie))
    lit = lambda x: F.lit(x).cast("double")
    wide = df.agg(
        F.count("*").alias("total_transactions"), F.sum(v).alias("total_value"), F.avg(v).alias("average_value"),
        F.stddev_pop(v).alias("std_deviation"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
        F.min(F.col(ts).cast("timestamp")).alias("start"), F.max(F.col(ts).cast("timestamp")).alias("end"),
        F.min_by(v, at).alias("_first"), F.max_by(v, at).alias("_last"),
    )
    days = F.floor((F.unix_micros("end") - F.unix_micros("start")) / 86_400_000_000)
    return wide.select(
        "total_transactions", "total_value", "average_value", lit(q2).alias("median_value"), "std_deviation",
        "min_value", "max_value", (F.col("max_value") - F.col("min_value")).alias("value_range"),
        F.coalesce(F.try_divide(F.col("std_deviation"), F.col("average_value")), lit(0)).alias("coefficient_of_variation"),
        "start", "end", days.cast("long").alias("days"),
        lit(q1).alias("q1"), lit(q2).alias("q2"), lit(q3).alias("q3"),
        F.when(F.col("total_transactions") > 1, F.try_divide(F.col("_last") - F.col("_first"), F.col("_first")) * 100)
        .alias("growth_rate"),
    )


def spikes_and_drops(
    df: DataFrame, value: str, order: Sequence[str], method: str = "zscore", threshold: float | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Rows far above or below the rest of a series, labelled spike or drop, with their 0-based index.

    The z-score uses the population standard deviation; a series without spread has none.
    """
    if method not in ("zscore", "iqr"):
        raise ValueError(f"unknown method: {method}")
    v = F.col(value)
    if method == "zscore":
        limit = 3.0 if threshold is None else threshold
        stats = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).first()
        z = (v - F.lit(stats["m"])) / F.lit(stats["s"] or None).cast("double")
        high, low = z > limit, z < -limit
    else:
        limit = 1.5 if threshold is None else threshold
        q1, q3 = column_percentiles(df, [value], [0.25, 0.75])[value]
        reach = None if q1 is None else limit * (q3 - q1)
        high = v > F.lit(None if q1 is None else q3 + reach).cast("double")
        low = v < F.lit(None if q1 is None else q1 - reach).cast("double")
    placed = row_position(df, [], [F.col(c) for c in order], "index", small)
    kind = F.when(high, "spike").when(low, "drop")
    return placed.withColumns({"index": F.col("index") - 1, "kind": kind}).filter("kind is not null")


def top_periods(df: DataFrame, value: str, n: int = 10, kind: str = "all", tie: str | None = None) -> DataFrame:
    """The ``n`` best periods and, for 'all' and 'negative', the ``n`` worst, worst first."""
    if kind not in ("all", "positive", "negative"):
        raise ValueError(f"unknown kind: {kind}")
    sides = [("top", F.desc(value))] + ([("bottom", F.asc(value))] if kind != "positive" else [])
    total = df.agg(F.count("*")).scalar()
    parts = []
    for side, first in sides:
        along = [first] + ([F.col(tie)] if tie else [])
        chosen = df.orderBy(*along).limit(n)
        rank = F.row_number().over(Window.orderBy(*along))
        parts.append(chosen.withColumns({"side": F.lit(side), "rank": rank}))
    result = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return result.withColumn("total_periods", total)


def rank_periods(df: DataFrame, value: str, tie: str, small: bool | None = None) -> DataFrame:
    """Rank by value from the best (``rank_desc``) and from the worst (``rank_asc``)."""
    best = row_position(df, [], [F.desc(value), F.col(tie)], "rank_desc", small)
    return row_position(best, [], [F.asc(value), F.col(tie)], "rank_asc", small)


def decompose(
    df: DataFrame, value: str, order: Sequence[str], period: int = 7, partition: Sequence[str] = ()
) -> DataFrame:
    """Additive trend, seasonal and residual parts of a daily series (one row per day).

    The trend is a centred mean over one period, NULL where the period is incomplete. A centred window is a
    trailing one some rows later, so series of any length are worked on in blocks of consecutive rows.
    """
    keys = list(partition)
    placed = row_position(df, keys, [F.col(c) for c in order], "_at")
    half = period // 2
    lags = [half] if period % 2 else [half - 1, half]

    def build(d: DataFrame, w) -> DataFrame:
        whole = F.count(F.lit(1)).over(w.rowsBetween(-(period - 1), 0)) == period
        return d.withColumn("_mean", F.avg(value).over(w.rowsBetween(-(period - 1), 0))).withColumn("_whole", whole)

    trailing = durable(over_history(placed.select(*keys, "_at", value), keys, [F.col("_at")], period, build))
    staged = placed
    for i, lag in enumerate(lags):
        moved = trailing.filter("_whole").select(*keys, (F.col("_at") - lag).alias("_at"), F.col("_mean").alias(f"_m{i}"))
        staged = attach(staged, moved, [*keys, "_at"])
    trend = sum((F.col(f"_m{i}") for i in range(1, len(lags))), F.col("_m0")) / len(lags)
    staged = durable(staged.withColumns({"trend": trend, "_phase": (F.col("_at") - 1) % period}))
    by_phase = staged.groupBy(*keys, "_phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_raw"))
    centre = by_phase.groupBy(*keys).agg(F.avg("_raw").alias("_centre"))
    seasonal = attach(staged, by_phase, [*keys, "_phase"])
    seasonal = attach(seasonal, centre, keys) if keys else seasonal.withColumn("_centre", centre.scalar())
    seasonal = seasonal.withColumn("seasonal", F.col("_raw") - F.col("_centre"))
    return seasonal.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal")).drop(
        "_phase", "_raw", "_centre", "_at", *[f"_m{i}" for i in range(len(lags))])
