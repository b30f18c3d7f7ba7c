"""Anomaly flags against a transaction's own history, and outlier rows of numeric columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlake.functions import text
from txnlake.functions.fixed_values import AMOUNT_NAMES, MERCHANT_NAMES, WHEN_NAMES
from txnlake.operators.clean import iqr_bounds, numeric_columns
from txnlake.plans.groups import attach, fits, over_history, row_position, running_total
from txnlake.plans.running_percentile import running_percentile

RULES = ("high_value", "burst_frequency", "unknown_merchant")


def _order(ts: str, tie: str) -> list[Column]:
    return [F.col(ts), F.col(tie)]


def pick_columns(df: DataFrame) -> dict[str, str | None]:
    """Amount, merchant and time columns, found by their usual names."""
    pick = lambda names: next((n for n in names if n in df.columns), None)
    return {"amount": pick(AMOUNT_NAMES), "merchant": pick(MERCHANT_NAMES), "ts": pick(WHEN_NAMES)}


def flag_high_value(
    df: DataFrame, amount: str, ts: str, tie: str, partition: Sequence[str] = (),
    pct: float = 90, min_history: int = 10, exact: bool = True, out: str = "high_value",
) -> DataFrame:
    """True where the amount exceeds the percentile of earlier amounts, given enough earlier rows."""
    staged = running_percentile(
        df, amount, pct / 100.0, partition, _order(ts, tie), "_limit", "_earlier", exact
    )
    above = (F.col("_earlier") >= min_history) & (F.col(amount) > F.col("_limit"))
    return staged.withColumn(out, F.coalesce(above, F.lit(False))).drop("_limit", "_earlier")


def flag_burst(
    df: DataFrame, merchant: str, ts: str, tie: str, partition: Sequence[str] = (),
    n: int = 3, hours: float = 24, out: str = "burst_frequency", small: bool | None = None,
) -> DataFrame:
    """True at the n-th and later rows of one merchant within the trailing hours.

    In time order this is one look n−1 rows back: was that row inside the window?
    """
    keyed = df.withColumn("_merchant", text.merchant_key(F.col(merchant)))
    if n <= 1:
        return keyed.withColumn(out, F.col("_merchant").isNotNull() & F.col(ts).isNotNull()).drop("_merchant")

    def build(d: DataFrame, w) -> DataFrame:
        nth = F.lag(ts, n - 1).over(w)
        hit = nth >= F.col(ts) - F.make_dt_interval(secs=F.lit(float(hours) * 3600))
        return d.withColumn(out, F.col("_merchant").isNotNull() & F.coalesce(hit, F.lit(False)))

    keys = [*partition, "_merchant"]
    return over_history(keyed, keys, _order(ts, tie), n - 1, build, small).drop("_merchant")


def flag_unknown_merchant(
    df: DataFrame, merchant: str, ts: str, tie: str, partition: Sequence[str] = (),
    window: int = 100, out: str = "unknown_merchant", small: bool | None = None,
) -> DataFrame:
    """True where the merchant is absent from the previous ``window`` rows of the group."""
    keyed = df.withColumn("_merchant", text.merchant_key(F.col(merchant)))
    placed = row_position(keyed, partition, _order(ts, tie), "_row", small)

    def build(d: DataFrame, w) -> DataFrame:
        gap = F.col("_row") - F.lag("_row").over(w)
        unseen = F.coalesce(gap > window, F.lit(True))
        return d.withColumn(out, F.col("_merchant").isNotNull() & unseen)

    return over_history(placed, [*partition, "_merchant"], [F.col("_row")], 1, build, small).drop("_merchant", "_row")


def burst_counts(
    df: DataFrame, merchant: str, ts: str, tie: str, partition: Sequence[str] = (), hours: float = 24,
    out: str = "in_window", small: bool | None = None,
) -> DataFrame:
    """Earlier rows of the same merchant within the trailing hours: the count of an interval self-join.

    No pairs are made. Each row stands twice in one time line, once where its window opens and
    once at itself; the running row count at the two places differs by the wanted number.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    keyed = df.withColumn("_merchant", text.merchant_key(F.col(merchant)))
    known = keyed.filter(F.col("_merchant").isNotNull() & F.col(ts).isNotNull())
    keys = [*partition, "_merchant"]
    base = known.select(*keys, F.col(tie).alias("_tie"), micros.alias("_at"))
    opens = base.withColumns({"_at": F.col("_at") - int(hours * 3_600_000_000), "_row": F.lit(0)})
    points = opens.unionByName(base.withColumn("_row", F.lit(1)))
    # An opening stands before every row of the same instant.
    counted = running_total(
        points, keys, [F.col("_at"), F.col("_row"), F.col("_tie")], F.col("_row").cast("long"), "_rows", small
    )
    spans = counted.groupBy(*keys, "_tie").agg(
        (F.max(F.when(F.col("_row") == 1, F.col("_rows"))) - 1 - F.max(F.when(F.col("_row") == 0, F.col("_rows")))).alias(out)
    )
    # ``tie`` tells rows apart within a group only.
    joined = attach(keyed.withColumn("_tie", F.col(tie)), spans, [*keys, "_tie"])
    return joined.drop("_tie", "_merchant").withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


def detect_anomalies(
    df: DataFrame, amount: str, merchant: str, ts: str, tie: str, partition: Sequence[str] = (),
    rules: Mapping[str, Mapping] | Sequence[str] = RULES, exact: bool = True,
) -> DataFrame:
    """Adds ``flags`` (array, in rule order) and ``anomalies`` (comma-joined, NULL when none).

    ``rules`` names the enabled rules, optionally with their settings. With small groups the
    whole operator needs one shuffle by ``partition``.
    """
    settings = {r: dict(rules[r]) if isinstance(rules, Mapping) else {} for r in rules}
    unknown = set(settings) - set(RULES)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    small = fits(df, partition)
    staged, flags = df, []
    if "high_value" in settings:
        staged = flag_high_value(staged, amount, ts, tie, partition, exact=exact, out="_f0", **settings["high_value"])
    if "unknown_merchant" in settings:
        staged = flag_unknown_merchant(
            staged, merchant, ts, tie, partition, out="_f2", small=small or None, **settings["unknown_merchant"]
        )
    if "burst_frequency" in settings:
        staged = flag_burst(staged, merchant, ts, tie, partition, out="_f1", small=small or None, **settings["burst_frequency"])
    for i, rule in enumerate(RULES):
        if rule in settings:
            flags.append(F.when(F.col(f"_f{i}"), F.lit(rule)))
    listed = F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")
    return (
        staged.withColumn("flags", listed)
        .withColumn("anomalies", F.nullif(F.concat_ws(",", "flags"), F.lit("")))
        .drop("_f0", "_f1", "_f2")
    )


def anomaly_report(df: DataFrame, flags: str = "flags") -> DataFrame:
    """Rows, flagged rows, rate and rows per flag."""
    return df.agg(
        F.count("*").alias("total_transactions"),
        F.count_if(F.size(flags) > 0).alias("total_anomalies"),
        *[F.count_if(F.array_contains(flags, r)).alias(f"{r}_count") for r in RULES],
    ).withColumn(
        "anomaly_rate",
        F.coalesce(F.try_divide(F.col("total_anomalies").cast("double"), F.col("total_transactions")), F.lit(0.0)),
    )


def select_anomalies(df: DataFrame, anomalies: str = "anomalies") -> DataFrame:
    return df.filter(F.col(anomalies).isNotNull() & (F.col(anomalies) != ""))


def anomaly_spend(df: DataFrame, amount: str, anomalies: str = "anomalies") -> DataFrame:
    """Flagged rows, their share, total and mean amount."""
    flagged = F.coalesce(F.col(anomalies) != "", F.lit(False))
    return df.agg(
        F.count_if(flagged).alias("anomaly_count"),
        F.try_divide(F.count_if(flagged) * 100.0, F.count("*")).alias("anomaly_rate"),
        F.coalesce(F.sum(F.when(flagged, F.col(amount))), F.lit(0.0)).alias("anomaly_total"),
        F.avg(F.when(flagged, F.col(amount))).alias("anomaly_mean"),
    )


def top_anomalies(df: DataFrame, amount: str, tie: str, n: int = 5, anomalies: str = "anomalies") -> DataFrame:
    """The largest flagged rows."""
    return select_anomalies(df, anomalies).orderBy(F.desc(amount), tie).limit(n)


def _labelled_union(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Rows meeting a column's condition, once per column, in one scan."""
    if not conditions:
        return df.limit(0).withColumn("anomaly_column", F.lit(None).cast("string"))
    hits = F.array_compact(F.array(*[F.when(cond, F.lit(c)) for c, cond in conditions.items()]))
    any_hit = None
    for cond in conditions.values():
        any_hit = cond if any_hit is None else any_hit | cond
    return df.filter(any_hit).select("*", F.explode(hits).alias("anomaly_column"))


def zscore_anomalies(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """Rows with |z| above the threshold (sample std), labelled with the column; no spread, no rows."""
    cols = [c for c in (columns or numeric_columns(df)) if c in numeric_columns(df)]
    stats = df.agg(*[a for c in cols for a in (F.avg(c).alias(f"{c}|m"), F.stddev_samp(c).alias(f"{c}|s"))]).first()
    return _labelled_union(
        df,
        {c: F.abs((F.col(c) - stats[f"{c}|m"]) / stats[f"{c}|s"]) > threshold for c in cols if stats[f"{c}|s"]},
    )


def iqr_anomalies(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Rows outside the IQR bounds of a column, labelled with the column."""
    cols = [c for c in (columns or numeric_columns(df)) if c in numeric_columns(df)]
    bounds = iqr_bounds(df, cols, k)
    return _labelled_union(df, {c: (F.col(c) < b[0]) | (F.col(c) > b[1]) for c, b in bounds.items() if b})
