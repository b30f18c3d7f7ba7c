"""Cash-flow statistics, saving targets and percentile bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlake.functions.fixed_values import RISK_PROFILES
from txnlake.plans.groups import percentiles


def cashflow_stats(df: DataFrame, amount: str, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """Income and expense statistics over monthly net amounts, months without rows counting as 0.

    Months above 0 are income, months below 0 expense (as positive numbers); the standard
    deviation is the sample one, NULL for a single month.
    """
    month = F.trunc(F.to_date(F.col(ts)), "MM")
    dated = df.filter(F.col(ts).isNotNull())
    monthly = dated.groupBy(*by, month.alias("month")).agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias("net"))
    listed = monthly.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("month", "net"))).alias("nets"))
    spine = F.explode(F.sequence(F.array_min(F.map_keys("nets")), F.array_max(F.map_keys("nets")), F.expr("interval 1 month")))
    filled = listed.select(*by, "nets", spine.alias("month")).select(
        *by, F.coalesce(F.try_element_at("nets", F.col("month")), F.lit(0.0)).alias("net")
    )
    income, expense = F.when(F.col("net") > 0, F.col("net")), F.when(F.col("net") < 0, -F.col("net"))
    return filled.groupBy(*by).agg(
        F.count("*").alias("months"),
        F.coalesce(F.avg(income), F.lit(0.0)).alias("income_mean"),
        F.when(F.count(income) == 0, 0.0).otherwise(F.stddev_samp(income)).alias("income_std"),
        F.coalesce(F.avg(expense), F.lit(0.0)).alias("expense_mean"),
        F.when(F.count(expense) == 0, 0.0).otherwise(F.stddev_samp(expense)).alias("expense_std"),
        F.avg("net").alias("net_mean"),
    )


def _money(value: Column) -> Column:
    """Two places, half up."""
    return F.round(value.cast("decimal(38,6)"), 2).cast("double")


def recommend_allocations(
    stats: DataFrame, risk_level: str | None = None, profiles: Mapping[str, Mapping[str, float]] = RISK_PROFILES
) -> DataFrame:
    """Emergency fund, growth and cash buffer targets from ``cashflow_stats``.

    One row per row of ``stats`` and risk level (all levels unless one is named). The profiles
    are a handful of settings and become literals.
    """
    levels = {risk_level: profiles[risk_level]} if risk_level else dict(profiles)
    choices = F.array(
        *[
            F.struct(
                F.lit(name).alias("risk_level"), F.lit(int(p["reserve_months"])).alias("reserve_months"),
                F.lit(float(p["equity_allocation"])).alias("equity_allocation"),
            )
            for name, p in levels.items()
        ]
    )
    widened = stats.select("*", F.inline(choices))
    saving = F.greatest(F.col("net_mean"), F.lit(0.0))
    invested = saving * F.col("equity_allocation")
    return widened.withColumns(
        {
            "emergency_fund": _money(F.greatest(F.col("expense_mean") * F.col("reserve_months"), F.lit(0.0))),
            "growth_allocation": _money(invested * 12),
            "cash_buffer": _money((saving - invested) * 12),
            "monthly_savings_capacity": _money(saving),
        }
    )


def percentile_bands(
    df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)
) -> DataFrame:
    """Percentiles of a value per group as columns p5, p25, ..."""
    found = percentiles(df, group, [value], probs)
    return found.select(*group, *[F.col(f"{value}_p{i}").alias(f"p{round(100 * p)}") for i, p in enumerate(probs)])
