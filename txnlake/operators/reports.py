"""Spending reports: pivots, shares, merchants, account types, urgency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_of(ts: str) -> Column:
    return F.date_format(F.col(ts), "yyyy-MM")


def total(value: str) -> Column:
    """Sum that is 0, not NULL, when nothing is there."""
    return F.coalesce(F.sum(value), F.lit(0.0))


UNNAMED, OTHER = "Uncategorized", "Other"


def _named(column: Column) -> Column:
    """Blank and missing names are one group."""
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(UNNAMED))


def _values(df: DataFrame, name: str) -> list[str]:
    """Distinct values of a column that becomes columns of the result: one aggregate, as many rows as there are columns."""
    return [r[0] for r in df.select(name).filter(F.col(name).isNotNull()).distinct().orderBy(name).collect()]


def _listed(df: DataFrame, name: str, wanted: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    """``df`` with ``name`` reduced to ``wanted`` and 'Other', and the names of the columns to come."""
    if wanted is None:
        return df, _values(df, name)
    other = df.filter(~F.col(name).isin(list(wanted))).limit(1).count() > 0
    kept = F.when(F.col(name).isin(list(wanted)), F.col(name)).when(F.col(name).isNotNull(), F.lit(OTHER))
    return df.withColumn(name, kept), [*wanted, *([OTHER] if other else [])]


def pivot_month_category(df: DataFrame, value: str, ts: str, category: str, categories: Sequence[str] | None = None) -> DataFrame:
    """Months down, categories across, gaps 0.

    Without ``categories`` all that occur; with them, the others' amounts stand under 'Other', so nothing is lost.
    """
    rows = df.select(month_of(ts).alias("month"), _named(F.col(category)).alias("category"), F.col(value).alias("v"))
    rows, names = _listed(rows, "category", categories)
    wide = rows.groupBy("month").pivot("category", names).agg(F.sum("v"))
    return wide.na.fill(0.0).orderBy("month")


def pivot_category_month_totals(df: DataFrame, value: str, ts: str, category: str, months: Sequence[str] | None = None) -> DataFrame:
    """Categories down, months across, with a Total row and a Total column.

    Without ``months`` all that occur; with them, the others' amounts stand under 'Other', so totals are complete.
    """
    rows = df.select(_named(F.col(category)).alias("category"), month_of(ts).alias("month"), F.col(value).alias("v")).filter("month is not null")
    chosen, names = _listed(rows, "month", months)
    cubed = chosen.cube("category", "month").agg(F.sum("v").alias("v"), F.grouping("category").alias("gc"), F.grouping("month").alias("gm"))
    named = cubed.select(
        F.when(F.col("gc") == 1, "Total").otherwise(F.col("category")).alias("category"),
        F.when(F.col("gm") == 1, "Total").otherwise(F.col("month")).alias("month"), "gc", "v",
    )
    wide = named.groupBy("category", "gc").pivot("month", [*names, "Total"]).agg(F.sum("v")).na.fill(0.0)
    return wide.orderBy("gc", "category").drop("gc")


def monthly_stats(df: DataFrame, value: str, ts: str) -> DataFrame:
    return (
        df.groupBy(month_of(ts).alias("month"))
        .agg(total(value).alias("total"), F.avg(value).alias("average"), F.count(value).alias("count"))
        .orderBy("month")
    )


def category_share(df: DataFrame, value: str, category: str) -> DataFrame:
    """Spending per category and its share of all spending, largest first."""
    sums = df.groupBy(category).agg(total(value).alias("total"))
    everything = df.agg(F.sum(value)).scalar()
    return sums.withColumn("pct", F.try_divide(F.col("total") * 100.0, everything)).orderBy(F.desc("total"), category)


def merchant_stats(df: DataFrame, value: str, merchant: str) -> DataFrame:
    return df.groupBy(merchant).agg(
        total(value).alias("total_spend"), F.count("*").alias("transaction_count"),
        F.try_divide(total(value), F.count("*")).alias("avg_transaction"),
    )


def top_merchants(df: DataFrame, value: str, merchant: str, n: int = 5) -> DataFrame:
    """The ``n`` merchants with the most spending."""
    return merchant_stats(df, value, merchant).orderBy(F.desc("total_spend"), merchant).limit(n)


def urgency_stats(df: DataFrame, value: str, urgency: str = "urgency") -> DataFrame:
    """Spending, rows, mean and share of rows per urgency level."""
    levels = df.groupBy(urgency).agg(
        total(value).alias("total_spend"), F.count(value).alias("count"), F.avg(value).alias("avg_spend")
    )
    counted = df.filter(F.col(urgency).isNotNull()).agg(F.count(value)).scalar()
    return levels.filter(F.col(urgency).isNotNull()).withColumn("pct", F.try_divide(F.col("count") * 100.0, counted))


def credit_debit_split(df: DataFrame, value: str, account_type: str) -> DataFrame:
    """Rows and spending on credit and debit accounts, and credit / debit (0 without debit)."""
    kind = F.lower(F.col(account_type))
    side = lambda name: F.coalesce(F.sum(F.when(kind == name, F.col(value))), F.lit(0.0))
    return df.agg(
        F.count_if(kind == "credit").alias("credit_count"), side("credit").alias("credit_total"),
        F.count_if(kind == "debit").alias("debit_count"), side("debit").alias("debit_total"),
    ).withColumn(
        "credit_debit_ratio",
        F.when(F.col("debit_total") > 0, F.col("credit_total") / F.col("debit_total")).otherwise(F.lit(0.0)),
    )


def account_type_by_category(df: DataFrame, value: str, account_type: str, category: str) -> DataFrame:
    return df.groupBy(account_type, category).agg(total(value).alias("total"))


def top_category_per_account_type(df: DataFrame, value: str, account_type: str, category: str) -> DataFrame:
    """The category with the most spending for each account type; the first name wins ties."""
    sums = account_type_by_category(df, value, account_type, category)
    ranked = sums.groupBy(account_type).agg(
        F.max("total").alias("top_total"),
        F.min_by(category, F.struct(-F.col("total"), F.col(category))).alias("top_category"),
    )
    return ranked.select(account_type, "top_category", "top_total")
