"""Whole jobs put together from operators: table ETL, messages to ledger, report bundles."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlake.functions import text
from txnlake.functions.templates import STOCK_TEMPLATES
from txnlake.operators import anomalies, classify, clean, extract, profile, series
from txnlake.plans.groups import durable
from txnlake.sources import readers, writers


def prepare(df: DataFrame, formats: Sequence[str] | None = None) -> DataFrame:
    """Normalised names, trimmed strings, ISO dates, single blanks: narrow steps only."""
    named = clean.strip_strings(clean.normalize_columns(df))
    dated = clean.standardize_dates(named, None, formats) if formats else clean.standardize_dates(named)
    return clean.clean_text(dated)


def _read(spark: SparkSession, source: str | DataFrame, is_directory: bool) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    return readers.read_dir(spark, source) if is_directory else readers.read_table(spark, source)


def run_pipeline(
    spark: SparkSession, source: str | DataFrame, table: str | None = None, is_directory: bool = False,
    outlier_columns: Sequence[str] = (), detect: Mapping[str, str] | None = None, partition: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(result, quality report): read, prepare, drop duplicates, optionally drop outliers and flag anomalies.

    ``detect`` names the columns (amount, merchant, ts, tie) of the anomaly rules; the table is
    replaced when a name is given.
    """
    df = prepare(_read(spark, source, is_directory))
    df = clean.distinct_rows(df)
    if outlier_columns:
        df = clean.remove_outliers(df, outlier_columns)
    quality = profile.data_quality(df)
    if detect:
        flagged = df.withColumn(detect["ts"], text.parse_timestamp(F.col(detect["ts"]).cast("string")))
        df = anomalies.detect_anomalies(flagged, detect["amount"], detect["merchant"], detect["ts"], detect["tie"], partition)
        df = df.drop("flags")
    if table:
        writers.save_table(df, table, "replace")
        df = spark.table(table)
    return df, quality


def replace_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Replace a table by rows that may be read from it: a new table is written, then swapped in."""
    staging, old = (f"{name}_{part}_{uuid.uuid4().hex[:8]}" for part in ("new", "old"))
    df.write.mode("error").saveAsTable(staging)
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {staging} RENAME TO {name}")
    writers.drop_table(spark, old)
    return spark.table(name)


def append_new_rows(spark: SparkSession, df: DataFrame, name: str) -> bool:
    """Append the rows of ``df`` that a table lacks, each once; False if the table's columns can't take them.

    Files of the table stay as they are, and until the append is committed readers see the old rows only, so a load that
    fails on the way has changed nothing and can be run again. Columns that ``df`` lacks are NULL.
    """
    table = spark.table(name)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if any(c not in table.columns or table.schema[c].dataType != kind for c, kind in kinds.items()):
        return False
    rows = df.select(*[F.col(c) if c in kinds else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    # EXCEPT takes NULL for equal to NULL and leaves each row once.
    durable(rows.subtract(table)).write.insertInto(name)
    return True


def run_incremental(spark: SparkSession, source: str | DataFrame, table: str, is_directory: bool = False) -> DataFrame:
    """Prepare new rows and append those that the table, which this job made, doesn't hold: every whole row once.

    Only rows with new columns or types make the table be written anew.
    """
    fresh = prepare(_read(spark, source, is_directory))
    if not spark.catalog.tableExists(table):
        return replace_table(spark, fresh.dropDuplicates(), table)
    if append_new_rows(spark, fresh, table):
        return spark.table(table)
    return replace_table(spark, readers.append_distinct(spark.table(table), fresh), table)


def messages_to_ledger(
    df: DataFrame, accounts: DataFrame, column: str = "text", templates: Sequence[dict] = STOCK_TEMPLATES,
    bank: str | None = None, seen_at: str = "file_mtime", compose: bool = True,
) -> DataFrame:
    """Message rows as ledger records: repair, parse, date, state, validate, account, normalise.

    One stage without a shuffle; the only join is with the broadcast account list.
    """
    repaired = extract.repair_text(df, column)
    parsed = extract.parse_messages(repaired, column, templates, bank)
    dated = extract.resolve_dates(parsed, "date", seen_at)
    stated = classify.classify_state(dated, column)
    valid = extract.validate_fields(stated)
    known = extract.lookup_accounts(valid, accounts)
    if "interest_rate" not in known.columns:
        known = known.withColumn("interest_rate", F.lit(None).cast("double"))
    return extract.normalize_records(known, compose)


def full_report(df: DataFrame, order: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Summaries, outliers, anomalies and correlations of a table, by section name."""
    numeric = clean.numeric_columns(df)
    sections = {
        "summary_numeric": profile.summary_numeric(df, numeric),
        "summary_categorical": profile.summary_categorical(df),
        "summary_dates": profile.summary_dates(df),
        "outliers": profile.outlier_report(df, numeric, order=order),
    }
    if numeric:
        flagged = anomalies.zscore_anomalies(df, numeric)
        sections["anomalies"] = flagged.groupBy("anomaly_column").agg(F.count("*").alias("count"))
    if len(numeric) > 1:
        sections["correlations"] = profile.correlation_matrix(df, numeric)
    return sections


def comprehensive_report(df: DataFrame, value: str, ts: str, tie: str) -> dict[str, DataFrame]:
    """Overview, grains with moving averages, spikes and top periods of a series, by section name."""
    total = f"{value}_sum"
    days = durable(series.summarize_by_day(df, value, ts))
    months = durable(series.summarize_by_month(df, value, ts))
    return {
        "overview": series.performance_indicators(df, value, ts, tie),
        "hourly": series.summarize_by_hour(df, value, ts),
        "peak_hours": series.peak_hours(df, value, ts, 1),
        "daily": series.moving_averages(days, total, ["date"], small=True).orderBy("date"),
        "daily_anomalies": series.spikes_and_drops(days, total, ["date"], small=True),
        "top_days": series.top_periods(days, total, 5, tie="date"),
        "monthly": series.moving_averages(months, total, ["year_month"], (3, 6), small=True),
        "monthly_anomalies": series.spikes_and_drops(months, total, ["year_month"], small=True),
        "top_months": series.top_periods(months, total, 5, tie="year_month"),
    }


def visualization_data(df: DataFrame, value: str, ts: str) -> dict[str, DataFrame]:
    """Daily series with a 7-day mean, hours of the day and months, ready to plot."""
    total = f"{value}_sum"
    days = series.moving_averages(series.summarize_by_day(df, value, ts), total, ["date"], (7,), small=True)
    return {
        "time_series": days.select("date", F.col(total).alias("value"), F.col(f"{total}_ma7").alias("moving_average_7")),
        "hourly_distribution": series.summarize_by_hour(df, value, ts).select("hour", F.col(total).alias("value")),
        "monthly_trends": series.summarize_by_month(df, value, ts).select(
            "year_month", F.col(total).alias("value"), "transaction_count"
        ),
    }
