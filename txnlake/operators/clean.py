"""Normalising and cleaning of tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlake.functions import text
from txnlake.functions.fixed_values import DATE_NAME_PARTS, TABLE_DATE_FORMATS
from txnlake.plans.groups import carry_forward, column_percentiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def columns_of(df: DataFrame, *kinds: type) -> list[str]:
    """Names of the columns of the given Spark types, in table order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, *NUMERIC)


def string_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.StringType)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Column names in lower case with underscores; a repeated name gets a number."""
    taken: dict[str, int] = {}
    names = []
    for name in df.columns:
        plain = re.sub(r"[^a-zA-Z0-9]+", "_", name).lower().strip("_")
        taken[plain] = taken.get(plain, 0) + 1
        names.append(plain if taken[plain] == 1 else f"{plain}_{taken[plain]}")
    return df.toDF(*names)


def strip_strings(df: DataFrame) -> DataFrame:
    """Trim every string column."""
    return df.withColumns({c: text.stripped(F.col(c)) for c in string_columns(df)})


def clean_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Trim and collapse white space; NULL stays NULL."""
    chosen = string_columns(df) if columns is None else [c for c in columns if c in df.columns]
    return df.withColumns({c: text.collapsed(F.col(c).cast("string")) for c in chosen})


def standardize_dates(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    formats: Sequence[str] = TABLE_DATE_FORMATS,
    out: str = "yyyy-MM-dd",
) -> DataFrame:
    """Date columns as text in one format; what does not parse stays as it is."""
    chosen = detect_date_columns(df, formats) if columns is None else [c for c in columns if c in df.columns]
    typed = columns_of(df, T.DateType, T.TimestampType, T.TimestampNTZType)
    return df.withColumns(
        {
            c: F.date_format(F.col(c), out) if c in typed else text.reformat_date(F.col(c).cast("string"), formats, out)
            for c in chosen
        }
    )


def date_column_profile(df: DataFrame, formats: Sequence[str] = TABLE_DATE_FORMATS) -> DataFrame:
    """Columns that may hold dates: (column, present, parsed, is_date).

    Date-typed columns count as they are; columns with a date-like name count when more than half of
    all their non-NULL values parse. One aggregate over all rows, whatever the number of columns.
    """
    aggs, kinds = [], {}
    for i, field in enumerate(df.schema.fields):
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kinds[i] = (field.name, True)
        elif any(part in field.name.lower() for part in DATE_NAME_PARTS):
            value = F.col(field.name).cast("string")
            parsed = F.coalesce(text.parse_timestamp(value, formats), value.try_cast("timestamp"))
            aggs += [F.count(value).alias(f"n{i}"), F.count(parsed).alias(f"ok{i}")]
            kinds[i] = (field.name, False)
    if not kinds:
        return df.sparkSession.createDataFrame([], "column string, present long, parsed long, is_date boolean")
    found = df.agg(*aggs).first() if aggs else {}
    rows = []
    for i, (name, typed) in kinds.items():
        present, parsed = (0, 0) if typed else (found[f"n{i}"], found[f"ok{i}"])
        rows.append((name, present, parsed, typed or (present > 0 and 2 * parsed > present)))
    return df.sparkSession.createDataFrame(rows, "column string, present long, parsed long, is_date boolean")


def detect_date_columns(df: DataFrame, formats: Sequence[str] = TABLE_DATE_FORMATS) -> list[str]:
    """Names of the columns that hold dates."""
    return [r["column"] for r in date_column_profile(df, formats).filter("is_date").collect()]


def normalize_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers out of text with currency signs and thousands commas; bad ones become NULL."""
    already = numeric_columns(df)
    return df.withColumns({c: text.to_number(F.col(c)) for c in columns if c in df.columns and c not in already})


def apply_schema(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns; values that do not fit become NULL, unknown columns are passed over."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def handle_missing(
    df: DataFrame,
    strategy: str = "drop",
    columns: Sequence[str] | None = None,
    value=None,
    order: Sequence[str] = (),
    partition: Sequence[str] = (),
) -> DataFrame:
    """Drop rows with NULLs, fill a constant, or carry the last / next value along ``order``."""
    chosen = list(columns) if columns is not None else df.columns
    if strategy == "drop":
        return df.na.drop(subset=chosen)
    if strategy == "fill":
        return df.na.fill(value, subset=chosen)
    if strategy in ("forward_fill", "backward_fill"):
        return fill_missing(df, strategy, chosen, order, partition)
    raise ValueError(f"unknown strategy: {strategy}")


def fill_missing(
    df: DataFrame,
    strategy: str,
    columns: Sequence[str],
    order: Sequence[str],
    partition: Sequence[str] = (),
    small: bool | None = None,
) -> DataFrame:
    """Carry the previous (forward_fill) or next (backward_fill) non-NULL value along ``order``."""
    if strategy not in ("forward_fill", "backward_fill"):
        raise ValueError(f"unknown strategy: {strategy}")
    if not order:
        raise ValueError("fill_missing needs an order")
    along = [F.col(c).asc() if strategy == "forward_fill" else F.col(c).desc() for c in order]
    return carry_forward(df, partition, along, columns, small)


def distinct_rows(
    df: DataFrame, subset: Sequence[str] | None = None, keep: str = "first", order: Sequence[str] = ()
) -> DataFrame:
    """Drop duplicates: keep the first or last row by ``order``, or none of the repeated ones.

    The filter on the row number lets Spark prune each key to one row before the shuffle, so a
    key with very many copies stays cheap.
    """
    if keep not in ("first", "last", "none"):
        raise ValueError(f"unknown keep: {keep}")
    keys = list(subset) if subset else df.columns
    if keep == "none":
        rest = [c for c in df.columns if c not in keys]
        grouped = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in rest])
        return grouped.filter("_n = 1").select(*df.columns)
    if not subset:
        return df.dropDuplicates()
    if not order:
        raise ValueError("keep='first' or 'last' on a subset needs an order")
    along = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*along)))
    return ranked.filter("_rn = 1").drop("_rn")


def iqr_bounds(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> dict[str, tuple[float, float] | None]:
    """(low, high) per column, None for a column without values."""
    quartiles = column_percentiles(df, columns, [0.25, 0.75])
    return {
        c: None if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1)) for c, (q1, q3) in quartiles.items()
    }


def remove_outliers(df: DataFrame, columns: Sequence[str], method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Filter by column after column; each column's bounds come from the rows still there.

    Bounds are a few numbers on the driver, so the filters are literals and reach the scan.
    Rows with NULL in a checked column go; a column without spread removes nothing by z-score.
    """
    if method not in ("iqr", "zscore"):
        raise ValueError(f"unknown method: {method}")
    for c in [c for c in columns if c in numeric_columns(df)]:
        if method == "iqr":
            bounds = iqr_bounds(df, [c], threshold)[c]
            df = df.filter(F.col(c).between(*bounds)) if bounds else df.filter(F.col(c).isNotNull())
        else:
            stats = df.agg(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).first()
            df = df.filter(F.col(c).isNotNull())
            if stats["s"]:
                df = df.filter(F.abs((F.col(c) - stats["m"]) / stats["s"]) <= threshold)
    return df


def apply_filters(df: DataFrame, filters: Sequence[Callable[[DataFrame], DataFrame] | Column]) -> DataFrame:
    """Caller's filters one after the other: functions over the table, or conditions."""
    for f in filters:
        df = df.filter(f) if isinstance(f, Column) else df.transform(f)
    return df


def weekdays_only(ts: str) -> Column:
    return F.weekday(F.col(ts)) < 5
