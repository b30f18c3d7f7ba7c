"""Table profiles: summaries, quality, semantic types, correlations, outliers."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlake.functions import text
from txnlake.functions.fixed_values import TABLE_DATE_FORMATS
from txnlake.operators.clean import columns_of, iqr_bounds, numeric_columns, string_columns
from txnlake.plans.groups import column_percentiles, plain_percentiles

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _rows(wide: DataFrame, structs: list[Column]) -> DataFrame:
    """One row per struct out of a one-row aggregate."""
    return wide.select(F.inline(F.array(*structs)))


def _nothing(df: DataFrame, schema: str) -> DataFrame:
    """The report of a table without columns of the kind asked for."""
    return df.sparkSession.createDataFrame([], schema)


def _distinct(column: str, exact: bool) -> Column:
    return F.count_distinct(column) if exact else F.approx_count_distinct(column)


def summary_numeric(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max and NULLs per numeric column, in one pass.

    Exact quartiles of a table beyond one task are ranked in a distributed way first;
    ``exact=False`` uses ``percentile_approx`` instead.
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    if not cols:
        stats = ", ".join(f"{c} double" for c in ("mean", "std", "min", "p25", "p50", "p75", "max"))
        return _nothing(df, f"column string, count long, {stats}, null_count long")
    probs = [0.25, 0.5, 0.75]
    one_pass = not exact or plain_percentiles(df)
    if not exact:
        quart = {c: F.percentile_approx(c, probs) for c in cols}
    elif one_pass:
        quart = {c: F.percentile(c, F.array(*[F.lit(p) for p in probs])) for c in cols}
    else:
        found = column_percentiles(df, cols, probs)
        quart = {c: F.array(*[F.lit(v).cast("double") for v in found[c]]) for c in cols}
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        aggs += [
            F.count(c).alias(f"{c}|n"), F.avg(v).alias(f"{c}|m"), F.stddev_samp(v).alias(f"{c}|s"),
            F.min(v).alias(f"{c}|lo"), F.max(v).alias(f"{c}|hi"), F.count_if(v.isNull()).alias(f"{c}|z"),
        ]
        if one_pass:
            aggs.append(quart[c].alias(f"{c}|q"))
    wide = df.agg(*aggs)
    structs = []
    for c in cols:
        q = F.col(f"`{c}|q`") if one_pass else quart[c]
        structs.append(
            F.struct(
                F.lit(c).alias("column"), F.col(f"`{c}|n`").alias("count"), F.col(f"`{c}|m`").alias("mean"),
                F.col(f"`{c}|s`").alias("std"), F.col(f"`{c}|lo`").alias("min"),
                q[0].cast("double").alias("p25"), q[1].cast("double").alias("p50"), q[2].cast("double").alias("p75"),
                F.col(f"`{c}|hi`").alias("max"), F.col(f"`{c}|z`").alias("null_count"),
            )
        )
    return _rows(wide, structs)


def _value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) over several string columns, NULLs included as NULL values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n"))


def summary_categorical(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Distinct values, NULLs and the ``k`` most frequent values per string column."""
    cols = list(columns) if columns is not None else string_columns(df)
    if not cols:
        return _nothing(df, "column string, unique_count long, null_count long, rank int, value string, count long")
    counts = _value_counts(df, cols)
    totals = counts.groupBy("column").agg(
        F.count("value").alias("unique_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("null_count"),
    )
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    top = counts.filter("value is not null").withColumn("rank", rank).filter(F.col("rank") <= k)
    return totals.join(top, "column", "left").select(
        "column", "unique_count", "null_count", "rank", "value", F.col("n").alias("count")
    )


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values of a column."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), column).limit(k)


def summary_dates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """First and last date, whole days between them, and NULLs per date column."""
    cols = list(columns) if columns is not None else columns_of(df, *DATES)
    if not cols:
        return _nothing(df, "column string, min_date timestamp, max_date timestamp, date_range_days long, null_count long")
    wide = df.agg(
        *[a for c in cols for a in (
            F.min(c).cast("timestamp").alias(f"{c}|lo"), F.max(c).cast("timestamp").alias(f"{c}|hi"),
            F.count_if(F.col(c).isNull()).alias(f"{c}|z"))]
    )
    span = lambda c: F.floor((F.unix_micros(F.col(f"`{c}|hi`")) - F.unix_micros(F.col(f"`{c}|lo`"))) / 86_400_000_000)
    return _rows(
        wide,
        [
            F.struct(
                F.lit(c).alias("column"), F.col(f"`{c}|lo`").alias("min_date"), F.col(f"`{c}|hi`").alias("max_date"),
                span(c).cast("long").alias("date_range_days"), F.col(f"`{c}|z`").alias("null_count"),
            )
            for c in cols
        ],
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(rows, duplicate_rows): copies are counted map-side before they are shuffled."""
    per_row = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return per_row.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows")
    )


def data_quality(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: type, NULLs, distinct values, zeros, negatives, with table totals on each row."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    totals = duplicate_rows(df).first()
    aggs = []
    for c, kind in kinds.items():
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}|z"), _distinct(c, exact).alias(f"{c}|u")]
        if isinstance(kind, (T.NumericType,)):
            aggs += [F.count_if(F.col(c) == 0).alias(f"{c}|zero"), F.count_if(F.col(c) < 0).alias(f"{c}|neg")]
    wide = df.agg(*aggs)
    rows = F.lit(totals["rows"]).cast("long")
    structs = []
    for c, kind in kinds.items():
        number = isinstance(kind, T.NumericType)
        structs.append(
            F.struct(
                F.lit(c).alias("column"), F.lit(kind.simpleString()).alias("dtype"),
                rows.alias("total_rows"), F.lit(len(kinds)).cast("long").alias("total_columns"),
                F.lit(totals["duplicate_rows"]).cast("long").alias("duplicate_rows"),
                F.col(f"`{c}|z`").alias("null_count"),
                F.try_divide(100.0 * F.col(f"`{c}|z`"), rows).alias("null_pct"),
                F.col(f"`{c}|u`").alias("unique_count"),
                F.try_divide(100.0 * F.col(f"`{c}|u`"), rows).alias("unique_pct"),
                (F.col(f"`{c}|zero`") if number else F.lit(None).cast("long")).alias("zero_count"),
                (F.col(f"`{c}|neg`") if number else F.lit(None).cast("long")).alias("negative_count"),
            )
        )
    return _rows(wide, structs)


def first_values(df: DataFrame, column: str, k: int, order: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` non-NULL values by ``order`` (any ``k`` without one), as text."""
    present = df.filter(F.col(column).isNotNull()).select(*dict.fromkeys([column, *order]))
    chosen = present.orderBy(*order).limit(k) if order else present.limit(k)
    return chosen.select(F.col(column).cast("string").alias("value"))


def _type_labels(df: DataFrame) -> dict[str, str]:
    """Semantic label of every column as far as the Spark type and, for strings, all values tell; one aggregate."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggs = []
    for i, c in enumerate(texts):
        value = F.col(f"`{c}`")
        parsed = F.coalesce(text.parse_timestamp(value, TABLE_DATE_FORMATS), value.try_cast("timestamp"))
        aggs += [F.count(value).alias(f"n{i}"), F.count(parsed).alias(f"ok{i}")]
    seen = df.agg(*aggs).first() if aggs else {}
    labels = {}
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, T.BooleanType):
            label = "boolean"
        elif isinstance(kind, INTEGERS):
            label = "integer"
        elif isinstance(kind, T.NumericType):
            label = "numeric"
        elif isinstance(kind, DATES):
            label = "datetime"
        elif isinstance(kind, T.StringType):
            i = texts.index(field.name)
            label = "date_string" if seen[f"n{i}"] and seen[f"n{i}"] == seen[f"ok{i}"] else "text"
        else:
            label = "unknown"
        labels[field.name] = label
    return labels


def infer_schema(df: DataFrame, order: Sequence[str] = (), exact: bool = True, samples: int = 3) -> DataFrame:
    """Per column: type, NULLs, distinct values, semantic type, samples, and numeric statistics."""
    fields = df.schema.fields
    rows = df.count()
    numeric = set(numeric_columns(df))
    if numeric and not (exact and plain_percentiles(df)):
        medians = (
            {c: v[0] for c, v in column_percentiles(df, sorted(numeric), [0.5]).items()}
            if exact else {c: None for c in numeric}
        )
    else:
        medians = None
    aggs = []
    for f in fields:
        c = f.name
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}|z"), _distinct(c, exact).alias(f"{c}|u")]
        if c in numeric:
            v = F.col(c).cast("double")
            middle = F.median(v) if medians is None else F.max(F.lit(medians[c]).cast("double"))
            if not exact:
                middle = F.percentile_approx(v, 0.5)
            aggs += [
                F.min(v).alias(f"{c}|lo"), F.max(v).alias(f"{c}|hi"), F.avg(v).alias(f"{c}|m"),
                middle.alias(f"{c}|md"), F.stddev_samp(v).alias(f"{c}|s"),
            ]
    wide = df.agg(*aggs)
    nothing = F.lit(None).cast("double")
    structs, labels = [], _type_labels(df)
    for f in fields:
        c, label = f.name, labels[f.name]
        unique = F.col(f"`{c}|u`")
        semantic = F.lit(label)
        if label == "text":
            few = (unique < 50) & (F.try_divide(unique.cast("double"), F.lit(rows)) < 0.05)
            semantic = F.when(few, F.lit("categorical")).otherwise(semantic)
        shown = [r["value"] for r in first_values(df, c, samples, order).collect()]
        stat = lambda s: F.col(f"`{c}|{s}`") if c in numeric else nothing
        structs.append(
            F.struct(
                F.lit(c).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                F.col(f"`{c}|z`").alias("null_count"),
                F.try_divide(100.0 * F.col(f"`{c}|z`"), F.lit(rows)).alias("null_pct"),
                unique.alias("unique_count"), semantic.alias("semantic_type"),
                F.array(*[F.lit(v) for v in shown]).cast("array<string>").alias("samples"),
                stat("lo").alias("min"), stat("hi").alias("max"), stat("m").alias("mean"),
                stat("md").alias("median"), stat("s").alias("std"),
            )
        )
    return _rows(wide, structs)


def infer_semantic_type(df: DataFrame, order: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """(column, semantic_type): integer, numeric, datetime, boolean, date_string, categorical, text, unknown."""
    labels = _type_labels(df)
    texts = [c for c, label in labels.items() if label == "text"]
    wide = df.agg(F.count("*").alias("_rows"), *[_distinct(c, exact).alias(f"{c}|u") for c in texts])
    structs = []
    for c, label in labels.items():
        semantic = F.lit(label)
        if label == "text":
            unique = F.col(f"`{c}|u`")
            few = (unique < 50) & (F.try_divide(unique.cast("double"), F.col("_rows")) < 0.05)
            semantic = F.when(few, F.lit("categorical")).otherwise(semantic)
        structs.append(F.struct(F.lit(c).alias("column"), semantic.alias("semantic_type")))
    return _rows(wide, structs)


def suggest_types(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """(column, suggested): the smallest integer type that holds the values, dates and categories named."""
    labels = infer_semantic_type(df, order)
    whole = columns_of(df, *INTEGERS)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wide = df.agg(
        F.count("*").alias("_rows"),
        *[a for c in whole for a in (F.min(c).cast("long").alias(f"{c}|lo"), F.max(c).cast("long").alias(f"{c}|hi"))],
    )
    structs = []
    for c, kind in kinds.items():
        suggested = F.lit(kind)
        if c in whole:
            low, high = F.col(f"`{c}|lo`"), F.col(f"`{c}|hi`")
            suggested = (
                F.when(low.isNull(), kind).when(low < 0, kind)
                .when(high < 256, "uint8").when(high < 65536, "uint16").otherwise("uint32")
            )
        structs.append(F.struct(F.lit(c).alias("column"), suggested.alias("by_range")))
    ranged = _rows(wide, structs)
    return labels.join(ranged, "column").select(
        "column",
        F.when(F.col("semantic_type") == "date_string", "datetime64")
        .when(F.col("semantic_type") == "categorical", "category")
        .otherwise(F.col("by_range")).alias("suggested"),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair over rows where both are present: (a, b, r)."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    wide = df.agg(
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in combinations(cols, 2)],
        *[F.corr(F.col(a).cast("double"), F.col(a).cast("double")).alias(f"{a}|{a}") for a in cols],
    )
    structs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            name = f"{a}|{b}" if i <= j else f"{b}|{a}"
            structs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{name}`").alias("r")))
    return _rows(wide, structs)


def outlier_report(
    df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5, order: Sequence[str] = (), first: int = 10
) -> DataFrame:
    """Columns with values outside the IQR bounds: count, share, bounds and the first values."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    bounds = {c: b for c, b in iqr_bounds(df, cols, k).items() if b} if cols else {}
    if not bounds:
        return _nothing(
            df, "column string, count long, percentage double, lower_bound double, upper_bound double, outlier_values array<double>"
        )
    parts = []
    rows = df.count()
    for c, (low, high) in bounds.items():
        beyond = df.filter((F.col(c) < low) | (F.col(c) > high))
        counted = beyond.agg(F.count("*").alias("count"))
        along = list(order) or [c]
        shown = beyond.select(*dict.fromkeys([c, *along])).orderBy(*along).limit(first)
        values = shown.agg(F.array_agg(F.struct(*along, F.col(c).cast("double").alias("_v"))).alias("_l")).select(
            F.transform(F.array_sort("_l"), lambda s: s["_v"]).alias("outlier_values")
        )
        parts.append(
            counted.withColumn("column", F.lit(c)).join(values.withColumn("column", F.lit(c)), "column").select(
                "column", "count", (F.lit(100.0) * F.col("count") / F.lit(rows)).alias("percentage"),
                F.lit(low).cast("double").alias("lower_bound"), F.lit(high).cast("double").alias("upper_bound"),
                "outlier_values",
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.filter("count > 0")
