"""Writing tables, exports and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: declared export types ---------------------------------------------------
EXPORT_TYPES = {
    "id": "string", "date": "timestamp", "amount": "double", "currency": "string", "payee": "string",
    "normalized_merchant": "string", "category": "string", "subcategory": "string", "tags": "string",
    "account_id": "string", "account_type": "string", "interest_rate": "double", "urgency": "string",
    "confidence": "string",
}
MODES = {"fail": "error", "replace": "overwrite", "append": "append"}


def export_frame(df: DataFrame, dates: str = "date") -> DataFrame:
    """Declared types, tags as comma-joined text, and year and month of the date."""
    out = {}
    for f in df.schema.fields:
        if f.name in EXPORT_TYPES:
            joined = F.concat_ws(",", f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
            out[f.name] = joined.try_cast(EXPORT_TYPES[f.name])
    if "tags" in out:
        out["tags"] = F.coalesce(out["tags"], F.lit(""))
    shaped = df.withColumns(out)
    if dates in shaped.columns:
        shaped = shaped.withColumns({"year": F.year(dates), "month": F.month(dates)})
    return shaped


def write_parquet(
    df: DataFrame, path: str, compression: str = "snappy", partition_cols: Sequence[str] = (), mode: str = "error"
) -> None:
    """The export form of a table as Parquet.

    Partitioned writes bring the rows of a partition together first, in a number of tasks AQE
    splits by size, so a large month does not become one file nor a small one thousands.
    """
    shaped = export_frame(df)
    if partition_cols:
        shaped = shaped.hint("rebalance", *partition_cols)
    else:
        shaped = shaped.drop("year", "month")
    writer = shaped.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*partition_cols) if partition_cols else writer).parquet(path)


def save_table(df: DataFrame, name: str, mode: str = "replace") -> None:
    """Save as a catalog table: 'fail' if it exists, 'replace' it or 'append' to it."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    df.write.mode(MODES[mode]).saveAsTable(name)


def table_catalog(spark: SparkSession, names: Sequence[str] | None = None) -> DataFrame:
    """Per column of each table: table, rows, column, type, nullable."""
    listed = list(names) if names is not None else [t.name for t in spark.catalog.listTables() if not t.isTemporary]
    result = None
    for name in listed:
        table = spark.table(name)
        columns = F.array(
            *[
                F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                         F.lit(f.nullable).alias("nullable"))
                for f in table.schema.fields
            ]
        )
        counted = table.agg(F.count("*").alias("rows"))
        part = counted.select(F.lit(name).alias("table"), "rows", F.inline(columns))
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], "table string, rows long, column string, type string, nullable boolean")
    return result


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def write_delimited(df: DataFrame, path: str, mode: str = "error") -> None:
    """Results as CSV with a header; lists become comma-joined text."""
    flat = df.withColumns(
        {f.name: F.concat_ws(",", f.name) for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    )
    flat.write.mode(mode).option("header", True).csv(path)


def write_report_json(sections: DataFrame | dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """A report section, or each of several under its name, as JSON lines."""
    if isinstance(sections, DataFrame):
        sections.write.mode(mode).json(path)
        return
    for name, section in sections.items():
        section.write.mode(mode).json(f"{path.rstrip('/')}/{name}")
