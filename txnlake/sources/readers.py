"""Reading tables and message files."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlake.functions import text

log = logging.getLogger(__name__)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, **options) -> DataFrame:
    """CSV with a header row; types are inferred unless a schema is given."""
    reader = spark.read.options(header=True, **options)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path if isinstance(path, str) else list(path))


def _with_source(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_name").alias("_source_file"))


def read_table(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """One CSV or Parquet file by its suffix, with ``_source_file``."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in (".csv", ".txt"):
        return _with_source(read_csv(spark, path, schema, **options))
    if suffix in (".parquet", ".pq"):
        return _with_source(spark.read.parquet(path))
    raise ValueError(f"unsupported file format: {suffix or path}")


def list_files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths of the files in a folder, in name order, on whatever file system it lives."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    glob = hadoop.Path(f"{folder.rstrip('/')}/{pattern}")
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob)
    return sorted(str(s.getPath().toString()) for s in found or [])


def read_dir(
    spark: SparkSession, folder: str, pattern: str = "*.csv", left_out: list[str] | None = None, **options
) -> DataFrame:
    """All CSV files of a folder, columns united, with ``_source_file``.

    Files with the same header are read together in one scan, so a folder of many like files
    makes a small plan. Files whose header Spark refuses, and empty ones, are logged and appended to ``left_out``;
    any other failure is raised.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in list_files(spark, folder, pattern):
        try:
            header = spark.read.options(header=True, **options).csv(path).columns
        except AnalysisException as problem:
            log.warning("left out %s: %s", path, problem)
            header = []
        if header:
            by_header.setdefault(tuple(header), []).append(path)
        elif left_out is not None:
            left_out.append(path)
    if not by_header:
        raise ValueError(f"no data files in {folder}")
    parts = [_with_source(read_csv(spark, paths, **options)) for paths in by_header.values()]
    return union_all(parts)


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Put tables together; columns one of them lacks are NULL there."""
    result = dfs[0]
    for df in dfs[1:]:
        result = result.unionByName(df, allowMissingColumns=True)
    return result


def append_distinct(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables together, whole rows once."""
    return existing.unionByName(new, allowMissingColumns=True).dropDuplicates()


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("file_path"), F.col("modificationTime").alias("file_mtime"), "content"
    )


def _first(df: DataFrame, max_messages: int | None) -> DataFrame:
    return df.orderBy("file_path", "line").limit(max_messages) if max_messages else df


def read_messages_txt(
    spark: SparkSession, path: str, max_messages: int | None = None, encoding: str = "UTF-8"
) -> DataFrame:
    """One message per line, trimmed, blank lines dropped: (file_path, file_mtime, line, text).

    A file is decoded as a whole so that line numbers are exact in any encoding; one very large
    export is best split into files. ``read_message_lines`` splits UTF-8 files across tasks.
    """
    lines = _files(spark, path).select(
        "file_path", "file_mtime", F.posexplode(F.split(F.decode("content", encoding), "\n")).alias("line", "text")
    )
    return _first(lines.withColumn("text", text.stripped(F.col("text"))).filter("text != ''"), max_messages)


def read_message_lines(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 messages, one per line, read in splits of any large file; ``line`` orders them in the file."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("file_mtime"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line"),
        text.stripped(F.col("value")).alias("text"),
    )
    return lines.filter("text != ''")


def read_messages_json(
    spark: SparkSession, path: str, max_messages: int | None = None, encoding: str = "UTF-8"
) -> DataFrame:
    """A JSON array of strings per file; empty elements are dropped, other documents give nothing."""
    listed = _files(spark, path).select(
        "file_path", "file_mtime", F.posexplode(text.json_strings(F.decode("content", encoding))).alias("line", "text")
    )
    return _first(listed.filter("text is not null and text != ''"), max_messages)


def load_table(spark: SparkSession, name: str | None = None, query: str | None = None, args: dict | None = None) -> DataFrame:
    """A whole table, or the result of a SQL text with named arguments."""
    if (name is None) == (query is None):
        raise ValueError("give a table name or a query")
    return spark.table(name) if name is not None else spark.sql(query, args=args or {})


def parquet_schema_info(spark: SparkSession, path: str) -> DataFrame:
    """(position, column, type, nullable, column_count) from the file footers, without a data scan."""
    fields = spark.read.parquet(path).schema.fields
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable, len(fields)) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "position int, column string, type string, nullable boolean, column_count int")
