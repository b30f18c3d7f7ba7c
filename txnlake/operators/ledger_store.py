"""A ledger in a folder, keyed by month and by a slot of the message hash.

Rows lie in Parquet partitions (month, slot). A row that equals a batch row by its message hash lies in the slots of the
batch's hashes; one that equals it by the composite key, which holds the date, in the months of the batch. So a load
reads the hash column of its slots and the key columns of its months, and an upsert rewrites only the partitions that
hold a row it changes or get a new one. Own ids of new rows are looked up in the id column alone.

A skip load appends, in one write. An upsert replaces whole partitions; one that fails on the way may be run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlake.operators import ledger as ledgers
from txnlake.plans.groups import durable

PLACE = ("month", "slot")
DEFAULT_SLOTS = 16


def month_of(date: str = "date") -> Column:
    """The partition of a row's month; rows without a date have their own."""
    return F.concat(F.lit("m"), F.coalesce(F.replace(F.substring(F.col(date).cast("string"), 1, 7), F.lit("-"), F.lit("")), F.lit("")))


def slot_of(slots: int, message_hash: str = "message_hash") -> Column:
    return F.pmod(F.xxhash64(message_hash), F.lit(slots)).cast("int")


def _placed(rows: DataFrame, slots: int) -> DataFrame:
    return rows.withColumns({"month": month_of(), "slot": slot_of(slots)})


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """One file for each partition and task that has rows for it; rows of a partition come together first."""
    writer = rows.repartition(*PLACE).write.mode(mode).partitionBy(*PLACE)
    (writer.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" else writer).parquet(path)


def create(rows: DataFrame, path: str, slots: int = DEFAULT_SLOTS) -> None:
    """Write a new ledger; ``slots`` should leave a partition some hundred MB and is given again to every load."""
    _write(_placed(ledgers.with_message_hash(rows), slots), path, "error")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger with its partition columns; None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER_SCHEMA" in str(problem):
            return None
        raise


def read(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows without their partition columns."""
    return spark.read.parquet(path).drop(*PLACE)


def _values(rows: DataFrame, column: Column) -> list:
    """Distinct slots or months: as many as there are partitions, at most."""
    return [r[0] for r in rows.select(column.alias("v")).distinct().collect()]


def lookups(rows: DataFrame, batch: DataFrame, slots: int) -> ledgers.Lookups:
    """The partitions of ``rows`` in which an equal of a batch row can lie; ``batch`` has message hashes."""
    in_slots = F.col("slot").isin(_values(batch, slot_of(slots)))
    in_months = F.col("month").isin(_values(batch, month_of()))
    return ledgers.Lookups(rows.filter(in_slots), rows.filter(in_months), rows)


def load_skip(
    path: str, batch: DataFrame, order: str, keys: Sequence[str] = ledgers.COMPOSITE,
    required: Sequence[str] = ledgers.REQUIRED, slots: int = DEFAULT_SLOTS,
) -> DataFrame:
    """Append the unseen rows of ``batch`` to the ledger at ``path``; returns the batch with ``status``, as `insert_skip`.

    Without a ledger the batch makes one, with the batch's columns and an id. ``keys`` hold the date.
    """
    _check(keys)
    spark = batch.sparkSession
    batch = durable(ledgers.with_message_hash(batch))
    rows = stored(spark, path)
    if rows is None:
        rows = _placed(batch if "id" in batch.columns else batch.withColumn("id", F.lit(None).cast("string")), slots).limit(0)
        found = ledgers.everywhere(rows)
    else:
        found = lookups(rows, batch, slots)
    settled = ledgers._settled(found, batch, order, keys, required)
    plain = rows.drop(*PLACE)
    added = ledgers._as_ledger(settled.filter("_state = 'new'").withColumn("id", F.col("_target")), plain)
    _write(_placed(added, slots), path, "append")
    return ledgers._status(settled, ledgers.SKIP_WORDS, required)


def load_upsert(
    path: str, batch: DataFrame, order: str, keys: Sequence[str] = ledgers.COMPOSITE,
    required: Sequence[str] = ledgers.REQUIRED, slots: int = DEFAULT_SLOTS,
) -> DataFrame:
    """Change and add rows of the ledger at ``path``, which exists; returns the batch with ``status``, as `upsert`."""
    _check(keys)
    spark = batch.sparkSession
    batch = durable(ledgers.with_message_hash(batch))
    rows = spark.read.parquet(path)
    found = lookups(rows, batch, slots)
    settled = ledgers._settled(found, batch, order, keys, required)
    plain = rows.drop(*PLACE)
    changes = ledgers._changes(settled, plain, order)
    # A known row lies where it was looked up, and may go to another place.
    near = found.hashes.select("id", *PLACE).union(found.keys.select("id", *PLACE))
    known = changes.filter("_is_new = 0").select(F.col("_target").alias("of"))
    held = near.join(known, near["id"].cast("string") == known["of"], "left_semi").select(*PLACE).distinct()
    news = _placed(changes.select("_b.*"), slots).select(*PLACE).distinct()
    touched: dict[str, list[int]] = {}
    for month, slot in held.union(news).distinct().collect():
        touched.setdefault(month, []).append(slot)
    here = F.lit(False)
    for month, mine in sorted(touched.items()):
        here = here | ((F.col("month") == month) & F.col("slot").isin(sorted(mine)))
    before = rows.filter(here)
    after = durable(_placed(ledgers._merged(before.drop(*PLACE), changes), slots))
    filled = {tuple(r) for r in after.select(*PLACE).distinct().collect()}
    emptied = {tuple(r) for r in held.collect()} - filled
    _write(after, path, "overwrite")
    for month, slot in sorted(emptied):
        _remove(spark, f"{path}/month={month}/slot={slot}")
    return ledgers._status(settled, ledgers.UPSERT_WORDS, required)


def _check(keys: Sequence[str]) -> None:
    if "date" not in keys:
        raise ValueError("the keys of a stored ledger hold the date, by which its months are found")


def _remove(spark: SparkSession, path: str) -> None:
    """Remove a partition that no row is left in, wherever the folder is."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
