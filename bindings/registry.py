"""Registration of queries, and shared views of the test tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlake.plans.groups import dealt, work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` is the statement with the same result."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def scratch(spark: SparkSession) -> str:
    """A new path in the shared work folder."""
    return os.path.join(work_dir(spark), f"run-{uuid.uuid4().hex}")


def rounded(df: DataFrame, places: int = 4, **special: int) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.withColumns(
        {
            f.name: F.round(F.col(f"`{f.name}`"), special.get(f.name, places))
            for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        }
    )


def longs(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.withColumns({f.name: F.col(f.name).cast("long") for f in df.schema.fields if isinstance(f.dataType, small)})


def texts(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


# The orders table as a ledger; every expression reads the same in both dialects.
DAY = "cast(cast(o_orderdate AS date) AS string)"
LEDGER = {
    "id": "cast(o_orderkey AS string)",
    "date": DAY,
    "payee": "'cust_' || cast(o_custkey AS string)",
    "category": "CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END",
    "subcategory": "'Sub ' || cast(o_orderkey % 20 AS string)",
    "amount": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END",
    "account_id": "'acc_' || cast(o_custkey % 10 AS string)",
    "account_type": "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Credit' "
                    "WHEN o_orderstatus = 'O' THEN 'Debit' ELSE 'Prepaid' END",
    "tags": "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'prio' || substr(o_orderpriority, 1, 1) || ', ' || o_orderstatus "
            "|| ',' END",
    "urgency": "CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 200000 THEN 'medium' ELSE 'normal' END",
    "currency": "'EGP'",
}
LEDGER_LIST = [f"{expr} AS {name}" for name, expr in LEDGER.items()]
WITH_LEDGER = f"WITH ledger AS (SELECT {', '.join(LEDGER_LIST)} FROM orders) "


def ledger_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*LEDGER_LIST)


# Bank-like messages made from the orders table, again in both dialects.
AMT = "cast(cast(o_totalprice AS decimal(18,2)) AS string)"
DMY = f"substr({DAY}, 9, 2) || '/' || substr({DAY}, 6, 2) || '/' || substr({DAY}, 1, 4)"
SUF = "lpad(cast(o_custkey % 10000 AS string), 4, '0')"
MESSAGE = f"""CASE o_orderkey % 9
 WHEN 0 THEN 'Your HSBC card ending ' || {SUF} || ' was charged ' || {AMT} || ' EGP at Carrefour City on ' || {DMY}
 WHEN 1 THEN 'CIB: Purchase of ' || {AMT} || ' USD at Store ' || cast(o_custkey % 50 AS string) || ' on ' || {DMY} || ', card ending ' || {SUF}
 WHEN 2 THEN 'تم خصم ' || {AMT} || ' جنيه من بطاقة ' || {SUF} || ' في ' || {DMY}
 WHEN 3 THEN 'OTP code ' || {SUF} || ' for amount ' || {AMT}
 WHEN 4 THEN 'Your payment of ' || {AMT} || ' EGP was declined on ' || {DMY}
 WHEN 5 THEN 'Special offer: 50% off, enjoy free delivery ' || cast(o_custkey AS string)
 WHEN 6 THEN 'NBE Withdrawal of ' || {AMT} || ' EGP at ATM card ' || {SUF}
 WHEN 7 THEN 'مبلغ ٢٥٠٫٥٠ ريال رقم ' || {SUF} || ' شراء من كارفور '
 ELSE '   hello  ' || o_orderpriority || '  ' END"""
MESSAGE_LIST = [
    "o_orderkey AS message_id", f"{MESSAGE} AS text", "o_orderdate AS file_mtime", "o_custkey AS custkey",
]
WITH_MESSAGES = f"WITH messages AS (SELECT {', '.join(MESSAGE_LIST)} FROM orders) "


#: Rows of a task where patterns run over short texts.
MESSAGES_PER_TASK = 50_000


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt out to all cores before work that is heavy per row."""
    return dealt(df, MESSAGES_PER_TASK)


def message_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")).selectExpr(*MESSAGE_LIST)
