"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a side of a join has at most if it is sent to all tasks whole, by way of the driver.
SENT = 50_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def q(name: str) -> str:
    """A column name quoted for ``F.col``."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct ``_row``, so that no helper column can clash with them."""
    return F.struct(*[F.col(q(c)) for c in df.columns]).alias("_row")


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on ``key`` (as string, null as '') and ``seed`` alone: 52 bits of an MD5 sum."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def merged(side: DataFrame) -> DataFrame:
    """``side`` of a join, to be sorted and merged whatever its size.

    Left alone, Spark sends a side whole, by way of the driver, if its files are small. Ids take several times as much
    there as in their files, so no side that grows with the input is left to that.
    """
    return side.hint("merge")


def beside(side: DataFrame, rows: int) -> DataFrame:
    """``side`` of a join, of ``rows`` rows at most: sent whole if these are few, else merged."""
    return F.broadcast(side) if rows <= SENT else merged(side)


def scratch_name() -> str:
    return uuid.uuid4().hex


def give_back() -> None:
    """Give memory of earlier tasks of this worker back to the system; what they remembered goes with them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):
        # Another C library keeps what it has.
        pass
