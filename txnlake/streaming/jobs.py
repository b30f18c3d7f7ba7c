"""Streaming jobs: incremental loading, replay-safe messages, live daily spikes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from txnlake.operators import ledger as ledgers
from txnlake.operators import ledger_store, series
from txnlake.plans.groups import durable


def stream_ingest(
    spark: SparkSession, source: DataFrame, target: str, checkpoint: str, order: str,
    keys: Sequence[str] = ledgers.COMPOSITE, prepare: Callable[[DataFrame], DataFrame] | None = None,
    name: str | None = None, slots: int | None = None,
) -> StreamingQuery:
    """Append the unseen rows of a stream to the Parquet ledger at ``target``.

    With ``slots`` the ledger is one of `ledger_store`, of which a micro-batch reads only the partitions that can hold
    an equal row; without, the hashes and keys of the whole ledger. Each micro-batch goes through the skip load against the ledger as it stands. A batch that is
    replayed after a failure finds its rows there already, so the result is the same. Rows are
    appended, the ledger itself is never rewritten.
    """

    def load(batch: DataFrame, _id: int) -> None:
        session = batch.sparkSession
        if slots:
            ledger_store.load_skip(target, prepare(batch) if prepare else batch, order, keys, slots=slots)
            return
        rows = ledgers.with_message_hash(prepare(batch) if prepare else batch)
        # One copy of the batch for the several passes of the load.
        rows = durable(rows)
        try:
            stored = session.read.parquet(target)
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem) and "UNABLE_TO_INFER_SCHEMA" not in str(problem):
                raise
            stored = rows.limit(0)
        _, status = ledgers.insert_skip(stored, rows, order, keys)
        added = status.filter("status = 'inserted'")
        if "id" in stored.columns:
            added = added.withColumn("id", F.col("stored_id").cast(stored.schema["id"].dataType))
        added = added.select(*stored.columns)
        added.write.mode("append").parquet(target)

    writer = source.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Event time as a timestamp; watermarks take no zoneless one."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_dedup(df: DataFrame, ts: str, key: str = "message_hash", delay: str = "1 day") -> DataFrame:
    """Each message once; repeats that arrive within the delay are dropped and state stays bounded."""
    return event_time(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def daily_totals(df: DataFrame, ts: str, value: str, delay: str = "2 days") -> DataFrame:
    """Running totals per calendar day; late rows count while the delay lasts."""
    return (
        event_time(df, ts).withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day").alias("w"))
        .agg(F.sum(value).alias(f"{value}_sum"), F.count("*").alias("transaction_count"))
        .select(F.to_date("w.start").alias("date"), f"{value}_sum", "transaction_count")
    )


def stream_daily_spikes(
    df: DataFrame, ts: str, value: str, target: str, checkpoint: str, delay: str = "2 days",
    method: str = "zscore", threshold: float | None = None, on_flags: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Keep daily totals under ``target`` and test them for spikes and drops after every micro-batch.

    Updated days are appended with the batch number; the newest number per day counts, which
    makes a replayed batch harmless.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(target)
        if on_flags:
            on_flags(series.spikes_and_drops(current_totals(session, target, value), f"{value}_sum", ["date"], method, threshold, small=True), batch_id)

    totals = daily_totals(df, ts, value, delay)
    return (
        totals.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_totals(spark: SparkSession, target: str, value: str) -> DataFrame:
    """The newest total of each day."""
    kept = spark.read.parquet(target)
    newest = F.max_by(F.struct(f"{value}_sum", "transaction_count"), "batch_id").alias("s")
    return kept.groupBy("date").agg(newest).select("date", "s.*")


# --- live flags with state ----------------------------------------------------------------------

_DAY_STATE = "days array<int>, sums array<double>, counts array<long>, kinds array<string>, version long"
_DAY_FLAGS = "day int, total double, count long, kind string, version long"


def _by_day(ts: str, value: str):
    """Totals per day of each batch of a task, so that few rows go on to the state."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            days = (rows[ts] - pd.Timestamp("1970-01-01")) // pd.Timedelta(days=1)
            known = rows.assign(day=days).dropna(subset=["day"])
            sums = known.groupby("day")[value].agg(["sum", "size"]).reset_index()
            yield pd.DataFrame({"all": 0, "day": sums["day"].astype("int32"), "total": sums["sum"].astype(float), "count": sums["size"].astype("int64")})

    return work


def _flagged(threshold: float):
    """The state of all days: totals, the kind told last, and with them count, mean and spread; tells days that change."""

    def work(_key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days, sums, counts, kinds, version = state.get if state.exists else ([], [], [], [], 0)
        held = {d: [s, c, k, False] for d, s, c, k in zip(days, sums, counts, kinds, strict=True)}
        for part in parts:
            for d, total, n in zip(part["day"].tolist(), part["total"].tolist(), part["count"].tolist(), strict=True):
                day = held.setdefault(d, [0.0, 0, None, True])
                day[0], day[1], day[3] = day[0] + total, day[1] + n, True
        mean = sum(x[0] for x in held.values()) / max(1, len(held))
        spread = (sum((x[0] - mean) ** 2 for x in held.values()) / max(1, len(held))) ** 0.5
        told = []
        for d, day in sorted(held.items()):
            z = (day[0] - mean) / spread if spread > 0 else 0.0
            kind = "spike" if z > threshold else "drop" if z < -threshold else None
            if day[3] or kind != day[2]:
                day[2] = kind
                told.append((d, day[0], day[1], kind, version + 1))
        order = sorted(held)
        state.update((order, [held[d][0] for d in order], [held[d][1] for d in order], [held[d][2] for d in order], version + 1))
        yield pd.DataFrame(told, columns=["day", "total", "count", "kind", "version"]).astype({"kind": object})

    return work


def stream_daily_flags(
    df: DataFrame, ts: str, value: str, target: str, checkpoint: str, threshold: float = 2.0,
) -> StreamingQuery:
    """Daily totals and their spikes and drops by z-score, kept in the state store; changes are appended to ``target``.

    Each task sums its rows by day, and one state of all days, some numbers a day however many rows there are, keeps the
    totals, their count, mean and spread and the flag that was told last. A micro-batch thus reads nothing that was written
    before, and writes the days whose total or flag changed. Rows count whenever they come; those without a time or a
    value are left out. The newest version of a day counts (`current_flags`), so a replayed batch changes nothing.
    """
    known = event_time(df, ts).select(ts, F.col(value).cast("double").alias(value)).dropna()
    sums = known.mapInPandas(_by_day(ts, value), "all int, day int, total double, count long")
    flags = sums.groupBy("all").applyInPandasWithState(_flagged(threshold), _DAY_FLAGS, _DAY_STATE, "update", GroupStateTimeout.NoTimeout)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(target)

    return (
        flags.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_flags(spark: SparkSession, target: str, value: str) -> DataFrame:
    """date, <value>_sum, transaction_count and kind of each day, as told last."""
    newest = F.max_by(F.struct("total", "count", "kind"), "version").alias("s")
    return spark.read.parquet(target).groupBy("day").agg(newest).select(
        F.date_from_unix_date("day").alias("date"), F.col("s.total").alias(f"{value}_sum"), F.col("s.count").alias("transaction_count"), "s.kind")
