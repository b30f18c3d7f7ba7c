"""Anomaly queries over events and lineitem."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bindings.registry import query, read, rounded
from txnlake.operators import anomalies
from txnlake.plans.running_percentile import running_percentile

# Events with missing amounts, blank merchants and tied times, to exercise the rules.
HISTORY = {
    "event_id": "event_id",
    "user_id": "user_id",
    "ts": "date_trunc('hour', ts)",
    "merchant": "CASE WHEN event_id % 29 = 0 THEN '  ' WHEN event_id % 31 = 0 THEN NULL "
                "WHEN event_id % 2 = 0 THEN upper(event_type) || ' ' ELSE event_type END",
    "amount": "CASE WHEN event_id % 23 = 0 THEN NULL ELSE value END",
}
HISTORY_LIST = [f"{expr} AS {name}" for name, expr in HISTORY.items()]
WITH_HISTORY = f"""WITH h AS (SELECT {', '.join(HISTORY_LIST)} FROM events),
 k AS (SELECT *, nullif(trim(lower(merchant)), '') AS mk, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM h),
 f AS (SELECT *,
  coalesce(count(*) OVER past >= 10 AND amount > quantile_cont(amount, 0.9) OVER past, false) AS high_value,
  mk IS NOT NULL AND coalesce(lag(ts, 2) OVER same >= ts - INTERVAL 24 HOUR, false) AS burst_frequency,
  mk IS NOT NULL AND coalesce(rn - lag(rn) OVER same > 100, true) AS unknown_merchant
 FROM k WINDOW past AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  same AS (PARTITION BY user_id, mk ORDER BY ts, event_id)),
 g AS (SELECT *, list_filter([CASE WHEN high_value THEN 'high_value' END, CASE WHEN burst_frequency THEN 'burst_frequency' END,
  CASE WHEN unknown_merchant THEN 'unknown_merchant' END], lambda x: x IS NOT NULL) AS flags FROM f),
 a AS (SELECT *, nullif(array_to_string(flags, ','), '') AS anomalies FROM g) """


def _history(spark, sf):
    return read(spark, sf, "events").selectExpr(*HISTORY_LIST)


def _flagged(spark, sf):
    return anomalies.detect_anomalies(_history(spark, sf), "amount", "merchant", "ts", "event_id", ["user_id"])


@query("w7_running_percentile", """SELECT event_id, round(quantile_cont(value, 0.9) OVER w, 6) AS running_pct, count(*) OVER w AS earlier_rows
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    events = read(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    out = running_percentile(events, "value", 0.9, ["user_id"], [F.col("ts"), F.col("event_id")])
    return rounded(out.select("event_id", "running_pct", "earlier_rows"), 6)


@query("a1_flag_high_value", WITH_HISTORY + "SELECT event_id, high_value FROM f")
def _(spark, sf):
    out = anomalies.flag_high_value(_history(spark, sf), "amount", "ts", "event_id", ["user_id"])
    return out.select("event_id", "high_value")


@query("a1_flag_high_value_one_history", """WITH f AS (SELECT event_id,
  coalesce(count(*) OVER past >= 10 AND value > quantile_cont(value, 0.9) OVER past, false) AS high_value
 FROM events WINDOW past AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT event_id, high_value FROM f""")
def _(spark, sf):
    """All rows as one history: a single group of any size, worked on in blocks."""
    events = read(spark, sf, "events").select("event_id", "ts", "value")
    return anomalies.flag_high_value(events, "value", "ts", "event_id").select("event_id", "high_value")


@query("a2_flag_burst", WITH_HISTORY + "SELECT event_id, burst_frequency FROM f")
def _(spark, sf):
    out = anomalies.flag_burst(_history(spark, sf), "merchant", "ts", "event_id", ["user_id"])
    return out.select("event_id", "burst_frequency")


@query("a3_flag_unknown_merchant", WITH_HISTORY + "SELECT event_id, unknown_merchant FROM f")
def _(spark, sf):
    out = anomalies.flag_unknown_merchant(_history(spark, sf), "merchant", "ts", "event_id", ["user_id"])
    return out.select("event_id", "unknown_merchant")


@query("a4_detect_anomalies", WITH_HISTORY + "SELECT event_id, user_id, anomalies FROM a")
def _(spark, sf):
    return _flagged(spark, sf).select("event_id", "user_id", "anomalies")


@query("a5_pick_columns", "SELECT 'amount' AS role, amount AS n FROM (SELECT count(value) AS amount FROM events) UNION ALL "
       "SELECT 'merchant', count(event_type) FROM events UNION ALL SELECT 'ts', count(ts) FROM events")
def _(spark, sf):
    """Finds the columns of a renamed table by their usual names, and counts through them."""
    table = read(spark, sf, "events").select("value", F.col("event_type").alias("Payee"), F.col("ts").alias("timestamp"))
    roles = anomalies.pick_columns(table)
    wide = table.agg(*[F.count(c).alias(r) for r, c in roles.items()])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("n")) for r in roles])))


@query("j7_burst_counts", WITH_HISTORY + """SELECT event_id, cast(CASE WHEN mk IS NULL THEN 0 ELSE (SELECT count(*) FROM k b
 WHERE b.user_id = k.user_id AND b.mk = k.mk AND b.ts >= k.ts - INTERVAL 24 HOUR AND (b.ts < k.ts OR (b.ts = k.ts AND b.event_id < k.event_id))) END AS BIGINT) AS in_window FROM k""")
def _(spark, sf):
    out = anomalies.burst_counts(_history(spark, sf), "merchant", "ts", "event_id", ["user_id"])
    return out.select("event_id", "in_window")


@query("j7_burst_counts_repeating_ids", WITH_HISTORY + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nr FROM k)
 SELECT user_id, nr, cast(CASE WHEN mk IS NULL THEN 0 ELSE (SELECT count(*) FROM r b
 WHERE b.user_id = r.user_id AND b.mk = r.mk AND b.ts >= r.ts - INTERVAL 24 HOUR AND (b.ts < r.ts OR (b.ts = r.ts AND b.nr < r.nr))) END AS BIGINT) AS in_window FROM r""")
def _(spark, sf):
    """Rows are told apart by a number that starts anew with every user."""
    numbered = _history(spark, sf).withColumn("nr", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    return anomalies.burst_counts(numbered, "merchant", "ts", "nr", ["user_id"]).select("user_id", "nr", "in_window")


@query("g30_anomaly_report", WITH_HISTORY + """SELECT count(*) AS total_transactions, count(anomalies) AS total_anomalies,
 count(*) FILTER (high_value) AS high_value_count, count(*) FILTER (burst_frequency) AS burst_frequency_count,
 count(*) FILTER (unknown_merchant) AS unknown_merchant_count, round(count(anomalies) / count(*), 6) AS anomaly_rate FROM a""")
def _(spark, sf):
    return rounded(anomalies.anomaly_report(_flagged(spark, sf)), 6)


@query("p13_select_anomalies", WITH_HISTORY + "SELECT event_id, anomalies FROM a WHERE anomalies IS NOT NULL")
def _(spark, sf):
    return anomalies.select_anomalies(_flagged(spark, sf)).select("event_id", "anomalies")


@query("g37_anomaly_spend", WITH_HISTORY + """SELECT count(anomalies) AS anomaly_count, round(count(anomalies) * 100.0 / count(*), 5) AS anomaly_rate,
 round(coalesce(sum(amount) FILTER (anomalies IS NOT NULL), 0.0), 2) AS anomaly_total,
 round(avg(amount) FILTER (anomalies IS NOT NULL), 4) AS anomaly_mean FROM a""")
def _(spark, sf):
    return rounded(anomalies.anomaly_spend(_flagged(spark, sf), "amount"), 5, anomaly_total=2, anomaly_mean=4)


@query("a10_top_anomalies", WITH_HISTORY + """SELECT event_id, amount, anomalies FROM a WHERE anomalies IS NOT NULL
 ORDER BY amount DESC NULLS LAST, event_id LIMIT 5""")
def _(spark, sf):
    return anomalies.top_anomalies(_flagged(spark, sf), "amount", "event_id").select("event_id", "amount", "anomalies")


def _z(col):
    return f"""SELECT l_orderkey, l_linenumber, {col} AS v, '{col}' AS anomaly_column FROM lineitem,
 (SELECT avg({col}) AS m, stddev_samp({col}) AS s FROM lineitem) WHERE abs(({col} - m) / s) > 1.7"""


@query("a6_zscore_anomalies", " UNION ALL ".join(_z(c) for c in ("l_extendedprice", "l_quantity")))
def _(spark, sf):
    items = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    out = anomalies.zscore_anomalies(items, ["l_extendedprice", "l_quantity"], 1.7)
    v = F.when(F.col("anomaly_column") == "l_quantity", F.col("l_quantity")).otherwise(F.col("l_extendedprice"))
    return out.select("l_orderkey", "l_linenumber", v.alias("v"), "anomaly_column")


@query("a7_iqr_anomalies", """SELECT event_id, value, 'value' AS anomaly_column FROM events,
 (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
 WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def _(spark, sf):
    events = read(spark, sf, "events").select("event_id", "value")
    return anomalies.iqr_anomalies(events, ["value"]).select("event_id", "value", "anomaly_column")
