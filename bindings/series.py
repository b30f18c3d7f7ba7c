"""Time-series and cash-flow queries over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import longs, query, read, rounded, texts
from txnlake.operators import cashflow, clean, series

DAILY = (
    "daily AS (SELECT cast(o_orderdate AS date) AS d, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1)"
)
MONTHLY = (
    "monthly AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1)"
)


def _orders(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


def _daily(spark, sf):
    return series.summarize_by_day(_orders(spark, sf), "o_totalprice", "o_orderdate")


def _hour_sql(kind: str, expr: str) -> str:
    return (
        f"SELECT h.hour, round(coalesce(v, 0.0), 4) AS value_{kind}, coalesce(n, 0) AS transaction_count "
        f"FROM (SELECT range AS hour FROM range(24)) h LEFT JOIN "
        f"(SELECT hour(ts) AS hh, cast({expr} AS double) AS v, count(*) AS n FROM events GROUP BY 1) e ON h.hour = e.hh"
    )


HOUR_KINDS = {
    "sum": "sum(value)", "mean": "avg(value)", "count": "count(value)", "min": "min(value)", "max": "max(value)",
}


@query("p12_validate_series", """
SELECT cast(d AS date)::VARCHAR AS day, count(*) AS n FROM (
  SELECT try_strptime(CASE WHEN event_id % 10 = 0 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d') END, '%Y-%m-%d') AS d FROM events
) WHERE d IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    raw = read(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 10 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("created_at")
    )
    valid, name = series.validate_series(raw)
    return valid.groupBy(F.to_date(name).cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("g1_summarize_by_hour", _hour_sql("sum", "sum(value)"))
def _(spark, sf):
    return longs(rounded(series.summarize_by_hour(read(spark, sf, "events"), "value", "ts")))


@query("g4_aggregation_kinds", " UNION ALL ".join(
    f"SELECT '{k}' AS kind, hour, value_{k} AS v, transaction_count FROM ({_hour_sql(k, e)})" for k, e in HOUR_KINDS.items()))
def _(spark, sf):
    events = read(spark, sf, "events")
    parts = [
        series.summarize_by_hour(events, "value", "ts", k)
        .select(F.lit(k).alias("kind"), "hour", F.col(f"value_{k}").alias("v"), "transaction_count")
        for k in HOUR_KINDS
    ]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return longs(rounded(result))


@query("g2_summarize_by_day", f"""WITH {DAILY}
SELECT d::VARCHAR AS date, round(s, 2) AS o_totalprice_sum, n AS transaction_count, dayname(d) AS day_of_week FROM daily""")
def _(spark, sf):
    return texts(rounded(_daily(spark, sf), 2), "date")


@query("g2_summarize_by_day_custom_aggregate", """
SELECT cast(ts AS date)::VARCHAR AS date, round(max(value) - min(value), 4) AS value_spread, count(*) AS transaction_count,
       dayname(cast(ts AS date)) AS day_of_week FROM events GROUP BY cast(ts AS date)""")
def _(spark, sf):
    def spread(v):
        return F.max(v) - F.min(v)

    return texts(rounded(series.summarize_by_day(read(spark, sf, "events"), "value", "ts", spread)), "date")


@query("g3_summarize_by_month", """
SELECT strftime(o_orderdate, '%Y-%m') AS year_month, round(sum(o_totalprice), 2) AS o_totalprice_sum,
  count(*) AS transaction_count, year(o_orderdate) AS year, month(o_orderdate) AS month, monthname(o_orderdate) AS month_name
FROM orders GROUP BY 1, 4, 5, 6""")
def _(spark, sf):
    return longs(rounded(series.summarize_by_month(_orders(spark, sf), "o_totalprice", "o_orderdate"), 2))


@query("g36_weekday_profile", f"""WITH {DAILY}
SELECT isodow(d) - 1 AS weekday, dayname(d) AS day_of_week, round(avg(n), 4) AS avg_count, round(avg(s), 2) AS avg_total
FROM daily GROUP BY 1, 2""")
def _(spark, sf):
    return longs(rounded(series.weekday_profile(_orders(spark, sf), "o_totalprice", "o_orderdate"), 4, avg_total=2))


@query("t3_peak_hours", f"""WITH h AS ({_hour_sql('sum', 'sum(value)')}), r AS (
 SELECT 'busiest' AS side, row_number() OVER (ORDER BY value_sum DESC, hour) AS rank, * FROM h UNION ALL
 SELECT 'quietest', row_number() OVER (ORDER BY value_sum, hour), * FROM h) SELECT * FROM r WHERE rank <= 5""")
def _(spark, sf):
    return longs(rounded(series.peak_hours(read(spark, sf, "events"), "value", "ts")))


@query("t4_peak_months", f"""WITH {MONTHLY}
SELECT (SELECT m FROM monthly ORDER BY s DESC, m LIMIT 1) AS best_month, round(max(s), 2) AS best_total,
 (SELECT m FROM monthly ORDER BY s, m LIMIT 1) AS worst_month, round(min(s), 2) AS worst_total, round(avg(s), 2) AS mean_total
FROM monthly""")
def _(spark, sf):
    return rounded(series.peak_months(_orders(spark, sf), "o_totalprice", "o_orderdate"), 2)


@query("w1_moving_averages", f"""WITH {DAILY}
SELECT d::VARCHAR AS date, round(s, 2) AS o_totalprice_sum,
 round(avg(s) OVER (ORDER BY d ROWS 6 PRECEDING), 3) AS o_totalprice_sum_ma7,
 round(avg(s) OVER (ORDER BY d ROWS 13 PRECEDING), 3) AS o_totalprice_sum_ma14,
 round(avg(s) OVER (ORDER BY d ROWS 29 PRECEDING), 3) AS o_totalprice_sum_ma30 FROM daily""")
def _(spark, sf):
    days = _daily(spark, sf).select("date", "o_totalprice_sum")
    return texts(rounded(series.moving_averages(days, "o_totalprice_sum", ["date"], small=True), 3, o_totalprice_sum=2), "date")


@query("w1_moving_averages_per_user", """
SELECT event_id, round(avg(value) OVER w3, 5) AS value_ma3, round(avg(value) OVER w10, 5) AS value_ma10 FROM events
WINDOW w3 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING),
       w10 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING)""")
def _(spark, sf):
    events = read(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    out = series.moving_averages(events, "value", ["ts", "event_id"], (3, 10), ["user_id"])
    return rounded(out.select("event_id", "value_ma3", "value_ma10"), 5)


@query("w2_pct_change", f"""WITH {DAILY}
SELECT d::VARCHAR AS date, round((s / lag(s) OVER (ORDER BY d) - 1) * 100, 5) AS o_totalprice_sum_pct_change FROM daily""")
def _(spark, sf):
    out = series.pct_change(_daily(spark, sf), "o_totalprice_sum", ["date"], small=True)
    return texts(rounded(out.select("date", "o_totalprice_sum_pct_change"), 5), "date")


@query("w2_pct_change_zero_base", """
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE value END AS v FROM events)
SELECT event_id, round((v / nullif(lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) - 1) * 100, 4) AS v_pct_change FROM e""")
def _(spark, sf):
    events = read(spark, sf, "events").select(
        "event_id", "user_id", "ts", F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("value")).alias("v")
    )
    return rounded(series.pct_change(events, "v", ["ts", "event_id"], ["user_id"]).select("event_id", "v_pct_change"))


@query("w3_trends", f"""WITH {DAILY}, m AS (SELECT d, avg(s) OVER (ORDER BY d ROWS 6 PRECEDING) AS ma FROM daily)
SELECT d::VARCHAR AS date, round(ma, 3) AS o_totalprice_sum_ma7,
 round(ma - lag(ma) OVER (ORDER BY d), 3) AS o_totalprice_sum_trend FROM m""")
def _(spark, sf):
    out = series.trends(_daily(spark, sf), "o_totalprice_sum", ["date"], small=True)
    return texts(rounded(out.select("date", "o_totalprice_sum_ma7", "o_totalprice_sum_trend"), 3), "date")


@query("w4_cumulative_spend", f"""WITH {MONTHLY}
SELECT m AS year_month, round(s, 2) AS total, round(sum(s) OVER (ORDER BY m), 2) AS cumulative FROM monthly""")
def _(spark, sf):
    return rounded(series.cumulative_spend(_orders(spark, sf), "o_totalprice", "o_orderdate"), 2)


FILL = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END"


def _fill_sql(fn: str, frame: str) -> str:
    return (
        f"SELECT event_id, {fn}({FILL} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id "
        f"ROWS BETWEEN {frame}) AS v FROM events"
    )


def _gappy(spark, sf):
    return read(spark, sf, "events").selectExpr("event_id", "user_id", "ts", f"{FILL} AS v")


@query("w5_fill_missing_forward", _fill_sql("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"))
def _(spark, sf):
    return clean.fill_missing(_gappy(spark, sf), "forward_fill", ["v"], ["ts", "event_id"], ["user_id"]).select("event_id", "v")


@query("w5_fill_missing_backward", _fill_sql("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
def _(spark, sf):
    return clean.fill_missing(_gappy(spark, sf), "backward_fill", ["v"], ["ts", "event_id"], ["user_id"]).select("event_id", "v")


@query("w6_growth_rate", """
WITH f AS (SELECT user_id, arg_min(value, (ts, event_id)) AS a, arg_max(value, (ts, event_id)) AS b FROM events GROUP BY 1)
SELECT user_id, a AS first_value, b AS last_value, round((b - a) / nullif(a, 0) * 100, 4) AS growth_rate FROM f""")
def _(spark, sf):
    return rounded(series.growth_rate(read(spark, sf, "events"), "value", "ts", "event_id", ["user_id"]), 4)


@query("w8_rank_periods", f"""WITH {MONTHLY}
SELECT m AS year_month, row_number() OVER (ORDER BY s DESC, m) AS rank_desc, row_number() OVER (ORDER BY s, m) AS rank_asc FROM monthly""")
def _(spark, sf):
    months = series.summarize_by_month(_orders(spark, sf), "o_totalprice", "o_orderdate")
    ranked = series.rank_periods(months, "o_totalprice_sum", "year_month", small=True)
    return ranked.select("year_month", "rank_desc", "rank_asc")


@query("w9_decompose", f"""WITH {DAILY}, t AS (
 SELECT d, s, (row_number() OVER (ORDER BY d) - 1) % 7 AS ph,
  CASE WHEN count(*) OVER c = 7 THEN avg(s) OVER c END AS trend FROM daily
 WINDOW c AS (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
 p AS (SELECT ph, avg(s - trend) AS raw FROM t GROUP BY 1), q AS (SELECT ph, raw - (SELECT avg(raw) FROM p) AS seasonal FROM p)
SELECT d::VARCHAR AS date, round(trend, 3) AS trend, round(seasonal, 3) AS seasonal, round(s - trend - seasonal, 3) AS residual
FROM t JOIN q USING (ph)""")
def _(spark, sf):
    out = series.decompose(_daily(spark, sf), "o_totalprice_sum", ["date"], 7)
    return texts(rounded(out.select("date", "trend", "seasonal", "residual"), 3), "date")


@query("g5_performance_indicators", """
SELECT count(*) AS total_transactions, round(sum(o_totalprice), 2) AS total_value, round(avg(o_totalprice), 4) AS average_value,
 round(median(o_totalprice), 4) AS median_value, round(stddev_pop(o_totalprice), 4) AS std_deviation,
 min(o_totalprice) AS min_value, max(o_totalprice) AS max_value, round(max(o_totalprice) - min(o_totalprice), 4) AS value_range,
 round(stddev_pop(o_totalprice) / avg(o_totalprice), 6) AS coefficient_of_variation,
 strftime(min(o_orderdate), '%Y-%m-%d') AS start, strftime(max(o_orderdate), '%Y-%m-%d') AS "end",
 date_diff('day', min(o_orderdate), max(o_orderdate)) AS days,
 round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS q2,
 round(quantile_cont(o_totalprice, 0.75), 4) AS q3,
 round((arg_max(o_totalprice, (o_orderdate, o_orderkey)) - arg_min(o_totalprice, (o_orderdate, o_orderkey)))
   / arg_min(o_totalprice, (o_orderdate, o_orderkey)) * 100, 4) AS growth_rate FROM orders""")
def _(spark, sf):
    out = series.performance_indicators(_orders(spark, sf), "o_totalprice", "o_orderdate", "o_orderkey")
    out = out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("start", "end")})
    return rounded(out, 4, total_value=2, coefficient_of_variation=6)


SPIKE_Z = """SELECT *, CASE WHEN s > m + 2.0 * sd THEN 'spike' WHEN s < m - 2.0 * sd THEN 'drop' END AS kind FROM (
 SELECT d, s, n, row_number() OVER (ORDER BY d) - 1 AS i, avg(s) OVER () AS m, stddev_pop(s) OVER () AS sd FROM daily)"""
SPIKE_IQR = """SELECT *, CASE WHEN s > q3 + 1.5 * (q3 - q1) THEN 'spike' WHEN s < q1 - 1.5 * (q3 - q1) THEN 'drop' END AS kind FROM (
 SELECT d, s, n, row_number() OVER (ORDER BY d) - 1 AS i, quantile_cont(s, 0.25) OVER () AS q1, quantile_cont(s, 0.75) OVER () AS q3 FROM daily)"""


def _spikes(spark, sf, method, threshold):
    out = series.spikes_and_drops(_daily(spark, sf), "o_totalprice_sum", ["date"], method, threshold, small=True)
    return texts(rounded(out.select("index", "kind", "date", "o_totalprice_sum", "transaction_count"), 2), "date")


@query("a8_spikes_and_drops_zscore", f"""WITH {DAILY} SELECT i AS index, kind, d::VARCHAR AS date,
 round(s, 2) AS o_totalprice_sum, n AS transaction_count FROM ({SPIKE_Z}) WHERE kind IS NOT NULL""")
def _(spark, sf):
    return _spikes(spark, sf, "zscore", 2.0)


@query("a8_spikes_and_drops_iqr", f"""WITH {DAILY} SELECT i AS index, kind, d::VARCHAR AS date,
 round(s, 2) AS o_totalprice_sum, n AS transaction_count FROM ({SPIKE_IQR}) WHERE kind IS NOT NULL""")
def _(spark, sf):
    return _spikes(spark, sf, "iqr", None)


@query("t1_top_periods", f"""WITH {DAILY}, r AS (
 SELECT d, s, n, row_number() OVER (ORDER BY s DESC, d) AS up, row_number() OVER (ORDER BY s, d) AS down, count(*) OVER () AS c FROM daily)
SELECT 'top' AS side, up AS rank, d::VARCHAR AS date, round(s, 2) AS o_totalprice_sum, n AS transaction_count, c AS total_periods FROM r WHERE up <= 10
UNION ALL SELECT 'bottom', down, d::VARCHAR, round(s, 2), n, c FROM r WHERE down <= 10""")
def _(spark, sf):
    out = series.top_periods(_daily(spark, sf), "o_totalprice_sum", 10, "all", "date").drop("day_of_week")
    return longs(texts(rounded(out, 2), "date"))


FLOWS = "(SELECT o_custkey % 5 AS grp, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS amt FROM orders)"


def _flows(spark, sf):
    return read(spark, sf, "orders").selectExpr(
        "o_custkey % 5 AS grp", "o_orderdate", "CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS amt"
    )


def _cash_sql(group: str) -> str:
    g, by, on = ("grp, ", "GROUP BY grp", "AND s.grp = n.grp") if group else ("", "", "")
    span_g = "grp, " if group else ""
    return f"""n AS (SELECT {g}date_trunc('month', o_orderdate)::DATE AS m, sum(amt) AS net FROM {FLOWS} GROUP BY ALL),
 s AS (SELECT {span_g}unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH))::DATE AS m FROM n {by}),
 f AS (SELECT {'s.grp, ' if group else ''}coalesce(net, 0.0) AS net FROM s LEFT JOIN n ON s.m = n.m {on}),
 st AS (SELECT {g}count(*) AS months, coalesce(avg(net) FILTER (net > 0), 0.0) AS income_mean,
 CASE WHEN count(*) FILTER (net > 0) = 0 THEN 0.0 ELSE stddev_samp(net) FILTER (net > 0) END AS income_std,
 coalesce(avg(-net) FILTER (net < 0), 0.0) AS expense_mean,
 CASE WHEN count(*) FILTER (net < 0) = 0 THEN 0.0 ELSE stddev_samp(-net) FILTER (net < 0) END AS expense_std,
 avg(net) AS net_mean FROM f {by})"""


STATS = ["income_mean", "income_std", "expense_mean", "expense_std", "net_mean"]


@query("g33_cashflow_stats", f"""WITH {_cash_sql('')} SELECT months, {', '.join(f'round({c}, 2) AS {c}' for c in STATS)} FROM st""")
def _(spark, sf):
    return rounded(cashflow.cashflow_stats(_flows(spark, sf), "amt", "o_orderdate"), 2)


@query("g33_cashflow_stats_by_group", f"""WITH {_cash_sql('grp')} SELECT grp, months, {', '.join(f'round({c}, 2) AS {c}' for c in STATS)} FROM st""")
def _(spark, sf):
    return rounded(cashflow.cashflow_stats(_flows(spark, sf), "amt", "o_orderdate", ["grp"]), 2)


@query("g34_recommend_allocations", f"""WITH {_cash_sql('grp')},
 p AS (SELECT * FROM (VALUES ('conservative', 6, 0.45::DOUBLE), ('balanced', 4, 0.6::DOUBLE), ('aggressive', 3, 0.75::DOUBLE)) t(risk_level, reserve_months, equity))
SELECT grp, risk_level, round(cast(greatest(expense_mean * reserve_months, 0.0) AS decimal(38,6)), 2)::DOUBLE AS emergency_fund,
 round(cast(greatest(net_mean, 0.0) * equity * 12 AS decimal(38,6)), 2)::DOUBLE AS growth_allocation,
 round(cast((greatest(net_mean, 0.0) - greatest(net_mean, 0.0) * equity) * 12 AS decimal(38,6)), 2)::DOUBLE AS cash_buffer,
 round(cast(greatest(net_mean, 0.0) AS decimal(38,6)), 2)::DOUBLE AS monthly_savings_capacity FROM st, p""")
def _(spark, sf):
    stats = cashflow.cashflow_stats(_flows(spark, sf), "amt", "o_orderdate", ["grp"])
    return cashflow.recommend_allocations(stats).select(
        "grp", "risk_level", "emergency_fund", "growth_allocation", "cash_buffer", "monthly_savings_capacity"
    )


@query("g35_percentile_bands", "SELECT o_orderpriority, " + ", ".join(
    f"round(quantile_cont(o_totalprice, {p / 100}), 4) AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM orders GROUP BY 1")
def _(spark, sf):
    return rounded(cashflow.percentile_bands(read(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice"), 4)
