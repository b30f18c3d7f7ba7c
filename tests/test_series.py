import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txnlake.operators import cashflow, reports, series


@pytest.fixture(scope="module")
def hourly(spark):
    start, rows, rng = dt.datetime(2024, 1, 1), [], np.random.default_rng(0)
    for i in range(30 * 24):
        ts = start + dt.timedelta(hours=i)
        amount = (200 if 9 <= ts.hour <= 17 else 100) + int(rng.integers(-20, 20))
        rows.append((i, ts, 500 if i == 100 else 10 if i == 200 else amount))
    return pd.DataFrame(rows, columns=["id", "ts", "amount"]), spark.createDataFrame(rows, "id long, ts timestamp, amount int")


def test_hours(hourly):
    pdf, df = hourly
    rows = series.summarize_by_hour(df, "amount", "ts").collect()
    assert [r["hour"] for r in rows] == list(range(24))
    want = pdf.groupby(pdf.ts.dt.hour).amount.sum()
    assert [r["amount_sum"] for r in rows] == list(want) and all(r["transaction_count"] == 30 for r in rows)


def test_hours_without_rows_show_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), 2.0)], "ts timestamp, v double")
    rows = series.summarize_by_hour(df, "v", "ts", "mean").collect()
    assert [r["v_mean"] for r in rows] == [2.0 if h == 5 else 0.0 for h in range(24)]


def test_days_and_months(hourly):
    pdf, df = hourly
    days = series.summarize_by_day(df, "amount", "ts", "mean").collect()
    assert len(days) == 30 and days[0]["day_of_week"] == "Monday"
    assert np.allclose([r["amount_mean"] for r in days], pdf.groupby(pdf.ts.dt.date).amount.mean())
    month = series.summarize_by_month(df, "amount", "ts").first()
    assert (month["year_month"], month["year"], month["month"], month["month_name"]) == ("2024-01", 2024, 1, "January")


def test_unknown_aggregation(hourly):
    with pytest.raises(ValueError):
        series.summarize_by_hour(hourly[1], "amount", "ts", "mode")


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), None)], "ts timestamp, v double")
    assert series.summarize_by_day(df, "v", "ts").first()["v_sum"] == 0
    assert series.summarize_by_day(df, "v", "ts", "count").first()["v_count"] == 0


def test_validate(spark, hourly):
    df = spark.createDataFrame([("2024-01-05", 1), ("bad", 2), (None, 3), ("15/01/2024", 4)], "created string, v int")
    valid, name = series.validate_series(df)
    assert name == "created" and sorted(r["v"] for r in valid.collect()) == [1, 4]
    with pytest.raises(ValueError):
        series.validate_series(df.filter("v = 2"))
    with pytest.raises(ValueError):
        series.validate_series(df.select("v"))


def test_spike_and_drop(hourly):
    _, df = hourly
    out = series.spikes_and_drops(df, "amount", ["ts"], "zscore", 2.5).collect()
    assert {(r["kind"], r["index"]) for r in out} >= {("spike", 100)}
    flat = df.withColumn("amount", F.lit(5))
    assert series.spikes_and_drops(flat, "amount", ["ts"]).count() == 0
    with pytest.raises(ValueError):
        series.spikes_and_drops(df, "amount", ["ts"], "other")


def test_moving_averages_match_rolling_means(crowded, hourly):
    pdf, df = hourly
    out = series.moving_averages(df, "amount", ["ts"], (3, 10)).orderBy("ts").toPandas()
    for n in (3, 10):
        assert np.allclose(out[f"amount_ma{n}"], pdf.amount.rolling(n, min_periods=1).mean())
    trend = series.trends(df, "amount", ["ts"], 5).orderBy("ts").toPandas()
    assert np.allclose(trend.amount_trend[1:], pdf.amount.rolling(5, min_periods=1).mean().diff()[1:])
    change = series.pct_change(df, "amount", ["ts"]).orderBy("ts").toPandas()
    assert np.allclose(change.amount_pct_change[1:], pdf.amount.pct_change()[1:] * 100)


def test_performance(hourly):
    pdf, df = hourly
    r = series.performance_indicators(df, "amount", "ts", "id").first()
    assert r["total_transactions"] == 720 and abs(r["std_deviation"] - np.std(pdf.amount)) < 1e-9
    assert r["median_value"] == np.median(pdf.amount) and r["days"] == 29
    assert abs(r["growth_rate"] - (pdf.amount.iloc[-1] / pdf.amount.iloc[0] - 1) * 100) < 1e-9


def test_growth_on_zero_base(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 0.0), (2, dt.datetime(2024, 1, 2), 4.0)], "id int, ts timestamp, v double")
    assert series.growth_rate(df, "v", "ts", "id").first()["growth_rate"] is None


def test_top_periods(hourly):
    _, df = hourly
    out = series.top_periods(df, "amount", 3, "all", "ts").collect()
    top = sorted((r for r in out if r["side"] == "top"), key=lambda r: r["rank"])
    bottom = sorted((r for r in out if r["side"] == "bottom"), key=lambda r: r["rank"])
    assert top[0]["amount"] == 500 and bottom[0]["amount"] == 10 and out[0]["total_periods"] == 720
    assert series.top_periods(df, "amount", 3, "positive", "ts").count() == 3


def test_decompose_even_and_odd_period(spark):
    values = [float(i % 4) + 0.5 * i for i in range(24)]
    df = spark.createDataFrame(list(enumerate(values)), "t int, v double")
    for period in (4, 5):
        out = series.decompose(df, "v", ["t"], period).orderBy("t").toPandas()
        half = period // 2
        weights = np.ones(period) / period if period % 2 else np.array([0.5, 1, 1, 1, 0.5]) / 4
        want = np.convolve(values, weights, "valid")
        assert np.allclose(out.trend.iloc[half:len(values) - half], want) and out.trend.iloc[:half].isna().all()
    assert np.allclose(series.decompose(df, "v", ["t"], 4).toPandas().residual.dropna(), 0)


def test_cashflow_fills_empty_months(spark):
    rows = [(dt.date(2024, 1, 5), 100.0), (dt.date(2024, 1, 9), -40.0), (dt.date(2024, 4, 1), -30.0)]
    r = cashflow.cashflow_stats(spark.createDataFrame(rows, "d date, a double"), "a", "d").first()
    assert (r["months"], r["income_mean"], r["expense_mean"], r["net_mean"]) == (4, 60.0, 30.0, 7.5)
    assert r["income_std"] is None
    stats = spark.createDataFrame([(1000.0, 500.0)], "expense_mean double, net_mean double")
    got = {x["risk_level"]: x for x in cashflow.recommend_allocations(stats).collect()}
    assert got["balanced"]["emergency_fund"] == 4000 and got["balanced"]["growth_allocation"] == 3600
    assert got["conservative"]["cash_buffer"] == 3300


def test_percentile_bands(crowded):
    df = crowded.createDataFrame([(i % 2, float(i)) for i in range(60)], "g int, v double")
    for r in cashflow.percentile_bands(df, ["g"], "v").collect():
        assert np.allclose([r["p5"], r["p50"], r["p95"]], np.percentile(np.arange(r["g"], 60, 2), [5, 50, 95]))


def test_pivots(spark):
    rows = [("2024-01-02", "A", 10.0), ("2024-02-03", "B", 5.0), ("2024-02-04", "A", 1.0)]
    df = spark.createDataFrame(rows, "d string, c string, v double").withColumn("d", F.to_date("d"))
    wide = reports.pivot_month_category(df, "v", "d", "c", ["A", "B"]).collect()
    assert [(r["month"], r["A"], r["B"]) for r in wide] == [("2024-01", 10.0, 0.0), ("2024-02", 1.0, 5.0)]
    total = reports.pivot_category_month_totals(df, "v", "d", "c", ["2024-01", "2024-02"]).collect()
    assert [tuple(r) for r in total] == [("A", 10.0, 1.0, 11.0), ("B", 0.0, 5.0, 5.0), ("Total", 10.0, 6.0, 16.0)]


def test_credit_debit_without_debit(spark):
    df = spark.createDataFrame([("CREDIT", 5.0), ("prepaid", 1.0)], "k string, v double")
    r = reports.credit_debit_split(df, "v", "k").first()
    assert (r["credit_count"], r["credit_total"], r["debit_total"], r["credit_debit_ratio"]) == (1, 5.0, 0.0, 0.0)


def test_pivots_lose_nothing(spark):
    rows = [("2024-01-02", "A", 10.0), ("2024-02-03", "", 5.0), ("2024-02-04", None, 1.0), ("2024-03-01", "C", 2.0)]
    df = spark.createDataFrame(rows, "d string, c string, v double").withColumn("d", F.to_date("d"))
    assert reports.pivot_month_category(df, "v", "d", "c").columns == ["month", "A", "C", "Uncategorized"]
    listed = reports.pivot_month_category(df, "v", "d", "c", ["A"]).collect()
    assert [(r["A"], r["Other"]) for r in listed] == [(10.0, 0.0), (0.0, 6.0), (0.0, 2.0)]
    total = reports.pivot_category_month_totals(df, "v", "d", "c", ["2024-01"]).collect()
    assert tuple(total[-1]) == ("Total", 10.0, 8.0, 18.0)
    assert reports.pivot_category_month_totals(df, "v", "d", "c").columns == ["category", "2024-01", "2024-02", "2024-03", "Total"]


def test_decompose_in_blocks_equals_plain(spark):
    rows = [(g, i, float((i * 7) % 5 + i / 10)) for g in ("a", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, t int, v double")
    want = {(r["g"], r["t"]): r for r in series.decompose(df, "v", ["t"], 7, ["g"]).collect()}
    spark.conf.set("spark.txnlake.rowsPerTask", "5")
    try:
        for period in (7,):
            got = series.decompose(df, "v", ["t"], period, ["g"]).collect()
    finally:
        spark.conf.unset("spark.txnlake.rowsPerTask")
    assert len(got) == 80
    for r in got:
        for c in ("trend", "seasonal", "residual"):
            a, b = r[c], want[(r["g"], r["t"])][c]
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)
