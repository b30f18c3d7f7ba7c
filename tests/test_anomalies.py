"""Anomaly rules against a literal loop over the history, and known boundary cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlake.operators import anomalies

START = dt.datetime(2024, 1, 1)
SCHEMA = "id long, user string, ts timestamp, payee string, amount double"


def history(n, seed):
    rnd = random.Random(seed)
    return [
        (i, rnd.choice(["u"] * 4 + ["w"]), START + dt.timedelta(hours=rnd.randrange(200)),
         rnd.choice(["Shop", " shop ", "Cafe", "X", None, "  "]), None if rnd.random() < 0.1 else float(rnd.randrange(100)))
        for i in range(n)
    ]


def loop(rows, by_user=True, pct=90, min_history=10, n=3, hours=24, window=100):
    """Each row against all earlier rows, one by one."""
    name = lambda r: (r[3] or "").strip().lower()
    flags, past = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        before = past.setdefault(r[1] if by_user else None, [])
        found = []
        amounts = [b[4] for b in before if b[4] is not None]
        if r[4] is not None and len(before) >= min_history and amounts and r[4] > np.percentile(amounts, pct):
            found.append("high_value")
        if name(r):
            close = [b for b in before if name(b) == name(r) and b[2] >= r[2] - dt.timedelta(hours=hours)]
            if len(close) + 1 >= n:
                found.append("burst_frequency")
            if name(r) not in {name(b) for b in before[-window:]}:
                found.append("unknown_merchant")
        flags[r[0]] = found
        before.append(r)
    return flags


def flagged(spark, rows, partition=("user",), **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    out = anomalies.detect_anomalies(df, "amount", "payee", "ts", "id", list(partition), **kw)
    return {r["id"]: list(r["flags"]) for r in out.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_flags_equal_the_loop(spark, seed):
    rows = history(300, seed)
    assert flagged(spark, rows) == loop(rows)


def test_flags_equal_the_loop_in_blocks(crowded):
    rows = history(200, 5)
    assert flagged(crowded, rows) == loop(rows)


def test_one_history_for_all(crowded):
    rows = history(150, 6)
    assert flagged(crowded, rows, ()) == loop(rows, by_user=False)


def test_rule_settings_and_selection(spark):
    rows = history(200, 7)
    rules = {"unknown_merchant": {"window": 5}, "burst_frequency": {"n": 2, "hours": 3}}
    want = {k: [f for f in v if f != "high_value"] for k, v in loop(rows, n=2, hours=3, window=5).items()}
    assert flagged(spark, rows, rules=rules) == want
    with pytest.raises(ValueError):
        flagged(spark, rows, rules=["other"])


def one_user(amounts, payees=None, step=48):
    return [(i, "u", START + dt.timedelta(hours=step * i), (payees or ["A"] * len(amounts))[i], float(a)) for i, a in enumerate(amounts)]


def test_high_value_boundary(spark):
    past = list(range(1, 101))
    assert "high_value" not in flagged(spark, one_user([*past, 90]))[100]
    assert "high_value" in flagged(spark, one_user([*past, 91]))[100]
    assert "high_value" in flagged(spark, one_user([*range(10, 101, 10), 150]))[10]
    assert "high_value" not in flagged(spark, one_user([*range(10, 91, 10), 150]))[9]


def test_burst_threshold(spark):
    two = one_user([1, 1], step=12)
    three = one_user([1, 1, 1], step=12)
    late = [*two, (2, "u", two[0][2] + dt.timedelta(hours=25), "A", 1.0)]
    assert "burst_frequency" not in flagged(spark, two)[1]
    assert "burst_frequency" in flagged(spark, three)[2]
    assert "burst_frequency" not in flagged(spark, late)[2]


def test_first_row_is_an_unknown_merchant_only(spark):
    assert flagged(spark, one_user([500])) == {0: ["unknown_merchant"]}


def test_burst_counts(crowded):
    rows = history(150, 9)
    df = crowded.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["in_window"] for r in anomalies.burst_counts(df, "payee", "ts", "id", ["user"]).collect()}
    name = lambda r: (r[3] or "").strip().lower()
    for r in rows:
        want = sum(
            1 for b in rows
            if name(r) and name(b) == name(r) and b[1] == r[1] and r[2] - dt.timedelta(hours=24) <= b[2] and (b[2], b[0]) < (r[2], r[0])
        )
        assert got[r[0]] == want


def test_report_of_a_new_merchant(spark):
    rows = one_user([100 + i for i in range(20)] + [1000], [f"M{i % 5}" for i in range(20)] + ["New"])
    out = anomalies.detect_anomalies(spark.createDataFrame(rows, SCHEMA), "amount", "payee", "ts", "id", ["user"])
    report = anomalies.anomaly_report(out).first()
    assert report["total_transactions"] == 21 and report["high_value_count"] >= 1 and report["unknown_merchant_count"] == 6
    spend = anomalies.anomaly_spend(out, "amount").first()
    assert spend["anomaly_count"] == report["total_anomalies"]
    assert anomalies.top_anomalies(out, "amount", "id", 1).first()["amount"] == 1000


def test_empty_table(spark):
    report = anomalies.anomaly_report(spark.createDataFrame([], "flags array<string>")).first()
    assert report["anomaly_rate"] == 0.0 and report["total_transactions"] == 0


def test_zscore_and_iqr_rows(spark):
    df = spark.createDataFrame([(float(v), 5.0) for v in [1, 2, 3, 4, 5, 100]], "a double, b double")
    rows = anomalies.iqr_anomalies(df).collect()
    assert [(r["a"], r["anomaly_column"]) for r in rows] == [(100.0, "a")]
    assert anomalies.zscore_anomalies(df, ["a", "b"], 2.0).count() == 1
    assert anomalies.zscore_anomalies(df, ["b"]).count() == 0


def test_pick_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Amount int, Merchant int, other int")
    assert anomalies.pick_columns(df) == {"amount": "Amount", "merchant": "Merchant", "ts": None}


def test_burst_counts_with_ids_that_repeat_across_groups(spark):
    rows = [("u1", 1, "2024-01-01 00:00:00", "M"), ("u1", 2, "2024-01-01 01:00:00", "M"), ("u2", 1, "2024-01-01 00:30:00", "M"), ("u2", 2, "2024-03-01 00:00:00", "M"), (None, 1, "2024-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "u string, id int, ts string, m string").withColumn("ts", F.to_timestamp("ts"))
    got = {(r["u"], r["id"]): r["in_window"] for r in anomalies.burst_counts(df, "m", "ts", "id", ["u"]).collect()}
    assert got == {("u1", 1): 0, ("u1", 2): 1, ("u2", 1): 0, ("u2", 2): 0, (None, 1): 0}
