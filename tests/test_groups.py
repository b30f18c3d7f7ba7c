"""Ordered work gives the same rows whether groups fit a task or are cut into blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlake.plans import groups
from txnlake.plans.running_percentile import running_percentile


def table(spark, n=150, seed=3):
    """One key holds most rows; keys and values may be NULL, times tie."""
    rnd = random.Random(seed)
    rows = [
        (i, rnd.choice(["hot"] * 6 + ["b", "c", None]), rnd.randrange(20), None if rnd.random() < 0.2 else float(rnd.randrange(30)))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "id long, k string, t long, v double")


def by_key(rows):
    groups_ = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        groups_.setdefault(r[1], []).append(r)
    return groups_




def order():
    return [F.col("t"), F.col("id")]


def collected(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("small", [True, None])
def test_row_position(crowded, small):
    rows, df = table(crowded)
    got = collected(groups.row_position(df, ["k"], order(), "_p", small), "_p")
    for members in by_key(rows).values():
        assert [got[r[0]][0] for r in members] == list(range(1, len(members) + 1))


def test_row_position_of_whole_table(crowded):
    rows, df = table(crowded)
    got = collected(groups.row_position(df, [], order(), "_p"), "_p")
    assert [got[r[0]][0] for r in sorted(rows, key=lambda r: (r[2], r[0]))] == list(range(1, len(rows) + 1))


def test_running_total_of_amounts(crowded):
    rows, df = table(crowded)
    got = collected(groups.running_total(df, ["k"], order(), F.coalesce("v", F.lit(0.0)), "s"), "s")
    for members in by_key(rows).values():
        want = np.cumsum([r[3] or 0.0 for r in members])
        assert np.allclose([got[r[0]][0] for r in members], want)


@pytest.mark.parametrize("back", [1, 3, 10])
def test_over_history_sees_the_rows_before(crowded, back):
    rows, df = table(crowded)

    def build(d, w):
        return d.withColumns({"lagged": F.lag("id", back).over(w), "n": F.count(F.lit(1)).over(w.rowsBetween(-back, 0))})

    got = collected(groups.over_history(df, ["k"], order(), back, build), "lagged", "n")
    assert len(got) == len(rows)
    for members in by_key(rows).values():
        for i, r in enumerate(members):
            assert got[r[0]] == (members[i - back][0] if i >= back else None, min(i, back) + 1)


def test_carry_forward(crowded):
    rows, df = table(crowded)
    got = collected(groups.carry_forward(df, ["k"], order(), ["v"]), "v")
    for members in by_key(rows).values():
        last = None
        for r in members:
            last = r[3] if r[3] is not None else last
            assert got[r[0]][0] == last


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_percentiles(crowded, keys):
    rows, df = table(crowded)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for r in groups.percentiles(df, keys, ["v", "t"], probs).collect():
        mine = [x for x in rows if not keys or x[1] == r["k"]]
        for col, at in (("v", 3), ("t", 2)):
            values = [x[at] for x in mine if x[at] is not None]
            assert np.allclose([r[f"{col}_p{i}"] for i in range(len(probs))], np.percentile(values, [100 * p for p in probs]))


@pytest.mark.parametrize("accuracy", [1_000, 3])
def test_column_percentiles_between_approximate_neighbours(crowded, monkeypatch, accuracy):
    monkeypatch.setattr(groups, "SKETCH_ACCURACY", accuracy)
    rows, df = table(crowded, 400)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = groups.column_percentiles(df.withColumn("none", F.lit(None).cast("double")), ["v", "t", "none"], probs)
    for col, at in (("v", 3), ("t", 2)):
        assert np.allclose(got[col], np.percentile([r[at] for r in rows if r[at] is not None], [100 * p for p in probs]))
    assert got["none"] == [None] * len(probs)


def test_running_percentile_of_middling_groups(spark, monkeypatch):
    monkeypatch.setattr("txnlake.plans.running_percentile.SMALL_GROUP", 10)
    check_running_percentile(spark, ["k"], 0.9)
    check_running_percentile(spark, [], 0.25)


@pytest.mark.parametrize("keys, p", [([], 0.0), ([], 0.9), (["k"], 0.9), (["k"], 1.0)])
def test_running_percentile_in_blocks(crowded, keys, p):
    check_running_percentile(crowded, keys, p)


def check_running_percentile(session, keys, p):
    rows, df = table(session, 220)
    got = collected(running_percentile(df, "v", p, keys, order(), "q", "n"), "q", "n")
    assert len(got) == len(rows)
    members_of = by_key(rows).values() if keys else [sorted(rows, key=lambda r: (r[2], r[0]))]
    for members in members_of:
        seen = []
        for i, r in enumerate(members):
            q, n = got[r[0]]
            assert n == i
            if seen:
                assert abs(q - np.percentile(seen, 100 * p)) < 1e-9
            else:
                assert q is None
            if r[3] is not None:
                seen.append(r[3])


class Session:
    """A stand-in with only what the choice of folder looks at."""

    def __init__(self, master, folder=None):
        self.sparkContext = self
        self.master, self.applicationId, self.folder = master, f"app-{master}", folder
        self.conf = self

    def get(self, _name, default=None):
        return self.folder or default


def test_work_dir_comes_from_the_session(tmp_path):
    assert groups.work_dir(Session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    local = groups.work_dir(Session("local[2]"))
    assert local == groups.work_dir(Session("local[2]"))
    with pytest.raises(RuntimeError):
        groups.work_dir(Session("yarn"))


def test_running_percentile_ways_agree_on_odd_values(spark, monkeypatch):
    from txnlake.plans import running_percentile as rp

    odd = [1.0, float("nan"), 3.0, None, float("inf"), 2.0, float("nan"), float("-inf"), 5.0, 4.0, None, 7.0] * 3
    df = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, v double")
    found = []
    for small, block in ((500, 20_000), (2, 20_000), (2, 5)):
        monkeypatch.setattr(rp, "SMALL_GROUP", small)
        monkeypatch.setattr(rp, "BLOCK_ROWS", block)
        rows = rp.running_percentile(df, "v", 0.9, [], [F.col("i")]).orderBy("i").collect()
        found.append([(repr(r["running_pct"]), r["earlier_rows"]) for r in rows])
    assert found[0] == found[1] == found[2] and "nan" not in str(found[0][:4])
