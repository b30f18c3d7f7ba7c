"""The partitioned ledger against loads of the whole table."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from txnlake.operators import ledger, ledger_store

SCHEMA = "id string, date string, payee string, category string, amount double, account_id string, sms_text string"


def rows_of(spark, seed, n, ids="r"):
    r = random.Random(seed)
    rows = [
        (f"{ids}{i}" if r.random() < 0.8 else None, r.choice(["2024-01-05", "2024-01-06", "2024-02-01", "2024-03-09", None] if ids != "r" else ["2024-01-05", "2024-02-01", "2024-03-09"]),
         r.choice("ABCDEF"), f"c{i}", float(r.randrange(6)), "x", r.choice([None, f"m{r.randrange(60)}"]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumn("ord", F.monotonically_increasing_id())


def plain(df, *drop):
    return sorted(map(str, (tuple(r) for r in df.drop(*drop).collect())))


def stored_once(spark, path, seed=1, n=80):
    first = ledger.insert_skip(ledger.with_message_hash(rows_of(spark, seed, 0)).drop("ord"), rows_of(spark, seed, n), "ord")[0]
    ledger_store.create(first, path, 4)
    return spark.createDataFrame(first.collect(), first.schema)


@pytest.mark.parametrize("seed", range(3))
def test_loads_equal_those_of_whole_tables(spark, tmp_path, seed):
    path = str(tmp_path / "l")
    table = stored_once(spark, path, seed)
    assert plain(ledger_store.read(spark, path)) == plain(table)
    for turn, (whole, stored) in enumerate([(ledger.insert_skip, ledger_store.load_skip), (ledger.upsert, ledger_store.load_upsert)] * 2):
        batch = rows_of(spark, 100 + seed + turn, 40, f"b{turn}-")
        batch = spark.createDataFrame(batch.collect(), batch.schema)
        table, status = whole(table, batch, "ord")
        table = spark.createDataFrame(table.collect(), table.schema)
        got = stored(path, batch, "ord", slots=4)
        assert plain(got) == plain(status)
        assert plain(ledger_store.read(spark, path).select(*table.columns)) == plain(table)


def test_first_load_makes_the_ledger(spark, tmp_path):
    path = str(tmp_path / "l")
    batch = rows_of(spark, 5, 30)
    assert ledger_store.stored(spark, path) is None
    first = ledger.load_stats(ledger_store.load_skip(path, batch, "ord")).first()
    again = ledger.load_stats(ledger_store.load_skip(path, batch, "ord")).first()
    assert first["inserted"] == ledger_store.read(spark, path).count() and again["inserted"] == 0


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*/*.parquet")}


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "l")
    stored_once(spark, path, 2, 120)
    before = files(path)
    row = ledger_store.read(spark, path).filter("date = '2024-02-01' AND sms_text IS NOT NULL").orderBy("id").limit(1)
    batch = row.drop("message_hash").withColumns({"category": F.lit("changed"), "ord": F.lit(1)})
    batch = spark.createDataFrame(batch.collect(), batch.schema)
    ledger_store.load_upsert(path, batch, "ord", slots=4)
    after = files(path)
    gone, new = set(before) - set(after), set(after) - set(before)
    assert len({os.path.dirname(f) for f in gone | new}) == 1 and all(after[f] == before[f] for f in set(before) & set(after))
    assert ledger_store.read(spark, path).filter("category = 'changed'").count() == 1


def test_a_row_that_moves_leaves_its_partition(spark, tmp_path):
    path = str(tmp_path / "l")
    one = spark.createDataFrame([("1", "2024-01-05", "A", "c", 1.0, "x", "m1")], SCHEMA)
    ledger_store.create(one, path, 4)
    moved = spark.createDataFrame([("9", "2024-05-05", "B", "new", 2.0, "y", "m1", 1)], SCHEMA + ", ord int")
    status = ledger_store.load_upsert(path, moved, "ord", slots=4).first()
    rows = ledger_store.read(spark, path).collect()
    assert status["status"] == "updated" and [(r["id"], r["date"], r["category"]) for r in rows] == [("1", "2024-05-05", "new")]


def test_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "l")
    stored_once(spark, path, 3, 120)
    rows = spark.read.parquet(path)
    batch = spark.createDataFrame([("1", "2024-02-07", "A", "c", 1.0, "x", "m1")], SCHEMA)
    found = ledger_store.lookups(rows, ledger.with_message_hash(batch), 4)
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in (found.hashes.select("message_hash", "id"), found.keys.select("payee"))]
    assert "PartitionFilters: [isnotnull(slot" in plans[0] and "PartitionFilters: [isnotnull(month" in plans[1]
    assert len(found.hashes.inputFiles()) >= len(found.keys.inputFiles()) > 0
    with pytest.raises(ValueError):
        ledger_store.load_skip(path, batch, "id", keys=("payee",))
