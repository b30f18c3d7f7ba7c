"""Work that grows with the rows, not with what they hold."""

import glob
from collections import Counter

from pyspark.sql import functions as F

from bindings import QUERIES, storage
from bindings.registry import MESSAGES_PER_TASK, message_table
from txnlake.functions.rules import needed_words


def test_json_documents_by_rows_not_by_users(spark, tmp_path, monkeypatch):
    rows = [(i % 400 if i % 50 else None, f"kind {i % 3}" if i % 60 else None) for i in range(1000)]
    spark.createDataFrame(rows, "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(storage, "scratch", lambda _: f"{tmp_path}/out")
    monkeypatch.setattr(storage, "MESSAGES_PER_DOCUMENT", 100)
    got = {r["first"]: r["n"] for r in QUERIES["s5_read_messages_json"](spark, str(tmp_path)).collect()}
    assert got == Counter(u for u, _ in rows)
    files = glob.glob(f"{tmp_path}/out/*/part-*")
    assert len(files) == 10 and all(len(open(f).read().splitlines()) == 1 for f in files)


def test_messages_of_one_row_group_are_dealt_out(spark):
    sf = "/root/testdata/sf0.1"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        by_task = message_table(spark, sf).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(by_task) >= 8 and max(r["count"] for r in by_task) <= MESSAGES_PER_TASK


def test_words_that_a_pattern_needs():
    assert needed_words(r"(?:charged|paid)\s+(\d+)") == ["charged", "paid"]
    assert needed_words(r"\d+\s+(EGP|usd)") == ["egp", "usd"]
    assert needed_words(r"(?:card|\*\*)\s*(\d{4})") == ["card", "**"]
    for other in (r"(?:a|b)x|c", r"(a|b)?x", r"(a|b)*", r"x(a|b){0,2}", r"\(a|b\)", r"(?:a1|b)c", r"(?!a)b", r"\*+(\d{4})"):
        assert needed_words(other) is None
