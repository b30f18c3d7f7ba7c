import datetime as dt

import pytest
from pyspark.sql import functions as F

from txnlake.operators import clean, ml, profile
from txnlake.plans import jobs
from txnlake.sources import readers, writers
from txnlake.streaming import jobs as streams


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(v, c, "t") for v, c in zip([1, 2, 3, 4, 5, 100], "ABABAA")], "numeric1 int, category string, text string")


def test_names_are_normalised_and_unique(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Column One", "COLUMN_TWO", "  Date-Field!", "column one"])
    assert clean.normalize_columns(df).columns == ["column_one", "column_two", "date_field", "column_one_2"]


def test_dates(spark):
    values = ["2024-01-15", "01/15/2024", "15-01-2024", "January 5, 2024", "Jan 5, 2024", "2024-01-15 10:20:30", "nonsense", None]
    df = spark.createDataFrame([(v,) for v in values], "created string")
    got = [r["created"] for r in clean.standardize_dates(df).collect()]
    assert got == ["2024-01-15", "2024-01-15", "2024-01-15", "2024-01-05", "2024-01-05", "2024-01-15", "nonsense", None]
    assert clean.detect_date_columns(df) == ["created"]
    assert clean.detect_date_columns(df.filter("created = 'nonsense'")) == []


def test_numbers_and_text(spark):
    df = spark.createDataFrame([("$1,234.50", " a \t b ", 1), ("n/a", None, 2)], "v string, t string, n int")
    assert [r["v"] for r in clean.normalize_numeric(df, ["v", "n", "absent"]).collect()] == [1234.5, None]
    assert [r["t"] for r in clean.clean_text(df).collect()] == ["a b", None]
    assert clean.apply_schema(df, {"v": "double", "n": "string", "absent": "int"}).dtypes[2] == ("n", "string")


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (2, "b", 3), (3, "c", 4), (4, "d", 5)], "col1 int, col2 string, row int")
    assert clean.distinct_rows(df.drop("row")).count() == 4
    assert {r["row"] for r in clean.distinct_rows(df, ["col1"], "last", ["row"]).collect()} == {1, 3, 4, 5}
    assert {r["row"] for r in clean.distinct_rows(df, ["col1"], "none").collect()} == {1, 4, 5}
    with pytest.raises(ValueError):
        clean.distinct_rows(df, ["col1"], "some")
    plan = clean.distinct_rows(df, ["col1"], "first", ["row"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_missing_values(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, None), (4, 7.0)], "t int, v double")
    assert clean.handle_missing(df, "drop").count() == 2
    assert [r["v"] for r in clean.handle_missing(df, "fill", ["v"], 0.0).orderBy("t").collect()] == [0, 5, 0, 7]
    assert [r["v"] for r in clean.handle_missing(df, "forward_fill", ["v"], order=["t"]).orderBy("t").collect()] == [None, 5, 5, 7]
    assert [r["v"] for r in clean.handle_missing(df, "backward_fill", ["v"], order=["t"]).orderBy("t").collect()] == [5, 5, 7, 7]
    with pytest.raises(ValueError):
        clean.handle_missing(df, "guess")


def test_outliers_go_column_by_column(spark):
    df = spark.createDataFrame([(float(i % 5), float(i % 7)) for i in range(50)] + [(1000.0, 1.0), (1.0, 5000.0), (None, 1.0)], "a double, b double")
    kept = clean.remove_outliers(df, ["a", "b"])
    assert kept.count() == 50 and kept.agg(F.max("a")).first()[0] == 4
    same = df.withColumn("a", F.when(F.col("a").isNotNull(), F.lit(1.0)))
    assert clean.remove_outliers(same, ["a"], "zscore", 3.0).count() == 52


def test_numeric_summary(crowded, small):
    r = profile.summary_numeric(small).first()
    assert (r["count"], r["p25"], r["p50"], r["p75"], r["null_count"]) == (6, 2.25, 3.5, 4.75, 0) and abs(r["std"] - 39.6253) < 1e-3
    big = small.unionByName(small).unionByName(small).unionByName(small).unionByName(small).unionByName(small)
    wide = profile.summary_numeric(big).first()
    assert (wide["count"], wide["p50"]) == (36, 3.5)
    report = profile.outlier_report(big, order=["numeric1"]).first()
    assert report["count"] == 6 and list(report["outlier_values"]) == [100.0] * 6


def test_quality_and_types(spark):
    df = spark.createDataFrame([(1, "a", None, True, dt.date(2024, 1, 1), "2024-01-01")] * 2 + [(0, "b", -1.5, False, None, "2024-02-01")],
                               "i int, s string, d double, b boolean, day date, txt string")
    q = {r["column"]: r for r in profile.data_quality(df).collect()}
    assert (q["i"]["duplicate_rows"], q["i"]["zero_count"], q["d"]["negative_count"], q["d"]["null_count"], q["s"]["zero_count"]) == (1, 1, 1, 2, None)
    labels = {r["column"]: r["semantic_type"] for r in profile.infer_semantic_type(df).collect()}
    assert labels == {"i": "integer", "s": "text", "d": "numeric", "b": "boolean", "day": "datetime", "txt": "date_string"}
    suggested = {r["column"]: r["suggested"] for r in profile.suggest_types(df).collect()}
    assert suggested["i"] == "uint8" and suggested["txt"] == "datetime64"
    schema = {r["column"]: r for r in profile.infer_schema(df, ["i"]).collect()}
    assert schema["i"]["median"] == 1 and list(schema["s"]["samples"]) == ["b", "a", "a"]


def test_correlations_skip_missing_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (4.0, 8.0)], "a double, b double")
    got = {(r["a"], r["b"]): r["r"] for r in profile.correlation_matrix(df).collect()}
    assert abs(got[("a", "b")] - 1) < 1e-12 and got[("a", "b")] == got[("b", "a")]


def test_categories_and_dates(small, spark):
    rows = profile.summary_categorical(small, k=1).collect()
    assert {(r["column"], r["value"], r["count"], r["unique_count"]) for r in rows} == {("category", "A", 4, 2), ("text", "t", 6, 1)}
    days = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 31),), (None,)], "d timestamp")
    r = profile.summary_dates(days).first()
    assert (r["date_range_days"], r["null_count"]) == (30, 1)


def test_full_report(small):
    sections = jobs.full_report(small)
    assert {"summary_numeric", "outliers", "anomalies"} <= set(sections) and sections["outliers"].first()["count"] == 1


# --- files ------------------------------------------------------------------------------------


def test_messages_in_any_encoding(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one \n\n  مرحبا\ntwo\r\n".encode("utf-16"))
    df = readers.read_messages_txt(spark, str(tmp_path / "a.txt"), encoding="UTF-16")
    assert [r["text"] for r in df.orderBy("line").collect()] == ["one", "مرحبا", "two"]
    assert [r["text"] for r in readers.read_messages_txt(spark, str(tmp_path / "a.txt"), 1, "UTF-16").collect()] == ["one"]
    (tmp_path / "b.json").write_text('["x", "", null, "y"]')
    (tmp_path / "c.json").write_text('{"not": "a list"}')
    assert [r["text"] for r in readers.read_messages_json(spark, str(tmp_path / "b.json")).orderBy("line").collect()] == ["x", "y"]
    assert readers.read_messages_json(spark, str(tmp_path / "c.json")).count() == 0


def test_lines_keep_file_order(spark, tmp_path):
    (tmp_path / "m.txt").write_text("\n".join(f"m{i}" for i in range(500)) + "\n\n")
    df = readers.read_message_lines(spark, str(tmp_path))
    assert [r["text"] for r in df.orderBy("file_path", "line").collect()] == [f"m{i}" for i in range(500)]


def test_folder_of_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_text("id,extra\n3,9\n")
    (tmp_path / "empty.csv").write_text("")
    df = readers.read_dir(spark, str(tmp_path))
    assert {(r["id"], r["name"], r["extra"], r["_source_file"]) for r in df.collect()} == {(1, "x", None, "a.csv"), (2, "y", None, "a.csv"), (3, None, 9, "b.csv")}
    assert readers.read_table(spark, str(tmp_path / "a.csv")).count() == 2
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.xml")


def test_partitioned_export_prunes(spark, tmp_path):
    df = spark.createDataFrame([(str(i), f"2024-0{i % 3 + 1}-05", float(i), ["a", "b"]) for i in range(9)], "id string, date string, amount double, tags array<string>")
    path = str(tmp_path / "out")
    writers.write_parquet(df, path, "zstd", ["year", "month"])
    back = spark.read.parquet(path)
    assert back.filter("month = 2").count() == 3 and back.first()["tags"] == "a,b"
    assert dict(back.dtypes)["date"] == "timestamp"
    assert {r["column"] for r in readers.parquet_schema_info(spark, path).collect()} == {"id", "date", "amount", "tags", "year", "month"}


def test_tables(spark, small):
    writers.save_table(small, "t_save", "replace")
    writers.save_table(small, "t_save", "append")
    assert readers.load_table(spark, "t_save").count() == 12
    with pytest.raises(Exception):
        writers.save_table(small, "t_save", "fail")
    assert readers.load_table(spark, query="SELECT * FROM t_save WHERE numeric1 > :n", args={"n": 50}).count() == 2
    assert {(r["table"], r["rows"]) for r in writers.table_catalog(spark, ["t_save"]).collect()} == {("t_save", 12)}
    writers.drop_table(spark, "t_save")
    assert not spark.catalog.tableExists("t_save")


def test_incremental_runs(spark):
    raw = spark.createDataFrame([(1, " a ", "01/15/2024"), (2, "b", "01/16/2024")], ["Row Id", "Name", "Order Date"])
    jobs.run_incremental(spark, raw, "t_inc")
    out = jobs.run_incremental(spark, raw.union(spark.createDataFrame([(3, "c", "x")], raw.schema)), "t_inc")
    assert {tuple(r) for r in out.collect()} == {(1, "a", "2024-01-15"), (2, "b", "2024-01-16"), (3, "c", "x")}
    writers.drop_table(spark, "t_inc")


def test_pipeline_flags_anomalies(spark):
    raw = spark.createDataFrame([(i, f"2024-01-{i + 1:02d}", "Shop", 10.0) for i in range(12)] + [(12, "2024-01-20", "Shop", 999.0)], ["id", "date", "payee", "amount"])
    out, quality = jobs.run_pipeline(spark, raw, detect={"amount": "amount", "merchant": "payee", "ts": "date", "tie": "id"})
    got = {r["id"]: r["anomalies"] for r in out.collect()}
    assert got[12] == "high_value" and got[0] == "unknown_merchant" and got[5] is None and quality.count() == 4


# --- learned categories -----------------------------------------------------------------------


def labelled(spark):
    words = {"food": "pizza burger lunch", "fuel": "petrol diesel station"}
    rows = [(i, f"{words[c]} shop {i % 3}", c) for i, c in enumerate(["food", "fuel"] * 15)]
    return spark.createDataFrame([*rows, (98, "pizza lunch", None), (99, "  ", "food")], "id int, text string, category string")


def test_train_predict_and_review(spark, tmp_path):
    df = labelled(spark)
    model, stats = ml.train_classifier(df, ["text"])
    assert stats == {"samples": 30.0, "labels": 2.0}
    got = {r["id"]: r for r in ml.predict_category(model, df, ["text"], "other").collect()}
    assert got[98]["predicted_category"] == "food" and got[98]["predicted_confidence"] == "high"
    assert (got[99]["predicted_category"], got[99]["predicted_probability"], got[99]["predicted_confidence"]) == ("other", 0.0, "low")
    wrong = df.withColumn("category", F.when(F.col("id") == 0, "fuel").otherwise(F.col("category")))
    assert [r["id"] for r in ml.misclassified(model, wrong, ["text"]).collect()] == [0]
    fixes = spark.createDataFrame([(0, "fuel"), (500, "rent")], "id int, category string")
    assert ml.retrain(df, fixes, str(tmp_path / "model"), ["text"])["samples"] == 30.0
    with pytest.raises(ValueError):
        ml.train_classifier(df.filter("category is null"), ["text"])


def test_corrections(spark):
    parsed = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, category string, payee string")
    fixes = spark.createDataFrame([(1, "A"), (2, None), (3, "C")], "id int, category string")
    got = {r["id"]: (r["category"], r["payee"], r["label_source"]) for r in ml.merge_corrections(parsed, fixes).collect()}
    assert got == {1: ("A", "x", "parsed"), 2: ("b", "y", "parsed"), 3: ("C", None, "correction")}
    assert ml.merge_corrections(parsed.drop("id"), fixes).count() == 5


# --- streams ----------------------------------------------------------------------------------


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-0{i % 3 + 1}", "Shop", float(i % 4), "a", f"m{i % 8}", dt.datetime(2024, 1, i % 3 + 1)) for i in range(24)]
    df = spark.createDataFrame(rows, "ord int, date string, payee string, amount double, account_id string, sms_text string, ts timestamp")
    df = df.withColumn("id", F.col("ord").cast("string"))
    src = str(tmp_path / "src")
    df.coalesce(1).write.parquet(src)
    feed = lambda: spark.readStream.schema(df.schema).parquet(src)
    target = str(tmp_path / "ledger")
    for checkpoint in ("c1", "c2"):
        streams.stream_ingest(spark, feed(), target, str(tmp_path / checkpoint), "ord").awaitTermination()
    kept = spark.read.parquet(target)
    assert kept.count() == 8 and {r["ord"] for r in kept.collect()} == set(range(8))
    seen = []
    streams.stream_daily_spikes(feed(), "ts", "amount", str(tmp_path / "days"), str(tmp_path / "c3"), threshold=0.5,
                                on_flags=lambda flags, batch: seen.append(flags.count())).awaitTermination()
    totals = {str(r["date"]): r["transaction_count"] for r in streams.current_totals(spark, str(tmp_path / "days"), "amount").collect()}
    assert totals == {"2024-01-01": 8, "2024-01-02": 8, "2024-01-03": 8} and seen


def test_dates_are_told_from_all_rows(spark):
    rows = [("n/a",)] * 12 + [("2024-01-02",)] * 88
    df = spark.createDataFrame(rows, "order_date string").coalesce(1)
    assert clean.detect_date_columns(df) == ["order_date"]
    later = spark.createDataFrame([("2024-01-02",)] * 20 + [("soon",)], "d string").coalesce(1)
    assert profile.infer_semantic_type(later).first()["semantic_type"] != "date_string"
