"""Sources, sinks, pipelines and streams: written to a work folder and read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from bindings.registry import (
    WITH_LEDGER, ledger_table, longs, message_table, query, read, rounded, scratch, texts, WITH_MESSAGES,
)
from txnlake.plans import jobs
from txnlake.sources import readers, writers
from txnlake.streaming import jobs as streams

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:10]}"


@query("s1_read_csv", CUSTOMER)
def _(spark, sf):
    path = scratch(spark)
    writers.write_delimited(read(spark, sf, "customer"), path)
    return readers.read_csv(spark, path).select(
        F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_acctbal", "c_mktsegment"
    )


@query("s2_read_dir", """SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance, 'csv' AS kind FROM customer
 UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal, 'csv' FROM supplier""")
def _(spark, sf):
    """Two kinds of files with different columns in one folder."""
    base = scratch(spark)
    c = read(spark, sf, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment")
    s = read(spark, sf, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance")
    writers.write_delimited(c, base)
    writers.write_delimited(s, base, "append")
    out = readers.read_dir(spark, base)
    return out.select(F.col("key").cast("long").alias("key"), "name", "segment", "balance", F.substring_index("_source_file", ".", -1).alias("kind"))


@query("s3_read_table", "SELECT p_partkey, p_name, 'part.parquet' AS _source_file FROM part")
def _(spark, sf):
    read(spark, sf, "part")
    return readers.read_table(spark, os.path.join(sf, "part.parquet")).select("p_partkey", "p_name", "_source_file")


@query("s4_read_messages_txt", WITH_MESSAGES + "SELECT trim(text) AS text, count(*) AS n FROM messages WHERE trim(text) <> '' GROUP BY 1")
def _(spark, sf):
    path = scratch(spark)
    message_table(spark, sf).select(F.encode(F.concat("text", F.lit("\n")), "UTF-8").cast("string").alias("value")).write.text(path)
    return readers.read_messages_txt(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("s4_read_message_lines", WITH_MESSAGES + "SELECT trim(text) AS text, count(*) AS n FROM messages WHERE trim(text) <> '' GROUP BY 1")
def _(spark, sf):
    path = scratch(spark)
    message_table(spark, sf).select(F.col("text").alias("value")).write.text(path)
    return readers.read_message_lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))


#: Messages of a JSON document, which a task reads whole.
MESSAGES_PER_DOCUMENT = 20_000


@query("s5_read_messages_json", "SELECT user_id AS first, count(*) AS n FROM (SELECT user_id, event_type FROM events) GROUP BY 1")
def _(spark, sf):
    """JSON documents with the messages of many users each, one in a file, as many as the rows call for."""
    path = scratch(spark)
    events = read(spark, sf, "events")
    message = F.concat(F.coalesce(F.col("user_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("event_type", F.lit("")))
    files = max(1, -(-events.count() // MESSAGES_PER_DOCUMENT))
    dealt_out = events.select(message.alias("text")).repartition(files)
    documents = dealt_out.groupBy(F.spark_partition_id().alias("document")).agg(F.to_json(F.collect_list("text")).alias("value"))
    documents.write.partitionBy("document").text(path)
    found = readers.read_messages_json(spark, f"{path}/document=*")
    return found.groupBy(F.nullif(F.substring_index("text", ":", 1), F.lit("")).cast("long").alias("first")).agg(F.count("*").alias("n"))


@query("s6_write_parquet", WITH_LEDGER + """SELECT id, strftime(cast(date AS date), '%Y-%m-%d') AS date, amount, account_type, 'a,' || account_type AS tags,
 year(cast(date AS date)) AS year, month(cast(date AS date)) AS month FROM ledger""")
def _(spark, sf):
    path = scratch(spark)
    table = ledger_table(spark, sf).withColumn("tags", F.array(F.lit("a"), F.col("account_type")))
    table = table.withColumn("tags", F.when(F.col("account_type").isNull(), F.lit(None)).otherwise(F.col("tags")))
    writers.write_parquet(table, path, "zstd", ["year", "month"])
    out = spark.read.parquet(path).select(
        "id", F.date_format("date", "yyyy-MM-dd").alias("date"), "amount", "account_type", F.nullif("tags", F.lit("")).alias("tags"), "year", "month"
    )
    return longs(out)


@query("s7_parquet_schema_info", """SELECT (row_number() OVER ()) - 1 AS position, column_name AS "column", 5::BIGINT AS column_count FROM
 (SELECT unnest(['r_regionkey', 'r_name']) AS column_name WHERE false) UNION ALL SELECT position::BIGINT, "column", 5::BIGINT FROM
 (VALUES (0, 'c_custkey'), (1, 'c_name'), (2, 'c_nationkey'), (3, 'c_acctbal'), (4, 'c_mktsegment')) t(position, "column") WHERE (SELECT count(*) FROM customer) > 0""")
def _(spark, sf):
    out = readers.parquet_schema_info(spark, os.path.join(sf, "customer.parquet"))
    return longs(out.select("position", "column", "column_count"))


def _saved(spark, df, *modes):
    name = _name("t")
    for mode in modes:
        writers.save_table(df, name, mode)
    return name


@query("s8_save_table", f"{CUSTOMER} UNION ALL {CUSTOMER}")
def _(spark, sf):
    name = _saved(spark, longs(read(spark, sf, "customer")), "fail", "replace", "append")
    return spark.table(name)


@query("s9_load_table", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 100 GROUP BY 1")
def _(spark, sf):
    name = _saved(spark, read(spark, sf, "customer"), "replace")
    return readers.load_table(spark, query=f"SELECT c_mktsegment, count(*) AS n FROM {name} WHERE c_acctbal > :floor GROUP BY 1", args={"floor": 100})


@query("s10_table_catalog", """SELECT column_name AS "column", data_type AS type, (SELECT count(*) FROM nation) AS rows FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) t(column_name, data_type)""")
def _(spark, sf):
    name = _saved(spark, read(spark, sf, "nation"), "replace")
    return writers.table_catalog(spark, [name]).select("column", "type", "rows")


@query("s11_write_delimited", "SELECT p_partkey, replace(p_name, ' ', ',') AS words FROM part")
def _(spark, sf):
    path = scratch(spark)
    writers.write_delimited(read(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("words")), path)
    return readers.read_csv(spark, path, "p_partkey long, words string")


@query("s12_write_report_json", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    path = scratch(spark)
    section = read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    writers.write_report_json({"priorities": section}, path)
    return spark.read.schema("o_orderpriority string, n long").json(f"{path}/priorities")


# --- pipelines --------------------------------------------------------------------------------


def _raw_orders(spark, sf):
    o = read(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("Order Key"), F.concat(F.lit(" "), "o_orderpriority", F.lit("  ")).alias("Priority"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("Order Date"), F.col("o_totalprice").alias("Amount"),
    )


@query("l8_run_pipeline", """WITH o AS (SELECT o_orderkey AS order_key, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_totalprice AS amount FROM orders),
 b AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM o)
 SELECT o.* FROM o, b WHERE amount BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def _(spark, sf):
    raw = _raw_orders(spark, sf)
    doubled = raw.unionByName(raw)
    out, _ = jobs.run_pipeline(spark, doubled, _name("p"), outlier_columns=["amount"])
    return out


@query("l9_run_incremental", """SELECT o_orderkey AS order_key, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_totalprice AS amount FROM orders""")
def _(spark, sf):
    """Two loads that overlap leave every row once."""
    name = _name("inc")
    raw = _raw_orders(spark, sf)
    jobs.run_incremental(spark, raw.filter("`Order Key` % 3 <> 0"), name)
    return jobs.run_incremental(spark, raw.filter("`Order Key` % 2 = 0 OR `Order Key` % 3 = 0"), name)


@query("l10_full_report", """WITH v AS (SELECT 'value' AS c, value AS x FROM events UNION ALL SELECT 'event_id', event_id::DOUBLE FROM events),
 b AS (SELECT c, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, avg(x) AS m, stddev_samp(x) AS s FROM v GROUP BY c)
 SELECT 'outliers' AS section, count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n FROM v JOIN b USING (c) UNION ALL
 SELECT 'anomalies', count(*) FILTER (abs(x - m) / s > 3.0) FROM v JOIN b USING (c) UNION ALL
 SELECT 'summary_numeric', count(x) FROM v UNION ALL SELECT 'summary_categorical', max(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type) UNION ALL
 SELECT 'summary_dates', datediff('second', min(ts), max(ts)) // 86400 FROM events UNION ALL SELECT 'correlations', 4""")
def _(spark, sf):
    sections = jobs.full_report(read(spark, sf, "events").select("event_id", "value", "event_type", "ts"))
    of = lambda name, n: sections[name].agg(n.cast("long").alias("n")).select(F.lit(name).alias("section"), "n")
    return readers.union_all([
        of("outliers", F.sum("count")), of("anomalies", F.sum("count")), of("summary_numeric", F.sum("count")),
        of("summary_categorical", F.max("count")), of("summary_dates", F.max("date_range_days")), of("correlations", F.count("*")),
    ])


@query("l10_comprehensive_report", """WITH d AS (SELECT cast(ts AS date) AS k, sum(value) AS s FROM events GROUP BY 1),
 h AS (SELECT hour(ts) AS k, sum(value) AS s FROM events GROUP BY 1), m AS (SELECT date_trunc('month', ts) AS k, sum(value) AS s FROM events GROUP BY 1),
 spread AS (SELECT (SELECT avg(s) FROM d) AS dm, (SELECT stddev_pop(s) FROM d) AS ds, (SELECT avg(s) FROM m) AS mm, (SELECT stddev_pop(s) FROM m) AS ms),
 odd_d AS (SELECT s FROM d, spread WHERE ds > 0 AND abs(s - dm) > 3 * ds), odd_m AS (SELECT s FROM m, spread WHERE ms > 0 AND abs(s - mm) > 3 * ms),
 top_d AS ((SELECT s FROM d ORDER BY s DESC, k LIMIT 5) UNION ALL (SELECT s FROM d ORDER BY s, k LIMIT 5)),
 top_m AS ((SELECT s FROM m ORDER BY s DESC, k LIMIT 5) UNION ALL (SELECT s FROM m ORDER BY s, k LIMIT 5)),
 top_h AS ((SELECT s FROM h ORDER BY s DESC, k LIMIT 1) UNION ALL (SELECT s FROM h ORDER BY s, k LIMIT 1))
 SELECT 'overview' AS section, count(*) AS n, round(sum(value), 2) AS v FROM events
 UNION ALL SELECT 'hourly', count(*), round(sum(s), 2) FROM h UNION ALL SELECT 'peak_hours', count(*), round(sum(s), 2) FROM top_h
 UNION ALL SELECT 'daily', count(*), round(sum(s), 2) FROM d UNION ALL SELECT 'daily_anomalies', count(*), round(coalesce(sum(s), 0.0), 2) FROM odd_d
 UNION ALL SELECT 'top_days', count(*), round(sum(s), 2) FROM top_d UNION ALL SELECT 'monthly', count(*), round(sum(s), 2) FROM m
 UNION ALL SELECT 'monthly_anomalies', count(*), round(coalesce(sum(s), 0.0), 2) FROM odd_m UNION ALL SELECT 'top_months', count(*), round(sum(s), 2) FROM top_m""")
def _(spark, sf):
    sections = jobs.comprehensive_report(read(spark, sf, "events"), "value", "ts", "event_id")
    parts = [sections["overview"].select(F.lit("overview").alias("section"), F.col("total_transactions").alias("n"), F.col("total_value").alias("v"))]
    for name, part in sections.items():
        if name != "overview":
            found = part.agg(F.count("*").alias("n"), F.coalesce(F.sum("value_sum"), F.lit(0.0)).alias("v"))
            parts.append(found.select(F.lit(name).alias("section"), "n", "v"))
    return rounded(longs(readers.union_all(parts)), 2)


@query("l10_visualization_data", """WITH d AS (SELECT cast(ts AS date) AS d, sum(value) AS s FROM events GROUP BY 1)
 SELECT 'time_series' AS section, d::VARCHAR AS key, round(s, 4) AS value, round(avg(s) OVER (ORDER BY d ROWS 6 PRECEDING), 4) AS moving_average_7 FROM d
 UNION ALL SELECT 'hourly_distribution', hour(ts)::VARCHAR, round(sum(value), 4), NULL FROM events GROUP BY 2
 UNION ALL SELECT 'monthly_trends', strftime(ts, '%Y-%m'), round(sum(value), 4), NULL FROM events GROUP BY 2""")
def _(spark, sf):
    sections = jobs.visualization_data(read(spark, sf, "events"), "value", "ts")
    keys = {"time_series": "date", "hourly_distribution": "hour", "monthly_trends": "year_month"}
    none = F.lit(None).cast("double").alias("moving_average_7")
    return rounded(readers.union_all([
        sections[name].select(
            F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), "value", "moving_average_7" if key == "date" else none)
        for name, key in keys.items()
    ]))


# --- streams ----------------------------------------------------------------------------------


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("r1_stream_ingest", WITH_LEDGER + "SELECT id, date, amount, payee FROM ledger")
def _(spark, sf):
    """The ledger arrives in files, some of its rows twice; a second run finds nothing new."""
    source, target, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    table = ledger_table(spark, sf).withColumns({"sms_text": F.concat(F.lit("m"), F.col("id")), "ord": F.col("id").cast("long") * 2})
    again = table.filter("ord % 3 = 0").withColumn("ord", F.col("ord") + 1)
    table.unionByName(again).repartition(4, "ord").write.parquet(source)
    for _ in range(2):
        streams.stream_ingest(spark, _stream(spark, source, spark.read.parquet(source).schema), target, checkpoint, "ord").awaitTermination()
    return spark.read.parquet(target).select("id", "date", "amount", "payee")


@query("r2_stream_dedup", "SELECT event_id, sha256('e' || event_id) AS message_hash FROM events")
def _(spark, sf):
    """Every event is sent twice; each is kept once."""
    source, target = scratch(spark), scratch(spark)
    events = read(spark, sf, "events").select("event_id", "ts", F.sha2(F.concat(F.lit("e"), F.col("event_id").cast("string")), 256).alias("message_hash"))
    events.unionByName(events).repartition(4, "event_id").write.parquet(source)
    stream = streams.stream_dedup(_stream(spark, source, events.schema), "ts", "message_hash", "60 days")
    stream.writeStream.format("parquet").option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.parquet(target).select("event_id", "message_hash")


@query("r3_stream_daily_spikes", """WITH d AS (SELECT cast(ts AS date) AS d, sum(value) AS s, count(*) AS n FROM events GROUP BY 1),
 z AS (SELECT *, (s - avg(s) OVER ()) / stddev_pop(s) OVER () AS z FROM d)
 SELECT d::VARCHAR AS date, round(s, 4) AS value_sum, n AS transaction_count, CASE WHEN z > 1.0 THEN 'spike' WHEN z < -1.0 THEN 'drop' END AS kind FROM z""")
def _(spark, sf):
    """After the last micro-batch the stored totals and the flags equal a batch computation."""
    source, target, flagged = scratch(spark), scratch(spark), scratch(spark)
    events = read(spark, sf, "events").select("event_id", "ts", "value")
    events.repartition(4, "event_id").write.parquet(source)

    def keep(flags, batch_id):
        flags.select("date", "kind", F.lit(batch_id).alias("batch")).write.mode("append").parquet(flagged)

    streams.stream_daily_spikes(
        _stream(spark, source, events.schema), "ts", "value", target, scratch(spark), "60 days", threshold=1.0, on_flags=keep).awaitTermination()
    flags = spark.read.parquet(flagged)
    last = flags.join(flags.agg(F.max("batch").alias("batch")), "batch").select("date", "kind")
    return texts(rounded(streams.current_totals(spark, target, "value").join(last, "date", "left")), "date")


@query("r1_stream_ingest_store", WITH_LEDGER + "SELECT id, date, amount, payee FROM ledger")
def _(spark, sf):
    """As `r1_stream_ingest`, into a ledger keyed by month and hash slot."""
    source, target, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    table = ledger_table(spark, sf).withColumns({"sms_text": F.concat(F.lit("m"), F.col("id")), "ord": F.col("id").cast("long") * 2})
    again = table.filter("ord % 3 = 0").withColumn("ord", F.col("ord") + 1)
    table.unionByName(again).repartition(4, "ord").write.parquet(source)
    for _ in range(2):
        streams.stream_ingest(spark, _stream(spark, source, spark.read.parquet(source).schema), target, checkpoint, "ord", slots=1).awaitTermination()
    return spark.read.parquet(target).select("id", "date", "amount", "payee")


@query("r3_stream_daily_flags", """WITH d AS (SELECT cast(ts AS date) AS d, sum(value) AS s, count(*) AS n FROM events GROUP BY 1),
 z AS (SELECT *, (s - avg(s) OVER ()) / stddev_pop(s) OVER () AS z FROM d)
 SELECT d::VARCHAR AS date, round(s, 4) AS value_sum, n AS transaction_count, CASE WHEN z > 1.0 THEN 'spike' WHEN z < -1.0 THEN 'drop' END AS kind FROM z""")
def _(spark, sf):
    """Late rows come with the second file; the flags of the last micro-batch equal a batch computation."""
    source, target = scratch(spark), scratch(spark)
    events = read(spark, sf, "events").select("event_id", "ts", "value")
    events.repartition(4, "event_id").write.parquet(source)
    streams.stream_daily_flags(_stream(spark, source, events.schema), "ts", "value", target, scratch(spark), 1.0).awaitTermination()
    return texts(rounded(streams.current_flags(spark, target, "value")), "date")


@query("l9_run_incremental_append", """SELECT o_orderkey AS order_key, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_totalprice AS amount,
 CASE WHEN o_orderkey % 5 <> 0 THEN 1 ELSE 2 END::BIGINT AS files_from FROM orders""")
def _(spark, sf):
    """The second load adds files and leaves those of the first as they are."""
    name = _name("inc")
    raw = _raw_orders(spark, sf)
    before = jobs.run_incremental(spark, raw.filter("`Order Key` % 5 <> 0"), name).inputFiles()
    table = jobs.run_incremental(spark, raw, name)
    listed = spark.createDataFrame([(os.path.basename(f),) for f in before], "name string")
    rows = table.withColumn("name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return rows.join(listed.withColumn("old", F.lit(True)), "name", "left").select(
        "order_key", "priority", "order_date", "amount", F.when(F.col("old"), 1).otherwise(2).cast("long").alias("files_from"))
