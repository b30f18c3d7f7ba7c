"""Normalising, cleaning and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindings.registry import longs, query, read, rounded, texts
from txnlake.functions import text
from txnlake.operators import clean, profile
from txnlake.sources import readers

# Dates in several styles, one unparsable in ten; the SQL reads them back style by style.
STYLED = """CASE o_orderkey % 5 WHEN 0 THEN substr(day, 1, 10)
 WHEN 1 THEN substr(day, 6, 2) || '/' || substr(day, 9, 2) || '/' || substr(day, 1, 4)
 WHEN 2 THEN substr(day, 9, 2) || '-' || substr(day, 6, 2) || '-' || substr(day, 1, 4)
 WHEN 3 THEN substr(day, 1, 4) || '/' || substr(day, 6, 2) || '/' || substr(day, 9, 2)
 ELSE 'n/a ' || day END"""
WITH_STYLED = f"WITH s AS (SELECT *, {STYLED} AS d FROM (SELECT *, cast(cast(o_orderdate AS date) AS string) AS day FROM orders))"


def _styled(spark, sf):
    days = read(spark, sf, "orders").withColumn("day", F.expr("cast(cast(o_orderdate AS date) AS string)"))
    return days.withColumn("d", F.expr(STYLED))


@query("p1_normalize_columns", """SELECT c_custkey AS customer_key, c_name AS full_name, c_acctbal AS account_balance, c_mktsegment AS full_name_2 FROM customer""")
def _(spark, sf):
    raw = read(spark, sf, "customer").select(
        F.col("c_custkey").alias(" Customer Key "), F.col("c_name").alias("Full-Name"),
        F.col("c_acctbal").alias("ACCOUNT (balance)"), F.col("c_mktsegment").alias("full name"),
    )
    return clean.normalize_columns(raw)


@query("p2_strip_strings", "SELECT p_partkey, p_name, p_type FROM part")
def _(spark, sf):
    padded = read(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit(" \t"), "p_name", F.lit("\n ")).alias("p_name"), F.concat(F.lit("  "), "p_type").alias("p_type")
    )
    return clean.strip_strings(padded)


@query("p3_clean_text", r"""SELECT doc_id, sha256(trim(regexp_replace(text, '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS h FROM documents""")
def _(spark, sf):
    out = clean.clean_text(read(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.sha2("text", 256).alias("h"))


@query("p4_standardize_dates", WITH_STYLED + """ SELECT o_orderkey, coalesce(strftime(coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%m/%d/%Y'),
 try_strptime(d, '%d-%m-%Y'), try_strptime(d, '%Y/%m/%d'), try_strptime(d, '%d/%m/%Y')), '%Y-%m-%d'), d) AS d FROM s""")
def _(spark, sf):
    return clean.standardize_dates(_styled(spark, sf).select("o_orderkey", "d"), ["d"])


@query("p5_detect_date_columns", """SELECT 'o_orderdate' AS "column", true AS is_date, count(*) > 0 AS present FROM orders
 UNION ALL SELECT 'created_text', true, count(*) > 0 FROM orders UNION ALL SELECT 'updated_by', false, count(*) > 0 FROM orders""")
def _(spark, sf):
    raw = read(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", F.date_format("o_orderdate", "dd/MM/yyyy").alias("created_text"),
        F.col("o_orderpriority").alias("updated_by"),
    )
    present = raw.agg((F.count("*") > 0).alias("present"))
    found = clean.date_column_profile(raw).select("column", "is_date")
    return found.withColumn("present", present.scalar())


@query("p6_normalize_numeric", """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE cast(o_totalprice AS decimal(18,2))::DOUBLE END AS price FROM orders""")
def _(spark, sf):
    raw = read(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 6 == 0, F.lit("none"))
        .otherwise(F.concat(F.lit("$ "), F.format_number("o_totalprice", 2), F.lit(" "))).alias("price"),
    )
    return clean.normalize_numeric(raw, ["price"])


@query("p7_apply_schema", WITH_STYLED + """ SELECT o_orderkey::INTEGER::BIGINT AS o_orderkey, try_cast(o_orderpriority AS BIGINT) AS o_orderpriority,
 CASE WHEN o_orderkey % 5 = 0 THEN d END AS d FROM s""")
def _(spark, sf):
    out = clean.apply_schema(
        _styled(spark, sf).select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, F.col("d")).otherwise("x").alias("d")),
        {"o_orderkey": "int", "o_orderpriority": "bigint", "d": "date", "absent": "int"},
    )
    return longs(texts(out, "d"))


@query("p17_apply_filters", """SELECT event_id, value FROM events WHERE value > 100 AND isodow(ts) < 6""")
def _(spark, sf):
    events = read(spark, sf, "events").select("event_id", "ts", "value")
    high = lambda df: df.filter("value > 100")
    return clean.apply_filters(events, [high, clean.weekdays_only("ts")]).select("event_id", "value")


@query("l7_handle_missing_drop", "SELECT event_id, value FROM events WHERE event_id % 3 <> 0")
def _(spark, sf):
    gaps = read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return clean.handle_missing(gaps, "drop", ["value"])


@query("l7_handle_missing_fill", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 7.5 ELSE value END AS value FROM events")
def _(spark, sf):
    gaps = read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return clean.handle_missing(gaps, "fill", ["value"], 7.5)


def _distinct_sql(direction: str) -> str:
    return (
        f"SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type "
        f"ORDER BY event_id {direction}) AS n FROM events) WHERE n = 1"
    )


def _keep(spark, sf, keep):
    events = read(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return clean.distinct_rows(events, ["user_id", "event_type"], keep, ["event_id"])


@query("g38_distinct_rows_first", _distinct_sql(""))
def _(spark, sf):
    return _keep(spark, sf, "first")


@query("g38_distinct_rows_last", _distinct_sql("DESC"))
def _(spark, sf):
    return _keep(spark, sf, "last")


@query("g38_distinct_rows_none", """SELECT l_orderkey, l_partkey, max(l_quantity) AS l_quantity FROM (SELECT l_orderkey, l_partkey % 20 AS l_partkey, l_quantity FROM lineitem)
 GROUP BY 1, 2 HAVING count(*) = 1""")
def _(spark, sf):
    items = read(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 20).alias("l_partkey"), "l_quantity")
    return clean.distinct_rows(items, ["l_orderkey", "l_partkey"], "none")


@query("g38_distinct_rows_whole", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def _(spark, sf):
    return clean.distinct_rows(read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@query("a9_remove_outliers_iqr", """WITH b1 AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events),
 s1 AS (SELECT events.* FROM events, b1 WHERE value BETWEEN a - 0.2 * (b - a) AND b + 0.2 * (b - a)),
 b2 AS (SELECT quantile_cont(user_id, 0.25) AS a, quantile_cont(user_id, 0.75) AS b FROM s1)
 SELECT event_id, value FROM s1, b2 WHERE user_id BETWEEN a - 0.2 * (b - a) AND b + 0.2 * (b - a)""")
def _(spark, sf):
    events = read(spark, sf, "events").select("event_id", "user_id", "value")
    return clean.remove_outliers(events, ["value", "user_id"], "iqr", 0.2).select("event_id", "value")


@query("a9_remove_outliers_zscore", """WITH b1 AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem),
 s1 AS (SELECT lineitem.* FROM lineitem, b1 WHERE abs((l_extendedprice - m) / s) <= 1.5),
 b2 AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM s1)
 SELECT l_orderkey, l_linenumber, l_partkey FROM s1, b2 WHERE abs((l_quantity - m) / s) <= 1.5""")
def _(spark, sf):
    items = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    out = clean.remove_outliers(items, ["l_extendedprice", "l_quantity"], "zscore", 1.5)
    return longs(out.select("l_orderkey", "l_linenumber", "l_partkey"))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _numeric_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, "
        f"round(min({c}), 5) AS min, round(quantile_cont({c}, 0.25), 5) AS p25, round(quantile_cont({c}, 0.5), 5) AS p50, "
        f"round(quantile_cont({c}, 0.75), 5) AS p75, round(max({c}), 5) AS max, count(*) - count({c}) AS null_count FROM lineitem"
    )


@query("g6_summary_numeric", " UNION ALL ".join(_numeric_sql(c) for c in NUMBERS))
def _(spark, sf):
    return rounded(profile.summary_numeric(read(spark, sf, "lineitem"), NUMBERS), 5)


@query("g6_summary_numeric_approx")
def _(spark, sf):
    """The approximate form: quartiles and distinct counts by sketch, never exact, so without SQL."""
    return rounded(profile.summary_numeric(read(spark, sf, "lineitem"), NUMBERS, exact=False), 5)


def _categorical_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM p) AS unique_count, (SELECT count(*) - count({c}) FROM p) AS null_count, "
        f"rank, value, n AS count FROM (SELECT {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank "
        f"FROM p WHERE {c} IS NOT NULL GROUP BY 1) WHERE rank <= 5"
    )


@query("g7_summary_categorical", "WITH p AS (SELECT p_name, p_brand, CASE WHEN p_size > 40 THEN NULL ELSE p_type END AS p_type FROM part) "
       + " UNION ALL ".join(_categorical_sql(c) for c in ("p_name", "p_brand", "p_type")))
def _(spark, sf):
    part = read(spark, sf, "part").select("p_name", "p_brand", F.when(F.col("p_size") <= 40, F.col("p_type")).alias("p_type"))
    return longs(profile.summary_categorical(part))


@query("t5_top_values", "SELECT p_name, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, sf):
    return profile.top_values(read(spark, sf, "part"), "p_name", 5)


@query("g8_summary_dates", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", strftime(min({c}), '%Y-%m-%d') AS min_date, strftime(max({c}), '%Y-%m-%d') AS max_date,
 date_diff('day', min({c}), max({c})) AS date_range_days, count(*) - count({c}) AS null_count FROM {t}"""
    for c, t in (("l_shipdate", "lineitem"), ("o_orderdate", "orders"))))
def _(spark, sf):
    out = profile.summary_dates(read(spark, sf, "lineitem")).unionByName(profile.summary_dates(read(spark, sf, "orders")))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("min_date", "max_date")})


def _quality_sql(table: str, columns: list[tuple[str, str, bool]], distinct: str) -> str:
    parts = []
    for c, kind, number in columns:
        zero = f"count(*) FILTER ({c} = 0)" if number else "NULL::BIGINT"
        neg = f"count(*) FILTER ({c} < 0)" if number else "NULL::BIGINT"
        parts.append(
            f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, count(*) AS total_rows, {len(columns)}::BIGINT AS total_columns, "
            f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS duplicate_rows, count(*) - count({c}) AS null_count, "
            f"round(100.0 * (count(*) - count({c})) / count(*), 5) AS null_pct, count(DISTINCT {c}) AS unique_count, "
            f"round(100.0 * count(DISTINCT {c}) / count(*), 5) AS unique_pct, {zero} AS zero_count, {neg} AS negative_count FROM {table}"
        )
    return f"WITH {table} AS ({distinct}) " + " UNION ALL ".join(parts)


@query("g9_data_quality", _quality_sql(
    "q", [("l_quantity", "double", True), ("l_discount", "double", True), ("l_tax", "double", True), ("flag", "string", False)],
    "SELECT l_quantity, l_discount, l_tax - 0.04 AS l_tax, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS flag FROM lineitem"))
def _(spark, sf):
    items = read(spark, sf, "lineitem").select(
        "l_quantity", "l_discount", (F.col("l_tax") - 0.04).alias("l_tax"),
        F.when(F.col("l_linenumber") != 7, F.col("l_returnflag")).alias("flag"),
    )
    return rounded(profile.data_quality(items), 5)


SCHEMA_COLUMNS = [("o_orderkey", "bigint", "integer", 1), ("o_totalprice", "double", "numeric", 1),
                  ("o_orderpriority", "string", "categorical", 0), ("day", "string", "date_string", 0)]


@query("g10_infer_schema", """WITH o AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 9 = 8 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
 strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders) """ + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS dtype, count(*) - count({c}) AS null_count, round(100.0 * (count(*) - count({c})) / count(*), 5) AS null_pct, "
    f"count(DISTINCT {c}) AS unique_count, '{s}' AS semantic_type, "
    f"(SELECT string_agg(v, '|' ORDER BY o_orderkey) FROM (SELECT o_orderkey, {c}::VARCHAR AS v FROM o WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 3)) AS samples, "
    + ", ".join(f"{'round(' + e + ', 4)' if number else 'NULL::DOUBLE'} AS {a}" for e, a in (
        (f"min({c})::DOUBLE", "min"), (f"max({c})::DOUBLE", "max"), (f"avg({c})", "mean"), (f"median({c})", "median"), (f"stddev_samp({c})", "std")))
    + " FROM o" for c, k, s, number in SCHEMA_COLUMNS))
def _(spark, sf):
    orders = read(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 9 != 8, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )
    out = profile.infer_schema(orders, ["o_orderkey"]).withColumn("samples", F.concat_ws("|", "samples"))
    return rounded(out, 4, null_pct=5)


@query("g11_infer_semantic_type", """SELECT * FROM (VALUES ('o_orderkey', 'integer'), ('o_totalprice', 'numeric'), ('o_orderdate', 'datetime'),
 ('o_orderpriority', 'categorical'), ('day', 'date_string'), ('urgent', 'boolean'), ('payee', 'text')) t("column", semantic_type) WHERE (SELECT count(*) FROM orders) > 0""")
def _(spark, sf):
    return profile.infer_semantic_type(
        read(spark, sf, "orders").select(
            "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
            (F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("payee"),
        ),
        ["o_orderkey"],
    )


@query("g12_suggest_types", """WITH r AS (SELECT max(p_partkey) AS k, max(p_size) AS z, count(DISTINCT p_brand) AS u, count(*) AS n FROM part)
 SELECT unnest(['p_partkey', 'p_size', 'balance', 'p_brand', 'p_retailprice']) AS "column", unnest([
  CASE WHEN k < 256 THEN 'uint8' WHEN k < 65536 THEN 'uint16' ELSE 'uint32' END, CASE WHEN z < 256 THEN 'uint8' WHEN z < 65536 THEN 'uint16' ELSE 'uint32' END,
  'int', CASE WHEN u < 50 AND u / n < 0.05 THEN 'category' ELSE 'string' END, 'double']) AS suggested FROM r""")
def _(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", "p_size", (-F.col("p_size")).alias("balance"), "p_brand", "p_retailprice")
    return profile.suggest_types(part, ["p_partkey"])


@query("g13_correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM lineitem" for a in NUMBERS for b in NUMBERS))
def _(spark, sf):
    return rounded(profile.correlation_matrix(read(spark, sf, "lineitem"), NUMBERS), 8)


@query("g14_outlier_report", """WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n FROM events),
 o AS (SELECT event_id, value, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, n FROM events, b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))
 SELECT 'value' AS "column", count(*) AS count, round(100.0 * count(*) / max(n), 5) AS percentage, round(max(lo), 5) AS lower_bound, round(max(hi), 5) AS upper_bound,
 (SELECT string_agg(value::VARCHAR, '|' ORDER BY event_id) FROM (SELECT * FROM o ORDER BY event_id LIMIT 10)) AS outlier_values FROM o""")
def _(spark, sf):
    out = profile.outlier_report(read(spark, sf, "events").select("event_id", "value"), ["value"], order=["event_id"])
    shown = F.concat_ws("|", F.transform("outlier_values", lambda v: v.cast("string")))
    return rounded(out.withColumn("outlier_values", shown), 5)


@query("t7_union_all", """SELECT 'customer' AS kind, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer
 UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""")
def _(spark, sf):
    c = read(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return readers.union_all([c, s])


@query("t8_append_distinct", "SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem")
def _(spark, sf):
    items = read(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    return readers.append_distinct(items.filter("l_orderkey % 2 = 0"), items)


@query("f1_date_parts", """SELECT event_id, hour(ts) AS hour, strftime(ts, '%Y-%m-%d') AS date, year(ts) AS year, month(ts) AS month,
 dayname(ts) AS day_name, monthname(ts) AS month_name, strftime(ts, '%Y-%m') AS year_month FROM events""")
def _(spark, sf):
    ts = F.col("ts")
    return longs(
        read(spark, sf, "events").select(
            "event_id", F.hour(ts).alias("hour"), F.to_date(ts).cast("string").alias("date"), F.year(ts).alias("year"),
            F.month(ts).alias("month"), F.date_format(ts, "EEEE").alias("day_name"), F.date_format(ts, "MMMM").alias("month_name"),
            F.date_format(ts, "yyyy-MM").alias("year_month"),
        )
    )


@query("f2_parse_dates", WITH_STYLED + """ SELECT o_orderkey, strftime(coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%Y/%m/%d'), try_strptime(d, '%d/%m/%Y'), try_strptime(d, '%m/%d/%Y')), '%Y-%m-%d') AS d FROM s""")
def _(spark, sf):
    from txnlake.functions.fixed_values import HISTORY_DATE_FORMATS

    day = F.date_format(text.parse_timestamp(F.col("d"), HISTORY_DATE_FORMATS), "yyyy-MM-dd")
    return _styled(spark, sf).select("o_orderkey", day.alias("d"))


@query("f3_number_cast", """SELECT o_orderkey, cast(o_totalprice AS decimal(18,2))::DOUBLE AS v FROM orders""")
def _(spark, sf):
    money = F.concat(F.lit(" "), F.format_number("o_totalprice", 2), F.lit(" "))
    cast = text.decimal_text(money).try_cast("decimal(38,10)").cast("double")
    return read(spark, sf, "orders").select("o_orderkey", cast.alias("v"))


@query("f4_list_functions", """SELECT p_partkey, upper(p_name) AS upper_name, string_split(p_name, ' ')[1] AS first_word, contains(p_name, 'red') AS has_red,
 array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), ['new', 'red']))), ',') AS words FROM part""")
def _(spark, sf):
    from txnlake.operators.classify import merge_tags

    parts = F.split("p_name", " ")
    return read(spark, sf, "part").select(
        "p_partkey", F.upper("p_name").alias("upper_name"), F.slice(parts, 1, 1)[0].alias("first_word"), F.contains("p_name", F.lit("red")).alias("has_red"),
        F.concat_ws(",", merge_tags(parts, F.array(F.lit("new"), F.lit("red")))).alias("words"),
    )


@query("f7_row_id", """SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id
 FROM (SELECT event_id, sha256(event_id || '|' || user_id) AS h FROM events)""")
def _(spark, sf):
    return read(spark, sf, "events").select("event_id", text.row_id(F.col("event_id"), F.col("user_id")).alias("id"))


@query("f8_numeric_functions", """SELECT event_type, round(max(abs(value - 100)), 4) AS reach, round(quantile_cont(value, 0.9), 4) AS p90,
 round(stddev_samp(value), 6) AS std_sample, round(stddev_pop(value), 6) AS std_population, round((max(value) - avg(value)) / stddev_samp(value), 6) AS top_z FROM events GROUP BY 1""")
def _(spark, sf):
    out = read(spark, sf, "events").groupBy("event_type").agg(
        F.round(F.max(F.abs(F.col("value") - 100)), 4).alias("reach"), F.round(F.percentile("value", 0.9), 4).alias("p90"),
        F.stddev_samp("value").alias("std_sample"), F.stddev_pop("value").alias("std_population"),
        ((F.max("value") - F.avg("value")) / F.stddev_samp("value")).alias("top_z"),
    )
    return rounded(out, 6)


@query("f9_combined_text", """SELECT o_orderkey, trim(concat_ws(' ', CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END)) AS t FROM orders""")
def _(spark, sf):
    o = read(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("a"), F.when(F.col("o_orderkey") % 4 == 0, "  ").otherwise(F.col("o_orderstatus")).alias("b")
    )
    return o.select("o_orderkey", text.combined(["a", "b"]).alias("t"))


@query("f11_json_strings", """SELECT user_id, count(*) AS n FROM (SELECT user_id, unnest([event_type, 'x'] ) FROM events) GROUP BY 1""")
def _(spark, sf):
    packed = read(spark, sf, "events").select("user_id", F.to_json(F.array("event_type", F.lit("x"))).alias("j"))
    return packed.select("user_id", F.explode(text.json_strings(F.col("j"))).alias("e")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("u1_nfc", "SELECT doc_id, sha256(nfc_normalize(replace(text, chr(233), 'e' || chr(769)))) AS h FROM documents")
def _(spark, sf):
    apart = F.replace(F.col("text"), F.lit("\u00e9"), F.lit("e\u0301"))
    return read(spark, sf, "documents").select("doc_id", F.sha2(text.nfc(apart), 256).alias("h"))
