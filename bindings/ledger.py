"""Ledger queries over the ledger view of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import WITH_LEDGER, ledger_table, query, read, rounded, scratch
from txnlake.operators import ledger, ledger_store

FILTERS = {
    "amount_min": 50000, "amount_max": 400000, "date_from": "1996-02-01", "date_to": "1998-06-30",
    "category_in": ["1-URGENT", "5-LOW"], "account_type": "Credit",
}
WHERE = (
    "amount >= 50000 AND amount <= 400000 AND date >= '1996-02-01' AND date <= '1998-06-30' "
    "AND category IN ('1-URGENT', '5-LOW') AND account_type = 'Credit'"
)


@query("p8_filter_ledger", WITH_LEDGER + f"SELECT * FROM ledger WHERE {WHERE}")
def _(spark, sf):
    return ledger.filter_ledger(ledger_table(spark, sf), FILTERS)


@query("p8_filter_ledger_search", WITH_LEDGER + """SELECT id, date, amount FROM ledger WHERE amount >= 100000
 AND list_has_all(string_split_regex(lower(concat_ws(' ', date, payee, category, subcategory, tags)), '\\W+'), ['urgent', '1997'])""")
def _(spark, sf):
    found = ledger.filter_ledger(ledger_table(spark, sf), {"amount_min": 100000, "search": "Urgent 1997"})
    return found.select("id", "date", "amount")


@query("p9_count_ledger", WITH_LEDGER + f"SELECT count(*) AS count FROM ledger WHERE {WHERE}")
def _(spark, sf):
    return ledger.count_ledger(ledger_table(spark, sf), FILTERS)


@query("p10_search_ledger", """WITH d AS (SELECT doc_id, list_distinct(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}]+')) AS w FROM documents)
 SELECT doc_id FROM d WHERE list_has_all(w, ['the', 'and'])""")
def _(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return ledger.search_ledger(docs, "The AND", ["text"], limit=None).select("doc_id")


@query("p10_search_ledger_many_hits", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O'")
def _(spark, sf):
    """More hits than any page of results: all of them come back."""
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return ledger.search_ledger(lines, "n O", ["l_returnflag", "l_linestatus"]).select("l_orderkey", "l_linenumber")


@query("p11_interactive_filter", WITH_LEDGER + """SELECT id FROM ledger WHERE date BETWEEN '1996-01-01' AND '1997-12-31'
 AND category IN ('2-HIGH', '3-MEDIUM') AND urgency IN ('high')""")
def _(spark, sf):
    table = ledger_table(spark, sf).withColumn("date", F.to_date("date"))
    return ledger.interactive_filter(table, "date", "1996-01-01", "1997-12-31", ["2-HIGH", "3-MEDIUM"], ["All"], ["high"]).select("id")


@query("p14_expense_rows", """SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1""")
def _(spark, sf):
    rows = read(spark, sf, "orders").withColumn(
        "transaction_state", F.when(F.col("o_orderkey") % 4 == 0, "DECLINED").otherwise("MONETARY")
    )
    return rounded(ledger.expense_rows(rows).groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("total")), 2)


@query("p15_export_projection", WITH_LEDGER + "SELECT id, date, payee, category, subcategory, amount, currency, account_id, account_type, tags, urgency FROM ledger")
def _(spark, sf):
    return ledger.export_projection(ledger_table(spark, sf).withColumn("internal", F.lit(1)))


@query("p16_parsed_to_ledger", WITH_LEDGER + """SELECT date, payee, amount, account_id, currency, urgency AS tags, 'high' AS confidence, id AS sms_text FROM ledger""")
def _(spark, sf):
    parsed = ledger_table(spark, sf).select(
        "date", "payee", "amount", F.col("account_id").alias("matched_bank"), "currency", F.col("urgency").alias("transaction_type"),
        F.lit("high").alias("confidence"), F.col("id").alias("sms_text"),
    )
    return ledger.parsed_to_ledger(parsed)


def _money(agg: str) -> str:
    return f"round(coalesce(cast({agg} AS decimal(38,6)), 0), 2)::DOUBLE"


@query("g15_summary_by_month", f"""{WITH_LEDGER}SELECT substr(date, 1, 7) AS month, count(*) AS transaction_count, {_money('sum(amount)')} AS total_amount,
 {_money('avg(amount)')} AS avg_amount, {_money('min(amount)')} AS min_amount, {_money('max(amount)')} AS max_amount
 FROM ledger WHERE date >= '1995-03-01' AND date <= '2000-12-31' GROUP BY 1""")
def _(spark, sf):
    return ledger.summary_by_month(ledger_table(spark, sf), date_from="1995-03-01", date_to="2000-12-31")


@query("g16_summary_by_month_category", f"""{WITH_LEDGER}SELECT substr(date, 1, 7) AS month, coalesce(nullif(category, ''), 'Uncategorized') AS category,
 count(*) AS transaction_count, {_money('sum(amount)')} AS total_amount FROM ledger GROUP BY 1, 2""")
def _(spark, sf):
    return ledger.summary_by_month_category(ledger_table(spark, sf))


@query("g17_summary_by_month_account_type", f"""{WITH_LEDGER}SELECT substr(date, 1, 7) AS month, coalesce(nullif(account_type, ''), 'Unknown') AS account_type,
 count(*) AS transaction_count, {_money('sum(amount)')} AS total_amount FROM ledger GROUP BY 1, 2""")
def _(spark, sf):
    return ledger.summary_by_month_account_type(ledger_table(spark, sf))


@query("g18_summary_by_month_tag", f"""{WITH_LEDGER}, t AS (SELECT substr(date, 1, 7) AS month, coalesce(amount, 0.0) AS a, trim(unnest(string_split(tags, ','))) AS tag FROM ledger)
 SELECT month, tag, count(*) AS transaction_count, {_money('sum(a)')} AS total_amount FROM t WHERE tag <> '' GROUP BY 1, 2""")
def _(spark, sf):
    return ledger.summary_by_month_tag(ledger_table(spark, sf))


# A stored part of the ledger and a batch that repeats some of it and some of itself.
BATCH_SQL = """ stored AS (SELECT *, sha256(id) AS message_hash FROM ledger WHERE cast(id AS BIGINT) % 4 <> 0),
 batch AS (SELECT *, sha256(id) AS message_hash, cast(id AS BIGINT) * 2 AS ord FROM ledger WHERE cast(id AS BIGINT) % 2 = 0
  UNION ALL SELECT *, sha256(id) AS message_hash, cast(id AS BIGINT) * 2 + 1 AS ord FROM ledger WHERE cast(id AS BIGINT) % 6 = 0) """


def _stored(spark, sf):
    table = ledger_table(spark, sf).withColumn("message_hash", F.sha2("id", 256))
    return table.filter("cast(id AS bigint) % 4 <> 0")


def _batch(spark, sf):
    table = ledger_table(spark, sf).withColumn("message_hash", F.sha2("id", 256))
    key = F.col("id").cast("long")
    once = table.filter(key % 2 == 0).withColumn("ord", key * 2)
    again = table.filter(key % 6 == 0).withColumn("ord", key * 2 + 1)
    return once.unionByName(again)


SAME = "b.message_hash = s.message_hash OR (b.date = s.date AND b.amount = s.amount AND b.payee = s.payee AND b.account_id = s.account_id)"


@query("j5_new_rows_only", f"{WITH_LEDGER},{BATCH_SQL} SELECT ord FROM batch b WHERE message_hash NOT IN (SELECT message_hash FROM stored) "
       "AND NOT EXISTS (SELECT 1 FROM stored s WHERE b.date = s.date AND b.amount = s.amount AND b.payee = s.payee AND b.account_id = s.account_id)")
def _(spark, sf):
    return ledger.new_rows_only(_batch(spark, sf), _stored(spark, sf)).select("ord")


@query("j6_existing_rows", f"{WITH_LEDGER},{BATCH_SQL} SELECT ord FROM batch b WHERE message_hash IN (SELECT message_hash FROM stored) "
       "OR EXISTS (SELECT 1 FROM stored s WHERE b.date = s.date AND b.amount = s.amount AND b.payee = s.payee AND b.account_id = s.account_id)")
def _(spark, sf):
    return ledger.existing_rows(_batch(spark, sf), _stored(spark, sf)).select("ord")


@query("l1_transaction_hash", WITH_LEDGER + """SELECT id, sha256(concat_ws('|', date, '', coalesce(cast(cast(amount AS decimal(18,2)) AS string), ''), payee, account_id, '')) AS h FROM ledger""")
def _(spark, sf):
    table = ledger_table(spark, sf).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    return table.select("id", ledger.transaction_hash(table).alias("h"))


@query("l2_message_hash", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN sha256(text) ELSE sha256('||' || turn || '|||') END AS h FROM conversations")
def _(spark, sf):
    talk = read(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("").alias("sms_text"), F.col("turn").alias("amount")
    )
    return talk.select("conv_id", "turn", ledger.message_hash(talk).alias("h"))


FIRSTS = """ n AS (SELECT b.*, row_number() OVER (PARTITION BY message_hash ORDER BY ord) AS r FROM batch b
  WHERE message_hash NOT IN (SELECT message_hash FROM stored)) """


@query("l3_insert_skip", f"{WITH_LEDGER},{BATCH_SQL},{FIRSTS} SELECT ord, CASE WHEN ord IN (SELECT ord FROM n WHERE r = 1) THEN 'inserted' ELSE 'skipped' END AS status FROM batch")
def _(spark, sf):
    _, status = ledger.insert_skip(_stored(spark, sf), _batch(spark, sf), "ord")
    return status.select("ord", "status")


@query("l3_insert_skip_ledger", f"{WITH_LEDGER},{BATCH_SQL},{FIRSTS} SELECT id, date, amount, message_hash FROM stored UNION ALL SELECT id, date, amount, message_hash FROM n WHERE r = 1")
def _(spark, sf):
    table, _ = ledger.insert_skip(_stored(spark, sf), _batch(spark, sf), "ord")
    return table.select("id", "date", "amount", "message_hash")


@query("l5_load_stats", f"""{WITH_LEDGER},{BATCH_SQL},{FIRSTS} SELECT (SELECT count(*) FROM n WHERE r = 1) AS inserted, 0::BIGINT AS updated,
 (SELECT count(*) FROM batch) - (SELECT count(*) FROM n WHERE r = 1) AS skipped, 0::BIGINT AS failed""")
def _(spark, sf):
    _, status = ledger.insert_skip(_stored(spark, sf), _batch(spark, sf), "ord")
    return ledger.load_stats(status)


@query("l4_upsert", f"""{WITH_LEDGER},{BATCH_SQL}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS r FROM batch) WHERE r = 1)
 SELECT coalesce(s.id, l.id) AS id, CASE WHEN l.id IS NOT NULL THEN 'batch ' || l.ord ELSE s.category END AS category,
  CASE WHEN l.id IS NOT NULL THEN NULL ELSE s.urgency END AS urgency, coalesce(s.payee, l.payee) AS payee
 FROM stored s FULL JOIN last l ON s.id = l.id""")
def _(spark, sf):
    """The batch changes the category, sets the urgency to NULL and brings a column the ledger lacks."""
    batch = _batch(spark, sf).withColumns(
        {"category": F.concat(F.lit("batch "), F.col("ord").cast("string")), "urgency": F.lit(None).cast("string"), "note": F.lit("x")}
    )
    table, _ = ledger.upsert(_stored(spark, sf), batch, "ord")
    return table.select("id", "category", "urgency", "payee")


@query("l4_upsert_stats", f"""{WITH_LEDGER},{BATCH_SQL},{FIRSTS} SELECT (SELECT count(*) FROM n WHERE r = 1) AS inserted,
 (SELECT count(*) FROM batch) - (SELECT count(*) FROM n WHERE r = 1) AS updated, 0::BIGINT AS skipped, 0::BIGINT AS failed""")
def _(spark, sf):
    _, status = ledger.upsert(_stored(spark, sf), _batch(spark, sf), "ord")
    return ledger.load_stats(status)


# Rows of the batch lose their ids, share one, take a stored one, or lack a date.
ODD_IDS = """ odd AS (SELECT * REPLACE (CASE WHEN cast(id AS BIGINT) % 3 = 0 THEN NULL WHEN cast(id AS BIGINT) % 5 = 0 THEN '1'
  WHEN cast(id AS BIGINT) % 7 = 0 THEN 'shared' ELSE id END AS id, CASE WHEN cast(id AS BIGINT) % 11 = 0 THEN NULL ELSE date END AS date),
  sha256(id) AS message_hash, cast(id AS BIGINT) AS ord FROM ledger WHERE cast(id AS BIGINT) % 2 = 0) """
STORED = BATCH_SQL.split("batch AS")[0].rstrip(" ,\n")


def _odd_batch(spark, sf):
    key = F.col("id").cast("long")
    table = ledger_table(spark, sf).filter(key % 2 == 0).withColumns({"message_hash": F.sha2("id", 256), "ord": key})
    odd_id = F.when(key % 3 == 0, None).when(key % 5 == 0, "1").when(key % 7 == 0, "shared").otherwise(F.col("id"))
    return table.withColumns({"date": F.when(key % 11 != 0, F.col("date")), "id": odd_id})


@query("l4_upsert_odd_ids", f"""{WITH_LEDGER},{STORED},{ODD_IDS},
 s AS (SELECT *, CASE WHEN date IS NULL THEN 'failed' WHEN ord % 4 <> 0 THEN 'updated' ELSE 'inserted' END AS status FROM odd)
 SELECT ord, status, CASE WHEN status = 'failed' THEN 'missing date' END AS reason,
  CASE WHEN status = 'updated' THEN true WHEN status = 'inserted' THEN id IS NOT NULL AND id <> '1' AND (id <> 'shared'
   OR ord = min(ord) FILTER (status = 'inserted' AND id = 'shared') OVER ()) END AS expected_id FROM s""")
def _(spark, sf):
    """Whether a stored id is the row's own (new rows) or that of the row it equals (known rows)."""
    _, status = ledger.upsert(_stored(spark, sf), _odd_batch(spark, sf), "ord")
    expected = F.when(F.col("status") == "updated", F.col("stored_id") == F.col("ord").cast("string")).when(
        F.col("status") == "inserted", F.coalesce(F.col("stored_id") == F.col("id"), F.lit(False)))
    return status.select("ord", "status", "reason", expected.alias("expected_id"))


@query("l4_upsert_odd_ids_ledger", f"""{WITH_LEDGER},{STORED},{ODD_IDS}, n AS (SELECT * FROM odd WHERE date IS NOT NULL AND ord % 4 = 0)
 SELECT (SELECT count(*) FROM stored) + (SELECT count(*) FROM n) AS rows, (SELECT count(*) FROM stored) + (SELECT count(*) FROM n) AS ids,
  (SELECT count(DISTINCT message_hash) FROM stored) + (SELECT count(*) FROM n) AS hashes""")
def _(spark, sf):
    table, _ = ledger.upsert(_stored(spark, sf), _odd_batch(spark, sf), "ord")
    return table.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.countDistinct("message_hash").alias("hashes"))


@query("l6_update_where", WITH_LEDGER + "SELECT id, CASE WHEN id IN ('1', '2', '3') THEN 'Food' ELSE category END AS category, CASE WHEN id IN ('1', '2', '3') THEN 9.5 ELSE amount END AS amount FROM ledger")
def _(spark, sf):
    return ledger.update_where(ledger_table(spark, sf), ["1", "2", "3"], {"category": "Food", "amount": 9.5}).select("id", "category", "amount")


@query("l6_delete_where", WITH_LEDGER + "SELECT id FROM ledger WHERE id NOT IN ('5', '6')")
def _(spark, sf):
    return ledger.delete_where(ledger_table(spark, sf), ["5", "6"]).select("id")


# Every row shares its hash with one neighbour and its key with the other, ten thousand rows in a chain.
CHAIN = """ chained AS (SELECT cast(id AS BIGINT) AS ord, 'h' || cast(id AS BIGINT) // 10000 || '_' || cast(id AS BIGINT) % 10000 // 2 AS message_hash, '2024-01-01' AS date,
  1.0::DOUBLE AS amount, 'P' || cast(id AS BIGINT) // 10000 || '_' || (cast(id AS BIGINT) % 10000 + 1) // 2 AS payee, 'x' AS account_id FROM ledger) """


@query("l3_insert_skip_chain", f"{WITH_LEDGER},{CHAIN} SELECT ord, message_hash, payee, CASE WHEN ord % 10000 % 2 = 0 THEN 'inserted' ELSE 'skipped' END AS status FROM chained")
def _(spark, sf):
    """Whether a row is inserted depends on all rows before it in its chain."""
    key = F.col("id").cast("long")
    block, place = F.floor(key / 10000), key % 10000
    batch = ledger_table(spark, sf).select(
        key.alias("ord"), F.concat(F.lit("h"), block, F.lit("_"), F.floor(place / 2)).alias("message_hash"), F.lit("2024-01-01").alias("date"),
        F.lit(1.0).alias("amount"), F.concat(F.lit("P"), block, F.lit("_"), F.floor((place + 1) / 2)).alias("payee"), F.lit("x").alias("account_id"))
    _, status = ledger.insert_skip(ledger.empty_ledger(spark), batch, "ord")
    return status.select("ord", "message_hash", "payee", "status")


def _store(spark, sf):
    path = scratch(spark)
    ledger_store.create(_stored(spark, sf), path, 4)
    return path


@query("l3_load_skip_store", f"{WITH_LEDGER},{BATCH_SQL},{FIRSTS} SELECT id, date, amount, message_hash FROM stored UNION ALL SELECT id, date, amount, message_hash FROM n WHERE r = 1")
def _(spark, sf):
    """A skip load into a stored ledger, then the ledger."""
    path = _store(spark, sf)
    ledger_store.load_skip(path, _batch(spark, sf), "ord", slots=4)
    return ledger_store.read(spark, path).select("id", "date", "amount", "message_hash")


@query("l4_load_upsert_store", f"""{WITH_LEDGER},{BATCH_SQL}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS r FROM batch) WHERE r = 1)
 SELECT coalesce(s.id, l.id) AS id, CASE WHEN l.id IS NOT NULL THEN 'batch ' || l.ord ELSE s.category END AS category,
  CASE WHEN l.id IS NOT NULL THEN NULL ELSE s.urgency END AS urgency, coalesce(s.payee, l.payee) AS payee
 FROM stored s FULL JOIN last l ON s.id = l.id""")
def _(spark, sf):
    """An upsert that rewrites only partitions with changes, then the ledger."""
    path = _store(spark, sf)
    batch = _batch(spark, sf).withColumns({"category": F.concat(F.lit("batch "), F.col("ord").cast("string")), "urgency": F.lit(None).cast("string"), "note": F.lit("x")})
    ledger_store.load_upsert(path, batch, "ord", slots=4)
    return ledger_store.read(spark, path).select("id", "category", "urgency", "payee")
