"""Spending reports over the ledger view of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import WITH_LEDGER, ledger_table, query, rounded
from txnlake.operators import reports

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13)][:80]  # all months of the test orders
NAMED = "coalesce(nullif(category, ''), 'Uncategorized')"


def _ledger(spark, sf):
    return ledger_table(spark, sf).withColumn("date", F.to_date("date"))


@query("g19_pivot_month_category", WITH_LEDGER + "SELECT substr(date, 1, 7) AS month, " + ", ".join(
    f"round(coalesce(sum(amount) FILTER ({NAMED} = '{p}'), 0.0), 2) AS \"{p}\"" for p in [*PRIORITIES, "Uncategorized"]) + " FROM ledger GROUP BY 1")
def _(spark, sf):
    return rounded(reports.pivot_month_category(_ledger(spark, sf), "amount", "date", "category"), 2)


@query("g20_pivot_category_month_totals", WITH_LEDGER + f""", l AS (
 SELECT {NAMED} AS category, substr(date, 1, 7) AS month, amount FROM ledger),
 c AS (SELECT CASE WHEN grouping(category) = 1 THEN 'Total' ELSE category END AS category,
  CASE WHEN grouping(month) = 1 THEN 'Total' ELSE month END AS month, sum(amount) AS v FROM l GROUP BY CUBE (category, month))
 SELECT category, """ + ", ".join(
    f"round(coalesce(max(v) FILTER (month = '{m}'), 0.0), 2) AS \"{m}\"" for m in [*MONTHS, "Total"]) + " FROM c GROUP BY 1")
def _(spark, sf):
    return rounded(reports.pivot_category_month_totals(_ledger(spark, sf), "amount", "date", "category"), 2)


@query("g21_monthly_stats", WITH_LEDGER + """SELECT substr(date, 1, 7) AS month, round(coalesce(sum(amount), 0.0), 2) AS total,
 round(avg(amount), 4) AS average, count(amount) AS count FROM ledger GROUP BY 1""")
def _(spark, sf):
    return rounded(reports.monthly_stats(_ledger(spark, sf), "amount", "date"), 4, total=2)


@query("g22_category_share", WITH_LEDGER + """SELECT category, round(coalesce(sum(amount), 0.0), 2) AS total,
 round(coalesce(sum(amount), 0.0) * 100.0 / (SELECT sum(amount) FROM ledger), 5) AS pct FROM ledger GROUP BY 1""")
def _(spark, sf):
    return rounded(reports.category_share(_ledger(spark, sf), "amount", "category"), 5, total=2)


@query("g23_merchant_stats", WITH_LEDGER + """SELECT payee, round(coalesce(sum(amount), 0.0), 2) AS total_spend,
 count(*) AS transaction_count, round(coalesce(sum(amount), 0.0) / count(*), 6) AS avg_transaction FROM ledger GROUP BY 1""")
def _(spark, sf):
    return rounded(reports.merchant_stats(_ledger(spark, sf), "amount", "payee"), 6, total_spend=2)


@query("t2_top_merchants", WITH_LEDGER + """SELECT payee, round(coalesce(sum(amount), 0.0), 2) AS total_spend,
 count(*) AS transaction_count, round(coalesce(sum(amount), 0.0) / count(*), 6) AS avg_transaction
FROM ledger GROUP BY 1 ORDER BY coalesce(sum(amount), 0.0) DESC, payee LIMIT 10""")
def _(spark, sf):
    return rounded(reports.top_merchants(_ledger(spark, sf), "amount", "payee", 10), 6, total_spend=2)


@query("g24_urgency_stats", WITH_LEDGER + """SELECT urgency, round(coalesce(sum(amount), 0.0), 2) AS total_spend, count(amount) AS count,
 round(avg(amount), 4) AS avg_spend, round(count(amount) * 100.0 / (SELECT count(amount) FROM ledger), 5) AS pct FROM ledger GROUP BY 1""")
def _(spark, sf):
    return rounded(reports.urgency_stats(_ledger(spark, sf), "amount"), 5, total_spend=2, avg_spend=4)


@query("g25_credit_debit_split", WITH_LEDGER + """, c AS (SELECT count(*) FILTER (lower(account_type) = 'credit') AS credit_count,
 coalesce(sum(amount) FILTER (lower(account_type) = 'credit'), 0.0) AS credit_total,
 count(*) FILTER (lower(account_type) = 'debit') AS debit_count,
 coalesce(sum(amount) FILTER (lower(account_type) = 'debit'), 0.0) AS debit_total FROM ledger)
 SELECT credit_count, round(credit_total, 2) AS credit_total, debit_count, round(debit_total, 2) AS debit_total,
 round(CASE WHEN debit_total > 0 THEN credit_total / debit_total ELSE 0.0 END, 6) AS credit_debit_ratio FROM c""")
def _(spark, sf):
    out = reports.credit_debit_split(_ledger(spark, sf), "amount", "account_type")
    return rounded(out, 2, credit_debit_ratio=6)


@query("g26_account_type_by_category", WITH_LEDGER + """SELECT account_type, category, round(coalesce(sum(amount), 0.0), 2) AS total
 FROM ledger GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(reports.account_type_by_category(_ledger(spark, sf), "amount", "account_type", "category"), 2)


@query("g27_top_category_per_account_type", WITH_LEDGER + """, s AS (SELECT account_type, category, coalesce(sum(amount), 0.0) AS t
 FROM ledger WHERE category <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY account_type ORDER BY t DESC, category) AS n FROM s)
 SELECT account_type, category AS top_category, round(t, 2) AS top_total FROM r WHERE n = 1""")
def _(spark, sf):
    named = _ledger(spark, sf).filter("category <> ''")
    return rounded(reports.top_category_per_account_type(named, "amount", "account_type", "category"), 2)
