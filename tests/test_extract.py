import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from txnlake.functions import text
from txnlake.functions.templates import STOCK_TEMPLATES, from_named_patterns
from txnlake.operators import classify, extract
from txnlake.plans import jobs

MESSAGES = [
    "Your HSBC card ending 1234 was charged 250.50 EGP at Carrefour City on 15/11/2024",
    "CIB: Purchase of 99,50 USD at Store 7 on 01-02-24, card ending 5678",
    "تم خصم 500 جنيه من بطاقة 9012 في 12/10/2024", "مبلغ ٢٥٠٫٥٠ ريال بطاقة رقم ١٢٣٤", "Withdrawal of 100 EGP at ATM card 3456",
    "OTP code 1234", "hello", "", "   ", "paid 20 to Bob for lunch", "amount 5 EGP", "Transfer of 1,00 AED from Ann. Payment", None,
    "charged 10 EGP on 2024-01-05 at Shop on", "خصم 10 دولار شراء من كارفور في 01/02/2024 رقم 4321",
]


def messages(spark, texts=MESSAGES):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def by_rule(message, templates):
    """The sequential rule: most fields win; an equal one replaces only with high confidence."""
    if message is None or not message.strip():
        return None, "low"
    message, best, best_score = message.strip(), None, 0
    digits = message.translate(str.maketrans("٠١٢٣٤٥٦٧٨٩٫٬", "0123456789.,"))
    card = next((m.group(1) for p in extract.CARD_SUFFIX_PATTERNS if (m := re.search(p, digits, re.I))), None)
    for t in templates:
        found = {}
        for f, (pattern, group) in t["fields"].items():
            m = re.search(pattern, message, re.I)
            found[f] = m.group(group).strip().translate(str.maketrans("٠١٢٣٤٥٦٧٨٩٫٬", "0123456789.,")) if m else None
        found["card_suffix"] = found["card_suffix"] or card
        n = sum(v is not None for v in found.values())
        if any(found[f] is None for f in t["required"]):
            level = "low"
        else:
            level = "high" if n >= 5 else "medium" if n >= 3 else "low"
        if n > best_score or (n == best_score and level == "high"):
            best, best_score = (found, level, t["bank"], t["name"]), n
    return best, best[1] if best else "low"


def test_parse_equals_the_sequential_rule(spark):
    for r in extract.parse_messages(messages(spark)).collect():
        want, level = by_rule(MESSAGES[r["id"]], STOCK_TEMPLATES)
        assert r["confidence"] == level
        if want is None:
            assert r["matched_template"] is None and r["amount"] is None
        else:
            assert {f: r[f] for f in want[0]} == want[0] and (r["matched_bank"], r["matched_template"]) == want[2:]


def test_known_bank_limits_the_templates(spark):
    df = messages(spark, ["charged 10 EGP at Shop on 01/02/2024 POS"]).withColumn("bank", F.lit("CIB"))
    assert extract.parse_messages(df, bank="bank").first()["matched_bank"] == "CIB"
    other = df.withColumn("bank", F.lit("NoBank"))
    r = extract.parse_messages(other, bank="bank").first()
    assert r["confidence"] == "low" and r["amount"] is None and r["matched_bank"] is None


def test_templates_with_named_groups(spark):
    t = from_named_patterns("B", "named", {
        "amount": r"paid (?P<amount>\d+)", "currency": r"(?P<amount_val>\d+) (?P<currency>EGP|USD)", "date": r"(?P<day>\d+/\d+)|(?P<other>today)", "bad": "([",
    })
    r = extract.parse_messages(messages(spark, ["paid 30 EGP today"]), templates=[t]).first()
    assert (r["amount"], r["currency"], r["date"], r["matched_bank"]) == ("30", "EGP", "today", "B")


def test_card_suffix(spark):
    cases = {
        "card ending 1234": "1234", "بطاقة رقم ١٢٣٤": "1234", "HSBC card **5678 charged": "5678", "ends with 4321": "4321", "No card": None,
        "ending 12345": None, "****9999": "9999", "بطاقة **1111": "1111", "card number 2222 used": "2222",
    }
    got = {r["text"]: r["card_suffix"] for r in extract.extract_card_suffix(messages(spark, list(cases))).collect()}
    assert got == cases


def test_sanitize_and_dedup(spark):
    raw = ["Hello‎  World", "  a   b ", "x\ty", "Hello World", "﻿", "a b"]
    df = extract.sanitize_messages(messages(spark, raw))
    assert [r["text"] for r in df.orderBy("id").collect()] == ["Hello World", "a b", "x\ty", "Hello World", "", "a b"]
    assert [r["id"] for r in extract.dedup_messages(df, "text", ["id"]).orderBy("id").collect()] == [0, 1, 2]


def test_repair(spark):
    cases = {"cafÃ©": ("café", True), "é": ("é", False), "مرحبا": ("مرحبا", False), " plain ": ("plain", True), "ok": ("ok", False)}
    rows = extract.repair_text(messages(spark, list(cases)).withColumn("raw", F.col("text"))).collect()
    assert {r["raw"]: (r["text"], r["text_repaired"]) for r in rows} == cases


def test_digits(spark):
    got = spark.createDataFrame([("١٬٢٣٤٫٥٦ abc",)], "t string").select(text.western_digits(F.col("t")).alias("t")).first()["t"]
    assert got == "1,234.56 abc"


def test_dates_take_the_year_of_the_file(spark):
    rows = [("21/07", dt.datetime(2022, 7, 21)), ("21-07", dt.datetime(2021, 1, 1)), ("31/02", dt.datetime(2022, 1, 1)), ("03/04/2020", dt.datetime(2022, 1, 1)), ("x", dt.datetime(2022, 1, 1))]
    df = spark.createDataFrame(rows, "date string, file_mtime timestamp")
    out = extract.resolve_dates(df)
    assert [r["resolved_date"] for r in out.collect()] == ["2022-07-21", "2021-07-21", None, "2020-04-03", None]
    assert [r["year_suspect"] for r in extract.year_inference_audit(out).collect()] == [False, False, False, True, False]


def validated(spark, **fields):
    base = {"amount": None, "currency": None, "date": None, "payee": None, "card_suffix": None, "confidence": None, **fields}
    schema = ", ".join(f"{k} string" for k in base)
    return extract.validate_fields(spark.createDataFrame([tuple(base.values())], schema)).first()


@pytest.mark.parametrize("fields, warnings, confidence", [
    ({"amount": "100.50", "currency": "EGP", "date": "15/11/2024"}, [], "high"),
    ({"amount": "1,234 ", "currency": "usd", "date": "Nov 5, 2024"}, [], "high"),
    ({"amount": "10", "currency": "جنيه"}, [], "low"),
    ({"amount": "abc", "currency": "EGP"}, ["Invalid numeric format for amount: abc"], "low"),
    ({"currency": "EGP"}, ["Missing required field: amount"], "low"),
    ({"amount": "-5", "currency": "EGP"}, ["Amount must be positive"], "medium"),
    ({"amount": "5", "currency": "XXX"}, ["Invalid currency code: XXX"], "medium"),
    ({"amount": "5", "currency": "EGP", "date": "99/99/2024"}, ["Malformed date: 99/99/2024"], "medium"),
    ({"amount": "5", "date": "99/99/2024"}, ["Missing currency field", "Malformed date: 99/99/2024"], "low"),
    ({"amount": "5", "currency": "EGP", "card_suffix": "12"}, ["Invalid card suffix (must be 4 digits): 12"], "medium"),
    ({"amount": "5", "currency": "EGP", "confidence": "Medium "}, [], "medium"),
])
def test_validation(spark, fields, warnings, confidence):
    r = validated(spark, **fields)
    assert (list(r["warnings"]), r["confidence"]) == (warnings, confidence)


def test_commas_are_thousands(spark):
    assert validated(spark, amount="100,50", currency="EGP")["amount"] == "10050"


def accounts(spark):
    return spark.createDataFrame([("1234", "A1", "Credit", 19.99, "Main"), ("5678", "A2", "Debit", None, "Other")],
                                 "card_suffix string, account_id string, account_type string, interest_rate double, label string")


def test_account_lookup(spark):
    df = spark.createDataFrame([("1234",), ("0000",), (None,)], "card_suffix string")
    got = {r["card_suffix"]: (r["account_id"], r["account_type"], r["is_known"], r["label"]) for r in extract.lookup_accounts(df, accounts(spark)).collect()}
    assert got == {"1234": ("A1", "Credit", True, "Main"), "0000": ("unknown_0000", "Unknown", False, "Unknown card"), None: ("unknown", "Unknown", False, "Invalid suffix")}


def test_states_in_order(spark):
    df = spark.createDataFrame([
        ("OTP code 1234", "1"), ("Payment declined", "1"), ("special promo for you", "1"), ("paid", None), ("paid", "5"), ("declined code", "1"), ("decoded", "2"), ("bought off-road", "3"),
    ], "text string, amount string")
    assert [r["transaction_state"] for r in classify.classify_state(df).collect()] == ["OTP", "DECLINED", "PROMO", "UNKNOWN", "MONETARY", "OTP", "MONETARY", "PROMO"]


def test_messages_to_ledger(spark):
    df = messages(spark).withColumn("file_mtime", F.lit("2024-06-01").cast("timestamp"))
    out = jobs.messages_to_ledger(df, accounts(spark))
    got = {r["id"]: r for r in out.collect()}
    first = got[0]
    assert (first["amount"], first["currency"], first["date"], first["payee"]) == (250.5, "EGP", "2024-11-15", "Carrefour City")
    assert (first["account_id"], first["account_type"], first["urgency"], first["transaction_state"]) == ("A1", "Credit", "normal", "MONETARY")
    assert got[5]["transaction_state"] == "OTP" and "has-warnings" in got[6]["tags"]
    assert got[6]["account_id"] is None and got[12]["confidence"] == "low"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_urgency(spark):
    df = spark.createDataFrame([(10000.0, "Debit"), (5000.0, "Credit"), (5000.0, "Debit"), (None, "Credit")], "a double, k string")
    assert [r["u"] for r in df.select(extract.urgency(F.col("a"), F.col("k")).alias("u")).collect()] == ["high", "medium", "normal", "normal"]


def test_dates_without_a_file_time_take_the_year_of_the_run(spark):
    df = spark.createDataFrame([("21/07", None), ("21/07", "2022-07-21")], "date string, file_mtime string").withColumn("file_mtime", F.to_timestamp("file_mtime"))
    at = F.lit("2019-03-01").cast("timestamp")
    assert [r["resolved_date"] for r in extract.resolve_dates(df, ingested_at=at).collect()] == ["2019-07-21", "2022-07-21"]


def test_stock_templates_on_literal_messages(spark):
    rows = [
        ("HSBC", "Your HSBC card ending 1234 was charged 250.50 EGP at Carrefour City on 15/11/2024", ("250.50", "EGP", "15/11/2024", "Carrefour City", "1234")),
        ("CIB", "CIB: debited 99,95 USD at Store 7, on 01-02-24 card ending 4321 POS", ("99,95", "USD", "01-02-24", "Store 7", "4321")),
        ("QNB", "QNB amount 10 SAR from Shop on 03/04/2024 ending 5555 Online", ("10", "SAR", "03/04/2024", "Shop", "5555")),
        ("Generic_Bank", "transaction 75.00 GBP at Corner Cafe on 2024-05-06 ending 9876", ("75.00", "GBP", "2024-05-06", "Corner Cafe", "9876")),
    ]
    df = spark.createDataFrame([(b, m) for b, m, _ in rows], "bank string, text string")
    got = {r["bank"]: r for r in extract.parse_messages(df, "text", bank="bank").collect()}
    for bank, _, want in rows:
        r = got[bank]
        assert r["matched_bank"] == bank
        assert (r["amount"], r["currency"], r["date"], r["payee"], r["card_suffix"]) == want
