"""Message, merchant, category and classifier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import WITH_MESSAGES, longs, message_table, query, read, rounded, scratch, spread
from txnlake.functions import similarity, text
from txnlake.functions.fixed_values import BANK_PATTERNS, PROMO_ARABIC, PROMO_LATIN
from txnlake.functions.templates import STOCK_TEMPLATES
from txnlake.operators import classify, extract, ml
from txnlake.plans import jobs

SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TRIMMED = rf"regexp_replace(%s, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _trim(expr: str) -> str:
    return TRIMMED % expr


# --- cleaning of messages ---------------------------------------------------------------------


@query("x1_sanitize_messages", f"""WITH d AS (SELECT doc_id, '  ' || chr(8206) || replace(text, ' ', '   ' || chr(8203)) || chr(65279) AS t FROM documents)
SELECT doc_id, sha256(regexp_replace(regexp_replace({_trim('t')}, '[\\x{{200e}}\\x{{200f}}\\x{{200b}}-\\x{{200d}}\\x{{feff}}]', '', 'g'), ' +', ' ', 'g')) AS h FROM d""")
def _(spark, sf):
    marked = F.concat(F.lit("  \u200e"), F.replace("text", F.lit(" "), F.lit("   \u200b")), F.lit("\ufeff"))
    out = extract.sanitize_messages(read(spark, sf, "documents").select("doc_id", marked.alias("text")))
    return out.select("doc_id", F.sha2("text", 256).alias("h"))


@query("x2_dedup_messages", "SELECT min(doc_id) AS doc_id FROM documents WHERE text <> '' GROUP BY text")
def _(spark, sf):
    return extract.dedup_messages(read(spark, sf, "documents"), "text", ["doc_id"]).select("doc_id")


@query("t6_limit_messages", "SELECT conv_id, turn FROM conversations ORDER BY conv_id, turn LIMIT 100")
def _(spark, sf):
    return extract.limit_messages(read(spark, sf, "conversations"), 100, ["conv_id", "turn"]).select("conv_id", "turn")


@query("x3_repair_text", f"""SELECT conv_id, turn, sha256({_trim('text')}) AS h,
 (conv_id % 2 = 0 AND regexp_matches(text, '[^\\x00-\\x7F]')) OR {_trim('text')} <> text AS text_repaired FROM conversations""")
def _(spark, sf):
    talk = read(spark, sf, "conversations")
    garbled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    mixed = talk.withColumn("text", F.when(F.col("conv_id") % 2 == 0, garbled).otherwise(F.col("text")))
    out = extract.repair_text(mixed)
    return out.select("conv_id", "turn", F.sha2("text", 256).alias("h"), "text_repaired")


@query("x4_western_digits", WITH_MESSAGES + "SELECT message_id, translate(text, '٠١٢٣٤٥٦٧٨٩٫٬', '0123456789.,') AS text FROM messages")
def _(spark, sf):
    return message_table(spark, sf).select("message_id", text.western_digits(F.col("text")).alias("text"))


# --- extraction -------------------------------------------------------------------------------

CARD_SQL = """coalesce(nullif(regexp_extract(w, '(?:ending|card ending|ends with)\\s+(\\d{4})(?:\\D|$)', 1, 'i'), ''),
 nullif(regexp_extract(w, '(?:card|Card)\\s+(?:number\\s+)?(?:\\*+\\s*)?(\\d{4})(?:\\D|$)', 1, 'i'), ''), nullif(regexp_extract(w, '\\*+(\\d{4})(?:\\D|$)', 1, 'i'), ''),
 nullif(regexp_extract(w, '(?:رقم|بطاقة رقم|ينتهي)\\s+(\\d{4})(?:\\D|$)', 1, 'i'), ''), nullif(regexp_extract(w, '(?:بطاقة)\\s+(?:\\*+\\s*)?(\\d{4})(?:\\D|$)', 1, 'i'), ''))"""
WITH_WESTERN = WITH_MESSAGES + ", wm AS (SELECT *, trim(text) AS t, translate(trim(text), '٠١٢٣٤٥٦٧٨٩٫٬', '0123456789.,') AS w FROM messages)" \
    + f", cm AS (SELECT *, {CARD_SQL} AS card FROM wm)"


def _field_sql(pattern: str, group: int) -> str:
    sql_pattern = pattern.replace("\\u0600-\\u06FF", "\\x{0600}-\\x{06FF}").replace("'", "''")
    # Java, asked for Unicode, counts Arabic digits as \\d; RE2 does not.
    sql_pattern = sql_pattern.replace("\\d", "[\\p{Nd}]")
    return f"translate(trim(nullif(regexp_extract(t, '{sql_pattern}', {group}, 'i'), '')), '٠١٢٣٤٥٦٧٨٩٫٬', '0123456789.,')"


def _template_sql(i: int, template: dict) -> str:
    fields = {f: _field_sql(*spec) for f, spec in template["fields"].items()}
    fields["card_suffix"] = f"coalesce({fields['card_suffix']}, card)"
    listed = ", ".join(f"{sql} AS {name}" for name, sql in fields.items())
    score = " + ".join(f"({name} IS NOT NULL)::INT" for name in fields)
    missing = " OR ".join(f"{name} IS NULL" for name in template["required"])
    return (
        f"SELECT *, CASE WHEN {missing} THEN 'low' WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS confidence, {i} AS place, "
        f"'{template['bank']}' AS matched_bank, '{template['name']}' AS matched_template FROM "
        f"(SELECT *, {score} AS score FROM (SELECT message_id, t, {listed} FROM cm))"
    )


WITH_PARSED = WITH_WESTERN + ", options AS (" + " UNION ALL ".join(_template_sql(i, t) for i, t in enumerate(STOCK_TEMPLATES)) + """),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY score DESC, (confidence = 'high') DESC,
   CASE WHEN confidence = 'high' THEN place ELSE -place END DESC) AS n FROM options WHERE score > 0),
 parsed AS (SELECT cm.message_id, cm.t, cm.file_mtime, amount, currency, date, payee, transaction_type, card_suffix, coalesce(confidence, 'low') AS confidence,
   coalesce(matched_bank, 'unknown') AS matched_bank, matched_template FROM cm LEFT JOIN (SELECT * FROM ranked WHERE n = 1) r USING (message_id)) """


@query("x5_extract_fields", WITH_WESTERN + ", f AS (" + _template_sql(8, STOCK_TEMPLATES[8]) + ") SELECT message_id, amount, currency, date, payee, transaction_type FROM f")
def _(spark, sf):
    found = extract.extract_fields(text.stripped(F.col("text")), STOCK_TEMPLATES[8])
    found.pop("card_suffix")
    return message_table(spark, sf).select("message_id", *[c.alias(n) for n, c in found.items()])


@query("x6_extract_card_suffix", WITH_WESTERN + "SELECT message_id, card AS card_suffix FROM cm")
def _(spark, sf):
    return extract.extract_card_suffix(message_table(spark, sf)).select("message_id", "card_suffix")


@query("x7_template_confidence", WITH_WESTERN + ", f AS (" + _template_sql(0, STOCK_TEMPLATES[0]) + ") SELECT confidence, count(*) AS n FROM f GROUP BY 1")
def _(spark, sf):
    out = extract.parse_messages(message_table(spark, sf), templates=STOCK_TEMPLATES[:1])
    return out.groupBy("confidence").agg(F.count("*").alias("n"))


PARSED_COLUMNS = "message_id, amount, currency, date, payee, transaction_type, card_suffix, confidence, matched_bank, matched_template"


@query("x8_parse_messages", WITH_PARSED + f"SELECT {PARSED_COLUMNS} FROM parsed")
def _(spark, sf):
    return extract.parse_messages(message_table(spark, sf)).select(*PARSED_COLUMNS.split(", "))


RAW_DATES = """SELECT o_orderkey AS message_id, o_orderdate AS file_mtime, CASE o_orderkey % 5 WHEN 0 THEN substr(day, 9, 2) || '/' || substr(day, 6, 2) || '/' || substr(day, 1, 4)
 WHEN 1 THEN day WHEN 2 THEN substr(day, 9, 2) || '/' || substr(day, 6, 2) WHEN 3 THEN substr(day, 9, 2) || '-' || substr(day, 6, 2) ELSE 'soon' END AS date
 FROM (SELECT *, cast(cast(o_orderdate AS date) AS string) AS day FROM orders)"""
RESOLVED = """coalesce(try_strptime(date, '%d/%m/%Y'), try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%m/%d/%Y'), try_strptime(date, '%d-%m-%Y'),
 CASE WHEN regexp_full_match(date, '\\d{1,2}[/-]\\d{1,2}') THEN try_strptime(replace(date, '-', '/') || '/' || year(file_mtime), '%d/%m/%Y') END)"""


def _raw_dates(spark, sf):
    read(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql(RAW_DATES)


@query("x9_resolve_dates", f"SELECT message_id, date AS extracted_date_raw, strftime({RESOLVED}, '%Y-%m-%d') AS resolved_date FROM ({RAW_DATES})")
def _(spark, sf):
    return extract.resolve_dates(_raw_dates(spark, sf)).select("message_id", "extracted_date_raw", "resolved_date")


FIELDS_LIST = """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'abc' WHEN 2 THEN '-5' WHEN 3 THEN ' 1,234.50 '
 ELSE cast(cast(o_totalprice AS decimal(18,2)) AS string) END AS amount,
 CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'xyz' WHEN 2 THEN 'usd ' ELSE 'EGP' END AS currency,
 CASE o_orderkey % 4 WHEN 0 THEN cast(cast(o_orderdate AS date) AS string) WHEN 1 THEN '31/31/2020' WHEN 2 THEN '15 Jan 2024' ELSE NULL END AS date,
 CASE o_orderkey % 3 WHEN 0 THEN '1234' WHEN 1 THEN '12a4' ELSE NULL END AS card_suffix,
 '  Store   ' || cast(o_custkey % 9 AS string) AS payee, 'POS' AS transaction_type, 'HSBC' AS matched_bank, 'medium' AS confidence FROM orders"""
CHECKED = f"""WITH raw AS ({FIELDS_LIST}), c AS (SELECT id, CASE WHEN try_cast(replace(replace(amount, ',', ''), ' ', '') AS decimal(38,10)) IS NOT NULL
  THEN replace(replace(amount, ',', ''), ' ', '') ELSE trim(amount) END AS amount, try_cast(replace(replace(amount, ',', ''), ' ', '') AS decimal(28,10)) AS number,
  upper(trim(currency)) AS currency, date, card_suffix, payee FROM raw),
 w AS (SELECT *, list_filter([
  CASE WHEN amount IS NULL THEN 'Missing required field: amount' WHEN number IS NULL THEN 'Invalid numeric format for amount: ' || amount WHEN number <= 0 THEN 'Amount must be positive' END,
  CASE WHEN currency IS NULL THEN 'Missing currency field' WHEN currency NOT IN ('EGP', 'USD') THEN 'Invalid currency code: ' || currency END,
  CASE WHEN date = '31/31/2020' THEN 'Malformed date: ' || date END,
  CASE WHEN card_suffix = '12a4' THEN 'Invalid card suffix (must be 4 digits): ' || card_suffix END], lambda x: x IS NOT NULL) AS warnings FROM c),
 v AS (SELECT *, CASE WHEN amount IS NULL OR number IS NULL OR len(warnings) >= 2 THEN 'low' WHEN len(warnings) = 1 THEN 'medium'
  WHEN date IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence FROM w) """


def _fields(spark, sf):
    read(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql(FIELDS_LIST)


@query("x10_validate_fields", CHECKED + "SELECT id, amount, currency, date, card_suffix, array_to_string(warnings, '|') AS warnings FROM v")
def _(spark, sf):
    out = extract.validate_fields(_fields(spark, sf))
    return out.select("id", "amount", "currency", "date", "card_suffix", F.concat_ws("|", "warnings").alias("warnings"))


@query("x11_validation_confidence", CHECKED + "SELECT id, confidence FROM v")
def _(spark, sf):
    return extract.validate_fields(_fields(spark, sf)).select("id", "confidence")


@query("x12_normalize_records", CHECKED + """, a AS (SELECT *, CASE WHEN card_suffix IS NULL THEN NULL WHEN card_suffix = '1234' THEN 'Credit' ELSE 'Unknown' END AS kind FROM v)
SELECT id, number::DOUBLE AS amount, currency, regexp_replace(trim(payee), ' +', ' ', 'g') AS payee,
 CASE WHEN date = '15 Jan 2024' THEN '2024-01-15' WHEN date = '31/31/2020' THEN NULL ELSE date END AS date,
 CASE WHEN card_suffix IS NULL THEN NULL WHEN card_suffix = '1234' THEN 'A-1' ELSE 'unknown_12a4' END AS account_id, kind AS account_type,
 CASE WHEN number >= 10000 THEN 'high' WHEN kind = 'Credit' AND number >= 5000 THEN 'medium' ELSE 'normal' END AS urgency,
 'POS,HSBC' || CASE WHEN len(warnings) > 0 THEN ',has-warnings' ELSE '' END AS tags, confidence FROM a""")
def _(spark, sf):
    accounts = read(spark, sf, "region").limit(1).select(
        F.lit("1234").alias("card_suffix"), F.lit("A-1").alias("account_id"), F.lit("Credit").alias("account_type"), F.lit(19.99).alias("interest_rate")
    )
    checked = extract.validate_fields(_fields(spark, sf)).withColumns(
        {"resolved_date": F.lit(None).cast("string"), "transaction_state": F.lit("monetary")}
    )
    out = extract.normalize_records(extract.lookup_accounts(checked, accounts))
    return out.select(
        "id", "amount", "currency", "payee", "date", "account_id", "account_type", "urgency", F.concat_ws(",", "tags").alias("tags"), "confidence"
    )


@query("x13_urgency", """SELECT c_custkey, CASE WHEN c_acctbal * 2 >= 10000 THEN 'high' WHEN c_mktsegment = 'BUILDING' AND c_acctbal * 2 >= 5000 THEN 'medium' ELSE 'normal' END AS urgency FROM customer""")
def _(spark, sf):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "Credit").otherwise("Debit")
    return read(spark, sf, "customer").select("c_custkey", extract.urgency(F.col("c_acctbal") * 2, kind).alias("urgency"))


@query("x14_year_inference_audit", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, abs(year(l_shipdate) - 1999) > 1 AS year_suspect FROM lineitem""")
def _(spark, sf):
    items = read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("resolved_date"),
        F.lit("1999-06-01").cast("timestamp").alias("file_mtime"),
    )
    return longs(extract.year_inference_audit(items).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "year_suspect"))


# Accounts for every third customer suffix, from the customer table.
ACCOUNTS = """SELECT lpad(cast(c_custkey % 10000 AS string), 4, '0') AS card_suffix, 'ACC-' || cast(min(c_custkey) AS string) AS account_id,
 CASE WHEN min(c_custkey) % 2 = 0 THEN 'Credit' ELSE 'Debit' END AS account_type, cast(min(c_custkey) % 20 AS double) AS interest_rate
 FROM customer WHERE c_custkey % 3 = 0 GROUP BY lpad(cast(c_custkey % 10000 AS string), 4, '0')"""


def _accounts(spark, sf):
    read(spark, sf, "customer").createOrReplaceTempView("customer")
    return spark.sql(ACCOUNTS)


@query("j1_lookup_accounts", WITH_WESTERN + f""", acc AS ({ACCOUNTS}) SELECT message_id, coalesce(account_id, CASE WHEN card IS NULL THEN 'unknown' ELSE 'unknown_' || card END) AS account_id,
 coalesce(account_type, 'Unknown') AS account_type, interest_rate, account_id IS NOT NULL AS is_known FROM cm LEFT JOIN acc ON card = card_suffix""")
def _(spark, sf):
    cards = extract.extract_card_suffix(message_table(spark, sf))
    out = extract.lookup_accounts(cards, _accounts(spark, sf))
    return out.select("message_id", "account_id", "account_type", "interest_rate", "is_known")


# --- promotions, states, banks ----------------------------------------------------------------


def _promo_sql(column: str) -> str:
    edge, tail = "(?:^|[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}])", "(?:[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]|$)"
    hits = []
    for k in PROMO_LATIN:
        start = edge if k[0].isalnum() else "[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]"
        hits.append(f"CASE WHEN regexp_matches(lower({column}), '{start}{k}{tail}') THEN '{k}' END")
    hits += [f"CASE WHEN contains({column}, '{k}') THEN '{k}' END" for k in PROMO_ARABIC]
    return f"list_sort(list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL))"


def _promo_columns(column: str) -> str:
    return f"""SELECT *, len(kw) > 0 AS skip, CASE WHEN trim({column}) = '' THEN 'low' WHEN len(kw) = 0 OR len(kw) >= 3 THEN 'high' WHEN len(kw) = 2 THEN 'medium' ELSE 'low' END AS promo_confidence,
 CASE WHEN trim({column}) = '' THEN 'Invalid input' WHEN len(kw) = 0 THEN 'No promotional keywords detected' ELSE 'Promotional message detected (keywords: ' || array_to_string(kw[1:3], ', ')
 || CASE WHEN len(kw) > 3 THEN ' (and ' || (len(kw) - 3) || ' more)' ELSE '' END || ')' END AS reason"""


@query("c7_classify_promo", WITH_MESSAGES + f", k AS (SELECT *, {_promo_sql('text')} AS kw FROM messages), p AS ({_promo_columns('text')} FROM k) "
       "SELECT message_id, skip, array_to_string(kw, '|') AS matched_keywords, promo_confidence, reason FROM p")
def _(spark, sf):
    out = classify.classify_promo(message_table(spark, sf))
    return out.select("message_id", "skip", F.concat_ws("|", "matched_keywords").alias("matched_keywords"), "promo_confidence", "reason")


@query("c7_classify_promo_documents", f"WITH k AS (SELECT doc_id, text, {_promo_sql('text')} AS kw FROM documents) SELECT doc_id, array_to_string(kw, '|') AS matched_keywords FROM k")
def _(spark, sf):
    out = classify.classify_promo(read(spark, sf, "documents"))
    return out.select("doc_id", F.concat_ws("|", "matched_keywords").alias("matched_keywords"))


@query("g31_promo_statistics", WITH_MESSAGES + f", k AS (SELECT *, {_promo_sql('text')} AS kw FROM messages), p AS ({_promo_columns('text')} FROM k) " + """
 SELECT count(*) AS total, count(*) FILTER (skip) AS promotional, count(*) FILTER (NOT skip) AS other,
 count(*) FILTER (NOT skip AND promo_confidence = 'high') AS passed, count(*) FILTER (reason = 'Invalid input') AS invalid FROM p""")
def _(spark, sf):
    return classify.promo_statistics(classify.classify_promo(message_table(spark, sf)))


STATE_SQL = f"""CASE WHEN regexp_matches(t, '\\b(otp|one\\s*time\\s*password|code)\\b', 'i') THEN 'OTP' WHEN regexp_matches(t, '\\b(declined|refused)\\b', 'i') THEN 'DECLINED'
 WHEN len({_promo_sql('t')}) > 0 THEN 'PROMO' WHEN amount IS NULL THEN 'UNKNOWN' ELSE 'MONETARY' END"""


@query("c9_classify_state", WITH_PARSED + f"SELECT message_id, {STATE_SQL} AS transaction_state FROM parsed")
def _(spark, sf):
    parsed = extract.parse_messages(message_table(spark, sf))
    return classify.classify_state(parsed).select("message_id", "transaction_state")


BANK_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(text, '(?:{'|'.join(ps)})', 'i') THEN '{b}'" for b, ps in BANK_PATTERNS.items()) + " ELSE 'unknown_bank' END"


@query("c8_identify_bank_patterns", WITH_MESSAGES + f"SELECT message_id, bank_id, CASE WHEN bank_id = 'unknown_bank' THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END AS bank_score FROM (SELECT message_id, {BANK_CASE} AS bank_id FROM messages)")
def _(spark, sf):
    return classify.identify_bank(message_table(spark, sf), fuzzy=False).select("message_id", "bank_id", "bank_score")


@query("c8_identify_bank")
def _(spark, sf):
    """With fuzzy matching of what no pattern found; checked against brute force in the tests."""
    return classify.identify_bank(spread(read(spark, sf, "conversations"))).select("conv_id", "turn", "bank_id", "bank_score")


@query("g28_bank_statistics", WITH_MESSAGES + f"SELECT bank_id, count(*) AS count FROM (SELECT {BANK_CASE} AS bank_id FROM messages) GROUP BY 1")
def _(spark, sf):
    return classify.bank_statistics(classify.identify_bank(message_table(spark, sf), fuzzy=False))


PATTERNS = [("greeting", r"\bhello\b"), ("dated", r"\d{2}/\d{2}/\d{4}"), ("paid", r"charged|payment|purchase"), ("broken", "(["), ("offer", r"offer")]


@query("j8_match_any_pattern", WITH_MESSAGES + "SELECT message_id, CASE " + " ".join(
    f"WHEN regexp_matches(text, '{p}', 'i') THEN '{n}'" for n, p in PATTERNS if n != "broken") + " END AS rule FROM messages")
def _(spark, sf):
    return classify.match_any_pattern(message_table(spark, sf), "text", PATTERNS).select("message_id", "rule")


X15_COLUMNS = ["message_id", "amount", "currency", "date", "payee", "transaction_state", "account_id", "account_type", "urgency", "confidence", "tags"]


@query("x15_messages_to_ledger", WITH_PARSED + f""", acc AS ({ACCOUNTS}),
 d AS (SELECT *, {STATE_SQL} AS transaction_state, {RESOLVED} AS day_at, try_cast(replace(amount, ',', '') AS decimal(28,10)) AS number FROM parsed),
 w AS (SELECT *, (amount IS NULL)::INT + (coalesce(number, 1) <= 0)::INT + (currency IS NULL)::INT + (date IS NOT NULL AND day_at IS NULL)::INT AS warned FROM d),
 j AS (SELECT w.*, acc.account_id AS known, acc.account_type AS known_type FROM w LEFT JOIN acc ON w.card_suffix = acc.card_suffix),
 k AS (SELECT *, CASE WHEN card_suffix IS NOT NULL THEN coalesce(known_type, 'Unknown') END AS kind FROM j)
 SELECT message_id, number::DOUBLE AS amount, upper(currency) AS currency, strftime(day_at, '%Y-%m-%d') AS date, payee, transaction_state,
 CASE WHEN card_suffix IS NOT NULL THEN coalesce(known, 'unknown_' || card_suffix) END AS account_id, kind AS account_type,
 CASE WHEN number >= 10000 THEN 'high' WHEN kind = 'Credit' AND number >= 5000 THEN 'medium' ELSE 'normal' END AS urgency,
 CASE WHEN amount IS NULL OR warned >= 2 THEN 'low' WHEN warned = 1 THEN 'medium' WHEN date IS NOT NULL THEN 'high' ELSE confidence END AS confidence,
 concat_ws(',', transaction_type, matched_bank, CASE WHEN warned > 0 THEN 'has-warnings' END) AS tags FROM k""")
def _(spark, sf):
    out = jobs.messages_to_ledger(message_table(spark, sf), _accounts(spark, sf))
    return out.withColumn("tags", F.concat_ws(",", "tags")).select(*X15_COLUMNS)


# --- merchants --------------------------------------------------------------------------------

ALIASES = [
    ("red widget", "Red Widget Co"), ("crimson widget", "Red Widget Co"), ("blue ring", "Blue Ring Ltd"), ("hot plate", "Hot Plate"),
    ("cold plte", "Cold Plate"), ("small rod", "Small Rod"), ("larg gizmo", "Large Gizmo"), ("old bolt", "Old Bolt"), ("new gear eg", "New Gear"),
]
PAYEE = """CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN '  ' || p_name || ' ' WHEN 2 THEN p_name || ' eg' WHEN 3 THEN replace(p_name, 'e', '')
 ELSE CASE WHEN p_partkey % 10 = 4 THEN ' ' END END"""
# The longest common subsequence, one row of the table per character of b.
LCS = """list_reduce(list_transform(string_split(b, ''), lambda ch: [ord(ch)]), lambda row, ch:
  list_reduce(list_transform(range(1, length(a) + 1), lambda i: [cast(i AS INTEGER)]), lambda acc, i:
   list_append(acc, CASE WHEN ord(a[i[1]]) = ch[1] THEN row[i[1]] + 1 ELSE greatest(acc[i[1]], row[i[1] + 1]) END), [0]),
  list_transform(range(0, length(a) + 1), lambda i: 0))"""
WITH_RESOLVED = f"""WITH p AS (SELECT p_partkey, p_retailprice, {PAYEE} AS payee FROM part), al AS (SELECT * FROM (VALUES
 {', '.join(f"({i}, '{a}', '{c}')" for i, (a, c) in enumerate(ALIASES))}) t(i, alias, canonical)),
 n AS (SELECT DISTINCT nullif(trim(lower(payee)), '') AS k FROM p), pairs AS (SELECT k, i, canonical, alias, k AS a, alias AS b FROM n, al WHERE k IS NOT NULL),
 s AS (SELECT k, i, canonical, k = alias AS exact, 200.0 * list_last({LCS}) / (length(a) + length(b)) AS score FROM pairs),
 r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY exact DESC, score DESC, i) AS n FROM s WHERE score >= 85),
 resolved AS (SELECT p_partkey, payee, p_retailprice, coalesce(canonical, CASE WHEN trim(payee) = '' THEN '' ELSE payee END) AS canonical, round(score, 6)::DOUBLE AS match_score
  FROM p LEFT JOIN (SELECT * FROM r WHERE n = 1) r ON nullif(trim(lower(payee)), '') = r.k) """


def _resolved(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", "p_retailprice", F.expr(PAYEE).alias("payee"))
    return classify.resolve_merchants(part, "payee", ALIASES)


@query("j2_resolve_merchants", WITH_RESOLVED + "SELECT p_partkey, canonical, match_score FROM resolved")
def _(spark, sf):
    return rounded(_resolved(spark, sf).select("p_partkey", "canonical", "match_score"), 6)


@query("g32_resolution_statistics", WITH_RESOLVED + """SELECT canonical, count(*) AS transaction_count, round(sum(p_retailprice), 2) AS total_amount,
 round(avg(p_retailprice), 5) AS avg_amount, round(avg(match_score), 4) AS avg_score,
 round(coalesce(sum(p_retailprice) FILTER (match_score IS NULL), 0.0), 2) AS unmatched_amount FROM resolved GROUP BY 1""")
def _(spark, sf):
    return rounded(classify.resolution_statistics(_resolved(spark, sf), "p_retailprice"), 2, avg_amount=5, avg_score=4)


@query("u2_indel_ratio", f"""WITH pairs AS (SELECT p_partkey, p_name AS a, lower(p_type) || ' ' || p_name AS b FROM part)
 SELECT p_partkey, round(200.0 * list_last({LCS}) / (length(a) + length(b)), 6)::DOUBLE AS ratio FROM pairs""")
def _(spark, sf):
    ratio = similarity.ratio_udf(similarity.indel_ratio)
    part = read(spark, sf, "part")
    return rounded(part.select("p_partkey", ratio("p_name", F.concat(F.lower("p_type"), F.lit(" "), "p_name")).alias("ratio")), 6)


@query("u3_token_ratios", """SELECT p_partkey, 100.0::DOUBLE AS token_sort, 100.0::DOUBLE AS token_set FROM part""")
def _(spark, sf):
    """Word order and added words do not lower the token ratios."""
    swapped = F.concat_ws(" ", F.reverse(F.split("p_name", " ")))
    longer = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    sort, sets = similarity.ratio_udf(similarity.token_sort_ratio), similarity.ratio_udf(similarity.token_set_ratio)
    return read(spark, sf, "part").select("p_partkey", sort("p_name", swapped).alias("token_sort"), sets("p_name", longer).alias("token_set"))


@query("u4_partial_ratio")
def _(spark, sf):
    """Checked against every stretch by brute force in the tests."""
    ratio = similarity.ratio_udf(similarity.partial_ratio)
    part = read(spark, sf, "part")
    return rounded(part.select("p_partkey", ratio(F.lower("p_type"), F.concat_ws(" ", "p_name", F.lower("p_brand"))).alias("ratio")), 6)


# --- categories -------------------------------------------------------------------------------

RULES = {
    "rules": [
        {"match": "Red Widget", "category": "Widgets", "subcategory": "Red", "tags": ["red", "Widget"]},
        {"match": "red widget", "category": "never", "subcategory": "never"},
        {"match_regex": "^HOT .*", "category": "Heat", "tags": ["hot"]},
        {"match_regex": "([", "category": "never"},
        {"match_tag": "PROMO", "category": "Promoted", "subcategory": "Tagged"},
    ],
    "categories": [
        {"category": "Plates", "subcategory": "Cold", "tags": ["cold"], "merchant_exact": ["cold plate", " Blue Ring "]},
        {"category": "Gizmos", "subcategory": "All", "tags": ["gizmo"], "merchant_fuzzy": ["gizmo"]},
        {"category": "Rods", "subcategory": "All", "keywords": {"english": ["ROD", "rods"], "arabic": ["قضيب"]}},
        {"category": "Small", "subcategory": "All", "keywords": {"english": ["small"]}},
    ],
    "fallback": {"category": "Uncategorized", "subcategory": "General", "tags": ["Uncategorized"]},
}
NEW, OLD = RULES["rules"], RULES["categories"]
STAGE_CASE = """CASE WHEN lower(p_name) = 'red widget' THEN 'match' WHEN regexp_matches(p_name, '^HOT .*', 'i') THEN 'match_regex' WHEN lower(p_type) = 'promo' THEN 'match_tag'
 WHEN lower(p_name) IN ('cold plate', 'blue ring') THEN 'merchant_exact' WHEN contains(p_name, 'gizmo') THEN 'merchant_fuzzy'
 WHEN contains(p_name, 'rod') THEN 'keywords' WHEN contains(p_name, 'small') THEN 'keywords' ELSE 'fallback' END"""
WITH_CATEGORIES = f"""WITH st AS (SELECT p_partkey, p_name, p_type, {STAGE_CASE} AS match_stage FROM part), cat AS (SELECT *,
 CASE match_stage WHEN 'match' THEN 'Widgets' WHEN 'match_regex' THEN 'Heat' WHEN 'match_tag' THEN 'Promoted' WHEN 'merchant_exact' THEN 'Plates'
  WHEN 'merchant_fuzzy' THEN 'Gizmos' WHEN 'keywords' THEN CASE WHEN contains(p_name, 'rod') THEN 'Rods' ELSE 'Small' END ELSE 'Uncategorized' END AS category,
 CASE match_stage WHEN 'match' THEN 'Red' WHEN 'match_regex' THEN 'General' WHEN 'match_tag' THEN 'Tagged' WHEN 'merchant_exact' THEN 'Cold' WHEN 'fallback' THEN 'General' ELSE 'All' END AS subcategory,
 array_to_string(list_sort(list_distinct(list_concat([p_type], CASE match_stage WHEN 'match' THEN ['red', 'Widget'] WHEN 'match_regex' THEN ['hot'] WHEN 'merchant_exact' THEN ['cold']
  WHEN 'merchant_fuzzy' THEN ['gizmo'] WHEN 'fallback' THEN ['Uncategorized'] ELSE []::VARCHAR[] END))), ',') AS tags FROM st) """


def _parts(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.col("p_name").alias("payee"), F.array("p_type").alias("tags"))


@query("j3_categorize", WITH_CATEGORIES + "SELECT p_partkey, category, subcategory, tags, match_stage FROM cat")
def _(spark, sf):
    out = classify.categorize(_parts(spark, sf), RULES)
    return out.select("p_partkey", "category", "subcategory", F.concat_ws(",", "tags").alias("tags"), "match_stage")


@query("g29_category_statistics", WITH_CATEGORIES + """SELECT category, subcategory, count(*) AS count, count(*) FILTER (category = 'Uncategorized' OR uncat = 1) AS uncategorized_count,
 round(100.0 * count(*) FILTER (category = 'Uncategorized' OR uncat = 1) / count(*), 5) AS uncategorized_pct FROM (SELECT *, (category = 'Uncategorized')::INT AS uncat FROM cat) GROUP BY ROLLUP (category, subcategory)""")
def _(spark, sf):
    return rounded(classify.category_statistics(classify.categorize(_parts(spark, sf), RULES)), 5)


@query("c1_match_exact", "SELECT p_partkey, CASE WHEN lower(p_name) = 'red widget' THEN 0 END::BIGINT AS rule_idx, CASE WHEN lower(p_name) IN ('cold plate', 'blue ring') THEN 0 END::BIGINT AS old_idx FROM part")
def _(spark, sf):
    out = classify.match_exact(_parts(spark, sf), "payee", NEW)
    return longs(classify.match_exact(out, "payee", OLD, "merchant_exact", 0, "old_idx").select("p_partkey", "rule_idx", "old_idx"))


@query("c2_match_regex", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^HOT .*', 'i') THEN 2 END::BIGINT AS rule_idx FROM part")
def _(spark, sf):
    return longs(classify.match_regex(_parts(spark, sf), "payee", NEW).select("p_partkey", "rule_idx"))


@query("c3_match_tag", "SELECT p_partkey, CASE WHEN lower(p_type) = 'promo' THEN 4 END::BIGINT AS rule_idx FROM part")
def _(spark, sf):
    return longs(classify.match_tag(_parts(spark, sf), "tags", NEW).select("p_partkey", "rule_idx"))


@query("c4_match_fuzzy", "SELECT p_partkey, CASE WHEN contains(p_name, 'gizmo') THEN 1 END::BIGINT AS rule_idx, CASE WHEN contains(p_name, 'gizmo') THEN 100.0 END::DOUBLE AS rule_idx_score FROM part")
def _(spark, sf):
    return longs(classify.match_fuzzy(_parts(spark, sf), "payee", OLD).select("p_partkey", "rule_idx", "rule_idx_score"))


@query("c5_match_keywords", "SELECT p_partkey, CASE WHEN contains(p_name, 'rod') THEN 2 WHEN contains(p_name, 'small') THEN 3 END::BIGINT AS rule_idx FROM part")
def _(spark, sf):
    return longs(classify.match_keywords(_parts(spark, sf), "payee", OLD).select("p_partkey", "rule_idx"))


@query("c6_merge_tags", "SELECT p_partkey, array_to_string(list_sort(list_distinct([p_type, 'b', 'a'])), ',') AS tags FROM part")
def _(spark, sf):
    merged = classify.merge_tags(F.col("tags"), F.array(F.lit("b"), F.lit("a"), F.lit("b")))
    return _parts(spark, sf).select("p_partkey", F.concat_ws(",", merged).alias("tags"))


# --- learned categories -----------------------------------------------------------------------

_MODELS: dict[tuple[str, str], tuple] = {}


def _labelled(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("payee"), F.col("lang").alias("category"))


def _trained(spark, sf):
    """One fit per session and table, for the queries that use the model."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = ml.train_classifier(_labelled(spark, sf), ["text", "payee"], iterations=20)
    return _MODELS[key]


@query("j4_merge_corrections", """SELECT coalesce(d.doc_id, c.id) AS id, coalesce(c.category, d.lang) AS category, CASE WHEN d.doc_id IS NULL THEN 'correction' ELSE 'parsed' END AS label_source
 FROM documents d FULL JOIN (SELECT CASE WHEN doc_id % 10 = 0 THEN doc_id + 1000000 ELSE doc_id END AS id, CASE WHEN quality = 1 THEN 'good' END AS category FROM labels) c ON d.doc_id = c.id""")
def _(spark, sf):
    parsed = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"))
    corrections = read(spark, sf, "labels").select(
        F.when(F.col("doc_id") % 10 == 0, F.col("doc_id") + 1000000).otherwise(F.col("doc_id")).alias("id"), F.when(F.col("quality") == 1, "good").alias("category")
    )
    return ml.merge_corrections(parsed, corrections).select("id", "category", "label_source")


@query("c10_train_classifier", "SELECT count(*)::DOUBLE AS samples, count(DISTINCT lang)::DOUBLE AS labels FROM documents WHERE lang IS NOT NULL")
def _(spark, sf):
    _, stats = _trained(spark, sf)
    counted = _labelled(spark, sf).agg(F.count("*").alias("_n"))
    return counted.select(F.lit(stats["samples"]).alias("samples"), F.lit(stats["labels"]).alias("labels"))


@query("c11_predict_category")
def _(spark, sf):
    model, _ = _trained(spark, sf)
    out = ml.predict_category(model, _labelled(spark, sf), ["text", "payee"])
    return rounded(out.select("doc_id", "category", "predicted_category", "predicted_probability", "predicted_confidence"), 4)


@query("c12_misclassified")
def _(spark, sf):
    model, _ = _trained(spark, sf)
    out = ml.misclassified(model, _labelled(spark, sf), ["text", "payee"])
    return rounded(out.select("doc_id", "category", "predicted_category", "predicted_probability", "predicted_confidence"), 4)


@query("c13_retrain", """SELECT count(*)::DOUBLE AS samples, count(DISTINCT cat)::DOUBLE AS labels FROM (
 SELECT CASE WHEN l.toxic = 1 THEN 'toxic' ELSE d.lang END AS cat FROM documents d LEFT JOIN labels l USING (doc_id))""")
def _(spark, sf):
    parsed = _labelled(spark, sf).withColumnRenamed("doc_id", "id")
    corrections = read(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("toxic").alias("category"))
    stats = ml.retrain(parsed, corrections, scratch(spark), ["text", "payee"])
    counted = parsed.agg(F.count("*").alias("_n"))
    return counted.select(F.lit(stats["samples"]).alias("samples"), F.lit(stats["labels"]).alias("labels"))
