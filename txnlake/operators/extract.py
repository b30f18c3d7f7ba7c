"""From message text to ledger rows, in one narrow stage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlake.functions import text
from txnlake.functions.fixed_values import (
    CARD_SUFFIX_PATTERNS,
    CURRENCIES,
    FIELD_DATE_FORMATS,
    MESSAGE_DATE_FORMATS,
    RECORD_DATE_FORMATS,
)
from txnlake.functions.rules import java_pattern, needed_words
from txnlake.functions.templates import STOCK_TEMPLATES

FIELDS = ("amount", "currency", "date", "payee", "transaction_type", "card_suffix")


def sanitize_messages(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, text.sanitized(F.col(column)))


def dedup_messages(df: DataFrame, column: str = "text", order: Sequence[str] = ("file_path", "line")) -> DataFrame:
    """Non-empty messages, each text once, at its first place in file order."""
    present = df.filter(F.col(column).isNotNull() & (F.col(column) != ""))
    rank = F.row_number().over(Window.partitionBy(column).orderBy(*order))
    return present.withColumn("_rn", rank).filter("_rn = 1").drop("_rn")


def limit_messages(df: DataFrame, n: int | None, order: Sequence[str] = ("file_path", "line")) -> DataFrame:
    """The first ``n`` messages in file order; no limit for NULL or 0."""
    return df.orderBy(*order).limit(n) if n else df


def repair_text(df: DataFrame, column: str = "text") -> DataFrame:
    """Undo UTF-8 read as Latin-1; ``text_repaired`` tells where the text changed."""
    fixed = text.repaired(F.col(column))
    return df.withColumns({column: fixed, "text_repaired": F.coalesce(fixed != F.col(column), F.lit(False))})


def _found(message: Column, pattern: str, group: int) -> Column:
    """The group's text; empty where the pattern does not match."""
    return F.regexp_extract(message, java_pattern(pattern), group)


def _groups(spec: tuple) -> list[int]:
    return [spec[1]] if isinstance(spec[1], int) else list(spec[1])


def _cleaned(found: Sequence[Column]) -> Column:
    value = F.coalesce(*[F.nullif(f, F.lit("")) for f in found])
    return text.western_digits(text.stripped(value))


def extract_fields(message: Column, template: dict) -> dict[str, Column]:
    """One column per field of the template; NULL where its pattern does not match."""
    return {f: _cleaned([_found(message, spec[0], g) for g in _groups(spec)]) for f, spec in template["fields"].items()}


def card_suffix(message: Column, patterns: Sequence[str] = CARD_SUFFIX_PATTERNS) -> Column:
    """The last four digits of the card, by the first pattern that matches."""
    digits = text.western_digits(message)
    return F.coalesce(*[F.nullif(_found(digits, p, 1), F.lit("")) for p in patterns])


def extract_card_suffix(df: DataFrame, column: str = "text", out: str = "card_suffix") -> DataFrame:
    return df.withColumn(out, card_suffix(F.col(column)))


def _present(columns: Sequence[Column]) -> Column:
    return sum((c.isNotNull().cast("int") for c in columns), F.lit(0))


def template_confidence(fields: dict[str, Column], required: Sequence[str]) -> Column:
    """low without a required field; high with all fields but one, medium with half, else low."""
    missing = F.lit(False)
    for name in required:
        missing = missing | (fields[name].isNull() if name in fields else F.lit(True))
    found, n = _present(list(fields.values())), len(fields)
    return F.when(missing, "low").when(found >= n - 1, "high").when(found >= n // 2, "medium").otherwise("low")


def parse_messages(
    df: DataFrame, column: str = "text", templates: Sequence[dict] = STOCK_TEMPLATES, bank: str | None = None,
    template_name: str | None = None, find_card: bool = True, names: Sequence[str] | None = None,
) -> DataFrame:
    """Adds the fields of the best template, its bank and name, and a confidence.

    The template with the most fields wins; among equals the last one of high confidence, else
    the first. ``bank`` names a column with the bank of each message, where known.
    """
    message = text.stripped(F.col(column))
    names = list(names or dict.fromkeys([*FIELDS, *[f for t in templates for f in t["fields"]]]))
    chosen = [t for t in templates if template_name is None or t["name"] == template_name]
    prepared = df.withColumn("_message", message)
    # Every distinct pattern runs once, into a column of its own, and only on messages that can
    # match: that hold one of the words it needs. Cleaning the found text is a second step, so that nothing is looked for twice.
    specs = [(t.get("needs"), *spec) for t in chosen for spec in t["fields"].values()]
    slots = {str(s): (f"_f{i}", s) for i, s in enumerate({str(s): s for s in specs}.values())}
    tests = {need: f"_n{i}" for i, need in enumerate(sorted({s[0] for s in specs if s[0]}))}
    patterns = dict.fromkeys([*[s[1] for s in specs], *(CARD_SUFFIX_PATTERNS if find_card else [])])
    needed = {p: needed_words(p) for p in patterns}
    words = {w: f"_w{i}" for i, w in enumerate(dict.fromkeys(w for ws in needed.values() for w in ws or []))}
    raw, clean = {}, {}

    def where_it_can(pattern: str, found: Column) -> Column:
        if needed[pattern] is None:
            return found
        return F.when(reduce(lambda a, b: a | b, [F.col(words[w]) for w in needed[pattern]]), found)

    for name, (need, *spec) in slots.values():
        numbers = _groups(spec)
        for g in numbers:
            found = where_it_can(spec[0], _found(F.col("_message"), spec[0], g))
            raw[f"{name}_{g}"] = F.when(F.col(tests[need]), found) if need else found
        clean[name] = _cleaned([F.col(f"{name}_{g}") for g in numbers])
    if find_card:
        prepared = prepared.withColumn("_digits", text.western_digits(F.col("_message")))
        raw.update({f"_c{i}": where_it_can(p, _found(F.col("_digits"), p, 1)) for i, p in enumerate(CARD_SUFFIX_PATTERNS)})
        clean["_card"] = F.coalesce(*[F.nullif(F.col(f"_c{i}"), F.lit("")) for i in range(len(CARD_SUFFIX_PATTERNS))])
    else:
        clean["_card"] = F.lit(None).cast("string")
    prepared = prepared.withColumn("_folded", text.folded(F.col("_message")))
    able = {c: F.col("_message").rlike(need) for need, c in tests.items()}
    able |= {c: F.contains("_folded", F.lit(w)) for w, c in words.items()}
    tested = prepared.withColumns(able) if able else prepared
    prepared = tested.withColumns(raw).withColumns(clean).drop(*raw, *able, "_digits", "_folded")
    options = []
    for template in chosen:
        found = {f: F.col(slots[str((template.get("needs"), *spec))][0]) for f, spec in template["fields"].items()}
        own_card = "card_suffix" in found
        if find_card:
            found["card_suffix"] = F.coalesce(found["card_suffix"], F.col("_card")) if own_card else F.col("_card")
        confidence = template_confidence(found, template["required"])
        if find_card and not own_card:
            # Without a pattern of its own the card counts as a field only when it was found.
            plain = template_confidence({k: v for k, v in found.items() if k != "card_suffix"}, template["required"])
            confidence = F.when(F.col("_card").isNull(), plain).otherwise(confidence)
        option = F.struct(
            _present(list(found.values())).alias("score"),
            confidence.alias("confidence"),
            *[found.get(n, F.lit(None).cast("string")).alias(n) for n in names],
            F.lit(template["bank"]).alias("matched_bank"),
            F.lit(template["name"]).alias("matched_template"),
        )
        wanted = F.lit(True) if bank is None else (F.col(bank).isNull() | (F.col(bank) == template["bank"]))
        options.append(F.when(wanted, option))

    def rank(option: Column, place: Column) -> Column:
        high = option["confidence"] == "high"
        return F.struct(
            option["score"].alias("score"), high.alias("high"), F.when(high, place).otherwise(-place).alias("place"),
            option.alias("option"),
        )

    ranked = F.filter(F.transform(F.array(*options), rank), lambda r: r["score"].isNotNull())
    best = prepared.withColumn("_best", F.array_max(ranked)["option"])
    good = F.coalesce(F.col("_best.score") > 0, F.lit(False)) & (F.col("_message") != "")
    missed = F.lit("unknown")
    if bank is not None:
        banks = sorted({t["bank"] for t in chosen})
        missed = F.when(F.col(bank).isNull(), missed).when(F.col(bank).isin(banks), F.col(bank))
    return best.select(
        *df.columns,
        *[F.when(good, F.col(f"_best.{n}")).alias(n) for n in names],
        F.when(good, F.col("_best.confidence")).otherwise("low").alias("confidence"),
        F.when(good, F.col("_best.matched_bank")).when(F.col("_message") != "", missed).alias("matched_bank"),
        F.when(good, F.col("_best.matched_template")).alias("matched_template"),
        F.nullif(F.col("_message"), F.lit("")).alias("sms_text"),
    )


def resolve_dates(
    df: DataFrame, raw: str = "date", seen_at: str = "file_mtime", out: str = "resolved_date", ingested_at: Column | None = None
) -> DataFrame:
    """ISO date of the message; day and month alone take the year of the file, else of the ingestion (default: now)."""
    year = F.coalesce(F.year(F.col(seen_at)), F.year(F.current_timestamp() if ingested_at is None else ingested_at))
    value = F.col(raw)
    full = text.parse_timestamp(value, MESSAGE_DATE_FORMATS)
    short = F.when(
        value.rlike(r"^\d{1,2}[/-]\d{1,2}$"),
        F.concat(F.replace(value, F.lit("-"), F.lit("/")), F.lit("/"), year.cast("string")),
    )
    resolved = F.coalesce(full, F.try_to_timestamp(short, F.lit("d/M/yyyy")))
    return df.withColumns({out: F.date_format(resolved, "yyyy-MM-dd"), "extracted_date_raw": value})


def year_inference_audit(df: DataFrame, resolved: str = "resolved_date", seen_at: str = "file_mtime") -> DataFrame:
    """Flags dates more than a year away from the year of the file."""
    gap = F.abs(F.year(F.to_date(F.col(resolved))) - F.year(F.col(seen_at)))
    return df.withColumn("year_suspect", F.coalesce(gap > 1, F.lit(False)))


def validate_fields(df: DataFrame, currencies: Sequence[str] = CURRENCIES) -> DataFrame:
    """Clean the fields and list what is wrong with them in ``warnings``; sets ``confidence``.

    Commas in amounts are thousands marks: '100,50' reads 10050.
    """
    amount, bare = text.blank_to_null(F.col("amount")), text.decimal_text(F.col("amount"))
    number = bare.try_cast("decimal(38,10)")
    currency = F.upper(text.blank_to_null(F.col("currency")))
    when, suffix = text.blank_to_null(F.col("date")), text.blank_to_null(F.col("card_suffix"))
    cleaned = df.withColumns(
        {
            "amount": F.when(number.isNotNull(), bare).otherwise(F.when(bare.isNotNull(), amount)),
            "_number": number, "currency": currency, "date": when, "card_suffix": suffix,
            "payee": text.blank_to_null(F.col("payee")),
        }
    )
    said = lambda label, name: F.concat(F.lit(label), F.col(name))
    parsed = text.parse_timestamp(F.col("date"), FIELD_DATE_FORMATS)
    checks = [
        F.when(F.col("amount").isNull(), "Missing required field: amount")
        .when(F.col("_number").isNull(), said("Invalid numeric format for amount: ", "amount"))
        .when(F.col("_number") <= 0, "Amount must be positive"),
        F.when(F.col("currency").isNull(), "Missing currency field")
        .when(~F.col("currency").isin(list(currencies)), said("Invalid currency code: ", "currency")),
        F.when(F.col("date").isNotNull() & parsed.isNull(), said("Malformed date: ", "date")),
        F.when(~F.col("card_suffix").rlike(r"^\d{4}$"), said("Invalid card suffix (must be 4 digits): ", "card_suffix")),
    ]
    warned = cleaned.withColumn("warnings", F.array_compact(F.array(*checks)))
    before = F.coalesce(F.col("confidence"), F.lit("low")) if "confidence" in df.columns else F.lit("low")
    return warned.withColumn("confidence", validation_confidence(before)).drop("_number")


def validation_confidence(before: Column) -> Column:
    """low for a missing or non-numeric amount or two warnings, medium for one, high when complete."""
    critical = F.exists("warnings", lambda w: w.startswith("Missing required field") | w.startswith("Invalid numeric format"))
    complete = F.col("amount").isNotNull() & F.col("currency").isNotNull() & F.col("date").isNotNull()
    known = F.lower(F.trim(before))
    return (
        F.when(critical | (F.size("warnings") >= 2), "low")
        .when(F.size("warnings") == 1, "medium")
        .when(complete, "high")
        .otherwise(F.when(known.isin("high", "medium", "low"), known).otherwise("low"))
    )


def lookup_accounts(df: DataFrame, accounts: DataFrame, suffix: str = "card_suffix") -> DataFrame:
    """Left lookup of account data by card suffix; an unknown card gets a stand-in account.

    The account list is reduced to the four-digit suffixes, which bounds it at 10,000 rows, and
    is then broadcast. Of several accounts with a suffix the one of the smallest row, by account_id first, counts.
    """
    wanted = ("account_id", "account_type", "interest_rate", "credit_limit", "billing_cycle", "label")
    side = (
        accounts.filter(F.col("card_suffix").rlike(r"^\d{4}$"))
        .groupBy(F.col("card_suffix").alias("_suffix"))
        .agg(F.min(F.struct(*[c for c in wanted if c in accounts.columns])).alias("_account"))
        .select("_suffix", F.lit(True).alias("is_known"), "_account.*")
    )
    key = F.nullif(F.col(suffix), F.lit(""))
    joined = df.join(F.broadcast(side), key == F.col("_suffix"), "left")
    stand_in = F.when(key.isNull(), "unknown").otherwise(F.concat(F.lit("unknown_"), key))
    label = F.when(key.isNull(), "Invalid suffix").otherwise("Unknown card")
    filled = {
        "account_id": F.coalesce("account_id", stand_in),
        "account_type": F.coalesce("account_type", F.lit("Unknown")),
        "is_known": F.coalesce("is_known", F.lit(False)),
    }
    if "label" in accounts.columns:
        filled["label"] = F.when(F.col("is_known"), F.col("label")).otherwise(label)
    return joined.withColumns(filled).drop("_suffix")


def urgency(amount: Column, account_type: Column) -> Column:
    return F.when(amount >= 10000, "high").when((account_type == "Credit") & (amount >= 5000), "medium").otherwise("normal")


def normalize_records(df: DataFrame, compose: bool = True) -> DataFrame:
    """Validated messages (with account data) as ledger records.

    ``compose=False`` leaves out Unicode composition, the only step that needs Python.
    """
    bare = text.decimal_text(F.col("amount"))
    amount = bare.try_cast("decimal(38,10)").cast("double")
    best_date = F.coalesce("resolved_date", "date")
    day = F.date_format(text.parse_timestamp(text.stripped(best_date), RECORD_DATE_FORMATS), "yyyy-MM-dd")
    payee = text.normal_text(F.col("payee"), compose)
    has_card = F.col("card_suffix").isNotNull()
    kind = F.when(has_card, F.col("account_type"))
    tags = F.array_compact(
        F.array(F.col("transaction_type"), F.col("matched_bank"), F.when(F.size("warnings") > 0, "has-warnings"))
    )
    return df.withColumns(
        {
            "amount": amount, "date": day, "resolved_date": day,
            "currency": text.normal_text(F.col("currency"), compose), "payee": payee, "normalized_merchant": payee,
            "category": F.lit("Uncategorized"), "subcategory": F.lit("General"), "tags": tags,
            "account_id": F.when(has_card, F.col("account_id")), "account_type": kind,
            "interest_rate": F.when(has_card, F.col("interest_rate")), "urgency": urgency(amount, kind),
            "transaction_state": F.upper(F.coalesce("transaction_state", F.lit("UNKNOWN"))),
        }
    )
