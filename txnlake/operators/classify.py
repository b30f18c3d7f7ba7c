"""Rule-based classification: merchants, categories, promotions, banks, message states.

Rule lists are small tables. Equality rules are joins whose strategy the optimizer picks from
the list's known size; pattern rules are column expressions in rule order. Fuzzy rules run on
distinct names only, and only on those no cheaper rule settled. Lists of fuzzy rules are sent along
with the scoring function; rules in a DataFrame may be many, and are joined by `plans.fuzzy_join`.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlake.functions import text
from txnlake.functions.fixed_values import (
    BANK_PATTERNS,
    DECLINED_PATTERN,
    OTP_PATTERN,
    PROMO_ARABIC,
    PROMO_LATIN,
)
from txnlake.functions.rules import category_rules, first_match, java_pattern, literal, local_table, valid_pattern
from txnlake.functions.similarity import best_group_udf, best_name_udf, best_ratio_udf, name_score, partial_ratio
from txnlake.plans import fuzzy_join
from txnlake.plans.groups import durable


# --- merchants ----------------------------------------------------------------------------------


def _checked(threshold: float) -> float:
    if not 0 < threshold <= 100:
        raise ValueError(f"a threshold is above 0 and at most 100, not {threshold}")
    return float(threshold)


def _placed(table: DataFrame, key: Column, value: str) -> DataFrame:
    """One row for each key, the empty one left out: right, _value (of the last place), _place (the first one).

    Without a ``place`` the text itself gives the order, and the greatest value counts.
    """
    place = F.col("place") if "place" in table.columns else key
    last = F.struct(place.alias("p"), F.col(value).alias("v"))
    return table.filter(key != "").groupBy(key.alias("right")).agg(F.max(last)["v"].alias("_value"), F.min(place).alias("_place"))


def _nearest(scored: DataFrame, table: DataFrame) -> DataFrame:
    """The best scored row of each ``left``, the first place at ties: left, _value, score."""
    best = F.min_by(F.struct("_value", "score"), F.struct(-F.col("score"), F.col("_place")))
    return scored.join(table, "right").groupBy("left").agg(best.alias("_b")).select("left", "_b._value", "_b.score")


def _resolved_names(names: DataFrame, aliases: DataFrame, threshold: float) -> DataFrame:
    """_name, _canonical, match_score of the ``names`` (column left) that an alias equals or resembles."""
    table = durable(_placed(aliases, F.lower("alias"), "canonical"))
    names = durable(names)
    exact = names.join(table, names["left"] == table["right"]).select("left", "_value", F.lit(100.0).alias("score"))
    missing = names.join(table.select(F.col("right").alias("left")), "left", "left_anti")
    near = _nearest(fuzzy_join.similar_names(missing, table.select("right"), threshold), table)
    return exact.union(near).toDF("_name", "_canonical", "match_score")


def resolve_merchants(
    df: DataFrame, payee: str, aliases: Sequence[tuple[str, str]] | DataFrame, threshold: float = 85.0
) -> DataFrame:
    """Adds ``canonical`` and ``match_score``: 100 for an alias, else the closest alias above the threshold.

    ``aliases`` are (alias, canonical) pairs; the first alias wins ties, an unmatched payee stands
    for itself without a score. Scoring runs once per distinct name; the scored names join back
    without a hint, so their measured size decides between broadcast and shuffle.

    A DataFrame of aliases (alias, canonical, and place, which gives their order) may have any size: only names that
    share a rare key with an alias are compared with it. Of equal aliases the last canonical name counts.
    """
    if isinstance(aliases, DataFrame):
        keyed = df.withColumn("_key", text.merchant_key(F.col(payee)))
        names = keyed.select(F.col("_key").alias("left")).filter("left is not null").distinct()
        return _with_canonical(keyed, payee, _resolved_names(names, aliases, _checked(threshold)))
    pairs = dict((a.lower(), c) for a, c in aliases)
    listed = list(pairs)
    spark = df.sparkSession
    known = local_table(
        spark, [{"_alias": a, "_exact": pairs[a]} for a in listed], "_alias string, _exact string"
    )
    by_place = local_table(
        spark, [{"_place": i, "_near": pairs[a]} for i, a in enumerate(listed)], "_place int, _near string"
    )
    keyed = df.withColumn("_key", text.merchant_key(F.col(payee)))
    names = keyed.select("_key").filter("_key is not null").distinct()
    exact = names.join(known, names["_key"] == known["_alias"], "left").drop("_alias")
    score = best_ratio_udf(listed, threshold)
    scored = exact.withColumn("_fuzzy", score(F.when(F.col("_exact").isNull(), F.col("_key"))))
    resolved = scored.join(by_place, scored["_fuzzy.idx"] == by_place["_place"], "left").select(
        F.col("_key").alias("_name"), F.coalesce("_exact", "_near").alias("_canonical"),
        F.when(F.col("_exact").isNotNull(), F.lit(100.0)).otherwise(F.col("_fuzzy.score")).alias("match_score"),
    )
    return _with_canonical(keyed, payee, resolved)


def _with_canonical(keyed: DataFrame, payee: str, resolved: DataFrame) -> DataFrame:
    joined = keyed.join(resolved, keyed["_key"] == resolved["_name"], "left")
    unmatched = F.when(F.col("_key").isNull() & F.col(payee).isNotNull(), "").otherwise(F.col(payee))
    return joined.withColumn("canonical", F.coalesce("_canonical", unmatched)).drop("_key", "_name", "_canonical")


def resolution_statistics(df: DataFrame, value: str) -> DataFrame:
    """Rows, spending, mean and mean score per canonical merchant, and the unmatched part of the spending."""
    return df.groupBy("canonical").agg(
        F.count("*").alias("transaction_count"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total_amount"),
        F.avg(value).alias("avg_amount"), F.avg("match_score").alias("avg_score"),
        F.coalesce(F.sum(F.when(F.col("match_score").isNull(), F.col(value))), F.lit(0.0)).alias("unmatched_amount"),
    )


# --- pattern rules ------------------------------------------------------------------------------


def match_any_pattern(df: DataFrame, column: str, patterns: Sequence[tuple[str, str]], out: str = "rule") -> DataFrame:
    """Adds the name of the first (name, pattern) rule that matches, without regard to case."""
    usable = [(n, p) for n, p in patterns if valid_pattern(p)]
    hit = [F.when(F.col(column).rlike(java_pattern(p)), F.lit(n)) for n, p in usable]
    return df.withColumn(out, F.coalesce(*hit) if hit else F.lit(None).cast("string"))


def identify_bank(
    df: DataFrame, column: str = "text", patterns: Mapping[str, Sequence[str]] = BANK_PATTERNS,
    fuzzy: bool = True, threshold: float = 80.0,
) -> DataFrame:
    """Adds ``bank_id`` and ``bank_score``: the first bank with a pattern in the text, else the closest one.

    For fuzzy names in a table of any size see `nearest_bank`.
    """
    message = text.stripped(F.col(column))
    banks = list(patterns)
    hits = []
    for bank in banks:
        literals = [(p, literal(p)) for p in patterns[bank]]
        good = [p for p, same in literals if same is None and valid_pattern(p)]
        plain = [p for p, same in literals if same is None and p not in good]
        # Plain text is looked up in the folded message, which a pattern without regard to case goes through far slower.
        found = F.lit(False)
        for _, same in literals:
            found = found if same is None else found | F.contains("_folded", F.lit(same))
        if good:
            found = found | F.col("_message").rlike(java_pattern("(?:" + "|".join(good) + ")"))
        for p in plain:
            found = found | F.contains(F.lower("_message"), F.lit(p.lower()))
        hits.append(F.when(found, F.lit(bank)))
    staged = df.withColumn("_message", message).withColumn("_folded", text.folded(F.col("_message")))
    staged = staged.withColumn("_exact", F.coalesce(*hits)).drop("_folded")
    missed = F.when(F.col("_exact").isNull() & (F.col("_message") != ""), F.col("_message"))
    if fuzzy:
        staged = staged.withColumn("_fuzzy", best_group_udf([patterns[b] for b in banks], threshold)(missed))
        near = F.try_element_at(F.array(*[F.lit(b) for b in banks]), F.col("_fuzzy.idx") + 1)
        near_score = F.col("_fuzzy.score")
    else:
        near, near_score = F.lit(None).cast("string"), F.lit(None).cast("double")
    return staged.withColumns(
        {
            "bank_id": F.coalesce("_exact", near, F.lit("unknown_bank")),
            "bank_score": F.when(F.col("_exact").isNotNull(), F.lit(100.0)).otherwise(F.coalesce(near_score, F.lit(0.0))),
        }
    ).drop("_message", "_exact", "_fuzzy")


#: Names that are sent along with the scoring; a longer table is joined by keys.
LISTED_NAMES = 500


def nearest_bank(df: DataFrame, column: str, names: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Adds ``bank_id`` and ``bank_score`` by a table of names (bank, name, place) that a text may hold with slips.

    A bank scores by its first name, by place, that reaches the threshold against a stretch of the text; the best bank
    wins, at ties the one with the first place. Without one: 'unknown_bank' and 0. Empty names match nothing.

    Few short names are sent along with the scoring, which goes through each text once for each; the keys of a long text
    are those of almost all names, so a join by keys pays only for more of them.
    """
    threshold = _checked(threshold)
    table = durable(names.select(F.lower("name").alias("right"), "bank", "place").filter("right <> ''"))
    messages = df.withColumn("_message", F.nullif(F.lower(text.stripped(F.col(column))), F.lit("")))
    few = table.orderBy("place").limit(LISTED_NAMES + 1).collect()
    if len(few) <= LISTED_NAMES and all(len(r["right"]) <= 64 for r in few):
        listed: dict[str, list[str]] = {}
        for r in few:
            if r["bank"] is not None:
                listed.setdefault(r["bank"], []).append(r["right"])
        near = messages.withColumn("_near", best_group_udf(list(listed.values()), threshold)("_message"))
        bank = F.try_element_at(F.array(*[F.lit(b) for b in listed]).cast("array<string>"), F.col("_near.idx") + 1)
        return near.withColumns({
            "bank_id": F.coalesce(bank, F.lit("unknown_bank")), "bank_score": F.coalesce("_near.score", F.lit(0.0)),
        }).drop("_message", "_near")
    left = durable(messages.select(F.col("_message").alias("left")).filter("left is not null").distinct())

    def score(a: list[str], b: list[str]) -> list[float]:
        return [partial_ratio(y, x) for x, y in zip(a, b, strict=True)]

    pairs = fuzzy_join.partial_candidates(left, table.select("right").distinct(), threshold)
    found = fuzzy_join.scored(pairs, score, threshold).join(table, "right")
    of_bank = found.groupBy("left", "bank").agg(F.min_by("score", "place").alias("score"))
    order = table.groupBy("bank").agg(F.min("place").alias("_first"))
    best = of_bank.join(order, "bank").groupBy("left").agg(F.min_by(F.struct("bank", "score"), F.struct(-F.col("score"), F.col("_first"))).alias("_b"))
    joined = messages.join(best, messages["_message"] == best["left"], "left")
    return joined.withColumns({
        "bank_id": F.coalesce("_b.bank", F.lit("unknown_bank")), "bank_score": F.coalesce("_b.score", F.lit(0.0)),
    }).drop("_message", "left", "_b")


def bank_statistics(df: DataFrame) -> DataFrame:
    """Messages per bank."""
    return df.groupBy("bank_id").agg(F.count("*").alias("count"))


def _whole_word(keyword: str) -> str:
    return rf"\b{re.escape(keyword.lower())}\b"


def is_promotional(message: Column, latin: Sequence[str] = PROMO_LATIN, arabic: Sequence[str] = PROMO_ARABIC) -> Column:
    """Whether any keyword is in the text, as one pattern per script."""
    found = F.lit(False)
    if latin:
        found = found | F.lower(message).rlike("(?U)(?:" + "|".join(_whole_word(k) for k in latin) + ")")
    if arabic:
        found = found | message.rlike("|".join(re.escape(k) for k in arabic))
    return found


def with_keywords(
    df: DataFrame, column: str, latin: Sequence[str] = PROMO_LATIN, arabic: Sequence[str] = PROMO_ARABIC,
    out: str = "matched_keywords",
) -> DataFrame:
    """Adds the sorted keywords in the text: Latin ones as whole words in any case, Arabic ones anywhere.

    The lower-case text is a column first, so that it is made once, not once per keyword.
    """
    staged = df.withColumn("_lower", F.lower(F.col(column)))
    hits = [
        F.when(F.contains("_lower", F.lit(k.lower())) & F.col("_lower").rlike(f"(?U){_whole_word(k)}"), F.lit(k)) for k in latin
    ]
    hits += [F.when(F.contains(F.col(column), F.lit(k)), F.lit(k)) for k in arabic]
    return staged.withColumn(out, F.array_sort(F.array_compact(F.array(*hits)))).drop("_lower")


def classify_promo(
    df: DataFrame, column: str = "text", latin: Sequence[str] = PROMO_LATIN, arabic: Sequence[str] = PROMO_ARABIC
) -> DataFrame:
    """Adds ``skip``, ``matched_keywords``, ``promo_confidence`` and ``reason``."""
    message = F.coalesce(text.stripped(F.col(column)), F.lit(""))
    staged = with_keywords(df.withColumn("_message", message), "_message", latin, arabic)
    n = F.size("matched_keywords")
    shown = F.concat_ws(", ", F.slice("matched_keywords", 1, 3))
    more = F.when(n > 3, F.concat(F.lit(" (and "), (n - 3).cast("string"), F.lit(" more)"))).otherwise("")
    blank = F.col("_message") == ""
    return staged.withColumns(
        {
            "skip": n > 0,
            "promo_confidence": F.when(blank, "low").when((n == 0) | (n >= 3), "high").when(n == 2, "medium").otherwise("low"),
            "reason": F.when(blank, "Invalid input").when(n == 0, "No promotional keywords detected")
            .otherwise(F.concat(F.lit("Promotional message detected (keywords: "), shown, more, F.lit(")"))),
        }
    ).drop("_message")


def promo_statistics(df: DataFrame) -> DataFrame:
    """Promotional and other messages; messages that pass on to, or are kept from, validation."""
    return df.agg(
        F.count("*").alias("total"), F.count_if("skip").alias("promotional"), F.count_if(~F.col("skip")).alias("other"),
        F.count_if((F.col("promo_confidence") == "high") & ~F.col("skip")).alias("passed"),
        F.count_if(F.col("reason") == "Invalid input").alias("invalid"),
    )


def classify_state(
    df: DataFrame, column: str = "text", amount: str = "amount", out: str = "transaction_state",
    latin: Sequence[str] = PROMO_LATIN, arabic: Sequence[str] = PROMO_ARABIC,
) -> DataFrame:
    """OTP, DECLINED, PROMO, UNKNOWN (no amount) or MONETARY: the first that holds."""
    message = F.coalesce(F.col(column), F.lit(""))
    promo = is_promotional(message, latin, arabic)
    return df.withColumn(
        out,
        F.when(message.rlike(java_pattern(OTP_PATTERN)), "OTP")
        .when(message.rlike(java_pattern(DECLINED_PATTERN)), "DECLINED")
        .when(promo, "PROMO")
        .when(F.coalesce(F.col(amount).cast("string"), F.lit("")) == "", "UNKNOWN")
        .otherwise("MONETARY"),
    )


# --- categories ---------------------------------------------------------------------------------

STAGES = ("match", "match_regex", "match_tag", "merchant_exact", "merchant_fuzzy", "keywords", "fallback")


def _split_rules(rules: Mapping) -> tuple[list[dict], list[dict]]:
    rules = category_rules(dict(rules))
    return list(rules.get("rules") or []), list(rules.get("categories") or [])


def _equal_rules(rules: Sequence[dict], field: str, offset: int = 0) -> dict[str, int]:
    """Lower-case name to the first rule that lists it."""
    found: dict[str, int] = {}
    for i, rule in enumerate(rules):
        names = rule.get(field) or []
        for name in [names] if isinstance(names, str) else names:
            found.setdefault(name.lower().strip(), i + offset)
    return found


def match_exact(df: DataFrame, merchant: str, rules: Sequence[dict], field: str = "match", offset: int = 0, out: str = "rule_idx") -> DataFrame:
    """Adds the first rule whose ``field`` equals the merchant, without regard to case and outer blanks."""
    equal = _equal_rules(rules, field, offset)
    if not equal:
        return df.withColumn(out, F.lit(None).cast("int"))
    side = local_table(df.sparkSession, [{"_eq": k, out: v} for k, v in equal.items()], f"_eq string, {out} int")
    return df.join(side, text.merchant_key(F.col(merchant)) == side["_eq"], "left").drop("_eq")


def match_regex(df: DataFrame, merchant: str, rules: Sequence[dict], out: str = "rule_idx") -> DataFrame:
    """Adds the first rule whose ``match_regex`` is found in the merchant; bad patterns are passed over."""
    choices = [
        (F.col(merchant).rlike(java_pattern(r["match_regex"])), i)
        for i, r in enumerate(rules) if r.get("match_regex") and valid_pattern(r["match_regex"])
    ]
    return df.withColumn(out, first_match(choices))


def match_tag(df: DataFrame, tags: str, rules: Sequence[dict], out: str = "rule_idx") -> DataFrame:
    """Adds the first rule whose ``match_tag`` is among the row's tags, without regard to case."""
    lowered = F.transform(F.col(tags), lambda t: F.lower(t))
    choices = [(F.array_contains(lowered, r["match_tag"].lower()), i) for i, r in enumerate(rules) if r.get("match_tag")]
    return df.withColumn(out, first_match(choices))


def _match_fuzzy_table(df: DataFrame, merchant: str, rules: DataFrame, threshold: float, unless: Column | None, offset: int, out: str) -> DataFrame:
    key = text.merchant_key(F.col(merchant))
    asked = df.withColumn("_asked", key if unless is None else F.when(unless, F.lit(None)).otherwise(key))
    left = durable(asked.select(F.col("_asked").alias("left")).filter("left is not null").distinct())
    pattern = F.lower(F.trim("pattern"))
    place = F.struct((F.col("place") if "place" in rules.columns else F.col("rule")).alias("at"), F.col("rule").alias("of"))
    table = durable(rules.filter(pattern != "").groupBy(pattern.alias("right")).agg(
        F.min_by("rule", place).alias("_value"), F.min(place).alias("_place")))
    right = table.select("right")
    pairs = fuzzy_join.token_candidates(left, right, threshold).union(fuzzy_join.partial_candidates(left, right, threshold)).distinct()

    def score(a: list[str], b: list[str]) -> list[float]:
        return [name_score(x, y) for x, y in zip(a, b, strict=True)]

    best = _nearest(fuzzy_join.scored(pairs, score, threshold), table).select(
        "left", (F.col("_value") + offset).cast("int").alias(out), F.col("score").alias(f"{out}_score"))
    return asked.join(best, asked["_asked"] == best["left"], "left").drop("_asked", "left")


def match_fuzzy(
    df: DataFrame, merchant: str, rules: Sequence[dict] | DataFrame, threshold: float = 80.0, unless: Column | None = None,
    offset: int = 0, out: str = "rule_idx",
) -> DataFrame:
    """Adds the rule with the closest ``merchant_fuzzy`` name and its score; rows meeting ``unless`` are left out.

    Rules in a DataFrame (rule, pattern, and place, which gives their order) may be any number: only names that share a
    word or a rare key with a pattern are compared with it. The first place wins ties; empty patterns match nothing.
    """
    if isinstance(rules, DataFrame):
        return _match_fuzzy_table(df, merchant, rules, _checked(threshold), unless, offset, out)
    patterns = [
        (i + offset, p.lower().strip()) for i, r in enumerate(rules) for p in r.get("merchant_fuzzy") or []
    ]
    if not patterns:
        return df.withColumns({out: F.lit(None).cast("int"), f"{out}_score": F.lit(None).cast("double")})
    key = text.merchant_key(F.col(merchant))
    asked = key if unless is None else F.when(unless, F.lit(None)).otherwise(key)
    scored = df.withColumn("_fuzzy", best_name_udf(patterns, threshold)(asked))
    return scored.withColumns({out: F.col("_fuzzy.idx"), f"{out}_score": F.col("_fuzzy.score")}).drop("_fuzzy")


def match_keywords(df: DataFrame, merchant: str, rules: Sequence[dict], offset: int = 0, out: str = "rule_idx") -> DataFrame:
    """Adds the first rule with a keyword in the merchant: Latin ones in any case, Arabic ones as written."""
    raw = F.col(merchant)
    lowered = F.lower(raw)
    choices = []
    for i, rule in enumerate(rules):
        words = rule.get("keywords") or {}
        tests = [F.contains(lowered, F.lit(w.lower())) for w in words.get("english") or []]
        tests += [F.contains(raw, F.lit(w)) for w in words.get("arabic") or []]
        if tests:
            held = tests[0]
            for t in tests[1:]:
                held = held | t
            choices.append((held, i + offset))
    return df.withColumn(out, first_match(choices))


def merge_tags(existing: Column, added: Column) -> Column:
    """Union of two tag lists, sorted."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(existing, empty), F.coalesce(added, empty)))


def categorize(
    df: DataFrame, rules: Mapping, merchant: str = "normalized_merchant", payee: str | None = "payee",
    tags: str | None = "tags", threshold: float = 80.0, fuzzy: DataFrame | None = None,
) -> DataFrame:
    """Adds category, subcategory, merged tags and the stage that decided.

    Stages in order: match, match_regex, match_tag, merchant_exact, merchant_fuzzy, keywords,
    fallback. Everything but the tags depends on the merchant alone and is worked out once per
    distinct name. ``fuzzy`` (rule, pattern, place) gives the fuzzy patterns as a table instead of the
    ``merchant_fuzzy`` lists; rule is a position in ``categories``.
    """
    new, old = _split_rules(rules)
    offset = len(new)
    present = [F.nullif(F.col(c), F.lit("")) for c in (merchant, payee) if c and c in df.columns]
    base = df.withColumn("_who", F.coalesce(*present))
    names = base.select("_who").filter("_who is not null").distinct()
    staged = match_exact(names, "_who", new, "match", 0, "_i0")
    staged = match_regex(staged, "_who", new, "_i1")
    staged = match_exact(staged, "_who", old, "merchant_exact", offset, "_i3")
    settled = F.coalesce("_i0", "_i1", "_i3").isNotNull()
    staged = match_fuzzy(staged, "_who", old if fuzzy is None else fuzzy, threshold, settled, offset, "_i4")
    staged = match_keywords(staged, "_who", old, offset, "_i5")
    staged = staged.withColumnRenamed("_who", "_name").drop("_i4_score")
    joined = base.join(staged, base["_who"] == staged["_name"], "left")
    tagged = match_tag(joined, tags, new, "_i2") if tags and tags in df.columns else joined.withColumn("_i2", F.lit(None).cast("int"))
    by_tag = F.when(F.col("_who").isNotNull(), F.col("_i2"))
    picks = [F.col("_i0"), F.col("_i1"), by_tag, F.col("_i3"), F.col("_i4"), F.col("_i5")]
    stage = F.coalesce(*[F.when(p.isNotNull(), F.lit(s)) for p, s in zip(picks, STAGES)], F.lit("fallback"))
    decided = tagged.withColumns({"match_stage": stage, "_rule": F.coalesce(*picks)})

    fallback = rules.get("fallback") or {}
    rows = [
        {"_idx": i, "_cat": r.get("category", "Uncategorized" if i < offset else None),
         "_sub": r.get("subcategory", "General" if i < offset else None), "_tags": list(r.get("tags") or [])}
        for i, r in enumerate([*new, *old])
    ]
    rows.append({
        "_idx": -1, "_cat": fallback.get("category", "Uncategorized"), "_sub": fallback.get("subcategory", "General"),
        "_tags": list(fallback.get("tags") or []),
    })
    side = local_table(df.sparkSession, rows, "_idx int, _cat string, _sub string, _tags array<string>")
    result = decided.join(side, F.coalesce(decided["_rule"], F.lit(-1)) == side["_idx"], "left")
    own = F.col(tags) if tags and tags in df.columns else F.lit(None).cast("array<string>")
    return result.withColumns(
        {"category": F.col("_cat"), "subcategory": F.col("_sub"), "tags": merge_tags(own, F.col("_tags"))}
    ).drop("_who", "_name", "_rule", "_idx", "_cat", "_sub", "_tags", "_i0", "_i1", "_i2", "_i3", "_i4", "_i5")


def category_statistics(df: DataFrame, category: str = "category", subcategory: str = "subcategory") -> DataFrame:
    """Rows per category and subcategory with totals (NULL marks a total) and the uncategorised share."""
    named = df.select(
        F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("Uncategorized")).alias("category"),
        F.coalesce(F.nullif(F.col(subcategory), F.lit("")), F.lit("General")).alias("subcategory"),
    )
    none = F.count_if(F.col("category") == "Uncategorized")
    # Counted per pair first: the rollup then works on a small table.
    pairs = named.groupBy("category", "subcategory").agg(F.count("*").alias("_n"), none.alias("_u"))
    return pairs.rollup("category", "subcategory").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("count"), F.coalesce(F.sum("_u"), F.lit(0)).alias("uncategorized_count"),
        F.coalesce(F.try_divide(F.sum("_u") * 100.0, F.sum("_n")), F.lit(0.0)).alias("uncategorized_pct"),
    )
