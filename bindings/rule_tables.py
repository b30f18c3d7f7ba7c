"""Queries of fuzzy rules that are tables, with SQL that scores all with all."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.messages import LCS, RULES
from bindings.registry import longs, query, read, rounded
from txnlake.functions.fixed_values import BANK_PATTERNS
from txnlake.operators import classify

# Aliases are the names and types of parts; payees are these with letters lost, added or in another order.
FULL_NAME = "lower(p_name || ' ' || p_type)"
SLIPPED = """CASE p_partkey % 4 WHEN 0 THEN replace(p_name, 'e', '') || ' ' || p_type WHEN 1 THEN upper(p_name) || ' ' || lower(p_type) || ' x'
 WHEN 2 THEN p_type || ' ' || p_name ELSE '  ' || p_name || ' ' || substr(p_type, 1, 3) END"""
ALIAS_TABLE = f"SELECT {FULL_NAME} AS alias, max_by(p_brand, p_partkey) AS canonical, min(p_partkey) AS place FROM part GROUP BY 1"
BEST_SCORE = f"SELECT *, 200.0 * list_last({LCS}) / (length(a) + length(b)) AS score FROM pairs"


@query("j2_resolve_merchants_table", f"""WITH al AS ({ALIAS_TABLE}), p AS (SELECT p_partkey, {SLIPPED} AS payee FROM part),
 n AS (SELECT DISTINCT trim(lower(payee)) AS k FROM p),
 pairs AS (SELECT k, canonical, place, k = alias AS exact, k AS a, alias AS b FROM n, al WHERE 200.0 * least(length(k), length(alias)) / (length(k) + length(alias)) >= 85),
 s AS ({BEST_SCORE}), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY exact DESC, score DESC, place) AS n FROM s WHERE score >= 85)
 SELECT p_partkey, coalesce(canonical, payee) AS canonical, round(score, 6)::DOUBLE AS match_score FROM p LEFT JOIN (SELECT * FROM r WHERE n = 1) r ON trim(lower(payee)) = k""")
def _(spark, sf):
    """Aliases that are as many as there are different parts."""
    part = read(spark, sf, "part")
    aliases = part.select(F.expr(FULL_NAME).alias("alias"), F.col("p_brand").alias("canonical"), F.col("p_partkey").alias("place"))
    out = classify.resolve_merchants(part.select("p_partkey", F.expr(SLIPPED).alias("payee")), "payee", aliases)
    return rounded(out.select("p_partkey", "canonical", "match_score"), 6)


# Patterns are names of parts without vowels but the first; their rule is the place of their first word.
PATTERN = "substr(p_name, 1, 2) || regexp_replace(substr(p_name, 3), '[aeiou]', '')"
PATTERN_SQL = PATTERN.replace("'[aeiou]', ''", "'[aeiou]', '', 'g'")
RULE = "length(p_name) % 5"
WITH_SCORES = f"""pt AS (SELECT pattern, min_by(rule, place) AS rule, min(place) AS place FROM (
  SELECT {PATTERN_SQL} AS pattern, ({RULE})::INT AS rule, p_partkey AS place FROM part) GROUP BY 1),
 names AS (SELECT DISTINCT trim(lower(payee)) AS k FROM asked), kp AS (SELECT k, pattern FROM names, pt),
 words AS (SELECT *, list_sort(list_filter(string_split(k, ' '), lambda x: x <> '')) AS kw, list_sort(list_filter(string_split(pattern, ' '), lambda x: x <> '')) AS pw FROM kp),
 sets AS (SELECT *, list_sort(list_distinct(kw)) AS ks, list_sort(list_distinct(pw)) AS ps FROM words),
 parts AS (SELECT *, list_filter(ks, lambda x: list_contains(ps, x)) AS shared, list_filter(ks, lambda x: NOT list_contains(ps, x)) AS mine,
   list_filter(ps, lambda x: NOT list_contains(ks, x)) AS theirs FROM sets),
 joined AS (SELECT *, array_to_string(shared, ' ') AS s, trim(array_to_string(list_concat(shared, mine), ' ')) AS wl, trim(array_to_string(list_concat(shared, theirs), ' ')) AS wr FROM parts),
 sl AS (SELECT k, pattern, CASE WHEN length(k) <= length(pattern) THEN k ELSE pattern END AS short, CASE WHEN length(k) <= length(pattern) THEN pattern ELSE k END AS long FROM kp),
 st AS (SELECT k, pattern, short, long, unnest(range(1 - length(short), length(long)))::INT AS i FROM sl),
 raw AS (SELECT k, pattern, array_to_string(kw, ' ') AS a, array_to_string(pw, ' ') AS b FROM words
  UNION ALL SELECT k, pattern, wl, wr FROM joined UNION ALL SELECT k, pattern, s, wl FROM joined WHERE s <> '' UNION ALL SELECT k, pattern, s, wr FROM joined WHERE s <> ''
  UNION ALL SELECT k, pattern, short, long[greatest(0, i) + 1 : least(length(long), i + length(short))] FROM st),
 pairs AS (SELECT DISTINCT * FROM raw WHERE 200.0 * least(length(a), length(b)) >= 80 * (length(a) + length(b))),
 lcs AS ({BEST_SCORE}),
 best AS (SELECT k, pattern, max(score) AS score FROM (SELECT k, pattern, score FROM lcs UNION ALL SELECT k, pattern, 100.0 FROM joined WHERE s <> '' AND (len(mine) = 0 OR len(theirs) = 0)
  UNION ALL SELECT k, pattern, 90.0 FROM kp WHERE contains(k, pattern)) GROUP BY 1, 2),
 hit AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, place) AS n FROM best JOIN pt USING (pattern) WHERE score >= 80)"""


def _rules(spark, sf):
    part = read(spark, sf, "part")
    return part.select(F.expr(RULE).cast("int").alias("rule"), F.expr(PATTERN).alias("pattern"), F.col("p_partkey").alias("place"))


@query("c4_match_fuzzy_table", f"""WITH asked AS (SELECT p_partkey, {SLIPPED} AS payee FROM part WHERE p_partkey % 5 <> 0), {WITH_SCORES}
 SELECT p_partkey, rule::BIGINT AS rule_idx, round(score, 6)::DOUBLE AS rule_idx_score FROM part LEFT JOIN asked USING (p_partkey) LEFT JOIN hit ON trim(lower(payee)) = k AND n = 1""")
def _(spark, sf):
    """Patterns that are as many as there are different parts, for payees that they don't equal; every fifth row is left out."""
    part = read(spark, sf, "part").select("p_partkey", F.expr(SLIPPED).alias("payee"))
    out = classify.match_fuzzy(part, "payee", _rules(spark, sf), unless=F.col("p_partkey") % 5 == 0)
    return rounded(longs(out.select("p_partkey", "rule_idx", "rule_idx_score")), 6)


@query("j3_categorize_table", f"""WITH asked AS (SELECT DISTINCT {SLIPPED} AS payee FROM part), {WITH_SCORES},
 named AS (SELECT p_partkey, {SLIPPED} AS payee FROM part)
 SELECT p_partkey, CASE WHEN rule IS NOT NULL AND rule < 4 THEN ['Plates', 'Gizmos', 'Rods', 'Small'][rule + 1] WHEN rule IS NULL AND contains(lower(payee), 'rod') THEN 'Rods'
  WHEN rule IS NULL AND contains(lower(payee), 'small') THEN 'Small' WHEN rule IS NULL THEN 'Uncategorized' ELSE 'Odd' END AS category,
  CASE WHEN rule IS NOT NULL THEN 'merchant_fuzzy' WHEN contains(lower(payee), 'rod') OR contains(lower(payee), 'small') THEN 'keywords' ELSE 'fallback' END AS match_stage
 FROM named LEFT JOIN hit ON trim(lower(payee)) = k AND n = 1""")
def _(spark, sf):
    """Categories by fuzzy patterns from a table, then by keywords."""
    rules = {"categories": [*[{k: v for k, v in r.items() if k not in ("merchant_exact", "merchant_fuzzy")} for r in RULES["categories"]], {"category": "Odd"}],
             "fallback": RULES["fallback"]}
    part = read(spark, sf, "part").select("p_partkey", F.expr(SLIPPED).alias("payee"))
    return classify.categorize(part, rules, fuzzy=_rules(spark, sf)).select("p_partkey", "category", "match_stage")


@query("c8_nearest_bank")
def _(spark, sf):
    """Banks by a table of their names; checked against brute force in the tests."""
    names = [(b, p, i) for i, (b, p) in enumerate((b, p) for b, ps in BANK_PATTERNS.items() for p in ps)]
    table = spark.createDataFrame(names, "bank string, name string, place int")
    return classify.nearest_bank(read(spark, sf, "conversations"), "text", table).select("conv_id", "turn", "bank_id", "bank_score")
