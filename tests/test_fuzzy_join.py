"""Names joined with tables of rules, against scoring all with all."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from txnlake.functions import similarity as sim
from txnlake.functions.fixed_values import BANK_PATTERNS
from txnlake.operators import classify
from txnlake.plans import fuzzy_join

STOCK = [
    "red widget", "crimson widget", "blue ring", "blue rings", "hot plate", "cold plate", "a", "b", "ab", "ba", "abc", "aaaa", "aaab",
    "carrefour maadi", "carrefour city centre", "kfc", "kentucky fried chicken", "مطعم النيل", "كارفور", "zz top", "top zz", "the the the",
]


def slipped(r, name):
    letters = list(name)
    for _ in range(r.randrange(4)):
        at = r.randrange(len(letters) + 1)
        if r.random() < 0.5 and len(letters) > 1:
            del letters[min(at, len(letters) - 1)]
        else:
            letters.insert(at, r.choice("abcre tن"))
    return " ".join("".join(letters).split()) or "x"


@pytest.fixture(scope="module")
def names():
    r = random.Random(4)
    left = sorted({slipped(r, r.choice(STOCK)) for _ in range(160)} | set(STOCK[:9]))
    right = sorted({slipped(r, s) for s in STOCK for _ in range(3)} | set(STOCK))
    return left, right


def one_column(spark, names, column):
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


@pytest.mark.parametrize("threshold", [30.0, 50.0, 60.0, 75.0, 80.0, 85.0, 92.5, 100.0])
def test_similar_names_are_all_found(spark, names, threshold):
    left, right = names
    got = fuzzy_join.similar_names(one_column(spark, left, "left"), one_column(spark, right, "right"), threshold, most=7)
    want = {(a, b): sim.indel_ratio(a, b) for a in left for b in right if sim.indel_ratio(a, b) >= threshold}
    rows = got.collect()
    assert len(rows) == len(want) and all(abs(want[r["left"], r["right"]] - r["score"]) < 1e-9 for r in rows)


@pytest.mark.parametrize("threshold", [40.0, 60.0, 80.0, 95.0, 100.0])
def test_candidates_hold_every_similar_name(spark, names, threshold):
    left, right = names
    a, b = one_column(spark, left, "left"), one_column(spark, right, "right")
    partial = {tuple(r) for r in fuzzy_join.partial_candidates(a, b, threshold, most=7).collect()}
    tokens = {tuple(r) for r in fuzzy_join.token_candidates(a, b, threshold, most=7).collect()}
    for x in left:
        for y in right:
            assert (x, y) in partial or sim.partial_ratio(x, y) < threshold
            assert (x, y) in tokens or max(sim.token_sort_ratio(x, y), sim.token_set_ratio(x, y)) < threshold


def test_few_pairs_are_scored(spark):
    r = random.Random(1)
    right = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(3000)]
    left = [slipped(r, x) for x in right[:300]]
    found = fuzzy_join.similar_candidates(one_column(spark, sorted(set(left)), "left"), one_column(spark, sorted(set(right)), "right"), 85.0)
    assert found.count() < 0.08 * len(left) * len(right)
    plan = fuzzy_join.scored(found, fuzzy_join.ratios, 85.0)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abc é", max_size=12), st.text("abc é", max_size=90)), max_size=8))
def test_common_lengths(pairs):
    got = fuzzy_join.common_lengths([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [sim.common_length(a, b) for a, b in pairs]


def test_merchants_by_a_table_of_aliases(spark, names):
    left, right = names
    pairs = [(a.upper() if i % 2 else a, f"C{i % 11}") for i, a in enumerate(right)] + [(right[0], "again")]
    table = spark.createDataFrame([(a, c, i) for i, (a, c) in enumerate(pairs)], "alias string, canonical string, place int")
    table = table.union(spark.createDataFrame([("", "never", 999), (None, "never", 1000)], table.schema))
    df = spark.createDataFrame([(i, n) for i, n in enumerate([*left, *left[:5], None, "", "  ", " " + right[3].upper() + " "])], "id int, payee string")
    for threshold in (70.0, 85.0):
        by_list = classify.resolve_merchants(df, "payee", pairs, threshold).collect()
        by_table = classify.resolve_merchants(df, "payee", table, threshold).collect()
        assert sorted(map(str, by_list)) == sorted(map(str, by_table))


def test_fuzzy_rules_by_a_table(spark, names):
    left, right = names
    rules = [{"merchant_fuzzy": right[i::9]} for i in range(9)]
    # As a list is read: rule by rule.
    rows = [(i, p) for i, rule in enumerate(rules) for p in rule["merchant_fuzzy"]]
    table = spark.createDataFrame([(i, f" {p.upper()} ", k) for k, (i, p) in enumerate(rows)] + [(0, " ", 999)], "rule int, pattern string, place int")
    df = spark.createDataFrame([(i, n) for i, n in enumerate([*left[:60], None, " ", left[0]])], "id int, payee string")
    unless = df["id"] % 7 == 3
    for threshold in (80.0, 90.0):
        by_list = classify.match_fuzzy(df, "payee", rules, threshold, unless, 3).collect()
        by_table = classify.match_fuzzy(df, "payee", table, threshold, unless, 3).collect()
        assert sorted(map(str, by_list)) == sorted(map(str, by_table))


def test_categories_with_fuzzy_patterns_in_a_table(spark):
    rules = {
        "rules": [{"match": "Uber", "category": "Transport"}],
        "categories": [{"category": "Food", "merchant_fuzzy": ["mcdonald", "pizza"]}, {"category": "Shops", "merchant_fuzzy": ["amazon"]}],
    }
    df = spark.createDataFrame([(n,) for n in ["uber", "mc donalds", "piza hut", "amazn", "tree", None]], "payee string")
    table = spark.createDataFrame([(0, "mcdonald", 0), (0, "pizza", 1), (1, "amazon", 2)], "rule int, pattern string, place int")
    by_list, by_table = classify.categorize(df, rules).collect(), classify.categorize(df, rules, fuzzy=table).collect()
    assert sorted(map(str, by_list)) == sorted(map(str, by_table))


def test_banks_by_a_table_of_names(spark):
    texts = [
        "Your HSBC card was charged", "nothing here at all", "Vodafne Cash sent", "", None, "Bnque Misr alert", "Emirats NBD", "  ", "بنك مصـر",
        "Vodafne Cash sent",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    names = [(b, p, i) for i, (b, p) in enumerate((b, p) for b, ps in BANK_PATTERNS.items() for p in ps)]
    got = classify.nearest_bank(df, "text", spark.createDataFrame([*names, ("x", "", 99)], "bank string, name string, place int")).collect()
    assert len(got) == len(texts)
    for r in got:
        t, best = (r["text"] or "").strip(), ("unknown_bank", 0.0)
        for bank, patterns in BANK_PATTERNS.items() if t else ():
            score = next((s for p in patterns if (s := sim.partial_ratio(p.lower(), t.lower())) >= 80), 0.0)
            best = (bank, score) if score > best[1] else best
        assert (r["bank_id"], r["bank_score"]) == best


def test_tables_without_rows(spark):
    df = spark.createDataFrame([("x",), (None,)], "payee string")
    none = classify.resolve_merchants(df, "payee", spark.createDataFrame([], "alias string, canonical string"))
    assert sorted(map(str, none.select("canonical", "match_score").collect())) == ["Row(canonical='x', match_score=None)", "Row(canonical=None, match_score=None)"]
    rules = spark.createDataFrame([], "rule int, pattern string")
    assert {r["rule_idx"] for r in classify.match_fuzzy(df, "payee", rules).collect()} == {None}
    assert classify.resolve_merchants(df.limit(0), "payee", spark.createDataFrame([("x", "y")], "alias string, canonical string")).collect() == []
    with pytest.raises(ValueError):
        classify.resolve_merchants(df, "payee", rules, 0)


def test_few_bank_names_need_no_join_and_many_give_the_same(spark, monkeypatch):
    texts = ["Vodafne Cash sent", "Bnque Misr alert and a long text about a great many other things", "citi", "Fawri", "", None, "brclays" * 3]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    names = [(b, p, i) for i, (b, p) in enumerate((b, p) for b, ps in BANK_PATTERNS.items() for p in ps)]
    table = spark.createDataFrame(names, "bank string, name string, place int")
    few = classify.nearest_bank(df, "text", table)
    assert "Join" not in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(classify, "LISTED_NAMES", 3)
    many = classify.nearest_bank(df, "text", table)
    assert "Join" in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
