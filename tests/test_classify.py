import re
from collections import Counter

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from txnlake.functions import similarity as sim
from txnlake.functions import text
from txnlake.functions.fixed_values import BANK_PATTERNS
from txnlake.functions.rules import alias_pairs, category_rules
from txnlake.operators import classify, ml
from txnlake.plans.groups import dealt

RULES = {
    "rules": [
        {"match": "Uber", "category": "Transport", "subcategory": "Ride", "tags": ["Mobility"]},
        {"match_regex": ".*Vodafone.*", "category": "Utilities"}, {"match_regex": "([", "category": "bad"},
        {"match_tag": "Subscription", "category": "Entertainment", "subcategory": "Streaming"},
    ],
    "categories": [
        {"category": "Food", "subcategory": "Restaurants", "tags": ["Dining"], "merchant_exact": ["McDonald's"], "merchant_fuzzy": ["mcdonald", "pizza"], "keywords": {"english": ["restaurant"], "arabic": ["مطعم"]}},
        {"category": "Shopping", "subcategory": "Online", "merchant_fuzzy": ["amazon"], "keywords": {"english": ["market"]}},
    ],
}


def categorized(spark, names, tags=None):
    df = spark.createDataFrame([(i, n, tags) for i, n in enumerate(names)], "id int, payee string, tags array<string>")
    return {r["payee"]: r for r in classify.categorize(df, RULES).collect()}


def test_stages_in_order(spark):
    got = categorized(spark, [" UBER ", "My vodafone shop", "McDonald's", "McDonalds Cairo", "Big Restaurant", "مطعم النيل", "Super Market", "Zzz", None, ""])
    stage = {k: v["match_stage"] for k, v in got.items()}
    assert stage == {
        " UBER ": "match", "My vodafone shop": "match_regex", "McDonald's": "merchant_exact", "McDonalds Cairo": "merchant_fuzzy",
        "Big Restaurant": "keywords", "مطعم النيل": "keywords", "Super Market": "keywords", "Zzz": "fallback", None: "fallback", "": "fallback",
    }
    assert (got["My vodafone shop"]["category"], got["My vodafone shop"]["subcategory"]) == ("Utilities", "General")
    assert (got["Zzz"]["category"], got["Zzz"]["subcategory"], got["Zzz"]["tags"]) == ("Uncategorized", "General", [])


def test_tags_decide_before_old_rules_and_are_merged(spark):
    got = categorized(spark, ["McDonald's", "Uber", "Zzz", None], ["SUBSCRIPTION", "x"])
    assert got["McDonald's"]["match_stage"] == "match_tag" and got["Zzz"]["category"] == "Entertainment"
    assert got["Uber"]["category"] == "Transport" and got["Uber"]["tags"] == ["Mobility", "SUBSCRIPTION", "x"]
    assert got[None]["match_stage"] == "fallback"


def test_fuzzy_rules_against_a_loop(spark):
    names = ["pizzza hut", "amazn prime", "mac donald", "amazon pizza", "tree", "mcdonnald egypt", "zon ama"]
    df = spark.createDataFrame([(n,) for n in names], "payee string")
    for r in classify.match_fuzzy(df, "payee", RULES["categories"]).collect():
        scored = [(sim.name_score(r["payee"], p), -i) for i, rule in enumerate(RULES["categories"]) for p in rule["merchant_fuzzy"]]
        best = max(scored)
        assert (r["rule_idx"], r["rule_idx_score"]) == ((-best[1], best[0]) if best[0] >= 80 else (None, None))


def test_rules_need_a_list():
    with pytest.raises(ValueError):
        category_rules({"other": []})


def test_statistics(spark):
    df = spark.createDataFrame([("A", "x"), ("A", "x"), ("A", None), (None, None)], "category string, subcategory string")
    got = {(r["category"], r["subcategory"]): (r["count"], r["uncategorized_count"]) for r in classify.category_statistics(df).collect()}
    assert got[("A", "x")] == (2, 0) and got[("A", None)] == (3, 0) and got[(None, None)] == (4, 1) and got[("Uncategorized", "General")] == (1, 1)


ALIASES = alias_pairs([
    {"canonical": "Carrefour", "aliases": ["كارفور", "Carrefour EG", "CARREFOUR MAADI"]}, {"canonical": "KFC", "aliases": ["KFC", "Kentucky Fried Chicken"]},
    {"canonical": None, "aliases": ["x"]},
])


def test_merchants(spark):
    names = ["carrefour maadi", "Carrefour Madi", "kfc ", "Kentucky Fried Chiken", "Unknown Shop", "كارفور", None, "", "   "]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, payee string")
    rows = {r["id"]: (r["canonical"], r["match_score"] and round(r["match_score"], 2)) for r in classify.resolve_merchants(df, "payee", ALIASES).collect()}
    assert rows == {0: ("Carrefour", 100.0), 1: ("Carrefour", 96.55), 2: ("KFC", 100.0), 3: ("KFC", 97.67), 4: ("Unknown Shop", None), 5: ("Carrefour", 100.0), 6: (None, None), 7: ("", None), 8: ("", None)}


def test_first_alias_wins_a_tie(spark):
    df = spark.createDataFrame([("abcdefgx",)], "payee string")
    assert classify.resolve_merchants(df, "payee", [("abcdefgy", "First"), ("abcdefgz", "Second")]).first()["canonical"] == "First"


YES = ["Special offer: 50% off!", "Enjoy free delivery", "You are a WINNER", "عروض خاصة لفترة محدودة", "Get cashback now", "احصل على هدية"]
NO = ["Your card was charged 100 EGP", "discounted item bought", "تم خصم 100 جنيه", "officer paid", "balance is 5"]


def test_promotions(spark):
    df = spark.createDataFrame([(t,) for t in [*YES, *NO, "", None]], "text string")
    got = {r["text"]: r for r in classify.classify_promo(df).collect()}
    assert all(got[t]["skip"] for t in YES) and not any(got[t]["skip"] for t in NO)
    first = got[YES[0]]
    assert list(first["matched_keywords"]) == ["% off", "off", "offer", "special offer"] and first["promo_confidence"] == "high"
    assert first["reason"] == "Promotional message detected (keywords: % off, off, offer (and 1 more))"
    assert (got[""]["reason"], got[""]["promo_confidence"], got[NO[0]]["promo_confidence"]) == ("Invalid input", "low", "high")
    same = df.filter("text is not null").select(F.col("text"), classify.is_promotional(F.col("text")).alias("p")).collect()
    assert all(r["p"] == got[r["text"]]["skip"] for r in same)


def test_banks_by_pattern_and_by_closeness(spark):
    texts = ["Your HSBC card was charged", "CIB: balance", "تم الخصم من بطاقتك من CIB", "nothing here at all", "Vodafne Cash sent", "", None, "Bnque Misr alert", "Emirats NBD"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: (r["bank_id"], r["bank_score"]) for r in classify.identify_bank(df).collect()}
    assert got[texts[0]] == ("HSBC", 100.0) and got[texts[1]] == ("CIB", 100.0) and got[texts[2]] == ("CIB", 100.0)
    assert got[""] == got[None] == ("unknown_bank", 0.0)
    for t in (texts[3], texts[4], texts[7], texts[8]):
        best = ("unknown_bank", 0.0)
        for bank, patterns in BANK_PATTERNS.items():
            score = next((s for p in patterns if (s := sim.partial_ratio(p.lower(), t.lower())) >= 80), 0.0)
            best = (bank, score) if score > best[1] else best
        assert got[t] == best
    exact = {r["text"]: r["bank_id"] for r in classify.identify_bank(df, fuzzy=False).collect()}
    assert exact[texts[4]] == "unknown_bank"
    stats = {r["bank_id"]: r["count"] for r in classify.bank_statistics(classify.identify_bank(df, fuzzy=False)).collect()}
    assert stats["CIB"] == 2


def test_first_pattern_wins(spark):
    df = spark.createDataFrame([("b a",), ("c",)], "t string")
    got = [r["rule"] for r in classify.match_any_pattern(df, "t", [("one", "A"), ("broken", "(["), ("two", "b")]).collect()]
    assert got == ["one", None]


def test_patterns_are_tried_where_they_run(spark):
    rules = [{"match_regex": "(?P<x>a)"}, {"match_regex": "(["}, {"match_regex": "a+"}]
    df = spark.createDataFrame([("caab",), (None,)], "m string")
    assert {r["m"]: r["rule_idx"] for r in classify.match_regex(df, "m", rules).collect()} == {"caab": 2, None: None}


def test_banks_in_letters_that_equal_ascii_ones_without_case(spark):
    texts = ["ſaıb", "yOUR hSBC CARD", "HSBC.COM", "hsbcxcom", "bloM banK", "CİTİ", "بنك مصر", "cib", None, " "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["bank_id"] for r in classify.identify_bank(df, fuzzy=False).collect()}
    plain = {b: classify.java_pattern("(?:" + "|".join(p) + ")") for b, p in BANK_PATTERNS.items()}
    hit = df.select("text", *[F.col("text").rlike(p).alias(b) for b, p in plain.items()]).collect()
    assert got == {r["text"]: next((b for b in plain if r[b]), "unknown_bank") for r in hit}
    plan = classify.identify_bank(df, fuzzy=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper()


def test_scores_of_many_texts_in_small_batches(monkeypatch):
    groups = [["hsbc", "your card"], ["citi", "balance is"]]
    texts = ["hsb", "x" * 50 + "citi", "your crd", "balanc is low", "", "itic", "a", "your balance"] * 9
    whole = sim.best_groups(texts, groups, 80.0)
    monkeypatch.setattr(sim, "LETTERS_AT_ONCE", 40)
    assert sim.best_groups(texts, groups, 80.0) == whole
    for t, (i, score) in zip(texts, whole):
        best = (None, 0.0)
        for g, ps in enumerate(groups):
            s = next((s for p in ps if (s := sim.partial_ratio(p, t)) >= 80), 0.0)
            best = (g, s) if s > best[1] else best
        assert (i, score or 0.0) == best


TEXTS = [(i, f"{a} {b} {a} {b} shop{i % 3} x {'pad ' * (i % 4)}" if i % 7 else "  ", None if i % 11 == 5 else a) for i, (a, b) in enumerate(
    [("food", "lunch menu"), ("ride", "Taxi trip"), ("bill", "Ünit lıght")] * 30)]


def test_learned_categories_are_those_of_the_whole_stages(spark):
    df = spark.createDataFrame(TEXTS, "id int, text string, category string").coalesce(1)
    for features in (5000, 4):
        model, stats = ml.train_classifier(df, ["text"], features=features, iterations=10)
        rows = ml.labelled_text(df, ["text"], "category")
        assert stats == {"samples": float(rows.count()), "labels": 3.0}
        terms = [t for r in PipelineModel(model.stages[:3]).transform(rows).collect() for t in r["_terms"]]
        held = Counter(t for r in PipelineModel(model.stages[:3]).transform(rows).collect() for t in set(r["_terms"]))
        count = {t: n for t, n in Counter(terms).items() if held[t] >= 2}
        assert model.stages[3].vocabulary == sorted(count, key=lambda t: (-count[t], t))[:features]
        whole = model.transform(df.withColumn("_text", text.combined(["text"])))
        want = {r["id"]: (r["predicted_category"], list(r["_probability"])) for r in whole.collect()}
        for r in ml.predict_category(model, df, ["text"], "none").collect():
            name, chances = want[r["id"]]
            blank = not r["text"].strip()
            assert (r["predicted_category"], r["predicted_probability"]) == (("none", 0.0) if blank else (name, max(chances)))
    kept, _ = ml._vocabulary(spark.createDataFrame([("a b a b",), ("a b",)], "_words string"), 2, 2), None
    assert kept == ["a", "a b"]


def test_wrong_predictions_run_the_model_once(spark):
    df = spark.createDataFrame(TEXTS, "id int, text string, category string")
    model, _ = ml.train_classifier(df, ["text"], iterations=3)
    shuffled = df.withColumn("category", F.when(F.col("id") % 2 == 0, "ride").otherwise(F.col("category")))
    wrong = ml.misclassified(model, shuffled, ["text"])
    told = {r["id"]: r["predicted_category"] for r in ml.predict_category(model, shuffled, ["text"]).collect()}
    labelled = ml.labelled_text(shuffled, ["text"], "category").select("id", "category").collect()
    assert {r["id"] for r in wrong.collect()} == {r["id"] for r in labelled if told[r["id"]] != r["category"]}
    plan = wrong._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"_one#\d+\)? AS|AS _one#|AS _words#", plan)) <= 2 and plan.count("AS _prediction#") == 1


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    each = dealt(rows, 100).groupBy(F.spark_partition_id()).count().collect()
    assert len(each) == 10 and sum(r["count"] for r in each) == 1000 and max(r["count"] for r in each) <= 110
    assert dealt(spark.range(800), 100).rdd.getNumPartitions() == spark.range(800).rdd.getNumPartitions()
    assert dealt(rows.limit(0), 100).count() == 0
