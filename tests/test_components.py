"""Components of links against a union-find."""

import random

import pytest

from txnlake.plans.components import components


def union_find(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(-200, 400), r.randrange(-200, 400)) for _ in range(250)] + [(1000, 1000)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {x["node"]: x["label"] for x in got.collect()} == union_find(links)


def test_a_chain_takes_few_rounds(spark):
    r = random.Random(1)
    names = list(range(3000))
    r.shuffle(names)
    rounds = []
    got = components(spark.createDataFrame(list(zip(names, names[1:])), "a long, b long"), rounds)
    assert {x["label"] for x in got.collect()} == {0} and got.count() == 3000 and len(rounds) <= 16


def test_no_links_and_a_hub(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    got = components(spark.createDataFrame([(5, i) for i in range(500)], "a long, b long"))
    assert {x["label"] for x in got.collect()} == {0} and got.count() == 500


def test_links_that_come_together_need_no_rounds(spark):
    rounds = []
    got = components(spark.range(0, 5000, 1, 2).selectExpr("id AS a", "id + 1 AS b"), rounds)
    assert {x["label"] for x in got.collect()} == {0} and got.count() == 5001 and len(rounds) <= 3
