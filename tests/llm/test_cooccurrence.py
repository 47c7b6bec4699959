import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from loomgraph.llm.cooccurrence import pair_counts


def brute(rows, support, lift):
    baskets = defaultdict(set)
    for b, i, _ in rows:
        if b is not None and i is not None:
            baskets[b].add(i)
    n = Counter(i for s in baskets.values() for i in s)
    both = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    return {(a, b): (k, n[a], n[b], len(baskets)) for (a, b), k in both.items() if k >= support and k * len(baskets) >= lift * n[a] * n[b]}


def run(spark, rows, support, lift, block):
    df = spark.createDataFrame(rows, "b string, i string, n int")
    out = pair_counts(df, "b", "i", support, lift, block).collect()
    for r in out:
        assert r["lift"] == pytest.approx(r["n_ab"] * r["n_baskets"] / r["n_a"] / r["n_b"])
    return {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n_baskets"]) for r in out}


@pytest.mark.parametrize(("support", "lift", "block"), [(4, 3, 1024), (4, 3, 8), (2, 0, 8), (1, 0, 16), (3, 1, 8)])
def test_against_brute_force(spark, support, lift, block):
    rnd = random.Random(4)
    rows = []
    for b in range(120):
        for _ in range(rnd.choice([0, 1, 3, 8, 25])):
            rows.append((f"b{b % 90}", f"i{int(rnd.paretovariate(0.7)) % 60}", 1))
    for b in ("big1", "big2", "big3", "big4", "big5"):
        rows += [(b, f"i{k}", 1) for k in range(rnd.randrange(30, 60))]
    rows += [(None, "i1", 1), ("b1", None, 1), ("b1", "", 1)] + rows[:50]
    assert run(spark, rows, support, lift, block) == brute(rows, support, lift)


def test_equal_baskets_and_empty_table(spark):
    rows = [(f"b{b}", i, 1) for b in range(50) for i in ("x", "y", "z")]
    assert run(spark, rows, 4, 1, 1024) == brute(rows, 4, 1)
    assert run(spark, [], 4, 3, 1024) == {}


def test_conviction(spark):
    rows = [("1", "a", 0), ("1", "b", 0), ("2", "a", 0), ("3", "b", 0), ("4", "c", 0)]
    df = spark.createDataFrame(rows, "b string, i string, n int")
    (r,) = pair_counts(df, "b", "i", 1).collect()
    assert r["conviction"] == pytest.approx((1 - 2 / 4) / (1 - 1 / 2))


def test_equal_large_baskets_and_many_giants_without_adaptive_plans(spark):
    """More giants than bits in an integer, equal large baskets, and a basket with a third of the rows."""
    rnd = random.Random(6)
    rows = [(f"g{k}", f"i{i}", 1) for k in range(75) for i in rnd.sample(range(40), 34)]
    rows += [(f"same{k}", f"i{i}", 1) for k in range(30) for i in range(11)]
    rows += [("huge", f"i{i}", 1) for i in range(700)]
    rows += [(f"s{k}", f"i{i}", 1) for k in range(60) for i in rnd.sample(range(10), 3)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert run(spark, rows, 70, 0, 8) == brute(rows, 70, 0) != {}
        assert run(spark, rows, 20, 1, 8) == brute(rows, 20, 1) != {}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
