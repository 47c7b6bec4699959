import math
import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomgraph.llm.topn import top_n

SCHEMA = "g string, h string, ident string, score double, place string"


def run(spark, rows, n):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((r["g"] or "", r["h"] or "", r["k"], r["ident"]) for r in top_n(df, ["g", "h"], "score", "ident", n, "k").collect())


def brute(rows, n):
    groups = defaultdict(list)
    for g, h, ident, score, _ in rows:
        if ident is not None and score is not None and not math.isnan(score):
            groups[g, h].append((-(score + 0.0), ident.encode(), ident))
    return sorted((g or "", h or "", i + 1, x[2]) for (g, h), v in groups.items() for i, x in enumerate(sorted(v)[:n]))


def test_many_sizes_ties_and_nulls(spark):
    rnd = random.Random(3)
    rows = []
    for g in range(40):
        for i in range(rnd.choice([1, 2, 5, 30, 300])):
            score = rnd.choice([0.0, -0.0, 1e-5, -3.5, None, math.nan, rnd.random(), math.inf, -math.inf])
            rows.append((f"g{g}", None if g % 7 == 0 else "h", None if rnd.random() < 0.02 else f"MSIGDB:M{rnd.randrange(10**6)}-{i}", score, "x"))
    assert run(spark, rows, 5) == brute(rows, 5)


def test_one_score_for_a_big_group(spark):
    rows = [("g", "h", f"id{i:06d}" + "z" * (i % 40), 1.0, "") for i in range(20_000)]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_empty_and_n_larger_than_groups(spark):
    assert run(spark, [], 3) == []
    rows = [("g", "h", "a", 1.0, ""), ("g", "h", "b", 2.0, "")]
    assert run(spark, rows, 10) == brute(rows, 10)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.floats(allow_nan=True), st.text("ab:é", max_size=12)), max_size=40, unique_by=lambda x: (x[0], x[2])), st.integers(1, 4))
def test_property(spark, items, n):
    rows = [(str(g), "h", ident, score, "") for g, score, ident in items]
    assert run(spark, rows, n) == brute(rows, n)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_codes_far_apart(spark, n):
    rows = [("g", "h", f"i{k}", s, "") for k, s in enumerate([5e-324, -5e-324, 1.8e308, -1.8e308, 0.0, 1.0])]
    assert run(spark, rows, n) == brute(rows, n)


def test_long_identifiers(spark):
    """Some have ten thousand bytes, but differ in their first words."""
    rows = [("g", "h", f"{k:03d}" + "x" * 10_000 * (k % 2), 1.0, "") for k in range(12)] + [("g", "h", "011y" + "x" * 20, 2.0, "")]
    assert run(spark, rows, 5) == brute(rows, 5)
