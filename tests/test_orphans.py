from datetime import datetime as t

import pytest

from loomgraph.operators.orphans import orphan_references, orphan_report


def run(spark, refs, targets, match):
    r = spark.createDataFrame(refs, "id int, a string, b string, kind2 string")
    g = spark.createDataFrame(targets, "a string, b string, extra int")
    return {x["id"]: x["kind"] for x in orphan_references(r, g, ["a", "b"], match).collect()}


REFS = [(1, "x", "1", ""), (2, "x", "9", ""), (3, None, "1", ""), (4, None, "9", ""), (5, None, None, ""), (6, "x", None, ""), (7, "y", None, ""), (2, "x", "9", "")]
TARGETS = [("x", "1", 0), ("x", "1", 1), (None, "7", 2)]


@pytest.mark.parametrize(
    ("match", "want"),
    [
        ("simple", {2: "missing"}),
        ("full", {2: "missing", 3: "mixed", 4: "mixed", 6: "mixed", 7: "mixed"}),
        ("partial", {2: "missing", 4: "missing", 7: "missing"}),
        ("exact", {2: "missing", 3: "missing", 4: "missing", 5: "missing", 6: "missing", 7: "missing"}),
    ],
)
def test_match_semantics(spark, match, want):
    assert run(spark, REFS, TARGETS, match) == want


def test_exact_matches_null_with_null(spark):
    assert run(spark, [(1, None, "7", "")], TARGETS, "exact") == {}


def test_empty_tables(spark):
    assert run(spark, [], TARGETS, "simple") == {}
    assert run(spark, [(1, "x", "1", "")], [], "simple") == {1: "missing"}


def test_lifetimes(spark):
    day = lambda d: t(2024, 1, d)
    nodes = [("A", day(5), day(10)), ("A", day(8), day(12)), ("A", day(20), None), ("A", day(20), day(21)), ("B", None, day(3)), ("C", day(1), day(1))]
    targets = spark.createDataFrame(nodes, "k string, f timestamp, u timestamp")
    refs = [(1, "A", day(4)), (2, "A", day(5)), (3, "A", day(11)), (4, "A", day(12)), (5, "A", day(25)), (6, "B", day(2)), (7, "C", day(1)), (8, "Z", day(1)), (9, "A", None)]
    r = spark.createDataFrame(refs, "id int, k string, at timestamp")
    got = orphan_references(r, targets, ["k"], "exact", "at", "f", "u")
    assert {x["id"]: x["kind"] for x in got.collect()} == {1: "late", 4: "deleted", 6: "missing", 7: "deleted", 8: "missing"}
    report = orphan_report(got, "at", ["k"]).collect()
    assert {(x["k"], x["kind"], x["period"], x["n"]) for x in report if x["k"] == "A"} == {("A", "late", "2024-01", 1), ("A", "deleted", "2024-01", 1)}


def test_unknown_semantics_are_refused(spark):
    with pytest.raises(ValueError):
        run(spark, REFS, TARGETS, "loose")


def test_hot_keys_are_split_without_adaptive_plans(spark):
    """Two keys hold two thirds of the references, one of them has no record; every reference gets its own answer."""
    day = lambda d: t(2024, 1, 1 + d)
    nodes = [("hot", "n", day(3), day(9)), ("hot", "n", day(12), None), (None, "n", day(5), None), ("k1", "n", day(0), day(2))]
    keys = [("hot", "n"), ("gone", "n"), ("hot", "n"), ("gone", "n"), ("k1", "n"), (None, "n")]
    refs = [(i, *keys[i % 6], day(i % 15)) for i in range(1800)]
    lives = {k: [(a, b) for *x, a, b in nodes if tuple(x) == k] for k in set(keys)}
    want = {}
    for i, a, b, at in refs:
        mine = lives[a, b]
        if not any(f <= at and (u is None or u > at) for f, u in mine):
            want[i] = "missing" if not mine else "late" if min(f for f, _ in mine) > at else "deleted"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        r = spark.createDataFrame(refs, "id int, a string, b string, at timestamp")
        g = spark.createDataFrame(nodes, "a string, b string, f timestamp, u timestamp")
        got = {x["id"]: x["kind"] for x in orphan_references(r, g, ["a", "b"], "exact", "at", "f", "u").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == want and set(want.values()) == {"missing", "late", "deleted"}


def test_clashing_columns(spark):
    r = spark.createDataFrame([(1, "x", "old", 5)], "id int, a string, kind string, load int")
    g = spark.createDataFrame([("y", 1)], "a string, kind int")
    assert [(x["id"], x["kind"], x["load"]) for x in orphan_references(r, g, ["a"], "simple").collect()] == [(1, "missing", 5)]
