import random
from collections import Counter, defaultdict

import numpy as np

from loomgraph.llm import frequency

SCHEMA = "field string, record string, term string, occ int"


def run(spark, rows, rare=2, common=0.5):
    out = frequency.term_frequencies(spark.createDataFrame(rows, SCHEMA), rare, common).collect()
    return {(r["field"], r["term"]): (r["occurrences"], r["records"], r["all_records"], r["mark"]) for r in out}


def brute(rows, rare=2, common=0.5):
    occ, rec, all_ = Counter(), defaultdict(set), defaultdict(set)
    for field, record, term, _ in rows:
        if record is not None:
            all_[field].add(record)
        if term is not None:
            occ[field, term] += 1
            rec[field, term] |= {record} - {None}
    out = {}
    for k, n in occ.items():
        r, total = len(rec[k]), len(all_[k[0]])
        out[k] = (n, r, total, "rare" if 0 < r <= rare else "common" if r > common * total else None)
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(frequency, "WIDTH", 16)
    monkeypatch.setattr(frequency, "HELD", 3)
    rnd = random.Random(2)
    rows = [
        (rnd.choice(["f", "g"]), None if rnd.random() < 0.1 else f"r{int(rnd.paretovariate(0.5)) % 200}", None if rnd.random() < 0.1 else f"t{int(rnd.paretovariate(0.4)) % 150}", 1)
        for _ in range(4000)
    ]
    rows += rows[:500] + [("f", "hot", "t1", 1)] * 2000
    assert run(spark, rows) == brute(rows)


def test_many_terms_without_a_broadcast(spark, monkeypatch):
    """As many terms as rows, one of them in a third of the rows, by shuffled joins only."""
    monkeypatch.setattr(frequency, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(frequency, "WIDTH", 64)
    rows = [("f", f"r{i}", f"t{i % 2900}", 1) for i in range(3000)] + [("f", f"r{i}", "hot", 1) for i in range(1500)]
    assert run(spark, rows) == brute(rows)


def test_arrays_of_few_counts_go_as_places():
    held = {("f", 3): np.zeros((2, 64), np.int64), ("g", 0): np.ones((2, 64), np.int64)}
    held["f", 3][:, [5, 9]] = [[7, 8], [1, 2]]
    batch = frequency._emit(held, 64)
    assert batch.column(2).to_pylist() == [[5, 9], None]
    assert batch.column(3).to_pylist() == [[7, 8], [1] * 64] and batch.column(4).to_pylist()[0] == [1, 2]
    (total,) = frequency._sum_ranges(iter([frequency._emit({("f", 3): held["f", 3]}, 64)] * 2), 64)
    assert total.column(3).to_pylist() == [[14, 16]]


def test_null_empty_and_long(spark):
    rows = [("f", None, "only", 1), ("f", "a", None, 1), ("f", "a", "", 1), ("f", "b", "x" * 100_000, 1)]
    got = run(spark, rows, rare=1, common=0.9)
    assert got["f", "only"] == (1, 0, 2, None)
    assert got["f", ""] == (1, 1, 2, "rare")
    assert got["f", "x" * 100_000] == (1, 1, 2, "rare")
    assert run(spark, []) == {}
