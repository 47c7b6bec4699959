"""Single seeds' scores at nodes asked for: in tasks, by joins and by plain steps; links that carry nothing; tails by size."""

import random

import numpy as np
import pytest

from loomgraph.operators import resample

STEPS = 6


@pytest.fixture(scope="module")
def graph(spark):
    rnd = random.Random(4)
    edges = [(f"g{rnd.randrange(30)}", f"g{rnd.randrange(60)}", rnd.random() < 0.6, True) for _ in range(400)]
    edges += [(f"g{rnd.randrange(60)}", "hub", True, True) for _ in range(80)] + [("hub", "w1", True, True), ("w1", "w2", True, True), ("x", "g1", True, True)]
    df = spark.createDataFrame(edges, "source string, target string, some boolean, every boolean")
    pool = spark.createDataFrame([(0, "g3"), (1, "hub"), (2, "w2"), (3, "off"), (4, "x"), (5, "g3"), (6, "g7")], "position int, node_id string")
    asked = spark.createDataFrame([(x,) for x in ("w1", "w2", "g5", "g59", "off", "x", "nowhere")], "node_id string")
    return edges, df, pool, asked


def plain(edges, start):
    out = {}
    for s, _ in edges:
        out[s] = out.get(s, 0) + 1
    x = {start: 1.0}
    for _ in range(STEPS):
        y = {start: 0.5}
        for s, t in edges:
            y[t] = y.get(t, 0.0) + 0.5 * x.get(s, 0.0) / out[s]
        x = y
    return x


@pytest.mark.parametrize("most", [resample.LINKS, 0])
def test_scores_of_asked_nodes_are_those_of_all_steps(spark, graph, monkeypatch, most):
    edges, df, pool, asked = graph
    monkeypatch.setattr(resample, "LINKS", most)
    got = resample.asked_scores(df, ["some", "every"], pool, 7, asked, 0.5, STEPS)
    starts = [r["node_id"] for r in pool.orderBy("position").collect()]
    for arm, at in (("some", 2), ("every", 3)):
        rows = {r["node_id"]: r["by_seed"] for r in got[arm].collect()}
        want = [plain([(e[0], e[1]) for e in edges if e[at]], s) for s in starts]
        for node in (r["node_id"] for r in asked.collect()):
            assert rows.get(node, [0.0] * 7) == pytest.approx([w.get(node, 0.0) for w in want], abs=1e-15)


def test_vectors_run_in_tasks_without_a_join_for_each_step(spark, graph, monkeypatch):
    _, df, pool, asked = graph
    monkeypatch.setattr(resample, "pagerank_vectors", lambda *a: pytest.fail("steps as joins"))
    resample.asked_scores(df, ["some"], pool, 7, asked, 0.5, STEPS)


def test_links_that_carry_nothing_are_left_out():
    blocks = [(np.array([0, 1, 2], np.int32), np.array([1, 2, 3], np.int32)), (np.array([1, 5, 6], np.int32), np.array([4, 1, 0], np.int32))]
    source, target = resample.carrying(blocks, np.array([0]), np.array([3]), 7, 9)
    assert list(zip(source, target)) == [(0, 1), (1, 2), (2, 3)]
    assert [len(x) for x in resample.carrying(blocks, np.array([3]), np.array([0]), 7, 9)] == [0, 0]


def test_tails_are_computed_once_for_a_size(monkeypatch):
    asked, tails = [], resample.tails
    monkeypatch.setattr(resample, "tails", lambda m, *a: (asked.extend(m), tails(m, *a))[1])
    value = resample.fisher_value([1.0, 1.0, 0.0], 50)
    sets, by_seed, size = np.array([[1, 0], [1, 1], [0, 1]], float), np.array([[1, 1, 0], [0, 0, 1], [1, 0, 0], [0, 1, 0]], float), np.array([8, 8, 9, 8])
    got = value(by_seed, size, sets)
    assert sorted(asked) == [8, 8, 9, 9]  # for one and for two drawn
    assert value(by_seed, size, sets) == pytest.approx(got) and len(asked) == 4
    want = [[tails(np.array([m]), 50, d)[0, int(h)] if 0 < h <= d else float(h == 0) for h, d in zip(b @ sets, (2, 1))] for b, m in zip(by_seed, size)]
    assert -got == pytest.approx(np.round(np.array(want), 12))
