"""Nulls of all registered permutations: counts, both ways of running them, and plain computations."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import many, nulls, propagate
from loomgraph.plans import reference

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["n2_seed_permutation_null", "n5_rewiring_null", "n7_member_mean_null"])
def test_thousand_permutations_of_every_pathway(spark, name):
    per = reference.QUERIES[name](spark, DATA).groupBy("pathway").agg(F.count_distinct("perm").alias("n"), F.count("*").alias("rows")).collect()
    assert per and {(r["n"], r["rows"]) for r in per} == {(1000, 1000)}


@pytest.fixture(scope="module")
def graph(spark):
    rnd = random.Random(5)
    edges = [(f"g{rnd.randrange(40)}", f"g{rnd.randrange(40)}", False) for _ in range(150)]
    edges += sorted({(f"g{rnd.randrange(40)}", f"w{rnd.randrange(12)}", True) for _ in range(150)}) + [("w1", "g3", False), ("w2", "g5", False)]
    rows = [(s, t, True, "Pathway Contribution" if b else "Other") for s, t, b in edges]
    kept = spark.createDataFrame(rows, "source string, target string, propagating boolean, flow_class string")
    pathways = spark.createDataFrame([(f"w{i}", i + 4) for i in range(13)], "pathway string, member_gene_count long")
    return kept, pathways


def values(df):
    return {(r["perm"], r["pathway"]): r["null"] for r in df.collect()}


def test_seed_null_in_tasks_equals_joins(spark, graph, monkeypatch):
    kept, pathways = graph
    moves = nulls.row_normalized(nulls.unit_operator(kept))
    drawn = nulls.draws(spark.createDataFrame([(f"g{i}",) for i in range(40)], "node_id string"), 5, 4)
    run = lambda: values(nulls.seed_permutation_null(moves, drawn, 5, pathways, 4, 0.5, 5))
    tasks = run()
    monkeypatch.setattr(many, "GRAPH_EDGES", 0)
    monkeypatch.setattr(nulls, "BATCH", 3)
    assert len(tasks) == 4 * 13 and tasks == pytest.approx(run(), abs=1e-12)


def test_rewiring_null_without_rounds_is_the_plain_score(spark, graph, monkeypatch):
    kept, pathways = graph
    seeds = spark.createDataFrame([("g1",), ("g2",)], "node_id string")
    nodes = kept.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    plain = {r["node_id"]: r["score"] for r in propagate.pagerank(nulls.row_normalized(nulls.unit_operator(kept)), seeds, nodes, iterations=5).collect()}
    want = {(p, f"w{i}"): plain.get(f"w{i}", 0.0) / (i + 4) ** 0.5 for p in range(2) for i in range(13)}
    run = lambda rounds: values(nulls.rewiring_null(kept, propagate.restart(seeds, nodes), pathways, 2, 0.5, 5, rounds))
    assert run(0) == pytest.approx(want, abs=1e-12)
    moved = run(10)
    assert {k[0] for k in moved} == {0, 1} and any(abs(moved[0, w] - moved[1, w]) > 1e-9 for _, w in moved)
    monkeypatch.setattr(many, "GRAPH_EDGES", 0)
    assert run(0) == pytest.approx(want, abs=1e-12)


def test_exchanges_keep_degrees_and_make_no_loops():
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 90, 900) * 100 + rng.integers(0, 100, 900))
    s, t = codes // 100, codes % 100
    s, t = s[s != t], t[s != t]
    new = many.exchanged(s, t, 100, 10, np.random.default_rng([42, 0]))
    assert sorted(new) == sorted(t) and (new != s).all() and len(set(zip(s, new))) == len(s)
    assert len(set(zip(s, new)) - set(zip(s, t))) > 300


def test_member_mean_null_is_the_mean_of_windows(spark, monkeypatch):
    import hashlib

    h = lambda *x: int(hashlib.md5("|".join(map(str, (42, *x))).encode()).hexdigest()[:15], 16)
    rnd = random.Random(8)
    stratum = {f"g{i}": f"d{rnd.randrange(3)}_m0" for i in range(30)}
    score = {g: rnd.random() for g in stratum if g != "g7"}  # g7 is off the graph: neither a member nor drawn
    member = [(f"w{w}", g) for w in range(4) for g in rnd.sample(sorted(stratum), 5 + w)] + [("off", "g7")]
    want = {}
    for p in range(5):
        rings = defaultdict(list)
        for g in sorted(score, key=lambda g: (h(p, g), g)):
            rings[stratum[g]].append(score[g])
        for w in range(4):
            taken = []
            for s, ring in rings.items():
                m = sum(1 for x, g in member if x == f"w{w}" and g in score and stratum[g] == s)
                taken += [ring[(h(p, f"w{w}", s) + k) % len(ring)] for k in range(m)]
            want[p, f"w{w}"] = sum(taken) / len(taken)
    tables = [spark.createDataFrame(member, "pathway string, gene string"), spark.createDataFrame(list(stratum.items()), "gene string, stratum string"), spark.createDataFrame(list(score.items()), "node_id string, score double")]
    assert values(nulls.member_mean_null(*tables, 5)) == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(many, "GRAPH_EDGES", 0)
    monkeypatch.setattr(nulls, "BATCH", 3)
    assert values(nulls.member_mean_null(*tables, 5)) == pytest.approx(want, abs=1e-12)


def test_propagation_in_parts_is_that_of_all_steps_on_all_transitions():
    rng = np.random.default_rng(1)
    source, target = rng.integers(0, 200, 2000), np.where(rng.random(2000) < 0.4, 7, rng.integers(50, 300, 2000))  # 7 is a hub; sources, sinks and nodes between
    share = rng.random(2000)
    share /= np.bincount(source, share, 300)[source]
    start = np.zeros((320, 3))  # the last are off the graph
    start[rng.integers(0, 320, 30), rng.integers(0, 3, 30)] = 0.1
    asked = np.arange(5, 320, 7)
    graph = many.Propagation(source, target, share, 320, asked, 0.5)
    for steps in (1, 2, 3, 4, 35):
        x = start
        for _ in range(steps):
            x = 0.5 * np.stack([np.bincount(target, share * x[source, i], 320) for i in range(3)], 1) + 0.5 * start
        want = x / x.sum(0)
        assert np.allclose(graph.run(start.copy(), steps), want[asked], rtol=0, atol=1e-15)
        assert np.allclose(many.propagated(source, target, share, start[:, 1], 0.5, steps), want[:, 1], rtol=0, atol=1e-15)
    assert not graph.run(np.zeros((320, 2)), 5).any()


def test_exchanges_are_those_of_the_plain_rule():
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 60, 601) * 70 + rng.integers(0, 70, 601))
    s, t = codes // 70, codes % 70
    want, draw = t.copy(), np.random.default_rng(9)
    for _ in range(8):
        order, half = draw.permutation(len(s)), len(s) // 2
        pairs = list(zip(order[:half], order[half : 2 * half]))
        made = [(s[i], want[j]) for i, j in pairs] + [(s[j], want[i]) for i, j in pairs]
        times, there = Counter(made), set(zip(s, want))
        ok = [not (a == b or (a, b) in there or times[a, b] > 1) for a, b in made]
        for k, (i, j) in enumerate(pairs):
            if ok[k] and ok[half + k]:
                want[i], want[j] = want[j], want[i]
    assert many.exchanged(s, t, 70, 8, np.random.default_rng(9)).tolist() == want.tolist()


def test_tasks_return_pathways_by_name_without_a_join(spark, graph):
    kept, pathways = graph
    moves = nulls.row_normalized(nulls.unit_operator(kept))
    drawn = nulls.draws(spark.createDataFrame([(f"g{i}",) for i in range(40)], "node_id string"), 5, 4)
    plan = nulls.seed_permutation_null(moves, drawn, 5, pathways, 4, 0.5, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_significance_propagates_over_the_conditioned_edges_only(spark, monkeypatch):
    """The result has nothing of the scores on all edges, so the driver plans no such steps."""
    g = reference.Graph(spark, DATA)
    observed = reference.scoring.tested_scores(g.sized, g.cond_scores).collect()
    want = {r["pathway"]: r for r in reference.scoring.pathway_scores(g.sized.select("pathway").distinct(), g.sized, g.cond_scores, g.cond_scores, g.kept).collect()}
    assert len(observed) == len(want) > 0
    for r in observed:
        assert (r["degree_norm"], r["member_mean"]) == pytest.approx((want[r["pathway"]]["degree_norm"], want[r["pathway"]]["member_mean"]), abs=1e-15)
    monkeypatch.setattr(reference.Graph, "raw_scores", property(lambda self: pytest.fail("propagation over all edges")))
    monkeypatch.setattr(reference, "PERMUTATIONS", 3)
    assert reference.ON_GRAPH["n12_significance"](g) is not None
