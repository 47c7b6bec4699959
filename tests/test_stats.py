import math
import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import stats
from loomgraph.functions.running import running_sums
from loomgraph.functions.scalars import hypergeometric_tail, log_factorial
from loomgraph.operators import enrich, nulls, resample, scoring


def test_log_factorial(spark):
    rows = spark.range(0, 200).select("id", log_factorial(F.col("id")).alias("v")).collect()
    assert all(r["v"] == pytest.approx(math.lgamma(r["id"] + 1), abs=1e-9, rel=1e-11) for r in rows)


def test_hypergeometric_tail(spark):
    cases = [(k, n, m, d) for n in (5, 20, 60) for m in (0, 1, n // 2, n) for d in (0, 1, n // 3, n) for k in (0, 1, 2, 5)]
    rows = spark.createDataFrame(cases, "k long, n long, m long, d long").select("*", hypergeometric_tail(F.col("k"), F.col("n"), F.col("m"), F.col("d")).alias("p")).collect()
    for r in rows:
        k, n, m, d = r["k"], r["n"], r["m"], r["d"]
        want = sum(math.comb(m, i) * math.comb(n - m, d - i) for i in range(max(k, 0), min(m, d) + 1) if d - i <= n - m) / math.comb(n, d)
        assert r["p"] == pytest.approx(want, abs=1e-10)


def bh(ps):
    known = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    out, low = [None] * len(ps), 1.0
    for rank in range(len(known), 0, -1):
        p, i = known[rank - 1]
        low = min(low, p * len(known) / rank)
        out[i] = low
    return out


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.sampled_from([0.0, 0.01, 0.02, 0.5, 1.0]), st.floats(0, 1)), min_size=1, max_size=30))
def test_false_discovery(spark, ps):
    df = spark.createDataFrame([(i, "g", p) for i, p in enumerate(ps)], "i int, g string, p double")
    got = {r["i"]: r["q"] for r in stats.benjamini_hochberg(df, "p", ["g"]).collect()}
    want = bh(ps)
    for i, p in enumerate(ps):
        assert (got[i] is None) == (p is None)
        if p is not None:
            assert got[i] == pytest.approx(min(want[j] for j, o in enumerate(ps) if o == p)) and got[i] <= 1


def test_auroc_and_auprc_with_ties(spark):
    rnd = random.Random(1)
    rows = [(f"n{i}", rnd.choice([0.0, 0.1, 0.5, rnd.random()]), rnd.random() < 0.2) for i in range(200)]
    r = stats.roc_and_precision(spark.createDataFrame(rows, "node_id string, s double, y boolean"), "s", F.col("y")).first()
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    assert r["auroc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    ap = sum(sum(p == t for p in pos) * sum(p >= t for p in pos) / sum(s >= t for _, s, _ in rows) for t in {s for _, s, _ in rows}) / len(pos)
    assert r["auprc"] == pytest.approx(ap)
    one = stats.roc_and_precision(spark.createDataFrame(rows[:0] + [("a", 0.1, True)], "node_id string, s double, y boolean"), "s", F.col("y")).first()
    assert one["auroc"] is None and one["auprc"] is None


def test_ranking_metrics(spark):
    rows = [("g", i, i in (1, 3)) for i in range(1, 8)] + [("none", i, False) for i in range(1, 4)]
    got = {r["g"]: r for r in stats.ranking_metrics(spark.createDataFrame(rows, "g string, rank int, y boolean"), ["g"], F.col("y"), (2, 10)).collect()}
    g = got["g"]
    assert (g["p_at_2"], g["p_at_10"], g["recall_at_2"], g["mean_rank"]) == (0.5, 0.2, 0.5, 2.0)
    assert g["ap"] == pytest.approx((1 + 2 / 3) / 2)
    assert g["ndcg_at_2"] == pytest.approx(1 / (1 + 1 / math.log2(3)))
    assert g["enrich_at_2"] == pytest.approx(0.5 / (2 / 7))
    n = got["none"]
    assert (n["ap"], n["ndcg_at_2"], n["recall_at_2"], n["enrich_at_2"], n["mean_rank"]) == (0.0, 0.0, 0.0, None, None)


def test_ranks_of_a_group_over_many_partitions(spark):
    rows = [("hot", (i * 7919) % 3001, i) for i in range(3001)] + [(f"g{i % 50}", i % 7, i) for i in range(500)] + [(None, i % 3, i) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    order = [F.desc("v"), F.asc("i")]
    a = stats.ranked_by_range(df, ["g"], order)
    assert a.exceptAll(stats.ranked(df, ["g"], order)).count() == 0 and a.count() == len(rows)


def test_empirical(spark):
    nul = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0)] + [("b", 0.0)] * 3 + [("c", 2.0)] * 2, "k string, null double")
    obs = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 2.0), ("d", 1.0)], "k string, observed double")
    got = {r["k"]: r for r in stats.empirical(nul, obs, "k").collect()}
    assert got["a"]["empirical_p"] == 0.5 and got["a"]["null_z"] == pytest.approx(1 / math.sqrt(2 / 3))
    assert not got["b"]["calibrated"] and got["b"]["empirical_p"] is None and got["b"]["null_z"] is None
    assert got["c"]["null_z"] == 0.0 and set(got) == {"a", "b", "c"}


def test_running_sums(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 as v")
    out = sorted((r["v"], r["s"]) for r in running_sums(df, [F.asc("v")], {"s": F.col("v")}).collect())
    assert [s for _, s in out] == [sum(range(i + 1)) for i in range(1000)]


def gsea(ranked, scores, members):
    total = sum(scores[g] for g in members)
    run, best, at, lead = 0.0, 0.0, 0, 0
    hits = 0
    for g in ranked:
        if g in members:
            run += scores[g] / total if total else 1 / len(members)
            hits += 1
        else:
            run -= 1 / (len(ranked) - len(members))
        if abs(run) > abs(best) + 1e-12:
            best, lead = run, hits
    return best, lead / len(members)


def test_preranked_equals_the_whole_walk(spark):
    rnd = random.Random(2)
    genes = [f"g{i:03d}" for i in range(80)]
    scores = {g: rnd.choice([0.0, rnd.random()]) for g in genes}
    sets = {f"w{k}": set(rnd.sample(genes, rnd.randrange(1, 30))) for k in range(25)} | {"zero": {g for g in genes if scores[g] == 0.0}}
    members = spark.createDataFrame([(w, g) for w, s in sets.items() for g in s], "pathway string, gene string")
    table = spark.createDataFrame(list(scores.items()), "node_id string, score double")
    ranked = sorted(genes, key=lambda g: (-scores[g], g))
    for r in enrich.preranked(members, table, table.select("node_id")).collect():
        es, lead = gsea(ranked, scores, sets[r["pathway"]])
        assert (r["es"], r["leading_edge"]) == (pytest.approx(es, abs=1e-9), pytest.approx(lead)), r["pathway"]


def test_rewiring_keeps_degrees_and_makes_no_loops(spark):
    rnd = random.Random(3)
    edges = sorted({(f"g{rnd.randrange(60)}", f"w{rnd.randrange(40)}") for _ in range(600)})
    df = spark.createDataFrame(edges, "source string, target string")
    new = [(r["source"], r["target"]) for r in nulls.rewire(df, rounds=4).collect()]
    assert len(set(new)) == len(edges) and len(set(new) - set(edges)) > 100
    for i in (0, 1):
        assert sorted(e[i] for e in new) == sorted(e[i] for e in edges)


def test_draws(spark):
    universe = spark.range(5000).selectExpr("cast(id as string) node_id")
    got = nulls.draws(universe, 10, 6).collect()
    by = {p: {r["node_id"] for r in got if r["perm"] == p} for p in range(6)}
    assert all(len(s) == 10 for s in by.values()) and len(set().union(*by.values())) > 50
    assert nulls.draws(spark.range(4).selectExpr("cast(id as string) node_id"), 10, 1).count() == 4


def test_member_mean_null_draws_within_strata(spark):
    strata = spark.createDataFrame([(f"a{i}", "s1") for i in range(10)] + [(f"b{i}", "s2") for i in range(10)], "gene string, stratum string")
    scores = spark.createDataFrame([(f"a{i}", 1.0) for i in range(10)] + [(f"b{i}", 3.0) for i in range(10)], "node_id string, score double")
    members = spark.createDataFrame([("w", "a1"), ("w", "a2"), ("w", "b1"), ("w", "b2"), ("v", "a3")], "pathway string, gene string")
    got = {(r["perm"], r["pathway"]): r["null"] for r in nulls.member_mean_null(members, strata, scores, 5).collect()}
    assert got == {(p, w): (2.0 if w == "w" else 1.0) for p in range(5) for w in ("w", "v")}


def test_splits_and_bootstrap(spark):
    assert sorted(tuple(p) for _, p in resample.splits(6, 4)) == sorted(combinations(range(6), 4))
    assert all(bin(s).count("1") == 4 and all(s >> i & 1 for i in p) for s, p in resample.splits(6, 4))
    boots = resample.bootstrap(spark, 15, [3, 5, 99], 20)
    assert len(boots) == 41 and boots[0] == (-1, list(range(15))) and all(len(set(p)) == [3, 5][s % 2] for s, p in boots[1:])
    assert boots == resample.bootstrap(spark, 15, [3, 5, 99], 20)


def test_tails_of_all_overlaps():
    for n, d in ((20, 6), (60, 10), (9, 9)):
        table = resample.tails(np.arange(0, n + 1), n, d)
        for m in range(n + 1):
            want = [sum(math.comb(m, i) * math.comb(n - m, d - i) for i in range(k, min(m, d) + 1) if d - i <= n - m) / math.comb(n, d) for k in range(d + 1)]
            assert table[m] == pytest.approx(want, abs=1e-10)


def test_ranks_by_counting_equal_sorted_lists(spark):
    rnd = random.Random(11)
    items = [(f"w{i:03d}", [float(rnd.choice([0, 0, 1, rnd.random()])) for _ in range(5)], float(rnd.randrange(1, 9))) for i in range(200)]
    sets = resample.splits(5, 3)
    asked = ["w003", "w150", "w199", "absent"]
    df = spark.createDataFrame(items, "key string, by_seed array<double>, size double").repartition(3)
    got = {(r["split"], r["key"]): r["n"] for r in resample.ahead(df, sets, 5, asked, resample.mean_score).collect()}
    for split, positions in sets:
        value = {k: round(sum(x[i] for i in positions) / 3 / math.sqrt(s) * 1e9) for k, x, s in items}
        ranked = sorted(value, key=lambda k: (-value[k], k))
        assert all(got[split, k] == ranked.index(k) for k in asked[:3])
    held = {r["split"]: r["gene_auprc"] for r in resample.held_out_precision(df.withColumn("size", F.lit(1.0)), sets, ["w000", "w001", "w002", "w003", "w004"]).collect()}
    pool = [f"w{i:03d}" for i in range(5)]
    for split, positions in sets:
        value = {k: round(sum(x[i] for i in positions) / 3 * 1e9) for k, x, _ in items}
        out = [p for i, p in enumerate(pool) if i not in positions]
        order = sorted((k for k in value if k not in pool or k in out), key=lambda k: (-value[k], k not in out))
        hits = [order.index(p) + 1 for p in out]
        assert held[split] == pytest.approx(sum(j / r for j, r in enumerate(sorted(hits), 1)) / len(hits))


def test_draws_that_a_cutoff_leaves_short_are_drawn_again(spark, monkeypatch):
    universe = spark.range(3000).selectExpr("cast(id as string) node_id")
    want = nulls.draws(universe, 12, 5).orderBy("perm", "node_id").collect()
    real = nulls.seeded_hash
    monkeypatch.setattr(nulls, "seeded_hash", lambda *a: F.when(F.col("perm") == 2, real(*a) % (1 << 30) + (1 << 59)).otherwise(real(*a)))
    got = nulls.draws(universe, 12, 5).orderBy("perm", "node_id").collect()
    assert [r for r in got if r["perm"] != 2] == [r for r in want if r["perm"] != 2] and sum(r["perm"] == 2 for r in got) == 12


def test_best_neighbours_of_a_hub(spark):
    rows = [("hub", f"n{i:04d}", float(i % 50)) for i in range(2000)] + [("w", "n1", 1.0)]
    got = scoring.best_neighbours(spark.createDataFrame(rows, "pathway string, node_id string, score double"), 7).collect()
    assert {(r["pathway"], r["node_id"]) for r in got} == {("hub", k) for _, k in sorted((-s, n) for p, n, s in rows if p == "hub")[:7]} | {("w", "n1")}


def test_pathway_scores_edge_cases(spark):
    scores = spark.createDataFrame([("w", 0.4), ("g1", 0.2), ("g2", 0.1), ("n", 0.3)], "node_id string, score double")
    members = spark.createDataFrame([("w", "g1"), ("w", "g2"), ("w", "off")], "pathway string, gene string")
    kept = spark.createDataFrame([("g1", "w"), ("g1", "w"), ("w", "n"), ("x", "y")], "source string, target string")
    pathways = spark.createDataFrame([("w",), ("lonely",)], "pathway string")
    got = {r["pathway"]: r for r in scoring.pathway_scores(pathways, members, scores, scores, kept).collect()}
    w = got["w"]
    assert (w["member_gene_count"], w["degree"]) == (3, 3)
    assert w["member_mean"] == pytest.approx(0.15) and w["member_max"] == 0.2
    assert w["degree_norm"] == pytest.approx(0.4 / math.sqrt(3)) and w["local_bg"] == pytest.approx(0.4 - (0.2 + 0.2 + 0.3) / 3)
    assert tuple(got["lonely"][c] for c in ("direct", "degree_norm", "member_mean", "degree")) == (0.0, 0.0, 0.0, 0)
    assert not any(r["degree_flag"] for r in scoring.degree_flags(spark.createDataFrame([("a", 9)], "pathway string, degree int")).collect())
