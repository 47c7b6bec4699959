"""Hand-made graphs for the rules of typing, conditioning and propagation."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.scalars import by_rules, edge_weight, first_non_empty, safe_double
from loomgraph.operators import conditioning as c
from loomgraph.operators import propagate

NODES = "row_id long, node_id string, label string, name string, sab string"
EDGES = "source string, target string, predicate string, confidence string, value string, evidence_type string"


@pytest.fixture(scope="module")
def rules(spark):
    return c.Rules.of(
        spark,
        {"HGNC": "G", "MSIGDB": "PW", "UNIPROTKB": "P", "MONDO": "DS", "GCO": "S"},
        [(r"HP:\d+", "PH"), (r"H", "X")],
        ["DS", "PH", "PW", "P", "G", "S", "X"],
        ["is_a", "both"],
        ["seen_with", "listed", "both"],
        [("acts", "Flow", "mechanistic"), ("weak", "Flow", "weak_mechanistic_or_observational"), ("ctx", "Flow", "contextual_constraint"), ("listed", "Flow", "mechanistic")],
        [("acts", "P", "PW", "Over", "mechanistic"), ("only_pair", "P", "PW", "Pair", "mechanistic"), ("listed", "P", "PW", "Never", "mechanistic")],
        ["GCO"],
    )


def test_entities(spark, rules):
    rows = [
        (1, "g", "Concept", "", "HGNC"), (2, "w", "CONCEPT", "", "MSIGDB"), (3, "w", "code", "", "HGNC"), (4, "HP:1", "Concept", "", None), (5, "Hx", "Concept", "", "ZZ"),
        (6, "q", "Concept", "", "ZZ"), (7, "t", "Term", "", "HGNC"), (8, "ENSEMBL:ENSP1", "Code", "", "ENSEMBL"), (9, "ENSEMBL:ENST1", "Code", "", "ENSEMBL"), (10, "ENSEMBL:ENSG1", "Code", "", "ENSEMBL"),
        (11, "i", "Concept", "", "GCO"),
    ]
    got = {r["node_id"]: r["entity"] for r in c.node_entities(spark.createDataFrame(rows, NODES), rules).collect()}
    assert got == {"g": "G", "w": "PW", "HP:1": "PH", "Hx": "X", "q": None, "ENSEMBL:ENSP1": "P", "ENSEMBL:ENST1": "RNA", "ENSEMBL:ENSG1": "G", "i": None}


def test_go_terms(spark, rules):
    cases = [
        ("biological_process", "x", "PW"), ("molecular function of y", "x", "PW"), ("cellular_component", "a complex", "CM"), ("cellular_component", "x", "S"), ("go_process", "x", "PW"),
        ("complex", "x", "CM"), ("cc", "x", "S"), ("odd", "membrane", None), ("", "Protein Complex", "CM"), (None, "outer membrane", "S"), (None, "x", None), (None, None, None),
    ]
    df = spark.createDataFrame([c_[:2] for c_ in cases], "ns string, name string")
    assert [r[0] for r in df.select(c.go_entity(F.col("ns"), F.col("name"))).collect()] == [x[2] for x in cases]
    rows = [
        (1, "GO:1", "Code", "x", "MSIGDB"), (2, "GO:2", "Code", "outer membrane", "GO"), (3, "GO:3", "Concept", "a complex", "MSIGDB"), (4, "q", "Concept", "protein complex", "GOCC"), (5, "GO:5", "Code", "x", "GO"),
        (6, "GO:6", "Concept", None, "GO"),
    ]
    nodes = spark.createDataFrame(rows, NODES)
    ontology = spark.createDataFrame([("GO:1", "complex"), ("GO:3", "cc")], "accession string, namespace string")
    got = {r["node_id"]: r["entity"] for r in c.row_entities(nodes, rules, ontology).collect()}
    assert got == {"GO:1": "CM", "GO:2": "S", "GO:3": "PW", "q": "CM", "GO:5": "PW", "GO:6": "PW"}


def test_codes_type_their_parents(spark, rules):
    rows = [(1, "HGNC:1", "Code", "", "HGNC", "C1"), (2, "MSIGDB:2", "code", "", "MSIGDB", "C1"), (3, "X:1", "Code", "", "ZZ", "C2"), (4, "C3", "Concept", "", "HGNC", None), (5, "HGNC:9", "Code", "", "HGNC", "")]
    nodes = spark.createDataFrame(rows, NODES + ", parent_id string")
    assert {r["node_id"]: r["entity"] for r in c.node_entities(nodes, rules).collect()} == {"C1": "PW", "C2": None}


def test_ensembl_ids_without_a_known_prefix_go_by_the_rules(spark, rules):
    nodes = spark.createDataFrame([(1, "ENSEMBL:ENSG1", "Code", "", "ENSEMBL"), (2, "Hx", "Code", "", "ENSEMBL"), (3, "ENSEMBL:X", "Code", "", "ENSEMBL")], NODES)
    assert {r["node_id"]: r["entity"] for r in c.node_entities(nodes, rules).collect()} == {"ENSEMBL:ENSG1": "G", "Hx": "X", "ENSEMBL:X": None}


def conditioned(spark, rules, edges):
    nodes = [(1, "g", "Concept", "", "HGNC"), (2, "p", "Concept", "", "UNIPROTKB"), (3, "w", "Concept", "", "MSIGDB"), (4, "u", "Concept", "", "ZZ")]
    entities = c.node_entities(spark.createDataFrame(nodes, NODES), rules)
    e = spark.createDataFrame([(s, t, p, None, None, None) for s, t, p in edges], EDGES)
    return c.condition_edges(e, entities, rules)


def test_precedence(spark, rules):
    cases = [
        ("p", "w", "acts", "Over", None, True),
        ("g", "w", "acts", "Flow", None, True),
        ("g", "p", "weak", "Flow", None, True),
        ("g", "p", "ctx", "Flow", None, False),
        ("p", "w", "only_pair", "Pair", None, True),
        ("g", "w", "only_pair", None, "unmapped", False),
        ("p", "w", "listed", c.OBSERVED, None, False),
        ("g", "p", "is_a", None, "non_flow", False),
        ("g", "p", "both", None, "non_flow", False),
        ("g", "u", "is_a", None, "unresolved", False),
        ("g", "u", "nothing", None, "unresolved", False),
        ("g", "p", "nothing", None, "unmapped", False),
        ("g", "p", None, None, "unmapped", False),
        ("g", "elsewhere", "acts", "gone", "gone", False),
    ]
    got = {(r["source"], r["target"], r["predicate"]): (r["flow_class"], r["drop_reason"], r["propagating"]) for r in conditioned(spark, rules, [x[:3] for x in cases]).collect()}
    assert got == {x[:3]: x[3:] for x in cases if x[3] != "gone"}


def test_kept_and_dropped_add_up(spark, rules):
    all_ = conditioned(spark, rules, [("g", "p", "acts")] * 3 + [("g", "p", "is_a")] * 2)
    f = {r["outcome"]: r["n"] for r in c.funnel(all_).collect()}
    assert f == {"kept: mechanistic": 3, "dropped: non_flow": 2}
    assert c.kept(all_).count() == 3 and c.mechanistic(c.kept(all_)).count() == 3


def test_parallel_edges_add_up_and_rows_sum_to_one(spark, rules):
    e = spark.createDataFrame([("a", "b", "x", None, None, None)] * 3 + [("a", "c", "x", "0.5", None, None), ("b", "c", "x", None, "2", None), ("c", "d", "x", "bad", None, "Curated ")], EDGES)
    w = {(r["src"], r["dst"]): r["w"] for r in c.weighted_operator(e).collect()}
    assert w == {("a", "b"): 1.5, ("a", "c"): 0.5, ("b", "c"): 2.0, ("c", "d"): 0.75}
    p = {(r["src"], r["dst"]): r["p"] for r in c.row_normalized(c.unit_operator(e)).collect()}
    assert p == {("a", "b"): 0.75, ("a", "c"): 0.25, ("b", "c"): 1.0, ("c", "d"): 1.0}


def test_sparsify_takes_exactly_n(spark):
    e = spark.range(100).selectExpr("cast(id as string) k")
    assert c.sparsify(e, 17, ["k"]).count() == 17
    assert c.sparsify(e, 17, ["k"]).exceptAll(c.sparsify(e, 17, ["k"])).count() == 0


def pagerank_by_hand(edges, seeds, alpha, steps, normalize):
    nodes = sorted({x for e in edges for x in e} | set(seeds))
    out = {n: [t for s, t in edges if s == n] for n in nodes}
    s = {n: (1 / len(seeds) if n in seeds else 0) for n in nodes}
    f = dict(s)
    for _ in range(steps):
        g = {n: alpha * s[n] for n in nodes}
        for n in nodes:
            for t in out[n]:
                g[t] += (1 - alpha) * f[n] / len(out[n])
        f = g
    total = sum(f.values()) if normalize else 1
    return {n: v / total for n, v in f.items() if v > 0}


@pytest.mark.parametrize(("normalize", "rows"), [(True, 50_000), (False, 50_000), (True, 3)])
def test_pagerank(spark, monkeypatch, normalize, rows):
    monkeypatch.setattr(propagate, "PART_ROWS", rows)
    edges = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "a")]
    e = spark.createDataFrame([(s, t, "x", None, None, None) for s, t in edges], EDGES)
    moves = c.row_normalized(c.unit_operator(e))
    graph = e.select(F.explode(F.array("source", "target")).alias("node_id"))
    seeds = spark.createDataFrame([("a",), ("a",), ("e",), ("absent",)], "node_id string")
    got = {r["node_id"]: r["score"] for r in propagate.pagerank(moves, seeds, graph, normalize=normalize).collect()}
    assert got == pytest.approx(pagerank_by_hand(edges, ["a", "e"], 0.5, propagate.steps_for(0.5), normalize), abs=1e-12)
    if normalize:
        assert sum(got.values()) == pytest.approx(1)


@pytest.mark.parametrize("rows", [40, 50_000])
def test_pagerank_with_a_hub(spark, monkeypatch, rows):
    monkeypatch.setattr(propagate, "PART_ROWS", rows)
    edges = [("hub", f"n{i}") for i in range(120)] + [(f"n{i}", "hub") for i in range(0, 120, 3)] + [("n1", "n2")]
    e = spark.createDataFrame([(s, t, "x", None, None, None) for s, t in edges], EDGES)
    moves = c.row_normalized(c.unit_operator(e))
    restarts = spark.createDataFrame([("hub", 1.0)], "node_id string, score double")
    got = {r["node_id"]: r["score"] for r in propagate.pagerank_vectors(moves, restarts, ["score"]).collect()}
    assert got == pytest.approx(pagerank_by_hand(edges, ["hub"], 0.5, propagate.steps_for(0.5), False), abs=1e-12)


def test_many_restarts_are_linear(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "a")]
    e = spark.createDataFrame([(s, t, "x", None, None, None) for s, t in edges], EDGES)
    moves = c.row_normalized(c.unit_operator(e))
    restarts = spark.createDataFrame([("a", 1.0, 0.0, 0.5), ("d", 0.0, 1.0, 0.5)], "node_id string, x double, y double, z double")
    for r in propagate.pagerank_vectors(moves, restarts, ["x", "y", "z"]).collect():
        assert r["z"] == pytest.approx((r["x"] + r["y"]) / 2, abs=1e-14)


@pytest.mark.parametrize("alpha", [0.15, 0.5, 0.9])
def test_the_tolerance_holds_after_its_steps(alpha):
    """On a cycle and a chain that ends, changes of a step shrink by 1 - alpha at best."""
    steps = propagate.steps_for(alpha, 1e-10)
    for edges in ([("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("a", "c")]):
        f, g = (pagerank_by_hand(edges, ["a"], alpha, k, False) for k in (steps, steps + 1))
        assert sum(abs(g[n] - f.get(n, 0.0)) for n in g) < 1e-10
    assert propagate.steps_for(0.5, 1e-10) == 35 and propagate.steps_for(1e-9) == 500


def test_a_run_without_seeds_fails(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "node_id string")
    propagate.require(ids("a", "b"), ids("b"), "seed")
    with pytest.raises(ValueError, match="seed"):
        propagate.require(ids("a"), ids("b"), "seed")


def test_scalar_rules(spark):
    df = spark.createDataFrame([("", "b", "c"), (None, "", "c"), ("a", None, None), (None, None, None)], "x string, y string, z string")
    assert [r[0] for r in df.select(first_non_empty(F.col("x"), F.col("y"), F.col("z"))).collect()] == ["b", "c", "a", None]
    nums = spark.createDataFrame([(v,) for v in ["1.5", " 2e3 ", "-.5", "x", "", "NaN", "1e999", None, "0x1"]], "v string")
    assert [r[0] for r in nums.select(safe_double(F.col("v"))).collect()] == [1.5, 2000.0, -0.5, None, None, None, None, None, None]
    ids = spark.createDataFrame([("ENSG1",), ("xENSG1",), (None,)], "v string")
    assert [r[0] for r in ids.select(by_rules(F.col("v"), [("ENSG", "G"), ("E", "Y")])).collect()] == ["G", None, None]
    w = spark.createDataFrame([("0.2", "9", "curated"), ("", "3", "curated"), (None, None, "EXPERIMENTAL"), (None, None, "odd"), (None, None, None), ("bad", "9", "curated"), (" ", "9", None)], "c string, v string, e string")
    assert [r[0] for r in w.select(edge_weight(F.col("c"), F.col("v"), F.col("e"))).collect()] == [0.2, 3.0, 1.0, 0.5, 0.5, 0.75, 9.0]
