import random
from collections import defaultdict

from pyspark.sql import functions as F

from loomgraph.operators import skew


def brute(rows, nodes):
    out = defaultdict(lambda: [0, set(), set()])
    for field, node, other, pred in rows:
        if node is not None:
            x = out[field, node]
            x[0] += 1
            x[1] |= {other} - {None}
            x[2] |= {pred} - {None}
    return {k: (n, len(o), len(p), nodes.get(k[1], 0)) for k, (n, o, p) in out.items()}


def profiles(spark, rows, nodes, tasks=4):
    edges = spark.createDataFrame(rows, "field string, node_id string, other string, predicate string")
    n = spark.createDataFrame(list(nodes.items()), "node_id string, n_node_rows long")
    got = skew.key_profiles(edges.withColumn("n", F.lit(1)).withColumn("_task", F.lit(9)), n, tasks).collect()
    return {(r["field"], r["node_id"]): (r["n_edges"], r["n_neighbours"], r["n_predicates"], r["n_node_rows"]) for r in got}


def test_hubs_nulls_and_repeats(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(3000):
        node = "HUB" if rnd.random() < 0.4 else None if rnd.random() < 0.05 else f"K{rnd.randrange(300)}"
        other = None if rnd.random() < 0.1 else f"O{rnd.randrange(200)}"
        rows.append((rnd.choice(["source", "target"]), node, other, rnd.choice(["a", "b", None])))
    rows += [("source", "HUB", "O1", "a")] * 500
    nodes = {"HUB": 3, "K1": 2, "UNSEEN": 7}
    assert profiles(spark, rows, nodes) == brute(rows, nodes)


def test_empty_table(spark):
    assert profiles(spark, [], {"A": 1}) == {}


def test_a_heavy_key_is_split_and_tasks_are_even(spark):
    loads = spark.createDataFrame([("HUB", 9000)] + [(f"K{i}", 10) for i in range(900)], "k string, load long")
    p = skew.place(loads, ["k"], tasks=6)
    heavy = {r["k"]: list(r["_shards"]) for r in p.heavy.collect()}
    assert set(heavy) == {"HUB"} and len(set(heavy["HUB"])) > 2
    rows = spark.range(18000).select(F.when(F.col("id") < 9000, "HUB").otherwise(F.concat(F.lit("K"), (F.col("id") % 900).cast("string"))).alias("k"), F.col("id").alias("v"))
    sizes = [r["count"] for r in p.fragment(rows, [F.col("v")]).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 18000 and max(sizes) < 1.5 * 18000 / 6
    matched = p.fragment(rows, [F.col("v")]).join(p.replicate(loads), ["_task", "_shard", "k"])
    assert matched.count() == 18000
