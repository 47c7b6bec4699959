"""Propagation: personalized PageRank as joins and aggregations, for one or many restart vectors at once."""

from __future__ import annotations

from math import ceil, log

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.skew import place
from loomgraph.session import settings, stage

ALPHA, TOLERANCE, MOST_STEPS = 0.5, 1e-10, 500
#: Steps between two written tables; so many joins are planned as one job.
CUT_EVERY = 5
#: Transitions of a partition: a small graph gets fewer partitions than Spark's default, a large one all of them.
PART_ROWS = 50_000

def steps_for(alpha: float, tolerance: float = TOLERANCE, most: int = MOST_STEPS) -> int:
    """Steps after which no vector changes by ``tolerance`` in sum, whatever the graph.

    As rows of transitions sum to at most 1, the change of a step is at most 1 - alpha times that of the step before, and the
    first one is at most 2 (1 - alpha) for a restart mass of 1.
    """
    if not 0 < alpha < 1:
        return 1 if alpha >= 1 else most
    return max(1, min(most, ceil(log(tolerance / 2) / log(1 - alpha))))


def pagerank_vectors(transitions: DataFrame, restarts: DataFrame, vectors: list[str], alpha: float = ALPHA, iterations: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(node_id, *vectors) after ``iterations`` steps f <- (1 - alpha) P'f + alpha s, without rescaling; by default as many as
    ``tolerance`` needs on any graph (``steps_for``), so no job has to look whether it is reached.

    ``transitions`` (src, dst, p) with row sums of at most 1; ``restarts`` (node_id, *vectors) with a restart mass of at most 1.
    Transitions are partitioned by source once, and a step's sums are partitioned alike, so a step has one exchange: one
    partial sum per target and task. A source with much of the graph is split into shards by target. Mass of nodes without
    outgoing transitions is lost; null ends match nothing.
    """
    iterations = iterations or steps_for(alpha, tolerance)
    transitions, restarts = stage(transitions, "transitions"), stage(restarts, "restarts")
    parts = min(int(transitions.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + transitions.count() // PART_ROWS)
    where = place(stage(transitions.groupBy("src").agg(F.count("*").alias("load")), "loads"), ["src"], parts) if parts > 1 else None
    hubs = where is not None and where.overfull()
    moves = where.fragment(transitions, [F.col("dst")]) if hubs else transitions.repartition(parts, "src")
    moves = moves.persist(StorageLevel.MEMORY_AND_DISK)

    def step_from(scores: DataFrame) -> DataFrame:
        sent = scores.withColumnRenamed("node_id", "src")
        if hubs:
            return moves.join(where.replicate(sent).hint("shuffle_hash"), ["_task", "_shard", "src"])
        return moves.join(sent.hint("shuffle_hash"), "src")

    jump = restarts.select("node_id", *((alpha * F.col(v)).alias(v) for v in vectors))
    scores = restarts
    # the plan of a step is known: sums in as many partitions as transitions are in, nothing to adapt
    with settings(transitions.sparkSession, {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.enabled": "false"}):
        for step in range(1, iterations + 1):
            moved = step_from(scores).select(F.col("dst").alias("node_id"), *(((1 - alpha) * F.col("p") * F.col(v)).alias(v) for v in vectors))
            scores = moved.unionByName(jump).groupBy("node_id").agg(*(F.sum(v).alias(v) for v in vectors))
            if step % CUT_EVERY == 0 or step == iterations:
                scores = stage(scores, "scores")
    moves.unpersist()
    return scores


def require(ids: DataFrame, graph_nodes: DataFrame, what: str) -> None:
    """Fails if none of ``ids`` is in the graph: a run without them would say nothing."""
    if ids.select("node_id").join(graph_nodes.select("node_id"), "node_id", "left_semi").isEmpty():
        raise ValueError(f"no {what} node is in the graph")


def restart(seeds: DataFrame, graph_nodes: DataFrame) -> DataFrame:
    """(node_id, score): equal mass on the distinct seeds that are in the graph."""
    inside = seeds.select("node_id").distinct().join(graph_nodes.select("node_id").distinct(), "node_id", "left_semi")
    n = inside.agg(F.count("*").alias("n"))
    return inside.join(F.broadcast(n)).select("node_id", (1.0 / F.col("n")).alias("score"))


def pagerank(transitions: DataFrame, seeds: DataFrame, graph_nodes: DataFrame, alpha: float = ALPHA, iterations: int | None = None, normalize: bool = True, tolerance: float = TOLERANCE) -> DataFrame:
    """(node_id, score) of one restart vector; ``normalize`` rescales to a sum of 1. No seed in the graph: empty result."""
    scores = pagerank_vectors(transitions, restart(seeds, graph_nodes), ["score"], alpha, iterations, tolerance)
    if not normalize:
        return scores
    total = scores.agg(F.sum("score").alias("_total"))
    return scores.join(F.broadcast(total)).select("node_id", (F.col("score") / F.col("_total")).alias("score"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("source").alias("node_id")).agg(F.count("*").alias("degree"))
