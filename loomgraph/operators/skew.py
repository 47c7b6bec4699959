"""Per-key results when a few keys hold most rows: fragment-replicate by estimated load.

Keys are bin-packed to tasks by their measured load. A key above a task's fair piece is split into shards in
proportion to its load, each shard with a task of its own; rows of the key go to one shard each, and the rows of
the matching side with that key are replicated to its shards only. Light keys travel in hash buckets, so the
driver packs a bounded number of pieces, however many keys there are.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.session import stage

#: Pieces (light buckets, or heavy keys) a task gets on average; bounds what the driver packs per task.
BUCKETS_PER_TASK, PIECES_PER_TASK = 16, 4


@dataclass
class Placement:
    """``heavy``: keys, _shards array<int> of tasks; ``light``: _bucket, _task. Both have at most
    ``tasks * (BUCKETS_PER_TASK + PIECES_PER_TASK)`` rows, so they are broadcast."""

    keys: list[str]
    tasks: int
    buckets: int
    heavy: DataFrame
    light: DataFrame
    largest: float = 0.0

    def overfull(self) -> bool:
        """Whether a key alone has more than a task's fair share."""
        return self.largest > 1

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _placed(self, df: DataFrame) -> DataFrame:
        matched = [df[k].eqNullSafe(F.col(f"_h_{k}")) for k in self.keys]
        condition = matched[0]
        for m in matched[1:]:
            condition = condition & m
        heavy = self.heavy.select(*(F.col(k).alias(f"_h_{k}") for k in self.keys), "_shards")
        df = df.join(F.broadcast(heavy), condition, "left").drop(*(f"_h_{k}" for k in self.keys))
        return df.withColumn("_bucket", self._bucket()).join(F.broadcast(self.light), "_bucket", "left").drop("_bucket")

    def fragment(self, df: DataFrame, shard_by: list[Column]) -> DataFrame:
        """Every row goes to one shard of its key, chosen by the hash of ``shard_by``."""
        shard = F.when(F.col("_shards").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit(7), *shard_by), F.size("_shards").cast("long"))).cast("int")
        df = self._placed(df).withColumn("_shard", shard)
        return self._routed(df)

    def replicate(self, df: DataFrame) -> DataFrame:
        """Every row goes to all shards of its key: one for light keys."""
        df = self._placed(df)
        last = F.coalesce(F.size("_shards") - 1, F.lit(0))
        return self._routed(df.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.when(F.col("_shards").isNull(), 0).otherwise(last)))))

    def _routed(self, df: DataFrame) -> DataFrame:
        task = F.when(F.col("_shards").isNull(), F.col("_task")).otherwise(F.get("_shards", F.col("_shard")))
        return df.withColumn("_task", F.coalesce(task, F.lit(0)).cast("int")).drop("_shards").repartitionById(self.tasks, "_task")


def place(loads: DataFrame, keys: list[str], tasks: int | None = None) -> Placement:
    """Pack keys to tasks, longest pieces first. ``loads``: one row per key with its ``load`` (rows, exact or estimated)."""
    spark = loads.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = tasks * BUCKETS_PER_TASK
    total = loads.agg(F.sum("load").alias("n")).first()["n"] or 0
    piece = max(1, ceil(total / (tasks * PIECES_PER_TASK)))
    heavy = loads.filter(F.col("load") > piece).select(*keys, "load").collect()  # fewer than tasks * PIECES_PER_TASK
    light = (
        loads.filter(F.col("load") <= piece)
        .groupBy(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket"))
        .agg(F.sum("load").alias("load"))
        .collect()
    )
    pieces = [(row["load"] / n, "heavy", i, s) for i, row in enumerate(heavy) for n in [min(tasks, ceil(row["load"] / piece))] for s in range(n)]
    pieces += [(row["load"], "light", row["_bucket"], 0) for row in light]
    filled = [(0, t) for t in range(tasks)]
    shards: list[list[int]] = [[] for _ in heavy]
    of_bucket = {}
    for load, kind, which, _ in sorted(pieces, key=lambda p: (-p[0], p[1:])):
        at, task = heapq.heappop(filled)
        heapq.heappush(filled, (at + load, task))
        if kind == "heavy":
            shards[which].append(task)
        else:
            of_bucket[which] = task
    types = {f.name: f.dataType for f in loads.schema}
    schema = T.StructType([T.StructField(k, types[k]) for k in keys] + [T.StructField("_shards", T.ArrayType(T.IntegerType()))])
    heavy_df = spark.createDataFrame([(*(row[k] for k in keys), s) for row, s in zip(heavy, shards, strict=True)], schema)
    light_df = spark.createDataFrame([(b, of_bucket.get(b, b % tasks)) for b in range(buckets)], "_bucket int, _task int")
    return Placement(keys, tasks, buckets, heavy_df, light_df, max((row["load"] for row in heavy), default=0) * tasks / max(total, 1))


def key_profiles(edges: DataFrame, nodes: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per field and id: edges, distinct neighbours and predicates, and the id's rows in ``nodes``.

    ``edges`` (field, node_id, other, predicate) with a row per edge and end; ``nodes`` (node_id, n_node_rows) with a
    row per id. Null ``node_id`` rows are left out; a null ``other`` or ``predicate`` is no neighbour or predicate.
    Empty input gives an empty result; other columns are ignored. Repeated rows count as edges.
    """
    keys = ["field", "node_id"]
    ends = edges.filter(F.col("node_id").isNotNull()).select("field", "node_id", "other", "predicate")
    # parallel edges are added up before they travel, so loads are what is left of them; a key's shards get disjoint neighbours
    merged = stage(ends.groupBy("field", "node_id", "other", "predicate").agg(F.count("*").alias("n")), "merged")
    where = place(stage(merged.groupBy(*keys).agg(F.count("*").alias("load")), "loads"), keys, tasks)
    rows = where.fragment(merged, [F.col("other")])
    match = where.replicate(nodes.select(F.explode(F.array(F.lit("source"), F.lit("target"))).alias("field"), "node_id", "n_node_rows"))
    joined = rows.join(match.hint("shuffle_hash"), ["_task", "_shard", *keys], "left")
    shards = joined.groupBy("_task", "_shard", *keys).agg(
        F.sum("n").alias("n_edges"),
        F.count_distinct("other").alias("n_neighbours"),
        F.collect_set("predicate").alias("predicates"),
        F.max("n_node_rows").alias("n_node_rows"),
    )
    return shards.groupBy(*keys).agg(
        F.sum("n_edges").alias("n_edges"),
        F.sum("n_neighbours").alias("n_neighbours"),
        F.size(F.array_distinct(F.flatten(F.collect_list("predicates")))).cast("long").alias("n_predicates"),
        F.coalesce(F.max("n_node_rows"), F.lit(0)).cast("long").alias("n_node_rows"),
    )
