"""Resampling of seeds: all splits of a pool, and bootstrap draws, by the linearity of propagation.

The score of a seed set is the mean of its seeds' scores, so a pool of n seeds costs n restart vectors, run as columns of
one propagation, however many sets are asked for. Lists are not sorted: tasks multiply their items' scores with all sets
and count, for each item whose rank is asked for, the items ahead of it; only counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.scalars import seeded_hash
from loomgraph.functions.stats import ranking_metrics
from loomgraph.operators.conditioning import row_normalized, unit_operator
from loomgraph.operators.propagate import pagerank_vectors
from loomgraph.session import numbered, settings, stage

#: Links that a task holds, about 25 bytes each while they arrive.
LINKS = 12_000_000
LINK, NODE, ASKED = range(3)


def splits(pool: int, chosen: int) -> list[tuple[int, list[int]]]:
    """(split, positions): every choice of ``chosen`` out of ``pool`` positions; the set bits of the split's number."""
    return sorted((sum(1 << i for i in c), list(c)) for c in combinations(range(pool), chosen))


def pool_scores(transitions: DataFrame, pool: DataFrame, n: int, alpha: float, iterations: int) -> DataFrame:
    """(node_id, by_seed array<double>): scores of each single seed; ``pool`` (position, node_id)."""
    names = [f"s{i}" for i in range(n)]
    restarts = pool.groupBy("node_id").agg(*(F.max(F.when(F.col("position") == i, 1.0).otherwise(0.0)).alias(v) for i, v in enumerate(names)))
    scores = pagerank_vectors(transitions, restarts, names, alpha, iterations)
    return scores.select("node_id", F.array(*names).alias("by_seed"))


def links_between(edges: DataFrame, arms: list[str], pool: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, *arms): ``edges`` (source, target, and for each arm whether the edge is in it) with numbers for ids; and (node_id, id, asked,
    *arms: number of the node's edges out of it).

    Only nodes with edges into and out of them, the pool and those in ``asked`` (node_id) have numbers: edges at other nodes bring no
    score of the pool to ``asked``. They count in the number of edges.
    """
    fields = lambda node, out, into, ask, count: [node.alias("node_id"), F.lit(out).alias("out"), F.lit(into).alias("into"), F.lit(ask).alias("asked"), *(c.alias(a) for a, c in zip(arms, count, strict=True))]
    none = [F.lit(0)] * len(arms)
    ends = F.array(F.struct(*fields(F.col("source"), True, False, False, [F.col(a).cast("int") for a in arms])), F.struct(*fields(F.col("target"), False, True, False, none)))
    rows = edges.select(F.explode(ends).alias("e")).select("e.*")
    rows = rows.unionByName(pool.select(*fields(F.col("node_id"), True, True, False, none))).unionByName(asked.select(*fields(F.col("node_id"), True, True, True, none)))
    nodes = rows.groupBy("node_id").agg(F.max("out").alias("out"), F.max("into").alias("into"), F.max("asked").alias("asked"), *(F.sum(a).alias(a) for a in arms))
    nodes = stage(numbered(nodes.filter("out and into").drop("out", "into"), "id", "nodes"), "nodes")
    number = lambda side, name: nodes.select(F.col("node_id").alias(side), F.col("id").cast("int").alias(name))
    links = edges.select("source", "target", *arms).join(number("source", "a"), "source").join(number("target", "b"), "target")
    return stage(links.select("a", "b", *arms), "links"), nodes


def _packed(df: DataFrame, kind: int) -> DataFrame:
    """``df`` (a, b) as one row for each of its batches."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy().astype(np.int32), batch.column("b").to_numpy().astype(np.int64 if kind == NODE else np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["kind", "a", "b"])

    return df.mapInArrow(pack, "kind int, a binary, b binary")


def carrying(blocks: list[tuple[np.ndarray, np.ndarray]], starts: np.ndarray, asked: np.ndarray, nodes: int, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """Sources and targets of the links in ``blocks`` that are on a way of at most ``iterations`` links from ``starts``, and on one to ``asked``."""
    ahead, behind = np.zeros(nodes, bool), np.zeros(nodes, bool)
    ahead[starts], behind[asked] = True, True
    for mark, tail, head in ((ahead, 0, 1), (behind, 1, 0)):
        for _ in range(iterations):
            before = mark.sum()
            for block in blocks:
                mark[block[head][mark[block[tail]]]] = True
            if mark.sum() == before:
                break
    masks = [ahead[a] & behind[b] for a, b in blocks]
    return tuple(np.concatenate([block[i][m] for block, m in zip(blocks, masks, strict=True)] or [np.empty(0, np.int32)]) for i in (0, 1))


def single_scores(source: np.ndarray, target: np.ndarray, share: np.ndarray, starts: Iterator[int] | list[int], asked: np.ndarray, alpha: float, iterations: int) -> Iterator[np.ndarray]:
    """For each start the scores of ``asked`` after ``iterations`` steps. ``share`` of each node's score goes along each of its links;
    links to one target should lie together."""
    used = np.zeros(len(share), bool)
    for nodes in (source, target, asked, starts):
        used[nodes] = True
    row = np.cumsum(used) - 1
    n, share, source, target, asked = int(used.sum()), share[used], row[source], row[target], row[asked]
    first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.empty(0, np.intp)
    heads, taken = target[first], np.empty(len(source))
    del target
    for start in row[np.asarray(starts, np.intp)]:
        x = np.zeros(n)
        x[start] = 1.0
        for _ in range(iterations):
            np.take(x * share, source, out=taken, mode="clip")
            x = np.bincount(heads, np.add.reduceat(taken, first), n) if len(first) else np.zeros(n)
            x[start] += alpha
        yield x[asked]


def asked_scores(edges: DataFrame, arms: list[str], pool: DataFrame, n: int, asked: DataFrame, alpha: float, iterations: int) -> dict[str, DataFrame]:
    """For each arm (node_id, by_seed array<double>) of the nodes in ``asked`` (node_id): scores of each single seed of ``pool``
    (position, node_id), every edge of the arm counting once.

    Each task runs whole vectors on all links of an arm if these fit it; else the scores come from joins.
    """
    spark = edges.sparkSession
    links, nodes = links_between(edges, arms, pool, asked)
    if links.count() > LINKS:
        return {arm: pool_scores(row_normalized(unit_operator(edges.filter(arm))), pool, n, alpha, iterations) for arm in arms}
    total = nodes.count()
    at = {r["position"]: r["id"] for r in nodes.join(F.broadcast(pool), "node_id").select("position", "id").collect()}
    starts = [at[i] for i in range(n)]
    tasks = max(1, min(n, spark.sparkContext.defaultParallelism))
    names = nodes.filter("asked").select("node_id", F.col("id").cast("int").alias("id"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, got = None, {kind: [] for kind in (LINK, NODE, ASKED)}
        for batch in batches:
            task = batch.column("task")[0].as_py() if batch.num_rows and task is None else task
            for kind, a, b in zip(*(batch.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True):
                got[kind].append((np.frombuffer(a, np.int32), np.frombuffer(b, np.int64 if kind == NODE else np.int32)))
        if not got[ASKED]:
            return
        wanted, share = np.concatenate([a for a, _ in got[ASKED]]), np.zeros(total)
        for a, b in got.pop(NODE):
            share[a] = (1 - alpha) / b
        mine = starts[task * n // tasks : (task + 1) * n // tasks]
        source, target = carrying(got.pop(LINK), np.array(mine, np.intp), wanted, total, iterations)
        values = np.stack(list(single_scores(source, target, share, mine, wanted, alpha, iterations)), 1)
        for i in range(0, len(wanted), 4096):
            part = values[i : i + 4096]
            lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32), part.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(wanted[i : i + 4096]), pa.array(np.full(len(part), task, np.int32)), lists], ["id", "task", "values"])

    out = {}
    for arm in arms:
        mine = links.filter(arm).select("a", "b").repartition("b").sortWithinPartitions("b")
        sent = _packed(mine, LINK).unionByName(_packed(nodes.filter(F.col(arm) > 0).select(F.col("id").alias("a"), F.col(arm).alias("b")), NODE))
        sent = sent.unionByName(_packed(names.select(F.col("id").alias("a"), F.lit(0).alias("b")), ASKED))
        sent = stage(sent, "packed").withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, "task")
        with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "64"}):  # a row is a batch of links
            got = stage(sent.mapInArrow(each, "id int, task int, values array<double>"), "by-task")
        whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("task", "values"))), lambda x: x["values"]))
        out[arm] = got.groupBy("id").agg(whole.alias("by_seed")).join(names, "id").select("node_id", "by_seed")
    return out


def bootstrap(spark: SparkSession, pool: int, sizes: list[int], draws: int, seed: int = 42) -> list[tuple[int, list[int]]]:
    """(split, positions): ``draws`` subsets for each size that the pool allows, without replacement, by seeded hashes, and as
    split -1 the whole pool. A list of as many sets as were asked for."""
    sizes = [s for s in sizes if s <= pool]
    keyed = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(pool - 1)), lambda i: F.struct(seeded_hash(seed, F.col("id"), i).alias("h"), i.alias("i"))))
    order = spark.range(draws * len(sizes)).select("id", F.transform(keyed, lambda x: x["i"]).alias("order")).collect()
    return [(-1, list(range(pool)))] + [(r["id"], sorted(r["order"][: sizes[r["id"] % len(sizes)]])) for r in sorted(order)]


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n! by Stirling's series, shifted up by eight."""
    x = np.asarray(n, float) + 9.0
    series = (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return series - sum(np.log(x - 9.0 + i) for i in range(1, 9))


def tails(marked: np.ndarray, population: int, drawn: int) -> np.ndarray:
    """P(X >= k) for k = 0..drawn (columns) of ``drawn`` of ``population`` items, for each number ``marked`` (rows)."""
    m, k = np.asarray(marked, np.int64)[:, None], np.arange(drawn + 1)[None, :]
    lc = lambda n, r: _log_factorial(n) - _log_factorial(r) - _log_factorial(n - r)
    able = (k <= m) & (drawn - k <= population - m)
    pmf = np.where(able, np.exp(lc(m, np.minimum(k, m)) + lc(np.maximum(population - m, 0), np.clip(drawn - k, 0, np.maximum(population - m, 0))) - lc(population, drawn)), 0.0)
    return np.minimum(1.0, pmf[:, ::-1].cumsum(1)[:, ::-1])


Sets = list[tuple[int, list[int]]]


def _matrix(sets: Sets, pool: int) -> np.ndarray:
    out = np.zeros((pool, len(sets)))
    for j, (_, positions) in enumerate(sets):
        out[positions, j] = 1.0
    return out


def ahead(items: DataFrame, sets: Sets, pool: int, asked: list[str], value: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], ties: bool = True) -> DataFrame:
    """(split, key, n): for each set and each key in ``asked`` (a short list) the number of ``items`` that come before it.

    ``items`` (key, by_seed array<double>, size double); ``value`` makes the items' values (rows) in all sets (columns) of their
    arrays, sizes and the sets' 0/1 matrix. Higher values come first, equal ones by key (with ``ties``; else they do not count).
    """
    matrix, numbers = _matrix(sets, pool), np.array([s for s, _ in sets], np.int64)
    known = {r["key"]: r for r in items.filter(F.col("key").isin(asked)).collect()}
    names = sorted(known)
    block = lambda rows: np.array(rows, float).reshape(len(rows), pool)
    own = value(block([known[k]["by_seed"] for k in names]), np.array([known[k]["size"] for k in names], float), matrix) if names else np.zeros((0, len(sets)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(own.shape, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                keys = np.array(part.column(0).to_pylist(), object)
                values = value(part.column(1).flatten().to_numpy().reshape(-1, pool), part.column(2).to_numpy(), matrix)
                for i, name in enumerate(names):
                    total[i] += (values > own[i]).sum(0)
                    if ties:
                        total[i] += ((values == own[i]) & (keys < name)[:, None]).sum(0)
        if total.size:
            columns = [np.tile(numbers, len(names)), np.repeat(np.array(names, object), len(numbers)), total.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["split", "key", "n"])

    counts = items.select("key", "by_seed", F.col("size").cast("double")).mapInArrow(count, "split long, key string, n long")
    return counts.groupBy("split", "key").agg(F.sum("n").alias("n"))


def mean_score(by_seed: np.ndarray, size: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Mean score of each set by the root of the size, in whole billionths."""
    return np.rint(by_seed @ matrix / matrix.sum(0) / np.sqrt(size)[:, None] * 1e9)


def fisher_value(in_universe: list[float], population: int) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Minus the p-value of each set's overlap: ``by_seed`` says which seeds are members, ``size`` the members in the universe."""
    known: dict[tuple[int, int], np.ndarray] = {}  # tails by number drawn and size

    def rows(sizes: np.ndarray, drawn: int, width: int) -> np.ndarray:
        distinct, of = np.unique(np.asarray(sizes, np.int64), return_inverse=True)
        new = [int(m) for m in distinct if (drawn, int(m)) not in known]
        known.update({(drawn, m): row for m, row in zip(new, tails(np.array(new), population, drawn), strict=True)} if new else {})
        table = np.zeros((len(distinct), width))
        for i, m in enumerate(distinct):
            table[i, : drawn + 1] = known[drawn, int(m)]
        return table[of]

    def value(by_seed: np.ndarray, size: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        hits, drawn = np.rint(by_seed @ matrix).astype(np.int64), np.rint(np.array(in_universe) @ matrix).astype(np.int64)
        out = np.zeros(hits.shape)
        for d in np.unique(drawn):
            at = np.flatnonzero(drawn == d)
            p = np.take_along_axis(rows(size, int(d), int(d) + 1 + matrix.shape[0]), hits[:, at], 1)
            out[:, at] = -np.round(np.where(hits[:, at] > 0, p, 1.0), 12)
        return out

    return value


def list_metrics(items: DataFrame, sets: Sets, pool: int, relevant: list[str], value: Callable, ks: tuple[int, ...] = (10, 20)) -> DataFrame:
    """Ranking metrics of every set's list, from the ranks of its relevant items."""
    ranks = ahead(items, sets, pool, relevant, value).select("split", (F.col("n") + 1).alias("rank"))
    spark = items.sparkSession
    counts = spark.createDataFrame([(s,) for s, _ in sets], "split long").withColumn("n", F.lit(items.count()))
    return ranking_metrics(ranks, ["split"], F.lit(True), ks, counts)


def held_out_precision(nodes: DataFrame, sets: Sets, pool_keys: list[str]) -> DataFrame:
    """(split, gene_auprc): average precision of the pool's nodes outside each set among all nodes but those of the set, of equal
    scores the held-out first. ``nodes`` (key, by_seed, size) has every scored node."""
    pool = len(pool_keys)
    others = nodes.filter(~F.col("key").isin(pool_keys))
    mine = nodes.filter(F.col("key").isin(pool_keys))
    above = ahead(others.unionByName(mine), sets, pool, pool_keys, mean_score, ties=False)
    within = {r["key"]: r["by_seed"] for r in mine.collect()}
    matrix = _matrix(sets, pool)
    own = mean_score(np.array([within[k] for k in pool_keys], float), np.ones(pool), matrix)
    rows = []
    for j, (split, positions) in enumerate(sets):
        held = [i for i in range(pool) if i not in set(positions)]
        order = sorted(held, key=lambda i: -own[i, j])
        for hit, i in enumerate(order, 1):  # nodes of the pool ahead of it are not other nodes
            rows.append((split, pool_keys[i], hit, int((own[:, j] > own[i, j]).sum())))
    hits = nodes.sparkSession.createDataFrame(rows, "split long, key string, hit int, pool_ahead int")
    rank = F.col("n") - F.col("pool_ahead") + F.col("hit")
    return above.join(F.broadcast(hits), ["split", "key"]).groupBy("split").agg(F.avg(F.col("hit") / rank).alias("gene_auprc"))


def compared(conditioned: DataFrame, raw: DataFrame, fisher: DataFrame) -> DataFrame:
    """Metrics of the conditioned lists beside those of the raw ones and of the seeds' overlap."""
    out = conditioned.join(raw.select("split", F.col("mean_rank").alias("mean_rank_raw")), "split")
    out = out.join(fisher.select("split", F.col("p_at_10").alias("fisher_p_at_10"), F.col("ap").alias("fisher_ap")), "split")
    beats = F.round("ap", 9) > F.round("fisher_ap", 9)
    return out.withColumn("rank_improvement", F.col("mean_rank_raw") - F.col("mean_rank")).withColumn("beats_fisher", beats.cast("int"))


def control_split(members: DataFrame, share: float = 0.7, seed: int = 42) -> DataFrame:
    """(pathway, gene, role): the members of each pathway as ``seed`` or ``heldout``, by the order of md5 hashes."""
    from pyspark.sql import Window

    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "pathway", "gene"))
    w = Window.partitionBy("pathway").orderBy(key, "gene")
    rows = members.withColumn("_k", F.row_number().over(w))
    sizes = members.groupBy("pathway").agg(F.count("*").alias("_n"))
    cut = F.ceil(F.round(F.col("_n") * share, 6))
    return rows.join(sizes, "pathway").select("pathway", "gene", F.when(F.col("_k") <= cut, "seed").otherwise("heldout").alias("role"))
