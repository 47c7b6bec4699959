"""Permutations over one graph, shared out among tasks.

A graph of counted, bounded size goes to every task, which runs whole permutations on arrays: then no step of a
propagation is shuffled. The tables travel as rows (kind, a, b, w) with numbers for ids, by ``repartitionById``, not
through the driver. Larger graphs are left to the joins of ``propagate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import numbered, stage

#: Transitions of a graph that a task holds, about 50 bytes each.
GRAPH_EDGES = 4_000_000
#: Restart vectors that a task runs side by side, and values that they may have in all (a task holds about four such arrays).
VECTORS, VALUES = 32, 6_000_000
#: Targets whose sums are held at once; sources of a target beyond ``HUB`` are added up as one product.
ROWS, HUB = 4096, 256
LINK, BRIDGE, PATHWAY, START = range(4)
NULLS = "perm int, pathway string, null double"


def number_nodes(*columns: DataFrame) -> DataFrame:
    """(node_id, id) over one-column tables."""
    out = columns[0].toDF("node_id")
    for c in columns[1:]:
        out = out.unionByName(c.toDF("node_id"))
    return numbered(out.distinct(), "id", "nodes")


def rows(df: DataFrame, ids: DataFrame, kind: int, a: str, b: str | None = None, w: str | None = None) -> DataFrame:
    """``df`` as (kind, a, b, w, name): ids of nodes ``a`` and ``b`` (an integer column stays as it is), of pathways the name too."""
    out = df.select(F.col(a).alias("_a"), (F.col(b) if b else F.lit(0)).alias("_b"), (F.col(w) if w else F.lit(1.0)).cast("double").alias("w"))
    out = out.join(ids.select(F.col("node_id").alias("_a"), F.col("id").cast("int").alias("a")), "_a")
    if dict(out.dtypes)["_b"] == "string":
        out = out.join(ids.select(F.col("node_id").alias("_b"), F.col("id").cast("int").alias("b")), "_b")
    else:
        out = out.withColumn("b", F.col("_b").cast("int"))
    return out.select(F.lit(kind).alias("kind"), "a", "b", "w", (F.col("_a") if kind == PATHWAY else F.lit(None).cast("string")).alias("name"))


def run(tables: list[DataFrame], work: Callable[[dict, range], Iterator[tuple]], permutations: int) -> DataFrame:
    """(perm, pathway, null): ``work(parts, perms)`` in each task yields (perm, values of the pathways) for its permutations.

    Batches are taken apart as they come, and pathways carry their names, so results need no join.
    """
    tasks = min(permutations, tables[0].sparkSession.sparkContext.defaultParallelism)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    sent = stage(out, "graph").withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, "task")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, names = None, []
        got: dict[int, list] = {k: [(np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0))] for k in range(4)}
        for batch in batches:
            kind, a, b, w = (batch.column(name).to_numpy() for name in ("kind", "a", "b", "w"))
            first = int(batch.column("task")[0].as_py()) if first is None else first
            for k in np.unique(kind):
                here = kind == k
                got[int(k)].append((a[here], b[here], w[here]))
                if k == PATHWAY:
                    names.append(batch.column("name").filter(pa.array(here)))
        if not names:
            return
        pathways = pa.concat_arrays(names)
        parts = {k: tuple(np.concatenate(c) for c in zip(*got.pop(k), strict=True)) for k in range(4)}
        for perm, values in work(parts, range(first, permutations, tasks)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pathways), perm, "int32")), pathways, pa.array(values)], ["perm", "pathway", "null"])

    return sent.mapInArrow(each, NULLS)


def hashes(seed: int, perm: int, ends: list[str]) -> np.ndarray:
    """``scalars.seeded_hash`` of the seed, the permutation and the texts in ``ends`` (each with its leading bar)."""
    start = hashlib.md5(f"{seed}|{perm}".encode())
    out = np.empty(len(ends), np.int64)
    for i, end in enumerate(ends):
        h = start.copy()
        h.update(end.encode())
        out[i] = int.from_bytes(h.digest()[:8], "big") >> 4
    return out


class Sums:
    """Sums over the transitions into each target, of rows with a value for each vector.

    Targets stand by their number of transitions, most first: the k-th ones of a block of targets are rows to be added to its
    head, so a sum of many vectors is a few operations on whole rows.
    """

    def __init__(self, source: np.ndarray, target: np.ndarray, share: np.ndarray):
        order = np.argsort(target, kind="stable")
        nodes, first, degree = np.unique(target[order], return_index=True, return_counts=True)
        source, share = source[order].astype(np.intp), share[order]
        by = np.argsort(-degree, kind="stable")
        nodes, first, degree = nodes[by], first[by], degree[by]
        self.blocks = []
        for r in range(0, len(nodes), ROWS):
            d, f = degree[r : r + ROWS], first[r : r + ROWS]
            rows = [f[: np.searchsorted(-d, -k)] + k for k in range(min(int(d[0]), HUB))]
            hubs = [(i, slice(c, min(c + ROWS, int(f[i] + d[i])))) for i in range(np.searchsorted(-d, -HUB)) for c in range(int(f[i]) + HUB, int(f[i] + d[i]), ROWS)]
            self.blocks.append((nodes[r : r + ROWS], [(source[e], share[e][:, None]) for e in rows], [(i, source[e], share[e]) for i, e in hubs]))

    def put(self, x: np.ndarray, base: np.ndarray, out: np.ndarray) -> None:
        """Rows of ``out`` for all targets: ``base`` plus the sums over ``x``."""
        room = np.empty((ROWS, x.shape[1]))
        for nodes, rows, hubs in self.blocks:
            total = base[nodes]
            for source, share in rows:
                taken = room[: len(source)]
                np.take(x, source, axis=0, out=taken, mode="clip")
                taken *= share
                total[: len(source)] += taken
            for i, source, share in hubs:
                total[i] += share @ x[source]
            out[nodes] = total


def split(source: np.ndarray, target: np.ndarray, nodes: int) -> tuple[np.ndarray, ...]:
    """Masks: inner nodes (with transitions into and out of them), transitions between those, from other nodes into them,
    and into nodes without any out of them.

    Transitions between inner nodes alone take part in every step. Nodes without transitions into them keep their restart value, so what comes
    from them is a constant; nodes without any out of them pass nothing on, so their sums matter in the last step only.
    """
    into, out_of = np.zeros(nodes, bool), np.zeros(nodes, bool)
    into[target], out_of[source] = True, True
    on, known = out_of[target], into[source]
    return into & out_of, on & known, on & ~known, ~on


class Propagation:
    """Propagation of blocks of restart vectors over one graph, for the values of the nodes ``asked``.

    Only inner nodes (``split``) have rows of values; of the others all but ``asked`` count in the total alone.
    """

    def __init__(self, source: np.ndarray, target: np.ndarray, share: np.ndarray, nodes: int, asked: np.ndarray, alpha: float):
        share = (1 - alpha) * share
        inner, between, feed, last = split(source, target, nodes)
        self.alpha, self.asked, self.core, self.others = alpha, asked, np.flatnonzero(inner), np.flatnonzero(~inner)
        row, place = np.full(nodes, -1, np.int32), np.full(nodes, -1, np.int32)
        row[self.core], place[asked] = np.arange(len(self.core)), np.arange(len(asked))
        self.asked_rows, self.place = row[asked], place
        self.between = Sums(row[source[between]], row[target[between]], share[between])
        self.feed = Sums(source[feed], row[target[feed]], share[feed])
        self.lost = np.bincount(source[last], share[last], nodes) if last.any() else np.zeros(nodes)
        mine = last & (place[target] >= 0)
        known = inner[source]
        self.last = Sums(row[source[mine & known]], place[target[mine & known]], share[mine & known])
        self.last_fed = Sums(source[mine & ~known], place[target[mine & ~known]], share[mine & ~known])

    def run(self, start: np.ndarray, iterations: int) -> np.ndarray:
        """(asked, vectors) after ``iterations`` steps from ``start`` (nodes, vectors), of vectors rescaled to a sum of 1 (zeros stay)."""
        alpha, x = self.alpha, start[self.core]
        jump = alpha * x
        base, spare = jump.copy(), x
        self.feed.put(start, jump, base)
        for step in range(1, iterations + 1):
            if step == 2:  # the other nodes start with their whole restart value and have its share from then on
                base = jump + alpha * (base - jump)
            x, spare = (base.copy() if step <= 3 else spare), x  # later buffers differ in the rows of ``between`` only
            self.between.put(spare, base, x)
        level = alpha if iterations > 1 else 1.0
        total = x.sum(0) + self.lost[self.core] @ spare + (alpha + level * self.lost[self.others]) @ start[self.others]
        out = alpha * start[self.asked]
        here = self.asked_rows >= 0
        out[here] = x[self.asked_rows[here]]
        self.last.put(spare, out, out)
        self.last_fed.put(level * start if self.last_fed.blocks else start, out, out)
        return out / np.where(total > 0, total, 1.0)


def propagated(source: np.ndarray, target: np.ndarray, share: np.ndarray, start: np.ndarray, alpha: float, iterations: int) -> np.ndarray:
    """One restart vector after ``iterations`` steps, rescaled to a sum of 1 (zeros stay)."""
    n, share = len(start), (1 - alpha) * share
    _, between, feed, last = split(source, target, n)
    sums = lambda mask, x: np.bincount(target[mask], share[mask] * x[source[mask]], n) if mask.any() else np.zeros(n)
    fed, x = sums(feed, start), start
    source_in, target_in, share_in = source[between].astype(np.intp), target[between].astype(np.intp), share[between]  # cast once, not every step
    for step in range(1, iterations + 1):
        before, x = x, np.bincount(target_in, share_in * x[source_in], n) + alpha * start + (fed if step == 1 else alpha * fed)
    x += sums(last, before)
    total = x.sum()
    return x / total if total > 0 else x


def exchanged(source: np.ndarray, target: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Targets after exchanges between random pairs of distinct edges, by the rule of ``nulls.rewire``: no loop, no edge that
    is there already or that another pair proposes."""
    source, target, edges = source.astype("int64") * n, target.astype("int64"), len(source)
    half = edges // 2
    codes = np.empty(edges + 2 * half, np.int64)
    for _ in range(rounds):
        order = rng.permutation(edges)
        i, j = order[:half], order[half : 2 * half]
        (from_i, from_j), (to_i, to_j) = (source[i], source[j]), (target[i], target[j])
        new = np.concatenate([from_i + to_j, from_j + to_i])
        np.add(source, target, out=codes[:edges])
        codes[edges:] = new
        codes.sort()
        repeated = codes[1:][codes[1:] == codes[:-1]]
        bad = np.concatenate([from_i == to_j * n, from_j == to_i * n])
        if len(repeated):
            bad |= repeated[np.minimum(np.searchsorted(repeated, new), len(repeated) - 1)] == new
        good = ~(bad[:half] | bad[half:])
        target[i[good]], target[j[good]] = to_j[good], to_i[good]
    return target
