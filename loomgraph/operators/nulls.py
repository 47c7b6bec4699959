"""Nulls by permutation: seeded hash draws, degree-preserving rewiring and stratified draws, all as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scalars import seeded_hash
from loomgraph.operators import many
from loomgraph.operators.conditioning import row_normalized, unit_operator
from loomgraph.operators.propagate import pagerank_vectors
from loomgraph.session import numbered, stage

#: Edges of a bucket in which swap partners are found.
SWAP_BUCKET = 1024
#: Vectors of one propagation by joins; batches of more permutations are written one after another.
BATCH = 50


def seed_universe(members: DataFrame, graph_nodes: DataFrame) -> DataFrame:
    """Distinct members that are in the graph."""
    return members.select(F.col("gene").alias("node_id")).distinct().join(graph_nodes.select("node_id").distinct(), "node_id", "left_semi")


def draws(universe: DataFrame, n: int, permutations: int, seed: int = 42) -> DataFrame:
    """(perm, node_id): ``n`` of the universe per permutation, without replacement, by seeded hashes.

    Only ids below a hash cutoff that passes about 4n + 64 of them are ranked, so no permutation sorts the universe. A
    permutation in which fewer than n pass is drawn again from all ids. Hashes (``seeded_hash``) stay hexadecimal digits, whose
    order as text is that of the numbers.
    """
    total = universe.count()
    share = min(1.0, (4 * n + 64) / max(1, total))
    perms = spark_range(universe, permutations)
    hashed = lambda p: universe.select("node_id").join(F.broadcast(p)).withColumn("_h", F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm").cast("string"), "node_id")), 1, 15))
    w = Window.partitionBy("perm").orderBy("_h", "node_id")
    first = lambda df: df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).select("perm", "node_id")
    if share == 1.0:
        return first(hashed(perms))
    below = stage(first(hashed(perms).filter(F.col("_h") <= f"{int(share * (1 << 60)):015x}")), "draws")
    whole = below.groupBy("perm").count().filter(F.col("count") >= min(n, total)).select("perm")
    short = perms.join(whole, "perm", "left_anti")
    if short.isEmpty():
        return below
    return below.join(F.broadcast(short), "perm", "left_anti").unionByName(first(hashed(short)))


def spark_range(df: DataFrame, n: int) -> DataFrame:
    """(perm): 0 to n - 1, as many rows as permutations are asked for."""
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("perm"))


def seed_permutation_null(transitions: DataFrame, drawn: DataFrame, n: int, pathways: DataFrame, permutations: int, alpha: float, iterations: int) -> DataFrame:
    """(perm, pathway, null): degree-normalised scores after propagation from drawn seeds. ``pathways`` (pathway,
    member_gene_count). Tasks run whole permutations if the graph fits them (``many``); else batches of permutations run as
    columns of one propagation each and are written."""
    transitions, drawn = stage(transitions, "transitions"), stage(drawn, "drawn")
    if transitions.count() <= many.GRAPH_EDGES:
        return _seed_null_in_tasks(transitions, drawn, n, pathways, permutations, alpha, iterations)
    out = None
    for first in range(0, permutations, BATCH):
        part = _seed_null_batch(transitions, drawn, n, pathways, range(first, min(first + BATCH, permutations)), alpha, iterations)
        if permutations > BATCH:
            part = stage(part, "nulls")
        out = part if out is None else out.unionByName(part)
    return out


def _seed_null_batch(transitions: DataFrame, drawn: DataFrame, n: int, pathways: DataFrame, perms: range, alpha: float, iterations: int) -> DataFrame:
    names = [f"v{i}" for i in perms]
    mine = drawn.filter(F.col("perm").between(perms[0], perms[-1]))
    restarts = mine.groupBy("node_id").agg(*(F.sum(F.when(F.col("perm") == i, 1.0 / n).otherwise(0.0)).alias(v) for i, v in zip(perms, names)))
    scores = pagerank_vectors(transitions, restarts, names, alpha, iterations)
    totals = scores.agg(*(F.sum(v).alias(f"t_{v}") for v in names))
    rows = pathways.join(scores.withColumnRenamed("node_id", "pathway"), "pathway", "left").fillna(0.0, names).join(F.broadcast(totals))
    values = F.array(*(F.when(F.col(f"t_{v}") > 0, F.col(v) / F.col(f"t_{v}")).otherwise(0.0) for v in names))
    rows = rows.select("pathway", "member_gene_count", F.posexplode(values).alias("perm", "direct"))
    null = F.col("direct") / F.sqrt(F.greatest("member_gene_count", F.lit(1)))
    return rows.select((F.col("perm") + perms[0]).alias("perm"), "pathway", null.alias("null"))


def _per_root(pathways: DataFrame) -> DataFrame:
    return stage(pathways.withColumn("scale", 1 / F.sqrt(F.greatest("member_gene_count", F.lit(1)))), "sizes")


def _seed_null_in_tasks(transitions: DataFrame, drawn: DataFrame, n: int, pathways: DataFrame, permutations: int, alpha: float, iterations: int) -> DataFrame:
    pathways = _per_root(pathways)
    ids = many.number_nodes(transitions.select("src"), transitions.select("dst"), pathways.select("pathway"), drawn.select("node_id"))
    nodes = ids.count()
    tables = [many.rows(transitions, ids, many.LINK, "src", "dst", "p"), many.rows(pathways, ids, many.PATHWAY, "pathway", w="scale"), many.rows(drawn, ids, many.START, "node_id", "perm")]

    def work(parts, perms):
        import numpy as np

        at, _, scale = parts[many.PATHWAY]
        graph = many.Propagation(*parts[many.LINK], nodes, at, alpha)
        seeds, perm, _ = parts[many.START]
        width = max(1, min(many.VECTORS, many.VALUES // nodes))
        for first in range(0, len(perms), width):
            block = perms[first : first + width]
            start = np.zeros((nodes, len(block)))
            for i, p in enumerate(block):
                start[seeds[perm == p], i] = 1.0 / n
            values = graph.run(start, iterations) * scale[:, None]
            for i, p in enumerate(block):
                yield p, np.ascontiguousarray(values[:, i])

    return many.run(tables, work, permutations)


def bridges(kept_edges: DataFrame, flow: str = "Pathway Contribution") -> tuple[DataFrame, DataFrame]:
    """Propagating edges into pathways, and the other propagating edges."""
    moving = kept_edges.filter("propagating")
    is_bridge = F.coalesce(F.col("flow_class") == flow, F.lit(False))
    return moving.filter(is_bridge), moving.filter(~is_bridge)


def rewire(edges: DataFrame, rounds: int = 20, seed: int = 42) -> DataFrame:
    """(source, target) with targets exchanged between random pairs of edges: in- and out-degrees stay as they are.

    Each round pairs all edges by seeded hashes within buckets of bounded size, so twenty rounds try ten exchanges an edge. A pair is exchanged if neither new edge is a
    loop, is there already, or is proposed by another pair; else it stays. Parallel edges are merged first.
    """
    now = stage(numbered(edges.select("source", "target").distinct(), "e", "edges"), "edges")
    buckets = max(1, now.count() // SWAP_BUCKET)
    for r in range(rounds):
        h = F.xxhash64(F.lit(seed), F.lit(r), "e")
        w = Window.partitionBy("_b").orderBy("_h", "e")
        rows = now.withColumn("_h", h).withColumn("_b", F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(r), "e"), F.lit(buckets))).withColumn("_n", F.row_number().over(w) - 1)
        rows = rows.withColumn("_pair", F.floor(F.col("_n") / 2)).withColumn("_other", F.when(F.col("_n") % 2 == 0, F.lead("target").over(w)).otherwise(F.lag("target").over(w)))
        there = now.select("source", F.col("target").alias("_other"), F.lit(True).alias("_there"))
        rows = rows.join(there, ["source", "_other"], "left")
        proposed = rows.filter("_other is not null").groupBy("source", "_other").agg(F.count("*").alias("_times"))
        rows = rows.join(proposed, ["source", "_other"], "left")
        bad = F.col("_other").isNull() | (F.col("_other") == F.col("source")) | F.col("_there").isNotNull() | (F.col("_times") > 1)
        rows = rows.withColumn("_bad", F.max(bad.cast("int")).over(Window.partitionBy("_b", "_pair")))
        now = stage(rows.select("e", "source", F.when(F.col("_bad") == 0, F.col("_other")).otherwise(F.col("target")).alias("target")), "rewired")
    return now.select("source", "target")


def rewiring_null(kept_edges: DataFrame, restarts: DataFrame, pathways: DataFrame, permutations: int, alpha: float, iterations: int, rounds: int = 20, seed: int = 42) -> DataFrame:
    """(perm, pathway, null): degree-normalised scores after the edges into pathways were rewired. Every permutation has its
    own operator, so each is a propagation of its own: in tasks if the graph fits them (``many``; exchanges by the same rule,
    other random numbers), else one after another, written."""
    bridge, rest = bridges(kept_edges)
    bridge = stage(bridge.select("source", "target").distinct(), "bridge")
    fixed = stage(unit_operator(rest), "rest")
    if fixed.count() + bridge.count() <= many.GRAPH_EDGES:
        return _rewiring_null_in_tasks(bridge, fixed, restarts, pathways, permutations, alpha, iterations, rounds, seed)
    out = None
    for i in range(permutations):
        moved = rest.select("source", "target").unionByName(rewire(bridge, rounds, seed + i))
        scores = pagerank_vectors(row_normalized(unit_operator(moved)), restarts, ["score"], alpha, iterations)
        total = scores.agg(F.sum("score").alias("_t"))
        rows = pathways.join(scores.withColumnRenamed("node_id", "pathway"), "pathway", "left").fillna(0.0, ["score"]).join(F.broadcast(total))
        part = rows.select(F.lit(i).alias("perm"), "pathway", (F.col("score") / F.col("_t") / F.sqrt(F.greatest("member_gene_count", F.lit(1)))).alias("null"))
        part = stage(part, "nulls")
        out = part if out is None else out.unionByName(part)
    return out


def _rewiring_null_in_tasks(bridge: DataFrame, fixed: DataFrame, restarts: DataFrame, pathways: DataFrame, permutations: int, alpha: float, iterations: int, rounds: int, seed: int) -> DataFrame:
    pathways, restarts = _per_root(pathways), stage(restarts, "restarts")
    links = fixed.withColumn("bridge", F.lit(False)).unionByName(bridge.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit(1.0).alias("w"), F.lit(True).alias("bridge")))
    out = links.groupBy("src").agg(F.sum("w").alias("_total"))  # exchanges of targets leave it as it is
    links = stage(links.join(out, "src").select("src", "dst", (F.col("w") / F.col("_total")).alias("p"), "bridge"), "links")
    ids = many.number_nodes(links.select("src"), links.select("dst"), pathways.select("pathway"), restarts.select("node_id"))
    nodes = ids.count()
    tables = [many.rows(links.filter(F.col("bridge") == b), ids, kind, "src", "dst", "p") for b, kind in ((False, many.LINK), (True, many.BRIDGE))]
    tables += [many.rows(pathways, ids, many.PATHWAY, "pathway", w="scale"), many.rows(restarts, ids, many.START, "node_id", w="score")]

    def work(parts, perms):
        import numpy as np

        (source, target, share), (b_source, b_target, b_share) = parts[many.LINK], parts[many.BRIDGE]
        order = np.lexsort((b_target, b_source))  # so that draws do not depend on the order of arrival
        b_source, b_target, b_share = b_source[order], b_target[order], b_share[order]
        source, share = np.concatenate([source, b_source]), np.concatenate([share, b_share])
        at, _, scale = parts[many.PATHWAY]
        seeds, _, mass = parts[many.START]
        start = np.zeros(nodes)
        start[seeds] = mass
        for p in perms:
            moved = many.exchanged(b_source, b_target, nodes, rounds, np.random.default_rng([seed, p]))
            yield p, many.propagated(source, np.concatenate([target, moved]), share, start, alpha, iterations)[at] * scale

    return many.run(tables, work, permutations)


def gene_strata(genes: DataFrame, kept_edges: DataFrame, bins: int = 10) -> DataFrame:
    """(gene, stratum): bins of the logarithms of out-degree and of memberships among propagating edges (1 if there are
    none), edges of the bins being exact percentiles; a value on an edge belongs to the bin above."""
    moving = kept_edges.filter("propagating")
    degree = moving.groupBy(F.col("source").alias("gene")).agg(F.count("*").alias("_d"), F.sum(F.when(F.col("flow_class") == "Pathway Contribution", 1).otherwise(0)).alias("_m"))
    rows = genes.join(degree, "gene", "left")
    rows = rows.select("gene", F.log10(F.coalesce("_d", F.lit(1)).cast("double")).alias("d"), F.log10(F.greatest(F.coalesce("_m", F.lit(1)), F.lit(1)).cast("double")).alias("m"))
    inner = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    cuts = rows.agg(F.percentile("d", inner).alias("_dc"), F.percentile("m", inner).alias("_mc"))
    rows = rows.join(F.broadcast(cuts))
    bin_of = lambda x, c: F.size(F.filter(F.col(c), lambda e: e <= F.col(x)))
    return rows.select("gene", F.format_string("d%d_m%d", bin_of("d", "_dc"), bin_of("m", "_mc")).alias("stratum"))


def member_mean_null(members: DataFrame, strata: DataFrame, scores: DataFrame, permutations: int, seed: int = 42) -> DataFrame:
    """(perm, pathway, null): mean score of genes drawn from the strata of a pathway's members, none twice in a pathway.

    Only genes with a score count, as members and to be drawn; a pathway without any has no row. In each permutation the genes of
    a stratum stand in a new seeded random order, as a ring, and a pathway with m members there takes m neighbours from a
    place of its own; so each permutation is an independent draw. Their sum is a difference of two running sums. Tasks run
    whole permutations if genes and memberships fit them (``many``), else they are joins, in written batches of permutations.
    """
    genes = stage(strata.join(scores.withColumnRenamed("node_id", "gene"), "gene").select("gene", "stratum", "score"), "genes")
    sizes = genes.groupBy("stratum").agg(F.count("*").alias("size"))  # bins x bins rows
    loads = members.join(genes.select("gene", "stratum"), "gene").groupBy("pathway", "stratum").agg(F.count("*").alias("_m"))
    loads = stage(loads.join(F.broadcast(sizes), "stratum"), "loads")
    if genes.count() + loads.count() <= many.GRAPH_EDGES:
        return _member_null_in_tasks(genes, loads, permutations, seed)
    out = None
    for start in range(0, permutations, BATCH):
        perms = spark_range(genes, permutations).filter(F.col("perm").between(start, start + BATCH - 1))
        ring = genes.join(F.broadcast(perms)).withColumn("_h", seeded_hash(seed, "perm", "gene"))
        place = Window.partitionBy("perm", "stratum").orderBy("_h", "gene")
        upto = F.sum("score").over(place.rowsBetween(Window.unboundedPreceding, 0))
        ring = stage(ring.select("perm", "stratum", F.row_number().over(place).alias("_at"), upto.alias("_sum")), "ring")
        whole = ring.groupBy("perm", "stratum").agg(F.max_by("_sum", "_at").alias("_all"))
        rows = loads.join(F.broadcast(perms)).withColumn("_from", F.pmod(seeded_hash(seed, "perm", "pathway", "stratum"), F.col("size")).cast("int"))
        rows = rows.withColumn("_to", F.col("_from") + F.col("_m")).withColumn("_end", F.when(F.col("_to") > F.col("size"), F.col("_to") - F.col("size")).otherwise(F.col("_to")))
        for name, at in (("_low", "_from"), ("_high", "_end")):  # the sum up to place 0 has no row
            rows = rows.join(ring.select("perm", "stratum", F.col("_at").cast("long").alias(at), F.col("_sum").alias(name)), ["perm", "stratum", at], "left").fillna(0.0, [name])
        rows = rows.join(whole, ["perm", "stratum"])
        drawn = F.col("_high") - F.col("_low") + F.when(F.col("_to") > F.col("size"), F.col("_all")).otherwise(0.0)
        part = stage(rows.groupBy("perm", "pathway").agg((F.sum(drawn) / F.sum("_m")).alias("null")), "nulls")
        out = part if out is None else out.unionByName(part)
    return out


def _member_null_in_tasks(genes: DataFrame, loads: DataFrame, permutations: int, seed: int) -> DataFrame:
    spark = genes.sparkSession
    tasks = min(permutations, spark.sparkContext.defaultParallelism)
    rows = genes.select(F.col("gene").alias("key"), "stratum", "score", F.lit(0).cast("long").alias("m"), F.lit(False).alias("load"))
    rows = rows.unionByName(loads.select(F.col("pathway").alias("key"), "stratum", F.lit(0.0).alias("score"), F.col("_m").alias("m"), F.lit(True).alias("load")))
    sent = stage(rows, "rings").withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, "task")

    def each(batches):
        import numpy as np
        import pyarrow as pa

        batches = list(batches)
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        first, is_load = int(t.column("task")[0].as_py()), t.column("load").to_numpy()
        part = lambda mask: t.filter(pa.array(mask)).sort_by([("key", "ascending"), ("stratum", "ascending")])
        g, w = part(~is_load), part(is_load)
        names, stratum = np.unique(g.column("stratum").to_pylist(), return_inverse=True)
        keys, score, size = g.column("key").to_pylist(), g.column("score").to_numpy(), np.bincount(stratum)
        start = np.cumsum(size) - size
        pathways, of = np.unique(w.column("key").to_pylist(), return_inverse=True)
        m, in_ = w.column("m").to_numpy(), np.searchsorted(names, w.column("stratum").to_pylist())
        ends = [f"|{p}|{s}" for p, s in zip(w.column("key").to_pylist(), w.column("stratum").to_pylist(), strict=True)]
        gene_ends = [f"|{k}" for k in keys]
        for perm in range(first, permutations, tasks):
            order = np.lexsort((many.hashes(seed, perm, gene_ends), stratum))  # genes are in the order of their names
            sums = np.concatenate([[0.0], np.cumsum(score[order])])
            low = start[in_] + many.hashes(seed, perm, ends) % size[in_]
            high = low + m
            over = high > start[in_] + size[in_]
            high = np.where(over, high - size[in_], high)
            whole = sums[start[in_] + size[in_]] - sums[start[in_]]
            total = np.bincount(of, sums[high] - sums[low] + np.where(over, whole, 0.0), len(pathways))
            null = total / np.bincount(of, m, len(pathways))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pathways), perm, "int32")), pa.array(pathways.tolist(), pa.string()), pa.array(null)], ["perm", "pathway", "null"])

    return sent.mapInArrow(each, "perm int, pathway string, null double")
