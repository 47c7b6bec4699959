"""Enrichment baselines: overlap weighted by degree, hypergeometric tests, and preranked enrichment scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.running import running_sums
from loomgraph.functions.scalars import hypergeometric_tail


def degree_overlap(members: DataFrame, seeds: DataFrame, degrees: DataFrame) -> DataFrame:
    """(pathway, size, stat): degrees of seed members, summed, by the root of the size; a gene without edges counts 1."""
    rows = members.join(seeds.select(F.col("node_id").alias("gene"), F.lit(1).alias("_s")).distinct(), "gene", "left")
    rows = rows.join(degrees.withColumnRenamed("node_id", "gene"), "gene", "left")
    weight = F.when(F.col("_s") == 1, F.coalesce("degree", F.lit(1))).otherwise(0)
    return rows.groupBy("pathway").agg(F.count("*").alias("size"), F.sum(weight).alias("_w")).select("pathway", "size", (F.col("_w") / F.sqrt("size")).alias("stat"))


def gene_universe(edges: DataFrame, gene_pattern: str = r"^C[0-9]") -> DataFrame:
    """Distinct genes at either end of an edge."""
    return edges.select(F.explode(F.array("source", "target")).alias("node_id")).filter(F.col("node_id").rlike(gene_pattern)).distinct()


def fisher(members: DataFrame, query: DataFrame, universe: DataFrame, degenerate: bool = False, seeds: DataFrame | None = None) -> DataFrame:
    """(pathway, k, marked, drawn, population, p): hypergeometric test of each pathway's members against ``query``.

    All sets are cut to the universe; p = 1 without overlap. ``degenerate`` repeats a published default whose universe has
    no seeds: k counts overlap before the cut, so p is 0 for every overlap of a query outside the universe.
    """
    universe = universe.select("node_id").distinct()
    query = query.select("node_id").distinct()
    inside = query.join(universe, "node_id", "left_semi")
    sizes = universe.agg(F.count("*").alias("population")).join(F.broadcast(inside.agg(F.count("*").alias("drawn"))))
    rows = members.join(universe.select(F.col("node_id").alias("gene"), F.lit(1).alias("_u")), "gene", "left")
    rows = rows.join(query.select(F.col("node_id").alias("gene"), F.lit(1).alias("_q")), "gene", "left")
    hit = F.col("_q").isNotNull() if degenerate else F.col("_q").isNotNull() & F.col("_u").isNotNull()
    counts = rows.groupBy("pathway").agg(F.count(F.when(hit, 1)).alias("k"), F.count("_u").alias("marked")).join(F.broadcast(sizes))
    tail = hypergeometric_tail(F.col("k"), F.col("population"), F.col("marked"), F.col("drawn"))
    return counts.withColumn("p", F.when(F.col("k") == 0, 1.0).otherwise(tail)).select("pathway", "k", "marked", "drawn", "population", "p")


def neighbourhood(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Seeds and everything one edge away."""
    s = seeds.select("node_id").distinct()
    out = edges.join(s.withColumnRenamed("node_id", "source"), "source", "left_semi").select(F.col("target").alias("node_id"))
    back = edges.join(s.withColumnRenamed("node_id", "target"), "target", "left_semi").select(F.col("source").alias("node_id"))
    return s.unionByName(out).unionByName(back).distinct()


def preranked(members: DataFrame, scores: DataFrame, genes: DataFrame) -> DataFrame:
    """(pathway, hits, es, leading_edge): weighted running-sum enrichment of each pathway over all ``genes`` ranked by score
    (ties by id; a gene without a score has 0).

    The running sum only turns at hits, so each pathway costs its members, not the list: with hit ranks r_i, the sum just
    after hit i is W_i / W - (r_i - i) / misses and just before it W_(i-1) / W - (r_i - i) / misses. The largest absolute
    value counts, the earliest of equal ones. Ranks come from sums over range partitions.
    """
    listed = genes.select("node_id").distinct().join(scores, "node_id", "left").fillna(0.0, ["score"])
    order = [F.desc("score"), F.asc("node_id")]
    listed = running_sums(listed, order, {"rank": F.lit(1)})
    n = listed.agg(F.count("*").alias("_n"))
    hits = members.join(listed.withColumnRenamed("node_id", "gene"), "gene").join(F.broadcast(n))
    w = Window.partitionBy("pathway").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("pathway")
    hits = hits.withColumn("_i", F.count("*").over(w)).withColumn("_w", F.sum(F.abs("score")).over(w)).withColumn("_total", F.sum(F.abs("score")).over(all_)).withColumn("_h", F.count("*").over(all_))
    # without any weight, hits weigh alike
    share = F.when(F.col("_total") > 0, F.col("_w") / F.col("_total")).otherwise(F.col("_i") / F.col("_h"))
    own = F.when(F.col("_total") > 0, F.abs("score") / F.col("_total")).otherwise(1 / F.col("_h"))
    missed = F.when(F.col("_n") > F.col("_h"), (F.col("rank") - F.col("_i")) / (F.col("_n") - F.col("_h"))).otherwise(0.0)
    after = F.struct(F.col("rank").alias("at"), (share - missed).alias("v"), F.col("_i").alias("lead"))
    before = F.struct((F.col("rank") - 1).alias("at"), (share - own - missed).alias("v"), (F.col("_i") - 1).alias("lead"))
    points = hits.select("pathway", "_h", F.explode(F.array(before, after)).alias("p")).filter("p.at >= 1")
    best = points.groupBy("pathway", F.col("_h").alias("hits")).agg(F.max(F.struct(F.round(F.abs("p.v"), 12).alias("a"), (-F.col("p.at")).alias("t"), F.col("p.v").alias("v"), F.col("p.lead").alias("lead"))).alias("b"))
    return best.select("pathway", "hits", F.col("b.v").alias("es"), (F.col("b.lead") / F.col("hits")).alias("leading_edge"))
