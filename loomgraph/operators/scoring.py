"""Pathway scores from node scores, and the tables of members and neighbours behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pathway_scores(pathways: DataFrame, members: DataFrame, scores: DataFrame, raw_scores: DataFrame, kept_edges: DataFrame) -> DataFrame:
    """One row per pathway: direct, member_mean, member_max, degree_norm, local_bg, direct_raw, raw_vs_cond_delta,
    member_gene_count, degree.

    Members without a score count in member_gene_count but not in mean and max; degree is the number of edges at the
    pathway in ``kept_edges``, both directions, parallel edges too; a pathway without members has degree_norm = direct.
    """
    stats = members.join(scores.withColumnRenamed("node_id", "gene"), "gene", "left").groupBy("pathway")
    stats = stats.agg(F.count("*").alias("member_gene_count"), F.avg("score").alias("member_mean"), F.max("score").alias("member_max"))
    ends = kept_edges.select(F.explode(F.array(F.struct(F.col("source").alias("pathway"), F.col("target").alias("node_id")), F.struct(F.col("target").alias("pathway"), F.col("source").alias("node_id")))).alias("e")).select("e.*")
    around = ends.join(pathways.select("pathway"), "pathway", "left_semi").join(scores, "node_id", "left")
    around = around.groupBy("pathway").agg(F.count("*").alias("degree"), F.avg("score").alias("_near"))
    out = pathways.join(stats, "pathway", "left").join(around, "pathway", "left")
    for name, s in (("direct", scores), ("direct_raw", raw_scores)):
        out = out.join(s.select(F.col("node_id").alias("pathway"), F.col("score").alias(name)), "pathway", "left")
    out = out.fillna(0.0, ["direct", "direct_raw", "member_mean", "member_max", "_near"]).fillna(0, ["member_gene_count", "degree"])
    count = F.col("member_gene_count")
    return out.select(
        *pathways.columns,
        "direct",
        "member_mean",
        "member_max",
        F.when(count > 0, F.col("direct") / F.sqrt(count)).otherwise(F.col("direct")).alias("degree_norm"),
        (F.col("direct") - F.col("_near")).alias("local_bg"),
        "direct_raw",
        (F.col("direct") - F.col("direct_raw")).alias("raw_vs_cond_delta"),
        count,
        "degree",
    )


def tested_scores(members: DataFrame, scores: DataFrame) -> DataFrame:
    """(pathway, degree_norm, member_mean): the columns of ``pathway_scores`` that nulls are compared with, for pathways with members."""
    stats = members.join(scores.withColumnRenamed("node_id", "gene"), "gene", "left").groupBy("pathway").agg(F.count("*").alias("_n"), F.avg("score").alias("member_mean"))
    out = stats.join(scores.select(F.col("node_id").alias("pathway"), F.col("score").alias("direct")), "pathway", "left").fillna(0.0, ["direct", "member_mean"])
    return out.select("pathway", (F.col("direct") / F.sqrt("_n")).alias("degree_norm"), "member_mean")


def degree_flags(scored: DataFrame, share: float = 0.9, least: int = 10) -> DataFrame:
    """degree_flag: degree above the percentile of all pathways; never with fewer than ``least`` pathways."""
    limit = scored.agg(F.percentile("degree", share).alias("_limit"), F.count("*").alias("_n"))
    flagged = scored.join(F.broadcast(limit))
    return flagged.withColumn("degree_flag", (F.col("_n") >= least) & (F.col("degree") > F.col("_limit"))).drop("_limit", "_n")


def top_seeds(seeds: DataFrame, scores: DataFrame, n: int = 5) -> DataFrame:
    """The best-scored seeds, ties by id: a report of n rows."""
    return seeds.join(scores, "node_id").orderBy(F.desc("score"), "node_id").limit(n)


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, (x - mean) / sd).otherwise(0.0)


def group_scores(rows: DataFrame, key: str = "pathway") -> DataFrame:
    """score_norm (min-max within the key, 1 if all are equal) and z_within of rows (key, score, ...). Statistics are
    aggregated and joined back, so a large key is not windowed in one task."""
    stats = rows.groupBy(key).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.avg("score").alias("_mean"), F.stddev_pop("score").alias("_sd"))
    rows = rows.join(stats, key)
    spread = F.col("_hi") - F.col("_lo")
    rows = rows.withColumn("score_norm", F.when(spread > 0, (F.col("score") - F.col("_lo")) / spread).otherwise(1.0))
    return rows.withColumn("z_within", F.when(spread > 0, (F.col("score") - F.col("_mean")) / F.col("_sd")).otherwise(0.0)).drop("_lo", "_hi", "_mean", "_sd")


def gene_moments(scores: DataFrame, sabs: DataFrame, gene_sabs: list[str]) -> DataFrame:
    """One row: mean and population deviation of the genes' scores, of all nodes' if there are no genes."""
    kind = scores.join(sabs.filter(F.col("sab").isin(gene_sabs)).select("node_id", F.lit(True).alias("_gene")), "node_id", "left")
    gene = F.when(F.col("_gene"), F.col("score"))
    return kind.agg(F.coalesce(F.avg(gene), F.avg("score")).alias("mean"), F.coalesce(F.stddev_pop(gene), F.stddev_pop("score")).alias("sd"))


def member_scores(members: DataFrame, scores: DataFrame, moments: DataFrame) -> DataFrame:
    """(pathway, gene, score, score_norm, z_within, z_global) of every member with a score."""
    rows = group_scores(members.join(scores.withColumnRenamed("node_id", "gene"), "gene"))
    rows = rows.join(F.broadcast(moments)).withColumn("z_global", z_score(F.col("score"), F.col("mean"), F.col("sd")))
    return rows.select("pathway", "gene", "score", "score_norm", "z_within", "z_global")


def influential_nodes(pathways: DataFrame, kept_edges: DataFrame, scores: DataFrame, members: DataFrame, seeds: DataFrame, limit: int | None = 200) -> DataFrame:
    """Distinct scored neighbours of each pathway with score_norm, z_within, is_member, is_seed; the ``limit`` best of each
    by z, ties by id (null: all). A report: the window sees a pathway's distinct neighbours."""
    ends = kept_edges.select(F.explode(F.array(F.struct(F.col("source").alias("pathway"), F.col("target").alias("node_id")), F.struct(F.col("target").alias("pathway"), F.col("source").alias("node_id")))).alias("e")).select("e.*")
    near = ends.join(pathways.select("pathway"), "pathway", "left_semi").distinct().join(scores, "node_id")
    near = group_scores(near)
    near = near.join(members.select("pathway", F.col("gene").alias("node_id"), F.lit(True).alias("_m")), ["pathway", "node_id"], "left")
    near = near.join(seeds.select("node_id", F.lit(True).alias("_s")).distinct(), "node_id", "left")
    out = near.select("pathway", "node_id", "score", "score_norm", "z_within", F.coalesce("_m", F.lit(False)).alias("is_member"), F.coalesce("_s", F.lit(False)).alias("is_seed"))
    return out if limit is None else best_neighbours(out, limit)


def best_neighbours(near: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best-scored neighbours of each pathway, ties by id: first the best of parts of a pathway's neighbours, then
    of those, so no task sorts all neighbours of a hub."""
    part = near.withColumn("_salt", F.pmod(F.xxhash64("node_id"), F.lit(64)))
    for keys in (["pathway", "_salt"], ["pathway"]):
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), "node_id")
        part = part.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= limit)
    return part.drop("_k", "_salt")


def influence_summary(near: DataFrame, best: DataFrame, z: float = 1.96) -> DataFrame:
    """Per pathway: number of neighbours above ``z``, quartiles and maximum of all their scores, and the ids above ``z`` among
    ``best`` (a bounded list for each pathway), best first."""
    above = F.round("z_within", 6) > z
    q = F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = near.groupBy("pathway").agg(F.count(F.when(above, 1)).alias("n_high"), F.count("*").alias("n"), q.alias("_q"), F.max("score").alias("max_score"))
    listed = best.filter(above).groupBy("pathway").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), F.col("node_id")))).alias("_l"))
    rows = rows.join(listed.select("pathway", F.array_join(F.transform("_l", lambda x: x["node_id"]), ";").alias("high")), "pathway", "left")
    return rows.select("pathway", "n_high", "n", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "max_score", F.coalesce("high", F.lit("")).alias("high"))


def summary(scored: DataFrame, member_table: DataFrame, seeds: DataFrame) -> DataFrame:
    """Per pathway its seed members, best first, and their number. Seeds are a short list, so are a pathway's."""
    rows = member_table.join(seeds.select(F.col("node_id").alias("gene")), "gene", "left_semi").groupBy("pathway")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score_norm")).alias("k"), F.col("gene"))))
    rows = rows.agg(F.count("*").alias("n_seeds"), F.array_join(F.transform(listed, lambda s: s["gene"]), ";").alias("seed_members"))
    out = scored.join(rows, "pathway", "left")
    return out.withColumn("n_seeds", F.coalesce("n_seeds", F.lit(0)).cast("long")).withColumn("seed_members", F.coalesce("seed_members", F.lit("")))
