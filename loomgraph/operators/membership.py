"""Gene sets: who belongs to which pathway, by vocabulary-checked and by predicate-only rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import broadcast_if_small


def best_sab(nodes: DataFrame, priority: list[str]) -> DataFrame:
    """(node_id, sab): of several vocabularies of an id the one of best priority, then of the smallest row_id."""
    ranks = F.create_map(*(x for i, s in enumerate(priority) for x in (F.lit(s), F.lit(i))))
    rank = F.coalesce(F.try_element_at(ranks, F.col("sab")), F.lit(len(priority)))
    return nodes.filter("sab is not null").groupBy("node_id").agg(F.min_by("sab", F.struct(rank, F.col("row_id"))).alias("sab"))


def candidates(edges: DataFrame, forward: list[str], reverse: list[str]) -> DataFrame:
    """(pathway, gene) of membership predicates, read in one scan; forward ones run from pathway to gene."""
    ahead = F.col("predicate").isin(forward)
    rows = edges.filter(ahead | F.col("predicate").isin(reverse))
    return rows.select(F.when(ahead, F.col("source")).otherwise(F.col("target")).alias("pathway"), F.when(ahead, F.col("target")).otherwise(F.col("source")).alias("gene"))


def checked_members(edges: DataFrame, sabs: DataFrame, forward: list[str], reverse: list[str], pathway_sabs: list[str], gene_sabs: list[str]) -> DataFrame:
    """Distinct (pathway, gene) whose ends have a pathway's and a gene's vocabulary."""
    pathways = sabs.filter(F.col("sab").isin(pathway_sabs)).select(F.col("node_id").alias("pathway"))
    genes = sabs.filter(F.col("sab").isin(gene_sabs)).select(F.col("node_id").alias("gene"))
    rows = candidates(edges, forward, reverse).distinct()
    return rows.join(pathways, "pathway", "left_semi").join(genes, "gene", "left_semi")


def predicate_members(edges: DataFrame, forward: list[str], reverse: list[str]) -> DataFrame:
    """Distinct (pathway, gene) by predicate alone, genes being bare concept ids."""
    return candidates(edges, forward, reverse).distinct().filter(is_gene(F.col("gene")))


def is_gene(ident: Column) -> Column:
    return ident.rlike(r"^C[0-9]")


def sized(members: DataFrame, least: int, most: int | None) -> DataFrame:
    """Members of pathways with ``least`` to ``most`` genes."""
    sizes = members.groupBy("pathway").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    if most is not None:
        sizes = sizes.filter(F.col("_n") <= most)
    return members.join(broadcast_if_small(sizes.select("pathway")), "pathway", "left_semi")


def name_allowed(name: Column, sab: Column, excluded: list[str], prefixes: list[str], prefixed_sab: str) -> Column:
    """Names without an excluded part; in ``prefixed_sab`` only names with an allowed prefix, if any are given."""
    upper = F.coalesce(F.upper(name), F.lit(""))
    allowed = F.lit(True)
    for part in excluded:
        allowed = allowed & ~upper.contains(part.upper())
    if prefixes:
        starts = F.lit(False)
        for p in prefixes:
            starts = starts | upper.startswith(p.upper())
        allowed = allowed & ((F.coalesce(sab, F.lit("")) != prefixed_sab) | starts)
    return allowed
