"""Graph patterns: seeds, their edges and neighbourhoods, and memberships, as joins on (source, target, predicate)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.membership import best_sab

UNKNOWN = "UNKNOWN"


def described(ids: DataFrame, nodes: DataFrame, priority: list[str]) -> DataFrame:
    """(node_id, label, name, sab) of ``ids``: best vocabulary or UNKNOWN, smallest name or the id itself; ids without a
    node keep their row (outer join)."""
    ids = ids.select("node_id").distinct()
    names = nodes.filter("name is not null").groupBy("node_id").agg(F.min("name").alias("name"))
    out = ids.join(names, "node_id", "left").join(best_sab(nodes, priority), "node_id", "left")
    return out.select("node_id", F.lit("Concept").alias("label"), F.coalesce("name", "node_id").alias("name"), F.coalesce("sab", F.lit(UNKNOWN)).alias("sab"))


def seed_concepts(nodes: DataFrame, names: DataFrame, priority: list[str]) -> DataFrame:
    """Concepts whose name is in the list ``names`` (name), described."""
    ids = nodes.join(names.select("name").distinct(), "name", "left_semi")
    return described(ids, nodes, priority)


def hop_edges(edges: DataFrame, seeds: DataFrame, excluded: list[str]) -> DataFrame:
    """Distinct edges at seeds, whatever their direction, written from seed to neighbour."""
    rows = edges.filter(F.col("predicate").isNotNull() & ~F.col("predicate").isin(excluded)).select("source", "target", "predicate")
    s = seeds.select("node_id").distinct()
    out = rows.join(s.withColumnRenamed("node_id", "source"), "source", "left_semi")
    back = rows.join(s.withColumnRenamed("node_id", "target"), "target", "left_semi").select(F.col("target").alias("source"), F.col("source").alias("target"), "predicate")
    return out.unionByName(back).distinct()


def directed_edges(edges: DataFrame, seeds: DataFrame, excluded: list[str]) -> DataFrame:
    """Edges with a seed at either end, in their own direction and number."""
    rows = edges.filter(F.col("predicate").isNotNull() & ~F.col("predicate").isin(excluded))
    s = seeds.select("node_id").distinct()
    rows = rows.join(s.select(F.col("node_id").alias("source"), F.lit(True).alias("_s")), "source", "left")
    rows = rows.join(s.select(F.col("node_id").alias("target"), F.lit(True).alias("_t")), "target", "left")
    return rows.filter(F.col("_s") | F.col("_t")).drop("_s", "_t")


def hop_nodes(edges: DataFrame, seeds: DataFrame, nodes: DataFrame, excluded: list[str], priority: list[str]) -> DataFrame:
    """Seeds that have an edge, and their neighbours, described."""
    near = hop_edges(edges, seeds, excluded)
    ids = near.select(F.explode(F.array("source", "target")).alias("node_id"))
    return described(ids, nodes, priority)


def pathway_memberships(edges: DataFrame, sabs: DataFrame, predicates: list[str], pathway_sab: str) -> DataFrame:
    """Distinct gene-to-pathway edges of ``predicates`` whose pathway has the vocabulary: a union of sets."""
    pathways = sabs.filter(F.col("sab") == pathway_sab).select(F.col("node_id").alias("target")).distinct()
    rows = edges.filter(F.col("predicate").isin(predicates)).select("source", "target", "predicate")
    return rows.join(pathways, "target", "left_semi").distinct()


def memberships_within(edges: DataFrame, ids: DataFrame, predicates: list[str]) -> DataFrame:
    """Distinct membership edges with both ends among ``ids``."""
    i = ids.select("node_id").distinct()
    rows = edges.filter(F.col("predicate").isin(predicates)).select("source", "target", "predicate")
    rows = rows.join(i.withColumnRenamed("node_id", "source"), "source", "left_semi")
    return rows.join(i.withColumnRenamed("node_id", "target"), "target", "left_semi").distinct()


def memberships_around(edges: DataFrame, ids: DataFrame, predicates: list[str]) -> DataFrame:
    """Distinct memberships of ``ids``, written from member to pathway."""
    rows = edges.filter(F.col("predicate").isin(predicates))
    return hop_edges(rows, ids, [])


def member_nodes(edges: DataFrame, sabs: DataFrame, nodes: DataFrame, predicates: list[str], pathway_sab: str, priority: list[str]) -> DataFrame:
    """All members of a vocabulary's pathways, described."""
    members = pathway_memberships(edges, sabs, predicates, pathway_sab)
    return described(members.select(F.col("source").alias("node_id")), nodes, priority)


def seed_coverage(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """(symbol, node_id) of symbols whose concept is named 'SYMBOL gene'; null where there is none."""
    genes = nodes.filter(F.col("name").endswith(" gene")).select(F.regexp_replace("name", r" gene\z", "").alias("symbol"), "node_id").groupBy("symbol").agg(F.min("node_id").alias("node_id"))
    return symbols.select("symbol").distinct().join(genes, "symbol", "left")


def lookup_symbols(symbols: DataFrame, nodes: DataFrame, sab: str = "HGNC") -> DataFrame:
    """(symbol, node_id): by the symbol as it stands, else in upper case; of several concepts the smallest id."""
    genes = nodes.filter((F.col("sab") == sab) & F.col("name").endswith(" gene")).select(F.regexp_replace("name", r" gene\z", "").alias("k"), "node_id")
    plain = genes.groupBy("k").agg(F.min("node_id").alias("plain_id"))
    upper = genes.groupBy(F.upper("k").alias("k")).agg(F.min("node_id").alias("upper_id"))
    out = symbols.select("symbol").distinct().join(plain, F.col("symbol") == plain["k"], "left").drop("k")
    out = out.join(upper, F.upper("symbol") == upper["k"], "left").drop("k")
    return out.select("symbol", F.coalesce("plain_id", "upper_id").alias("node_id"))
