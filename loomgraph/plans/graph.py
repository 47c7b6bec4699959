"""The knowledge graph of the given tables as DataFrames, and the same as SQL.

Ids in plain form, terms in one case; parallel edges stay apart. Rule tables are small DataFrames; ``load_rules`` of
``operators.conditioning`` reads complete ones from a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.ids import plain_id, plain_id_sql, term, term_sql
from loomgraph.operators.conditioning import COMPARTMENTS, Rules
from loomgraph.session import table

# Entity classes of the vocabularies here, their priority, and what each predicate conveys.
SAB_ENTITY = {
    "HGNC": "G", "NCBI": "G", "ENTREZ": "G", "ENSEMBL": "G", "UNIPROTKB": "P", "GO": "PW", "MSIGDB": "PW",
    "REACTOME": "PW", "WP": "PW", "HP": "PH", "MONDO": "DS", "CHEBI": "SM", "UBERON": "S",
}
ENTITY_PRIORITY = ["DS", "PH", "PW", "C", "CM", "P", "RNA", "CH", "G", "SM", "ION", "S", "X", "MECH"]
ID_RULES = [
    (r"(?:ENSEMBL:)?ENSG\d+", "G"), (r"(?:ENSEMBL:)?ENST\d+", "RNA"), (r"(?:ENSEMBL:)?ENSP\d+", "P"), (r"(?:REACTOME:)?R-HSA-\d+", "PW"),
    (r"UBERON:\d+", "S"), (r"HP:\d+", "PH"), (r"MONDO:\d+", "DS"), (r"CHEBI:\d+", "SM"), (r"GO:\d+", "PW"),
]
NON_FLOW = ["is_a", "part_of"]
OBSERVATIONAL = ["coexpressed_with", "gene_associated_with_disease_or_phenotype"]
FLOWS = [
    ("expressed_in", "Transcription", "mechanistic"),
    ("interacts_with", "Protein Interaction", "mechanistic"),
    ("regulates", "Signal Transduction", "mechanistic"),
    ("gene_encodes_gene_product", "Translation", "mechanistic"),
    ("located_in", "Spatial constraint", "contextual_constraint"),
    ("has_phenotype", "Molecular → Phenotype", "mechanistic"),
    ("inverse_pathway_associated_with_gene", "Pathway Contribution", "weak_mechanistic_or_observational"),
    ("pathway_associated_with_gene", "Pathway Contribution", "nonpropagating_context"),
    ("process_involves_gene", "Pathway Contribution", "weak_mechanistic_or_observational"),
]
OVERRIDES = [
    ("regulates", "P", "PW", "Pathway Contribution", "mechanistic"),
    ("regulates", "RNA", "P", "Translation Support", "mechanistic"),
]
MEMBER_FORWARD = ["pathway_associated_with_gene", "has_signature_gene", "process_involves_gene"]
MEMBER_REVERSE = ["inverse_pathway_associated_with_gene", "inverse_has_signature_gene", "gene_plays_role_in_process"]
GENE_SABS = ["HGNC", "NCBI", "ENTREZ", "NCBIGENE"]
PATHWAY_SABS = ["MSIGDB", "REACTOME", "GO", "WP"]
# Order in which vocabularies describe an id, when scored and when exported.
SAB_PRIORITY = ["MSIGDB", "REACTOME", "GO", "WIKIPATHWAYS", "KEGG", "WP", "HGNC", "NCBIGENE", "ENTREZ", "NCBI", "UNIPROTKB", "PR", "MONDO", "OMIM", "DOID"]
EXPORT_PRIORITY = ["HGNC", "NCBIGENE", "MSIGDB", "REACTOME", "GO", "MONDO", "OMIM"]


def rules(spark: SparkSession) -> Rules:
    return Rules.of(spark, SAB_ENTITY, ID_RULES, ENTITY_PRIORITY, NON_FLOW, OBSERVATIONAL, FLOWS, OVERRIDES)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, node_id, label, name, sab) of all rows with an id, the reference concepts too (negative row_ids)."""
    ref = table(spark, sf_dir, "reference_concepts").select((-F.dense_rank().over(_by_id())).cast("long").alias("row_id"), "node_id", "label", "name", "sab")
    rows = table(spark, sf_dir, "nodes").select("row_id", "node_id", "label", "name", "sab").unionByName(ref)
    rows = rows.select("row_id", plain_id("node_id").alias("node_id"), F.lower(F.trim("label")).alias("label"), "name", term("sab", "upper").alias("sab"))
    return rows.filter("node_id is not null")


def _by_id():
    from pyspark.sql import Window

    return Window.orderBy("node_id")  # 120 fixed rows


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_id, source, target, predicate, sab, confidence, evidence_type, value) of edges and memberships."""
    a = table(spark, sf_dir, "edges").withColumn("tbl", F.lit("edges"))
    b = table(spark, sf_dir, "pathway_membership_edges").withColumn("tbl", F.lit("membership"))
    rows = a.unionByName(b, allowMissingColumns=True)
    rows = rows.select("tbl", "row_id", plain_id("source").alias("source"), plain_id("target").alias("target"), term("predicate", "lower").alias("predicate"), "sab", "confidence", "evidence_type", "value")
    return rows.filter("source is not null and target is not null")


def seeds(spark: SparkSession, sf_dir: str, role: str = "seed") -> DataFrame:
    return table(spark, sf_dir, "reference_concepts").filter(F.col("role") == role).select("node_id")


def _values(rows: list) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


GRAPH = f"""g_nodes AS (SELECT row_id, id AS node_id, lower(trim(label)) AS label, name, t AS sab FROM (
 SELECT row_id, {plain_id_sql("node_id")} AS id, label, name, {term_sql("sab", "upper")} AS t FROM nodes
 UNION ALL SELECT -row_number() OVER (ORDER BY node_id), node_id, label, name, sab FROM reference_concepts) WHERE id IS NOT NULL),
g_edges AS (SELECT * FROM (
 SELECT 'edges' AS tbl, row_id, {plain_id_sql("source")} AS source, {plain_id_sql("target")} AS target, {term_sql("predicate", "lower")} AS predicate, sab, confidence, evidence_type, value FROM edges
 UNION ALL SELECT 'membership', row_id, {plain_id_sql("source")}, {plain_id_sql("target")}, {term_sql("predicate", "lower")}, NULL, NULL, NULL, NULL FROM pathway_membership_edges)
 WHERE source IS NOT NULL AND target IS NOT NULL),
seeds AS (SELECT node_id FROM reference_concepts WHERE role = 'seed'), heldout AS (SELECT node_id FROM reference_concepts WHERE role = 'heldout'),
refs AS (SELECT node_id FROM reference_concepts WHERE role = 'pathway')"""

TYPING = f"""priority(entity, prio) AS (VALUES {", ".join(f"('{e}', {i})" for i, e in enumerate(ENTITY_PRIORITY))}),
sab_entity(sab, entity) AS (VALUES {_values(list(SAB_ENTITY.items()))}),
row_entity AS (SELECT n.node_id, CASE WHEN coalesce(n.sab IN ('GO', 'GOCC'), false) OR (label = 'code' AND starts_with(n.node_id, 'GO:')) THEN CASE
  WHEN contains(lower(n.name), 'complex') THEN 'CM' WHEN regexp_matches(lower(n.name), '{"|".join(COMPARTMENTS)}') THEN 'S' ELSE 'PW' END
 ELSE coalesce(CASE WHEN n.sab = 'ENSEMBL' THEN CASE WHEN regexp_matches(n.node_id, '(^|:)ENSG[^:]*$') THEN 'G' WHEN regexp_matches(n.node_id, '(^|:)ENST[^:]*$') THEN 'RNA'
  WHEN regexp_matches(n.node_id, '(^|:)ENSP[^:]*$') THEN 'P' END END, s.entity, {" ".join(["CASE"] + [f"WHEN regexp_matches(n.node_id, '^(?:{p})') THEN '{e}'" for p, e in ID_RULES] + ["END"])}) END AS entity
 FROM g_nodes n LEFT JOIN sab_entity s ON n.sab = s.sab WHERE label IN ('concept', 'code')),
typed AS (SELECT node_id, arg_min(r.entity, p.prio) AS entity FROM row_entity r LEFT JOIN priority p ON r.entity = p.entity GROUP BY 1)"""

CONDITIONED = f"""flows(predicate, flow, class) AS (VALUES {_values(FLOWS)}),
overrides(predicate, source_entity, target_entity, flow, class) AS (VALUES {_values(OVERRIDES)}),
resolved AS (SELECT e.*, s.entity AS source_entity, t.entity AS target_entity, s.node_id IS NOT NULL AND t.node_id IS NOT NULL AS known,
 e.predicate IN ({", ".join(f"'{x}'" for x in NON_FLOW)}) AS non_flow, e.predicate IN ({", ".join(f"'{x}'" for x in OBSERVATIONAL)}) AS observed,
 o.flow AS o_flow, o.class AS o_class, f.flow AS f_flow, f.class AS f_class
 FROM g_edges e LEFT JOIN typed s ON e.source = s.node_id LEFT JOIN typed t ON e.target = t.node_id
 LEFT JOIN overrides o ON e.predicate = o.predicate AND s.entity = o.source_entity AND t.entity = o.target_entity
 LEFT JOIN flows f ON e.predicate = f.predicate),
conditioned AS (SELECT tbl, row_id, source, target, predicate, confidence, evidence_type, value, source_entity, target_entity,
 CASE WHEN coalesce(non_flow, false) THEN NULL WHEN coalesce(observed, false) THEN 'Observational Association' ELSE coalesce(o_flow, f_flow) END AS flow_class,
 CASE WHEN coalesce(non_flow, false) THEN NULL WHEN coalesce(observed, false) THEN 'observational' ELSE coalesce(o_class, f_class) END AS classification,
 CASE WHEN source_entity IS NULL OR target_entity IS NULL THEN 'unresolved' WHEN coalesce(non_flow, false) THEN 'non_flow'
  WHEN coalesce(observed, false) OR o_flow IS NOT NULL OR f_flow IS NOT NULL THEN NULL ELSE 'unmapped' END AS drop_reason
 FROM resolved WHERE known),
kept AS (SELECT *, classification IN ('mechanistic', 'weak_mechanistic_or_observational') AS propagating FROM conditioned WHERE drop_reason IS NULL)"""

MEMBERS = f"""member_rows AS (SELECT source AS pathway, target AS gene FROM g_edges WHERE predicate IN ({", ".join(f"'{x}'" for x in MEMBER_FORWARD)})
 UNION SELECT target, source FROM g_edges WHERE predicate IN ({", ".join(f"'{x}'" for x in MEMBER_REVERSE)})),
best_sab AS (SELECT node_id, arg_min(sab, rank * 100000000000 + row_id) AS sab FROM (SELECT *, CASE sab {" ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SAB_PRIORITY))} ELSE {len(SAB_PRIORITY)} END AS rank
 FROM g_nodes WHERE sab IS NOT NULL) GROUP BY 1),
members AS (SELECT DISTINCT m.pathway, m.gene FROM member_rows m JOIN best_sab p ON m.pathway = p.node_id JOIN best_sab g ON m.gene = g.node_id
 WHERE p.sab IN ({", ".join(f"'{x}'" for x in PATHWAY_SABS)}) AND g.sab IN ({", ".join(f"'{x}'" for x in GENE_SABS)}))"""


def transitions_sql(name: str, where: str, source: str = "kept") -> str:
    """Row-normalised transitions: parallel edges add up."""
    return f"""{name} AS (SELECT source AS src, target AS dst, count(*) / sum(count(*)) OVER (PARTITION BY source) AS p FROM {source} WHERE {where} GROUP BY 1, 2)"""


def pagerank_sql(name: str, transitions: str, graph_nodes: str, iterations: int, alpha: float, normalize: bool = True) -> str:
    """Recursive CTEs ``name``(node_id, score) after a fixed number of steps."""
    start = f"(SELECT node_id, 1.0 / count(*) OVER () AS s FROM seeds WHERE node_id IN (SELECT node_id FROM {graph_nodes}))"
    scale = "score / sum(score) OVER ()" if normalize else "score"
    return f"""{name}_steps AS (SELECT 0 AS i, node_id, s::DOUBLE AS score FROM {start}
 UNION ALL SELECT i + 1, node_id, sum(v) FROM (
  SELECT f.i, t.dst AS node_id, {1 - alpha} * t.p * f.score AS v FROM {name}_steps f JOIN {transitions} t ON f.node_id = t.src WHERE f.i < {iterations}
  UNION ALL SELECT k.i, s.node_id, {alpha} * s.s FROM (SELECT DISTINCT i FROM {name}_steps WHERE i < {iterations}) k, {start} s) GROUP BY i, node_id),
{name} AS (SELECT node_id, {scale} AS score FROM {name}_steps WHERE i = {iterations})"""
