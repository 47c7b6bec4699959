"""Queries of the graph pipeline over the given tables, and the same in SQL.

Scores are compared after scaling by 1e6 and rounding, so that the order of additions does not matter.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars, stats
from loomgraph.functions.ids import WHITE, plain_id, plain_id_sql, term, term_sql
from loomgraph.operators import conditioning, enrich, membership, nulls, patterns, propagate, resample, scoring
from loomgraph.plans import graph, problems
from loomgraph.plans.graph import CONDITIONED, EXPORT_PRIORITY, GENE_SABS, GRAPH, MEMBER_FORWARD, MEMBER_REVERSE, MEMBERS, PATHWAY_SABS, SAB_PRIORITY, TYPING, pagerank_sql, transitions_sql
from loomgraph.session import broadcast_if_small, stage, staged_path, table
from loomgraph.sources import files

ALPHA, STEPS = propagate.ALPHA, propagate.steps_for(propagate.ALPHA)
LEAST_MEMBERS, MOST_MEMBERS = 4, 300
EXCLUDED_HOPS = ["part_of", "is_a"]
MEMBERSHIPS = MEMBER_FORWARD + MEMBER_REVERSE

QUERIES: dict = {}
ON_GRAPH: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        ON_GRAPH[f.__name__] = f
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def micro(c: str):
    """A score in millionths, rounded."""
    return F.round(F.col(c) * 1e6, 3).alias(c)


def nano(scores: DataFrame) -> DataFrame:
    """Scores rounded so that equal ones tie."""
    return scores.withColumn("score", F.round(F.col("score") * 1e9, 0) / 1e9)


class Graph:
    """The graph of one query's tables, each part computed once: what several steps read is written first."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def role(self, role: str) -> DataFrame:
        return graph.seeds(self.spark, self.dir, role)

    @cached_property
    def rules(self):
        return graph.rules(self.spark)

    @cached_property
    def seeds(self) -> DataFrame:
        return self.role("seed")

    @cached_property
    def refs(self) -> DataFrame:
        return self.role("pathway")

    @cached_property
    def nodes(self) -> DataFrame:
        return graph.nodes(self.spark, self.dir)

    @cached_property
    def edges(self) -> DataFrame:
        return graph.edges(self.spark, self.dir)

    def hold(self) -> None:
        """Write nodes and edges in plain form, for plans that read them more than once."""
        if "held" not in self.__dict__:
            self.held = True
            self.nodes, self.edges = stage(self.nodes, "nodes"), stage(self.edges, "edges")

    @cached_property
    def typed(self) -> DataFrame:
        return conditioning.node_entities(self.nodes, self.rules)

    @cached_property
    def conditioned(self) -> DataFrame:
        return conditioning.condition_edges(self.edges, self.typed, self.rules)

    def hold_conditioned(self) -> None:
        if "held_conditioned" not in self.__dict__:
            self.hold()
            self.held_conditioned = True
            self.typed = stage(self.typed, "typed")
            self.conditioned = stage(self.conditioned, "conditioned")

    @cached_property
    def kept(self) -> DataFrame:
        self.hold_conditioned()
        return conditioning.kept(self.conditioned)

    @property
    def moving(self) -> DataFrame:
        return self.kept.filter("propagating")

    def moves(self, edges: DataFrame) -> DataFrame:
        return conditioning.row_normalized(conditioning.unit_operator(edges))

    def ends(self, edges: DataFrame) -> DataFrame:
        return edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()

    def scores(self, edges: DataFrame, normalize: bool = True) -> DataFrame:
        return propagate.pagerank(self.moves(edges), self.seeds, self.ends(edges), ALPHA, STEPS, normalize)

    @cached_property
    def cond_scores(self) -> DataFrame:
        return self.scores(self.moving)

    def hold_scores(self) -> None:
        """Write the conditioned scores, for queries with several plans on them."""
        if "held_scores" not in self.__dict__:
            self.held_scores = True
            self.cond_scores = stage(self.cond_scores, "scores")

    @cached_property
    def raw_scores(self) -> DataFrame:
        self.hold_conditioned()
        return self.scores(self.conditioned)

    @cached_property
    def sabs(self) -> DataFrame:
        return membership.best_sab(self.nodes, SAB_PRIORITY)

    @cached_property
    def members(self) -> DataFrame:
        return membership.checked_members(self.edges, self.sabs, MEMBER_FORWARD, MEMBER_REVERSE, PATHWAY_SABS, GENE_SABS)

    @cached_property
    def sized(self) -> DataFrame:
        self.hold()
        return stage(membership.sized(stage(self.members, "all-members"), LEAST_MEMBERS, MOST_MEMBERS), "members")

    @cached_property
    def sizes(self) -> DataFrame:
        return self.sized.groupBy("pathway").agg(F.count("*").alias("member_gene_count"))


# --- sources and cleaning --------------------------------------------------------------------------------------------


@query(f"""SELECT row_id, {plain_id_sql("node_id")} AS node_id, coalesce(label, '') AS label, coalesce(name, '') AS name, coalesce(sab, '') AS sab FROM nodes""")
def s1_text_table(g):
    rows = g.table("nodes").select("row_id", plain_id("node_id").alias("node_id"), "label", "name", "sab")
    return rows.fillna("", ["label", "name", "sab"])


@query("""SELECT row_id, try_cast(trim(confidence) AS DOUBLE) AS confidence, try_cast(trim(value) AS DOUBLE) AS value FROM edges
WHERE regexp_matches(trim(confidence), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')""")
def s2_typed_table(g):
    rows = g.table("edges").select("row_id", scalars.safe_double(F.col("confidence")).alias("confidence"), scalars.safe_double(F.col("value")).alias("value"))
    return rows.filter("confidence is not null")


@query(f"""SELECT layout, count(*) AS n_lines, count(*) FILTER (NOT regexp_matches(ltrim(coalesce(line, '')), '^(WARNING|Failed|java[.])')
 AND trim(coalesce(line, ''), {" || ".join(f"chr({ord(x)})" for x in WHITE)}) <> '') AS n_rows FROM raw_export_lines GROUP BY 1""")
def s7_shell_messages(g):
    line = F.coalesce("line", F.lit(""))
    row = ~F.ltrim(line).rlike(r"^(WARNING|Failed|java\.)") & (F.btrim(line, F.lit(WHITE)) != "")
    return g.table("raw_export_lines").groupBy("layout").agg(F.count("*").alias("n_lines"), F.count(F.when(row, 1)).alias("n_rows"))


@query(f"SELECT 'nodes' AS layout, count(*) AS n FROM ({problems.P5_NODES}) UNION ALL SELECT 'edges', count(*) FROM ({problems.P5_EDGES})")
def s7_clean_export(g):
    lines = g.table("raw_export_lines")
    nodes, edges = (files.clean_export(lines, layout).agg(F.count("*").alias("n")).withColumn("layout", F.lit(layout)) for layout in ("nodes", "edges"))
    return nodes.unionByName(edges)


@query("""SELECT source, target, predicate, coalesce(sab, '') AS sab, coalesce(confidence, '') AS confidence, count(*) AS n FROM (
 SELECT coalesce(source, '') AS source, coalesce(target, '') AS target, coalesce(predicate, '') AS predicate, sab, confidence FROM edges) GROUP BY ALL""")
def s9_gzip_files(g):
    """Edges written as gzip CSV files and read again as text."""
    columns = ["source", "target", "predicate", "sab", "confidence"]
    path = staged_path(g.spark, "edges-csv")
    files.write_text_table(g.table("edges").select(columns), path, gzip=True)
    return files.read_text_table(g.spark, path, ",", True).groupBy(*columns).agg(F.count("*").alias("n"))


@query(f"""WITH {GRAPH} SELECT tbl, predicate, count(*) AS n FROM g_edges GROUP BY 1, 2""")
def s8_merge_edges(g):
    return g.edges.groupBy("tbl", "predicate").agg(F.count("*").alias("n"))


@query()
def s12_manifest(g):
    from loomgraph.sources.files import manifest

    return manifest(g.spark, g.dir)


@query(f"""WITH {GRAPH} SELECT node_id, min(regexp_replace(name, ' gene$', '')) AS symbol FROM g_nodes WHERE name LIKE '% gene' AND node_id LIKE 'C%' GROUP BY 1""")
def s13_symbols(g):
    rows = g.nodes.filter(F.col("name").endswith(" gene") & F.col("node_id").startswith("C"))
    return rows.groupBy("node_id").agg(F.min(F.regexp_replace("name", r" gene\z", "")).alias("symbol"))


# --- graph patterns --------------------------------------------------------------------------------------------------


def _rank_sql(priority: list[str]) -> str:
    return "CASE sab " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(priority)) + f" ELSE {len(priority)} END"


_DESCRIBE = f"""ex_sab AS (SELECT node_id, arg_min(sab, {_rank_sql(EXPORT_PRIORITY)} * 100000000000 + row_id) AS sab FROM g_nodes WHERE sab IS NOT NULL GROUP BY 1),
ex_name AS (SELECT node_id, min(name) AS name FROM g_nodes WHERE name IS NOT NULL GROUP BY 1)"""
_DESCRIBED = """SELECT i.node_id, 'Concept' AS label, coalesce(name, i.node_id) AS name, coalesce(sab, 'UNKNOWN') AS sab
FROM (SELECT DISTINCT node_id FROM {ids}) i LEFT JOIN ex_name n ON i.node_id = n.node_id LEFT JOIN ex_sab s ON i.node_id = s.node_id"""
_EXCLUDED = ", ".join(f"'{x}'" for x in EXCLUDED_HOPS)
_MEMBERSHIPS = ", ".join(f"'{x}'" for x in MEMBERSHIPS)
_HOP = f"""hop AS (SELECT source, target, predicate FROM g_edges WHERE predicate NOT IN ({_EXCLUDED}) AND source IN (SELECT node_id FROM seeds)
 UNION SELECT target, source, predicate FROM g_edges WHERE predicate NOT IN ({_EXCLUDED}) AND target IN (SELECT node_id FROM seeds))"""


@query(f"""WITH {GRAPH}, {_DESCRIBE}, ids AS (SELECT node_id FROM g_nodes WHERE name IN (SELECT name FROM reference_concepts WHERE role = 'seed')) {_DESCRIBED.format(ids="ids")}""")
def g1_seed_concepts(g):
    names = g.table("reference_concepts").filter("role = 'seed'").select("name")
    return patterns.seed_concepts(g.nodes, names, EXPORT_PRIORITY)


@query(f"WITH {GRAPH}, {_HOP} SELECT * FROM hop")
def g2_hop_edges(g):
    return patterns.hop_edges(g.edges, g.seeds, EXCLUDED_HOPS)


@query(f"""WITH {GRAPH} SELECT tbl, row_id, source, target, predicate FROM g_edges WHERE predicate NOT IN ({_EXCLUDED})
AND (source IN (SELECT node_id FROM seeds) OR target IN (SELECT node_id FROM seeds))""")
def g3_directed_edges(g):
    return patterns.directed_edges(g.edges, g.seeds, EXCLUDED_HOPS).select("tbl", "row_id", "source", "target", "predicate")


@query(f"WITH {GRAPH}, {_DESCRIBE}, {_HOP}, ids AS (SELECT source AS node_id FROM hop UNION SELECT target FROM hop) {_DESCRIBED.format(ids='ids')}")
def g4_hop_nodes(g):
    return patterns.hop_nodes(g.edges, g.seeds, g.nodes, EXCLUDED_HOPS, EXPORT_PRIORITY)


_G5 = f"""pw AS (SELECT DISTINCT node_id FROM g_nodes WHERE sab = 'MSIGDB'),
mship AS (SELECT DISTINCT source, target, predicate FROM g_edges WHERE predicate IN ({", ".join(f"'{x}'" for x in MEMBER_REVERSE)}) AND target IN (SELECT node_id FROM pw))"""


@query(f"WITH {GRAPH}, {_G5} SELECT * FROM mship")
def g5_memberships(g):
    return patterns.pathway_memberships(g.edges, g.nodes, MEMBER_REVERSE, "MSIGDB")


@query(f"""WITH {GRAPH}, {_HOP}, ids AS (SELECT source AS node_id FROM hop UNION SELECT target FROM hop) SELECT DISTINCT source, target, predicate FROM g_edges
WHERE predicate IN ({_MEMBERSHIPS}) AND source IN (SELECT node_id FROM ids) AND target IN (SELECT node_id FROM ids)""")
def g6_memberships_within(g):
    near = patterns.hop_edges(g.edges, g.seeds, EXCLUDED_HOPS)
    return patterns.memberships_within(g.edges, g.ends(near), MEMBERSHIPS)


@query(f"""WITH {GRAPH}, {_HOP}, ids AS (SELECT source AS node_id FROM hop UNION SELECT target FROM hop), m AS (SELECT * FROM g_edges WHERE predicate IN ({_MEMBERSHIPS}))
SELECT source, target, predicate FROM m WHERE source IN (SELECT node_id FROM ids) UNION SELECT target, source, predicate FROM m WHERE target IN (SELECT node_id FROM ids)""")
def g7_memberships_around(g):
    near = patterns.hop_edges(g.edges, g.seeds, EXCLUDED_HOPS)
    return patterns.memberships_around(g.edges, g.ends(near), MEMBERSHIPS)


@query(f"WITH {GRAPH}, {_DESCRIBE}, {_G5}, ids AS (SELECT source AS node_id FROM mship) {_DESCRIBED.format(ids='ids')}")
def g8_member_nodes(g):
    return patterns.member_nodes(g.edges, g.nodes, g.nodes, MEMBER_REVERSE, "MSIGDB", EXPORT_PRIORITY)


@query(f"""WITH {GRAPH}, g AS (SELECT regexp_replace(name, ' gene$', '') AS symbol, min(node_id) AS node_id FROM g_nodes WHERE name LIKE '% gene' GROUP BY 1)
SELECT s.symbol, g.node_id FROM (SELECT DISTINCT regexp_replace(name, ' gene$', '') AS symbol FROM reference_concepts WHERE role IN ('seed', 'heldout')) s LEFT JOIN g ON s.symbol = g.symbol""")
def g10_seed_coverage(g):
    symbols = g.table("reference_concepts").filter("role in ('seed', 'heldout')").select(F.regexp_replace("name", r" gene\z", "").alias("symbol"))
    return patterns.seed_coverage(symbols, g.nodes)


# --- projections and scalar rules ------------------------------------------------------------------------------------


@query(f"""SELECT row_id, regexp_replace(trim(node_id, {" || ".join(f"chr({ord(x)})" for x in WHITE)}), ' CUI$', '') AS node_id FROM nodes""")
def proj1_strip_marks(g):
    return g.table("nodes").select("row_id", scalars.strip_cui(F.col("node_id")).alias("node_id"))


@query("SELECT row_id, coalesce(nullif(confidence, ''), nullif(value, ''), nullif(evidence_type, '')) AS first FROM edges")
def proj2_first_non_empty(g):
    return g.table("edges").select("row_id", scalars.first_non_empty(F.col("confidence"), F.col("value"), F.col("evidence_type")).alias("first"))


@query(f"""WITH {GRAPH} SELECT row_id, {" ".join(["CASE"] + [f"WHEN regexp_matches(node_id, '^(?:{p})') THEN '{e}'" for p, e in graph.ID_RULES] + ["END"])} AS entity FROM g_nodes""")
def proj3_entity_by_id(g):
    return g.nodes.select("row_id", scalars.by_rules(F.col("node_id"), graph.ID_RULES).alias("entity"))


@query(f"""WITH {GRAPH} SELECT row_id, CASE WHEN regexp_matches(node_id, '(^|:)ENST') THEN 'RNA' WHEN regexp_matches(node_id, '(^|:)ENSP') THEN 'P' ELSE 'G' END AS entity
FROM g_nodes WHERE sab = 'ENSEMBL' AND label IN ('concept', 'code')""")
def proj4_ensembl_entity(g):
    rows = g.nodes.filter("sab = 'ENSEMBL'")
    keyed = rows.withColumn("node_id", F.concat_ws("\t", "node_id", "row_id"))
    typed = conditioning.row_entities(keyed, g.rules)
    return typed.select(F.substring_index("node_id", "\t", -1).cast("long").alias("row_id"), "entity")


@query(f"""WITH {GRAPH} SELECT row_id, CASE WHEN contains(lower(name), 'complex') THEN 'CM' WHEN regexp_matches(lower(name), '{"|".join(conditioning.COMPARTMENTS)}') THEN 'S' ELSE 'PW' END AS entity
FROM g_nodes WHERE (sab IN ('GO', 'GOCC') OR (label = 'code' AND starts_with(node_id, 'GO:'))) AND label IN ('concept', 'code')""")
def proj5_go_entities(g):
    """Terms of the ontology through the typing of all rows: their keys carry the row."""
    rows = g.nodes.filter(F.col("sab").isin("GO", "GOCC") | ((F.col("label") == "code") & F.col("node_id").startswith("GO:")))
    typed = conditioning.row_entities(rows.withColumn("node_id", F.concat_ws("\t", "node_id", "row_id")), g.rules)
    return typed.select(F.substring_index("node_id", "\t", -1).cast("long").alias("row_id"), "entity")


@query("SELECT lower(trim(label)) AS label, count(*) AS n FROM nodes GROUP BY 1")
def proj6_labels(g):
    return g.table("nodes").groupBy(F.lower(F.trim("label")).alias("label")).agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT row_id, upper(coalesce(name, '')) AS u, coalesce({term_sql("sab", "upper")}, '') AS s, member_gene_count AS m FROM pathway_scores_standard)
SELECT row_id FROM r WHERE m BETWEEN 8 AND 300 AND NOT contains(u, '_DEGRADATION') AND (s <> 'MSIGDB' OR u LIKE 'CORE%' OR u LIKE 'ATLAS%')""")
def proj7_pathway_filter(g):
    rows = g.table("pathway_scores_standard").withColumn("s", term("sab", "upper"))
    named = membership.name_allowed(F.col("name"), F.col("s"), ["_DEGRADATION"], ["CORE", "ATLAS"], "MSIGDB")
    return rows.filter(F.col("member_gene_count").between(8, 300) & named).select("row_id")


@query(f"WITH {GRAPH} SELECT DISTINCT node_id FROM (SELECT source AS node_id FROM g_edges UNION ALL SELECT target FROM g_edges) WHERE regexp_matches(node_id, '^C[0-9]')")
def proj8_gene_ends(g):
    return enrich.gene_universe(g.edges)


NAME_PATTERNS = ["signaling", "transport", "channel.subunit", "binding.factor", r"\brepair\b"]


@query(f"SELECT row_id, sab, name FROM pathway_scores_standard WHERE regexp_matches(lower(name), '{'|'.join(NAME_PATTERNS)}')")
def proj9_name_patterns(g):
    return g.table("pathway_scores_standard").filter(F.lower("name").rlike("|".join(NAME_PATTERNS))).select("row_id", "sab", "name")


@query("SELECT row_id, CASE WHEN isnan(null_z) THEN NULL ELSE null_z END AS null_z, coalesce(lower(degree_flag::VARCHAR) IN ('true', '1', 'yes'), false) AS flag FROM pathway_scores_standard")
def proj10_safe_values(g):
    rows = g.table("pathway_scores_standard")
    flag = F.coalesce(scalars.safe_bool(F.col("degree_flag").cast("string")), F.lit(False))
    return rows.select("row_id", F.when(~F.isnan("null_z"), F.col("null_z")).alias("null_z"), flag.alias("flag"))


@query("SELECT row_id, round(sqrt(abs(direct)), 9) AS root, round(log2(1 + abs(direct)), 9) AS bits, round(-log10(greatest(empirical_p, 1e-300)), 6) AS minus_log_p FROM pathway_scores_standard WHERE direct IS NOT NULL AND NOT isnan(direct) AND empirical_p IS NOT NULL AND NOT isnan(empirical_p)")
def proj14_math(g):
    rows = g.table("pathway_scores_standard").filter("direct is not null and not isnan(direct) and empirical_p is not null and not isnan(empirical_p)")
    size = F.abs("direct")
    return rows.select("row_id", F.round(F.sqrt(size), 9).alias("root"), F.round(F.log2(1 + size), 9).alias("bits"), F.round(-F.log10(F.greatest("empirical_p", F.lit(1e-300))), 6).alias("minus_log_p"))


@query("""SELECT row_id, regexp_replace(name, ' gene$', '') AS symbol, array_to_string(list_sort(string_split(contributing_seeds, '|')), ';') AS seeds FROM pathway_scores_standard""")
def proj11_formats(g):
    rows = g.table("pathway_scores_standard")
    return rows.select("row_id", F.regexp_replace("name", r" gene\z", "").alias("symbol"), F.array_join(F.array_sort(F.split("contributing_seeds", r"\|")), ";").alias("seeds"))


_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _weight_sql(prefix: str = "") -> str:
    given = f"coalesce(nullif(trim({prefix}confidence), ''), nullif(trim({prefix}value), ''))"
    number = f"CASE WHEN regexp_matches({given}, '{_NUMBER}') AND abs(try_cast({given} AS DOUBLE)) < 'inf'::DOUBLE THEN try_cast({given} AS DOUBLE) END"
    tier = " ".join(f"WHEN '{k}' THEN {v}" for k, v in scalars.EVIDENCE_WEIGHT.items())
    return f"coalesce({number}, CASE lower(trim({prefix}evidence_type)) {tier} END, {scalars.DEFAULT_WEIGHT})"


@query(f"SELECT row_id, round({_weight_sql()}, 9) AS weight FROM edges")
def proj12_edge_weights(g):
    return g.table("edges").select("row_id", F.round(scalars.edge_weight(F.col("confidence"), F.col("value"), F.col("evidence_type")), 9).alias("weight"))


@query("SELECT row_id, CASE WHEN length(replace(name, '_', ' ')) > 30 THEN left(replace(name, '_', ' '), 27) || '...' ELSE replace(name, '_', ' ') END AS shown, CASE upper(trim(sab)) WHEN 'WP' THEN 'WikiPathways' ELSE sab END AS source FROM pathway_scores_standard")
def proj15_display_names(g):
    plain = F.replace("name", F.lit("_"), F.lit(" "))
    shown = F.when(F.length(plain) > 30, F.concat(F.left(plain, F.lit(27)), F.lit("..."))).otherwise(plain)
    return g.table("pathway_scores_standard").select("row_id", shown.alias("shown"), F.when(F.upper(F.trim("sab")) == "WP", "WikiPathways").otherwise(F.col("sab")).alias("source"))


# --- joins -----------------------------------------------------------------------------------------------------------

_TYPED = f"WITH {GRAPH}, {TYPING}"


@query(f"{_TYPED} SELECT e.tbl, e.row_id FROM g_edges e JOIN typed s ON e.source = s.node_id JOIN typed t ON e.target = t.node_id")
def j1_concept_edges(g):
    return conditioning.concept_edges(g.edges, g.typed).select("tbl", "row_id")


@query(f"{_TYPED} SELECT e.tbl, e.row_id, s.entity AS source_entity, t.entity AS target_entity FROM g_edges e JOIN typed s ON e.source = s.node_id JOIN typed t ON e.target = t.node_id")
def j2_end_entities(g):
    return conditioning.concept_edges(g.edges, g.typed).select("tbl", "row_id", "source_entity", "target_entity")


_CODES = TYPING.replace("label IN ('concept', 'code')", "label = 'code'")


@query(f"WITH {GRAPH}, {_CODES} SELECT node_id, entity FROM typed")
def j4_code_entities(g):
    return conditioning.node_entities(g.nodes.filter("label = 'code'"), g.rules)


@query(f"WITH {GRAPH}, {MEMBERS} SELECT pathway, gene FROM members")
def j5_members(g):
    return g.members


@query(f"""WITH {GRAPH}, g AS (SELECT regexp_replace(name, ' gene$', '') AS k, node_id FROM g_nodes WHERE sab = 'HGNC' AND name LIKE '% gene'),
s AS (SELECT DISTINCT lower(regexp_replace(name, ' gene$', '')) AS symbol FROM nodes WHERE name LIKE '% gene')
SELECT symbol, coalesce((SELECT min(node_id) FROM g WHERE k = symbol), (SELECT min(node_id) FROM g WHERE upper(k) = upper(symbol))) AS node_id FROM s""")
def j7_symbol_lookup(g):
    symbols = g.table("nodes").filter(F.col("name").endswith(" gene")).select(F.lower(F.regexp_replace("name", r" gene\z", "")).alias("symbol"))
    return patterns.lookup_symbols(symbols, g.nodes)


@query(f"""WITH {GRAPH}, ids AS (SELECT name, min(node_id) AS node_id FROM g_nodes WHERE name IS NOT NULL GROUP BY 1)
SELECT row_id, coalesce(ids.node_id, {plain_id_sql("concept_id")}) AS id FROM pathway_scores_standard s LEFT JOIN ids ON s.name = ids.name""")
def j8_ids_by_name(g):
    ids = g.nodes.filter("name is not null").groupBy("name").agg(F.min("node_id").alias("node_id"))
    rows = g.table("pathway_scores_standard").select("row_id", "name", plain_id("concept_id").alias("own"))
    return rows.join(ids, "name", "left").select("row_id", F.coalesce("node_id", "own").alias("id"))


@query(f"WITH {GRAPH}, {MEMBERS} SELECT pathway, count(*) AS n_seeds FROM members WHERE gene IN (SELECT node_id FROM seeds) GROUP BY 1")
def j9_seed_overlap(g):
    inside = g.members.join(g.seeds.withColumnRenamed("node_id", "gene"), "gene", "left_semi")
    return inside.groupBy("pathway").agg(F.count("*").alias("n_seeds"))


@query(f"WITH {GRAPH}, {MEMBERS}, u AS (SELECT DISTINCT {plain_id_sql('concept_id')} AS id FROM pathway_scores_standard) SELECT pathway, count(*) AS n FROM members WHERE pathway IN (SELECT id FROM u) GROUP BY 1")
def j10_scored_universe(g):
    scored = g.table("pathway_scores_standard").select(plain_id("concept_id").alias("pathway")).distinct()
    return g.members.join(scored, "pathway", "left_semi").groupBy("pathway").agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT {plain_id_sql("concept_id")} AS id, run_id LIKE '%PRIMARY' AS main, max(CASE WHEN isnan(degree_norm) THEN NULL ELSE degree_norm END) AS v FROM pathway_scores_standard GROUP BY ALL)
SELECT a.id, round(a.v * 1e6, 3) + 0.0 AS v_primary, round(max(b.v) * 1e6, 3) + 0.0 AS v_resampled FROM r a JOIN r b ON a.id = b.id WHERE a.main AND NOT b.main GROUP BY a.id, a.v""")
def j11_shared_pathways(g):
    rows = g.table("pathway_scores_standard").select(plain_id("concept_id").alias("id"), F.col("run_id").endswith("PRIMARY").alias("main"), F.when(~F.isnan("degree_norm"), F.col("degree_norm")).alias("v"))
    a = rows.filter("main").groupBy("id").agg(F.max("v").alias("v_primary"))
    b = rows.filter("not main").groupBy("id").agg(F.max("v").alias("v_resampled"))
    return a.join(b, "id").select("id", *((F.round(F.col(c) * 1e6, 3) + F.lit(0.0)).alias(c) for c in ("v_primary", "v_resampled")))


# --- conditioning ----------------------------------------------------------------------------------------------------

_COND = f"{_TYPED}, {CONDITIONED}"


@query(f"{_TYPED} SELECT node_id, entity, count(*) AS n FROM row_entity GROUP BY 1, 2")
def c1_row_entities(g):
    return conditioning.row_entities(g.nodes, g.rules).groupBy("node_id", "entity").agg(F.count("*").alias("n"))


@query(f"{_TYPED} SELECT node_id, entity FROM typed")
def c2_node_entities(g):
    return g.typed


@query(f"{_TYPED} SELECT count(*) AS concepts, count(entity) AS resolved, round(count(entity) / count(*), 9) AS coverage FROM typed")
def c3_coverage(g):
    return conditioning.coverage(g.nodes, g.typed).withColumn("coverage", F.round("coverage", 9))


@query(f"{_COND} SELECT tbl, row_id, flow_class, classification, drop_reason FROM conditioned")
def c5_condition_edges(g):
    return g.conditioned.select("tbl", "row_id", "flow_class", "classification", "drop_reason")


@query(f"WITH {GRAPH} SELECT tbl, predicate, count(*) AS n FROM g_edges WHERE predicate IS NULL OR predicate NOT IN ({', '.join(repr(x) for x in graph.NON_FLOW)}) GROUP BY 1, 2")
def c6_metadata_filtered(g):
    return conditioning.metadata_filtered(g.edges, g.rules).groupBy("tbl", "predicate").agg(F.count("*").alias("n"))


@query(f"{_COND} SELECT tbl, row_id FROM kept WHERE classification = 'mechanistic'")
def c7_mechanistic(g):
    return conditioning.mechanistic(conditioning.kept(g.conditioned)).select("tbl", "row_id")


_SPARSE = """sparse AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('1|' || tbl || '|' || row_id), tbl, row_id) AS k FROM conditioned)
 WHERE k <= (SELECT count(*) FROM kept WHERE propagating))"""


@query(f"{_COND}, {_SPARSE} SELECT tbl, row_id FROM sparse")
def c8_sparsified(g):
    return _sparsified(g).select("tbl", "row_id")


def _sparsified(g: Graph) -> DataFrame:
    """As many edges between concepts, at random, as propagate."""
    g.hold_conditioned()
    return conditioning.sparsify(g.conditioned, g.conditioned.filter("propagating").count(), ["tbl", "row_id"])


@query(f"{_COND} SELECT source AS src, target AS dst, round(sum({_weight_sql()}), 6) AS w FROM kept WHERE propagating GROUP BY 1, 2")
def c9_weighted_operator(g):
    return conditioning.weighted_operator(conditioning.kept(g.conditioned).filter("propagating")).withColumn("w", F.round("w", 6))


@query(f"{_COND}, {transitions_sql('t', 'propagating')} SELECT src, dst, round(p, 9) AS p FROM t")
def c10_transitions(g):
    return g.moves(conditioning.kept(g.conditioned).filter("propagating")).withColumn("p", F.round("p", 9))


@query(f"{_COND} SELECT flow_class, count(*) AS n FROM kept WHERE propagating AND flow_class <> '' GROUP BY 1")
def c11_flow_distribution(g):
    return conditioning.flow_distribution(conditioning.kept(g.conditioned))


@query(f"""{_COND}, o AS (SELECT coalesce('dropped: ' || drop_reason, 'kept: ' || classification) AS outcome FROM conditioned)
SELECT outcome, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM o GROUP BY 1""")
def a28_edge_funnel(g):
    return conditioning.funnel(g.conditioned).withColumn("share", F.round("share", 9))


# --- propagation -----------------------------------------------------------------------------------------------------

_MOVES = f"{_COND}, prop AS (SELECT * FROM kept WHERE propagating), cond_nodes AS (SELECT source AS node_id FROM prop UNION SELECT target FROM prop), {transitions_sql('t', 'propagating')}".replace("WITH", "WITH RECURSIVE", 1)
_PPR = f"{_MOVES}, {pagerank_sql('cond', 't', 'cond_nodes', STEPS, ALPHA)}"
_RAW = f"""raw AS (SELECT * FROM resolved WHERE known), raw_nodes AS (SELECT source AS node_id FROM raw UNION SELECT target FROM raw),
{transitions_sql("rt", "true", "raw")}, {pagerank_sql("rawf", "rt", "raw_nodes", STEPS, ALPHA)}"""
_META = f"""meta AS (SELECT * FROM resolved WHERE known AND NOT coalesce(non_flow, false)), meta_nodes AS (SELECT source AS node_id FROM meta UNION SELECT target FROM meta),
{transitions_sql("mt", "true", "meta")}, {pagerank_sql("metaf", "mt", "meta_nodes", STEPS, ALPHA)}"""


@query(f"{_PPR} SELECT node_id, round(score * 1e6, 3) AS score FROM cond")
def r1_pagerank(g):
    return g.cond_scores.select("node_id", micro("score"))


@query(f"{_MOVES}, {pagerank_sql('cond', 't', 'cond_nodes', STEPS, ALPHA, False)} SELECT node_id, round(score * 1e6, 3) AS score FROM cond")
def r2_pagerank_unscaled(g):
    return g.scores(g.moving, False).select("node_id", micro("score"))


@query(f"""{_MOVES}, pool AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS position FROM seeds QUALIFY position < 15),
steps AS (SELECT 0 AS i, position, node_id, 1.0::DOUBLE AS score FROM pool UNION ALL SELECT i + 1, position, node_id, sum(v) FROM (
 SELECT f.i, f.position, t.dst AS node_id, {1 - ALPHA} * t.p * f.score AS v FROM steps f JOIN t ON f.node_id = t.src WHERE f.i < {STEPS}
 UNION ALL SELECT k.i, p.position, p.node_id, {ALPHA} FROM (SELECT DISTINCT i FROM steps WHERE i < {STEPS}) k, pool p) GROUP BY i, position, node_id)
SELECT position, node_id, round(score * 1e6, 3) AS score FROM steps WHERE i = {STEPS} AND round(score * 1e6, 3) > 0""")
def r3_single_seeds(g):
    scores = _pool_scores(g, g.moving, _pool(g, POOL))
    rows = scores.select("node_id", F.posexplode("by_seed").alias("position", "score"))
    return rows.select(F.col("position").cast("long").alias("position"), "node_id", micro("score")).filter("score > 0")


@query(f"{_COND} SELECT source AS node_id, count(*) AS degree FROM kept GROUP BY 1")
def r4_degree(g):
    return propagate.out_degree(conditioning.kept(g.conditioned))


def _arms(g: Graph) -> DataFrame:
    """(arm, node_id, score, positive, seed) of every concept: conditioned, raw, without non-flow predicates, and as many edges
    at random as propagate; one propagation each."""
    g.hold_conditioned()
    edges = {"conditioned": g.moving, "raw": g.conditioned, "metadata": conditioning.metadata_filtered(g.conditioned, g.rules), "random": stage(_sparsified(g), "sparse")}
    held = g.role("heldout").select("node_id", F.lit(True).alias("positive"))
    concepts = stage(g.typed.select("node_id").join(broadcast_if_small(held), "node_id", "left").fillna(False, ["positive"]), "concepts")
    propagate.require(g.seeds, concepts, "seed")
    propagate.require(held, concepts, "held-out")
    out = None
    for arm, e in edges.items():
        scores = {"conditioned": lambda: g.cond_scores, "raw": lambda: g.raw_scores}.get(arm, lambda e=e: g.scores(e))()
        part = concepts.join(nano(scores), "node_id", "left").fillna(0.0, ["score"]).withColumn("arm", F.lit(arm))
        out = part if out is None else out.unionByName(part)
    return stage(out, "arms")


_ARM_NAMES = ["conditioned", "raw", "metadata", "random"]
_ARMS = f"""{_PPR}, {_RAW}, {_META}, {_SPARSE}, sparse_nodes AS (SELECT source AS node_id FROM sparse UNION SELECT target FROM sparse), {transitions_sql("st", "true", "sparse")},
{pagerank_sql("sparsef", "st", "sparse_nodes", STEPS, ALPHA)}, arm_scores AS (SELECT 'conditioned' AS arm, * FROM cond UNION ALL SELECT 'raw', * FROM rawf UNION ALL SELECT 'metadata', * FROM metaf UNION ALL SELECT 'random', * FROM sparsef),
arms AS (SELECT a.arm, t.node_id, coalesce(round(s.score * 1e9) / 1e9, 0) AS score, t.node_id IN (SELECT node_id FROM heldout) AS positive
 FROM typed t CROSS JOIN (SELECT unnest({_ARM_NAMES}) AS arm) a LEFT JOIN arm_scores s ON s.arm = a.arm AND s.node_id = t.node_id),
arm_g AS (SELECT arm, score, count(*) AS n, count(*) FILTER (positive) AS p FROM arms GROUP BY 1, 2),
arm_c AS (SELECT *, sum(n) OVER w AS seen, sum(p) OVER w AS tp, sum(n) OVER (PARTITION BY arm) AS tn, sum(p) OVER (PARTITION BY arm) AS tot FROM arm_g WINDOW w AS (PARTITION BY arm ORDER BY score DESC)),
arm_roc AS (SELECT arm, round(1 - sum(p * (seen - n - (tp - p) + (n - p) / 2)) / (any_value(tot) * (any_value(tn) - any_value(tot))), 9) AS auroc, round(sum(p * tp / seen) / any_value(tot), 9) AS auprc FROM arm_c GROUP BY 1),
arm_signal AS (SELECT arm, count(*) AS n, round(-sum(CASE WHEN score > 0 THEN score * ln(score) ELSE 0 END), 6) AS entropy, round(sum(CASE WHEN positive THEN score ELSE 0 END), 9) AS localization FROM arms GROUP BY 1),
arm_top AS (SELECT arm, count(*) FILTER (positive AND k <= 50) / 50 AS top50, count(*) FILTER (positive AND k <= 100) / 100 AS top100
 FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY score DESC, node_id) AS k FROM arms) GROUP BY 1)"""


@query(f"{_ARMS} SELECT * FROM arm_signal JOIN arm_roc USING (arm) JOIN arm_top USING (arm)")
def c12_arms(g):
    arms = _arms(g)
    out = None
    for arm in _ARM_NAMES:
        rows = arms.filter(F.col("arm") == arm)
        roc = stats.roc_and_precision(rows, "score", F.col("positive")).select("n", F.round("auroc", 9).alias("auroc"), F.round("auprc", 9).alias("auprc"))
        signal = stats.signal(rows, "score", F.col("positive")).withColumn("entropy", F.round("entropy", 6)).withColumn("localization", F.round("localization", 9))
        part = roc.join(F.broadcast(signal)).withColumn("arm", F.lit(arm))  # one row each
        out = part if out is None else out.unionByName(part)
    return out


def _labelled(g: Graph) -> DataFrame:
    """Conditioned scores (rounded so that equal ones tie) and whether a node is held out."""
    held = g.role("heldout").withColumn("positive", F.lit(True))
    rows = g.cond_scores.join(F.broadcast(held), "node_id", "left").fillna(False, ["positive"])
    return nano(rows)


_LABELLED = f"{_PPR}, lab AS (SELECT node_id, round(score * 1e9) / 1e9 AS score, node_id IN (SELECT node_id FROM heldout) AS positive FROM cond)"


@query(f"""{_LABELLED}, e AS (SELECT -sum(CASE WHEN score > 0 THEN score * ln(score) ELSE 0 END) AS entropy, sum(CASE WHEN positive THEN score ELSE 0 END) AS localization FROM lab),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, node_id) AS k FROM lab)
SELECT round(entropy, 6) AS entropy, round(localization, 9) AS localization, (SELECT count(*) FILTER (positive AND k <= 50) / 50 FROM r) AS top50, (SELECT count(*) FILTER (positive AND k <= 100) / 100 FROM r) AS top100 FROM e""")
def a9_signal(g):
    rows = stats.signal(stage(_labelled(g), "labelled"), "score", F.col("positive"))
    return rows.withColumn("entropy", F.round("entropy", 6)).withColumn("localization", F.round("localization", 9))


@query(f"""{_LABELLED}, g AS (SELECT score, count(*) AS n, count(*) FILTER (positive) AS p FROM lab GROUP BY 1),
c AS (SELECT *, sum(n) OVER w AS seen, sum(p) OVER w AS tp FROM g WINDOW w AS (ORDER BY score DESC)), tot AS (SELECT sum(n) AS n, sum(p) AS p FROM g)
SELECT tot.n::BIGINT AS n, tot.p::BIGINT AS positives, round(1 - sum(c.p * (c.seen - c.n - (c.tp - c.p) + (c.n - c.p) / 2)) / (any_value(tot.p) * (any_value(tot.n) - any_value(tot.p))), 9) AS auroc,
round(sum(c.p * c.tp / c.seen) / any_value(tot.p), 9) AS auprc FROM c, tot GROUP BY tot.n, tot.p""")
def a10_recovery(g):
    rows = stats.roc_and_precision(stage(_labelled(g), "labelled"), "score", F.col("positive"))
    return rows.withColumn("auroc", F.round("auroc", 9)).withColumn("auprc", F.round("auprc", 9))


@query(f"""{_LABELLED}, l AS (SELECT * FROM lab WHERE node_id NOT IN (SELECT node_id FROM seeds)), r AS (SELECT *, row_number() OVER w AS k, sum(positive::INT) OVER w AS hits FROM l
 WINDOW w AS (ORDER BY score DESC, positive DESC, node_id)) SELECT count(*) AS n, count(*) FILTER (positive) AS positives, round(avg(hits / k) FILTER (positive), 9) AS auprc FROM r""")
def a11_seedless_auprc(g):
    rows = _labelled(g).join(g.seeds, "node_id", "left_anti")
    return stats.pointwise_precision(stage(rows, "labelled"), "score", F.col("positive")).withColumn("auprc", F.round("auprc", 9))


# --- pathway scores --------------------------------------------------------------------------------------------------


def _scored(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    kept = g.kept
    members = g.sized
    scores = g.cond_scores
    pathways = members.select("pathway").distinct()
    scored = scoring.pathway_scores(pathways, members, scores, g.raw_scores, kept)
    return stage(scored, "scored"), members, scores, kept


_SIZED = f"""{MEMBERS}, sized AS (SELECT * FROM members WHERE pathway IN (SELECT pathway FROM members GROUP BY 1 HAVING count(*) BETWEEN {LEAST_MEMBERS} AND {MOST_MEMBERS}))"""
_SCORED = f"""{_PPR}, {_RAW}, {_SIZED}, ms AS (SELECT pathway, count(*) AS m, avg(score) AS mean, max(score) AS top FROM sized LEFT JOIN cond ON gene = cond.node_id GROUP BY 1),
ends AS (SELECT source AS pathway, target AS node_id FROM kept UNION ALL SELECT target, source FROM kept),
near AS (SELECT e.pathway, count(*) AS degree, avg(score) AS bg FROM ends e LEFT JOIN cond USING (node_id) WHERE e.pathway IN (SELECT pathway FROM ms) GROUP BY 1),
scored AS (SELECT ms.pathway, coalesce(c.score, 0) AS direct, coalesce(mean, 0) AS member_mean, coalesce(top, 0) AS member_max, coalesce(c.score, 0) / sqrt(m) AS degree_norm,
 coalesce(c.score, 0) - coalesce(bg, 0) AS local_bg, coalesce(r.score, 0) AS direct_raw, coalesce(c.score, 0) - coalesce(r.score, 0) AS raw_vs_cond_delta, m AS member_gene_count, coalesce(degree, 0) AS degree
 FROM ms LEFT JOIN cond c ON ms.pathway = c.node_id LEFT JOIN rawf r ON ms.pathway = r.node_id LEFT JOIN near ON ms.pathway = near.pathway)"""
_SCORES = ["direct", "member_mean", "member_max", "degree_norm", "local_bg", "direct_raw", "raw_vs_cond_delta"]


@query(f"""{_SCORED} SELECT pathway, {", ".join(f"round({c} * 1e6, 3) AS {c}" for c in _SCORES)}, member_gene_count, degree,
(SELECT count(*) FROM scored) >= 10 AND degree > (SELECT quantile_cont(degree, 0.9) FROM scored) AS degree_flag FROM scored""")
def a1_pathway_scores(g):
    scored = _scored(g)[0]
    return scoring.degree_flags(scored).select("pathway", *(micro(c) for c in _SCORES), "member_gene_count", "degree", "degree_flag")


@query(f"{_PPR} SELECT node_id, round(score * 1e6, 3) AS score FROM cond WHERE node_id IN (SELECT node_id FROM seeds) ORDER BY round(score * 1e9) DESC, node_id LIMIT 5")
def a3_top_seeds(g):
    scores = nano(g.cond_scores)
    return scoring.top_seeds(g.seeds, scores).select("node_id", micro("score"))


@query(f"WITH {GRAPH} SELECT sab, count(DISTINCT node_id) AS n FROM g_nodes WHERE sab IN ({', '.join(repr(x) for x in PATHWAY_SABS)}) GROUP BY 1")
def a4_pathway_nodes(g):
    return g.nodes.filter(F.col("sab").isin(PATHWAY_SABS)).groupBy("sab").agg(F.count_distinct("node_id").alias("n"))


@query(f"WITH {GRAPH}, {MEMBERS} SELECT node_id, sab FROM best_sab")
def a5_best_sab(g):
    return g.sabs


@query(f"""WITH {GRAPH}, s AS (SELECT node_id, count(DISTINCT sab) AS k, count(*) AS c FROM g_nodes GROUP BY 1)
SELECT count(*) AS nodes, sum(c)::BIGINT AS n_rows, count(*) FILTER (k > 1) AS several, round(count(*) FILTER (k > 1) / count(*), 9) AS share,
CASE WHEN count(*) FILTER (k > 1) = 0 THEN 'reliable' WHEN count(*) FILTER (k > 1) / count(*) < 0.01 THEN 'small impact' ELSE 'may be unreliable' END AS advice FROM s""")
def a6_preflight(g):
    per = g.nodes.groupBy("node_id").agg(F.count_distinct("sab").alias("k"), F.count("*").alias("c"))
    several = F.count(F.when(F.col("k") > 1, 1))
    advice = F.when(several == 0, "reliable").when(several / F.count("*") < 0.01, "small impact").otherwise("may be unreliable")
    return per.agg(F.count("*").alias("nodes"), F.sum("c").alias("n_rows"), several.alias("several"), F.round(several / F.count("*"), 9).alias("share"), advice.alias("advice"))


@query(f"WITH {GRAPH} SELECT sab, count(*) AS n FROM g_nodes WHERE sab IN ({', '.join(repr(x) for x in PATHWAY_SABS)}) GROUP BY 1")
def a6_pathway_histogram(g):
    return g.nodes.filter(F.col("sab").isin(PATHWAY_SABS)).groupBy("sab").agg(F.count("*").alias("n"))


# --- statistics over runs --------------------------------------------------------------------------------------------

_RUNS = f"""runs AS (SELECT row_id, run_id, {plain_id_sql("concept_id")} AS id, degree_norm + 0.0 AS v, CASE WHEN isnan(empirical_p) THEN NULL ELSE empirical_p END AS p, in_chd_set, direct_raw, degree_flag, null_z, member_mean, null_calibrated
 FROM pathway_scores_standard WHERE degree_norm IS NOT NULL AND NOT isnan(degree_norm)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY v DESC, row_id) AS rank FROM runs)"""


def _runs(g: Graph) -> DataFrame:
    rows = g.table("pathway_scores_standard").filter("degree_norm is not null and not isnan(degree_norm)")
    return rows.select("row_id", "run_id", plain_id("concept_id").alias("id"), (F.col("degree_norm") + F.lit(0.0)).alias("v"), F.when(~F.isnan("empirical_p"), F.col("empirical_p")).alias("p"), "in_chd_set", "direct_raw", "degree_flag", "null_z", "member_mean", "null_calibrated")


def _ranked(g: Graph) -> DataFrame:
    return stats.ranked_by_range(_runs(g), ["run_id"], [F.desc("v"), F.asc("row_id")])


@query(f"""WITH {_RUNS}, k AS (SELECT v AS x, * FROM runs), o AS (SELECT id, max(v) AS observed FROM runs WHERE run_id LIKE '%PRIMARY' AND id IS NOT NULL GROUP BY 1),
n AS (SELECT id, v AS nul FROM runs WHERE run_id NOT LIKE '%PRIMARY'), s AS (SELECT id, observed, count(*) AS n, avg(nul) AS m, stddev_pop(nul) AS sd, count(*) FILTER (nul >= observed) AS ge FROM n JOIN o USING (id) GROUP BY 1, 2)
SELECT id, n, round(m * 1e6, 3) AS null_mean, round(sd * 1e6, 3) AS null_sd, m > 0 AND observed / m <= 10 AS calibrated,
CASE WHEN m > 0 AND observed / m <= 10 THEN round((1 + ge) / (1 + n), 9) END AS empirical_p FROM s""")
def a7_empirical(g):
    runs = _runs(g)
    observed = runs.filter(F.col("run_id").endswith("PRIMARY") & F.col("id").isNotNull()).groupBy("id").agg(F.max("v").alias("observed"))
    nulls_ = runs.filter(~F.col("run_id").endswith("PRIMARY")).select("id", F.col("v").alias("null"))
    return stats.empirical(nulls_, observed, "id").select("id", "n", micro("null_mean"), micro("null_sd"), "calibrated", F.round("empirical_p", 9).alias("empirical_p"))


@query(f"""WITH {_RUNS}, t AS (SELECT run_id, p, count(*) AS c FROM runs WHERE p IS NOT NULL GROUP BY 1, 2),
u AS (SELECT *, sum(c) OVER (PARTITION BY run_id ORDER BY p) AS r, sum(c) OVER (PARTITION BY run_id) AS n FROM t),
q AS (SELECT run_id, p, least(1, min(p * n / r) OVER (PARTITION BY run_id ORDER BY p DESC)) AS q FROM u)
SELECT runs.row_id, round(q.q, 9) AS q FROM runs LEFT JOIN q ON runs.run_id = q.run_id AND runs.p = q.p""")
def a8_false_discovery(g):
    return stats.benjamini_hochberg(_runs(g), "p", ["run_id"]).select("row_id", F.round("q", 9).alias("q"))


def _metric_sql(k: int) -> str:
    ideal = f"list_sum(list_transform(range(1, greatest(least(n_relevant, {k}), 1) + 1), lambda i: 1 / log2(i + 1.0)))"
    return f"""h{k} / {k} AS p_at_{k}, CASE WHEN n_relevant > 0 THEN h{k} / n_relevant ELSE 0 END AS recall_at_{k},
 CASE WHEN n_relevant > 0 THEN round((h{k} / {k}) / (n_relevant / n), 9) END AS enrich_at_{k}, CASE WHEN n_relevant > 0 THEN round(d{k} / {ideal}, 9) ELSE 0 END AS ndcg_at_{k}"""


_METRICS = f"""WITH {_RUNS}, h AS (SELECT *, sum(in_chd_set::INT) OVER (PARTITION BY run_id ORDER BY rank) AS hits FROM ranked),
a AS (SELECT run_id, count(*) AS n, count(*) FILTER (in_chd_set) AS n_relevant, coalesce(avg(hits / rank) FILTER (in_chd_set), 0) AS ap, avg(rank) FILTER (in_chd_set) AS mean_rank,
 {", ".join(f"count(*) FILTER (in_chd_set AND rank <= {k}) AS h{k}, coalesce(sum(1 / log2(rank + 1.0)) FILTER (in_chd_set AND rank <= {k}), 0) AS d{k}" for k in (10, 20, 50))} FROM h GROUP BY 1),
metrics AS (SELECT run_id, n, n_relevant, round(ap, 9) AS ap, round(mean_rank, 9) AS mean_rank, {", ".join(_metric_sql(k) for k in (10, 20, 50))} FROM a)"""


def _metrics(g: Graph) -> DataFrame:
    out = stats.ranking_metrics(_ranked(g), ["run_id"], F.col("in_chd_set"))
    rounded = {c for c in out.columns if c.startswith(("ap", "mean_rank", "enrich", "ndcg"))}
    return out.select(*(F.round(c, 9).alias(c) if c in rounded else F.col(c) for c in out.columns))


@query(f"{_METRICS} SELECT * FROM metrics")
def a12_ranking_metrics(g):
    return _metrics(g)


_KS = (10, 20, 50)


@query(f"""WITH {_RUNS}, w AS (SELECT run_id, row_id, row_number() OVER (PARTITION BY run_id ORDER BY direct_raw DESC NULLS LAST, row_id) AS raw_rank FROM runs),
t AS (SELECT run_id, p, count(*) AS c FROM runs WHERE p IS NOT NULL GROUP BY 1, 2), u AS (SELECT *, sum(c) OVER (PARTITION BY run_id ORDER BY p) AS r, sum(c) OVER (PARTITION BY run_id) AS n FROM t),
q AS (SELECT run_id, p, least(1, min(p * n / r) OVER (PARTITION BY run_id ORDER BY p DESC)) AS q FROM u)
SELECT run_id, count(*) AS n, count(*) FILTER (in_chd_set) AS n_relevant, {", ".join(f"count(*) FILTER (in_chd_set AND rank <= {k}) / {k} AS p_at_{k}, count(*) FILTER (degree_flag AND rank <= {k}) / {k} AS hubs_at_{k}, CASE WHEN count(*) FILTER (in_chd_set) > 0 THEN round((count(*) FILTER (in_chd_set AND rank <= {k}) / {k}) / (count(*) FILTER (in_chd_set) / count(*)), 9) END AS enrich_at_{k}" for k in _KS)},
round(avg(rank) FILTER (in_chd_set), 9) AS mean_rank, round(avg(raw_rank) FILTER (in_chd_set), 9) AS mean_rank_raw, round(avg(raw_rank) FILTER (in_chd_set) - avg(rank) FILTER (in_chd_set), 9) AS rank_improvement,
count(*) FILTER (round(q, 9) < 0.05) AS n_q05, count(*) FILTER (round(q, 9) < 0.1) AS n_q10, count(*) FILTER (null_calibrated) AS n_calibrated, count(*) FILTER (NOT null_calibrated) AS n_degenerate
FROM ranked JOIN w USING (run_id, row_id) LEFT JOIN q USING (run_id, p) GROUP BY 1""")
def a13_recovery_by_run(g):
    rows = stats.ranked_by_range(_ranked(g), ["run_id"], [F.desc_nulls_last("direct_raw"), F.asc("row_id")], "raw_rank")
    rows = stats.benjamini_hochberg(rows, "p", ["run_id"])
    cond, raw = (F.avg(F.when(F.col("in_chd_set"), F.col(c))) for c in ("rank", "raw_rank"))
    number = lambda c: F.count(F.when(c, 1))
    relevant, n = number(F.col("in_chd_set")), F.count("*")
    tops = []
    for k in _KS:
        top = F.col("rank") <= k
        precision = number(F.col("in_chd_set") & top) / k
        tops += [precision.alias(f"p_at_{k}"), (number(F.col("degree_flag") & top) / k).alias(f"hubs_at_{k}"), F.round(F.when(relevant > 0, precision / (relevant / n)), 9).alias(f"enrich_at_{k}")]
    q = F.round("q", 9)
    return rows.groupBy("run_id").agg(
        n.alias("n"), relevant.alias("n_relevant"), *tops, F.round(cond, 9).alias("mean_rank"), F.round(raw, 9).alias("mean_rank_raw"), F.round(raw - cond, 9).alias("rank_improvement"),
        number(q < 0.05).alias("n_q05"), number(q < 0.1).alias("n_q10"), number(F.col("null_calibrated")).alias("n_calibrated"), number(~F.col("null_calibrated")).alias("n_degenerate"),
    )


@query(f"""{_METRICS}, l AS (SELECT unnest(['ap', 'p_at_10', 'mean_rank']) AS metric, unnest([ap, p_at_10, mean_rank]) AS v FROM metrics)
SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max FROM l GROUP BY 1""")
def a24_resampling_summary(g):
    long = _metrics(g).unpivot([], ["ap", "p_at_10", "mean_rank"], "metric", "v")
    out = stats.distribution(long, "v", ["metric"])
    return out.select("metric", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd")), "min", *(F.round(c, 6).alias(c) for c in ("p25", "median", "p75")), "max")


@query(f"""{_METRICS} SELECT count(*) FILTER (p.ap IS NOT NULL AND m.ap <= p.ap) / count(*) AS ap_percentile, count(*) FILTER (m.p_at_10 <= p.p_at_10) / count(*) AS p10_percentile
FROM metrics m, (SELECT * FROM metrics WHERE run_id LIKE '%PRIMARY') p WHERE m.run_id NOT LIKE '%PRIMARY'""")
def a25_primary_percentile(g):
    rows = stage(_metrics(g), "metrics")
    main = rows.filter(F.col("run_id").endswith("PRIMARY")).select(F.col("ap").alias("_a"), F.col("p_at_10").alias("_p"))
    rest = rows.filter(~F.col("run_id").endswith("PRIMARY")).join(F.broadcast(main))
    share = lambda c, m: F.avg(F.when(F.col(c) <= F.col(m), 1.0).otherwise(0.0))
    return rest.agg(share("ap", "_a").alias("ap_percentile"), share("p_at_10", "_p").alias("p10_percentile"))


@query(f"""WITH {_RUNS}, c AS (SELECT id, count(*) AS n FROM runs WHERE id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2) SELECT id, n FROM c ORDER BY n DESC, id LIMIT 50""")
def a26_top_concepts(g):
    counts = _runs(g).filter("id is not null").groupBy("id").agg(F.count("*").alias("n"))
    return counts.filter("n >= 2").orderBy(F.desc("n"), "id").limit(50)  # a top-k report


@query(f"""{_METRICS}, l AS (SELECT run_id, unnest(['ap', 'p_at_10', 'rank']) AS metric, unnest([ap, p_at_10, 1 / mean_rank]) AS v FROM metrics)
SELECT run_id, metric, round(v / max(v) OVER (PARTITION BY metric), 6) AS share FROM l WHERE v IS NOT NULL""")
def a27_normalised_metrics(g):
    long = _metrics(g).withColumn("rank", 1 / F.col("mean_rank")).unpivot(["run_id"], ["ap", "p_at_10", "rank"], "metric", "v").filter("v is not null")
    tops = long.groupBy("metric").agg(F.max("v").alias("top"))
    return long.join(F.broadcast(tops), "metric").select("run_id", "metric", F.round(F.when(F.col("top") != 0, F.col("v") / F.col("top")), 6).alias("share"))


@query(f"WITH {_RUNS} SELECT id, count(DISTINCT run_id) AS runs, round(avg(rank), 6) AS avg_rank FROM ranked WHERE id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT run_id) > 1")
def a29_mean_rank_across_runs(g):
    rows = _ranked(g).filter("id is not null").groupBy("id").agg(F.count_distinct("run_id").alias("runs"), F.round(F.avg("rank"), 6).alias("avg_rank"))
    return rows.filter("runs > 1")


@query(f"""{_ARMS}, m AS (SELECT * FROM arm_signal JOIN arm_roc USING (arm) JOIN arm_top USING (arm))
SELECT arm, unnest(['entropy', 'localization', 'auroc', 'auprc', 'top50', 'top100']) AS metric, round(unnest([entropy, localization, auroc, auprc, top50, top100]), 6) AS v FROM m""")
def a30_arm_table(g):
    return c12_arms(g).unpivot(["arm"], ["entropy", "localization", "auroc", "auprc", "top50", "top100"], "metric", "v").withColumn("v", F.round("v", 6))


@query(f"""WITH {_RUNS} SELECT r.node_id, coalesce(min(k.rank), 9999)::BIGINT AS rank FROM refs_ r LEFT JOIN ranked k ON r.node_id = k.id AND k.run_id LIKE '%PRIMARY' GROUP BY 1""".replace("refs_", "(SELECT node_id FROM reference_concepts WHERE role = 'pathway')"))
def a31_reference_ranks(g):
    main = _ranked(g).filter(F.col("run_id").endswith("PRIMARY")).groupBy(F.col("id").alias("node_id")).agg(F.min("rank").cast("long").alias("rank"))
    return g.refs.join(main, "node_id", "left").fillna(9999, ["rank"])


@query(f"""WITH {_RUNS}, w AS (SELECT run_id, row_id, row_number() OVER (PARTITION BY run_id ORDER BY direct_raw DESC NULLS LAST, row_id) AS raw_rank FROM runs),
c AS (SELECT run_id, avg(rank) FILTER (in_chd_set) AS conditioned, avg(raw_rank) FILTER (in_chd_set) AS raw FROM ranked JOIN w USING (run_id, row_id) GROUP BY 1)
SELECT run_id, unnest(['conditioned', 'raw']) AS arm, round(unnest([conditioned, raw]), 9) AS mean_rank FROM c""")
def a32_control_comparison(g):
    rows = a13_recovery_by_run(g).select("run_id", F.col("mean_rank").alias("conditioned"), F.col("mean_rank_raw").alias("raw"))
    return rows.unpivot(["run_id"], ["conditioned", "raw"], "arm", "mean_rank")


@query(f"""{_METRICS}, l AS (SELECT run_id, unnest(['ap', 'p_at_10']) AS metric, unnest([ap, p_at_10]) AS v FROM metrics)
SELECT a.metric, round(quantile_cont(a.v, 0.05), 6) AS p5, round(median(a.v), 6) AS p50, round(quantile_cont(a.v, 0.95), 6) AS p95, any_value(b.v) AS v_primary
FROM l a LEFT JOIN l b ON a.metric = b.metric AND b.run_id LIKE '%PRIMARY' WHERE a.run_id NOT LIKE '%PRIMARY' GROUP BY 1""")
def a33_quantiles_and_primary(g):
    long = stage(_metrics(g).unpivot(["run_id"], ["ap", "p_at_10"], "metric", "v"), "metrics")
    main = F.col("run_id").endswith("PRIMARY")
    q = long.filter(~main).groupBy("metric").agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    q = q.select("metric", *(F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("p5", "p50", "p95"))))
    return q.join(F.broadcast(long.filter(main).groupBy("metric").agg(F.max("v").alias("v_primary"))), "metric", "left")


@query(f"WITH {_RUNS} SELECT run_id, row_id, rank::BIGINT AS rank, CASE WHEN isnan(null_z) THEN NULL ELSE null_z END AS null_z, id IN (SELECT node_id FROM reference_concepts WHERE role = 'pathway') AS is_reference FROM ranked WHERE id IS NOT NULL")
def a34_rank_and_z(g):
    refs = g.refs.select(F.col("node_id").alias("id"), F.lit(True).alias("is_reference"))
    rows = _ranked(g).filter("id is not null").join(F.broadcast(refs), "id", "left").fillna(False, ["is_reference"])
    return rows.select("run_id", "row_id", F.col("rank").cast("long").alias("rank"), F.when(~F.isnan("null_z"), F.col("null_z")).alias("null_z"), "is_reference")


# --- enrichment ------------------------------------------------------------------------------------------------------

_KEPT = f"{_COND}, {_SIZED}"
_UNIVERSE = "u AS (SELECT DISTINCT node_id FROM (SELECT source AS node_id FROM g_edges UNION ALL SELECT target FROM g_edges) WHERE regexp_matches(node_id, '^C[0-9]'))"


@query(f"""{_KEPT}, deg AS (SELECT source AS node_id, count(*) AS degree FROM kept GROUP BY 1)
SELECT pathway, count(*) AS size, round(sum(CASE WHEN gene IN (SELECT node_id FROM seeds) THEN coalesce(degree, 1) ELSE 0 END) / sqrt(count(*)), 6) AS stat FROM sized LEFT JOIN deg ON gene = deg.node_id GROUP BY 1""")
def a14_degree_overlap(g):
    degrees = propagate.out_degree(conditioning.kept(g.conditioned))
    return enrich.degree_overlap(g.sized, g.seeds, degrees).withColumn("stat", F.round("stat", 6))


def _fisher_sql(query_set: str, digits: int | None = 9) -> str:
    choose = lambda n, r: f"(lgamma({n} + 1.0) - lgamma({r} + 1.0) - lgamma({n} - {r} + 1.0))"
    term_ = f"exp({choose('marked', 'i')} + {choose('(population - marked)', '(drawn - i)')} - {choose('population', 'drawn')})"
    tail = f"least(1, list_sum(list_transform(range(greatest(k, marked + drawn - population, 0), least(marked, drawn) + 1), lambda i: {term_})))"
    return f"""f AS (SELECT pathway, count(*) FILTER (gene IN (SELECT node_id FROM {query_set}) AND gene IN (SELECT node_id FROM u)) AS k, count(*) FILTER (gene IN (SELECT node_id FROM u)) AS marked,
 (SELECT count(*) FROM {query_set} WHERE node_id IN (SELECT node_id FROM u)) AS drawn, (SELECT count(*) FROM u) AS population FROM sized GROUP BY 1)
SELECT pathway, k, marked, drawn, population, CASE WHEN k = 0 THEN 1 ELSE {f"round({tail}, {digits})" if digits else tail} END AS p FROM f"""


@query(f"WITH {GRAPH}, {_SIZED}, {_UNIVERSE}, qs AS (SELECT DISTINCT node_id FROM seeds), {_fisher_sql('qs')}")
def a15_seed_fisher(g):
    return enrich.fisher(g.sized, g.seeds, enrich.gene_universe(g.edges)).withColumn("p", F.round("p", 9))


@query(f"""WITH {GRAPH}, {_SIZED}, {_UNIVERSE}, v AS (SELECT node_id FROM u WHERE node_id NOT IN (SELECT node_id FROM seeds))
SELECT pathway, count(*) FILTER (gene IN (SELECT node_id FROM seeds)) AS k, CASE WHEN count(*) FILTER (gene IN (SELECT node_id FROM seeds)) > 0 THEN 0 ELSE 1 END::DOUBLE AS p FROM sized GROUP BY 1""")
def a15_seed_fisher_degenerate(g):
    universe = enrich.gene_universe(g.edges).join(g.seeds, "node_id", "left_anti")
    return enrich.fisher(g.sized, g.seeds, universe, degenerate=True).select("pathway", "k", "p")


@query(f"""WITH {GRAPH}, {_SIZED}, {_UNIVERSE}, qs AS (SELECT node_id FROM seeds UNION SELECT target FROM g_edges WHERE source IN (SELECT node_id FROM seeds)
 UNION SELECT source FROM g_edges WHERE target IN (SELECT node_id FROM seeds)), {_fisher_sql('qs')}""")
def a16_neighbourhood_fisher(g):
    edges = g.edges
    near = enrich.neighbourhood(g.seeds, edges)
    return enrich.fisher(g.sized, near, enrich.gene_universe(edges)).withColumn("p", F.round("p", 9))


def _gsea_sql(name: str, scores: str) -> str:
    return f"""{name}_gl AS (SELECT node_id, round(score * 1e9) / 1e9 AS score FROM {scores} WHERE regexp_matches(node_id, '^C[0-9]')),
{name}_rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, node_id) AS rank, count(*) OVER () AS n FROM {name}_gl),
{name}_hits AS (SELECT pathway, rank, n, score, count(*) OVER w AS i, sum(score) OVER w AS cw, sum(score) OVER (PARTITION BY pathway) AS tw, count(*) OVER (PARTITION BY pathway) AS h
 FROM sized JOIN {name}_rk ON gene = {name}_rk.node_id WINDOW w AS (PARTITION BY pathway ORDER BY rank)),
{name}_pts AS (SELECT pathway, h, rank AS pos, i AS lead, CASE WHEN tw > 0 THEN cw / tw ELSE i / h END - (rank - i) / (n - h) AS v FROM {name}_hits
 UNION ALL SELECT pathway, h, rank - 1, i - 1, CASE WHEN tw > 0 THEN (cw - score) / tw ELSE (i - 1) / h END - (rank - i) / (n - h) FROM {name}_hits WHERE rank > 1),
{name} AS (SELECT pathway, h AS hits, arg_max(v, round(abs(v), 12) * 1e12 - pos / 1e9) AS es, arg_max(lead, round(abs(v), 12) * 1e12 - pos / 1e9) / h AS leading_edge FROM {name}_pts GROUP BY 1, 2)"""


_GSEA = f"{_PPR}, {_SIZED}, {_gsea_sql('gsea', 'cond')}"


@query(f"{_GSEA} SELECT pathway, hits, round(es, 6) AS es, round(leading_edge, 6) AS leading_edge FROM gsea")
def a17_preranked(g):
    scores = nano(g.cond_scores)
    genes = scores.filter(membership.is_gene(F.col("node_id")))
    return enrich.preranked(g.sized, scores, genes.select("node_id")).select("pathway", "hits", F.round("es", 6).alias("es"), F.round("leading_edge", 6).alias("leading_edge"))


_BASELINES = f"""{_GSEA}, {_RAW}, {_UNIVERSE}, deg AS (SELECT source AS node_id, count(*) AS degree FROM kept GROUP BY 1), qs AS (SELECT DISTINCT node_id FROM seeds),
qn AS (SELECT node_id FROM seeds UNION SELECT target FROM g_edges WHERE source IN (SELECT node_id FROM seeds) UNION SELECT source FROM g_edges WHERE target IN (SELECT node_id FROM seeds)),
b0 AS (SELECT pathway, sum(CASE WHEN gene IN (SELECT node_id FROM seeds) THEN coalesce(degree, 1) ELSE 0 END) / sqrt(count(*)) AS stat FROM sized LEFT JOIN deg ON gene = deg.node_id GROUP BY 1),
b1 AS (WITH {_fisher_sql("qs", None)}),
b2 AS (WITH {_fisher_sql("qn", None)}),
{_gsea_sql("gsea_raw", "rawf")},
u6 AS (SELECT 'degree_overlap' AS method, pathway, stat FROM b0 UNION ALL SELECT 'seed_fisher', pathway, -log10(greatest(p, 1e-300)) FROM b1
 UNION ALL SELECT 'neighbourhood_fisher', pathway, -log10(greatest(p, 1e-300)) FROM b2 UNION ALL SELECT 'preranked', pathway, es FROM gsea UNION ALL SELECT 'preranked_raw', pathway, es FROM gsea_raw
 UNION ALL SELECT 'full', pathway, round(coalesce(any_value(score), 0) / sqrt(count(*)) * 1e9) / 1e3 FROM sized LEFT JOIN cond ON pathway = node_id GROUP BY 2),
b_ranked AS (SELECT method, pathway, round(stat, 6) + 0.0 AS stat, (row_number() OVER (PARTITION BY method ORDER BY round(stat, 6) DESC, pathway))::INTEGER AS rank FROM u6)
"""


def _baselines(g: Graph) -> DataFrame:
    """(method, pathway, stat, rank) of all six methods on one universe of pathways."""
    members, edges = g.sized, g.edges
    universe = stage(enrich.gene_universe(edges), "universe")
    overlap = enrich.degree_overlap(members, g.seeds, propagate.out_degree(g.kept)).select("pathway", "stat")
    log_p = -F.log10(F.greatest("p", F.lit(1e-300)))
    seed = enrich.fisher(members, g.seeds, universe).select("pathway", log_p.alias("stat"))
    near = enrich.fisher(members, enrich.neighbourhood(g.seeds, edges), universe).select("pathway", log_p.alias("stat"))
    parts = {"degree_overlap": overlap, "seed_fisher": seed, "neighbourhood_fisher": near}
    for name, scores in (("preranked", nano(g.cond_scores)), ("preranked_raw", nano(g.raw_scores))):
        genes = scores.filter(membership.is_gene(F.col("node_id"))).select("node_id")
        parts[name] = enrich.preranked(members, scores, genes).select("pathway", F.col("es").alias("stat"))
    full = g.sizes.join(g.cond_scores.withColumnRenamed("node_id", "pathway"), "pathway", "left").fillna(0.0, ["score"])
    parts["full"] = full.select("pathway", (F.round(F.col("score") / F.sqrt("member_gene_count") * 1e9, 0) / 1e3).alias("stat"))
    out = None
    for name, part in parts.items():
        part = part.withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return stats.ranked_by_range(out.withColumn("stat", F.round("stat", 6) + F.lit(0.0)), ["method"], [F.desc("stat"), F.asc("pathway")])


@query(_BASELINES + "SELECT * FROM b_ranked")
def a18_baselines(g):
    """Every baseline, and the degree-normalised score itself, with rank: a long table of methods."""
    return _baselines(g)


@query(f"""{_BASELINES}, rk AS (SELECT *, pathway IN (SELECT node_id FROM refs) AS in_set FROM b_ranked), h AS (SELECT *, sum(in_set::INT) OVER (PARTITION BY method ORDER BY rank) AS hits FROM rk),
a AS (SELECT method, count(*) AS n, count(*) FILTER (in_set) AS n_relevant, coalesce(avg(hits / rank) FILTER (in_set), 0) AS ap, avg(rank) FILTER (in_set) AS mean_rank,
 {", ".join(f"count(*) FILTER (in_set AND rank <= {k}) AS h{k}, coalesce(sum(1 / log2(rank + 1.0)) FILTER (in_set AND rank <= {k}), 0) AS d{k}" for k in (10, 20, 50))} FROM h GROUP BY 1)
SELECT method, n, n_relevant, round(ap, 9) AS ap, round(mean_rank, 9) AS mean_rank, {", ".join(_metric_sql(k) for k in (10, 20, 50))} FROM a""")
def a18_method_metrics(g):
    refs = g.refs.select(F.col("node_id").alias("pathway"), F.lit(True).alias("in_set"))
    rows = _baselines(g).join(F.broadcast(refs), "pathway", "left").fillna(False, ["in_set"])
    return _rounded(stats.ranking_metrics(rows, ["method"], F.col("in_set")))


# --- members and neighbours ------------------------------------------------------------------------------------------

_MEMBER_TABLE = f"""{_PPR}, {_SIZED}, mom AS (SELECT avg(score) FILTER (b.sab IN ({", ".join(f"'{x}'" for x in GENE_SABS)})) AS gm, stddev_pop(score) FILTER (b.sab IN ({", ".join(f"'{x}'" for x in GENE_SABS)})) AS gs
 FROM cond LEFT JOIN best_sab b USING (node_id)),
mt AS (SELECT pathway, gene, score, min(score) OVER w AS lo, max(score) OVER w AS hi, avg(score) OVER w AS mean, stddev_pop(score) OVER w AS sd FROM sized JOIN cond ON gene = cond.node_id WINDOW w AS (PARTITION BY pathway))"""


@query(f"""{_MEMBER_TABLE} SELECT pathway, gene, round(score * 1e6, 3) AS score, round(CASE WHEN hi - lo > 0 THEN (score - lo) / (hi - lo) ELSE 1 END, 6) AS score_norm, round(CASE WHEN hi - lo > 0 THEN (score - mean) / sd ELSE 0 END, 6) + 0.0 AS z_within, round((score - gm) / gs, 6) AS z_global FROM mt, mom""")
def a20_member_scores(g):
    scores = g.cond_scores
    rows = scoring.member_scores(g.sized, scores, scoring.gene_moments(scores, g.sabs, GENE_SABS))
    return rows.select("pathway", "gene", micro("score"), F.round("score_norm", 6).alias("score_norm"), (F.round("z_within", 6) + F.lit(0.0)).alias("z_within"), F.round("z_global", 6).alias("z_global"))


@query(f"""{_MEMBER_TABLE} SELECT round(gm * 1e6, 3) AS mean, round(gs * 1e6, 3) AS sd FROM mom""")
def a19_gene_moments(g):
    moments = scoring.gene_moments(g.cond_scores, g.sabs, GENE_SABS)
    return moments.select(micro("mean"), micro("sd"))


_NEAR = f"""{_PPR}, {_SIZED}, ends AS (SELECT source AS pathway, target AS node_id FROM kept UNION SELECT target, source FROM kept),
nb AS (SELECT pathway, node_id, round(score * 1e9) / 1e9 AS score FROM ends JOIN cond USING (node_id) WHERE pathway IN (SELECT pathway FROM sized)),
ns AS (SELECT *, CASE WHEN hi - lo > 0 THEN (score - mean) / sd ELSE 0 END AS z FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, avg(score) OVER w AS mean, stddev_pop(score) OVER w AS sd FROM nb WINDOW w AS (PARTITION BY pathway))),
best AS (SELECT * FROM ns QUALIFY row_number() OVER (PARTITION BY pathway ORDER BY score DESC, node_id) <= 200)"""


def _influential(g: Graph, limit: int | None) -> DataFrame:
    return scoring.influential_nodes(g.sized.select("pathway").distinct(), g.kept, nano(g.cond_scores), g.sized, g.seeds, limit)


@query(f"""{_NEAR} SELECT pathway, node_id, round(CASE WHEN hi - lo > 0 THEN (score - lo) / (hi - lo) ELSE 1 END, 6) AS score_norm, round(z, 6) + 0.0 AS z_within, (pathway, node_id) IN (SELECT (pathway, gene) FROM sized) AS is_member,
node_id IN (SELECT node_id FROM seeds) AS is_seed FROM best""")
def a21_influential_nodes(g):
    g.hold_conditioned()
    return _influential(g, 200).select("pathway", "node_id", F.round("score_norm", 6).alias("score_norm"), (F.round("z_within", 6) + F.lit(0.0)).alias("z_within"), "is_member", "is_seed")


_A22 = """i22 AS (SELECT pathway, count(*) AS n, count(*) FILTER (round(z, 6) > 1.96) AS n_high, round(quantile_cont(score, 0.25) * 1e6, 5) AS p25, round(median(score) * 1e6, 5) AS p50, round(quantile_cont(score, 0.75) * 1e6, 5) AS p75, round(max(score) * 1e6, 5) AS max_score FROM ns GROUP BY 1),
h22 AS (SELECT pathway, string_agg(node_id, ';' ORDER BY score DESC, node_id) AS high FROM best WHERE round(z, 6) > 1.96 GROUP BY 1)"""


@query(f"{_NEAR}, {_A22} SELECT i22.*, coalesce(high, '') AS high FROM i22 LEFT JOIN h22 USING (pathway)")
def a22_influence_summary(g):
    g.hold_conditioned()
    return _influence(g).select("pathway", "n", "n_high", *(F.round(F.col(c) * 1e6, 5).alias(c) for c in ("p25", "p50", "p75", "max_score")), "high")


def _influence(g: Graph) -> DataFrame:
    near = stage(_influential(g, None), "near")
    return scoring.influence_summary(near, scoring.best_neighbours(near, 200))


@query(f"""{_SCORED.replace("ends AS (SELECT source AS pathway", "ends2 AS (SELECT source AS pathway").replace("FROM ends e", "FROM ends2 e")}, {_NEAR[_NEAR.index("ends AS"):]}, {_A22},
mt AS (SELECT pathway, gene, score FROM sized JOIN cond ON gene = cond.node_id), sm AS (SELECT pathway, count(*) AS n_seeds, string_agg(gene, ';' ORDER BY round(score * 1e9) DESC, gene) AS seed_members FROM mt WHERE gene IN (SELECT node_id FROM seeds) GROUP BY 1)
SELECT (row_number() OVER (ORDER BY round(degree_norm * 1e9) DESC, s.pathway))::INTEGER AS rank, s.pathway, round(degree_norm * 1e6, 3) AS degree_norm, coalesce(n_seeds, 0) AS n_seeds, coalesce(seed_members, '') AS seed_members,
coalesce(n_high, 0) AS n_high, coalesce(high, '') AS high FROM scored s LEFT JOIN sm ON s.pathway = sm.pathway LEFT JOIN i22 ON s.pathway = i22.pathway LEFT JOIN h22 ON s.pathway = h22.pathway""")
def a23_summary(g):
    """Pathways by rank with their seed members and their influential neighbours."""
    scored = _scored(g)[0]
    scores = nano(g.cond_scores)
    rows = scoring.member_scores(g.sized, scores, scoring.gene_moments(scores, g.sabs, GENE_SABS))
    out = scoring.summary(scored.select("pathway", "degree_norm", F.round(F.col("degree_norm") * 1e9, 0).alias("_by")), rows, g.seeds)
    out = stats.ranked_by_range(out, [], [F.desc("_by"), F.asc("pathway")]).join(_influence(g).select("pathway", "n_high", "high"), "pathway", "left")
    return out.select("rank", "pathway", micro("degree_norm"), "n_seeds", "seed_members", F.coalesce("n_high", F.lit(0)).cast("long").alias("n_high"), F.coalesce("high", F.lit("")).alias("high"))


# --- nulls and resampling --------------------------------------------------------------------------------------------

PERMUTATIONS, REWIRINGS, POOL, CHOSEN = 1000, 1000, 15, 10
BOOT_SIZES, BOOTS = [10, 20, 30], 500


@query(f"{_COND}, {MEMBERS} SELECT DISTINCT gene AS node_id FROM members WHERE gene IN (SELECT source FROM kept WHERE propagating UNION SELECT target FROM kept WHERE propagating)")
def n1_seed_universe(g):
    return nulls.seed_universe(g.members, g.ends(conditioning.kept(g.conditioned).filter("propagating")))


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("pathway").agg(F.count("*").alias("member_gene_count"))


_PERMS = f"SELECT unnest(range({PERMUTATIONS})) AS perm"


# by the adjoint: a pathway's score is the mean over the seeds of what one backward propagation from it leaves there
_N2 = f"""uni AS (SELECT DISTINCT gene AS node_id FROM sized WHERE gene IN (SELECT node_id FROM cond_nodes)),
drawn AS (SELECT perm, node_id FROM (SELECT perm, node_id, row_number() OVER (PARTITION BY perm ORDER BY {scalars.seeded_hash_sql(42, "perm", "node_id")}, node_id) AS k FROM uni, ({_PERMS})) WHERE k <= (SELECT count(*) FROM seeds)),
wanted AS (SELECT DISTINCT pathway AS w, pathway AS node_id FROM sized UNION ALL SELECT '', node_id FROM cond_nodes),
back AS (SELECT 0 AS i, w, node_id, 1.0::DOUBLE AS score FROM wanted UNION ALL SELECT i + 1, w, node_id, sum(v) FROM (
 SELECT f.i, f.w, t.src AS node_id, {1 - ALPHA} * t.p * f.score AS v FROM back f JOIN t ON f.node_id = t.dst WHERE f.i < {STEPS}
 UNION ALL SELECT k.i, p.w, p.node_id, {ALPHA} FROM (SELECT DISTINCT i FROM back WHERE i < {STEPS}) k, wanted p) GROUP BY i, w, node_id),
hits AS (SELECT perm, w, sum(score) AS s FROM drawn JOIN back ON back.i = {STEPS} AND back.node_id = drawn.node_id GROUP BY 1, 2),
n2 AS (SELECT q.perm, z.pathway, coalesce(h.s / t.s, 0) / sqrt(z.m) AS n2_null FROM (SELECT pathway, count(*) AS m FROM sized GROUP BY 1) z CROSS JOIN ({_PERMS}) q
 LEFT JOIN hits h ON h.perm = q.perm AND h.w = z.pathway LEFT JOIN hits t ON t.perm = q.perm AND t.w = '')"""


def _seed_null(g: Graph) -> DataFrame:
    n = g.seeds.count()
    drawn = nulls.draws(nulls.seed_universe(g.sized, g.ends(g.moving)), n, PERMUTATIONS)
    return nulls.seed_permutation_null(g.moves(g.moving), drawn, n, g.sizes, PERMUTATIONS, ALPHA, STEPS)


@query(f"""{_MOVES}, {_SIZED}, {_N2} SELECT perm::INTEGER AS perm, pathway, round(n2_null * 1e6, 3) AS "null" FROM n2""")
def n2_seed_permutation_null(g):
    return _seed_null(g).select("perm", "pathway", micro("null"))


@query(f"{_COND} SELECT flow_class = 'Pathway Contribution' AS bridge, count(*) AS n FROM kept WHERE propagating GROUP BY 1")
def n3_bridges(g):
    bridge, rest = nulls.bridges(conditioning.kept(g.conditioned))
    rows = bridge.select(F.lit(True).alias("bridge")).unionByName(rest.select(F.lit(False).alias("bridge")))
    return rows.groupBy("bridge").agg(F.count("*").alias("n"))


@query(f"""{_COND}, b AS (SELECT DISTINCT source, target FROM kept WHERE propagating AND flow_class = 'Pathway Contribution')
SELECT 'out' AS side, source AS node_id, count(*) AS n FROM b GROUP BY 2 UNION ALL SELECT 'in', target, count(*) FROM b GROUP BY 2""")
def n4_rewired_degrees(g):
    """Degrees after rewiring: the oracle has those before it."""
    rewired = nulls.rewire(nulls.bridges(g.kept)[0])
    rewired = stage(rewired.distinct(), "rewired")
    out = rewired.groupBy(F.col("source").alias("node_id")).agg(F.count("*").alias("n")).withColumn("side", F.lit("out"))
    return out.unionByName(rewired.groupBy(F.col("target").alias("node_id")).agg(F.count("*").alias("n")).withColumn("side", F.lit("in")))


@query()
def n5_rewiring_null(g):
    kept = g.kept
    restarts = propagate.restart(g.seeds, g.ends(kept.filter("propagating")))
    return nulls.rewiring_null(kept, restarts, g.sizes, REWIRINGS, ALPHA, STEPS)


_STRATA = f"""{_COND}, {MEMBERS}, gs AS (SELECT DISTINCT gene FROM members), dg AS (SELECT source, count(*) AS d, greatest(count(*) FILTER (flow_class = 'Pathway Contribution'), 1) AS m FROM kept WHERE propagating GROUP BY 1),
lg AS (SELECT gene, log10(coalesce(d, 1)) AS d, log10(coalesce(m, 1)) AS m FROM gs LEFT JOIN dg ON gene = source),
cu AS (SELECT quantile_cont(d, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS dc, quantile_cont(m, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS mc FROM lg)"""


@query(f"""{_STRATA} SELECT gene, 'd' || len(list_filter(dc, lambda x: x <= d)) || '_m' || len(list_filter(mc, lambda x: x <= m)) AS stratum FROM lg, cu""")
def n6_gene_strata(g):
    return nulls.gene_strata(g.members.select("gene").distinct(), conditioning.kept(g.conditioned))


_N7 = f"""dg AS (SELECT source, count(*) AS d, greatest(count(*) FILTER (flow_class = 'Pathway Contribution'), 1) AS m FROM kept WHERE propagating GROUP BY 1),
lg2 AS (SELECT gene, log10(coalesce(d, 1)) AS d, log10(coalesce(m, 1)) AS m FROM (SELECT DISTINCT gene FROM sized) LEFT JOIN dg ON gene = source WHERE gene IN (SELECT node_id FROM cond)),
cu2 AS (SELECT quantile_cont(d, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS dc, quantile_cont(m, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS mc FROM lg2),
st AS (SELECT gene, 'd' || len(list_filter(dc, lambda x: x <= d)) || '_m' || len(list_filter(mc, lambda x: x <= m)) AS stratum FROM lg2, cu2),
st_size AS (SELECT stratum, count(*) AS size FROM st GROUP BY 1),
ring AS (SELECT perm, stratum, row_number() OVER (PARTITION BY perm, stratum ORDER BY {scalars.seeded_hash_sql(42, "perm", "st.gene")}, st.gene) - 1 AS slot, score FROM st JOIN cond c ON st.gene = c.node_id, ({{perms}})),
pl AS (SELECT pathway, stratum, row_number() OVER (PARTITION BY pathway, stratum ORDER BY gene) - 1 AS k FROM sized JOIN st USING (gene)),
dr AS (SELECT perm, pathway, stratum, ({scalars.seeded_hash_sql(42, "perm", "pathway", "stratum")} % size + k) % size AS slot FROM pl JOIN st_size USING (stratum), ({{perms}})),
n7 AS (SELECT perm, pathway, avg(score) AS null_mean_score FROM dr JOIN ring USING (perm, stratum, slot) GROUP BY 1, 2)"""


def _member_null(g: Graph) -> DataFrame:
    genes = g.sized.select("gene").distinct().join(g.cond_scores.select(F.col("node_id").alias("gene")), "gene", "left_semi")
    strata = stage(nulls.gene_strata(genes, g.kept), "strata")
    return nulls.member_mean_null(g.sized, strata, g.cond_scores, PERMUTATIONS)


@query(f"""{_PPR}, {_SIZED}, {_N7.format(perms=_PERMS)} SELECT perm::INTEGER AS perm, pathway, round(null_mean_score * 1e6, 3) AS "null" FROM n7""")
def n7_member_mean_null(g):
    return _member_null(g).select("perm", "pathway", micro("null"))


def _against(nulls_: DataFrame, scored: DataFrame, score: str, prefix: str) -> DataFrame:
    """(pathway, null mean, z, p and q of ``score``), values compared in whole billionths."""
    billionths = lambda c: F.round(F.col(c) * 1e9, 0)
    observed = scored.select("pathway", billionths(score).alias("observed"))
    out = stats.empirical(nulls_.select("pathway", billionths("null").alias("null")), observed, "pathway")
    out = stats.benjamini_hochberg(out, "empirical_p", [])
    named = {"null_mean": F.round(F.col("null_mean") / 1e3, 3), "null_z": F.round("null_z", 4), "p": F.round("empirical_p", 9), "q": F.round("q", 9), "calibrated": F.col("calibrated")}
    return out.select("pathway", *(c.alias(prefix + n) for n, c in named.items()))


def _empirical_sql(name: str, source: str, observed: str, prefix: str) -> str:
    return f"""{name}_o AS (SELECT pathway, round({observed} * 1e9) AS o FROM scored),
{name}_s AS (SELECT pathway, o, count(*) AS n, avg(v) AS m, stddev_pop(v) AS sd, count(*) FILTER (v >= o) AS ge, m > 0 AND o / m <= 10 AS cal FROM (SELECT pathway, round({source[1]} * 1e9) AS v FROM {source[0]}) JOIN {name}_o USING (pathway) GROUP BY 1, 2),
{name}_p AS (SELECT *, CASE WHEN cal THEN (1 + ge) / (1 + n) END AS p FROM {name}_s),
{name}_r AS (SELECT p, sum(count(*)) OVER (ORDER BY p) AS r, sum(count(*)) OVER () AS n FROM {name}_p WHERE p IS NOT NULL GROUP BY 1),
{name}_q AS (SELECT p, least(1, min(p * n / r) OVER (ORDER BY p DESC)) AS q FROM {name}_r),
{name}_f AS (SELECT pathway, round(m / 1e3, 3) AS {prefix}null_mean, CASE WHEN cal THEN round(CASE WHEN sd > 0 THEN (o - m) / sd ELSE 0 END, 4) END AS {prefix}null_z, round(s.p, 9) AS {prefix}p, round(q, 9) AS {prefix}q, cal AS {prefix}calibrated
 FROM {name}_p s LEFT JOIN {name}_q ON s.p = {name}_q.p)"""


@query(f"""{_SCORED}, {_N2}, {_N7.format(perms=_PERMS)}, {_empirical_sql("e1", ("n2", "n2_null"), "degree_norm", "")}, {_empirical_sql("e2", ("n7", "null_mean_score"), "member_mean", "member_")}
SELECT * FROM (SELECT pathway, round(degree_norm * 1e6, 3) AS degree_norm, round(member_mean * 1e6, 3) AS member_mean FROM scored) LEFT JOIN e1_f USING (pathway) LEFT JOIN e2_f USING (pathway)""")
def n12_significance(g):
    """Every scored pathway against both nulls: seeds drawn at random, and genes of the same strata as its members."""
    g.hold_scores()
    scored = stage(scoring.tested_scores(g.sized, g.cond_scores), "scored")
    rows = scored.select("pathway", micro("degree_norm"), micro("member_mean"))
    rows = rows.join(_against(stage(_seed_null(g), "nulls"), scored, "degree_norm", ""), "pathway", "left")
    return rows.join(_against(stage(_member_null(g), "nulls"), scored, "member_mean", "member_"), "pathway", "left")


def _pool(g: Graph, most: int | None) -> list[str]:
    """The first seeds by id, all of them without ``most``; a short list."""
    return sorted(r["node_id"] for r in g.seeds.collect())[:most]


def _pool_scores(g: Graph, edges: DataFrame, pool: list[str]) -> DataFrame:
    positions = g.spark.createDataFrame(list(enumerate(pool)), "position int, node_id string")
    return stage(resample.pool_scores(g.moves(edges), positions, len(pool), ALPHA, STEPS), "by-seed")


def _set_metrics(g: Graph, sets: list, pool: list[str], held_out: bool) -> DataFrame:
    """Metrics of every set of seeds by both operators and by their overlap with the pathways."""
    least = 2 * LEAST_MEMBERS
    g.hold()
    members = stage(membership.sized(stage(g.members, "all-members"), least, MOST_MEMBERS), "members")
    kept = g.kept  # also holds the edges
    sizes = stage(members.groupBy(F.col("pathway").alias("key")).agg(F.count("*").cast("double").alias("size")), "sizes")
    refs = [r["node_id"] for r in g.refs.collect()]
    none = F.array_repeat(F.lit(0.0), len(pool))
    lists = {}
    positions = g.spark.createDataFrame(list(enumerate(pool)), "position int, node_id string")
    held = {"conditioned": _pool_scores(g, kept.filter("propagating"), pool)} if held_out else {}  # of every node
    arms = {"conditioned": F.col("propagating"), "raw": F.lit(True)}
    edges = g.conditioned.select("source", "target", *(c.alias(a) for a, c in arms.items() if a not in held))
    by_arm = held | resample.asked_scores(edges, [a for a in arms if a not in held], positions, len(pool), sizes.select(F.col("key").alias("node_id")), ALPHA, STEPS)
    for arm in arms:
        scores = by_arm[arm]
        size = F.col("size") if arm == "conditioned" else F.lit(1.0)
        rows = sizes.join(scores.withColumnRenamed("node_id", "key"), "key", "left").select("key", F.coalesce("by_seed", none).alias("by_seed"), size.alias("size"))
        lists[arm] = resample.list_metrics(stage(rows, "lists"), sets, len(pool), refs, resample.mean_score)
        if held_out and arm == "conditioned":
            genes = resample.held_out_precision(scores.select(F.col("node_id").alias("key"), "by_seed", F.lit(1.0).alias("size")), sets, pool)
    universe = stage(enrich.gene_universe(g.edges), "universe")
    inside = {r["node_id"] for r in universe.filter(F.col("node_id").isin(pool)).collect()}
    rows = members.join(universe.withColumnRenamed("node_id", "gene").withColumn("_u", F.lit(1)), "gene", "left")
    rows = rows.join(F.broadcast(positions.groupBy(F.col("node_id").alias("gene")).agg(F.collect_list("position").alias("_at"))), "gene", "left")
    hits = rows.groupBy(F.col("pathway").alias("key")).agg(F.flatten(F.collect_list("_at")).alias("_at"), F.count("_u").cast("double").alias("size"))
    hit = F.transform(F.sequence(F.lit(0), F.lit(len(pool) - 1)), lambda i: F.array_contains("_at", i).cast("double"))
    rows = hits.select("key", hit.alias("by_seed"), "size")
    value = resample.fisher_value([1.0 if s in inside else 0.0 for s in pool], universe.count())
    fisher = resample.list_metrics(stage(rows, "overlaps"), sets, len(pool), refs, value)
    out = resample.compared(lists["conditioned"], lists["raw"], fisher)
    return _rounded(out.join(genes, "split", "left") if held_out else out)


def _list_sql(name: str, scores: str) -> str:
    """Metrics ``name`` of lists ``scores`` (split, pathway, in_set, score), higher first."""
    return f"""{name}_rk AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY score DESC, pathway) AS rank FROM {scores}), {name}_h AS (SELECT *, sum(in_set::INT) OVER (PARTITION BY split ORDER BY rank) AS hits FROM {name}_rk),
{name}_a AS (SELECT split, count(*) AS n, count(*) FILTER (in_set) AS n_relevant, coalesce(avg(hits / rank) FILTER (in_set), 0) AS ap, avg(rank) FILTER (in_set) AS mean_rank,
 {", ".join(f"count(*) FILTER (in_set AND rank <= {k}) AS h{k}, coalesce(sum(1 / log2(rank + 1.0)) FILTER (in_set AND rank <= {k}), 0) AS d{k}" for k in (10, 20))} FROM {name}_h GROUP BY 1),
{name} AS (SELECT split, n, n_relevant, ap, mean_rank, {", ".join(_metric_sql(k) for k in (10, 20))} FROM {name}_a)"""


def _pool_sql(name: str, transitions: str) -> str:
    return f"""{name} AS (SELECT 0 AS i, position, node_id, 1.0::DOUBLE AS score FROM pool UNION ALL SELECT i + 1, position, node_id, sum(v) FROM (
 SELECT f.i, f.position, t.dst AS node_id, {1 - ALPHA} * t.p * f.score AS v FROM {name} f JOIN {transitions} t ON f.node_id = t.src WHERE f.i < {STEPS}
 UNION ALL SELECT k.i, p.position, p.node_id, {ALPHA} FROM (SELECT DISTINCT i FROM {name} WHERE i < {STEPS}) k, pool p) GROUP BY i, position, node_id)"""


def _split_sql(sets: str, most: int | None, held_out: bool) -> str:
    """Metrics of the sets ``chosen`` (split, position)."""
    choose = lambda n, r: f"(lgamma({n} + 1.0) - lgamma({r} + 1.0) - lgamma({n} - {r} + 1.0))"
    term_ = f"exp({choose('marked', 'i')} + {choose('(population - marked)', '(drawn - i)')} - {choose('population', 'drawn')})"
    tail = f"least(1, list_sum(list_transform(range(greatest(k, marked + drawn - population, 0), least(marked, drawn) + 1), lambda i: {term_})))"
    genes = f""", node_s AS (SELECT c.split, v.node_id, round(sum(v.score) / any_value(n.k) * 1e9) AS s FROM chosen c JOIN csteps v ON v.i = {STEPS} AND v.position = c.position JOIN n_seeds n ON n.split = c.split GROUP BY 1, 2),
held AS (SELECT n.split, p.node_id, coalesce(s, 0) AS s FROM n_seeds n CROSS JOIN pool p LEFT JOIN node_s USING (split, node_id) WHERE (n.split, p.position) NOT IN (SELECT (split, position) FROM chosen)),
held_n AS (SELECT h.split, h.node_id, h.s, count(o.node_id) AS above FROM held h LEFT JOIN node_s o ON o.split = h.split AND o.s > h.s AND o.node_id NOT IN (SELECT node_id FROM pool) GROUP BY 1, 2, 3),
held_k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY s DESC, node_id) AS hit FROM held_n),
genes AS (SELECT split, round(avg(hit / (above + hit)), 9) AS gene_auprc FROM held_k GROUP BY 1)"""
    return f"""{_MOVES}, raw AS (SELECT * FROM resolved WHERE known), {transitions_sql("rt", "true", "raw")}, {MEMBERS}, pool AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS position FROM seeds {f"QUALIFY position < {most}" if most else ""}),
{_pool_sql("csteps", "t")}, {_pool_sql("rsteps", "rt")}, {sets}, {_UNIVERSE},
n_seeds AS (SELECT split, count(*) AS k, count(*) FILTER (node_id IN (SELECT node_id FROM u)) AS drawn FROM chosen JOIN pool USING (position) GROUP BY 1),
pw AS (SELECT pathway, count(*) AS size, pathway IN (SELECT node_id FROM refs) AS in_set, count(*) FILTER (gene IN (SELECT node_id FROM u)) AS marked FROM members GROUP BY 1 HAVING count(*) BETWEEN {2 * LEAST_MEMBERS} AND {MOST_MEMBERS}),
chit AS (SELECT c.split, v.node_id AS pathway, sum(v.score) AS s FROM chosen c JOIN csteps v ON v.i = {STEPS} AND v.position = c.position WHERE v.node_id IN (SELECT pathway FROM pw) GROUP BY 1, 2),
rhit AS (SELECT c.split, v.node_id AS pathway, sum(v.score) AS s FROM chosen c JOIN rsteps v ON v.i = {STEPS} AND v.position = c.position WHERE v.node_id IN (SELECT pathway FROM pw) GROUP BY 1, 2),
fhit AS (SELECT c.split, m.pathway, count(*) AS k FROM chosen c JOIN pool USING (position) JOIN members m ON m.gene = pool.node_id GROUP BY 1, 2),
cs AS (SELECT n.split, pw.pathway, in_set, round(coalesce(s, 0) / n.k / sqrt(size) * 1e9) AS score FROM n_seeds n CROSS JOIN pw LEFT JOIN chit ON chit.split = n.split AND chit.pathway = pw.pathway),
rs AS (SELECT n.split, pw.pathway, in_set, round(coalesce(s, 0) / n.k * 1e9) AS score FROM n_seeds n CROSS JOIN pw LEFT JOIN rhit ON rhit.split = n.split AND rhit.pathway = pw.pathway),
fk AS (SELECT DISTINCT marked, drawn, k, (SELECT count(*) FROM u) AS population FROM fhit JOIN pw USING (pathway) JOIN (SELECT split, drawn FROM n_seeds) USING (split)), fp AS (SELECT marked, drawn, k, round({tail}, 12) AS p FROM fk),
fs AS (SELECT n.split, pw.pathway, in_set, -coalesce(fp.p, 1) AS score FROM n_seeds n CROSS JOIN pw LEFT JOIN fhit ON fhit.split = n.split AND fhit.pathway = pw.pathway LEFT JOIN fp ON fp.marked = pw.marked AND fp.drawn = n.drawn AND fp.k = fhit.k),
{_list_sql("cm", "cs")}, {_list_sql("rm", "rs")}, {_list_sql("fm", "fs")}{genes if held_out else ""}
SELECT cm.split, cm.n, cm.n_relevant, round(cm.ap, 9) AS ap, round(cm.mean_rank, 9) AS mean_rank, {", ".join(f"cm.{m}_at_{k}" for k in (10, 20) for m in ("p", "recall", "enrich", "ndcg"))},
 round(rm.mean_rank, 9) AS mean_rank_raw, round(rm.mean_rank - cm.mean_rank, 9) AS rank_improvement, fm.p_at_10 AS fisher_p_at_10, round(fm.ap, 9) AS fisher_ap, (round(cm.ap, 9) > round(fm.ap, 9))::INTEGER AS beats_fisher{", gene_auprc" if held_out else ""}
FROM cm JOIN rm USING (split) JOIN fm USING (split){" LEFT JOIN genes USING (split)" if held_out else ""}"""


def _rounded(metrics: DataFrame) -> DataFrame:
    real = ("ap", "mean_rank", "enrich", "ndcg", "rank_improvement", "fisher_ap", "gene_auprc")
    return metrics.select(*(F.round(c, 9).alias(c) if c.startswith(real) else F.col(c) for c in metrics.columns))


@query(_split_sql(f"chosen AS (SELECT split, position FROM (SELECT unnest(range({1 << POOL})) AS split), (SELECT unnest(range({POOL})) AS position) WHERE bit_count(split) = {CHOSEN} AND (split >> position) & 1 = 1)", POOL, True))
def n9_split_metrics(g):
    return _set_metrics(g, resample.splits(POOL, CHOSEN), _pool(g, POOL), True)


_BOOTS = f"""chosen AS (SELECT split, position FROM (SELECT split, position, row_number() OVER (PARTITION BY split ORDER BY {scalars.seeded_hash_sql(42, "split", "position")}, position) AS k
 FROM (SELECT unnest(range({BOOTS * len(BOOT_SIZES)})) AS split), pool) WHERE k <= [{", ".join(map(str, BOOT_SIZES))}][split % {len(BOOT_SIZES)} + 1] UNION ALL SELECT -1, position FROM pool)"""


@query(_split_sql(_BOOTS, None, False))
def n10_bootstrap_metrics(g):
    pool = _pool(g, None)
    return _set_metrics(g, resample.bootstrap(g.spark, len(pool), BOOT_SIZES, BOOTS), pool, False)


_ROBUST = "count(*) AS n, count(*) FILTER (p_at_10 >= 0.5) AS p10_half, count(*) FILTER (p_at_10 >= 0.3) AS p10_third, count(*) FILTER (rank_improvement > 0) AS improved, sum(beats_fisher)::BIGINT AS beats_fisher, round(avg(ap), 6) AS mean_ap, round(stddev_samp(ap), 6) AS sd_ap"


def _robustness() -> list:
    number = lambda c: F.count(F.when(c, 1))
    return [
        F.count("*").alias("n"), number(F.col("p_at_10") >= 0.5).alias("p10_half"), number(F.col("p_at_10") >= 0.3).alias("p10_third"), number(F.col("rank_improvement") > 0).alias("improved"),
        F.sum("beats_fisher").alias("beats_fisher"), F.round(F.avg("ap"), 6).alias("mean_ap"), F.round(F.stddev_samp("ap"), 6).alias("sd_ap"),
    ]


@query(f"SELECT {_ROBUST} FROM ({SQL['n9_split_metrics']})")
def a24_robustness(g):
    return n9_split_metrics(g).agg(*_robustness())


@query(f"SELECT CASE WHEN split < 0 THEN -1 ELSE [{', '.join(map(str, BOOT_SIZES))}][split % {len(BOOT_SIZES)} + 1] END AS seed_size, {_ROBUST} FROM ({SQL['n10_bootstrap_metrics']}) GROUP BY 1")
def a24_by_seed_size(g):
    """Of bootstrap draws by their number of seeds; -1 is the run with all of them."""
    size = F.when(F.col("split") < 0, -1).otherwise(F.get(F.array(*(F.lit(x) for x in BOOT_SIZES)), (F.col("split") % len(BOOT_SIZES)).cast("int")))
    return n10_bootstrap_metrics(g).groupBy(size.alias("seed_size")).agg(*_robustness())


@query(f"""WITH {GRAPH}, {_SIZED}, k AS (SELECT pathway, gene, row_number() OVER (PARTITION BY pathway ORDER BY md5('42|' || pathway || '|' || gene), gene) AS k, count(*) OVER (PARTITION BY pathway) AS n FROM sized)
SELECT pathway, gene, CASE WHEN k <= ceil(round(n * 0.7, 6)) THEN 'seed' ELSE 'heldout' END AS role FROM k""")
def n11_control_split(g):
    return resample.control_split(g.sized)


@query(f"""WITH p AS (SELECT {term_sql("predicate", "lower")} AS predicate, count(*) AS n FROM edges GROUP BY 1), f(predicate, class) AS (VALUES {", ".join(f"('{p}', '{c}')" for p, _, c in graph.FLOWS)})
SELECT p.predicate, n, CASE WHEN f.class IS NULL THEN 'no rule' WHEN f.class IN ('nonpropagating_context', 'contextual_constraint') THEN 'does not propagate' ELSE 'ok' END AS finding FROM p LEFT JOIN f ON p.predicate = f.predicate WHERE p.predicate IS NOT NULL""")
def v3_rule_findings(g):
    counts = g.table("edges").groupBy(term("predicate", "lower").alias("predicate")).agg(F.count("*").alias("n")).filter("predicate is not null")
    rows = counts.join(F.broadcast(g.rules.flows), "predicate", "left")
    finding = F.when(F.col("class").isNull(), "no rule").when(F.col("class").isin("nonpropagating_context", "contextual_constraint"), "does not propagate").otherwise("ok")
    return rows.select("predicate", "n", finding.alias("finding"))


@query(f"WITH {GRAPH} SELECT node_id, count(*) AS n FROM g_nodes WHERE name LIKE '% gene' AND name NOT IN (SELECT name FROM reference_concepts WHERE role = 'heldout') GROUP BY 1")
def v9_excluded_symbols(g):
    banned = g.table("reference_concepts").filter("role = 'heldout'").select("name").distinct()
    return g.nodes.filter(F.col("name").endswith(" gene")).join(F.broadcast(banned), "name", "left_anti").groupBy("node_id").agg(F.count("*").alias("n"))
