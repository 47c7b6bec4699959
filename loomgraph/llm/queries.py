"""Queries of problems 1, 3, 4, 7, 8, 9 and 10 over the given tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.ids import WHITE, plain_id, plain_id_sql, term, term_sql
from loomgraph.llm import cooccurrence, duplicates, frequency, packing, spam, tokens, topn
from loomgraph.session import table

RARE_RECORDS, COMMON_SHARE = 3, 0.1
TOP = 5
MIN_SHARED, MIN_LIFT = 4, 3
CONTAINER_TOKENS = 2048


# --- problem 1 -------------------------------------------------------------------------------------------------------


def p1_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nodes").select(F.lit("nodes.sab").alias("field"), plain_id("node_id").alias("a"), F.lit(None).cast("string").alias("b"), term("sab", "upper").alias("term"))
    edges = table(spark, sf_dir, "edges").select(F.lit("edges.predicate").alias("field"), plain_id("source").alias("a"), plain_id("target").alias("b"), term("predicate", "lower").alias("term"))
    record = F.when((F.col("field") == "edges.predicate") | F.col("a").isNotNull(), F.struct("a", "b"))
    rows = nodes.unionByName(edges).select("field", record.alias("record"), "term")
    return frequency.term_frequencies(rows, RARE_RECORDS, COMMON_SHARE)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_frequencies(spark, sf_dir).filter("mark is not null").select("field", "term", "mark")


_P1 = f"""WITH r AS (SELECT 'nodes.sab' AS field, CASE WHEN id IS NOT NULL THEN id END AS record, t AS term FROM
  (SELECT {plain_id_sql("node_id")} AS id, {term_sql("sab", "upper")} AS t FROM nodes)
 UNION ALL SELECT 'edges.predicate', coalesce({plain_id_sql("source")}, '') || ' ' || coalesce({plain_id_sql("target")}, ''), {term_sql("predicate", "lower")} FROM edges),
n AS (SELECT field, count(DISTINCT record) AS all_records FROM r GROUP BY 1),
f AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT record) AS records FROM r WHERE term IS NOT NULL GROUP BY 1, 2),
m AS (SELECT f.*, all_records, CASE WHEN records BETWEEN 1 AND {RARE_RECORDS} THEN 'rare' WHEN records > {COMMON_SHARE} * all_records THEN 'common' END AS mark
 FROM f JOIN n USING (field)) """
P1_FREQUENCIES = _P1 + "SELECT * FROM m"
P1_FOUND = _P1 + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL"


# --- problem 3 -------------------------------------------------------------------------------------------------------


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pathway_scores_standard").select("row_id", "run_id", term("sab", "upper").alias("sab"), plain_id("concept_id").alias("concept"), (F.col("degree_norm") + F.lit(0.0)).alias("score"))
    rows = rows.filter("sab is not null and concept is not null and score is not null and not isnan(score)")
    best = rows.groupBy("run_id", "sab", "concept").agg(F.max(F.struct("score", (-F.col("row_id")).alias("r"))).alias("b"))
    best = best.select("run_id", "sab", "concept", F.col("b.score").alias("score"), (-F.col("b.r")).alias("row_id"))
    return topn.top_n(best, ["run_id", "sab"], "score", "concept", TOP).select("run_id", "sab", "row_id", "place")


P3_FOUND = f"""WITH r AS (SELECT row_id, run_id, {term_sql("sab", "upper")} AS sab, {plain_id_sql("concept_id")} AS concept, degree_norm + 0.0 AS score
 FROM pathway_scores_standard WHERE degree_norm IS NOT NULL AND NOT isnan(degree_norm)),
d AS (SELECT *, row_number() OVER (PARTITION BY run_id, sab, concept ORDER BY score DESC, row_id) AS k FROM r WHERE sab IS NOT NULL AND concept IS NOT NULL),
p AS (SELECT *, (row_number() OVER (PARTITION BY run_id, sab ORDER BY score DESC, concept))::INTEGER AS place FROM d WHERE k = 1)
SELECT run_id, sab, row_id, place FROM p WHERE place <= {TOP}"""


# --- problem 4 -------------------------------------------------------------------------------------------------------


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pathway_membership_edges").select(plain_id("target").alias("pathway"), plain_id("source").alias("gene"))
    pairs = cooccurrence.pair_counts(rows, "pathway", "gene", MIN_SHARED, MIN_LIFT)
    return pairs.select(F.col("item_a").alias("gene_a"), F.col("item_b").alias("gene_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pairs(spark, sf_dir).select("gene_a", "gene_b")


_P4 = f"""WITH m AS (SELECT DISTINCT {plain_id_sql("target")} AS p, {plain_id_sql("source")} AS g FROM pathway_membership_edges),
k AS (SELECT * FROM m WHERE p IS NOT NULL AND g IS NOT NULL), c AS (SELECT g, count(*) AS n FROM k GROUP BY 1), t AS (SELECT count(DISTINCT p) AS n FROM k),
x AS (SELECT a.g AS gene_a, b.g AS gene_b, count(*) AS n_ab FROM k a JOIN k b ON a.p = b.p AND a.g < b.g GROUP BY 1, 2 HAVING count(*) >= {MIN_SHARED}),
y AS (SELECT x.*, ca.n AS n_a, cb.n AS n_b, t.n AS n FROM x JOIN c ca ON gene_a = ca.g JOIN c cb ON gene_b = cb.g, t WHERE n_ab * t.n >= {MIN_LIFT} * ca.n * cb.n) """
P4_FOUND = _P4 + "SELECT gene_a, gene_b FROM y"
P4_PAIRS = _P4 + """SELECT gene_a, gene_b, n_ab, n_a, n_b, round(n_ab * n / (n_a * n_b), 6) AS lift,
 round(CASE WHEN n_a > n_ab THEN ((n - n_b) / n) / ((n_a - n_ab) / n_a) END, 6) AS conviction FROM y"""


# --- problem 7 -------------------------------------------------------------------------------------------------------

NODE_FIELDS = {"node_id": "id", "sab": "vocabulary", "label": "label", "name": "name"}
EDGE_FIELDS = {"source": "id", "target": "id", "predicate": "predicate", "sab": "sab", "confidence": "confidence", "evidence_type": "evidence", "value": "value"}


def _as_it_stands(c: Column) -> Column:
    return c


CANON = {
    "id": plain_id,
    "vocabulary": lambda c: term(c, "upper"),
    "predicate": lambda c: term(c, "lower"),
    "label": lambda c: F.lower(F.btrim(c, F.lit(WHITE))),
    "name": lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")),
}


def _copies(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    out = {}
    for tbl, fields, required in (("nodes", NODE_FIELDS, ["node_id"]), ("edges", EDGE_FIELDS, ["source", "target"])):
        canon = {kind: CANON.get(kind, _as_it_stands) for kind in fields.values()}
        out[tbl] = duplicates.copies(table(spark, sf_dir, tbl), "row_id", fields, canon, required)
    return out


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {tbl: f.select(F.lit(tbl).alias("tbl"), "row_id", "first_row_id") for tbl, (f, _) in _copies(spark, sf_dir).items()}
    return found["nodes"].unionByName(found["edges"])


def p7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = {tbl: r.select(F.lit(tbl).alias("tbl"), "first_row_id", "copies") for tbl, (_, r) in _copies(spark, sf_dir).items()}
    return records["nodes"].unionByName(records["edges"])


_WHITE_SQL = " || ".join(f"chr({ord(x)})" for x in WHITE)
_P7 = f"""WITH r AS (SELECT 'nodes' AS tbl, row_id, {plain_id_sql("node_id")} AS a, '' AS b, {term_sql("sab", "upper")} AS c, lower(trim(label, {_WHITE_SQL})) AS d,
 lower(regexp_replace(name, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS e, NULL AS f, NULL AS g FROM nodes
 UNION ALL SELECT 'edges', row_id, {plain_id_sql("source")}, {plain_id_sql("target")}, {term_sql("predicate", "lower")}, sab, confidence, evidence_type, value FROM edges),
w AS (SELECT tbl, row_id, CASE WHEN a IS NULL OR b IS NULL THEN row_id ELSE min(row_id) OVER (PARTITION BY tbl, a, b, c, d, e, f, g) END AS first_row_id FROM r) """
P7_FOUND = _P7 + "SELECT tbl, row_id, first_row_id FROM w WHERE row_id <> first_row_id"
P7_RECORDS = _P7 + "SELECT tbl, first_row_id, count(*) AS copies FROM w GROUP BY 1, 2"


# --- problems 8 and 9 ------------------------------------------------------------------------------------------------


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(table(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(table(spark, sf_dir, "documents")), CONTAINER_TOKENS)


# --- problem 10 ------------------------------------------------------------------------------------------------------


def p10_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.label_words(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.flagged(p10_labels(spark, sf_dir))


QUERIES = {
    "p1_found": p1_found,
    "p1_frequencies": p1_frequencies,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p7_found": p7_found,
    "p7_records": p7_records,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p10_found": p10_found,
    "p10_labels": p10_labels,
}
SQL = {
    "p1_found": P1_FOUND,
    "p1_frequencies": P1_FREQUENCIES,
    "p3_found": P3_FOUND,
    "p4_found": P4_FOUND,
    "p4_pairs": P4_PAIRS,
    "p7_found": P7_FOUND,
    "p7_records": P7_RECORDS,
}
