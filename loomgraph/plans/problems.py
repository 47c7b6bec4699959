"""Queries of problems 2, 5 and 6 over the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.ids import plain_id, plain_id_sql, term, term_sql
from loomgraph.operators import orphans, rejects, skew
from loomgraph.session import table

#: A hub holds at least one row in so many.
HUB_SHARE = 100


# --- problem 2: a few keys hold most records -------------------------------------------------------------------------


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "edges").select(plain_id("source").alias("s"), plain_id("target").alias("t"), term("predicate", "lower").alias("predicate"))
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.lit("source").alias("field"), F.col("s").alias("node_id"), F.col("t").alias("other")),
                F.struct(F.lit("target").alias("field"), F.col("t").alias("node_id"), F.col("s").alias("other")),
            )
        ).alias("e"),
        "predicate",
    ).select("e.*", "predicate")
    nodes = table(spark, sf_dir, "nodes").groupBy(plain_id("node_id").alias("node_id")).agg(F.count("*").alias("n_node_rows"))
    return skew.key_profiles(ends, nodes.filter("node_id is not null"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "edges").agg(F.count("*").alias("n_rows"))
    return _profiles(spark, sf_dir).join(F.broadcast(rows), F.col("n_edges") * HUB_SHARE >= F.col("n_rows")).select("field", "node_id")


def p2_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir)


_ENDS = f"""ends AS (SELECT unnest(['source', 'target']) AS field, unnest([s, t]) AS node_id, unnest([t, s]) AS other, predicate FROM
 (SELECT {plain_id_sql("source")} AS s, {plain_id_sql("target")} AS t, {term_sql("predicate", "lower")} AS predicate FROM edges))"""

P2_PROFILES = f"""WITH {_ENDS}, n AS (SELECT {plain_id_sql("node_id")} AS node_id, count(*) AS n_node_rows FROM nodes GROUP BY 1)
SELECT e.field, e.node_id, count(*) AS n_edges, count(DISTINCT other) AS n_neighbours, count(DISTINCT predicate) AS n_predicates,
 coalesce(any_value(n.n_node_rows), 0)::BIGINT AS n_node_rows
FROM ends e LEFT JOIN n ON e.node_id = n.node_id WHERE e.node_id IS NOT NULL GROUP BY 1, 2"""

P2_FOUND = f"""WITH {_ENDS} SELECT field, node_id FROM ends WHERE node_id IS NOT NULL GROUP BY 1, 2
HAVING count(*) * {HUB_SHARE} >= (SELECT count(*) FROM edges)"""


# --- problem 5: rows that fail to parse ------------------------------------------------------------------------------


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(rejects.parse_lines(table(spark, sf_dir, "raw_export_lines")))


def p5_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.valid(rejects.parse_lines(table(spark, sf_dir, "raw_export_lines")), "nodes")


def p5_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.valid(rejects.parse_lines(table(spark, sf_dir, "raw_export_lines")), "edges")


def _p5_sql() -> tuple[str, str, str]:
    white = " || ".join(f"chr({ord(x)})" for x in rejects.SPACE)
    body = f"ltrim(coalesce(line, ''), {white} || chr({ord(rejects.MARK)}))"
    heads = " OR ".join(
        f"(layout = '{k}' AND regexp_full_match(body, '" + ",".join(rf'{rejects.WS}(?:{c}|"{rejects.WS}{c}{rejects.WS}"){rejects.WS}' for c in v) + "'))"
        for k, v in rejects.LAYOUTS.items()
    )
    piece = rf"(?:{rejects.WS}{rejects.QUOTED}{rejects.WS}|[^\",]*),".replace('\\"', '"')
    unquoted = f"trim(replace(CASE WHEN trim(x, {white}) LIKE '\"%' THEN trim(x, {white})[2:-2] ELSE x END, '\"\"', '\"'), {white})"
    lines = f"""WITH l AS (SELECT line_id, layout, {body} AS body FROM raw_export_lines), f AS (SELECT *,
 trim(body, {white}) = '' OR regexp_matches(body, '{rejects.MESSAGES}') OR {heads} AS noise,
 NOT regexp_full_match(body, '(?s){rejects.GOOD_QUOTES[1:-2]}') AS quoting,
 list_transform(list_transform(regexp_extract_all(body || ',', '{piece}'), lambda x: x[1:-2]), lambda x: {unquoted}) AS v FROM l),
c AS (SELECT *, CASE WHEN noise THEN 'noise' WHEN quoting THEN 'quoting' WHEN len(v) <> CASE layout WHEN 'nodes' THEN 4 ELSE 5 END THEN 'columns'
 WHEN len(list_filter(v, lambda x: regexp_matches(x, '{rejects.CONTROL}'))) > 0 THEN 'value'
 WHEN layout = 'nodes' AND (v[1] = '' OR lower(v[2]) NOT IN ('concept', 'code')) THEN 'value'
 WHEN layout = 'edges' AND (v[1] = '' OR v[2] = '' OR NOT regexp_full_match(v[3], '[a-z][a-z0-9_]*') OR (v[5] <> '' AND NOT
  (regexp_matches(v[5], '{rejects.NUMBER}') AND coalesce(try_cast(v[5] AS DOUBLE), 2) <= 1))) THEN 'value' END AS reason FROM f) """
    return (
        lines + "SELECT line_id, reason FROM c WHERE reason IS NOT NULL",
        lines + "SELECT line_id, v[1] AS node_id, v[2] AS label, v[3] AS name, v[4] AS sab FROM c WHERE reason IS NULL AND layout = 'nodes'",
        lines + "SELECT line_id, v[1] AS source, v[2] AS target, v[3] AS predicate, v[4] AS sab, try_cast(v[5] AS DOUBLE) AS confidence FROM c WHERE reason IS NULL AND layout = 'edges'",
    )


P5_FOUND, P5_NODES, P5_EDGES = _p5_sql()


# --- problem 6: references to records that do not exist --------------------------------------------------------------


def _composite(ident) -> list:
    """Namespace (null for a bare concept id) and local part of a plain id."""
    at = F.instr(ident, ":")
    return [F.when(at > 0, F.substring_index(ident, ":", 1)).alias("ns"), F.when(at > 0, F.substring(ident, at + 1, F.length(ident))).otherwise(ident).alias("local")]


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = None
    for tbl in ("edges", "pathway_membership_edges"):
        edges = table(spark, sf_dir, tbl).select("row_id", "exported_at", plain_id("source").alias("s"), plain_id("target").alias("t"))
        part = edges.select(
            F.lit(tbl).alias("tbl"),
            "row_id",
            "exported_at",
            F.explode(F.array(F.struct(F.lit("source").alias("field"), F.col("s").alias("id")), F.struct(F.lit("target").alias("field"), F.col("t").alias("id")))).alias("e"),
        ).select("tbl", "row_id", "e.field", "exported_at", "e.id")
        refs = part if refs is None else refs.unionByName(part)
    refs = refs.filter("id is not null").select("tbl", "row_id", "field", F.col("exported_at").alias("at"), *_composite(F.col("id")))
    nodes = table(spark, sf_dir, "nodes").select(plain_id("node_id").alias("id"), "exported_at", "deleted_at")
    always = table(spark, sf_dir, "reference_concepts").select(plain_id("node_id").alias("id"), F.lit(orphans.FIRST).cast("timestamp").alias("exported_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    targets = nodes.select("id", F.col("exported_at").cast("timestamp"), F.col("deleted_at").cast("timestamp")).unionByName(always)
    targets = targets.filter("id is not null").select(*_composite(F.col("id")), "exported_at", "deleted_at")
    refs = refs.withColumn("at", F.col("at").cast("timestamp"))
    return orphans.orphan_references(refs, targets, ["ns", "local"], "exact", "at", "exported_at", "deleted_at")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("tbl", "row_id", "field", "kind", F.date_format("at", "yyyy-MM").alias("period"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, sf_dir), "at", ["tbl", "field"])


_P6 = f"""WITH refs AS (
 SELECT 'edges' AS tbl, row_id, unnest(['source', 'target']) AS field, unnest([{plain_id_sql("source")}, {plain_id_sql("target")}]) AS id, exported_at AS t FROM edges UNION ALL
 SELECT 'pathway_membership_edges', row_id, unnest(['source', 'target']), unnest([{plain_id_sql("source")}, {plain_id_sql("target")}]), exported_at FROM pathway_membership_edges),
n AS (SELECT {plain_id_sql("node_id")} AS id, exported_at AS a, deleted_at AS b FROM nodes),
r AS (SELECT refs.*, n.a, (n.a <= t AND (n.b IS NULL OR n.b > t)) AS ok FROM refs LEFT JOIN n ON refs.id = n.id
 WHERE refs.id IS NOT NULL AND refs.id NOT IN (SELECT {plain_id_sql("node_id")} FROM reference_concepts)),
o AS (SELECT tbl, row_id, field, CASE WHEN min(a) IS NULL THEN 'missing' WHEN min(a) > any_value(t) THEN 'late' ELSE 'deleted' END AS kind,
 strftime(any_value(t), '%Y-%m') AS period FROM r GROUP BY 1, 2, 3 HAVING NOT coalesce(bool_or(ok), false)) """
P6_FOUND = _P6 + "SELECT * FROM o"
P6_REPORT = _P6 + "SELECT tbl, field, kind, period, count(*) AS n FROM o GROUP BY ALL"

QUERIES = {"p2_found": p2_found, "p2_profiles": p2_profiles, "p5_found": p5_found, "p5_nodes": p5_nodes, "p5_edges": p5_edges, "p6_found": p6_found, "p6_report": p6_report}
SQL = {"p2_found": P2_FOUND, "p2_profiles": P2_PROFILES, "p5_found": P5_FOUND, "p5_nodes": P5_NODES, "p5_edges": P5_EDGES, "p6_found": P6_FOUND, "p6_report": P6_REPORT}
