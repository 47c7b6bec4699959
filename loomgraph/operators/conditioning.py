"""Conditioning: entity types of nodes, flow classes of edges, and the edges each analysis arm keeps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.running import running_sums
from loomgraph.functions.scalars import by_rules, edge_weight, first_non_empty
from loomgraph.session import broadcast_if_small

PROPAGATING = ["mechanistic", "weak_mechanistic_or_observational"]
OBSERVED = "Observational Association"
MOST_RULES = 10_000
# Words of compartments in GO names.
COMPARTMENTS = ["membrane", "nucleus", "cytoplasm", "cytosol", "mitochond", "extracellular", "organelle"]


@dataclass
class Rules:
    """Rule tables of a file a person writes. Those of up to ``MOST_RULES`` rows are marked for broadcast."""

    sabs: DataFrame
    id_rules: list[tuple[str, str]]
    priority: DataFrame
    non_flow: DataFrame
    observational: DataFrame
    flows: DataFrame
    overrides: DataFrame
    ignored: list[str]

    @classmethod
    def of(cls, spark: SparkSession, sabs: dict, id_rules: list, priority: list, non_flow: list, observational: list, flows: list, overrides: list, ignored: list | None = None) -> Rules:
        def make(rows: list, schema: str) -> DataFrame:
            df = spark.createDataFrame(rows, schema)
            return F.broadcast(df) if len(rows) <= MOST_RULES else df

        others = sorted(({*sabs.values(), "G", "RNA", "P", "PW", "CM", "S"} | {e for _, e in id_rules}) - set(priority))
        return cls(
            make(list(sabs.items()), "sab string, entity string"),
            id_rules,
            make([(e, i) for i, e in enumerate([*priority, *others])], "entity string, prio int"),
            make([(p,) for p in non_flow], "predicate string"),
            make([(p,) for p in observational], "predicate string"),
            make(flows, "predicate string, flow string, class string"),
            make(overrides, "predicate string, source_entity string, target_entity string, flow string, class string"),
            ignored or [],
        )


def load_rules(spark: SparkSession, path: str) -> Rules:
    """Rule tables from a YAML file with sections node_resolution and edge_resolution."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f)
    node, edge = data["node_resolution"], data["edge_resolution"]
    ignored = node.get("ignored_or_auxiliary_sabs") or []
    flat = [s for x in (ignored.values() if isinstance(ignored, dict) else [ignored]) for s in x if isinstance(s, str)]
    names = lambda section: [x if isinstance(x, str) else x["predicate"] for x in edge.get(section) or []]
    flows = [(p, r.get("flow"), r.get("classification", "mechanistic")) for p, r in (edge.get("predicate_to_flow") or {}).items()]
    overrides = [(r["predicate"], r["source_entity"], r["target_entity"], r.get("flow"), r.get("classification", "mechanistic")) for r in edge.get("entity_pair_overrides") or []]
    id_rules = [(r["pattern"], r["entity"]) for r in node.get("codeid_regex_to_entity") or []]
    return Rules.of(spark, node.get("sab_to_entity") or {}, id_rules, node.get("priority_order") or [], names("non_flow_edges"), names("observational_edges"), flows, overrides, flat)


def go_entity(namespace: Column, name: Column) -> Column:
    """Entity of a GO term by its namespace, else by words of its name; null where neither tells."""
    space, text = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (namespace, name))
    is_in = lambda *words: space.isin([w.replace(" ", "_") for w in words] + [f"go_{w.split()[-1]}" for w in words] + [w.split()[-1] for w in words]) | space.contains(words[0])
    cellular = F.when(text.contains("complex"), "CM").otherwise("S")
    by_space = F.when(is_in("cellular component") | (space == "cc"), cellular).when(space == "complex", "CM").when(is_in("biological process", "molecular function") | space.contains("molecular function") | space.isin("bp", "mf"), "PW")
    by_name = F.when(text.contains("complex"), "CM").when(text.rlike("|".join(COMPARTMENTS)), "S")
    return F.when(space != "", by_space).otherwise(by_name)


def row_entities(nodes: DataFrame, rules: Rules, ontology: DataFrame | None = None) -> DataFrame:
    """(node_id, entity) of every Concept or Code row, with its ``parent_id`` if ``nodes`` has one.

    An ignored vocabulary gives none. Terms of GO and GOCC, and codes GO:..., go by ``ontology`` (accession, namespace), else
    by the words of their name, else are pathways. ENSEMBL ids go by the prefix of their local part. Else the vocabulary
    decides, else the first id rule that matches.
    """
    rows = nodes.filter(F.lower("label").isin("concept", "code")).join(rules.sabs.withColumnRenamed("entity", "_e"), "sab", "left")
    local = F.element_at(F.split("node_id", ":"), -1)
    ensembl = F.when(local.startswith("ENSG"), "G").when(local.startswith("ENST"), "RNA").when(local.startswith("ENSP"), "P")
    go = F.coalesce(F.col("sab").isin("GO", "GOCC"), F.lit(False)) | ((F.lower("label") == "code") & F.col("node_id").startswith("GO:"))
    by_name = F.coalesce(go_entity(F.lit(None).cast("string"), F.col("name")), F.lit("PW"))
    if ontology is not None:
        spaces = ontology.select(F.col("accession").alias("node_id"), go_entity(F.col("namespace"), F.lit(None).cast("string")).alias("_go"))
        rows = rows.join(broadcast_if_small(spaces), "node_id", "left")
        by_name = F.coalesce("_go", by_name)
    entity = F.when(go, by_name).otherwise(F.coalesce(F.when(F.col("sab") == "ENSEMBL", ensembl), "_e", by_rules(F.col("node_id"), rules.id_rules)))
    if rules.ignored:
        entity = F.when(F.col("sab").isin(rules.ignored), F.lit(None).cast("string")).otherwise(entity)
    return rows.select(*(c for c in ("parent_id",) if c in nodes.columns), "node_id", entity.alias("entity"))


def node_entities(nodes: DataFrame, rules: Rules, ontology: DataFrame | None = None) -> DataFrame:
    """(node_id, entity): of several rows of an id, the entity of highest priority, those without one last and by name; null
    if no row has an entity.

    If ``nodes`` has a column ``parent_id``, only Code rows count, each for its parent concept; a code without a parent counts
    for none. Without that column a Concept or Code row counts for its own id.
    """
    if "parent_id" in nodes.columns:
        rows = row_entities(nodes.filter(F.lower("label") == "code"), rules, ontology).filter(first_non_empty(F.col("parent_id")).isNotNull()).select(F.col("parent_id").alias("node_id"), "entity")
    else:
        rows = row_entities(nodes, rules, ontology)
    rows = rows.join(rules.priority, "entity", "left")
    return rows.groupBy("node_id").agg(F.min("prio").alias("prio")).join(rules.priority, "prio", "left").select("node_id", "entity")


def coverage(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: concepts, resolved concepts and their share; null share for no concepts."""
    known = entities.agg(F.count("*").alias("concepts"), F.count("entity").alias("resolved"))
    return known.withColumn("coverage", F.when(F.col("concepts") > 0, F.col("resolved") / F.col("concepts")))


def concept_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose both ends are concepts, with their entities. An end that holds much of the edges is split by Spark's
    skew join; a null end matches nothing."""
    ends = {side: entities.select(F.col("node_id").alias(side), F.col("entity").alias(f"{side}_entity")) for side in ("source", "target")}
    return edges.join(ends["source"], "source").join(ends["target"], "target")


def resolve_flows(edges: DataFrame, rules: Rules) -> DataFrame:
    """flow_class and classification: non-flow predicates have none; then the observational list, then the override for
    the pair of entities, then the predicate's rule. drop_reason: unresolved end first, then non_flow, then unmapped."""
    e = edges.join(rules.non_flow.withColumn("_non", F.lit(True)), "predicate", "left")
    e = e.join(rules.observational.withColumn("_obs", F.lit(True)), "predicate", "left")
    over = rules.overrides.withColumnRenamed("flow", "_of").withColumnRenamed("class", "_oc")
    e = e.join(over, ["predicate", "source_entity", "target_entity"], "left")
    e = e.join(rules.flows.withColumnRenamed("flow", "_ff").withColumnRenamed("class", "_fc"), "predicate", "left")
    flow = F.when(F.col("_non"), None).when(F.col("_obs"), OBSERVED).otherwise(F.coalesce("_of", "_ff"))
    kind = F.when(F.col("_non"), None).when(F.col("_obs"), "observational").otherwise(F.coalesce("_oc", "_fc"))
    unresolved = F.col("source_entity").isNull() | F.col("target_entity").isNull()
    reason = F.when(unresolved, "unresolved").when(F.col("_non"), "non_flow").when(flow.isNull(), "unmapped")
    e = e.withColumn("flow_class", flow).withColumn("classification", kind).withColumn("drop_reason", reason)
    return e.drop("_non", "_obs", "_of", "_oc", "_ff", "_fc")


def condition_edges(edges: DataFrame, entities: DataFrame, rules: Rules) -> DataFrame:
    """All concept edges with flow, classification, drop_reason (null: kept) and propagating."""
    e = resolve_flows(concept_edges(edges, entities), rules)
    propagates = F.col("classification").isin(PROPAGATING) & F.col("drop_reason").isNull()
    return e.withColumn("propagating", F.coalesce(propagates, F.lit(False)))


def kept(conditioned: DataFrame) -> DataFrame:
    return conditioned.filter("drop_reason is null")


def funnel(conditioned: DataFrame) -> DataFrame:
    """Edges by outcome: kept ones by classification, dropped ones by reason, with their share of all concept edges."""
    outcome = F.coalesce(F.concat(F.lit("dropped: "), "drop_reason"), F.concat(F.lit("kept: "), "classification"))
    counts = conditioned.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(total)).select("outcome", "n", (F.col("n") / F.col("all")).alias("share"))


def metadata_filtered(edges: DataFrame, rules: Rules) -> DataFrame:
    """Edges without non-flow predicates; all of them propagate. A null predicate stays."""
    return edges.join(rules.non_flow, "predicate", "left_anti")


def mechanistic(kept_edges: DataFrame) -> DataFrame:
    return kept_edges.filter("classification = 'mechanistic'")


def sparsify(edges: DataFrame, n: int, key: list[str], seed: int = 1) -> DataFrame:
    """Exactly ``n`` edges by the order of a seeded hash of their key: a sample that any engine can repeat. Places come from
    sums over range partitions, so no task holds the sample."""
    order = [F.asc("_h"), *(F.asc(k) for k in key)]
    rows = edges.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key))))
    return running_sums(rows, order, {"_k": F.lit(1)}).filter(F.col("_k") <= n).drop("_h", "_k")


def weighted_operator(edges: DataFrame) -> DataFrame:
    """(src, dst, w): weights of parallel edges add up."""
    weight = edge_weight(F.col("confidence"), F.col("value"), F.col("evidence_type"))
    return edges.groupBy(F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.sum(weight).alias("w"))


def unit_operator(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.count("*").cast("double").alias("w"))


def row_normalized(operator: DataFrame) -> DataFrame:
    """(src, dst, p): weights as shares of their source. Sums are joined back rather than windowed, so a source with much of
    the edges is neither sorted nor held in one task."""
    sums = operator.groupBy("src").agg(F.sum("w").alias("_total")).filter("_total > 0")
    return operator.join(sums, "src").select("src", "dst", (F.col("w") / F.col("_total")).alias("p"))


def flow_distribution(kept_edges: DataFrame) -> DataFrame:
    return kept_edges.filter("propagating and flow_class <> ''").groupBy("flow_class").agg(F.count("*").alias("n"))
