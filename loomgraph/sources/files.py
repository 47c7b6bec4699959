"""Readers and writers of the files a graph export consists of."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.rejects import parse_lines


def read_text_table(spark: SparkSession, path: str, sep: str | None = None, multiline: bool = False) -> DataFrame:
    """CSV or TSV files (also gzip) with all columns as text, null as '', and no byte order mark in a column name.

    A plain file is split among tasks; with ``multiline``, for files whose quoted fields hold line ends, each is one task's.
    """
    sep = sep or ("\t" if ".tsv" in path or path.endswith(".txt") else ",")
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=multiline, inferSchema=False)
    df = df.toDF(*(c.lstrip(chr(0xFEFF)).strip() for c in df.columns))
    return df.fillna("")


def read_typed_table(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', schema=schema)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(node_id): first word of each line; comments from # on and blank lines are left out."""
    line = F.trim(F.regexp_replace("value", r"#.*\z", ""))
    return spark.read.text(path).select(F.split(line, r"\s+")[0].alias("node_id")).filter("node_id <> ''")


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, count): tab-separated, the count optional."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#"))
    return rows.select(F.trim(parts[0]).alias("symbol"), F.get(parts, F.lit(1)).try_cast("int").alias("count")).filter("symbol <> ''")


def at_least(genes: DataFrame, least: int | None = None, top: int | None = None) -> DataFrame:
    """Genes with a count of at least ``least`` (unknown counts stay), the ``top`` of them by count."""
    if least is not None:
        genes = genes.filter(F.col("count").isNull() | (F.col("count") >= least))
    return genes if top is None else genes.orderBy(F.desc_nulls_last("count"), "symbol").limit(top)


def read_node_index(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, position) of a JSON object {id: position}."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,int>").alias("m"))
    return rows.select(F.explode("m").alias("node_id", "position"))


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """(accession, namespace) of OBO stanzas; a cellular component whose name has 'complex' is a ``complex``."""
    # stanzas begin with a line [Term]; line ends of either kind
    stanza = spark.read.text(path, lineSep="[Term]").withColumn("value", F.regexp_replace(F.regexp_replace("value", r"\r\n?", "\n"), r"(?s)\n\[\w+\].*", ""))
    field = lambda k: F.regexp_extract("value", rf"(?m)^{k}: (.*?)\s*$", 1)
    short = F.create_map(*(F.lit(x) for kv in {"biological_process": "bp", "molecular_function": "mf", "cellular_component": "cc"}.items() for x in kv))
    space = F.try_element_at(short, field("namespace"))
    kind = F.when((space == "cc") & F.lower(field("name")).contains("complex"), "complex").otherwise(space)
    return stanza.select(field("id").alias("accession"), kind.alias("namespace")).filter("accession <> '' and namespace is not null")


def clean_export(lines: DataFrame, layout: str) -> DataFrame:
    """Rows of an export whose shell wrote messages between them: see ``operators.rejects``."""
    parsed = parse_lines(lines)
    return parsed.filter((F.col("layout") == layout) & F.col("reason").isNull())


def merged(*tables: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Union by name; columns under another name are renamed first, missing ones are null; rows are kept as they are."""
    renamed = [t.withColumnsRenamed({a: b for a, b in (aliases or {}).items() if a in t.columns}) for t in tables]
    out = renamed[0]
    for t in renamed[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_text_table(df: DataFrame, path: str, sep: str = ",", gzip: bool = False) -> None:
    """All rows as delimited files of quoted fields with a header, one a task; ``read_text_table`` gives the same texts back."""
    out = df.write.option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    out.option("compression", "gzip" if gzip else "none").csv(path, header=True, sep=sep, nullValue="", emptyValue="")


def write_report(df: DataFrame, path: str, order: list[Column] | None = None, sep: str = "\t") -> None:
    """One delimited file of a report; larger results go to ``df.write.parquet``."""
    rows = df.orderBy(*order) if order else df
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, sep=sep, nullValue="")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256) of all files below a folder, paths relative to it; files are hashed where they are read.
    Spark's reader passes over empty files, so those come from its list of files."""
    root = os.path.realpath(folder) if "://" not in folder else folder
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    local = F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "")
    hashed = files.select(local.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "path string").select(F.url_decode(local).alias("path"))
    empty = listed.join(hashed.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("size"), F.sha2(F.lit(b""), 256).alias("sha256"))
    start = len(root.rstrip("/")) + 2
    return hashed.unionByName(empty).withColumn("path", F.when(F.col("path").startswith(root), F.substring("path", start, 1 << 20)).otherwise(F.col("path")))
