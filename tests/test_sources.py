import gzip
import hashlib
import json

from pyspark.sql import functions as F

from loomgraph.sources import files
from loomgraph.streaming import edges as streaming


def test_text_table(spark, tmp_path):
    text = '﻿node_id,label,name\nC1,Concept,"a, ""b"""\nC2,,\n'
    (tmp_path / "t.csv").write_text(text, encoding="utf-8")
    with gzip.open(tmp_path / "t.csv.gz", "wt", encoding="utf-8") as f:
        f.write(text)
    for name in ("t.csv", "t.csv.gz"):
        df = files.read_text_table(spark, str(tmp_path / name))
        assert df.columns == ["node_id", "label", "name"]
        assert sorted(map(tuple, df.collect())) == [("C1", "Concept", 'a, "b"'), ("C2", "", "")]
    typed = files.read_typed_table(spark, str(tmp_path / "t.csv"), "node_id string, label string, name string")
    assert typed.count() == 2


def test_lists(spark, tmp_path):
    f = tmp_path / "ids.txt"
    f.write_text("# seeds\nC1 first\n\nC2 # note\n  C3\n")
    assert [r[0] for r in files.read_id_list(spark, str(f)).collect()] == ["C1", "C2", "C3"]
    f.write_text("# genes\nA\t5\nB\nC\tx\nD\t9\n")
    genes = files.read_gene_list(spark, str(f))
    assert [tuple(r) for r in genes.collect()] == [("A", 5), ("B", None), ("C", None), ("D", 9)]
    assert [r["symbol"] for r in files.at_least(genes, 6).collect()] == ["B", "C", "D"]
    assert [r["symbol"] for r in files.at_least(genes, top=2).collect()] == ["D", "A"]


def test_index_and_ontology(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"a": 0, "b": 1}))
    assert {tuple(r) for r in files.read_node_index(spark, str(tmp_path / "i.json")).collect()} == {("a", 0), ("b", 1)}
    obo = "format: 1\n\n[Term]\nid: GO:1\nname: x\nnamespace: biological_process\n\n[Term]\nid: GO:2\nname: big Complex\nnamespace: cellular_component\n\n[Term]\nid: GO:3\nname: y\nnamespace: cellular_component\n\n[Typedef]\nid: z\nnamespace: biological_process\n\n"
    (tmp_path / "go.obo").write_text(obo)
    assert {tuple(r) for r in files.read_ontology(spark, str(tmp_path / "go.obo")).collect()} == {("GO:1", "bp"), ("GO:2", "complex"), ("GO:3", "cc")}


def test_merge_and_clean(spark):
    a = spark.createDataFrame([("1", "x")], "source string, predicate string")
    b = spark.createDataFrame([("1", "x"), ("2", "y")], "src string, predicate string").withColumn("extra", F.lit(1))
    out = files.merged(a, b, aliases={"src": "source"})
    assert out.count() == 3 and set(out.columns) == {"source", "predicate", "extra"}
    lines = spark.createDataFrame([(1, "edges", "a,b,is_a,s,1"), (2, "edges", "WARNING x"), (3, "nodes", "a,Code,b,c")], "line_id long, layout string, line string")
    assert [r["line_id"] for r in files.clean_export(lines, "edges").collect()] == [1]


def test_report_and_manifest(spark, tmp_path):
    out = str(tmp_path / "report")
    files.write_report(spark.range(3).withColumn("x", F.lit("a")), out, [F.desc("id")])
    parts = list((tmp_path / "report").glob("part-*.csv"))
    assert len(parts) == 1 and parts[0].read_text().split() == ["id", "x", "2", "a", "1", "a", "0", "a"]
    folder = tmp_path / "run"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_bytes(b"abc")
    (folder / "sub" / "b.bin").write_bytes(b"")
    got = {r["path"]: (r["size"], r["sha256"]) for r in files.manifest(spark, str(folder)).collect()}
    assert got == {"a.txt": (3, hashlib.sha256(b"abc").hexdigest()), "sub/b.bin": (0, hashlib.sha256(b"").hexdigest())}


def test_streams(spark, tmp_path):
    rows = [(1, "c1 cui", "GO:1", "Is_A", "2024-01-01 10:00:00"), (1, "c1 cui", "GO:1", "Is_A", "2024-01-01 10:00:00"), (2, "C2", "GO:2", "is_a", "2024-01-02 10:00:00")]
    df = spark.createDataFrame(rows, "row_id long, source string, target string, predicate string, loaded_at string").withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["row_id"], r["source"], r["predicate"]) for r in got.collect()) == [(1, "C1", "is_a"), (2, "C2", "is_a")]
    q = streaming.arrivals(stream).writeStream.outputMode("complete").format("memory").queryName("arrivals").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["n"] for r in spark.sql("SELECT * FROM arrivals").collect()) == 3


def test_ontology_with_windows_line_ends(spark, tmp_path):
    text = "format-version: 1.2\n\n[Term]\nid: GO:1\nname: a complex\nnamespace: cellular_component\n\n[Term]\nid: GO:2\nname: x\nnamespace: molecular_function\n\n[Typedef]\nid: part_of\nnamespace: external\n"
    for i, end in enumerate(("\n", "\r\n")):
        path = tmp_path / f"{i}.obo"
        path.write_bytes(text.replace("\n", end).encode())
        assert {(r["accession"], r["namespace"]) for r in files.read_ontology(spark, str(path)).collect()} == {("GO:1", "complex"), ("GO:2", "mf")}


def test_text_tables_survive_writing(spark, tmp_path):
    rows = [(' a, "b" ', "line\nend", "é\t"), ("", None, "\\"), ("#x", " ", "'")]
    df = spark.createDataFrame(rows, "x string, y string, z string")
    for gzip in (False, True):
        files.write_text_table(df, str(tmp_path / str(gzip)), gzip=gzip)
        got = files.read_text_table(spark, str(tmp_path / str(gzip)), ",", multiline=True)
        assert sorted(map(tuple, got.collect())) == sorted(tuple(v or "" for v in r) for r in rows)


def test_staged_tables_are_deleted_with_their_block(spark):
    import os

    from loomgraph import session

    with session.stages(spark):
        inner = session.stage(spark.range(3).toDF("a"), "inner")
        path = inner.inputFiles()[0].removeprefix("file://")
        assert inner.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)
