import pyarrow as pa
import pytest

from loomgraph.operators import rejects
from loomgraph.operators.rejects import parse_lines

NODES = [
    ("C1,Concept,a name,HGNC", None),
    ('"C1", "concept" , "a ""quoted"", name","HGNC"\r', None),
    ('C1,CODE,"two\nlines",', None),
    ("﻿C1,Code,x,y", None),
    ("C1,Code,back\\slash,y", None),
    (None, "noise"),
    ("", "noise"),
    (" \t ", "noise"),
    ("node_id, label, name, sab", "noise"),
    ('﻿"node_id","label","name","sab"', "noise"),
    ("  WARNING: slow, very", "noise"),
    ('Failed: "timeout', "noise"),
    ("java.io.IOException: x", "noise"),
    ("source,target,predicate,sab,confidence", "columns"),
    ('GO:" 1,Concept,a,b', "quoting"),
    ('C1,Concept,"open,b', "quoting"),
    ('C1,Concept,"a" b,c', "quoting"),
    ('C1,Concept,a"b,c', "quoting"),
    ("C1,Concept,a", "columns"),
    ("C1,Concept,a,b,", "columns"),
    ("C1\tConcept\ta\tb", "columns"),
    (",Concept,a,b", "value"),
    ('" ",Concept,a,b', "value"),
    ("C1,Kode,a,b", "value"),
    ("C1,,a,b", "value"),
    ("C1,Concept,a\x00,b", "value"),
    ("C1,Concept,a,b\x1f", "value"),
    ("C1,Concept,a�,b", "value"),
    ("C1,Concept,tab\there,b", None),
    ('C1,Concept,bare\nbreak,"b"', None),
    ("C1,Concept,bare\nbreak,b", None),
]
EDGES = [
    ("a,b,is_a,s,0.5", None),
    ('"a","b","is_a","s",""', None),
    ("a,b,is_a,,1e-3", None),
    ("a,b,is_a,s,1", None),
    ("a,b,is_a,s,1.0001", "value"),
    ("a,b,is_a,s,-0.2", "value"),
    ("a,b,is_a,s,+0.2", "value"),
    ("a,b,is_a,s,NaN", "value"),
    ("a,b,is_a,s,0x1", "value"),
    ("a,b,is_a,s,1d", "value"),
    ("a,b,Is_a,s,1", "value"),
    ("a,b,9x,s,1", "value"),
    ("a,b,,s,1", "value"),
    (",b,is_a,s,1", "value"),
    ("a,b,is_a,s,1,", "columns"),
    ("a,b,régule,s,1", "value"),
]


@pytest.mark.parametrize(("layout", "cases"), [("nodes", NODES), ("edges", EDGES)])
def test_reasons(spark, layout, cases):
    df = spark.createDataFrame([(i, layout, line, 1) for i, (line, _) in enumerate(cases)], "line_id long, layout string, line string, reason int")
    got = {r["line_id"]: r["reason"] for r in parse_lines(df).collect()}
    assert {i: got[i] for i in got} == {i: want for i, (_, want) in enumerate(cases)}


def test_fields_are_typed_and_unquoted(spark):
    lines = [(1, "nodes", '"C1", "concept" , "a ""quoted"", name","HGNC"\r'), (2, "edges", ' a ,"b",is_a,, 5e-1 '), (3, "edges", "a,b,is_a,s,")]
    rows = {r["line_id"]: r for r in parse_lines(spark.createDataFrame(lines, "line_id long, layout string, line string")).collect()}
    assert (rows[1]["node_id"], rows[1]["label"], rows[1]["name"], rows[1]["sab"]) == ("C1", "concept", 'a "quoted", name', "HGNC")
    assert (rows[2]["source"], rows[2]["target"], rows[2]["sab"], rows[2]["confidence"]) == ("a", "b", "", 0.5)
    assert rows[3]["confidence"] is None and rows[3]["reason"] is None


def test_unknown_layouts_repeats_and_empty_tables(spark):
    lines = [(1, None, "a,b"), (2, "other", ""), (3, "other", 'a"'), (4, "nodes", "x"), (4, "nodes", "x"), (None, "nodes", "x")]
    schema = "line_id long, layout string, line string"
    got = sorted(((r["line_id"] or 0), r["reason"]) for r in parse_lines(spark.createDataFrame(lines, schema)).collect())
    assert got == [(0, "columns"), (1, "columns"), (2, "noise"), (3, "quoting"), (4, "columns"), (4, "columns")]
    assert parse_lines(spark.createDataFrame([], schema)).count() == 0


def test_a_very_long_line(spark):
    line = 'C1,Concept,"' + "x, " * 400_000 + '",HGNC'
    row = parse_lines(spark.createDataFrame([(1, "nodes", line)], "line_id long, layout string, line string")).first()
    assert row["reason"] is None and len(row["name"]) == 1_199_999


@pytest.mark.parametrize("batch", [7, 100, 10_000])
def test_a_reason_does_not_depend_on_the_batch(batch):
    """Lines with a NUL among thousands of quoted ones, whatever the batch."""
    cases = [(f'"C{i}", "Concept","name ""{i}""",HGNC', None) for i in range(2000)]
    for i in range(50, 2000, 500):
        cases[i] = (f'"C{i}\0",Concept,"a, b",HGNC', "value")
        cases[i + 1] = (f'C{i},Concept,"a"', "columns")
    table = pa.table({"line_id": range(len(cases)), "layout": ["nodes"] * len(cases), "line": [line for line, _ in cases]})
    got = {}
    for out in rejects._split(iter(table.to_batches(max_chunksize=batch))):
        got.update(zip(out["line_id"].to_pylist(), out["reason"].to_pylist(), strict=True))
    assert got == {i: want for i, (_, want) in enumerate(cases)}
