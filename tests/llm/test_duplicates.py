import random
from collections import defaultdict

from pyspark.sql import functions as F

from loomgraph.llm import duplicates

FIELDS = {"a": "word", "b": "word", "v": "raw", "w": "raw2"}
CANON = {"word": lambda c: F.nullif(F.lower(F.trim(c)), F.lit("")), "raw": lambda c: c, "raw2": lambda c: c}
SCHEMA = "rid long, a string, b string, v string, w string, record string, copies int"


def brute(rows):
    groups, out = defaultdict(list), {}
    canon = lambda x: (x.strip(" ").lower() or None) if x is not None else None
    for rid, a, b, v, w, *_ in rows:
        if canon(a) is not None:
            groups[canon(a), canon(b), v, w].append(rid)
    for ids in groups.values():
        out |= {i: min(ids) for i in ids if i != min(ids)}
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    found, records = duplicates.copies(df, "rid", FIELDS, CANON, ["a"])
    got = {r["row_id"]: r["first_row_id"] for r in found.collect()}
    want = brute(rows)
    assert got == want
    recs = {r["first_row_id"]: r["copies"] for r in records.collect()}
    assert sum(recs.values()) == len(rows) and set(recs) == {r[0] for r in rows} - set(want)


def make(n):
    rnd = random.Random(5)
    word = lambda: rnd.choice([None, "", " x", "X", "y ", "Y", "z" * 5000, f"w{rnd.randrange(40)}"])
    rows = [(i, word(), word(), rnd.choice([None, "", "1", "2"]), rnd.choice([None, "q"]), "r", 1) for i in range(n)]
    return rows + [(n + i, "HOT", "hot ", "1", None, "r", 1) for i in range(n // 2)]


def test_small_dictionaries(spark):
    check(spark, make(1500))


def test_dictionaries_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(duplicates, "HOT", 20)
    check(spark, make(1500))


def test_fields_that_do_not_fit_one_integer(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "PACKED_BITS", 4)
    check(spark, make(600))


def test_empty_table(spark):
    check(spark, [])


def test_a_record_that_is_most_of_the_table_without_adaptive_plans(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "HOT", 20)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        check(spark, make(300))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_fields_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "HOT", 2)
    rnd = random.Random(9)
    records, cells = {}, []
    for i in range(300):
        fields = {"name": rnd.choice(["A ", "a", "b", " B"]), "n": rnd.choice(["1", "2"]), "note": rnd.choice([None, "x", "X"])}
        records[i] = frozenset((k, v.strip().lower() if k == "name" else v) for k, v in fields.items() if v is not None)
        cells += [(i, k, v, 0) for k, v in rnd.sample(sorted(fields.items()), 3)]
    cells += [(500, "note", None, 0), (501, None, "x", 0), (0, "n", dict(c[1:3] for c in cells[:3])["n"], 0)]
    df = spark.createDataFrame(cells, "rid long, f string, v string, id int")
    found, groups = duplicates.copies_of_cells(df, "rid", "f", "v", {"name": lambda c: F.lower(F.trim(c))})
    first = {}
    for i in sorted(records):
        first.setdefault(records[i], i)
    assert {r["row_id"]: r["first_row_id"] for r in found.collect()} == {i: first[r] for i, r in records.items() if first[r] != i}
    got = {r["first_row_id"]: r["copies"] for r in groups.collect()}
    assert got == {f: sum(r == x for x in records.values()) for r, f in first.items()} | {500: 1, 501: 1}
