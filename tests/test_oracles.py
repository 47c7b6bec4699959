"""Every query of the core against its SQL on the smallest tables, and the driver's contract."""

import glob
import importlib
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from loomgraph.plans import problems, reference  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SQL = problems.SQL | reference.SQL
QUERIES = problems.QUERIES | reference.QUERIES


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.fixture(scope="module")
def shared(spark):
    """One graph for all queries, so that what they have in common is computed once."""
    return reference.Graph(spark, DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, shared, name):
    df = reference.ON_GRAPH[name](shared) if name in reference.ON_GRAPH else QUERIES[name](spark, DATA)
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(spark, shared, name):
    df = reference.ON_GRAPH[name](shared) if name in reference.ON_GRAPH else QUERIES[name](spark, DATA)
    assert df.count() > 0


def test_nulls_are_probabilities(spark, shared):
    for name in ("n2_seed_permutation_null", "n7_member_mean_null"):
        rows = reference.ON_GRAPH[name](shared).collect()
        assert all(0 <= r["null"] <= 1e6 for r in rows)  # millionths
        assert len({r["perm"] for r in rows}) == reference.PERMUTATIONS


def test_contract(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
