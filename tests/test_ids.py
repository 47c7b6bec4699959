import pytest
from pyspark.sql import functions as F

from loomgraph.functions.ids import plain_id, term

CASES = {
    "C30000000": "C30000000",
    " c30000000 CUI ": "C30000000",
    "M30000000 [MSIGDB]": "MSIGDB:M30000000",
    "msigdb/m30000000": "MSIGDB:M30000000",
    "MSIGDB : M30000000 cui cui": "MSIGDB:M30000000",
    "R-HSA-2440 (REACTOME)": "REACTOME:R-HSA-2440",
    "reactome:r-hsa-2440;": "REACTOME:R-HSA-2440",
    "GO：00123": "GO:00123",
    "﻿GO:00123\r\n": "GO:00123",
    "C30000000\n": "C30000000",
    "C00105356X": "C00105356X",
    "CUI": "CUI",
    "12-34": "12-34",
    "-": None,
    "  ": None,
    "": None,
    None: None,
}


def test_plain_id(spark):
    rows = spark.createDataFrame([(k,) for k in CASES], "id string").select("id", plain_id("id").alias("p")).collect()
    assert {r["id"]: r["p"] for r in rows} == CASES


def test_spellings_of_one_id_agree(spark):
    spellings = ["UNIPROTKB:Q00118976", "q00118976_uniprotkb", "'UNIPROTKB:Q00118976'", "UNIPROTKB - Q00118976", "UniProtKB|Q00118976 CUI"]
    rows = spark.createDataFrame([(k,) for k in spellings], "id string").select(plain_id("id").alias("p")).distinct().collect()
    assert [r["p"] for r in rows] == ["UNIPROTKB:Q00118976"]


@pytest.mark.parametrize(("raw", "case", "want"), [("\t Go \n", "upper", "GO"), ("Is_A ", "lower", "is_a"), ("  ", "lower", None), (None, "upper", None)])
def test_term(spark, raw, case, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(term(F.col("t"), case).alias("x")).first()["x"] == want
