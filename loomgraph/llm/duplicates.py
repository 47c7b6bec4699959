"""Duplicates hidden by formatting: columns are dictionary-encoded on their canonical values, and compact tuples grouped.

Every distinct value of a column is canonicalised once and gets an integer shared by all its spellings. Records become
sorted tuples of field-value integers, and equal tuples are copies. In a table (``copies``) a field's integers follow those
of the fields before it, so a sorted tuple has its fields in one order; each integer is stored less its field's first,
and small ones are packed bit by bit into common integers. Records given as cells (``copies_of_cells``), whose fields come in
any order, are sorted as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import BROADCAST_BYTES, numbered, stage

#: A spelling in more than one row of so many is looked up by broadcast (fewer than that many spellings a column).
HOT = 1000
#: Small fields share an integer up to so many bits.
PACKED_BITS = 62


def _dictionary(rows: DataFrame, columns: dict[str, str], canon: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(kind, raw, id, n): every spelling of every kind with the integer of its canonical value; spellings whose
    canonical value is null are left out."""
    cells = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("raw")) for c, kind in columns.items()))
    spellings = rows.select(F.explode(cells).alias("c")).select("c.*").filter("raw is not null").groupBy("kind", "raw").agg(F.count("*").alias("n"))
    value = F.lit(None).cast("string")
    for kind, rule in canon.items():
        value = F.when(F.col("kind") == kind, rule(F.col("raw"))).otherwise(value)
    spellings = stage(spellings.withColumn("value", value).filter("value is not null"), "spellings")
    # in the order of their kind, so a kind's integers are consecutive
    names = numbered(spellings.select("kind", "value").distinct().sort("kind", "value"), "id", "values")
    return stage(spellings.join(names, ["kind", "value"]).select("kind", "raw", "id", "n"), "dictionary")


def _encode(rows: DataFrame, column: str, entries: DataFrame, n_rows: int, small: bool, row_id: str) -> DataFrame:
    entries = entries.select(F.col("raw").alias("_raw"), F.col("id").alias("_id"), "n")
    if small:
        return rows.join(F.broadcast(entries.drop("n")), F.col(column) == F.col("_raw"), "left").drop("_raw", column).withColumnRenamed("_id", column)
    limit = n_rows // HOT + 1
    hot = entries.filter(F.col("n") > limit).select(F.col("_raw").alias("_hot"), F.col("_id").alias("_hot_id"))
    rows = rows.join(F.broadcast(hot), F.col(column) == F.col("_hot"), "left")
    # rows that are done, or have nothing to look up, are spread evenly instead of meeting under one key
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64(row_id), F.lit(4096)).cast("string"))
    rows = rows.withColumn(column, F.when(F.col("_hot").isNull() & F.col(column).isNotNull(), F.col(column)).otherwise(spread))
    cold = entries.filter(F.col("n") <= limit).drop("n")
    rows = rows.join(cold, F.col(column) == F.col("_raw"), "left")
    return rows.withColumn(column, F.coalesce("_hot_id", "_id")).drop("_raw", "_id", "_hot", "_hot_id")


def encode_records(rows: DataFrame, row_id: str, columns: dict[str, str], canon: dict[str, Callable[[Column], Column]], required: list[str]) -> tuple[DataFrame, list[str]]:
    """(row_id, whole, record columns) and the names of the record columns: each row as a tuple of integers.

    ``columns`` says the kind of value of each column; columns of one kind share integers. ``canon`` has each kind's
    canonical form as a column rule. ``whole`` says whether all ``required`` columns have a value.
    """
    rows = rows.select(F.col(row_id).alias("row_id"), *(F.col(c).cast("string").alias(c) for c in columns))
    dictionary = _dictionary(rows, columns, canon)
    sums = [F.sum(F.octet_length("raw") + 40).alias("bytes"), F.min("id").alias("first"), F.max("id").alias("last")]
    kinds = {r["kind"]: r for r in dictionary.groupBy("kind").agg(*sums).collect()}
    n_rows = rows.count()
    small = [c for c in columns if columns[c] not in kinds or kinds[columns[c]]["bytes"] <= BROADCAST_BYTES]
    record: list[str] = []
    packed, bits = F.lit(0).cast("long"), 0

    def flush(rows: DataFrame, packed: Column, bits: int) -> DataFrame:
        if bits:
            record.append(f"_p{len(record)}")
            rows = rows.withColumn(record[-1], packed).drop(*waiting)
            waiting.clear()
        return rows

    waiting: list[str] = []
    for c in [*(c for c in small if c not in required), *(c for c in columns if c in required or c not in small)]:
        kind = kinds.get(columns[c])
        first, last = (kind["first"], kind["last"]) if kind else (0, -1)
        entries = dictionary.filter(F.col("kind") == columns[c]).withColumn("id", F.col("id") - first + 1)
        if c in small and c not in required:
            width = (last - first + 1).bit_length()
            if bits + width > PACKED_BITS:
                rows, packed, bits = flush(rows, packed, bits), F.lit(0).cast("long"), 0
            rows = _encode(rows, c, entries, n_rows, True, "row_id")
            packed, bits = packed + F.shiftleft(F.coalesce(F.col(c), F.lit(0)), bits), bits + width
            waiting.append(c)
        else:
            rows, packed, bits = flush(rows, packed, bits), F.lit(0).cast("long"), 0
            rows = _encode(rows, c, entries, n_rows, c in small, "row_id")
            record.append(c)
    rows = flush(rows, packed, bits)
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull()
    return rows.select("row_id", whole.alias("whole"), *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in record)), record


def copies(
    rows: DataFrame, row_id: str, columns: dict[str, str], canon: dict[str, Callable[[Column], Column]], required: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Duplicates of ``rows`` as (row_id, first_row_id), and records as (first_row_id, copies).

    Rows are copies when all ``columns`` agree in their canonical forms; null equals null only, and so does a value
    whose canonical form is null. Rows where one of ``required`` has no canonical value are never copies: each is a
    record of its own. Of equal records the smallest row_id comes first. ``row_id`` must be unique; other columns are
    ignored; an empty table gives empty results.
    """
    encoded, record = encode_records(rows, row_id, columns, canon, required or [])
    encoded = stage(encoded, "records")
    groups, found = _grouped(encoded.filter("whole").select("row_id", *record), record)
    alone = encoded.filter("NOT whole").select(F.col("row_id").alias("first_row_id"), F.lit(1).cast("long").alias("copies"))
    return found, groups.select("first_row_id", "copies").unionByName(alone)


def _grouped(encoded: DataFrame, record: list[str]) -> tuple[DataFrame, DataFrame]:
    """(record, first_row_id, copies) of all records, and (row_id, first_row_id) of the copies.

    Copies are counted before the shuffle: a record that is most of the table is one row of each task. Rows of the few
    records with many copies are found by broadcast where they are; the other records have few rows each, so none is hot.
    """
    groups = stage(encoded.groupBy(*record).agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("copies")), "groups")
    limit = (groups.agg(F.sum("copies").alias("n")).first()["n"] or 0) // HOT + 1
    repeated = groups.filter("copies > 1")
    hot = repeated.filter(F.col("copies") > limit).select(*record, "first_row_id")  # fewer than HOT
    cold = repeated.filter(F.col("copies") <= limit).select(*record, "first_row_id")
    # rows of hot records do not travel; those without a copy meet no row of ``cold``
    rest = encoded.join(F.broadcast(hot.drop("first_row_id")), record, "left_anti")
    found = encoded.join(F.broadcast(hot), record).select("row_id", "first_row_id").unionByName(rest.join(cold, record).select("row_id", "first_row_id"))
    return groups, found.filter("row_id <> first_row_id")


def copies_of_cells(cells: DataFrame, row_id: str, field: str, value: str, canon: dict[str, Callable[[Column], Column]]) -> tuple[DataFrame, DataFrame]:
    """The same for records whose fields come in any order: ``cells`` has a row per record, field and value.

    A field without a rule in ``canon`` is compared as it stands. A field whose canonical value is null, and a null field, do
    not count; equal cells of a record count once, different values of one field each. A record without cells is none; one
    whose cells are all null is a record of its own. Other columns are ignored.
    """
    rows = cells.select(F.col(row_id).alias("row_id"), F.col(field).cast("string").alias("field"), F.col(value).cast("string").alias("raw"))
    given = rows.filter("field is not null and raw is not null")
    spellings = given.groupBy("field", "raw").agg(F.count("*").alias("n"))
    canonical = F.col("raw")
    for name, rule in canon.items():
        canonical = F.when(F.col("field") == name, rule(F.col("raw"))).otherwise(canonical)
    spellings = stage(spellings.withColumn("value", canonical), "spellings")
    names = numbered(spellings.filter("value is not null").select("field", "value").distinct(), "id", "values")
    entries = stage(spellings.join(names, ["field", "value"], "left").select("field", "raw", "id", "n"), "dictionary")
    limit = (entries.agg(F.sum("n").alias("n")).first()["n"] or 0) // HOT + 1
    hot, cold = F.broadcast(entries.filter(F.col("n") > limit).drop("n")), entries.filter(F.col("n") <= limit).drop("n")
    coded = given.join(hot, ["field", "raw"]).unionByName(given.join(hot, ["field", "raw"], "left_anti").join(cold, ["field", "raw"])).select("row_id", "id")
    coded = coded.unionByName(rows.filter("field is null or raw is null").select("row_id", F.lit(None).cast("long").alias("id")))
    # a record's cells add up to its sorted tuple, which has as many integers as the record has fields
    tuples = coded.groupBy("row_id").agg(F.array_sort(F.collect_set("id")).alias("_tuple"))
    tuples = stage(tuples, "records")
    groups, found = _grouped(tuples.filter(F.size("_tuple") > 0), ["_tuple"])
    alone = tuples.filter(F.size("_tuple") == 0).select(F.col("row_id").alias("first_row_id"), F.lit(1).cast("long").alias("copies"))
    return found, groups.select("first_row_id", "copies").unionByName(alone)
