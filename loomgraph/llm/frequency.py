"""Frequency of every distinct term: occurrences and records, counted in blocks of arrays over a global dictionary.

Distinct terms get dense integers; records are encoded; each task adds up count arrays for ranges of identifiers, and
arrays of the same range are summed. Only arrays and a record's distinct terms are shuffled, never single occurrences. Arrays
that are mostly zero travel as their places and counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import BROADCAST_BYTES, broadcast_if_small, estimated_bytes, numbered, stage

#: Identifiers of one array, and arrays a task holds before it passes them on; an array filled less than one in ``SPARSE`` goes
#: as places and counts.
WIDTH, HELD, SPARSE = 2048, 512, 4
#: A term in more than one row of so many is looked up by broadcast (fewer than that many terms).
HOT = 1000
ARRAYS = "field string, r long, at array<short>, occ array<long>, rec array<long>"
SCHEMA = pa.schema([("field", pa.string()), ("r", pa.int64()), ("at", pa.list_(pa.int16())), ("occ", pa.list_(pa.int64())), ("rec", pa.list_(pa.int64()))])


def _emit(held: dict[tuple[str, int], np.ndarray], width: int) -> pa.RecordBatch:
    keys, places, counts = list(held), [], []
    for k in keys:
        at = np.flatnonzero(held[k][0])
        dense = len(at) * SPARSE >= width
        places.append(None if dense else at.astype(np.int16))
        counts.append(held[k] if dense else held[k][:, at])
    columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(places, pa.list_(pa.int16()))]
    columns += [pa.array([c[i] for c in counts], pa.list_(pa.int64())) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, schema=SCHEMA)


def _count_blocks(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[pa.RecordBatch]:
    """(field, id, occ, in_record) rows into one array per range met in the task, ``most`` arrays at once."""
    held: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        field = batch.column(0).dictionary_encode()
        names, which = field.dictionary.to_pylist(), field.indices.to_numpy().astype(np.int64)
        ids, occ, rec = (batch.column(i).to_numpy() for i in (1, 2, 3))
        part = which * (1 << 40) + ids // width
        order = np.argsort(part, kind="stable")
        starts = np.flatnonzero(np.diff(part[order], prepend=-1))
        for rows in np.split(order, starts[1:]) if len(order) else []:
            p = part[rows[0]]
            key = (names[p >> 40], int(p & ((1 << 40) - 1)))
            if key not in held:
                if len(held) >= most:
                    yield _emit(held, width)
                    held = {}
                held[key] = np.zeros((2, width), np.int64)
            np.add.at(held[key][0], ids[rows] % width, occ[rows])
            np.add.at(held[key][1], ids[rows] % width, rec[rows])
    if held:
        yield _emit(held, width)


def _sum_ranges(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Arrays in the order of their range, added up range by range."""
    now, total = None, np.zeros((2, width), np.int64)
    for batch in batches:
        for field, r, at, occ, rec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(batch.column(i) for i in (2, 3, 4)), strict=True):
            if now != (field, r):
                if now is not None:
                    yield _emit({now: total}, width)
                now, total = (field, r), np.zeros((2, width), np.int64)
            total[:, at.values.to_numpy() if at.is_valid else slice(None)] += np.stack([occ.values.to_numpy(), rec.values.to_numpy()])
    if now is not None:
        yield _emit({now: total}, width)


def term_frequencies(rows: DataFrame, rare: int, common: float) -> DataFrame:
    """(field, term, occurrences, records, all_records, mark) for every term of ``rows`` (field, record, term).

    ``record`` identifies a row's record within its field (any type); a row with a null record counts as an occurrence
    but adds no record; a null term is no term, its record counts in all_records. ``mark`` is ``rare`` for terms in 1 to
    ``rare`` records, ``common`` for terms in more than the share ``common`` of all records, else null. Repeated rows
    are occurrences, not records. Other columns are ignored; an empty table gives an empty result.
    """
    # a record's rows combine before they are shuffled, however often the record repeats
    seen = stage(rows.groupBy("field", "record", "term").agg(F.count("*").alias("occ")), "seen")
    width, held = WIDTH, HELD
    rows_of_terms = seen.filter("term is not null")
    # numbered in the order of their hash, so a task of the join below meets few ranges
    dictionary = stage(numbered(rows_of_terms.groupBy("field", "term").agg(F.count("*").alias("n")), "id", "terms"), "terms")
    if estimated_bytes(dictionary.drop("n")) <= BROADCAST_BYTES:
        encoded = rows_of_terms.join(F.broadcast(dictionary.drop("n")), ["field", "term"])
    else:  # terms of many rows don't meet in one task
        limit = rows_of_terms.count() // HOT + 1
        hot, cold = (dictionary.filter(c).drop("n") for c in (F.col("n") > limit, F.col("n") <= limit))
        encoded = rows_of_terms.join(F.broadcast(hot), ["field", "term"]).unionByName(rows_of_terms.join(F.broadcast(hot), ["field", "term"], "left_anti").join(cold, ["field", "term"]))
    blocks = encoded.select("field", "id", "occ", F.col("record").isNotNull().cast("long").alias("rec")).mapInArrow(lambda batches: _count_blocks(batches, width, held), ARRAYS)
    sums = blocks.repartition("field", "r").sortWithinPartitions("field", "r").mapInArrow(lambda batches: _sum_ranges(batches, width), ARRAYS)
    at = F.coalesce("at", F.sequence(F.lit(0), F.lit(width - 1)).cast("array<short>"))
    counts = sums.select("field", "r", F.explode(F.arrays_zip(at.alias("at"), "occ", "rec")).alias("c")).select(
        "field", (F.col("r") * width + F.col("c.at")).alias("id"), F.col("c.occ").alias("occurrences"), F.col("c.rec").alias("records")
    )
    totals = seen.filter("record is not null").select("field", "record").distinct().groupBy("field").agg(F.count("*").alias("all_records"))
    out = counts.filter("occurrences > 0").join(broadcast_if_small(dictionary.drop("n")), ["field", "id"]).join(F.broadcast(totals), "field", "left").fillna(0, ["all_records"])
    mark = F.when((F.col("records") > 0) & (F.col("records") <= rare), "rare").when(F.col("records") > common * F.col("all_records"), "common")
    return out.select("field", "term", "occurrences", "records", "all_records", mark.alias("mark"))
