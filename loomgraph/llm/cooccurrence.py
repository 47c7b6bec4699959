"""Items that appear together, by basket collapsing.

Baskets become sets of distinct item numbers; equal ones collapse into one with a weight, and pairs are enumerated once
per distinct basket. Baskets up to ``BLOCK`` items are arrays in one row; larger ones stay as rows, are found equal by
fingerprints and then compared item by item, and are enumerated block against block in separate tasks. Two exact rules keep
large baskets from being paired out: items that cannot reach the thresholds are left out first, and of the
``min_support`` baskets that a pair must share at least one is not among the ``min_support - 1`` largest, so those giants are
never enumerated but looked up in the list of giants of each item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import broadcast_if_small, numbered, stage

#: Largest array of items in one row; pairs added up at once within a task; pairs a task enumerates.
BLOCK, PAIRS_AT_ONCE, PAIRS_PER_TASK = 1024, 2_000_000, 20_000_000


def _weights(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    total = np.bincount(at, np.concatenate([w for _, w in parts])).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(code), pa.array(total)], names=["pair", "w"])


def _summed(pieces: Iterator[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    parts, n = [], 0
    for code, weight in pieces:
        parts.append((code, np.full(len(code), weight, np.int64)))
        n += len(code)
        if n >= PAIRS_AT_ONCE:
            yield _weights(parts)
            parts, n = [], 0
    if parts:
        yield _weights(parts)


def _codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (np.minimum(a, b) << 32) | np.maximum(a, b)


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pieces() -> Iterator[tuple[np.ndarray, int]]:
        for batch in batches:
            for items, weight in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                x = items.values.to_numpy()
                i, j = np.triu_indices(len(x), 1)
                yield _codes(x[i], x[j]), weight

    yield from _summed(pieces())


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pieces() -> Iterator[tuple[np.ndarray, int]]:
        for batch in batches:
            for left, right, same, weight in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = left.values.to_numpy(), right.values.to_numpy()
                if same:
                    i, j = np.triu_indices(len(x), 1)
                    yield _codes(x[i], x[j]), weight
                else:
                    yield _codes(np.repeat(x, len(y)), np.tile(y, len(x))), weight

    yield from _summed(pieces())


def _spread(work: DataFrame, by: list[str]) -> DataFrame:
    """``work`` (n_pairs, ...) over so many tasks that each has about ``PAIRS_PER_TASK`` pairs, whatever its bytes are."""
    least = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = work.agg(F.sum("n_pairs").alias("n")).first()["n"] or 0
    return work.repartition(max(least, -(-total // PAIRS_PER_TASK)), *by)


def _collapsed_large(member: DataFrame, large: DataFrame) -> DataFrame:
    """(basket, size, weight): of equal baskets of ``large`` (basket, size) the smallest, with their number.

    Equal baskets have equal fingerprints; baskets of one fingerprint are then compared with the smallest of them item by
    item, and one that differs stands for itself.
    """
    marks = member.join(large, "basket").groupBy("basket", "size").agg(F.bit_xor(F.xxhash64("i")).alias("x"), F.bit_xor(F.xxhash64("i", F.lit(7))).alias("y"))
    first = marks.groupBy("size", "x", "y").agg(F.min("basket").alias("first"))
    marks = stage(marks.join(first, ["size", "x", "y"]).select("basket", "size", "first"), "alike")
    alike = marks.filter("basket <> first").select("basket", "first")
    theirs = member.join(alike, "basket").select("basket", "first", "i")
    held = theirs.join(member.join(alike.select(F.col("first").alias("basket")).distinct(), "basket").withColumnRenamed("basket", "first"), ["first", "i"])
    equal = held.groupBy("basket").agg(F.count("*").alias("common"))
    marks = marks.join(equal, "basket", "left")
    stands = F.when((F.col("basket") == F.col("first")) | (F.col("common") == F.col("size")), F.col("first")).otherwise(F.col("basket"))
    return marks.groupBy(stands.alias("basket"), "size").agg(F.count("*").alias("weight"))


def pair_counts(rows: DataFrame, basket: str, item: str, min_support: int, min_lift: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n_baskets, lift, conviction) with item_a < item_b, for all pairs that share at
    least ``min_support`` baskets and have a lift of at least ``min_lift``.

    An item counts once per basket, repeated rows or not; rows whose basket or item is null are left out, also of
    n_baskets. conviction of a => b is null where a never occurs without b. Other columns are ignored; an empty table
    gives an empty result.
    """
    member = stage(rows.filter(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct(), "members")
    n_baskets = member.select("basket").distinct().count()
    counts = member.groupBy("item").agg(F.count("*").alias("n"))
    # n_ab is at most n_a and n_b, so these items can't be in any pair of the result
    items = numbered(counts.filter((F.col("n") >= min_support) & (F.col("n") * min_lift <= n_baskets)), "i", "items")
    items = stage(items, "items")
    lookup = broadcast_if_small(items.select("item", "i"))
    member = stage(member.join(lookup, "item").select("basket", "i"), "members")
    sizes = stage(member.groupBy("basket").agg(F.count("*").alias("size")), "sizes")
    large = sizes.filter(F.col("size") > block)
    small = sizes.filter(F.col("size") <= block)
    spark = rows.sparkSession
    kind = dict(member.dtypes)["basket"]
    # the driver gets at most min_support - 1 baskets: those whose weights add up to that
    giants, left = [], max(0, min_support - 1)
    has_large = not large.isEmpty()
    if has_large:
        large = stage(_collapsed_large(member, broadcast_if_small(large)), "large")
        for g in large.orderBy(F.desc("size"), "basket").limit(left).collect():
            if g["weight"] > left:
                break
            giants.append(g)
            left -= g["weight"]
    giant = spark.createDataFrame([(g["basket"], k) for k, g in enumerate(giants)], f"basket {kind}, giant int")
    weights = F.array(*(F.lit(g["weight"]).cast("long") for g in giants)) if giants else None

    arrays = member.join(small, "basket").groupBy("basket").agg(F.array_sort(F.collect_list("i")).alias("items"))
    collapsed = arrays.filter(F.size("items") > 1).groupBy("items").agg(F.count("*").alias("weight"))
    n = F.size("items").cast("long")
    collapsed = stage(collapsed.withColumn("n_pairs", (n * (n - 1) / 2).cast("long")), "collapsed")
    pairs = _spread(collapsed, ["items"]).select("items", "weight").mapInArrow(_within, "pair long, w long")
    if has_large:
        rest = large.join(F.broadcast(giant), "basket", "left_anti")
        part = F.pmod(F.xxhash64("i"), F.ceil(F.col("size") / F.lit(block // 2))).cast("int")
        blocks = member.join(broadcast_if_small(rest), "basket").withColumn("part", part).groupBy("basket", "part", "weight").agg(F.collect_list("i").alias("items"))
        blocks = stage(blocks, "blocks")
        facing = blocks.select("basket", F.col("part").alias("part2"), F.col("items").alias("items2"))
        both = blocks.join(facing, "basket").filter("part <= part2")
        both = both.select("items", "items2", (F.col("part") == F.col("part2")).alias("same"), "weight", (F.size("items") * F.size("items2").cast("long")).alias("n_pairs"))
        pairs = pairs.unionByName(_spread(both, ["items", "items2"]).drop("n_pairs").mapInArrow(_across, "pair long, w long"))
    total = pairs.groupBy("pair").agg(F.sum("w").alias("w")).filter(F.col("w") >= max(1, min_support - sum(g["weight"] for g in giants)))
    total = total.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b"), "w")
    none = F.array().cast("array<int>")
    if giants:
        lists = member.join(F.broadcast(giant), "basket").groupBy("i").agg(F.collect_list("giant").alias("giants"))
        items = items.join(lists, "i", "left").withColumn("giants", F.coalesce("giants", none))
    else:
        items = items.withColumn("giants", none)
    items = broadcast_if_small(stage(items, "items"))
    for side in "ab":
        total = total.join(items.select(F.col("i").alias(side), F.col("item").alias(f"item_{side}"), F.col("n").alias(f"n_{side}"), F.col("giants").alias(f"giants_{side}")), side)
    n_ab = F.col("w")
    if giants:
        n_ab = n_ab + F.aggregate(F.array_intersect("giants_a", "giants_b"), F.lit(0).cast("long"), lambda t, g: t + F.get(weights, g))
    total = total.withColumn("n_ab", n_ab).filter((F.col("n_ab") >= min_support) & (F.col("n_ab") * n_baskets >= min_lift * F.col("n_a") * F.col("n_b")))
    swap = F.col("item_a") > F.col("item_b")
    first = {x: F.when(swap, F.col(f"{x}_b")).otherwise(F.col(f"{x}_a")).alias(f"{x}_a") for x in ("item", "n")}
    second = {x: F.when(swap, F.col(f"{x}_a")).otherwise(F.col(f"{x}_b")).alias(f"{x}_b") for x in ("item", "n")}
    out = total.select(first["item"], second["item"], "n_ab", first["n"], second["n"], F.lit(n_baskets).cast("long").alias("n_baskets"))
    without = F.col("n_a") - F.col("n_ab")
    return out.withColumn("lift", F.col("n_ab") * F.col("n_baskets") / (F.col("n_a") * F.col("n_b"))).withColumn(
        "conviction", F.when(without > 0, (F.col("n_baskets") - F.col("n_b")) / F.col("n_baskets") / (without / F.col("n_a")))
    )
