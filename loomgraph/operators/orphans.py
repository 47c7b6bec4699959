"""References to records that do not exist, for composite keys with partial nulls and records with a lifetime.

References are grouped by the null mask of their key; each mask is anti-joined on its non-null columns only, under
declared match semantics. Keys are placed by their number of references (``skew.place``): those with many are split into
shards, so none meets in one task, and both joins of a mask run where the placement put its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.skew import Placement, place
from loomgraph.session import stage

FIRST, LAST = "0001-01-01 00:00:00", "9999-12-31 00:00:00"
MATCH = ("simple", "partial", "full", "exact")


def null_mask(keys: list[str]) -> Column:
    """Bit i is set where key i is null."""
    mask = F.lit(0)
    for i, k in enumerate(keys):
        mask = mask + F.when(F.col(k).isNull(), 1 << i).otherwise(0)
    return mask


def lifetimes(targets: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, seg_from, seg_to, first): the times [seg_from, seg_to) in which a key has a record, overlapping ones merged, and
    the start of its first. Lifetimes are merged by month first, then over all time, so a key with many records is cut
    down before its timeline is put together. Empty lifetimes stay, as they say that the key was there once."""
    life = targets.select(*keys, F.col(start).alias("_a"), F.coalesce(F.col(end), F.lit(LAST).cast("timestamp")).alias("_b"))
    life = life.filter("_a is not null").groupBy(*keys, "_a").agg(F.max("_b").alias("_b"))

    def merged(df: DataFrame, part: list) -> DataFrame:
        w = Window.partitionBy(*keys, *part).orderBy("_a")
        reach = F.max("_b").over(w.rowsBetween(Window.unboundedPreceding, -1))
        run = F.sum(F.when(reach.isNull() | (F.col("_a") > reach), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumn("_run", run).groupBy(*keys, *part, "_run").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b")).drop("_run")

    life = merged(merged(life.withColumn("_month", F.trunc("_a", "month")), ["_month"]).drop("_month"), [])
    return life.select(*keys, F.col("_a").alias("seg_from"), F.col("_b").alias("seg_to"), F.min("_a").over(Window.partitionBy(*keys)).alias("first"))


def orphan_references(
    refs: DataFrame, targets: DataFrame, keys: list[str], match: str = "simple", at: str | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Rows of ``refs`` whose key has no record in ``targets``, with column ``kind``.

    match: ``simple``: a key with a null refers to nothing and is no orphan; ``partial``: non-null columns must
    match some record, an all-null key refers to nothing; ``full``: as simple, but a key that is null in part is an
    orphan of kind ``mixed``; ``exact``: null equals null. Without ``at`` a missing key is kind ``missing``. With it, a
    record exists in [start, end) (a null end is open, a null start never), kinds are ``missing`` (no record at any time), ``late`` (all
    start after ``at``) and ``deleted``; rows whose ``at`` is null can't be judged and are left out. Repeated rows are
    reported each; other columns of ``refs`` are kept (a column ``kind`` is replaced; names with a leading underscore are the
    operator's own), other columns of ``targets`` ignored. Empty tables give an empty result or all references.
    """
    if match not in MATCH:
        raise ValueError(f"match must be one of {MATCH}")
    everything = (1 << len(keys)) - 1
    own = {k: f"_k{i}" for i, k in enumerate(keys)}
    refs = refs.drop("kind")
    columns = [F.col(own.get(c, c)).alias(c) for c in refs.columns]
    refs = refs.withColumnsRenamed(own)
    targets = targets.select(*(F.col(k).alias(n) for k, n in own.items()), *([F.col(start).alias("_start"), F.col(end).alias("_end")] if at else []))
    keys = list(own.values())
    refs = refs.withColumn("_mask", null_mask(keys))
    mixed = None
    if match == "full":
        mixed = refs.filter((F.col("_mask") != 0) & (F.col("_mask") != everything)).select(*columns, F.lit("mixed").alias("kind"))
    if match in ("simple", "full"):
        refs = refs.filter("_mask = 0")
    elif match == "partial":
        refs = refs.filter(F.col("_mask") != everything)
    if at:
        refs = refs.filter(F.col(own.get(at, at)).isNotNull())

    if match == "partial":  # a record answers each mask by its columns that are not null in the mask
        targets = targets.withColumn("_mask", F.explode(F.array(*(F.lit(m) for m in range(everything)))))
        for i, k in enumerate(keys):
            targets = targets.withColumn(k, F.when(F.col("_mask").bitwiseAND(F.lit(1 << i)) == 0, F.col(k)))
        targets = targets.filter(null_mask(keys) == F.col("_mask"))
    else:
        targets = targets.withColumn("_mask", null_mask(keys))
    on = ["_mask", *keys]
    records = stage(lifetimes(targets, on, "_start", "_end") if at else targets.distinct(), "records")

    refs = stage(refs.withColumn("_row", F.monotonically_increasing_id()), "references")
    loads = stage(refs.groupBy(*on).agg(F.count("*").alias("load")), "loads")
    where = place(loads, on)
    out = mixed
    for mask in sorted(r["_mask"] for r in loads.select("_mask").distinct().collect()):  # at most 2^k
        part = _orphans_of_mask(refs, records, where, mask, [k for i, k in enumerate(keys) if not mask >> i & 1], own.get(at, at)).select(*columns, "kind")
        out = part if out is None else out.unionByName(part)
    return refs.select(*columns, F.lit("missing").alias("kind")).limit(0) if out is None else out


def _orphans_of_mask(refs: DataFrame, records: DataFrame, where: Placement, mask: int, known: list[str], at: str | None) -> DataFrame:
    """Anti-join of one mask on its non-null columns ``known``; then the kind, by a join of the orphans only."""
    here = ["_task", "_shard", *known]
    left = where.fragment(refs.filter(F.col("_mask") == mask), [F.col("_row")])
    records = records.filter(F.col("_mask") == mask)
    if not at:
        return left.join(where.replicate(records).select(*here), here, "left_anti").withColumn("kind", F.lit("missing"))
    valid = where.replicate(records.filter("seg_to > seg_from")).select(*(F.col(c).alias(f"_r{c}") for c in here), F.col("seg_from").alias("_from"), F.col("seg_to").alias("_to"))
    same = [F.col(c) == F.col(f"_r{c}") for c in here]
    lost = left.join(valid, reduce(Column.__and__, [*same, F.col(at) >= F.col("_from"), F.col(at) < F.col("_to")]), "left_anti")
    first = where.replicate(records.filter("seg_from = first")).select(*here, F.col("first").alias("_first"))
    kind = F.when(F.col("_first").isNull(), "missing").when(F.col(at) < F.col("_first"), "late").otherwise("deleted")
    return lost.join(first, here, "left").withColumn("kind", kind)


def orphan_report(orphans: DataFrame, at: str, by: list[str]) -> DataFrame:
    """Number of orphans per ``by``, kind and month of ``at``."""
    return orphans.groupBy(*by, "kind", F.date_format(at, "yyyy-MM").alias("period")).agg(F.count("*").alias("n"))
