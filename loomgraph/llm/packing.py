"""Filling fixed-capacity containers: swap-based local search over shards of items.

Items are hashed into shards of bounded size and put into bins one after another (next fit). Then bins exchange items: the
emptiest bin gives fill to bins at least as full, by a move, one item for one, or two for one, always the exchange that
raises the sum of squared fills most, until it is empty or nothing improves. All underfull bins take part. In further
rounds whole bins that are not full meet those of other shards, as long as rounds save bins.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import stage

#: Items of a shard. A round that saves less than one bin in so many is the last.
SHARD_ITEMS, LEAST_SAVING = 4096, 1000


def next_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item in the order given: a new bin where the last one has no room."""
    out, b, fill = np.zeros(len(sizes), np.int64), 0, 0
    for i, s in enumerate(sizes.tolist()):
        if fill + s > capacity:
            b, fill = b + 1, 0
        out[i] = b
        fill += s
    return out


def _offers(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of one or two items of a bin, ascending and distinct, with the sizes (the second is 0 for a single item). There
    are at most as many as the bin is large, as sums of distinct sizes are."""
    count = Counter(sizes)
    one = np.array(sorted(count), np.int64)
    i, j = np.triu_indices(len(one))
    keep = (i != j) | (np.array([count[x] for x in one.tolist()])[i] > 1)
    first, second = np.concatenate([one, one[i[keep]]]), np.concatenate([np.zeros(len(one), np.int64), one[j[keep]]])
    total, at = np.unique(first + second, return_index=True)
    return total, first[at], second[at]


class _Bins:
    """Items of a shard in bins, with the fill of each bin; ``search`` improves them in place."""

    def __init__(self, sizes: np.ndarray, bins: np.ndarray, capacity: int):
        self.size, self.bin, self.capacity = sizes, bins.copy(), capacity
        self.fill = np.bincount(bins, sizes).astype(np.int64)

    def search(self) -> None:
        improved = True
        while improved:
            improved = False
            open_ = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
            for d in open_[np.argsort(self.fill[open_], kind="stable")]:
                while 0 < self.fill[d] < self.capacity and self._give(int(d)):
                    improved = True

    def _give(self, d: int) -> bool:
        """The best exchange that takes fill from bin ``d`` to a bin at least as full; False if there is none."""
        mine = np.flatnonzero(self.bin == d)
        total, first, second = _offers(self.size[mine].tolist())
        room = self.capacity - self.fill
        takes = (self.fill >= self.fill[d]) & (room > 0)
        takes[d] = False
        bins = np.flatnonzero(takes)
        theirs = np.flatnonzero(takes[self.bin])
        # an exchange for nothing is a move of one item; else one or two items for one of the other bin
        single = second == 0
        ones = total[single]
        back = np.concatenate([np.zeros(len(bins), np.int64), self.size[theirs]])
        to = np.concatenate([bins, self.bin[theirs]])
        most = back + room[to]
        k = np.searchsorted(total, most, "right") - 1
        gain = np.where(k >= 0, total[np.maximum(k, 0)], 0) - back
        k1 = np.searchsorted(ones, room[bins], "right") - 1
        gain[: len(bins)] = np.where(k1 >= 0, ones[np.maximum(k1, 0)], 0)
        value = np.where(gain > 0, gain * (self.fill[to] - self.fill[d] + gain), 0)
        if not len(value) or value.max() <= 0:
            return False
        best = int(value.argmax())
        at = int(np.flatnonzero(single)[k1[best]]) if best < len(bins) else int(k[best])
        given = [mine[np.flatnonzero(self.size[mine] == first[at])[0]]]
        if second[at]:
            rest = np.setdiff1d(mine, given)
            given.append(rest[np.flatnonzero(self.size[rest] == second[at])[0]])
        b = int(to[best])
        self.bin[given] = b
        if best >= len(bins):
            self.bin[theirs[best - len(bins)]] = d
        self.fill[b] += gain[best]
        self.fill[d] -= gain[best]
        return True


def pack_shard(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item after the search; sizes are 1..capacity and ``bins`` hold at most ``capacity``."""
    state = _Bins(np.asarray(sizes, np.int64), np.asarray(bins, np.int64), capacity)
    state.search()
    return state.bin


def _packer(level: int, capacity: int):
    """Items of a shard into bins; in later rounds they come with their bins, which stay together until exchanges."""

    def work(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_item", "_k"]).drop(columns="_shard").reset_index(drop=True)
        sizes = pdf["_size"].to_numpy(np.int64)
        # bins before the search: one after another in the order of a hash, or those of the last round
        if level:
            bins = pd.factorize(pdf["container"])[0]
        else:
            order = pd.util.hash_array((pdf["_item"].to_numpy(np.int64) << 20) + pdf["_k"].to_numpy(np.int64)).argsort(kind="stable")
            bins = np.empty(len(pdf), np.int64)
            bins[order] = next_fit(sizes[order], capacity)
        bins = pack_shard(sizes, bins, capacity)
        pdf["container"] = [f"{level}-{group[0]}-{b}" for b in bins]
        pdf["_fill"] = pdf["_size"].groupby(bins).transform("sum")
        return pdf

    return work


def pack(items: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, piece, start, size, container): every item in a container of at most ``capacity``.

    An item larger than the capacity is split into full pieces, each its own container, and a rest that is packed;
    no other item is split. Items of size 0 (also null or negative sizes) need no room: their container is null.
    Repeated keys are separate items; equal sizes are told apart by a row number of the stored input. An empty table
    gives an empty result; other columns are ignored.
    """
    whole = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    rows = stage(items.select(F.col(key), whole.alias("_n")).withColumn("_item", F.monotonically_increasing_id()), "items")
    pieces = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / capacity) - 1, F.lit(0)).cast("int"))))
    pieces = pieces.withColumn("start", F.col("_k").cast("long") * capacity).withColumn("_size", F.least(F.col("_n") - F.col("start"), F.lit(capacity)))
    result = [key, F.col("_k").alias("piece"), "start", F.col("_size").alias(size)]
    empty = pieces.filter("_size = 0").select(*result, F.lit(None).cast("string").alias("container"))
    full = pieces.filter(F.col("_size") == capacity).select(*result, F.format_string("full-%d-%d", "_item", "_k").alias("container"))
    parts, level = [empty, full], 0
    todo = pieces.filter((F.col("_size") > 0) & (F.col("_size") < capacity)).select(key, "_k", "start", "_size", "_item", F.lit("").alias("container"))
    schema = f"`{key}` {dict(items.dtypes)[key]}, _k int, start long, _size long, _item long, container string, _fill long"
    left, before = todo.count(), 0
    while left:
        shards = -(-left // SHARD_ITEMS)
        by = [F.col("_item"), F.col("_k")] if not level else [F.col("container")]
        shard = F.pmod(F.xxhash64(F.lit(level), *by), F.lit(shards))
        done = stage(todo.withColumn("_shard", shard).groupBy("_shard").applyInPandas(_packer(level, capacity), schema), "packed")
        loose = F.when(F.col("_fill") < capacity, F.col("container"))
        left, bins, now = done.agg(F.count(loose), F.count_distinct(loose), F.count_distinct("container")).first()
        if shards == 1 or (level and (before - now) * LEAST_SAVING < before):
            parts.append(done.select(*result, "container"))
            break
        parts.append(done.filter(F.col("_fill") == capacity).select(*result, "container"))
        todo, before, level = done.filter(F.col("_fill") < capacity).drop("_fill"), bins, level + 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
