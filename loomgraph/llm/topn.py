"""Top N of every group by simultaneous bisection of all groups' cutoffs on order-preserving codes.

A row's code is its score as an order-preserving integer, followed by its identifier in integers of seven bytes. Each
round counts the rows of each group in up to 4096 code ranges; ranges wholly above the cutoff are taken, the range
that holds the cutoff is refined in the next round, the rest is dropped. Groups end as soon as a boundary leaves exactly
N rows above. No group is ever sorted or collected; counts combine before they are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.session import stage

#: Bits by which a round narrows a range.
BITS = 12


@F.pandas_udf(T.LongType())
def score_code(score: pd.Series) -> pd.Series:
    """Integer in the order of the doubles; -0 and 0 are one."""
    bits = (score.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


def id_code(ident: Column, word: Column) -> Column:
    """Seven UTF-8 bytes of the identifier, from place 7 ``word`` on, as an integer, larger for smaller ones."""
    part = F.rpad(F.hex(F.substring(F.encode(ident, "UTF-8"), 7 * word + 1, F.lit(7))), 14, "0")
    return -F.conv(part, 16, 10).cast("long")


def top_n(rows: DataFrame, groups: list[str], score: str, ident: str, n: int, place: str = "place") -> DataFrame:
    """The ``n`` best rows of every group with their ``place`` (int, from 1): higher score first, equal scores by
    ``ident`` in ascending code-point order.

    ``ident`` must be unique within a group. Rows whose score or ident is null, or whose score is NaN, do not compete.
    Null is a group key like any other. Groups with fewer rows give fewer; an empty table an empty result. Columns
    beginning with ``_`` are kept for the operator's own use.
    """
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("")).alias(f"_g{i}") for i, g in enumerate(groups)]
    nulls = [F.col(g).isNull().alias(f"_n{i}") for i, g in enumerate(groups)]
    names = [f"_{c}{i}" for i in range(len(groups)) for c in "gn"]
    rows = rows.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(ident).isNotNull())
    live = stage(rows.select("*", *keys, *nulls, score_code(F.col(score)).alias("_code"), F.lit(n).cast("long").alias("_need"), F.lit(0).alias("_word")), "codes")
    width = live.agg(F.min("_code").alias("lo"), F.max("_code").alias("hi")).first()
    columns = rows.columns
    if width["lo"] is None:
        return rows.select("*", F.lit(None).cast("int").alias(place)).limit(0)
    live = live.withColumn("_lo", F.lit(width["lo"])).withColumn("_hi", F.lit(width["hi"]))
    taken: list[DataFrame] = []
    while True:
        shift = F.expr(f"greatest(0, length(bin(_lo ^ _hi)) - {BITS})")
        live = live.withColumn("_range", F.call_function("shiftright", F.col("_code"), shift))
        counts = live.groupBy(*names, "_range").agg(F.count("*").alias("_c"), F.min("_code").alias("_min"), F.max("_code").alias("_max"), F.max("_need").alias("_need"))
        above = F.sum("_c").over(Window.partitionBy(*names).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("_above", F.coalesce(above, F.lit(0))).filter("_above < _need")
        cuts = counts.select(*names, "_range", (F.col("_above") + F.col("_c") <= F.col("_need")).alias("_in"), (F.col("_need") - F.col("_above")).alias("_rest"), "_min", "_max")
        kept = live.drop("_need", "_lo", "_hi").join(cuts, [*names, "_range"])
        kept = stage(kept, "cut")
        taken.append(kept.filter("_in").select(*columns))
        edge = kept.filter("NOT _in")
        if edge.isEmpty():
            break
        # equal codes at the cutoff are told apart by the next word of the identifier
        tied = F.col("_min") == F.col("_max")
        next_code = id_code(F.col(ident), F.col("_word"))
        live = edge.select(
            *columns,
            *names,
            F.when(tied, next_code).otherwise(F.col("_code")).alias("_code"),
            F.col("_rest").alias("_need"),
            F.when(tied, F.col("_word") + 1).otherwise(F.col("_word")).alias("_word"),
            F.when(tied, F.lit(-(1 << 56))).otherwise(F.col("_min")).alias("_lo"),
            F.when(tied, F.lit(-1)).otherwise(F.col("_max")).alias("_hi"),
        )
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    order = Window.partitionBy(*groups).orderBy(F.desc(F.col(score) + F.lit(0.0)), F.encode(F.col(ident), "UTF-8"))
    return out.withColumn(place, F.row_number().over(order).cast("int"))
