"""Running sums over a whole table in a total order, without a window that puts all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import stage


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with columns ``sums``: the sum of each expression over all rows up to and including this one.

    Rows are range-partitioned; the driver gets one row of sums per partition and hands back what lies before it.
    ``order`` must be total for a defined result.
    """
    names = list(sums)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select("*", *(e.cast("double").alias(f"_v_{n}") for n, e in sums.items()))
    rows = stage(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = rows.groupBy("_part").agg(*(F.sum(f"_v_{n}").alias(n) for n in names)).orderBy("_part").collect()
    before, at = [], dict.fromkeys(names, 0.0)
    for row in totals:
        before.append((row["_part"], *(at[n] for n in names)))
        at = {n: at[n] + (row[n] or 0.0) for n in names}
    schema = "_part int, " + ", ".join(f"`_b_{n}` double" for n in names)
    offsets = df.sparkSession.createDataFrame(before, schema)
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(offsets), "_part")
    return rows.select(*df.columns, *((F.sum(f"_v_{n}").over(w) + F.col(f"_b_{n}")).alias(n) for n in names))
