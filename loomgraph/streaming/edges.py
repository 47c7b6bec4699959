"""Edges as a stream (an extension: the batch pipeline needs none): counts per window, and idempotent ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.functions.ids import plain_id, term


def arrivals(edges: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Edges per predicate and window of ``loaded_at``; rows later than ``late`` behind the newest are left out."""
    rows = edges.withWatermark("loaded_at", late)
    return rows.groupBy(F.window("loaded_at", window).alias("w"), term("predicate", "lower").alias("predicate")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "predicate", "n")


def ingest(edges: DataFrame, path: str, checkpoint: str, late: str = "30 days") -> StreamingQuery:
    """Write new edges in plain form, each row_id once within the watermark; a batch that is repeated after a failure
    replaces its own folder, so nothing is written twice."""
    rows = edges.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["row_id"])
    rows = rows.withColumns({"source": plain_id("source"), "target": plain_id("target"), "predicate": term("predicate", "lower")})

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
