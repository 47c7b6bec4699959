"""Session helpers: tables, reliable lineage cuts, checked broadcasts, dense numbering."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest in-memory size, in bytes as estimated by ``estimated_bytes``, of a table sent to every executor.
BROADCAST_BYTES = 8 << 20


#: Folder of staged tables within the shared one; tables of each application that are still there.
JOB_FOLDER = "staged"
_STAGED: dict[str, set[str]] = {}
_SHIPPED: set[str] = set()


@atexit.register
def _drop_all() -> None:
    """At the end of the program, while its session lives; a program that stops its session first calls ``drop_staged``."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        drop_staged(spark)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once per application, wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="spark-package-"), f"{root.name}.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(archive))
        _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a fresh local one where it is unset (tests)."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with the staged tables."""
    path = os.path.join(shared_dir(spark), JOB_FOLDER, f"{name}-{uuid.uuid4().hex}")
    _STAGED.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and return that table: later jobs neither recompute it nor
    lose it with an executor. Columnar and compressed, so smaller than a checkpoint of the same rows."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, since: set[str] | None = None) -> None:
    """Delete the tables that ``stage`` wrote in this application, but those in ``since``."""
    paths = _STAGED.get(spark.sparkContext.applicationId, set())
    for path in paths - (since or set()):
        _delete(spark, path)
        paths.discard(path)


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """Tables staged within the block are deleted at its end, when the results made of them are written."""
    before = set(_STAGED.get(spark.sparkContext.applicationId, set()))
    try:
        yield
    finally:
        drop_staged(spark, before)


def drop_jobs(spark: SparkSession) -> None:
    """Delete what earlier applications left in the shared folder, as where one was lost before it could clear up. Only for a
    folder that no other application uses now."""
    _delete(spark, os.path.join(shared_dir(spark), JOB_FOLDER))
    _STAGED.pop(spark.sparkContext.applicationId, None)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for plans that run within the block; those of before come back after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def estimated_bytes(df: DataFrame, row_overhead: int = 32) -> int:
    """Upper-bound style estimate: string lengths are measured, other values count 8 bytes, plus an overhead per row."""
    cells = [F.coalesce(F.octet_length(c), F.lit(0)) + 8 if t in ("string", "binary") else F.lit(8) for c, t in df.dtypes]
    width = F.lit(row_overhead)
    for cell in cells:
        width = width + cell
    return df.agg(F.sum(width.cast("long")).alias("n")).first()["n"] or 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size is below ``limit``; else unchanged (Spark then shuffles)."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def numbered(df: DataFrame, column: str = "id", stage_name: str = "dictionary") -> DataFrame:
    """Distinct rows get dense integers 0..n-1. The driver sees one count per partition, never the rows."""
    part = stage(df.withColumn("_mono", F.monotonically_increasing_id()), stage_name)
    split = part.select("*", F.shiftright("_mono", 33).alias("_part"), F.col("_mono").bitwiseAND((1 << 33) - 1).alias("_pos"))
    counts = split.groupBy("_part").count().orderBy("_part").collect()
    starts, total = [], 0
    for row in counts:
        starts.append((row["_part"], total))
        total += row["count"]
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    return split.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_start") + F.col("_pos")).alias(column))
