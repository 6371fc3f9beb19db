"""Session defaults and the shared folder for tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel


_WRITTEN: list[str] = []
_HELD: list[DataFrame] = []
#: Whether a query deletes its shuffles when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "peerlens", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks, with a shared folder of its own; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="peerlens-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PEERLENS_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset and one process runs everything, as in tests, a temporary folder is set for the session; on
    a cluster such a folder is private to one machine and lost with it, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="peerlens-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage by writing a table in the shared folder and reading it back.

    Every reader then sees the same rows even after executors are lost, and branches that need
    few columns scan few columns. The table stays until ``release``; the shuffles behind it go as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a plan of its own, as a plan keeps the setting it was made under
    finally:
        spark.conf.set(_CLEANUP, was)
    _WRITTEN.append(path)
    return cheap(spark.read.schema(df.schema).parquet(path))


def cheap(df: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Marks rows that are read again by a scan of a written table, nothing being moved; with ``like``, only if that one is marked."""
    df._cheap = like is None or getattr(like, "_cheap", False)
    return df


def stage(df: DataFrame) -> DataFrame:
    """Rows that several branches read: written, unless reading them again is ``cheap``."""
    return df if getattr(df, "_cheap", False) else durable(df)


def alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows that ``make`` returns, written; whatever it wrote on the way is deleted, so that loops need the room of one turn."""
    before = len(_WRITTEN)
    out = durable(make())
    _delete(spark, _WRITTEN[before:-1])
    del _WRITTEN[before:-1]
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        place = jvm.org.apache.hadoop.fs.Path(p)
        place.getFileSystem(conf).delete(place, True)


def held(df: DataFrame) -> DataFrame:
    """Rows that several branches of one plan read, kept by Spark once the plan runs; nothing runs before.

    They lie in memory and on the executors' disks and are made again from their lineage if an executor is lost. They stay until
    ``release``. Loops use ``durable`` instead, so that lineage does not grow."""
    _HELD.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _HELD[-1]


def release(spark: SparkSession) -> int:
    """Delete the tables that ``durable`` wrote in this process and let go of what is ``held``; call it when no result that
    reads them is needed any more. Returns how many there were."""
    rows = [_HELD.pop().unpersist() for _ in range(len(_HELD))]
    paths = [_WRITTEN.pop() for _ in range(len(_WRITTEN))]
    _delete(spark, paths)
    return len(paths) + len(rows)
