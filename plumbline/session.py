"""Sessions, table access and lineage cutting."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "plumbline", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.compress", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    reach_workers(session)
    return session


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever the working folder. Executors that don't see that path need it installed."""
    root, environment = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; only where none is set, as in tests, a folder of our own.

    Spark makes a folder of the application's own in it. That one is deleted when the driver ends; with ``spark.cleaner.referenceTracking.cleanCheckpoints`` each
    checkpoint goes as soon as nothing refers to it.
    """
    context = spark.sparkContext
    present = context.getCheckpointDir()
    if not present:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
        present = context.getCheckpointDir()
    if present not in _DELETED_AT_END:
        _DELETED_AT_END.add(present)
        path = context._jvm.org.apache.hadoop.fs.Path(present)
        atexit.register(_deleted, path.getFileSystem(context._jsc.hadoopConfiguration()), path)
    return present


_DELETED_AT_END: set[str] = set()


def _deleted(file_system, path) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        file_system.delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder: later readers neither recompute it nor depend on an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_unused(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints that nothing refers to any more, which it does only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores when it comes in fewer partitions, as a small file does; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
