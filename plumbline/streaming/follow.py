"""Run records scored as they arrive. An extension: the batch operators on micro-batches, with late and repeated records settled by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from plumbline.operators.scoring import correctness_rows


def followed_runs(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    time_column: str = "loaded_at",
    lateness: str = "1 hour",
) -> DataFrame:
    """The stream of a folder of JSONL files: a repeated (``config``, ``id``, time) within the watermark counts once."""
    stream = spark.readStream.schema(schema).json(folder)
    return stream.withWatermark(time_column, lateness).dropDuplicatesWithinWatermark(["config", "id", time_column])


def accuracy_windows(runs: DataFrame, time_column: str = "loaded_at", width: str = "1 hour") -> DataFrame:
    """Runs and right ones by configuration and window."""
    right = F.coalesce(F.col("pred_label") == F.col("gold_label"), F.lit(False))
    return runs.groupBy(F.window(time_column, width), "config").agg(
        F.count("*").alias("n"),
        F.sum(right.cast("long")).alias("n_correct"),
    ).select(F.col("window.start").alias("from"), "config", "n", "n_correct")


def append_correctness(runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Correctness rows to Parquet; the checkpoint makes restarts exact."""
    return correctness_rows(runs).writeStream.format("parquet").option("path", path).option(
        "checkpointLocation",
        checkpoint,
    ).outputMode("append").trigger(availableNow=True).start()
