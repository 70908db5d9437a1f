"""Queries of the sources and sinks: whole tables written to the shared folder and read back, with SQL."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plumbline import schemas
from plumbline.session import checkpoint_dir, table
from plumbline.sources import files

_NUMBERED = lambda schema: StructType([*schema.fields, StructField("row_no", LongType())])
_CONFIGS = ("agent_structured", "baseline2_standard_rag")


def _folder(spark: SparkSession) -> str:
    """A folder of our own in the checkpoint folder, which is deleted when the driver ends."""
    return f"{checkpoint_dir(spark)}/files-{uuid4().hex}"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "runs").select("row_no", *schemas.RUNS.names)


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test set as JSON lines, nulls written as such, read back strictly; blank lines between the files' lines don't matter."""
    path = _folder(spark)
    files.write_jsonl(table(spark, sf_dir, "test_set").select("row_no", *schemas.TEST_SET.names), path)
    spark.range(3).select(F.lit("").alias("value")).write.mode("append").text(path)
    return files.read_jsonl(spark, path, _NUMBERED(schemas.TEST_SET)).withColumn(
        "needs_review",
        F.array_join("needs_review", ","),
    )


def tolerant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file in which every seventh line is broken and every eleventh is blank: which lines load, and which come out as they stand."""
    path = _folder(spark)
    whole = F.to_json(F.struct("row_no", "id", "label"), {"ignoreNullFields": "false"})
    line = F.when(F.col("row_no") % 11 == 0, "  ").when(
        F.col("row_no") % 7 == 0,
        F.concat(F.lit('{"row_no": '), F.col("row_no").cast("string")),
    ).otherwise(whole)
    table(spark, sf_dir, "test_set").select(line.alias("value")).write.text(path)
    good, bad = files.read_jsonl_tolerant(
        spark,
        path,
        StructType([f for f in _NUMBERED(schemas.TEST_SET).fields if f.name in ("row_no", "id", "label")]),
    )
    return good.select("row_no", "id", "label", F.lit(None).cast("string").alias("line")).unionByName(
        bad.select(
            F.lit(None).cast("long").alias("row_no"),
            F.lit(None).cast("string").alias("id"),
            F.lit(None).cast("string").alias("label"),
            "line",
        )
    )


def _written(spark: SparkSession, runs: DataFrame, configs: Sequence[str]) -> str:
    """A folder of parts for each configuration, named as its file would be."""
    folder = _folder(spark)
    for c in configs:
        files.write_jsonl(runs.where(F.col("config") == c).drop("config"), f"{folder}/{c}.jsonl")
    return folder


def config_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs read by configuration from a folder, which gives ``config``; an absent one gives no rows."""
    runs = _runs(spark, sf_dir)
    folder = _written(spark, runs, [*_CONFIGS, "baseline1_plain_llm"])
    found = files.read_configs(spark, folder, _NUMBERED(schemas.RUNS), [*_CONFIGS, "absent"])
    absent = files.read_optional(spark, f"{folder}/absent.jsonl", _NUMBERED(schemas.RUNS))
    return found.unionByName(absent).select(
        "row_no",
        "id",
        "config",
        "pred_label",
        "parse_ok",
        F.size("retrieved_top5").alias("n_hits"),
        F.col("usage.input_tokens").alias("input_tokens"),
    )


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions with their quotes and line breaks through a CSV file."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "test_set").where("system_description is not null").select(
        "row_no",
        "system_description",
    )
    files.write_csv(rows, path)
    read = spark.read.schema(
        "row_no long, system_description string"
    ).option("header", "true").option("escape", '"').option("multiLine", "true")
    return read.options(ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path).select(
        "row_no",
        F.regexp_replace("system_description", "\r\n?", "\n").alias("system_description"),
    )


def appended_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that stopped on the way, resumed: each configuration and id once, what was written first stays."""
    path = _folder(spark)
    runs = table(spark, sf_dir, "runs").where("id is not null and config is not null").groupBy("config", "id").agg(
        F.min("row_no").alias("row_no")
    )
    schema = StructType(
        [f for f in schemas.RUNS.fields if f.name in ("config", "id")]
        + [StructField("row_no", LongType())]
    )
    files.write_jsonl(runs.where("row_no % 3 = 0").withColumn("row_no", -F.col("row_no")), path)
    missing = files.append_missing(runs, path, ["config", "id"], schema)
    files.write_jsonl(missing, path, "append")
    return files.read_jsonl(spark, path, schema).select("config", "id", "row_no")


QUERIES = {f.__name__: f for f in (jsonl_roundtrip, tolerant_lines, config_folders, csv_roundtrip, appended_runs)}

SQL = {
    "jsonl_roundtrip": f"""SELECT row_no, {', '.join(c for c in schemas.TEST_SET.names if c != 'needs_review')},
        array_to_string(needs_review, ',') AS needs_review FROM test_set""",
    "tolerant_lines": """SELECT CASE WHEN row_no % 7 <> 0 THEN row_no END AS row_no, CASE WHEN row_no % 7 <> 0 THEN id
        END AS id, CASE WHEN row_no % 7 <> 0 THEN label END AS label,
      CASE WHEN row_no % 7 = 0 THEN '{"row_no": ' || row_no END AS line FROM test_set WHERE row_no % 11 <> 0""",
    "config_folders": """SELECT row_no, id, config, pred_label, parse_ok, len(retrieved_top5)::INT AS n_hits,
        usage.input_tokens AS input_tokens FROM runs WHERE config IN ('agent_structured', 'baseline2_standard_rag')""",
    "csv_roundtrip": """SELECT row_no, CASE WHEN system_description <> '' THEN regexp_replace(system_description,
        '\\r\\n?', chr(10), 'g') END AS system_description FROM test_set WHERE system_description IS NOT NULL""",
    "appended_runs": """WITH r AS (SELECT config, id, min(row_no) AS row_no FROM runs WHERE id IS NOT NULL AND config
        IS NOT NULL GROUP BY 1, 2) SELECT config, id, CASE WHEN row_no % 3 = 0 THEN -row_no ELSE row_no END AS row_no
        FROM r""",
}
