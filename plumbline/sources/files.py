"""Files in and out: JSON lines, CSV, summaries, whole documents, vectors."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator, Sequence
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_BAD = "_bad_line"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop))


def read_jsonl(
    spark: SparkSession, path: str | Sequence[str], schema: StructType, blank_lines: bool = True
) -> DataFrame:
    """One object per line; a broken line fails the read. Blank lines are skipped, or fail it, too, without ``blank_lines``."""
    paths = path if isinstance(path, str) else list(path)
    if blank_lines:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    line = F.when(F.trim("value") == "", F.raise_error(F.lit("blank line"))).otherwise(F.col("value"))
    parsed = spark.read.text(paths).select(F.from_json(line, schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select(*[F.col(f"r.`{f.name}`") for f in schema.fields])


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and broken lines (``line``)."""
    whole = StructType([*schema.fields, StructField(_BAD, StringType())])
    text = spark.read.text(path).where("trim(value) <> ''")
    parsed = text.select(
        "value",
        F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("r"),
    )
    bad = F.col("r").isNull() | F.col(f"r.{_BAD}").isNotNull()
    return parsed.where(~bad).select(*[F.col(f"r.`{f.name}`") for f in schema.fields]), parsed.where(bad).select(
        F.col("value").alias("line")
    )


def read_optional(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """No rows where there's no such file."""
    return read_jsonl(spark, path, schema) if _exists(spark, path) else spark.createDataFrame([], schema)


def read_configs(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    configs: Sequence[str] | None = None,
) -> DataFrame:
    """All JSONL files of a folder, or folders of parts that are named so, with the stem as ``config``; a subset of these reads no other file."""
    paths = [
        p for c in configs if _exists(spark, p := f"{folder}/{c}.jsonl")
    ] if configs is not None else [f"{folder}/*.jsonl"]
    if not paths or not _exists(spark, paths[0]):
        return spark.createDataFrame(
            [],
            StructType([*[f for f in schema.fields if f.name != "config"], StructField("config", StringType())]),
        )
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl(?:/[^/]*)?$", 1)
    return read_jsonl(spark, paths, schema).withColumn("config", stem)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", by: Sequence[str] = ()) -> None:
    """Null fields are written as such."""
    writer = df.write.mode(mode).option("ignoreNullFields", "false")
    (writer.partitionBy(*by) if by else writer).json(path)


def append_missing(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    schema: StructType,
    retry_errors: bool = False,
) -> DataFrame:
    """The rows of ``df`` whose keys aren't written yet; write these with mode 'append' to resume. ``retry_errors`` counts rows with a call error as missing."""
    done = read_optional(df.sparkSession, path, schema)
    if retry_errors:
        done = done.where("usage.error is null")
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(
        header="true",
        escape='"',
        ignoreLeadingWhiteSpace="false",
        ignoreTrailingWhiteSpace="false",
    ).csv(path)


def write_summary(
    df: DataFrame,
    path: str,
    key: str | None = None,
    max_rows: int = 10_000,
) -> dict[str, Any] | list[Any]:
    """A small aggregate as indented JSON, by ``key`` where given; more than ``max_rows`` is an error, not a cut."""
    rows = [json.loads(x) for x in df.limit(max_rows + 1).toJSON().collect()]
    if len(rows) > max_rows:
        raise ValueError(f"a summary of more than {max_rows} rows")
    out: dict[str, Any] | list[Any] = {r.get(key): r for r in rows} if key else rows
    Path(path).write_text(json.dumps(out, indent=2, ensure_ascii=False), encoding="utf-8")
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text extracted from documents, one row per file: (``doc_id``, ``text``)."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("doc_id"),
        F.col("value").alias("text"),
    )


def read_pdfs(spark: SparkSession, path: str, command: Sequence[str] = ("pdftotext", "-layout", "-", "-")) -> DataFrame:
    """The text of PDF files, one row per file: (``doc_id``, ``text``). Each worker pipes its files through ``command``, which must be installed there; a file at which it fails ends the read."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [subprocess.run(list(command), input=bytes(c), capture_output=True, check=True).stdout for c in pdf["content"]]
            yield pd.DataFrame({"doc_id": pdf["path"], "text": [t.decode("utf-8", "replace") for t in texts]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(extract, "doc_id string, text string")


def write_vectors(df: DataFrame, path: str) -> None:
    """Replace a vector collection: (``id``, ``embedding``, ``document``, metadata with '' for null)."""
    filled = df.select(
        "id",
        F.col("embedding").cast("array<float>").alias("embedding"),
        "document",
        *[
            F.coalesce(c, F.lit("")).alias(c)
            for c in ("section", "annex_iii_area", "para_num", "heading_path") if c in df.columns
        ],
    )
    filled.write.mode("overwrite").parquet(path)


def read_config(path: str) -> dict[str, Any]:
    """A YAML or JSON configuration."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML; a JSON configuration does not") from e
    return yaml.safe_load(text)
