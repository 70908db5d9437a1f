"""Command line: each step of the evaluation over files."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from plumbline import report, schemas
from plumbline.operators import encoders, generation, quality, redact, retrieval, scoring, segment
from plumbline.session import local_session
from plumbline.sources import files, fixtures


def _numbered(df: DataFrame) -> DataFrame:
    return df if "row_no" in df.columns else df.withColumn("row_no", F.monotonically_increasing_id())


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(files.read_jsonl(spark, path, schemas.TEST_SET))


def _runs(spark: SparkSession, folder: str, configs: Sequence[str] | None = None) -> DataFrame:
    return _numbered(files.read_configs(spark, folder, schemas.RUNS, configs))


def _settings(a: argparse.Namespace) -> dict:
    """The sections of the configuration file, if one is named; options given on the command line go before it."""
    return files.read_config(a.config_file) if getattr(a, "config_file", None) else {}


def _options(a: argparse.Namespace, section: dict, names: Sequence[str]) -> dict:
    """Those of ``names`` that the command line or else the section gives."""
    found = {n: getattr(a, n, None) if getattr(a, n, None) is not None else section.get(n) for n in names}
    return {n: v for n, v in found.items() if v is not None}


def _ranking(queries: DataFrame, corpus: DataFrame, a: argparse.Namespace, log_k: int) -> DataFrame:
    """Fused ranking of (``key``, ``text``); with vectors of the encoder that is named, else by hashed words."""
    settings = _settings(a)
    retrieval_options, embedding = settings.get("retrieval", {}), settings.get("embedding", {})
    name = getattr(a, "encoder", None) or embedding.get("encoder")
    if name:
        options = {"model": embedding["model"]} if name == "sentence" and "model" in embedding else {}
        encoder = encoders.get_encoder(
            name,
            **options,
            **({"query_prefix": embedding["query_prefix"]} if "query_prefix" in embedding else {}),
        )
        queries, corpus = encoders.encoded(queries, encoder, as_queries=True), encoders.encoded(corpus, encoder)
    return retrieval.fused(queries, corpus, log_k, retrieval_options.get("alpha", 0.5))


def _hits(rows: DataFrame, chunks: DataFrame, k: int, a: argparse.Namespace) -> DataFrame:
    corpus = chunks.select(F.col("row_no").alias("key"), "text")
    queries = rows.select(F.col("row_no").alias("key"), F.col("system_description").alias("text"))
    joined = _ranking(queries, corpus, a, k).join(
        chunks.select(F.col("row_no").alias("key"), "id", "text", "heading_path"),
        "key",
    )
    one = F.struct("rank", "id", "text", "heading_path", "score")
    return joined.groupBy(F.col("query").alias("row_no")).agg(F.sort_array(F.collect_list(one)).alias("hits"))


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(files.read_jsonl(spark, path, schemas.CORPUS_CHUNKS))


def _source(spark: SparkSession, path: str) -> DataFrame:
    return files.read_pdfs(spark, path) if path.lower().endswith(".pdf") else files.read_documents(spark, path)


def build_corpus(spark: SparkSession, a: argparse.Namespace) -> None:
    files.write_jsonl(segment.segment_corpus(_source(spark, a.source)), a.out)


def embed_index(spark: SparkSession, a: argparse.Namespace) -> None:
    """Replace the vector collection of a corpus."""
    files.write_vectors(encoders.embedded_chunks(_chunks(spark, a.chunks), encoders.get_encoder(a.encoder)), a.out)


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    """The best passages for one query, as a table on the screen."""
    query = spark.createDataFrame([(0, a.query)], "row_no long, system_description string")
    hits = _hits(query, _chunks(spark, a.chunks), a.top_k, a).select(F.explode("hits").alias("h")).select(
        "h.rank",
        "h.score",
        "h.id",
        "h.heading_path",
        F.substring("h.text", 1, 80).alias("text"),
    )
    print(report.markdown_table(hits.orderBy("rank")))


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    files.write_jsonl(segment.segment_examples(_source(spark, a.source)), a.out)


def check(spark: SparkSession, a: argparse.Namespace) -> None:
    """The rows of each check as JSON lines in a folder beside the report, which has their numbers."""
    good, bad = files.read_jsonl_tolerant(spark, a.source, schemas.TEST_SET)
    rows = _numbered(good)
    checks = {
        "labels": quality.label_vocabulary,
        "missing fields": quality.missing_fields,
        "exact duplicates": quality.exact_duplicates,
        "exact duplicate rows": quality.exact_duplicate_rows,
        "near duplicates": quality.similar_pairs,
        "near duplicate classes": quality.similar_classes,
        "lengths": quality.length_outliers,
        "endings": quality.unterminated,
        "label against point": quality.label_against_mode,
        "filter cases": quality.filter_case_labels,
        "summary": quality.set_summary,
    }
    found = {"broken lines": bad, **{k: f(rows) for k, f in checks.items()}}
    counts = {}
    for name, df in found.items():
        path = f"{Path(a.out).with_suffix('')}_rows/{name.replace(' ', '_')}"
        files.write_jsonl(df, path)
        counts[name] = (spark.read.text(path).count(), path)
    tables = {
        "rows found": spark.createDataFrame(
            [(name, *n) for name, n in counts.items()],
            "check string, n long, written_to string",
        )
    }
    if counts["summary"][0] <= report.MAX_ROWS:
        tables["summary"] = found["summary"].orderBy("level", F.desc("n"), "value")
    report.write_markdown(a.out, "Checks", tables)


def redact_rows(spark: SparkSession, a: argparse.Namespace) -> None:
    out = redact.redacted(_rows(spark, a.source))
    files.write_jsonl(out.drop("row_no"), a.out)
    if a.diff:
        files.write_csv(
            out.select(
                "id",
                F.col("label").alias("gold_label"),
                "edge_case_type",
                "redaction",
                F.col("system_description_original").alias("original"),
                F.col("system_description").alias("redacted"),
                F.lit(None).cast("string").alias("your_check"),
            ),
            a.diff,
        )


def retrieval_eval(spark: SparkSession, a: argparse.Namespace) -> None:
    rows, chunks = _rows(spark, a.test_set), _chunks(spark, a.chunks)
    keyed = chunks.withColumn("key", F.col("row_no"))
    queries = rows.select(F.col("row_no").alias("key"), F.col("system_description").alias("text"))
    corpus = keyed.select("key", "text")
    ranking = _ranking(queries, corpus, a, 50)
    gold, kinds = retrieval.gold_chunks(rows.select(F.col("row_no").alias("query"), "label_source"), keyed)
    per_row = retrieval.per_row_metrics(ranking, gold, kinds).join(
        rows.select(F.col("row_no").alias("query"), F.col("annex_iii_area").alias("area"), "edge_case_type"),
        "query",
    )
    report.write_markdown(
        a.out,
        "Retrieval",
        {
            "summary": retrieval.retrieval_summary(per_row).orderBy("level", "value"),
            "gold matches": per_row.groupBy("kind").count().orderBy(F.desc("count"), "kind"),
        },
    )


_MODEL = ("model", "base_url", "api_key_env", "temperature", "max_tokens", "project", "region")


def _generated(spark: SparkSession, a: argparse.Namespace, rows: DataFrame) -> DataFrame:
    section = _settings(a).get("generation", {})
    crossed = generation.config_cross(rows, a.configs, a.rows, a.limit)
    if a.resume:
        crossed = files.append_missing(crossed, a.out, ["config", "id"], schemas.RUNS, a.retry_errors)
    empty = F.array().cast("array<struct<rank:int,id:string,text:string,heading_path:string,score:double>>")
    with_hits = crossed.join(_hits(rows, _chunks(spark, a.chunks), 10, a), "row_no", "left").withColumn(
        "hits",
        F.when(F.col("config").isin(*scoring.NO_RETRIEVAL), empty).otherwise(F.coalesce("hits", empty)),
    )
    provider = a.provider or section.get("provider", "stub")
    model = generation.get_model(provider, **({} if provider == "stub" else _options(a, section, _MODEL)))
    return generation.generate(generation.with_prompts(with_hits), model, workers=a.workers)


def generate(spark: SparkSession, a: argparse.Namespace) -> None:
    files.write_jsonl(
        _generated(spark, a, _rows(spark, a.test_set)).drop("row_no"),
        a.out,
        "append" if a.resume else "overwrite",
    )


def sanity_run(spark: SparkSession, a: argparse.Namespace) -> None:
    """A few rows of each kind through retrieval and the model; the replies are written once and tallied."""
    rows = _rows(spark, a.test_set)
    picked = rows.join(generation.stratified_sample(rows, a.n_each).select("row_no").distinct(), "row_no", "left_semi")
    files.write_jsonl(_generated(spark, a, picked).drop("row_no"), f"{a.out}/runs")
    runs = files.read_jsonl(spark, f"{a.out}/runs", schemas.RUNS)
    right = F.sum((F.col("pred_label") == F.col("gold_label")).cast("long"))
    report.write_markdown(
        f"{a.out}/sanity.md",
        "Sanity run",
        {
            "right by configuration": runs.groupBy("config").agg(
                F.count("*").alias("n"),
                F.coalesce(right, F.lit(0)).alias("n_right"),
            ).orderBy("config"),
            "checks": scoring.run_checks(runs).orderBy("config"),
        },
    )


def _faithful(spark: SparkSession, a: argparse.Namespace, runs: DataFrame) -> DataFrame:
    """Faithfulness rows, written once and read back, so that a judge isn't asked again."""
    options = {
        k: v
        for k, v in (
            ("model", a.judge_model),
            ("base_url", a.judge_base_url),
            ("api_key_env", a.judge_api_key_env),
            ("max_tokens", a.judge_max_tokens),
        ) if v is not None
    }
    judge = generation.get_judge(a.judge, **options)
    if judge is None:
        rows = scoring.faithfulness_rows(runs).withColumn("error", F.lit(None).cast("string"))
    else:
        questions = _rows(spark, a.test_set) if a.test_set else spark.createDataFrame(
            [],
            "id string, row_no long, system_description string",
        )
        read = runs.where(F.col("config").isNull() | ~F.col("config").isin(*scoring.NO_RETRIEVAL))
        rows = generation.judged_runs(read, questions, judge, a.workers)
    files.write_jsonl(rows, f"{a.out_dir}/faithfulness")
    return files.read_jsonl(
        spark,
        f"{a.out_dir}/faithfulness",
        StructType([*schemas.FAITHFULNESS.fields, StructField("row_no", LongType())]),
    )


def faithfulness(spark: SparkSession, a: argparse.Namespace) -> None:
    found = _faithful(spark, a, _runs(spark, a.runs_dir, a.configs))
    report.write_markdown(
        f"{a.out_dir}/faithfulness.md",
        "Faithfulness",
        {
            "summary": scoring.faithfulness_summary(found).orderBy("config"),
            "skipped": scoring.skip_reasons(found).orderBy("config", "skipped_reason"),
        },
    )


def correctness(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = scoring.correctness_rows(_runs(spark, a.runs_dir, a.configs), absent_is_parsed=True)
    files.write_jsonl(rows, f"{a.out_dir}/correctness")
    slices = {
        f"by {c}": scoring.slice_accuracy(rows, c, null).orderBy("config", c)
        for c, null in (("edge_case_type", True), ("area", False))
    }
    report.write_markdown(
        f"{a.out_dir}/correctness.md",
        "Correctness",
        {
            "metrics": scoring.class_metrics(scoring.confusion(rows)).orderBy("config"),
            **slices,
            "predictions": scoring.distribution(rows, "pred").orderBy("config", F.desc("n")),
        },
    )


def _write_buckets(joined: DataFrame, a: argparse.Namespace) -> dict[str, DataFrame]:
    files.write_jsonl(scoring.off_diagonal(joined, a.faithful_threshold), f"{a.out_dir}/off_diagonal")
    return {
        "buckets": scoring.bucket_matrix(
            joined,
            a.faithful_threshold,
        ).orderBy("config", "bucket"), "sweep": scoring.bucket_sweep(joined).orderBy("config", "threshold", "bucket"),
        "means": scoring.faithfulness_means(joined).orderBy("config"), "point-biserial": scoring.point_biserial(joined).orderBy("config"),
    }


def buckets(spark: SparkSession, a: argparse.Namespace) -> None:
    """The axes that ``correctness`` and ``faithfulness`` wrote, joined."""
    keyed = lambda schema: StructType([*schema.fields, *[f for f in (StructField("row_no", LongType()), StructField("config", StringType())) if f.name not in schema.names]])
    correct = files.read_jsonl(spark, f"{a.scoring_dir}/correctness", keyed(schemas.CORRECTNESS))
    faithful = files.read_jsonl(spark, f"{a.scoring_dir}/faithfulness", keyed(schemas.FAITHFULNESS))
    report.write_markdown(
        f"{a.out_dir}/buckets.md",
        "Buckets",
        _write_buckets(scoring.joined_axes(correct, faithful), a),
    )


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    runs = _runs(spark, a.runs_dir, a.configs)
    correct = scoring.correctness_rows(runs, absent_is_parsed=True)
    files.write_jsonl(correct, f"{a.out_dir}/correctness")
    faithful = _faithful(spark, a, runs)
    tables = {
        "correctness": scoring.class_metrics(scoring.confusion(correct)).orderBy("config"),
        "faithfulness": scoring.faithfulness_summary(faithful).orderBy("config"),
        **_write_buckets(scoring.joined_axes(correct, faithful), a),
    }
    report.write_markdown(f"{a.out_dir}/summary.md", "Scoring", tables)


def cleanup(spark: SparkSession, a: argparse.Namespace) -> None:
    """Cut descriptions at their markers and drop rows, by a file of ``markers`` (id to text) and ``drop`` (ids); what couldn't be cut stands in the report."""
    plan = files.read_config(a.plan)
    markers = spark.createDataFrame(list(plan.get("markers", {}).items()), "id string, marker string")
    done = redact.cut_at_markers(_rows(spark, a.source), markers, list(plan.get("drop", [])))
    files.write_jsonl(done.drop("row_no", "outcome"), a.out)
    if a.report:
        report.write_markdown(
            a.report,
            "Clean-up",
            {"outcomes": done.groupBy("outcome").count().orderBy(F.desc("count"), "outcome")},
        )


def make_report(spark: SparkSession, a: argparse.Namespace) -> None:
    runs = _runs(spark, a.runs_dir)
    correct = scoring.correctness_rows(runs, absent_is_parsed=True)
    joined = scoring.joined_axes(correct, scoring.faithfulness_rows(runs))
    cases = scoring.report_cases(joined, runs, _rows(spark, a.test_set), a.max_cases)
    report.write_html(
        a.out,
        "Evaluation",
        {
            "Correctness": scoring.class_metrics(scoring.confusion(correct)).orderBy("config"),
            "Buckets": scoring.bucket_matrix(joined).orderBy("config", "bucket"),
            "Divergent cases": cases,
        },
    )


def synthetic(spark: SparkSession, a: argparse.Namespace) -> None:
    files.write_jsonl(fixtures.synthetic_runs(_rows(spark, a.test_set)).drop("row_no"), a.out, by=["config"])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline")
    subs = top.add_subparsers(required=True)

    def command(name: str, run, *arguments: tuple) -> None:
        sub = subs.add_parser(name)
        sub.set_defaults(run=run)
        for names, options in arguments:
            sub.add_argument(*names.split(), **options)

    source, out, test_set, chunks = ("source", {}), ("out", {}), ("--test-set", {"required": True}), (
        "--chunks",
        {"required": True},
    )
    configs, runs_dir, out_dir, config_file = ("--configs", {"nargs": "*"}), ("--runs-dir", {"required": True}), (
        "--out-dir",
        {"required": True},
    ), ("--config-file", {})
    encoder, threshold = ("--encoder", {"choices": sorted(encoders.ENCODERS)}), (
        "--faithful-threshold",
        {"type": float, "default": 0.5},
    )
    command("build-corpus", build_corpus, source, out)
    command("embed-index", embed_index, chunks, out, encoder)
    command("search", search, ("query", {}), chunks, ("--top-k", {"type": int, "default": 5}), encoder, config_file)
    command("extract", extract, source, out)
    command("check", check, source, out)
    command("cleanup", cleanup, source, ("plan", {}), out, ("--report", {}))
    command("redact", redact_rows, source, out, ("--diff", {}))
    command("retrieval-eval", retrieval_eval, test_set, chunks, out, encoder, config_file)
    model = [
        ("--provider", {"choices": sorted(generation.MODELS)}),
        ("--model", {}),
        ("--base-url", {}),
        ("--api-key-env", {}),
        ("--max-tokens", {"type": int}),
        ("--project", {}),
        ("--workers", {"type": int}),
        ("--region", {}),
        encoder,
        config_file,
    ]
    wanted = [
        configs,
        ("--rows", {"nargs": "*"}),
        ("--limit", {"type": int}),
        ("--resume", {"action": "store_true"}),
        ("--retry-errors", {"action": "store_true"}),
    ]
    command("generate", generate, test_set, chunks, out, *wanted, *model)
    command("sanity-run", sanity_run, test_set, chunks, out, ("--n-each", {"type": int, "default": 3}), *wanted, *model)
    judge = [
        ("--judge", {"default": "stub", "choices": sorted([*generation.JUDGES, "stub"])}),
        ("--judge-model", {}),
        ("--judge-base-url", {}),
        ("--judge-api-key-env", {}),
        ("--judge-max-tokens", {"type": int}),
        ("--workers", {"type": int}),
        ("--test-set", {}),
    ]
    command("correctness", correctness, runs_dir, out_dir, configs)
    command("faithfulness", faithfulness, runs_dir, out_dir, configs, *judge)
    command("buckets", buckets, ("--scoring-dir", {"required": True}), out_dir, threshold)
    command("score", score, runs_dir, out_dir, configs, threshold, *judge)
    command("report", make_report, runs_dir, test_set, out, ("--max-cases", {"type": int, "default": 12}))
    command("synthetic-runs", synthetic, test_set, out)
    return top


def main(arguments: Sequence[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(local_session(), a)


if __name__ == "__main__":
    main()
