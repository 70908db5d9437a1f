"""Queries of prompts, run records and judges over the runs, with a model and a judge that answer by rule; with SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import generation
from plumbline.plans.sql import SPACE, quoted, trimmed
from plumbline.session import table


class WordJudge:
    """Answers as a judging model would, by rule: every sentence is a statement, supported when it has the word 'system'; reasons are null, and one in five numbers of
    statements gets a reply without JSON."""

    def complete(self, system: str, user: str) -> tuple[str, dict]:
        if user.startswith("Question:"):
            return "no JSON here", {}
        claims = [c.partition(". ")[2] for c in re.split(r"\n(?=\d+\. )", user.partition("\n\nStatements:\n")[2])]
        if len(claims) % 5 == 4:
            return "nor here", {}
        return "Verdicts: " + json.dumps(
            {
                "verdicts": [
                    {"statement": c + " ", "verdict": "yes" if "system" in c else 0, "reason": None} for c in claims
                ]
            }
        ), {}


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs as rows to be run again: the last description of their id, their label, and the passages they had, whose ids stand for headings."""
    runs = generation.with_questions(table(spark, sf_dir, "runs"), table(spark, sf_dir, "test_set"))
    hits = F.transform(
        "retrieved_top5",
        lambda h: F.struct(
            h["id"].alias("id"),
            h["text"].alias("text"),
            h["id"].alias("heading_path"),
            h["score"].alias("score"),
        ),
    )
    return runs.select(
        "row_no",
        "id",
        "config",
        F.col("gold_label").alias("label"),
        F.col("question").alias("system_description"),
        hits.alias("hits"),
        "edge_case_type",
        "annex_iii_area",
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of every run."""
    return generation.with_prompts(_asked(spark, sf_dir)).select("row_no", "config", "system", "user")


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run again, by the model that answers from a hash of the prompt."""
    runs = generation.generate(
        generation.with_prompts(_asked(spark, sf_dir).where("config is not null")),
        generation.StubModel(),
    )
    return runs.select(
        "row_no",
        "id",
        "config",
        "gold_label",
        "pred_label",
        "explanation",
        "parse_ok",
        F.size("retrieved_top5").alias("n_hits"),
        F.array_join("retrieved_top10_ids", ",").alias("ids"),
        F.col("usage.output_tokens").alias("output_tokens"),
        F.col("usage.error").alias("error"),
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faithfulness of every run by a judging model, matched statement by statement."""
    rows = generation.judged_runs(
        table(spark, sf_dir, "runs"),
        table(spark, sf_dir, "test_set"),
        generation.Judge(WordJudge()),
    )
    failed = F.exists("statements", lambda v: v["reason"] == "judge-parse-failed")
    return rows.select(
        "row_no",
        "id",
        "config",
        F.round("faithfulness", 6).alias("faithfulness"),
        "skipped_reason",
        "n_statements",
        "n_supported",
        F.coalesce(failed, F.lit(False)).alias("judge_failed"),
        "judge",
        "error",
    )


def config_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two configurations over the rows of named ids, the first twenty of these in row order."""
    ids = [f"anx3-{i:03d}" for i in range(1, 40)]
    rows = table(spark, sf_dir, "test_set").select("row_no", "id")
    return generation.config_cross(rows, ["agent_structured", "baseline1_plain_llm"], ids, 20).select(
        "row_no",
        "id",
        "config",
    )


QUERIES = {"prompts": prompts, "run_records": run_records, "judged_runs": judged, "config_subset": config_subset}

_CASES = lambda values: "CASE config " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in values.items()) + " END"
_PROMPTS = f"""last AS (SELECT id, max_by(coalesce(system_description, ''), row_no) AS question FROM test_set GROUP BY
    id),
asked AS (SELECT row_no, r.id, config, gold_label, retrieved_top5 AS hits, coalesce(question, '') AS question FROM runs
  r LEFT JOIN last ON last.id = r.id),
lists AS (SELECT *, coalesce(array_to_string(list_transform(range(1, len(hits) + 1), lambda i: '[Passage ' || i || ']'
  || CASE WHEN coalesce(hits[i].id, '') <> '' THEN ' [' || hits[i].id || ']' ELSE '' END || chr(10) ||
  coalesce(hits[i].text, '')), chr(10) || chr(10)), '') AS passages FROM asked),
prompts AS (SELECT *, {_CASES(generation.SYSTEM)} AS system, CASE WHEN config IN
  ({', '.join(quoted(c) for c in generation.CONFIGS)}) THEN CASE WHEN config IN
  ({', '.join(quoted(c) for c, r in generation.CONFIGS.items() if r)}) THEN
  {quoted(generation.PASSAGES)} || passages || chr(10) || chr(10) ELSE '' END || {quoted(generation.DESCRIPTION)} ||
    question || {_CASES(generation.ENDING)} END AS user FROM lists)"""
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(explanation, '([.!?]){SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {trimmed('x')}), lambda x: x <> '')"
SQL = {
    "prompts": f"WITH {_PROMPTS} SELECT row_no, config, system, user FROM prompts",
    "run_records": f"""WITH {_PROMPTS}, labels AS (SELECT *, CASE WHEN ('0x' || substr(sha1(user), 1, 2))::INT % 3 = 0
        THEN 'high-risk' ELSE 'not-high-risk' END AS pred_label FROM prompts WHERE user IS NOT NULL)
      SELECT row_no, id, config, gold_label, pred_label, 'The description leads to ' || pred_label || '.' AS
        explanation, true AS parse_ok, len(hits)::INT AS n_hits, array_to_string(list_transform(hits, lambda h: h.id),
        ',') AS ids, 8 AS output_tokens, NULL::VARCHAR AS error FROM labels""",
    "judged_runs": f"""WITH ctx AS (SELECT row_no, id, config, len(retrieved_top5) > 0 AS has,
        {trimmed("coalesce(explanation, '')")} AS explanation FROM runs),
      s AS (SELECT *, {_SENTENCES} AS parts FROM ctx), r AS (SELECT *, CASE WHEN NOT coalesce(has, false) THEN
        'no-retrieved-context' WHEN explanation = '' THEN 'no-explanation' WHEN len(parts) = 0 THEN
        'no-statements-extracted' END AS skipped_reason FROM s),
      j AS (SELECT row_no, id, config, skipped_reason, CASE WHEN skipped_reason IS NULL THEN len(parts) ELSE 0 END::INT
        AS n_statements, skipped_reason IS NULL AND len(parts) % 5 = 4 AS judge_failed,
        CASE WHEN skipped_reason IS NULL AND len(parts) % 5 <> 4 THEN len(list_filter(parts, lambda p: contains(p,
          'system'))) ELSE 0 END::INT AS n_supported FROM r)
      SELECT *, CASE WHEN n_statements > 0 THEN round(n_supported::DOUBLE / n_statements, 6) END AS faithfulness, 'llm'
        AS judge, NULL::VARCHAR AS error FROM j""",
    "config_subset": """SELECT row_no, id, c.config FROM (SELECT row_no, id FROM test_set WHERE id IN (SELECT printf('anx3-%03d', i) FROM (SELECT unnest(range(1, 40)) AS i)) ORDER BY row_no LIMIT 20), (SELECT unnest(['agent_structured', 'baseline1_plain_llm']) AS config) c""",
}
