"""Queries of correctness, faithfulness and the buckets over the runs, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.labels import parsed_reply
from plumbline.operators import generation, scoring
from plumbline.operators.common import count_where
from plumbline.plans.sql import SPACE, trimmed
from plumbline.session import table
from plumbline.sources import fixtures


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "runs")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.correctness_rows(_runs(spark, sf_dir))


def _faith(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.faithfulness_rows(_runs(spark, sf_dir))


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.joined_axes(_rows(spark, sf_dir), _faith(spark, sf_dir))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def json_label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("row_no", parsed_reply(F.col("raw")).alias("p")).select(
        "row_no",
        F.col("p.label").alias("label"),
        F.col("p.parse_ok").alias("parse_ok"),
    )


def config_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.config_cross(table(spark, sf_dir, "test_set").select("row_no", "id")).select(
        "row_no",
        "id",
        "config",
    )


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row and configuration pairs that no run has yet."""
    done = _runs(spark, sf_dir).select("id", "config").distinct()
    return config_cross(spark, sf_dir).join(done, ["id", "config"], "left_anti").select("row_no", "id", "config")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.stratified_sample(table(spark, sf_dir, "test_set"))


def sample_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.sample_tally(_runs(spark, sf_dir), stratified_sample(spark, sf_dir))


def leak_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = table(spark, sf_dir, "test_set").where(F.coalesce("notes", F.lit("")) != "").select("id")
    return _rounded(scoring.leak_split(_rows(spark, sf_dir), flagged), "accuracy")


def synthetic_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fabricated runs through all of the scoring: faithfulness is 0.75 or 0.25 by construction."""
    runs = fixtures.synthetic_runs(table(spark, sf_dir, "test_set"))
    faith = scoring.faithfulness_rows(runs)
    return faith.groupBy("config", "skipped_reason").agg(
        F.count("*").alias("n"),
        count_where(F.col("faithfulness") == 0.75).alias("n_three_quarters"),
        count_where(F.col("faithfulness") == 0.25).alias("n_one_quarter"),
    )


def report_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.report_cases(
        _joined(spark, sf_dir),
        _runs(spark, sf_dir),
        table(spark, sf_dir, "test_set"),
    ).withColumn("faithfulness", F.round("faithfulness", 6))


QUERIES = {
    "correctness_rows": _rows,
    "confusion": lambda s, d: scoring.confusion(_rows(s, d)),
    "class_metrics": lambda s, d: _rounded(
        scoring.class_metrics(scoring.confusion(_rows(s, d))),
        "accuracy",
        "hr_precision",
        "hr_recall",
        "hr_f1",
        "nhr_precision",
        "nhr_recall",
        "nhr_f1",
        "macro_f1",
    ),
    "slice_accuracy_edge": lambda s, d: _rounded(
        scoring.slice_accuracy(_rows(s, d), "edge_case_type", True),
        "accuracy",
    ),
    "slice_accuracy_area": lambda s, d: _rounded(scoring.slice_accuracy(_rows(s, d), "area", False), "accuracy"),
    "pred_distribution": lambda s, d: scoring.distribution(_rows(s, d), "pred"),
    "gold_distribution": lambda s, d: scoring.distribution(_rows(s, d), "gold"),
    "run_checks": lambda s, d: scoring.run_checks(_runs(s, d)),
    "json_label_parse": json_label_parse,
    "config_cross": config_cross,
    "resume_antijoin": resume_antijoin,
    "stratified_sample": stratified_sample,
    "sample_tally": sample_tally,
    "leak_split": leak_split,
    "area_composition": lambda s, d: scoring.area_composition(table(s, d, "test_set")),
    "faith_rows": lambda s, d: _rounded(_faith(s, d).drop("statements", "judge"), "faithfulness"),
    "faith_statements": lambda s, d: _faith(s, d).select("row_no", F.posexplode("statements").alias("i", "v")).select(
        "row_no",
        "i",
        F.col("v.statement").alias("statement"),
        F.col("v.verdict").alias("verdict"),
    ),
    "faith_summary": lambda s, d: _rounded(
        scoring.faithfulness_summary(_faith(s, d)),
        "mean_faithfulness",
        "min_faithfulness",
        "max_faithfulness",
    ),
    "skip_reasons": lambda s, d: scoring.skip_reasons(_faith(s, d)),
    "bucket_rows": lambda s, d: scoring.bucket_rows(_joined(s, d)).select(
        "config", "id", "gold", "pred", "correct", "n_statements", "n_supported", "bucket", "pos",
    ),
    "bucket_matrix": lambda s, d: scoring.bucket_matrix(_joined(s, d)),
    "bucket_sweep": lambda s, d: scoring.bucket_sweep(_joined(s, d)),
    "off_diagonal": lambda s, d: scoring.off_diagonal(_joined(s, d)).select(
        "config",
        "id",
        "bucket",
        "n_statements",
        "n_supported",
    ),
    "unscored": lambda s, d: scoring.unscored(_joined(s, d)).select("config", "id", "skipped_reason"),
    "faith_means": lambda s, d: _rounded(scoring.faithfulness_means(_joined(s, d)), "mean_right", "mean_wrong"),
    "point_biserial": lambda s, d: _rounded(scoring.point_biserial(_joined(s, d)), "point_biserial"),
    "pass_as_faithful": lambda s, d: _rounded(scoring.pass_as_faithful(_joined(s, d)), "pass_share"),
    "report_cases": report_cases,
    "synthetic_buckets": synthetic_buckets,
    "ext_auc": lambda s, d: _rounded(scoring.auc(_joined(s, d)), "auc"),
    "ext_mcnemar": lambda s, d: scoring.discordant_pairs(_rows(s, d), "agent_structured", "baseline2_standard_rag"),
    "ext_bootstrap": lambda s, d: _rounded(scoring.bootstrap_accuracy(_rows(s, d)), "low", "high"),
}

_CORRECT = """corr AS (SELECT row_no, id, config, gold_label AS gold, pred_label AS pred, coalesce(parse_ok, false) AS
    parse_ok,
  coalesce(pred_label = gold_label, false) AS correct, edge_case_type, annex_iii_area AS area FROM runs)"""
_COUNTS = _CORRECT + """, counts AS (SELECT config, count(*) AS n, count(*) FILTER (gold IS NOT DISTINCT FROM
    'high-risk' AND pred IS NOT DISTINCT FROM 'high-risk') AS tp,
  count(*) FILTER (gold IS DISTINCT FROM 'high-risk' AND pred IS NOT DISTINCT FROM 'high-risk') AS fp, count(*) FILTER
    (gold IS NOT DISTINCT FROM 'high-risk' AND pred IS DISTINCT FROM 'high-risk') AS fn,
  count(*) FILTER (gold IS DISTINCT FROM 'high-risk' AND pred IS DISTINCT FROM 'high-risk') AS tn, count(*) FILTER
    (correct) AS n_correct, count(*) FILTER (NOT parse_ok OR pred IS NULL) AS n_parse_fail FROM corr GROUP BY config)"""
_PARTS = f"""list_filter(list_transform(string_split(regexp_replace(explanation, '([.!?]){SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {trimmed('x')}), lambda x: x <> '')"""
_FAITH = f"""ctx AS (SELECT row_no, id, config, coalesce(array_to_string(list_transform(range(1, len(retrieved_top5) +
    1), lambda i: '[Passage ' || i || ']' || chr(10) || coalesce(retrieved_top5[i].text, '')), chr(10) || chr(10)), '')
    AS context,
  {trimmed("coalesce(explanation, '')")} AS explanation FROM runs WHERE config IS NULL OR config <>
    'baseline1_plain_llm'),
split AS (SELECT *, CASE WHEN context = '' THEN 'no-retrieved-context' WHEN explanation = '' THEN 'no-explanation' WHEN
  len({_PARTS}) = 0 THEN 'no-statements-extracted' END AS skipped_reason, {_PARTS} AS parts FROM ctx),
judged AS (SELECT row_no, id, config, skipped_reason, CASE WHEN skipped_reason IS NULL THEN list_transform(parts, lambda
  s: {{'statement': s, 'verdict': CASE WHEN contains(s, '[[UNSUPPORTED]]') THEN 0 WHEN contains(s, '[[SUPPORTED]]') THEN
  1
  WHEN ('0x' || substr(sha1(s || '||' || substr(context, 1, 200)), 1, 2))::INT % 100 < 70 THEN 1 ELSE 0 END}}) ELSE []
    END AS vs FROM split),
faith AS (SELECT row_no, id, config, skipped_reason, len(vs)::INT AS n_statements, coalesce(list_sum(list_transform(vs,
  lambda v: v.verdict)), 0)::INT AS n_supported,
  CASE WHEN len(vs) > 0 THEN list_sum(list_transform(vs, lambda v: v.verdict))::DOUBLE / len(vs) END AS faithfulness
    FROM judged)"""
_JOINED = f"""{_CORRECT}, {_FAITH},
c AS (SELECT config, id, min(row_no) AS pos, max_by(gold, row_no) AS gold0, max(row_no) AS last FROM corr GROUP BY
  config, id),
f AS (SELECT config, id, max(row_no) AS last FROM faith GROUP BY config, id),
joined AS (SELECT c.config, c.id, c.pos, corr.gold, corr.pred, corr.correct, corr.edge_case_type, corr.area,
  faith.faithfulness, faith.skipped_reason, faith.n_statements, faith.n_supported
  FROM c JOIN corr ON corr.row_no = c.last JOIN f ON f.config = c.config AND f.id = c.id JOIN faith ON faith.row_no =
    f.last),
buckets AS (SELECT *, CASE WHEN correct THEN 'right' ELSE 'wrong' END || CASE WHEN faithfulness >= 0.5 THEN '_faithful'
  ELSE '_unfaithful' END AS bucket FROM joined WHERE faithfulness IS NOT NULL),
sweep AS (SELECT config, t.threshold, b.bucket, count(*) FILTER (CASE WHEN correct THEN 'right' ELSE 'wrong' END || CASE
  WHEN faithfulness >= t.threshold THEN '_faithful' ELSE '_unfaithful' END = b.bucket) AS n
  FROM buckets, (SELECT unnest([0.3::DOUBLE, 0.5, 0.7, 0.9, 1.0]) AS threshold) t, (SELECT unnest(['right_faithful',
    'right_unfaithful', 'wrong_faithful', 'wrong_unfaithful']) AS bucket) b GROUP BY 1, 2, 3)"""
_SAFE = lambda a, b: f"(CASE WHEN ({b}) = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END)"
_HP, _HR, _NP, _NR = _SAFE("tp", "tp + fp"), _SAFE("tp", "tp + fn"), _SAFE("tn", "tn + fn"), _SAFE("tn", "tn + fp")
_HF, _NF = _SAFE(f"2 * {_HP} * {_HR}", f"{_HP} + {_HR}"), _SAFE(f"2 * {_NP} * {_NR}", f"{_NP} + {_NR}")
_OBJECT = "regexp_extract(coalesce(raw, ''), '(?s)\\{.*\\}', 0)"
_SAMPLE = """sample AS (
  (SELECT 'high-risk' AS stratum, min(row_no) AS row_no FROM test_set WHERE label = 'high-risk' GROUP BY annex_iii_area
    ORDER BY 2 LIMIT 3)
  UNION ALL (SELECT 'not-high-risk', row_no FROM test_set WHERE label = 'not-high-risk' AND edge_case_type = 'none'
    ORDER BY 2 LIMIT 3)
  UNION ALL (SELECT 'filter', row_no FROM test_set WHERE edge_case_type = 'article-6-3-filter' ORDER BY 2 LIMIT 3))"""
_CROSS = """crossed AS (SELECT row_no, id, c.config FROM test_set, (SELECT unnest(['baseline1_plain_llm',
    'baseline2_standard_rag', 'agent_structured']) AS config) c)"""
_PERCENT = "('0x' || substr(md5(row_no || '|' || config || '|{}'), 1, 8))::BIGINT % 100"
_POISSON = "((v >= 24109)::INT + (v >= 48219)::INT + (v >= 60273)::INT + (v >= 64291)::INT + (v >= 65296)::INT + (v >= 65497)::INT + (v >= 65530)::INT + (v >= 65535)::INT)"

SQL = {
    "correctness_rows": f"WITH {_CORRECT} SELECT * FROM corr",
    "confusion": f"WITH {_COUNTS} SELECT * FROM counts",
    "class_metrics": f"""WITH {_COUNTS} SELECT config, n, n_parse_fail, round({_SAFE('n_correct', 'n')}, 6) AS accuracy,
        round({_HP}, 6) AS hr_precision, round({_HR}, 6) AS hr_recall, round({_HF}, 6) AS hr_f1,
      round({_NP}, 6) AS nhr_precision, round({_NR}, 6) AS nhr_recall, round({_NF}, 6) AS nhr_f1, round(({_HF} + {_NF})
        / 2, 6) AS macro_f1 FROM counts""",
    "slice_accuracy_edge": f"""WITH {_CORRECT} SELECT config, edge_case_type, count(*) AS n, round(avg(correct::INT),
        6) AS accuracy FROM corr GROUP BY 1, 2""",
    "slice_accuracy_area": f"""WITH {_CORRECT} SELECT config, area, count(*) AS n, round(avg(correct::INT), 6) AS
        accuracy FROM corr WHERE area IS NOT NULL GROUP BY 1, 2""",
    "pred_distribution": "SELECT config, coalesce(pred_label, 'null') AS value, count(*) AS n FROM runs GROUP BY 1, 2",
    "gold_distribution": "SELECT config, coalesce(gold_label, 'null') AS value, count(*) AS n FROM runs GROUP BY 1, 2",
    "run_checks": f"""SELECT config, count(*) AS n, count(*) FILTER (NOT coalesce(parse_ok, false)) AS n_parse_fail,
        count(*) FILTER (usage.error IS NOT NULL) AS n_call_error, count(*) FILTER ({trimmed("coalesce(raw, '')")} = '')
        AS n_blank_raw FROM runs GROUP BY config""",
    "json_label_parse": f"""WITH o AS (SELECT row_no, coalesce(raw, '') AS raw, {_OBJECT} AS obj FROM runs),
      j AS (SELECT row_no, raw, coalesce(json_valid(obj), false) AS ok, CASE WHEN json_valid(obj) THEN
        lower({trimmed("json_extract_string(obj, '$.label')")}) END AS label FROM o),
      l AS (SELECT row_no, ok, CASE WHEN label IN ('high-risk', 'not-high-risk') THEN label WHEN contains(lower(raw),
        'not-high-risk') OR contains(lower(raw), 'not high-risk') THEN 'not-high-risk' WHEN contains(lower(raw),
        'high-risk') THEN 'high-risk' END AS label FROM j)
      SELECT row_no, label, ok AND label IS NOT NULL AS parse_ok FROM l""",
    "config_cross": f"WITH {_CROSS} SELECT * FROM crossed",
    "resume_antijoin": f"""WITH {_CROSS} SELECT * FROM crossed c WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.id =
        c.id AND r.config = c.config)""",
    "stratified_sample": f"""WITH {_SAMPLE} SELECT stratum, t.row_no, id, annex_iii_area, label, edge_case_type FROM
        sample s JOIN test_set t ON s.row_no = t.row_no""",
    "sample_tally": f"""WITH {_SAMPLE}, ids AS (SELECT DISTINCT id FROM sample s JOIN test_set t ON s.row_no =
        t.row_no) SELECT config, count(*) AS n, count(*) FILTER (pred_label = gold_label) AS n_right FROM runs JOIN ids
        USING (id) GROUP BY config""",
    "leak_split": f"""WITH {_CORRECT}, flags AS (SELECT DISTINCT id FROM test_set WHERE coalesce(notes, '') <> '' AND
        id IS NOT NULL) SELECT config, flags.id IS NOT NULL AS leaks, count(*) AS n, round(avg(correct::INT), 6) AS
        accuracy FROM corr LEFT JOIN flags ON corr.id = flags.id GROUP BY 1, 2""",
    "area_composition": """SELECT annex_iii_area, count(*) FILTER (label IS NOT DISTINCT FROM 'high-risk') AS
        n_high_risk, count(*) FILTER (label IS DISTINCT FROM 'high-risk' AND edge_case_type IS NOT DISTINCT FROM
        'article-6-3-filter') AS n_filter, count(*) FILTER (label IS DISTINCT FROM 'high-risk' AND edge_case_type IS
        DISTINCT FROM 'article-6-3-filter') AS n_other FROM test_set GROUP BY 1""",
    "faith_rows": f"""WITH {_FAITH} SELECT row_no, id, config, round(faithfulness, 6) AS faithfulness, skipped_reason,
        n_statements, n_supported FROM faith""",
    "faith_statements": f"""WITH {_FAITH} SELECT row_no, (i - 1)::INT AS i, vs[i].statement AS statement, vs[i].verdict
        AS verdict FROM (SELECT row_no, vs, unnest(range(1, len(vs) + 1)) AS i FROM judged)""",
    "faith_summary": f"""WITH {_FAITH} SELECT config, count(*) AS n, count(faithfulness) AS n_scored, count(*) -
        count(faithfulness) AS n_skipped, round(avg(faithfulness), 6) AS mean_faithfulness, round(min(faithfulness), 6)
        AS min_faithfulness, round(max(faithfulness), 6) AS max_faithfulness, count(*) FILTER (faithfulness = 1) AS
        n_fully_faithful, count(*) FILTER (faithfulness = 0) AS n_zero_faithful, 0::BIGINT AS n_judge_parse_failed FROM
        faith GROUP BY config""",
    "skip_reasons": f"""WITH {_FAITH} SELECT config, skipped_reason, count(*) AS n FROM faith WHERE skipped_reason IS
        NOT NULL GROUP BY 1, 2""",
    "bucket_rows": f"""WITH {_JOINED} SELECT config, id, gold, pred, correct, n_statements, n_supported, bucket, pos
        FROM buckets""",
    "bucket_matrix": f"WITH {_JOINED} SELECT config, bucket, n FROM sweep WHERE threshold = 0.5",
    "bucket_sweep": f"WITH {_JOINED} SELECT config, threshold, bucket, n FROM sweep",
    "off_diagonal": f"""WITH {_JOINED} SELECT config, id, bucket, n_statements, n_supported FROM buckets WHERE bucket
        IN ('wrong_faithful', 'right_unfaithful')""",
    "unscored": f"WITH {_JOINED} SELECT config, id, skipped_reason FROM joined WHERE faithfulness IS NULL",
    "faith_means": f"""WITH {_JOINED} SELECT config, count(*) AS n_scored, round(avg(faithfulness) FILTER (correct), 6)
        AS mean_right, round(avg(faithfulness) FILTER (NOT correct), 6) AS mean_wrong FROM buckets GROUP BY config""",
    "point_biserial": f"""WITH {_JOINED}, s AS (SELECT config, count(*) AS n_scored, covar_pop(correct::INT,
        faithfulness) AS c, stddev_pop(correct::INT) AS sx, stddev_pop(faithfulness) AS sy FROM buckets GROUP BY config)
        SELECT config, n_scored, round(CASE WHEN n_scored >= 2 AND sx > 0 AND sy > 0 THEN c / (sx * sy) END, 6) AS
        point_biserial FROM s""",
    "pass_as_faithful": f"""WITH {_JOINED}, w AS (SELECT config, threshold, sum(n) FILTER (bucket =
        'wrong_faithful')::BIGINT AS n_wrong_faithful, sum(n) FILTER (bucket LIKE 'wrong%')::BIGINT AS n_wrong FROM
        sweep GROUP BY 1, 2) SELECT *, round({_SAFE('n_wrong_faithful', 'n_wrong')}, 6) AS pass_share FROM w""",
    "report_cases": f"""WITH {_JOINED}, top AS (SELECT * FROM buckets WHERE bucket IN ('wrong_faithful',
        'right_unfaithful') ORDER BY CASE WHEN bucket = 'wrong_faithful' THEN 0 ELSE 1 END, faithfulness DESC,
      CASE config WHEN 'agent_structured' THEN 1 WHEN 'baseline1_plain_llm' THEN 2 WHEN 'baseline2_standard_rag' THEN 3
        ELSE 4 END, config, pos LIMIT 12),
      e AS (SELECT config, id, max_by(coalesce(explanation, ''), row_no) AS explanation FROM runs GROUP BY 1, 2), d AS
        (SELECT id, max_by(coalesce(system_description, ''), row_no) AS description FROM test_set GROUP BY 1)
      SELECT top.config, top.id, bucket, gold, pred, round(faithfulness, 6) AS faithfulness, pos, coalesce(description,
        '') AS description, coalesce(explanation, '') AS explanation FROM top LEFT JOIN e ON e.config = top.config AND
        e.id = top.id LEFT JOIN d ON d.id = top.id""",
    "ext_auc": f"""WITH {_JOINED}, v AS (SELECT config, faithfulness, count(*) FILTER (correct) AS p, count(*) AS n FROM
        buckets GROUP BY 1, 2),
      r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY config ORDER BY faithfulness ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS mid FROM v),
      s AS (SELECT config, sum(p * mid)::DOUBLE AS ranks, sum(p)::BIGINT AS pos, sum(n - p)::BIGINT AS neg FROM r GROUP
        BY config) SELECT config, pos, neg, round(CASE WHEN pos > 0 AND neg > 0 THEN (ranks - pos * (pos + 1) / 2.0) /
        (pos * neg) END, 6) AS auc FROM s""",
    "ext_mcnemar": f"""WITH {_CORRECT}, last AS (SELECT config, id, max_by(correct, row_no) AS correct FROM corr GROUP
        BY 1, 2), s AS (SELECT id, bool_or(correct) FILTER (config = 'agent_structured') AS a, bool_or(correct) FILTER
        (config = 'baseline2_standard_rag') AS b FROM last GROUP BY id)
      SELECT count(*) AS n_pairs, count(*) FILTER (a AND NOT b) AS only_one, count(*) FILTER (NOT a AND b) AS only_two
        FROM s WHERE a IS NOT NULL AND b IS NOT NULL""",
    "synthetic_buckets": f"""WITH x AS (SELECT row_no, label, coalesce(annex_iii_area, 'unknown') AS area, c.config FROM
        test_set, (SELECT unnest(['baseline1_plain_llm', 'baseline2_standard_rag', 'agent_structured']) AS config) c
        WHERE c.config <> 'baseline1_plain_llm'),
      y AS (SELECT config, row_no % 60 = 0 AS fails, {_PERCENT.format('faith')} < 30 AS unfaithful, CASE WHEN
        {_PERCENT.format('flip')} < 25 THEN '' ELSE label END AS pred FROM x),
      z AS (SELECT config, CASE WHEN fails THEN 'no-explanation' END AS skipped_reason, CASE WHEN fails THEN NULL WHEN
        unfaithful THEN 0.25 WHEN pred IS NULL THEN 0.6666 ELSE 0.75 END AS f FROM y)
      SELECT config, skipped_reason, count(*) AS n, count(*) FILTER (f = 0.75) AS n_three_quarters, count(*) FILTER (f =
        0.25) AS n_one_quarter FROM z GROUP BY 1, 2""",
    "ext_bootstrap": f"""WITH {_CORRECT}, d AS (SELECT config, correct::INT AS c, g, md5(row_no || '|' || config || '|'
        || g) AS d FROM corr, (SELECT unnest(range(250)) AS g) WHERE config IS NOT NULL),
      w AS (SELECT config, c, g * 8 + i AS k, ('0x' || substr(d, (4 * i + 1)::INT, 4))::INT AS v FROM d, (SELECT
        unnest(range(8)) AS i)),
      a AS (SELECT config, k, sum({_POISSON} * c)::DOUBLE / sum({_POISSON}) AS accuracy FROM w GROUP BY 1, 2), o AS
        (SELECT config, list_sort(list(accuracy)) AS a FROM a GROUP BY config)
      SELECT config, round(a[51], 6) AS low, round(a[1951], 6) AS high FROM o""",
}
