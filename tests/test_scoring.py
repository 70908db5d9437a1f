import pytest
from pyspark.sql import functions as F

from plumbline.functions.labels import parsed_reply
from plumbline.operators import scoring
from plumbline.sources.fixtures import synthetic_runs

RUN = "row_no long, id string, config string, gold_label string, pred_label string, explanation string, parse_ok boolean, edge_case_type string, annex_iii_area string, retrieved_top5 array<struct<id:string,text:string,score:double>>, raw string, usage struct<input_tokens:int,output_tokens:int,error:string>"
H, N = "high-risk", "not-high-risk"
HIT = [("c1", "Some passage.", 0.5)]


def run(
    row_no, id="a", config="agent_structured", gold=H, pred=H, explanation="One. Two.", parse_ok=True, edge="none",
    area="x", hits=HIT,
):
    return (row_no, id, config, gold, pred, explanation, parse_ok, edge, area, hits, "{}", None)


def runs(spark, *rows):
    return spark.createDataFrame(list(rows), RUN)


def test_null_prediction_counts_as_wrong_and_not_positive(spark):
    rows = scoring.correctness_rows(runs(spark, run(1, gold=N, pred=None), run(2, gold=H, pred=None)))
    c = scoring.confusion(rows).first()
    assert (c.tn, c.fn, c.tp, c.fp, c.n_correct, c.n_parse_fail) == (1, 1, 0, 0, 0, 2)


@pytest.mark.parametrize(
    ("counts", "published"),
    [
        ((59, 60, 7, 89), (0.688, 0.496, 0.894, 0.638, 0.682)),
        ((57, 17, 9, 132), (0.879, 0.770, 0.864, 0.814, 0.862)),
        ((57, 22, 9, 127), (0.856, 0.722, 0.864, 0.786, 0.839)),
    ],
)
def test_published_metrics_follow_from_their_counts(spark, counts, published):
    tp, fp, fn, tn = counts
    pairs = [(H, H)] * tp + [(N, H)] * fp + [(H, N)] * fn + [(N, N)] * tn
    rows = scoring.correctness_rows(runs(spark, *[run(i, str(i), gold=g, pred=p) for i, (g, p) in enumerate(pairs)]))
    m = scoring.class_metrics(scoring.confusion(rows)).first()
    assert tuple(round(x, 3) for x in (m.accuracy, m.hr_precision, m.hr_recall, m.hr_f1, m.macro_f1)) == published


def test_null_parse_ok_is_false_unless_it_means_absent(spark):
    source = runs(spark, run(1, parse_ok=None), run(2, pred=None, parse_ok=None))
    assert [r.parse_ok for r in scoring.correctness_rows(source).orderBy("row_no").collect()] == [False, False]
    assert [
        r.parse_ok for r in scoring.correctness_rows(source, absent_is_parsed=True).orderBy("row_no").collect()
    ] == [True, False]


def test_undefined_ratios_are_zero_and_no_rows_give_no_groups(spark):
    rows = scoring.correctness_rows(runs(spark, run(1, gold=N, pred=N)))
    assert scoring.class_metrics(scoring.confusion(rows)).first().hr_f1 == 0.0
    empty = scoring.correctness_rows(runs(spark))
    assert scoring.class_metrics(scoring.confusion(empty)).count() == 0
    assert scoring.bucket_sweep(scoring.joined_axes(empty, scoring.faithfulness_rows(runs(spark)))).count() == 0


def test_context_is_missed_before_the_explanation(spark):
    faith = scoring.faithfulness_rows(
        runs(
            spark,
            run(1, explanation="", hits=[]),
            run(2, "b", explanation="  "),
            run(3, "c", explanation=None),
            run(4, "d", config="baseline1_plain_llm"),
        )
    )
    assert {r.row_no: r.skipped_reason for r in faith.collect()} == {
        1: "no-retrieved-context",
        2: "no-explanation",
        3: "no-explanation",
    }


def test_markers_decide_the_stub(spark):
    text = "A [[SUPPORTED]]. B [[SUPPORTED]]. C [[SUPPORTED]]. D [[UNSUPPORTED]]."
    r = scoring.faithfulness_rows(runs(spark, run(1, explanation=text))).first()
    assert (r.faithfulness, r.n_statements, r.n_supported) == (0.75, 4, 3)


def test_last_row_of_a_key_wins_and_threshold_is_inclusive(spark):
    source = runs(
        spark,
        run(1, pred=N, explanation="A [[SUPPORTED]]."),
        run(5, explanation="A [[SUPPORTED]]. B [[UNSUPPORTED]]."),
    )
    joined = scoring.joined_axes(scoring.correctness_rows(source), scoring.faithfulness_rows(source))
    rows = scoring.bucket_rows(joined).collect()
    assert [(r.bucket, r.pos) for r in rows] == [("right_faithful", 1)]


def test_sweep_adds_up_and_falls_with_the_threshold(spark):
    source = synthetic_runs(
        spark.range(1, 121).select(
            F.col("id").alias("row_no"),
            F.concat(F.lit("r"), "id").alias("id"),
            F.when(F.col("id") % 3 == 0, H).otherwise(N).alias("label"),
            F.lit("none").alias("edge_case_type"),
            F.lit("x").alias("annex_iii_area"),
        )
    )
    joined = scoring.joined_axes(scoring.correctness_rows(source), scoring.faithfulness_rows(source))
    n = scoring.scored(joined).groupBy("config").count().collect()
    sweep = scoring.bucket_sweep(joined).collect()
    for config, total in n:
        by = {t: sum(r.n for r in sweep if r.config == config and r.threshold == t) for t in scoring.THRESHOLDS}
        assert set(by.values()) == {total}
        faithful = [
            sum(r.n for r in sweep if r.config == config and r.threshold == t and r.bucket.endswith("_faithful"))
            for t in scoring.THRESHOLDS
        ]
        assert faithful == sorted(faithful, reverse=True)
    assert {round(r.faithfulness, 2) for r in scoring.scored(joined).collect()} == {0.25, 0.75}


def test_correlation_without_variance_is_null(spark):
    source = runs(spark, run(1, "a", explanation="A [[SUPPORTED]]."), run(2, "b", explanation="A [[UNSUPPORTED]]."))
    joined = scoring.joined_axes(scoring.correctness_rows(source), scoring.faithfulness_rows(source))
    assert scoring.point_biserial(joined).first().point_biserial is None
    assert scoring.auc(joined).first().auc is None


def test_mcnemar_of_the_published_counts():
    assert scoring.mcnemar_p(5, 10) == pytest.approx(0.3018, abs=1e-4)
    assert scoring.mcnemar_p(0, 0) == 1.0


@pytest.mark.parametrize(
    ("raw", "label", "ok"),
    [
        ("I think high-risk", H, False),
        ("not high-risk", N, False),
        ('{"label":"maybe high-risk"}', H, True),
        ('{"label":"high-risk"} {"label":"x"}', H, False),
        ('{"label": " High-Risk ", "explanation": "e"}', H, True),
        ('{"label": 3}', None, False),
        ("", None, False),
        (None, None, False),
        ('{"label": "unclear"}', None, False),
    ],
)
def test_replies(spark, raw, label, ok):
    r = spark.createDataFrame([(raw,)], "raw string").select(parsed_reply(F.col("raw")).alias("p")).first().p
    assert (r.label, r.parse_ok) == (label, ok)


def test_report_cases_put_wrong_but_faithful_first(spark):
    source = runs(
        spark,
        run(1, "a", explanation="A [[UNSUPPORTED]]."),
        run(2, "b", pred=N, explanation="A [[SUPPORTED]]."),
    )
    joined = scoring.joined_axes(scoring.correctness_rows(source), scoring.faithfulness_rows(source))
    described = spark.createDataFrame(
        [("b", 1, "old"), ("b", 2, "new")],
        "id string, row_no long, system_description string",
    )
    cases = {r.id: (r.bucket, r.description) for r in scoring.report_cases(joined, source, described).collect()}
    assert cases == {"b": ("wrong_faithful", "new"), "a": ("right_unfaithful", "")}
    assert scoring.report_cases(joined, source, described, max_cases=1).first().id == "b"
