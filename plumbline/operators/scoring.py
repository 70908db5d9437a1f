"""Correctness, faithfulness, and both joined into four buckets.

Null predictions count as wrong and, in the confusion counts, as not positive. Runs are keyed by (``config``, ``id``); where one side holds a key twice, its last
row by ``row_no`` counts. Empty inputs give no groups; overall rows aren't made up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import passages, statements, stripped
from plumbline.operators.common import count_where, latest, share

POSITIVE, NEGATIVE = "high-risk", "not-high-risk"
THRESHOLDS = (0.3, 0.5, 0.7, 0.9, 1.0)
BUCKETS = ("right_faithful", "right_unfaithful", "wrong_faithful", "wrong_unfaithful")
NO_RETRIEVAL = ("baseline1_plain_llm",)
CONFIG_ORDER = ("agent_structured", "baseline1_plain_llm", "baseline2_standard_rag")


def correctness_rows(runs: DataFrame, absent_is_parsed: bool = False) -> DataFrame:
    """A null ``parse_ok`` is false. Where nulls stand for an absent field, ``absent_is_parsed`` takes a row with a prediction as parsed."""
    unknown = F.col("pred_label").isNotNull() if absent_is_parsed else F.lit(False)
    return runs.select(
        "row_no",
        "id",
        "config",
        F.col("gold_label").alias("gold"),
        F.col("pred_label").alias("pred"),
        F.coalesce("parse_ok", unknown).alias("parse_ok"),
        F.coalesce(F.col("pred_label") == F.col("gold_label"), F.lit(False)).alias("correct"),
        "edge_case_type",
        F.col("annex_iii_area").alias("area"),
    )


def confusion(rows: DataFrame, by: Sequence[str] = ("config",)) -> DataFrame:
    positive, predicted = F.col("gold").eqNullSafe(POSITIVE), F.col("pred").eqNullSafe(POSITIVE)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        count_where(positive & predicted).alias("tp"),
        count_where(~positive & predicted).alias("fp"),
        count_where(positive & ~predicted).alias("fn"),
        count_where(~positive & ~predicted).alias("tn"),
        count_where(F.col("correct")).alias("n_correct"),
        count_where(~F.col("parse_ok") | F.col("pred").isNull()).alias("n_parse_fail"),
    )


def class_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of both classes from ``confusion``, macro-F1 and accuracy; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def f1(p: Column, r: Column) -> Column:
        return share(2 * p * r, p + r)

    hp, hr, np_, nr = share(tp, tp + fp), share(tp, tp + fn), share(tn, tn + fn), share(tn, tn + fp)
    return counts.select(
        *[c for c in counts.columns if c not in {"tp", "fp", "fn", "tn", "n_correct"}],
        share(F.col("n_correct"), F.col("n")).alias("accuracy"),
        hp.alias("hr_precision"),
        hr.alias("hr_recall"),
        f1(hp, hr).alias("hr_f1"),
        np_.alias("nhr_precision"),
        nr.alias("nhr_recall"),
        f1(np_, nr).alias("nhr_f1"),
        ((f1(hp, hr) + f1(np_, nr)) / 2).alias("macro_f1"),
    )


def slice_accuracy(rows: DataFrame, column: str, keep_null: bool) -> DataFrame:
    source = rows if keep_null else rows.where(F.col(column).isNotNull())
    return source.groupBy("config", column).agg(
        F.count("*").alias("n"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
    )


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy("config", F.coalesce(column, F.lit("null")).alias("value")).agg(F.count("*").alias("n"))


def stub_verdicts(statement_array: Column, context: Column, support_rate: float = 0.7) -> Column:
    """Verdicts without a model: markers decide, else a hash of statement and context start; for tests of the plumbing."""
    key, limit = F.substring(context, 1, 200), round(support_rate * 100)

    def one(s: Column) -> Column:
        bucket = F.conv(
            F.substring(F.sha1(F.concat(s, F.lit("||"), key).cast("binary")), 1, 2),
            16,
            10,
        ).cast("int") % 100
        verdict = F.when(s.contains("[[UNSUPPORTED]]"), 0).when(
            s.contains("[[SUPPORTED]]"),
            1,
        ).when(bucket < limit, 1).otherwise(0)
        marked = s.contains("[[UNSUPPORTED]]") | s.contains("[[SUPPORTED]]")
        return F.struct(
            s.alias("statement"),
            verdict.alias("verdict"),
            F.when(marked, "stub-marker").otherwise("stub").alias("reason"),
        )

    return F.transform(statement_array, one)


def faithfulness_rows(runs: DataFrame, skip_configs: Sequence[str] = NO_RETRIEVAL, judge: str = "stub") -> DataFrame:
    """A row per run of the configurations with retrieval. The missing context is looked at before the missing explanation. Built-in functions only, no shuffle."""
    source = runs.where(F.col("config").isNull() | ~F.col("config").isin(*skip_configs)) if skip_configs else runs
    explanation = stripped(F.coalesce("explanation", F.lit("")))
    read = source.select(
        "row_no",
        "id",
        "config",
        passages(F.col("retrieved_top5")).alias("context"),
        explanation.alias("explanation"),
    )
    split = read.withColumn("parts", statements(F.col("explanation")))
    skipped = F.when(F.col("context") == "", "no-retrieved-context").when(
        F.col("explanation") == "",
        "no-explanation",
    ).when(F.size("parts") == 0, "no-statements-extracted")
    scored = split.withColumn("skipped_reason", skipped).withColumn(
        "statements",
        F.when(F.col("skipped_reason").isNull(), stub_verdicts(F.col("parts"), F.col("context"))).otherwise(
            F.slice(stub_verdicts(F.col("parts"), F.col("context")), 1, 0)
        ),
    )
    supported = F.aggregate("statements", F.lit(0), lambda acc, v: acc + v["verdict"])
    return scored.select(
        "row_no",
        "id",
        "config",
        F.try_divide(supported.cast("double"), F.size("statements").cast("double")).alias("faithfulness"),
        "skipped_reason",
        F.size("statements").alias("n_statements"),
        supported.alias("n_supported"),
        "statements",
        F.lit(judge).alias("judge"),
    )


def faithfulness_summary(rows: DataFrame) -> DataFrame:
    f = F.col("faithfulness")
    return rows.groupBy("config").agg(
        F.count("*").alias("n"),
        F.count(f).alias("n_scored"),
        count_where(f.isNull()).alias("n_skipped"),
        F.avg(f).alias("mean_faithfulness"),
        F.min(f).alias("min_faithfulness"),
        F.max(f).alias("max_faithfulness"),
        count_where(f == 1.0).alias("n_fully_faithful"),
        count_where(f == 0.0).alias("n_zero_faithful"),
        count_where(F.exists("statements", lambda v: v["reason"] == "judge-parse-failed")).alias(
            "n_judge_parse_failed"
        ),
    )


def skip_reasons(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce("skipped_reason", F.lit("")) != "").groupBy("config", "skipped_reason").agg(
        F.count("*").alias("n")
    )


def joined_axes(correctness: DataFrame, faithfulness: DataFrame) -> DataFrame:
    """Both axes by (``config``, ``id``), with the first place of the key in ``pos``. The keys of each side are made unique before the join."""
    left = latest(
        correctness.select("config", "id", "row_no", "gold", "pred", "correct", "edge_case_type", "area"),
        ["config", "id"],
        "row_no",
        "pos",
    ).drop("row_no")
    right = latest(
        faithfulness.select("config", "id", "row_no", "faithfulness", "skipped_reason", "n_statements", "n_supported"),
        ["config", "id"],
        "row_no",
    ).drop("row_no")
    return left.join(right, ["config", "id"])


def scored(joined: DataFrame) -> DataFrame:
    return joined.where("faithfulness is not null").drop("skipped_reason")


def unscored(joined: DataFrame) -> DataFrame:
    return joined.where("faithfulness is null")


def bucket_of(correct: Column, faithful: Column) -> Column:
    return F.concat(
        F.when(correct, "right").otherwise("wrong"),
        F.lit("_"),
        F.when(faithful, "faithful").otherwise("unfaithful"),
    )


def bucket_rows(joined: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored(joined).withColumn("bucket", bucket_of(F.col("correct"), F.col("faithfulness") >= threshold))


def off_diagonal(joined: DataFrame, threshold: float = 0.5) -> DataFrame:
    return bucket_rows(joined, threshold).where(F.col("bucket").isin("wrong_faithful", "right_unfaithful"))


def bucket_sweep(joined: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(``config``, ``threshold``, ``bucket``, ``n``) with zeros, from one aggregation of the rows over all thresholds."""
    counts = [
        count_where(bucket_of(F.col("correct"), F.col("faithfulness") >= t).eqNullSafe(b)).alias(f"{i}_{b}")
        for i, t in enumerate(thresholds) for b in BUCKETS
    ]
    wide = scored(joined).groupBy("config").agg(*counts)
    cells = F.array(
        *[
            F.struct(
                F.lit(t).cast("double").alias("threshold"),
                F.lit(b).alias("bucket"),
                F.col(f"`{i}_{b}`").alias("n"),
            )
            for i, t in enumerate(thresholds) for b in BUCKETS
        ]
    )
    return wide.select("config", F.inline(cells))


def bucket_matrix(joined: DataFrame, threshold: float = 0.5) -> DataFrame:
    return bucket_sweep(joined, (threshold,)).drop("threshold")


def faithfulness_means(joined: DataFrame) -> DataFrame:
    f = F.col("faithfulness")
    return scored(joined).groupBy("config").agg(
        F.count("*").alias("n_scored"),
        F.avg(F.when(F.col("correct"), f)).alias("mean_right"),
        F.avg(F.when(~F.col("correct"), f)).alias("mean_wrong"),
    )


def point_biserial(joined: DataFrame) -> DataFrame:
    """Correlation of being right with faithfulness; null under two rows or without variance on either side."""
    right, f = F.col("correct").cast("double"), F.col("faithfulness")
    agg = scored(joined).groupBy("config").agg(
        F.count("*").alias("n_scored"),
        F.covar_pop(right, f).alias("c"),
        F.stddev_pop(right).alias("sx"),
        F.stddev_pop(f).alias("sy"),
    )
    sound = (F.col("n_scored") >= 2) & (F.col("sx") > 0) & (F.col("sy") > 0)
    return agg.select(
        "config",
        "n_scored",
        F.when(sound, F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))).alias("point_biserial"),
    )


def pass_as_faithful(joined: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """The share of wrong answers that each threshold lets pass as faithful; 0 without wrong answers."""
    n = F.col("n")
    swept = bucket_sweep(joined, thresholds).groupBy("config", "threshold")
    cells = swept.agg(
        F.sum(F.when(F.col("bucket") == "wrong_faithful", n).otherwise(0)).alias("n_wrong_faithful"),
        F.sum(F.when(F.col("bucket").startswith("wrong"), n).otherwise(0)).alias("n_wrong"),
    )
    return cells.select(
        "config",
        "threshold",
        "n_wrong_faithful",
        "n_wrong",
        share(F.col("n_wrong_faithful"), F.col("n_wrong")).alias("pass_share"),
    )


def config_rank(c: Column, order: Sequence[str] = CONFIG_ORDER) -> Column:
    known = F.array_position(F.array(*[F.lit(x) for x in order]), c)
    return F.when(known > 0, known).otherwise(len(order) + 1)


def report_cases(
    joined: DataFrame,
    runs: DataFrame,
    descriptions: DataFrame,
    max_cases: int = 12,
    threshold: float = 0.5,
) -> DataFrame:
    """The first divergent cases: wrong but faithful before right but unfaithful, then by faithfulness; with description and explanation, the last of each key."""
    off = off_diagonal(joined, threshold)
    order = [
        F.when(F.col("bucket") == "wrong_faithful", 0).otherwise(1),
        F.desc("faithfulness"),
        config_rank(F.col("config")),
        F.col("config"),
        F.col("pos"),
    ]
    top = off.orderBy(*order).limit(max_cases)
    wanted = F.broadcast(top.select("config", "id").distinct())  # at most max_cases rows
    texts = latest(
        runs.select("config", "id", "row_no", "explanation").join(wanted, ["config", "id"]),
        ["config", "id"],
        "row_no",
    ).select("config", "id", "explanation")
    described = latest(
        descriptions.select("id", "row_no", "system_description").join(
            F.broadcast(wanted.select("id").distinct()),
            "id",
        ),
        ["id"],
        "row_no",
    ).select("id", "system_description")
    return top.join(F.broadcast(texts), ["config", "id"], "left").join(F.broadcast(described), "id", "left").select(
        "config", "id", "bucket", "gold", "pred", "faithfulness", "pos", F.coalesce("system_description", F.lit("")).alias("description"), F.coalesce("explanation", F.lit("")).alias("explanation")
    )


def area_composition(rows: DataFrame) -> DataFrame:
    """High-risk rows, filter cases and others of each area. A row counts once, a filter case as such when it isn't high-risk."""
    high, filtered = F.col("label").eqNullSafe(POSITIVE), F.col("edge_case_type").eqNullSafe("article-6-3-filter")
    return rows.groupBy("annex_iii_area").agg(
        count_where(high).alias("n_high_risk"),
        count_where(~high & filtered).alias("n_filter"),
        count_where(~high & ~filtered).alias("n_other"),
    )


def run_checks(runs: DataFrame) -> DataFrame:
    blank = stripped(F.coalesce("raw", F.lit(""))) == ""
    return runs.groupBy("config").agg(
        F.count("*").alias("n"), count_where(~F.coalesce("parse_ok", F.lit(False))).alias("n_parse_fail"), count_where(F.col("usage.error").isNotNull()).alias("n_call_error"), count_where(blank).alias("n_blank_raw")
    )


def leak_split(rows: DataFrame, flagged_ids: DataFrame) -> DataFrame:
    """Accuracy of rows whose id is in ``flagged_ids`` (``id``) and of the others."""
    flags = flagged_ids.select("id").where("id is not null").distinct().withColumn("flag", F.lit(True))
    marked = rows.join(flags, "id", "left").withColumn("leaks", F.coalesce("flag", F.lit(False)))
    return marked.groupBy("config", "leaks").agg(
        F.count("*").alias("n"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
    )


def auc(joined: DataFrame) -> DataFrame:
    """Extension: area under the curve of faithfulness as a detector of right answers, from mid-ranks; null when one side is missing.

    Faithfulness takes few values, so the ranks come from counts by value, not from a sort of all rows.
    """
    by_value = scored(joined).groupBy("config", "faithfulness").agg(
        count_where(F.col("correct")).alias("p"),
        F.count("*").alias("n"),
    )
    upto = Window.partitionBy("config").orderBy("faithfulness").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_value.withColumn("below", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    mid = F.col("below") + (F.col("n") + 1) / 2.0
    sums = ranked.groupBy("config").agg(
        F.sum(F.col("p") * mid).alias("ranks"),
        F.sum("p").alias("pos"),
        F.sum(F.col("n") - F.col("p")).alias("neg"),
    )
    return sums.select(
        "config",
        "pos",
        "neg",
        F.try_divide(
            F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2.0,
            (F.col("pos") * F.col("neg")).cast("double"),
        ).alias("auc"),
    )


def discordant_pairs(rows: DataFrame, one: str, two: str) -> DataFrame:
    """Extension: rows that only one of two configurations has right, with the z-free exact test left to ``mcnemar_p``."""
    last = latest(
        rows.where(F.col("config").isin(one, two)).select("config", "id", "row_no", "correct"),
        ["config", "id"],
        "row_no",
    )
    sides = last.groupBy("id").agg(
        F.max(F.when(F.col("config") == one, F.col("correct"))).alias("a"),
        F.max(F.when(F.col("config") == two, F.col("correct"))).alias("b"),
    )
    return sides.where("a is not null and b is not null").agg(
        F.count("*").alias("n_pairs"),
        count_where(F.col("a") & ~F.col("b")).alias("only_one"),
        count_where(~F.col("a") & F.col("b")).alias("only_two"),
    )


def mcnemar_p(only_one: int, only_two: int) -> float:
    """Exact two-sided p of the discordant counts."""
    from math import comb

    n, k = only_one + only_two, min(only_one, only_two)
    return 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)


def bootstrap_accuracy(rows: DataFrame, resamples: int = 2000) -> DataFrame:
    """Extension: a 95 % interval of accuracy from Poisson-weighted resamples; weights come from a digest of row and resample, so reruns and other engines agree.

    A digest of 128 bits serves eight resamples. Each row becomes one record for every eight, summed before the shuffle into ``resamples`` pairs of sums a configuration.
    """
    digest = F.md5(
        F.concat_ws("|", F.col("row_no").cast("string"), F.col("config"), F.col("g").cast("string")).cast("binary")
    )
    value = lambda i: F.conv(F.substring("d", 4 * i + 1, 4), 16, 10).cast("int")
    # The distribution function of a Poisson variable of mean 1, in parts of 65536.
    cdf = (24109, 48219, 60273, 64291, 65296, 65497, 65530, 65535)
    weight = lambda i: sum(((value(i) >= c).cast("int") for c in cdf), F.lit(0))
    groups = F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // 8) - 1)))
    drawn = rows.select(
        "config",
        "row_no",
        F.col("correct").cast("int").alias("c"),
        groups.alias("g"),
    ).withColumn("d", digest)
    sums = drawn.groupBy("config", "g").agg(
        *[F.sum(weight(i)).alias(f"n_{i}") for i in range(8)],
        *[F.sum(weight(i) * F.col("c")).alias(f"c_{i}") for i in range(8)],
    )
    each = F.explode(
        F.array(
            *[
                F.struct((F.col("g") * 8 + i).alias("k"), share(F.col(f"c_{i}"), F.col(f"n_{i}")).alias("accuracy"))
                for i in range(8)
            ]
        )
    )
    accuracies = sums.select("config", each.alias("x")).where(F.col("x.k") < resamples)
    at = lambda q: F.get("a", F.lit(min(resamples - 1, int(q * resamples))))
    return accuracies.groupBy("config").agg(F.sort_array(F.collect_list("x.accuracy")).alias("a")).select(
        "config",
        at(0.025).alias("low"),
        at(0.975).alias("high"),
    )
