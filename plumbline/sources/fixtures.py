"""Deterministic synthetic runs for tests of the scoring: hashes of the row instead of a random generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIGS = ("baseline1_plain_llm", "baseline2_standard_rag", "agent_structured")


def _percent(salt: str) -> Column:
    """0 to 99 from the row, the configuration and a salt, the same in every engine that has md5."""
    digest = F.substring(
        F.md5(F.concat_ws("|", F.col("row_no").cast("string"), F.col("config"), F.lit(salt)).cast("binary")),
        1,
        8,
    )
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(100)).cast("int")


def synthetic_runs(rows: DataFrame) -> DataFrame:
    """A run per row and configuration: a quarter of the labels flipped, three tenths unfaithful, one in sixty fails to parse; the first
    configuration has no passages. Explanations carry markers that fix the stub's verdicts to 0.75 or 0.25."""
    crossed = rows.select("row_no", "id", "label", "edge_case_type", "annex_iii_area").withColumn(
        "config",
        F.explode(F.array(*[F.lit(c) for c in CONFIGS])),
    )
    fails, flipped, unfaithful = F.pmod("row_no", F.lit(60)) == 0, _percent("flip") < 25, _percent("faith") < 30
    other = F.when(F.col("label") == "high-risk", "not-high-risk").otherwise("high-risk")
    pred = F.when(~fails, F.when(flipped, other).otherwise(F.col("label")))
    area = F.coalesce("annex_iii_area", F.lit("unknown"))
    good = [
        F.concat(F.lit("The purpose lies in the area "), area, F.lit(" [[SUPPORTED]].")),
        F.lit("The passages describe that area [[SUPPORTED]]."),
        F.concat(F.lit("The label is "), pred, F.lit(" [[SUPPORTED]].")),
    ]
    bad = [
        F.lit("An outside body audited the system [[UNSUPPORTED]]."),
        F.lit("Similar systems were fined [[UNSUPPORTED]]."),
        F.lit("The vendor reports few errors [[UNSUPPORTED]]."),
    ]
    text = F.when(unfaithful, F.concat_ws(" ", good[0], *bad)).otherwise(F.concat_ws(" ", *good, bad[0]))
    explanation = F.when(fails, "").when(F.col("config") == CONFIGS[0], "A short reason.").otherwise(text)
    hit = F.struct(
        F.concat(area, F.lit("-chunk-1")).alias("id"),
        F.concat(F.lit("Systems in the area "), area, F.lit(" are assessed on this route.")).alias("text"),
        (_percent("score") / 100.0).alias("score"),
    )
    hits = F.when(
        F.col("config") == CONFIGS[0],
        F.array().cast("array<struct<id:string,text:string,score:double>>"),
    ).otherwise(F.array(hit))
    raw = F.when(fails, "malformed text without an object").otherwise(
        F.to_json(F.struct(pred.alias("label"), explanation.alias("explanation")))
    )
    return crossed.select(
        "row_no",
        "id",
        "config",
        F.col("label").alias("gold_label"),
        pred.alias("pred_label"),
        explanation.alias("explanation"),
        (~fails).alias("parse_ok"),
        "edge_case_type",
        "annex_iii_area",
        hits.alias("retrieved_top5"),
        F.transform(hits, lambda h: h["id"]).alias("retrieved_top10_ids"),
        raw.alias("raw"),
    )
