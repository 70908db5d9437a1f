"""Queries of projections over the corpus and the runs: index metadata, headings, sections, hits, review files; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import area_of, clauses, collapsed, escaped, governing_section, heading_path, passages, redaction_sentences, statements, stripped, top_section
from plumbline.operators import redact, scoring, segment
from plumbline.plans.quality_queries import SQL as QUALITY
from plumbline.plans.sql import AREA, EXAMPLES, SPACE, TOP, flat, trimmed
from plumbline.session import table


def index_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a vector collection holds beside the vectors: '' for null."""
    return table(spark, sf_dir, "corpus_chunks").select(
        "row_no",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("section", "annex_iii_area", "para_num", "heading_path")],
    )


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("section")
    return table(spark, sf_dir, "corpus_chunks").select(
        "row_no",
        top_section(s).alias("top"),
        area_of(s).alias("area"),
        heading_path(s, collapsed(F.col("section_title"))).alias("path"),
    )


def kept_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the kept parts that are long enough and hold no worked examples, by top section."""
    kept = segment.normative(F.col("section"), collapsed(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "corpus_chunks").where(kept).groupBy(top_section(F.col("section")).alias("top")).agg(
        F.count("*").alias("n")
    )


def hit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of every run, one row each, with rank, and whether the logged ids have them at the same place."""
    runs = table(spark, sf_dir, "runs").select(
        "row_no",
        "retrieved_top10_ids",
        F.posexplode("retrieved_top5").alias("i", "hit"),
    )
    return runs.select(
        "row_no",
        (F.col("i") + 1).alias("rank"),
        F.col("hit.id").alias("id"),
        F.round("hit.score", 6).alias("score"),
        F.coalesce(F.get("retrieved_top10_ids", F.col("i")) == F.col("hit.id"), F.lit(False)).alias("logged"),
    )


def judge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "runs").select("row_no", passages(F.col("retrieved_top5")).alias("context"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each description by the three ways of splitting."""
    t = stripped(F.coalesce("system_description", F.lit("")))
    return table(spark, sf_dir, "test_set").select(
        "row_no",
        F.size(redaction_sentences(t)).alias("n_redaction"),
        F.size(statements(t)).alias("n_statements"),
        F.size(clauses(t)).alias("n_clauses"),
    )


def review_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the redaction's review file; its seventh column is for the reviewer."""
    out = redact.redacted(table(spark, sf_dir, "test_set"))
    return out.select(
        "row_no",
        "id",
        F.col("label").alias("gold_label"),
        "edge_case_type",
        "redaction",
        F.col("system_description_original").alias("original"),
        F.col("system_description").alias("redacted"),
        F.lit(None).cast("string").alias("your_check"),
    )


def escaped_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations as a report shows them: escaped, then cut."""
    return table(spark, sf_dir, "runs").select(
        "row_no",
        F.substring(escaped(F.coalesce("explanation", F.lit(""))), 1, 300).alias("shown"),
    )


def label_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "test_set").select("row_no", governing_section(F.col("label_source")).alias("section"))


def stored_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stored rows agree with the correctness computed from the runs."""
    computed = scoring.correctness_rows(table(spark, sf_dir, "runs")).select(
        "row_no",
        F.col("correct").alias("computed"),
        F.col("parse_ok").alias("computed_ok"),
    )
    joined = computed.join(table(spark, sf_dir, "correctness"), "row_no")
    agrees = F.col("computed").eqNullSafe(F.col("correct")) & F.col("computed_ok").eqNullSafe(F.col("parse_ok"))
    return joined.groupBy("config", agrees.alias("agrees")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        index_metadata, headings, kept_sections, hit_projection, judge_context, sentence_counts, review_file,
        escaped_explanations, label_sources, stored_correctness,
    )
}

_T = trimmed("coalesce(system_description, '')")


def _parts(pattern: str) -> str:
    return f"string_split(regexp_replace({_T}, '{pattern}', 'g'), chr(1))"


SQL = {
    "index_metadata": """SELECT row_no, coalesce(section, '') AS section, coalesce(annex_iii_area, '') AS
        annex_iii_area, coalesce(para_num, '') AS para_num, coalesce(heading_path, '') AS heading_path FROM
        corpus_chunks""",
    "headings": f"""SELECT row_no, {TOP} AS top, {AREA} AS area, CASE WHEN coalesce(section, '') <> '' THEN
        {trimmed(f"CASE WHEN starts_with(section, '2') THEN 'General principles' ELSE coalesce({AREA}, 'Annex III') END || ' | ' || section || ' ' || coalesce({flat('section_title')}, '')")}
        END AS path FROM corpus_chunks""",
    "kept_sections": f"""SELECT {TOP} AS top, count(*) AS n FROM corpus_chunks WHERE string_split(section, '.')[1] IN
        ('2', '3') AND length({flat("coalesce(text, '')")}) >= 25 AND NOT regexp_matches({flat("coalesce(text, '')")},
        '{EXAMPLES}') GROUP BY 1""",
    "review_file": f"""SELECT t.row_no, id, label AS gold_label, edge_case_type, redaction, t.system_description AS original, r.system_description AS redacted, NULL::VARCHAR AS your_check FROM test_set t JOIN ({QUALITY["redact_sentences"]}) r ON r.row_no = t.row_no""",
    "hit_projection": """SELECT row_no, i::INT AS rank, retrieved_top5[i].id AS id, round(retrieved_top5[i].score, 6)
        AS score, coalesce(retrieved_top10_ids[i] = retrieved_top5[i].id, false) AS logged FROM (SELECT *,
        unnest(range(1, len(retrieved_top5) + 1)) AS i FROM runs)""",
    "judge_context": """SELECT row_no, coalesce(array_to_string(list_transform(range(1, len(retrieved_top5) + 1),
        lambda i: '[Passage ' || i || ']' || chr(10) || coalesce(retrieved_top5[i].text, '')), chr(10) || chr(10)), '')
        AS context FROM runs""",
    "sentence_counts": f"""SELECT row_no, len({_parts(f"([.;]){SPACE}+([A-Z(])', '\\1' || chr(1) || '\\2")})::INT AS
        n_redaction, len(list_filter({_parts(f"([.!?]){SPACE}+', '\\1' || chr(1) || '")}, lambda x: {trimmed('x')} <>
        ''))::INT AS n_statements, len({_parts(f"([.;:]){SPACE}+', '\\1' || chr(1) || '")})::INT AS n_clauses FROM
        test_set""",
    "escaped_explanations": """SELECT row_no, substr(replace(replace(replace(replace(replace(coalesce(explanation,
        ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), 1, 300) AS shown FROM runs""",
    "label_sources": """SELECT row_no, nullif(regexp_extract(coalesce(label_source, ''),
        '(?i)section\\s+([0-9]+(?:\\.[0-9]+)+)', 1), '') AS section FROM test_set""",
    "stored_correctness": """SELECT c.config, coalesce(r.pred_label = r.gold_label, false) IS NOT DISTINCT FROM
        c.correct AND coalesce(r.parse_ok, false) IS NOT DISTINCT FROM c.parse_ok AS agrees, count(*) AS n FROM runs r
        JOIN correctness c USING (row_no) GROUP BY 1, 2""",
}
