"""Queries of the test set's checks, redaction and clean-up, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import LEGAL_WORDING, stripped, without_legal_wording
from plumbline.operators import quality, redact
from plumbline.plans.sql import SPACE, flat, trimmed
from plumbline.session import table


def _set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "test_set")


def _redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of a redaction by rule: rows ending in 7 have a reviewer's text, those in 3 an override; filter cases lose sentences on volunteers."""
    rows = _set(spark, sf_dir).withColumn("id", F.concat(F.lit("r"), F.col("row_no").cast("string")))
    ids = rows.select("id", "row_no")
    reviews = ids.where("row_no % 10 = 7").select(
        "id",
        F.concat(F.lit("Reviewed text of "), "id", F.lit(" should be classified as high-risk.")).alias("text"),
    )
    pair = lambda old, new: F.struct(F.lit(old).alias("old"), F.lit(new).alias("new"))
    strips = reviews.select(
        "id",
        F.array(
            pair(" should be classified as high-risk.", " is classified."),
            pair(" is classified.", "."),
        ).alias("pairs"),
    )
    overrides = ids.where("row_no % 10 = 3").select(
        "id",
        F.concat(F.lit("Text by hand of "), "id", F.lit(".")).alias("text"),
    )
    trims = rows.where("edge_case_type = 'article-6-3-filter'").select(
        "id",
        F.array(F.lit("volunteers")).alias("fragments"),
    )
    return redact.redacted(rows, reviews, overrides, trims, strips)


def redaction_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict redaction, which fails on a strip that isn't found and on a row that becomes empty; so every row that would has an override."""
    rows = _set(spark, sf_dir).withColumn("id", F.concat(F.lit("r"), F.col("row_no").cast("string")))
    blank = stripped(without_legal_wording(F.coalesce("system_description", F.lit("")))) == ""
    overrides = rows.where(blank).select("id", F.lit("A text by hand.").alias("text"))
    return redact.redacted(rows, overrides=overrides, strict=True).select("row_no", "system_description", "redaction")


def cut_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth row has a marker, every twenty-fifth is dropped."""
    rows = _set(spark, sf_dir).withColumn("id", F.concat(F.lit("r"), F.col("row_no").cast("string")))
    markers = rows.where("row_no % 4 = 0").select("id", F.lit(" Its operators").alias("marker"))
    dropped = rows.where("row_no % 25 = 0").select("id")
    return redact.cut_at_markers(rows, markers, dropped).select("row_no", "system_description", "outcome")


def cut_every_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row has a marker, none is dropped."""
    rows = _set(spark, sf_dir).withColumn("id", F.concat(F.lit("r"), F.col("row_no").cast("string")))
    markers = rows.select("id", F.lit(" Its operators").alias("marker"))
    return redact.cut_at_markers(rows, markers, []).select("row_no", "system_description", "outcome")


QUERIES = {
    "missing_fields": lambda s, d: quality.missing_fields(_set(s, d)),
    "exact_duplicates": lambda s, d: quality.exact_duplicates(_set(s, d)),
    "exact_duplicate_rows": lambda s, d: quality.exact_duplicate_rows(_set(s, d)),
    "similar_classes": lambda s, d: quality.similar_classes(_set(s, d)),
    "similar_pairs": lambda s, d: quality.similar_pairs(_set(s, d)).select(
        "row_a",
        "row_b",
        F.round("jaccard", 6).alias("jaccard"),
        quality.displayed(F.col("jaccard")).alias("shown"),
    ),
    "similar_links": lambda s, d: quality.similar_links(_set(s, d)),
    "length_outliers": lambda s, d: quality.length_outliers(_set(s, d)),
    "length_outliers_narrow": lambda s, d: quality.length_outliers(_set(s, d), 400, 200),
    "unterminated": lambda s, d: quality.unterminated(_set(s, d)),
    "label_against_mode": lambda s, d: quality.label_against_mode(_set(s, d), none_is_empty=True),
    "label_against_mode_any": lambda s, d: quality.label_against_mode(
        _set(s, d).withColumn("edge_case_type", F.when(F.pmod("row_no", F.lit(4)) == 0, F.col("edge_case_type")))
    ),
    "filter_case_labels": lambda s, d: quality.filter_case_labels(_set(s, d)),
    "label_vocabulary": lambda s, d: quality.label_vocabulary(_set(s, d)),
    "set_summary": lambda s, d: quality.set_summary(_set(s, d)),
    "corpus_statistics": lambda s, d: quality.corpus_statistics(table(s, d, "corpus_chunks")),
    "redact_sentences": lambda s, d: redact.redacted(_set(s, d)).select("row_no", "system_description", "redaction"),
    "redaction_precedence": lambda s, d: _redacted(s, d).select("row_no", "system_description", "redaction"),
    "redaction_strict": redaction_strict,
    "redaction_counts": lambda s, d: redact.redaction_counts(_redacted(s, d)),
    "cut_markers": cut_markers,
    "cut_every_marker": cut_every_marker,
}

_T = "coalesce(system_description, '')"
_LEGAL = LEGAL_WORDING.replace("(?iU)", "(?i)").replace("'", "''")


def _split(c: str) -> str:
    return f"string_split(regexp_replace({trimmed(c)}, '([.;]){SPACE}+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


_AUTO = f"array_to_string(list_filter({_split(_T)}, lambda s: NOT regexp_matches(s, '{_LEGAL}')), ' ')"
_PRECEDENCE = f"""auto AS (SELECT row_no, {_T} AS t, {_AUTO} AS a, edge_case_type FROM test_set),
trim AS (SELECT row_no, t, CASE WHEN edge_case_type = 'article-6-3-filter' THEN
  array_to_string(list_filter({_split('a')}, lambda s: NOT contains(s, 'volunteers')), ' ') ELSE a END AS a FROM auto),
red AS (SELECT row_no, CASE WHEN row_no % 10 = 7 THEN 'Reviewed text of r' || row_no || '.' WHEN row_no % 10 = 3 THEN
  'Text by hand of r' || row_no || '.' ELSE a END AS system_description,
  CASE WHEN row_no % 10 = 7 THEN 'reviewer' WHEN row_no % 10 = 3 THEN 'manual' WHEN a <> {trimmed('t')} THEN 'auto' ELSE
    'unchanged' END AS redaction FROM trim)"""
_WORDS = f"list_distinct(list_filter(string_split_regex(lower({_T}), '{SPACE}+'), lambda w: w <> ''))"
_REQUIRED = ("id", "source", "annex_iii_area", "annex_iii_point", "system_description", "label", "label_source")
_SIMILAR = f"""s AS (SELECT min(row_no) AS rep, ws FROM (SELECT row_no, list_sort({_WORDS}) AS ws FROM test_set) WHERE
    len(ws) > 0 GROUP BY ws),
  p AS (SELECT a.rep AS row_a, b.rep AS row_b, len(list_intersect(a.ws, b.ws)) AS i, len(a.ws) + len(b.ws) AS n FROM s a
    JOIN s b ON a.rep < b.rep), links AS (SELECT row_a, row_b, i::DOUBLE / (n - i) AS j FROM p WHERE i::DOUBLE / (n - i)
    >= 0.85::DOUBLE)"""
_OUTLIERS = f"""WITH l AS (SELECT row_no, id, length({_T})::INT AS n_chars FROM test_set), o AS (SELECT n_chars,
    row_number() OVER (ORDER BY n_chars) - 1 AS spot, count(*) OVER () AS n FROM l WHERE n_chars > 0),
  b AS (SELECT min(n_chars) FILTER (spot = greatest(floor(n * 0.05::DOUBLE) - 1, 0)) AS p5, min(n_chars) FILTER (spot =
    least(n - 1, floor(n * 0.95::DOUBLE))) AS p95 FROM o),
  k AS (SELECT row_no, id, n_chars, CASE WHEN n_chars > 0 AND n_chars < least(p5, {{short}}) THEN 'short' WHEN n_chars >
    greatest(p95, {{long}}) THEN 'long' END AS kind FROM l, b) SELECT * FROM k WHERE kind IS NOT NULL"""
_AGAINST = """WITH c AS (SELECT annex_iii_point, label, count(*) AS n, min(row_no) AS first FROM test_set WHERE
    coalesce(annex_iii_point, '') <> '' GROUP BY 1, 2),
  m AS (SELECT annex_iii_point, label AS modal_label FROM (SELECT *, row_number() OVER (PARTITION BY annex_iii_point
    ORDER BY n DESC, first) AS r, sum(n) OVER (PARTITION BY annex_iii_point) AS size FROM c) WHERE r = 1 AND size >= 3)
  SELECT row_no, id, annex_iii_point, label, modal_label FROM test_set JOIN m USING (annex_iii_point) WHERE
    coalesce({edge}, '') IN ({none}) AND label IS DISTINCT FROM modal_label"""

SQL = {
    "missing_fields": "WITH m AS (SELECT row_no, id, concat_ws(',', " + ", ".join(
        f"CASE WHEN coalesce({c}, '') = '' THEN '{c}' END" for c in _REQUIRED
    ) + ") AS missing FROM test_set) SELECT * FROM m WHERE missing <> ''",
    "exact_duplicates": f"""WITH t AS (SELECT row_no, {trimmed(_T)} AS t FROM test_set) SELECT count(*) AS n,
        min(row_no) AS first_row, max(row_no) AS last_row, substr(t, 1, 80) AS preview FROM t WHERE t <> '' GROUP BY t
        HAVING count(*) > 1""",
    "exact_duplicate_rows": f"""WITH t AS (SELECT row_no, id, {trimmed(_T)} AS t FROM test_set), g AS (SELECT *,
        count(*) OVER (PARTITION BY t) AS n, min(row_no) OVER (PARTITION BY t) AS first_row FROM t WHERE t <> '') SELECT
        row_no, id, first_row, n FROM g WHERE n > 1""",
    "similar_classes": f"""SELECT row_no, min(row_no) OVER (PARTITION BY ws) AS rep FROM (SELECT row_no,
        list_sort({_WORDS}) AS ws FROM test_set) WHERE len(ws) > 0""",
    "similar_pairs": f"""WITH {_SIMILAR} SELECT row_a, row_b, round(j, 6) AS jaccard, round_even(j, 2) AS shown FROM
        links""",
    "similar_links": f"""WITH {_SIMILAR}, n AS (SELECT rep, count(*) AS n FROM (SELECT row_a AS rep FROM links UNION ALL
        SELECT row_b FROM links) GROUP BY rep),
      c AS (SELECT row_no, min(row_no) OVER (PARTITION BY ws) AS rep FROM (SELECT row_no, list_sort({_WORDS}) AS ws FROM
        test_set) WHERE len(ws) > 0) SELECT row_no, rep, coalesce(n, 0) AS n_links FROM c LEFT JOIN n USING (rep)""",
    "length_outliers": _OUTLIERS.format(short=60, long=800),
    "length_outliers_narrow": _OUTLIERS.format(short=400, long=200),
    "unterminated": f"""WITH t AS (SELECT row_no, id, regexp_replace({_T}, '{SPACE}+$', '') AS t FROM test_set) SELECT row_no, id, right(t, 60) AS ending FROM t WHERE t <> '' AND right(t, 1) NOT IN ('.', '?', '!', '"', '''', ')', ']')""",
    "label_against_mode": _AGAINST.format(edge="edge_case_type", none="'', 'none'"),
    "label_against_mode_any": _AGAINST.format(edge="CASE WHEN row_no % 4 = 0 THEN edge_case_type END", none="''"),
    "filter_case_labels": f"""SELECT row_no, id, edge_case_type, label FROM test_set WHERE coalesce(edge_case_type, '')
        <> '' AND lower(coalesce(label, '')) IN ('high-risk', 'high_risk', 'highrisk', 'true', '1') AND
        {trimmed("coalesce(notes, '')")} = ''""",
    "label_vocabulary": f"""WITH l AS (SELECT row_no, id, label, lower({trimmed("coalesce(label, 'None')")}) AS v FROM
        test_set) SELECT row_no, id, label FROM l WHERE v <> '' AND v NOT IN ('high-risk', 'not-high-risk')""",
    "set_summary": """SELECT 'rows' AS level, 'all' AS value, count(*) AS n FROM test_set UNION ALL SELECT 'edge cases',
        'all', count(*) FILTER (coalesce(edge_case_type, '') <> '') FROM test_set
      UNION ALL SELECT 'area', coalesce(annex_iii_area, 'None'), count(*) FROM test_set GROUP BY 2 UNION ALL SELECT
        'label', lower(coalesce(label, 'None')), count(*) FROM test_set GROUP BY 2
      UNION ALL SELECT 'edge', coalesce(edge_case_type, 'None'), count(*) FROM test_set GROUP BY 2 UNION ALL SELECT
        'review reason', r, count(*) FROM (SELECT unnest(needs_review) AS r FROM test_set) GROUP BY 2""",
    "corpus_statistics": f"""WITH l AS (SELECT section, annex_iii_area, length({flat("coalesce(text, '')")})::INT AS len
        FROM corpus_chunks),
      e AS (SELECT 'overall' AS level, NULL AS value, len FROM l UNION ALL SELECT 'section', section, len FROM l UNION
        ALL SELECT 'area', annex_iii_area, len FROM l),
      o AS (SELECT *, row_number() OVER (PARTITION BY level, value ORDER BY len) - 1 AS spot, count(*) OVER (PARTITION
        BY level, value) AS n FROM e)
      SELECT level, value, count(*) AS n_chunks, min(len) AS min_len, min(len) FILTER (spot = n // 2) AS median_len,
        max(len) AS max_len, floor(sum(len) / count(*))::BIGINT AS mean_len, count(*) FILTER (len > 1800) AS n_over FROM
        o GROUP BY level, value""",
    "redact_sentences": f"""WITH r AS (SELECT row_no, {_T} AS t, {_AUTO} AS a FROM test_set) SELECT row_no, a AS
        system_description, CASE WHEN a <> {trimmed('t')} THEN 'auto' ELSE 'unchanged' END AS redaction FROM r""",
    "redaction_precedence": f"WITH {_PRECEDENCE} SELECT * FROM red",
    "redaction_strict": f"""WITH r AS (SELECT row_no, {_T} AS t, {_AUTO} AS a FROM test_set) SELECT row_no, CASE WHEN
        {trimmed('a')} = '' THEN 'A text by hand.' ELSE a END AS system_description, CASE WHEN {trimmed('a')} = '' THEN
        'manual' WHEN a <> {trimmed('t')} THEN 'auto' ELSE 'unchanged' END AS redaction FROM r""",
    "redaction_counts": f"WITH {_PRECEDENCE} SELECT redaction, count(*) AS n FROM red GROUP BY redaction",
    "cut_every_marker": f"""WITH r AS (SELECT row_no, system_description, instr({_T}, ' Its operators') AS spot,
        regexp_replace(substr({_T}, 1, greatest(instr({_T}, ' Its operators') - 1, 0)), '{SPACE}+$', '') AS head FROM
        test_set),
      o AS (SELECT *, CASE WHEN spot = 0 THEN 'marker not found' WHEN right(head, 1) IN ('.', '?', '!', ')') THEN
        'fixed' ELSE 'bad ending' END AS outcome FROM r)
      SELECT row_no, CASE WHEN outcome = 'fixed' THEN head ELSE system_description END AS system_description, outcome
        FROM o""",
    "cut_markers": f"""WITH r AS (SELECT row_no, system_description, instr({_T}, ' Its operators') AS spot,
        regexp_replace(substr({_T}, 1, greatest(instr({_T}, ' Its operators') - 1, 0)), '{SPACE}+$', '') AS head FROM
        test_set WHERE row_no % 25 <> 0),
      o AS (SELECT *, CASE WHEN row_no % 4 <> 0 THEN 'kept' WHEN spot = 0 THEN 'marker not found' WHEN right(head, 1) IN
        ('.', '?', '!', ')') THEN 'fixed' ELSE 'bad ending' END AS outcome FROM r)
      SELECT row_no, CASE WHEN outcome = 'fixed' THEN head ELSE system_description END AS system_description, outcome
        FROM o""",
}
