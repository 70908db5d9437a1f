"""Query of the general training-data operator: records that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import reject_load
from plumbline.operators.reject_load import FIELDS
from plumbline.plans.sql import trimmed
from plumbline.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_load.rejected(table(spark, sf_dir, "test_set_raw"), table(spark, sf_dir, "test_set"))


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_load.typed_rows(table(spark, sf_dir, "test_set_raw"), table(spark, sf_dir, "test_set"))


def p2_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failing rows with the kind of the line-level error and what settled the reason."""
    found = reject_load.rejects(table(spark, sf_dir, "test_set_raw"), table(spark, sf_dir, "test_set"))
    return found.select("origin", "row_no", "reason", "settled_by", F.substring_index("detail", ":", 1).alias("error"))


QUERIES = {"p2_found": p2_found, "p2_loaded": p2_loaded, "p2_rejects": p2_rejects}

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'


def _value(n: int) -> str:
    """The n-th field of a record whose quoting is sound."""
    plain = f"regexp_extract(raw_line, '^(?:{_FIELD},){{{n - 1}}}({_FIELD})', 1)"
    return f"""CASE WHEN {plain} LIKE '"%' THEN replace(substr({plain}, 2, length({plain}) - 2), '""', '"') ELSE {plain} END"""


_BAD_ID = f"NOT coalesce(regexp_matches({trimmed('id')}, '^anx3-[0-9]{{3,}}$'), false)"
_BAD_LABEL = f"NOT coalesce(lower({trimmed('label')}) IN ('high-risk', 'not-high-risk'), false)"
_REASONS = f"""
WITH read AS (
  SELECT row_no, NOT regexp_full_match(raw_line, '{_FIELD}(?:,{_FIELD})*') AS unsound,
         1 + length(regexp_replace(regexp_replace(raw_line, '"(?:[^"]|"")*"', '', 'g'), '[^,]', '', 'g')) AS n, received_at AS arrived_at, {", ".join(f"{_value(n)} AS {c}" for n, c in enumerate(FIELDS, 1))}
  FROM (SELECT row_no, received_at, coalesce(raw_line, '') AS raw_line FROM test_set_raw)
), reasons AS (
  SELECT 'test_set_raw' AS origin, row_no, CASE WHEN unsound THEN 'quoting' WHEN n <> 9 THEN 'column_count' WHEN
    {_BAD_ID} THEN 'bad_id' WHEN {_BAD_LABEL} THEN 'bad_label' END AS reason FROM read
  UNION ALL
  SELECT 'test_set', row_no, CASE WHEN {_BAD_ID} THEN 'bad_id' WHEN {_BAD_LABEL} THEN 'bad_label' END FROM test_set
)
"""
_CLEAN = lambda c: f"nullif({trimmed(c)}, '')"
_TYPED = ", ".join(f"lower({_CLEAN(c)}) AS {c}" if c == "label" else f"{_CLEAN(c)} AS {c}" for c in FIELDS)
_POINT = trimmed("annex_iii_point")
SQL = {
    "p2_found": _REASONS + "SELECT origin, row_no, reason FROM reasons WHERE reason IS NOT NULL",
    "p2_loaded": _REASONS.rstrip() + f""", every AS (SELECT 'test_set_raw' AS origin, row_no, {", ".join(FIELDS)},
        arrived_at FROM read UNION ALL SELECT 'test_set', row_no, {", ".join(FIELDS)}, loaded_at FROM test_set)
SELECT e.origin, e.row_no, {_TYPED}, CASE WHEN regexp_full_match({_POINT}, '[0-9]+(\\([a-z]\\))?') THEN
  regexp_extract({_POINT}, '^[0-9]+')::INT END AS point_number, nullif(regexp_extract({_POINT}, '^[0-9]+\\(([a-z])\\)$',
  1), '') AS point_letter, arrived_at
FROM every e JOIN reasons r ON r.origin = e.origin AND r.row_no = e.row_no WHERE reason IS NULL""",
    # The reject table has an error for every surplus or missing field, and for a quoted field that goes wrong; not for a quote within an unquoted one.
    "p2_rejects": _REASONS.rstrip()
    + f""", raw AS (SELECT row_no, raw_line, len(string_split(raw_line, chr(13))) > 1 AS apart FROM test_set_raw),
kinds AS (SELECT origin, row_no, reason, CASE WHEN origin = 'test_set' OR apart OR raw_line IS NULL THEN NULL
    WHEN reason = 'column_count' THEN CASE WHEN n > 9 THEN 'TOO MANY COLUMNS' ELSE 'MISSING COLUMNS' END
    WHEN reason = 'quoting' AND regexp_matches(raw_line, '^(?:{_FIELD},)*"(?:[^"]|"")*(?:$|"[^,"])') THEN 'UNQUOTED VALUE' END AS error
  FROM reasons LEFT JOIN raw USING (row_no) LEFT JOIN read USING (row_no) WHERE reason IS NOT NULL)
SELECT origin, row_no, reason, CASE WHEN reason IN ('bad_id', 'bad_label') THEN 'value' WHEN error IS NOT NULL THEN 'reject table' ELSE 'exact reading' END AS settled_by, error FROM kinds""",
}
