"""Queries of segmentation and sentence packing: tables laid out as guideline documents and read back, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import collapsed, packed
from plumbline.operators import segment
from plumbline.plans.sql import AREA, EXAMPLES, SPACE, flat, quoted
from plumbline.session import table

#: A small guideline: a heading, footnotes, page furniture, held-out and inline examples, a continued paragraph, three
#: kinds of example block.
GUIDE = """
2.1. General principles of the classification of systems
(1) The first paragraph says what this part is about.
 12
Draft Commission guidelines on the classification of systems
3.2.3. Management of road traffic and of other networks, point 2(a)
(2) A provider looks at the purpose of the system first
    and goes on to the point of the annex. 19
  19 A footnote that is dropped
   with a second line, dropped too
(3) Below are some examples of systems that would be caught by this.
a) Practical example of systems falling within the high-risk use case
   - A system that closes lanes when it reads heavy traffic,
     which a control room can only watch, and
   – Too short.
b) Practical example of systems falling outside the use case, Point 2(b)
   - A system that counts cars for a yearly report of the town.
text that ends the bullet
     and is lost
 13
   - A bullet within the footnotes of the page, which is lost.
c) Practical example of systems exempted
     - A system that only formats letters, see Article 6(3)(a), for a clerk.
1. Too short
(4) A later paragraph is long enough and stays in its section.
4.1 A part of the guideline that isn't kept at all
(5) Its paragraphs are left out whatever they say.
"""


def _documents(blocks: DataFrame) -> DataFrame:
    """``blocks``: (``row_no``, ``block``). One document of each eight rows in a row."""
    grouped = blocks.groupBy(F.floor(F.col("row_no") / 8).cast("string").alias("doc_id")).agg(
        F.sort_array(F.collect_list(F.struct("row_no", "block"))).alias("b")
    )
    return grouped.select("doc_id", F.array_join(F.col("b.block"), "").alias("text"))


def _section(df: DataFrame, ending: str) -> DataFrame:
    """(``row_no``, ``block``): each chunk as a heading and a numbered paragraph."""
    text = F.concat(
        F.col("section"),
        F.lit("  Provisions on the matters of this section\n\n("),
        F.coalesce("para_num", F.lit("1")),
        F.lit(")   "),
        collapsed(F.coalesce("text", F.lit(""))),
        F.lit("\n" + ending),
    )
    return df.where("section is not null").select("row_no", text.alias("block"))


_CHUNK = (
    "doc_id", "id", "section", "section_title", "annex_iii_area", "para_num", "part", "heading_path", "text",
    "char_len",
)


def segment_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written as small documents, a heading and a numbered paragraph each, and read back by the segmentation."""
    blocks = _section(table(spark, sf_dir, "corpus_chunks"), "")
    return segment.segment_corpus(
        blocks.select(F.col("row_no").cast("string").alias("doc_id"), F.col("block").alias("text"))
    ).select(*_CHUNK)


def segment_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as sections of documents, each with a footnote, a paragraph of examples that is held out, an example block and a page number, and read back."""
    junk = "  9 A footnote of two lines\n   which are both dropped\n(98) Below are some examples of systems that would be caught.\na) Practical example of a system\n   which is held out\n 12\n"
    return segment.segment_corpus(_documents(_section(table(spark, sf_dir, "corpus_chunks"), junk))).select(*_CHUNK)


def segment_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions as bullets of example blocks of the three kinds, under a heading and a point each, and read back."""
    rows = table(spark, sf_dir, "test_set").where(
        "annex_iii_point rlike '^[0-9]+[(][a-z][)]$' and system_description is not null"
    )
    kinds = F.array(
        F.lit("a) Practical example of systems falling within the high-risk use case"),
        F.lit("b) Practical example of systems falling outside the high-risk use case"),
        F.lit("c) Practical example of systems exempted"),
    )
    kind = F.get(kinds, F.pmod(F.col("row_no"), F.lit(3)).cast("int"))
    text = F.concat(
        F.lit("3.4. Employment, workers management and access to self-employment\n"),
        kind,
        F.lit(", Point "),
        F.col("annex_iii_point"),
        F.lit("\n   - "),
        collapsed(F.col("system_description")),
        F.lit("\n"),
    )
    found = segment.segment_examples(_documents(rows.select("row_no", text.alias("block"))))
    return found.select(
        "doc_id",
        "id",
        "annex_iii_area",
        "annex_iii_point",
        "system_description",
        "label",
        "label_source",
        "edge_case_type",
        "notes",
        F.array_join("needs_review", ",").alias("needs_review"),
    )


def _guide(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("guide", GUIDE), ("empty", ""), ("null", None)], "doc_id string, text string")


def guide_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment_corpus(_guide(spark)).select("doc_id", "id", "section", "para_num", "heading_path", "text")


def guide_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.segment_examples(_guide(spark))
    return found.select(
        "doc_id",
        "id",
        "annex_iii_area",
        "annex_iii_point",
        "system_description",
        "label",
        "label_source",
        "edge_case_type",
        "notes",
        F.array_join("needs_review", ",").alias("needs_review"),
    )


def sentence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "corpus_chunks").select(
        "row_no",
        packed(collapsed(F.coalesce("text", F.lit("")))).alias("parts"),
    )
    return chunks.select("row_no", F.posexplode("parts").alias("part", "text")).select(
        "row_no",
        "part",
        "text",
        F.length("text").alias("char_len"),
    )


QUERIES = {
    f.__name__: f
    for f in (segment_roundtrip, segment_sections, segment_examples, guide_chunks, guide_examples, sentence_packing)
}

#: Clauses of each chunk's text, packed one after another; ``parts``: the last state of each part.
_PACKED = f"""texts AS (SELECT row_no, section, para_num, {flat("coalesce(text, '')")} AS t FROM corpus_chunks),
clauses AS (SELECT row_no, t, string_split(regexp_replace(t, '([.;:]) ', '\\1' || chr(1), 'g'), chr(1)) AS c FROM
  texts),
steps AS (SELECT row_no, 1 AS i, 0 AS part, trim(c[1], ' ') AS buf FROM clauses WHERE length(t) > 1800
  UNION ALL SELECT s.row_no, i + 1, CASE WHEN length(buf) + length(c[i + 1]) + 1 > 1800 AND buf <> '' THEN part + 1 ELSE
    part END,
    CASE WHEN length(buf) + length(c[i + 1]) + 1 > 1800 AND buf <> '' THEN c[i + 1] ELSE trim(buf || ' ' || c[i + 1],
      ' ') END FROM steps s JOIN clauses k ON k.row_no = s.row_no WHERE i < len(c)),
parts AS (SELECT row_no, part, arg_max(buf, i) AS text FROM steps GROUP BY row_no, part UNION ALL SELECT row_no, 0, t
  FROM texts WHERE length(t) <= 1800)"""
_SECTIONS = f"""{_PACKED}, kept AS (SELECT p.row_no, p.part, p.text, section, coalesce(para_num, '1') AS para_num,
    count(*) OVER (PARTITION BY p.row_no) AS n FROM parts p JOIN texts x ON x.row_no = p.row_no
  WHERE section IS NOT NULL AND string_split(section, '.')[1] IN ('2', '3') AND length(t) >= 25 AND NOT regexp_matches(t, '{EXAMPLES}'))"""
_COLUMNS = f"""section, 'Provisions on the matters of this section' AS section_title, {AREA} AS annex_iii_area, para_num, CASE WHEN n > 1 THEN part END AS part,
  CASE WHEN starts_with(section, '2') THEN 'General principles' ELSE coalesce({AREA}, 'Annex III') END || ' | ' ||
    section || ' Provisions on the matters of this section' AS heading_path, text, length(text)::INT AS char_len"""
_HEAD = "3.2.3 Management of road traffic and of other networks, point 2(a)"
SQL = {
    "sentence_packing": f"WITH RECURSIVE {_PACKED} SELECT row_no, part, text, length(text)::INT AS char_len FROM parts",
    "segment_roundtrip": f"""WITH RECURSIVE {_SECTIONS} SELECT row_no::VARCHAR AS doc_id, printf('chunk-%04d',
        row_number() OVER (PARTITION BY row_no ORDER BY part)) AS id, {_COLUMNS} FROM kept""",
    "segment_sections": f"""WITH RECURSIVE {_SECTIONS} SELECT (row_no // 8)::VARCHAR AS doc_id, printf('chunk-%04d',
        row_number() OVER (PARTITION BY row_no // 8 ORDER BY row_no, part)) AS id, {_COLUMNS} FROM kept""",
    "segment_examples": f"""WITH r AS (SELECT row_no, annex_iii_point, {flat('system_description')} AS t, row_no % 3 AS
        k FROM test_set WHERE regexp_full_match(annex_iii_point, '[0-9]+\\([a-z]\\)') AND system_description IS NOT
        NULL),
      e AS (SELECT *, regexp_extract(t, 'Article{SPACE}+6\\(3\\)\\(([a-d])\\)', 1) AS condition FROM r WHERE length(t)
        >= 30)
      SELECT (row_no // 8)::VARCHAR AS doc_id, printf('anx3-%03d', row_number() OVER (PARTITION BY row_no // 8 ORDER BY
        row_no)) AS id, 'employment' AS annex_iii_area, annex_iii_point, t AS system_description,
        CASE WHEN k = 0 THEN 'high-risk' ELSE 'not-high-risk' END AS label, 'Annex III guidelines, section 3.4, ' ||
          ['a', 'b', 'c'][k + 1] || ') subsection' AS label_source,
        CASE WHEN k = 2 THEN 'article-6-3-filter' ELSE 'none' END AS edge_case_type, CASE WHEN condition <> '' THEN
          'Filter condition: Article 6(3)(' || condition || ')' ELSE '' END AS notes,
        nullif(concat_ws(',', CASE WHEN regexp_matches(t,
          '( (from|of|to|by|with|on|in|for|and|or|that|which|such as|including|e\\.g\\.,)|,)$') THEN
          'possibly_truncated' END,
          CASE WHEN length(t) > 1200 THEN 'very_long' END, CASE WHEN k = 2 AND NOT contains(t, '6(3)') THEN
            'filter_row_missing_6_3_ref' END), '') AS needs_review FROM e""",
    "guide_chunks": f"""SELECT 'guide' AS doc_id, * FROM (VALUES ('chunk-0001', '2.1', '1',
        'General principles | 2.1 General principles of the classification of systems',
        'The first paragraph says what this part is about.'),
      ('chunk-0002', '3.2.3', '2', 'critical-infrastructure | {_HEAD}', 'A provider looks at the purpose of the system first and goes on to the point of the annex. 19'),
      ('chunk-0003', '3.2.3', '4', 'critical-infrastructure | {_HEAD}', 'A later paragraph is long enough and stays in its section.')) t(id, section, para_num, heading_path, text)""",
    "guide_examples": f"""SELECT 'guide' AS doc_id, printf('anx3-%03d', n) AS id, 'critical-infrastructure' AS
        annex_iii_area, p AS annex_iii_point, t AS system_description, CASE WHEN n = 1 THEN 'high-risk' ELSE
        'not-high-risk' END AS label,
      'Annex III guidelines, section 3.2.3, ' || k || ') subsection, para ~3' AS label_source, CASE WHEN k = 'c' THEN
        'article-6-3-filter' ELSE 'none' END AS edge_case_type,
      CASE WHEN k = 'c' THEN 'Filter condition: Article 6(3)(a); ' ELSE '' END || 'Sub-topic: road-traffic' AS notes, r
        AS needs_review
      FROM (VALUES (1, 'a', '2(a)',
        {quoted("A system that closes lanes when it reads heavy traffic, which a control room can only watch, and")},
        'possibly_truncated'),
      (2, 'b', '2(b)', 'A system that counts cars for a yearly report of the town.', NULL), (3, 'c', '2(b)',
        'A system that only formats letters, see Article 6(3)(a), for a clerk.', NULL)) v(n, k, p, t, r)""",
}
