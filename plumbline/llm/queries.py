"""Queries of the operators on training text, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import leakage, near_duplicates, packing, pair_defects, spam, splitting, truncation
from plumbline.session import cut_lineage, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(
        table(spark, sf_dir, "test_set"),
        "row_no",
        "system_description",
        0.85,
    ).select("row_a", "row_b")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, sf_dir, "test_set"), "row_no", "system_description", 0.85)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "test_set").select(
        F.lit("test_set").alias("origin"),
        F.col("row_no").alias("key"),
        "source",
        F.col("system_description").alias("text"),
    )
    runs = table(spark, sf_dir, "runs").select(
        F.lit("runs").alias("origin"),
        F.col("row_no").alias("key"),
        F.col("config").alias("source"),
        F.col("explanation").alias("text"),
    )
    return truncation.judged_rows(rows.unionByName(runs))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("is_cut").select("origin", F.col("key").alias("row_no"))


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_shares(_judged(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(table(spark, sf_dir, "corpus_chunks"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_pieces(table(spark, sf_dir, "corpus_chunks"))


def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each chunk over the limit, what its pieces must be: all of the text, each within the limit with its heading, sharing 100 to 200 characters with the piece before."""
    pieces = splitting.split_pieces(table(spark, sf_dir, "corpus_chunks"))
    low, high = splitting.OVERLAP
    size = F.length("text") + F.coalesce(F.length("heading") + 1, F.lit(0))
    ok = (size <= splitting.LIMIT) & (F.length("text") == F.col("ends_at") - F.col("starts_at")) & (
        (F.col("piece_no") == 1)
        | F.col("shared").between(low, high)
    )
    # Each piece but the first starts what it shares before the end of the one before it, so these add up to the length
    # of the text.
    return pieces.groupBy("row_no", "cut_kind").agg(F.sum(F.col("ends_at") - F.col("starts_at") - F.col("shared")).alias("n_covered"), F.max("ends_at").alias("ends_at"), F.count("*").alias("n_rows"), F.sum((~ok).cast("long")).alias("n_bad"), F.max("n_pieces").cast("long").alias("n_pieces")).select(
        "row_no", "cut_kind", "n_covered", F.col("ends_at").cast("long").alias("ends_at"), "n_bad", (F.col("n_rows") % F.col("n_pieces") == 0).alias("complete")
    )


def p5_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers that are empty, which SQL can tell, too."""
    return p5_found(spark, sf_dir).where("defect = 'empty'").select("row_no")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects.pair_defects(table(spark, sf_dir, "runs"), table(spark, sf_dir, "test_set"))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every packing must be, for the limits of training and for some where all three bind: texts, those not there once in whole, and sequences over each limit."""
    documents, rows = table(spark, sf_dir, "documents"), []
    for name, limits in (("training", (packing.TOKENS, packing.SEGMENTS, packing.LOSS)), ("narrow", (packing.TOKENS, 32, 1920))):
        packed = cut_lineage(packing.pack(documents, limits=limits))
        size = F.col("token_to") - F.col("token_from")
        texts = packed.groupBy("doc_id").agg(
            F.count("*").alias("n"),
            F.max("n_parts").alias("of"),
            F.sum(size).alias("tokens"),
            F.max("token_to").alias("ends"),
            F.countDistinct("part_no").alias("different"),
        )
        whole = (F.col("n") == F.col("of")) & (F.col("different") == F.col("of")) & (F.col("tokens") == F.col("ends"))
        sequences = packed.groupBy("sequence_id").agg(
            F.sum(size).alias("tokens"),
            F.count("*").alias("segments"),
            F.sum("n_loss").alias("loss"),
        )
        over = [
            F.sum((F.col(c) > most).cast("long")).alias(f"n_over_{c}")
            for c, most in zip(("tokens", "segments", "loss"), limits, strict=True)
        ]
        rows.append(texts.agg(F.count("*").alias("n_texts"), F.sum((~whole).cast("long")).alias("n_not_whole")).crossJoin(sequences.agg(*over)).withColumn("limits", F.lit(name)))  # one row each
    return rows[0].unionByName(rows[1])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents give away each item, items of none included."""
    leaked = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    items = table(spark, sf_dir, "eval_items").select("item_id", "annex_iii_area", "label")
    return items.join(leaked, "item_id", "left").select(
        "item_id",
        "annex_iii_area",
        "label",
        F.coalesce("n_documents", F.lit(0).cast("long")).alias("n_documents"),
    )


def p7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of the found pairs where the document has 20 words of the item without any change, which SQL finds by itself."""
    words = lambda t, key: t.select(key, F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0).alias("w"))
    runs = F.transform(
        F.sequence(F.lit(1), F.size("w") - 19),
        lambda i: F.sha1(F.array_join(F.slice(F.col("w"), i, F.lit(20)), " ").cast("binary")),
    )
    of = lambda t, key: words(t, key).where(F.size("w") >= 20).select(key, F.explode(F.array_distinct(runs)).alias("run"))
    found = cut_lineage(p7_found(spark, sf_dir))
    documents, items = of(
        table(spark, sf_dir, "documents").join(found.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"),
        "doc_id",
    ), of(table(spark, sf_dir, "eval_items"), "item_id")
    return found.join(documents.hint("merge"), "doc_id").join(
        items.hint("merge"),
        ["item_id", "run"],
    ).select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf_dir, "documents"))


def p8_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.page_evidence(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_groups, p3_found, p3_shares, p4_found, p4_pieces, p4_checks, p5_found, p5_empty, p6_pack,
        p6_checks, p7_found, p7_items, p7_exact, p8_found, p8_evidence,
    )
}

_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_PLAIN = f"trim(regexp_replace(text, '{_SPACE}+', ' ', 'g'), ' ')"
_SETS = f"""sets AS (SELECT row_no, list_sort(list_distinct(list_filter(string_split_regex(lower(system_description),
    '{_SPACE}+'), lambda w: w <> ''))) AS ws FROM test_set)"""
_OVERSIZED = f"""plain AS (SELECT row_no, {_PLAIN} AS body, CASE WHEN heading_path IS NULL THEN 0 ELSE
    length(heading_path) + 1 END AS share FROM corpus_chunks),
oversized AS (SELECT row_no, body, CASE WHEN list_max(list_transform(string_split(regexp_replace(body, '([.;:]) ', '\\1'
  || chr(1), 'g'), chr(1)), lambda x: length(x))) > 1800 - share THEN 'forced' ELSE 'boundary' END AS cut_kind FROM
  plain WHERE length(body) + share > 1800)"""
SQL = {
    "p1_found": f"""
WITH sets AS (SELECT row_no, list_distinct(list_filter(string_split_regex(lower(system_description), '{_SPACE}+'),
  lambda w: w <> '')) AS ws FROM test_set WHERE system_description IS NOT NULL),
pairs AS (SELECT a.row_no AS row_a, b.row_no AS row_b, len(list_intersect(a.ws, b.ws)) AS both_have, len(a.ws) +
  len(b.ws) AS n
  FROM sets a JOIN sets b ON a.row_no < b.row_no AND least(len(a.ws), len(b.ws)) >= 0.84 * greatest(len(a.ws),
    len(b.ws)) WHERE len(a.ws) > 0 AND len(b.ws) > 0)
SELECT row_a, row_b FROM pairs WHERE both_have::DOUBLE / (n - both_have) >= 0.85::DOUBLE""",
    "p1_groups": f"""
WITH RECURSIVE {_SETS}, members AS (SELECT row_no, min(row_no) OVER (PARTITION BY ws) AS rep FROM sets WHERE len(ws) >
  0), heads AS (SELECT DISTINCT rep, ws FROM members JOIN sets ON sets.row_no = rep),
pairs AS (SELECT a.rep AS a, b.rep AS b, len(list_intersect(a.ws, b.ws)) AS both_have, len(a.ws) + len(b.ws) AS n FROM
  heads a JOIN heads b ON a.rep < b.rep AND least(len(a.ws), len(b.ws)) >= 0.84 * greatest(len(a.ws), len(b.ws))),
links AS (SELECT a, b FROM pairs WHERE both_have::DOUBLE / (n - both_have) >= 0.85::DOUBLE), edges AS (SELECT a, b FROM
  links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep, rep AS least FROM heads UNION SELECT e.b, r.least FROM reach r JOIN edges e ON e.a = r.rep),
  groups AS (SELECT rep, min(least) AS group_id FROM reach GROUP BY rep),
counts AS (SELECT a AS rep, count(*) AS n FROM edges GROUP BY a)
SELECT t.row_no, coalesce(m.rep, t.row_no) AS class_id, coalesce(group_id, t.row_no) AS group_id, coalesce(n, 0) AS
  n_links FROM test_set t LEFT JOIN members m ON m.row_no = t.row_no LEFT JOIN groups g ON g.rep = m.rep LEFT JOIN
  counts c ON c.rep = m.rep""",
    "p4_found": f"WITH {_OVERSIZED} SELECT row_no, cut_kind FROM oversized",
    "p4_checks": f"""WITH {_OVERSIZED} SELECT row_no, cut_kind, sum(length(body))::BIGINT AS n_covered,
        max(length(body))::BIGINT AS ends_at, 0::BIGINT AS n_bad, true AS complete FROM oversized GROUP BY row_no,
        cut_kind""",
    "p5_empty": f"""
WITH w AS (SELECT row_no, array_to_string(regexp_extract_all(lower(coalesce(explanation, '')), '[\\p{{L}}\\p{{N}}]+'),
  ' ') AS t FROM runs)
SELECT row_no FROM w WHERE t IN ({", ".join(f"'{x}'" for x in sorted(pair_defects.PLACEHOLDERS))}) OR regexp_matches(t,
  '{pair_defects.BARE_LABEL.pattern}')""",
    "p6_checks": """SELECT unnest(['training', 'narrow']) AS limits, (SELECT count(*) FROM documents) AS n_texts,
        0::BIGINT AS n_not_whole, 0::BIGINT AS n_over_tokens, 0::BIGINT AS n_over_segments, 0::BIGINT AS n_over_loss""",
    "p7_exact": """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), i AS (SELECT item_id,
  regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
dr AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 19], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) -
  18)) AS k FROM d)), ir AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 19], ' ') AS run FROM (SELECT item_id, w,
  unnest(range(1, len(w) - 18)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)""",
}
