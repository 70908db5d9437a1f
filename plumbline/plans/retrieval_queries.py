"""Queries of ranking and retrieval metrics over the corpus, with SQL. The stated queries are the rows whose number is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import governing_section
from plumbline.operators import retrieval
from plumbline.operators.common import latest
from plumbline.session import table

EVERY = 50
N_FETCH = 60


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each chunk id, keyed by its number."""
    return latest(
        table(spark, sf_dir, "corpus_chunks").select("id", "row_no", "text", "section"),
        ["id"],
        "row_no",
    ).select(F.col("row_no").alias("key"), "id", "text", "section")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "test_set").where(F.col("row_no") % EVERY == 0)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select(F.col("row_no").alias("key"), F.col("system_description").alias("text"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("key"),
        F.col("embedding").alias("vector"),
        "label",
    )


def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.term_stats(corpus(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_topk(_texts(spark, sf_dir), corpus(spark, sf_dir)).withColumn("sparse", F.round("sparse", 6))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return retrieval.nearest(vectors.where(F.col("key") % EVERY == 0), vectors).withColumn(
        "cosine",
        F.round("cosine", 6),
    )


def hashed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hashed_topk(_texts(spark, sf_dir), corpus(spark, sf_dir)).withColumn("dense", F.round("dense", 6))


def ranking(spark: SparkSession, sf_dir: str, log_k: int = 50) -> DataFrame:
    return retrieval.fused(_texts(spark, sf_dir), corpus(spark, sf_dir), log_k)


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking(spark, sf_dir, 10).select("query", "rank", "key", F.round("score", 6).alias("score"))


def _kinds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return retrieval.gold_chunks(
        asked(spark, sf_dir).select(F.col("row_no").alias("query"), "label_source"),
        corpus(spark, sf_dir),
    )


def retrieval_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, kinds = _kinds(spark, sf_dir)
    rows = asked(spark, sf_dir).select(
        F.col("row_no").alias("query"),
        F.col("annex_iii_area").alias("area"),
        "edge_case_type",
    )
    return retrieval.per_row_metrics(ranking(spark, sf_dir), gold, kinds).join(rows, "query")


def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.retrieval_summary(retrieval_per_row(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("mrr", "hit_5", "recall_5", "hit_10", "recall_10")})


def gold_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold sections, kinds and numbers of gold chunks of all test rows, not of the stated queries only."""
    rows = table(spark, sf_dir, "test_set").select(F.col("row_no").alias("query"), "label_source")
    return retrieval.gold_chunks(rows, corpus(spark, sf_dir))[1].withColumnRenamed("query", "row_no")


def gold_match_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_matches(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


def gold_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback on its own: the sections of the test rows against a corpus whose sections stop at the second level."""
    wanted = table(spark, sf_dir, "test_set").select(
        governing_section(F.col("label_source")).alias("section")
    ).distinct()
    have = corpus(spark, sf_dir).select(F.substring_index("section", ".", 2).alias("section")).distinct()
    return retrieval.section_matches(wanted, have)


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused against BM25 alone: hits at 5 by area."""
    gold, kinds = _kinds(spark, sf_dir)
    q, c = _texts(spark, sf_dir), corpus(spark, sf_dir)
    areas = asked(spark, sf_dir).select(F.col("row_no").alias("query"), F.col("annex_iii_area").alias("area"))
    sparse = retrieval.per_row_metrics(retrieval.bm25_topk(q, c, 10), gold, kinds).join(areas, "query")
    return retrieval.compared_runs(retrieval_per_row(spark, sf_dir), sparse)


QUERIES = {
    "bm25_term_stats": bm25_term_stats,
    "bm25_topk": bm25_topk,
    "dense_topk": dense_topk,
    "hashed_topk": hashed_topk,
    "hybrid_topk": hybrid_topk,
    "gold_index": lambda s, d: retrieval.gold_index(corpus(s, d)),
    "gold_matches": gold_matches,
    "gold_match_kinds": gold_match_kinds,
    "gold_fallback": gold_fallback,
    "retrieval_per_row": lambda s, d: retrieval_per_row(s, d).select(
        "query",
        "gold_section",
        "kind",
        "n_gold",
        "first_gold_rank",
        F.round("mrr", 6).alias("mrr"),
        "hit_5",
        "hit_10",
        F.round("recall_5", 6).alias("recall_5"),
        F.round("recall_10", 6).alias("recall_10"),
    ),
    "retrieval_summary": retrieval_summary,
    "run_comparison": run_comparison,
}

_BASE = """corpus AS (SELECT max(row_no) AS key, id, max_by(coalesce(text, ''), row_no) AS text, max_by(section, row_no)
    AS section FROM corpus_chunks GROUP BY id),
asked AS (SELECT row_no AS query, coalesce(system_description, '') AS text, annex_iii_area AS area, edge_case_type,
  label_source FROM test_set WHERE row_no % 50 = 0),
dl AS (SELECT key, regexp_extract_all(lower(text), '[A-Za-z0-9]+') AS tokens FROM corpus), size AS (SELECT count(*) AS
  n_docs, avg(len(tokens)) AS avgdl FROM dl),
tf AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(tokens) AS term FROM dl) GROUP BY 1, 2),
raw AS (SELECT term, count(*) AS df, ln((SELECT n_docs FROM size) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE)
  AS raw FROM tf GROUP BY term),
stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qtok AS (SELECT query, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS term FROM asked), qf AS (SELECT query,
  term, count(*) AS qf FROM qtok GROUP BY 1, 2),
sparse AS (SELECT query, key, sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE *
  len(tokens) / avgdl))) AS sparse FROM qf JOIN stats USING (term) JOIN tf USING (term) JOIN dl USING (key), size GROUP
  BY 1, 2)"""
_CELL = "(('0x' || substr(md5({}), 1, 8))::BIGINT % 768)"
_DENSE = f"""ccell AS (SELECT key, cell, count(*)::DOUBLE AS n FROM (SELECT key, {_CELL.format('term')} AS cell FROM
    (SELECT key, unnest(tokens) AS term FROM dl)) GROUP BY 1, 2),
qcell AS (SELECT query, cell, count(*)::DOUBLE AS n FROM (SELECT query, {_CELL.format('term')} AS cell FROM qtok) GROUP
  BY 1, 2),
cnorm AS (SELECT key, sqrt(sum(n * n)) AS norm FROM ccell GROUP BY key), qnorm AS (SELECT query, sqrt(sum(n * n)) AS
  norm FROM qcell GROUP BY query),
dense AS (SELECT query, key, sum((q.n / qnorm.norm) * (c.n / cnorm.norm)) AS dense FROM qcell q JOIN ccell c USING
  (cell) JOIN qnorm USING (query) JOIN cnorm USING (key) GROUP BY 1, 2),
dranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(dense, 9) DESC, key) AS rank FROM dense)"""


def _hybrid(log_k: int) -> str:
    return f"""{_BASE}, {_DENSE}, fetched AS (SELECT * FROM dranked WHERE rank <= {max(6 * log_k, 50)}),
pool AS (SELECT a.query, c.key, coalesce(f.dense, 0) AS dense, coalesce(s.sparse, 0) AS sparse FROM asked a CROSS JOIN
  corpus c LEFT JOIN fetched f ON f.query = a.query AND f.key = c.key LEFT JOIN sparse s ON s.query = a.query AND s.key
  = c.key),
lim AS (SELECT query, min(dense) AS dl0, max(dense) AS dh, min(sparse) AS sl, max(sparse) AS sh FROM pool GROUP BY
  query),
scored AS (SELECT query, key, 0.5 * CASE WHEN dh - dl0 < 1e-9 THEN 0 ELSE (dense - dl0) / (dh - dl0) END + 0.5 * CASE
  WHEN sh - sl < 1e-9 THEN 0 ELSE (sparse - sl) / (sh - sl) END AS score FROM pool JOIN lim USING (query)),
ranking AS (SELECT * FROM (SELECT query, key, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9)
  DESC, key) AS rank FROM scored) WHERE rank <= {log_k})"""


def _gold(rows: str) -> str:
    return f"""want AS (SELECT query, nullif(regexp_extract(coalesce(label_source, ''),
        '(?i)section\\s+([0-9]+(?:\\.[0-9]+)+)', 1), '') AS gold_section FROM {rows}),
have AS (SELECT DISTINCT section FROM corpus WHERE section IS NOT NULL),
match AS (SELECT g.gold_section, h.section, CASE WHEN g.gold_section = h.section THEN 'exact' ELSE 'related' END AS kind
  FROM (SELECT DISTINCT gold_section FROM want) g JOIN have h
  ON g.gold_section = h.section OR (g.gold_section NOT IN (SELECT section FROM have) AND (starts_with(h.section,
    g.gold_section || '.') OR starts_with(g.gold_section, h.section || '.')))),
gold AS (SELECT query, key, kind FROM want JOIN match USING (gold_section) JOIN corpus USING (section)),
kinds AS (SELECT query, gold_section, CASE WHEN gold_section IS NULL THEN 'no-section' ELSE coalesce(min(kind),
  'missing') END AS kind, count(key) AS n_gold FROM want LEFT JOIN gold USING (query) GROUP BY 1, 2)"""


def _metrics(source: str = "ranking", name: str = "per_row") -> str:
    return f"""{name}_f AS (SELECT query, min(rank) AS first_gold_rank, count(*) FILTER (rank <= 5) AS f5, count(*)
        FILTER (rank <= 10) AS f10 FROM {source} JOIN gold USING (query, key) GROUP BY query),
{name} AS (SELECT query, gold_section, kind, n_gold, first_gold_rank::INT AS first_gold_rank, coalesce(1.0::DOUBLE /
  first_gold_rank, 0) AS mrr, (coalesce(f5, 0) > 0)::INT AS hit_5, (coalesce(f10, 0) > 0)::INT AS hit_10,
  CASE WHEN n_gold > 0 THEN coalesce(f5, 0)::DOUBLE / n_gold ELSE 0 END AS recall_5, CASE WHEN n_gold > 0 THEN
    coalesce(f10, 0)::DOUBLE / n_gold ELSE 0 END AS recall_10 FROM kinds LEFT JOIN {name}_f USING (query))"""


_PER_ROW = f"{_hybrid(50)}, {_gold('asked')}, {_metrics()}"
_MEANS = "count(*) AS n, round(avg(mrr), 6) AS mrr, round(avg(hit_5), 6) AS hit_5, round(avg(recall_5), 6) AS recall_5, round(avg(hit_10), 6) AS hit_10, round(avg(recall_10), 6) AS recall_10"
SQL = {
    "bm25_term_stats": f"WITH {_BASE} SELECT term, df, round(idf, 6) AS idf FROM stats",
    "bm25_topk": f"""WITH {_BASE} SELECT query, rank, key, round(sparse, 6) AS sparse FROM (SELECT *, row_number() OVER
        (PARTITION BY query ORDER BY round(sparse, 9) DESC, key) AS rank FROM sparse) WHERE rank <= 5""",
    "dense_topk": """WITH v AS (SELECT vec_id AS key, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.key AS
        query, v.key, list_cosine_similarity(q.e, v.e) AS cosine FROM v q JOIN v ON q.key <> v.key WHERE q.key % 50 = 0)
      SELECT query, rank, key, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY
        round(cosine, 9) DESC, key) AS rank FROM s) WHERE rank <= 10""",
    "hashed_topk": f"""WITH {_BASE}, {_DENSE} SELECT query, rank, key, round(dense, 6) AS dense FROM dranked WHERE rank
        <= 5""",
    "hybrid_topk": f"WITH {_hybrid(10)} SELECT query, rank, key, round(score, 6) AS score FROM ranking",
    "gold_index": f"WITH {_BASE} SELECT section, id, count(*) OVER (PARTITION BY section) AS n_chunks FROM corpus",
    "gold_matches": f"""WITH {_BASE}, every AS (SELECT row_no AS query, label_source FROM test_set), {_gold('every')}
        SELECT query AS row_no, gold_section, kind, n_gold FROM kinds""",
    "gold_match_kinds": f"""WITH {_BASE}, every AS (SELECT row_no AS query, label_source FROM test_set),
        {_gold('every')} SELECT kind, count(*) AS n FROM kinds GROUP BY kind""",
    "gold_fallback": f"""WITH {_BASE}, want AS (SELECT DISTINCT nullif(regexp_extract(coalesce(label_source, ''),
        '(?i)section\\s+([0-9]+(?:\\.[0-9]+)+)', 1), '') AS section FROM test_set),
      have AS (SELECT DISTINCT array_to_string(string_split(section, '.')[1:2], '.') AS chunk_section FROM corpus WHERE
        section IS NOT NULL)
      SELECT section, chunk_section, CASE WHEN section = chunk_section THEN 'exact' ELSE 'related' END AS kind FROM want
        JOIN have ON section = chunk_section OR (section NOT IN (SELECT chunk_section FROM have) AND
        (starts_with(chunk_section, section || '.') OR starts_with(section, chunk_section || '.')))""",
    "retrieval_per_row": f"""WITH {_PER_ROW} SELECT query, gold_section, kind, n_gold, first_gold_rank, round(mrr, 6)
        AS mrr, hit_5, hit_10, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10 FROM per_row""",
    "retrieval_summary": f"""WITH {_PER_ROW}, r AS (SELECT * FROM per_row JOIN asked USING (query)) SELECT 'overall' AS
        level, NULL AS value, {_MEANS} FROM r HAVING count(*) > 0
      UNION ALL SELECT 'area', area, {_MEANS} FROM r GROUP BY area UNION ALL SELECT 'edge_case_type', edge_case_type,
        {_MEANS} FROM r GROUP BY edge_case_type""",
    "run_comparison": f"""WITH {_PER_ROW}, bm AS (SELECT * FROM (SELECT query, key, row_number() OVER (PARTITION BY
        query ORDER BY round(sparse, 9) DESC, key) AS rank FROM sparse) WHERE rank <= 10), {_metrics('bm', 'other')}
      SELECT area, count(*) AS n, sum(p.hit_5)::BIGINT AS hits_one, sum(o.hit_5)::BIGINT AS hits_two FROM per_row p JOIN
        other o USING (query) JOIN asked USING (query) GROUP BY area""",
}
