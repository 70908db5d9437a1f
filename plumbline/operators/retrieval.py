"""BM25, dense and fused ranking, and retrieval metrics, for all queries at once.

Corpus and queries are tables of (``key``, ``text``), keys unique; ties in a ranking go to the lower key. Null and empty texts have no tokens: such a
passage scores 0, such a query ranks passages by key alone.

A text is tokenised once, to hashes of its terms and, for dense scores without an encoder, cells of a hashed bag of words. The stated queries meet the corpus in a grid: the corpus
in slices of ``SLICE`` passages, the queries in blocks of ``BLOCK``, each cell one task that multiplies matrices and passes on the few best of each query. So neither
stop words nor cells become join keys, no pair of query and passage is ever a row, and what a task holds is bounded. The corpus is shuffled once for each block of queries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import bm25_tokens, governing_section
from plumbline.operators.common import count_where, share
from plumbline.session import cut_lineage

SLICE, BLOCK = 8192, 256
DIM = 768
#: Rows of the incidence matrix of passages and query terms that are filled at once.
_ROWS = 512


@dataclass(frozen=True)
class BM25:
    """The constants of the Okapi formula; idf below zero becomes ``epsilon`` times the mean raw idf."""

    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


def _idf(frequencies: DataFrame, n_docs: int, p: BM25) -> Column:
    """Of a table with ``df``, a row for each term; the mean over all terms is one number."""
    raw = F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = frequencies.agg(F.avg(raw)).first()[0]
    return F.when(raw < 0, F.lit(p.epsilon * (mean or 0.0))).otherwise(raw)


def term_stats(corpus: DataFrame, p: BM25 = BM25()) -> DataFrame:
    """(``term``, ``df``, ``idf``)."""
    terms = corpus.select(F.explode(F.array_distinct(bm25_tokens(F.col("text")))).alias("term"))
    frequencies = cut_lineage(terms.groupBy("term").agg(F.count("*").alias("df")))
    return frequencies.select("term", "df", _idf(frequencies, corpus.count(), p).alias("idf"))


def hashed_cell(token: Column, dim: int = DIM) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def indexed(texts: DataFrame, dim: int | None = None) -> DataFrame:
    """(``key``, ``terms``, and ``cells`` if ``dim``) of each text, materialised; a ``vector`` that the texts have stays."""
    tokens = texts.select(
        "key",
        *[c for c in texts.columns if c == "vector"],
        bm25_tokens(F.col("text")).alias("tokens"),
    )
    cells = [F.transform("tokens", lambda t: hashed_cell(t, dim)).alias("cells")] if dim else []
    return cut_lineage(
        tokens.select(
            *[c for c in tokens.columns if c != "tokens"],
            F.transform("tokens", lambda t: F.xxhash64(t)).alias("terms"),
            *cells,
        )
    )


def _with_weights(queries: DataFrame, corpus: DataFrame, n_docs: int, p: BM25) -> DataFrame:
    """``queries`` with ``weighted``: for each of its terms that the corpus has, how often it occurs times its idf."""
    frequencies = cut_lineage(
        corpus.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    )
    asked = queries.select("key", F.explode("terms").alias("term")).groupBy("key", "term").agg(F.count("*").alias("qf"))
    known = asked.join(frequencies.hint("merge"), "term").select(
        "key",
        F.struct("term", (F.col("qf") * _idf(frequencies, n_docs, p)).alias("weight")).alias("w"),
    )
    return queries.join(known.groupBy("key").agg(F.collect_list("w").alias("weighted")).hint("merge"), "key", "left")


def _sparse_scores(asked: pd.DataFrame, passages: pd.DataFrame, avgdl: float, p: BM25) -> tuple[np.ndarray, np.ndarray]:
    """Scores, passages by queries, and whether they share a term."""
    weighted = [[] if w is None else w for w in asked["weighted"]]
    vocabulary, at = np.unique(np.array([x["term"] for w in weighted for x in w], dtype=np.int64), return_inverse=True)
    weights, has = np.zeros((len(vocabulary), len(asked))), np.zeros((len(vocabulary), len(asked)), dtype=np.float32)
    column = np.repeat(np.arange(len(asked)), [len(w) for w in weighted])
    weights[at, column], has[at, column] = [x["weight"] for w in weighted for x in w], 1
    scores, shared = np.zeros((len(passages), len(asked))), np.zeros((len(passages), len(asked)), dtype=bool)
    if not len(vocabulary):
        return scores, shared
    for lo in range(0, len(passages), _ROWS):
        terms = [np.asarray(t, dtype=np.int64) for t in passages["terms"].iloc[lo : lo + _ROWS]]
        sizes = np.fromiter(map(len, terms), np.int64, len(terms))
        every, row = np.concatenate(terms), np.repeat(np.arange(len(terms)), sizes)
        place = np.minimum(np.searchsorted(vocabulary, every), len(vocabulary) - 1)
        known = vocabulary[place] == every
        tf = np.bincount(
            row[known] * len(vocabulary) + place[known],
            minlength=len(terms) * len(vocabulary),
        ).reshape(len(terms), -1)
        length = p.k1 * (1 - p.b + p.b * sizes / max(avgdl, 1e-12))
        scores[lo : lo + _ROWS] = (tf * (p.k1 + 1) / (tf + length[:, None] + (tf == 0))) @ weights
        shared[lo : lo + _ROWS] = ((tf > 0).astype(np.float32) @ has) > 0
    return scores, shared


def _matrix(pdf: pd.DataFrame, dim: int | None) -> np.ndarray:
    """A row of length 1 for each text, from its vector or its cells; a text without either has zeros."""
    if dim is None:
        width = max((len(v) for v in pdf["vector"] if v is not None), default=0)
        out = np.array(
            [np.zeros(width) if v is None else v for v in pdf["vector"]],
            dtype=np.float64,
        ).reshape(len(pdf), width)
    else:
        sizes = np.fromiter(map(len, pdf["cells"]), np.int64, len(pdf))
        every = np.concatenate([np.empty(0, np.int64), *pdf["cells"]]).astype(np.int64)
        out = np.bincount(
            np.repeat(np.arange(len(pdf)), sizes) * dim + every,
            minlength=len(pdf) * dim,
        ).reshape(len(pdf), dim).astype(np.float64)
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norms == 0, 1.0, norms)


def _best(score: np.ndarray, keys: np.ndarray, k: int, allowed: np.ndarray | None = None) -> np.ndarray:
    """Places of the ``k`` best, ties by key."""
    at = np.arange(len(keys)) if allowed is None else np.flatnonzero(allowed)
    rounded = np.round(score[at], 9)
    if len(at) > 4 * k:
        few = rounded >= np.partition(rounded, len(at) - k)[len(at) - k]
        at, rounded = at[few], rounded[few]
    return at[np.lexsort((keys[at], -rounded))[:k]]


def _in_grid(
    asked: DataFrame,
    passages: DataFrame,
    n_asked: int,
    n_passages: int,
    cell: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """``cell`` over each block of ``asked`` with each slice of ``passages``, both keyed by ``key``."""
    spark = passages.sparkSession
    slices = max(-(-n_passages // SLICE), min(spark.sparkContext.defaultParallelism, -(-n_passages // 256)), 1)
    blocks = max(-(-n_asked // BLOCK), 1)
    spot = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("block", spot(blocks)).withColumn("slice", every(slices))
    right = passages.withColumn("slice", spot(slices)).withColumn("block", every(blocks))
    tasks = min(blocks * slices, 4 * spark.sparkContext.defaultParallelism + 1000)
    # Where both sides come from one table, their columns must differ by name.
    left = left.select("block", "slice", *[F.col(c).alias(f"asked_{c}") for c in asked.columns])
    one, two = (t.repartition(tasks, "block", "slice").groupBy("block", "slice") for t in (left, right))
    return one.cogroup(two).applyInPandas(
        lambda a, b: cell(a.rename(columns=lambda c: c.removeprefix("asked_")), b),
        schema,
    )


def _scale(index: DataFrame) -> tuple[int, float]:
    found = index.agg(F.count("*"), F.avg(F.size("terms").cast("double"))).first()
    return found[0], found[1] or 0.0


def ranked(scores: DataFrame, score: str, k: int) -> DataFrame:
    """The best ``k`` of each query, with a 1-based ``rank``; the rank filter limits each partition before the shuffle."""
    w = Window.partitionBy("query").orderBy(F.desc(F.round(score, 9)), "key")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best_of_cells(score_and_allowed: Callable, name: str, k: int) -> Callable[
    [pd.DataFrame, pd.DataFrame],
    pd.DataFrame
]:
    def cell(asked: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(passages):
            keys = passages["key"].to_numpy()
            scores, allowed = score_and_allowed(asked, passages)
            for q, query in enumerate(asked["key"]):
                at = _best(scores[:, q], keys, k, None if allowed is None else allowed[:, q])
                out.append(pd.DataFrame({"query": query, "key": keys[at], name: scores[at, q]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "key": [], name: []})

    return cell


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, p: BM25 = BM25()) -> DataFrame:
    """(``query``, ``rank``, ``key``, ``sparse``) of the passages that share a term; a term of the query counts as often as it occurs."""
    index, asked = indexed(corpus), indexed(queries)
    n_docs, avgdl = _scale(index)
    cell = _best_of_cells(lambda a, b: _sparse_scores(a, b, avgdl, p), "sparse", k)
    found = _in_grid(
        _with_weights(asked, index, n_docs, p).drop("terms"),
        index,
        asked.count(),
        n_docs,
        cell,
        "query long, key long, sparse double",
    )
    return ranked(found, "sparse", k).select("query", "rank", "key", "sparse")


def hashed_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, dim: int = DIM) -> DataFrame:
    """(``query``, ``rank``, ``key``, ``dense``) by the product of unit-length hashed bags of words, for passages that share a cell."""
    index, asked = indexed(corpus, dim), indexed(queries, dim)

    def scores(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        product = _matrix(b, dim) @ _matrix(a, dim).T
        return product, product > 0

    found = _in_grid(
        asked.drop("terms"),
        index.drop("terms"),
        asked.count(),
        index.count(),
        _best_of_cells(scores, "dense", k),
        "query long, key long, dense double",
    )
    return ranked(found, "dense", k).select("query", "rank", "key", "dense")


def fused(
    queries: DataFrame, corpus: DataFrame, log_k: int = 10, alpha: float = 0.5, n_fetch: int | None = None,
    dim: int = DIM, p: BM25 = BM25(),
) -> DataFrame:
    """Both scores over all passages, min-max normalised per query, fused; the best ``log_k``: (``query``, ``rank``, ``key``, ``score``, ``dense``, ``sparse``).

    Dense scores are products of the ``vector`` columns when both tables have one, else of hashed bags of words. They count for the ``n_fetch`` nearest
    only, ``max(6 * log_k, 50)`` unless given; others have 0 before normalising. A passage that isn't fetched ranks by its sparse score alone, so the best ``n_fetch + log_k`` by either
    score in each cell hold all that can come out, and the extremes of a query come from its cells.
    """
    hashed = None if "vector" in queries.columns and "vector" in corpus.columns else dim
    index, asked = indexed(corpus, hashed), indexed(queries, hashed)
    n_docs, avgdl = _scale(index)
    fetch = n_fetch or max(6 * log_k, 50)

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["query", "key", "dense", "sparse", "low", "high", "n"]
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in names})
        keys, out = b["key"].to_numpy(), []
        sparse, _ = _sparse_scores(a, b, avgdl, p)
        dense = _matrix(b, hashed) @ _matrix(a, hashed).T
        for q, query in enumerate(a["key"]):
            at = np.union1d(_best(dense[:, q], keys, fetch), _best(sparse[:, q], keys, fetch + log_k))
            part = pd.DataFrame(
                {
                    "query": query, "key": keys[at], "dense": dense[at, q], "sparse": sparse[at, q],
                    "low": sparse[:, q].min(), "high": sparse[:, q].max(), "n": 0,
                }
            )
            part.loc[0, "n"] = len(b)
            out.append(part)
        return pd.concat(out)[names]

    schema = "query long, key long, dense double, sparse double, low double, high double, n long"
    found = _in_grid(_with_weights(asked, index, n_docs, p), index, asked.count(), n_docs, cell, schema)
    each = Window.partitionBy("query")
    place = F.row_number().over(each.orderBy(F.desc(F.round("dense", 9)), "key"))
    kept = found.select(
        "query",
        "key",
        F.when(place <= fetch, F.col("dense")).alias("near"),
        "sparse",
        "low",
        "high",
        "n",
    )
    n_near, total = F.count("near").over(each), F.sum("n").over(each)
    beside = F.when(n_near < total, 0.0)
    limits = kept.select(
        "query", "key", F.coalesce("near", F.lit(0.0)).alias("dense"), "sparse", F.min("low").over(each).alias("s_low"), F.max("high").over(each).alias("s_high"),
        F.least(F.min("near").over(each), beside).alias("d_low"), F.greatest(
            F.max("near").over(each),
            beside,
        ).alias("d_high"),
    )

    def scaled(c: str, low: str, high: str) -> Column:
        return F.when(F.col(high) - F.col(low) < 1e-9, 0.0).otherwise(
            (F.col(c) - F.col(low)) / (F.col(high) - F.col(low))
        )

    both = limits.select(
        "query",
        "key",
        "dense",
        "sparse",
        (alpha * scaled("dense", "d_low", "d_high") + (1 - alpha) * scaled("sparse", "s_low", "s_high")).alias("score"),
    )
    return ranked(both, "score", log_k).select("query", "rank", "key", "score", "dense", "sparse")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """Exact nearest neighbours by cosine: (``query``, ``rank``, ``key``, ``cosine``), a query isn't its own neighbour. Both sides have (``key``, ``vector``). Null vectors have no neighbours."""
    near, asked = (
        t.where("vector is not null").select("key", F.col("vector").cast("array<double>").alias("vector"))
        for t in (vectors, queries)
    )

    def scores(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return _matrix(b, None) @ _matrix(a, None).T, b["key"].to_numpy()[:, None] != a["key"].to_numpy()[None, :]

    found = _in_grid(
        asked,
        near,
        asked.count(),
        near.count(),
        _best_of_cells(scores, "cosine", k),
        "query long, key long, cosine double",
    )
    return ranked(found, "cosine", k).select("query", "rank", "key", "cosine")


def gold_index(chunks: DataFrame) -> DataFrame:
    """(``section``, ``id``, ``n_chunks``): a row for each chunk, with how many its section has; no section is gathered in one place."""
    counts = chunks.groupBy(F.col("section").alias("of_section")).agg(F.count("*").alias("n_chunks"))
    return chunks.join(counts, F.col("section").eqNullSafe(F.col("of_section"))).select("section", "id", "n_chunks")


def section_matches(sections: DataFrame, chunk_sections: DataFrame) -> DataFrame:
    """(``section``, ``chunk_section``, ``kind``): the exact section where the corpus has it, else its descendants and ancestors.

    Both tables hold distinct sections (``section``). Ancestors are the prefixes up to a dot, so the fallback is an equi-join on these.
    """

    def prefixes(c: str) -> Column:
        parts = F.split(c, r"\.")
        return F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."),
        )

    wanted = sections.where("section is not null").select("section")
    have = chunk_sections.where("section is not null").select(F.col("section").alias("chunk_section"))
    exact = wanted.join(have, F.col("section") == F.col("chunk_section")).select(
        "section",
        "chunk_section",
        F.lit("exact").alias("kind"),
    )
    rest = wanted.join(exact.select("section"), "section", "left_anti")
    up = rest.select("section", F.explode(prefixes("section")).alias("chunk_section")).join(have, "chunk_section")
    down = have.select("chunk_section", F.explode(prefixes("chunk_section")).alias("section")).join(rest, "section")
    related = up.select("section", "chunk_section").unionByName(down.select("section", "chunk_section")).distinct()
    return exact.unionByName(related.withColumn("kind", F.lit("related")))


def gold_chunks(rows: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows``: (``query``, ``label_source``). The gold passages (``query``, ``key``), and (``query``, ``gold_section``, ``kind``, ``n_gold``) of each row."""
    asked = cut_lineage(rows.select("query", governing_section(F.col("label_source")).alias("gold_section")))
    placed = cut_lineage(chunks.select("section", "key"))
    wanted, have = (
        cut_lineage(t.select(F.col(c).alias("section")).distinct())
        for t, c in ((asked, "gold_section"), (placed, "section"))
    )
    matches = cut_lineage(section_matches(wanted, have))
    sections = asked.join(matches, asked["gold_section"] == matches["section"]).select("query", "chunk_section", "kind")
    gold = sections.join(placed.select(F.col("section").alias("chunk_section"), "key"), "chunk_section").select(
        "query",
        "key",
        "kind",
    )
    counts = gold.groupBy("query").agg(F.count("*").alias("n_gold"), F.min("kind").alias("kind"))
    kinds = asked.join(counts, "query", "left").select(
        "query", "gold_section", F.when(F.col("gold_section").isNull(), "no-section").otherwise(F.coalesce("kind", F.lit("missing"))).alias("kind"), F.coalesce("n_gold", F.lit(0).cast("long")).alias("n_gold")
    )
    return gold.select("query", "key"), kinds


def per_row_metrics(ranking: DataFrame, gold: DataFrame, kinds: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """First gold rank, its reciprocal (0 beyond the ranking), hit and recall at each k; a row for each of ``kinds``."""
    marked = ranking.select("query", "rank", "key").join(gold.withColumn("gold", F.lit(True)), ["query", "key"])
    found = marked.groupBy("query").agg(
        F.min("rank").alias("first_gold_rank"),
        *[count_where(F.col("rank") <= k).alias(f"found_{k}") for k in ks],
    )
    joined = kinds.join(found, "query", "left").fillna(0, [f"found_{k}" for k in ks])
    at_k = [
        c
        for k in ks for c in (
            (F.col(f"found_{k}") > 0).cast("int").alias(f"hit_{k}"),
            share(F.col(f"found_{k}"), F.col("n_gold")).alias(f"recall_{k}"),
        )
    ]
    return joined.select(
        "query",
        "gold_section",
        "kind",
        "n_gold",
        "first_gold_rank",
        F.coalesce(1.0 / F.col("first_gold_rank"), F.lit(0.0)).alias("mrr"),
        *at_k,
    )


def retrieval_summary(per_row: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """``per_row`` with ``area`` and ``edge_case_type``; means overall, by area and by edge case, in one pass of grouping sets."""
    means = ", ".join(f"avg(hit_{k}) AS hit_{k}, avg(recall_{k}) AS recall_{k}" for k in ks)
    sql = f"""SELECT CASE grouping_id(area, edge_case_type) WHEN 3 THEN 'overall' WHEN 1 THEN 'area' ELSE 'edge_case_type' END AS level,
      CASE grouping_id(area, edge_case_type) WHEN 1 THEN area WHEN 2 THEN edge_case_type END AS value, count(*) AS n, avg(mrr) AS mrr, {means}
      FROM {{rows}} GROUP BY GROUPING SETS ((), (area), (edge_case_type))"""
    return per_row.sparkSession.sql(sql, rows=per_row)


def compared_runs(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two per-row results (``query``, ``area``, ``hit_5``) side by side: hits by area."""
    joined = one.select("query", "area", F.col("hit_5").alias("one")).join(
        two.select("query", F.col("hit_5").alias("two")),
        "query",
    )
    return joined.groupBy("area").agg(
        F.count("*").alias("n"),
        F.sum("one").alias("hits_one"),
        F.sum("two").alias("hits_two"),
    )
