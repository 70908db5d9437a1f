import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import retrieval

DOCS = {1: "The cat sat on the mat", 2: "A dog and a cat", 3: "Nothing here", 4: "", 5: None, 6: "the dog, the dog!"}


def brute(query, docs):
    tokens = {k: re.findall("[A-Za-z0-9]+", (t or "").lower()) for k, t in docs.items()}
    n, avgdl = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = Counter(t for ts in tokens.values() for t in set(ts))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    out = {}
    for k, ts in tokens.items():
        tf = Counter(ts)
        s = sum(
            idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / avgdl))
            for t in re.findall("[A-Za-z0-9]+", query.lower()) if tf[t]
        )
        if any(t in tf for t in re.findall("[A-Za-z0-9]+", query.lower())):
            out[k] = s
    return out


def table(spark, rows):
    return spark.createDataFrame(list(rows.items()), "key long, text string")


def test_bm25_equals_brute_force(spark):
    q = "the cat and the dog"
    got = {r.key: r.sparse for r in retrieval.bm25_topk(table(spark, {9: q}), table(spark, DOCS), 10).collect()}
    assert got == pytest.approx(brute(q, DOCS))
    assert [
        r.key for r in retrieval.bm25_topk(table(spark, {9: q}), table(spark, DOCS), 2).orderBy("rank").collect()
    ] == sorted(got, key=lambda k: -got[k])[:2]


def test_empty_queries_and_corpora(spark):
    assert retrieval.bm25_topk(table(spark, {9: None}), table(spark, DOCS)).count() == 0
    assert retrieval.bm25_topk(table(spark, {9: "cat"}), table(spark, DOCS).limit(0)).count() == 0


def test_fusion_ranks_all_passages_and_constant_scores_are_zero(spark):
    q, c = table(spark, {9: "zebra"}), table(spark, DOCS)
    got = retrieval.fused(q, c, 10).orderBy("rank").collect()
    assert [r.key for r in got] == [1, 2, 3, 4, 5, 6]
    assert {r.score for r in got} == {0.0}


def test_unfetched_passages_have_no_dense_score(spark):
    vectors = {1: [0.9, 0.1], 2: [0.8, 0.3], 3: [0.7, 0.7], 4: [0.0, 0.0], 5: None, 6: [-1.0, 0.0]}
    q = table(spark, {9: "cat"}).withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))
    c = spark.createDataFrame(
        [(k, DOCS[k], v) for k, v in vectors.items()],
        "key long, text string, vector array<double>",
    )
    got = {r.key: r for r in retrieval.fused(q, c, 10, n_fetch=2).collect()}
    assert got[1].dense == pytest.approx(
        0.9 / math.sqrt(0.82)
    ) and got[3].dense == got[6].dense == 0.0 and len(got) == 6


def fused_by_hand(queries, docs, log_k, n_fetch):
    bag = lambda t: Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % retrieval.DIM for w in re.findall("[A-Za-z0-9]+", (t or "").lower()))
    norm = lambda c: math.sqrt(sum(v * v for v in c.values())) or 1.0
    scaled = lambda v, vs: 0.0 if max(vs) - min(vs) < 1e-9 else (v - min(vs)) / (max(vs) - min(vs))
    bags, out = {k: bag(t) for k, t in docs.items()}, {}
    for q, text in queries.items():
        b, found = bag(text), brute(text or "", docs)
        sparse = {k: found.get(k, 0.0) for k in docs}
        dense = {k: sum(b[x] * c[x] for x in b) / norm(b) / norm(c) for k, c in bags.items()}
        near = set(sorted(docs, key=lambda k: (-round(dense[k], 9), k))[:n_fetch])
        dense = {k: dense[k] if k in near else 0.0 for k in docs}
        score = {k: 0.5 * scaled(dense[k], dense.values()) + 0.5 * scaled(sparse[k], sparse.values()) for k in docs}
        out[q] = sorted(docs, key=lambda k: (-round(score[k], 9), k))[:log_k]
    return out


def test_the_grid_changes_nothing(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["the", "of", *(f"w{i}" for i in range(30))]) for _ in range(n))
    docs = {k: text(rng.randrange(1, 30)) for k in range(60)} | {60: None, 61: "", 62: "of of of"}
    docs[63] = docs[5]
    queries = {k: text(8) for k in range(7)} | {7: "", 8: "unknown words"}
    truth = fused_by_hand(queries, docs, 5, 8)
    for piece, block in ((8192, 256), (7, 2)):
        monkeypatch.setattr(retrieval, "SLICE", piece)
        monkeypatch.setattr(retrieval, "BLOCK", block)
        got = retrieval.fused(
            table(spark, queries),
            table(spark, docs),
            5,
            n_fetch=8,
        ).orderBy("query", "rank").collect()
        assert {q: [r.key for r in got if r["query"] == q] for q in queries} == truth
    assert retrieval.fused(table(spark, queries).limit(0), table(spark, docs), 5).count() == 0 == retrieval.fused(
        table(spark, queries),
        table(spark, docs).limit(0),
        5,
    ).count()


def test_nearest_leaves_out_itself_and_takes_zero_vectors(spark):
    v = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])],
        "key long, vector array<float>",
    )
    got = retrieval.nearest(v.where("key = 1"), v).orderBy("rank").collect()
    assert [r.key for r in got] == [2, 3, 4]
    assert [round(r.cosine, 4) for r in got] == [0.7071, 0.0, -1.0]


@pytest.mark.parametrize(
    ("section", "have", "kind"),
    [("3.1.2", "3.1", "related"), ("3.1", "3.1.4", "related"), ("3.1", "3.10", None), ("3.1", "3.1", "exact")],
)
def test_section_fallback_is_bounded_by_dots(spark, section, have, kind):
    got = retrieval.section_matches(
        spark.createDataFrame([(section,), (None,)], "section string"),
        spark.createDataFrame([(have,), (None,)], "section string"),
    ).collect()
    assert [r.kind for r in got] == ([kind] if kind else [])


def test_metrics(spark):
    rows = spark.createDataFrame(
        [(1, "guidelines, Section 3.1"), (2, "no number"), (3, "section 9.9")],
        "query long, label_source string",
    )
    chunks = spark.createDataFrame([(10, "3.1"), (11, "3.1"), (12, "4.1")], "key long, section string")
    gold, kinds = retrieval.gold_chunks(rows, chunks)
    ranking = spark.createDataFrame(
        [(1, 1, 12), (1, 2, 11), (1, 7, 10), (2, 1, 10), (3, 1, 10)],
        "query long, rank int, key long",
    )
    got = {r["query"]: r for r in retrieval.per_row_metrics(ranking, gold, kinds).collect()}
    assert (
        got[1].first_gold_rank,
        got[1].mrr,
        got[1].hit_5,
        got[1].recall_5,
        got[1].recall_10,
    ) == (2, 0.5, 1, 0.5, 1.0)
    assert (got[2].kind, got[2].mrr, got[2].recall_5) == ("no-section", 0.0, 0.0)
    assert (got[3].kind, got[3].n_gold) == ("missing", 0)
    full = retrieval.per_row_metrics(ranking, gold, kinds).withColumn("area", F.lit(None).cast("string")).withColumn(
        "edge_case_type",
        F.lit("none"),
    )
    assert {(r.level, r.value, r.n) for r in retrieval.retrieval_summary(full).collect()} == {
        ("overall", None, 3),
        ("area", None, 3),
        ("edge_case_type", "none", 3),
    }
