"""All named queries of the core."""

from __future__ import annotations

from plumbline.plans import corpus_queries, generation_queries, problems, quality_queries, retrieval_queries, scoring_queries, segment_queries, source_queries

FLAGSHIP = "bucket_sweep"
_PARTS = (
    source_queries, segment_queries, corpus_queries, generation_queries, retrieval_queries, scoring_queries,
    quality_queries, problems,
)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}
