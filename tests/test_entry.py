import importlib.util
import sys
import warnings
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.plans import registry

DATA = Path("/root/testdata/sf0.001")
SMALL = (
    "bm25_topk", "dense_topk", "retrieval_summary", "class_metrics", "faith_statements", "bucket_sweep", "report_cases",
    "similar_pairs", "redaction_precedence", "cut_markers", "json_label_parse", "p2_found", "p2_loaded",
    "tolerant_lines", "config_folders", "csv_roundtrip", "appended_runs", "segment_sections", "guide_chunks",
    "guide_examples", "sentence_packing", "run_records", "judged_runs", "redaction_strict", "similar_links",
    "ext_bootstrap", "synthetic_buckets", "review_file",
)


def test_a_missing_dependency_costs_the_llm_queries_only(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("plumbline.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert entry.queries() == registry.QUERIES
    assert not any(m.startswith("plumbline.llm.") for m in sys.modules if m.endswith("queries")) and (
        len(said) == 1 or importlib.util.find_spec("plumbline.llm") is None
    )


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SMALL) <= set(entry.oracle_sql())


@pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")
@pytest.mark.parametrize("name", SMALL)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = entry.queries()[name](spark, str(DATA))
    names = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == names
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(show(r[c]) for c in names) for r in df.collect()) == sorted(
        tuple(show(r[at.index(c)]) for c in names) for r in found.fetchall()
    )
