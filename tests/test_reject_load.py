import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.operators import reject_load
from plumbline.operators.reject_load import FIELDS, exact_fields, parse_records, rejected, rejects, typed_rows

RAW = "row_no long, file_name string, raw_line string, received_at timestamp, id string"
SET = "row_no long, id string, source string, annex_iii_area string, annex_iii_point string, system_description string, label string, label_source string, edge_case_type string, notes string, loaded_at timestamp"
GOOD = 'anx3-001,s,a,1(a),"Text, with ""quotes"" and\na break",high-risk,"section 3.1, para",none,'


def reasons(*records):
    return [x[0] for x in parse_records(list(records), ["f"] * len(records))]


@pytest.mark.parametrize(
    ("record", "reason"),
    [
        (GOOD, None),
        (GOOD + ",", "column_count"),
        ("anx3-001", "column_count"),
        ("", "column_count"),
        (None, "column_count"),
        ('anx3-001,s,a,1(a),"open text,high-risk,l,none,', "quoting"),
        ('anx3-001,s,a,1(a),"closed" too early,high-risk,l,none,', "quoting"),
        ('anx3-001,s,a,1(a), "blank before",high-risk,l,none,', "quoting"),
        ('anx3-001,s,a,1(a),a "word" within,high-risk,l,none,', "quoting"),
        ('anx3-001,s,a,1(a),"back\\"slash",high-risk,l,none,', "quoting"),
        ('"anx3-001","s","a","1(a)","t","high-risk","l","none",""', None),
        ("anx3-001,s,a,1(a),t,high-risk,l,none,\r", None),
        ("anx3-001,s,a,1(a),t,high-risk,l,none," + "x" * 300_000, None),
    ],
)
def test_reasons(record, reason):
    assert reasons(record) == [reason]


def test_a_broken_record_takes_no_neighbour_with_it():
    broken = 'anx3-002,s,a,1(a),"open,high-risk,l,none,'
    found = parse_records([GOOD, broken, GOOD, broken, GOOD], ["f", "f", "f", "g", None])
    assert [x[0] for x in found] == [None, "quoting", None, "quoting", None]
    assert found[2][2][4] == 'Text, with "quotes" and\na break'


def test_valid_records_with_doubled_quotes_come_from_duckdb(monkeypatch):
    read = []
    monkeypatch.setattr(reject_load, "exact_fields", lambda r: read.append(r) or exact_fields(r))
    broken = GOOD.replace('""quotes""', '"quotes"')
    edge = 'anx3-001,s,a,1(a),"""","x""",l,none,"""a"""'
    found = parse_records([GOOD, edge, broken, GOOD], ["f"] * 4)
    assert [x[0] for x in found] == [None, None, "quoting", None] and read == [broken]
    assert found[0][2][4] == 'Text, with "quotes" and\na break' and found[1][2][4:] == ['"', 'x"', "l", "none", '"a"']


def test_rejects_have_the_line_level_error(spark):
    raw = spark.createDataFrame(
        [
            (1, "f", GOOD, None, "x"),
            (2, "f", GOOD + ",x", None, None),
            (3, "f", "anx3-001,s", None, None),
            (4, "f", GOOD.replace("high-risk", "maybe"), None, None),
            (5, "f", GOOD.replace('""quotes""', '"quotes"'), None, None),
            (6, "f", None, None, None),
        ],
        RAW,
    )
    raw = raw.unionByName(
        spark.createDataFrame(
            [
                (7, "f", GOOD + ",", None, None),
                (8, "f", 'anx3-001,s,a,1(a), "blank before",high-risk,l,none,', None, None),
            ],
            RAW,
        )
    )
    got = {
        r.row_no: (r.reason, r.settled_by, (r.detail or "").split(":")[0])
        for r in rejects(raw, spark.createDataFrame([], SET)).collect()
    }
    table, reading = "reject table", "exact reading"
    assert got == {
        2: ("column_count", table, "TOO MANY COLUMNS"), 3: ("column_count", table, "MISSING COLUMNS"), 4: (
            "bad_label",
            "value",
            "",
        ), 5: ("quoting", table, "UNQUOTED VALUE"), 6: ("column_count", reading, ""),
        7: ("column_count", table, "TOO MANY COLUMNS"), 8: ("quoting", reading, ""),
    }


def test_accepted_records_are_not_read_again(monkeypatch):
    monkeypatch.setattr(
        reject_load,
        "exact_fields",
        lambda r: (_ for _ in ()).throw(AssertionError(r)) if r == GOOD else exact_fields(r),
    )
    assert [x[0] for x in parse_records([GOOD, GOOD + ",", GOOD.replace("anx3-001", "x\r")], ["f"] * 3)] == [
        None,
        "column_count",
        None,
    ]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab ,"\n\\é', max_size=6), min_size=9, max_size=9), min_size=1, max_size=8))
def test_written_records_come_back(rows):
    records = []
    for r in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(r)
        records.append(out.getvalue())
    found = parse_records(records, ["f"] * len(records))
    for r, record, (reason, _, fields) in zip(rows, records, found, strict=True):
        if exact_fields(record) == r:
            assert reason is None and [f or "" for f in fields] == r


def test_tables_with_clashing_columns_and_empty_ones(spark):
    raw = spark.createDataFrame(
        [
            (1, "f", GOOD, None, "clash"),
            (2, "f", GOOD.replace("anx3-001", "NULL"), None, None),
            (3, None, GOOD.replace("high-risk", "maybe"), None, None),
        ],
        RAW,
    )
    held = spark.createDataFrame(
        [
            (1, " anx3-777 ", "s", "a", "2", None, " High-Risk ", "l", None, None, None),
            (2, None, "s", "a", "2", None, None, "l", None, None, None),
        ],
        SET,
    )
    assert {tuple(r) for r in rejected(raw, held).collect()} == {
        ("test_set_raw", 2, "bad_id"),
        ("test_set_raw", 3, "bad_label"),
        ("test_set", 2, "bad_id"),
    }
    typed = {(r.origin, r.row_no): r for r in typed_rows(raw, held).collect()}
    assert typed["test_set", 1].id == "anx3-777" and typed["test_set", 1].label == "high-risk" and typed["test_set", 1].point_number == 2
    assert typed["test_set_raw", 1].point_letter == "a" and typed["test_set_raw", 1].notes is None
    assert set(FIELDS) <= set(typed_rows(raw, held).columns)
    assert rejected(raw.limit(0), held.limit(0)).count() == 0
    unnamed = spark.createDataFrame(
        [(None, None, GOOD + ",", None, None), (9007199254740993, "f", None, None, None)],
        RAW,
    )
    assert {r.row_no for r in rejected(unnamed, held.limit(0)).collect()} == {None, 9007199254740993}
