import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import clauses, collapsed, packed, redaction_sentences, statements
from plumbline.operators import quality, redact
from plumbline.operators.common import latest
from plumbline.operators.components import connected_components

SET = "row_no long, id string, source string, annex_iii_area string, annex_iii_point string, system_description string, label string, label_source string, edge_case_type string, notes string, needs_review array<string>"


def row(row_no, text="A text.", label="high-risk", point="1(a)", edge=None, notes=None, **other):
    return (
        row_no,
        other.get("id", f"anx3-{row_no:03d}"),
        "s",
        "area",
        point,
        text,
        label,
        "section 3.1",
        edge,
        notes,
        None,
    )


def rows(spark, *r):
    return spark.createDataFrame(list(r), SET)


def test_columns_of_text(spark):
    df = spark.createDataFrame([("  x\ty  ",), (None,), ("",)], "t string")
    assert [r.c for r in df.select(collapsed(F.col("t")).alias("c")).collect()] == ["x y", None, ""]
    one = spark.createDataFrame([("One. Two; (Three) four. five",)], "t string").select(
        redaction_sentences(F.col("t")).alias("a"),
        statements(F.col("t")).alias("b"),
        clauses(F.col("t")).alias("c"),
    ).first()
    assert one.a == ["One.", "Two;", "(Three) four. five"]
    assert one.b == ["One.", "Two; (Three) four.", "five"]
    assert one.c == ["One.", "Two;", "(Three) four.", "five"]


def test_packing_keeps_a_long_sentence(spark):
    long = "x" * 2000 + "."
    sentences = ("Some words here. " * 300).strip()
    texts = [long, "short", "", f"First one. {long} Last one; end", sentences]
    got = [
        r.p
        for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
            packed(F.col("t")).alias("p")
        ).collect()
    ]
    assert got[:4] == [[long], ["short"], [""], ["First one.", long, "Last one; end"]]
    assert " ".join(got[4]) == sentences and all(len(p) <= 1800 for p in got[4])
    assert all(len(a) + 1 + len("Some words here.") > 1800 for a in got[4][:-1])


def test_duplicates_and_similar_pairs_at_the_boundary(spark):
    words = [f"w{i}" for i in range(17)]
    a, b = " ".join([*words, "a", "b", "c"]), " ".join(words)  # 17 of 20
    t = rows(spark, row(1, a), row(2, b), row(3, "other"), row(4, " other "), row(5, None), row(6, ""))
    assert [(r.row_a, r.row_b, r.jaccard) for r in quality.similar_pairs(t).collect()] == [(1, 2, 0.85)]
    assert [(r.n, r.first_row, r.preview) for r in quality.exact_duplicates(t).collect()] == [(2, 3, "other")]


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 20, 27, 40, 41, 90, 200]:
        for _ in range(3):
            base = rng.sample(words, n)
            texts.append(" ".join(base))
            for _ in range(4):
                copy = [w for w in base if rng.random() > 0.06] + rng.sample(words, rng.randint(0, max(1, n // 12)))
                rng.shuffle(copy)
                texts.append(" ".join(copy))
    texts += ["", None, " ".join(f"v{i}" for i in range(6000)), " ".join(f"v{i}" for i in range(700, 6000))]
    sets = {k: frozenset((t or "").lower().split()) for k, t in enumerate(texts)}
    least = {}
    for k, x in sets.items():
        if x:
            least.setdefault(x, k)
    truth = {}
    for x, a in least.items():
        for y, b in least.items():
            if a < b and len(x & y) / len(x | y) >= 0.85:
                truth[a, b] = pytest.approx(len(x & y) / len(x | y))
    got = {(r.row_a, r.row_b): r.jaccard for r in quality.similar_pairs(rows(spark, *[row(k, t) for k, t in enumerate(texts)])).collect()}
    assert got == truth and len(truth) > 60


def test_every_copy_is_named(spark):
    t = rows(
        spark, row(1, "one two"), row(2, " two  ONE "), row(3, "other"), row(4, " other "), row(5, None), row(6, " "),
        row(7, "other\n", id=None), row(8, "Other"), row(9, "alone"), row(10, "one two"),
    )
    assert sorted((r.row_no, r.id, r.first_row, r.n) for r in quality.exact_duplicate_rows(t).collect()) == [
        (1, "anx3-001", 1, 2),
        (3, "anx3-003", 3, 3),
        (4, "anx3-004", 3, 3),
        (7, None, 3, 3),
        (10, "anx3-010", 1, 2),
    ]
    assert {r.row_no: r.rep for r in quality.similar_classes(t).collect()} == {
        1: 1, 2: 1, 10: 1, 3: 3, 4: 3, 7: 3, 8: 3, 9: 9,
    }
    assert quality.exact_duplicate_rows(t.limit(0)).count() == 0 and quality.similar_classes(t.limit(0)).count() == 0


def test_outliers_are_strict(spark):
    t = rows(
        spark,
        *[row(i, "x" * 100) for i in range(1, 40)],
        row(50, "x" * 10),
        row(51, "x" * 801),
        row(52, "x" * 60),
    )
    assert {(r.row_no, r.kind) for r in quality.length_outliers(t).collect()} == {(50, "short"), (51, "long")}
    assert quality.length_outliers(t.limit(0)).count() == 0


def test_mode_ties_go_to_the_first_and_small_points_are_left_out(spark):
    t = rows(
        spark,
        row(1, label="b"),
        row(2, label="a"),
        row(3, label="a"),
        row(4, label="b"),
        row(5, point="2", label="x"),
    )
    assert {r.row_no for r in quality.label_against_mode(t).collect()} == {2, 3}


def test_other_checks_and_nulls(spark):
    t = rows(
        spark,
        row(1, "No end", label="HIGH-RISK", edge="none"),
        row(2, None, label=None, id=None),
        row(3, "Ends)", label="odd"),
    )
    assert [r.row_no for r in quality.unterminated(t).collect()] == [1]
    assert {(r.row_no, r.missing) for r in quality.missing_fields(t).collect()} == {(2, "id,system_description,label")}
    assert [r.row_no for r in quality.filter_case_labels(t).collect()] == [1]
    assert quality.filter_case_labels(t, none_is_empty=True).count() == 0
    assert {r.row_no for r in quality.label_vocabulary(t).collect()} == {2, 3}
    assert {(r.level, r.value): r.n for r in quality.set_summary(t).collect()}[("rows", "all")] == 3


def test_redaction_order_of_sources(spark):
    t = rows(
        spark,
        row(1, "Plain text. It is high-risk. More."),
        row(2, "A."),
        row(3, "Keep. Drop volunteers here. Stay."),
        row(4, "As is."),
    )
    one = lambda **k: spark.createDataFrame([tuple(k.values())], ", ".join(f"{c} {kind}" for c, kind in zip(k, ("string", "string"), strict=False)))
    reviews, overrides = one(id="anx3-002", text="Seen, high-risk."), one(id="anx3-002", text="Never used.")
    strips = spark.createDataFrame(
        [("anx3-002", [(", high-risk.", ".")])],
        "id string, pairs array<struct<old:string,new:string>>",
    )
    trims = spark.createDataFrame([("anx3-003", ["volunteers"])], "id string, fragments array<string>")
    got = {
        r.row_no: (r.system_description, r.redaction)
        for r in redact.redacted(t, reviews, overrides, trims, strips).collect()
    }
    assert got == {
        1: ("Plain text. More.", "auto"),
        2: ("Seen.", "reviewer"),
        3: ("Keep. Stay.", "auto"),
        4: ("As is.", "unchanged"),
    }


def test_cut_markers(spark):
    t = rows(spark, row(1, "Whole. Junk follows"), row(2, "no end Junk"), row(3, "Nothing."), row(4, "Gone."))
    markers = spark.createDataFrame(
        [("anx3-001", " Junk"), ("anx3-002", " Junk"), ("anx3-003", " Junk")],
        "id string, marker string",
    )
    got = {
        r.row_no: (r.system_description, r.outcome) for r in redact.cut_at_markers(t, markers, ["anx3-004"]).collect()
    }
    assert got == {1: ("Whole.", "fixed"), 2: ("no end Junk", "bad ending"), 3: ("Nothing.", "marker not found")}


def test_dropped_ids_from_a_table(spark):
    t = rows(spark, row(1, "Whole. Junk"), row(2, "Gone."), row(3, "Stays.", id=None), row(4, "Stays, too."))
    markers = spark.createDataFrame([("anx3-001", " Junk"), ("anx3-002", " Junk")], "id string, marker string")
    dropped = spark.createDataFrame([("anx3-002",), ("anx3-002",), (None,), ("other",)], "id string")
    assert {r.row_no: r.outcome for r in redact.cut_at_markers(t, markers, dropped).collect()} == {
        1: "fixed",
        3: "kept",
        4: "kept",
    }


def test_latest_with_null_keys(spark):
    t = spark.createDataFrame([(None, 1, "a"), (None, 3, "b"), ("k", 2, None)], "k string, o long, v string")
    assert {(r.k, r.v, r.f) for r in latest(t, ["k"], "o", "f").collect()} == {(None, "b", 1), ("k", None, 2)}


def test_components(spark):
    links = spark.createDataFrame(
        [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)],
        "src long, dst long",
    )
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100}
    assert connected_components(links.limit(0)).count() == 0


def test_checkpoints_are_deleted_at_the_end(tmp_path):
    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
from plumbline.session import cut_lineage
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
kept = cut_lineage(spark.range(9))
from pathlib import Path
assert kept.count() == 9 and any(Path({str(tmp_path / "shared")!r}).rglob("part-*"))
"""
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120).returncode == 0
    assert not any((tmp_path / "shared").rglob("part-*"))
