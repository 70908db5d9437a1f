import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import near_duplicates
from plumbline.llm.near_duplicates import estimate, near_duplicate_groups, near_duplicate_pairs

SCHEMA = "row_no long, system_description string, key string, words long, rep int"


def brute(rows, threshold=0.85):
    sets = {k: set(t.lower().split()) for k, t in rows if k is not None and t and t.split()}
    return {
        (a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold
    }


def table(spark, rows):
    return spark.createDataFrame([(k, t, "clash", 1, 2) for k, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"word{i}" for i in range(400)]
    out, n = [], 0
    for _ in range(25):
        base = rng.sample(words, rng.randint(8, 60))
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 8))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                rng.shuffle(copy)
            n += 1
            out.append((n, " ".join(copy)))
    hot = " ".join(words[:40])
    out += [(1000 + i, hot if i % 3 else hot.upper() + " \t") for i in range(40)]
    edge = [
        (None, hot),
        (2000, None),
        (2001, ""),
        (2002, "  \n"),
        (2003, "one"),
        (2004, "ONE one"),
        (2005, " ".join(f"w{i}" for i in range(30_000))),
        (2006, " ".join(f"w{i}" for i in range(100, 30_000))),
    ]
    edge += [
        (2007, " ".join(f"t{i}" for i in range(17))),
        (2008, " ".join(f"t{i}" for i in range(20))),
        (2009, " ".join(f"t{i}" for i in range(21))),
    ]
    return out + edge


@pytest.fixture(params=["joined", "in blocks", "in small blocks"])
def way(request, monkeypatch):
    """The same results when hot buckets are found and verified in blocks."""
    if request.param != "joined":
        monkeypatch.setattr(near_duplicates, "SAMPLE", 1)
        monkeypatch.setattr(near_duplicates, "HOT", 2)
    if request.param == "in small blocks":
        monkeypatch.setattr(near_duplicates, "BLOCK", 2)
        monkeypatch.setattr(near_duplicates, "COLUMNS", 5)


def test_pairs_equal_brute_force(spark, rows, way):
    got = near_duplicate_pairs(table(spark, rows), "row_no", "system_description").collect()
    pairs = [(r.row_a, r.row_b) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(rows)
    assert (2007, 2008) in pairs and (2007, 2009) not in pairs  # 17 of 20 is on the threshold


def test_groups_follow_the_chains(spark, rows, way):
    pairs = brute(rows)
    least = {k: k for k, _ in rows if k is not None}
    for _ in rows:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.row_no: r for r in near_duplicate_groups(table(spark, rows), "row_no", "system_description").collect()}
    assert {k: r.group_id for k, r in got.items()} == least
    classes = {r.row_no: r.class_id for r in got.values()}
    links = {(classes[a], classes[b]) for a, b in pairs if classes[a] != classes[b]}
    assert {k: r.n_links for k, r in got.items()} == {
        k: len({frozenset(x) for x in links if classes[k] in x}) for k in got
    }
    assert got[1039].class_id == 1000 and got[2000].n_links == 0


def test_texts_of_one_template_form_no_blob(spark, monkeypatch):
    """They share keys of one band by the dozen, but not enough words: no reason to verify all pairs of them."""
    rng = random.Random(7)
    common = [f"the{i}" for i in range(34)]
    rows = [(n, " ".join(common + [f"own{rng.randrange(10_000)}" for _ in range(22)])) for n in range(300)]
    rows += [(1000 + n, text.replace("the7 ", "these ")) for n, text in rows[::10]]
    monkeypatch.setattr(near_duplicates, "SAMPLE", 1)

    def verified_in_blocks(*_):
        raise AssertionError("a blob")

    monkeypatch.setattr(near_duplicates, "_blob_links", verified_in_blocks)
    got = near_duplicate_pairs(table(spark, rows), "row_no", "system_description").collect()
    assert {(r.row_a, r.row_b) for r in got} == brute(rows) and len(got) == 30


def test_passes_and_places_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(near_duplicates, "PASS_BYTES", 50_000)
    monkeypatch.setattr(near_duplicates, "PLACE_BYTES", 3_000)
    got = near_duplicate_pairs(table(spark, rows), "row_no", "system_description").collect()
    assert {(r.row_a, r.row_b) for r in got} == brute(rows)


def test_no_rows(spark):
    empty = table(spark, [(1, "a")]).limit(0)
    assert near_duplicate_pairs(empty, "row_no", "system_description").count() == 0
    assert near_duplicate_groups(empty, "row_no", "system_description").count() == 0


def test_estimate_corrects_chance_agreement(spark):
    a, b = [F.lit(0)] * 2, [F.lit(0x5555555555555555)] * 2
    one = spark.range(1).select(estimate(a, a).alias("s"), estimate(a, b).alias("d")).first()
    assert one.s == 1.0 and one.d == pytest.approx(-1 / 3)
