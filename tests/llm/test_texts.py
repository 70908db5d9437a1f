import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import leakage, pair_defects, spam, splitting
from plumbline.llm.packing import bears_loss, fill, pack, packing_summary, token_counts
from plumbline.llm.truncation import cut_shares, judge, judged_rows
from plumbline.llm.words import WORD, Bitmap, hashes, lcs_length, lower_words, plain_words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=12), st.lists(st.integers(0, 5), max_size=12))
def test_common_subsequence_equals_the_table(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert lcs_length(a, b) == table[-1][-1]


@pytest.mark.parametrize(
    ("text", "evidence"),
    [
        (None, "blank"), ("", "blank"), ("N/A", "blank"), ("A whole sentence.", "terminated"), (
            'He said "yes."',
            "terminated",
        ), ("A cut sentence of…", "ellipsis"), ("Cut here ...", "ellipsis"), ("It is whole. ...", "terminated"),
        ("Some words and �", "broken character"), ("Some words and &am", "broken escape"), (
            "Some words \\u00",
            "broken escape",
        ), ("Some words <a href=", "open markup"), ("Some words (see the note", "open bracket"),
        ('Some words "of the', "open quote"), ("Some <b>words of the", "open markup"), ("Some <b>words</b> of the<br> text", "unterminated"), ("The <i>words <b>are</i> here", "unterminated"), ("Some words (e.g.", "open bracket"), ("Some words (for garbled text.", "terminated"), ('It is 5" wide.', "terminated"), ("It is (forgotten. And goes on", "unterminated"),
        ("The rate is 50%", "unterminated"), ("See page%20of%2", "broken escape"), ("Two words \\x4", "broken escape"), ("He said „so“ and [then", "open bracket"), ("It is <b>new.", "terminated"), ("Some words (in {braces [and", "open bracket"), ("Some words, which,", "dangling mark"), ("It is so. (point 1(c))", "terminated"), ("No stop at the end", "unterminated"),
    ],
)
def test_evidence(text, evidence):
    assert judge(text)[0] == evidence


def test_cut_and_whole_endings(spark):
    ends = ["was left out in 2016", "is kept by the head of unit", "runs during market days"]
    rng = random.Random(1)
    rows = [("t", i, "s1", " ".join(f"The record {rng.choice(ends)}." for _ in range(4))) for i in range(60)]
    whole = [("t", 100 + i, "s1", f"The tool is new. The record {e}") for i, e in enumerate(ends)]
    cut = [
        ("t", 200, "s2", "The tool is new. The record was left"),
        ("t", 201, None, "The tool is new. The record was left out in 20"),
        ("t", 202, "s2", "The tool is new. The record is kept by the he"),
        ("t", 203, "s2", "The record is kept by the " + "x " * 50_000),
    ]
    other = [("t", 300, "s2", None), ("t", 301, None, ""), ("t", 302, "s2", "null")]
    df = spark.createDataFrame(rows + whole + cut + other, "origin string, key long, source string, text string")
    judged = judged_rows(df)
    assert {r.key for r in judged.where("is_cut").collect()} == {200, 201, 202, 203}
    assert {(r.source, r.n_cut, r.n_rows) for r in cut_shares(judged).collect()} == {
        ("s1", 0, 63),
        ("s2", 3, 5),
        (None, 1, 2),
    }
    assert judged_rows(df.limit(0)).count() == 0


def test_a_missing_terminator_is_weighed_by_its_source(spark):
    known = [("t", i, "other", "It is so. The list ends here." if i % 20 < 13 else "It is so. The list ends here and goes on.") for i in range(200)]
    text = "It is so. The list ends here"
    open_ = [("t", 1000 + i, "mostly cut", f"It is so. The list of unheard{i}") for i in range(30)]
    lax = [("t", 2000 + i, "mostly whole", "It is so. The list ends here and goes on") for i in range(30)]
    df = spark.createDataFrame(known + open_ + lax + [("t", 1100, "mostly cut", text), ("t", 2100, "mostly whole", text)], "origin string, key long, source string, text string")
    judged = {r.key: r for r in judged_rows(df).collect()}
    assert judged[1100].whole_share == judged[2100].whole_share == pytest.approx(130 / 230)
    assert judged[1100].is_cut and not judged[2100].is_cut
    shares = {r.source: (r.n_cut, r.n_by_structure) for r in cut_shares(judged_rows(df)).collect()}
    assert shares == {"other": (0, 0), "mostly cut": (31, 0), "mostly whole": (0, 0)}


BODY = "".join(f"Sentence number {i} says something of the matter; it goes on a little. " for i in range(80))


def check_pieces(body, pieces, room, overlap=splitting.OVERLAP):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(body)
    for (start, end, _), (nxt, _, _) in zip(pieces, pieces[1:], strict=False):
        assert overlap[0] <= end - nxt <= overlap[1] and nxt > start
    assert all(0 < e - s <= room for s, e, _ in pieces)


@settings(max_examples=60, deadline=None)
@given(
    st.lists(
        st.sampled_from(["word ", "sentence. ", "clause; ", "long" * 80 + " ", "x" * 700 + " ", "a, "]),
        min_size=1,
        max_size=120,
    ),
    st.integers(450, 1800),
)
def test_pieces_cover_the_text_within_the_limit(parts, room):
    body = splitting.collapsed("".join(parts))
    check_pieces(body, splitting.plan(body, room), room)


def test_cuts_are_at_boundaries_where_there_are_any():
    pieces = splitting.plan(splitting.collapsed(BODY), 1500)
    check_pieces(splitting.collapsed(BODY), pieces, 1500)
    assert all(penalty <= splitting.CLAUSE for _, _, penalty in pieces)


def test_kinds_of_cut(spark):
    rows = [
        (1, "h", BODY),
        (2, None, "x" * 4000),
        (3, None, "short"),
        (4, None, None),
        (5, "h" * 1700, "Some text. " * 40),
        (6, None, "a" * 1800),
        (7, None, "a" * 1801),
        (8, "", "b" * 1800),
        (1, "h", BODY),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "row_no long, heading_path string, text string, piece_no int")
    assert sorted(map(tuple, splitting.oversized(df).collect())) == [
        (1, "boundary"),
        (1, "boundary"),
        (2, "forced"),
        (5, "boundary"),
        (7, "forced"),
        (8, "forced"),
    ]
    for r in splitting.split_pieces(df).collect():
        assert len(r.text) + (0 if r.heading is None else len(r.heading) + 1) <= 1800
    assert splitting.oversized(df.limit(0)).count() == 0


def test_only_headings_without_room_for_the_overlap_are_shortened(spark):
    sizes = [269, 898, 899, 900, 1200, 1398, 1399, 1700, 5000]
    df = spark.createDataFrame(
        [(n, "h" * n, BODY) for n in sizes] + [(0, None, BODY)],
        "row_no long, heading_path string, text string",
    )
    pieces = splitting.split_pieces(df).collect()
    assert {r.row_no for r in pieces} == {0, *sizes}
    for r in pieces:
        assert r.heading_shortened == (r.row_no > 1398)
        assert (r.heading is None) if r.row_no == 0 else len(r.heading) == min(r.row_no, 1398)
        assert len(r.text) + (0 if r.heading is None else len(r.heading) + 1) <= 1800
    body = splitting.collapsed(BODY)
    for n in {0, *sizes}:
        own = sorted((r for r in pieces if r.row_no == n), key=lambda r: r.piece_no)
        check_pieces(body, [(r.starts_at, r.ends_at, 0) for r in own], 1800)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=200))
def test_sequences_keep_all_limits(sizes):
    limits = (100, 7, 90 + 10)
    sequence, place = fill(np.array(sizes, dtype=np.int64), limits)
    for k in set(sequence.tolist()):
        inside = [s for s, q in zip(sizes, sequence, strict=True) if q == k]
        assert sum(inside) <= 100 and len(inside) <= 7
        assert sorted(p for p, q in zip(place, sequence, strict=True) if q == k) == list(range(len(inside)))
    assert len(set(sequence.tolist())) <= max(2 * sum(sizes) // 100 + 1, -(-len(sizes) // 7) + 1) + 1


def test_only_a_lower_limit_on_loss_binds():
    sizes = np.array([81, 60, 60, 40, 40, 30, 2, 1] * 5)
    most = lambda s: max(np.maximum(sizes - 1, 0)[s == k].sum() for k in set(s.tolist()))
    assert 80 < most(fill(sizes, (100, 64, 100))[0]) < 100 and most(fill(sizes, (100, 64, 80))[0]) <= 80


def test_links_markup_and_quotes_bear_no_loss():
    text = "Plain wörds\n> a quoted line\nsee <b>www.a.example/x</b> &amp; more"
    pieces = [c.encode() for c in text]
    kept = "".join(c for c, b in zip(text, bears_loss(text, pieces), strict=True) if b)
    assert kept == "Plain wörds\n\nsee   more"
    assert bears_loss(text, [text.encode()]).tolist() == [True] and bears_loss("", []).tolist() == []


@settings(max_examples=50, deadline=None)
@given(
    st.lists(st.tuples(st.integers(1, 60), st.integers(0, 59)), max_size=150),
    st.integers(60, 100),
    st.integers(1, 9),
)
def test_all_three_limits_are_kept(items, loss_limit, segments):
    sizes, losses = (np.array([x[0] for x in items], dtype=np.int64), np.array([min(x) for x in items], dtype=np.int64))
    sequence, _ = fill(sizes, (100, segments, loss_limit), losses)
    for k in set(sequence.tolist()):
        inside = sequence == k
        assert sizes[inside].sum() <= 100 and losses[inside].sum() <= loss_limit and inside.sum() <= segments


def test_every_text_is_packed_once(spark):
    rows = [(i, "some words of a text " * (i % 50)) for i in range(300)] + [
        (1000, None),
        (1001, ""),
        (1002, "word " * 7000),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_parts string")
    packed = pack(df, group=100)
    got = packed.collect()
    counts = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    assert all(r.n_loss == max(r.token_to - r.token_from - 1, 0) for r in got)
    for doc, n in counts.items():
        parts = sorted((r.token_from, r.token_to) for r in got if r.doc_id == doc)
        assert parts[0][0] == 0 and parts[-1][1] == n and all(
            a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False)
        )
        assert len(parts) == max(1, -(-n // 2048))
    for s in {r.sequence_id for r in got}:
        inside = sorted((r.segment_no, r.starts_at, r.token_to - r.token_from) for r in got if r.sequence_id == s)
        assert sum(x[2] for x in inside) <= 2048
        assert [x[1] for x in inside] == [sum(y[2] for y in inside[:k]) for k in range(len(inside))]
    summary = packing_summary(packed).first()
    assert summary.n_texts == len(rows) and summary.n_tokens == sum(counts.values())
    assert pack(df.limit(0)).count() == 0 and packing_summary(pack(df.limit(0))).first().n_sequences == 0


DESCRIPTION = "A monitoring tool which helps a hotel chain to route tasks to couriers in small batches. From shift records, the tool derives a ranked list that feeds the final decision. No result is kept after the pilot phase ends in May 2023."


def test_pair_defects(spark):
    sound = "The tool routes tasks, so it falls under point 4(b). A refusal of an applicant by a clerk would not change this reading."
    cases = [
        (1, "a", sound, "high-risk", None), (2, "a", None, "high-risk", "empty"), (3, "a", " \n", None, "empty"), (
            4,
            "a",
            "n/a.",
            "high-risk",
            "empty",
        ), (5, "a", DESCRIPTION, "high-risk", "echo"),
        (6, "A ", "The description reads: " + DESCRIPTION.lower().replace("hotel", "motel"), "high-risk", "echo"), (
            7,
            "a",
            "I am sorry, but I am unable to assess this system.",
            None,
            "refusal",
        ),
        (
            8,
            "a",
            "Das System ist daher als hochriskant einzustufen, weil es für die Auswahl von Personen eingesetzt wird.",
            "high-risk",
            "other_language",
        ), (9, "a", sound, None, "no_label"), (10, "a", sound, "maybe", "no_label"),
        (11, "missing", DESCRIPTION, "high-risk", None), (12, None, sound, " High-Risk ", None), (
            13,
            "a",
            'The term "Zweckbestimmung" is decisive for the reading of this point.',
            "high-risk",
            None,
        ),
        (14, "a", "The tool routes tasks, so it falls under point 4(b). A refusal of an appl", "high-risk", "truncated"), (15, "hot", DESCRIPTION, "high-risk", "echo"), (16, "a", "word " * 30_000 + ".", "high-risk", "other_language"),
    ]
    filler = [(1000 + i, "b", sound, "high-risk", None) for i in range(20)]
    runs = spark.createDataFrame(
        [(n, i, "c", t, p, "clash") for n, i, t, p, _ in cases + filler],
        "row_no long, id string, config string, explanation string, pred_label string, text string",
    )
    asked = [
        (1, "a", "s", DESCRIPTION),
        (2, "a", "s", DESCRIPTION),
        (3, None, "s", "x"),
        (4, "b", None, None),
        (5, "b", "s", ""),
    ]
    asked += [
        (100 + i, "hot", "s", DESCRIPTION.replace("hotel", f"hotel{i}")) for i in range(pair_defects.FEW_PROMPTS + 4)
    ]
    prompts = spark.createDataFrame(asked, "row_no long, id string, source string, system_description string")
    got = {r.row_no: r.defect for r in pair_defects.pair_defects(runs, prompts).collect()}
    assert got == {n: d for n, _, _, _, d in cases if d}
    assert pair_defects.pair_defects(runs.limit(0), prompts).count() == 0
    assert 5 not in {
        r.row_no for r in pair_defects.pair_defects(runs, prompts.limit(0)).where("defect = 'echo'").collect()
    }


@pytest.mark.parametrize(
    ("text", "is_refusal"),
    [
        ("This system cannot be assessed on the information given.", True), ("We are unable to assess this system.", True), ("Sorry, no assessment can be given.", True), ("Unable to classify this.", True), ("Unfortunately, an assessment is not possible here.", True),
        ("I'm sorry, but we can't help with that.", True), ("The system cannot be classified as high-risk.", False), (
            "A clerk who is unable to assess the case asks for help. It falls under point 4.",
            False,
        ), ("No decision can be taken without a clerk, so it is not high-risk.", False),
        ("The tool gives us no profile, so the exception applies.", False), (
            "Where an assessment is not possible, the tool hands over to a clerk.",
            False,
        ), ("", False),
    ],
)
def test_refusals_with_and_without_a_person(text, is_refusal):
    assert pair_defects.is_refusal(text) == is_refusal


def test_many_prompts_change_no_echo(spark, monkeypatch):
    rng = random.Random(5)
    sentence = lambda: " ".join(rng.choice(["tool", "clerk", "hotel", "record", "shift", "list", "task", "pilot", "result", "map"]) + str(rng.randrange(6)) for _ in range(12)) + "."
    base = [sentence() for _ in range(4)]
    prompts = [" ".join([*base, f"It has number {i}."]) for i in range(30)] + [
        " ".join(sentence() for _ in range(4)) for _ in range(10)
    ] + [" ".join([base[0], *(sentence() for _ in range(9))]), "Too short."]
    words = prompts[3].split()
    texts = {
        "echo": prompts[3], "reworded": " ".join(f"other{i}" if i % 7 == 3 else w for i, w in enumerate(words)), "half": " ".join([*base[:2], *(sentence() for _ in range(2))]), "short quote": prompts[40].split(". ")[3] + ".",
        "of several": " ".join(p.split(". ")[0] + "." for p in prompts[30:35]), "own": " ".join(
            sentence() for _ in range(4)
        ), "same word": "tool1 " * 9 + ".", "few words": "Too short.",
    }
    for k in range(40):
        text = rng.choice(prompts).split()
        texts[k] = " ".join(
            w if rng.random() > k / 100 else sentence().split()[0] for w in text[: rng.randint(1, len(text))]
        )
    is_echo = {t: pair_defects.is_echo(text, prompts) for t, text in texts.items()}
    assert [t for t in list(texts)[:8] if is_echo[t]] == ["echo", "reworded"] and 5 < sum(is_echo.values()) < 40
    rows = [(k, "hot", "c", text, "high-risk") for k, text in enumerate(texts.values())]
    rows += [
        rows[0],
        (None, *rows[0][1:]),
        (2, *rows[0][1:]),
        (900, None, "c", prompts[3], "high-risk"),
        (901, "hot", "c", None, "high-risk"),
    ]
    runs = spark.createDataFrame(rows, "row_no long, id string, config string, explanation string, pred_label string")
    asked = spark.createDataFrame(
        [(k, "Hot ", "s", p) for k, p in enumerate(prompts * 2)],
        "row_no long, id string, source string, system_description string",
    )
    found = []
    for few, block in ((1000, 1024), (16, 1024), (16, 9)):
        monkeypatch.setattr(pair_defects, "FEW_PROMPTS", few)
        monkeypatch.setattr(pair_defects, "BLOCK", block)
        found.append(sorted(map(str, pair_defects.pair_defects(runs, asked).collect())))
        echoes = [r.row_no for r in pair_defects.pair_defects(runs, asked).where("defect = 'echo'").collect()]
        assert sorted(e for e in echoes if e is not None) == sorted(
            [*(k for k, t in enumerate(texts) if is_echo[t]), 0, 2]
        ) and echoes.count(None) == 1
    assert found[0] == found[1] == found[2]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(120)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.choice([12, 25, 40]))] for i in range(12)}
    docs = {}
    for d in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            item = items[rng.randrange(12)]
            n = rng.randint(10, len(item))
            start = rng.randint(0, len(item) - n)
            part = item[start : start + n]
            for _ in range(rng.randint(0, n // 6)):
                k, how = rng.randrange(len(part)), rng.random()
                part[k : k + 1] = ["zz"] if how < 0.4 else [] if how < 0.7 else [part[k], "yy"]
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs[d] = words
    text = lambda ws: "\n> ".join([" ".join(ws[:7]).upper() + ", ", " ".join(ws[7:])])
    truth = {(d, i) for d, ws in docs.items() for i, it in items.items() if leakage._aligns(hashes(it), hashes(ws))}
    documents = spark.createDataFrame(
        [(d, text(ws), "clash") for d, ws in docs.items()] + [
            (900, None, ""),
            (901, "", ""),
            (902, " ".join(items[1] if len(items[1]) >= 20 else items[2]) + " filler" * 50_000, ""),
        ],
        "doc_id long, text string, item_id string",
    )
    held = spark.createDataFrame(
        [(i, " ".join(ws)) for i, ws in items.items()] + [(99, None)],
        "item_id long, text string",
    )
    got = {tuple(r) for r in leakage.leaked_items(documents, held).collect()}
    assert {x for x in got if x[0] < 900} == truth and truth
    assert leakage.leaked_items(documents.limit(0), held).count() == 0 and leakage.leaked_items(
        documents,
        held.limit(0),
    ).count() == 0


def test_alignment_allows_one_edit_in_eight():
    item = hashes([f"w{i}" for i in range(40)])
    words = [f"w{i}" for i in range(40)]
    near = lambda ws: leakage._aligns(item, hashes(ws))
    assert near(words[5:25]) and not near(words[5:22])
    assert near([*words[5:11], "x", *words[12:18], "y", *words[19:25]])
    assert not near([*words[5:9], "x", *words[10:14], "y", *words[15:19], "z", *words[20:25]])
    assert near([*words[5:15], "added", *words[15:25]])


PROSE = "The provider of a tool has to document the purpose before it is used. A clerk reviews the result and may depart from it. The minutes record the comments on this. "


@pytest.mark.parametrize(
    ("text", "is_spam"),
    [
        (PROSE * 3, False), (PROSE + "\n\nTags: cheap audit, best label", False), (
            PROSE + "\n" + "\n".join(f"[{i}] Notes on the tool https://library.example/{i}" for i in range(9)),
            False,
        ),
        (PROSE + "\n- Profile: an assessment of a person built from reports.\n- Deployer: whoever puts the system to use in its own name.\n- Provider: the one that places it on the market.\n- Filter: the rule by which a narrow task is exempt.", False), ("cheap audit, best label, free form, " * 30, True), ("\n".join(f"www.shop{i % 3}.example/label/{i}" for i in range(40)), True),
        ("Our cheap audit is the best label for your free form! Looking for best label? Our free form and cheap audit beat every label. " * 10, True), ("#cheapaudit #bestlabel12 @free_form " * 20, True), (PROSE * 2 + "cheap audit, " * 10, False),
        (
            PROSE + "\n" + "\n".join(f"SKU-{i} | Free label | {i}.50 EUR buy now" for i in range(30)),
            True,
        ), (None, False), ("", False), ("  ", False),
    ],
)
def test_spam(spark, text, is_spam):
    rows = [(1, text, "https://a.example/1", "a", "clash"), (2, text, None, "b", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string, source string, host string")
    assert sorted(r.doc_id for r in spam.spam_pages(df).collect()) == ([1, 2] if is_spam else [])


def test_replication_decides_among_dense_pages(spark):
    letters = "abcdefghijklmnopqrst"
    own = lambda k: "\n".join(f"{letters[k]}{a}x {letters[k]}{b}y" for a in letters[:8] for b in letters[8:16])
    once = lambda k: "\n".join(f"{letters[k]}{a}{b}x {letters[k]}{b}{a}y" for a in letters[:7] for b in letters[7:14])
    pages = [(1, own(0), "https://a.example/1"), (2, once(1), "https://a.example/2")]
    pages += [(10 + i, once(2), f"https://{h}.example/{i}") for i, h in enumerate("bb")] + [
        (20 + i, once(3), f"https://{h}.example/{i}") for i, h in enumerate("bcc")
    ] + [(30 + i, once(4), f"https://{h}.example/{i}") for i, h in enumerate("bcd")]
    pages += [(40 + i, PROSE * 3, f"https://{h}.example/9") for i, h in enumerate("bcde")]
    df = spark.createDataFrame(
        [(d, t, u, "s") for d, t, u in pages],
        "doc_id long, text string, url string, source string",
    )
    got = {r.doc_id: r for r in spam.page_evidence(df).collect()}
    assert all(got[d].density > spam.DENSITY for d, _, _ in pages if d < 40)
    # Keywords of its own, on no other host; then a list of own wording, with a copy on its host, on one other host, and
    # on two.
    assert {d: r.evidence for d, r in got.items() if r.is_spam} == {1: "own repetition", 30: "other hosts", 31: "other hosts", 32: "other hosts"}
    assert got[2].stitched == got[20].stitched == 0.0 and got[30].on_hosts == 1.0 and got[40].stitched is None


def test_bitmap_has_what_was_put_in(spark):
    rng = np.random.default_rng(1)
    put, other = (rng.integers(0, 2**63, 2000, dtype=np.uint64) for _ in "ab")
    bitmap = Bitmap.of(
        spark.createDataFrame(
            [(x.view(np.int64).tolist(),) for x in np.array_split(put, 7)] + [(None,), ([],)],
            "h array<long>",
        )
    )
    assert bitmap.has(put).all() and bitmap.has(other).mean() < 0.01 and not Bitmap.of(
        spark.createDataFrame([], "h array<long>")
    ).has(other).any()


def test_spam_of_no_pages(spark):
    df = spark.createDataFrame([], "doc_id long, text string, url string, source string")
    assert spam.page_evidence(df).count() == 0


@given(st.text(st.characters(max_codepoint=127)))
def test_ascii_words_equal_the_pattern(text):
    assert lower_words(text) == WORD.findall(text.lower())


def test_words():
    assert plain_words("Don&#39;t A_b 3x Ü") == ["don", "t", "a", "b", "3x", "ü"]


def test_rows_without_a_key_do_no_harm(spark):
    judged = judged_rows(
        spark.createDataFrame(
            [("t", None, "s", "It is cut of…"), ("t", 2, "s", "It is cut of…")],
            "origin string, key long, source string, text string",
        )
    )
    assert sorted((r.key is None, r.is_cut) for r in judged.collect()) == [(False, True), (True, True)]
    chunks = spark.createDataFrame(
        [(None, None, BODY), (2, None, BODY)],
        "row_no long, heading_path string, text string",
    )
    assert {r.row_no for r in splitting.oversized(chunks).collect()} == {None, 2}
    runs = spark.createDataFrame(
        [(None, "a", "c", "", None), (2, "a", "c", "", None)],
        "row_no long, id string, config string, explanation string, pred_label string",
    )
    prompts = spark.createDataFrame(
        [(None, "a", "s", DESCRIPTION)],
        "row_no long, id string, source string, system_description string",
    )
    assert {r.row_no for r in pair_defects.pair_defects(runs, prompts).collect()} == {None, 2}
    pages = spark.createDataFrame([(None, "#a #b " * 40, None, None), (2, "#a #b " * 40, None, None)], "doc_id long, text string, url string, source string")
    assert {r.doc_id for r in spam.spam_pages(pages).collect()} == {None, 2}
    assert {r.doc_id for r in pack(pages).collect()} == {None, 2}
    held = spark.createDataFrame([(None, PROSE), (7, PROSE)], "item_id long, text string")
    documents = spark.createDataFrame([(None, PROSE), (2, PROSE)], "doc_id long, text string")
    assert (2, 7) in {tuple(r) for r in leakage.leaked_items(documents, held).collect()}
