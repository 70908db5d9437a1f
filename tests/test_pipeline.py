import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from plumbline import cli, report, schemas
from plumbline.operators import encoders, generation, segment
from plumbline.plans import registry
from plumbline.sources import files
from plumbline.streaming.follow import accuracy_windows, append_correctness, followed_runs

GUIDE = """
3.4. Employment, workers management and access to self-employment, point 4(a)
 12
(1) The first paragraph speaks of the recruitment of natural persons
    and goes on here.
  9 A footnote that is dropped
   with its second line
     but an indented line ends it.
(2) Below are some examples of systems that would be caught.
a) Practical example of systems falling within the high-risk use case, Point 4(b)
   - A system that ranks the applicants of a large employer by fit,
     going on in the next line.
   - Too short.
c) Practical example of systems exempted
   - A system that only formats the letters of applicants, see Article 6(3)(a) and
(3) Short.
  9.1 A heading out of range is taken for a footnote
(4) This paragraph is still within section 3.4 and is long enough.
"""


def documents(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")


def test_paragraphs_of_a_document(spark):
    got = segment.segment_corpus(documents(spark, GUIDE)).orderBy("seq").collect()
    assert [(c.para_num, c.section, c.annex_iii_area) for c in got] == [
        ("1", "3.4", "employment"),
        ("4", "3.4", "employment"),
    ]
    assert got[0].text == "The first paragraph speaks of the recruitment of natural persons and goes on here. but an indented line ends it."
    assert got[0].heading_path.startswith("employment | 3.4 Employment") and [c.id for c in got] == [
        "chunk-0001",
        "chunk-0002",
    ]


def test_examples_of_a_document(spark):
    got = segment.segment_examples(documents(spark, GUIDE)).orderBy("seq").collect()
    assert [(r.label, r.edge_case_type, r.annex_iii_point) for r in got] == [
        ("high-risk", "none", "4(b)"),
        ("not-high-risk", "article-6-3-filter", "4(b)"),
    ]
    assert got[1].notes == "Filter condition: Article 6(3)(a)" and got[1].needs_review == ["possibly_truncated"]
    assert got[0].label_source == "Annex III guidelines, section 3.4, a) subsection, para ~2" and got[0].needs_review is None


def test_state_of_a_document(spark):
    text = "2.1 General matters of this guideline\n(1) One paragraph that is long enough.\n 12\n   goes on after the page\na) Practical example of systems\n   which is held out\n(2) Two paragraphs that are long enough.\n  7 A note\n   of two lines\nDraft Commission guidelines on the classification\n   after the footer"
    got = segment.segment_corpus(
        documents(
            spark,
            text,
            "4.2 A part that isn't kept at all\n(1) One paragraph that is long enough.",
            "(1) A paragraph without any section above it.",
        )
    ).collect()
    assert sorted((r.doc_id, r.para_num, r.heading_path, r.text) for r in got) == [
        ("0", "1", "General principles | 2.1 General matters of this guideline", "One paragraph that is long enough. goes on after the page"), ("0", "2", "General principles | 2.1 General matters of this guideline", "Two paragraphs that are long enough. after the footer"),
    ]
    block = "3.2.3. Roads and traffic\na) Practical example of systems falling within the high-risk use case\n- A bullet that is long enough to count\n  and goes on\nan end of it\n  lost\n 4\n  lost too\n     – Another bullet that is long enough\n3.9. Something else, point 9(z)\nc) Practical example of systems exempted\n- A bullet of nothing known at all, of"
    found = segment.segment_examples(documents(spark, block)).orderBy("seq").collect()
    assert [(r.system_description, r.annex_iii_point, r.annex_iii_area, r.notes) for r in found[:2]] == [
        (
            "A bullet that is long enough to count and goes on",
            "2",
            "critical-infrastructure",
            "Sub-topic: road-traffic",
        ), ("Another bullet that is long enough", "2", "critical-infrastructure", "Sub-topic: road-traffic"),
    ]
    assert (found[2].annex_iii_point, found[2].needs_review) == (
        "9(z)",
        ["unknown_area", "possibly_truncated", "filter_row_missing_6_3_ref"],
    )


def test_segments_of_null_and_empty_documents(spark):
    df = spark.createDataFrame([("a", GUIDE), ("b", None), ("c", "")], "doc_id string, text string")
    assert segment.segment_corpus(df).count() == 2 and segment.segment_examples(df).count() == 2


class Failing:
    def __init__(self, times):
        self.times = times

    def complete(self, system, user):
        self.times -= 1
        if self.times >= 0:
            raise OSError("down " * 100)
        return "fine", {}


def test_retries_and_error_isolation():
    waits = []
    assert generation.completed(Failing(2), "s", "u", 4, waits.append) == ("fine", {}) and waits == [1.0, 2.0]
    text, usage = generation.completed(Failing(9), "s", "u", 3, waits.append)
    assert text == "" and len(usage["error"]) == 300
    with pytest.raises(ValueError, match="no model"):
        generation.get_model("other")


def test_verdicts_match_by_text_then_by_place():
    m = generation.matched_verdicts
    assert [v["verdict"] for v in m(["a", "b"], [{"statement": "b ", "verdict": 1}])] == [0, 1]
    assert [v["verdict"] for v in m(["a", "b"], [{"verdict": 1}, {"verdict": "0"}])] == [1, 1]
    assert [v["verdict"] for v in m(["a", "b"], [{"verdict": 1}])] == [0, 0]


class Scripted:
    def __init__(self, *replies):
        self.replies = replies

    def complete(self, system, user):
        return (self.replies[1] if user.startswith("Context") else self.replies[0]), {}


def test_judge_falls_back(spark):
    judge = generation.Judge(Scripted("no json", "neither"))
    assert judge.statements("q", "One. Two.") == ["One.", "Two."]
    assert generation.Judge(Scripted('{"statements": ["", 3]}', "")).statements("q", "One. Two.") == ["One.", "Two."]
    assert {v["reason"] for v in judge.verdicts("c", ["a"])} == {"judge-parse-failed"}
    runs = spark.createDataFrame(
        [(1, "a", "c", [("i", "text", 0.1)], "One. Two."), (2, "b", "c", [], "x")],
        "row_no long, id string, config string, retrieved_top5 array<struct<id:string,text:string,score:double>>, explanation string",
    )
    asked = spark.createDataFrame([("a", 1, "q")], "id string, row_no long, system_description string")
    good = generation.Judge(
        Scripted(
            '{"statements": ["One.", "Two."]}',
            '{"verdicts": [{"statement": "Two.", "verdict": 1, "reason": "r"}]}',
        )
    )
    got = {r.row_no: (r.faithfulness, r.skipped_reason) for r in generation.judged_runs(runs, asked, good).collect()}
    assert got == {1: (0.5, None), 2: (None, "no-retrieved-context")}


def test_registries():
    with pytest.raises(ValueError, match="no judge"):
        generation.get_judge("other")
    with pytest.raises(ValueError, match="no encoder"):
        encoders.get_encoder("other")
    assert generation.get_judge("stub") is None and generation.get_judge(
        "openai_compatible",
        model="m",
        base_url="b",
    ).model.model == "m"
    hosted = generation.get_model("vertex", model="m", project="p", region="r").request("s", "u")
    assert "/projects/p/locations/r/" in hosted.full_url and json.loads(hosted.data)["system"] == "s"
    plain = generation.get_model("anthropic", model="m").request("s", "u")
    assert plain.full_url.endswith("/v1/messages") and json.loads(plain.data)["model"] == "m"


def test_only_queries_get_the_prefix(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "cat"), (2, None)], "key long, text string")
    encoder = encoders.HashedEncoder(16, query_prefix="dog ")
    vectors = lambda as_queries: {r.key: r.vector for r in encoders.encoded(texts, encoder, as_queries).collect()}
    assert sum(x > 0 for x in vectors(False)[1]) == 1 and sum(vectors(False)[2]) == 0 and sum(
        x > 0 for x in vectors(True)[2]
    ) == 1
    assert vectors(True)[1] == encoder.encode(["dog cat"])[0].tolist()
    monkeypatch.setenv("PLUMBLINE_ENCODER", "sentence")
    assert encoders.get_encoder().query_prefix.startswith("Represent")


def test_a_null_reason_is_empty():
    assert generation.matched_verdicts(["a"], [{"statement": "a", "verdict": 1, "reason": None}]) == [
        {"statement": "a", "verdict": 1, "reason": ""}
    ]


def test_files(spark, tmp_path):
    path = tmp_path / "agent_structured.jsonl"
    path.write_text('{"id": "a", "config": "ignored", "parse_ok": true}\n\n{"id": "b"}\n', encoding="utf-8")
    (tmp_path / "other.jsonl").write_text('{"id": "c"}\n', encoding="utf-8")
    got = files.read_configs(spark, str(tmp_path), schemas.RUNS, ["agent_structured", "absent"])
    assert sorted((r.id, r.config) for r in got.collect()) == [("a", "agent_structured"), ("b", "agent_structured")]
    assert files.read_optional(spark, str(tmp_path / "none.jsonl"), schemas.RUNS).count() == 0
    (tmp_path / "bad.json").write_text('{"id": "a"}\n{broken\n\n', encoding="utf-8")
    good, bad = files.read_jsonl_tolerant(spark, str(tmp_path / "bad.json"), schemas.TEST_SET)
    assert [r.id for r in good.collect()] == ["a"] and [r.line for r in bad.collect()] == ["{broken"]
    files.write_jsonl(good, str(tmp_path / "out"))
    assert json.loads(
        next((tmp_path / "out").glob("*.json")).read_text(encoding="utf-8").splitlines()[0]
    )["label"] is None
    wanted = spark.createDataFrame([("a", "agent_structured"), ("z", "agent_structured")], "id string, config string")
    done = got.withColumn("usage", F.lit(None).cast("struct<input_tokens:int,output_tokens:int,error:string>"))
    files.write_jsonl(done, str(tmp_path / "done"))
    assert [
        r.id for r in files.append_missing(wanted, str(tmp_path / "done"), ["config", "id"], schemas.RUNS).collect()
    ] == ["z"]


class Counting:
    """Supports every statement, and writes down each call."""

    def __init__(self, path, options):
        assert options == {"model": "m"}
        self.path = path

    def complete(self, system, user):
        with open(self.path, "a", encoding="utf-8") as out:
            out.write("call\n")
        statements = [line.split(". ", 1)[1] for line in user.partition("Statements:\n")[2].splitlines()]
        return json.dumps(
            {
                "verdicts": [{"statement": s, "verdict": 1, "reason": None} for s in statements]
            } if statements else {"statements": []}
        ), {}


def test_command_line_end_to_end(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    (tmp_path / "guide.txt").write_text(GUIDE, encoding="utf-8")
    d = str(tmp_path)
    cli.main(["build-corpus", f"{d}/guide.txt", f"{d}/chunks"])
    cli.main(["extract", f"{d}/guide.txt", f"{d}/set"])
    cli.main(["check", f"{d}/set", f"{d}/checks.md"])
    cli.main(["generate", "--test-set", f"{d}/set", "--chunks", f"{d}/chunks", f"{d}/runs_out"])
    runs = spark.read.schema(schemas.RUNS).json(f"{d}/runs_out")
    assert runs.groupBy("config").count().count() == 3 and runs.where("pred_label is null").count() == 0
    assert {r.config for r in runs.where("size(retrieved_top5) = 0").collect()} == {"baseline1_plain_llm"}
    cli.main(["retrieval-eval", "--test-set", f"{d}/set", "--chunks", f"{d}/chunks", f"{d}/eval.md"])
    (tmp_path / "runs").mkdir()
    rows = [r.asDict(recursive=True) for r in runs.collect()]
    for config in {r["config"] for r in rows}:
        (tmp_path / "runs" / f"{config}.jsonl").write_text(
            "\n".join(json.dumps(r) for r in rows if r["config"] == config),
            encoding="utf-8",
        )
    cli.main(["score", "--runs-dir", f"{d}/runs", "--out-dir", f"{d}/scores"])
    for step in (["correctness", "--runs-dir", f"{d}/runs"], ["faithfulness", "--runs-dir", f"{d}/runs"], ["buckets", "--scoring-dir", f"{d}/steps"]):
        cli.main([*step, "--out-dir", f"{d}/steps"])
    tables = lambda name: (tmp_path / name).read_text(encoding="utf-8").split("## ", 1)[1]
    assert tables("steps/buckets.md").split("## means")[0].strip() in tables("scores/summary.md")
    monkeypatch.setitem(
        generation.JUDGES,
        "openai_compatible",
        lambda **options: generation.Judge(Counting(f"{d}/calls", options)),
    )
    cli.main(
        [
            "score", "--runs-dir", f"{d}/runs", "--out-dir", f"{d}/judged", "--judge", "openai_compatible",
            "--judge-model", "m", "--test-set", f"{d}/set",
        ]
    )
    judged = spark.read.json(f"{d}/judged/faithfulness")
    assert {r.judge for r in judged.collect()} == {"llm"} and judged.where(
        "faithfulness = 1.0"
    ).count() == judged.count() == 4
    assert len((tmp_path / "calls").read_text(encoding="utf-8").splitlines()) == 8
    cli.main(["embed-index", "--chunks", f"{d}/chunks", f"{d}/vectors"])
    assert {len(r.embedding) for r in spark.read.parquet(f"{d}/vectors").collect()} == {768}
    cli.main(
        [
            "retrieval-eval", "--test-set", f"{d}/set", "--chunks", f"{d}/chunks", "--encoder", "hashed",
            f"{d}/encoded.md",
        ]
    )
    assert (tmp_path / "encoded.md").read_text(encoding="utf-8") == (tmp_path / "eval.md").read_text(encoding="utf-8")
    capsys.readouterr()
    cli.main(["search", "recruitment of natural persons", "--chunks", f"{d}/chunks", "--top-k", "1"])
    assert capsys.readouterr().out.splitlines()[2].startswith("| 1 |")
    (tmp_path / "settings.json").write_text(
        json.dumps(
            {"generation": {"provider": "stub"}, "retrieval": {"alpha": 0.3}, "embedding": {"encoder": "hashed"}}
        ),
        encoding="utf-8",
    )
    cli.main(
        [
            "sanity-run", "--test-set", f"{d}/set", "--chunks", f"{d}/chunks", f"{d}/sanity", "--config-file",
            f"{d}/settings.json",
        ]
    )
    assert "| agent_structured | 2 |" in (tmp_path / "sanity" / "sanity.md").read_text(encoding="utf-8")
    (tmp_path / "plan.json").write_text(
        json.dumps({"markers": {"anx3-001": " by fit,"}, "drop": ["anx3-002"]}),
        encoding="utf-8",
    )
    cli.main(["cleanup", f"{d}/set", f"{d}/plan.json", f"{d}/clean", "--report", f"{d}/clean.md"])
    assert [r.id for r in spark.read.json(f"{d}/clean").collect()] == ["anx3-001"] and "| bad ending | 1 |" in (
        tmp_path / "clean.md"
    ).read_text(encoding="utf-8")
    cli.main(["report", "--runs-dir", f"{d}/runs", "--test-set", f"{d}/set", f"{d}/report.html"])
    assert "agent_structured" in (tmp_path / "scores" / "summary.md").read_text(encoding="utf-8")
    assert "<table>" in (tmp_path / "report.html").read_text(encoding="utf-8")


def test_pdfs_go_through_the_command(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"3.4. Employment\xff")
    got = files.read_pdfs(spark, str(tmp_path / "*.pdf"), ("tr", "a-z", "A-Z")).collect()
    assert [(r.doc_id.rsplit("/", 1)[1], r.text) for r in got] == [("a.pdf", "3.4. EMPLOYMENT\ufffd")]


def test_blank_lines_are_skipped_or_fail(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a"}\n\n{"id": "b"}\n', encoding="utf-8")
    (tmp_path / "y.jsonl").write_text('{"id": "a"}\n', encoding="utf-8")
    assert files.read_jsonl(spark, str(tmp_path / "x.jsonl"), schemas.TEST_SET).count() == 2
    assert [r.id for r in files.read_jsonl(spark, str(tmp_path / "y.jsonl"), schemas.TEST_SET, blank_lines=False).collect()] == ["a"]
    with pytest.raises(Exception, match="blank line"):
        files.read_jsonl(spark, str(tmp_path / "x.jsonl"), schemas.TEST_SET, blank_lines=False).collect()


def test_checks_of_many_rows_are_written_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    monkeypatch.setattr(report, "MAX_ROWS", 20)
    lines = [
        json.dumps(
            {
                "id": f"anx3-{i:03d}",
                "annex_iii_area": f"area {i % 3}",
                "system_description": "No end",
                "label": "high-risk",
            }
        )
        for i in range(30)
    ]
    (tmp_path / "set.jsonl").write_text("\n".join([*lines, "{broken"]), encoding="utf-8")
    cli.main(["check", str(tmp_path / "set.jsonl"), str(tmp_path / "checks.md")])
    text = (tmp_path / "checks.md").read_text(encoding="utf-8")
    for name, n in (("endings", 30), ("missing fields", 30), ("broken lines", 1), ("exact duplicates", 1), ("exact duplicate rows", 30), ("near duplicates", 0), ("lengths", 0)):
        folder = tmp_path / "checks_rows" / name.replace(" ", "_")
        assert f"| {name} | {n} | {folder} |" in text
        assert sum(len(f.read_text(encoding="utf-8").splitlines()) for f in folder.glob("*.json")) == n
    assert "| area | area 1 | 10 |" in text


def test_segmentation_queries_keep_state_over_lines(spark, tmp_path):
    texts = [f"Paragraph {i} speaks of the recruitment of natural persons." for i in range(20)]
    spark.createDataFrame(
        [(i, f"3.{i % 8 + 1}", str(i + 1), t) for i, t in enumerate(texts)],
        "row_no long, section string, para_num string, text string",
    ).write.parquet(str(tmp_path / "corpus_chunks.parquet"))
    spark.createDataFrame(
        [(i, f"{i % 8 + 1}(b)", t) for i, t in enumerate(texts)],
        "row_no long, annex_iii_point string, system_description string",
    ).write.parquet(str(tmp_path / "test_set.parquet"))
    chunks = registry.QUERIES["segment_sections"](spark, str(tmp_path)).collect()
    assert sorted((r.section, r.para_num, r.text) for r in chunks) == sorted(
        (f"3.{i % 8 + 1}", str(i + 1), t) for i, t in enumerate(texts)
    ) and len({r.doc_id for r in chunks}) == 3
    examples = registry.QUERIES["segment_examples"](spark, str(tmp_path)).collect()
    kinds = [("high-risk", "none"), ("not-high-risk", "none"), ("not-high-risk", "article-6-3-filter")]
    assert sorted((r.system_description, r.annex_iii_point, r.label, r.edge_case_type) for r in examples) == sorted(
        (t, f"{i % 8 + 1}(b)", *kinds[i % 3]) for i, t in enumerate(texts)
    )


def test_streamed_runs(spark, tmp_path):
    schema = StructType(
        [*schemas.RUNS.fields, StructField("loaded_at", TimestampType()), StructField("row_no", LongType())]
    )
    line = {
        "id": "a",
        "config": "c",
        "gold_label": "high-risk",
        "pred_label": "high-risk",
        "loaded_at": "2026-01-01T00:00:00",
        "row_no": 1,
    }
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text(
        "\n".join(json.dumps(x) for x in (line, line, {**line, "id": "b", "pred_label": None})),
        encoding="utf-8",
    )
    runs = followed_runs(spark, str(tmp_path / "in"), schema)
    append_correctness(runs, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted((r.id, r.correct) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [
        ("a", True),
        ("b", False),
    ]
    batch = spark.read.schema(schema).json(str(tmp_path / "in"))
    assert accuracy_windows(batch).first().n == 3
