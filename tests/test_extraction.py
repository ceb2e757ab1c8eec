"""Extraction as map and reduce: kept calls, resumption, reduction; rows of registered queries against plain loops; sources and sinks."""

import difflib
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from citeline.functions import text as T
from citeline.operators import answering as A
from citeline.operators import evalkit as V
from citeline.operators import extract as E
from citeline.operators import extraction as X
from citeline.operators.models import ModelError
from citeline.plans import extract_plans, registry
from citeline.sources.pages import Pages, page_file
from citeline.sources.staged import Uploads

SMALL = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables here")
CHUNKS = "report_id long, chunk_id long, page_start int, page_end int, kind string, text string"


def chunks(spark, n=47):
    rows = [(i % 2, i, i // 3, i // 3, "text", f"Chunk {i}.\nWe aim for net zero in plant {i % 4} by {2024 + i % 5}.") for i in range(n)]
    return spark.createDataFrame(rows, CHUNKS)


def test_a_killed_run_goes_on_where_it_stood(spark, tmp_path):
    logs, path = str(tmp_path), str(tmp_path / "answers")
    asked = spark.range(40).select(F.concat(F.lit("prompt "), F.col("id") % 30).alias("prompt")).withColumn("digest", F.sha2("prompt", 256))

    def model(run):
        def call(prompt):
            with open(f"{logs}/{run}", "a") as f:
                f.write(prompt + "\n")
            if run == "first" and prompt == "prompt 7":
                raise ValueError("killed")
            return json.dumps({"goals": []})

        return call

    def calls(run):
        return open(f"{logs}/{run}").read().split("\n")[:-1] if os.path.exists(f"{logs}/{run}") else []

    with pytest.raises(PySparkException, match="killed"):
        X.complete_kept(asked, path, model("first"), wave=6)
    kept = {r.prompt for r in asked.join(X.kept_answers(spark, path), "digest").collect()}
    assert X.failed_calls(asked, path) == 30 - len(kept) and "prompt 7" not in kept
    assert X.complete_kept(asked, path, model("second"), wave=6).count() == 30
    assert sorted(calls("second")) == sorted({f"prompt {i}" for i in range(30)} - kept) and X.failed_calls(asked, path) == 0
    X.complete_kept(asked, path, model("third"))
    assert calls("third") == []


def test_a_failing_call_is_kept_as_an_error_and_tried_again(spark, tmp_path, monkeypatch):
    asked = spark.createDataFrame([("d1", "good"), ("d2", "bad")], "digest string, prompt string")
    mended = str(tmp_path / "mended")

    def model(prompt):
        if prompt == "bad" and not os.path.exists(mended):
            from citeline.operators import models

            models.time.sleep = lambda s: None
            raise ModelError("down")
        return "{}"

    with_errors = X.complete_kept(asked, str(tmp_path / "a"), model)
    assert [r.digest for r in with_errors.collect()] == ["d1"] and X.failed_calls(asked, str(tmp_path / "a")) == 1
    assert "down" in X.kept_answers(spark, str(tmp_path / "a")).where("error is not null").first().error
    open(mended, "w").close()
    assert X.complete_kept(asked, str(tmp_path / "a"), model).count() == 2 and X.failed_calls(asked, str(tmp_path / "a")) == 0


def test_goals_are_mapped_and_reduced(spark, tmp_path):
    years = spark.createDataFrame([(0, 2024), (1, 2026)], "report_id long, fiscal_year int")
    found = X.extract_goals(chunks(spark), years, str(tmp_path / "a"), X.offline_goals).collect()
    assert found and all(r.verified and r.page == r.chunk_id // 3 and r.target_year > (2024, 2026)[r.report_id] for r in found)
    # A plain loop over the same answers.
    for report, year in ((0, 2024), (1, 2026)):
        mine = sorted((i // 3, i) for i in range(47) if i % 2 == report)
        goals = []
        for b in range(0, len(mine), 10):
            prompt = "\n\n".join(f'<source id="S{k}" pages="{p}" kind="text">\nChunk {i}.\nWe aim for net zero in plant {i % 4} by {2024 + i % 5}.\n</source>' for k, (p, i) in enumerate(mine[b : b + 10], 1))
            goals += [(g, mine[b + int(g["source_id"][1:]) - 1][1]) for g in json.loads(X.offline_goals(prompt))["goals"]]
        kept = plain_dedupe([(g | {"chunk": c}) for g, c in goals if g["target_year"] > year])
        assert [r.chunk_id for r in sorted((r for r in found if r.report_id == report), key=lambda r: r["rank"])] == [g["chunk"] for g in kept]


def plain_dedupe(goals):
    text = lambda g: "".join(c for c in f"{g['title'] or ''} {g['target'] or ''}".lower() if not c.isspace() and c != "-")
    kept = []
    for g in goals:
        for i, k in enumerate(kept):
            if (k["category"], k["target_year"]) == (g["category"], g["target_year"]) and difflib.SequenceMatcher(None, text(g), text(k)).ratio() >= 0.6:
                if len(g["quote"] or "") > len(k["quote"] or ""):
                    kept[i] = g
                break
        else:
            kept.append(g)
    return kept


def test_unknown_sources_and_not_found(spark, tmp_path):
    model = lambda p: json.dumps({"goals": [{"quote": "q", "source_id": s, "title": "t", "category": "other"} for s in ("S1", "S99", None)]})
    years = spark.createDataFrame([(0, 2024)], "report_id long, fiscal_year int")
    found = X.extract_goals(chunks(spark, 5), years, str(tmp_path / "a"), model).collect()
    assert [(r.report_id, r.chunk_id, r.verified) for r in found] == [(0, 0, False)]
    ranked = chunks(spark, 6).withColumn("rank", F.col("chunk_id"))
    assert X.extract_workforce(ranked, str(tmp_path / "b"), X.offline_workforce).collect() == []
    fact = ranked.withColumn("text", F.when(F.col("chunk_id") == 3, "We had 12,345 employees.").otherwise(F.col("text")))
    got = X.extract_workforce(fact, str(tmp_path / "b"), X.offline_workforce).collect()
    assert [(r.report_id, r.chunk_id, r.value, r.verified, r.page) for r in got] == [(1, 3, 12345.0, True, 1)]


def test_page_items(spark):
    rows = spark.createDataFrame([(1, 5, "fte"), (1, 3, "fte"), (1, 4, "sustainability_goal"), (2, 9, "sustainability_goal"), (2, 8, "else")], "report_id int, id int, kind string")
    figures, goals = E.page_items(rows)
    assert [(r.report_id, r.id) for r in figures.collect()] == [(1, 3)] and {r.id for r in goals.collect()} == {4, 9}


@here
def test_rows_of_dedupe_goals(spark):
    rows = [r.asDict() for r in extract_plans.goals(spark, SMALL).orderBy("pos").collect()]
    for report in range(10):
        kept = plain_dedupe([r for r in rows if r["report_id"] == report])
        found = registry.QUERIES["dedupe_goals"](spark, SMALL).where(F.col("report_id") == report).orderBy("slot").collect()
        assert [(r.pos, r.quote) for r in found] == [(k["pos"], k["quote"]) for k in kept]
        if report == 1:
            break


@here
def test_rows_of_extracted_goals(spark):
    found = registry.QUERIES["extracted_goals"](spark, SMALL).collect()
    assert found and all(r.verified and (r.target_year is None or r.target_year > 2024) for r in found)
    held = {r.chunk_id: r.text for r in extract_plans.statements(spark, SMALL).collect()}
    assert all(r.quote in held[r.chunk_id] for r in found)


def test_block_text(spark):
    rows = [([["Emis", "sions fell by 4 per-"], ["cent  in total", "."], [" ", "\t"], [None, "End"]],), (None,), ([],), ([[" "]],)]
    found = [r.t for r in spark.createDataFrame(rows, "lines array<array<string>>").select(T.block_text(F.col("lines")).alias("t")).collect()]
    assert found == ["Emissions fell by 4 percent in total. End", "", "", ""]
    assert spark.range(1).select(T.clean_cell(F.lit(" a|b\n c ")).alias("c")).first().c == "a/b c"


def pages_folder(tmp_path, n=23):
    block = lambda p, i: {"kind": "text", "box": [i, p, i + 1, p + 1], "lines": [[f"page {p} ", f"block {i} é"]]}
    for doc, count in ((1, n), (2, 3), (3, 0)):
        pages = [[block(p, i) for i in range(p % 3)] + [{"kind": "table", "header": ["h"], "rows": [["1"], [str(p)]]}] for p in range(1, count + 1)]
        (tmp_path / f"{doc}.pages").write_bytes(page_file(doc, pages))
    return str(tmp_path)


def test_pages_of_a_document_are_read_by_several_tasks(spark, tmp_path):
    spark.dataSource.register(Pages)
    folder = pages_folder(tmp_path)
    many = spark.read.format("pages").load(folder)
    whole = spark.read.format("pages").option("task_pages", 1000).load(folder)
    assert many.rdd.getNumPartitions() == 6 and whole.rdd.getNumPartitions() == 2
    assert sorted(map(str, many.collect())) == sorted(map(str, whole.collect()))
    rows = many.where("doc_id = 1 and page = 23").orderBy("block_no").collect()
    assert [r.kind for r in rows] == ["text", "text", "table"] and rows[2].rows == [["1"], ["23"]] and rows[1].lines == [["page 23 ", "block 1 é"]]
    assert many.where("kind = 'text'").select(T.block_text(F.col("lines")).alias("t")).where("t like 'page 23 block 1%'").count() == 1


def uploads(spark, rows):
    spark.dataSource.register(Uploads)
    return spark.createDataFrame(rows, "name string, content binary").repartition(3)


def test_a_rejected_upload_leaves_nothing(spark, tmp_path):
    good, bad = [("a", b"%PDF-1"), ("b", b"%PDF-1"), ("c", b"%PDF-2")], [("d", b"nope"), ("e", b""), ("f", None), ("g", b"%PDF-" + b"x" * 100)]
    write = lambda rows, **o: uploads(spark, rows).write.format("uploads").options(path=str(tmp_path), max_bytes=50, **o).mode("append").save()
    for b in bad:
        with pytest.raises(PySparkException):
            write([*good, b])
        assert os.listdir(tmp_path) == []
    write([*good, *bad], rejects="skip")
    stored = sorted(os.listdir(tmp_path))
    assert len(stored) == 2 and {(tmp_path / f).read_bytes() for f in stored} == {b"%PDF-1", b"%PDF-2"}
    write([("again", b"%PDF-2"), ("new", b"%PDF-3")])
    assert len(os.listdir(tmp_path)) == 3


def test_answers_are_checked(spark, tmp_path):
    turns = spark.createDataFrame(
        [(1, "what?", None, '<source id="S1">\nWe emit 5,120 tonnes.\n</source>', None), (2, "and then?", "what then?", "", "User: what?"), (3, "bad", None, '<source id="S1">\nx\n</source>', "")],
        "turn_id long, message string, interpreted_as string, context string, history string",
    )
    prompts = {r.turn_id: r.p for r in turns.select("turn_id", A.answer_prompt(F.col("message"), F.col("interpreted_as"), F.col("context"), F.col("history")).alias("p")).collect()}
    assert prompts[1] == '<sources>\n<source id="S1">\nWe emit 5,120 tonnes.\n</source>\n</sources>\n\nQuestion: what?'
    assert prompts[2] == f"<sources>\n{A.NO_SOURCES}\n</sources>\n\nConversation so far:\nUser: what?\n\nQuestion: and then?\nInterpreted as: what then?"
    sources = spark.createDataFrame([(1, "S1", "We emit 5,120 tonnes."), (3, "S1", "x")], "turn_id long, source_id string, text string")

    def model(prompt):
        if "Question: bad" in prompt:
            return json.dumps({"citations": [{"source_id": "S1", "quote": "made up", "value_text": "7"}, {"source_id": "S9", "quote": "x"}], "status": "answered", "answer": "It is 9,999 [S1] [S9]."})
        return A.offline_answer(prompt)

    found = {r.turn_id: r for r in A.answered(turns, sources, str(tmp_path / "a"), model).collect()}
    assert found[1].status == "answered" and found[1].citations[0].verified and found[1].caveats == []
    assert found[2].status == "not_found" and found[2].citations == []
    assert found[3].status == "partial" and len(found[3].citations) == 1 and len(found[3].caveats) == 3


def test_gold_set_and_small_reports(spark, tmp_path):
    rows = [(i, 1, "table" if i < 3 else "text", i, f"line {i} " * 100) for i in range(4)] + [(10 + i, 2, "table" if i < 3 else "text", i, f"row {i} " * (90 + i)) for i in range(20)] + [(90, 3, "text", 1, "short")]
    df = spark.createDataFrame(rows, "id long, report_id long, kind string, page_start int, text string")
    found = V.sample_chunks(df, 5).collect()
    assert {r.id for r in found if r.report_id == 1} == {0, 1, 2, 3} and len([r for r in found if r.report_id == 2]) == 5 and not [r for r in found if r.report_id == 3]
    named = df.withColumns({"company": F.lit("acme"), "fiscal_year": F.lit(2024)})
    model = lambda p: json.dumps({"usable": "line 0" in p or "line 1" in p, "question": "q?", "expected_quote": "line 0 line 0"})
    assert [(r.id, r.question) for r in A.gold_set(named.where("report_id = 1"), str(tmp_path / "g"), model).collect()] == [(0, "q?")]
