from citeline.sources.files import append_by_report, checked_uploads, read_json, replace_reports, write_json
from citeline.streaming.intake import ingest, once_per_content, uploads


def test_intake_is_once_per_content(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, content in (("a.pdf", b"%PDF-1"), ("b.pdf", b"%PDF-1"), ("c.pdf", b"nope"), ("d.pdf", b"%PDF-2")):
        (folder / name).write_bytes(content)
    got = []
    run = lambda: ingest(once_per_content(uploads(spark, str(folder), "*.pdf")), str(tmp_path / "check"), lambda df, n: got.extend(bytes(r.content) for r in df.collect()))
    run()
    assert sorted(got) == [b"%PDF-1", b"%PDF-2"]
    (folder / "e.pdf").write_bytes(b"%PDF-2")
    (folder / "f.pdf").write_bytes(b"%PDF-3")
    run()
    assert sorted(got) == [b"%PDF-1", b"%PDF-2", b"%PDF-3"]
    (folder / "g.pdf").write_bytes(b"")
    assert {r.problem for r in checked_uploads(spark, str(folder)).collect()} == {None, "wrong type", "empty"}
    assert [r.path.rsplit("/", 1)[1] for r in checked_uploads(spark, str(folder)).where("problem = 'empty'").collect()] == ["g.pdf"]


def test_tables_and_json(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "report_id int, x string")
    append_by_report(rows, str(tmp_path / "t"))
    replace_reports(spark.createDataFrame([(2, "c")], "report_id int, x string"), str(tmp_path / "t"))
    assert sorted((r.report_id, r.x) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (2, "c")]
    write_json(rows, str(tmp_path / "j"))
    assert read_json(spark, str(tmp_path / "j"), "report_id int, x string").count() == 2
