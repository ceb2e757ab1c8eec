"""Chunking reads whole documents, not their first lines."""

import hashlib
import os
import re
import sys

import pytest
from pyspark.sql import functions as F

from citeline.operators import chunking as C
from citeline.plans import chunk_plans
from citeline.sources.files import load_prompt

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_operators import plain_pack  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_chunks_reach_the_last_line(spark, tmp_path):
    text = "\n".join(f"Line {i} of the document has some words." for i in range(100))
    spark.createDataFrame([(1, text)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query in (chunk_plans.chunk_documents, chunk_plans.semantic_chunks):
        assert max(r.page_end for r in query(spark, str(tmp_path)).collect()) == 20


def test_a_word_is_hashed_once(spark, monkeypatch):
    """The offline embedding finds a word's bucket by one digest and counts it for all 32 dimensions; null and empty texts, more words than are kept."""
    assert "md5" not in chunk_plans.hashed_vector(F.lit("x"))._jc.toString()  # the JVM's form repeated it for each dimension
    calls, digest = [], hashlib.md5
    monkeypatch.setattr(chunk_plans.hashlib, "md5", lambda b: calls.append(b) or digest(b))
    monkeypatch.setattr(chunk_plans, "KNOWN_WORDS", 3)
    bucket = chunk_plans.Buckets(32)
    words = ["a", "b", "a", "", "c", "c", "a"]
    wanted = {w: int(digest(w.encode()).hexdigest()[:8], 16) % 32 for w in words} | {"": 32}
    assert [bucket[w] for w in words] == [wanted[w] for w in words] and calls == [b"a", b"b", b"c", b"c"] and len(bucket) == 3
    monkeypatch.undo()
    found = [r.v for r in spark.createDataFrame([(0, "B  a b"), (1, None), (2, "")], "i int, t string").select("i", chunk_plans.hashed_vector(F.col("t")).alias("v")).orderBy("i").collect()]
    assert found == [[sum(wanted[w] == i for w in ("b", "a", "b")) for i in range(32)], None, [0.0] * 32]


def plain_chunks(items):
    """(n, page_start, page_end, kind, text) of one document's items, by plain loops."""
    out, run = [], []

    def close():
        out.extend((a, b, "text", t) for a, b, t in plain_pack([(i["page"], i["text"]) for i in run]))
        run.clear()

    before = None
    for i in items:
        if i["kind"] == "table":
            close()
            caption = ""
            if before is not None and before["kind"] == "text":
                caption = before["text"].strip()
                if len(caption) > 200:
                    caption = [s for s in re.split(r"(?<=[.!?])\s+", caption) if s][-1][-200:]
            row = lambda cells: "| " + " | ".join(cells) + " |"
            head = [row(i["header"]), row(["---"] * len(i["header"]))]
            parts, now = [], ([caption] if caption else []) + head
            body = [row(r) for r in i["rows"]]
            if len("\n".join(now + body)) <= C.HARD_MAX:
                parts.append("\n".join(now + body))
            else:
                n = 0
                for r in body:
                    if n and len("\n".join(now)) + 1 + len(r) > C.HARD_MAX:
                        parts.append("\n".join(now))
                        now, n = list(head), 0
                    now.append(r)
                    n += 1
                parts.append("\n".join(now))
            out.extend((i["page"], i["page"], "table", p) for p in parts)
        else:
            if run and run[-1]["region"] != i["region"]:
                close()
            run.append(i)
        before = i
    close()
    return [(n, *x[:3], hashlib.md5(x[3].encode()).hexdigest()) for n, x in enumerate(out, 1)]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables here")
def test_rows_of_chunk_documents(spark):
    """Every row of the registered query on the small tables against plain loops."""
    docs = {}
    for r in chunk_plans.items(spark, SMALL).orderBy("doc_id", "seq").collect():
        docs.setdefault(r.doc_id, []).append(r.asDict())
    found = {}
    for r in chunk_plans.chunk_documents(spark, SMALL).orderBy("doc_id", "n").collect():
        found.setdefault(r.doc_id, []).append((r.n, r.page_start, r.page_end, r.kind, r.digest))
    assert set(found) == set(docs)
    assert [d for d in docs if found[d] != plain_chunks(docs[d])] == []


def test_prompts_are_read_once(spark, tmp_path):
    (tmp_path / "p.md").write_text("Extract é.", encoding="utf-8")
    assert load_prompt(str(tmp_path / "p.md")) == "Extract é."
    (tmp_path / "p.md").unlink()
    assert load_prompt(str(tmp_path / "p.md")) == "Extract é."
