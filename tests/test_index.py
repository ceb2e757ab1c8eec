"""Stored indexes: versions, pruning, replays, pinned readers, compaction, vectors with codes."""

import os
import random
import re
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeline.operators import retrieval as R
from citeline.operators import segments as S
from citeline.operators import text_index as I
from citeline.operators import vector_index as VI
from citeline.streaming.indexing import index_batch, index_stream, vector_stream

DOCS = "doc_id long, text string"


def texts(n, seed=0):
    r = random.Random(seed)
    return [(i, " ".join(f"w{r.randint(0, 80)}" for _ in range(r.randint(0, 12)))) for i in range(n)]


def held(index):
    found = index.postings()
    return sorted((r.doc_id, r.term, r.tf, tuple(r.positions), r.doc_len) for r in found.collect()) if found is not None else []


def wanted(spark, rows):
    return sorted((r.doc_id, r.term, r.tf, tuple(r.positions), r.doc_len) for r in R.postings(spark.createDataFrame(rows, DOCS), "doc_id", "text").collect())


def test_questions_read_only_their_terms(spark, tmp_path):
    """Bucket and term filters reach the scan; of all files only those of asked buckets are read, in one scan."""
    path = str(tmp_path / "index")
    rows = texts(400)
    version = I.index_append(spark.createDataFrame(rows, DOCS), path, bucket_tokens=40)
    assert version.segments[0]["buckets"] > 32
    index = I.index_read(spark, path)
    terms = {r.term: r.h for r in spark.createDataFrame([("w7",), ("w9",), ("never",)], "term string").select("term", F.xxhash64("term").alias("h")).collect()}
    some = index.postings(terms)
    plan = some._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|INSET)", plan) and re.search(r"PushedFilters: \[[^\]]*In\(term, \[never,w7,w9\]\)", plan)
    assert sorted({r.term for r in some.collect()}) == ["w7", "w9"]
    read = {f.f for f in some.select(F.input_file_name().alias("f")).distinct().collect()}
    all_files = [f for _, _, names in os.walk(f"{path}/postings") for f in names if f.endswith(".parquet")]
    assert len(read) <= 6 < 32 < len(all_files)
    asked = spark.createDataFrame([(1, "w7 w9"), (2, "never w9")], "query_id long, question string")
    scored = lambda df: sorted((r.query_id, r.doc_id, round(r.score, 12)) for r in df.collect())
    found = R.bm25_indexed(index, asked)
    assert scored(found) == scored(R.bm25(spark.createDataFrame(rows, DOCS), asked))
    # What remains of the scan is kept, so nothing after it reads postings again.
    assert "postings" not in found._jdf.queryExecution().toString()


def test_more_terms_than_stand_in_a_plan(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "index"), texts(60)
    I.index_append(spark.createDataFrame(rows, DOCS), path)
    asked = spark.createDataFrame([(1, "w7 w9 w11")], "query_id long, question string")
    scored = lambda: sorted((r.doc_id, round(r.score, 12)) for r in R.bm25_indexed(I.index_read(spark, path), asked).collect())
    one = scored()
    monkeypatch.setattr(R, "LITERAL_TERMS", 2)
    assert scored() == one


def test_a_reader_keeps_its_version(spark, tmp_path):
    path, rows = str(tmp_path / "index"), texts(30)
    I.index_append(spark.createDataFrame(rows[:10], DOCS), path)
    pinned = I.index_read(spark, path)
    before, statistics = held(pinned), pinned.statistics()
    lazy = pinned.postings()
    I.index_append(spark.createDataFrame(rows[10:], DOCS), path)
    I.index_delete(spark.createDataFrame(rows[:5], DOCS), path)
    I.index_compact(spark, path)
    assert held(pinned) == before == wanted(spark, rows[:10]) and pinned.statistics() == statistics and lazy.count() == len(before)
    assert held(I.index_read(spark, path, version=1)) == before
    assert held(I.index_read(spark, path)) == wanted(spark, rows[5:])
    # The last version alone is left after a vacuum, leftovers of a killed writer go too.
    os.makedirs(f"{path}/postings/segment=leftover")
    assert any("leftover" in g for g in I.index_vacuum(spark, path)) and S.versions(spark, path) == [4]
    assert held(I.index_read(spark, path)) == wanted(spark, rows[5:]) and len(os.listdir(f"{path}/lengths")) == 1


def test_statistics_and_odd_cases(spark, tmp_path):
    path = str(tmp_path / "index")
    asked = spark.createDataFrame([(1, "a")], "query_id long, question string")
    assert R.bm25_indexed(I.index_read(spark, path), asked).collect() == [] and I.index_read(spark, path).statistics() == (0, None)
    I.index_append(spark.createDataFrame([(1, None), (2, "...")], DOCS), path)
    assert I.index_read(spark, path).statistics() == (2, 0.0) and R.bm25_indexed(I.index_read(spark, path), asked).collect() == []
    I.index_append(spark.createDataFrame([], DOCS), path)
    I.index_append(spark.createDataFrame([(3, "a b"), (3, "a b")], DOCS), path)
    assert I.index_read(spark, path).statistics() == (4, 1.0)
    assert I.index_compact(spark, path).version == 4 and I.index_read(spark, path).statistics() == (4, 1.0)
    assert I.index_compact(spark, path).version == 4


def test_two_writers_at_once(spark, tmp_path):
    path, failed = str(tmp_path / "index"), []

    def write(i):
        try:
            I.index_append(spark.createDataFrame([(i, f"word{i}")], DOCS), path, batch=f"b{i % 3}")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    now = S.snapshot(spark, path)
    assert not failed and now.version == 3 and sorted(b for s in now.segments for b in s["batches"]) == ["b0", "b1", "b2"]
    # Another driver's writer: the number is taken, and the rename does not overwrite.
    assert not S._publish(spark, path, now.version, [])


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    folder, path, rows = str(tmp_path / "in"), str(tmp_path / "index"), texts(40)
    spark.createDataFrame(rows[:20], DOCS).write.parquet(folder)
    run = lambda: index_stream(spark.readStream.schema(DOCS).parquet(folder), path, str(tmp_path / "check"), "feed")
    run()
    spark.createDataFrame(rows[20:], DOCS).write.mode("append").parquet(folder)
    run()
    run()
    assert held(I.index_read(spark, path)) == wanted(spark, rows)
    version = S.snapshot(spark, path).version
    index_batch(spark.createDataFrame(rows[:20], DOCS), 0, path, "feed")
    I.index_compact(spark, path)
    index_batch(spark.createDataFrame(rows[:20], DOCS), 0, path, "feed")  # compaction remembers batches
    assert S.snapshot(spark, path).version == version + 1 and held(I.index_read(spark, path)) == wanted(spark, rows)
    # An update that failed between its two steps is finished by its replay.
    new = spark.createDataFrame([(3, "renewed text")], DOCS)
    I.index_delete(new, path, batch="feed/9/deleted")
    for _ in range(2):
        index_batch(new, 9, path, "feed", update=True)
    assert held(I.index_read(spark, path)) == wanted(spark, [r for r in rows if r[0] != 3] + [(3, "renewed text")])


VECTORS = "chunk_id long, report_id long, embedding array<float>"


def test_vector_index_life(spark, tmp_path):
    path = str(tmp_path / "v")
    frame = lambda rows: spark.createDataFrame(rows, VECTORS)
    read = lambda: VI.vectors_read(spark, path)
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, vector array<float>")
    assert read().size == 0 and read().search(asked, 3).collect() == []
    VI.vectors_add(frame([(i, i % 2, [float(j == i) for j in range(4)]) for i in range(4)] + [(9, 0, None)]), path)
    assert read().size == 4
    first = lambda **kw: [(r.chunk_id, round(r.score, 6)) for r in sorted(read().search(asked, 2, **kw).collect(), key=lambda r: r["rank"])]
    assert first() == [(0, 1.0), (1, 0.0)] and first(reports=[1]) == [(1, 0.0), (3, 0.0)] and first(reports=[7]) == []
    VI.vectors_remove(frame([(0, 0, None), (77, 0, None)]), path)
    VI.vectors_add(frame([(5, 1, [2.0, 0.0, 0.0, 0.0]), (6, 1, [0.0] * 4)]), path)
    assert read().size == 5 and first() == [(5, 1.0), (1, 0.0)]
    pinned = read()
    VI.vectors_remove(frame([(5, 0, None)]), path)
    VI.vectors_add(frame([(5, 1, [0.0, 1.0, 0.0, 0.0])]), path)  # anew, after the mark
    assert pinned.search(asked, 1).first().chunk_id == 5 and {r.chunk_id for r in read().vectors().collect()} == {1, 2, 3, 5, 6}
    assert first()[0] == (1, 0.0)


def test_vector_index_recall(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, i % 5, r.normal(size=32).tolist()) for i in range(1500)]
    VI.vectors_add(spark.createDataFrame(rows, VECTORS), str(tmp_path / "v"))
    asked = spark.createDataFrame([(j, r.normal(size=32).tolist()) for j in range(30)], "query_id long, vector array<float>")
    m = np.array([v for *_, v in rows], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for block in (2000, 10):
        monkeypatch.setattr(VI, "QUERY_BLOCK", block)
        found = VI.vectors_read(spark, str(tmp_path / "v")).search(asked, 10).collect()
        hits = sum(x.chunk_id in np.argsort(-m @ np.array(q.vector))[:10] for q in asked.collect() for x in found if x.query_id == q.query_id)
        assert len(found) == 300 and hits >= 297


@pytest.mark.parametrize("block", [2000, 4])
def test_vector_search_where_codes_do_not_tell(spark, tmp_path, monkeypatch, block):
    """Vectors closer to each other than codes resolve, copies beyond the first pass, a zero vector: the first k are those of all vectors."""
    monkeypatch.setattr(VI, "QUERY_BLOCK", block)
    r, path = np.random.default_rng(5), str(tmp_path / "v")
    middle = r.normal(size=16)
    dense = [middle + r.normal(size=16) * 1e-3 for _ in range(600)]
    rows = [(900 - i, i % 3, [float(np.float32(x)) for x in v]) for i, v in enumerate([*dense, *[dense[0]] * 200, np.zeros(16)])]
    VI.vectors_add(spark.createDataFrame(rows, VECTORS), path)
    asked = [(j, [float(np.float32(x)) for x in v]) for j, v in enumerate([*dense[:5], -middle, np.eye(16)[0], np.zeros(16)])]
    found = VI.vectors_read(spark, path).search(spark.createDataFrame(asked, "query_id long, vector array<float>"), 10).collect()
    m = np.array([v for *_, v in rows])
    for j, q in asked:
        size = np.linalg.norm(m, axis=1) * np.linalg.norm(q)
        score = np.where(size > 0, m @ np.array(q) / np.where(size > 0, size, 1), 0.0)
        wanted = sorted((-round(x, 9), key) for x, (key, *_) in zip(score.tolist(), rows))[:10]
        assert [(-round(x.score, 9), x.chunk_id) for x in sorted(found, key=lambda x: x["rank"]) if x.query_id == j] == wanted


def test_vector_stream(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "v")
    spark.createDataFrame([(1, 1, [1.0]), (2, 1, [2.0])], VECTORS).write.parquet(folder)
    for _ in range(2):
        vector_stream(spark.readStream.schema(VECTORS).parquet(folder), path, str(tmp_path / "check"), "feed")
    VI.vectors_add(spark.createDataFrame([(1, 1, [1.0])], VECTORS), path, batch="feed/0")
    assert VI.vectors_read(spark, path).size == 2


@pytest.mark.parametrize("many", [1, 6])
def test_buckets_grow(many):
    assert I.buckets_for(10 * 2**many, 10) == 2**many and I.buckets_for(0) == 1 and I.buckets_for(10**15) == I.MAX_BUCKETS
