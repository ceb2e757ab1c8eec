"""The stages against plain computations, and the registered queries on the small tables."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from citeline.llm import common, near_copies, packing, pii, quality, registry
from citeline.llm.common import table

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables here")


def kept_by_force(texts, similarity=0.8):
    """The smallest key of each component of texts whose five-word shingles have at least that Jaccard similarity."""
    sets = {}
    for i, t in texts.items():
        words = (t or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    near = {i: [j for j in sets if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])] for i in sets}
    low, before = {i: i for i in sets}, None
    while low != before:
        before = low
        low = {i: min(low[j] for j in near[i]) for i in sets}
    return {i for i in low if low[i] == i}


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_near_copies_against_brute_force(spark, similarity):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(60):
        words = [r.choice(vocabulary) for _ in range(r.choice((4, 30, 200, 400)))]
        texts += [" ".join(words)] * r.choice((1, 1, 2))
        for _ in range(r.choice((0, 1, 3))):
            words = list(words)
            for _ in range(max(1, len(words) // 100)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append(" ".join(words))
    texts += ["", "  ", None, "one two", "one two", "One two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(c) for c in ("key", "h", "id", "__h", "fp", "low")})
    kept = near_copies.keep_one(df, similarity=similarity)
    found = {x.doc_id for x in kept.collect()}
    wanted = kept_by_force(dict(enumerate(texts)), similarity)
    assert kept.columns == df.columns and not wanted - found and len(found - wanted) <= 0.03 * len(texts)


def test_near_copies_tiles_and_ties(spark):
    """A crowd of copies over several tiles, rows that share a key, null keys."""
    base = " ".join(f"v{i}" for i in range(120))
    rows = [(i, f"{base} end{i}") for i in range(50)] + [(3, "something else altogether here now"), (None, base + " null"), (None, "all alone in the world"), (7, f"{base} end7")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((x.doc_id if x.doc_id is not None else -1, x.text) for x in near_copies.keep_one(df).collect())
    assert found == [(-1, "all alone in the world"), (0, f"{base} end0"), (3, "something else altogether here now")]
    fps = np.array([np.frombuffer(near_copies.wide(near_copies.shingles(t, 5)), np.uint64) for _, t in rows[:50]])
    whole, parts = near_copies.forest(fps, fps, 50), near_copies.forest(fps[:20], fps[20:], 50)
    assert len(whole) == 49 and len(parts) == 49


def test_every_link_at_the_threshold_is_found(spark, monkeypatch):
    """Pairs just above and just below 0.8, chains, and common lines that lead more texts than one tile or the order allows."""
    r = random.Random(3)
    texts = []
    for k in range(150):
        words = [f"{k}w{i}" for i in range(r.choice((40, 104, 200)))]
        n = len(words) - 4
        for cut in (round(n / 9), round(n / 9) + 1):  # of n shingles that many differ at either end: 0.8 and a little less
            texts.append(" ".join(words))
            texts.append(" ".join([*words[cut:], *(f"{k}x{cut}y{i}" for i in range(cut))]))
            words = texts[-1].split() if r.random() < 0.5 else [f"{k}z{cut}w{i}" for i in range(len(words))]
    line = " ".join(f"common{i}" for i in range(24))
    texts += [f"{line} {' '.join(f'{k}c{i}' for i in range(r.choice((1, 3, 5, 6, 30))))}" for k in range(60)]
    r.shuffle(texts)
    wanted = kept_by_force(dict(enumerate(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frequent, tile in ((1000, near_copies.TILE), (5, 8)):
        monkeypatch.setattr(near_copies, "FREQUENT", frequent, raising=False)
        monkeypatch.setattr(near_copies, "TILE", tile)
        assert {x.doc_id for x in near_copies.keep_one(df).collect()} == wanted


def test_long_texts_of_one_subject_do_not_move(spark, monkeypatch):
    """Long texts that share a passage meet, but their texts are not fetched for it; those near the threshold are, and link."""
    r = random.Random(5)
    passage = [f"p{i}" for i in range(300)]
    texts = [" ".join([*passage, *(f"{k}u{i}" for i in range(r.randrange(1200, 1500)))]) for k in range(40)]
    for k in range(6):
        words = texts[k].split()
        n = (len(words) - 4) // 9
        texts += [" ".join([*words[n:], *(f"{k}v{i}" for i in range(n))])]
    fetched, verify = [], near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda edges, *rest: fetched.append(edges.count()) or verify(edges, *rest))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id for x in near_copies.keep_one(df).collect()} == kept_by_force(dict(enumerate(texts)))
    assert sum(fetched) <= 12


def test_pairs_of_a_crowd_grow_with_its_texts_not_their_square(spark, monkeypatch):
    """Near copies of one text, with few or many edits, and texts with passages in common: all links, and few pairs looked at for them."""
    r = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for k in range(300):
        words = list(base)
        for i in r.sample(range(len(words)), r.randrange(1, 16)):
            words[i] = f"{k}e{i}"
        texts.append(" ".join(words))
    passages = [" ".join(f"{p}p{i}" for i in range(120)) for p in range(6)]
    texts += [" ".join([*r.sample(passages, 3), *(f"{k}u{i}" for i in range(400))]) for k in range(120)]
    r.shuffle(texts)
    looked, allowed = [], near_copies.allowed
    monkeypatch.setattr(near_copies, "allowed", lambda edges, *rest: looked.append(edges.count()) or allowed(edges, *rest))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id for x in near_copies.keep_one(df).collect()} == kept_by_force(dict(enumerate(texts)))
    assert sum(looked) <= 8 * len(texts)


def test_ranks_of_an_anchor_never_rule_out_similar_sets():
    """Of two sets of enough similarity the first shared leading hash is early enough in both, whatever is frequent; one that is frequent comes last."""
    g = np.random.default_rng(6)
    for n in (1, 4, 9, 10, 50, 300):
        for _ in range(30):
            x = np.unique(g.integers(0, 2**64, n, np.uint64))
            lost = g.integers(0, n // 5 + 1)
            y = np.union1d(g.permutation(x)[: n - lost], g.integers(0, 2**64, g.integers(0, n // 9 + 1), np.uint64))
            both = len(np.intersect1d(x, y))
            part, rest = near_copies.Late.split(x[::3], 7)
            late = near_copies.Late(7, part << 32 | rest, g.integers(21, 99, len(part)))
            a, b = (near_copies.leading(v, 0.8, late).view(np.uint64) for v in (x, y))
            assert not len(np.setdiff1d(x[np.isin(x, x[::3], invert=True)], a)) or not np.isin(a, x[::3]).any()
            if both < 0.8 * (len(x) + len(y) - both):
                continue
            i, j = next((int(np.nonzero(a == h)[0][0]), int(np.nonzero(b == h)[0][0])) for h in a if h in b)
            sides = [{"id": np.array([k]), "component": np.array([k]), "size": np.array([len(v)]), "rank": np.array([at]), "print": np.frombuffer(near_copies.sketch(v), np.uint64)[None]} for k, v, at in ((0, x, i), (1, y, j))]
            assert [v.tolist() for v in near_copies.apart(*sides, 0.8)] == [[0], [1]]


def test_long_sketches_never_exceed_the_differing_hashes():
    r = np.random.default_rng(4)
    for n in (0, 1, 5, 32, 33, 400, 3000):
        x = np.unique(r.integers(0, 2**64, n, np.uint64))
        for m in (0, 1, n // 2, n, 2 * n):
            y = np.union1d(x[: r.integers(0, n + 1)], r.integers(0, 2**64, m, np.uint64))
            far = near_copies.differing(near_copies.parity(x), near_copies.parity(y))
            assert far <= len(np.setxor1d(x, y)) and far == near_copies.differing(near_copies.parity(y), near_copies.parity(x))
            assert len(near_copies.parity(x)) * 8 >= 2 * len(x)


def test_a_task_of_quality_has_one_python_worker(spark):
    """Blocks are opened and counted in one function: two in a row would be two workers for each task. A block is read in slices."""
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    plan = quality.scored(df, quality.trained(df.selectExpr("text", "doc_id % 2 AS tag")))._jdf.queryExecution().sparkPlan().toString().split("\n")
    stages = "\n".join("\0" if "Exchange" in x or "Scan" in x else x for x in plan).split("\0")
    assert sum("MapInArrow" in x for x in stages) >= 2 and max(x.count("MapInArrow") for x in stages) == 1
    column = pa.chunked_array([[f"t{i}" for i in range(quality.SLICE + 7)], [None, "b"]])
    assert [len(x) for x in quality.slices(column)] == [quality.SLICE, 7, 2]
    assert [t for x in quality.slices(column) for t in x] == column.to_pylist()


def test_blocks_come_to_a_worker_few_at_a_time(spark):
    """What one worker gets at once is bounded in bytes, not in rows alone."""
    common.small_batches(spark)
    sizes = lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches)
    blocks = spark.range(40, numPartitions=1).select(F.repeat(F.lit("x"), F.lit(2 << 20)).cast("binary").alias("rows"))
    found = [r.n for r in blocks.mapInArrow(sizes, "n long").collect()]
    assert max(found) <= 8 << 20 and sum(found) >= 80 << 20


def test_run_is_its_stages(spark):
    docs = table(spark, SMALL, "documents").toPandas()
    accepted = {r.doc_id for r in quality.classify(table(spark, SMALL, "documents"), table(spark, SMALL, "labels")).where("accepted").collect()}
    left = docs[docs.doc_id.isin(accepted)]
    kept = kept_by_force(dict(zip(left.doc_id, left.text)))
    clean = pii.sanitise(table(spark, SMALL, "documents").where(f"doc_id in ({','.join(map(str, kept))})")).toPandas()
    wanted = dict(zip(clean.doc_id, map(lambda t: len(t.split()), clean.text)))
    found = corpus_pipeline.run(spark, SMALL).collect()
    sizes = {}
    for r in found:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.n_tokens
    assert sizes == wanted
    texts = {}
    for r in sorted(found, key=lambda r: r.piece):
        assert len(r.text.split()) == r.n_tokens
        texts[r.doc_id] = texts.get(r.doc_id, "") + r.text
    assert texts == dict(zip(clean.doc_id, clean.text))
    histogram = {}
    for r in found:
        if r.n_tokens:
            histogram[r.n_tokens] = histogram.get(r.n_tokens, 0) + 1
    cost = sum(packing.sequence_cost(c) for _, c in {(r.seq_id, r.seq_length) for r in found if r.seq_id is not None})
    assert abs(cost - packing.best_plan(histogram)[0]) < 1e-6 * cost


def test_pieces_are_the_text(spark):
    """Null and repeated keys, repeated rows, long texts: each piece has its own text, and pieces put together are the text."""
    r = random.Random(2)
    long = "".join(r.choice(["a", "bé", "ccc"]) + r.choice([" ", "\n", "  ", "\t "]) for _ in range(1000))
    rows = [(1, "  " + long), (1, long + "end"), (None, long), (None, "x y"), (4, None), (5, ""), (6, " \n "), (7, "one two"), (7, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("row", "key", "piece", "n", "seq_id")})
    found = packing.pack_texts(df, sizes=(16, 64)).collect()
    whole = {}
    for x in found:
        assert x.n_tokens == len(x.text.split()) <= 64
        whole.setdefault((x.doc_id, x.seq_id is None), []).append((x.piece, x.text))
    assert "".join(t for _, t in sorted(whole[None, False]) if t != "x y") == long and (0, "x y") in whole[None, False]
    assert sorted(t for (k, _), v in whole.items() if k in (4, 5, 6) for _, t in v) == ["", "", " \n "] and [t for _, t in whole[7, False]] == ["one two"] * 2
    of_one = {p: sorted(t for q, t in whole[1, False] if q == p) for p, _ in whole[1, False]}
    assert all(len(v) == 2 for v in of_one.values()) and sum(len(t) for v in of_one.values() for t in v) == 2 * len(long) + 5


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered_queries_run(spark, name):
    source = {"op1": "pages", "op4": "pages", "op5": "embeddings", "op6": "conversations"}.get(name.split("_")[0], "documents")
    df = registry.QUERIES[name](spark, SMALL)
    rows = df.count()
    if name.startswith(("op11", "op12")):
        assert rows > 0
        return
    assert rows == table(spark, SMALL, source).count() or name.startswith("op7") and rows >= table(spark, SMALL, source).count()


def test_entry_lists_all():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_match_their_sql(spark, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cell = lambda v: None if pd.isna(v) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    plain = lambda df: sorted((tuple(cell(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)
    found, wanted = registry.QUERIES[name](spark, SMALL).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert plain(found) == plain(wanted)
