"""Ranked search, spelling variants and line de-duplication against brute force and on odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeline.llm import lexical, line_dedup, spelling

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, clash="n long, h string, doc string, term string, word string, gone string, name string, kept_text string, i int"):
    base = spark.createDataFrame(rows, "doc_id long, text string")
    return base.selectExpr("*", *(f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in clash.split(", ")))


# --- lines


def plain_lines(rows):
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(" \t\n\x0b\x0c\r").translate(SMALL)
            if len(k) >= 40:
                holders[k].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = []
        for line in lines:
            h = holders.get(line.strip(" \t\n\x0b\x0c\r").translate(SMALL), ())
            if len(h) < 5 or d == max(h, key=lambda x: (x is not None, x or 0)):
                stay.append(line)
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("seed", range(3))
def test_lines_equal_brute_force(spark, seed, monkeypatch):
    r = random.Random(seed)
    if seed == 2:
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    pool = ["", " ", "x" * 39, "Y" * 40, "  " + "y" * 40 + "\r", "Ä" * 41, "ä" * 41, *(f"a line that several of the documents share {i}" for i in range(6)), "A LINE THAT SEVERAL OF THE DOCUMENTS SHARE 3\t"]
    rows = [(r.choice([None, *range(14)]), None if r.random() < 0.05 else "\n".join(r.choices(pool, k=r.randint(1, 6)))) for _ in range(60)]
    rows += rows[:5]
    found = Counter(tuple(x) for x in line_dedup.report(frame(spark, rows)).collect())
    assert found == plain_lines(rows)


def test_lines_of_long_and_hot_texts(spark):
    hot = "the same long line stands in very many of these documents"
    rows = [(i, f"own {i}\n{hot}\nlast") for i in range(300)] + [(1000, "\n".join(f"{hot} {i % 7}" for i in range(50_000)))] + [(2000 + i, "\n".join(f"{hot} {j}" for j in range(7))) for i in range(5)]
    found = {x.doc_id: x for x in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert found[299].kept_text == f"own 299\n{hot}\nlast" and all(found[i].kept_text == f"own {i}\nlast" for i in range(299))
    assert found[1000].kept_text == "" and found[1000].n_dropped == 50_000 and found[2004].n_dropped == 0 and found[2003].n_dropped == 7
    assert line_dedup.report(frame(spark, [])).collect() == []
    assert "h" in line_dedup.dedup_lines(frame(spark, [])).columns


def test_lines_need_no_python(spark):
    plan = line_dedup.report(frame(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# --- search


def plain_search(rows, items, keep=10):
    words = [(d, re.findall(lexical.TERM, (t or "").translate(SMALL))) for d, t in rows]
    n, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(re.findall(lexical.TERM, (t or "").translate(SMALL)))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, w in words:
            tf = Counter(w)
            m = 10 + (90 * len(w) * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, k, None if gone else d, -s) for k, (s, gone, d) in enumerate(sorted(scored)[:keep], 1)]
    return Counter(out)


@pytest.mark.parametrize("block", [lexical.BLOCK_TERMS, 60])
def test_search_equals_brute_force(spark, block):
    r = random.Random(block)
    vocabulary = [f"wörd{i}" for i in range(30)] + ["THE", "the", "10", "é"]
    text = lambda n: " ".join(r.choices(vocabulary, weights=range(34, 0, -1), k=n))
    rows = [(i if i % 20 else None, text(r.randint(0, 30))) for i in range(300)] + [(7, "wörd1 wörd2"), (7, "wörd1 wörd2"), (301, None), (302, ""), (303, "wörd3 " * 20_000)]
    rows += [(400 + i, "wörd9 the") for i in range(40)]  # ties
    items = [(i, text(6)) for i in range(25)] + [(3, "wörd29"), (None, "wörd4"), (90, None), (91, "nowhere")]
    found = lexical.search(frame(spark, rows).repartition(7), spark.createDataFrame(items, "item_id long, text string"), block_terms=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(x) for x in found.collect()) == plain_search(rows, items)


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for docs, asked in ((frame(spark, []), items), (frame(spark, [(1, "a b")]), items.limit(0)), (frame(spark, [(1, None)]), items)):
        found = lexical.search(docs, asked)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.collect() == []


def test_search_keys_of_text_and_large_numbers(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "doc_id string, text string")
    assert [(r.rank, r.doc_id) for r in sorted(lexical.search(docs, spark.createDataFrame([(1, "x")], "item_id long, text string")).collect(), key=lambda r: r.rank)] == [(1, "a"), (2, "b"), (3, None)]
    big = frame(spark, [(2**60 + 1, "x"), (None, "x"), (2**60, "q")])
    assert [r.doc_id for r in lexical.search(big, spark.createDataFrame([(1, "q")], "item_id long, text string")).collect()] == [2**60]


# --- spelling


def plain_variants(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: next((v for v in sorted(near[w], key=lambda v: (-n[v], v)) if n[v] >= 10 * n[w]), None) if near[w] and max(n[v] for v in near[w]) >= 10 * n[w] else None for w in n}
    root = lambda w: w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


@pytest.mark.parametrize("limit", [spelling.LIMIT, 2])
def test_variants_equal_brute_force(spark, limit):
    r = random.Random(3)
    words = ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "Sonnenlicht", "éclairage", "straßenbahn", "sonnenlichte"]
    words += ["".join(r.choices("abÿ×", k=r.randint(7, 9))) for _ in range(40)]
    slips = [w[:i] + c + w[i + k :] for w in words for i in range(len(w)) for c, k in ((r.choice("ab"), 1), ("", 1), (r.choice("abé"), 0)) if r.random() < 0.6]
    bag = words * 9 + words[:8] * 200 + slips * 2 + slips[::3] * 30
    r.shuffle(bag)
    rows = [(None if i == 3 else i, " ".join(bag[i::50]) + "! x1y " + bag[i].upper()) for i in range(50)] + [(60, None), (61, ""), (62, "kurz")]
    rows += rows[:2]
    found = spelling.variants(frame(spark, rows), limit=limit)
    assert {tuple(x) for x in found.collect()} == plain_variants(rows) and found.count() == len(plain_variants(rows))


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abc", max_size=5), max_size=40))
def test_composition_is_one_path_a_pair(words):
    states = spelling.acceptor(sorted(words))
    found = Counter(spelling.pairs(states))
    assert set(found) == {(a, b) for a in words for b in words if one_edit(a, b) and (len(a) > len(b) or len(a) == len(b) and a < b)}
    assert not found or max(found.values()) == 1
    assert len({tuple(sorted(s.items())) for s in states}) == len(states) or not words  # minimal: no two states alike


def test_variants_of_hot_beginnings(spark):
    """A third of all words begin alike, and so on: intervals are halved until partitions fit."""
    r = random.Random(9)
    words = {"prefixprefix" + "".join(r.choices("abcd", k=6)) for _ in range(1500)} | {"".join(r.choices("abcdef", k=8)) for _ in range(1500)}
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    rounds = spelling.partitions(table, 50)
    assert len(rounds) > 2 and all(r_.where(~spelling.large(50)).groupBy("key").count().agg(F.max("count")).first()[0] <= 91 for r_ in rounds)
    found = Counter((x.word, x.near) for x in spelling.near_words(rounds, 50).collect())
    wild = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            wild[w[:i] + "*" + w[i + 1 :]].add(w)
    assert set(found) == {(a, b) for group in wild.values() for a in group for b in group if a != b} and max(found.values()) == 1


def test_variants_of_nothing(spark):
    assert spelling.variants(frame(spark, [])).collect() == [] and spelling.variants(frame(spark, [(1, None)])).collect() == []
