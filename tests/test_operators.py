import difflib
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeline.operators import catalog as K
from citeline.operators import chunking as C
from citeline.operators import context as X
from citeline.operators import evalkit as E
from citeline.operators import extract as G
from citeline.operators import layout as L
from citeline.operators import models as M
from citeline.operators import retrieval as R
from citeline.operators import text_index as I
from citeline.operators import verify as V
from citeline.operators.dedupe import dedupe_goals

QUIET = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def packed(spark, paragraphs):
    rows = spark.createDataFrame([(paragraphs,)], "ps array<struct<page:int,text:string>>")
    return [tuple(c) for c in rows.select(C.pack(F.col("ps"))).first()[0]]


def plain_pack(paragraphs):
    out, now = [], []
    flush = lambda: now and (out.append((now[0][0], now[-1][0], "\n\n".join(t for _, t in now))), now.clear())
    for page, text in paragraphs:
        if len(text) > C.HARD_MAX:
            flush()
            at = 0
            while at < len(text):
                end = min(at + C.HARD_MAX, len(text))
                if end < len(text) and 0 <= (space := text.find(" ", end)) < end + C.SNAP:
                    end = space
                if piece := text[at:end].strip():
                    out.append((page, page, piece))
                if end >= len(text):
                    break
                at = max(end - C.OVERLAP, at + 1)
            continue
        if now and sum(len(t) for _, t in now) + 2 * (len(now) - 1) + 2 + len(text) > C.TARGET:
            flush()
        now.append((page, text))
    flush()
    return out


@QUIET
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 4000), st.integers(1, 60)), max_size=12))
def test_packing_matches_a_plain_loop(spark, shape):
    paragraphs = [(page, ("x" * gap + " ") * (size // (gap + 1)) + "y" * (size % (gap + 1))) for page, size, gap in shape]
    assert packed(spark, paragraphs) == plain_pack(paragraphs)


def test_long_paragraph_pieces_overlap(spark):
    text = " ".join(f"w{i}" for i in range(1500))
    pieces = [t for _, _, t in packed(spark, [(1, text)])]
    assert len(pieces) > 1 and all(len(p) <= C.HARD_MAX + C.SNAP for p in pieces) and pieces[0][-100:] in pieces[1]


def test_tables(spark):
    rows = [[f"r{i}", "v" * 40] for i in range(80)]
    df = spark.createDataFrame([(["a", "b"], rows, "Cap"), (["a", "b"], [["1", "2"]], None), (["h"], [], "")], "h array<string>, r array<array<string>>, c string")
    big, small, bare = [x[0] for x in df.select(C.split_table(F.col("h"), F.col("r"), F.col("c"))).collect()]
    assert small == ["| a | b |\n| --- | --- |\n| 1 | 2 |"] and bare == ["| h |\n| --- |"]
    assert len(big) > 1 and big[0].startswith("Cap\n| a | b |") and all(p.startswith("| a | b |") for p in big[1:]) and all(len(p) <= C.HARD_MAX for p in big)
    assert sum(p.count("\n| r") for p in big) == 80


def test_chunk_documents(spark):
    items = [(1, i, k, p, g, t, ["h"] if k == "table" else None, [["c"]] if k == "table" else None) for i, (k, p, g, t) in enumerate(
        [("text", 1, 0, "one"), ("text", 2, 0, "two"), ("table", 2, 0, ""), ("table", 2, 0, ""), ("text", 3, 1, "three"), ("text", 3, 2, "four")])]
    df = spark.createDataFrame(items, "doc_id long, seq int, kind string, page int, region int, text string, header array<string>, rows array<array<string>>")
    found = [(r.kind, r.page_start, r.page_end, r.text) for r in C.chunk_documents(df).orderBy("n").collect()]
    table = "| h |\n| --- |\n| c |"
    assert found == [("text", 1, 2, "one\n\ntwo"), ("table", 2, 2, "two\n" + table), ("table", 2, 2, table), ("text", 3, 3, "three"), ("text", 3, 3, "four")]


def test_semantic_breaks(spark):
    vectors = [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [0.01, 1.0], [0.02, 1.0]]
    rows = [(1, i, "text", i, 0, str(i) * 10) for i in range(5)] + [(1, 5, "table", 5, 0, "t"), (1, 6, "text", 6, 0, "x"), (2, 0, "text", 1, 0, "y" * 3000), (2, 1, "text", 2, 0, "z")]
    df = spark.createDataFrame(rows, "doc_id long, seq int, kind string, page int, region int, text string")
    known = {str(i) * 10: v for i, v in enumerate(vectors)}
    embed = lambda text: F.coalesce(*(F.when(text == t, F.array(*map(F.lit, v))) for t, v in known.items()), F.array(F.lit(0.0), F.lit(0.0)))
    found = [(r.doc_id, r.run, r.i, r.page_start, r.page_end) for r in C.semantic_chunks(df, embed).orderBy("doc_id", "run", "i").collect()]
    assert found == [(1, 1, 0, 0, 1), (1, 1, 1, 2, 4), (1, 3, 0, 6, 6), (2, 1, 0, 1, 1), (2, 1, 1, 1, 1), (2, 1, 2, 2, 2)]


def test_budget_skips_and_continues(spark):
    df = spark.createDataFrame([([50, 40, 10],), ([],)], "n array<long>")
    assert [r[0] for r in df.select(X.within_budget(F.col("n"), 60)).collect()] == [[True, False, True], []]


def test_history(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a" * 600), (1, 1, "system", "b"), (1, 2, "user", "c")], "c int, t int, r string, x string")
    assert X.history(X.recent(rows, "c", "t", 2), "c", "t", "r", "x").first()["history"] == "Assistant: b\nUser: c"
    assert X.history(rows.where("t = 0"), "c", "t", "r", "x").first()["history"] == "User: " + "a" * 500


def test_bm25_phrases(spark):
    docs = spark.createDataFrame([(1, "rate 8.7 percent"), (2, "rate 8 and 7"), (3, "nothing here"), (4, "8.7 8.7")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "8.7"), (2, "..."), (3, "nothing")], "query_id long, question string")
    found = {(r.query_id, r.doc_id): r.score for r in R.bm25(docs, asked).collect()}
    assert set(found) == {(1, 1), (1, 4), (3, 3)} and found[3, 3] > 0


def test_cosine_of_zero_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 2.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(9, [0.0, 1.0])], "query_id long, vector array<float>")
    assert {r.id: r.score for r in R.cosine_scores(v, q, "id", "query_id").collect()} == {1: 0.0, 2: 0.0, 3: 1.0}


def test_stored_index_answers_as_the_texts_do(spark, tmp_path):
    """Appends, a delete and an update; scores equal those of the live texts, with and without a scope."""
    path, schema = str(tmp_path / "index"), "doc_id long, text string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    first, second = [(1, "rate 8.7 percent"), (2, "rate 8 and 7"), (3, "nothing here")], [(4, "8.7 8.7 rate"), (5, "..."), (6, "new rate"), (7, None)]
    I.index_append(frame(first), path)
    I.index_append(frame(second), path)
    I.index_delete(frame([(1, ""), (6, "")]), path)
    assert I.index_append(frame([(6, "newer 8.7 words")]), path).version == 4
    live = frame([first[1], first[2], second[0], second[1], second[3], (6, "newer 8.7 words")])
    asked = spark.createDataFrame([(1, "8.7"), (2, "rate"), (3, "gone percent")], "query_id long, question string")
    scores = lambda df: {(r.query_id, r.doc_id): round(r.score, 12) for r in df.collect()}
    index = I.index_read(spark, path)
    found = scores(R.bm25_indexed(index, asked))
    assert set(found) == {(1, 4), (1, 6), (2, 2), (2, 4)}
    assert found == scores(R.bm25(live.fillna("", ["text"]), asked))
    scope = spark.createDataFrame([(1, 6), (2, 2)], "query_id long, doc_id long")
    assert scores(R.bm25_indexed(index, asked, scope=scope)) == {k: found[k] for k in ((1, 6), (2, 2))}


def test_cosine_blocks_and_first_k(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), 1.0], i % 2) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>, label int").repartition(3)
    q = spark.createDataFrame([(j, [1.0, float(j), 0.5], j % 2) for j in range(7)], "query_id long, vector array<float>, label int")
    best = lambda df: {(r.query_id, r.id): round(r.score, 9) for r in R.top_k(df, ["query_id"], [F.round("score", 9).desc(), F.col("id")], 4).collect()}
    for scope in (None, "label"):
        every = best(R.cosine_scores(v, q, "id", "query_id", scope))
        assert len(every) == 28 and best(R.cosine_scores(v, q, "id", "query_id", scope, k=4)) == every
        monkeypatch.setattr(R, "QUERY_BLOCK", 3)
        monkeypatch.setattr(R, "VECTOR_BLOCK", 20)
        assert "toArrow" not in str(R.cosine_scores(v, q, "id", "query_id", scope)._jdf.queryExecution()) and best(R.cosine_scores(v, q, "id", "query_id", scope)) == every
        assert best(R.cosine_scores(v, q, "id", "query_id", scope, k=4)) == every
        monkeypatch.undo()


def test_ids_follow_the_order(spark):
    rows = spark.range(1000).selectExpr("id * 7 % 1000 as x").repartition(5)
    found = K.with_ids(rows, ["x"], after=10).collect()
    assert sorted((r.x, r.id) for r in found) == [(i, i + 11) for i in range(1000)]
    assert K.with_ids(rows.limit(0), ["x"]).collect() == []


def test_candidates_by_fixed_phrasings(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate(["employees headcount at year end", "workforce of the year", "own employees 2024", "no such thing", "external employees and internal employees", "weather"])]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in docs], "doc_id long, text string, report_id int")
    I.index_append(df, str(tmp_path / "index"))
    index = I.index_read(spark, str(tmp_path / "index"))
    found = {(r.report_id, r["rank"]): r.doc_id for r in G.workforce_candidates(index, df.select("report_id", "doc_id")).collect()}
    lists = {}
    for q, text in enumerate(G.WORKFORCE_QUESTIONS):
        scored = R.bm25_indexed(index, spark.createDataFrame([(q, text)], "query_id long, question string")).collect()
        for rep in (0, 1):
            order = sorted((r for r in scored if r.doc_id % 2 == rep), key=lambda r: (-round(r.score, 9), r.doc_id))[:20]
            lists[rep, q] = [r.doc_id for r in order]
    for rep in (0, 1):
        fused, first = {}, {}
        for q in range(len(G.WORKFORCE_QUESTIONS)):
            for rank, d in enumerate(lists[rep, q], 1):
                fused[d] = fused.get(d, 0) + 1 / (60 + rank)
                first.setdefault(d, (q, rank))
        order = sorted(fused, key=lambda d: (-round(fused[d], 12), first[d], d))[:12]
        assert [found[rep, i + 1] for i in range(len(order))] == order and len(order) >= 1
    assert len(found) == 4


def test_extraction_context(spark):
    rows = spark.createDataFrame([(1, 7, 2, 2, "text", "b"), (1, 5, 1, 2, "table", "a")], "query_id long, chunk_id long, page_start int, page_end int, kind string, text string")
    text, ids = X.extraction_context(rows, ["page_start", "chunk_id"])
    assert text.first()["context"].startswith('<source id="S1" pages="1-2" kind="table">\na\n</source>\n\n<source id="S2"')
    assert sorted(map(tuple, ids.collect())) == [(1, "S1", 5), (1, "S2", 7)]


def test_fusion(spark):
    lists = spark.createDataFrame([(1, 0, 1, 7), (1, 0, 2, 8), (1, 1, 1, 9), (1, 1, 2, 7)], "q int, list_idx int, rank int, id long")
    found = [(r.id, round(r.fused, 9)) for r in R.fused_top(lists, "q", "id", 9).orderBy("rank").collect()]
    assert found == [(7, round(1 / 61 + 1 / 62, 9)), (9, round(1 / 61, 9)), (8, round(1 / 62, 9))]


def test_scope(spark, monkeypatch):
    rows = [(1, "what of SRC1"), (2, "nobody"), (3, "Src10, src1 and SRC1"), (4, None), (5, "ÉCLAIR or éclair")]
    asked = spark.createDataFrame(rows, "q int, question string")
    given = ["src1", "src10", "Éclair", "éclair", "", None, "SRC1"]
    names = spark.createDataFrame([(n,) for n in given], "name string")
    wanted = {(i, n) for i, t in rows for n in given if n and n.lower() in (t or "").lower()}
    wanted |= {(i, None) for i, _ in rows if i not in {q for q, _ in wanted}}
    for size in (R.NAME_BLOCK, 2):
        monkeypatch.setattr(R, "NAME_BLOCK", size)
        found = [tuple(x) for x in R.scope_by_name(asked, names, "q", "question", "name").collect()]
        assert set(found) == wanted and len(found) == len(wanted)
    assert R.scope_by_name(asked, names.limit(0), "q", "question", "name").where("name is null").count() == 5
    scored = spark.createDataFrame([(1, "src1", 1), (1, "x", 2), (2, "x", 3)], "q int, name string, id int")
    assert {r.id for r in R.in_scope(scored, R.scope_by_name(asked, names, "q", "question", "name"), "q", "name").collect()} == {1, 3}


CASES = [
    ("we employ 12,345 people", "In all, we employ 12,345 people.", True), ("we hire robots", "we employ people", False), ("full time", "full-\n\ntime", False), ("fulltime", "full-\ntime staff", True),
    ("by 2030", "by 2030s", False), ("goal, reached", "Goal reached!", True), ("", "x", False), (None, "x", False), ("a  b", "a b", True),
]


def test_quotes(spark):
    df = spark.createDataFrame([(i, q, s) for i, (q, s, _) in enumerate(CASES)], "i int, q string, s string")
    assert [r[1] for r in df.select("i", V.quote_in(F.col("q"), F.col("s"))).orderBy("i").collect()] == [x for _, _, x in CASES]


def test_values(spark):
    df = spark.createDataFrame([("345", "12,345", "12,345"), ("", "q", "q"), (None, "q", "q"), ("9", "q", "q 9")], "v string, q string, s string")
    found = [tuple(r[0]) for r in df.select(V.verification(F.col("q"), F.col("v"), F.col("s"))).collect()]
    assert found == [(True, 345.0), (True, None), (True, None), (False, 9.0)]


@QUIET
@given(st.text("abc -", min_size=1, max_size=12).filter(str.strip), st.text("xyz ", max_size=8), st.text("xyz ", max_size=8))
def test_quotes_verify_against_themselves(spark, q, a, b):
    df = spark.createDataFrame([(q, f"{a} {q} {b}")], "q string, s string")
    blank = not q.replace("-", "").strip()
    assert df.select(V.quote_in(F.col("q"), F.col("s"))).first()[0] or blank


def test_quotes_in_corpus(spark):
    quotes = spark.createDataFrame([(1, "b c d e"), (2, "c"), (3, "d x"), (4, "")], "qid long, q string")
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "b c d x"), (3, None)], "id long, t string")
    assert sorted(map(tuple, V.quotes_in_corpus(quotes, docs, "qid", "q", "id", "t").collect())) == [(1, 1), (2, 1), (2, 2), (3, 2)]


def test_answer_checks(spark):
    c = lambda s, q, v: (s, q, "", v)
    rows = [
        (1, "answered", "a [S1] 12,345", [], [c("S1", "12,345", True)]), (2, "not_found", "b [S1]", ["own"], [c("S1", "x", True)]), (3, "answered", "c [S1]", [], [c("S1", "x", False)]),
        (4, "answered", "d 99,999 in 2024", [], []), (5, "answered", "e [S2] [S2]", [], [c("S1", "x", True)]),
    ]
    df = spark.createDataFrame(rows, "t int, status string, answer string, caveats array<string>, citations array<struct<source_id:string,quote:string,value_text:string,verified:boolean>>")
    found = {r.t: (r.status, len(r.citations), r.caveats) for r in V.check_answer(df).collect()}
    assert found == {
        1: ("answered", 1, []), 2: ("not_found", 0, ["own", V.ORPHANED]), 3: ("partial", 1, [V.UNVERIFIED]), 4: ("answered", 0, [V.UNBACKED]), 5: ("answered", 1, [V.ORPHANED]),
    }


def test_citation_groups(spark):
    rows = [(1, 0, "S1", "q", "5", True), (1, 1, "S1", "q", None, False), (1, 2, None, "q", "7", True), (1, 3, None, "q", "", True)]
    df = spark.createDataFrame(rows, "turn_id int, pos int, source_id string, quote string, value_text string, verified boolean")
    found = sorted((r.position, r.verified, r["values"]) for r in V.group_citations(df).collect())
    assert found == [(0, False, ["5"]), (2, True, ["7"]), (3, True, [])]


def test_highlight_spans(spark):
    df = spark.createDataFrame([(1, "abcdefgh", ["bc", "cd", "de", "gh", "zz"])], "k int, q string, v array<string>")
    assert sorted((r.start, r.end) for r in V.highlight_spans(df, ["k"], "q", "v").collect()) == [(1, 5), (6, 8)]


def block(no, kind, x0, y0, x1, y1, text="", page=1, rows=None, header=None):
    return (1, page, no, kind, float(x0), float(y0), float(x1), float(y1), text, header, rows)


BLOCK = "doc_id long, page int, block_no int, kind string, x0 double, y0 double, x1 double, y1 double, text string, header array<string>, rows array<array<string>>"


def test_layout(spark):
    long = "words " * 20
    rows = [block(0, "text", 300, 10, 400, 20, long), block(1, "text", 50, 30, 150, 40, long), block(2, "text", 60, 10, 150, 20, long), block(3, "text", 55, 105, 90, 115, "in table"),
            block(4, "table", 50, 100, 200, 200, rows=[["a", ""], ["", ""]], header=["h", ""]), block(5, "table", 0, 0, 1, 1, rows=[["", ""]], header=["", ""]), block(6, "text", 0, 0, 9, 9, "tiny", page=2)]
    blocks = spark.createDataFrame(rows, BLOCK)
    pages = spark.createDataFrame([(1, 3)], "doc_id long, page_count int")
    found = [(r.block_no, r.region) for r in L.prepare(blocks, pages).orderBy("seq").collect()]
    assert found == [(2, 0), (1, 0), (4, 0), (0, 1)]
    assert sorted(r.page for r in L.skipped_pages(blocks, pages).collect()) == [2, 3]


def test_boilerplate_needs_ten_pages(spark):
    rows = [block(p, "text", 0, 0, 1, 1, "Header" if p < 10 else "x", page=p + 1) for p in range(12)]
    blocks = spark.createDataFrame(rows, BLOCK)
    pages = spark.createDataFrame([(1, 12)], "doc_id long, page_count int")
    assert [r.text for r in L.boilerplate(blocks, pages).collect()] == ["Header"]
    assert L.boilerplate(blocks.where("page < 10"), pages).count() == 0


def squeezed_plain(title, target):
    return "".join(c for c in f"{title} {target or ''}".lower() if not c.isspace() and c != "-")


def test_dedupe_goals_matches_a_plain_loop(spark):
    r = random.Random(4)
    words = ["cut", "reduce", "water", "waste", "use", "by", "half", "energy"]
    rows = [(1, i, "q" * r.randint(1, 9), " ".join(r.choice(words) for _ in range(3)), r.choice("ab"), r.choice([None, "", "30%"]), r.choice([None, 2030])) for i in range(60)]
    df = spark.createDataFrame(rows, "report_id long, pos long, quote string, title string, category string, target string, target_year int")
    kept = []
    for row in rows:
        for i, k in enumerate(kept):
            if k[4] == row[4] and k[6] == row[6] and difflib.SequenceMatcher(None, squeezed_plain(row[3], row[5]), squeezed_plain(k[3], k[5])).ratio() >= 0.6:
                if len(row[2]) > len(k[2]):
                    kept[i] = row
                break
        else:
            kept.append(row)
    assert [x.pos for x in dedupe_goals(df).orderBy("slot").collect()] == [k[1] for k in kept]
    # In rounds of small blocks, and with few commitments a task.
    assert [x.pos for x in dedupe_goals(df, block=4, share=2).orderBy("slot").collect()] == [k[1] for k in kept]
    assert dedupe_goals(df.limit(0)).collect() == []


def test_catalog_codec_and_sorting(spark):
    v = spark.createDataFrame([(1, [1.5, -2.0]), (2, None)], "id int, v array<float>")
    assert [r[0] for r in v.orderBy("id").select(K.blob_to_vector(K.vector_to_blob(F.col("v")))).collect()] == [[1.5, -2.0], None]
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "id int, n int")
    assert [r.id for r in K.sorted_by(rows, "n").collect()] == [2, 3, 1] and [r.id for r in K.sorted_by(rows, "n", True).collect()] == [3, 2, 1]


def test_summary_of_nothing(spark):
    none = spark.createDataFrame([], "hit boolean, grounded boolean, status string")
    assert tuple(E.summary(none).first()) == (0, 0, 0, None, None, 0)


def test_retries():
    calls, slept = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise M.ModelError("busy")
        return "ok"

    assert M.with_retries(flaky, sleep=slept.append) == "ok" and slept == [1.5, 3.0]
    try:
        M.with_retries(lambda: (_ for _ in ()).throw(M.AuthError("no")), sleep=slept.append)
    except M.AuthError:
        pass
    assert len(slept) == 2


def test_models(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "id int, t string")
    assert [sum(r.v) for r in M.embed(rows, "t", "v").orderBy("id").collect()] == [2.0, 0.0]
    made = M.complete(rows.where("id = 1"), "t", "n int", lambda p: '{"n": %d}' % len(p))
    assert made.first()["answer"]["n"] == 3
    assert M.best_sentence("cut waste", ["We grow. We cut waste now", "cut"]) == (0, "We cut waste now")
