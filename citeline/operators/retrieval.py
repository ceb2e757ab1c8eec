"""Full-text BM25, exact cosine, reciprocal rank fusion and scoping, for batches of questions.

Everything takes many questions at once. Corpus statistics always come from all documents; scopes filter
after scoring, so scoped and unscoped scores of a row are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeline.functions.text import index_tokens, question_tokens
from citeline.operators.text_index import TextIndex
from citeline.session import cut, release

K1, B, RRF_K = 1.2, 0.75, 60
#: Rows of a question table that are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Asked terms that prune a stored index as literals; more are joined.
LITERAL_TERMS = 10_000
#: Query vectors that are held against all vectors at once.
QUERY_BLOCK = 2_000
#: Vectors of a block where both sides are dealt into a grid.
VECTOR_BLOCK = 20_000
#: Names that one automaton looks for; more are dealt into several.
NAME_BLOCK = 200_000


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, positions, doc_len): the inverted index of a table of texts."""
    words = docs.select(key, index_tokens(F.col(text)).alias("w"))
    each = words.select(key, F.size("w").alias("doc_len"), F.posexplode("w").alias("pos", "term"))
    return each.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"), F.first("doc_len").alias("doc_len"))


def lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, doc_len) of every text, those without words too."""
    return docs.select(key, F.size(index_tokens(F.col(text))).alias("doc_len"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row (n_docs, avg_len) over all texts."""
    return docs.select(F.size(index_tokens(F.col(text))).alias("n")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("avg_len"))


def phrases(questions: DataFrame, query: str, text: str) -> DataFrame:
    """(query, phrase, i, term, len): each quoted token is a phrase of index terms; empty ones match nothing."""
    tokens = questions.select(query, F.posexplode(question_tokens(F.col(text))).alias("phrase", "token"))
    return tokens.select(query, "phrase", index_tokens(F.col("token")).alias("terms")).select(
        query, "phrase", F.size("terms").alias("len"), F.posexplode("terms").alias("i", "term")
    )


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def asked(questions: DataFrame, query: str, question: str) -> tuple[DataFrame, DataFrame, bool]:
    """((query, phrase, p, n), (p, len, i, term), whether they are few): questions share phrases, each distinct phrase is matched once."""
    parts = phrases(questions, query, question)
    listed = parts.groupBy(query, "phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "term"))), lambda x: x["term"]), " ").alias("p"), F.min("phrase").alias("n"))
    # Phrases and their document frequencies are no more rows than this table: one check bounds all three.
    few = listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    parts_of = listed.select("p").distinct().select("p", F.split("p", " ").alias("terms")).select("p", F.size("terms").alias("len"), F.posexplode("terms").alias("i", "term"))
    return listed, parts_of, few


def scores(tf: DataFrame, stats: tuple[int, float | None], listed: DataFrame, hint, key: str, query: str) -> DataFrame:
    """(query, key, score) from how often each phrase occurs in each document (key, p, doc_len, tf), which is read once and kept."""
    n_docs, avg_len = F.lit(stats[0]), F.lit(stats[1]).cast("double")
    tf = cut(tf)
    release(tf.sparkSession)
    df = tf.groupBy("p").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * ((1 - B) + B * F.col("doc_len") / avg_len))
    # Parts are added as whole numbers of 2^-60, so that sums are the same in any order and start in the tasks that join.
    up = (part * float(1 << 20)).alias("up")
    high = F.floor("up").cast("long")
    scored = tf.join(hint(df), "p").select(key, "p", up).select(key, "p", high.alias("high"), F.floor((F.col("up") - high) * float(1 << 40)).cast("long").alias("low"))
    # Dealt by key before each part meets the questions that ask for it, which are more rows; they add up where they are.
    sums = scored.repartition(key).join(hint(listed.select(query, "p")), "p").groupBy(query, key).agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return sums.select(query, key, ((F.col("high") + F.col("low") / float(1 << 40)) / float(1 << 20)).alias("score"))


def bm25(docs: DataFrame, questions: DataFrame, key: str = "doc_id", text: str = "text", query: str = "query_id", question: str = "question") -> DataFrame:
    """(query, key, score) of all matching documents; higher is better.

    A document's words meet only the words asked for. A phrase matches where all its terms follow each
    other: occurrences of its parts are shifted to the phrase's start and counted. Questions that come again and
    again are better asked of a stored index (``bm25_indexed``).
    """
    listed, parts_of, few = asked(questions, query, question)
    hint = F.broadcast if few else (lambda df: df)
    words = docs.select(key, index_tokens(F.col(text)).alias("w")).select(key, F.size("w").alias("doc_len"), F.posexplode("w").alias("pos", "term"))
    met = words.join(hint(parts_of), "term")
    # Occurrences of a single term add up before the shuffle; only real phrases keep where they start.
    start = F.when(F.col("len") > 1, F.col("pos") - F.col("i")).alias("start")
    starts = met.groupBy(key, "p", "len", "doc_len", start).agg(F.count(F.lit(1)).alias("found")).where("len = 1 or found = len")
    tf = starts.groupBy(key, "p", "doc_len").agg(F.sum(F.when(F.col("len") == 1, F.col("found")).otherwise(1)).alias("tf"))
    return scores(tf, tuple(corpus_stats(docs, text).first()), listed, hint, key, query)


def asked_terms(parts_of: DataFrame) -> dict[str, int] | None:
    """Asked terms with their hashes, to stand in the plan; None if they are more than LITERAL_TERMS."""
    rows = parts_of.select("term", F.xxhash64("term").alias("h")).distinct().limit(LITERAL_TERMS + 1).collect()
    return {r["term"]: r["h"] for r in rows} if len(rows) <= LITERAL_TERMS else None


def bm25_indexed(index: TextIndex, questions: DataFrame, query: str = "query_id", question: str = "question", scope: DataFrame | None = None) -> DataFrame:
    """What ``bm25`` gives, from a stored index: one scan of the asked terms' buckets serves all questions.

    ``scope`` (query, key) leaves only its pairs; statistics stay those of all documents.
    """
    key = index.key
    listed, parts_of, few = asked(questions, query, question)
    hint = F.broadcast if few else (lambda df: df)
    held = index.postings(asked_terms(parts_of))
    if held is None:
        return questions.sparkSession.createDataFrame([], f"{query} {questions.schema[query].dataType.simpleString()}, {key} long, score double")
    met = held.join(hint(parts_of), "term")
    if parts_of.where("len > 1").limit(1).count():
        # A phrase's parts are shifted to its start and meet there; a single term is a phrase that starts nowhere.
        nowhere = F.array(F.struct(F.lit(None).cast("int").alias("start"), F.col("tf").cast("long").alias("n")))
        starts = F.transform("positions", lambda x: F.struct((x - F.col("i")).alias("start"), F.lit(1).cast("long").alias("n")))
        each = met.select(key, "p", "len", "doc_len", F.explode(F.when(F.col("len") == 1, nowhere).otherwise(starts)).alias("x")).repartition(key, "p")
        found = each.groupBy(key, "p", "len", "doc_len", "x.start").agg(F.sum("x.n").alias("n")).where("len = 1 or n = len")
        tf = found.groupBy(key, "p", "doc_len").agg(F.sum(F.when(F.col("len") == 1, F.col("n")).otherwise(1)).alias("tf"))
    else:
        tf = met.select(key, "p", "doc_len", F.col("tf").cast("long").alias("tf"))
    found = scores(tf, index.statistics(), listed, hint, key, query)
    return found if scope is None else found.join(scope, [query, key], "left_semi")


def top_k(scored: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their 1-based rank; pre-limited in each task before the shuffle."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; zero vectors score 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    size = np.sqrt((vectors * vectors).sum(axis=1))
    return vectors / np.where(size > 0, size, 1.0)[:, None]


def blocks_of(rows: DataFrame, key: str, size: int) -> list[DataFrame]:
    """Rows dealt by a hash into blocks of about ``size``, one after the other; few rows are one block."""
    n = rows.count()
    if n <= size:
        return [rows]
    many = -(-n // size) + 1
    numbered = cut(rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(many))))
    return [numbered.where(F.col("_b") == i).drop("_b") for i in range(many)]


def first_of(names: pa.Array, scopes: list | None, asked_: np.ndarray, keys: pa.Array, v: np.ndarray, mine: list | None, k: int | None) -> Iterator[tuple]:
    """(query, keys, scores) of what can be among the first ``k`` of each query in a batch of vectors, ties at the last place too.

    The last place is found by partition, so a query costs one pass over its scores, not a sort.
    """
    alike = asked_ @ unit_rows(v).T
    if mine is not None:
        alike = np.where(np.array(scopes, object)[:, None] == np.array(mine, object)[None, :], alike, -np.inf)
    for i in range(len(names)):
        row = alike[i]
        some = np.nonzero(row > -np.inf)[0] if mine is not None else np.arange(len(row))
        if k is not None and len(some) > k:
            last = np.partition(row[some], len(some) - k)[len(some) - k]
            some = some[row[some] >= last - 1e-9]
        if len(some):
            yield names.take(pa.array([i] * len(some))), keys.take(pa.array(some)), row[some]


def cosine_scores(vectors: DataFrame, queries: DataFrame, key: str, query: str, scope: str | None = None, k: int | None = None) -> DataFrame:
    """(query, key, score) of each query vector with each vector, or with those of its scope only.

    With ``k`` a batch passes on, of each query, only what can be among its first k (to nine places). At most QUERY_BLOCK
    queries go to the tasks of the vectors' scan by broadcast. More of them are never in the driver: queries and vectors are
    dealt into blocks, and each pair of blocks is one group of a shuffled grid, of bounded size on both sides.
    """
    more = [scope] if scope else []
    asked_ = queries.select(query, "vector", *more)
    held = vectors.where("embedding is not null").select(key, "embedding", *more)
    kinds = {f.name: f.dataType for f in [*vectors.schema, *queries.schema]}
    schema = f"{query} {kinds[query].simpleString()}, {key} {kinds[key].simpleString()}, score double"
    matrix = lambda column: np.array(column.to_pylist(), np.float64).reshape(len(column), -1)
    listed = lambda table, i: table.column(i).to_pylist() if scope else None

    def made(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for names, keys, scores_ in parts:
            yield pa.record_batch([names, keys, pa.array(scores_, pa.float64())], [query, key, "score"])

    many = asked_.count()
    if many <= QUERY_BLOCK:
        block = asked_.orderBy(query).toArrow().combine_chunks()
        sent = vectors.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = sent.value
            if not block.num_rows:
                return
            names, unit = block.column(0).combine_chunks(), unit_rows(matrix(block.column(1)))
            names = names if isinstance(names, pa.Array) else pa.concat_arrays(names.chunks)
            for b in batches:
                if b.num_rows:
                    yield from made(first_of(names, listed(block, 2), unit, b.column(0), matrix(b.column(1)), listed(b, 2), k))

        return held.mapInArrow(run, schema)
    q_blocks, v_blocks = -(-many // QUERY_BLOCK), max(1, -(-held.count() // VECTOR_BLOCK))
    spread = lambda df, by, own, other, mine, theirs: df.withColumn(own, F.pmod(F.xxhash64(by), F.lit(mine))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(theirs - 1).cast("long"))))
    left = spread(asked_, query, "_q", "_v", q_blocks, v_blocks).groupBy("_q", "_v")
    right = spread(held, key, "_v", "_q", v_blocks, q_blocks).groupBy("_q", "_v")

    def cell(q: pa.Table, v: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], q.schema.field(query).type), pa.array([], v.schema.field(key).type), pa.array([], pa.float64())], [query, key, "score"])
        if not q.num_rows or not v.num_rows:
            return empty
        flat = lambda column: pa.concat_arrays(column.chunks)
        mine, theirs = (q[scope].to_pylist(), v[scope].to_pylist()) if scope else (None, None)
        parts = made(first_of(flat(q[query]), mine, unit_rows(matrix(q["vector"])), flat(v[key]), matrix(v["embedding"]), theirs, k))
        return pa.Table.from_batches(parts, empty.schema)

    return left.cogroup(right).applyInArrow(cell, schema)


def fuse(lists: DataFrame, by: str, key: str, k: int = RRF_K) -> DataFrame:
    """(by, key, fused, first): reciprocal rank fusion of rows (by, list_idx, rank from 1, key).

    Contributions are added in list order, so that doubles are reproducible; ``first`` breaks ties.
    """
    part = F.struct("list_idx", "rank", (1.0 / (k + F.col("rank"))).alias("part"))
    return lists.groupBy(by, key).agg(
        F.aggregate(F.array_sort(F.collect_list(part)), F.lit(0.0), lambda a, x: a + x["part"]).alias("fused"), F.min(F.struct("list_idx", "rank")).alias("first")
    )


def fused_top(lists: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """(by, key, fused, rank): the first k of a fusion."""
    return top_k(fuse(lists, by, key), [by], [F.round("fused", 12).desc(), F.col("first"), F.col(key)], k).select(by, key, "fused", "rank")


def hybrid(text_scores: DataFrame, vector_scores: DataFrame, query: str = "query_id", key: str = "doc_id", depth: int = 20, keep: int | None = None) -> DataFrame:
    """(query, key, fused, rank): text and vector scores, each cut at ``depth``, fused; the first ``keep``, by default as many as the depth."""
    best = lambda s, i: top_k(s, [query], [F.round("score", 9).desc(), F.col(key)], depth).select(query, F.lit(i).alias("list_idx"), "rank", key)
    return fused_top(best(text_scores, 0).unionByName(best(vector_scores, 1)), query, key, keep or depth)


def multi_query(fused: DataFrame, group: Column, query: str = "query_id", key: str = "doc_id", keep: int = 12) -> DataFrame:
    """(group_id, key, fused, rank): the fused lists of several phrasings of one need, fused again in order of phrasing."""
    lists = fused.select(group.alias("group_id"), F.col(query).alias("list_idx"), "rank", key)
    return fused_top(lists, "group_id", key, keep)


def vectors_added(index: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """A vector index with further vectors; one that is there already is replaced."""
    return index.join(more, key, "left_anti").unionByName(more.where("embedding is not null"))


def vectors_removed(index: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return index.join(keys, key, "left_anti")


def scope_by_name(questions: DataFrame, reports: DataFrame, query: str, question: str, name: str) -> DataFrame:
    """(query, name): names contained in a question, regardless of case; one row with a null name, for "all", where none is.

    One pass of an automaton of all names over each question finds them; names are broadcast in automata of NAME_BLOCK.
    """
    listed = reports.select(name).distinct().where(F.coalesce(F.col(name), F.lit("")) != "").withColumn("_n", F.lower(F.col(name)))
    text = questions.select(query, F.lower(F.coalesce(F.col(question), F.lit(""))).alias("_t"))
    kind = questions.schema[query].dataType.simpleString()
    hits = None
    for block in blocks_of(listed, "_n", NAME_BLOCK):
        names: dict[str, list[str]] = {}
        for r in block.collect():
            names.setdefault(r["_n"], []).append(r[name])
        sent = questions.sparkSession.sparkContext.broadcast(names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, machine = sent.value, ahocorasick.Automaton()
            for n in names:
                machine.add_word(n, n)
            machine.make_automaton()
            for b in batches:
                found = [(i, x) for i, t in enumerate(b.column(1).to_pylist()) for n in dict.fromkeys(n for _, n in machine.iter(t)) for x in names[n]] if names else []
                yield pa.record_batch([b.column(0).take(pa.array([i for i, _ in found], pa.int64())), pa.array([x for _, x in found], pa.string())], [query, name])

        part = text.mapInArrow(run, f"{query} {kind}, {name} string")
        hits = part if hits is None else hits.unionByName(part)
    hits = cut(hits)
    rest = questions.select(query).join(hits.select(query).distinct(), query, "left_anti")
    return hits.unionByName(rest.select(query, F.lit(None).cast("string").alias(name)))


def in_scope(scored: DataFrame, scoped: DataFrame, query: str, name: str) -> DataFrame:
    """Scored rows (query, name, ...) whose name is in their question's scope; a null name of the scope is all names."""
    every = scoped.where(F.col(name).isNull()).select(query)
    return scored.join(scoped, [query, name], "left_semi").unionByName(scored.join(every, query, "left_semi"))
