"""Retrieval over documents (text) and embeddings (vectors); benchmark passages are the questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeline.operators import retrieval as R
from citeline.operators import segments as S
from citeline.operators import text_index as I
from citeline.operators import vector_index as VI
from citeline.plans.base import query
from citeline.plans.text_plans import FIRSTS, TOKENS
from citeline.session import release, scratch, table
from citeline.streaming.indexing import index_batch, index_stream

def bm25_sql(docs: str, asked: str) -> str:
    """Views of DuckDB up to s(query_id, doc_id, score): BM25 of every question (query_id, text) over all texts (doc_id, text)."""
    return f"""words AS (SELECT doc_id, list_transform(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+'), lambda x: x) AS w FROM {docs}),
stats AS (SELECT count(*) AS n, avg(len(w)) AS l FROM words),
q0 AS (SELECT query_id, {TOKENS.format(x='text')} AS t FROM {asked}),
q1 AS (SELECT query_id, {FIRSTS.format(l='t')} AS t FROM q0),
q AS (SELECT query_id, i AS n, t[i] AS token FROM q1, range(1, len(t) + 1) r(i)),
ph AS (SELECT query_id, n, regexp_extract_all(strip_accents(token), '[\\p{{L}}\\p{{N}}]+') AS terms FROM q),
one AS (SELECT DISTINCT terms FROM ph WHERE len(terms) = 1),
many AS (SELECT DISTINCT terms FROM ph WHERE len(terms) > 1),
tf1 AS (SELECT doc_id, [term] AS terms, len, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM words) WHERE [term] IN (SELECT terms FROM one) GROUP BY ALL),
tf2 AS (SELECT doc_id, terms, len(w) AS len, (SELECT count(*) FROM range(1, len(w) + 1) r(i) WHERE w[i:i + len(terms) - 1] = terms) AS tf FROM words, many WHERE list_has_all(w, terms)),
tf AS (SELECT * FROM tf1 UNION ALL SELECT * FROM tf2 WHERE tf > 0),
dfs AS (SELECT terms, count(*) AS df FROM tf GROUP BY terms),
part AS (SELECT doc_id, terms, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / l)) AS p FROM tf JOIN dfs USING (terms), stats),
s AS (SELECT query_id, doc_id, sum(p ORDER BY n) AS score FROM part JOIN ph USING (terms) GROUP BY query_id, doc_id)"""


#: BM25 of every benchmark passage over all documents.
BM25 = bm25_sql("documents", "(SELECT item_id AS query_id, text FROM benchmark)")

_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)"


def passages(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


_STORED: dict[tuple, tuple] = {}


def stored_index(spark, sf_dir, view=None):
    """The index of the documents, or of a named view of them (a function of (spark, sf_dir)): written once a session for the files as they are (name, length, time of change), then read by every question."""
    fs, at = S.hadoop(spark, f"{sf_dir}/documents.parquet")
    state = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)))
    name = (spark.sparkContext.applicationId, sf_dir, view and view.__name__)
    held = _STORED.get(name)
    if held is None or held[0] != state:
        if held is not None:
            S.hadoop(spark, held[1])[0].delete(S.hadoop(spark, held[1])[1], True)
        path = scratch(spark, "index")
        I.index_append((view(spark, sf_dir) if view else table(spark, sf_dir, "documents")).select("doc_id", "text"), path)
        release(spark)  # of building it, its files alone stay
        _STORED[name] = (state, path)
    return I.index_read(spark, _STORED[name][1])


@query(
    """WITH a AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM documents), w AS (SELECT doc_id, unnest(w) AS term FROM a)
SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM w GROUP BY term"""
)
def stream_index(spark, sf_dir):
    """The documents as a stream into a stored index, its first batch run once more: what the index holds is what one append holds."""
    path, docs = scratch(spark, "index"), table(spark, sf_dir, "documents").select("doc_id", "text")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parque[t]")
    index_stream(stream, path, scratch(spark, "progress"), "documents")
    index_batch(docs, 0, path, "documents")
    return I.index_read(spark, path).postings().groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences"))


def bm25_lists(spark, sf_dir):
    return R.bm25_indexed(stored_index(spark, sf_dir), passages(spark, sf_dir))


def bm25_once(spark, sf_dir):
    """What ``bm25_lists`` gives, without an index: where questions are asked once, only their words move, not all of the documents."""
    return R.bm25(table(spark, sf_dir, "documents"), passages(spark, sf_dir))


def vector_scores(spark, sf_dir, queries=None, k=20):
    """Scores of the first ``k`` vectors of each query at least."""
    queries = vector_queries(spark, sf_dir).drop("label") if queries is None else queries
    return R.cosine_scores(vectors(spark, sf_dir), queries, "doc_id", "query_id", k=k)


def best(scored, k, key="doc_id"):
    return R.top_k(scored, ["query_id"], [F.round("score", 9).desc(), F.col(key)], k)


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, {_TOP} AS rank FROM s) WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return best(bm25_lists(spark, sf_dir), 10).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT s.*, {_TOP} AS rank FROM s JOIN documents d USING (doc_id) WHERE d.source = 'src' || (query_id % 20)) WHERE rank <= 5")
def bm25_scoped(spark, sf_dir):
    """Corpus statistics stay global; each question sees one source only."""
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    wanted = passages(spark, sf_dir).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("source"))
    mine = R.bm25_indexed(stored_index(spark, sf_dir), passages(spark, sf_dir), scope=sources.join(F.broadcast(wanted), "source").select("query_id", "doc_id"))
    return best(mine, 5).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query(
    """WITH a AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM documents),
w AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM a)
SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS occurrences, CAST(max(l) AS INTEGER) AS longest FROM w GROUP BY term"""
)
def postings(spark, sf_dir):
    found = R.postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences"), F.max("doc_len").alias("longest"))


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def vector_queries(spark, sf_dir):
    return vectors(spark, sf_dir).where("doc_id % 100 = 0").select((F.expr("doc_id div 100")).alias("query_id"), F.col("embedding").alias("vector"), "label")


COS = """v AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, label FROM embeddings),
vq AS (SELECT doc_id // 100 AS query_id, e AS qe, label AS ql FROM v WHERE doc_id % 100 = 0),
cs AS (SELECT query_id, doc_id, label, ql, list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))) AS score FROM v, vq)"""
_VTOP = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)"


@query(f"WITH {COS} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, {_VTOP} AS rank FROM cs) WHERE rank <= 20")
def cosine_topk(spark, sf_dir):
    return best(vector_scores(spark, sf_dir), 20).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {COS} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, {_VTOP} AS rank FROM cs WHERE label = ql) WHERE rank <= 20")
def cosine_scoped(spark, sf_dir):
    """The semi-join on the scope comes before scoring."""
    return best(R.cosine_scores(vectors(spark, sf_dir), vector_queries(spark, sf_dir), "doc_id", "query_id", "label", k=20), 20).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_LISTS = f"""{BM25}, {COS},
lists AS (SELECT query_id, 0 AS list_idx, {_TOP} AS rank, doc_id FROM s UNION ALL SELECT query_id, 1, {_VTOP}, doc_id FROM cs WHERE query_id IN (SELECT item_id FROM benchmark)),
top20 AS (SELECT * FROM lists WHERE rank <= 20),
f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank) ORDER BY list_idx) AS fused, min(list_idx * 1000 + rank) AS first FROM (SELECT query_id, list_idx, CAST(rank AS DOUBLE) AS rank, doc_id FROM top20) GROUP BY ALL),
fr AS (SELECT query_id, doc_id, round(fused, 9) AS fused, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, first, doc_id) AS INTEGER) AS rank FROM f)"""


def ranked_lists(spark, sf_dir):
    """Both lists of each question, 20 deep: text first, vectors second."""
    text = best(bm25_lists(spark, sf_dir), 20).select("query_id", F.lit(0).alias("list_idx"), "rank", "doc_id")
    asked = passages(spark, sf_dir).select("query_id")
    semantic = best(vector_scores(spark, sf_dir, vector_queries(spark, sf_dir).drop("label").join(asked, "query_id", "left_semi")), 20)
    return text.unionByName(semantic.select("query_id", F.lit(1).alias("list_idx"), "rank", "doc_id"))


@query(f"WITH {_LISTS} SELECT query_id, doc_id, fused FROM fr")
def rrf_fuse(spark, sf_dir):
    return R.fuse(ranked_lists(spark, sf_dir), "query_id", "doc_id").select("query_id", "doc_id", F.round("fused", 9).alias("fused"))


def hybrid_lists(spark, sf_dir, keep=None):
    asked = vector_queries(spark, sf_dir).drop("label").join(passages(spark, sf_dir).select("query_id"), "query_id", "left_semi")
    return R.hybrid(bm25_lists(spark, sf_dir), vector_scores(spark, sf_dir, asked), keep=keep)


@query(f"WITH {_LISTS} SELECT * FROM fr WHERE rank <= 8")
def hybrid_search(spark, sf_dir):
    return hybrid_lists(spark, sf_dir, 8).select("query_id", "doc_id", F.round("fused", 9).alias("fused"), "rank")


@query(
    f"""WITH {_LISTS}, g AS (SELECT query_id % 5 AS group_id, query_id AS list_idx, rank, doc_id FROM fr WHERE rank <= 20),
h AS (SELECT group_id, doc_id, sum(1.0 / (60 + CAST(rank AS DOUBLE)) ORDER BY list_idx) AS fused, min(list_idx * 1000 + rank) AS first FROM g GROUP BY ALL)
SELECT group_id, doc_id, round(fused, 9) AS fused, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY round(fused, 12) DESC, first, doc_id) AS INTEGER) AS rank FROM h) WHERE rank <= 12"""
)
def multi_query_search(spark, sf_dir):
    """Several phrasings of one need: each is fused first, then the fused lists are fused again."""
    return R.multi_query(hybrid_lists(spark, sf_dir), F.col("query_id") % 5).select("group_id", "doc_id", F.round("fused", 9).alias("fused"), "rank")


_NAMED = "SELECT item_id, CASE WHEN item_id % 4 = 0 THEN text ELSE text || ' SRC' || (item_id % 20) END AS question FROM benchmark"


@query(
    f"""WITH qs AS ({_NAMED}), p AS (SELECT item_id, source, contains(lower(question), lower(source)) AS hit FROM qs, (SELECT DISTINCT source FROM documents))
SELECT item_id, source FROM (SELECT *, bool_or(hit) OVER (PARTITION BY item_id) AS found FROM p) WHERE hit OR NOT found"""
)
def scope_by_source(spark, sf_dir):
    """The sources that each question names; every source where it names none."""
    named = F.when(F.col("item_id") % 4 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" SRC"), (F.col("item_id") % 20).cast("string")))
    questions = table(spark, sf_dir, "benchmark").select("item_id", named.alias("question"))
    questions, sources = questions.where("question is not null"), table(spark, sf_dir, "documents").select("source").distinct()
    hits = R.scope_by_name(questions, sources, "item_id", "question", "source").where("source is not null")
    hits = hits.unionByName(questions.select("item_id").crossJoin(sources.where("source = ''")))  # the empty name is in every question
    rest = questions.select("item_id").join(hits.select("item_id").distinct(), "item_id", "left_anti")
    return hits.unionByName(rest.crossJoin(sources))


_LIVE = """live AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 5 = 0),
lw AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(CASE WHEN doc_id % 15 = 0 THEN 'renewed ' || text ELSE text END)), '[\\p{L}\\p{N}]+') AS w FROM live)"""


@query(f"WITH {_LIVE} SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM (SELECT doc_id, unnest(w) AS term FROM lw) GROUP BY term")
def index_maintenance(spark, sf_dir):
    """Two appends, a delete, an update (delete and append anew), a compaction: the index holds what is live, and a pinned reader what was."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "index")
    I.index_append(docs.where("doc_id % 2 = 0"), path, batch="even")
    I.index_append(docs.where("doc_id % 2 <> 0"), path)
    I.index_append(docs.where("doc_id % 2 = 0"), path, batch="even")  # replayed: changes nothing
    I.index_delete(docs.where("doc_id % 3 = 0"), path)
    I.index_compact(spark, path)
    I.index_append(docs.where("doc_id % 15 = 0").withColumn("text", F.concat(F.lit("renewed "), "text")), path)
    found = I.index_read(spark, path).postings()
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences"))


@query("SELECT vec_id AS doc_id, label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) * CASE WHEN vec_id % 10 = 2 THEN 2 ELSE 1 END, 6) AS total FROM embeddings WHERE vec_id % 10 NOT IN (0, 1)")
def vector_index_updates(spark, sf_dir):
    """A stored index: add, replace some (remove and add anew), remove some; what is left."""
    all_, path = vectors(spark, sf_dir), scratch(spark, "vectors")
    add = lambda rows: VI.vectors_add(rows, path, "doc_id", "label")
    add(all_.where("doc_id % 10 <> 1"))
    VI.vectors_remove(all_.where("doc_id % 10 = 2"), path, "doc_id")
    add(all_.where("doc_id % 10 = 2").withColumn("embedding", F.transform("embedding", lambda x: (x * 2).cast("float"))))
    VI.vectors_remove(all_.where("doc_id % 10 = 0"), path, "doc_id")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return VI.vectors_read(spark, path, "doc_id", "label").vectors().select("doc_id", "label", F.round(total, 6).alias("total"))


@query(f"WITH {COS} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, {_VTOP} AS rank FROM cs) WHERE rank <= 20")
def vector_index_search(spark, sf_dir):
    """The stored index's search, codes first and exact scores last, of every hundredth vector against all."""
    path = scratch(spark, "vectors")
    VI.vectors_add(vectors(spark, sf_dir), path, "doc_id", "label")
    found = VI.vectors_read(spark, path, "doc_id", "label").search(vector_queries(spark, sf_dir), 20)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")
