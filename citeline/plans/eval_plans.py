"""Evaluation over retrieval results, labels and packed chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeline.operators import answering as A
from citeline.operators import evalkit as E
from citeline.operators import models as M
from citeline.plans import chunk_plans as C
from citeline.plans import retrieval_plans as P
from citeline.plans.base import query
from citeline.plans.text_plans import CANON
from citeline.session import scratch, table


def results(spark, sf_dir):
    status = F.when(F.col("doc_id") % 10 == 0, "not_found").otherwise("answered")
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("hit"), (F.col("toxic") == 0).alias("grounded"), status.alias("status"))


RESULTS = "results AS (SELECT doc_id, quality = 1 AS hit, toxic = 0 AS grounded, CASE WHEN doc_id % 10 = 0 THEN 'not_found' ELSE 'answered' END AS status FROM labels)"


@query(f"WITH {RESULTS} SELECT count(*) AS total, count(*) FILTER (hit) AS hits, count(*) FILTER (grounded) AS grounded, count(*) FILTER (hit) / count(*) AS hit_rate, count(*) FILTER (grounded) / count(*) AS grounded_rate, count(*) FILTER (status = 'not_found') AS not_found FROM results")
def eval_summary(spark, sf_dir):
    return E.summary(results(spark, sf_dir))


@query(f"WITH {RESULTS} SELECT doc_id, hit, grounded FROM results WHERE NOT hit OR NOT grounded")
def eval_failures(spark, sf_dir):
    return E.failures(results(spark, sf_dir)).select("doc_id", "hit", "grounded")


@query(f"WITH {RESULTS} SELECT status, round(count(*) FILTER (hit) * 100.0::DOUBLE / count(*), 1) AS rate, CASE WHEN count(*) FILTER (hit) > 0 THEN round(count(*) FILTER (hit AND grounded) * 100.0::DOUBLE / count(*) FILTER (hit), 1) END AS grounded_of_hits FROM results GROUP BY status")
def rate_report(spark, sf_dir):
    n = results(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("h"), F.count_if(F.col("hit") & F.col("grounded")).alias("g"))
    return n.select("status", E.percent(F.col("h"), F.col("n")).alias("rate"), E.percent(F.col("g"), F.col("h")).alias("grounded_of_hits"))


_SOURCE_CHUNKS = f"""{C.PACKED}, sc AS (SELECT source AS report_id, CAST(c.doc_id * 1000 + n AS BIGINT) AS id, CASE WHEN c.doc_id % 6 = 0 THEN 'table' ELSE 'text' END AS kind, page_start, c.text FROM chunks c JOIN documents d ON d.doc_id = c.doc_id)"""


def source_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    kind = F.when(F.col("doc_id") % 6 == 0, "table").otherwise("text")
    return C.packed(spark, sf_dir).join(docs, "doc_id").select(F.col("source").alias("report_id"), (F.col("doc_id") * 1000 + F.col("n")).alias("id"), kind.alias("kind"), "page_start", "text")


#: Views up to sampled(report_id, id, kind, page_start, text): five chunks of each source.
_SAMPLED = f"""{_SOURCE_CHUNKS}, ev AS (SELECT *, count(*) OVER (PARTITION BY report_id) AS m FROM sc WHERE length(text) >= 400), lg AS (SELECT * FROM ev WHERE m > 5),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY length(text) DESC, page_start, id) AS k FROM lg WHERE kind = 'table') WHERE k = 1),
x AS (SELECT lg.*, 5 - CASE WHEN t.report_id IS NULL THEN 0 ELSE 1 END AS want, row_number() OVER (PARTITION BY lg.report_id ORDER BY lg.page_start, lg.id) - 1 AS i, count(*) OVER (PARTITION BY lg.report_id) AS alln FROM lg LEFT JOIN t ON t.report_id = lg.report_id WHERE lg.kind = 'text'),
sampled AS (SELECT report_id, id, kind, page_start, text FROM t UNION ALL SELECT report_id, id, kind, page_start, text FROM x WHERE i % greatest(1, alln // want) = 0 AND i // greatest(1, alln // want) < want UNION ALL SELECT report_id, id, kind, page_start, text FROM ev WHERE m <= 5)"""


@query(f"WITH RECURSIVE {_SAMPLED} SELECT report_id, id, kind FROM sampled")
def sample_chunks(spark, sf_dir):
    return E.sample_chunks(source_chunks(spark, sf_dir), 5).select("report_id", "id", "kind")


@query(
    f"""WITH RECURSIVE {_SAMPLED}, q AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))[1] AS quote FROM sampled)
SELECT id, 'What is said on page ' || page_start || '?' AS question, quote AS expected_quote FROM q WHERE quote IS NOT NULL AND contains({CANON.format(x='text')}, {CANON.format(x='quote')})"""
)
def gold_set(spark, sf_dir):
    """Questions of the offline model on the sampled chunks of each source, where their quotes stand in the chunk."""
    chunks = E.sample_chunks(source_chunks(spark, sf_dir), 5).withColumns({"company": F.col("report_id"), "fiscal_year": F.lit(2024)})
    return A.gold_set(chunks, scratch(spark, "answers"), A.offline_question, compatibility=False).select("id", "question", "expected_quote")


@query(
    f"""WITH {P.BM25}, top AS (SELECT query_id, doc_id FROM (SELECT *, {P._TOP} AS rank FROM s) WHERE rank <= 8),
p AS (SELECT item_id, {CANON.format(x='b.text')} AS q, {CANON.format(x='d.text')} AS t FROM benchmark b LEFT JOIN top ON query_id = item_id LEFT JOIN documents d USING (doc_id))
SELECT item_id AS query_id, coalesce(bool_or(contains(t, q) OR contains(q, t)), false) AS hit FROM p GROUP BY item_id"""
)
def retrieval_hits(spark, sf_dir):
    """Whether one of the first eight documents of a passage overlaps it."""
    top = P.best(P.bm25_lists(spark, sf_dir), 8).join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("chunk_text")), "doc_id").select("query_id", "chunk_text")
    return E.retrieval_hits(top, P.passages(spark, sf_dir), "query_id", "chunk_text", "question", compatibility=False)


def stored_facts(spark, sf_dir):
    """Two facts of each document, one of them with a stale flag."""
    docs = table(spark, sf_dir, "documents")
    quote = F.when(F.col("doc_id") % 7 == 0, F.reverse(F.substring("text", 1, 50))).otherwise(F.substring("text", 1, 50))
    kind = F.when(F.col("doc_id") % 2 == 0, "fte").otherwise("sustainability_goal")
    return docs.select(F.col("doc_id").alias("id"), kind.alias("kind"), quote.alias("quote"), F.when(F.col("doc_id") % 4 == 0, F.lit("zz")).otherwise("").alias("value_text"), F.when(F.col("doc_id") % 50 != 0, F.col("doc_id")).alias("chunk_id"), (F.col("doc_id") % 3 != 0).alias("verified"))


@query(
    f"""WITH e AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'fte' ELSE 'goal' END AS kind, CASE WHEN doc_id % 7 = 0 THEN reverse(substr(text, 1, 50)) ELSE substr(text, 1, 50) END AS quote, CASE WHEN doc_id % 4 = 0 THEN 'zz' ELSE '' END AS v, doc_id % 3 <> 0 AS verified, text FROM documents WHERE doc_id % 50 <> 0),
n AS (SELECT *, trim(quote) <> '' AND contains({CANON.format(x='text')}, {CANON.format(x='quote')}) AND (kind <> 'fte' OR v = '' OR contains(quote, v)) AS now_verified FROM e)
SELECT id, now_verified FROM n WHERE now_verified <> verified"""
)
def reverify(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return E.reverify(stored_facts(spark, sf_dir), chunks, compatibility=False).select("id", "now_verified")


@query(
    """WITH w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM benchmark),
b AS (SELECT item_id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 64 AS bucket, count(*) AS n FROM w GROUP BY ALL)
SELECT item_id, bucket, n FROM b"""
)
def offline_embedding(spark, sf_dir):
    """The deterministic stand-in for an embedding model, bucket by bucket."""
    made = M.embed(table(spark, sf_dir, "benchmark"), "text", "v")
    return made.select("item_id", F.posexplode("v").alias("bucket", "n")).where("n > 0").select("item_id", F.col("bucket").cast("long").alias("bucket"), F.col("n").cast("long").alias("n"))


@query(
    """WITH m AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS history, CASE turn % 3 WHEN 0 THEN ' ' WHEN 1 THEN substr(text, 1, 15) ELSE text END AS proposal FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN coalesce(history, '') <> '' AND trim(proposal) <> '' THEN trim(proposal) ELSE text END AS question, coalesce(history, '') <> '' AND trim(proposal) <> '' AND trim(proposal) <> trim(text) AS rewritten FROM m"""
)
def followup_rewrite(spark, sf_dir):
    w = P.R.Window.partitionBy("conv_id").orderBy("turn")
    proposal = F.when(F.col("turn") % 3 == 0, " ").when(F.col("turn") % 3 == 1, F.substring("text", 1, 15)).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text", F.lag("text").over(w).alias("history"), proposal.alias("proposal"))
    question, changed = M.rewritten(F.col("text"), F.col("history"), F.col("proposal"))
    return rows.select("conv_id", "turn", question.alias("question"), changed.alias("rewritten"))


@query(
    f"""WITH e AS (SELECT doc_id AS chunk_id, doc_id % 3 <> 0 AS usable, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'q' END AS question, CASE WHEN doc_id % 7 = 0 THEN reverse(substr(text, 1, 50)) ELSE substr(text, 1, 50) END AS q, text FROM documents)
SELECT chunk_id FROM e WHERE usable AND trim(question) <> '' AND trim(q) <> '' AND contains({CANON.format(x='text')}, {CANON.format(x='q')})"""
)
def gold_entries(spark, sf_dir):
    """Which proposed entries of a gold set are taken."""
    docs = table(spark, sf_dir, "documents")
    quote = F.when(F.col("doc_id") % 7 == 0, F.reverse(F.substring("text", 1, 50))).otherwise(F.substring("text", 1, 50))
    made = docs.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 3 != 0).alias("usable"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise("q").alias("question"), quote.alias("expected_quote"))
    return E.accepted_gold(made, docs.select(F.col("doc_id").alias("id"), "text"), compatibility=False).select("chunk_id")


@query(
    f"""WITH e AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'fte' ELSE 'sustainability_goal' END AS kind, CASE WHEN doc_id % 7 = 0 THEN reverse(substr(text, 1, 50)) ELSE substr(text, 1, 50) END AS quote, CASE WHEN doc_id % 4 = 0 THEN 'zz' ELSE '' END AS v, doc_id % 3 <> 0 AS verified, text FROM documents WHERE doc_id % 50 <> 0),
n AS (SELECT *, trim(quote) <> '' AND contains({CANON.format(x='text')}, {CANON.format(x='quote')}) AND (kind <> 'fte' OR v = '' OR contains(quote, v)) AS now FROM e)
SELECT kind, count(*) AS checked, count(*) FILTER (now AND NOT verified) AS gained, count(*) FILTER (verified AND NOT now) AS lost FROM n GROUP BY kind"""
)
def reverify_counts(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return E.reverify_counts(stored_facts(spark, sf_dir), chunks, compatibility=False)
