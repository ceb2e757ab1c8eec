"""Extraction operators over goals made of ``part`` and over document lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeline.functions.text import TOPICS
from citeline.operators import catalog as K
from citeline.operators import extract as E
from citeline.operators import extraction as X
from citeline.operators.context import extraction_context
from citeline.operators.dedupe import dedupe_goals as dedupe
from citeline.plans.base import query
from citeline.plans.retrieval_plans import bm25_sql, stored_index
from citeline.plans.text_plans import CANON
from citeline.session import scratch, table


def goals(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        (k % 10).alias("report_id"), k.alias("pos"), F.expr("repeat(p_name, cast(p_partkey % 4 + 1 as int))").alias("quote"), F.col("p_name").alias("title"), F.col("p_type").alias("category"),
        F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, F.lit("")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("%"))).alias("target"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 20 + 2020).alias("target_year"),
    )


GOALS = """goals AS (SELECT p_partkey % 10 AS report_id, p_partkey AS pos, repeat(p_name, CAST(p_partkey % 4 + 1 AS INTEGER)) AS quote, p_name AS title, p_type AS category,
 CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_size || '%' END AS target, CASE WHEN p_size % 7 <> 0 THEN p_size % 20 + 2020 END AS target_year FROM part)"""


@query(f"WITH {GOALS} SELECT report_id, pos, target_year FROM goals WHERE target_year IS NULL OR target_year > 2024 + report_id % 5")
def open_goals(spark, sf_dir):
    return goals(spark, sf_dir).where(E.still_open(F.col("target_year"), F.col("report_id") % 5 + 2024)).select("report_id", "pos", "target_year")


@query(f"WITH {GOALS} SELECT report_id, pos, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY CASE WHEN coalesce(target, '') <> '' AND coalesce(target_year, 0) <> 0 THEN 0 ELSE 1 END, pos) AS n FROM goals) WHERE n <= 60")
def rank_goals(spark, sf_dir):
    return E.rank_goals(goals(spark, sf_dir), "report_id", "pos").select("report_id", "pos", "rank")


@query(f"WITH {GOALS} SELECT report_id, pos, CAST((row_number() OVER (PARTITION BY report_id ORDER BY pos) - 1) // 10 AS INTEGER) AS batch FROM goals")
def batches(spark, sf_dir):
    return E.batches(goals(spark, sf_dir), "report_id", ["pos"]).select("report_id", "pos", "batch")


@query(f"WITH {GOALS} SELECT report_id, pos FROM goals WHERE pos % 2 = 0 AND coalesce(quote, '') <> '' AND coalesce(target, '') <> ''")
def accepted_extractions(spark, sf_dir):
    return goals(spark, sf_dir).where(E.accepted(F.col("pos") % 2 == 0, F.col("quote"), F.col("target"))).select("report_id", "pos")


@query()
def dedupe_goals(spark, sf_dir):
    """No SQL form: the similarity is a matching of blocks, and order counts; tests hold these rows against a loop."""
    return dedupe(goals(spark, sf_dir)).select("report_id", "category", "target_year", "slot", "pos", "quote")


def statements(spark, sf_dir):
    """Documents as chunks of their source's report: whole texts, some with a last line on staff or on goals.

    Columns: doc_id, chunk_id, report_id, page_start, page_end, kind, text.
    """
    i, n = F.col("doc_id"), F.format_number(F.col("doc_id") * 37 + 1000, 0)
    staff = F.concat(F.lit("The workforce was "), n, F.lit(" employees at year end."))
    goal = F.concat(F.lit("We aim to reach net zero emissions in plant "), (i % 6).cast("string"), F.lit(" by "), (2020 + i % 17).cast("string"), F.lit("."))
    last = F.when(i % 5 == 0, staff).when(i % 5 == 1, goal).when(i % 5 == 2, F.lit("Renewable energy and water are on the agenda."))
    page = (i % 50).cast("int")
    return table(spark, sf_dir, "documents").select(
        i, i.alias("chunk_id"), F.col("source").alias("report_id"), page.alias("page_start"), page.alias("page_end"), F.lit("text").alias("kind"), F.concat_ws("\n", "text", last).alias("text")
    )


STATEMENTS = """statements AS (SELECT doc_id, doc_id AS chunk_id, source AS report_id, CAST(doc_id % 50 AS INTEGER) AS page_start, concat_ws(chr(10), text, CASE doc_id % 5
  WHEN 0 THEN 'The workforce was ' || format('{:,}', doc_id * 37 + 1000) || ' employees at year end.'
  WHEN 1 THEN 'We aim to reach net zero emissions in plant ' || (doc_id % 6) || ' by ' || (2020 + doc_id % 17) || '.'
  WHEN 2 THEN 'Renewable energy and water are on the agenda.' END) AS text FROM documents)"""


def _asked(phrasings) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(phrasings)) + ") v(query_id, text))"


def _found(phrasings, keep: int) -> str:
    """Views up to found(report_id, doc_id, rank): phrasings fused in their order."""
    return f"""{STATEMENTS}, {bm25_sql("statements", _asked(phrasings))},
tops AS (SELECT report_id, query_id, doc_id, row_number() OVER (PARTITION BY report_id, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s JOIN statements USING (doc_id)),
fu AS (SELECT report_id, doc_id, sum(1.0 / (60 + CAST(rank AS DOUBLE)) ORDER BY query_id) AS fused, min(query_id * 1000 + rank) AS first FROM tops WHERE rank <= 20 GROUP BY ALL),
found AS (SELECT report_id, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY round(fused, 12) DESC, first, doc_id) AS rank FROM fu) WHERE rank <= {keep})"""


@query(f"WITH {_found(E.WORKFORCE_QUESTIONS, 12)} SELECT report_id, doc_id, rank FROM found")
def workforce_candidates(spark, sf_dir):
    """The first twelve chunks of each report by six fixed phrasings."""
    return E.workforce_candidates(stored_index(spark, sf_dir, statements), statements(spark, sf_dir).select("report_id", "doc_id"))


@query(
    f"""WITH {_found(E.GOAL_QUESTIONS, 40)}, c AS (SELECT report_id, chunk_id, page_start FROM statements WHERE regexp_matches(text, '(?i)\\b({TOPICS})\\b') OR chunk_id IN (SELECT doc_id FROM found))
SELECT report_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY page_start, chunk_id) AS n FROM c) WHERE n <= 150"""
)
def goal_candidates(spark, sf_dir):
    """Chunks that speak of a topic united with what eight fixed searches find, the first 150 of each report in page order."""
    return candidates_of_goals(spark, sf_dir).select("report_id", "chunk_id")


def candidates_of_goals(spark, sf_dir):
    chunks = statements(spark, sf_dir)
    searched = E.goal_searches(stored_index(spark, sf_dir, statements), chunks.select("report_id", "doc_id"))
    return X.goal_candidates(chunks, searched.withColumnRenamed("doc_id", "chunk_id"))


@query()
def extracted_goals(spark, sf_dir):
    """Goals of each report by the offline model, mapped in batches of ten chunks and reduced; no SQL form, since rewordings are told by a matching of blocks."""
    years = table(spark, sf_dir, "documents").select(F.col("source").alias("report_id")).distinct().withColumn("fiscal_year", F.lit(2024))
    return X.extract_goals(candidates_of_goals(spark, sf_dir), years, scratch(spark, "answers"), X.offline_goals, compatibility=False)


@query(
    f"""WITH {_found(E.WORKFORCE_QUESTIONS, 12)}, f AS (SELECT report_id, min(rank) AS rank FROM found WHERE doc_id % 5 = 0 GROUP BY report_id)
SELECT report_id, doc_id AS chunk_id, format('{{:,}}', doc_id * 37 + 1000) AS value_text, CAST(doc_id * 37 + 1000 AS DOUBLE) AS value, CAST(doc_id % 50 AS INTEGER) AS page, true AS verified FROM found JOIN f USING (report_id, rank)"""
)
def extracted_workforce(spark, sf_dir):
    """The workforce figure of each report by the offline model, from its twelve candidates, held against its chunk."""
    chunks = statements(spark, sf_dir)
    found = E.workforce_candidates(stored_index(spark, sf_dir, statements), chunks.select("report_id", "doc_id"))
    facts = X.extract_workforce(chunks.join(found, ["report_id", "doc_id"]), scratch(spark, "answers"), X.offline_workforce, compatibility=False)
    return facts.select("report_id", "chunk_id", "value_text", "value", "page", "verified")


def found_facts(spark, sf_dir):
    """A fact of each document: its first words as the quote, every fifth one spoilt."""
    docs = table(spark, sf_dir, "documents")
    quote = F.when(F.col("doc_id") % 5 == 0, F.reverse(F.substring("text", 1, 60))).otherwise(F.substring("text", 1, 60))
    return docs.select(F.col("doc_id").alias("chunk_id"), quote.alias("quote"), F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") * 1000).cast("string")).otherwise("").alias("value_text"))


def doc_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).cast("int").alias("page_start"), "text")


_FACTS = "f AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 5 = 0 THEN reverse(substr(text, 1, 60)) ELSE substr(text, 1, 60) END AS quote, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id * 1000 AS VARCHAR) ELSE '' END AS v, text FROM documents)"
_GOOD = f"trim(quote) <> '' AND contains({CANON.format(x='text')}, {CANON.format(x='quote')})"


@query(f"WITH {_FACTS} SELECT chunk_id, {_GOOD} AND (v = '' OR contains(quote, v)) AS verified, CASE WHEN v <> '' THEN CAST(v AS DOUBLE) END AS value, CAST(chunk_id % 50 AS INTEGER) AS page FROM f")
def fact_rows(spark, sf_dir):
    return E.fact_rows(found_facts(spark, sf_dir), doc_chunks(spark, sf_dir), compatibility=False).select("chunk_id", "verified", "value", "page")


@query(f"WITH {_FACTS} SELECT chunk_id, {_GOOD} AS verified, CAST(chunk_id % 50 AS INTEGER) AS page FROM f")
def goal_rows(spark, sf_dir):
    return E.goal_rows(found_facts(spark, sf_dir), doc_chunks(spark, sf_dir), compatibility=False).select("chunk_id", "verified", "page")


@query(f"WITH {STATEMENTS} SELECT chunk_id, page_start FROM statements WHERE report_id = 'src3' ORDER BY page_start, chunk_id")
def report_chunks(spark, sf_dir):
    """The chunks of one report by page."""
    return K.of_report(statements(spark, sf_dir), "src3", ["page_start", "chunk_id"]).select("chunk_id", "page_start")


@query(
    f"""WITH {STATEMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY page_start, chunk_id) - 1 AS i FROM statements)
SELECT report_id || '/' || (i // 10) AS prompt, md5(string_agg('<source id="S' || (i % 10 + 1) || '" pages="' || page_start || '" kind="text">' || chr(10) || text || chr(10) || '</source>', chr(10) || chr(10) ORDER BY i)) AS digest, string_agg('S' || (i % 10 + 1) || '=' || chunk_id, ',' ORDER BY i) AS ids FROM n GROUP BY 1"""
)
def extraction_contexts(spark, sf_dir):
    """The prompt text of each batch of ten chunks, and what its source ids stand for."""
    batched = E.batches(statements(spark, sf_dir), "report_id", ["page_start", "chunk_id"]).withColumn("prompt", F.concat_ws("/", "report_id", "batch"))
    text, ids = extraction_context(batched, ["page_start", "chunk_id"], "prompt")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.substring("source_id", 2, 9).cast("int").alias("i"), "source_id", "chunk_id"))), lambda x: F.concat_ws("=", x["source_id"], x["chunk_id"].cast("string")))
    return text.select("prompt", F.md5(F.col("context").cast("binary")).alias("digest")).join(ids.groupBy("prompt").agg(F.array_join(listed, ",").alias("ids")), "prompt")
