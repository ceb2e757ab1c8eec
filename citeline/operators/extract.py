"""Extracted facts: candidates, acceptance, open goals, fuzzy de-duplication, ranking, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeline.operators.text_index import TextIndex

MAX_CANDIDATES, MAX_GOALS, BATCH = 150, 60, 10


def candidates(topical: DataFrame, semantic: DataFrame, report: str, order: list[str], key: str, cap: int = MAX_CANDIDATES) -> DataFrame:
    """Union of both sets by key, the first ``cap`` of each report in document order."""
    both = topical.unionByName(semantic).dropDuplicates([key])
    w = Window.partitionBy(report).orderBy(*order, key)
    return both.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def accepted(found: Column, quote: Column, source_id: Column) -> Column:
    """A model's extraction counts if it says so and gives a quote and a source."""
    return F.coalesce(found & (F.coalesce(quote, F.lit("")) != "") & (F.coalesce(source_id, F.lit("")) != ""), F.lit(False))


def still_open(target_year: Column, fiscal_year: Column) -> Column:
    return target_year.isNull() | (target_year > fiscal_year)


def batches(rows: DataFrame, report: str, order: list[str], size: int = BATCH) -> DataFrame:
    """Rows with ``batch``: consecutive groups of ``size`` in order."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(report).orderBy(*order)) - 1) / size).cast("int"))


def rank_goals(goals: DataFrame, report: str, order: str, cap: int = MAX_GOALS) -> DataFrame:
    """Goals with ``rank``: those with a target and a year first, otherwise in order; the first ``cap``."""
    dated = (F.coalesce("target", F.lit("")) != "") & F.coalesce(F.col("target_year") != 0, F.lit(False))
    w = Window.partitionBy(report).orderBy(F.when(dated, 0).otherwise(1), order)
    return goals.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


#: The phrasings that look for workforce figures and for sustainability goals.
WORKFORCE_QUESTIONS = (
    "total number of employees FTE full-time equivalent", "workforce headcount at year end", "average number of employees",
    "own employees own workforce", "number of employees as of 31 December", "internal employees external employees",
)
GOAL_QUESTIONS = (
    "net zero ambition", "emission reduction target 2030 scope 1 2 3", "we aim to", "science based targets",
    "renewable energy target", "biodiversity water waste circularity target", "diversity inclusion target", "sustainability strategy goals",
)


def question_table(spark, phrasings: tuple[str, ...]) -> DataFrame:
    """(query_id, question) of fixed phrasings, in order; with them multi-query retrieval finds candidates."""
    return spark.createDataFrame(list(enumerate(phrasings)), "query_id long, question string")


def phrased_candidates(index: TextIndex, phrasings: tuple[str, ...], reports: DataFrame, vector_lists: DataFrame | None = None, report: str = "report_id", key: str = "doc_id", depth: int = 20, keep: int = 12) -> DataFrame:
    """(report, key, rank): the chunks of each report that several fixed phrasings find, each cut at ``depth``, fused in their order.

    ``index`` is the stored index of all chunks, ``reports`` (report, key) says whose they are; ``vector_lists``
    (report, query_id, list_idx, rank, key) are the vector side's lists, where there is one.
    """
    from citeline.operators import retrieval as R

    questions = question_table(reports.sparkSession, phrasings)
    found = R.bm25_indexed(index, questions).join(reports.select(report, key), key)
    order = [F.round("score", 9).desc(), F.col(key)]
    words = R.top_k(found, [report, "query_id"], order, depth).select(report, "query_id", F.lit(0).alias("list_idx"), "rank", key)
    both = words if vector_lists is None else words.unionByName(vector_lists)
    each = F.struct(report, "query_id").alias("q")
    inner = R.fused_top(both.select(each, "list_idx", "rank", key), "q", key, depth)
    outer = inner.select(F.col(f"q.{report}").alias(report), F.col("q.query_id").alias("list_idx"), "rank", key)
    return R.fused_top(outer, report, key, keep).select(report, key, "rank")


def workforce_candidates(index: TextIndex, reports: DataFrame, **limits) -> DataFrame:
    """Chunks of each report where workforce figures may stand: six phrasings, 20 each, 12 of them."""
    return phrased_candidates(index, WORKFORCE_QUESTIONS, reports, keep=12, **limits)


def goal_searches(index: TextIndex, reports: DataFrame, **limits) -> DataFrame:
    """Chunks of each report where goals may stand, by search: eight phrasings, 20 each, 40 of them."""
    return phrased_candidates(index, GOAL_QUESTIONS, reports, keep=40, **limits)


def page_items(extractions: DataFrame, report: str = "report_id") -> tuple[DataFrame, DataFrame]:
    """(one row (report, ...) with its first workforce row, all goal rows): what a report's page shows of its extractions."""
    first = F.row_number().over(Window.partitionBy(report).orderBy("id"))
    figures = extractions.where("kind = 'fte'").withColumn("_n", first).where("_n = 1").drop("_n")
    return figures, extractions.where("kind = 'sustainability_goal'")


def fact_rows(facts: DataFrame, chunks: DataFrame, compatibility: bool = True) -> DataFrame:
    """Accepted workforce facts (report_id, chunk_id, quote, value_text, ...) with verified, value, page and payload."""
    from citeline.operators.verify import verification

    joined = facts.join(chunks.select(F.col("id").alias("chunk_id"), "page_start", F.col("text").alias("_t")), "chunk_id")
    v = verification(F.col("quote"), F.col("value_text"), F.col("_t"), compatibility)
    made = joined.withColumn("_v", v).withColumns({"verified": F.col("_v.verified"), "value": F.col("_v.value"), "page": F.col("page_start")})
    return made.withColumn("payload", F.to_json(F.struct("value_text", "value"))).drop("_v", "_t", "page_start")


def goal_rows(goals: DataFrame, chunks: DataFrame, compatibility: bool = True) -> DataFrame:
    """Goals with verified (the quote alone) and page."""
    from citeline.operators.verify import quote_in

    joined = goals.join(chunks.select(F.col("id").alias("chunk_id"), F.col("page_start").alias("page"), F.col("text").alias("_t")), "chunk_id")
    return joined.withColumn("verified", quote_in(F.col("quote"), F.col("_t"), compatibility)).drop("_t")
