"""Budgeted context assembly, source tags and chat history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeline.operators.text_index import TextIndex

from citeline.functions.text import page_label, source_tag

CHARS_PER_TOKEN, HISTORY_CHARS, HISTORY_MESSAGES = 4, 500, 2


def within_budget(sizes: Column, budget: int) -> Column:
    """Which of the sizes, in order, are kept: one that does not fit is skipped and the walk goes on."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("kept"))

    def step(acc: Column, n: Column) -> Column:
        fits = acc["used"] + n <= budget
        return F.struct((acc["used"] + F.when(fits, n).otherwise(0)).alias("used"), F.concat(acc["kept"], F.array(fits)).alias("kept"))

    return F.aggregate(sizes, start, step, lambda acc: acc["kept"])


def assemble(ranked: DataFrame, budget_tokens: int, query: str = "query_id") -> DataFrame:
    """Ranked chunks (query, rank, chunk_id, report_id, page_start, ...) within the budget, with ``source_id``.

    A chunk counts once, at its best rank; what is kept is ordered by report and page.
    """
    first = Window.partitionBy(query, "chunk_id").orderBy("rank")
    once = ranked.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    sized = once.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.length("text").cast("long").alias("n")))).alias("c"))
    kept = sized.select(query, F.explode(F.arrays_zip("c", within_budget(F.transform("c", lambda x: x["n"]), budget_tokens * CHARS_PER_TOKEN).alias("kept"))).alias("x")).where("x.kept").select(query, "x.c.chunk_id")
    number = F.row_number().over(Window.partitionBy(query).orderBy("report_id", "page_start", "rank"))
    return once.join(kept, [query, "chunk_id"]).withColumn("_s", number).withColumn("source_id", F.concat(F.lit("S"), F.col("_s").cast("string")))


def render(sources: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, context): the sources as tagged blocks in order, blank lines between."""
    tag = source_tag(F.col("source_id"), F.concat_ws(" ", "company", F.col("year").cast("string")), F.col("company"), F.col("year"), F.col("page_start"), F.col("page_end"), F.col("kind"), F.col("text"))
    return sources.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_s", tag.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))


def short_tag(source_id: Column, first: Column, last: Column, kind: Column, text: Column) -> Column:
    """The tag of an extraction prompt: pages and kind only."""
    return F.concat(F.lit('<source id="'), source_id, F.lit('" pages="'), page_label(first, last), F.lit('" kind="'), kind, F.lit('">\n'), text, F.lit("\n</source>"))


def extraction_context(chunks: DataFrame, order: list[str], query: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """((query, context), (query, source_id, chunk_id)): the prompt of an extraction, and what its source ids stand for."""
    numbered = chunks.withColumn("_s", F.row_number().over(Window.partitionBy(query).orderBy(*order))).withColumn("source_id", F.concat(F.lit("S"), F.col("_s").cast("string")))
    tag = short_tag(F.col("source_id"), F.col("page_start"), F.col("page_end"), F.col("kind"), F.col("text"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("_s", tag.alias("t")))), lambda x: x["t"])
    return numbered.groupBy(query).agg(F.array_join(blocks, "\n\n").alias("context")), numbered.select(query, "source_id", "chunk_id")


def recent(messages: DataFrame, conversation: str, order: str, n: int = HISTORY_MESSAGES) -> DataFrame:
    """The last n messages of each conversation."""
    w = Window.partitionBy(conversation).orderBy(F.col(order).desc())
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def history(messages: DataFrame, conversation: str, order: str, role: str, text: str) -> DataFrame:
    """(conversation, history): one line per message, oldest first; any role but user is the assistant."""
    line = F.concat(F.when(F.col(role) == "user", "User: ").otherwise("Assistant: "), F.substring(F.col(text), 1, HISTORY_CHARS))
    return messages.groupBy(conversation).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))), lambda x: x["l"]), "\n").alias("history"))


def attach_interpretation(messages: DataFrame, conversation: str, order: str) -> DataFrame:
    """Messages with ``shown_as``: a user turn takes the interpretation stored with the assistant turn after it."""
    after = F.lead(F.struct("role", "interpreted_as")).over(Window.partitionBy(conversation).orderBy(order))
    return messages.withColumn("shown_as", F.when((F.col("role") == "user") & (after["role"] == "assistant"), after["interpreted_as"]))


def chat_context(docs: DataFrame, questions: DataFrame, vector_lists: DataFrame, chunks: DataFrame, budget_tokens: int = 5000, depth: int = 20, keep: int = 8, index: TextIndex | None = None) -> DataFrame:
    """Sources of each question: words and vectors fused, the best chunks within the budget, tagged in order.

    docs (doc_id, text, company) are ready reports' chunks; vector_lists (query_id, list_idx, rank, doc_id) come
    from the vector side; a question that names companies sees theirs only. ``index`` is the stored index of docs.
    """
    from citeline.operators import retrieval as R

    scoped = R.scope_by_name(questions, docs, "query_id", "question", "company")
    scored = R.bm25_indexed(index, questions) if index else R.bm25(docs.select("doc_id", "text"), questions)
    scored = R.in_scope(scored.join(docs.select("doc_id", "company"), "doc_id"), scoped, "query_id", "company")
    words = R.top_k(scored, ["query_id"], [F.round("score", 9).desc(), F.col("doc_id")], depth).select("query_id", F.lit(0).alias("list_idx"), "rank", "doc_id")
    best = R.fused_top(words.unionByName(vector_lists), "query_id", "doc_id", keep).select("query_id", "rank", F.col("doc_id").alias("chunk_id"))
    return assemble(best.join(chunks, "chunk_id"), budget_tokens)
