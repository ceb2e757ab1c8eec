"""Evaluation: sampling of chunks, hit metrics, summaries, re-verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeline.operators.verify import overlap, quote_in, verification

MIN_CHARS = 400


def sample_chunks(chunks: DataFrame, per_report: int, report: str = "report_id") -> DataFrame:
    """The longest table of each report, first on ties, and a systematic sample of its long texts.

    Every step-th text in order with step = max(1, n div remaining), the first ``remaining`` of them. A report that has no
    more long chunks than are asked for gives them all.
    """
    every = chunks.where(F.length("text") >= MIN_CHARS)
    sizes = every.groupBy(report).agg((F.count(F.lit(1)) <= per_report).alias("_few"))
    sized = every.join(sizes, report)
    few, long = (sized.where(c).select(*chunks.columns) for c in ("_few", "not _few"))
    table = long.where("kind = 'table'").withColumn("_n", F.row_number().over(Window.partitionBy(report).orderBy(F.length("text").desc(), "page_start", "id"))).where("_n = 1").drop("_n")
    has = table.select(report).withColumn("_t", F.lit(1))
    texts = long.where("kind = 'text'").join(has, report, "left").withColumn("_left", F.lit(per_report) - F.coalesce("_t", F.lit(0)))
    w = Window.partitionBy(report)
    numbered = texts.withColumn("_i", F.row_number().over(w.orderBy("page_start", "id")) - 1).withColumn("_all", F.count(F.lit(1)).over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("_all") / F.greatest(F.col("_left"), F.lit(1))))
    taken = numbered.where((F.col("_i") % step == 0) & (F.floor(F.col("_i") / step) < F.col("_left")))
    return table.unionByName(taken.select(*chunks.columns)).unionByName(few)


def retrieval_hits(found: DataFrame, gold: DataFrame, key: str, text: str, quote: str, compatibility: bool = True) -> DataFrame:
    """(key, hit): whether any retrieved text overlaps the expected quote."""
    checked = gold.join(found, key, "left").withColumn("_hit", F.coalesce(overlap(F.col(quote), F.col(text), compatibility), F.lit(False)))
    return checked.groupBy(key).agg(F.bool_or("_hit").alias("hit"))


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Totals, hits and rates of (hit, grounded, status); rates are null without rows."""
    n = F.count(F.lit(1))
    return results.groupBy(*by).agg(
        n.alias("total"), F.count_if("hit").alias("hits"), F.count_if("grounded").alias("grounded"), F.try_divide(F.count_if("hit"), n).alias("hit_rate"),
        F.try_divide(F.count_if("grounded"), n).alias("grounded_rate"), F.count_if(F.col("status") == "not_found").alias("not_found"),
    )


def failures(results: DataFrame) -> DataFrame:
    return results.where("not hit or not grounded")


def reverify(extractions: DataFrame, chunks: DataFrame, compatibility: bool = True) -> DataFrame:
    """Extractions (id, kind, quote, value_text, chunk_id, verified) whose verification changes; those without a chunk are left out."""
    joined = extractions.join(chunks.select(F.col("id").alias("chunk_id"), F.col("text").alias("_t")), "chunk_id")
    again = F.when(F.col("kind") == "fte", verification(F.col("quote"), F.col("value_text"), F.col("_t"), compatibility)["verified"]).otherwise(quote_in(F.col("quote"), F.col("_t"), compatibility))
    return joined.withColumn("now_verified", again).where("now_verified <> verified").drop("_t")


def accepted_gold(entries: DataFrame, chunks: DataFrame, compatibility: bool = True) -> DataFrame:
    """Gold entries (chunk_id, usable, question, expected_quote) that are usable, have both texts, and whose quote stands in the chunk."""
    joined = entries.join(chunks.select(F.col("id").alias("chunk_id"), F.col("text").alias("_t")), "chunk_id")
    given = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return joined.where(F.coalesce("usable", F.lit(False)) & given("question") & given("expected_quote") & quote_in(F.col("expected_quote"), F.col("_t"), compatibility)).drop("_t")


def reverify_counts(extractions: DataFrame, chunks: DataFrame, compatibility: bool = True) -> DataFrame:
    """(kind, checked, gained, lost): how many verifications a new pass looks at and changes, by kind."""
    held = extractions.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("checked"))
    changed = reverify(extractions, chunks, compatibility).groupBy("kind").agg(F.count_if("now_verified").alias("gained"), F.count_if(~F.col("now_verified")).alias("lost"))
    return held.join(changed, "kind", "left").na.fill(0, ["gained", "lost"])


def percent(part: Column, whole: Column) -> Column:
    """A share in percent with one decimal; null where there is no whole."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, 1))
