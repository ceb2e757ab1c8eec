"""From parsed page blocks to reading order: boilerplate, overlaps, columns, short pages.

blocks(doc_id, page, block_no, kind text|table|image, x0, y0, x1, y1, text, header, rows)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMN_GAP, MIN_PAGE_CHARS, MIN_REPEATS, REPEAT_SHARE, MAX_OVERLAP = 40.0, 50, 10, 0.5, 0.5
PAGE = ["doc_id", "page"]


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def overlap_fraction(a: str, b: str) -> Column:
    """The share of rectangle a that lies in b; 0 for an empty a."""
    c = lambda side, n: F.col(f"{side}.{n}")
    both = area(F.greatest(c(a, "x0"), c(b, "x0")), F.greatest(c(a, "y0"), c(b, "y0")), F.least(c(a, "x1"), c(b, "x1")), F.least(c(a, "y1"), c(b, "y1")))
    own = area(c(a, "x0"), c(a, "y0"), c(a, "x1"), c(a, "y1"))
    return F.when(own > 0, both / own).otherwise(0.0)


def boilerplate(blocks: DataFrame, pages: DataFrame, minimum: int = MIN_REPEATS) -> DataFrame:
    """(doc_id, text) of texts on at least max(minimum, half) of a document's pages; pages(doc_id, page_count)."""
    seen = blocks.where("kind = 'text'").select("doc_id", "page", "text").distinct().groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(minimum), F.floor(F.col("page_count") * REPEAT_SHARE))).select("doc_id", "text")


def outside_tables(blocks: DataFrame) -> DataFrame:
    """Blocks without the text blocks that a table of the page covers by more than half."""
    tables = blocks.where("kind = 'table'").select(*PAGE, "x0", "y0", "x1", "y1")
    covered = (F.col("a.doc_id") == F.col("t.doc_id")) & (F.col("a.page") == F.col("t.page")) & (F.col("a.kind") == "text") & (overlap_fraction("a", "t") > MAX_OVERLAP)
    return blocks.alias("a").join(tables.alias("t"), covered, "left_anti")


def real_tables(blocks: DataFrame) -> DataFrame:
    """Blocks whose tables have no empty rows; a table with nothing in header and body goes."""
    filled = lambda cells: F.exists(cells, lambda c: c != "")
    kept = blocks.withColumn("rows", F.when(F.col("kind") == "table", F.filter("rows", filled)).otherwise(F.col("rows")))
    return kept.where((F.col("kind") != "table") | (F.size("rows") > 0) | F.coalesce(filled("header"), F.lit(False)))


def regions(blocks: DataFrame) -> DataFrame:
    """Blocks with ``region``: left edges over COLUMN_GAP apart start a new column of the page."""
    w = Window.partitionBy(*PAGE).orderBy("x0")
    gap = F.coalesce((F.col("x0") - F.lag("x0").over(w) > COLUMN_GAP).cast("int"), F.lit(0))
    whole = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("_gap", gap).withColumn("region", F.sum("_gap").over(whole).cast("int")).drop("_gap")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks with ``seq``: by page, column, top and left edge; tables come first on full ties."""
    w = Window.partitionBy("doc_id").orderBy("page", "region", "y0", "x0", F.col("kind") == "text", "block_no")
    return blocks.withColumn("seq", F.row_number().over(w))


def page_chars(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, chars): text lengths, and body cells of tables without their header."""
    cells = F.aggregate(F.flatten("rows"), F.lit(0), lambda a, c: a + F.length(c))
    size = F.when(F.col("kind") == "text", F.length("text")).when(F.col("kind") == "table", F.coalesce(cells, F.lit(0))).otherwise(0)
    return blocks.groupBy(*PAGE).agg(F.sum(size).alias("chars"))


def skipped_pages(blocks: DataFrame, pages: DataFrame, minimum: int = MIN_PAGE_CHARS) -> DataFrame:
    """(doc_id, page) of pages with too little text, pages without blocks among them."""
    spine = pages.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("page"))
    return spine.join(page_chars(blocks).where(F.col("chars") >= minimum), PAGE, "left_anti")


def prepare(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """All steps in order: boilerplate, overlaps, empty tables, short pages, columns, reading order."""
    text = blocks.join(boilerplate(blocks, pages).withColumn("kind", F.lit("text")), ["doc_id", "text", "kind"], "left_anti").select(*blocks.columns)
    kept = real_tables(outside_tables(text))
    return reading_order(regions(kept.join(skipped_pages(kept, pages), PAGE, "left_anti").select(*kept.columns)))
