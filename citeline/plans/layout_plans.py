"""Layout operators over blocks made of the documents' lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeline.operators import layout as L
from citeline.plans.base import LINES, lines, query


def blocks(spark, sf_dir):
    """Lines as blocks in one of five columns; every seventh is a table whose cells are its words."""
    rows = lines(spark, sf_dir)
    table = F.col("pos") % 7 == 3
    x0 = (F.col("pos") * 37 % 5 * 60 + F.col("doc_id") % 7 + F.col("pos") % 2 * 45).cast("double")
    y0 = (F.col("pos") % 5 * 20).cast("double")
    cells = F.array(F.split("para", " "), F.array(F.lit(""), F.lit("")))
    return rows.select(
        "doc_id", "page", F.col("pos").alias("block_no"), F.when(table, "table").otherwise("text").alias("kind"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 100).alias("x1"), (y0 + F.when(table, 60).otherwise(15)).alias("y1"), F.col("para").alias("text"),
        F.when(table, F.array(F.lit("a"), F.lit("b"))).alias("header"), F.when(table, cells).alias("rows"),
    )


def pages(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("doc_id").agg((F.max("page") + 1).alias("page_count"))


BLOCKS = f"""{LINES}, b AS (SELECT *, y0 + CASE WHEN kind = 'table' THEN 60 ELSE 15 END AS y1, x0 + 100 AS x1 FROM (SELECT doc_id, page, pos AS block_no, CASE WHEN pos % 7 = 3 THEN 'table' ELSE 'text' END AS kind,
 CAST(pos * 37 % 5 * 60 + doc_id % 7 + pos % 2 * 45 AS DOUBLE) AS x0, CAST(pos % 5 * 20 AS DOUBLE) AS y0, para AS text FROM lines)),
pg AS (SELECT doc_id, max(page) + 1 AS page_count FROM b GROUP BY doc_id)"""
_INSIDE = """greatest(0, least(a.x1, t.x1) - greatest(a.x0, t.x0)) * greatest(0, least(a.y1, t.y1) - greatest(a.y0, t.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)) > 0.5"""


@query(f"WITH {BLOCKS}, s AS (SELECT doc_id, text, count(DISTINCT page) AS n FROM b WHERE kind = 'text' GROUP BY ALL) SELECT doc_id, text FROM s JOIN pg USING (doc_id) WHERE n >= greatest(2, floor(page_count * 0.5))")
def boilerplate_lines(spark, sf_dir):
    """With a minimum of two pages, as these documents are short; the library's default is ten."""
    return L.boilerplate(blocks(spark, sf_dir), pages(spark, sf_dir), minimum=2)


_SIZE = "CAST(length(para) // 500 AS VARCHAR)"


@query(f"WITH {LINES}, s AS (SELECT doc_id, {_SIZE} AS text, count(DISTINCT pos) AS n FROM lines GROUP BY ALL), p AS (SELECT doc_id, count(*) AS c FROM lines GROUP BY doc_id) SELECT doc_id, text FROM s JOIN p USING (doc_id) WHERE n >= greatest(10, floor(c * 0.5))")
def boilerplate_default(spark, sf_dir):
    """The library's own minimum of ten pages, on documents of a page a line that bear only the line's size class."""
    rows = lines(spark, sf_dir)
    marks = rows.select("doc_id", (F.col("pos") + 1).alias("page"), F.lit("text").alias("kind"), F.expr("cast(length(para) div 500 as string)").alias("text"))
    return L.boilerplate(marks, rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count")))


@query(f"WITH {BLOCKS} SELECT doc_id, block_no FROM b a WHERE NOT EXISTS (SELECT 1 FROM b t WHERE t.kind = 'table' AND a.kind = 'text' AND a.doc_id = t.doc_id AND a.page = t.page AND {_INSIDE})")
def table_overlap_filter(spark, sf_dir):
    return L.outside_tables(blocks(spark, sf_dir)).select("doc_id", "block_no")


_REGIONS = """g AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id, page ORDER BY x0) > 40 THEN 1 ELSE 0 END AS gap FROM b),
r AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY doc_id, page ORDER BY x0 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS region FROM g)"""


@query(f"WITH {BLOCKS}, {_REGIONS} SELECT doc_id, block_no, region FROM r")
def column_regions(spark, sf_dir):
    return L.regions(blocks(spark, sf_dir)).select("doc_id", "block_no", "region")


@query(f"WITH {BLOCKS}, {_REGIONS} SELECT doc_id, block_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, region, y0, x0, kind = 'text', block_no) AS INTEGER) AS seq FROM r")
def reading_order(spark, sf_dir):
    return L.reading_order(L.regions(blocks(spark, sf_dir))).select("doc_id", "block_no", "seq")


_CELLS = "length(replace(text, ' ', ''))"
_CHARS = f"pc AS (SELECT doc_id, page, sum(CASE WHEN kind = 'text' THEN length(text) ELSE {_CELLS} END) AS chars FROM b GROUP BY ALL)"


@query(f"WITH {BLOCKS}, {_CHARS} SELECT doc_id, page, CAST(chars AS BIGINT) AS chars FROM pc")
def page_chars(spark, sf_dir):
    return L.page_chars(blocks(spark, sf_dir))


@query(f"WITH {BLOCKS}, {_CHARS}, s AS (SELECT doc_id, CAST(i AS INTEGER) AS page FROM pg, range(1, page_count + 1) r(i)) SELECT doc_id, page FROM s WHERE NOT EXISTS (SELECT 1 FROM pc WHERE pc.doc_id = s.doc_id AND pc.page = s.page AND chars >= 50)")
def skipped_pages(spark, sf_dir):
    return L.skipped_pages(blocks(spark, sf_dir), pages(spark, sf_dir))


@query(f"WITH {BLOCKS} SELECT doc_id, block_no, CAST(len(list_filter([string_split(text, ' '), ['', '']], lambda r: len(list_filter(r, lambda c: c <> '')) > 0)) AS INTEGER) AS n_rows FROM b WHERE kind = 'table'")
def real_tables(spark, sf_dir):
    return L.real_tables(blocks(spark, sf_dir)).where("kind = 'table'").select("doc_id", "block_no", F.size("rows").alias("n_rows"))


@query(
    f"""WITH {BLOCKS}, bp AS (SELECT doc_id, text FROM (SELECT doc_id, text, count(DISTINCT page) AS n FROM b WHERE kind = 'text' GROUP BY ALL) JOIN pg USING (doc_id) WHERE n >= greatest(10, floor(page_count * 0.5))),
k AS (SELECT * FROM b a WHERE NOT (kind = 'text' AND EXISTS (SELECT 1 FROM bp WHERE bp.doc_id = a.doc_id AND bp.text = a.text)) AND NOT EXISTS (SELECT 1 FROM b t WHERE t.kind = 'table' AND a.kind = 'text' AND a.doc_id = t.doc_id AND a.page = t.page AND {_INSIDE})),
kc AS (SELECT doc_id, page FROM k GROUP BY ALL HAVING sum(CASE WHEN kind = 'text' THEN length(text) ELSE {_CELLS} END) >= 50),
kb AS (SELECT k.* FROM k JOIN kc USING (doc_id, page)), {_REGIONS.replace("FROM b)", "FROM kb)")}
SELECT doc_id, block_no, region, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, region, y0, x0, kind = 'text', block_no) AS INTEGER) AS seq FROM r"""
)
def parsed_documents(spark, sf_dir):
    return L.prepare(blocks(spark, sf_dir), pages(spark, sf_dir)).select("doc_id", "block_no", "region", "seq")
