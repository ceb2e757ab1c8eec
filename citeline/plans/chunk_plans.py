"""Chunking of documents and relational tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from citeline.operators import chunking as C
from citeline.plans.base import LINES, lines, query
from citeline.plans.text_plans import CAPTION
from citeline.session import table

#: Words whose buckets a task of the offline embedding keeps.
KNOWN_WORDS = 500_000
#: Where a window of a long paragraph ends in DuckDB, from its start ``st``.
_END = """CASE WHEN st + 2800 >= length(para) THEN length(para)
  WHEN strpos(substr(para, st + 2801), ' ') BETWEEN 1 AND 50 THEN st + 2800 + strpos(substr(para, st + 2801), ' ') - 1 ELSE st + 2800 END"""
_PIECES = f"""lp AS (SELECT *, {_END} AS e FROM (SELECT doc_id, pos, page, para, 0 AS st, 0 AS piece FROM lines WHERE length(para) > 2800)
  UNION ALL SELECT *, {_END} AS e FROM (SELECT doc_id, pos, page, para, greatest(e - 336, st + 1) AS st, piece + 1 AS piece FROM lp WHERE e < length(para)))"""


@query(f"WITH RECURSIVE {LINES}, {_PIECES} SELECT doc_id, pos, piece, trim(substr(para, st + 1, e - st)) AS text FROM lp")
def long_paragraph_split(spark, sf_dir):
    long = lines(spark, sf_dir).where(f"length(para) > {C.HARD_MAX}")
    return long.select("doc_id", "pos", F.posexplode(C.split_long(F.col("para"))).alias("piece", "text"))


_NEW = "length(l.para) > 2800 OR p.long OR p.len + 2 + length(l.para) > 1800"
PACKED = f"""{LINES}, pk AS (SELECT doc_id, pos, page, para, 0 AS chunk, length(para) AS len, length(para) > 2800 AS long FROM lines WHERE pos = 0
  UNION ALL SELECT l.doc_id, l.pos, l.page, l.para, CASE WHEN {_NEW} THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN {_NEW} THEN length(l.para) ELSE p.len + 2 + length(l.para) END, length(l.para) > 2800
  FROM pk p JOIN lines l ON l.doc_id = p.doc_id AND l.pos = p.pos + 1),
{_PIECES},
ch AS (SELECT doc_id, chunk, 0 AS piece, min(page) AS page_start, max(page) AS page_end, string_agg(para, chr(10) || chr(10) ORDER BY pos) AS text FROM pk WHERE NOT long GROUP BY doc_id, chunk
  UNION ALL SELECT doc_id, chunk, piece, lp.page, lp.page, trim(substr(lp.para, st + 1, e - st)) FROM lp JOIN pk USING (doc_id, pos) WHERE pk.long),
chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk, piece) AS INTEGER) AS n, page_start, page_end, text FROM ch)"""


def packed(spark, sf_dir):
    """Documents packed in one row each: no shuffle."""
    paragraphs = F.transform(F.split("text", "\n", -1), lambda t, i: F.struct((F.floor(i / 5) + 1).cast("int").alias("page"), t.alias("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.pack(paragraphs)).alias("n", "c")).select("doc_id", (F.col("n") + 1).alias("n"), "c.*")


@query(f"WITH RECURSIVE {PACKED} SELECT doc_id, n, page_start, page_end, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM chunks")
def paragraph_pack(spark, sf_dir):
    return packed(spark, sf_dir).select("doc_id", "n", "page_start", "page_end", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def brands(spark, sf_dir):
    """``part`` as one table per brand: (brand, header, rows), rows by key."""
    cells = F.array(F.col("p_partkey").cast("string"), "p_name", "p_type", F.col("p_size").cast("string"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", cells.alias("c")))), lambda x: x["c"])
    header = F.array(*map(F.lit, ("key", "name", "type", "size")))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(rows.alias("rows")).withColumn("header", header)


_ROW = "'| ' || p_partkey || ' | ' || p_name || ' | ' || p_type || ' | ' || p_size || ' |'"
_HEAD = "'| key | name | type | size |' || chr(10) || '| --- | --- | --- | --- |'"


@query(f"SELECT p_brand AS brand, 'Parts of ' || p_brand || chr(10) || {_HEAD} || chr(10) || string_agg({_ROW}, chr(10) ORDER BY p_partkey) AS markdown FROM part GROUP BY p_brand")
def table_markdown(spark, sf_dir):
    return brands(spark, sf_dir).select("brand", C.render_table(F.col("header"), F.col("rows"), F.concat(F.lit("Parts of "), "brand")).alias("markdown"))


@query(
    f"""WITH RECURSIVE r AS (SELECT p_brand AS brand, {_ROW} AS line, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
h AS (SELECT {_HEAD} AS head), w AS (SELECT brand, length('Parts of ' || brand) + 1 + length(head) + sum(1 + length(line)) AS whole FROM r, h GROUP BY brand, head),
f AS (SELECT r.brand, i, line, 0 AS part, length('Parts of ' || r.brand) + 1 + length(head) + 1 + length(line) AS len, whole FROM r, h, w WHERE i = 1 AND w.brand = r.brand
 UNION ALL SELECT r.brand, r.i, r.line, CASE WHEN whole > 2800 AND len + 1 + length(r.line) > 2800 THEN part + 1 ELSE part END, CASE WHEN whole > 2800 AND len + 1 + length(r.line) > 2800 THEN length(head) + 1 + length(r.line) ELSE len + 1 + length(r.line) END, whole FROM f JOIN r ON r.brand = f.brand AND r.i = f.i + 1, h)
SELECT brand, CAST(part AS INTEGER) AS part, md5(CASE WHEN part = 0 THEN 'Parts of ' || brand || chr(10) ELSE '' END || head || chr(10) || string_agg(line, chr(10) ORDER BY i)) AS digest, count(*) AS n_rows FROM f, h GROUP BY brand, part, head"""
)
def table_split(spark, sf_dir):
    parts = brands(spark, sf_dir).select("brand", F.posexplode(C.split_table(F.col("header"), F.col("rows"), F.concat(F.lit("Parts of "), "brand"))).alias("part", "text"))
    body = F.size(F.split("text", "\n")) - 2 - (F.col("part") == 0).cast("int")
    return parts.select("brand", "part", F.md5(F.col("text").cast("binary")).alias("digest"), body.cast("long").alias("n_rows"))


def items(spark, sf_dir):
    """Lines as items: every ninth is a table of its words, regions change every four lines."""
    rows = lines(spark, sf_dir).where("para <> ''")
    is_table = (F.col("pos") % 9 == 8) & (F.length("para") < 2000)
    words = F.split("para", " ")
    return rows.select(
        "doc_id", F.col("pos").alias("seq"), F.when(is_table, "table").otherwise("text").alias("kind"), "page", F.expr("pos div 4 % 3").cast("int").alias("region"), F.col("para").alias("text"),
        F.when(is_table, F.array(F.lit("word"), F.lit("size"))).alias("header"), F.when(is_table, F.transform(words, lambda w: F.array(w, F.length(w).cast("string")))).alias("rows"),
    )


_ITEMS = f"""{LINES}, it AS (SELECT doc_id, pos AS seq, CASE WHEN pos % 9 = 8 AND length(para) < 2000 THEN 'table' ELSE 'text' END AS kind, page, pos // 4 % 3 AS region, para AS text FROM lines WHERE para <> ''),
lg AS (SELECT *, lag(kind) OVER w AS k, lag(region) OVER w AS r, lag(text) OVER w AS t FROM it WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
rn AS (SELECT *, sum(CASE WHEN k IS NULL OR kind = 'table' OR k = 'table' OR r <> region THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM lg)"""


@query(f"WITH {_ITEMS} SELECT doc_id, seq, kind, CAST(run AS BIGINT) AS run, CASE WHEN kind = 'table' AND k = 'text' THEN {CAPTION.format(s='trim(t)')} END AS caption FROM rn")
def item_runs(spark, sf_dir):
    return C.runs(items(spark, sf_dir)).select("doc_id", "seq", "kind", F.col("run").cast("long").alias("run"), "caption")


@query()
def chunk_documents(spark, sf_dir):
    """Text and table chunks in document order; a fold over folds, held against a plain loop in the tests."""
    return C.chunk_documents(items(spark, sf_dir)).select("doc_id", "n", "page_start", "page_end", "kind", F.md5(F.col("text").cast("binary")).alias("digest"))


class Buckets(dict):
    """The bucket of each word, from its MD5, found once for a word; the empty one has the last, which is no dimension."""

    def __init__(self, dim: int):
        self.dim = dim
        self[""] = dim

    def __missing__(self, word: str) -> int:
        found = int.from_bytes(hashlib.md5(word.encode()).digest()[:4]) % self.dim
        if len(self) < KNOWN_WORDS:
            self[word] = found
        return found


def hashed_vector(text, dim: int = 32):
    """The offline embedding: words counted in buckets of their MD5. It is an Arrow function, like any model's hook."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bucket = Buckets(dim).__getitem__
        for texts in batches:
            yield pd.Series([None if t is None else np.bincount(list(map(bucket, t.split(" "))), minlength=dim + 1)[:dim].astype(float) for t in texts])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(F.lower(text))


_VECTOR = """list_transform(range(0, 32), lambda b: CAST(len(list_filter(list_transform(list_filter(string_split(lower(text), ' '), lambda w: w <> ''), lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 32), lambda x: x = b)) AS DOUBLE))"""
_KEYS = "al.doc_id = f.doc_id AND al.run = f.run AND al.stretch = f.stretch"


@query(
    f"""WITH RECURSIVE {_ITEMS}, {_PIECES},
tx AS (SELECT doc_id, run, seq, page, text, length(text) > 2800 AS long, sum(CASE WHEN length(text) > 2800 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY seq) AS stretch FROM rn WHERE kind = 'text'),
vc AS MATERIALIZED (SELECT *, {_VECTOR} AS v FROM tx WHERE NOT long),
lv AS (SELECT *, row_number() OVER w AS i, lag(v) OVER w AS b FROM vc WINDOW w AS (PARTITION BY doc_id, run, stretch ORDER BY seq)),
al AS MATERIALIZED (SELECT * EXCLUDE (v, b), CASE WHEN b IS NOT NULL THEN CASE WHEN list_dot_product(b, b) * list_dot_product(v, v) > 0 THEN list_dot_product(b, v) / (sqrt(list_dot_product(b, b)) * sqrt(list_dot_product(v, v))) ELSE 0 END END AS alike FROM lv),
lm AS (SELECT doc_id, run, stretch, quantile_cont(alike, 0.25) AS least FROM al GROUP BY ALL),
f AS (SELECT doc_id, run, stretch, i, page, text, 0 AS g, length(text) AS len FROM al WHERE i = 1
  UNION ALL SELECT al.doc_id, al.run, al.stretch, al.i, al.page, al.text, CASE WHEN alike < least OR len + 2 + length(al.text) > 2800 THEN g + 1 ELSE g END,
   CASE WHEN alike < least OR len + 2 + length(al.text) > 2800 THEN length(al.text) ELSE len + 2 + length(al.text) END FROM f JOIN al ON {_KEYS} AND al.i = f.i + 1 JOIN lm ON lm.doc_id = f.doc_id AND lm.run = f.run AND lm.stretch = f.stretch),
ch AS (SELECT doc_id, run, stretch, 1 AS after, g AS n, min(page) AS page_start, max(page) AS page_end, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text FROM f GROUP BY doc_id, run, stretch, g
  UNION ALL SELECT tx.doc_id, run, stretch, 0, lp.piece, tx.page, tx.page, trim(substr(lp.para, st + 1, e - st)) FROM tx JOIN lp ON lp.doc_id = tx.doc_id AND lp.pos = tx.seq WHERE tx.long)
SELECT doc_id, CAST(run AS BIGINT) AS run, CAST(row_number() OVER (PARTITION BY doc_id, run ORDER BY stretch, after, n) - 1 AS INTEGER) AS i, page_start, page_end, md5(text) AS digest FROM ch"""
)
def semantic_chunks(spark, sf_dir):
    found = C.semantic_chunks(items(spark, sf_dir), hashed_vector)
    return found.select("doc_id", F.col("run").cast("long").alias("run"), "i", "page_start", "page_end", F.md5(F.col("text").cast("binary")).alias("digest"))
