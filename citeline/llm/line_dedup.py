"""Line de-duplication: frequent lines stay in one document only.

Texts are exploded into lines, a line's key (stripped, small A to Z) is hashed, documents are counted per hash,
and lines over the threshold are dropped from all documents but one; what is left is put together by position.
All of it is DataFrame functions. Only (hash, document) pairs of lines that are long enough are shuffled, never texts of lines;
a hash that very many lines share is counted per task first and meets its lines by broadcast, as all do that are few.

Defined cases: a null or empty text is one empty line; the key of a document is ``key`` and a digest of its text, so repeated
rows are judged alike and count once; rows of one ``key`` are one document when documents are counted, and
those without a key are one more, smaller than all others; a very long text is split whole and put together in linear time; an
empty table gives no rows; other columns stay as they are, and added ones are put last under the names below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.llm.common import cut, numbered, spread_join

MIN_CHARS, MIN_DOCS = 40, 5
#: Frequent lines, of 32 bytes each, that are broadcast; more meet their places in a shuffle.
BROADCAST_LINES = 200_000
#: The white space that is stripped from a line's ends, and the letters made small.
BLANKS, CAPITALS = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_key(line: Column) -> Column:
    """Small A to Z; lines of ASCII alone, told by their length in bytes, take the built-in's fast way."""
    text = bare(line)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def digest(text: Column) -> Column:
    """128 bits; with one of 64 bits some of 10^12 different lines would meet."""
    return F.unhex(F.md5(text))


def places(docs: DataFrame, doc: str, text: str, min_chars: int) -> DataFrame:
    """(doc, name, pos, h) of the lines that are long enough; ``name`` is a digest of the text."""
    # The digest of a text is bound before its lines are rows, else it is taken for each of them.
    named = docs.select(F.col(doc).alias("doc"), digest(F.coalesce(F.col(text), F.lit(""))).alias("name"), split_lines(F.col(text)).alias("lines"))
    each = named.select("doc", "name", F.posexplode_outer("lines").alias("pos", "line"))
    # The length is that of the stripped line: a filter on the key would compute the key twice.
    return each.where(F.length(bare(F.col("line"))) >= min_chars).select("doc", "name", "pos", digest(line_key(F.col("line"))).alias("h"))


def frequent(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h, last, __n): lines of ``min_docs`` documents or more, the largest document, and how many rows hold them."""
    once = lines.groupBy("h", "doc").agg(F.count(F.lit(1)).alias("r"))
    return once.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last"), F.sum("r").alias("__n")).where(F.col("n") >= min_docs).drop("n")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows and columns with ``kept_text``, ``n_lines`` and ``n_dropped``; see the module for odd cases."""
    base, names = numbered(docs)
    doc, body = names[key], names[text]
    lines = places(base, doc, body, min_chars)
    common = cut(frequent(lines, min_docs))
    few = common.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    met = lines.join(F.broadcast(common), "h") if few else spread_join(lines, common, "h")
    gone = met.where(~F.col("doc").eqNullSafe(F.col("last"))).groupBy("doc", "name").agg(F.collect_set("pos").alias("gone"))
    whole = base.withColumn("name", digest(F.coalesce(F.col(body), F.lit(""))))
    both = whole.join(gone, F.col(doc).eqNullSafe(F.col("doc")) & (whole["name"] == gone["name"]), "left")
    none = F.array().cast("array<int>")
    # Positions that stay, by a hash set: linear in the lines of a text, however many of them go.
    parts = F.transform(F.array(F.struct(split_lines(F.col(body)).alias("l"), F.coalesce("gone", none).alias("g"))), lambda x: F.struct(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["l"]) - 1), x["g"]), lambda i: F.get(x["l"], i)), "\n").alias("kept_text"),
        F.size(x["l"]).cast("long").alias("n_lines"), F.size(x["g"]).cast("long").alias("n_dropped"),
    ))[0]
    made = both.select(*names.values(), parts.alias("made"))
    added = ["kept_text", "n_lines", "n_dropped"]
    return made.select(*(F.col(c).alias(n) for n, c in names.items() if n not in added), *(F.col(f"made.{c}").alias(c) for c in added))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    found = dedup_lines(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


#: The contract in DuckDB.
SQL = """WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, r, i, l[i] AS line, translate(trim(l[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM d, range(1, len(l) + 1) s(i)),
f AS (SELECT k, max(doc_id) AS last FROM e WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 5),
g AS (SELECT e.*, f.k IS NOT NULL AND e.doc_id IS DISTINCT FROM f.last AS gone FROM e LEFT JOIN f ON e.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY r, doc_id"""
