"""Text functions over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeline.functions import text as T
from citeline.plans.base import LINES, lines, query
from citeline.session import table

#: The mapped characters as DuckDB literals.
_FROM = " || ".join(f"chr({ord(c)})" for c in T.MAPPED)
_TO = "'" + T.BECOMES.replace("'", "''") + "'"
NORM = f"trim(regexp_replace(translate({{x}}, {_FROM}, {_TO}), '[ \\t]+', ' ', 'g'), ' ' || chr(9) || chr(13) || chr(11) || chr(12))"
CANON = "(' ' || trim(regexp_replace(replace(lower({x}), '-', ''), '[^a-z0-9]+', ' ', 'g')) || ' ')"
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TOKENS = f"""(CASE WHEN len(list_filter(regexp_extract_all(lower({{x}}), '[A-Za-z0-9%.]+'), lambda t: t NOT IN ({STOP}) AND length(t) > 1)) > 0
  THEN list_filter(regexp_extract_all(lower({{x}}), '[A-Za-z0-9%.]+'), lambda t: t NOT IN ({STOP}) AND length(t) > 1)
  ELSE regexp_extract_all(lower({{x}}), '[A-Za-z0-9%.]+') END)"""
#: First occurrences of a list, in order.
FIRSTS = "list_filter({l}, lambda v, i: list_position({l}, v) = i)"


@query(f"WITH {LINES} SELECT doc_id, pos, {NORM.format(x='para')} AS norm FROM lines")
def normalize_lines(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", T.normalize_text(F.col("para"), compatibility=False).alias("norm"))


@query(f"SELECT doc_id, {NORM.format(x='text')} AS norm FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents)")
def normalize_compatibility(spark, sf_dir):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(flat).alias("norm"))


@query(f"WITH {LINES} SELECT doc_id, pos, {CANON.format(x='para')} AS canon FROM lines")
def canonical_form(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", T.canonical_form(F.col("para"), compatibility=False).alias("canon"))


_NUMBERS = FIRSTS.format(l="found")


@query(
    f"""WITH n AS (SELECT doc_id, list_filter(regexp_extract_all(text, '{T.REPORTABLE}'), lambda v: NOT regexp_matches(v, '{T.YEAR}')) AS found FROM documents)
SELECT doc_id, array_to_string({_NUMBERS}, '|') AS numbers, CAST(len({_NUMBERS}) AS INTEGER) AS n_numbers FROM n WHERE len(found) > 0"""
)
def number_mentions(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", T.reportable_numbers(F.col("text")).alias("n"))
    return found.where(F.size("n") > 0).select("doc_id", F.array_join("n", "|").alias("numbers"), F.size("n").alias("n_numbers"))


@query(
    f"""WITH {LINES}, m AS (SELECT doc_id, pos, regexp_extract(para, '(?i)([-+])?([0-9][0-9.,\\s]*[0-9]|[0-9])\\s*(thousand|million|billion|mn|bn|k)?\\s*(%)?', ['sign', 'num', 'word', 'pct']) AS g FROM lines WHERE regexp_matches(para, '[0-9]')),
r AS (SELECT doc_id, pos, g, replace(g.num, ' ', '') AS raw FROM m),
p AS (SELECT *, contains(raw, ',') AS c, contains(raw, '.') AS d FROM r),
v AS (SELECT doc_id, pos, g, try_cast(CASE
  WHEN c AND d THEN CASE WHEN length(raw) - strpos(reverse(raw), ',') > length(raw) - strpos(reverse(raw), '.') THEN replace(replace(raw, '.', ''), ',', '.') ELSE replace(raw, ',', '') END
  WHEN c THEN CASE WHEN regexp_matches(raw, ',[0-9]{{1,2}}$') AND NOT regexp_matches(raw, ',[0-9]{{3}}\\b') THEN replace(raw, ',', '.') ELSE replace(raw, ',', '') END
  WHEN d AND regexp_matches(raw, '^[0-9]{{1,3}}(\\.[0-9]{{3}})+$') THEN replace(raw, '.', '')
  ELSE raw END AS DOUBLE) AS x FROM p)
SELECT doc_id, pos, CASE WHEN g.sign = '-' THEN -x ELSE x END * CASE lower(g.word) WHEN 'k' THEN 1e3 WHEN 'thousand' THEN 1e3 WHEN 'mn' THEN 1e6 WHEN 'million' THEN 1e6 WHEN 'bn' THEN 1e9 WHEN 'billion' THEN 1e9 ELSE 1.0 END AS value FROM v"""
)
def parse_number(spark, sf_dir):
    return lines(spark, sf_dir).where(F.col("para").rlike("[0-9]")).select("doc_id", "pos", T.parse_number(F.col("para")).alias("value"))


@query(f"SELECT item_id, array_to_string(list_transform({FIRSTS.format(l='t')}, lambda v: '\"' || v || '\"'), ' OR ') AS match FROM (SELECT item_id, {TOKENS.format(x='text')} AS t FROM benchmark)")
def fts_query_tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.fts_query(F.col("text")).alias("match"))


#: The caption of a stripped paragraph ``s``: all of it, or the end of its last sentence.
CAPTION = "CASE WHEN length({s}) <= 200 THEN {s} ELSE right(coalesce(list_filter(string_split(regexp_replace({s}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')[-1], {s}), 200) END"


@query(f"WITH {LINES} SELECT doc_id, pos, {CAPTION.format(s='s')} AS caption FROM (SELECT doc_id, pos, trim(para) AS s FROM lines)")
def caption(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", T.sentence_tail(F.col("para")).alias("caption"))


@query(
    f"""WITH {LINES}, c AS (SELECT doc_id, min(page) AS a, max(page) AS b, count(*) AS n FROM lines GROUP BY doc_id)
SELECT doc_id, CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END AS label FROM c"""
)
def page_label(spark, sf_dir):
    spans = lines(spark, sf_dir).groupBy("doc_id").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    return spans.select("doc_id", T.page_label(F.col("a"), F.col("b")).alias("label"))


@query(
    f"""WITH {LINES} SELECT doc_id, pos, d.source || ' | Annual Report ' || CAST(2020 + doc_id % 6 AS VARCHAR) || ' | page ' || page || chr(10) || chr(10) || para AS embed_text
FROM lines JOIN documents d USING (doc_id)"""
)
def embed_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    year, page = F.col("doc_id") % 6 + 2020, F.expr("pos div 5 + 1").cast("int")
    each = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "para"))
    return each.select("doc_id", "pos", T.embed_text(F.col("source"), year, page, page, F.col("para")).alias("embed_text"))


@query("SELECT page_id, name, upper(left(token, 1)) || substr(token, 2) AS company, try_cast(nullif(regexp_extract(name, '20[0-9]{2}'), '') AS INTEGER) AS year FROM (SELECT page_id, name, regexp_extract(regexp_replace(name, '\\.[^./]+$', ''), '^[^-_\\s]*') AS token FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) || '-report-' || CAST(1995 + page_id % 40 AS VARCHAR) || '.pdf' AS name FROM pages))")
def filename_guess(spark, sf_dir):
    name = F.concat(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("-report-"), (F.col("page_id") % 40 + 1995).cast("string"), F.lit(".pdf"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name")).select("page_id", "name", T.guess_company(F.col("name")).alias("company"), T.guess_year(F.col("name")).alias("year"))


@query(f"WITH {LINES} SELECT doc_id, pos FROM lines WHERE regexp_matches(para, '(?i)\\b({T.TOPICS}|the|licen[sc]e\\w*)\\b')")
def topic_filter(spark, sf_dir):
    """The topic regex, with two words of the test corpus so that it selects rows there."""
    return lines(spark, sf_dir).where(F.col("para").rlike(rf"(?i)\b({T.TOPICS}|the|licen[sc]e\w*)\b")).select("doc_id", "pos")


_LINES_OF = "list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\\S'))"


@query(f"SELECT doc_id, trim(regexp_replace({NORM.format(x='t')}, '\\s+', ' ', 'g')) AS block FROM (SELECT doc_id, regexp_replace(array_to_string({_LINES_OF}, chr(10)), '([A-Za-z0-9_])-\\n+([A-Za-z0-9_])', '\\1\\2', 'g') AS t FROM documents)")
def block_text(spark, sf_dir):
    """Each document as a block: its lines cut into spans at blanks, and put together again."""
    spans = F.transform(F.split("text", "\n", -1), lambda l: F.regexp_extract_all(l, F.lit(r"\S+|\s+"), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", T.block_text(spans, compatibility=False).alias("block"))


@query(f"SELECT item_id, {NORM.format(x='t')} AS cell FROM (SELECT item_id, replace(replace(text || ' | a' || chr(10) || ' b', chr(10), ' '), '|', '/') AS t FROM benchmark)")
def clean_cells(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.clean_cell(F.concat("text", F.lit(" | a\n b")), compatibility=False).alias("cell"))
