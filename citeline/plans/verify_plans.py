"""Verification of quotes, values and answers built from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeline.functions.text import REPORTABLE, YEAR
from citeline.operators import verify as V
from citeline.plans.base import LINES, lines, query
from citeline.plans.text_plans import CANON, FIRSTS
from citeline.session import table

CITATIONS = "array<struct<source_id:string,quote:string,value_text:string,verified:boolean>>"


def answers(spark, sf_dir):
    """Answers made of the lines with digits: (turn_id, status, answer, caveats, citations)."""
    rows = lines(spark, sf_dir).where(F.col("para").rlike("[0-9]")).select((F.col("doc_id") * 1000 + F.col("pos")).alias("turn_id"), "doc_id", "para")
    t = F.col("turn_id")
    one = F.struct(F.lit("S1").alias("source_id"), F.substring("para", 1, 40).alias("quote"), F.lit("").alias("value_text"), (t % 2 == 0).alias("verified"))
    two = F.struct(F.lit("S2").alias("source_id"), F.right("para", F.lit(60)).alias("quote"), F.regexp_extract("para", "[0-9]+", 0).alias("value_text"), (t % 3 == 0).alias("verified"))
    return rows.select(
        "turn_id", "doc_id", "para", F.when(t % 4 == 0, "not_found").when(t % 4 == 3, "partial").otherwise("answered").alias("status"),
        F.concat("para", F.lit(" See [S1], [S3] and [S1].")).alias("answer"), F.array().cast("array<string>").alias("caveats"),
        F.when(t % 5 == 0, F.array().cast(CITATIONS)).otherwise(F.array(one, two).cast(CITATIONS)).alias("citations"),
    )


ANSWERS = f"""{LINES}, answers AS (SELECT t AS turn_id, doc_id, para, CASE WHEN t % 4 = 0 THEN 'not_found' WHEN t % 4 = 3 THEN 'partial' ELSE 'answered' END AS status,
 para || ' See [S1], [S3] and [S1].' AS answer,
 CASE WHEN t % 5 = 0 THEN [] ELSE [{{'source_id': 'S1', 'quote': substr(para, 1, 40), 'value_text': '', 'verified': t % 2 = 0}}, {{'source_id': 'S2', 'quote': right(para, 60), 'value_text': regexp_extract(para, '[0-9]+'), 'verified': t % 3 = 0}}] END AS citations
 FROM (SELECT doc_id * 1000 + pos AS t, doc_id, para FROM lines WHERE regexp_matches(para, '[0-9]')))"""


@query(f"WITH c AS (SELECT doc_id, {CANON.format(x='text')} AS t FROM documents), b AS (SELECT item_id, {CANON.format(x='text')} AS q FROM benchmark) SELECT item_id, doc_id FROM c, b WHERE contains(t, q) AND trim(q) <> ''")
def verify_quotes(spark, sf_dir):
    """All verbatim benchmark passages in all documents, by hash on their first words."""
    found = V.quotes_in_corpus(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text"), "item_id", "text", "doc_id", "text", compatibility=False)
    return found.select("item_id", "doc_id")


@query(
    f"""WITH {ANSWERS}, c AS (SELECT turn_id, doc_id, unnest(citations) AS c FROM answers), k AS (SELECT turn_id, c.source_id AS source_id, CASE WHEN turn_id % 7 = 0 THEN reverse(c.quote) ELSE c.quote END AS quote, CASE WHEN turn_id % 3 = 1 THEN c.value_text || '9' ELSE c.value_text END AS value_text, text FROM c JOIN documents USING (doc_id))
SELECT turn_id, source_id, trim(quote) <> '' AND contains({CANON.format(x='text')}, {CANON.format(x='quote')}) AND (value_text = '' OR contains(quote, value_text)) AS verified, CASE WHEN value_text <> '' THEN try_cast(value_text AS DOUBLE) END AS value FROM k"""
)
def verify_values(spark, sf_dir):
    """Citations against their sources: quote in source, value in quote; some are spoilt on purpose."""
    cited = answers(spark, sf_dir).select("turn_id", "doc_id", F.explode("citations").alias("c")).select("turn_id", "doc_id", "c.source_id", "c.quote", "c.value_text")
    spoilt = cited.withColumns({
        "quote": F.when(F.col("turn_id") % 7 == 0, F.reverse("quote")).otherwise(F.col("quote")),
        "value_text": F.when(F.col("turn_id") % 3 == 1, F.concat("value_text", F.lit("9"))).otherwise(F.col("value_text")),
    })
    sources = cited.select("turn_id", "source_id", "doc_id").distinct().join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return V.verify_citations(spoilt, sources, compatibility=False).select("turn_id", "source_id", "verified", "value")


_MARKS = "list_transform(regexp_extract_all(answer, '\\[S([0-9]+)\\]', 1), lambda n: 'S' || n)"
_FIRST_MARKS = FIRSTS.format(l=_MARKS)
_SET = "CASE WHEN status = 'not_found' THEN [] ELSE citations END"


def _orphans(c: str) -> str:
    return f"list_filter({_FIRST_MARKS}, lambda m: NOT list_contains(list_transform({c}, lambda x: x.source_id), m))"


_FIGURES = f"list_filter(regexp_extract_all(answer, '{REPORTABLE}'), lambda v: NOT regexp_matches(v, '{YEAR}'))"


def _unbacked(c: str) -> str:
    return f"list_filter({FIRSTS.format(l=_FIGURES)}, lambda n: NOT contains(coalesce(array_to_string(list_transform(list_filter({c}, lambda x: x.verified), lambda x: x.quote), ' '), ''), n))"



@query(f"WITH {ANSWERS} SELECT turn_id, array_to_string({_orphans('citations')}, ',') AS orphans FROM answers")
def orphan_citations(spark, sf_dir):
    return answers(spark, sf_dir).select("turn_id", F.array_join(V.orphans(F.col("answer"), F.col("citations")), ",").alias("orphans"))


@query(f"WITH {ANSWERS} SELECT turn_id, array_to_string({_unbacked('citations')}, '|') AS numbers FROM answers")
def unbacked_numbers(spark, sf_dir):
    return answers(spark, sf_dir).select("turn_id", F.array_join(V.unbacked(F.col("answer"), F.col("citations")), "|").alias("numbers"))


@query(
    f"""WITH {ANSWERS}, a AS (SELECT turn_id, status, answer, {_SET} AS c FROM answers), l AS (SELECT *, status = 'answered' AND len(c) > 0 AND len(list_filter(c, lambda x: x.verified)) = 0 AS low FROM a)
SELECT turn_id, CASE WHEN low THEN 'partial' ELSE status END AS status, CAST(len(c) AS INTEGER) AS n_citations,
 array_to_string(list_concat(list_concat(CASE WHEN low THEN ['{V.UNVERIFIED}'] ELSE [] END, CASE WHEN len({_orphans('c')}) > 0 THEN ['{V.ORPHANED}'] ELSE [] END), CASE WHEN len({_unbacked('c')}) > 0 THEN ['{V.UNBACKED}'] ELSE [] END), '|') AS caveats FROM l"""
)
def answer_status(spark, sf_dir):
    return V.check_answer(answers(spark, sf_dir)).select("turn_id", "status", F.size("citations").alias("n_citations"), F.array_join("caveats", "|").alias("caveats"))


@query(
    f"""WITH {ANSWERS}, e AS (SELECT turn_id, i - 1 AS pos, citations[(i - 1) % len(citations) + 1] AS c FROM answers, range(1, 4) r(i) WHERE len(citations) > 0)
SELECT turn_id, c.source_id AS source_id, c.quote AS quote, CAST(min(pos) AS INTEGER) AS position, bool_and(c.verified) AS verified, count(*) AS n_citations, coalesce(string_agg(nullif(c.value_text, ''), '|' ORDER BY pos), '') AS vals FROM e GROUP BY ALL"""
)
def citation_groups(spark, sf_dir):
    """The citations of a turn, the first of them given twice."""
    some = answers(spark, sf_dir).where(F.size("citations") > 0).select("turn_id", F.posexplode(F.concat("citations", F.slice("citations", 1, 1))).alias("pos", "c"))
    found = V.group_citations(some.select("turn_id", "pos", "c.*"))
    return found.select("turn_id", "source_id", "quote", "position", "verified", "n_citations", F.array_join("values", "|").alias("vals"))


@query(
    f"""WITH {ANSWERS}, n AS (SELECT turn_id, {FIRSTS.format(l='l')} AS ids FROM (SELECT turn_id, list_concat({_MARKS}, list_transform(citations, lambda c: c.source_id)) AS l FROM answers))
SELECT turn_id, ids[i] AS source_id, CAST(i AS INTEGER) AS number FROM n, range(1, len(ids) + 1) r(i)"""
)
def display_numbers(spark, sf_dir):
    return V.display_numbers(answers(spark, sf_dir))


@query(
    f"""WITH {LINES}, v AS (SELECT doc_id, pos, para, v FROM (SELECT doc_id, pos, para, ['th', 'the', 'he ', 'and', right(para, 3)] AS vs FROM lines WHERE length(para) >= 3), unnest(vs) u(v)),
s AS (SELECT doc_id, pos, strpos(para, v) - 1 AS a, strpos(para, v) - 1 + length(v) AS b FROM v WHERE strpos(para, v) > 0),
m AS (SELECT *, max(b) OVER (PARTITION BY doc_id, pos ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s),
g AS (SELECT *, sum(CASE WHEN far IS NULL OR far < a THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pos ORDER BY a, b) AS island FROM m)
SELECT doc_id, pos, CAST(min(a) AS INTEGER) AS start, CAST(max(b) AS INTEGER) AS "end" FROM g GROUP BY doc_id, pos, island"""
)
def highlight_spans(spark, sf_dir):
    some = lines(spark, sf_dir).where("length(para) >= 3")  # shorter ones hold no value
    values = F.array(F.lit("th"), F.lit("the"), F.lit("he "), F.lit("and"), F.right("para", F.lit(3)))
    return V.highlight_spans(some.withColumn("values", values), ["doc_id", "pos"], "para").select("doc_id", "pos", "start", "end")


@query(
    f"""WITH {ANSWERS}, a AS (SELECT turn_id, {_FIRST_MARKS} AS ord, {_MARKS} AS marks, string_split(regexp_replace(answer, '\\[S[0-9]+\\]', chr(1), 'g'), chr(1)) AS texts FROM answers),
p AS (SELECT turn_id, ord, i, texts[i] AS text, CASE WHEN i <= len(marks) THEN marks[i] END AS mark FROM a, range(1, len(texts) + 1) r(i))
SELECT turn_id, CAST((i - 1) * 2 AS INTEGER) AS seq, text, CAST(NULL AS INTEGER) AS number FROM p WHERE text <> ''
UNION ALL SELECT turn_id, CAST((i - 1) * 2 + 1 AS INTEGER), '', CAST(list_position(ord, mark) AS INTEGER) FROM p WHERE mark IS NOT NULL"""
)
def answer_segments(spark, sf_dir):
    return V.segments(answers(spark, sf_dir))


@query(
    f"""WITH {LINES}, q AS (SELECT doc_id, pos, para, CASE WHEN pos % 3 = 0 THEN substr(para, 3, 9) ELSE 'zq' || substr(para, 1, 4) END AS q FROM lines WHERE length(para) > 12)
SELECT doc_id, pos, CASE WHEN strpos(para, q) > 0 THEN substr(para, 1, strpos(para, q) - 1) END AS before, CASE WHEN strpos(para, q) > 0 THEN substr(para, strpos(para, q) + length(q)) END AS after FROM q"""
)
def quote_split(spark, sf_dir):
    quote = F.when(F.col("pos") % 3 == 0, F.substring("para", 3, 9)).otherwise(F.concat(F.lit("zq"), F.substring("para", 1, 4)))
    cut = lines(spark, sf_dir).where("length(para) > 12").select("doc_id", "pos", V.split_around(F.col("para"), quote).alias("s"))
    return cut.select("doc_id", "pos", "s.before", "s.after")
