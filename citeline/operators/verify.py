"""Verbatim verification of quotes, values and whole answers, and citation display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeline.functions.text import canonical_form, normalize_text, parse_number, reportable_numbers
from citeline.operators.retrieval import small

#: Quotes whose first words are one literal set in the plan; more are joined.
LITERAL_HEADS = 20_000
#: The caveats that the answer check adds.
UNVERIFIED = "Quotes could not be matched exactly to the source text"
ORPHANED = "Some inline citations could not be matched to evidence"
UNBACKED = "Some figures in the answer are not confirmed by a verified citation"


def quote_in(quote: Column, source: Column, compatibility: bool = True) -> Column:
    """Whether a quote is in a source in canonical form; false for null and blank quotes."""
    found = F.contains(canonical_form(source, compatibility), canonical_form(quote, compatibility))
    return F.coalesce(F.when(F.trim(quote) != "", found), F.lit(False))


def value_in(value: Column, quote: Column, compatibility: bool = True) -> Column:
    """Whether a printed value is in a quote, normalised, by case; not bounded by words."""
    found = F.contains(normalize_text(quote, compatibility), normalize_text(value, compatibility))
    return F.coalesce(F.when((value != "") & (quote != ""), found), F.lit(False))


def verification(quote: Column, value: Column, source: Column, compatibility: bool = True) -> Column:
    """struct(verified, value): the quote is in the source and the value, if any, in the quote."""
    given = F.coalesce(value, F.lit("")) != ""
    good = quote_in(quote, source, compatibility) & (~given | value_in(value, quote, compatibility))
    return F.struct(good.alias("verified"), F.when(given, parse_number(value)).alias("value"))


def heads(text: Column, k: int, firsts: list[str] | None = None) -> Column:
    """Hashes of all runs of k words of a canonical form; ``firsts`` leaves the runs that begin with one of these words.

    The words are the variable of a lambda, so that a text is split once.
    """

    def runs(w: Column) -> Column:
        at = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
        some = at if firsts is None else F.filter(at, lambda i: F.get(w, i).isin(firsts))
        return F.array_distinct(F.transform(some, lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(w, i + j) for j in range(k))))))

    return F.transform(F.array(F.split(F.trim(text), " ")), runs)[0]


def tagged(hashes: Column, k: int) -> Column:
    return F.transform(hashes, lambda h: F.struct(F.lit(k).alias("k"), h.alias("h")))


def quotes_in_corpus(quotes: DataFrame, docs: DataFrame, quote_id: str, quote: str, key: str, text: str, k: int = 3, compatibility: bool = True) -> DataFrame:
    """(quote_id, key) of all verbatim quotes in all texts.

    A text can hold a quote only if it holds the quote's first k words, so pairs are formed by hash on
    those and then verified; quotes of fewer words meet on their own number of words.
    """
    canon = quotes.select(quote_id, canonical_form(F.col(quote), compatibility).alias("q")).where(F.trim("q") != "")
    canon = canon.withColumn("k", F.least(F.lit(k), F.size(F.split(F.trim("q"), " "))))
    first = canon.select(quote_id, "q", "k", F.xxhash64(F.array_join(F.slice(F.split(F.trim("q"), " "), 1, k), " ")).alias("h"))
    # Never null, else a filter on that would find the canonical form once more.
    texts = docs.select(key, canonical_form(F.coalesce(F.col(text), F.lit("")), compatibility).alias("t"))
    sizes = sorted(r["k"] for r in first.select("k").distinct().collect()) or [k]  # k values at most
    asked = first.select("k", "h", F.get(F.split(F.trim("q"), " "), 0).alias("w")).limit(LITERAL_HEADS + 1).collect()  # a row for each quote, which bounds the broadcast too
    if len(asked) <= LITERAL_HEADS:
        # Few heads are one literal set: a text's other heads are dropped before rows are made of them, and it is verified in place.
        wanted = {i: sorted({r["h"] for r in asked if r["k"] == i}) for i in sizes}
        firsts = {i: sorted({r["w"] for r in asked if r["k"] == i}) for i in sizes}
        hit = lambda i: F.filter(heads(F.col("t"), i, firsts[i]), lambda h: h.isin(wanted[i]))
        # An outer explosion and no filter: one on the array would be pushed below and repeat the canonical form many times.
        met = texts.select(key, "t", F.explode_outer(F.concat(*(tagged(hit(i), i) for i in sizes))).alias("x"))
        pairs = met.join(F.broadcast(first.select(quote_id, "q", "k", "h")), (F.col("x.k") == F.col("k")) & (F.col("x.h") == F.col("h")))
        return pairs.where(F.contains("t", F.col("q"))).select(quote_id, key).distinct()
    each = texts.select(key, F.explode(F.array(*(F.struct(F.lit(i).alias("k"), heads(F.col("t"), i).alias("hs")) for i in sizes))).alias("x"))
    met = each.select(key, "x.k", F.explode("x.hs").alias("h")).join(small(first.select(quote_id, "k", "h")), ["k", "h"]).select(quote_id, key).distinct()
    return met.join(canon.select(quote_id, "q"), quote_id).join(texts, key).where(F.contains("t", F.col("q"))).select(quote_id, key)


def markers(answer: Column) -> Column:
    """Source ids of inline markers, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[S(\d+)\]"), F.lit(1)), lambda n: F.concat(F.lit("S"), n)))


def orphans(answer: Column, citations: Column) -> Column:
    """Inline markers without a citation entry."""
    return F.array_except(markers(answer), F.transform(citations, lambda c: c["source_id"]))


def unbacked(answer: Column, citations: Column) -> Column:
    """Reportable numbers of an answer that no verified quote contains."""
    quotes = F.array_join(F.transform(F.filter(citations, lambda c: c["verified"]), lambda c: c["quote"]), " ")
    return F.filter(reportable_numbers(answer), lambda n: ~F.contains(quotes, n))


def check_answer(turns: DataFrame) -> DataFrame:
    """All columns of (status, answer, caveats, citations with source_id, quote, verified) after the checks.

    The order counts: citations of a ``not_found`` answer go first, then the status is lowered, then the
    markers and numbers are held against what is left.
    """
    none = F.array().cast(turns.schema["citations"].dataType)
    cleared = turns.withColumn("citations", F.when(F.col("status") == "not_found", none).otherwise(F.col("citations")))
    lowered = (F.col("status") == "answered") & (F.size("citations") > 0) & F.forall("citations", lambda c: ~c["verified"])
    more = [F.when(lowered, F.array(F.lit(UNVERIFIED))), F.when(F.size(orphans(F.col("answer"), F.col("citations"))) > 0, F.array(F.lit(ORPHANED))), F.when(F.size(unbacked(F.col("answer"), F.col("citations"))) > 0, F.array(F.lit(UNBACKED)))]
    caveats = F.concat("caveats", *(F.coalesce(c, F.array().cast("array<string>")) for c in more))
    return cleared.withColumns({"status": F.when(lowered, "partial").otherwise(F.col("status")), "caveats": caveats})


def verify_citations(citations: DataFrame, sources: DataFrame, turn: str = "turn_id", compatibility: bool = True) -> DataFrame:
    """Citations of known sources with ``verified`` and ``value``; those of unknown sources go."""
    known = citations.join(sources.select(turn, "source_id", F.col("text").alias("_source")), [turn, "source_id"])
    return known.withColumn("_v", verification(F.col("quote"), F.col("value_text"), F.col("_source"), compatibility)).withColumns({"verified": F.col("_v.verified"), "value": F.col("_v.value")}).drop("_v", "_source")


def group_citations(citations: DataFrame, turn: str = "turn_id") -> DataFrame:
    """One row per (turn, source_id, quote), first seen first; citations without a source never merge.

    Columns: position, verified (all of them), n_citations, values (those given, in order).
    """
    alone = F.when(F.col("source_id").isNull(), F.col("pos"))
    return citations.groupBy(turn, "source_id", "quote", alone.alias("_alone")).agg(
        F.min("pos").alias("position"), F.bool_and("verified").alias("verified"), F.count(F.lit(1)).alias("n_citations"),
        F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("value_text", F.lit("")) != "", F.struct("pos", "value_text")))), lambda x: x["value_text"]).alias("values"),
    ).drop("_alone")


def display_numbers(turns: DataFrame, turn: str = "turn_id") -> DataFrame:
    """(turn, source_id, number): markers by first mention, then the other citations in order."""
    ids = F.array_distinct(F.concat(markers(F.col("answer")), F.filter(F.transform("citations", lambda c: c["source_id"]), lambda s: s.isNotNull() & (s != ""))))
    return turns.select(turn, F.posexplode(ids).alias("n", "source_id")).select(turn, "source_id", (F.col("n") + 1).alias("number"))


def highlight_spans(rows: DataFrame, key: list[str], quote: str = "quote", values: str = "values") -> DataFrame:
    """(key, start, end) of the merged places of values in a quote; places that touch are one."""
    at = rows.select(*key, F.explode(values).alias("v"), F.col(quote).alias("q")).select(*key, (F.instr("q", F.col("v")) - 1).alias("start"), F.length("v").alias("n")).where("start >= 0")
    w = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = at.withColumn("end", F.col("start") + F.col("n"))
    fresh = spans.withColumn("new", F.coalesce((F.max("end").over(w) < F.col("start")).cast("int"), F.lit(1)))
    island = F.sum("new").over(Window.partitionBy(*key).orderBy("start", "end"))
    return fresh.withColumn("island", island).groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def overlap(a: Column, b: Column, compatibility: bool = True) -> Column:
    """Whether one quote contains the other."""
    return quote_in(a, b, compatibility) | quote_in(b, a, compatibility)


def split_around(text: Column, quote: Column) -> Column:
    """struct(before, found, after) around the first literal place of a quote, null where it is not there."""
    at = F.call_function("instr", text, quote)
    whole = F.length(text)
    parts = F.struct(F.substring(text, 1, at - 1).alias("before"), F.substring(text, at, F.length(quote)).alias("found"), F.substring(text, at + F.length(quote), whole).alias("after"))
    return F.when((at > 0) & (F.length(quote) > 0), parts)


def segments(turns: DataFrame, turn: str = "turn_id") -> DataFrame:
    """(turn, seq, text, number): an answer cut at its markers; a marker has its display number and no text."""
    ids = F.transform(F.regexp_extract_all("answer", F.lit(r"\[S(\d+)\]"), F.lit(1)), lambda n: F.concat(F.lit("S"), n))
    zipped = F.arrays_zip(F.split("answer", r"\[S\d+\]", -1).alias("text"), ids.alias("id"))
    each = turns.select(turn, markers(F.col("answer")).alias("_order"), F.posexplode(zipped).alias("i", "x"))
    pair = F.array(F.struct((F.col("i") * 2).alias("seq"), F.col("x.text").alias("text"), F.lit(None).cast("int").alias("number")), F.struct((F.col("i") * 2 + 1).alias("seq"), F.lit("").alias("text"), F.array_position("_order", F.col("x.id")).cast("int").alias("number")))
    return each.select(turn, F.explode(pair).alias("s")).select(turn, "s.*").where("text <> '' or number is not null")
