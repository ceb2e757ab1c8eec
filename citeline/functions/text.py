"""Column functions over text: normalisation, canonical form, numbers, tokens, labels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that the normaliser maps, in its order, and what they become.
SPACES, SINGLES, DOUBLES = "\u00a0\u2007\u202f\u2009\u200a", "\u2018\u2019\u201a\u201b", "\u201c\u201d\u201e\u201f"
DASHES, SOFT_HYPHEN = "\u2010\u2011\u2012\u2013\u2014\u2015", "\u00ad"
MAPPED = SPACES + SINGLES + DOUBLES + DASHES + SOFT_HYPHEN
BECOMES = " " * len(SPACES) + "'" * len(SINGLES) + '"' * len(DOUBLES) + "-" * len(DASHES)
#: The stop words of the question builder.
STOP_WORDS = ("a an and are as at be by for from has have how in into is it its of on or our than that the their this to was were what when where which who will with did do does much").split()
#: Magnitude words of printed numbers.
MAGNITUDES = {"k": 1e3, "thousand": 1e3, "mn": 1e6, "million": 1e6, "bn": 1e9, "billion": 1e9}
PRINTED = r"(?iU)([-+])?(\d[\d.,\s\u00a0]*\d|\d)\s*(thousand|million|billion|mn|bn|k)?\s*(%)?"
#: Figures worth a citation, and years, which are not.
REPORTABLE, YEAR = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+|\d{4,}", r"^(19|20)\d\d$"
#: The topic filter.
TOPICS = (
    r"sustainab\w*|climate|emissions?|carbon|co2e?|scope\s*[123]\b|renewable|circular\w*|biodiversity|water|waste|net[- ]zero|"
    r"greenhouse gas|ghg|esrs|human rights|diversity|inclusion|community|deforestation|energy efficiency"
)


def accents() -> tuple[str, str]:
    """Letters below U+0250 that fold to one ASCII letter once marks go, and what they fold to."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and all(unicodedata.combining(x) for x in unicodedata.normalize("NFD", a)[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, FOLDED = accents()


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def dehyphenate(text: Column) -> Column:
    """Words broken at a line's end are joined; texts without such a place are not searched by the pattern."""
    return F.when(F.contains(text, F.lit("-\n")), F.regexp_replace(text, r"(?U)(\w)-\n+(\w)", "$1$2")).otherwise(text)


def tidy(text: Column) -> Column:
    """The steps after NFKC: mapped characters, runs of blanks and newlines, stripped lines."""
    text = F.translate(text, MAPPED, BECOMES)
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(text, r"(?Udm)^[^\S\n]+|[^\S\n]+$", ""))


def normalize_text(text: Column, compatibility: bool = True) -> Column:
    """The normaliser used at write and at verify time; the order of its steps is part of it.

    NFKC has no built-in, so it is an Arrow function; leave it out where the text is known to be NFKC.
    """
    return tidy(compatible(text, compatibility))


def compatible(text: Column, compatibility: bool = True) -> Column:
    """Joined words in compatibility form; ASCII is its own, so only other texts go to the Arrow function."""
    joined = dehyphenate(text)
    return F.coalesce(nfkc(F.when(joined.rlike(r"[^\x00-\x7F]"), joined)), joined) if compatibility else joined


def clean_paragraph(line_list: Column, compatibility: bool = True) -> Column:
    """Lines of a block joined, normalised, and all white space runs made one space."""
    return F.regexp_replace(normalize_text(F.array_join(line_list, "\n"), compatibility), r"(?U)\s+", " ")


def block_text(lines: Column, compatibility: bool = True) -> Column:
    """The text of a block of lines of spans: spans run on, blank lines go, the rest is one paragraph; empty for a null block."""
    joined = F.transform(lines, lambda spans: F.array_join(spans, ""))
    kept = F.filter(joined, lambda t: t.rlike(r"(?U)\S"))
    return clean_paragraph(F.coalesce(kept, F.array().cast("array<string>")), compatibility)


def clean_cell(text: Column, compatibility: bool = True) -> Column:
    """A table cell: normalised, newlines as spaces, pipes as slashes, stripped."""
    return strip(F.translate(normalize_text(F.coalesce(text, F.lit("")), compatibility), "\n|", " /"))


def canonical_form(text: Column, compatibility: bool = True) -> Column:
    """Small ASCII words between single spaces, padded on both sides; hyphens vanish.

    What the normaliser does to blanks and lines leaves no trace here, so of its steps only those before and the
    mapped characters are taken.
    """
    mapped = F.translate(compatible(text, compatibility), MAPPED, BECOMES)
    words = F.regexp_replace(F.replace(F.lower(mapped), F.lit("-"), F.lit("")), "[^a-z0-9]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def parse_number(text: Column) -> Column:
    """Best-effort value of the first printed number, null if none."""
    part = lambda i: F.regexp_extract(text, PRINTED, i)
    raw = F.translate(part(2), " \u00a0", "")
    comma, dot = F.contains(raw, F.lit(",")), F.contains(raw, F.lit("."))
    no_comma, no_dot = F.replace(raw, F.lit(","), F.lit("")), F.replace(raw, F.lit("."), F.lit(""))
    last = lambda c: F.length(raw) - F.instr(F.reverse(raw), c)
    plain = (
        F.when(comma & dot, F.when(last(",") > last("."), F.replace(no_dot, F.lit(","), F.lit("."))).otherwise(no_comma))
        .when(comma, F.when(raw.rlike(r",\d{1,2}$") & ~raw.rlike(r"(?U),\d{3}\b"), F.replace(raw, F.lit(","), F.lit("."))).otherwise(no_comma))
        .when(dot & raw.rlike(r"^\d{1,3}(\.\d{3})+$"), no_dot)
        .otherwise(raw)
    )
    value = F.when(F.coalesce(part(2), F.lit("")) != "", plain.try_cast("double"))
    signed = F.when(part(1) == "-", -value).otherwise(value)
    word = F.lower(part(3))
    return signed * F.coalesce(*(F.when(word == w, F.lit(m)) for w, m in MAGNITUDES.items()), F.lit(1.0))


def reportable_numbers(text: Column) -> Column:
    """Figures as printed, years left out, in order of first appearance."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(REPORTABLE), F.lit(0)), lambda n: ~n.rlike(YEAR)))


def question_tokens(text: Column) -> Column:
    """Tokens of a question: stop words and single characters go unless nothing else is left."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[A-Za-z0-9%.]+"), F.lit(0))
    kept = F.filter(tokens, lambda t: ~t.isin(STOP_WORDS) & (F.length(t) > 1))
    return F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(tokens))


def fts_query(text: Column) -> Column:
    """The match expression: each token quoted, OR-joined; empty without tokens."""
    return F.array_join(F.transform(question_tokens(text), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def index_tokens(text: Column) -> Column:
    """Index terms: small letters without marks, split at whatever is no letter or digit."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, FOLDED), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def page_label(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def embed_text(company: Column, year: Column, first: Column, last: Column, text: Column) -> Column:
    return F.concat(company, F.lit(" | Annual Report "), year.cast("string"), F.lit(" | page "), page_label(first, last), F.lit("\n\n"), text)


def topical(text: Column) -> Column:
    """Whether a text mentions a sustainability topic."""
    return text.rlike(rf"(?iuU)\b({TOPICS})\b")


def guess_company(filename: Column) -> Column:
    """First token of a file name's stem with its first letter capital; the rest keeps its case."""
    token = F.regexp_extract(F.regexp_replace(filename, r"\.[^./]+$", ""), r"^[^-_\s]*", 0)
    return F.concat(F.upper(F.substring(token, 1, 1)), F.substring(token, 2, 1 << 30))


def guess_year(filename: Column) -> Column:
    return F.nullif(F.regexp_extract(filename, r"20\d{2}", 0), F.lit("")).cast("int")


def sentence_tail(paragraph: Column, limit: int = 200) -> Column:
    """The caption of a table: the paragraph if short, else its last sentence, its last ``limit`` characters."""
    text = strip(paragraph)
    sentences = F.filter(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda s: s != "")
    return F.when(F.length(text) <= limit, text).otherwise(F.right(F.coalesce(F.try_element_at(sentences, F.lit(-1)), text), F.lit(limit)))


def source_tag(source_id: Column, report: Column, company: Column, year: Column, first: Column, last: Column, kind: Column, text: Column) -> Column:
    """One tagged source of the answer prompt; attributes are not escaped."""
    attributes = (("id", source_id), ("report", report), ("company", company), ("year", year.cast("string")), ("pages", page_label(first, last)), ("kind", kind))
    parts = [x for name, value in attributes for x in (F.lit(f' {name}="'), value, F.lit('"'))]
    return F.concat(F.lit("<source"), *parts, F.lit(">\n"), text, F.lit("\n</source>"))
