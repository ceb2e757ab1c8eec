import pytest
from pyspark.sql import functions as F

from citeline.functions import text as T


def one(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


NORMALISED = [
    ("work-\nforce", "workforce"), ("work-\n\nforce", "workforce"), ("12 345", "12 345"), ("co­op", "coop"), ("“Hi” ’s", '"Hi" \'s'),
    ("2024–2025", "2024-2025"), ("a\n\n\n\nb", "a\n\nb"), ("a\n \n \nb", "a\n\n\nb"), ("CO₂ ﬁt", "CO2 fit"), ("  x \t y  \n z ", "x y\nz"), ("", ""), (None, None), ("Café-\ncrème", "Cafécrème"),
]


def test_normalize_text(spark):
    assert one(spark, [a for a, _ in NORMALISED], T.normalize_text) == [b for _, b in NORMALISED]


def test_normalizer_is_not_idempotent_on_blank_lines(spark):
    assert one(spark, ["a\n\n\nb"], T.normalize_text) == ["a\n\nb"]


NUMBERS = [
    ("1,234.5", 1234.5), ("1.234,5", 1234.5), ("12 345", 12345.0), ("12 345", 12345.0), ("about 12.3 million", 12.3e6), ("43k", 43000.0), ("12%", 12.0), ("none", None), ("", None), (None, None),
    ("1,5", 1.5), ("1,234", 1234.0), ("1.234", 1234.0), ("0.123", 123.0), ("12 km", 12000.0), ("12m", 12.0), ("2024 103,100", 2024103100.0), ("-7 bn", -7e9), ("+3", 3.0), ("1\t2", None), ("1.2.3", None),
]


@pytest.mark.parametrize("at", range(len(NUMBERS)))
def test_parse_number(spark, at):
    assert one(spark, [NUMBERS[at][0]], T.parse_number) == [NUMBERS[at][1]]


def test_canonical_form(spark):
    assert one(spark, ["Full-Time, staff!", "éé", None], T.canonical_form) == [" fulltime staff ", "  ", None]


def test_fts_query(spark):
    asked = ["What is the FTE of the FTE group?", "the of it", "?!", 'say "x" OR 8.7% in 103,100', "café"]
    assert one(spark, asked, T.fts_query) == ['"fte" OR "group"', '"the" OR "of" OR "it"', "", '"say" OR "8.7%" OR "103" OR "100"', '"caf"']


def test_reportable_numbers(spark):
    assert one(spark, ["In 2028 we had 122,779 and 8.7 or 12345, 8.7 and 99"], T.reportable_numbers) == [["122,779", "8.7", "12345"]]


def test_labels_and_names(spark):
    rows = spark.createDataFrame([(3, 3), (3, 4)], "a int, b int")
    assert [r[0] for r in rows.select(T.page_label(F.col("a"), F.col("b"))).collect()] == ["3", "3-4"]
    names = ["shell-annual-report-2025.pdf", "ING_groep.pdf", "2031.pdf", ".pdf"]
    assert one(spark, names, T.guess_company) == ["Shell", "ING", "2031", ""]
    assert one(spark, names, T.guess_year, "string") == [2025, None, 2031, None]


def test_caption(spark):
    long = "First part. " + "w" * 180 + " end. " + "Last one here"
    assert one(spark, ["  short  ", long, "z" * 300], T.sentence_tail) == ["short", "Last one here", "z" * 200]


def test_topics(spark):
    assert one(spark, ["Net-zero by 2040", "scope 3", "watery", "our CO2e", "Sustainably"], T.topical) == [True, True, False, True, True]
