"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns: every operator, every stage."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citeline.llm import bpe, chat, embed_dedup, html_extract, media, packing, pii, quality, simhash, url_filter

LONG = ("lorem ipsum dolor sit amet " * 8000).strip()
CLASH = "__fp long, n long, rep long, score double, line string, pii string, w long, h long, ids string, seq_id long, salt int, rank long, a long, t string, rule string, path string, verdict string, n_links long"
TEXTS = [(1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, "same words here again and again"), (6, "same words here again and again"), (6, "same words here again and again"), (None, "mail me at a.b@c.de or +31 20 123 4567"), (8, "\u0000 é 😀 <|endoftext|> 1.2.3.4")]


def documents(spark, rows=TEXTS):
    extra = ", ".join(f"cast(null as {c.rsplit(' ', 1)[1]}) as {c.rsplit(' ', 1)[0]}" for c in CLASH.split(", "))
    base = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return base.selectExpr("*", *extra.split(", "))


def labels(spark, rows=((4, 1, 0), (5, 1, 0), (5, 0, 0), (None, 1, None), (6, None, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


PATH = public_tokenizers.path("byte_bpe_50k.json")
PER_DOCUMENT = {
    "media": lambda df, s: media.text_media(df), "bpe": lambda df, s: bpe.round_trip(df, PATH), "pii": lambda df, s: pii.report(df),
    "simhash": lambda df, s: simhash.near_duplicates(df), "quality": lambda df, s: quality.classify(df, labels(s)), "sanitise": lambda df, s: pii.sanitise(df),
    "media_columns": lambda df, s: media.media_columns(df.withColumn("content", F.col("text").cast("binary"))), "ids": lambda df, s: bpe.decode(bpe.encode(df, PATH, ids="tokens"), PATH, "tokens"),
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_a_row_for_each_document(spark, name):
    assert PER_DOCUMENT[name](documents(spark), spark).count() == len(TEXTS)
    assert PER_DOCUMENT[name](documents(spark, TEXTS[:0]), spark).collect() == []


def test_bpe_digests(spark):
    for r in bpe.round_trip(documents(spark), PATH).collect():
        texts = {hashlib.sha256((t or "").encode()).hexdigest() for i, t in TEXTS if i == r.doc_id}
        assert r.decoded_sha256 in texts


def test_simhash_of_nothing_links(spark):
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(documents(spark)).collect()}
    assert {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)} <= found and (None, None) in found


def test_pages_and_urls(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no scheme", "<p>x"), (4, "http://A.Example.NET/en/x?y", "<" * 5000 + "<p>" * 3000), (4, "http://A.Example.NET/en/x?y", "<p>q</p>"), (None, "ftp://org/fr/#a", "<div><p>A sentence that is long enough to be text.</p></div>"), (7, "x://y.org", "a & b &lt; c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(None).cast("string") for c in ("text", "host", "line", "score", "rule")})
    assert html_extract.extract(df).count() == len(rows) and html_extract.extract(df.limit(0)).count() == 0
    found = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert {(1, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.example.net", "/en/x", "example.net/en/", "allow"), (None, "org", "/fr/", "org/fr/", "allow")} <= found
    assert url_filter.judge(df).count() == len(rows) and url_filter.judge(df.limit(0)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 1), (None, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("rep", "w", "v", "n", "side")})
    found = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()), key=lambda r: r[0])
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert found == [(0, 0, None, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *alone]
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (2, None, "user", "x"), (None, 0, "user", "x"), (3, 0, "system", LONG), (3, 5, "assistant", '{"tool_call'), (4, 0, None, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("level", "state", "call_id", "payload")})
    assert chat.linked(*chat.exchanges(df)).count() == len(rows) and chat.linked(*chat.exchanges(df.limit(0))).count() == 0


def test_packing_places_every_piece(spark):
    found = packing.pack(documents(spark)).collect()
    assert sum(r.n_tokens for r in found if r.doc_id == 4) == 40000 and {r.doc_id for r in found if r.seq_id is None} == {1, 2, 3}
    assert packing.pack(documents(spark, TEXTS[:0])).collect() == []


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, tmp_path, at):
    """The one trusted text knows no other words, so quality keeps it and the two without any text."""
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    name, stage = corpus_pipeline.STAGES[at]
    docs = documents(spark)
    out = stage(spark, docs, str(tmp_path))
    n = out.count()
    if at < 3:
        assert out.columns == docs.columns
        assert {"quality": 3, "simhash_near_dedup": 5, "pii": len(TEXTS)}[name] == n
    assert stage(spark, documents(spark, TEXTS[:0]), str(tmp_path)).count() == 0


def test_url_threshold_is_the_exact_place(spark):
    """The threshold is the score at its place of all labelled ones, ties, nulls and none too; an approximate percentile is some places off."""
    scores = spark.range(0, 300_000).select(F.when(F.col("id") > 0, F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 2.0**40).alias("score"))
    values = sorted(r.score for r in scores.collect() if r.score is not None)
    assert url_filter.cutoff_of(scores, 0.001) == values[299_999 - 299 - 1]
    assert scores.agg(F.expr("percentile_approx(score, 0.9, 10000)").alias("x")).first().x != url_filter.cutoff_of(scores, 0.1) == values[299_999 - 29_999 - 1]
    assert url_filter.cutoff_of(spark.range(5).select(F.lit(1.5).alias("score")), 0.5) == 1.5 and url_filter.cutoff_of(scores.where("false"), 0.001) is None
