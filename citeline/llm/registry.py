"""The registered query of each training-data operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.llm import lexical, line_dedup
from citeline.llm.common import table
from citeline.llm.oracles import PII, url_filter


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeline.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeline.llm.media import text_media

    return text_media(table(spark, sf_dir, "documents"))


def op3_sanitise_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeline.llm.pii import report

    return report(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeline.llm.url_filter import judge

    found = judge(table(spark, sf_dir, "pages"))
    return found.withColumns({c: F.round(c, 6) for c in ("score", "threshold")})


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeline.llm.embed_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeline.llm.chat import exchanges, linked

    found = linked(*exchanges(table(spark, sf_dir, "conversations")))
    return found.withColumn("errors", F.array_join("errors", "; "))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeline.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeline.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeline.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from citeline.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeline.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeline.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeline.llm.line_dedup import report

    return report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_media_columns, op3_sanitise_pii, op4_url_filter, op5_embedding_near_dedup, op6_tool_call_linking, op7_best_fit_packing, op8_quality_classifier, op9_simhash_near_dedup, op10_bpe_round_trip, op11_ranked_search, op12_spelling_variants, op13_line_dedup)}
ORACLES: dict[str, str] = {
    "op11_ranked_search": lexical.SQL,
    "op13_line_dedup": line_dedup.SQL,
    "op3_sanitise_pii": PII,
    "op4_url_filter": url_filter(),
    "op5_embedding_near_dedup": """WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS n, vec_id AS m FROM embeddings UNION SELECT l.a, r.m FROM r JOIN l ON l.b = r.n),
c AS (SELECT n, min(m) AS component_id FROM r GROUP BY n),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.n = vec_id LEFT JOIN k ON k.a = vec_id""",
    "op6_tool_call_linking": """WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS x FROM conversations),
calls AS (SELECT * FROM c WHERE role = 'user'),
res AS (SELECT *, CASE WHEN role = 'assistant' THEN turn - 1 END AS k FROM c WHERE role IS DISTINCT FROM 'user'),
runs AS (SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM (SELECT DISTINCT conv_id, turn FROM calls)),
lv AS (SELECT conv_id, turn, CAST(2 * (row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1) AS INTEGER) AS level FROM runs)
SELECT conv_id, turn, CAST(0 AS INTEGER) AS place, 'call' AS kind, CAST(turn AS VARCHAR) AS call_id, turn AS call_turn, level,
 CASE WHEN EXISTS (SELECT 1 FROM res WHERE res.conv_id = calls.conv_id AND res.k = calls.turn) THEN 'linked' ELSE 'open' END AS state,
 x <> '' AS valid, CASE WHEN x = '' THEN '$.prompt: too short' ELSE '' END AS errors,
 '{"arguments":{"prompt":' || CAST(to_json(x) AS VARCHAR) || ',"turn":' || turn || '},"conversation":' || conv_id || ',"id":"' || turn || '","name":"answer","role":"user","turn":' || turn || ',"type":"call"}' AS json FROM calls JOIN lv USING (conv_id, turn)
UNION ALL SELECT r.conv_id, r.turn, 0, 'result', CAST(k AS VARCHAR), calls.turn, lv.level + 1, CASE WHEN calls.turn IS NULL THEN 'orphan' ELSE 'linked' END,
 calls.turn IS NOT NULL, CASE WHEN calls.turn IS NULL THEN 'orphan' ELSE '' END,
 '{"content":' || CAST(to_json(r.x) AS VARCHAR) || ',"conversation":' || r.conv_id || ',"id":' || coalesce('"' || k || '"', 'null') || ',"role":' || coalesce('"' || r.role || '"', 'null') || ',"turn":' || r.turn || ',"type":"result"}'
 FROM res r LEFT JOIN calls ON calls.conv_id = r.conv_id AND calls.turn = k LEFT JOIN lv ON lv.conv_id = r.conv_id AND lv.turn = k""",
}
