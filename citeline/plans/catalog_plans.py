"""Catalog operators: documents play reports, events play extractions and updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeline.operators import catalog as K
from citeline.operators import extract as E
from citeline.plans.base import query
from citeline.session import scratch, table
from citeline.sources.files import write_json_lines

KINDS = ("click", "error")


def reports(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("id"), F.sha2("text", 256).alias("sha256"), F.col("source").alias("company"), F.when(i % 5 == 0, "processing").when(i % 5 == 1, "failed").otherwise("ready").alias("status"),
        F.when(i % 5 < 2, "embed").alias("stage"), F.when(i % 5 < 2, 0.5).otherwise(1.0).alias("progress"), F.when(i % 5 == 1, "no text").alias("error"),
        F.when(i % 4 != 0, (i % 9).cast("int")).alias("page_count"), (F.lit(20000) + i * 7 % 97).cast("int").alias("created_at"),
    )


REPORTS = """reports AS (SELECT doc_id AS id, sha256(text) AS sha256, source AS company, CASE doc_id % 5 WHEN 0 THEN 'processing' WHEN 1 THEN 'failed' ELSE 'ready' END AS status,
 CASE WHEN doc_id % 5 < 2 THEN 'embed' END AS stage, CASE WHEN doc_id % 5 < 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS progress, CASE WHEN doc_id % 5 = 1 THEN 'no text' END AS error,
 CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id % 9 AS INTEGER) END AS page_count, CAST(20000 + doc_id * 7 % 97 AS INTEGER) AS created_at FROM documents)"""


def extractions(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "fte").when(F.col("event_type") == "error", "sustainability_goal")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("report_id"), kind.alias("kind"), "value", "props").where("kind is not null")


EXTRACTIONS = """extractions AS (SELECT event_id AS id, user_id AS report_id, CASE event_type WHEN 'click' THEN 'fte' ELSE 'sustainability_goal' END AS kind, value, props FROM events WHERE event_type IN ('click', 'error'))"""


def numbered(rows, order):
    """Rows with their place in an order, so that a result without order can be compared."""
    return rows.withColumn("place", F.row_number().over(K.Window.orderBy(*order)))


@query(f"WITH {REPORTS} SELECT id, company, status, created_at FROM reports ORDER BY created_at DESC, id DESC")
def report_listing(spark, sf_dir):
    return K.newest_first(reports(spark, sf_dir)).select("id", "company", "status", "created_at")


@query(f"WITH {REPORTS} SELECT id, company, created_at FROM reports WHERE status = 'ready' ORDER BY created_at, id")
def ready_reports(spark, sf_dir):
    return K.ready(reports(spark, sf_dir)).select("id", "company", "created_at")


@query(f"WITH {REPORTS} SELECT id, status FROM reports WHERE id IN (SELECT item_id * 7 FROM benchmark)")
def report_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 7).alias("id"))
    return K.lookup(reports(spark, sf_dir), wanted, "id").select("id", "status")


@query(f"WITH {REPORTS}, {EXTRACTIONS}, n AS (SELECT report_id, count(*) FILTER (kind = 'fte') AS f, count(*) FILTER (kind <> 'fte') AS g FROM extractions GROUP BY report_id) SELECT id, CASE WHEN status = 'ready' THEN coalesce(f, 0) ELSE 0 END AS fte, CASE WHEN status = 'ready' THEN coalesce(g, 0) ELSE 0 END AS goals FROM reports LEFT JOIN n ON id = report_id")
def extraction_counts(spark, sf_dir):
    return K.extraction_counts(reports(spark, sf_dir), extractions(spark, sf_dir)).select("id", "fte", "goals")


@query(f"WITH {REPORTS}, {EXTRACTIONS}, n AS (SELECT report_id, count(*) FILTER (kind = 'fte') AS f, count(*) FILTER (kind <> 'fte') AS g FROM extractions GROUP BY report_id) SELECT id, CASE WHEN status <> 'ready' THEN '—' ELSE CASE WHEN coalesce(f, 0) > 0 THEN 'FTE' ELSE 'no FTE' END || ', ' || coalesce(g, 0) || ' goals' END AS cell FROM reports LEFT JOIN n ON id = report_id")
def extracted_cell(spark, sf_dir):
    counted = K.extraction_counts(reports(spark, sf_dir), extractions(spark, sf_dir))
    return counted.select("id", K.extracted_cell(F.col("status"), F.col("fte"), F.col("goals")).alias("cell"))


@query(f"WITH {EXTRACTIONS} SELECT report_id, kind, id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM extractions ORDER BY report_id, kind, id")
def extraction_payloads(spark, sf_dir):
    decoded = K.extraction_payload(extractions(spark, sf_dir), "k int", "props")
    return K.of_report(decoded.select("report_id", "kind", "id", "props.k"), None, ["kind", "id"])


@query(f"WITH {REPORTS} SELECT sha256, min(id) AS id, count(*) AS copies FROM reports GROUP BY sha256")
def content_dedupe(spark, sf_dir):
    rows = reports(spark, sf_dir).withColumn("arrival", F.col("id"))
    copies = rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"))
    return K.first_copies(rows, order="arrival").select("sha256", "id").join(copies, "sha256")


@query(
    f"""WITH {REPORTS}, known AS (SELECT sha256, min(id) AS report_id, min_by(status, id) AS s FROM reports WHERE id % 2 = 0 GROUP BY sha256)
SELECT r.id AS upload, k.report_id, CASE WHEN s IN ('ready', 'processing') THEN 'existing' WHEN s = 'failed' THEN 'retry' ELSE 'create' END AS action, coalesce(s NOT IN ('ready', 'processing'), true) AS needs_ingestion FROM reports r LEFT JOIN known k ON k.sha256 = r.sha256"""
)
def intake_decision(spark, sf_dir):
    stored = K.first_copies(reports(spark, sf_dir).where("id % 2 = 0"), order="id").select("id", "sha256", "status")
    found = K.intake(reports(spark, sf_dir).select(F.col("id").alias("upload"), "sha256"), stored)
    return found.select("upload", "report_id", "action", "needs_ingestion")


@query(f"WITH {REPORTS} SELECT id, CASE WHEN status = 'processing' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'processing' THEN 'Interrupted by a restart' ELSE error END AS error FROM reports")
def interrupted_repair(spark, sf_dir):
    return K.repaired(reports(spark, sf_dir)).select("id", "status", "error")


@query(f"WITH {REPORTS} SELECT id, CASE WHEN id % 3 = 0 AND status = 'failed' THEN 'processing' ELSE status END AS status, CASE WHEN id % 3 = 0 AND status = 'failed' THEN NULL ELSE stage END AS stage, CASE WHEN id % 3 = 0 AND status = 'failed' THEN 0.0 ELSE progress END AS progress FROM reports")
def reset_for_retry(spark, sf_dir):
    rows = reports(spark, sf_dir)
    return K.reset(rows, rows.where("id % 3 = 0").select("id")).select("id", "status", "stage", "progress")


@query("SELECT vec_id, label FROM embeddings WHERE label NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 4 = 1)")
def delete_cascade(spark, sf_dir):
    """Vectors of deleted reports go with them; here a label is a report."""
    deleted = table(spark, sf_dir, "nation").where("n_nationkey % 4 = 1").select(F.col("n_nationkey").alias("label"))
    return K.without(table(spark, sf_dir, "embeddings").select("vec_id", "label"), deleted, "label")


@query("SELECT user_id, event_type AS status, round(value, 2) AS progress FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def latest_state(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("status"), F.round("value", 2).alias("progress"))
    return K.latest(events, "user_id", "event_id").select("user_id", "status", "progress")


@query(f"WITH {REPORTS} SELECT id, page_count, CAST(row_number() OVER (ORDER BY page_count DESC NULLS LAST, id) AS INTEGER) AS place FROM reports")
def listing_sort(spark, sf_dir):
    c = F.col("page_count").desc_nulls_last()
    return numbered(K.sorted_by(reports(spark, sf_dir), "page_count", descending=True), [c, "id"]).select("id", "page_count", "place")


@query(f"WITH {REPORTS} SELECT company, bool_or(status = 'processing') AS busy, count(DISTINCT status) AS statuses FROM reports GROUP BY company")
def processing_flags(spark, sf_dir):
    rows = reports(spark, sf_dir)
    return K.busy(rows, "company").join(rows.groupBy("company").agg(F.countDistinct("status").alias("statuses")), "company")


_CATEGORY = "CASE p_size % 9 WHEN 0 THEN 'climate' WHEN 1 THEN 'energy' WHEN 2 THEN 'circularity_waste' WHEN 3 THEN 'water' WHEN 4 THEN 'biodiversity' WHEN 5 THEN 'social_people' WHEN 6 THEN 'governance' WHEN 7 THEN 'other' ELSE 'new_' || p_size END"
_LABEL = "CASE c WHEN 'climate' THEN 'Climate' WHEN 'energy' THEN 'Energy' WHEN 'circularity_waste' THEN 'Circularity & waste' WHEN 'water' THEN 'Water' WHEN 'biodiversity' THEN 'Biodiversity' WHEN 'social_people' THEN 'Social & people' WHEN 'governance' THEN 'Governance' WHEN 'other' THEN 'Other' ELSE c END"


@query(f"SELECT p_partkey, {_LABEL} AS label FROM (SELECT p_partkey, {_CATEGORY} AS c FROM part)")
def category_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", K.category_label(F.expr(_CATEGORY)).alias("label"))


@query(f"SELECT p_brand, array_to_string(list_sort(list_distinct(list(c))), '|') AS categories, array_to_string(list_sort(list_distinct(list(y) FILTER (y IS NOT NULL))), '|') AS years FROM (SELECT p_brand, {_CATEGORY} AS c, CASE WHEN p_size % 7 <> 0 THEN 2020 + p_size % 20 END AS y FROM part) GROUP BY p_brand")
def filter_choices(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", F.expr(_CATEGORY).alias("c"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 20 + 2020).alias("y"))
    found = K.choices(rows, "p_brand", ["c", "y"])
    return found.select("p_brand", F.array_join("c", "|").alias("categories"), F.array_join(F.col("y").cast("array<string>"), "|").alias("years"))


@query(f"SELECT p_partkey FROM (SELECT p_partkey, {_CATEGORY} AS category, CASE WHEN p_size % 7 <> 0 THEN CAST(2020 + p_size % 20 AS VARCHAR) ELSE '' END AS y FROM part) WHERE category = 'water' AND y = ''")
def goal_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_CATEGORY).alias("category"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 20 + 2020).alias("target_year"))
    return K.filtered(rows, "water", "").select("p_partkey")


@query("SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN 0.0 + 0.3 * f WHEN 1 THEN 0.3 + 0.2 * f WHEN 2 THEN 0.5 + 0.3 * f ELSE 0.8 + 0.2 * f END, 6) AS progress FROM (SELECT event_id, CAST(event_id % 10 AS DOUBLE) / 10 AS f FROM events)")
def stage_progress(spark, sf_dir):
    stage = F.element_at(F.array(*map(F.lit, ("parse", "chunk", "embed", "extract"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.round(K.progress(stage, F.col("event_id") % 10, F.lit(10)), 6).alias("progress"))


@query("SELECT row_number() OVER (ORDER BY doc_id) + 500 AS id, doc_id FROM documents")
def append_with_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return K.with_ids(rows, ["doc_id"], after=500).select("id", "doc_id")


@query("SELECT vec_id, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def vector_codec(spark, sf_dir):
    """To little-endian bytes and back; nothing may be lost."""
    back = table(spark, sf_dir, "embeddings").select("vec_id", K.blob_to_vector(K.vector_to_blob(F.col("embedding"))).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("vec_id", F.size("v").cast("long").alias("dim"), F.round(total, 6).alias("total"))


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents")
def streaming_intake(spark, sf_dir):
    """Documents as a stream, each content once, in available-now batches into a shared folder."""
    from citeline.streaming.intake import ingest, once_per_content

    folder = scratch(spark, "intake")
    schema = table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*")
    digests = once_per_content(stream.select(F.sha2("text", 256).alias("sha256")))
    ingest(digests, f"{folder}/checkpoint", lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}"))
    return spark.read.parquet(f"{folder}/rows").select("sha256")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 4 = 0")
def pending_embeddings(spark, sf_dir):
    some = F.when(F.col("vec_id") % 4 != 0, F.col("embedding"))
    return K.pending(table(spark, sf_dir, "embeddings").withColumn("embedding", some)).select("vec_id")


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'S' || turn END AS source_id, CAST(CASE turn % 3 WHEN 0 THEN 1 END AS INTEGER) AS n FROM conversations")
def message_payloads(spark, sf_dir):
    stored = F.when(F.col("turn") % 3 == 0, F.to_json(F.array(F.struct(F.concat(F.lit("S"), F.col("turn").cast("string")).alias("source_id"), F.lit("q").alias("quote"))))).when(F.col("turn") % 3 == 1, "")
    read = K.message_payload(table(spark, sf_dir, "conversations").withColumn("citations", stored))
    return read.select("conv_id", "turn", F.col("citations")[0]["source_id"].alias("source_id"), F.when(F.col("citations").isNotNull(), F.size("citations")).alias("n"))


@query(
    f"""WITH {REPORTS}, {EXTRACTIONS}, n AS (SELECT report_id, count(*) FILTER (kind = 'fte') AS f, count(*) FILTER (kind <> 'fte') AS g FROM extractions GROUP BY report_id)
SELECT id, '{{"id":' || id || ',"company":"' || company || '","status":"' || status || '","page_count":' || coalesce(CAST(page_count AS VARCHAR), 'null') || ',"extraction_counts":{{"fte":' || CASE WHEN status = 'ready' THEN coalesce(f, 0) ELSE 0 END || ',"sustainability_goal":' || CASE WHEN status = 'ready' THEN coalesce(g, 0) ELSE 0 END || '}}}}' AS payload FROM reports LEFT JOIN n ON id = report_id"""
)
def report_payloads(spark, sf_dir):
    return K.report_payload(K.extraction_counts(reports(spark, sf_dir), extractions(spark, sf_dir)))


@query(f"WITH {EXTRACTIONS} SELECT report_id, kind, id FROM extractions")
def extraction_listing(spark, sf_dir):
    """All extractions in order of report, kind and id."""
    return K.of_report(extractions(spark, sf_dir), None, ["kind", "id"]).select("report_id", "kind", "id")


@query(f"WITH {EXTRACTIONS} SELECT kind, id FROM extractions WHERE report_id = 7")
def report_extractions(spark, sf_dir):
    return K.of_report(extractions(spark, sf_dir), 7, ["kind", "id"]).select("kind", "id")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 4 <> 0")
def embedded_chunks(spark, sf_dir):
    some = F.when(F.col("vec_id") % 4 != 0, F.col("embedding"))
    return K.embedded(table(spark, sf_dir, "embeddings").withColumn("embedding", some)).select("vec_id")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id <> 3")
def clear_conversation(spark, sf_dir):
    return K.cleared(table(spark, sf_dir, "conversations"), 3, "conv_id").select("conv_id", "turn")


@query(f"SELECT id, CAST(row_number() OVER (ORDER BY {_LABEL} COLLATE NOCASE, title, y NULLS LAST, id) AS INTEGER) AS place FROM (SELECT p_partkey AS id, {_CATEGORY} AS c, lower(p_type) AS title, CASE WHEN p_size % 7 <> 0 THEN 2020 + p_size % 20 END AS y FROM part)")
def goal_sort(spark, sf_dir):
    year = F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 20 + 2020)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_CATEGORY).alias("category"), F.lower("p_type").alias("title"), year.alias("target_year"), F.lit(1).alias("page"))
    return K.with_ids(K.sorted_goals(rows).withColumn("_o", F.monotonically_increasing_id()), ["_o"], key="place").select("id", F.col("place").cast("int").alias("place"))


@query("SELECT conv_id, turn, '{\"status\":\"' || CASE WHEN turn % 2 = 0 THEN 'answered' ELSE 'partial' END || '\",\"interpreted_as\":' || CASE WHEN turn % 3 = 0 THEN CAST(turn AS VARCHAR) ELSE 'null' END || ',\"citations\":[' || CASE WHEN turn % 2 = 0 THEN '{\"source_id\":\"S' || turn || '\",\"verified\":true}' ELSE '' END || ']}' AS payload FROM conversations")
def chat_payloads(spark, sf_dir):
    cited = F.array(F.struct(F.concat(F.lit("S"), F.col("turn").cast("string")).alias("source_id"), F.lit(True).alias("verified")))
    none = F.filter(cited, lambda c: F.lit(False))
    rows = table(spark, sf_dir, "conversations").select(
        F.struct("conv_id", "turn").alias("turn_id"), F.when(F.col("turn") % 2 == 0, "answered").otherwise("partial").alias("status"),
        F.when(F.col("turn") % 3 == 0, F.col("turn")).alias("interpreted_as"), F.when(F.col("turn") % 2 == 0, cited).otherwise(none).alias("citations"),
    )
    return K.chat_payload(rows).select("turn_id.conv_id", "turn_id.turn", "payload")


@query("WITH n AS (SELECT doc_id, CAST(doc_id % 23 AS INTEGER) AS pages FROM documents) SELECT doc_id, CAST(f AS INTEGER) AS first, CAST(least(f + 4, pages) AS INTEGER) AS last FROM n, range(1, pages + 1, 5) r(f)")
def page_tasks(spark, sf_dir):
    return K.page_tasks(table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 23).cast("int").alias("page_count")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at FROM events")
def iso_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", K.now_iso(F.col("ts").cast("timestamp")).alias("at"))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS line FROM nation""")
def json_lines(spark, sf_dir):
    """Rows as JSON lines, as the sink writes them; read back from what it wrote."""
    path = scratch(spark, "lines")
    write_json_lines(table(spark, sf_dir, "nation"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"WITH {EXTRACTIONS}, f AS (SELECT report_id, id, kind, row_number() OVER (PARTITION BY report_id, kind ORDER BY id) AS n FROM extractions) SELECT report_id, id, kind FROM f WHERE kind = 'sustainability_goal' OR n = 1")
def page_items(spark, sf_dir):
    """What a report's page shows: its first workforce figure and all its goals."""
    figures, goals = E.page_items(extractions(spark, sf_dir))
    return figures.unionByName(goals).select("report_id", "id", "kind")
