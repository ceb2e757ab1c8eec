"""State of reports, extractions and messages as immutable tables: listings, intake, updates, deletes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeline.session import cut

#: Labels of goal categories.
CATEGORY_LABELS = {
    "climate": "Climate", "energy": "Energy", "circularity_waste": "Circularity & waste", "water": "Water",
    "biodiversity": "Biodiversity", "social_people": "Social & people", "governance": "Governance", "other": "Other",
}
#: Where a stage's progress begins and ends.
STAGES = {"parse": (0.0, 0.3), "chunk": (0.3, 0.5), "embed": (0.5, 0.8), "extract": (0.8, 1.0)}


def newest_first(reports: DataFrame) -> DataFrame:
    return reports.orderBy(F.col("created_at").desc(), F.col("id").desc())


def ready(reports: DataFrame) -> DataFrame:
    return reports.where("status = 'ready'").orderBy("created_at", "id")


def lookup(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the given keys; the batch form of a point lookup."""
    return rows.join(keys, key, "left_semi")


def with_ids(rows: DataFrame, order: list[str], after: int = 0, key: str = "id") -> DataFrame:
    """New rows with ids that follow ``after`` in a stated order; ids are never reused.

    Rows are sorted by ranges and numbered within each; a range starts after the counts of those before it.
    """
    placed = cut(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    # One row for each task of the sort.
    counts = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_p", before.alias("_b")))
    return placed.withColumn("_p", part).join(starts, "_p").withColumn(key, F.col("_b") + place + F.lit(after + 1)).drop("_p", "_b", "_m")


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The current state from update events: the last one of each key counts."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("s")).select(key, "s.*")


def repaired(reports: DataFrame, error: str = "Interrupted by a restart") -> DataFrame:
    """At start, whatever was being processed has failed."""
    stuck = F.col("status") == "processing"
    return reports.withColumns({"status": F.when(stuck, "failed").otherwise(F.col("status")), "error": F.when(stuck, error).otherwise(F.col("error"))})


def without(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows of reports that are not deleted; the same for chunks, extractions and vectors."""
    return rows.join(deleted, key, "left_anti")


def reset(reports: DataFrame, retried: DataFrame) -> DataFrame:
    """Failed reports to retry start anew; the report row stays."""
    again = reports.join(retried.select("id").withColumn("_again", F.lit(True)), "id", "left")
    on = F.coalesce("_again", F.lit(False)) & (F.col("status") == "failed")
    fresh = {"status": F.lit("processing"), "stage": F.lit(None).cast("string"), "progress": F.lit(0.0), "error": F.lit(None).cast("string")}
    return again.withColumns({c: F.when(on, v).otherwise(F.col(c)) for c, v in fresh.items()}).drop("_again")


def first_copies(uploads: DataFrame, digest: str = "sha256", order: str = "arrival") -> DataFrame:
    """One row per content, the first to arrive."""
    return uploads.withColumn("_n", F.row_number().over(Window.partitionBy(digest).orderBy(order))).where("_n = 1").drop("_n")


def intake(uploads: DataFrame, reports: DataFrame) -> DataFrame:
    """Uploads (sha256, ...) with ``action`` (existing, retry, create), ``report_id`` and ``needs_ingestion``."""
    known = reports.select("sha256", F.col("id").alias("report_id"), F.col("status").alias("_s"))
    action = F.when(F.col("_s").isin("ready", "processing"), "existing").when(F.col("_s") == "failed", "retry").otherwise("create")
    return uploads.join(known, "sha256", "left").withColumn("action", action).withColumn("needs_ingestion", F.col("action") != "existing").drop("_s")


def extraction_counts(reports: DataFrame, extractions: DataFrame) -> DataFrame:
    """Reports with counts by kind; zero for reports without any and for those not ready."""
    n = extractions.groupBy("report_id").agg(F.count_if(F.col("kind") == "fte").alias("fte"), F.count_if(F.col("kind") == "sustainability_goal").alias("goals"))
    joined = reports.join(n, reports["id"] == n["report_id"], "left")
    zero = lambda c: F.when(F.col("status") == "ready", F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    return joined.select(*reports.columns, zero("fte"), zero("goals"))


def extracted_cell(status: Column, fte: Column, goals: Column) -> Column:
    return F.when(status != "ready", "—").otherwise(F.concat(F.when(fte > 0, "FTE").otherwise("no FTE"), F.lit(", "), goals.cast("string"), F.lit(" goals")))


def category_label(category: Column) -> Column:
    """The label of a category, or the raw value."""
    return F.coalesce(*(F.when(category == k, v) for k, v in CATEGORY_LABELS.items()), category)


def progress(stage: Column, done: Column, total: Column) -> Column:
    """Overall progress of a stage that has done so much of its total."""
    share = F.coalesce(F.try_divide(done, total), F.lit(1.0))
    return F.coalesce(*(F.when(stage == s, a + (b - a) * share) for s, (a, b) in STAGES.items()))


def sorted_by(rows: DataFrame, column: str, descending: bool = False, tie: str = "id") -> DataFrame:
    """Rows sorted as a list shows them: nulls last both ways."""
    c = F.col(column)
    return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie)


def filtered(rows: DataFrame, category: str | None = None, year: str | None = None) -> DataFrame:
    """Rows of a category and a year; None means all, the empty year means none given."""
    if category is not None:
        rows = rows.where(F.col("category") == category)
    return rows if year is None else rows.where(F.coalesce(F.col("target_year").cast("string"), F.lit("")) == year)


def _decode(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))


def _encode(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def blob_to_vector(blob: Column) -> Column:
    """Little-endian float32 bytes as array<float>."""
    return F.pandas_udf(_decode, "array<float>")(blob)


def vector_to_blob(vector: Column) -> Column:
    return F.pandas_udf(_encode, "binary")(vector)


def text_sink(rows: DataFrame) -> DataFrame:
    """One JSON line per row."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


def pending(chunks: DataFrame) -> DataFrame:
    """Chunks that still lack a vector."""
    return chunks.where("embedding is null")


def message_payload(messages: DataFrame) -> DataFrame:
    """Messages with their citations decoded; null where there are none."""
    kind = "array<struct<source_id:string,quote:string>>"
    return messages.withColumn("citations", F.from_json(F.nullif("citations", F.lit("")), kind, {"mode": "FAILFAST"}))


def report_payload(counted: DataFrame) -> DataFrame:
    """(id, payload): a report as JSON with its counts by kind."""
    counts = F.struct("fte", F.col("goals").alias("sustainability_goal")).alias("extraction_counts")
    return counted.select("id", F.to_json(F.struct("id", "company", "status", "page_count", counts), {"ignoreNullFields": "false"}).alias("payload"))


def of_report(rows: DataFrame, report: str, order: list[str], key: str = "report_id") -> DataFrame:
    """The chunks or extractions of one report in a stated order; None means all reports, in order of report first."""
    return rows.orderBy(key, *order) if report is None else rows.where(F.col(key) == report).orderBy(*order)


def extraction_payload(rows: DataFrame, schema: str, column: str = "payload") -> DataFrame:
    """Extractions with their stored JSON decoded by a declared schema; what is no such JSON fails the job."""
    return rows.withColumn(column, F.from_json(column, schema, {"mode": "FAILFAST"}))


def choices(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, and the sorted distinct values of each column): what a filter offers; nulls are not offered.

    Values are made distinct before they are gathered, so a list is no longer than its distinct values.
    """
    found = rows.select(by).distinct()
    for c in columns:
        listed = rows.where(F.col(c).isNotNull()).select(by, c).distinct().groupBy(by).agg(F.array_sort(F.collect_list(c)).alias(c))
        found = found.join(listed, by, "left").withColumn(c, F.coalesce(c, F.array().cast(f"array<{rows.schema[c].dataType.simpleString()}>")))
    return found


def busy(reports: DataFrame, by: str) -> DataFrame:
    """(by, busy): whether any report of a group is being processed."""
    return reports.groupBy(by).agg(F.bool_or(F.col("status") == "processing").alias("busy"))


def embedded(chunks: DataFrame) -> DataFrame:
    """Chunks that have a vector: what a vector index loads."""
    return chunks.where("embedding is not null")


def cleared(messages: DataFrame, conversation: str | None = None, key: str = "conversation_id") -> DataFrame:
    """Messages without those of one conversation; None clears all."""
    return messages.limit(0) if conversation is None else messages.where(~F.col(key).eqNullSafe(conversation))


def sorted_goals(goals: DataFrame) -> DataFrame:
    """Goals by the label of their category, then title, both as people read them, then year and page."""
    read = lambda c: F.collate(c, "UNICODE")
    return goals.orderBy(read(category_label(F.col("category"))), read(F.coalesce(F.col("title"), F.lit(""))), F.col("target_year").asc_nulls_last(), F.col("page").asc_nulls_last(), "id")


def chat_payload(results: DataFrame) -> DataFrame:
    """(turn_id, payload): a chat result (status, answer, caveats, citations, interpreted_as) as JSON, nulls kept."""
    fields = [c for c in results.columns if c != "turn_id"]
    return results.select("turn_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))


def now_iso(at: Column | None = None) -> Column:
    """A point in time, now by default, as ISO 8601 in UTC with microseconds."""
    at = F.current_timestamp() if at is None else at
    return F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def page_tasks(pages: DataFrame, size: int = 5, key: str = "doc_id", count: str = "page_count") -> DataFrame:
    """(key, first, last): ranges of pages to work on, ``size`` pages each; the last one of a document may be shorter."""
    starts = F.when(F.col(count) > 0, F.sequence(F.lit(1), F.col(count).cast("int"), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return pages.select(key, count, F.explode(starts).alias("first")).select(key, "first", F.least(F.col("first") + size - 1, F.col(count)).cast("int").alias("last"))
