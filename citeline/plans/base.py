"""Registration of queries with their DuckDB oracles, and the views that several plans share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a plan (spark, sf_dir) -> DataFrame under its function's name."""

    def add(plan):
        QUERIES[plan.__name__] = plan
        if oracle:
            ORACLES[plan.__name__] = oracle
        return plan

    return add


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document as paragraphs: (doc_id, pos, para, page), five lines to a page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    exploded = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "para"))
    return exploded.withColumn("page", F.expr("pos div 5 + 1").cast("int"))


#: The same view for DuckDB.
LINES = """lines AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS para, CAST((i - 1) // 5 + 1 AS INTEGER) AS page
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, range(1, len(parts) + 1) r(i))"""
