"""Batch sources and sinks: uploads as binary files, JSON documents, prompts, report-partitioned tables."""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.operators.catalog import text_sink
from citeline.operators.segments import hadoop
from citeline.streaming.intake import MAGIC, MAX_BYTES


def checked_uploads(spark: SparkSession, path: str, magic: bytes = MAGIC, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length, sha256, problem) of a folder's files: problem is null, ``empty``, ``too large`` or ``wrong type``.

    Spark reads no empty files, so those are listed by the folder's store.
    """
    files = spark.read.format("binaryFile").load(path)
    wrong = F.substring("content", 1, len(magic)) != F.lit(magic)
    problem = F.when(F.col("length") > max_bytes, "too large").when(wrong, "wrong type")
    checked = files.select("path", "length", F.sha2("content", 256).alias("sha256"), problem.alias("problem"))
    fs, at = hadoop(spark, path)
    empty = [(f.getPath().toString(), 0, hashlib.sha256().hexdigest(), "empty") for f in fs.listStatus(at) if f.isFile() and f.getLen() == 0]
    seen = checked.where("length > 0")
    return seen.unionByName(spark.createDataFrame(empty, "path string, length long, sha256 string, problem string")) if empty else seen


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents or arrays of records with a declared schema; a file is one task, so large tables belong in JSON lines."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines, nulls kept."""
    text_sink(rows).write.mode("append").text(path)


def append_by_report(rows: DataFrame, path: str, report: str = "report_id") -> None:
    """Append to a table partitioned by report, so that scans of a report read its folder alone."""
    rows.write.mode("append").partitionBy(report).parquet(path)


def replace_reports(rows: DataFrame, path: str, report: str = "report_id") -> None:
    """Replace the partitions of the reports in ``rows`` and leave the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(report).parquet(path)


@lru_cache
def load_prompt(path: str) -> str:
    """A prompt text, read once on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()
