"""Streaming intake: new files or rows, once per content, in available-now batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length long, content binary"
MAGIC, MAX_BYTES = b"%PDF-", 100 * 1024 * 1024


def uploads(spark: SparkSession, path: str, pattern: str = "*", magic: bytes = MAGIC, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A stream of (path, content, sha256) of acceptable files: right first bytes, not empty, not too large."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(path)
    return files.where((F.length("content") <= max_bytes) & (F.substring("content", 1, len(magic)) == F.lit(magic))).select("path", "content", F.sha2("content", 256).alias("sha256"))


def once_per_content(stream: DataFrame, digest: str = "sha256") -> DataFrame:
    """A stream without copies of contents seen before; the state holds digests only."""
    return stream.dropDuplicates([digest])


def ingest(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Run ``batch`` over all that is there now; a restart goes on where the checkpoint stands."""
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
