"""Indexing from a stream, each batch once: a batch's segment carries the stream's name and the batch's number."""

from __future__ import annotations

from pyspark.sql import DataFrame

from citeline.operators.text_index import index_append, index_delete
from citeline.operators.vector_index import vectors_add
from citeline.streaming.intake import ingest


def index_batch(rows: DataFrame, batch: int, path: str, stream: str, key: str = "doc_id", text: str = "text", update: bool = False) -> None:
    """One batch as one segment; a batch that is run again, after a failure before the checkpoint, changes nothing.

    With ``update`` older texts of the batch's keys are deleted first, by marks of their own, so both steps can be replayed.
    """
    if update:
        index_delete(rows, path, key, batch=f"{stream}/{batch}/deleted")
    index_append(rows, path, key, text, batch=f"{stream}/{batch}")


def index_stream(rows: DataFrame, path: str, checkpoint: str, stream: str, key: str = "doc_id", text: str = "text", update: bool = False) -> None:
    """Append all that a stream has now to a stored text index; ``stream`` names it in the index, one name a checkpoint."""
    ingest(rows, checkpoint, lambda df, n: index_batch(df, n, path, stream, key, text, update))


def vector_stream(rows: DataFrame, path: str, checkpoint: str, stream: str, key: str = "chunk_id", report: str = "report_id") -> None:
    """The same for a stored vector index of rows (key, report, embedding)."""
    ingest(rows, checkpoint, lambda df, n: vectors_add(df, path, key, report, batch=f"{stream}/{n}"))
