"""A stored text index: postings in segments, pruned by term, in versions that readers pin.

``<path>/postings/segment=<name>/bucket=<n>`` holds (key, term, tf, positions, doc_len) sorted by term, ``lengths`` a row for each
text and ``deleted`` marks that count for segments before them. A segment has as many buckets of terms as its size asks for, and its
files are dealt by ranges of (bucket, term, key): a frequent term is written by many tasks. A question reads only
the buckets and terms it asks for: they are literals in the plan, which prune folders and row groups.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.functions.text import index_tokens
from citeline.operators import segments as S

#: Terms of a segment's bucket, repeats included; a segment has a power of two of buckets, this many at most.
BUCKET_TOKENS, MAX_BUCKETS = 250_000, 4_096
FOLDERS = ("postings", "lengths", "deleted")


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class TextIndex:
    """A reader of one version of the index at ``snapshot.path``."""

    spark: SparkSession
    snapshot: S.Snapshot
    key: str = "doc_id"

    def _table(self, folder: str, parts: list[dict]) -> DataFrame:
        base = f"{self.snapshot.path}/{folder}"
        return self.spark.read.option("basePath", base).parquet(*(f"{base}/segment={p['name']}" for p in parts))

    def _live(self, rows: DataFrame, parts: list[dict]) -> DataFrame:
        """Without rows that a later mark deletes."""
        marks = [m for m in self.snapshot.of("deleted") if m["order"] > min(p["order"] for p in parts)]
        if not marks:
            return rows.drop("segment")
        orders = F.create_map(*(F.lit(x) for p in parts for x in (p["name"], p["order"])))
        late = reduce(DataFrame.unionByName, (self._table("deleted", [m]).select(self.key, F.lit(m["order"]).alias("_gone")) for m in marks))
        both = rows.join(late.groupBy(self.key).agg(F.max("_gone").alias("_gone")), self.key, "left")
        return both.where(F.col("_gone").isNull() | (orders[F.col("segment")] > F.col("_gone"))).drop("_gone", "segment")

    def postings(self, terms: dict[str, int] | None = None) -> DataFrame | None:
        """(key, term, tf, positions, doc_len) of live texts; with ``terms`` (each with its hash) those alone are read. None without any."""
        parts = [p for p in self.snapshot.of("texts") if p["tokens"]]
        if not parts:
            return None
        rows = self._table("postings", parts)
        if terms is not None:
            sizes = sorted({p["buckets"] for p in parts})
            ours = lambda b: F.col("bucket").isin(sorted({h % b for h in terms.values()}))
            of = lambda b: F.col("segment").isin([p["name"] for p in parts if p["buckets"] == b])
            rows = rows.where(ours(sizes[0]) if len(sizes) == 1 else reduce(lambda x, y: x | y, (of(b) & ours(b) for b in sizes)))
            rows = rows.where(F.col("term").isin(sorted(terms)))
        return self._live(rows.drop("bucket"), parts)

    def lengths(self) -> DataFrame | None:
        """(key, doc_len) of live texts, those without words too."""
        parts = self.snapshot.of("texts")
        return self._live(self._table("lengths", parts), parts) if parts else None

    def statistics(self) -> tuple[int, float | None]:
        """(texts, mean length): as committed where nothing is deleted, else counted."""
        parts = self.snapshot.of("texts")
        if not parts:
            return 0, None
        if not self.snapshot.of("deleted"):
            n, tokens = sum(p["rows"] for p in parts), sum(p["tokens"] for p in parts)
            return n, tokens / n if n else None
        return tuple(self.lengths().agg(F.count(F.lit(1)), F.avg("doc_len")).first())


def index_read(spark: SparkSession, path: str, key: str = "doc_id", version: int | None = None) -> TextIndex:
    """The index as it is now, or in a given version; later appends, deletions and compactions do not change it."""
    return TextIndex(spark, S.snapshot(spark, path, version), key)


def buckets_for(tokens: int, each: int = BUCKET_TOKENS) -> int:
    return min(MAX_BUCKETS, 1 << max(0, -(-tokens // each) - 1).bit_length())


def _write(rows: DataFrame, path: str, name: str, key: str, grouped: bool) -> None:
    """Postings of a segment; occurrences are grouped where the ranges put them, with no further shuffle."""
    dealt = rows.repartitionByRange("bucket", "term", key)
    if grouped:
        dealt = dealt.groupBy("bucket", "term", key, "doc_len").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    columns = ["bucket", key, "term", "tf", "positions", "doc_len"]
    dealt.select(*columns).sortWithinPartitions("bucket", "term", key).write.partitionBy("bucket").parquet(f"{path}/postings/segment={name}")


def _lengths(spark: SparkSession, path: str, name: str) -> tuple[int, int]:
    held = spark.read.parquet(f"{path}/lengths/segment={name}").agg(F.count(F.lit(1)), F.sum(F.col("doc_len").cast("long"))).first()
    return held[0], held[1] or 0


def index_append(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", batch: str | None = None, bucket_tokens: int = BUCKET_TOKENS) -> S.Snapshot:
    """Write texts as a new segment and commit it; a ``batch`` that was committed before is not written again."""
    spark = docs.sparkSession
    if batch is not None and S.has_batch(S.snapshot(spark, path).segments, batch):
        return S.snapshot(spark, path)
    name = uuid.uuid4().hex
    words = docs.select(key, F.coalesce(index_tokens(F.col(text)), F.array().cast("array<string>")).alias("w"))
    words.select(key, F.size("w").alias("doc_len")).write.parquet(f"{path}/lengths/segment={name}")
    rows, tokens = _lengths(spark, path, name)
    buckets = buckets_for(tokens, bucket_tokens)
    if tokens:
        each = words.select(key, F.size("w").alias("doc_len"), F.posexplode("w").alias("pos", "term")).withColumn("bucket", bucket_of(buckets))
        _write(each, path, name, key, True)
    return S.commit(spark, path, S.added("texts", name, batch, rows=rows, tokens=tokens, buckets=buckets))


def index_delete(keys: DataFrame, path: str, key: str = "doc_id", batch: str | None = None) -> S.Snapshot:
    """Mark texts as deleted in all segments so far. An update is a delete and an append."""
    spark = keys.sparkSession
    if batch is not None and S.has_batch(S.snapshot(spark, path).segments, batch):
        return S.snapshot(spark, path)
    name = uuid.uuid4().hex
    keys.select(key).distinct().write.parquet(f"{path}/deleted/segment={name}")
    return S.commit(spark, path, S.added("deleted", name, batch))


def index_compact(spark: SparkSession, path: str, key: str = "doc_id", bucket_tokens: int = BUCKET_TOKENS) -> S.Snapshot:
    """One segment instead of all there are, without what is deleted; what others commit meanwhile stays as it is."""
    held = index_read(spark, path, key)
    if len(held.snapshot.segments) < 2 or not held.snapshot.of("texts"):
        return held.snapshot
    name = uuid.uuid4().hex
    held.lengths().write.parquet(f"{path}/lengths/segment={name}")
    rows, tokens = _lengths(spark, path, name)
    buckets = buckets_for(tokens, bucket_tokens)
    if tokens:
        _write(held.postings().withColumn("bucket", bucket_of(buckets)), path, name, key, False)
    old = {s["name"] for s in held.snapshot.segments}

    def change(segments: list[dict]) -> list[dict] | None:
        gone = [s for s in segments if s["name"] in old]
        if len(gone) < len(old):
            return None  # another compaction was first
        batches = sorted({b for s in gone for b in s["batches"]})
        one = {"name": name, "kind": "texts", "order": max(s["order"] for s in gone), "batches": batches, "rows": rows, "tokens": tokens, "buckets": buckets}
        return [one, *(s for s in segments if s["name"] not in old)]

    return S.commit(spark, path, change)


def index_vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete what the last ``keep`` versions do not use, leftovers of killed writers too."""
    return S.vacuum(spark, path, FOLDERS, keep)
