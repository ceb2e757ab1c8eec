"""A stored vector index: vectors and short codes by report, deletion marks, a first pass over codes and exact re-ranking.

``<path>/vectors/segment=<name>/report=<id>`` holds (key, vector), ``codes`` (key, code, turn, same): one signed byte for each dimension of
the unit vector, a quarter of the bytes of floats, the angle between the vector and its code, and a hash that copies of a vector share.
A search multiplies the codes with its queries and ranks the ``k * wide`` best of each by exact cosine. The last of the first ``k`` is
what a vector must reach: a second pass over codes finds every vector whose angle to the query can be as small, since it is that of its code
less the turn at least, and these are ranked by exact cosine. So the result is that of all vectors. Segments are versions as in ``segments``: readers pin one.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from citeline.operators import segments as S
from citeline.operators.retrieval import QUERY_BLOCK, blocks_of, cosine, dot, norm, top_k
from citeline.session import cut

FOLDERS, LEVELS, WIDE = ("vectors", "codes", "deleted"), 127, 4
#: Queries that meet a batch of codes at once.
ASKED = 256


def code_of(vector: Column) -> Column:
    """One signed byte a dimension of the unit vector; zero vectors, and those with no finite length, have zeros."""
    unit = lambda size: F.transform(vector, lambda x: F.when((size > 0) & (size < float("inf")), F.round(x.cast("double") / size * LEVELS)).otherwise(0.0).cast("tinyint"))
    return F.transform(F.array(norm(vector)), unit)[0]  # the length is the variable of a lambda, so that it is found once


def turn_of(vector: Column, code: Column) -> Column:
    """The angle between a vector and its code: 0 for a zero vector, whose score is 0 like its code's, and a half turn where a code tells nothing."""
    told = F.least(dot(vector, code) / (norm(vector) * norm(code)), F.lit(1.0))
    return F.when(norm(vector) == 0, 0.0).when((norm(vector) < float("inf")) & (norm(code) > 0), F.acos(told)).otherwise(math.pi)


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    snapshot: S.Snapshot
    key: str = "chunk_id"
    report: str = "report_id"

    def _live(self, folder: str, reports: list | None) -> DataFrame | None:
        parts = [p for p in self.snapshot.of("vectors") if p["rows"]]
        if not parts:
            return None
        base = f"{self.snapshot.path}/{folder}"
        rows = self.spark.read.option("basePath", base).parquet(*(f"{base}/segment={p['name']}" for p in parts))
        if reports is not None:
            rows = rows.where(F.col(self.report).isin(reports))  # a partition filter: only their folders are read
        marks = [m for m in self.snapshot.of("deleted") if m["order"] > min(p["order"] for p in parts)]
        if not marks:
            return rows.drop("segment")
        orders = F.create_map(*(F.lit(x) for p in parts for x in (p["name"], p["order"])))
        at = f"{self.snapshot.path}/deleted"
        late = reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{at}/segment={m['name']}").select(self.key, F.lit(m["order"]).alias("_gone")) for m in marks))
        both = rows.join(late.groupBy(self.key).agg(F.max("_gone").alias("_gone")), self.key, "left")
        return both.where(F.col("_gone").isNull() | (orders[F.col("segment")] > F.col("_gone"))).drop("_gone", "segment")

    def vectors(self, reports: list | None = None) -> DataFrame | None:
        """(key, embedding, report) of live vectors; None if the index holds none."""
        return self._live("vectors", reports)

    @property
    def size(self) -> int:
        live = self._live("codes", None)
        return live.count() if live is not None else 0

    def search(self, queries: DataFrame, k: int, query: str = "query_id", reports: list | None = None, wide: int = WIDE) -> DataFrame:
        """(query, key, score, rank): the first ``k`` by exact cosine, to nine places, and key.

        ``reports`` leaves their vectors only. Queries (query, vector) are taken in blocks against all codes; ``wide`` decides the cost alone.
        """
        live, kinds = self._live("codes", reports), {f.name: f.dataType for f in queries.schema}
        blocks = blocks_of(queries.select(query, "vector"), query, QUERY_BLOCK) if live is not None and not queries.isEmpty() else []
        if not blocks:
            return self.spark.createDataFrame([], f"{query} {kinds[query].simpleString()}, {self.key} long, score double, rank int")
        order = lambda s: [F.round(s, 9).desc(), F.col(self.key)]

        def ranked(some: DataFrame) -> DataFrame:
            exact = some.select(query, self.key).distinct().join(self.vectors(reports).select(self.key, "embedding"), self.key).join(queries.select(query, "vector"), query)
            return top_k(exact.select(query, self.key, cosine(F.col("vector"), F.col("embedding")).alias("score")), [query], order("score"), k)

        found = reduce(DataFrame.unionByName, (first_pass(live, block, self.key, query, k * wide) for block in blocks))
        least = cut(ranked(top_k(found, [query], order("alike"), k * wide, "_r")).where(F.col("rank") == k).select(query, F.col("score").alias("least")))
        near = reduce(DataFrame.unionByName, (within(live, block.join(least, query, "left"), self.key, query, k) for block in blocks))
        # Copies have the same score, so of those of one vector the first k keys are enough.
        return ranked(top_k(near, [query, "same", "turn"], [F.col(self.key)], k, "_r"))


def first_pass(codes: DataFrame, block: DataFrame, key: str, query: str, keep: int) -> DataFrame:
    """(query, key, alike) of what each task holds among the first ``keep`` of each of at most QUERY_BLOCK queries."""
    held = block.toArrow()
    names, asked = held[query], np.array(held["vector"].to_pylist(), np.float32).reshape(held.num_rows, -1)
    size = np.linalg.norm(asked, axis=1, keepdims=True)
    asked = asked / np.where(size > 0, size, 1)
    sent = codes.sparkSession.sparkContext.broadcast((names.combine_chunks(), asked))
    kind = to_arrow_type(codes.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = sent.value
        best = [(np.empty(0, np.float32), pa.array([], kind))] * len(asked)
        for b in batches:
            if not b.num_rows or not len(asked):
                continue
            flat = b.column(1).flatten().to_numpy().astype(np.float32).reshape(b.num_rows, -1)
            alike = asked @ flat.T / LEVELS
            for i, row in enumerate(alike):
                some = np.argpartition(-row, keep)[:keep] if len(row) > keep else np.arange(len(row))
                score, ids = np.concatenate([best[i][0], row[some]]), pa.concat_arrays([best[i][1], b.column(0).take(pa.array(some))])
                if len(score) > keep:
                    stay = np.argpartition(-score, keep)[:keep]
                    score, ids = score[stay], ids.take(pa.array(stay))
                best[i] = (score, ids)
        for i, (score, ids) in enumerate(best):
            if len(score):
                yield pa.record_batch([names.take(pa.array([i] * len(score))), ids, pa.array(score, pa.float64())], [query, key, "alike"])

    kinds = f"{query} {block.schema[query].dataType.simpleString()}, {key} {codes.schema[key].dataType.simpleString()}, alike double"
    return codes.select(key, "code").mapInArrow(run, kinds)


def within(codes: DataFrame, block: DataFrame, key: str, query: str, k: int) -> DataFrame:
    """(query, key, same, turn) of every vector that can score ``least`` (to nine places) of a query (query, vector, least), whatever its code leaves open.

    A null ``least`` takes all vectors. Of copies in a batch, which have one score, the first ``k`` keys are passed on.
    """
    held = block.toArrow()
    names, asked = held[query].combine_chunks(), np.array(held["vector"].to_pylist(), np.float64).reshape(held.num_rows, -1)
    size = np.linalg.norm(asked, axis=1, keepdims=True)
    asked = (asked / np.where(size > 0, size, 1)).astype(np.float32)
    least = held["least"].to_numpy().astype(np.float64)
    angle = np.where(np.isnan(least), np.inf, np.arccos(np.clip(np.nan_to_num(least) - 2e-9, -1, 1)))
    sent = codes.sparkSession.sparkContext.broadcast((names, asked, angle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, angle = sent.value
        for b in batches:
            b = b.take(first_copies(b, k))
            flat = b.column(1).flatten().to_numpy().astype(np.float32).reshape(b.num_rows, -1)
            turn, length = b.column(2).to_numpy(), np.linalg.norm(flat, axis=1)
            flat /= np.where(length > 0, length, 1)[:, None]
            slack = 1e-6 + 2 * flat.shape[1] * np.finfo(np.float32).eps  # what rounding takes from a product of floats
            for at in range(0, len(asked), ASKED):
                alike, far = asked[at : at + ASKED] @ flat.T, angle[at : at + ASKED, None] + turn
                i, j = np.nonzero((alike >= np.cos(np.minimum(far, math.pi)) - slack) | (far >= math.pi))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i + at)), *(b.column(c).take(pa.array(j)) for c in (0, 3, 2))], names=[query, key, "same", "turn"])

    kinds = f"{query} {block.schema[query].dataType.simpleString()}, {key} {codes.schema[key].dataType.simpleString()}, same long, turn double"
    return codes.select(key, "code", "turn", "same").mapInArrow(run, kinds)


def first_copies(batch: pa.RecordBatch, k: int) -> pa.Array:
    """Places of the rows (key, code, turn, same) that are among the first ``k`` keys of a vector's copies."""
    rows = pa.table({"key": batch.column(0), "turn": batch.column(2), "same": batch.column(3)})
    order = pc.sort_indices(rows, [(c, "ascending") for c in ("same", "turn", "key")]).to_numpy()
    turn, same = (rows[c].to_numpy()[order] for c in ("turn", "same"))
    fresh = np.concatenate([[True], (same[1:] != same[:-1]) | (turn[1:] != turn[:-1])])[: len(order)]
    place = np.arange(len(order))
    return pa.array(order[place - np.maximum.accumulate(np.where(fresh, place, 0)) < k])


def vectors_read(spark: SparkSession, path: str, key: str = "chunk_id", report: str = "report_id", version: int | None = None) -> VectorIndex:
    return VectorIndex(spark, S.snapshot(spark, path, version), key, report)


def vectors_add(rows: DataFrame, path: str, key: str = "chunk_id", report: str = "report_id", vector: str = "embedding", batch: str | None = None) -> S.Snapshot:
    """Add (key, report, vector); a vector of a key that is there already is a further one: remove that first. Nulls are left out."""
    spark = rows.sparkSession
    if batch is not None and S.has_batch(S.snapshot(spark, path).segments, batch):
        return S.snapshot(spark, path)
    name = uuid.uuid4().hex
    given = rows.where(F.col(vector).isNotNull()).select(key, report, F.col(vector).alias("embedding"))
    given.write.partitionBy(report).parquet(f"{path}/vectors/segment={name}")
    n = 0
    if any(x.startswith(f"{report}=") for x in S.names(spark, f"{path}/vectors/segment={name}")):
        held = spark.read.parquet(f"{path}/vectors/segment={name}")
        coded = held.select(key, report, "embedding", code_of(F.col("embedding")).alias("code"), F.xxhash64("embedding").alias("same"))
        coded.select(key, report, "code", turn_of(F.col("embedding"), F.col("code")).alias("turn"), "same").write.partitionBy(report).parquet(f"{path}/codes/segment={name}")
        n = held.count()
    return S.commit(spark, path, S.added("vectors", name, batch, rows=n))


def vectors_remove(keys: DataFrame, path: str, key: str = "chunk_id", batch: str | None = None) -> S.Snapshot:
    """Remove keys from all segments so far; those that are not there are ignored."""
    spark, name = keys.sparkSession, uuid.uuid4().hex
    keys.select(key).distinct().write.parquet(f"{path}/deleted/segment={name}")
    return S.commit(spark, path, S.added("deleted", name, batch))
