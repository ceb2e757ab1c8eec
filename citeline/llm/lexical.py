"""Reversed ranked search: documents stream through an inverted index over the items' terms.

The items' terms are few and make the index, which is broadcast; a task keeps a bounded heap for each item while
documents pass, and the heaps are merged: those of some tasks first, then those. Statistics (documents, terms, document
frequencies) are counted over all documents in one pass before. Scores are integers.

The index is broadcast in blocks of at most ``block_terms`` (item, term) pairs, so a larger table of items takes more passes
over the documents, not more memory; an item is never split, so its own distinct terms must fit.

Defined cases: null texts have no terms, and a document or item without terms is in no result; rows of one item are
one item that holds the terms of all; repeated documents count and are ranked as often as they come; equal scores are ranked by
document, one without a key last; a very long text is read whole; empty tables give no rows; only the named columns are read, so
others cannot clash.
"""

from __future__ import annotations

import math
import re
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from citeline.llm.common import cut, small_batches

KEEP, BLOCK_TERMS = 10, 200_000
#: What a term is, the letters made small, and the constants of the score.
TERM, CAPITALS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
UNIT, SATURATION, PERCENT, LENGTH_SHARE = 1_000_000_000, 8, 100, 90


def small_letters(text: str):
    """A column of whole texts with A to Z made small, null as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), CAPITALS, CAPITALS.lower())


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term), each once."""
    return items.select(F.col(item).alias("item"), F.explode(F.regexp_extract_all(small_letters(text), F.lit(TERM), F.lit(0))).alias("term")).distinct()


def statistics(docs: DataFrame, text: str, asked) -> tuple[int, int, dict[str, int]]:
    """(documents with a term, all terms with repeats, documents of each asked term): one row a task and term is shuffled.

    ``asked`` is a broadcast set of terms, which bounds the rows that come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, wanted, df, docs_, terms = re.compile(TERM).findall, asked.value, Counter(), 0, 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = find(t)
                docs_ += bool(words)
                terms += len(words)
                df.update(wanted.intersection(words))
        yield pa.record_batch([pa.array([None, *df], pa.string()), pa.array([docs_, *df.values()], pa.int64()), pa.array([terms, *[0] * len(df)], pa.int64())], ["term", "n", "l"])

    rows = docs.select(small_letters(text).alias("t")).mapInArrow(count, "term string, n long, l long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).collect()
    all_ = next((r for r in rows if r["term"] is None), None)
    return (all_["n"], all_["l"], {r["term"]: r["n"] for r in rows if r["term"] is not None}) if all_ else (0, 0, {})


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Heaps:
    """The best ``keep`` documents of each item; a worse one than the last of a full heap does not enter."""

    def __init__(self, items: int, keep: int):
        self.keep, self.best, self.floor = keep, [[] for _ in range(items)], np.ones(items, np.int64)

    def offer(self, scores: np.ndarray, doc) -> None:
        for i in np.nonzero(scores >= self.floor)[0]:
            heap = self.best[i]
            insort(heap, (-int(scores[i]), doc is None, doc if doc is not None else 0))
            if len(heap) > self.keep:
                heap.pop()
            if len(heap) == self.keep:
                self.floor[i] = max(1, -heap[-1][0])


def block_scores(docs: DataFrame, key: str, text: str, index, n_docs: int, n_terms: int, items: int, keep: int) -> DataFrame:
    """(i, doc, score): what each task's heaps hold at its end. ``index`` is a broadcast term -> (weight, item numbers)."""
    called = docs.select(F.col(key).alias("doc"), small_letters(text).alias("t"))
    kind = to_arrow_type(called.schema["doc"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, terms, heaps = re.compile(TERM).findall, index.value, Heaps(items, keep)
        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = find(t)
                met = [(x, tf) for w, tf in Counter(words).items() if (x := terms.get(w)) is not None]
                if not met:
                    continue
                m = PERCENT - LENGTH_SHARE + (LENGTH_SHARE * len(words) * n_docs) // n_terms
                part = [x[0] * ((UNIT * tf) // (1000 * tf + SATURATION * m)) for x, tf in met]
                scores = np.zeros(items, np.int64)
                np.add.at(scores, np.concatenate([x[1] for x, _ in met]), np.repeat(np.array(part, np.int64), [len(x[1]) for x, _ in met]))
                heaps.offer(scores, doc)
        rows = [(i, None if gone else doc, -score) for i, heap in enumerate(heaps.best) for score, gone, doc in heap]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], ["i", "doc", "score"])

    return called.mapInArrow(run, f"i int, doc {called.schema['doc'].dataType.simpleString()}, score long")


def merged(found: DataFrame, keep: int, fan_in: int = 64) -> DataFrame:
    """The first ``keep`` of each item with ``rank``: heaps of ``fan_in`` groups of tasks are merged apart, so that no task meets all of an item's."""
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    first = lambda df, by, name: df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= keep)
    some = first(found.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(fan_in))), ["i", "group"], "_r").drop("_r", "group")
    return first(some, ["i"], "rank")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", keep: int = KEEP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, doc, score) under the names of both keys: the ``keep`` highest-scoring documents of every item."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    small_batches(spark)
    pairs = cut(item_terms(items, item, item_text))
    blocks = -(-pairs.count() // block_terms)
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1))))
    found = None
    for b in range(blocks):
        held = pairs.where(F.col("block") == b).groupBy("item").agg(F.collect_list("term").alias("terms")).collect()
        names, listed = [r["item"] for r in held], {}
        for i, r in enumerate(held):
            for t in r["terms"]:
                listed.setdefault(t, []).append(i)
        n_docs, n_terms, df = statistics(docs, text, asked := context.broadcast(frozenset(listed)))
        asked.unpersist()
        index = context.broadcast({t: (weight(n_docs, df[t]), np.array(i, np.int64)) for t, i in listed.items() if t in df})
        best = merged(block_scores(docs, key, text, index, n_docs, n_terms, len(names), keep), keep)
        called = spark.createDataFrame(list(enumerate(names)), f"i int, item {items.schema[item].dataType.simpleString()}")
        part = cut(best.join(F.broadcast(called), "i").select("item", "rank", "doc", "score"))  # keep rows an item
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = pairs.join(docs.select(F.col(key).alias("doc")).limit(0), F.lit(False)).select("item", F.lit(0).alias("rank"), "doc", F.lit(0).cast("long").alias("score"))
    return found.select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")


#: The contract in DuckDB.
_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS w FROM documents),
n AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
e AS (SELECT r, doc_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM e GROUP BY term), n),
p AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * dl * n) // l))) AS s FROM e JOIN f USING (term), n),
s AS (SELECT item_id, r, doc_id, CAST(sum(s) AS BIGINT) AS score FROM q JOIN p USING (term) GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s) WHERE rank <= 10"""
