"""Quality classification by an interpolated modified Kneser-Ney model of trusted text.

Method. Texts are read as n-grams of LENGTH real characters, with no fixed alphabet, so that what is counted grows
with the trusted text. All trusted texts are counted, pre-aggregated in each task; the shards of counts are joined by
context, order by order, with three discounts estimated from the counts of counts. Texts to score are packed into compressed
blocks; the distinct n-grams of the blocks meet the model in joins, and their probabilities return to the block's
texts; the mean gives the perplexity. A language's threshold is a high quantile of the perplexity of its trusted
texts, each scored by the model of the half that it is not in, widened by a slack; texts above it are rejected.

Defined cases: null and empty texts score as their end symbol alone; a null or unlabelled language takes the
quantile of all trusted texts; without any trusted text nothing is rejected; labels that contradict
each other, or call it toxic, do not make a text trusted; repeated rows stay repeated, copies get equal scores (ties are
accepted or rejected together, and one at the threshold is accepted); very long texts are read whole, portion by portion; an
empty table gives no rows; extra columns are ignored. N-grams of a block are told by 64-bit hashes; a block holds
fewer than 2^24 distinct ones, so two that meet are one in 10^5 blocks, and what is lost is one n-gram's probability there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from citeline.llm.common import cut, numbered, small_batches

#: Characters of an n-gram; what stands before and after a text.
LENGTH = 4
START, STOP = "\x02", "\x03"
#: Documents of a block that is scored at once, characters that are held as numbers at once, n-grams that a task adds up.
BLOCK, BLOCK_BYTES, CHARACTERS, HELD = 8000, 32 << 20, 1 << 19, 1 << 18
#: Texts of a block that are Python strings at once.
SLICE = 500
#: Bytes of input files for a task that packs blocks.
TASK_BYTES = 12 << 20
#: Models by number: of the texts outside the first half, of those outside the second, of all.
ALL = 2
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Trusted ids that are broadcast at most; beyond that the join shuffles.
BROADCAST_IDS = 4_000_000
#: Languages whose limits are broadcast at most; beyond that the join shuffles.
BROADCAST_LANGUAGES = 10_000


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(all windows of code points, places of the n-grams, their 64-bit hashes, how many each text has), one n-gram for each character and the end."""
    padded = [START * (LENGTH - 1) + (t or "").replace("\0", "\ufffd") + STOP for t in texts]
    flat = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), "<u4")
    ends = np.cumsum([len(t) for t in padded])
    valid = np.ones(len(flat), bool)
    for i in range(1, LENGTH):
        valid[ends - i] = False
    at = np.nonzero(valid)[0]
    return np.lib.stride_tricks.sliding_window_view(flat, LENGTH), at, hashes(flat)[at], [len(t) - LENGTH + 1 for t in padded]


def hashes(flat: np.ndarray) -> np.ndarray:
    """The hash of the n-gram that starts at each place (of no meaning at the last ones)."""
    wide = np.concatenate([flat.astype(np.uint64), np.zeros(LENGTH - 1, np.uint64)])
    out = sum(wide[i : len(flat) + i] * MIX[i] for i in range(LENGTH))
    return out ^ (out >> np.uint64(29))


def portions(texts: list[str | None]):
    """Runs of texts of about CHARACTERS characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= CHARACTERS:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def by_tag(batch: pa.RecordBatch):
    """(tag, texts) of a batch of (text, tag)."""
    tags = batch.column(1).to_numpy(zero_copy_only=False)
    for tag in np.unique(tags).tolist():
        yield tag, batch.column(0).filter(pa.array(tags == tag)).to_pylist()


def slices(column: pa.ChunkedArray):
    """The texts of a block as lists of at most SLICE, so that a block is not held as Python strings beside its bytes."""
    for chunk in column.chunks:
        for i in range(0, len(chunk), SLICE):
            yield chunk.slice(i, SLICE).to_pylist()


def tally(texts: DataFrame, read=by_tag) -> DataFrame:
    """(g, tag, c): how often each n-gram occurs in the (tag, texts) that ``read`` finds in a batch; each task adds up its own before the shuffle."""

    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def out():
            for tag, (_, grams, many) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(grams.tolist(), pa.string()), pa.array(np.full(len(grams), tag)), pa.array(many)], names=["g", "tag", "c"])
            held.clear()

        for batch in batches:
            for tag, found in read(batch):
                for part in portions(found):
                    views, at, h, _ = windows(part)
                    new, first, seen = np.unique(h, return_index=True, return_counts=True)
                    grams = np.ascontiguousarray(views[at[first]]).view(f"<U{LENGTH}")[:, 0]
                    if tag in held:
                        old, before, many = held[tag]
                        new, first, place = np.unique(np.concatenate([old, new]), return_index=True, return_inverse=True)
                        grams = np.concatenate([before, grams])[first]
                        seen = np.bincount(place, np.concatenate([many, seen]), len(new)).astype(np.int64)
                    held[tag] = new, grams, seen
                    if sum(len(x[0]) for x in held.values()) > HELD:
                        yield from out()
        yield from out()

    return texts.mapInArrow(run, "g string, tag long, c long").groupBy("g", "tag").agg(F.sum("c").alias("c"))


def trained(texts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order (own, left) of (text, half): the discounted share of each n-gram, and of each context what it leaves to lower orders.

    Lower orders count distinct left neighbours. ``m`` is the model.
    """
    halves = tally(texts).select("g", F.explode(F.array(1 - F.col("tag"), F.lit(ALL).cast("long"))).alias("m"), "c")
    top = cut(halves.groupBy("m", "g").agg(F.sum("c").alias("c")))
    orders = {LENGTH: top}
    for k in range(LENGTH - 1, 0, -1):
        orders[k] = cut(orders[k + 1].select("m", F.right("g", F.lit(k)).alias("g")).groupBy("m", "g").agg(F.count(F.lit(1)).alias("c")))
    out = []
    for k in range(1, LENGTH + 1):
        cuts = F.lit(None).cast("double")
        for m, found in ((r["m"], [r[f"n{i}"] for i in (1, 2, 3, 4)]) for r in orders[k].groupBy("m").agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4))).collect()):
            d1, d2, d3 = discounts_of(*found)
            cuts = F.when(F.col("m") == m, F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)).otherwise(cuts)
        shard = orders[k].select("m", "g", F.left("g", F.lit(k - 1)).alias("x"), "c", cuts.alias("d"))
        sums = cut(shard.groupBy("m", "x").agg(F.sum("c").alias("total"), F.sum("d").alias("mass"), F.count(F.lit(1)).alias("kinds")))
        own = shard.join(sums, ["m", "x"]).select("m", "g", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"))
        out.append((cut(own), sums.select("m", "x", (F.col("mass") / F.col("total")).alias("left"), "kinds")))
    return out


def probabilities(needed: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(m, g, nats) for distinct (m, g): negative ln p, interpolated down to an even share of the characters seen and one more."""
    found = needed.withColumn("p", F.lit(None).cast("double"))
    for k, (own, left) in enumerate(model, 1):
        found = found.withColumns({"s": F.right("g", F.lit(k)), "x": F.left(F.right("g", F.lit(k)), F.lit(k - 1))})
        found = found.join(own.withColumnRenamed("g", "s"), ["m", "s"], "left").join(left, ["m", "x"], "left")
        lower = F.col("p") if k > 1 else 1 / (F.coalesce("kinds", F.lit(0)) + 1)
        found = found.select("m", "g", (F.coalesce("own", F.lit(0.0)) + F.coalesce("left", F.lit(1.0)) * lower).alias("p"))
    return found.select("m", "g", (-F.log("p")).alias("nats"))


def packed(df: DataFrame) -> DataFrame:
    """(tag, rows): the rows of each task in compressed blocks of at most BLOCK, by ``__m``; tag * 4 + m names a block."""
    at = df.columns.index("__m")

    def run(batches):
        from pyspark import TaskContext

        held: dict[int, list] = {}
        number = TaskContext.get().partitionId() << 24

        def out(m):
            nonlocal number
            table = pa.Table.from_batches(held.pop(m)).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as writer:
                writer.write_table(table)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number * 4 + m]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["tag", "rows"])

        for batch in batches:
            ms = batch.column(at).to_numpy(zero_copy_only=False)
            for m in np.unique(ms).tolist():
                held.setdefault(m, []).append(batch.filter(pa.array(ms == m)))
                if sum(b.num_rows for b in held[m]) >= BLOCK or sum(b.nbytes for b in held[m]) >= BLOCK_BYTES:
                    yield out(m)
        for m in list(held):
            yield out(m)

    return df.mapInArrow(run, "tag long, rows binary")


def gathered(df: DataFrame) -> DataFrame:
    """The rows in tasks of about TASK_BYTES of their files, so that many small partitions do not make many small blocks.

    The size is the optimizer's, from the files, so nothing is read for it; where it knows none, partitions stay as they are.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.coalesce(min(size // TASK_BYTES + 1, 1 << 30))


def unpacked(blob: bytes | pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def scored(df: DataFrame, model: list[tuple[DataFrame, DataFrame]], text: str = "text", by: Column | None = None) -> DataFrame:
    """All rows and columns but the text, with ``__symbols`` and ``__nats``: how long the text is and its negative ln p by the model ``by``.

    Texts move once, compressed: both reads of the blocks share one exchange.
    """
    kept = [f for f in df.schema.fields if f.name != text]
    schema = StructType([*kept, StructField("__symbols", LongType()), StructField("__nats", DoubleType())])
    blocks = packed(df.withColumn("__m", (F.lit(ALL) if by is None else by).cast("long"))).repartition("tag")

    def texts_of(batch):
        for tag, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield from ((tag, some) for some in slices(unpacked(blob.as_buffer()).column(text)))

    # A block is opened where it is counted: a function of its own would double the Python workers of each executor.
    grams = tally(blocks, texts_of)
    # The sum keeps both uses of the counts alike, so that they are counted once.
    needed = grams.groupBy((F.col("tag") % 4).alias("m"), "g").agg(F.sum("c").alias("c")).where("c > 0").select("m", "g")
    found = grams.where("c > 0").select("g", "tag", (F.col("tag") % 4).alias("m")).join(probabilities(needed, model), ["m", "g"]).select("tag", "g", "nats")

    def run(packs: pa.Table, table: pa.Table) -> pa.Table:
        if not packs.num_rows:
            return pa.table({f.name: pa.array([], t.type) for f, t in zip(schema, to_arrow_schema(schema))})
        names = np.array(table.column("g").to_pylist(), f"<U{LENGTH}")
        known = hashes(names.view("<u4"))[::LENGTH]
        order = np.argsort(known)
        known, nats = known[order], table.column("nats").to_numpy()[order]
        rows = pa.concat_tables(unpacked(blob) for blob in packs.column("rows").to_pylist())
        sizes, sums = [], []
        for part in (p for some in slices(rows.column(text)) for p in portions(some)):
            _, _, h, many = windows(part)
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            if (known[place] != h).any():
                raise RuntimeError("an n-gram of a block has no probability")
            sizes += many
            sums.append(np.add.reduceat(nats[place], np.cumsum([0, *many[:-1]])))
        columns = [*(rows.column(f.name) for f in kept), pa.array(sizes, pa.int64()), pa.array(np.concatenate(sums), pa.float64())]
        return pa.table(columns, names=schema.names)

    return blocks.groupBy("tag").cogroup(found.groupBy("tag")).applyInArrow(run, schema)


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys with the label quality 1 and no contradicting one, and not called toxic."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    return labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("q"), F.max(toxic).alias("t")).where("q = 1 and t = 0").select(key)


def judged(df: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 0.15, prior: float = 60.0, key: str = "doc_id", text: str = "text", lang: str = "lang", also: dict[str, Column] | None = None) -> DataFrame:
    """(key, lang, also, __perplexity, __threshold, __accepted) of each row, by a model of all trusted texts.

    Trusted texts are scored by the model without their half, the others by the model of all. ``slack`` widens the
    log-perplexity threshold; ``prior`` symbols at the language's mean are added to each text, so that a few odd
    letters do not reject a short text.
    """
    small_batches(df.sparkSession)
    ids = cut(trusted_ids(labels, key)).select(F.col(key).alias("__id"), F.lit(True).alias("__t"))
    known = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = gathered(df).select(F.col(key).alias("__key"), F.col(lang).alias("__lang"), F.col(text).alias("__text"), *(c.alias(n) for n, c in (also or {}).items()))
    rows = rows.join(known, F.col("__key") == F.col("__id"), "left").drop("__id")
    # By the text, so that copies are in one half; a trusted text is judged by the model of the other.
    half = F.pmod(F.xxhash64("__text"), F.lit(2))
    model = trained(rows.where("__t").select("__text", half.alias("tag")))
    found = cut(scored(rows, model, "__text", F.when(F.col("__t"), half).otherwise(F.lit(ALL).cast("long"))))
    trusted = found.where("__t")
    whole = trusted.agg(F.sum("__nats").alias("a"), F.sum("__symbols").alias("b")).first()
    found = found.withColumn("__perplexity", F.exp(F.col("__nats") / F.col("__symbols")))
    if not whole["b"]:
        return found.withColumns({"__threshold": F.lit(None).cast("double"), "__accepted": F.lit(True)})
    mean = whole["a"] / whole["b"]
    means = by_language(trusted.groupBy("__lang").agg((F.sum("__nats") / F.sum("__symbols")).alias("__mean")))
    levels = cut(trusted.join(means, "__lang", "left").withColumn("__level", level(F.coalesce("__mean", F.lit(mean)), prior)))
    limits = levels.groupBy("__lang").agg(F.first("__mean").alias("__mean"), (F.percentile_approx("__level", quantile, 10000) + math.log1p(slack)).alias("__limit")).where("__lang is not null")
    overall = levels.agg(F.percentile_approx("__level", quantile, 10000).alias("q")).first()["q"] + math.log1p(slack)
    limit = F.coalesce("__limit", F.lit(overall))
    return found.join(by_language(limits), "__lang", "left").withColumns({"__threshold": F.exp(limit), "__accepted": level(F.coalesce("__mean", F.lit(mean)), prior) <= limit})


def by_language(rows: DataFrame) -> DataFrame:
    """A row per language, broadcast if there are few enough."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_LANGUAGES else rows


def level(mean: Column, prior: float) -> Column:
    """Log-perplexity with the prior's symbols added."""
    return (F.col("__nats") + prior * mean) / (F.col("__symbols") + prior)


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **settings) -> DataFrame:
    """One row per input row: key, lang, perplexity, threshold, accepted."""
    found = judged(df, labels, key=key, text=text, lang=lang, **settings)
    return found.select(F.col("__key").alias(key), F.col("__lang").alias(lang), *(F.col("__" + c).alias(c) for c in ("perplexity", "threshold", "accepted")))


def keep_accepted(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **settings) -> DataFrame:
    """The accepted rows with their own columns; rows are told by key, language and the digest of the text."""
    rows, name = numbered(df)
    digest = F.unhex(F.sha2(F.coalesce(F.col(name[text]), F.lit("")), 256))
    known = labels.withColumnRenamed(key, name[key]) if key in labels.columns else labels
    accepted = judged(rows, known, key=name[key], text=name[text], lang=name[lang], also={"__d": digest}, **settings).where("__accepted").select("__key", "__lang", "__d").distinct()
    same = F.col(name[key]).eqNullSafe(F.col("__key")) & F.col(name[lang]).eqNullSafe(F.col("__lang")) & (F.col("__d0") == F.col("__d"))
    return rows.withColumn("__d0", digest).join(accepted, same, "left_semi").select(*rows.columns).toDF(*df.columns)
