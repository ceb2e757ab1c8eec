"""SimHash near-duplicates by anchor-point covering.

Method. A fingerprint is cut into pieces; two fingerprints that differ in at most ``bits`` places differ
in at most ``bits // pieces`` places of some piece. In each piece the anchors are a covering code: the
product of [7,4] Hamming codes (covering radius 1 a block) and of the bits left over (radius 0). Every
value has one home anchor within the covering radius. A fingerprint is replicated, as a guest, to each
anchor that may be the home of a fingerprint within the piece's threshold, that is to the anchors
within covering radius plus threshold, block by block. The number of pieces is that of least counted cost: few
pieces make many replicas, many pieces compare more pairs. At an anchor the homes are compared with
the guests by XOR and bit count over all 64 bits, so no link is missed. Equal fingerprints are one
row beforehand. An anchor answers with a spanning forest of its links, never with all pairs;
an anchor with more than ``tile`` fingerprints is split into tiles of blocks of homes and guests.

Defined cases: null and empty texts have fingerprint zero and link with each other; fewer words than a
shingle make one shingle; repeated rows stay repeated and share a component; a null key takes part in
a component without naming it; an empty table gives no rows; extra columns are ignored. A bit set in exactly half of
the hashes (a tie) is 0; very long texts are hashed in portions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from citeline.llm.common import components, cut, numbered, small_batches, spread_join

SEED = 42
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Cost of a replica of a fingerprint in comparisons.
COPY_COST = 2500
#: Parity masks of the [7,4] Hamming code; the syndrome is the place of the wrong bit.
PARITY = (0b1010101, 0b1100110, 0b1111000)


def fingerprint(text: str | None, words: int) -> int:
    """64 bits: each is 1 if set in over half of the hashes of the word shingles."""
    tokens = (text or "").encode().translate(LOWER).split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: max(1, len(tokens) - words + 1)].tolist()
    stops = (ends[words - 1 :] if len(tokens) >= words else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    n, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        part = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + (1 << 14)], stops[at : at + (1 << 14)])], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(v.as_py(), words) for v in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    small_batches(df.sparkSession)
    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, fp long")


def homes(values: np.ndarray, width: int) -> np.ndarray:
    """The home anchor of each piece value: every full block of 7 bits is decoded, left-over bits stay."""
    out = values.copy()
    for at in range(0, width - width % 7, 7):
        block = (values >> np.uint64(at)) & np.uint64(127)
        place = sum((np.bitwise_count(block & np.uint64(mask)).astype(np.uint64) & np.uint64(1)) << np.uint64(i) for i, mask in enumerate(PARITY))
        wrong = np.where(place > 0, np.uint64(1) << (np.maximum(place, 1) - np.uint64(1)), np.uint64(0))
        out ^= wrong << np.uint64(at)
    return out


def pieces_of(pieces: int) -> list[tuple[int, int]]:
    """(first bit, width) of each piece."""
    edges = [64 * i // pieces for i in range(pieces + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def visits(fps: np.ndarray, bits: int, pieces: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(piece, anchors, whether home, indices of the fingerprints) of all replicas, guests without repeats."""
    within = bits // pieces
    for piece, (first, width) in enumerate(pieces_of(pieces)):
        values = (fps >> np.uint64(first)) & np.uint64((1 << width) - 1)
        own = homes(values, width)
        flips = [sum(1 << b for b in c) for k in range(within + 1) for c in combinations(range(width), k)]
        reach = np.sort(np.stack([homes(values ^ np.uint64(f), width) for f in flips]), axis=0)
        fresh = np.ones(reach.shape, bool)
        fresh[1:] = reach[1:] != reach[:-1]
        _, index = np.nonzero(fresh)
        anchors = reach[fresh]
        yield piece, anchors, anchors == own[index], index


@lru_cache
def cost_of(bits: int, pieces: int) -> tuple[float, float]:
    """(replicas of a fingerprint, share of all pairs that are compared) with so many pieces."""
    some = np.random.default_rng(SEED).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2)
    replicas = compared = 0.0
    for piece, anchors, _, _ in visits(some, bits, pieces):
        width = pieces_of(pieces)[piece][1]
        each = len(anchors) / len(some)
        replicas += each
        compared += each / 2 ** (width // 7 * 4 + width % 7)
    return replicas, compared


def pieces_for(rows: int, bits: int) -> int:
    """The number of pieces of least counted cost for so many fingerprints; every number finds every link."""
    return min(range(min(2, bits + 1), bits + 2), key=lambda p: (lambda r, c: r * COPY_COST + c * rows)(*cost_of(bits, p)))


def link_tile(home: np.ndarray, guest: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest, as fingerprints, of the links between two arrays of distinct fingerprints."""
    nodes, places = np.unique(np.concatenate([home, guest]), return_inverse=True)
    at_home, at_guest = places[: len(home)], places[len(home) :]
    label, edges = np.arange(len(nodes)), []
    for start in range(0, len(home), 256):
        near = np.bitwise_count(home[start : start + 256, None] ^ guest[None, :]) <= bits
        for i in np.nonzero(near.any(axis=1))[0]:
            mine, linked = at_home[start + i], at_guest[near[i]]
            other, first = np.unique(label[linked], return_index=True)
            fresh = other != label[mine]
            if fresh.any():
                edges += [(int(nodes[mine]), int(nodes[x])) for x in linked[first[fresh]]]
                label[np.isin(label, other[fresh])] = label[mine]
    return edges


def links(fps: DataFrame, bits: int, pieces: int, tile: int = 4096) -> DataFrame:
    """(a, b): edges that connect the distinct fingerprints ``fp`` as their links do."""
    signed = lambda x: np.asarray(x, np.uint64).view(np.int64)

    def replicate(batches):
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for piece, anchors, home, index in visits(all_fps, bits, pieces):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(index), piece, np.int32)), pa.array(signed(anchors)), pa.array(home), pa.array(signed(all_fps[index]))],
                    names=["piece", "anchor", "home", "fp"],
                )

    spread = fps.mapInArrow(replicate, "piece int, anchor long, home boolean, fp long")
    # Anchors number at most pieces * 2^(4 * blocks + left-over bits), whatever the input.
    sizes = spread.groupBy("piece", "anchor").agg(F.count_if("home").alias("h"), F.count(F.lit(1)).alias("g"))
    busy = sizes.where("h > 0 and g > 1").select(
        "piece", "anchor", F.ceil(F.col("h") / tile).cast("int").alias("hb"), F.ceil(F.col("g") / tile).cast("int").alias("gb")
    )
    # A home row goes to the tiles of its block of homes; each row, as a guest, to those of its block of guests.
    block = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    other = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    placed = (
        spread.join(F.broadcast(busy) if max(w // 7 * 4 + w % 7 for _, w in pieces_of(pieces)) <= 12 else busy, ["piece", "anchor"])  # bounded as said above
        .select(
            "piece", "anchor", "fp",
            F.explode(F.concat(
                F.transform(other("hb"), lambda x: F.struct(x.alias("hi"), block("gb").alias("gi"), F.lit(False).alias("is_home"))),
                F.when(F.col("home"), F.transform(other("gb"), lambda x: F.struct(block("hb").alias("hi"), x.alias("gi"), F.lit(True).alias("is_home")))).otherwise(F.array()),
            )).alias("t"),
        )
        .select("piece", "anchor", "t.*", "fp")
    )

    def compare(batches):
        """Rows come sorted by tile; a tile is bounded, so one is held at a time."""
        key, rows = None, []

        def done():
            data = np.concatenate(rows)
            home = data[data[:, 1] == 1, 0].view(np.uint64)
            guest = data[data[:, 1] == 0, 0].view(np.uint64)
            edges = link_tile(home, guest, bits) if len(home) and len(guest) > 1 else []
            a, b = (signed([e[i] for e in edges]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            data = np.stack([batch.column(5).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
            edges = [0, *(np.nonzero((k[1:] != k[:-1]).any(axis=1))[0] + 1).tolist(), len(k)]
            for a, b in zip(edges, edges[1:]):
                if key is not None and tuple(k[a]) != key:
                    yield done()
                    rows = []
                key = tuple(k[a])
                rows.append(data[a:b])
        if key is not None:
            yield done()

    tiles = ["piece", "anchor", "hi", "gi"]
    return placed.repartition(*tiles).sortWithinPartitions(*tiles).mapInArrow(compare, "a long, b long").distinct()


def with_fingerprints(df: DataFrame, words: int, text: str = "text") -> DataFrame:
    """All rows and columns with ``__fp``."""
    at, schema = df.columns.index(text), StructType([*df.schema.fields, StructField("__fp", LongType())])

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(v.as_py(), words) for v in batch.column(at)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], names=schema.names)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def classes_of(docs: DataFrame, bits: int, pieces: int | None) -> DataFrame:
    """(fp, component_id, __root, __n) of (key, fp) rows: the smallest key reachable from each fingerprint, its component, its rows."""
    key = docs.columns[0]
    classes = cut(docs.groupBy("fp").agg(F.min(key).alias("low"), F.count(F.lit(1)).alias("n")))
    reach = components(links(classes.select("fp"), bits, pieces or pieces_for(classes.count(), bits)))
    joined = cut(classes.join(reach, classes["fp"] == reach["node"], "left").select("fp", "low", "n", F.coalesce("component", "fp").alias("root")))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("__n"))
    return spread_join(joined, lowest, "root").select("fp", "component_id", F.col("root").alias("__root"), F.col("n").alias("__n"))


def near_duplicates(df: DataFrame, words: int = 4, bits: int = 4, pieces: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, fingerprint (16 hex digits) and the smallest key reachable by links."""
    docs = cut(fingerprints(df, words, key, text))
    return spread_join(docs, classes_of(docs, bits, pieces), "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, words: int = 4, bits: int = 4, pieces: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest key, with its own columns.

    The choice is made on keys and fingerprints; whole texts move once, for the join with the kept ones.
    """
    docs = cut(fingerprints(df, words, key, text))
    winners = spread_join(docs, classes_of(docs, bits, pieces), "fp").where(F.col(key).eqNullSafe(F.col("component_id")))
    # By component and not by key: rows that share a key, or have none, may be of different components.
    kept = cut(winners.groupBy("__root").agg(F.first("component_id").alias("__key"), F.min("fp").alias("__kept"), F.count(F.lit(1)).alias("__rows")))
    rows, name = numbered(df)
    left = with_fingerprints(rows, words, name[text]).join(kept, F.col(name[key]).eqNullSafe(F.col("__key")) & (F.col("__fp") == F.col("__kept")))
    if kept.where("__rows > 1").limit(1).collect():  # repeated rows or keys: one of them stays
        left = left.dropDuplicates([name[key], "__fp"])
    return left.select(*rows.columns).toDF(*df.columns)
