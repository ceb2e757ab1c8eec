"""Near-duplicate vectors by collision-counting projections.

Method. In a tile of vectors of one label and dimension, the rows are sorted along many one-dimensional random
projections. Around each query a window is cut out of each sorted list; a row collides with the query in the lists
whose windows it stands in. Pairs with enough collisions in the first lists are counted on in the others; pairs
with enough in all are verified by their cosine in double precision, no others. Window and counts are
calibrated by recall: the difference of two unit vectors at the threshold, projected, has a known spread,
and the counts are the largest that lose such a pair with at most ``MISS`` probability.

Windows of single projections alone would count quadratically many collisions, so a label is dealt into cells
by the signs of ``bits`` further projections, in as many tables as keep the probability of losing a pair at
the threshold below ``CELL_MISS``. The number of bits is the one of least counted cost of copies and
comparisons; it is none for small labels and grows with the logarithm of large ones.
Equal vectors are one weighted row beforehand. A tile answers with the number of links of each row and
a spanning forest, never with pairs; a cell of any size is split into tiles, so no task holds more
than two blocks of it.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a
null label, link with nothing; vectors of other dimensions do not link; a pair exactly at the threshold links (ties
need no order); repeated rows count as vectors of their own; a null key takes part in a component without
naming it; an empty table gives no rows; extra columns are ignored. Vectors of any length go: a block
holds fewer long ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.llm.common import components, cut, spread_join

#: Sorted lists; lists that are counted for every pair of a tile; half window in spreads; recall loss of the counts, of the cells.
PROJECTIONS, FIRST_LISTS, WIDTH, MISS, CELL_MISS = 40, 12, 2.0, 1e-5, 1e-4
#: Vectors of a block; queries counted at once; cost of a copy of a vector in compared pairs.
BLOCK, QUERIES, COPY_COST = 8192, 128, 2500
SEED = 7


def directions(dim: int, many: int, seed: int) -> np.ndarray:
    """Random unit vectors as columns."""
    found = np.random.default_rng(seed).standard_normal((dim, many))
    return found / np.linalg.norm(found, axis=0)


def least_count(lists: int, inside: float, miss: float) -> int:
    """The largest count that a binomial of that many lists stays below with at most ``miss``."""
    lost, least = 0.0, 0
    for count in range(lists + 1):
        lost += math.comb(lists, count) * inside**count * (1 - inside) ** (lists - count)
        if lost > miss:
            break
        least = count + 1
    return least


def calibrated(cosine: float, dim: int) -> tuple[float, int, int]:
    """(half window, least count in the first lists, least count in all): a pair at the threshold has both but for MISS."""
    inside = math.erf(WIDTH / math.sqrt(2))
    return WIDTH * math.sqrt((2 - 2 * cosine) / dim), least_count(FIRST_LISTS, inside, MISS / 2), least_count(PROJECTIONS, inside, MISS / 2)


def tables(rows: int, cosine: float) -> tuple[int, int]:
    """(sign bits, tables) of least cost for a label with that many vectors."""

    def many(bits: int) -> int:
        same = (1 - math.acos(cosine) / math.pi) ** bits
        return 1 if not bits else math.ceil(math.log(CELL_MISS) / math.log1p(-same))

    bits = min(range(40), key=lambda b: (many(b) * (COPY_COST + rows / 2**b), b))
    return bits, many(bits)


def cells(unit: np.ndarray, bits: int, many: int) -> np.ndarray:
    """The cell of each row in each table."""
    if not bits:
        return np.zeros((len(unit), 1), np.int64)
    signs = unit @ directions(unit.shape[1], bits * many, SEED + 1) > 0
    return (signs.reshape(len(unit), many, bits) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64)


def candidates(query: np.ndarray, data: np.ndarray, half: float, first: int, least: int, after: int | None):
    """(i, j) arrays, chunk by chunk, of the rows that collide often enough with each query.

    ``query`` and ``data`` are projections. With ``after`` the queries are the rows of data, and j > i.
    """
    ranks, low, wide = [], [], []
    for q, d in zip(query.T, data.T):
        order = np.argsort(d, kind="stable")
        rank = np.empty(len(d), np.uint16)
        rank[order] = np.arange(len(d), dtype=np.uint16)
        line = d[order]
        a, b = np.searchsorted(line, q - half, "left"), np.searchsorted(line, q + half, "right")
        ranks.append(rank)
        low.append(a.astype(np.uint16))
        wide.append((b - a).astype(np.uint16))
    for start in range(0, len(query), QUERIES):
        rows = slice(start, start + QUERIES)
        origin = start + 1 if after is not None else 0  # rows up to the query itself were met before
        if origin >= len(data):
            break
        count = np.zeros((len(query[rows]), len(data) - origin), np.uint8)
        for k in range(FIRST_LISTS):
            count += ranks[k][None, origin:] - low[k][rows, None] < wide[k][rows, None]
        i, j = np.nonzero(count >= first)
        if len(i) * 8 > count.size:  # nearly all of them go on: count on by whole lists
            for k in range(FIRST_LISTS, PROJECTIONS):
                count += ranks[k][None, origin:] - low[k][rows, None] < wide[k][rows, None]
            i, j = np.nonzero(count >= least)
            i, j = i + start, j + origin
        elif len(i):
            total = count[i, j]
            i, j = i + start, j + origin
            for k in range(FIRST_LISTS, PROJECTIONS):
                total += ranks[k][j] - low[k][i] < wide[k][i]
            i, j = i[total >= least], j[total >= least]
        if after is not None and len(i):
            i, j = i[j > i], j[j > i]
        if len(i):
            yield i, j


def linked(unit: np.ndarray, at: np.ndarray, to: np.ndarray, cosine: float, codes: np.ndarray | None, table: int, same: bool, seen: list[int] | None = None):
    """Verified links (positions in ``at`` and ``to``), chunk by chunk; each link in its first common table alone.

    ``seen`` collects how many pairs were verified.
    """
    spots = unit @ directions(unit.shape[1], PROJECTIONS, SEED)
    half, first, least = calibrated(cosine, unit.shape[1])
    for i, j in candidates(spots[at], spots[to], half, first, least, 0 if same else None):
        if seen is not None:
            seen.append(len(i))
        if codes is not None and table:
            fresh = ~(codes[at[i], :table] == codes[to[j], :table]).any(axis=1)
            i, j = i[fresh], j[fresh]
        a, b = at[i], to[j]
        queries, place = np.unique(a, return_inverse=True)
        if len(a) > len(queries) * len(to) / 8:  # a crowd of near copies: one matrix product is less work than its pairs
            near = (unit[queries] @ unit[to].T)[place, j] >= cosine
        else:
            near = np.concatenate([np.einsum("ij,ij->i", unit[a[s : s + 8192]], unit[b[s : s + 8192]]) >= cosine for s in range(0, len(a), 8192)] or [np.zeros(0, bool)])
        if near.any():
            yield i[near], j[near]


def tile_links(rep: np.ndarray, weight: np.ndarray, vectors: np.ndarray, side: np.ndarray, cosine: float, bits: int, many: int, table: int, seen: list[int] | None = None):
    """(rep, links) counts and forest edges of one tile; side 0 are queries, 1 data, 2 both."""
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    same = bool((side == 2).any())
    at = np.nonzero(side != 1)[0]
    to = at if same else np.nonzero(side == 1)[0]
    codes = cells(unit, bits, many) if table else None
    links, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
    edges: list[tuple[int, int]] = []
    for i, j in linked(unit, at, to, cosine, codes, table, same, seen):
        a, b = at[i], to[j]
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        cuts = np.nonzero(np.diff(a))[0] + 1
        for x, ys in zip(a[np.r_[0, cuts]], np.split(b, cuts)):
            other, first = np.unique(label[ys], return_index=True)
            fresh = other != label[x]
            if fresh.any():
                edges += [(int(rep[x]), int(rep[y])) for y in ys[first[fresh]]]
                label[np.isin(label, other[fresh])] = label[x]
    return links, edges


def classes(df: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the name of their group of equals, groups); names are hashes that are checked to be one for each vector."""
    v = F.col(vector)
    sound = F.col(label).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    for seed in range(8):
        name = F.when(F.coalesce(sound, F.lit(False)), F.xxhash64(F.lit(seed), F.col(label), v))
        rows = df.select(F.col(key).alias("_key"), name.alias("rep"), F.col(label).cast("string").alias("lab"), v.alias("v"))
        reps = cut(rows.where("rep is not null").groupBy("rep", "lab", "v").agg(F.count(F.lit(1)).alias("w"), F.min("_key").alias("low")).withColumn("dim", F.size("v")))
        if not reps.groupBy("rep").count().where("count > 1").limit(1).collect():
            return rows.select("_key", "rep"), reps
    raise RuntimeError("different vectors share every name")


def near_duplicates(df: DataFrame, cosine: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", plan: Callable[[int, float], tuple[int, int]] = tables) -> DataFrame:
    """One row per input row: key, n_links, component_id, kept. ``plan`` says how many sign bits and tables a label takes."""
    kind = df.schema[vector].dataType.simpleString()
    rows, reps = classes(df, key, vector, label)
    sizes = reps.groupBy("lab", "dim").agg(F.count(F.lit(1)).alias("n"))
    sized = reps.join(sizes, ["lab", "dim"])

    def spread(batches):
        for batch in batches:
            n = batch.column(4).to_numpy()
            dims = batch.column(3).to_numpy()
            for d, total in sorted({*zip(dims.tolist(), n.tolist())}):
                part = batch.filter(pa.array((dims == d) & (n == total)))
                bits, many = plan(total, cosine)
                unit = part.column(2).flatten().to_numpy().reshape(-1, d).astype(np.float64)
                found = cells(unit / np.linalg.norm(unit, axis=1)[:, None], bits, many)
                for t in range(many):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(unit), t, np.int32)), pa.array(found[:, t])], names=[*part.schema.names, "tab", "cell"])

    placed = sized.select("rep", "w", "v", "dim", "n", "lab").mapInArrow(spread, f"rep long, w long, v {kind}, dim int, n long, lab string, tab int, cell long")
    where = ["lab", "dim", "tab", "cell"]
    # Blocks of long vectors hold fewer of them.
    full = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.lit(BLOCK * 256) / F.col("dim")))
    blocks = placed.groupBy(*where).agg(F.count(F.lit(1)).alias("c")).select(*where, F.ceil(F.col("c") / full).cast("int").alias("nb"))
    mine = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("nb")).cast("int")
    tiles = placed.join(blocks, where).withColumn("b", mine).select(
        *where, "n", F.explode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(
            F.least("b", j).alias("bi"), F.greatest("b", j).alias("bj"), F.when(F.col("b") == j, 2).when(F.col("b") < j, 0).otherwise(1).alias("side")))).alias("t"), "rep", "w", "v",
    ).select(*where, "t.bi", "t.bj", "n", "t.side", "rep", "w", "v")

    def compare(batches):
        """Rows come sorted by tile; one tile of at most two blocks or so is held at a time."""
        held, key_now = [], None

        def done():
            b = pa.Table.from_batches(held).combine_chunks()
            d, n, t = b["dim"][0].as_py(), b["n"][0].as_py(), b["tab"][0].as_py()
            rep = b["rep"].to_numpy()
            vectors = b["v"].combine_chunks().flatten().to_numpy().reshape(-1, d).astype(np.float64)
            links, edges = tile_links(rep, b["w"].to_numpy(), vectors, b["side"].to_numpy(), cosine, *plan(n, cosine), t)
            some = np.nonzero(links)[0]
            a = np.concatenate([rep[some], np.array([e[0] for e in edges], np.int64)])
            z = np.concatenate([links[some], np.array([e[1] for e in edges], np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(a)) >= len(some)), pa.array(a), pa.array(z)], names=["edge", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(6))))
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if key_now is not None and keys[start] != key_now:
                        yield done()
                        held.clear()
                    key_now = keys[start]
                    held.append(batch.slice(start, i - start))
                    start = i
        if held:
            yield done()

    tile = [*where, "bi", "bj"]
    found = cut(tiles.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(compare, "edge boolean, a long, b long"))
    links = found.where("not edge").groupBy("a").agg(F.sum("b").alias("links"))
    reach = components(found.where("edge").select("a", "b"))
    named = cut(
        reps.select("rep", "w", "low")
        .join(links, F.col("rep") == F.col("a"), "left")
        .join(reach, F.col("rep") == F.col("node"), "left")
        .select("rep", "w", "low", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("root"))
    )
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("__n"))
    facts = spread_join(named, lowest, "root").select("rep", "n_links", "component_id", F.col("w").alias("__n"))
    linked_rows = spread_join(rows.where("rep is not null"), facts, "rep").select("_key", "n_links", "component_id")
    alone = rows.where("rep is null").select("_key", F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component_id"))
    out = linked_rows.unionByName(alone).select(F.col("_key").alias(key), F.col("n_links").cast("long").alias("n_links"), F.coalesce("component_id", "_key").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
