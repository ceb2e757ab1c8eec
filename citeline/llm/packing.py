"""Packing documents into training sequences by variable-capacity best fit.

Method. Lengths are whole numbers up to the largest permitted sequence length, so the histogram of
lengths, not the documents, is packed: decreasing lengths go to the open bins with the least room that
holds them; where none does, the bin size of least cost per token that the remaining lengths can fill is
opened; at the end every bin is downsized to the smallest permitted length that holds its contents. The
policies "least cost" and "always this size" are planned jointly and the cheapest plan is taken.
Bins with equal contents are intervals of bin numbers, so a plan grows with the number of lengths,
not of documents. Documents get a rank within their length from salted counts, and the broadcast plan
(bounded by the largest length) turns length and rank into a sequence and an offset.

Defined cases: documents longer than the largest length are cut into pieces, all of them kept; null and
empty texts give one row without a sequence; repeated rows are packed each on their own; pieces of one length are ranked
by key and place, and equal ones (ties) in any order, which changes no sequence's lengths; a null key
stays null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeline.llm.common import cut

LENGTHS = (256, 512, 1024, 2048, 4096)
#: Pieces that one task ranks: the salts of a table grow with it.
RANKED = 50_000
#: Salts up to which the offsets, at most so many for each length, are broadcast.
BROADCAST_SALTS = 256


def sequence_cost(length: int) -> float:
    """Work of a padded sequence: linear layers, and attention that grows with the square."""
    return length * (1 + length / 16384)


def plan(histogram: dict[int, int], sizes: Sequence[int], cost: Callable[[int], float], fixed: int | None = None) -> tuple[float, list[tuple]]:
    """(total cost, rows) for one opening policy.

    Rows (length, item_lo, item_hi, bin_lo, per_bin, offset, used, capacity): the items of that length
    with ranks from item_lo below item_hi fill bins from bin_lo on, per_bin in each, from offset on.
    """
    sizes = sorted(sizes)
    left = {n: c for n, c in histogram.items() if c > 0}
    order = sorted(left)
    rooms: list[int] = []
    pools: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, end bin, used)
    rows, bins = [], 0

    def add(room: int, lo: int, hi: int, used: int) -> None:
        if lo < hi:
            if room not in pools:
                insort(rooms, room)
                pools[room] = []
            pools[room].append((lo, hi, used))

    def fill(room: int) -> int:
        """How much of the room the largest remaining lengths fill."""
        used = 0
        while room and (i := bisect_right(order, room)) and left[order[i - 1]]:
            n = order[i - 1]
            k = min(room // n, left[n])
            used, room = used + k * n, room - k * n
            if k < room // n + k and left[n] <= k:
                break
        return used

    def opened(n: int) -> int:
        """The bin size of least cost per token for an item that no open bin holds."""
        fits = [c for c in sizes if c >= n]
        if fixed:
            return max(fixed, fits[0])
        rate = lambda c: cost(sizes[bisect_left(sizes, f := n + fill(c - n))]) / f
        return min(fits, key=lambda c: (rate(c), c))

    for n in sorted(left, reverse=True):
        total = todo = left[n]
        while todo:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                size = opened(n)
                per = size // n
                many = max(1, (todo + per - 1) // per if fixed else -(-todo // (2 * per)))
                add(size, bins, bins + many, 0)
                bins += many
                i = bisect_left(rooms, n)
            room = rooms[i]
            lo, hi, used = pools[room].pop()
            if not pools[room]:
                del pools[room], rooms[i]
            per = room // n
            whole = min(hi - lo, todo // per)
            at = total - todo
            if whole:
                rows.append((n, at, at + whole * per, lo, per, used))
                add(room - per * n, lo, lo + whole, used + per * n)
                todo -= whole * per
            elif todo:
                rows.append((n, at, at + todo, lo, todo, used))
                add(room - todo * n, lo, lo + 1, used + todo * n)
                whole, todo = 1, 0
            add(room, lo + whole, hi, used)
        order.pop()
        left[n] = 0
    final = sorted((lo, hi, used) for pool in pools.values() for lo, hi, used in pool if used)
    starts = [lo for lo, _, _ in final]
    capacity = lambda used: sizes[bisect_left(sizes, used)]
    out = []
    for n, a, b, lo, per, used in rows:
        while a < b:
            first, end, full = final[bisect_right(starts, lo) - 1]
            items = min(b - a, (end - lo) * per)
            out.append((n, a, a + items, lo, per, used, full, capacity(full)))
            a, lo = a + items, end
    return sum((hi - lo) * cost(capacity(used)) for lo, hi, used in final), out


def best_plan(histogram: dict[int, int], sizes: Sequence[int] = LENGTHS, cost: Callable[[int], float] = sequence_cost) -> tuple[float, list[tuple]]:
    """The cheapest plan over the opening policies."""
    return min((plan(histogram, sizes, cost, f) for f in (None, *sorted(sizes, reverse=True))), key=lambda p: p[0])


def words(text: Column) -> Column:
    """The default length of a text: its white-space separated words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def pack(df: DataFrame, sizes: Sequence[int] = LENGTHS, key: str = "doc_id", length: Column | None = None, cost: Callable[[int], float] = sequence_cost) -> DataFrame:
    """Rows (key, piece, start, n_tokens, seq_id, seq_offset, seq_used, seq_length) for each piece of each row."""
    spark, largest = df.sparkSession, max(sizes)
    n = (words(F.col("text")) if length is None else length).cast("long")
    # Counted once, then only keys and lengths are read.
    docs = cut(df.select(F.col(key), n.alias("n")))
    salts = docs.agg((F.sum(F.greatest((F.col("n") + largest - 1) / largest, F.lit(1)).cast("long")) / RANKED).cast("long") + 1).first()[0] or 1
    items = docs.select(
        key, F.posexplode(F.when(F.col("n") > 0, F.sequence(F.lit(0), ((F.col("n") - 1) / largest).cast("int"))).otherwise(F.array(F.lit(0)))).alias("piece", "_"), "n"
    ).select(
        key, "piece", (F.col("piece") * F.lit(largest).cast("long")).alias("start"),
        F.least(F.lit(largest).cast("long"), F.col("n") - F.col("piece") * largest).alias("n_tokens"),
        F.pmod(F.xxhash64(key, "piece", "n"), F.lit(salts)).cast("int").alias("salt"),
    )
    packed = items.where("n_tokens > 0")
    # At most a row for each length and salt, and no more than pieces.
    salted = packed.groupBy("n_tokens", "salt").count()
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.select("n_tokens", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ranked"))
    histogram = {r["n_tokens"]: r["c"] for r in salted.groupBy("n_tokens").agg(F.sum("count").alias("c")).collect()}
    _, rows = best_plan(histogram, sizes, cost)
    by_length = spark.createDataFrame(rows, "n_tokens long, item_lo long, item_hi long, bin_lo long, per_bin long, at long, seq_used long, seq_length int")
    rank = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy(key, "piece")) - 1
    placed = (
        packed.withColumn("rank", rank)
        .join(offsets if salts > BROADCAST_SALTS else F.broadcast(offsets), ["n_tokens", "salt"])
        .withColumn("rank", F.col("rank") + F.col("ranked"))
        .join(F.broadcast(by_length), "n_tokens")
        .where("rank >= item_lo and rank < item_hi")
    )
    turn = F.col("rank") - F.col("item_lo")
    found = placed.select(
        key, "piece", "start", "n_tokens",
        (F.col("bin_lo") + F.expr("(rank - item_lo) div per_bin")).alias("seq_id"),
        (F.col("at") + turn % F.col("per_bin") * F.col("n_tokens")).alias("seq_offset"), "seq_used", "seq_length",
    )
    none = [F.lit(None).cast(t).alias(c) for c, t in (("seq_id", "long"), ("seq_offset", "long"), ("seq_used", "long"), ("seq_length", "int"))]
    return found.unionByName(items.where("n_tokens <= 0").select(key, "piece", "start", "n_tokens", *none))


def pieces(text: Column, largest: int) -> Column:
    """The pieces of a text of at most ``largest`` words, each with the white space after its words; together they are the text."""
    blank = r"[\x20\x09-\x0D]"
    whole = F.coalesce(text, F.lit(""))

    def cut_up(t: Column) -> Column:
        tokens = F.regexp_extract_all(t, F.lit(rf"[^\x20\x09-\x0D]+{blank}*"), F.lit(0))
        parts = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / largest).cast("int")), lambda i: F.array_join(F.slice(w, i * largest + 1, largest), ""))
        first = F.regexp_extract(t, rf"^{blank}*", 0)
        return F.transform(F.transform(F.array(tokens), parts)[0], lambda x, i: F.when(i == 0, F.concat(first, x)).otherwise(x))

    return F.when(words(whole) <= largest, F.array(whole)).otherwise(cut_up(whole))


def pack_texts(df: DataFrame, sizes: Sequence[int] = LENGTHS, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``pack`` by words with ``text``, the piece's own: what a sequence is written from.

    Rows are told by key and text, so null and repeated keys keep their own texts; whole repeated rows are packed as
    often as they come.
    """
    row = F.unhex(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("\0")), F.lit("\1"), F.coalesce(F.col(text), F.lit("\0")))))
    named = df.select(row.alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    placed = pack(named, sizes, "row", **settings)
    each = named.dropDuplicates(["row"]).select(F.col("row").alias("row0"), "key", F.posexplode_outer(pieces(F.col("text"), max(sizes))).alias("piece0", "text"))
    met = placed.join(each, (F.col("row") == F.col("row0")) & (F.col("piece") == F.col("piece0")))
    return met.select(F.col("key").alias(key), "piece", "start", "n_tokens", "seq_id", "seq_offset", "seq_used", "seq_length", "text")
