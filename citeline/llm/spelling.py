"""Spelling variants: composition of the vocabulary's acceptor, a one-edit transducer and the acceptor again.

Words that differ by one code point are paths of the composition V o E o V. Its state space is cut at initial states: a pair
that is edited at place i of the longer word shares all before an interval [s, e) with i in it, which leads both to one state of the acceptor,
and all after it, one state of the reversed acceptor. So a partition of words of one length and the next shorter one is
(length, s, e, what is before, what is after); it holds the minimised acceptor of the middles, which is composed with the
transducer and enumerated. The transducer edits where both words first differ, so each pair is one path, of one interval and partition.

Intervals start as both halves of a word. A partition of more than ``limit`` words is cut into the halves of its interval, round by
round; at an interval of one place it holds at most one word a letter, so partitions are bounded whatever the words are. Rows of
partitions are sorted into tasks and read one after the other; the pairs of a word are added up before they are joined back.

Defined cases: null and empty texts have no words, a null key counts as an empty one; repeated rows are counted as often as they come; a
very long text is read whole in the JVM; of forms that are equally frequent the smallest by code points wins; an empty table gives
no rows; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.llm.common import cut, discard, spread_join, stored

MIN_CHARS, MIN_COUNT, RATIO, LIMIT = 7, 2, 10, 5_000
#: The letters of a word, those made small, and which runs lose a letter.
LETTERS, CAPITALS, MODULUS = r"A-Za-zÀ-ÿ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 31


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the counted words, each occurrence with its planted slip; shorter runs are left out before they are rows."""
    runs = F.regexp_extract_all(F.translate(F.col(text), CAPITALS, CAPITALS.lower()), F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))
    each = docs.select(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":")).alias("d"), F.explode(runs).alias("run"))
    h = each.select("run", F.crc32(F.concat("d", "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.col("h") % MODULUS == 0, F.concat(F.expr("left(run, cast(pmod(h, length(run)) as int))"), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    counted = h.select(word.alias("word")).where(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def acceptor(words: list[str]) -> list[dict[str, int]]:
    """The minimal deterministic acceptor of sorted words: state 0 is the end of a path, the last state is the first.

    A state is its arcs by letter; all words end by the same sign (an empty letter), so that equal states are equal arcs.
    """
    states: list[dict[str, int]] = [{}]
    known: dict[tuple, int] = {(): 0}

    def settle(path: list[dict], depth: int) -> None:
        while len(path) > depth:
            arcs = path.pop()
            sign = tuple(arcs.items())
            if sign not in known:
                known[sign] = len(states)
                states.append(arcs)
            if path:
                path[-1][last[len(path) - 1]] = known[sign]

    path: list[dict] = [{}]
    last: list[str] = []
    for word in words:
        shared = 0
        while shared < min(len(last), len(word)) and last[shared] == word[shared]:
            shared += 1
        settle(path, shared + 1)
        del last[shared:]
        for letter in word[shared:]:
            last.append(letter)
            path.append({})
        path[-1][""] = 0
    settle(path, 0)
    return states if words else [{}, {}]


def pairs(states: list[dict[str, int]]) -> Iterator[tuple[str, str]]:
    """(a, b) of the composition: b is a with one letter replaced by a larger one, or one letter less; edited where both first differ."""

    def same(p: int, q: int) -> Iterator[str]:
        """Words that both states accept."""
        todo = [(p, q, "")]
        while todo:
            p, q, read = todo.pop()
            a, b = (states[p], states[q]) if len(states[p]) <= len(states[q]) else (states[q], states[p])
            for letter in a:
                if letter in b:
                    if letter:
                        todo.append((a[letter], b[letter], read + letter))
                    else:
                        yield read

    todo = [(len(states) - 1, "")]
    while todo:
        q, read = todo.pop()
        arcs = [x for x in states[q].items() if x[0]]
        for i, (a, x) in enumerate(arcs):
            todo.append((x, read + a))
            for b, y in arcs[i + 1 :]:
                for rest in same(x, y):
                    yield read + a + rest, read + b + rest
            # One letter less: after it the other word goes on from q, with another letter or its end.
            for c, y in states[q].items():
                if c != a and c in states[x]:
                    if not c:
                        yield read + a, read
                    else:
                        for rest in same(states[x][c], y):
                            yield read + a + c + rest, read + c + rest


def keyed(rows: DataFrame) -> DataFrame:
    """(c, s, e, word, n) with the partition's ``key``; the shorter words of class c lack one letter of the interval."""
    less = F.col("c") - F.length("word")
    after = F.substring("word", F.col("e") - less + 1, F.length("word"))
    return rows.withColumn("key", F.concat_ws(" ", "c", "s", "e", F.expr("left(word, s)"), after))


def partitions(words: DataFrame, limit: int = LIMIT) -> list[DataFrame]:
    """(key, c, s, e, word, n, size) of partitions of more than one word: a stored table for each round, read ``where(~large(limit))``."""
    length = F.length("word")
    classes = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("c"))
    half = F.expr("c div 2")
    ends = F.array(F.struct(F.lit(0).alias("s"), half.alias("e")), F.struct(half.alias("s"), F.col("c").alias("e")))
    rows = classes.select("word", "n", "c", F.explode(ends).alias("i")).select("word", "n", "c", "i.s", "i.e")
    rounds: list[DataFrame] = []
    while not rounds or rounds[-1].where(large(limit)).limit(1).count():
        if rounds:
            middle = F.expr("(s + e) div 2")
            ends = F.array(F.struct("s", middle.alias("e")), F.struct(middle.alias("s"), "e"))
            rows = rounds[-1].where(large(limit)).select("word", "n", "c", F.explode(ends).alias("i")).select("word", "n", "c", "i.s", "i.e")
        rows = keyed(rows)
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").withColumn("size", F.col("__n"))
        rounds.append(stored(spread_join(rows, sizes, "key")))
    return rounds


def large(limit: int):
    return (F.col("size") > limit) & (F.col("e") - F.col("s") > 1)


def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, near, near_n) both ways of each pair, from rows (key, c, s, e, word, n) sorted by key and word."""
    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(6))))
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        made = pa.record_batch([pa.array([r[i] for r in out], (pa.string(), pa.int64())[i % 2]) for i in range(4)], ["word", "n", "near", "near_n"])
        out.clear()
        return made

    for _, group in groupby(rows, key=lambda r: r[0]):
        held = list(group)
        if len(held) < 2:
            continue
        _, c, s, e, word, _ = held[0]
        before, after = word[:s], word[e - (c - len(word)) :]
        counts = {r[4]: r[5] for r in held}
        middles = sorted(r[4][s : e - (c - len(r[4]))] for r in held)
        for a, b in pairs(acceptor(middles)):
            a, b = before + a + after, before + b + after
            # Short words are held against long ones alone (they meet each other in their own class), and
            # a letter that could as well go after the interval belongs to a later one.
            if len(a) == c and (len(b) == c or not after or a[s:e] != b[s : e - 1] + after[0]):
                out.append((a, counts[a], b, counts[b]))
                out.append((b, counts[b], a, counts[a]))
        if len(out) > 50_000:
            yield batch()
    yield batch()


def near_words(rounds: list[DataFrame], limit: int = LIMIT) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of words one edit apart, each once."""
    fits = [r.where(~large(limit)).select("key", "c", "s", "e", "word", "n") for r in rounds]
    rows = reduce(DataFrame.unionByName, fits)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(composed, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling: a form is ten times as frequent, so chains are short; the rounds are their logarithm."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.join(at.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root", "left")
        at = cut(step.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if not at.where("moved").limit(1).count():
            return at.drop("moved")
        at = at.drop("moved")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word; see the module for ties and odd cases."""
    words = stored(vocabulary(docs, key, text))
    rounds = partitions(words, limit)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("b")
    near = near_words(rounds, limit).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    good = -F.col("b.less") >= ratio * F.col("n")
    both = words.join(near, "word", "left")
    found = stored(both.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("b.near")).alias("form"), F.when(good, -F.col("b.less")).alias("form_n")))
    for old in (words, *rounds):
        discard(old)
    rooted = found.join(roots(found.where("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
