"""Personal data by information-theoretic sanitisation, in DataFrame functions alone.

Method. Base patterns find the protected entities: each kind (e-mail, IP, card, phone) and each value that
recurs. Over all distinct texts of the corpus, whole texts at any distance, the pointwise mutual
information of a term and an entity is PMI(t, e) = ln(n(t, e) N / (n(t) n(e))). A term discloses an entity when
PMI reaches ``threshold`` of the entity's own information ln(N / n(e)), with at least ``support``
texts behind it. A term that discloses a value is generalised wherever it occurs, for it names that value
even alone; one that discloses a kind, in the texts that hold that kind. Base spans are replaced by their
kind. Copies of a text are one piece of evidence. Words are exploded only of texts with entities, and of
the others only the words that may disclose.

Defined cases: null and empty texts have no spans and stay as they are; a term inside a base span is not marked again; overlapping spans are replaced as one; ties at the
threshold disclose; repeated rows stay repeated; tables without entities have no terms; an empty table gives no
rows; extra columns stay. Very long texts take time in proportion to their length. Places are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.llm.common import cut, discard, numbered, stored

KINDS = ("email", "ip", "card", "phone", "term")
#: The four base patterns. Possessive loops and the guards before them change no match; they keep the
#: search linear and the matcher's stack flat in very long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9](?:[\\x20-]?[0-9]){14}", "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
ONE = "struct<kind:int,start:int,end:int,value:string>"
SPAN = f"array<{ONE}>"
#: One letter for one letter: capitals become small, punctuation becomes a space, so places stay.
CAPITALS = "".join(chr(c) for c in [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&=/\\_`~^"
SPACE = r"[\x20\x09-\x0D]"
#: Terms up to this number are one literal set in the plan; up to the second they are broadcast; more are joined by shuffle.
LITERAL_TERMS, BROADCAST_TERMS = 5000, 200_000
#: Texts with terms whose hashes are broadcast at most; beyond that all texts move to meet their terms.
BROADCAST_TEXTS = 4_000_000
#: Items that are folded in one go; longer lists are folded block by block, so that appending stays linear.
FOLDED = 256


def plain(text: Column) -> Column:
    """The text in small letters with spaces for punctuation, letter by letter."""
    return F.translate(text, CAPITALS + PUNCTUATION, CAPITALS.lower() + " " * len(PUNCTUATION))


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def folded(items: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """One array of what ``step(place, item)`` -> (new place, array of ``kind``) gives for the items in order."""
    state = f"struct<at:int,out:array<{kind}>>"

    def one(acc: Column, x: Column) -> Column:
        at, fresh = step(acc["at"], x)
        return F.struct(at.cast("int").alias("at"), F.concat(acc["out"], fresh).alias("out"))

    def block(done: Column, part: Column) -> Column:
        at = F.coalesce(F.try_element_at(done, F.lit(-1))["at"], F.lit(0))
        start = F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.concat(done, F.array(F.aggregate(part, start, one)))

    def all_of(items: Column) -> Column:
        last = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / FOLDED).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * FOLDED + 1, FOLDED))
        done = F.aggregate(parts, F.array().cast(f"array<{state}>"), block)
        return F.flatten(F.transform(done, lambda x: x["out"]))

    # As the variable of a lambda the items are computed once, not once a block.
    return F.transform(F.array(items), all_of)[0]


def kind_spans(text: Column, kind: str) -> Column:
    """The valid spans of one kind, in order: what lies between the matches gives their places."""
    number, pattern = KINDS.index(kind), F.lit(PATTERNS[kind])
    pairs = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        a = at + F.length(x["gap"])
        b = a + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.array(F.struct(F.lit(number).alias("kind"), a.alias("start"), b.alias("end"), x["hit"].alias("value"))).cast(SPAN)
        return b, F.when(x["hit"].isNotNull() & valid(kind, x["hit"]), span).otherwise(F.array().cast(SPAN))

    needed = F.contains(text, F.lit(NEEDS[kind])) if len(NEEDS[kind]) == 1 else text.rlike(NEEDS[kind])
    return F.when(needed, folded(pairs, step, ONE)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """All base spans by kind as listed, then by place; null and empty texts have none."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*(kind_spans(text, k) for k in KINDS[:4]))


def tokens(text: Column) -> Column:
    return F.split(plain(text), SPACE, -1)


def is_term(word: Column) -> Column:
    """Words of three letters or more that are no piece of a number or an address."""
    return (F.length(word) >= 3) & ~F.contains(word, F.lit("@")) & ~word.rlike("^[0-9+-]+$")


def identity(text: str) -> Column:
    """What stands for a text where copies count once."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def words_outside(text: Column) -> Column:
    """The distinct terms of a text, those inside e-mail addresses left out; the other kinds hold no letters."""
    text = F.coalesce(text, F.lit(""))
    masked = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.filter(tokens(masked), is_term))


def entities_of(spans: Column) -> Column:
    """The distinct entities of base spans: their kinds, and kind and value."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_distinct(F.concat(F.transform(spans, name), F.transform(spans, lambda s: F.concat_ws(":", name(s), F.lower(s["value"])))))


def holding(df: DataFrame, text: str, terms: DataFrame, many: int) -> DataFrame:
    """Distinct (term, h) of the texts that hold each of ``terms``, over all texts; the terms of a text are shuffled as one row with its digest."""
    words = words_outside(F.col(text))
    if many <= LITERAL_TERMS:
        literal = [r["term"] for r in terms.collect()]
        held = df.select(identity(text).alias("h"), F.filter(words, lambda w: w.isin(literal)).alias("terms")).dropDuplicates(["h"])
    elif many <= BROADCAST_TERMS:
        each = df.select(identity(text).alias("h"), F.explode(words).alias("term")).join(F.broadcast(terms), "term", "left_semi")
        held = each.groupBy("h").agg(F.collect_set("term").alias("terms"))
    else:
        return df.select(identity(text).alias("h"), F.explode(words).alias("term")).join(terms, "term", "left_semi").distinct()
    return held.select("h", F.explode("terms").alias("term"))


def disclosing_terms(df: DataFrame, text: str = "text", threshold: float = 0.9, support: int = 3) -> DataFrame:
    """(term, entity, n_both, n_term, n_entity, disclosure) of the terms that disclose a protected entity."""
    # No filter on the spans: it would be pushed below them and find them again for each use. Texts without
    # entities keep their digest alone, so that all distinct texts are counted here.
    found = df.select(F.col(text).alias("t"), identity(text).alias("h")).withColumn("s", base_spans(F.col("t")))
    some = F.size("s") > 0
    held = stored(found.select("h", F.when(some, words_outside(F.col("t"))).alias("words"), F.when(some, entities_of(F.col("s"))).alias("entities")).dropDuplicates(["h"]))
    texts = held.count()
    mentions = held.select("h", F.explode("entities").alias("entity"))
    entities = cut(mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= support))
    # One pass over the words gives each term's texts, in all and of each kind.
    each = held.select(F.explode("words").alias("term"), *(F.array_contains("entities", k).alias(k) for k in KINDS[:4]))
    seen = cut(each.groupBy("term").agg(F.count(F.lit(1)).alias("n_seen"), *(F.count_if(F.col(k)).alias(k) for k in KINDS[:4])).where(F.col("n_seen") >= support))
    by_kind = seen.select("term", F.explode(F.array(*(F.struct(F.lit(k).alias("entity"), F.col(k).alias("n_both")) for k in KINDS[:4]))).alias("x")).select("x.entity", "term", "x.n_both")
    # Values stand with a colon, so that they are told from kinds; only the recurring ones meet the words of their texts.
    values = mentions.where(F.contains("entity", F.lit(":"))).join(entities.select("entity"), "entity", "left_semi")
    by_value = values.join(held.select("h", "words"), "h").select("entity", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
    both = by_kind.unionByName(by_value).where(F.col("n_both") >= support)
    # A term is in at least the texts that hold an entity with it; what fails with that count fails with the whole one.
    own = F.greatest(F.log(F.lit(texts) / F.col("n_entity")), F.lit(1e-9))
    most = F.log(F.col("n_both") * texts / (F.col("n_seen") * F.col("n_entity"))) / own
    small = F.broadcast(entities) if entities.count() <= BROADCAST_TERMS else entities
    both = cut(both.join(seen.select("term", "n_seen"), "term").join(small, "entity").where(most >= threshold).drop("n_seen"))
    discard(held)
    candidates = cut(both.select("term").distinct())
    many = candidates.count()
    if not many:
        return both.select("term", "entity", "n_both", F.lit(None).cast("long").alias("n_term"), "n_entity", F.lit(None).cast("double").alias("disclosure"))
    counted = holding(df, text, candidates, many).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    pmi = F.log(F.col("n_both") * texts / (F.col("n_term") * F.col("n_entity")))
    return both.join(counted, "term").withColumn("disclosure", pmi / own).where(F.col("disclosure") >= threshold).select("term", "entity", "n_both", "n_term", "n_entity", "disclosure")


def with_spans(df: DataFrame, text: str = "text", **limits) -> DataFrame:
    """All rows with ``pii``: base spans by kind and place, then the spans of disclosing terms by place."""
    pairs = cut(disclosing_terms(df, text, **limits).select("entity", "term"))
    many = pairs.count()
    whole = F.coalesce(F.col(text), F.lit(""))
    base = df.withColumn("pii", base_spans(F.col(text)))
    if not many:
        return base
    number, none = KINDS.index("term"), F.array().cast(SPAN)
    kinds = F.transform("pii", lambda s: s["kind"])
    has = {k: F.array_contains(kinds, i) for i, k in enumerate(KINDS[:4])}

    def spread(hit) -> Column:
        """The places of the words for which ``hit`` holds, outside base spans."""

        def step(at: Column, w: Column) -> tuple[Column, Column]:
            end = at + F.length(w)
            free = ~F.exists("pii", lambda s: (s["start"] < end) & (s["end"] > at))
            span = F.array(F.struct(F.lit(number).alias("kind"), at.alias("start"), end.alias("end"), w.alias("value"))).cast(SPAN)
            return end + 1, F.when(hit(w) & free, span).otherwise(none)

        return folded(tokens(whole), step, ONE)

    if many <= LITERAL_TERMS:
        told: dict[str, set[str]] = {}
        for r in pairs.collect():
            told.setdefault(r["entity"] if r["entity"] in KINDS else "", set()).add(r["term"])
        known = base.withColumns({f"__{k}": has[k] for k in told if k})

        def hit(w: Column) -> Column:
            found = F.lit(False)
            for k, terms in sorted(told.items()):
                found = found | (w.isin(sorted(terms)) & (F.col(f"__{k}") if k else F.lit(True)))
            return found

        added = F.when(F.exists(tokens(whole), hit), spread(hit)).otherwise(none)
        return known.withColumn("pii", F.concat("pii", added)).drop(*(f"__{k}" for k in told if k))
    # Too many for a literal: the terms of each distinct text come by joins instead.
    hashed = df.withColumn("__h", identity(text))
    worded = hashed.withColumn("pii", base_spans(F.col(text))).select("__h", F.filter(F.array(*(F.when(c, k) for k, c in has.items())), lambda k: k.isNotNull()).alias("k"), F.explode(F.array_distinct(F.filter(tokens(whole), is_term))).alias("term"))
    small = F.broadcast(pairs) if many <= BROADCAST_TERMS else pairs
    of_text = worded.join(small, "term").where(F.contains("entity", F.lit(":")) | F.array_contains("k", F.col("entity"))).groupBy("__h").agg(F.collect_set("term").alias("__terms"))
    of_text = cut(of_text)
    # Only texts that hold a term move to meet it; those without one, which are most, stay where they are.
    hashes = of_text.select(F.xxhash64("__h").alias("__x")).distinct()
    moved, stay = hashed, None
    if of_text.count() <= BROADCAST_TEXTS:
        same = F.xxhash64("__h") == F.col("__x")
        moved, stay = hashed.join(F.broadcast(hashes), same, "left_semi"), hashed.join(F.broadcast(hashes), same, "left_anti")
    marked = moved.join(of_text, "__h", "left")
    if stay is not None:
        marked = marked.unionByName(stay.withColumn("__terms", F.lit(None).cast("array<string>")))
    marked = marked.withColumn("pii", base_spans(F.col(text)))
    return marked.withColumn("pii", F.concat("pii", F.when(F.col("__terms").isNotNull(), spread(lambda w: F.array_contains("__terms", w))).otherwise(none))).drop("__h", "__terms")


def sanitise(df: DataFrame, text: str = "text", **limits) -> DataFrame:
    """All rows with every span of ``text`` replaced by its kind in brackets; overlapping spans by the first's."""
    names = df.columns
    df, name = numbered(df)
    text = name[text]
    found = with_spans(df, text, **limits)
    order = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"], s["kind"], s["end"])))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        name = F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit("]"))
        fresh = F.array(F.substring(F.col(text), at + 1, s["start"] - at), name)
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, fresh).otherwise(F.array().cast("array<string>"))

    last = F.array_max(F.transform("pii", lambda s: s["end"]))
    clean = F.concat(F.array_join(folded(order, step, "string"), ""), F.substring(F.col(text), last + 1, F.length(F.col(text))))
    return found.withColumn(text, F.when(F.size("pii") > 0, clean).otherwise(F.col(text))).select(*df.columns).toDF(*names)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the given order."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Per row: the key, base counts, the digest of the base spans, and all spans."""
    found = with_spans(df.select(key, text), text, **limits)
    base = F.filter("pii", lambda s: s["kind"] < 4)
    kinds = F.transform("pii", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select(key, *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("pii")).alias("spans"))
