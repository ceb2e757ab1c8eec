"""Fuzzy de-duplication of goals, where order counts, in rounds of bounded blocks.

A goal is held against the wording of each kept commitment of its report, category and year, in order; the first alike takes it, and
its longer quote replaces the wording that later goals meet. A group of up to ``block`` goals is one fold. A larger one goes in rounds, one
block of consecutive goals each: the block meets all commitments kept so far, which are dealt over many tasks, and one
fold over the block alone settles it. A task sees a block and a bounded share of the commitments, never a group.
"""

from __future__ import annotations

import difflib
from bisect import insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.operators.catalog import with_ids
from citeline.operators.retrieval import small
from citeline.session import cut

SIMILARITY, BLOCK, SHARE = 0.6, 1_000, 2_000


def squeezed(title: Column, target: Column) -> Column:
    """Title and target as small letters, without blanks and hyphens."""
    return F.regexp_replace(F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(target, F.lit("")))), r"(?U)[\s\-]+", "")


def alike(matcher: difflib.SequenceMatcher) -> bool:
    """Whether both texts of a matcher are similar enough; the two bounds from lengths and letters come first."""
    return matcher.real_quick_ratio() >= SIMILARITY and matcher.quick_ratio() >= SIMILARITY and matcher.ratio() >= SIMILARITY


def settle(goals: list[tuple[int, str, int]], found: dict[int, list[int]], lengths: dict[int, int]) -> list[tuple[int, int, bool]]:
    """(goal, commitment, whether it is its wording from now on) of consecutive goals (id, text, length of the quote).

    ``found`` has each goal's older commitments alike, in order, as they were worded before this block; wordings that
    changed in the block are compared here. A commitment is named by its first goal.
    """
    changed: dict[int, tuple[str, int]] = {}
    order: list[int] = []
    out = []
    for goal, text, size in goals:
        slot = next((s for s in found.get(goal, ()) if s not in changed), None)
        for s in order:
            if slot is not None and s > slot:
                break
            if alike(difflib.SequenceMatcher(None, text, changed[s][0])):
                slot = s
                break
        holds = slot is None or size > (changed[slot][1] if slot in changed else lengths[slot])
        slot = goal if slot is None else slot
        if holds:
            if slot not in changed:
                insort(order, slot)
            changed[slot] = (text, size)
        out.append((goal, slot, holds))
    return out


def dedupe_goals(goals: DataFrame, report: str = "report_id", order: str = "pos", block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """Goals without rewordings, with ``slot``: the ``order`` of the goal where the commitment first appeared.

    Goals of the same ``order`` are taken by wording, then quote; null titles, targets and quotes count as empty, null categories
    and years as values; no goals give no rows.
    """
    group = F.to_json(F.struct(F.col(report).alias("r"), F.col("category").alias("c"), F.col("target_year").alias("y")), {"ignoreNullFields": "false"})
    made = goals.withColumns({"_g": group, "_text": squeezed(F.col("title"), F.col("target")), "_q": F.length(F.coalesce("quote", F.lit(""))).cast("long")})
    placed = with_ids(made, ["_g", order, "_text", "quote"], key="_id")
    placed = cut(placed)
    sizes = placed.groupBy("_g").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    large = cut(sizes.where(F.col("_n") > block))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id")
        rows = settle(list(zip(pdf["_id"].tolist(), pdf["_text"], pdf["_q"].tolist())), {}, {})
        return pd.DataFrame({s: g for g, s, holds in rows if holds}.items(), columns=["_slot", "_id"])  # the last that holds

    few = placed.join(small(large.select("_g")), "_g", "left_anti").select("_g", "_id", "_text", "_q")
    kept = few.groupBy("_g").applyInPandas(fold, "_slot long, _id long")
    if large.limit(1).count():
        kept = kept.unionByName(in_rounds(placed.join(small(large), "_g").select("_g", "_id", "_text", "_q", F.floor((F.col("_id") - F.col("_first")) / block).alias("_b")), share))
    first = placed.select(F.col("_id").alias("_slot"), F.col(order).alias("slot"))
    return placed.join(kept, "_id").join(first, "_slot").select(*goals.columns, "slot")


def in_rounds(goals: DataFrame, share: int) -> DataFrame:
    """(_slot, _id) of the kept wordings of groups that take several blocks (_g, _id, _text, _q, _b)."""
    spark = goals.sparkSession
    rounds = goals.agg(F.max("_b")).first()[0] + 1
    slots = spark.createDataFrame([], "_g string, _slot long, _id long, _text string, _q long")

    def meet(now: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """The first older commitments alike of each goal: as many as can change in one block, and one more."""
        out, matcher = {}, difflib.SequenceMatcher()
        asked, most = list(zip(now["_id"], now["_text"])), len(now) + 1
        for slot, text, size in held.sort_values("_slot")[["_slot", "_text", "_q"]].itertuples(index=False):
            matcher.set_seq2(text)
            for goal, words in asked:
                if len(out.get(goal, ())) < most:
                    matcher.set_seq1(words)
                    if alike(matcher):
                        out.setdefault(goal, []).append((slot, size))
        rows = [(now["_g"].iloc[0], goal, s, q) for goal, found in out.items() for s, q in found]
        return pd.DataFrame(rows, columns=["_g", "_id", "_slot", "_q"])

    def close(now: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        now, met = now.sort_values("_id"), met.sort_values("_slot")
        found: dict[int, list[int]] = {}
        for goal, slot in zip(met["_id"].tolist(), met["_slot"].tolist()):
            found.setdefault(goal, []).append(slot)
        rows = settle(list(zip(now["_id"].tolist(), now["_text"], now["_q"].tolist())), found, dict(zip(met["_slot"].tolist(), met["_q"].tolist())))
        last = {s: g for g, s, holds in rows if holds}
        return now.merge(pd.DataFrame(last.items(), columns=["_slot", "_id"]), on="_id")[["_g", "_slot", "_id", "_text", "_q"]]

    for r in range(rounds):
        now = goals.where(F.col("_b") == r).drop("_b")
        parts = max(1, -(-(slots.groupBy("_g").count().agg(F.max("count")).first()[0] or 0) // share))
        dealt = now.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("_g", "_p")
        held = slots.withColumn("_p", F.pmod(F.xxhash64("_slot"), F.lit(parts)).cast("int")).groupBy("_g", "_p")
        met = dealt.cogroup(held).applyInPandas(lambda a, b: meet(a, b) if len(a) and len(b) else pd.DataFrame(columns=["_g", "_id", "_slot", "_q"]), "_g string, _id long, _slot long, _q long")
        fresh = cut(now.groupBy("_g").cogroup(met.groupBy("_g")).applyInPandas(close, "_g string, _slot long, _id long, _text string, _q long"))
        slots = cut(slots.join(fresh.select("_slot"), "_slot", "left_anti").select(*fresh.columns).unionByName(fresh))
    return slots.select("_slot", "_id")
