"""Extraction by a language model as map and reduce: prompts over batches of chunks, answers kept, facts checked.

The map side makes prompts and calls the model for those that have no answer yet, in waves; each wave is committed, so a job that is
killed or whose model fails goes on where it stood and pays for no call twice. The reduce side reads the answers with a
declared schema, resolves their sources, and filters, de-duplicates, ranks and verifies.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.functions.text import TOPICS, topical
from citeline.operators import extract as E
from citeline.operators import segments as S
from citeline.operators.context import short_tag
from citeline.operators.dedupe import dedupe_goals
from citeline.operators.models import AuthError, ModelError, with_retries

#: Calls at a time, and calls between two commits.
CONCURRENCY, WAVE = 5, 500
#: The fields of a model's answers, and what ends a prompt.
GOALS = "goals array<struct<quote string, source_id string, title string, category string, target string, target_year int, baseline string>>"
WORKFORCE = "quote string, source_id string, found boolean, value_text string, metric string, as_of string, scope string, notes string"
ASK_GOALS, ASK_WORKFORCE = "Extract sustainability goals following the rules.", "Extract the workforce (FTE) figure following the rules."
ANSWERS = "digest string, answer string, error string"


def prompts(chunks: DataFrame, by: list[str], order: list[str], ask: str, system: str = "") -> tuple[DataFrame, DataFrame]:
    """((*by, digest, prompt), (*by, source_id, chunk_id, page_start, text)): one prompt a group of bounded size, its sources numbered in order."""
    places = [F.col(c).alias(f"o{i}") for i, c in enumerate([*order, "chunk_id"])]
    held = F.array_sort(F.collect_list(F.struct(*places, "chunk_id", "page_start", "page_end", "kind", "text")))
    each = chunks.groupBy(*by).agg(held.alias("c"))
    numbered = F.transform("c", lambda x, i: F.struct(F.concat(F.lit("S"), (i + 1).cast("string")).alias("source_id"), x["chunk_id"].alias("chunk_id"), x["page_start"].alias("page_start"), x["page_end"].alias("page_end"), x["kind"].alias("kind"), x["text"].alias("text")))
    made = each.select(*by, numbered.alias("s"))
    tags = F.transform("s", lambda x: short_tag(x["source_id"], x["page_start"], x["page_end"], x["kind"], x["text"]))
    prompt = F.concat(F.array_join(tags, "\n\n"), F.lit(f"\n\n{ask}"))
    asked = made.select(*by, prompt.alias("prompt")).withColumn("digest", F.sha2(F.concat(F.lit(system), F.lit("\0"), F.col("prompt")), 256))
    return asked, made.select(*by, F.explode("s").alias("x")).select(*by, "x.source_id", "x.chunk_id", "x.page_start", "x.text")


def kept_answers(spark, path: str) -> DataFrame:
    """(digest, answer, error) of all calls so far."""
    there = any(n.startswith("part-") for n in S.names(spark, path))
    return spark.read.schema(ANSWERS).parquet(path) if there else spark.createDataFrame([], ANSWERS)


def complete_kept(asked: DataFrame, path: str, model: Callable[[str], str], concurrency: int = CONCURRENCY, wave: int = WAVE) -> DataFrame:
    """(digest, answer) of prompts (digest, prompt), called only where ``path`` keeps no answer; equal prompts are one call.

    A wave of about ``wave`` calls runs in ``concurrency`` tasks and is committed whole. A call that fails after its retries is kept as an error and
    tried again by the next run; wrong credentials end the run at once. Prompts are told by their digest, system prompt included.
    """
    spark = asked.sparkSession

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, prompt in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows.append((digest, with_retries(lambda prompt=prompt: model(prompt)), None))
                except AuthError:
                    raise
                except ModelError as e:
                    rows.append((digest, None, f"{type(e).__name__}: {e}"))
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["digest", "answer", "error"])

    def missing() -> DataFrame:
        return asked.select("digest", "prompt").dropDuplicates(["digest"]).join(kept_answers(spark, path).where("answer is not null").select("digest"), "digest", "left_anti")

    todo = missing().count()
    waves = -(-todo // wave)
    for w in range(waves):
        # Dealt by digest, so that what an earlier wave has answered does not move the others.
        now = missing().where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == w).repartition(concurrency)
        now.mapInArrow(call, ANSWERS).write.mode("append").parquet(path)
    return kept_answers(spark, path).where("answer is not null").select("digest", "answer").dropDuplicates(["digest"])


def failed_calls(asked: DataFrame, path: str) -> int:
    """How many prompts have no answer."""
    return asked.select("digest").distinct().join(kept_answers(asked.sparkSession, path).where("answer is not null").select("digest"), "digest", "left_anti").count()


def read_answers(asked: DataFrame, answers: DataFrame, by: list[str], schema: str) -> DataFrame:
    """(*by, a): each prompt's answer with its declared fields; an answer that is no such JSON fails the job."""
    return asked.select(*by, "digest").join(answers, "digest").select(*by, F.from_json("answer", schema, {"mode": "FAILFAST"}).alias("a"))


def goal_candidates(chunks: DataFrame, searched: DataFrame, report: str = "report_id", key: str = "chunk_id") -> DataFrame:
    """Chunks of each report that speak of a topic or that searches (report, key) found, the first 150 in page order."""
    found = chunks.join(searched.select(key), key, "left_semi").select(*chunks.columns)
    return E.candidates(chunks.where(topical(F.col("text"))), found, report, ["page_start"], key)


def extract_goals(candidates: DataFrame, years: DataFrame, path: str, model: Callable[[str], str], report: str = "report_id", system: str = "", compatibility: bool = True, **calls) -> DataFrame:
    """(report, rank, title, category, target, target_year, baseline, quote, chunk_id, page, verified): the goals of each report.

    Map: batches of ten chunks in page order, one call each. Reduce: goals of unknown sources go, then those whose year has passed by
    ``years`` (report, fiscal_year), then rewordings; the first sixty by rank are held against their chunk.
    """
    batched = E.batches(candidates, report, ["page_start", "chunk_id"])
    asked, sources = prompts(batched, [report, "batch"], ["page_start", "chunk_id"], ASK_GOALS, system)
    answers = read_answers(asked, complete_kept(asked, path, model, **calls), [report, "batch"], GOALS)
    goals = answers.select(report, "batch", F.posexplode("a.goals").alias("n", "g")).select(report, "batch", "n", "g.*")
    known = goals.join(sources, [report, "batch", "source_id"]).join(years.select(report, "fiscal_year"), report)
    still = known.where(E.still_open(F.col("target_year"), F.col("fiscal_year"))).withColumn("pos", F.struct("batch", "n"))
    unique = dedupe_goals(still.select(report, "pos", "title", "category", "target", "target_year", "baseline", "quote", "chunk_id"), report, "pos")
    ranked = E.rank_goals(unique.drop("pos"), report, "slot")
    chunks = candidates.select(F.col("chunk_id").alias("id"), "page_start", "text")
    return E.goal_rows(ranked, chunks, compatibility).select(report, "rank", "title", "category", "target", "target_year", "baseline", "quote", "chunk_id", "page", "verified")


def extract_workforce(candidates: DataFrame, path: str, model: Callable[[str], str], report: str = "report_id", order: str = "rank", system: str = "", compatibility: bool = True, **calls) -> DataFrame:
    """(report, chunk_id, quote, value_text, value, page, verified, payload): the workforce figure of each report that has one.

    One call a report over its twelve candidates at most, in ``order``; an answer counts if it is found and cites a given source.
    """
    asked, sources = prompts(candidates, [report], [order], ASK_WORKFORCE, system)
    answers = read_answers(asked, complete_kept(asked, path, model, **calls), [report], WORKFORCE).select(report, "a.*")
    good = answers.where(E.accepted(F.col("found"), F.col("quote"), F.col("source_id"))).join(sources.select(report, "source_id", "chunk_id"), [report, "source_id"])
    return E.fact_rows(good.select(report, "chunk_id", "quote", "value_text"), candidates.select(F.col("chunk_id").alias("id"), "page_start", "text"), compatibility)


_SOURCE = re.compile(r'<source id="(S\d+)"[^>]*>\n(.*?)\n</source>', re.S)
_TOPIC = re.compile(rf"\b({TOPICS})\b", re.I)


def offline_goals(prompt: str) -> str:
    """The offline stand-in for goals: each source's first line of a topic or year, its first words as title and its last year from 2020 on."""
    goals = []
    for source, text in _SOURCE.findall(prompt):
        line = next((x for x in text.split("\n") if _TOPIC.search(x) or re.search(r"20[2-9]\d", x)), None)
        if line:
            year = re.findall(r"20[2-9]\d", line)
            goals.append({"quote": line, "source_id": source, "title": " ".join(line.split()[:6]), "category": "climate" if _TOPIC.search(line) else "other", "target": None, "target_year": int(year[-1]) if year else None, "baseline": None})
    return json.dumps({"goals": goals})


def offline_workforce(prompt: str) -> str:
    """The offline stand-in for workforce figures: the first number of three digits or more beside the word employees or workforce."""
    for source, text in _SOURCE.findall(prompt):
        for line in text.split("\n"):
            number = re.search(r"\d{1,3}(?:,\d{3})+|\d{3,}", line)
            if number and re.search(r"employees|workforce|headcount", line, re.I):
                return json.dumps({"quote": line, "source_id": source, "found": True, "value_text": number[0], "metric": "headcount"})
    return json.dumps({"found": False, "metric": "other"})
