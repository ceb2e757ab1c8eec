"""Answers and gold sets by a language model: prompts, kept calls, and the checks that follow."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.operators.evalkit import accepted_gold
from citeline.operators.extraction import complete_kept, read_answers
from citeline.operators.verify import check_answer, verify_citations

#: The fields of the model's answers, and what stands where nothing was retrieved.
ANSWER = "citations array<struct<source_id string, quote string, label string, value_text string, unit string, period string>>, status string, answer string, caveats array<string>"
QUESTION = "usable boolean, question string, expected_quote string"
NO_SOURCES = "(no relevant sources were found for this question)"


def given(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def digested(rows: DataFrame, system: str) -> DataFrame:
    """Rows with the ``digest`` of their prompt and the system prompt, which names the call."""
    return rows.withColumn("digest", F.sha2(F.concat(F.lit(system), F.lit("\0"), F.col("prompt")), 256))


def answer_prompt(message: Column, interpreted_as: Column, context: Column, history: Column) -> Column:
    """Sources, the conversation so far if there is one, the question, and how it was understood if that differs."""
    sources = F.concat(F.lit("<sources>\n"), F.when(given(context), context).otherwise(NO_SOURCES), F.lit("\n</sources>"))
    question = F.concat(F.lit("Question: "), message, F.when(given(interpreted_as), F.concat(F.lit("\nInterpreted as: "), interpreted_as)).otherwise(""))
    return F.concat_ws("\n\n", sources, F.when(given(history), F.concat(F.lit("Conversation so far:\n"), history)), question)


def answered(turns: DataFrame, sources: DataFrame, path: str, model: Callable[[str], str], system: str = "", compatibility: bool = True, **calls) -> DataFrame:
    """(turn_id, status, answer, caveats, citations with verified and value) of turns (turn_id, message, interpreted_as, context, history).

    ``sources`` (turn_id, source_id, text) are what the context shows: citations of others go, quotes are held against
    them, and the answer's status and caveats follow. Citations keep their order; a turn whose call failed is left out.
    """
    asked = digested(turns.withColumn("prompt", answer_prompt(F.col("message"), F.col("interpreted_as"), F.col("context"), F.col("history"))), system)
    found = read_answers(asked, complete_kept(asked, path, model, **calls), ["turn_id"], ANSWER).select("turn_id", "a.*")
    cited = found.select("turn_id", F.posexplode(F.coalesce("citations", F.array().cast("array<struct<source_id:string,quote:string,label:string,value_text:string,unit:string,period:string>>"))).alias("pos", "c")).select("turn_id", "pos", "c.*")
    checked = verify_citations(cited, sources, compatibility=compatibility)
    fields = ["source_id", "quote", "label", "value_text", "unit", "period", "verified", "value"]
    listed = checked.groupBy("turn_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", *fields))), lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("_c"))
    none = F.array().cast(listed.schema["_c"].dataType)
    turned = found.drop("citations").join(listed, "turn_id", "left").withColumn("citations", F.coalesce("_c", none)).withColumn("caveats", F.coalesce("caveats", F.array().cast("array<string>")))
    return check_answer(turned.select("turn_id", "status", "answer", "caveats", "citations"))


def gold_set(chunks: DataFrame, path: str, model: Callable[[str], str], system: str = "", compatibility: bool = True, **calls) -> DataFrame:
    """Sampled chunks (id, company, fiscal_year, page_start, text, ...) with ``question`` and ``expected_quote``, where the model's entry is
    usable and its quote stands in the chunk; chunks without such an entry are left out."""
    excerpt = F.concat(F.lit('<excerpt company="'), "company", F.lit('" year="'), F.col("fiscal_year").cast("string"), F.lit('" page="'), F.col("page_start").cast("string"), F.lit('">\n'), "text", F.lit("\n</excerpt>"))
    asked = digested(chunks.withColumn("prompt", excerpt), system)
    made = read_answers(asked, complete_kept(asked, path, model, **calls), ["id"], QUESTION).select(F.col("id").alias("chunk_id"), "a.*")
    taken = accepted_gold(made, chunks, compatibility).select(F.col("chunk_id").alias("id"), "question", "expected_quote")
    return chunks.join(taken, "id")


def offline_question(prompt: str) -> str:
    """The offline stand-in for questions: what the page says, with the first line that is not blank as the expected quote."""
    head, _, rest = prompt.partition("\n")
    lines = [x for x in rest.rsplit("\n</excerpt>", 1)[0].split("\n") if x.strip()]
    page = head.split('page="')[1].split('"')[0]
    return json.dumps({"usable": bool(lines), "question": f"What is said on page {page}?", "expected_quote": lines[0] if lines else ""})


def offline_answer(prompt: str) -> str:
    """The offline stand-in for answers: the first line of the first source, quoted and cited; not_found without sources."""
    if NO_SOURCES in prompt or '<source id="' not in prompt:
        return json.dumps({"citations": [], "status": "not_found", "answer": "", "caveats": []})
    source = prompt.split('<source id="', 1)[1]
    quote = next((x for x in source.split(">\n", 1)[1].split("\n</source>", 1)[0].split("\n") if x.strip()), "")
    name = source.split('"', 1)[0]
    return json.dumps({"citations": [{"source_id": name, "quote": quote}], "status": "answered", "answer": f"{quote} [{name}]", "caveats": []})
