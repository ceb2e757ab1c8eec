"""Chat formatting: tool calls linked with their results.

Method. Calls and results are joined by hash on conversation and identifier. Calls are ordered topologically:
a call's level is one more than the highest level it refers to, and a result follows its call. Calls with a single
reference point along their chain, and the pointers double in each round of equi-joins, so a chain takes as many
rounds as its length has binary digits; rounds over the calls still open are left to calls with several
references. Texts are parsed once and the parsed rows are stored. Arguments are validated against the JSON schema of
the called tool, and every row is serialised as canonical JSON (sorted keys, no white space, UTF-8).
Rows are never gathered by conversation, so one conversation may hold any share of them.

Defined cases: an identifier used twice belongs to the first call by turn and place, later ones are ``repeated``;
a result without a call is an ``orphan``; a call without a result is ``open``; references to nothing are
ignored and calls on a cycle get level null and the error ``cycle``; arguments that are no JSON object or
tools without a schema are invalid with a reason; numbers that are not finite and JSON that is nested too
deep to be read are no JSON; half surrogates become U+FFFD; references that are no list are none; null and empty texts
are the empty text and very long ones are kept whole; repeated rows stay repeated; a null conversation or
turn stays null and links with nothing; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.llm.common import cut, small_batches, stored

#: Schemas of the tools that ``exchanges`` makes of the turns of a conversation.
TURN_TOOLS = {
    "answer": {
        "type": "object",
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["prompt", "turn"],
        "additionalProperties": False,
    }
}
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def parsed(text: str):
    """The value of a JSON text; ValueError for what is none, holds numbers that are not finite, or is nested too deep."""

    def number(digits: str) -> float:
        if not math.isfinite(x := float(digits)):
            raise ValueError("a number is not finite")
        return x

    try:
        return json.loads(text, parse_float=number, parse_constant=number)
    except RecursionError:
        raise ValueError("nested too deep") from None


def whole(text: str | None) -> str | None:
    """The text with half surrogates replaced, which no UTF-8 can hold."""
    return text if text is None or text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def canonical(value) -> str:
    """Canonical JSON: keys sorted by code point, no white space, whole floats as integers."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and math.isfinite(x) and x == int(x) and abs(x) < 1e15 else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def problems(value, schema: dict, path: str = "$") -> list[str]:
    """Where a value breaks a schema of type, enum, bounds, lengths, properties and items."""
    kind = schema.get("type")
    if kind in ("integer", "number"):
        fits = isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or math.isfinite(value) and value == int(value))
    else:
        fits = kind is None or isinstance(value, TYPES[kind])
    if not fits:
        return [f"{path}: not {kind}"]
    out = [f"{path}: not in enum"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, str):
        out += [f"{path}: too short"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{path}: too long"] if len(value) > schema.get("maxLength", math.inf) else []
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{path}: too small"] if value < schema.get("minimum", -math.inf) else []
        out += [f"{path}: too large"] if value > schema.get("maximum", math.inf) else []
    elif isinstance(value, list):
        for i, x in enumerate(value):
            out += problems(x, schema.get("items", {}), f"{path}[{i}]")
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{path}.{k}: unknown")
    return out


def exchanges(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of a table (conv_id, turn, role, text).

    Tool calls in JSON, as {"tool_calls": [{"id", "name", "arguments", "after": [ids]}]} from the assistant and
    {"tool_call_id", "content"} from the tool, are taken as they are. Every other user turn is a call of
    ``answer`` named by its turn, which refers to the call two turns before, and every other assistant turn
    the result for the turn before it; other roles are results of no call.
    """
    entry = "struct<kind:string,place:int,call_id:string,name:string,payload:string,after:array<string>>"

    @F.pandas_udf(f"array<{entry}>")
    def read(turn: pd.Series, role: pd.Series, text: pd.Series) -> pd.Series:
        def one(t, r, x):
            x = x or ""
            t = None if pd.isna(t) else int(t)
            found = None
            if x.lstrip()[:1] == "{" and ("tool_call" in x):
                try:
                    found = parsed(x)
                except ValueError:
                    found = None
            name = lambda v: None if v is None else whole(v if isinstance(v, str) else json.dumps(v))
            if isinstance(found, dict) and isinstance(found.get("tool_calls"), list):
                calls = [c if isinstance(c, dict) else {} for c in found["tool_calls"]]
                after = lambda c: [name(a) for a in c["after"] if a is not None] if isinstance(c.get("after"), list) else []
                return [{"kind": "call", "place": i, "call_id": name(c.get("id")), "name": name(c.get("name")), "payload": name(c.get("arguments")) or "null", "after": after(c)} for i, c in enumerate(calls)]
            if isinstance(found, dict) and "tool_call_id" in found:
                return [{"kind": "result", "place": 0, "call_id": name(found["tool_call_id"]), "name": None, "payload": json.dumps(found.get("content")), "after": []}]
            if r == "user":
                return [{"kind": "call", "place": 0, "call_id": None if t is None else str(t), "name": "answer", "payload": json.dumps({"prompt": x, "turn": t}), "after": [] if t is None else [str(t - 2)]}]
            return [{"kind": "result", "place": 0, "call_id": str(t - 1) if r == "assistant" and t is not None else None, "name": None, "payload": json.dumps(x), "after": []}]

        return pd.Series([one(*row) for row in zip(turn, role, text)])

    small_batches(turns.sparkSession, 1000)
    rows = stored(turns.select("conv_id", "turn", "role", F.explode(read("turn", "role", "text")).alias("e")).select("conv_id", "turn", "role", "e.*"))
    return rows.where("kind = 'call'").drop("kind"), rows.where("kind = 'result'").drop("kind", "name", "after")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of owned calls (conv_id, call_id, after): 0 without references, null on a cycle or after one."""
    at, none = ["conv_id", "call_id"], F.lit(None).cast("int")
    nodes = cut(calls.select(*at))
    edges = calls.select(*at, F.explode("after").alias("ref")).distinct()
    edges = cut(edges.join(nodes.withColumnRenamed("call_id", "ref"), ["conv_id", "ref"]).select(*at, "ref"))
    degree = edges.groupBy(*at).agg(F.count(F.lit(1)).alias("refs"), F.min("ref").alias("to"))
    jumps = cut(degree.where("refs = 1").select(*at, "to", F.lit(1).alias("steps")))
    # Pointer doubling along the calls with one reference, to the next call with none or several.
    for _ in range(max(jumps.count(), 1).bit_length()):
        on = jumps.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        joined = jumps.join(on, ["conv_id", "to"], "left")
        grown = cut(joined.select(*at, F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")))
        jumps = grown.drop("moved")
        if not grown.where("moved").limit(1).collect():
            break
    single = jumps.select(*at)
    several = degree.where("refs > 1").select(*at)
    done = nodes.join(single.unionByName(several), at, "left_anti").withColumn("level", F.lit(0))
    # A reference of a call with several is a reference to where its chain ends, so many steps further.
    ends = jumps.select("conv_id", F.col("call_id").alias("ref"), "to", "steps")
    open_ = cut(edges.join(several, at, "left_semi").join(ends, ["conv_id", "ref"], "left").select(*at, F.coalesce("to", "ref").alias("ref"), F.coalesce("steps", F.lit(0)).alias("steps")))
    left = open_.count()
    while left:
        met = open_.join(done.withColumnRenamed("call_id", "ref"), ["conv_id", "ref"], "left")
        ready = met.groupBy(*at).agg(F.count_if(F.col("level").isNull()).alias("missing"), (F.max(F.col("level") + F.col("steps")) + 1).cast("int").alias("level")).where("missing = 0").drop("missing")
        new = cut(ready.join(done, at, "left_anti"))
        done = cut(done.unionByName(new))
        open_ = cut(open_.join(new, at, "left_anti"))
        before, left = left, open_.count()
        if left == before:
            break
    done = done.unionByName(open_.select(*at).distinct().withColumn("level", none))
    ended = jumps.join(done.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"], "left")
    return done.unionByName(ended.select(*at, (F.col("level") + F.col("steps")).cast("int").alias("level")))


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row per call and result: conv_id, turn, place, kind, call_id, call_turn, level, state, valid, errors, json."""
    schemas = TURN_TOOLS if schemas is None else schemas
    first = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "place", F.xxhash64("payload").alias("h"))).alias("f"), F.min_by("after", F.struct("turn", "place")).alias("after"))
    owned = first.select("conv_id", "call_id", F.col("f.turn").alias("call_turn"), F.col("f.place").alias("_p"), F.col("f.h").alias("_h"), "after")
    steps = owned.drop("after").join(levels(owned), ["conv_id", "call_id"], "left")
    answered = results.select("conv_id", "call_id").distinct().withColumn("_answered", F.lit(True))
    owner = F.col("turn").eqNullSafe(F.col("call_turn")) & (F.col("place") == F.col("_p")) & (F.xxhash64("payload") == F.col("_h"))
    call_rows = (
        calls.join(steps, ["conv_id", "call_id"], "left")
        .join(answered, ["conv_id", "call_id"], "left")
        .select(
            "conv_id", "turn", "place", "role", F.lit("call").alias("kind"), "call_id", "name", "payload", "call_turn", "level",
            F.when(~F.coalesce(owner, F.lit(False)), "repeated").when(F.col("level").isNull(), "cycle").when(F.col("_answered"), "linked").otherwise("open").alias("state"),
        )
    )
    result_rows = results.join(steps, ["conv_id", "call_id"], "left").select(
        "conv_id", "turn", "place", "role", F.lit("result").alias("kind"), "call_id", F.lit(None).cast("string").alias("name"), "payload", "call_turn", "level",
        F.when(F.col("call_turn").isNull(), "orphan").otherwise("linked").alias("state"),
    )

    @F.pandas_udf("struct<valid:boolean,errors:array<string>,json:string>")
    def finish(conv: pd.Series, turn: pd.Series, role: pd.Series, kind: pd.Series, call_id: pd.Series, name: pd.Series, payload: pd.Series, state: pd.Series) -> pd.DataFrame:
        out = []
        for c, t, r, k, i, n, p, s in zip(conv, turn, role, kind, call_id, name, payload, state):
            try:
                value = parsed(p) if p else None
            except ValueError:
                value = p
            errors = [] if s in ("linked", "open") else [s]
            try:
                if k == "call":
                    errors += map(whole, problems(value, schemas[n])) if n in schemas else ["no schema"]
                row = {"conversation": None if pd.isna(c) else c if isinstance(c, str) else int(c), "id": i, "role": r, "turn": None if pd.isna(t) else int(t), "type": k}
                row |= {"name": n, "arguments": value} if k == "call" else {"content": value}
                line = whole(canonical(row))
            except RecursionError:
                errors.append("nested too deep")
                line = None
            out.append((not errors, errors, line))
        return pd.DataFrame(out, columns=["valid", "errors", "json"])

    both = call_rows.unionByName(result_rows)
    made = both.withColumn("f", finish("conv_id", "turn", "role", "kind", "call_id", "name", "payload", "state"))
    step = F.when(F.col("kind") == "call", F.col("level") * 2).otherwise(F.col("level") * 2 + 1)
    return made.select("conv_id", "turn", "place", "kind", "call_id", "call_turn", step.cast("int").alias("level"), "state", "f.valid", "f.errors", "f.json")
