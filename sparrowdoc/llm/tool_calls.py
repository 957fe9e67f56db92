"""Chat formatting: tool calls linked to their results.

Calls and results are hash-joined by conversation and call id. Each
conversation's calls are ordered so that a call comes after those it depends
on, arguments are validated against the tool's schema, and the conversation is
serialised as canonical JSON (sorted keys, no spaces, UTF-8).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tools that chat turns are taken as calls of, and what their arguments must look like.
SCHEMAS = {
    "reply": {
        "type": "object",
        "required": ["prompt", "turn"],
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "additionalProperties": False,
    },
    "search": {
        "type": "object",
        "required": ["query", "limit"],
        "properties": {
            "query": {"type": "string", "minLength": 1},
            "limit": {"type": "integer", "minimum": 1, "maximum": 50},
            "filters": {"type": "object", "required": ["exact"], "properties": {"exact": {"type": "boolean"}, "order": {"type": "string", "enum": ["best", "new"]}}},
        },
    },
    "lookup": {"type": "object", "required": ["keys"], "properties": {"keys": {"type": "array", "items": {"type": "string"}}, "depth": {"type": "number", "minimum": 0, "maximum": 10}}},
}

KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def problems(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with ``value`` under a schema of types, required and known
    properties, items, enumerations, and least and largest values and lengths."""
    kind = schema.get("type")
    if kind and (not isinstance(value, KINDS[kind]) or (isinstance(value, bool) and kind in ("integer", "number"))):
        return [f"{at}: not of type {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not among the allowed values")
    if isinstance(value, str):
        size = len(value)
        if size < schema.get("minLength", 0) or size > schema.get("maxLength", size):
            out.append(f"{at}: length {size}")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{at}: out of range")
    elif isinstance(value, list):
        out += [p for i, x in enumerate(value) for p in problems(x, schema.get("items", {}), f"{at}[{i}]")]
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: unknown" for k in sorted(set(value) - set(known))]
        out += [p for k, s in known.items() if k in value for p in problems(value[k], s, f"{at}.{k}")]
    return out


def canonical(value: Any) -> str:
    """Sorted keys, no spaces, text as it is; half surrogate pairs, which UTF-8 can't hold,
    stay escaped. Numbers that JSON doesn't know raise ValueError."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode("utf-8", "backslashreplace").decode()


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def parsed(arguments: str | None, schema: dict | None) -> tuple[Any, list[str]]:
    """The arguments' value and what is wrong with it. What is no JSON (NaN and infinities
    too) or nested too deep to read stays the text it is; without a schema the tool is unknown."""
    try:
        value = json.loads(arguments, parse_constant=_no_number)
        canonical([[[[value]]]])  # as deep as it stands in a chat
        return value, problems(value, schema) if schema is not None else ["$: unknown tool"]
    except RecursionError:
        return arguments, ["$: nested too deep"]
    except (TypeError, ValueError):
        return arguments, ["$: not JSON"]


def ordered(calls: list[dict]) -> tuple[list[dict], bool]:
    """Calls after those that they depend on, else by turn and id; whether there is no cycle.

    Dependencies on unknown ids are ignored; calls in a cycle come last, by turn.
    """
    first: dict[str, int] = {}
    for i, c in enumerate(calls):
        first.setdefault(c["call_id"], i)
    waits = [len({a for a in c["after"] or [] if a in first and first[a] != i}) for i, c in enumerate(calls)]
    frees: dict[int, list[int]] = {}
    for i, c in enumerate(calls):
        for a in {a for a in c["after"] or [] if a in first and first[a] != i}:
            frees.setdefault(first[a], []).append(i)
    rank = lambda i: (calls[i]["turn"] is None, calls[i]["turn"] or 0, calls[i]["call_id"], i)
    ready = [rank(i) for i, w in enumerate(waits) if not w]
    heapq.heapify(ready)
    out = []
    while ready:
        i = heapq.heappop(ready)[-1]
        out.append(i)
        for j in frees.get(i, ()):
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(ready, rank(j))
    cyclic = sorted(set(range(len(calls))) - set(out), key=rank)
    return [calls[i] for i in out + cyclic], not cyclic


def turns_as_calls(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain chat rows ``df(conv_id, turn, role, text)``.

    A user's turn t is a call with id "conv:t" that waits for the one two turns
    before. With m = t + the text's length in code points, m mod 4 tells the tool:
    reply, search, lookup, or translate, which has no schema. The whole text is in
    the arguments; where m mod 11 is 5 the arguments are the bare text, which is no
    JSON; a search's limit is m mod 60, as text where m mod 7 is 3; a lookup's depth
    is m mod 14. Where m mod 13 is 1 the call also waits for the one two turns later,
    which makes a cycle. An assistant's turn is the result of the turn before it, but
    where m mod 17 is 2 it cites a call that isn't there. Turns of other roles are in
    :func:`other_turns`. Null texts have length 0 and become null arguments or contents.
    """
    tag = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    m = F.coalesce("turn", F.lit(0)) + F.coalesce(F.char_length("text"), F.lit(0))
    mod = lambda k: F.pmod(m, F.lit(k))
    to_json = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    filters = F.struct((mod(2) == 1).alias("exact"), F.when(mod(3) == 0, "best").otherwise("new").alias("order")).alias("filters")
    query, limit = F.col("text").alias("query"), mod(60)
    search = F.when(mod(7) == 3, to_json(query, limit.cast("string").alias("limit"), filters)).otherwise(to_json(query, limit.alias("limit"), filters))
    arguments = (
        F.when(mod(11) == 5, F.col("text"))
        .when(mod(4) == 0, to_json(F.col("text").alias("prompt"), "turn"))
        .when(mod(4) == 1, search)
        .when(mod(4) == 2, to_json(F.split("text", " ").alias("keys"), mod(14).alias("depth")))
        .otherwise(to_json("text"))
    )
    name = F.element_at(F.array(*map(F.lit, ("reply", "search", "lookup", "translate"))), (mod(4) + 1).cast("int"))
    after = F.when(mod(13) == 1, F.array(tag(2), tag(-2))).otherwise(F.array(tag(2)))
    calls = df.where(F.col("role") == "user").select("conv_id", "turn", tag(0).alias("call_id"), name.alias("name"), arguments.alias("arguments"), after.alias("after"))
    results = df.where(F.col("role") == "assistant").select("conv_id", "turn", F.when(mod(17) == 2, tag(-1000)).otherwise(tag(1)).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def other_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content) of chat rows that are neither call nor result, null roles included."""
    return df.where(F.col("role").isNull() | ~F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", F.col("text").alias("content"))


def _key(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Full outer hash join by conversation and call id: one row for each call with
    each of its results, each call without one, and each result without a call.
    A call's ``row`` tells it from its repeats."""
    left = calls.select(F.col("conv_id"), _key("call_id").alias("call_id"), F.struct("turn", "name", "arguments", "after", F.monotonically_increasing_id().alias("row")).alias("call"))
    right = results.select(F.col("conv_id"), _key("call_id").alias("call_id"), F.struct("turn", "content").alias("result"))
    return left.hint("shuffle_hash").join(right, ["conv_id", "call_id"], "full_outer")


def format_chats(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], messages: DataFrame | None = None) -> DataFrame:
    """One row for each conversation that has a call, a result or a message.

    ``calls(conv_id, turn, call_id, name, arguments, after)``, ``results(conv_id,
    turn, call_id, content)``, ``messages(conv_id, turn, role, content)``: turns that
    are neither, kept in the chat by turn, role and content. Returns conv_id, n_calls, n_linked (calls with a
    result), n_orphan_calls, n_orphan_results, n_invalid (arguments that are no
    JSON, nested too deep, or break the schema of the tool, or unknown tools), n_messages, acyclic, call_order
    (ids, comma-joined), chat (canonical JSON) and chat_sha256. Several results of
    one call are listed by turn and content; repeated calls stay separate, each with all results. A null
    call id is the id ""; rows of null conv_id link with nothing.
    """
    links = link(calls, results)
    if messages is None:
        links = links.withColumn("message", F.lit(None).cast("struct<turn:bigint,role:string,content:string>"))
    else:
        links = links.unionByName(messages.select("conv_id", F.struct("turn", "role", "content").alias("message")), allowMissingColumns=True)
    linked = links.groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "call", "result", "message")).alias("links"))

    def chat(links: list[dict]) -> list:
        found: dict[tuple[str, int], dict] = {}
        orphans, others = [], []
        for x in links:
            result = x["result"]
            if x["message"] is not None:
                others.append(x["message"])
                continue
            if x["call"] is None:
                orphans.append(result | {"call_id": x["call_id"]})
                continue
            call = x["call"] | {"call_id": x["call_id"]}
            row = call.pop("row")
            held = found.setdefault((json.dumps(call, sort_keys=True), row), call | {"results": []})
            if result is not None:
                held["results"].append(result)
        order, acyclic = ordered([found[k] for k in sorted(found)])
        rows, invalid = [], 0
        for c in order:
            arguments, wrong = parsed(c["arguments"], schemas.get(c["name"]))
            invalid += bool(wrong)
            by_turn = sorted(c["results"], key=lambda r: (r["turn"] is None, r["turn"] or 0, r["content"] or ""))
            rows.append({"id": c["call_id"], "name": c["name"], "arguments": arguments, "results": [r["content"] for r in by_turn], "errors": wrong})
        lost = sorted(([o["call_id"], o["content"]] for o in orphans), key=lambda o: (o[0], o[1] or ""))
        others.sort(key=lambda m: (m["turn"] is None, m["turn"] or 0, m["role"] or "", m["content"] or ""))
        text = canonical({"calls": rows, "messages": others, "orphan_results": lost})
        linked = sum(bool(c["results"]) for c in order)
        return [len(rows), linked, len(rows) - linked, len(lost), invalid, len(others), acyclic, ",".join(c["call_id"] for c in order), text, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()]

    names = ["n_calls", "n_linked", "n_orphan_calls", "n_orphan_results", "n_invalid", "n_messages", "acyclic", "call_order", "chat", "chat_sha256"]
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.string(), pa.string(), pa.string()]

    def work(batches):
        for b in batches:
            rows = [chat(x) for x in b.column("links").to_pylist()]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *cols], names=["conv_id", *names])

    kind = linked.schema["conv_id"].dataType.simpleString()
    return linked.mapInArrow(work, f"conv_id {kind}, " + ", ".join(f"{n} {'boolean' if n == 'acyclic' else 'long' if n[:2] == 'n_' else 'string'}" for n in names))
