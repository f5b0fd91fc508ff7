"""Chat formatting: links tool calls to their results and writes canonical JSON.

Turns whose text is a JSON object with ``tool_calls`` (a list of objects with id, name and
arguments, and optionally ``after``, ids of calls whose results they need) are calls; turns with
``tool_call_id`` are results. Calls and results meet in a hash join on (conversation, call id).
The calls of a conversation are ordered topologically: by depth, the longest chain of ``after``
links before them, then by turn and place. Depth is worked out in rounds of joins over the links
of all conversations at once, chains of any length by doubled pointers; calls in a cycle, or after one,
keep depth null and come last.

Arguments are checked against the schema given for the call's name: ``type`` (one or a list), ``enum``,
``properties``, ``required``, ``additionalProperties`` and ``items``, at every level. Canonical JSON has sorted keys, no spaces
and text as it is. Every turn comes back: plain turns as {"content", "role"}, call turns with
their ordered, checked calls, results with the name of the call they answer.

Defined cases: text that is null, no JSON object or holds lone surrogates is a plain turn; a call without an id is
``no_id`` and links nothing; of several calls with one id the first by turn and place is linked;
a result without call is ``orphan``, one before its call ``early``; a call without result is
``open``; an unknown name or arguments that aren't an object are faults like schema violations;
repeated turns stay separate rows; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stash

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
_CALL = "array<struct<id: string, name: string, arguments: string, fault: string, after: array<string>>>"


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is(value, kind: str) -> bool:
    found = _TYPES.get(kind)
    return found is None or isinstance(value, found) and not (isinstance(value, bool) and kind in ("integer", "number"))


def _violation(schema: dict, value, path: str) -> str | None:
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds if isinstance(kinds, list) else []
    if kinds and not any(_is(value, k) for k in kinds if isinstance(k, str)):
        return f"type:{path}"
    if "enum" in schema and canonical(value) not in [canonical(e) for e in schema["enum"]]:
        return f"enum:{path}"
    if isinstance(value, dict):
        return _members(schema, value, path)
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, item in enumerate(value):
            fault = _violation(schema["items"], item, f"{path}[{i}]")
            if fault:
                return fault
    return None


def _members(schema: dict, value: dict, path: str) -> str | None:
    properties, extra = schema.get("properties", {}), schema.get("additionalProperties", True)
    inside = f"{path}." if path else ""
    for name in sorted(schema.get("required", ())):
        if name not in value:
            return f"missing:{inside}{name}"
    for name in sorted(value):
        rule = properties.get(name, extra if isinstance(extra, dict) else None)
        if rule is None and name not in properties and extra is False:
            return f"unexpected:{inside}{name}"
        fault = _violation(rule, value[name], inside + name) if isinstance(rule, dict) else None
        if fault:
            return fault
    return None


def argument_fault(schema: dict | None, arguments) -> str | None:
    """The first violation by path, down to nested objects and lists, or None."""
    if schema is None:
        return "unknown_tool"
    return _members(schema, arguments, "") if isinstance(arguments, dict) else "not_an_object"


def _parsed(text):
    """A JSON object that is text throughout (no lone surrogates), or None."""
    try:
        value = json.loads(text) if text and text.lstrip()[:1] == "{" else None
        canonical(value).encode()
        return value if isinstance(value, dict) else None
    except (ValueError, RecursionError):
        return None


def as_calls(turns: DataFrame) -> DataFrame:
    """Plain turns as tool traffic: user turn t is a call that needs the call two turns before,
    through the whole conversation; assistant turn t is the result of the call before it.

    The length of a text decides which tool is called and what is wrong: arguments of another type or
    outside their list, an unknown tool, the id of an earlier call, a result of no call.
    """
    ident = lambda c: F.concat(F.lit("call_"), c.cast("string"))
    size, turn = F.length(F.coalesce("text", F.lit(""))), F.col("turn")
    before = F.when(turn >= 2, F.array(ident(turn - 2))).otherwise(F.array().cast("array<string>"))
    own = F.when((size % 19 == 0) & (turn >= 2), ident(turn - 2)).otherwise(ident(turn))
    name = F.when(size % 13 == 0, "fetch").when(size % 2 == 0, "search").otherwise("lookup")
    search = F.struct(F.coalesce("text", F.lit("")).alias("query"), F.when(size % 5 == 0, "ten").alias("limit"))
    lookup = F.struct(F.when(size % 7 != 0, size).alias("id"), F.when(size % 11 == 0, "xx").otherwise("de").alias("lang"))
    body = F.when(size % 2 == 0, F.to_json(search)).otherwise(F.to_json(lookup))
    # Arguments come as JSON text, which parse_turns opens.
    call = F.to_json(F.struct(F.array(F.struct(
        own.alias("id"), name.alias("name"), body.alias("arguments"), before.alias("after"))).alias("tool_calls")))
    answered = F.when(size % 17 == 0, F.lit("call_none")).otherwise(ident(turn - 1))
    result = F.to_json(F.struct(answered.alias("tool_call_id"), F.coalesce("text", F.lit("")).alias("content")))
    text = F.when((F.col("role") == "user") & turn.isNotNull(), call).when(
        (F.col("role") == "assistant") & turn.isNotNull(), result).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", "role", text.alias("text"))


def parse_turns(turns: DataFrame, schemas: dict) -> DataFrame:
    """Every turn with its kind (plain, calls, result), calls and answered id."""
    base = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")

    def parse(batches):
        for batch in batches:
            kinds, calls, answers = [], [], []
            for text in batch.column(3).to_pylist():
                value = _parsed(text)
                listed = value.get("tool_calls") if value else None
                kind, found, answer = "plain", None, None
                if isinstance(listed, list) and listed and all(isinstance(c, dict) for c in listed):
                    kind, found = "calls", []
                    for c in listed:
                        arguments = c.get("arguments")
                        if isinstance(arguments, str):
                            arguments = _parsed(arguments) if _parsed(arguments) is not None else arguments
                        name = c.get("name") if isinstance(c.get("name"), str) else None
                        after = [a for a in c.get("after") or () if isinstance(a, str)] if isinstance(c.get("after"), list) else []
                        found.append({"id": c["id"] if isinstance(c.get("id"), str) and c["id"] else None, "name": name,
                                      "arguments": canonical(arguments), "fault": argument_fault(schemas.get(name), arguments), "after": after})
                elif value and isinstance(value.get("tool_call_id"), str):
                    kind, answer = "result", value["tool_call_id"]
                kinds.append(kind), calls.append(found), answers.append(answer)
            item = pa.struct([(n, pa.string()) for n in ("id", "name", "arguments", "fault")] + [("after", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(kinds), pa.array(calls, pa.list_(item)), pa.array(answers, pa.string())],
                names=["conv_id", "turn", "role", "text", "kind", "calls", "answers"])
    return base.mapInArrow(parse, f"conv_id bigint, turn bigint, role string, text string, kind string, calls {_CALL}, answers string")


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, id, depth) of linked calls: longest chain of ``after`` links; null in or after a cycle.

    A call with one link points at the call before it; doubling the pointers brings it, in a number of
    rounds that is the logarithm of the chain, to a call with no link or with several. Only
    those then take a round of joins a level.
    """
    both = ["conv_id", "id"]
    nodes = calls.select(*both)
    edges = calls.select(*both, F.explode("after").alias("before")).distinct()
    edges = stash(edges.join(nodes.withColumnRenamed("id", "before"), ["conv_id", "before"]))
    links = edges.groupBy(*both).agg(F.count(F.lit(1)).alias("n"), F.min("before").alias("before"))
    single = F.coalesce("n", F.lit(0)) == 1
    # head: the call where the chain of single links begins, once ``open`` is false.
    points = stash(nodes.join(links, both, "left").select(
        *both, F.when(single, F.col("before")).otherwise(F.col("id")).alias("head"), single.cast("int").alias("far"), single.alias("open")))
    steps, total = 1, points.count()
    while not points.filter("open").isEmpty() and steps <= 2 * total:  # longer chains are cycles
        ahead = points.select("conv_id", F.col("id").alias("head"), F.col("head").alias("_head"), F.col("far").alias("_far"), F.col("open").alias("_open"))
        points = stash(points.join(ahead, ["conv_id", "head"]).select(
            *both, F.when(F.col("open"), F.col("_head")).otherwise(F.col("head")).alias("head"),
            (F.col("far") + F.when(F.col("open"), F.col("_far")).otherwise(0)).alias("far"), (F.col("open") & F.col("_open")).alias("open")))
        steps *= 2
    placed = points.filter("NOT open").select("conv_id", F.col("id").alias("before"), F.col("head").alias("from"), "far")
    # Levels of the calls with several links; one that waits for a cycle never gets a depth.
    merging = stash(edges.join(links.filter("n > 1").select(*both), both).join(placed, ["conv_id", "before"], "left"))
    done = stash(nodes.join(links, both, "left_anti").withColumn("depth", F.lit(0)))
    rounds = 0
    while True:
        rest = merging.join(done, both, "left_anti")
        known = rest.join(done.select("conv_id", F.col("id").alias("from"), F.col("depth").alias("_d")), ["conv_id", "from"], "left").groupBy(*both).agg(
            F.count_if(F.col("_d").isNull()).alias("waiting"), F.max(F.col("_d") + F.col("far") + 1).alias("depth"))
        fresh = stash(known.filter("waiting = 0").select(*both, F.col("depth").cast("int").alias("depth")))
        if fresh.isEmpty():
            break
        rounds += 1
        done = done.unionByName(fresh) if rounds % 16 else stash(done.unionByName(fresh))
    starts = done.select("conv_id", F.col("id").alias("from"), F.col("depth").alias("_d"))
    found = placed.join(starts, ["conv_id", "from"]).select("conv_id", F.col("before").alias("id"), (F.col("_d") + F.col("far")).cast("int").alias("depth"))
    return nodes.join(found, both, "left")


def _quoted(c):
    """A JSON string of the column, or null: quotes, backslashes and control characters escaped."""
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        sign = json.dumps(chr(code))[1:-1]
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(sign))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def link(turns: DataFrame, schemas: dict) -> DataFrame:
    """conv_id, turn, role, kind, n_calls, status, json for every turn."""
    parsed = stash(parse_turns(turns, schemas).withColumn("text_key", F.xxhash64("text")))
    # Repeated turns have the same calls and are folded until the end.
    flat = parsed.filter("kind = 'calls'").select("conv_id", "turn", "text_key", F.posexplode("calls").alias("place", "c")).select(
        "conv_id", "turn", "text_key", "place", "c.*").distinct()
    first = Window.partitionBy("conv_id", "id").orderBy("turn", "place", "arguments", "text_key")
    named = stash(flat.filter("id IS NOT NULL AND conv_id IS NOT NULL").withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n"))
    results = parsed.filter("kind = 'result' AND conv_id IS NOT NULL").select("conv_id", F.col("answers").alias("id"), F.col("turn").alias("answered"))
    answered = results.groupBy("conv_id", "id").agg(F.min("answered").alias("answered"))
    calls = named.join(answered, ["conv_id", "id"], "left").join(depths(named), ["conv_id", "id"], "left").select(
        "conv_id", "id", F.col("turn").alias("call_turn"), F.col("name").alias("call_name"), "answered", "depth")
    calls = stash(calls)
    # Calls back to their turns, in topological order.
    listed = flat.join(calls.select("conv_id", "id", "call_turn", "answered", "depth"), ["conv_id", "id"], "left")
    state = (F.when(F.col("id").isNull(), "no_id").when(F.col("call_turn") != F.col("turn"), "repeated_id")
             .when(F.col("answered").isNull(), "open").otherwise("linked"))
    ordered = listed.groupBy("conv_id", "turn", "text_key").agg(F.sort_array(F.collect_list(F.struct(
        F.coalesce("depth", F.lit(1 << 30)).alias("depth"), "place", "id", "name", "arguments", "fault", state.alias("state")))).alias("ordered"))
    body = F.concat(F.lit('{"calls":['), F.array_join(F.transform("ordered", lambda c: F.concat(
        F.lit('{"arguments":'), c["arguments"], F.lit(',"fault":'), _quoted(c["fault"]), F.lit(',"id":'), _quoted(c["id"]),
        F.lit(',"name":'), _quoted(c["name"]), F.lit(',"state":'), _quoted(c["state"]), F.lit("}"))), ","), F.lit("]"))
    ordered = ordered.withColumnsRenamed({"conv_id": "_conv", "turn": "_turn", "text_key": "_key"})
    found = parsed.join(ordered, parsed["conv_id"].eqNullSafe(F.col("_conv")) & parsed["turn"].eqNullSafe(F.col("_turn"))
                        & (parsed["text_key"] == F.col("_key")), "left").join(
        calls.select(F.col("conv_id"), F.col("id").alias("answers"), "call_turn", "call_name"), ["conv_id", "answers"], "left")
    role = F.concat(F.lit(',"role":'), _quoted(F.col("role")), F.lit("}"))
    plain = F.concat(F.lit('{"content":'), _quoted(F.col("text")), role)
    result = F.concat(F.lit('{"content":'), _quoted(F.col("text")), F.lit(',"name":'), _quoted(F.col("call_name")), role)
    return found.select(
        "conv_id", "turn", "role", "kind", F.coalesce(F.size("calls"), F.lit(0)).alias("n_calls"),
        F.when(F.col("kind") == "result", F.when(F.col("call_turn").isNull(), "orphan").when(
            F.col("turn") < F.col("call_turn"), "early").otherwise("linked")).otherwise(
            F.when(F.col("kind") == "calls", F.when(F.exists("ordered", lambda c: c["fault"].isNotNull()), "faulty").otherwise("valid"))).alias("status"),
        F.when(F.col("kind") == "calls", F.concat(body, role)).when(F.col("kind") == "result", result).otherwise(plain).alias("json"))
