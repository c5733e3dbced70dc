"""Tool calls of chats: parsed, linked to their results, ordered, validated and written as canonical JSON.

Assistant texts hold calls as ``<tool_call>{"id", "name", "arguments"}</tool_call>``; texts of the role ``tool`` are
results, ``{"tool_call_id", "content"}``. Calls and results are joined by conversation and identifier. A call that
names another's result as ``"$id"`` among its arguments depends on it; levels follow the longest chain of
dependencies, by rounds of joins that halve the chains of the dependent calls until nothing changes. Arguments are checked against
the schema of their tool: system texts declare the tools of a chat as ``<tools>[{"name", "parameters"}]</tools>`` (or those within
``{"function"}``), and calls are joined to them by conversation and name; schemas given to ``link`` stand in for all declared ones. Every message and every call stays a row of its own, so that a chat of any length is spread
over tasks.

Defined cases: a null text is empty; texts without calls are plain messages; what is no valid JSON, or lacks a name, is
reported in ``errors`` and stays; a repeated identifier links every call to the first result of that identifier; calls
without a result, results without a call and calls in a circle (level null) are reported; null conversations form
one of their own; of tools declared twice in a chat the first counts; unknown tools are an error only in chats that declare
tools or if schemas are given; schemas that cannot be applied are reported; empty tables give no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.operators.skew import hot_keys, skew_join
from corpusmap.scratch import Tables

CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
TOOLS = re.compile(r"<tools>(.*?)</tools>", re.S)
REFERENCE = re.compile(r"^\$([^.\s]+)")
KINDS = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float),
    "integer": int,
}


def canonical(value) -> str:
    """JSON with sorted keys and without blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def problems(value, schema: dict, path: str = "arguments") -> list[str]:
    """What is wrong with a value under a JSON schema: types, enumerations, required and further properties, bounds."""
    found = []
    kind = schema.get("type")
    kinds = kind if isinstance(kind, list) else [kind] if kind else []

    def fits(k: str) -> bool:
        if isinstance(value, bool) and k in ("number", "integer"):
            return False
        return isinstance(value, KINDS.get(k, object)) or (k == "integer" and isinstance(value, float) and value.is_integer())

    if kinds and not any(fits(k) for k in kinds):
        return [f"{path}: not of type {'|'.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{path}: not among the allowed values")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += problems(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{path}.{k}: not allowed")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, x in enumerate(value):
            found += problems(x, schema["items"], f"{path}[{i}]")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            found.append(f"{path}: below the minimum")
        if "maximum" in schema and value > schema["maximum"]:
            found.append(f"{path}: above the maximum")
    return found


def references(value) -> list[str]:
    """Identifiers of results that a value names."""
    if isinstance(value, str):
        m = REFERENCE.match(value)
        return [m[1]] if m else []
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
    return [r for v in parts for r in references(v)]


def parse(role: str | None, text: str) -> tuple[str, list[dict]]:
    """The plain content of a message, and its calls or its result."""
    if role == "tool":
        try:
            body = json.loads(text)
            if isinstance(body, dict) and "tool_call_id" in body:
                return canonical(body.get("content")), [{"kind": "result", "id": str(body["tool_call_id"])}]
        except ValueError:
            pass
        return text, [{"kind": "result", "id": None, "errors": ["no result with an identifier"]}]
    if role != "assistant" or "<tool_call>" not in text:
        return text, []
    calls = []
    for m in CALL.finditer(text):
        try:
            body = json.loads(m[1])
        except ValueError:
            body = None
        if not isinstance(body, dict) or not isinstance(body.get("name"), str):
            calls.append({"kind": "call", "id": None, "errors": ["no call with a name"], "arguments": m[1]})
            continue
        arguments = body.get("arguments", {})
        if isinstance(arguments, str):
            try:
                arguments = json.loads(arguments)
            except ValueError:
                pass
        calls.append({
            "kind": "call", "id": None if body.get("id") is None else str(body["id"]), "name": body["name"],
            "arguments": canonical(arguments), "needs": sorted(set(references(arguments))),
        })
    return CALL.sub("", text), calls


def declared(role: str | None, text: str) -> tuple[list[dict], list[str]]:
    """The tools that a message declares, and what is wrong with the declarations."""
    tools, errors = [], []
    for m in TOOLS.finditer(text) if role == "system" and "<tools>" in text else ():
        try:
            body = json.loads(m[1])
        except ValueError:
            body = None
        for tool in body if isinstance(body, list) else [body]:
            if isinstance(tool, dict) and isinstance(tool.get("function"), dict):
                tool = tool["function"]
            if isinstance(tool, dict) and isinstance(tool.get("name"), str) and isinstance(tool.get("parameters", {}), dict):
                tools.append({"kind": "tool", "id": None, "name": tool["name"], "schema": canonical(tool.get("parameters", {}))})
            else:
                errors.append("no tool with a name and a schema")
    return tools, errors


def _problems():
    """``problems`` of the arguments of calls, a batch at a time; none where there is no schema."""

    @F.arrow_udf("array<string>")
    def wrong(bodies: pa.Array, schemas: pa.Array) -> pa.Array:
        found = []
        for body, schema in zip(bodies.to_pylist(), schemas.to_pylist()):
            try:
                found.append([] if schema is None else problems(json.loads(body)["arguments"], json.loads(schema)))
            except (TypeError, AttributeError):
                found.append(["schema that cannot be applied"])
        return pa.array(found, pa.list_(pa.string()))

    return wrong


def checked(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls, with what is wrong with their arguments by the tools ``(key, turn, nth, name, json)`` of their chats among ``errors``."""
    first = tools.groupBy("key", "name").agg(F.min_by("json", F.struct("turn", "nth")).alias("schema"))
    chats = tools.select("key", F.lit(True).alias("declares")).distinct()
    salt = F.xxhash64("turn", "nth")
    rows = skew_join(calls, chats, ["key"], salt, "left")
    rows = skew_join(rows, first, ["key", "name"], salt, "left", hot=hot_keys(calls, ["key", "name"]))
    unknown = F.col("declares") & F.col("name").isNotNull() & F.col("schema").isNull()
    wrong = F.when(unknown, F.array(F.lit("unknown tool"))).otherwise(_problems()("json", "schema"))
    return rows.withColumn("errors", F.concat("errors", wrong)).drop("declares", "schema")


PARSED = (
    "conv_id {kind}, turn bigint, nth int, kind string, id string, name string, json string, needs array<string>, "
    "errors array<string>"
)


def parsed(chats: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row for each message (kind ``message``), call, result and declared tool, with its canonical JSON and what is wrong with it.

    The JSON of a tool is its schema.
    """
    kind = chats.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "turn", "nth", "kind", "id", "name", "json", "needs", "errors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []
            turns, roles, texts = (batch.column(c).to_pylist() for c in (1, 2, 3))
            for k, (turn, role, text) in enumerate(zip(turns, roles, texts)):
                content, parts = parse(role, text or "")
                tools, wrong = declared(role, text or "")
                parts += tools
                rows.append((turn, 0, "message", None, None, canonical({"content": content, "role": role}), [], wrong))
                at += [k] * (1 + len(parts))
                for n, p in enumerate(parts, 1):
                    errors = list(p.get("errors", []))
                    body = p.get("schema")
                    if p["kind"] == "call":
                        name, arguments = p.get("name"), p["arguments"]
                        if name is None:
                            body = canonical({"arguments": arguments})
                        else:
                            if schemas is not None:
                                errors += problems(json.loads(arguments), schemas[name]) if name in schemas else ["unknown tool"]
                            body = canonical({"arguments": json.loads(arguments), "id": p["id"], "name": name})
                    rows.append((turn, n, p["kind"], p["id"], p.get("name"), body, p.get("needs", []), errors))
            kinds = [pa.int64(), pa.int32(), *[pa.string()] * 4, *[pa.list_(pa.string())] * 2]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] or [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=names)

    plain = chats.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return plain.mapInArrow(run, PARSED.format(kind=kind))


def levels(calls: DataFrame, tables: Tables) -> DataFrame:
    """``(conv_id, id, level)``: the length of the longest chain of calls that a call depends on; circles have none.

    Only the calls that wait for others take part in the rounds, one row each. A round takes out the needs that the
    round before settled, and lets a call that waits for one with a single need wait for that need in its place, so that
    chains of single needs halve with every round. Where all calls of a chain wait for several open ones, a round settles one
    level. Settled calls are written once. A chain with more links than there are waiting calls runs in a circle.
    """
    key = ["conv_id", "id"]
    nodes = calls.select(*key).distinct()
    needs = tables.save(calls.select(*key, F.explode("needs").alias("need")).distinct(), "needs")
    known = _skewed(needs, nodes.withColumnRenamed("id", "need"), "inner")
    links = F.collect_list(F.struct("need", F.lit(1).cast("bigint").alias("gap"))).alias("links")
    waiting, seen = tables.save_measured(
        known.groupBy(*key).agg(links).withColumn("base", F.lit(0).cast("bigint")), "waiting", n=F.count("*")
    )
    most, names = seen["n"], ["settled0"]
    latest = tables.save(nodes.join(waiting, key, "left_anti").withColumn("level", F.lit(0).cast("bigint")), names[0])
    while seen["n"]:
        turn = len(names)
        found = latest.select("conv_id", F.col("id").alias("need"), "level", F.lit(True).alias("ended"))
        met = _skewed(_links(waiting), found, "left")
        left = F.collect_list(F.when(F.col("ended").isNull(), F.struct("need", "gap"))).alias("links")
        resolved = tables.save(met.groupBy(*key).agg(
            F.max(F.greatest("base", F.col("gap") + F.col("level"))).alias("base"),
            F.bool_or(F.col("ended").isNotNull() & F.col("level").isNull()).alias("lost"), left,
        ), f"resolved{turn}")
        done = F.col("lost") | (F.size("links") == 0)
        rest = resolved.filter(~done)
        single = rest.filter(F.size("links") == 1).select(
            "conv_id", F.col("id").alias("need"), F.col("links")[0]["need"].alias("next"),
            F.col("links")[0]["gap"].alias("hop"), F.col("base").alias("under"),
        )
        further = F.struct(
            F.coalesce("next", "need").alias("need"), (F.col("gap") + F.coalesce("hop", F.lit(0))).alias("gap")
        )
        moved = _skewed(_links(rest), single, "left").groupBy(*key).agg(
            F.max(F.greatest("base", F.col("gap") + F.col("under"))).alias("base"),
            F.sort_array(F.collect_set(further)).alias("all"), F.count_if(F.col("next").isNotNull()).alias("moves"),
        )
        # Of several links to one call the longest counts.
        longest = F.filter("all", lambda x, i: F.coalesce(F.get("all", i + 1)["need"] != x["need"], F.lit(True)))
        circle = F.exists("links", lambda x: (x["need"] == F.col("id")) | (x["gap"] > most))
        moved, seen = tables.save_measured(
            moved.withColumn("links", longest).withColumn("lost", circle).drop("all"), f"moved{turn}",
            n=F.count_if(~F.col("lost")), moves=F.sum("moves"),
        )
        ended = resolved.filter(done).select(*key, F.when(~F.col("lost"), F.col("base")).alias("level"))
        circles = moved.filter("lost").select(*key, F.lit(None).cast("bigint").alias("level"))
        latest, new = tables.save_measured(ended.unionByName(circles), f"settled{turn}", n=F.count("*"))
        names.append(f"settled{turn}")
        if not new["n"] and not seen["moves"]:
            break
        waiting = moved.filter("NOT lost").select(*key, "links", "base")
    every = tables.spark.read.schema(latest.schema).parquet(*[f"{tables.base}/{name}" for name in names])
    return every.filter("level IS NOT NULL").withColumn("level", F.col("level").cast("int"))


def _links(waiting: DataFrame) -> DataFrame:
    return waiting.select("conv_id", "id", "base", F.inline("links"))


def _skewed(links: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Links and what is known of the calls they need, of which one may be needed by very many."""
    return skew_join(links, found, ["conv_id", "need"], F.xxhash64("id"), how)


def link(chats: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """Messages, calls and results in order: ``(conv_id, turn, nth, kind, id, name, level, linked_turn, json, errors)``.

    Ordered by ``level`` and then ``(turn, nth)``, every call stands after what it depends on; ``linked_turn`` is the turn
    of a call's result, and of a result's call.
    """
    tables = Tables(chats.sparkSession, "tool_calls")
    rows = parsed(chats.withColumn("conv_id", F.col("conv_id")), schemas)
    rows = tables.save(rows.withColumn("key", F.struct("conv_id")), "parsed")
    parts = rows.filter("kind <> 'message'")
    calls, results = parts.filter("kind = 'call'"), parts.filter("kind = 'result'")
    named = calls.filter("id IS NOT NULL").select(F.col("key").alias("conv_id"), "id", "needs")
    if schemas is None:
        calls = checked(calls, rows.filter("kind = 'tool'").select("key", "turn", "nth", "name", "json"))
    depth = levels(named, tables).select(F.col("conv_id").alias("key"), "id", "level")
    first_result = results.filter("id IS NOT NULL").groupBy("key", "id").agg(F.min("turn").alias("linked_turn"))
    first_call = calls.filter("id IS NOT NULL").groupBy("key", "id").agg(F.min("turn").alias("linked_turn"))
    lonely = F.when(F.col("linked_turn").isNull() & F.col("id").isNotNull(), F.array(F.lit("nothing linked")))
    circle = F.when(F.col("level").isNull() & F.col("id").isNotNull(), F.array(F.lit("depends on itself")))
    none = F.array().cast("array<string>")
    out_calls = calls.join(first_result, ["key", "id"], "left").join(depth, ["key", "id"], "left").withColumn(
        "errors", F.concat("errors", F.coalesce(lonely, none), F.coalesce(circle, none))
    )
    out_results = results.join(first_call, ["key", "id"], "left").join(depth, ["key", "id"], "left").withColumn(
        "errors", F.concat("errors", F.coalesce(lonely, none))
    )
    plain = rows.filter("kind = 'message'").withColumns(
        {"linked_turn": F.lit(None).cast("bigint"), "level": F.lit(0)}
    )
    columns = ["conv_id", "turn", "nth", "kind", "id", "name", "level", "linked_turn", "json", "errors"]
    made = plain.select(columns).unionByName(out_calls.select(columns)).unionByName(out_results.select(columns))
    return made.withColumn("errors", F.array_join("errors", "; "))
