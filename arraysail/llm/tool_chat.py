"""Chat formatting with tool-call linking.

Turns are plain text, or JSON objects in the common chat notation:

* a ``system`` turn ``{"tools": [{"name": ..., "parameters": <JSON schema>}]}``
  declares tools,
* an ``assistant`` turn ``{"content": ..., "tool_calls": [{"id", "name",
  "arguments"}]}`` calls them (also with the name and arguments, as an object or
  as a string of JSON, below ``"function"``),
* a ``tool`` turn ``{"tool_call_id": ..., "content": ...}`` holds a result.

Calls and results meet in a hash join on (conversation, identifier, occurrence):
the k-th result of an identifier answers its k-th call. The messages of a
conversation are then put in topological order (a result after its call; a call
after the results whose identifiers its arguments name; otherwise by turn),
arguments are checked against the declared schemas, and all is serialised as
canonical JSON: sorted keys, no white space, whole numbers without a fraction.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from decimal import Decimal
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _plain(x):
    """Numbers with a whole value as integers, at any depth."""
    todo, box = [], [x]
    todo.append((box, 0))
    while todo:
        holder, k = todo.pop()
        v = holder[k]
        if isinstance(v, float):
            holder[k] = int(v) if math.isfinite(v) and v == int(v) and abs(v) < 2**53 else v if math.isfinite(v) else None
        elif isinstance(v, dict):
            todo += [(v, i) for i in v]
        elif isinstance(v, list):
            todo += [(v, i) for i in range(len(v))]
    return box[0]


def canonical(x) -> str:
    """JSON of one form: sorted keys, no white space, characters as they are; halves of surrogate pairs stay escaped."""
    return json.dumps(_plain(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode("utf-8", "backslashreplace").decode()


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(x, kind: str) -> bool:
    if kind == "number":
        return isinstance(x, (int, float)) and not isinstance(x, bool)
    if kind == "integer":
        return isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer()
    return kind in _TYPES and isinstance(x, _TYPES[kind]) and (kind == "boolean" or not isinstance(x, bool))


#: Keywords that are read, and those that constrain nothing.
_READ = set("type enum const anyOf allOf oneOf not $ref minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength minItems maxItems uniqueItems minProperties maxProperties pattern properties patternProperties required dependentRequired additionalProperties items prefixItems".split())
_NOTES = set("$defs definitions $schema $id $comment title description default examples deprecated readOnly writeOnly".split())


def _target(root, ref):
    """What a local reference names; LookupError for any other."""
    if not isinstance(ref, str) or ref != "#" and not ref.startswith("#/"):
        raise LookupError(ref)
    for part in unquote(ref).split("/")[1:]:
        if not isinstance(root, (dict, list)):
            raise LookupError(ref)
        root = root[int(part) if isinstance(root, list) else part.replace("~1", "/").replace("~0", "~")]
    return root


def unread(schema) -> list[str]:
    """Keywords of a schema, at any depth, that are not read."""
    out, todo, known = set(), [(schema, "$")], set()
    while todo:
        s, at = todo.pop()
        if not isinstance(s, dict) or id(s) in known:
            continue
        known.add(id(s))
        out |= {f"{at}: {k} is not read" for k in s.keys() - _READ - _NOTES}
        if "$ref" in s:
            try:
                todo.append((_target(schema, s["$ref"]), at))
            except LookupError:
                out.add(f"{at}: $ref is not read")
        todo += [(s.get(k), at) for k in ("not", "additionalProperties")]
        todo += [(v, at) for k in ("anyOf", "allOf", "oneOf") for v in s.get(k, ())]
        items = s.get("items")
        todo += [(v, f"{at}[]") for v in (*(items if isinstance(items, list) else [items]), *s.get("prefixItems", ()))]
        todo += [(v, f"{at}.{name}") for k in ("properties", "patternProperties") for name, v in s.get(k, {}).items()]
    return sorted(out)


def violations(x, schema, at: str = "$", root=None) -> list[str]:
    """Where a value breaks a JSON schema, by the keywords of ``_READ``; references are local to ``root``."""
    if schema is True or not isinstance(schema, dict):
        return [] if schema is not False else [f"{at}: not allowed"]
    root = schema if root is None else root
    out = []
    if "$ref" in schema:
        try:
            target = _target(root, schema["$ref"])
        except LookupError:
            target = True  # named by unread()
        out += violations(x, target, at, root)
    kinds = schema.get("type")
    if kinds is not None and not any(_is(x, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [*out, f"{at}: type"]
    if "enum" in schema and canonical(x) not in map(canonical, schema["enum"]):
        out.append(f"{at}: enum")
    if "const" in schema and canonical(x) != canonical(schema["const"]):
        out.append(f"{at}: const")
    if "anyOf" in schema and not any(not violations(x, s, at, root) for s in schema["anyOf"]):
        out.append(f"{at}: anyOf")
    for s in schema.get("allOf", ()):
        out += violations(x, s, at, root)
    if "oneOf" in schema and sum(not violations(x, s, at, root) for s in schema["oneOf"]) != 1:
        out.append(f"{at}: oneOf")
    if "not" in schema and not violations(x, schema["not"], at, root):
        out.append(f"{at}: not")
    if _is(x, "number"):
        for name, ok in (("minimum", lambda b: x >= b), ("maximum", lambda b: x <= b), ("exclusiveMinimum", lambda b: x > b), ("exclusiveMaximum", lambda b: x < b)):
            if _is(schema.get(name), "number") and not ok(schema[name]):
                out.append(f"{at}: {name}")
        by = schema.get("multipleOf")
        if _is(by, "number") and Decimal(str(x)) % Decimal(str(by)):
            out.append(f"{at}: multipleOf")
    size = len(x) if isinstance(x, (str, list, dict)) else 0
    for kind, low, high in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems"), (dict, "minProperties", "maxProperties")):
        if isinstance(x, kind):
            if size < schema.get(low, 0):
                out.append(f"{at}: {low}")
            if size > schema.get(high, size):
                out.append(f"{at}: {high}")
    if isinstance(x, str) and isinstance(schema.get("pattern"), str):
        try:
            if not re.search(schema["pattern"], x):
                out.append(f"{at}: pattern")
        except re.error:
            out.append(f"{at}: pattern cannot be read")
    if isinstance(x, dict):
        own, like = schema.get("properties", {}), schema.get("patternProperties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in x]
        for k, needs in schema.get("dependentRequired", {}).items():
            out += [f"{at}.{n}: dependentRequired" for n in needs if k in x and n not in x]
        for k in sorted(x):
            found = [own[k]] if k in own else []
            for p, v in like.items():
                try:
                    found += [v] if re.search(p, k) else []
                except re.error:
                    out.append(f"{at}.{k}: patternProperties cannot be read")
            for v in found:
                out += violations(x[k], v, f"{at}.{k}", root)
            if not found and "additionalProperties" in schema:
                more = schema["additionalProperties"]
                out += [f"{at}.{k}: additional"] if more is False else violations(x[k], more, f"{at}.{k}", root)
    if isinstance(x, list):
        if schema.get("uniqueItems") is True and len({canonical([v]) for v in x}) < len(x):
            out.append(f"{at}: uniqueItems")
        first, rest = schema.get("prefixItems", []), schema.get("items", True)
        if isinstance(rest, list):  # the older notation of prefixItems
            first, rest = rest, True
        for i, v in enumerate(x):
            out += violations(v, first[i] if i < len(first) else rest, f"{at}[{i}]", root)
    return out


def check(x, schema) -> list[str]:
    """:func:`violations` and :func:`unread`, or one error where the schema itself can't be read."""
    try:
        return violations(x, schema) + unread(schema)
    except (TypeError, ValueError, AttributeError, ArithmeticError, RecursionError):
        return ["$: schema cannot be read"]


def _strings(x) -> set[str]:
    found, todo = set(), [x]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            found.add(v)
        elif isinstance(v, dict):
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return found


def _json(text: str | None):
    """(value, whether it is JSON)."""
    try:
        value = json.loads(text, parse_constant=lambda _: None)
        canonical(value)
        return value, True
    except (TypeError, ValueError, RecursionError):
        return None, False


def ordered(items: list[dict]) -> tuple[list[dict], bool]:
    """Items {key, needs, gives, at} after all whose ``gives`` is in their ``needs``, otherwise by ``at``; False with a cycle, whose items come by ``at`` as the rest allows."""
    waiting, after = [0] * len(items), {}
    for i, x in enumerate(items):
        for need in x["needs"]:
            after.setdefault(need, set()).add(i)
    for x in items:
        for i in after.get(x["gives"], ()):
            waiting[i] += items[i] is not x
    heap = [(x["at"], i) for i, x in enumerate(items) if not waiting[i]]
    heapq.heapify(heap)
    rest = sorted((x["at"], i) for i, x in enumerate(items))
    done, out, whole, at = [False] * len(items), [], True, 0
    while len(out) < len(items):
        if heap:
            _, i = heapq.heappop(heap)
            if done[i]:
                continue
        else:  # a cycle: its first item goes
            while done[rest[at][1]]:
                at += 1
            i, whole = rest[at][1], False
        done[i] = True
        out.append(items[i])
        for j in after.get(items[i]["gives"], ()):
            waiting[j] -= items[j] is not items[i]
            if waiting[j] <= 0 and not done[j]:
                heapq.heappush(heap, (items[j]["at"], j))
    return out, whole


def conversation(turns: list[dict], links: list[dict], tools: list[dict]) -> dict:
    """One conversation from its plain turns, joined calls and results, and declared tools."""
    schemas: dict = {}
    for t in sorted(tools, key=lambda t: (t["turn"], t["pos"])):
        if t["name"] is not None:
            value, good = _json(t["parameters"])
            schemas[t["name"]] = value if good else None
    items = [{"needs": (), "gives": None, "at": (t["turn"], 0, -1, t["role"] or "", t["text"] or ""), "message": {"role": t["role"], "content": t["text"]}} for t in turns]
    known = {x["id"] for x in links if x["call_turn"] is not None and x["result_turn"] is not None}
    n = {"n_calls": 0, "n_results": 0, "n_linked": 0, "n_invalid": 0, "n_orphans": 0}
    for x in links:
        called, answered = x["call_turn"] is not None, x["result_turn"] is not None
        n["n_calls"] += called
        n["n_results"] += answered
        n["n_linked"] += called and answered
        n["n_orphans"] += called != answered
        if called:
            value, good = _json(x["arguments"])
            if isinstance(value, str):
                inner, ok = _json(value)
                value, good = (inner, True) if ok else (value, False)
            if not good:
                wrong = ["$: no JSON"]
            elif x["name"] not in schemas:
                wrong = ["unknown tool"] if schemas else []
            else:
                wrong = check(value, schemas[x["name"]])
            n["n_invalid"] += bool(wrong)
            call = {"id": x["id"], "name": x["name"], "arguments": value if good else x["arguments"], "answered": answered, "errors": wrong}
            needs = [("result", i, 0) for i in _strings(value) & known - {x["id"]}]
            items.append({"needs": needs, "gives": ("call", x["id"], x["nth"]), "at": (x["call_turn"], 1, x["call_pos"], x["id"] or "", ""), "message": {"role": "assistant", "tool_call": call}})
        if answered:
            items.append({"needs": [("call", x["id"], x["nth"])] if called else [], "gives": ("result", x["id"], x["nth"]), "at": (x["result_turn"], 1, x["result_pos"], x["id"] or "", ""), "message": {"role": "tool", "tool_call_id": x["id"], "content": x["content"], "orphan": not called}})
    messages, whole = ordered(items)
    out = {"messages": [m["message"] for m in messages]}
    if schemas:
        out["tools"] = [{"name": k, "parameters": schemas[k]} for k in sorted(schemas)]
    return n | {"n_messages": len(messages), "cyclic": not whole, "json": canonical(out)}


_CALL = "array<struct<id: string, name: string, arguments: string, `function`: struct<name: string, arguments: string>>>"
_TOOL = "array<struct<name: string, parameters: string, `function`: struct<name: string, parameters: string>>>"
_COLUMNS = {"n_messages": "int", "n_calls": "int", "n_results": "int", "n_linked": "int", "n_invalid": "int", "n_orphans": "int", "cyclic": "boolean", "json": "string"}
_ARROW = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


def _format(turns: pa.Array, links: pa.Array, tools: pa.Array) -> pa.Array:
    rows = [conversation(t or [], x or [], s or []) for t, x, s in zip(turns.to_pylist(), links.to_pylist(), tools.to_pylist())]
    return pa.array([{k: r[k] for k in _COLUMNS} for r in rows], pa.struct([(k, _ARROW[t]) for k, t in _COLUMNS.items()]))


def _nth(order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy("conv_id", "id").orderBy(*order)) - 1


def linked(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plain turns, calls joined with results, declared tools) of a table (conv_id, turn, role, text)."""
    base = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1)).alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    structured = F.col("role").isin("system", "assistant", "tool") & F.col("text").rlike(r"\A[ \t\n\r]*\{")
    read = F.from_json("text", f"content string, tool_calls {_CALL}, tools {_TOOL}, tool_call_id string")
    rows = base.withColumn("j", F.when(structured, read))
    calls_ = (F.col("role") == "assistant") & (F.size("j.tool_calls") > 0)
    tools_ = (F.col("role") == "system") & (F.size("j.tools") > 0)
    result_ = (F.col("role") == "tool") & F.col("j.tool_call_id").isNotNull()
    no = F.lit(False)
    is_call, is_tools, is_result = (F.coalesce(c, no) for c in (calls_, tools_, result_))
    # what the structured turns say beside their calls or tools stays a message
    plain = rows.where(~is_result & ~((is_call | is_tools) & F.col("j.content").isNull())).select("conv_id", "turn", "role", F.when(is_call | is_tools, F.col("j.content")).otherwise(F.col("text")).alias("text"))
    c = rows.where(is_call).select("conv_id", "turn", F.posexplode("j.tool_calls").alias("pos", "c"))
    c = c.select("conv_id", "turn", "pos", F.col("c.id").alias("id"), F.coalesce("c.name", "c.function.name").alias("name"), F.coalesce("c.arguments", "c.function.arguments", F.lit("{}")).alias("arguments"))
    c = c.withColumn("nth", _nth([F.col("turn"), F.col("pos"), F.col("name"), F.col("arguments")]))
    c = c.select("conv_id", "id", "nth", F.struct(F.col("turn").alias("call_turn"), F.col("pos").alias("call_pos"), "name", "arguments").alias("call"))
    r = rows.where(is_result).select("conv_id", "turn", F.col("j.tool_call_id").alias("id"), F.col("j.content").alias("content"))
    r = r.withColumn("nth", _nth([F.col("turn"), F.col("content")]))
    r = r.select("conv_id", "id", "nth", F.struct(F.col("turn").alias("result_turn"), F.lit(0).alias("result_pos"), "content").alias("result"))
    links = c.hint("shuffle_hash").join(r, ["conv_id", "id", "nth"], "full").select("conv_id", "id", "nth", "call.*", "result.*")
    t = rows.where(is_tools).select("conv_id", "turn", F.posexplode("j.tools").alias("pos", "t"))
    t = t.select("conv_id", "turn", "pos", F.coalesce("t.name", "t.function.name").alias("name"), F.coalesce("t.parameters", "t.function.parameters").alias("parameters"))
    return plain, links, t


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_messages, n_calls, n_results, n_linked, n_invalid, n_orphans, cyclic, json): a row for each conversation.

    Rows with a null conversation are left out; a null turn comes last; null
    roles and texts are JSON nulls. Turns that only look like JSON, or are
    broken, are plain text. Calls without a result and results without a call
    stay, are marked and counted as orphans; calls with a null identifier are
    never answered. Arguments that break the schema of their tool, are no JSON,
    or name a tool that is not declared (where any is) are invalid: kept, with
    the places named. Among turns of one number the order is by role and text,
    so repeated and unordered rows have one result. Messages in a cycle of
    references are in turn order and ``cyclic`` is true. Texts are whole; other
    columns are ignored; an empty table gives an empty result.
    """
    plain, links, tools = linked(turns)
    gather = lambda df, name: df.groupBy("conv_id").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "conv_id"])).alias(name))
    schema = ", ".join(f"{k}: {t}" for k, t in _COLUMNS.items())
    rows = gather(plain, "turns").join(gather(links, "links"), "conv_id", "full").join(gather(tools, "tools"), "conv_id", "full")
    return rows.select("conv_id", F.arrow_udf(_format, f"struct<{schema}>").asNondeterministic()("turns", "links", "tools").alias("r")).select("conv_id", "r.*")


#: Over tables whose turns are all plain text.
PLAIN_SQL = """
WITH m AS (
  SELECT conv_id, turn, role, text,
         '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS message
  FROM conversations WHERE conv_id IS NOT NULL
)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_messages, 0 AS n_calls, 0 AS n_results, 0 AS n_linked, 0 AS n_invalid, 0 AS n_orphans, false AS cyclic,
       '{"messages":[' || string_agg(message, ',' ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) || ']}' AS json
FROM m GROUP BY conv_id
"""
