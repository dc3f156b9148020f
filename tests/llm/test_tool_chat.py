import itertools
import json
import random

import common
import pytest
from oracle import connect, difference

from arraysail.llm import registry
from arraysail.llm import tool_chat as T

TURNS = "conv_id long, turn long, role string, text string"


def _one(spark, rows):
    got = T.format_chats(spark.createDataFrame([(1, *r) for r in rows], TURNS).repartition(3)).collect()
    assert len(got) == 1
    return got[0], json.loads(got[0]["json"])


def test_matches_sql_on_plain_tables(spark):
    for folder in (common.SF, "/root/testdata/sf0.01"):
        assert difference(registry.op3_tool_chat(spark, folder), connect(folder), T.PLAIN_SQL) == ""


def test_links_orders_and_validates(spark):
    tools = {"tools": [{"name": "add", "parameters": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"], "additionalProperties": False}}]}
    r, j = _one(spark, [
        (0, "system", json.dumps(tools)),
        (1, "user", "go"),
        (2, "tool", json.dumps({"tool_call_id": "c1", "content": "early answer"})),
        (3, "assistant", json.dumps({"content": "calling", "tool_calls": [{"id": "c1", "name": "add", "arguments": {"x": 2.0}}, {"id": "c2", "function": {"name": "add", "arguments": '{"y": 1}'}}]})),
        (4, "assistant", json.dumps({"tool_calls": [{"id": "c3", "name": "nothing", "arguments": {}}]})),
        (9, "tool", json.dumps({"tool_call_id": "lost", "content": "?"})),
    ])
    assert (r.n_calls, r.n_results, r.n_linked, r.n_invalid, r.n_orphans, r.cyclic) == (3, 2, 1, 2, 3, False)
    m = j["messages"]
    place = {x["tool_call"]["id"]: k for k, x in enumerate(m) if "tool_call" in x}
    answer = next(k for k, x in enumerate(m) if x.get("tool_call_id") == "c1")
    assert answer > place["c1"]
    assert m[place["c1"]]["tool_call"] == {"id": "c1", "name": "add", "arguments": {"x": 2}, "answered": True, "errors": []}
    assert m[place["c2"]]["tool_call"]["errors"] == ["$.x: required", "$.y: additional"]
    assert m[place["c3"]]["tool_call"]["errors"] == ["unknown tool"]
    assert j["tools"][0]["name"] == "add" and '"x":2}' in r.json and ": " not in r.json.replace("$.x: required", "").replace("$.y: additional", "")


def test_a_call_waits_for_the_result_it_names(spark):
    call = lambda i, a: json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": a}]})
    _, j = _one(spark, [(1, "assistant", call("b", {"from": ["a"]})), (2, "assistant", call("a", {})), (3, "tool", '{"tool_call_id": "a", "content": "1"}'), (4, "tool", '{"tool_call_id": "b", "content": "2"}')])
    assert [x.get("tool_call_id") or x["tool_call"]["id"] for x in j["messages"]] == ["a", "a", "b", "b"]
    r, j = _one(spark, [(1, "assistant", call("a", {"q": "b"})), (2, "assistant", call("b", {"q": "a"})), (3, "tool", '{"tool_call_id": "a", "content": "1"}'), (4, "tool", '{"tool_call_id": "b", "content": "2"}')])
    assert r.cyclic and len(j["messages"]) == 4


def test_repeated_identifiers_pair_up_in_order(spark):
    call = json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": {}}]})
    r, j = _one(spark, [(1, "assistant", call), (2, "tool", '{"tool_call_id": "a", "content": "1"}'), (3, "assistant", call), (4, "tool", '{"tool_call_id": "a", "content": "2"}')])
    assert (r.n_linked, r.n_orphans) == (2, 0) and [x.get("content") for x in j["messages"]] == [None, "1", None, "2"]


def test_order_is_topological_and_least():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 6)
        items = [{"needs": [k for k in range(n) if k != i and rng.random() < 0.25], "gives": i, "at": (rng.randrange(4), i)} for i in range(n)]
        out, whole = T.ordered(items)
        assert sorted(x["gives"] for x in out) == list(range(n))
        valid = [p for p in itertools.permutations(range(n)) if all(p.index(k) < p.index(i) for i in range(n) for k in items[i]["needs"])]
        assert whole == bool(valid)
        if valid:
            assert tuple(x["gives"] for x in out) == min(valid, key=lambda p: [items[i]["at"] for i in p])


@pytest.mark.parametrize(
    ("value", "schema", "wrong"),
    [
        (1, {"type": "integer"}, 0), (1.0, {"type": "integer"}, 0), (True, {"type": "integer"}, 1), ("a", {"type": ["string", "null"]}, 0), (None, {"type": "null"}, 0),
        ([1, "x"], {"items": {"type": "number"}}, 1), ({"a": {"b": 1}}, {"properties": {"a": {"properties": {"b": {"maximum": 0}}}}}, 1), ("abc", {"pattern": "^b"}, 1), ("abc", {"pattern": "("}, 1),
        (3, {"enum": [1, 2]}, 1), (3.0, {"const": 3}, 0), (5, {"anyOf": [{"type": "string"}, {"minimum": 4}]}, 0), ("", {"minLength": 1}, 1), ([], {"maxItems": 0}, 0), ({}, {"required": ["a", "b"]}, 2), (1, True, 0), (1, False, 1), (1, {"type": 5}, 1), ({}, {"required": 5}, 1),
    ],
)
def test_schema(value, schema, wrong):
    assert len(T.check(value, schema)) == wrong


def test_canonical():
    assert T.canonical({"b": [1.0, 2.5, None], "a": "é\n"}) == '{"a":"é\\n","b":[1,2.5,null]}'
    assert T.canonical({"a": "\ud800"}) == '{"a":"\\ud800"}'


def test_edges(spark):
    from pyspark.sql import functions as F

    rows = [(None, 1, "user", "gone"), (1, None, None, None), (1, 1, "user", ""), (1, 1, "user", ""), (1, 2, "assistant", "{broken"), (2, 1, "assistant", "x" * 200_000), (3, 1, "tool", '{"content": "no id"}'), (4, 1, "assistant", '{"tool_calls": [{"id": null, "name": null, "arguments": "no json"}]}'), (4, 2, "tool", '{"tool_call_id": null}'), (5, 1, "assistant", '{"tool_calls": []}'), (6, 1, "assistant", '{"tool_calls": [{"id": "d", "name": "f", "arguments": ' + '{"a":' * 3000 + "1" + "}" * 3000 + "}]}")]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("id", "nth", "call", "result", "j", "pos", "name", "turns", "links", "tools")})
    got = {r["conv_id"]: r for r in T.format_chats(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert [m["content"] for m in json.loads(got[1]["json"])["messages"]] == ["", "", "{broken", None]
    assert got[4]["n_calls"] == 1 and got[4]["n_invalid"] == 1 and got[4]["n_orphans"] == 1
    assert len(json.loads(got[2]["json"])["messages"][0]["content"]) == 200_000
    assert T.format_chats(common.empty(df)).count() == 0


@pytest.mark.parametrize("value, schema, wrong", [
    ({"a": {"n": "x"}}, {"properties": {"a": {"$ref": "#/$defs/A"}}, "$defs": {"A": {"properties": {"n": {"type": "integer"}}}}}, ["$.a.n: type"]),
    (3, {"allOf": [{"minimum": 1}, {"maximum": 2}]}, ["$: maximum"]),
    (3, {"oneOf": [{"type": "integer"}, {"minimum": 1}]}, ["$: oneOf"]),
    (3, {"not": {"type": "integer"}}, ["$: not"]),
    (0.35, {"multipleOf": 0.1}, ["$: multipleOf"]),
    (0.3, {"multipleOf": 0.1}, []),
    ([1, 1.0], {"uniqueItems": True}, ["$: uniqueItems"]),
    ({"xa": 1}, {"patternProperties": {"^x": {"type": "string"}}, "additionalProperties": False}, ["$.xa: type"]),
    (["a", 1], {"prefixItems": [{"type": "string"}], "items": {"type": "string"}}, ["$[1]: type"]),
    ({"a": 1}, {"dependentRequired": {"a": ["b"]}}, ["$.b: dependentRequired"]),
    ("x", {"format": "date"}, ["$: format is not read"]),
    ("x", {"$ref": "http://elsewhere"}, ["$: $ref is not read"]),
    ({}, {"$ref": "#"}, ["$: schema cannot be read"]),
])
def test_more_of_schema(value, schema, wrong):
    assert T.check(value, schema) == wrong


def test_json_after_white_space_is_read(spark):
    r, _ = _one(spark, [(0, "assistant", "\n\t " + json.dumps({"tool_calls": [{"id": "c", "name": "f", "arguments": {}}]})), (1, "tool", "\r\n" + json.dumps({"tool_call_id": "c", "content": "x"}))])
    assert (r.n_calls, r.n_results, r.n_linked) == (1, 1, 1)


#: Links and counts of tables whose calls all have an identifier and a name.
COUNTS_SQL = """
WITH c AS (SELECT conv_id, id, row_number() OVER (PARTITION BY conv_id, id ORDER BY turn, pos) AS nth, arguments FROM (
    SELECT conv_id, turn, pos, json_extract_string(text, '$.tool_calls[' || pos || '].id') AS id, json_extract(text, '$.tool_calls[' || pos || '].arguments') AS arguments
    FROM turns, range(0, 5) t(pos) WHERE role = 'assistant' AND pos < json_array_length(text, '$.tool_calls'))),
r AS (SELECT conv_id, json_extract_string(text, '$.tool_call_id') AS id, row_number() OVER (PARTITION BY conv_id, json_extract_string(text, '$.tool_call_id') ORDER BY turn) AS nth FROM turns WHERE role = 'tool'),
x AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, c.id AS call, r.id AS result, c.arguments FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.id = r.id AND c.nth = r.nth)
SELECT conv_id, count(call) AS n_calls, count(result) AS n_results, count(*) FILTER (call = result) AS n_linked, count(*) FILTER (call IS NULL OR result IS NULL) AS n_orphans,
    count(*) FILTER (call IS NOT NULL AND NOT coalesce(json_type(arguments, '$.n') IN ('BIGINT', 'UBIGINT'), false)) AS n_invalid
FROM x GROUP BY conv_id
"""


def test_links_and_counts_against_sql(spark):
    import duckdb

    rng, rows = random.Random(9), []
    tool = json.dumps({"tools": [{"name": "f", "parameters": {"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}}]})
    for conv in range(60):
        rows.append((conv, 0, "system", tool))
        for turn in range(1, rng.randrange(3, 9)):
            if rng.random() < 0.5:
                calls = [{"id": f"c{rng.randrange(4)}", "name": "f", "arguments": rng.choice([{"n": 1}, {"n": "x"}, {}, {"n": -7, "m": 0}])} for _ in range(rng.randrange(1, 4))]
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": calls})))
            else:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": f"c{rng.randrange(4)}", "content": "x"})))
    names = ["n_calls", "n_results", "n_linked", "n_orphans", "n_invalid"]
    got = {r["conv_id"]: tuple(r[n] for n in names) for r in T.format_chats(spark.createDataFrame(rows, TURNS).repartition(4)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE turns (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO turns VALUES (?, ?, ?, ?)", rows)
    found = con.execute(COUNTS_SQL)
    at = {d[0]: i for i, d in enumerate(found.description)}
    want = {r[at["conv_id"]]: tuple(r[at[n]] for n in names) for r in found.fetchall()}
    assert {k: v for k, v in got.items() if any(v)} == want and sum(v[2] for v in want.values()) > 40 and sum(v[4] for v in want.values()) > 20
