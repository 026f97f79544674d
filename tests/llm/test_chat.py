"""Schemas, canonical JSON and order of tool calls against fixed cases and a plain Python version."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from kinweave.llm import chat, registry

OBJ = lambda **p: {"type": "object", "properties": p}
CASES = [
    (OBJ(x=OBJ(y={"type": "integer"})), '{"x":{"y":"no"}}', False), (OBJ(x=OBJ(y={"type": "integer"})), '{"x":{"y":3}}', True), (OBJ(x=OBJ(y={"type": "integer"})), '{"x":7}', False),
    (OBJ(x={"type": "array", "items": {"type": "string"}}), '{"x":["a","b"]}', True), (OBJ(x={"type": "array", "items": {"type": "string"}}), '{"x":["a",1]}', False), (OBJ(x={"items": {"type": "null"}}), '{"x":[null]}', True),
    (OBJ(x={"type": "array", "minItems": 1, "maxItems": 2}), '{"x":[]}', False), (OBJ(x={"type": "array", "minItems": 1, "maxItems": 2}), '{"x":[1,2]}', True),
    (OBJ(x={"minimum": 0, "exclusiveMaximum": 10}), '{"x":10}', False), (OBJ(x={"minimum": 0, "exclusiveMaximum": 10}), '{"x":9.5}', True), (OBJ(x={"minimum": 0}), '{"x":"text"}', True),
    (OBJ(x={"enum": [True]}), '{"x":true}', True), (OBJ(x={"enum": [True]}), '{"x":"true"}', False), (OBJ(x={"enum": [1, "a", None]}), '{"x":null}', True), (OBJ(x={"enum": [1.0]}), '{"x":1e0}', True), (OBJ(x={"const": {"b": [1], "a": 2}}), '{"x":{"a":2.0,"b":[1]}}', True),
    ({"properties": {"a.b": {"type": "integer"}, "it's [0] \"$\"": {"type": "string"}}, "required": ["a.b"]}, '{"a.b":4}', True), ({"properties": {"a.b": {"type": "integer"}}, "required": ["a.b"]}, '{"a":{"b":4}}', False),
    ({"properties": {"it's [0] \"$\"": {"type": "string"}}}, '{"it\'s [0] \\"$\\"":5}', False),
    (OBJ(x={"type": "null"}), '{"x":null}', True), (OBJ(x={"type": "null"}), '{"x":0}', False), (OBJ(x={"type": ["string", "null"]}), '{"x":null}', True), (OBJ(x={"type": ["string", "null"]}), '{"x":1}', False),
    (OBJ(x={"type": "integer"}), '{"x":12345678901234567890}', True), (OBJ(x={"type": "integer"}), '{"x":1.0}', True), (OBJ(x={"type": "integer"}), '{"x":1e2}', True), (OBJ(x={"type": "integer"}), '{"x":1.5}', False), (OBJ(x={"type": "number"}), '{"x":1e-3}', True),
    ({"additionalProperties": False, "properties": {"x": {}}}, '{"x":1,"y":2}', False), ({"additionalProperties": {"type": "integer"}, "properties": {"x": {}}}, '{"x":"s","y":2}', True), ({"additionalProperties": {"type": "integer"}}, '{"y":"s"}', False),
    (OBJ(x={"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^a"}), '{"x":"abc"}', True), (OBJ(x={"pattern": "^a"}), '{"x":"bc"}', False), (OBJ(x={"minLength": 2}), '{"x":"a"}', False),
    ({"required": ["x"], "title": "t"}, "{}", False), ({}, "[]", False), ({}, "{", False), ({}, '{"a":1,"a":2}', False), ({}, None, False), ({}, "{}", True),
]


def test_schemas(spark):
    schemas = {f"t{i}": s for i, (s, _, _) in enumerate(CASES)}
    df = spark.createDataFrame([(i, f"t{i}", a) for i, (_, a, _) in enumerate(CASES)] + [(-1, "unknown", "{}"), (-2, None, "{}")], "i int, name string, arguments string")
    got = {r.i: r.v for r in df.select("i", chat.arguments_valid(F.col("name"), F.col("arguments"), schemas).alias("v")).collect()}
    assert {i: (CASES[i], got[i]) for i in range(len(CASES)) if got[i] != CASES[i][2]} == {}
    assert got[-1] is False and got[-2] is False
    with pytest.raises(ValueError):
        chat.fits(F.try_parse_json(F.lit("{}")), {"oneOf": []})


FORMS = [
    ('{"b":1e2, "a":1.0}', '{"a":1,"b":100}'), ('{"a":10000000.0,"b":1E7}', '{"a":10000000,"b":10000000}'), ('{"a":"1.0 and \\"2e5\\""}', '{"a":"1.0 and \\"2e5\\""}'), ('{"a":0.50,"b":-0.0}', '{"a":0.5,"b":0}'),
    ('{"a":12345678901234567890}', '{"a":12345678901234567890}'), ('{"a":-1.250e1}', '{"a":-12.5}'), ('{"a":[1.10,{"z":2.0,"y":[]}]}', '{"a":[1.1,{"y":[],"z":2}]}'), ('{"a":01.5}', None), ('{"a":1.}', None), ("{", None), (None, None), ('{"a":1e-30}', '{"a":1.0E-30}'), ('{"a":10e-31}', '{"a":1.0E-30}'),
]


def test_canonical_numbers(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(FORMS)], "i int, a string")
    got = {r.i: r.c for r in df.select("i", chat.canonical(F.col("a")).alias("c")).collect()}
    assert [got[i] for i in range(len(FORMS))] == [w for _, w in FORMS]


def test_query_in_python(spark):
    """Order and links of the query's traffic by a plain simulation over a few conversations, and against its SQL."""
    rows = [(c, t, "system" if c % 3 == 0 and t == 0 else "user" if (t + (c % 3 == 0)) % 2 == 0 else "assistant", None if (c, t) == (1, 2) else f"text {t} of {c} 1.50") for c in range(40) for t in range(c % 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in chat.format_chat(registry.turns_as_calls(df), registry.REPLY).collect()}
    assert len(got) == len(rows) and any(r.cyclic for r in got.values()) and any(r.order_level == 2 for r in got.values()) and any(r.valid is False for r in got.values())
    kind = {(c, t): r for c, t, r, _ in rows}
    p = lambda c, t: (c + t // 2) % 8
    for c in range(40):
        calls, results = {}, {}
        for t in range(9):
            if kind.get((c, t)) == "user":
                calls.setdefault(f"{c}-{t - 2 if p(c, t) == 7 else t}", t)
            elif kind.get((c, t)) == "assistant":
                results.setdefault(f"{c}-{t + 1 if p(c, t - 1) == 0 else t - 1}", []).append(t)
        needs = {i: [f"{c}-{t + (-2 if p(c, t) in (1, 4) else 2)}"] if p(c, t) in (1, 3, 4, 5) else [] for i, t in calls.items()}
        place, moved = {}, True
        while moved:  # settle what can be settled
            moved = False
            for i, t in calls.items():
                known = [n for n in needs[i] if n in calls]
                if i not in place and all(n in place for n in known):
                    after = max((max((place[n][0], place[n][1] + 1), (min(results[n]), 0)) if n in results else (place[n][0], place[n][1] + 1) for n in known), default=(-9, 0))
                    place[i], moved = ((after[0], after[1] + 1) if after[0] >= t else (t, 0)), True
        for i, t in calls.items():
            r = got[c, t]
            assert r.cyclic == (i not in place) and (r.order_turn, r.order_level) == place.get(i, (t, 0)) and r.linked == (i in results), (c, t)
            assert json.loads(r.json)["id"] == i and r.valid == (p(c, t) != 2 and (c, t) != (1, 2))
            for s in results.get(i, []):
                own = place.get(i, (t, 0))
                assert (got[c, s].order_turn, got[c, s].order_level) == max((s, 0), (own[0], own[1] + 1) if own[0] >= s else (s, 0)) and got[c, s].linked
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    sql = db.execute(registry.oracle_sql()["op2_chat_format"])
    names = [d[0] for d in sql.description]
    assert sorted((tuple(r[n] for n in names) for r in got.values()), key=repr) == sorted(sql.fetchall(), key=repr)


def test_hot_conversation_long_text_and_clashing_columns(spark):
    """One conversation with most rows, an id used a hundred times, a text of a megabyte and columns named like the operator's own."""
    rows = [(1, i, 0, "message", None, None, "x", None) for i in range(300)] + [(1, 1000 + i, 0, "call", "t", "same", None, "{}") for i in range(100)] + [(2, 0, 0, "message", None, None, "y" * 1_000_000, None), (None, None, None, None, None, None, None, None)]
    rows += [(3, 5 - i, 0, "call", "t", f"c{i}", None, json.dumps({"a": {"$ref": f"c{i + 1}"}})) for i in range(3)]  # waits for an id that nobody owns, in reverse
    df = spark.createDataFrame([(*r, 1, "o", True) for r in rows], "conv_id long, turn long, item int, role string, name string, call_id string, text string, arguments string, own int, n string, valid boolean")
    got = chat.format_chat(df, {"t": {}}).collect()
    assert len(got) == len(rows)
    same = [r for r in got if r.call_id == "same"]
    assert len(same) == 100 and not any(r.linked for r in same) and all(r.valid for r in same)
    assert next(r for r in got if r.conv_id == 2).json == '{"content":"' + "y" * 1_000_000 + '","role":"message"}'
    chain = {r.call_id: (r.order_turn, r.order_level) for r in got if r.conv_id == 3}
    assert chain["c2"] < chain["c1"] < chain["c0"]
