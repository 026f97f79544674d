"""Chat formatting: tool calls and results linked by identifier, topologically ordered, validated, canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, join_split, let

#: Columns of an event. role is "call" or "result" for tool traffic, anything else for plain messages.
EVENT = ("conv_id", "turn", "item", "role", "name", "call_id", "text", "arguments")


def events_from_messages(messages: DataFrame) -> DataFrame:
    """Events of (conv_id, turn, role, text). An assistant text that is a JSON object with tool_calls
    ([{id, name, arguments}]) becomes one call per entry; a tool text with tool_call_id becomes a result; any other
    row is a plain message, malformed JSON included."""
    calls = "array<struct<id:string,name:string,arguments:string>>"
    parsed = F.from_json("text", f"struct<tool_calls:{calls},tool_call_id:string,content:string>")
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").withColumn(
        "p", F.when(F.ltrim("text").startswith("{"), parsed))
    is_call = (F.col("role") == "assistant") & (F.coalesce(F.size("p.tool_calls"), F.lit(0)) > 0)
    is_result = (F.col("role") == "tool") & F.col("p.tool_call_id").isNotNull()
    kind = F.when(is_call, "call").when(is_result, "result").otherwise("message")
    base = base.withColumn("kind", F.coalesce(kind, F.lit("message")))
    none = F.lit(None).cast("string")
    plain = base.where("kind = 'message'").select("conv_id", "turn", F.lit(0).alias("item"), "role", none.alias("name"), none.alias("call_id"), "text", none.alias("arguments"))
    call = base.where("kind = 'call'").select("conv_id", "turn", F.posexplode("p.tool_calls").alias("item", "c")).select(
        "conv_id", "turn", "item", F.lit("call").alias("role"), "c.name", F.col("c.id").alias("call_id"), none.alias("text"), "c.arguments")
    result = base.where("kind = 'result'").select("conv_id", "turn", F.lit(0).alias("item"), F.lit("result").alias("role"), none.alias("name"), F.col("p.tool_call_id").alias("call_id"), F.col("p.content").alias("text"), none.alias("arguments"))
    return plain.unionByName(call).unionByName(result)


def one_form(json: Column) -> Column:
    """JSON text whose numbers have one form: no exponent, no fraction of zeros, exact up to 20 digits before and 18 after the
    point; beyond that the nearest double's own form. Strings, order and white space stay; so does what is no JSON number."""
    token = r'"(?:[^"\\]|\\.)*+"?|-?[0-9][0-9.eE+-]*+|[^"0-9-]++|-'

    def form(t: Column) -> Column:
        number = t.rlike(r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$")
        exact, near = t.try_cast("decimal(38,18)"), t.try_cast("double")
        plain = F.regexp_replace(F.regexp_replace(exact.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        # an exact value that has no exponent comes as decimal text; others print their zero padding as 0E-18
        plain = F.when(exact == 0, "0").otherwise(plain)
        return F.when(number & t.rlike("[.eE]"), F.when(exact.cast("double") == near, plain).otherwise(near.cast("string"))).otherwise(t)

    rewritten = F.array_join(F.transform(F.regexp_extract_all(json, F.lit(token), F.lit(0)), lambda t: F.when(t.rlike("^-?[0-9]"), form(t)).otherwise(t)), "")
    return F.when(json.rlike("[0-9][.eE]"), rewritten).otherwise(json)


#: JSON types and the variant types they admit. A number that is whole is an integer, whatever its size.
TYPES = {"string": "STRING", "boolean": "BOOLEAN", "integer": r"BIGINT|DECIMAL\([0-9]+,0\)", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID"}
#: Keywords that say nothing about validity.
SILENT = {"title", "description", "default", "examples", "$schema", "$id"}
BOUNDS = {"minimum": lambda x, y: x >= y, "maximum": lambda x, y: x <= y, "exclusiveMinimum": lambda x, y: x > y, "exclusiveMaximum": lambda x, y: x < y}
SIZES = {"minLength": lambda x, y: x >= y, "maxLength": lambda x, y: x <= y, "minItems": lambda x, y: x >= y, "maxItems": lambda x, y: x <= y}


def _canonical_literal(value: object) -> str:
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fits(v: Column, schema: Mapping) -> Column:
    """Whether a variant fits a JSON schema: type (one or a list), enum, const, properties, required, additionalProperties (a
    truth value or a schema), items, minItems, maxItems, minimum, maximum, their exclusive forms, minLength, maxLength,
    pattern; nested at any depth. Another keyword raises ValueError. Keywords of one type let other types pass."""
    wide = {"required", "properties", "additionalProperties"} & set(schema)
    inner = lambda v: let(F.schema_of_variant(v), lambda kind: let(_members(v), lambda m: _rules(v, kind, m, schema)) if wide else _rules(v, kind, None, schema))
    return let(v, inner)


def _rules(v: Column, kind: Column, members: Column | None, schema: Mapping) -> Column:
    of = lambda t: kind.rlike(f"^(?:{TYPES[t]})$")
    rules = [F.lit(True)]
    for word, x in schema.items():
        if word == "type":
            rules.append(kind.rlike("^(?:" + "|".join(TYPES[t] for t in ([x] if isinstance(x, str) else x)) + ")$"))
        elif word in ("enum", "const"):
            rules.append(F.to_json(v).isin(*map(_canonical_literal, x if word == "enum" else [x])))
        elif word == "required":
            rules.append(~of("object") | (F.size(F.array_except(F.array(*map(F.lit, x)).cast("array<string>"), F.map_keys(members))) == 0))
        elif word == "properties":
            for name, sub in x.items():
                part = F.try_element_at(members, F.lit(name))
                rules.append(~of("object") | ~F.array_contains(F.map_keys(members), name) | F.coalesce(fits(part, sub), F.lit(False)))
        elif word == "additionalProperties":
            known = F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")
            if x is False:
                rules.append(~of("object") | (F.size(F.array_except(F.map_keys(members), known)) == 0))
            elif x is not True:
                rules.append(~of("object") | F.forall(F.map_entries(members), lambda e: F.array_contains(known, e["key"]) | F.coalesce(fits(e["value"], x), F.lit(False))))
        elif word == "items":
            rules.append(~of("array") | F.forall(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.coalesce(fits(e, x), F.lit(False))))
        elif word in BOUNDS:
            rules.append(~of("number") | BOUNDS[word](F.try_variant_get(v, "$", "double"), F.lit(float(x))))
        elif word in SIZES:
            kind_, size = ("string", F.char_length(F.try_variant_get(v, "$", "string"))) if word.endswith("Length") else ("array", F.size(F.try_variant_get(v, "$", "array<variant>")))
            rules.append(~of(kind_) | SIZES[word](size, F.lit(x)))
        elif word == "pattern":
            rules.append(~of("string") | F.try_variant_get(v, "$", "string").rlike(x))
        elif word not in SILENT:
            raise ValueError(f"unknown schema keyword {word!r}")
    return reduce(lambda p, q: p & q, rules)


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def arguments_valid(name: Column, arguments: Column, schemas: Mapping[str, Mapping]) -> Column:
    """Whether arguments are a JSON object that fits the tool's schema, see fits(). Unknown tools, nulls and malformed JSON,
    to which objects with a repeated key count, are not valid."""
    def judged(v: Column) -> Column:
        out = F.lit(False)
        for tool, schema in sorted(schemas.items()):
            out = F.when(name == tool, F.coalesce(F.schema_of_variant(v).rlike("^OBJECT") & fits(v, schema), F.lit(False))).otherwise(out)
        return F.coalesce(out, F.lit(False))

    return let(F.try_parse_json(one_form(arguments)), judged)


def canonical(json: Column) -> Column:
    """JSON text with sorted keys, one form of numbers and no spaces; null where it is malformed."""
    return F.to_json(F.try_parse_json(one_form(json)))


def format_chat(events: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """One row per event: conv_id, turn, item, kind (message, call, result), call_id, linked, valid, cyclic,
    order_turn, order_level, json.

    A result links to the call of its conversation with its call_id; of several such calls the first by (turn, item)
    owns the id, the others stay unlinked. linked is null for messages. valid judges a call's arguments, null otherwise.
    Topological order is (conv_id, order_turn, order_level, turn, item): a result follows its call, and a call whose
    arguments hold {"$ref": id} follows that id's result, even where turns say otherwise; events without such a need
    keep (turn, 0). Calls that wait for each other in a cycle keep their turns and are marked cyclic.
    json has sorted keys: role, content for messages; arguments (canonical, or the raw string if malformed), id,
    name for calls; content, tool_call_id for results. Null texts are JSON nulls. Rows with a null conv_id or turn stay, unlinked.
    Repeated rows stay; ids they share are owned once. Empty tables give empty results.

    Plan: calls and results meet in a hash join on (conv_id, call_id), pre-aggregated to one owner per id; ids of many rows are
    split, and so are the rows of one conversation that have no id. A conversation is never gathered, so its length does
    not matter; rows carry their order. Only conversations in which some call waits for a later result enter the
    rounds of topological ordering, one join each, and only from their first such call on.
    """
    e = events.select(*EVENT).withColumn("kind", F.when(F.col("role").isin("call", "result"), F.col("role")).otherwise("message"))
    named = e.where("kind <> 'message' and call_id is not null and conv_id is not null")
    mine, result = F.when(F.col("kind") == "call", F.struct("turn", "item")), F.when(F.col("kind") == "result", F.col("turn"))
    pairs = named.groupBy("conv_id", "call_id").agg(F.min(mine).alias("own"), F.min(result).alias("result_turn"), F.count_if(F.col("kind") == "result").alias("results"), F.count("*").alias("n"))
    pairs = pairs.where("own is not null").withColumn("result_turn", F.when(F.col("results") > 0, F.col("result_turn"))).drop("results")
    limit = max(1.0, events.count() * HOT_SHARE)
    e = join_split(e, pairs, ["conv_id", "call_id"], "n", limit, F.xxhash64("conv_id", "turn", "item", "text"), "left")
    mine = F.struct("turn", "item").eqNullSafe(F.col("own"))
    answered = F.col("own").isNotNull() & F.col("result_turn").isNotNull()
    linked = F.when(F.col("kind") == "call", mine & answered).when(F.col("kind") == "result", F.col("own").isNotNull())
    e = e.withColumns({
        "linked": F.coalesce(linked, F.when(F.col("kind") != "message", False)),
        "valid": F.when(F.col("kind") == "call", arguments_valid(F.col("name"), F.col("arguments"), schemas)),
    })
    levels = _order(e)
    late = F.when((F.col("kind") == "result") & F.col("own").isNotNull() & (F.col("own.turn") >= F.col("turn")), F.col("own.turn"))
    if levels is not None:
        e = join_split(e, levels, ["conv_id", "call_id"], "n", limit, F.xxhash64("conv_id", "turn", "item", "text"), "left")
        call_turn, call_level, cyclic = F.coalesce("ref_turn", "own.turn"), F.coalesce("ref_level", F.lit(0)), F.coalesce("in_cycle", F.lit(False))
        own_call = (F.col("kind") == "call") & mine
        order_turn = F.when(own_call, call_turn).when(F.col("kind") == "result", F.greatest("turn", F.coalesce(call_turn, "turn"))).otherwise(F.col("turn"))
        order_level = F.when(own_call, call_level).when((F.col("kind") == "result") & (call_turn >= F.col("turn")), call_level + 1).otherwise(F.lit(0))
        cyclic = F.when(own_call | (F.col("kind") == "result"), cyclic).otherwise(F.lit(False))
    else:
        order_turn, order_level, cyclic = F.coalesce(late, "turn"), F.when(late.isNotNull(), 1).otherwise(0), F.lit(False)
    keep = {"ignoreNullFields": "false"}
    call_json = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), _quoted("arguments")), F.lit(',"id":'), _quoted("call_id"), F.lit(',"name":'), _quoted("name"), F.lit(',"role":"call"}'))
    result_json = F.to_json(F.struct(F.col("text").alias("content"), F.lit("result").alias("role"), F.col("call_id").alias("tool_call_id")), keep)
    plain_json = F.to_json(F.struct(F.col("text").alias("content"), F.col("role")), keep)
    return e.select(
        "conv_id", "turn", "item", "kind", "call_id", "linked", "valid", cyclic.alias("cyclic"),
        F.coalesce(order_turn, "turn").alias("order_turn"), order_level.cast("int").alias("order_level"),
        F.when(F.col("kind") == "call", call_json).when(F.col("kind") == "result", result_json).otherwise(plain_json).alias("json"))


def _quoted(name: str) -> Column:
    """A string column as a JSON string or null."""
    one = F.to_json(F.struct(F.col(name).alias("a")), {"ignoreNullFields": "false"})
    return F.substring(one, F.lit(6), F.length(one) - 6)


def _order(e: DataFrame) -> DataFrame | None:
    """(conv_id, call_id, ref_turn, ref_level, in_cycle, n) for owned calls whose place chains of $ref may change, or None
    without any; n is the number of rows with that id.

    A reference to a call whose result stands before is met by the turns as they are. Where one is not, the calls of
    that conversation from there on go through rounds that take the calls whose references are all settled; what is
    never settled waits in a cycle.
    """
    owned = F.struct("turn", "item").eqNullSafe(F.col("own"))
    refs = e.where("kind = 'call' and arguments is not null and conv_id is not null").where(F.col("arguments").contains("$ref")).where(owned).select(
        "conv_id", "call_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r'"\$ref"\s*:\s*"([^"]+)"'), F.lit(1)))).alias("needs"))
    targets = e.where("kind = 'call' and conv_id is not null").where(owned).select(
        "conv_id", F.col("call_id").alias("needs"), F.col("turn").alias("needs_turn"), "result_turn").distinct()
    edges = refs.distinct().join(targets, ["conv_id", "needs"]).withColumn("unmet", F.greatest("needs_turn", F.coalesce("result_turn", "needs_turn")) >= F.col("turn"))
    edges = cut(edges)
    start = edges.groupBy("conv_id").agg(F.min(F.when(F.col("unmet"), F.least("turn", "needs_turn"))).alias("start"), F.count("*").alias("n")).where("start is not null")
    edges = cut(join_split(edges, start, ["conv_id"], "n", max(1.0, edges.count() * HOT_SHARE), F.xxhash64("call_id", "needs")).where("turn >= start").drop("unmet"))
    if edges.isEmpty():
        return None
    before = F.col("needs_turn") < F.col("start")
    nodes = edges.select("conv_id", "call_id", "turn").unionByName(edges.where(~before).select("conv_id", F.col("needs").alias("call_id"), F.col("needs_turn").alias("turn"))).distinct()
    settled = edges.where(before).select("conv_id", F.col("needs").alias("call_id"), F.col("needs_turn").alias("turn")).distinct()
    first = nodes.join(edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").unionByName(settled)
    done = cut(first.select("conv_id", "call_id", F.col("turn").alias("ref_turn"), F.lit(0).alias("ref_level")))
    before = -1
    while (now := done.count()) != before:
        before = now
        open_edges = edges.join(done.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
        met = open_edges.join(done.select("conv_id", F.col("call_id").alias("needs"), "ref_turn", "ref_level"), ["conv_id", "needs"], "left")
        # a result stands at the later of its own turn and its call's; one level above the call where these are equal
        at = F.struct(F.greatest("ref_turn", F.coalesce("result_turn", "ref_turn")).alias("t"),
                      F.when(F.coalesce("result_turn", "ref_turn") > F.col("ref_turn"), 0).otherwise(F.col("ref_level") + 1).alias("l"))
        ready = met.groupBy("conv_id", "call_id", "turn").agg(F.max(F.col("ref_turn").isNull()).alias("waits"), F.max(at).alias("after")).where("not waits")
        late = F.col("after.t") >= F.col("turn")
        done = cut(done.unionByName(ready.select("conv_id", "call_id", F.greatest("turn", "after.t").alias("ref_turn"), F.when(late, F.col("after.l") + 1).otherwise(0).alias("ref_level"))))
    stuck = nodes.join(done.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
    placed = done.withColumn("in_cycle", F.lit(False)).unionByName(
        stuck.select("conv_id", "call_id", F.col("turn").alias("ref_turn"), F.lit(0).alias("ref_level"), F.lit(True).alias("in_cycle")))
    size = e.where("own is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("n"))
    return placed.join(size, ["conv_id", "call_id"])
