"""Chat formatting with tool-call linking, in DataFrame operations alone.

A message is a row (conv_id, turn, role, text). An assistant message whose text is a JSON object with
``tool_calls`` ([{id, name, arguments}] or [{id, function: {name, arguments}}], arguments an object or a string holding
one; an array of objects, at least one) makes calls; a tool message whose text is a JSON object with ``tool_call_id`` and ``content``
answers one. Everything else is plain content.

* Linking: calls and results are hash-joined on (conv_id, call id); a hot conversation so spreads over
  its call ids. Nothing is gathered per conversation: the result is one row a message.
* Order: a call may name calls it depends on by ``{"$ref": "<call id>"}`` in its arguments, in any turn
  before or after its own. A message follows what it depends on: a result its call, a call the first result of
  each call that it refers to, or where there is none the message with that call. Messages sort by (ord_turn,
  ord_level, turn): ord_turn is the latest turn among a message and all it depends on, ord_level counts the
  steps taken within that turn. The calls of a message are listed by their dependencies on each other, then
  as given.
* Validation: arguments are checked against the tool's schema: {"properties": {name: spec}, "required": [names],
  "additional": whether other names are allowed}. A spec is a type of ``TYPES``, a list of types, or an object with any of
  type, enum, items (a spec) and the three keys above, to any depth; nested places are told as a.b[0].
* Serialising: canonical JSON, keys sorted at every depth, no white space, numbers normalised. The content
  and all other keys beside ``tool_calls`` or ``tool_call_id``, and those of a call, are kept; a content that is a
  string stays one, whatever it holds, and a call keeps its form.

Defined results: null text is content null; null conv_id or turn is kept, and a null conv_id links with nothing.
Every row comes out once: repeated rows are kept, an empty table gives no rows. A call id used twice in a
conversation links to its first call (lowest turn, then place, then a hash of the call), repeated results all link and
the first (lowest turn) is the one that dependent calls wait for. Messages on a cycle of dependencies, or behind
one, stay in their turn, last, and say so in ``problems``, as do a result without a call, a call without a result,
and arguments that are not an object; arguments that do not parse are kept as a string. The row's role decides:
another one in the text is reported in ``problems``. A text that does not parse, repeats a key or is too long for a
variant (128 MiB) is no JSON object and stays plain content. Extra columns are ignored.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import discard, materialise

TYPES = {"string": "^STRING$", "integer": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\\(\\d+,0\\))$", "number": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<", "null": "^VOID$"}
_REF = r'"\$ref"\s*:\s*"((?:[^"\\]|\\.)+)"'
_LAST = 2**31 - 1


def _path(name: str) -> str:
    """A member's path in a variant."""
    for quote in "'\"":
        if quote not in name and "?" not in name:
            return f"$[{quote}{name}{quote}]"
    raise ValueError(f"no path leads to a property of the name {name!r}")


def _spec(spec: str | list | dict, where: str) -> dict:
    """A property's spec as an object, its type as a list; refuses types that are none."""
    spec = dict(spec) if isinstance(spec, dict) else {"type": spec}
    kinds = spec.get("type")
    spec["type"] = kinds if isinstance(kinds, list) or kinds is None else [kinds]
    if wrong := [k for k in spec["type"] or () if k not in TYPES]:
        raise ValueError(f"{where}: no type {wrong[0]!r} among {', '.join(TYPES)}")
    return spec


def _value_problems(v: Column, at: Column, spec: dict, where: str) -> Column:
    """Array of what is wrong with a value; a missing one is null and has no faults."""
    kind, none, parts = F.schema_of_variant(v), F.array().cast("array<string>"), []
    if spec["type"]:
        fits = reduce(Column.__or__, (kind.rlike(TYPES[k]) for k in spec["type"]))
        parts.append(F.when(~fits, F.array(F.concat(at, F.lit(f": not {' or '.join(spec['type'])}")))))
    if "enum" in spec:
        values = [json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in spec["enum"]]
        parts.append(F.when(v.isNotNull() & ~F.to_json(v).isin(values), F.array(F.concat(at, F.lit(": not allowed")))))
    if spec.get("properties") or spec.get("required"):
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        parts.append(F.when(kind.startswith("OBJECT<"), _member_problems(v, keys, spec, where, F.concat(at, F.lit(".")))))
    if "items" in spec:
        items = _spec(spec["items"], f"{where}[]")
        each = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: _value_problems(x, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), items, f"{where}[]"))
        parts.append(F.when(kind.startswith("ARRAY<"), F.flatten(each)))
    return F.concat(*(F.coalesce(p, none) for p in parts)) if parts else none


def _member_problems(v: Column, keys: Column, schema: dict, where: str, before: Column | None = None) -> Column:
    """Array of what is wrong with the members (named ``keys``) of an object."""
    named = lambda x: x if before is None else F.concat(before, x)
    none, parts, properties = F.array().cast("array<string>"), [], schema.get("properties", {})
    for field, spec in properties.items():
        own = f"{where}.{field}"
        parts.append(_value_problems(F.try_variant_get(v, _path(field), "variant"), named(F.lit(field)), _spec(spec, own), own))
    parts += [F.when(F.array_contains(keys, field), none).otherwise(F.array(F.concat(named(F.lit(field)), F.lit(": missing")))) for field in schema.get("required", [])]
    if not schema.get("additional", False) and (before is None or properties):
        allowed = F.array(*map(F.lit, properties)) if properties else none
        parts.append(F.transform(F.array_except(keys, allowed), lambda k: F.concat(named(k), F.lit(": unknown"))))
    return F.concat(*parts) if parts else none


def _argument_problems(name: Column, v: Column, keys: Column, schemas: dict[str, dict]) -> Column:
    """Array of what is wrong with the arguments ``v`` (a variant with these keys) of a call of tool ``name``."""
    none = F.array().cast("array<string>")
    known = none
    for tool, schema in schemas.items():
        known = F.when(name == tool, _member_problems(v, keys, schema, tool)).otherwise(known)
    unknown = F.when(~F.coalesce(name.isin(*schemas), F.lit(False)), F.array(F.lit("tool: unknown"))).otherwise(none) if schemas else none
    return F.when(keys.isNull(), F.array(F.lit("arguments: not an object"))).otherwise(F.concat(unknown, known))


def _calls() -> Column:
    """The calls that a text holds, as array<variant>; null if its ``tool_calls`` is no array."""
    return F.try_variant_get(F.try_parse_json(F.col("text")), "$.tool_calls", "array<variant>")


def makes_calls() -> Column:
    """Whether a message makes calls; never null."""
    objects = F.forall(_calls(), lambda x: F.schema_of_variant(x).startswith("OBJECT<"))
    return F.coalesce((F.col("role") == "assistant") & F.col("text").contains("tool_calls") & (F.size(_calls()) > 0) & objects, F.lit(False))


def _member(x: Column, key: str) -> Column:
    return F.try_variant_get(x, f"$.{key}", "string")


def _nested(x: Column) -> Column:
    """Whether a call keeps its name and arguments in an object ``function``."""
    inner = F.schema_of_variant(F.try_variant_get(x, "$.function", "variant")).startswith("OBJECT<")
    flat = F.try_variant_get(x, "$.name", "variant").isNotNull() | F.try_variant_get(x, "$.arguments", "variant").isNotNull()
    return F.coalesce(inner & ~flat, F.lit(False))


def _called(x: Column, key: str) -> Column:
    """The ``name`` or ``arguments`` of a call, in either form."""
    return F.when(_nested(x), _member(x, f"function.{key}")).otherwise(_member(x, key))


def answers_call() -> Column:
    """Whether a message answers a call; never null."""
    text = F.col("text")
    whole = F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT<")
    return F.coalesce((F.col("role") == "tool") & text.contains("tool_call_id") & F.get_json_object(text, "$.tool_call_id").isNotNull() & whole, F.lit(False))


def _rest(v: Column, *own: str) -> Column:
    """The members of a variant object besides ``own``: array<struct<k, json>>."""
    members = F.filter(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: ~e["key"].isin(*own))
    return F.transform(members, lambda e: F.struct(e["key"].alias("k"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("json")))


def _object(rest: Column, **members: Column) -> Column:
    """A JSON object of ``rest`` and of members given as JSON, keys sorted."""
    given = F.array(*(F.struct(F.lit(k).alias("k"), v.alias("json")) for k, v in members.items()))
    parts = F.transform(F.array_sort(F.concat(rest, given)), lambda m: F.concat(_quoted(m["k"]), F.lit(":"), m["json"]))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def _other_role(v: Column, role: str) -> Column:
    """What is wrong with the role that a text gives itself."""
    found = F.to_json(F.try_variant_get(v, "$.role", "variant"))
    return F.when(~found.isin(f'"{role}"', "null"), F.array(F.concat(F.lit("role: "), found))).otherwise(F.array().cast("array<string>"))


# -- order -------------------------------------------------------------------------------------------


def _followed(at: Column, level: Column, m: Column, n: Column, c: Column) -> tuple[Column, Column]:
    """The place (turn, level) after ``n`` steps from (at, level) whose latest turn is ``m``: a step into a
    later turn starts it at level 0, so from before ``m`` one always ends at level ``c``."""
    return F.greatest(at, m), F.when(at >= m, level + n).otherwise(c)


def _joined(first: str, then: str) -> list[Column]:
    """(m, n, c) of the steps ``first`` followed by the steps ``then`` (prefixes of columns)."""
    m1, n1, c1, m2, n2, c2 = (F.col(f"{p}{x}") for p in (first, then) for x in "mnc")
    return [F.greatest(m1, m2).alias("m"), (n1 + n2).alias("n"), F.when(m1 >= m2, c1 + n2).otherwise(c2).alias("c")]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def places(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, at, level) for each of ``nodes`` (node, t) with dependencies ``edges`` (node, needs): ``at`` is the
    latest t among a node and all it depends on, ``level`` the most steps taken at that t. Both are null on
    a cycle and behind one.

    Nodes with one dependency make chains, which are followed by doubling: each round every open chain
    skips as far as the node it points to has already skipped, so a chain of n takes log2(n) rounds; what
    has reached a chain's root is not written again. Nodes with several dependencies are then placed level
    by level among themselves, so only their own nesting costs rounds.
    """
    edges = materialise(edges.distinct().join(nodes, "node"), "edges")
    if edges.isEmpty():
        discard(edges)
        return nodes.select("node", F.col("t").alias("at"), F.lit(0).cast("long").alias("level"))
    scratch = [edges]
    degree = edges.groupBy("node").agg(F.count("*").alias("k"), F.min("needs").alias("to"), F.min("t").alias("t"))
    degree = materialise(degree, "degree")
    scratch.append(degree)
    lone = degree.filter("k = 1")
    rooted = lone.join(lone.select(F.col("node").alias("to"), F.lit(True).alias("inner")), "to", "left")
    chain = materialise(rooted.select("node", "to", F.col("t").alias("m"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("c"), F.col("inner").isNull().alias("ends")), "chain")
    scratch.append(chain)
    closed, rounds = [chain.filter("ends")], 0
    left, longest = chain.filter("NOT ends"), None
    while not left.isEmpty():
        if longest is None:  # no chain is longer than its conversation has nodes
            longest = chain.count()
        if 1 << rounds > longest:
            break  # what is still open runs in a circle
        ahead = _union([*closed, left]).select(F.col("node").alias("to"), F.col("to").alias("further"), *(F.col(x).alias(f"a_{x}") for x in "mnc"), F.col("ends").alias("a_ends"))
        near = left.select("node", "to", *(F.col(x).alias(f"b_{x}") for x in "mnc"))
        step = materialise(near.join(ahead, "to").select("node", F.col("further").alias("to"), *_joined("a_", "b_"), F.col("a_ends").alias("ends")), "chain")
        scratch.append(step)
        closed.append(step.filter("ends"))
        left, rounds = step.filter("NOT ends"), rounds + 1
    chains = _union(closed).drop("ends")

    # Nodes without dependencies stand where they are.
    known = [nodes.join(degree.select("node"), "node", "left_anti").select("node", F.col("t").alias("at"), F.lit(0).cast("long").alias("level"))]
    several = degree.filter("k > 1").select("node")
    if not several.isEmpty():
        own = edges.join(several, "node", "left_semi").select("node", F.col("needs").alias("to"), F.col("t").alias("b_m"), F.lit(1).cast("long").alias("b_n"), F.lit(0).cast("long").alias("b_c"))
        through = chains.select(F.col("node").alias("to"), F.col("to").alias("root"), *(F.col(x).alias(f"a_{x}") for x in "mnc"))
        via = own.join(through, "to", "left")
        direct = via.filter("root IS NULL").select("node", F.col("to").alias("root"), *(F.col(f"b_{x}").alias(x) for x in "mnc"))
        state = direct.unionByName(via.filter("root IS NOT NULL").select("node", "root", *_joined("a_", "b_")))
        state = state.join(known[0].withColumnRenamed("node", "root"), "root", "left")
        while True:
            state = materialise(state, "waiting")
            scratch.append(state)
            at, level = _followed(F.col("at"), F.col("level"), F.col("m"), F.col("n"), F.col("c"))
            placed = state.groupBy("node").agg(F.max(F.struct(at.alias("at"), level.alias("level"))).alias("p"), F.count_if(F.col("at").isNull()).alias("waits"))
            fresh = materialise(placed.filter("waits = 0").select("node", "p.at", "p.level"), "placed")
            scratch.append(fresh)
            if fresh.isEmpty():
                break
            known.append(fresh)
            found = fresh.select(F.col("node").alias("root"), F.col("at").alias("f_at"), F.col("level").alias("f_level"))
            state = state.join(fresh.select("node"), "node", "left_anti").join(found, "root", "left").select("node", "root", "m", "n", "c", F.coalesce("at", "f_at").alias("at"), F.coalesce("level", "f_level").alias("level"))
    known = _union(known)
    at, level = _followed(F.col("at"), F.col("level"), F.col("m"), F.col("n"), F.col("c"))
    followed = chains.join(known.withColumnRenamed("node", "to"), "to").select("node", at.alias("at"), level.alias("level"))
    out = materialise(nodes.select("node").join(known.unionByName(followed), "node", "left"), "places")
    discard(*scratch)
    return out


def _looked_up(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with what is known of (conv_id, id). Rows without one of these find nothing and go round
    the join, where they would all meet in one task."""
    keyed = F.col("conv_id").isNotNull() & F.col("id").isNotNull()
    return rows.filter(keyed).join(known, ["conv_id", "id"], "left").unionByName(rows.filter(~keyed), allowMissingColumns=True)


def _quoted(text: Column) -> Column:
    """A string as a JSON string; null as null."""
    json = F.to_json(F.struct(text.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(json, F.lit(6), F.length(json) - 6)


def _references(arguments: Column) -> Column:
    """The call ids that arguments refer to, without JSON's escapes."""
    found = F.regexp_extract_all(arguments, F.lit(_REF), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.get_json_object(F.concat(F.lit('{"v":"'), x, F.lit('"}')), "$.v")))


def _serialised(calls: Column, info: Column, schemas: dict[str, dict]) -> Column:
    """The calls of a message in their order: array<struct<l, place, json, told>>. ``info``: array of
    (place, level, answered) of each call, by place."""
    none = F.array().cast("array<string>")
    bound = F.transform(calls, lambda x, i: F.struct(x.alias("x"), i.alias("place"), _member(x, "id").alias("id"), *(_called(x, c).alias(c) for c in ("name", "arguments")), F.get(info, i).alias("info")))
    # Arguments are parsed once for all that looks at them.
    bound = F.transform(bound, lambda c: F.struct(c.alias("c"), F.try_parse_json(c["arguments"]).alias("v"), F.json_object_keys(c["arguments"]).alias("keys")))

    def one(b: Column) -> Column:
        c = b["c"]
        wrong = F.concat(
            _argument_problems(c["name"], b["v"], b["keys"], schemas), F.when(c["info"]["answered"], none).otherwise(F.array(F.lit("no result"))),
            F.when(c["id"].isNull(), F.array(F.lit("no id"))).otherwise(none), F.when(c["info"]["level"].isNull(), F.array(F.lit("cyclic"))).otherwise(none),
        )
        own = {"arguments": F.coalesce(F.to_json(b["v"]), _quoted(c["arguments"])), "name": _quoted(c["name"])}
        inner = _object(_rest(F.try_variant_get(c["x"], "$.function", "variant"), "name", "arguments"), **own)
        text = F.when(_nested(c["x"]), _object(_rest(c["x"], "id", "function"), function=inner, id=_quoted(c["id"]))).otherwise(_object(_rest(c["x"], "id", "name", "arguments"), id=_quoted(c["id"]), **own))
        return F.struct(F.coalesce(c["info"]["level"], F.lit(_LAST).cast("long")).alias("l"), c["place"].alias("place"), text.alias("json"), F.transform(wrong, lambda w: F.concat_ws(" ", c["id"], w)).alias("told"))

    return F.array_sort(F.transform(bound, one))


def format_chat(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row a message: conv_id, turn, role, ord_turn, ord_level, message, n_calls, problems.

    Texts are written once and shuffled once, to meet what the links say of their message; everything
    between is done on ids.
    """
    messages = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    is_call, is_result = makes_calls(), answers_call()
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    envelope = F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role")), {"ignoreNullFields": "false"})
    plain = messages.filter(~is_call & ~is_result).select("conv_id", "turn", "role", F.col("turn").alias("ord_turn"), F.lit(0).alias("ord_level"), envelope.alias("message"), zero.alias("n_calls"), none.alias("problems"))

    # Every message that takes part has a key of its own, written once so that no recomputation deals it anew.
    linked = materialise(messages.filter(is_call | is_result).withColumn("row", F.monotonically_increasing_id()).withColumn("asks", F.col("role") == "assistant"), "linked")
    if linked.isEmpty():
        return plain
    text = F.col("text")
    calls = linked.filter("asks").select("row", "conv_id", "turn", F.posexplode(_calls()).alias("place", "x"))
    calls = materialise(calls.select("row", "conv_id", "turn", "place", _member(F.col("x"), "id").alias("id"), _references(_called(F.col("x"), "arguments")).alias("refs"), F.xxhash64(F.to_json("x")).alias("h")), "calls")
    results = materialise(linked.filter("NOT asks").select("row", "conv_id", "turn", F.get_json_object(text, "$.tool_call_id").alias("id")), "results")
    keyed = "conv_id IS NOT NULL AND id IS NOT NULL"
    first = calls.filter(keyed).groupBy("conv_id", "id").agg(F.min(F.struct("turn", "place", "h", "row")).alias("f")).select("conv_id", "id", F.col("f.row").alias("call_row"), F.col("f.place").alias("call_place"), F.col("f.turn").alias("call_turn"))
    told = results.filter(keyed).groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row")).alias("f")).select("conv_id", "id", F.col("f.row").alias("result_row"))
    known = materialise(first.join(told, ["conv_id", "id"], "left"), "known")

    # References to ids that are no calls hold nothing up.
    needs = calls.filter("conv_id IS NOT NULL").select("row", "place", "conv_id", F.explode("refs").alias("id")).join(known, ["conv_id", "id"])
    needs = materialise(needs.select("row", "place", "call_row", "call_place", "result_row"), "needs")
    node = lambda row, place: F.concat_ws(":", row, place)
    inner = needs.filter("row = call_row").select(node("row", "place").alias("node"), node("row", "call_place").alias("needs"))
    within = places(calls.select(node("row", "place").alias("node"), zero.alias("t")), inner)
    answering = results.join(known, ["conv_id", "id"]).select(F.col("row").alias("node"), F.col("call_row").alias("needs"))
    outer = needs.filter("row <> call_row").select(F.col("row").alias("node"), F.coalesce("result_row", "call_row").alias("needs"))
    # A missing turn is before all others.
    never = F.lit(-(2**63))
    order = places(linked.select(F.col("row").alias("node"), F.coalesce("turn", never).alias("t")), outer.unionByName(answering))

    named = _looked_up(calls.select("row", "place", "conv_id", "id", node("row", "place").alias("node")), known.select("conv_id", "id", F.col("result_row").isNotNull().alias("answered")))
    named = named.join(within.select("node", "level"), "node")
    # A message's calls, at most what its own text holds.
    per_message = named.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "level", F.coalesce("answered", F.lit(False)).alias("answered")))).alias("info"))
    per_result = _looked_up(results.select("row", "conv_id", "id"), known.select("conv_id", "id", "call_turn", F.lit(True).alias("found"))).select("row", "call_turn", F.coalesce("found", F.lit(False)).alias("found"))
    links = per_message.unionByName(per_result, allowMissingColumns=True).join(order.withColumnRenamed("node", "row"), "row")

    asks, stuck, v = F.col("asks"), F.col("at").isNull(), F.try_parse_json(text)
    whole = linked.join(links, "row").select(
        *linked.columns, stuck.alias("stuck"), F.when(stuck, F.greatest("turn", "call_turn")).otherwise(F.nullif(F.col("at"), never)).alias("ord_turn"),
        F.when(stuck, F.when(asks, _LAST - 1).otherwise(_LAST)).otherwise(F.col("level")).cast("int").alias("ord_level"), "found", F.when(asks, _serialised(_calls(), F.col("info"), schemas or {})).alias("all"),
    )
    asked = _object(_rest(v, "role", "tool_calls"), role=F.lit('"assistant"'), tool_calls=F.concat(F.lit("["), F.array_join(F.transform("all", lambda c: c["json"]), ","), F.lit("]")))
    content, call_id = F.to_json(F.try_variant_get(v, "$.content", "variant")), F.get_json_object(text, "$.tool_call_id")
    answered = _object(_rest(v, "content", "role", "tool_call_id"), content=F.coalesce(content, F.lit("null")), role=F.lit('"tool"'), tool_call_id=_quoted(call_id))
    cyclic = F.when(F.col("stuck"), F.array(F.lit("cyclic"))).otherwise(none)
    said = F.when(asks, F.concat(_other_role(v, "assistant"), cyclic, F.flatten(F.transform("all", lambda c: c["told"])))).otherwise(
        F.concat(_other_role(v, "tool"), cyclic, F.when(F.col("found"), none).otherwise(F.array(F.concat(call_id, F.lit(" no call")))))
    )
    return plain.unionByName(whole.select("conv_id", "turn", "role", "ord_turn", "ord_level", F.when(asks, asked).otherwise(answered).alias("message"), F.when(asks, F.size("all")).otherwise(0).cast("long").alias("n_calls"), said.alias("problems")))
