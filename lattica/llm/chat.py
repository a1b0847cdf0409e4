"""Chat formatting with tool calls linked to their results.

Calls stand in an assistant's message whose text is a JSON object with ``tool_calls``; results in
a tool's message whose text is one with ``tool_call_id``. Calls and results are joined by
conversation and identifier. A call whose arguments hold ``${id}`` depends on the call of that
id: a call's level is one more than the highest of those it depends on, found by repeated joins.
Arguments are held against the tool's schema. Each message becomes one row of canonical JSON
(sorted keys, no blanks), with the keys by which a conversation's rows are ordered: each result
behind its call, calls of one message by level. No conversation is gathered into one row.

Only DataFrame functions are used; JSON is read as variants, whose objects sort their keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import durable

#: Tools by name: parameters with their types, those with ``!`` required.
TOOLS = {
    "search": {"query": "string!", "limit": "integer"},
    "calculate": {"expression": "string!"},
    "weather": {"city": "string!", "days": "integer", "metric": "boolean"},
}
_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY"}
_REFERENCE = r"\$\{([A-Za-z0-9_.:-]+)\}"


def _quoted(value: Column) -> Column:
    """The value as JSON; a null is ``null``."""
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _text_of(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, path, "string")


def _json_of(variant: Column, path: str) -> Column:
    """What stands at the path, of any type, as canonical JSON; ``null`` if nothing does."""
    return F.coalesce(F.to_json(F.try_variant_get(variant, path, "variant")), F.lit("null"))


def _further(variant: Column, *known: str) -> Column:
    """The object's other members as (key, JSON) structs."""
    every = F.map_entries(F.coalesce(F.try_variant_get(variant, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    return F.transform(F.filter(every, lambda x: ~x["key"].isin("role", *known)), lambda x: F.struct(x["key"].alias("key"), F.coalesce(F.to_json(x["value"]), F.lit("null")).alias("value")))


def _object(further: Column, **members: Column) -> Column:
    """Canonical JSON of an object: ``members`` (as JSON) and ``further`` ones, sorted by key."""
    named = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in members.items()])
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.concat(named, further)), lambda x: F.concat(_quoted(x["key"]), F.lit(":"), x["value"])), ","), F.lit("}"))


def _type_of(arguments: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(arguments, f"$['{name}']", "variant"))


def _valid(name: Column, arguments: Column, tools: dict[str, dict[str, str]]) -> Column:
    """Whether the arguments are an object that has the tool's required parameters, no unknown
    ones, and the right types; false for unknown tools."""
    keys = F.map_keys(F.coalesce(F.try_variant_get(arguments, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    out = F.lit(False)
    for tool, parameters in tools.items():
        checks = [F.coalesce(F.schema_of_variant(arguments).rlike("^OBJECT"), F.lit(False)), F.size(F.array_except(keys, F.array(*map(F.lit, parameters)).cast("array<string>"))) == 0]
        for parameter, kind in parameters.items():
            fits = F.coalesce(_type_of(arguments, parameter).rlike(_TYPES[kind.rstrip("!")]), F.lit(False))
            checks.append(fits if kind.endswith("!") else fits | ~F.array_contains(keys, parameter))
        out = F.when(name == tool, reduce(lambda a, b: a & b, checks)).otherwise(out)
    return out


def _levels(calls: DataFrame) -> DataFrame:
    """conv_id, turn, idx, level of each call; calls in a cycle, or behind one, have level -1."""
    key = ["conv_id", "turn", "idx"]
    links = (
        calls.select(*key, F.explode(F.array_distinct("needs")).alias("call_id"))
        .join(calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "idx")).alias("on")), ["conv_id", "call_id"])
        .select(*key, F.col("on.turn").alias("on_turn"), F.col("on.idx").alias("on_idx"))
    )
    links = durable(links)
    free = calls.select(*key).distinct()
    if links.isEmpty():
        return free.withColumn("level", F.lit(0))
    known = free.join(links.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(0))
    known, before = durable(known), -1
    while (now := known.count()) != before:
        before = now
        on = known.select("conv_id", F.col("turn").alias("on_turn"), F.col("idx").alias("on_idx"), F.col("level").alias("on_level"))
        ready = (
            links.join(known.select(*key), key, "left_anti")
            .join(on, ["conv_id", "on_turn", "on_idx"], "left")
            .groupBy(*key)
            .agg(F.max("on_level").alias("top"), F.count_if(F.col("on_level").isNull()).alias("open"))
            .where("open = 0")
            .select(*key, (F.col("top") + 1).alias("level"))
        )
        known = durable(known.unionByName(ready))
    return free.join(known, key, "left").select(*key, F.coalesce("level", F.lit(-1)).alias("level"))


def format_chats(conversations: DataFrame, tools: dict[str, dict[str, str]] = TOOLS) -> DataFrame:
    """One row per message: conv_id, turn, role, at_turn, at_part, at_level, at_idx, message,
    n_calls, n_linked, n_invalid, orphan.

    Sorting a conversation by the four ``at_`` columns, then turn, gives the topological order.
    ``message`` is canonical JSON with content and role (null where they are null), with
    tool_calls (arguments, id, level, linked, name, valid) or tool_call_id, and whatever other
    members the text's object has; numbers are written as Spark's variants write them. A call is linked with
    the first later result of its id, a result with the last earlier call; a result without one
    is an orphan at its own turn. Text that is not such JSON is content as it stands, and
    so is all text of rows without a conv_id or turn. Rows that
    repeat are messages of their own, with the same links. Other columns are not read.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    looks = F.coalesce(F.col("text").rlike(r"^\s*\{"), F.lit(False)) & F.contains("text", F.lit("tool_call")) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    rows = rows.withColumn("json", F.when(looks, F.try_parse_json("text")))
    rows = rows.withColumn("calls", F.when(F.col("role") == "assistant", F.try_variant_get("json", "$.tool_calls", "array<variant>")))
    rows = rows.withColumn("answers", F.when((F.col("role") == "tool"), _text_of(F.col("json"), "$.tool_call_id")))
    plain = rows.where("calls is null and answers is null").select(
        "conv_id", "turn", "role", F.col("turn").alias("at_turn"), *[F.lit(0).alias(f"at_{x}") for x in ("part", "level", "idx")],
        F.concat(F.lit('{"content":'), _quoted(F.col("text")), F.lit(',"role":'), _quoted(F.col("role")), F.lit("}")).alias("message"),
        *[F.lit(0).cast("long").alias(f"n_{x}") for x in ("calls", "linked", "invalid")], F.lit(False).alias("orphan"),
    )

    one = F.col("c")
    raw = F.coalesce(F.try_parse_json(_text_of(one, "$.function.arguments")), F.try_variant_get(one, "$.function.arguments", "variant"), F.try_variant_get(one, "$.arguments", "variant"))
    name = F.coalesce(_text_of(one, "$.function.name"), _text_of(one, "$.name"))
    said = rows.where("calls is not null").select("conv_id", "turn", F.to_json("json").alias("said"), _json_of(F.col("json"), "$.content").alias("content"), _further(F.col("json"), "content", "tool_calls").alias("further"), "calls")
    calls = (
        said.select("conv_id", "turn", "said", F.posexplode("calls").alias("idx", "c"))
        .select("conv_id", "turn", "said", "idx", _text_of(one, "$.id").alias("call_id"), name.alias("name"), raw.alias("raw"))
        .select("conv_id", "turn", "said", "idx", "call_id", "name", F.to_json("raw").alias("arguments"), _valid(F.col("name"), F.col("raw"), tools).alias("valid"))
        .withColumn("needs", F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit(_REFERENCE), F.lit(1)))
    )
    calls = durable(calls.distinct())
    results = durable(rows.where("answers is not null").select("conv_id", "turn", F.col("answers").alias("call_id"), _json_of(F.col("json"), "$.content").alias("content"), _further(F.col("json"), "content", "tool_call_id").alias("further")))
    late = results.select("conv_id", "call_id", F.col("turn").alias("result_turn")).distinct()
    linked = calls.join(late, ["conv_id", "call_id"]).where("result_turn > turn").groupBy("conv_id", "turn", "said", "idx").agg(F.min("result_turn").alias("result_turn"))
    levels = _levels(calls)
    known = durable(calls.join(linked, ["conv_id", "turn", "said", "idx"], "left").join(levels, ["conv_id", "turn", "idx"], "left"))

    item = F.concat(
        F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"id":'), _quoted(F.col("call_id")), F.lit(',"level":'), F.col("level").cast("string"),
        F.lit(',"linked":'), F.col("result_turn").isNotNull().cast("string"), F.lit(',"name":'), _quoted(F.col("name")), F.lit(',"valid":'), F.col("valid").cast("string"), F.lit("}"),
    )
    listed = known.groupBy("conv_id", "turn", "said").agg(
        F.array_sort(F.collect_list(F.struct("level", "idx", item.alias("item")))).alias("items"),
        F.count("*").alias("n_calls"), F.count("result_turn").alias("n_linked"), F.count_if(~F.col("valid")).alias("n_invalid"),
    )
    items = F.array_join(F.transform("items", lambda x: x["item"]), ",")
    asking = (
        said.select("conv_id", "turn", "said", "content", "further")
        .join(listed, ["conv_id", "turn", "said"], "left")
        .select(
            "conv_id", "turn", F.lit("assistant").alias("role"), F.col("turn").alias("at_turn"), *[F.lit(0).alias(f"at_{x}") for x in ("part", "level", "idx")],
            _object(F.col("further"), content=F.col("content"), role=F.lit('"assistant"'), tool_calls=F.concat(F.lit("["), F.coalesce(items, F.lit("")), F.lit("]"))).alias("message"),
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_calls", "n_linked", "n_invalid")], F.lit(False).alias("orphan"),
        )
    )
    from_call = known.select("conv_id", "call_id", F.col("turn").alias("call_turn"), "level", "idx")
    places = (
        results.select("conv_id", "turn", "call_id").distinct().join(from_call, ["conv_id", "call_id"]).where("call_turn < turn")
        .groupBy("conv_id", "turn", "call_id").agg(F.max(F.struct("call_turn", "level", "idx")).alias("p"))
    )
    answers = results.join(places, ["conv_id", "turn", "call_id"], "left").select(
        "conv_id", "turn", F.lit("tool").alias("role"), F.coalesce("p.call_turn", "turn").alias("at_turn"), F.when(F.col("p").isNotNull(), 1).otherwise(0).alias("at_part"),
        F.coalesce("p.level", F.lit(0)).alias("at_level"), F.coalesce("p.idx", F.lit(0)).alias("at_idx"),
        _object(F.col("further"), content=F.col("content"), role=F.lit('"tool"'), tool_call_id=_quoted(F.col("call_id"))).alias("message"),
        *[F.lit(0).cast("long").alias(f"n_{x}") for x in ("calls", "linked", "invalid")], F.col("p").isNull().alias("orphan"),
    )
    return plain.unionByName(asking).unionByName(answers)


#: For conversations without tool calls, as the test tables are.
CHAT_SQL = """
SELECT conv_id, turn, role, turn AS at_turn, CAST(0 AS INTEGER) AS at_part, CAST(0 AS INTEGER) AS at_level, CAST(0 AS INTEGER) AS at_idx,
       '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS message,
       CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_invalid, false AS orphan
FROM conversations
"""
