"""Chat formatting: tool calls linked to their results, in SQL functions only.

Messages are rows ``(conv_id, turn, role, text)``. An assistant's text may be
JSON with ``tool_calls`` (each with ``id``, ``name``, ``arguments`` and, where a
call needs others' results, ``after``: their ids); a tool's text is JSON with
``tool_call_id`` and ``content``. Calls and results meet in a hash join on
conversation and identifier. Calls are ordered topologically: chains of calls
that need one other each are shortened by pointer jumping, then Kahn's rounds
settle calls of several needs once these are settled. So a chain costs as many
joins as its length has binary digits. Arguments are checked against the schema of
the tool's name, and everything is written as canonical JSON: keys sorted, no
spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.durable import Scratch, cut, discard

_CALLS = "struct<tool_calls: array<struct<id: string, name: string, arguments: string, after: array<string>>>>"
_RESULT = "struct<tool_call_id: string, content: string>"
#: Types that a schema may ask for, and what Spark calls such a value.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL.*|DOUBLE", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def canonical(text: Column) -> Column:
    """JSON with sorted keys and without spaces; null where the text isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def _errors(schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call's arguments: of the first fault in the order of the schema, else null.

    ``schemas``: tool name -> field -> (type, whether it is required).
    """
    parsed = F.try_parse_json("arguments")
    out = F.lit("unknown tool")
    for tool, fields in schemas.items():
        fault = F.when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), "arguments are not an object")
        for name, (kind, required) in fields.items():
            value = F.try_variant_get(parsed, f"$['{name}']", "variant")
            is_null = value.isNull() | F.is_variant_null(value)
            if required:
                fault = fault.when(is_null, f"{name} is missing")
            fault = fault.when(~is_null & ~F.schema_of_variant(value).rlike(f"^({TYPES[kind]})$"), f"{name} is not of type {kind}")
        out = F.when(F.col("name") == tool, fault.otherwise(F.lit(None))).otherwise(out)
    return out


def _levels(calls: DataFrame) -> DataFrame:
    """``(conv_id, id, level)`` of ``calls (conv_id, id, after)``: 0 for calls that need none, else one more than the highest they need; calls on or behind a cycle have no row."""
    key = ["conv_id", "id"]
    with Scratch() as s:
        needs = cut(calls.select(*key, F.size("after").alias("n"), F.explode("after").alias("need")))
        one = _jumped(needs.where("n = 1").select(*key, F.col("need").alias("root"), F.lit(1).alias("far")))
        s.keep(one)
        shorter = one.select("conv_id", F.col("id").alias("need"), "root", "far")
        waiting = needs.where("n > 1").join(shorter, ["conv_id", "need"], "left")
        waiting = cut(waiting.select(*key, F.coalesce("root", "need").alias("root"), F.coalesce("far", F.lit(0)).alias("far")))
        known = s.keep(cut(calls.where(F.size("after") == 0).select(*key, F.lit(0).alias("level"))))
        fresh = known
        while not waiting.isEmpty():
            met = waiting.join(known.select("conv_id", F.col("id").alias("root"), "level"), ["conv_id", "root"], "left").groupBy(*key)
            met = met.agg(F.count("*").alias("asked"), F.count("level").alias("met"), F.max(F.col("level") + F.col("far") + 1).alias("level"))
            fresh = cut(met.where("asked = met").select(*key, "level"))
            if fresh.isEmpty():
                break
            with Scratch() as t:
                grown, left = t.keep(cut(known.union(fresh))), t.keep(cut(waiting.join(fresh, key, "left_anti")))
            discard(known, fresh, waiting)
            known, waiting = grown, left
        s.keep(known)
    behind = one.join(known.select("conv_id", F.col("id").alias("root"), F.col("level").alias("of_root")), ["conv_id", "root"])
    return known.union(behind.select(*key, F.col("of_root") + F.col("far")))


def _jumped(one: DataFrame) -> DataFrame:
    """``(conv_id, id, root, far)`` with the root at the chain's end instead of the next call, and how far it is.

    Each round doubles the reach. What still moves when the reach is over the
    number of rows is on or behind a cycle; its root has no level ever.
    """
    one = cut(one)
    reach, most = 1, one.count()
    while reach <= most:
        onward = one.select("conv_id", F.col("id").alias("root"), F.col("root").alias("next"), F.col("far").alias("more"))
        moved = cut(one.join(onward, ["conv_id", "root"], "left"))
        ended = moved.where("next IS NOT NULL").isEmpty()
        after = one if ended else cut(moved.select("conv_id", "id", F.coalesce("next", "root").alias("root"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")))
        discard(moved)
        if ended:
            break
        discard(one)
        one, reach = after, 2 * reach
    return one


def link_calls(messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """A row for each call or lone result of ``messages``.

    Columns: ``conv_id``, ``call_id``, ``name``, ``call_turn``, ``result_turn``,
    ``level``, ``status`` (``linked``, ``no result``, ``no call``), ``error``
    (null where the call is valid) and ``json`` (canonical, of call and result
    together). Ordering a conversation by (level, call_turn, call_id) is a
    topological order; calls on a cycle have a null level.

    Of calls with one identifier the first by turn counts, of results the first
    after it or at it; ties by text. Needed identifiers that no call of the
    conversation has are an error, and don't hold the call back. Texts that
    are null, empty or not JSON of this form hold no calls; rows with a null
    conv_id or identifier take no part; repeated rows count once; other columns
    are ignored; an empty table gives no rows. Texts are taken whole, however
    long, and a conversation is never gathered into one row.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").where("conv_id IS NOT NULL")
    said = rows.where("role = 'assistant'").select("conv_id", "turn", F.explode(F.from_json("text", _CALLS)["tool_calls"]).alias("c"))
    said = said.select("conv_id", "turn", F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.array_compact(F.coalesce("c.after", F.array())).alias("after"))
    calls = said.where("id IS NOT NULL").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"))
    calls = cut(calls.select("conv_id", "id", "c.*"))
    got = rows.where("role = 'tool'").select("conv_id", "turn", F.from_json("text", _RESULT).alias("r"))
    got = got.select("conv_id", F.col("turn").alias("result_turn"), F.col("r.tool_call_id").alias("id"), F.col("r.content").alias("content")).where("id IS NOT NULL")

    key = ["conv_id", "id"]
    asked = calls.select("conv_id", "id", F.explode("after").alias("need")).distinct()
    met = asked.join(calls.select("conv_id", F.col("id").alias("need")), ["conv_id", "need"], "left_semi")
    unmet = asked.join(met, ["conv_id", "id", "need"], "left_anti").groupBy(*key).agg(F.min("need").alias("unmet"))
    real = met.groupBy(*key).agg(F.collect_set("need").alias("after"))  # one call's own list
    plain = calls.select("conv_id", "id").join(real, key, "left").withColumn("after", F.coalesce("after", F.array().cast("array<string>")))
    levels = _levels(cut(plain))

    paired = calls.hint("shuffle_hash").join(got.withColumnRenamed("id", "_id").withColumnRenamed("conv_id", "_conv"), (F.col("conv_id") == F.col("_conv")) & (F.col("id") == F.col("_id")), "full_outer")
    paired = paired.select(F.coalesce("conv_id", "_conv").alias("conv_id"), F.coalesce("id", "_id").alias("id"), "turn", "name", "arguments", "after", "result_turn", "content")
    late = F.when(F.col("result_turn") >= F.coalesce("turn", "result_turn"), F.struct("result_turn", "content"))
    first = paired.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"), F.min(late).alias("r"))
    out = first.select("conv_id", "id", "c.*", "r.*").join(levels, key, "left").join(unmet, key, "left")
    fault = F.coalesce(_errors(schemas), F.when(F.col("unmet").isNotNull(), F.concat(F.lit("needs unknown call "), "unmet")), F.when(F.col("level").isNull(), "is on or behind a cycle"))
    whole = F.concat(
        F.lit('{"after":'), F.coalesce(F.to_json(F.sort_array("after")), F.lit("[]")),
        F.lit(',"arguments":'), F.coalesce(canonical(F.col("arguments")), _quoted("arguments")),
        F.lit(',"id":'), _quoted("id"), F.lit(',"name":'), _quoted("name"), F.lit(',"result":'), _quoted("content"), F.lit("}"),
    )
    has_call = F.col("turn").isNotNull()
    status = F.when(~has_call, "no call").when(F.col("result_turn").isNull(), "no result").otherwise("linked")
    return out.select("conv_id", F.col("id").alias("call_id"), "name", F.col("turn").alias("call_turn"), "result_turn", "level", status.alias("status"), F.when(has_call, fault).alias("error"), whole.alias("json"))


def _quoted(name: str) -> Column:
    """A JSON string, or ``null``."""
    inner = F.to_json(F.struct(F.col(name).alias("x")))  # {"x":"..."}, or {} for null
    return F.when(F.col(name).isNull(), "null").otherwise(F.substring(inner, F.lit(6), F.length(inner) - 6))


def from_turns(conversations: DataFrame) -> DataFrame:
    """Plain conversations as messages with tool calls: a user's turn calls ``reply``, the assistant's next turn is its result.

    The call of turn t is ``c<t>``; calls after the first turn need ``c0``.
    """
    call = F.struct(
        F.concat(F.lit("c"), F.col("turn").cast("string")).alias("id"), F.lit("reply").alias("name"), F.struct("turn", F.col("text").alias("prompt")).alias("arguments"),
        F.when(F.col("turn") > 0, F.array(F.lit("c0"))).alias("after"),
    )
    result = F.struct(F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("tool_call_id"), F.col("text").alias("content"))
    role = F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    text = F.when(F.col("role") == "user", F.to_json(F.struct(F.array(call).alias("tool_calls")))).when(F.col("role") == "assistant", F.to_json(result)).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
