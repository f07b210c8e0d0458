"""Chat formatting: tool calls linked to their results, ordered, validated and serialised."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseyard.session import stored

from .shared import spare_names, without

OUTPUT = ("kind", "status", "at_turn", "level", "step", "errors", "json")


@dataclass(frozen=True)
class Parameter:
    """``type`` is one of string, integer, number, boolean, object, array, null."""

    name: str
    type: str
    required: bool = True


@dataclass(frozen=True)
class ToolSchema:
    tool: str
    parameters: tuple[Parameter, ...]


def _same(conv: str, call: str, other_conv: str, other_call: str) -> Column:
    return F.col(conv).eqNullSafe(F.col(other_conv)) & (F.col(call) == F.col(other_call))


def _chains(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, turn, reach, next, root, level, joint): each call followed back, while it waits for one call
    alone, to its ``root``: a call that waits for none, or for several (a joint).

    Every round doubles the distance looked back, so a chain of n calls takes log2(n) joins; calls that have reached
    their root take no further part. What keeps a ``next`` is on a cycle or behind one.
    """
    needs = edges.groupBy(F.col("conv_id").alias("e_conv"), F.col("call_id").alias("e_call")).agg(
        F.count(F.lit(1)).alias("needs"), F.min("after").alias("only")
    )
    alone = F.col("needs") == 1
    state = calls.join(needs, _same("conv_id", "call_id", "e_conv", "e_call"), "left").select(
        "conv_id",
        "call_id",
        "turn",
        F.col("turn").alias("reach"),
        F.when(alone, F.col("only")).alias("next"),
        F.when(alone, F.col("only")).otherwise(F.col("call_id")).alias("root"),
        F.when(alone, 1).otherwise(0).cast("long").alias("level"),
        F.coalesce(F.col("needs") > 1, F.lit(False)).alias("joint"),
    )
    state = stored(state)
    waiting = None
    while True:
        left = state.filter("next is not null").count()
        if not left or left == waiting:
            return state
        waiting = left
        ahead = state.select(*[F.col(c).alias(f"p_{c}") for c in state.columns])
        moved = state.filter("next is not null").join(ahead, _same("conv_id", "next", "p_conv_id", "p_call_id")).select(
            "conv_id",
            "call_id",
            "turn",
            F.greatest("reach", "p_reach").alias("reach"),
            F.col("p_next").alias("next"),
            F.col("p_root").alias("root"),
            (F.col("level") + F.col("p_level")).alias("level"),
            "joint",
        )
        state = stored(state.filter("next is null").unionByName(moved))


def _joints(state: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, reach) of the joints, by rounds of join and max; none for those on or behind a cycle.

    A leg of a joint leads along one chain to a root. A round finishes the joints whose legs all lead to calls
    that are finished; there are as many rounds as joints on the longest path.
    """
    joints = state.filter("joint").select(F.col("conv_id").alias("j_conv"), F.col("call_id").alias("j_call"), "turn")
    ends = state.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_call"), "reach", "next", "root", "level")
    roots = state.filter("joint").select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"))
    legs = edges.join(joints, _same("conv_id", "call_id", "j_conv", "j_call")).join(ends, _same("conv_id", "after", "p_conv", "p_call"))
    legs = legs.groupBy("conv_id", "call_id", "turn", "root").agg(
        F.max("level").alias("level"), F.max("reach").alias("reach"), F.max(F.col("next").isNotNull()).alias("lost")
    )
    legs = legs.join(roots, _same("conv_id", "root", "r_conv", "r_call"), "left")
    waits = F.when(F.col("lost") | F.col("r_call").isNotNull(), F.col("root"))
    legs = stored(legs.select("conv_id", "call_id", "turn", (F.col("level") + 1).alias("level"), F.greatest("turn", "reach").alias("reach"), waits.alias("root")))
    finished = legs.select("conv_id", "call_id", "level", "reach").limit(0)
    while True:
        whole = legs.groupBy("conv_id", "call_id").agg(F.max("level").alias("level"), F.max("reach").alias("reach"), F.count("root").alias("open"))
        new = stored(whole.filter("open = 0").drop("open"))
        if new.isEmpty():
            return finished
        finished = finished.unionByName(new)
        ready = new.select(F.col("conv_id").alias("n_conv"), F.col("call_id").alias("n_call"), F.col("level").alias("n_level"), F.col("reach").alias("n_reach"))
        rest = legs.join(ready, _same("conv_id", "call_id", "n_conv", "n_call"), "left_anti")
        rest = rest.join(ready, _same("conv_id", "root", "n_conv", "n_call"), "left")
        legs = stored(
            rest.select(
                "conv_id",
                "call_id",
                "turn",
                (F.col("level") + F.coalesce("n_level", F.lit(0))).alias("level"),
                F.greatest("reach", "n_reach").alias("reach"),
                F.when(F.col("n_call").isNull(), F.col("root")).alias("root"),
            )
        )


def call_levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, reach) from calls (conv_id, call_id, turn), one row each, and edges (conv_id, call_id, after).

    ``level`` is the number of calls on the longest path a call waits for, ``reach`` the latest turn among
    it and all these. Sorting by (reach, level) puts every call behind those it needs. Edges to missing
    calls and repeated edges count for nothing. Calls on a cycle, or behind one, get null for both.

    Stretches in which a call waits for one other alone are followed by pointer doubling; calls that wait
    for several are then finished by rounds of join and max over these stretches.
    """
    known = calls.select(F.col("conv_id").alias("k_conv"), F.col("call_id").alias("k_call"))
    edges = edges.join(known, _same("conv_id", "after", "k_conv", "k_call")).select("conv_id", "call_id", "after").distinct()
    edges = stored(edges)
    state = _chains(calls, edges)
    cyclic = F.col("next").isNotNull()
    ends = state.filter("not joint and call_id = root").select("conv_id", "call_id", "level", "reach")
    if not state.filter("joint").isEmpty():
        ends = ends.unionByName(_joints(state, edges))
    ends = ends.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), F.col("level").alias("r_level"), F.col("reach").alias("r_reach"))
    done = state.join(ends, _same("conv_id", "root", "r_conv", "r_call"), "left")
    free = ~cyclic & F.col("r_call").isNotNull()
    return done.select(
        "conv_id",
        "call_id",
        F.when(free, F.col("level") + F.col("r_level")).alias("level"),
        F.when(free, F.greatest("reach", "r_reach")).alias("reach"),
    )


def _json_type(kind: Column) -> Column:
    return (
        F.when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .when((kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
        .otherwise("number")
    )


def argument_errors(arguments: str, schema: Column) -> Column:
    """Sorted errors of the variant column ``arguments`` against ``array<struct<name,type,required>>`` (null: unknown tool)."""
    is_object = F.startswith(F.schema_of_variant(F.col(arguments)), F.lit("OBJECT"))
    kinds = F.when(
        is_object,
        F.transform_values(F.expr(f"try_variant_get({arguments}, '$', 'map<string,variant>')"), lambda _, v: _json_type(F.schema_of_variant(v))),
    )
    empty = F.create_map().cast("map<string,string>")
    kinds = F.coalesce(kinds, empty)

    def wrong(p: Column) -> Column:
        given = F.try_element_at(kinds, p["name"])
        fits = (given == p["type"]) | ((p["type"] == "number") & (given == "integer"))
        return F.when(given.isNull() & p["required"], F.concat(F.lit("missing: "), p["name"])).when(
            given.isNotNull() & ~fits, F.concat(F.lit("type: "), p["name"])
        )

    declared = F.transform(schema, lambda p: p["name"])
    extra = F.transform(F.array_except(F.map_keys(kinds), declared), lambda k: F.concat(F.lit("unknown: "), k))
    checked = F.array_sort(F.concat(F.array_compact(F.transform(schema, wrong)), extra))
    no_object = F.coalesce(~is_object, F.lit(True))
    return (
        F.when(schema.isNull(), F.array(F.lit("unknown tool")))
        .when(no_object, F.array(F.lit("arguments are not an object")))
        .otherwise(checked)
    )


def format_chat(messages: DataFrame, schemas: Sequence[ToolSchema]) -> DataFrame:
    """Every message with its link, its place, its errors and its canonical JSON.

    ``messages``: conv_id, turn, role, text, call_id, tool, arguments (JSON text), after (the id, or an array of
    the ids, of calls that a call waits for). A row with a tool is a call, another row with a call_id is a result, the rest are plain messages.

    * ``status``: of a call ``answered``, ``pending``, ``duplicate`` (its id was called at an earlier
      turn) or ``cyclic``; of a result ``linked`` or ``orphan``; of a message ``plain``. Ids count within
      a conversation; null conversations are one conversation. Equal rows get equal results.
    * Sorting a conversation by ``at_turn, level, turn, step`` gives an order in which calls follow the
      calls they need and results follow their calls; logs in order stay as they are. Sort on output, so
      that a conversation with a third of all rows need not pass through one task.
    * ``errors``: arguments against the tool's schema, null for other rows. Invalid JSON and null
      arguments are no object.
    * ``json``: keys in alphabetical order, null fields left out, no white space; arguments in canonical
      form if they are valid JSON, else as text.

    Links come from one grouping by (conversation, call id) and one join back, whose right side is a
    table with one row per id. Input columns named like an output are replaced.
    """
    messages = without(messages, OUTPUT)
    arguments, link, tool = spare_names(messages, "parsed_arguments", "link", "tool_schema")
    kind = F.when(F.col("tool").isNotNull() & F.col("call_id").isNotNull(), "call").when(F.col("call_id").isNotNull(), "result").otherwise("message")
    rows = messages.withColumn("kind", kind)
    calling = F.col("kind") == "call"
    after = F.col("after") if messages.schema["after"].dataType.typeName() == "array" else F.array("after")
    links = rows.filter("call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.when(calling, F.struct("turn", after.alias("after")))).alias("first"),
        F.count(F.when(calling, 1)).alias("calls"),
        F.count(F.when(~calling, 1)).alias("results"),
    )
    links = stored(links.select("conv_id", "call_id", "calls", "results", F.col("first.turn").alias("turn"), F.col("first.after").alias("after")))
    called = links.filter("calls > 0")
    levels = call_levels(called.select("conv_id", "call_id", "turn"), called.select("conv_id", "call_id", F.explode("after").alias("after")))
    levels = levels.select(F.col("conv_id").alias("v_conv"), F.col("call_id").alias("v_call"), "level", "reach")
    links = links.join(levels, _same("conv_id", "call_id", "v_conv", "v_call"), "left")
    links = stored(links.select(F.struct("conv_id", "call_id", "calls", "results", F.col("turn").alias("call_turn"), "level", "reach").alias(link)))
    parameters = "array<struct<name:string,type:string,required:boolean>>"
    known = [((s.tool, [(p.name, p.type, p.required) for p in s.parameters]),) for s in schemas]
    tools = messages.sparkSession.createDataFrame(known, f"{tool} struct<tool:string,parameters:{parameters}>")

    joined = rows.join(links, _same("conv_id", "call_id", f"{link}.conv_id", f"{link}.call_id"), "left")
    joined = joined.join(F.broadcast(tools), F.col("tool") == F.col(f"{tool}.tool"), "left")  # as many rows as schemas given
    joined = joined.withColumn(arguments, F.try_parse_json("arguments"))
    link = F.col(link)
    later = calling & ~F.col("turn").eqNullSafe(link["call_turn"])
    status = (
        F.when(F.col("kind") == "message", "plain")
        .when(~calling, F.when(link["calls"] > 0, "linked").otherwise("orphan"))
        .when(later, "duplicate")
        .when(link["level"].isNull(), "cyclic")
        .when(link["results"] > 0, "answered")
        .otherwise("pending")
    )
    moved = F.coalesce(F.when(later, F.greatest(F.col("turn"), link["reach"])).otherwise(link["reach"]), F.col("turn"))
    plain = F.to_json(F.struct(F.col("call_id"), F.col("role"), F.col("text"), F.col("tool")))
    body = F.substring(plain, F.lit(2), F.length(plain))
    with_arguments = F.concat(F.lit('{"arguments":'), F.to_json(arguments), F.when(F.length(body) > 1, F.lit(",")).otherwise(F.lit("")), body)
    as_text = F.to_json(F.struct("arguments", "call_id", "role", "text", "tool"))
    done = joined.withColumns(
        {
            "status": status,
            "at_turn": moved,
            "level": link["level"],
            "step": F.when(F.col("kind") == "result", 1).otherwise(0),
            "errors": F.when(calling, argument_errors(arguments, F.col(f"{tool}.parameters"))),
            "json": F.when(F.col(arguments).isNotNull(), with_arguments).otherwise(as_text),
        }
    )
    return done.select(*[f"`{c}`" for c in messages.columns], *OUTPUT)


#: How the table of conversations is read: a user turn calls for an answer, an assistant turn gives it.
ANSWER = ToolSchema("answer", (Parameter("text", "string"), Parameter("turn", "integer")))


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as messages with calls and results.

    A user turn is a call of ``answer``; an assistant turn is the result for the turn before it; other roles
    are plain messages. A call waits for the user turn two before it; the third question waits for the first
    instead, like the second, and the fourth for the second and the third.

    Logs have faults, and so have these calls; the length of a row's own text says which: an undeclared
    tool, a turn given as text, a missing text, arguments that are no JSON, an undeclared argument, an id that was
    used two turns before, or waiting for the next question too, which waits for this one.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    call = lambda turn: F.concat(F.lit("c"), conv, F.lit("-"), turn.cast("string"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    turn, size = F.col("turn"), F.length("text")
    fault = size % 16
    before = (
        F.when(turn.isin(4, 5), F.array(call(turn - 4)))
        .when(turn.isin(6, 7), F.array(call(turn - 4), call(turn - 2)))
        .otherwise(F.array(call(turn - 2)))
    )
    arguments = (
        F.when(fault == 1, F.to_json(F.struct(turn.cast("string").alias("turn"), "text")))
        .when(fault == 2, F.to_json(F.struct("turn")))
        .when(fault == 3, F.concat(F.lit("turn "), turn.cast("string")))
        .when(fault == 4, F.to_json(F.struct("turn", "text", F.col("role").alias("note"))))
        .otherwise(F.to_json(F.struct("turn", "text")))
    )
    return conversations.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(user, call(F.when(size % 17 == 5, turn - 2).otherwise(turn))).when(assistant, call(turn - 1)).alias("call_id"),
        F.when(user, F.when(fault == 0, "lookup").otherwise(ANSWER.tool)).alias("tool"),
        F.when(user, arguments).alias("arguments"),
        F.when(user, F.when(size % 23 == 4, F.concat(before, F.array(call(turn + 2)))).otherwise(before)).alias("after"),
    )
