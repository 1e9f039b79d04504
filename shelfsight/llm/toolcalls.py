"""Chat formatting with linked tool calls, in DataFrame functions only.

Calls and results are hash-joined by identifier, arguments are checked against the tools'
schemas, messages are put in an order in which nothing precedes what it depends on, and each is
serialised as canonical JSON: compact, keys sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfsight.llm.common import own_columns, saved

SPAN = 1024  # turns numbered by one task


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no spaces; null where it does not parse."""
    return F.to_json(F.try_parse_json(text))


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with `error`: null, or the least of the faults found in their arguments.

    schemas has (name, key, type, required), type as in `schema_of_variant` (STRING, BIGINT,
    BOOLEAN, ...) of top-level keys. Faults: arguments that are no JSON object, an unknown tool, an unknown key, a
    value of another type, a required key that is missing.
    """
    tools = own_columns(schemas, ["name", "key", "type", "required"]).groupBy("name").agg(F.collect_list(F.struct("key", "type", "required")).alias("rules"))
    parsed = F.when(F.col("arguments").rlike(r"^\s*\{"), F.try_parse_json("arguments"))
    raw = calls.withColumn("_v", parsed).join(tools, "name", "left")
    # Keys of the object with the type of each value.
    keys = F.json_object_keys(F.to_json("_v"))
    given = F.filter("rules", lambda r: F.array_contains(keys, r["key"]))
    unknown = F.array_except(keys, F.transform("rules", lambda r: r["key"]))
    missing = F.filter("rules", lambda r: r["required"] & ~F.array_contains(keys, r["key"]))
    shape = F.regexp_replace(F.schema_of_variant("_v"), r"^OBJECT<|>$", "")
    types = F.transform(F.filter(given, lambda r: ~F.concat(F.lit(", "), shape, F.lit(",")).contains(
        F.concat(F.lit(", "), r["key"], F.lit(": "), r["type"], F.lit(",")))), lambda r: r["key"])
    error = (
        F.when(F.col("_v").isNull(), "not an object").when(F.col("rules").isNull(), "unknown tool")
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_min(F.transform(missing, lambda r: r["key"]))))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown key "), F.array_min(unknown)))
        .when(F.size(types) > 0, F.concat(F.lit("wrong type "), F.array_min(types))))
    return raw.withColumn("error", error).drop("_v", "rules")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, node, level): 0 without dependencies, else one more than the highest of them.

    edges has (conv_id, node, needs); needs that no node answers are ignored. Nodes in or behind a
    cycle get level null. One join for each level: rounds are the longest chain.
    """
    waits = edges.join(nodes.select("conv_id", F.col("node").alias("needs")), ["conv_id", "needs"], "left_semi").distinct()
    waits = saved(waits)
    done = saved(nodes.join(waits, ["conv_id", "node"], "left_anti").select("conv_id", "node", F.lit(0).alias("level")))
    level = 0
    while not waits.isEmpty():
        level += 1
        ready = done.where(F.col("level") == level - 1).select("conv_id", F.col("node").alias("needs"))
        rest = saved(waits.join(ready, ["conv_id", "needs"], "left_anti"))
        freed = waits.select("conv_id", "node").distinct().join(rest, ["conv_id", "node"], "left_anti")
        freed = saved(freed.withColumn("level", F.lit(level)))
        if freed.isEmpty():
            return done.unionByName(rest.select("conv_id", "node").distinct().withColumn("level", F.lit(None).cast("int")))
        done, waits = saved(done.unionByName(freed)), rest
    return done


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame, needs: DataFrame | None = None, messages: DataFrame | None = None) -> DataFrame:
    """(conv_id, position, kind, call_id, name, status, message) for every call, result and plain message.

    calls: (conv_id, call_id, turn, name, arguments); results: (conv_id, call_id, turn, content);
    needs: (conv_id, call_id, needs), calls that wait for other calls' results; messages: (conv_id, turn,
    role, text), turns of any role that carry no call: they depend on nothing, stand by turn among the
    rows without dependencies, and have kind `message`, status `ok` and no name. A call's status is
    `ok`, `pending` (no result) or its arguments' fault; a result's is `ok`, `orphan` (no call) or
    `repeated` (not the first for its call, by turn and content). Identifiers are unique within a
    conversation; of calls that repeat one, the first by turn and arguments counts and the others
    are `repeated`. Rows with a null conversation or identifier are orphans at their turn. position
    counts from 0 in each conversation along dependencies, then turns; rows on a cycle come last
    with status `cycle`. Empty tables give no rows. Extra columns are not read.
    """
    ok = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    own = own_columns(calls, ["conv_id", "call_id", "turn", "name", "arguments"])
    back = own_columns(results, ["conv_id", "call_id", "turn", "content"])
    first = W.partitionBy("conv_id", "call_id").orderBy("turn", "arguments", "name")
    own = checked(own.withColumn("nth", F.when(ok, F.row_number().over(first)).otherwise(0)), schemas)
    back = back.withColumn("nth", F.when(ok, F.row_number().over(W.partitionBy("conv_id", "call_id").orderBy("turn", "content"))).otherwise(0))
    answered = back.where("nth = 1").select("conv_id", "call_id", F.lit(True).alias("answered"))
    known = own.where("nth = 1").select("conv_id", "call_id", F.col("name").alias("tool"), F.lit(True).alias("called"))
    own = own.join(answered, ["conv_id", "call_id"], "left").select(
        "conv_id", F.lit("call").alias("kind"), "call_id", "turn", "name",
        F.when(F.col("nth") == 0, "orphan").when(F.col("nth") > 1, "repeated").when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("answered"), "ok").otherwise("pending").alias("status"),
        F.coalesce(canonical_json(F.col("arguments")), F.to_json(F.struct(F.col("arguments").alias("raw")))).alias("body"), "nth")
    back = back.join(known, ["conv_id", "call_id"], "left").select(
        "conv_id", F.lit("result").alias("kind"), "call_id", "turn", F.col("tool").alias("name"),
        F.when(F.col("called").isNull(), "orphan").when(F.col("nth") > 1, "repeated").otherwise("ok").alias("status"),
        F.to_json(F.struct(F.coalesce("content", F.lit("")).alias("content"))).alias("body"), "nth")
    rows = own.unionByName(back)
    if messages is not None:
        text = F.struct(F.coalesce("text", F.lit("")).alias("content"), "role")
        rows = rows.unionByName(own_columns(messages, ["conv_id", "turn", "role", "text"]).select(
            "conv_id", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), "turn",
            F.lit(None).cast("string").alias("name"), F.lit("ok").alias("status"), F.to_json(text).alias("body"), F.lit(0).alias("nth")))
    rows = saved(rows)
    # A result waits for its call; a call waits for the results it needs.
    nodes = rows.where("nth = 1").select("conv_id", F.concat_ws(":", "kind", "call_id").alias("node")).distinct()
    edges = back.where("nth = 1").select("conv_id", F.concat(F.lit("result:"), "call_id").alias("node"), F.concat(F.lit("call:"), "call_id").alias("needs"))
    if needs is not None:
        edges = edges.unionByName(own_columns(needs, ["conv_id", "call_id", "needs"]).select(
            "conv_id", F.concat(F.lit("call:"), "call_id").alias("node"), F.concat(F.lit("result:"), "needs").alias("needs")))
    level = levels(saved(nodes), edges)
    placed = rows.withColumn("node", F.concat_ws(":", "kind", "call_id")).join(level, ["conv_id", "node"], "left")
    cycle = (F.col("nth") == 1) & F.col("level").isNull()
    placed = placed.withColumn("status", F.when(cycle, "cycle").otherwise(F.col("status"))) \
        .withColumn("rank", F.when(cycle, F.lit(2147483647)).when(F.col("kind") == "message", 0).otherwise(F.coalesce("level", F.lit(1))))
    message = F.to_json(F.struct(F.col("call_id"), F.col("kind"), F.col("name")))
    body = F.concat(F.lit('{"body":'), "body", F.lit(","), F.substring(message, 2, F.length(message)))
    placed = placed.select("conv_id", "rank", "turn", "kind", "call_id", "name", "status", body.alias("message"))
    return positioned(placed)


def positioned(rows: DataFrame) -> DataFrame:
    """rows with `position`, numbered along (rank, turn) without gathering a conversation in one task."""
    rows = rows.withColumn("part", F.floor(F.coalesce("turn", F.lit(-1)) / SPAN))
    sizes = rows.groupBy("conv_id", "rank", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("conv_id").orderBy("rank", "part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col("conv_id").alias("_c"), F.col("rank").alias("_r"), F.col("part").alias("_p"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = W.partitionBy("conv_id", "rank", "part").orderBy("turn", "kind", "call_id", "message")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("rank") == F.col("_r")) & (F.col("part") == F.col("_p"))
    return rows.join(offsets, same).select(
        "conv_id", (F.row_number().over(order) - 1 + F.col("offset")).cast("long").alias("position"),
        "kind", "call_id", "name", "status", "message")
