"""Chat formatting with tool-call linking.

A message is a row (conv_id, turn, role, text). An assistant's text may be a JSON object
with `content` and `tool_calls`, each with id, name, arguments and, optionally, `after`, the
ids of calls that it builds on; a tool's text is an object with `tool_call_id` and
`content`. Calls and results are hash-joined by conversation and id, calls are ordered by
what they build on, arguments are checked against the tools' schemas, and each message
becomes one line of canonical JSON: keys in order, no blanks, nested objects included.

Only DataFrame and SQL functions are used. Conversations are never collected: messages
stay rows, of which the ones without calls or results need no shuffle, and a call's
siblings are only ever those of one message. `as_calls` derives calls and results from
conversations that have none, by a rule of its own.

Defined results: a text that isn't such an object is content as it is; a null text is
null content; calls without an id or name are invalid and never linked; of calls with
one id in a conversation the first (by turn, then place) is answered, of results with one
id the first answers, and the others are marked `repeated`; results without a call are
`orphan`; of repeated rows only the first takes part; calls that wait for each other have no level and are `cyclic`; ids in `after`
that no call has are ignored; repeated rows get one line each; other columns are ignored;
an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import repeated, words, written

CALLS = "struct<content: string, tool_calls: array<struct<id: string, name: string, arguments: string, after: array<string>>>>"
RESULT = "struct<tool_call_id: string, content: string>"
TOOLS = "name string, parameter string, type string, required boolean"
#: What a value of each type may look like to schema_of_variant.
TYPES = {"string": "STRING", "boolean": "BOOLEAN", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID"}

MESSAGE = ["conv_id", "turn", "role", "text"]


def parsed(messages: DataFrame) -> DataFrame:
    """The message's columns with `calls` (structs of id, name, arguments in canonical JSON, after) and `answers` (an id)."""
    rows = messages.select(*[F.col(f"`{c}`").alias(c) for c in MESSAGE])
    json = F.col("text").rlike(r"^\s*\{")
    rows = rows.withColumn("c", F.when((F.col("role") == "assistant") & json, F.from_json("text", CALLS)))
    rows = rows.withColumn("r", F.when((F.col("role") == "tool") & json, F.from_json("text", RESULT)))
    calls = F.transform("c.tool_calls", lambda x: F.struct(x.id.alias("id"), x["name"].alias("name"), F.to_json(F.try_parse_json(x.arguments)).alias("arguments"), x.after.alias("after")))
    content = F.when(F.size("c.tool_calls") > 0, F.col("c.content")).when(F.isnotnull("r.tool_call_id"), F.col("r.content")).otherwise(F.col("text"))
    return rows.select(*MESSAGE, content.alias("content"), F.when(F.size("c.tool_calls") > 0, calls).alias("calls"), F.col("r.tool_call_id").alias("answers"))


def levels(calls: DataFrame) -> DataFrame:
    """From first calls (conv_id, id, after): conv_id, id, level; none for calls that wait for each other.

    A call that builds on nothing has level 0, any other one more than the highest it builds
    on. Chains of calls with one need each are followed by doubling: in each round a call
    looks as far again as it already does, so a chain of n links takes log n rounds. What is
    left are calls with several needs; there are as many more rounds as lie on the
    longest way through them.
    """
    key = ["conv_id", "id"]
    need = calls.select(*key, F.explode(F.array_distinct("after")).alias("on"))
    need = written(need.join(calls.select("conv_id", F.col("id").alias("on")), ["conv_id", "on"], "left_semi"))
    degree = need.groupBy(*key).agg(F.count("*").alias("needs"), F.min("on").alias("on"))
    chain = written(degree.where("needs = 1").select(*key, F.col("on").alias("to"), F.lit(1).alias("far")))
    left = None
    while True:
        ahead = chain.select("conv_id", F.col("id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        hop = chain.join(ahead, ["conv_id", "to"], "left")
        chain = written(hop.select(*key, F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")))
        waiting = chain.join(chain.select("conv_id", F.col("id").alias("to")), ["conv_id", "to"], "left_semi").count()
        if waiting in (0, left):  # if none has come to an end, all that is left goes round
            break
        left = waiting
    chain = written(chain.join(chain.select("conv_id", F.col("id").alias("to")), ["conv_id", "to"], "left_anti"))

    placed = written(calls.select(*key).join(need, key, "left_anti").withColumn("level", F.lit(0)))
    several = need.join(degree.where("needs > 1").select(*key), key, "left_semi")
    ends = chain.select("conv_id", F.col("id").alias("on"), "to", "far")
    waits = written(several.join(ends, ["conv_id", "on"], "left").select(*key, "on", F.coalesce("to", "on").alias("to"), (1 + F.coalesce("far", F.lit(0))).alias("far")))
    fresh, known = placed, None
    while waits.limit(1).count():
        reached = waits.join(fresh.select("conv_id", F.col("id").alias("to"), "level"), ["conv_id", "to"])
        reached = reached.select(*key, (F.col("level") + F.col("far")).alias("level"))
        known = written(reached if known is None else known.unionByName(reached).groupBy(*key).agg(F.max("level").alias("level")))
        waits = written(waits.join(fresh.select("conv_id", F.col("id").alias("to")), ["conv_id", "to"], "left_anti"))
        ready = known.groupBy(*key).agg(F.max("level").alias("level")).join(waits.select(*key), key, "left_anti")
        fresh = written(ready.join(placed.select(*key), key, "left_anti"))
        if not fresh.limit(1).count():
            break
        placed = placed.unionByName(fresh)
    behind = chain.join(placed.select("conv_id", F.col("id").alias("to"), "level"), ["conv_id", "to"])
    return placed.unionByName(behind.select(*key, (F.col("level") + F.col("far")).cast("int").alias("level")))


def checked(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """calls (name, arguments) with `errors`: what their arguments lack or hold against the tools' schemas."""
    of = tools.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("parameter", F.lit("")), F.struct("type", "required")))).alias("params"))
    rows = calls.join(of, "name", "left").withColumn("given", F.from_json("arguments", "map<string, variant>"))
    kinds = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    rows = rows.withColumn("kinds", kinds)
    missing = "transform(filter(map_keys(params), p -> params[p].required AND NOT array_contains(map_keys(given), p)), p -> concat('missing ', p))"
    unknown = "transform(filter(map_keys(given), p -> NOT array_contains(map_keys(params), p)), p -> concat('unknown ', p))"
    wrong = "transform(filter(map_keys(given), p -> array_contains(map_keys(params), p) AND NOT coalesce(schema_of_variant(given[p]) RLIKE concat('^(', kinds[params[p].type], ')$'), true)), p -> concat('type of ', p))"
    errors = f"""CASE WHEN id IS NULL OR name IS NULL THEN array('no id or name') WHEN params IS NULL THEN array('unknown tool')
        WHEN given IS NULL THEN array('not an object') ELSE array_sort(concat({missing}, {unknown}, {wrong})) END"""
    return rows.withColumn("errors", F.expr(errors)).drop("given", "params", "kinds")


def _line(extra: dict[str, str] | None = None):
    fields = {"content": "content", "role": "role"} | (extra or {})
    return F.to_json(F.struct(*[F.expr(sql).alias(k) for k, sql in sorted(fields.items())]), {"ignoreNullFields": "false"})


def formatted(messages: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """One row for each message: conv_id, turn, role, n_calls, n_linked, n_valid, status, level, line.

    Calls and results are linked without their texts, one row for each distinct message; of
    repeated messages the first takes part and the others are marked. The texts of results
    are shuffled once, by message, to meet what was found.
    """
    spark = messages.sparkSession
    tools = tools if tools is not None else spark.createDataFrame([], TOOLS)
    rows = parsed(messages)
    none = [F.lit(0).cast("long").alias(c) for c in ("n_calls", "n_linked", "n_valid")]
    plain = rows.where("calls IS NULL AND answers IS NULL")
    plain = plain.select("conv_id", "turn", "role", *none, F.lit("plain").alias("status"), F.lit(0).alias("level"), _line().alias("line"))
    key = ["k_conv", "k_turn", "k_none", "k_text"]
    busy = rows.where("calls IS NOT NULL OR answers IS NOT NULL").withColumns({
        "k_conv": F.coalesce("conv_id", F.lit(0)), "k_turn": F.coalesce("turn", F.lit(0)),
        "k_none": F.concat(F.isnull("conv_id").cast("string"), F.isnull("turn").cast("string")), "k_text": F.xxhash64("role", "text"),
    })
    told = F.when(F.isnotnull("calls"), F.col("content"))  # a result's content is read again at the end
    slim = busy.groupBy(*key, "conv_id", "turn", "role").agg(F.count("*").alias("n"), F.first("calls").alias("calls"), F.first("answers").alias("answers"), F.first(told).alias("content"))
    slim = written(slim.withColumn("row", F.monotonically_increasing_id()))
    most = slim.agg(F.max("n")).first()[0]
    if not most:
        return plain

    place = F.struct("turn", "row", "pos").alias("place")
    calls = slim.where("calls IS NOT NULL").select("conv_id", "turn", "row", F.posexplode("calls").alias("pos", "c")).select("conv_id", "row", "pos", place, "c.*")
    first = calls.where("id IS NOT NULL AND name IS NOT NULL").groupBy("conv_id", "id").agg(F.min(F.struct("place", "after")).alias("f"))
    first = written(first.select("conv_id", "id", F.col("f.place").alias("first"), F.col("f.after").alias("after")))
    results = slim.where("answers IS NOT NULL").select("conv_id", F.col("answers").alias("id"), "row", F.struct("turn", "row").alias("at"))
    answer = results.groupBy("conv_id", "id").agg(F.min("at").alias("answer"))
    known = first.drop("after").hint("shuffle_hash").join(answer, ["conv_id", "id"], "left").join(levels(first), ["conv_id", "id"], "left")
    known = written(known.withColumn("here", F.lit(True)))

    calls = checked(calls.join(known, ["conv_id", "id"], "left"), tools)
    status = F.when(~F.coalesce("here", F.lit(False)), "invalid").when(F.col("place") != F.col("first"), "repeated").when(F.isnull("level"), "cyclic").when(F.isnull("answer"), "open").otherwise("linked")
    calls = calls.withColumn("status", status)
    done = F.struct("pos", F.struct("arguments", "errors", "id", F.when(F.col("status") == "linked", F.col("level")).alias("level"), "name", "status").alias("c"))
    calls = calls.groupBy("row").agg(
        F.transform(F.sort_array(F.collect_list(done)), lambda x: x.c).alias("done"),  # the calls of one message
        F.count("*").alias("n_calls"),
        F.count_if(F.col("status") == "linked").alias("n_linked"),
        F.count_if(F.size("errors") == 0).alias("n_valid"),
        F.max("level").alias("level"),
    )
    asked = repeated(slim.where("calls IS NOT NULL").drop("calls").join(calls, "row"), "n", "copy", most)
    once = F.col("copy") == 0
    each = """transform(done, x -> struct(try_parse_json(x.arguments) AS arguments, x.errors AS errors, x.id AS id,
        CASE WHEN copy = 0 THEN x.level END AS level, x.name AS name, CASE WHEN copy = 0 OR x.status = 'invalid' THEN x.status ELSE 'repeated' END AS status))"""
    asked = asked.select("conv_id", "turn", "role", "n_calls", F.when(once, F.col("n_linked")).otherwise(0).cast("long").alias("n_linked"), "n_valid", F.lit("calls").alias("status"), F.coalesce("level", F.lit(-1)).alias("level"), _line({"tool_calls": each}).alias("line"))

    found = slim.where("answers IS NOT NULL").join(known.withColumnRenamed("id", "answers"), ["conv_id", "answers"], "left")
    status = F.when(~F.coalesce("here", F.lit(False)), "orphan").when(F.col("answer") != F.struct("turn", "row"), "repeated").when(F.isnull("level"), "cyclic").otherwise("linked")
    found = found.select(*key, "conv_id", "turn", "role", "answers", "n", status.alias("status"), F.col("level").alias("of"))
    said = busy.where("answers IS NOT NULL").groupBy(*key).agg(F.first("content").alias("content"))
    told = repeated(said.join(found, key), "n", "copy", most)
    told = told.withColumn("status", F.when((F.col("copy") > 0) & (F.col("status") != "orphan"), "repeated").otherwise(F.col("status")))
    told = told.select("conv_id", "turn", "role", *none, "status", F.when(F.col("status") == "linked", F.col("of") + 1).otherwise(-1).alias("level"), _line({"tool_call_id": "answers"}).alias("line"))
    return plain.unionByName(asked).unionByName(told)


#: The tools that `as_calls` calls, and what they take.
TURN_TOOLS = (("reply", "words", "integer", True), ("reply", "lines", "integer", True), ("expand", "words", "integer", True))
BRIEF = 100  # a request of fewer characters asks to expand


def as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as tool calls and results, and the schemas of the two tools.

    A user turn t becomes a call with the id u<t>, which builds on the call of turn t - 2, if
    there is one. It is a call of `expand` if the text has fewer than BRIEF characters, else of
    `reply`; its arguments are the number of words and, if the text has a newline, of lines. An
    assistant turn t becomes the result of the call u<t - 1>. Other turns stay as they are.
    The tools' schemas are TURN_TOOLS: a `reply` to one line lacks an argument, an `expand`
    of several lines has one too many.
    """
    rows = messages.select(*[F.col(f"`{c}`").alias(c) for c in MESSAGE])
    t = F.coalesce("text", F.lit(""))
    lines = F.when(F.instr(t, "\n") > 0, F.regexp_count(t, F.lit("\n")) + 1)
    of = lambda back: F.concat(F.lit("u"), (F.col("turn") - back).cast("string"))
    arguments = F.struct(lines.alias("lines"), F.size(words(t)).alias("words"))
    name = F.when(F.length(t) < BRIEF, "expand").otherwise("reply")
    call = F.struct(of(0).alias("id"), name.alias("name"), arguments.alias("arguments"), F.array(of(2)).alias("after"))
    result = F.to_json(F.struct(of(1).alias("tool_call_id"), F.col("text").alias("content")))
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    text = F.when(user, F.to_json(F.struct(F.array(call).alias("tool_calls")))).when(answer, result).otherwise(F.col("text"))
    role = F.when(user, "assistant").when(answer, "tool").otherwise(F.col("role"))
    made = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    return made, messages.sparkSession.createDataFrame(list(TURN_TOOLS), TOOLS)


def linked(formatted: DataFrame) -> DataFrame:
    """The messages that take part in calls, in an order in which each call comes after what it builds on and before its result."""
    return formatted.where("status <> 'plain'").orderBy("conv_id", "level", "turn")
