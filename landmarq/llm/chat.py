"""Tool-call linking for conversations, in built-in functions only.

Calls and results meet in a hash join on (conversation, call id); calls are put
in an order in which each comes after those it depends on; arguments are
validated against the tools' schemas; and every link is written as canonical
JSON (sorted keys, no white space).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import exists, materialise, shared_dir, with_prefix

#: Tool name -> parameter name -> (type, required). Types: string, integer, number, boolean, array, object, any.
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]
#: Bound on tools and parameters: schemas are part of the plan.
MOST_PARAMETERS = 5000
#: What a variant's type is called, as a pattern over schema_of_variant.
_KINDS = {
    "string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY.*$", "object": "^OBJECT.*$", "any": "^(?!VOID$).*$",
}


def canonical(json: Column) -> Column:
    """The JSON text with sorted keys and no white space; null for malformed JSON or repeated keys."""
    return F.to_json(F.try_parse_json(json))


def json_string(text: Column) -> Column:
    """``text`` as a JSON string literal; null for null."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))


def argument_errors(tool: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted array of what is wrong with ``arguments`` (JSON text): empty where valid.

    ``malformed`` JSON, a value that is no object (``not an object``), an unknown
    tool, a missing required parameter, a parameter of the wrong type, and a
    parameter that the schema doesn't name. JSON null counts as missing.
    """
    if sum(max(1, len(p)) for p in schemas.values()) > MOST_PARAMETERS:
        raise ValueError(f"schemas have over {MOST_PARAMETERS} parameters")
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    fields = F.when(kind.rlike("^OBJECT"), value.cast("map<string,variant>"))
    found = F.lit(None).cast("array<string>")
    for name, parameters in schemas.items():
        checks = []
        for p, (wanted, required) in parameters.items():
            given = F.coalesce(F.schema_of_variant(F.try_element_at(fields, F.lit(p))), F.lit("VOID"))
            wrong = F.when(given == "VOID", F.lit(f"missing {p}") if required else F.lit(None)).when(~given.rlike(_KINDS[wanted]), F.lit(f"{p} is no {wanted}"))
            checks.append(wrong)
        extra = F.transform(F.array_except(F.map_keys(fields), F.array(*(F.lit(p) for p in parameters)).cast("array<string>")), lambda k: F.concat(F.lit("unknown "), k))
        own = F.concat(F.array_compact(F.array(*checks).cast("array<string>")), extra)
        found = F.when(tool == name, own).otherwise(found)
    return (
        F.when(tool.isNull() | ~tool.isin(list(schemas)), F.array(F.lit("unknown tool")))
        .when(value.isNull(), F.array(F.lit("malformed")))
        .when(fields.isNull(), F.array(F.lit("not an object")))
        .otherwise(F.sort_array(found))
    )


def topological_levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level, cyclic`` for each distinct call, from ``conv_id, call_id, turn, after``.

    ``after`` lists the calls of the same conversation that must come first.
    Where every one of them stands at an earlier turn, the order of turns is
    already right and the level is 0 throughout. Only conversations in which
    some call waits for a later one are levelled: a call's level is the
    longest way to it over what it waits for. What waits on a ring has no
    level. Names of unknown calls and of the call itself are ignored.

    Each round settles the calls that wait for none that is open, and every
    wait for a call that itself waits for one other alone then reaches past it, twice as
    far each round. So a chain takes a number of rounds that grows with the logarithm of its
    length, and only calls that wait for several open ones at once cost a round for each level.
    Rounds go by call, so a conversation that holds most rows is no single task's.
    """
    spark = calls.sparkSession
    nodes = materialise(calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn")), "calls")
    edges = calls.select("conv_id", "call_id", F.explode("after").alias("before")).where(F.col("before").isNotNull() & (F.col("before") != F.col("call_id"))).distinct()
    target = nodes.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_b"), F.col("turn").alias("_t"))
    known = edges.join(target, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("before") == F.col("_b"))).drop("_c", "_b")
    own = nodes.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_b"), F.col("turn").alias("_own"))
    known = materialise(known.join(own, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_b"))).select("conv_id", "call_id", "before", (F.col("_t") < F.col("_own")).alias("earlier")), "waits")
    late = materialise(known.where("not coalesce(earlier, false)").select(F.col("conv_id").alias("_c")).distinct(), "late")
    same = lambda a: F.col(a).eqNullSafe(F.col("_c"))
    done = nodes.join(late, same("conv_id"), "left_anti").select("conv_id", "call_id", F.lit(0).alias("level"), F.lit(False).alias("cyclic"))
    if late.isEmpty():
        return done
    # ``least``: the level that what is already settled asks for; a wait reaches back over ``steps`` levels.
    left = materialise(nodes.join(late, same("conv_id"), "left_semi").select("conv_id", "call_id", F.lit(0).cast("long").alias("least")), "left")
    waits = materialise(known.join(late, same("conv_id"), "left_semi").select("conv_id", "call_id", "before", F.lit(1).cast("long").alias("steps")), "left-waits")
    settled = shared_dir(spark, "settled")  # each round adds its calls here, so no plan grows with the rounds
    most = F.lit(1 << 40)  # no conversation is as long; it stops what goes round a ring from growing
    at = lambda call: F.col("conv_id").eqNullSafe(F.col("_c")) & F.col(call).eqNullSafe(F.col("_b"))
    while True:
        open_calls = waits.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_b")).distinct()
        free = materialise(left.join(open_calls, at("call_id"), "left_anti"), "free")
        if free.isEmpty():
            break
        free.write.mode("append").parquet(settled)
        now = free.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_b"), F.col("least").alias("_level"))
        kept = waits.join(now, at("before"), "left")
        asked = kept.where("_level is not null").groupBy("conv_id", "call_id").agg(F.max(F.col("_level") + F.col("steps")).alias("_asked"))
        still = materialise(left.join(now.select("_c", "_b"), at("call_id"), "left_anti").join(asked.withColumnsRenamed({"conv_id": "_c", "call_id": "_b"}), at("call_id"), "left").select("conv_id", "call_id", F.greatest("least", F.coalesce("_asked", F.lit(0))).alias("least")), "left")
        rest = materialise(kept.where("_level is null").select("conv_id", "call_id", "before", "steps"), "left-waits")
        # What a call with one open wait asks for is known but for that wait: who waits for it takes over both.
        single = rest.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("_n"), F.first("before").alias("_q"), F.first("steps").alias("_w")).where("_n = 1").join(
            still.withColumnsRenamed({"conv_id": "_c", "call_id": "_b", "least": "_least"}), at("call_id")).select("_c", "_b", "_q", "_w", "_least")
        reached = materialise(rest.join(single, at("before"), "left"), "reached")
        raised = reached.where("_least > 0").groupBy(F.col("conv_id").alias("_c"), F.col("call_id").alias("_b")).agg(F.max(F.least(F.col("_least") + F.col("steps"), most)).alias("_asked"))
        left = materialise(still.join(raised, at("call_id"), "left").select("conv_id", "call_id", F.greatest("least", F.coalesce("_asked", F.lit(0))).alias("least")), "left")
        waits = materialise(reached.select("conv_id", "call_id", F.coalesce("_q", "before").alias("before"), F.least(F.col("steps") + F.coalesce("_w", F.lit(0)), most).alias("steps")).groupBy("conv_id", "call_id", "before").agg(F.max("steps").alias("steps")), "left-waits")
    levelled = spark.read.schema(left.schema).parquet(settled) if exists(spark, settled) else left.limit(0)
    done = done.union(levelled.select("conv_id", "call_id", F.col("least").cast("int").alias("level"), F.lit(False).alias("cyclic")))
    return done.union(left.select("conv_id", "call_id", F.lit(None).cast("int").alias("level"), F.lit(True).alias("cyclic")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Links calls with their results, orders, validates and serialises them.

    ``calls``: ``conv_id, turn, call_id, tool, arguments`` (JSON text), ``after``
    (array of call ids). ``results``: ``conv_id, turn, call_id, content``. Other
    columns are ignored. Gives for every call row, and for every result whose
    call is unknown: ``conv_id, call_id, turn, result_turn, position, level,
    tool, status, errors, record``.

    ``status``: ``linked``; ``unanswered`` (no result); ``invalid`` (a result or
    not, but ``errors`` isn't empty); ``repeated`` (the id was called before in
    the conversation); ``cyclic``; ``orphan`` (a result without a call, also
    one with a null id). Of results that share an id the first by turn counts, ties by content;
    the rest have no row. ``position`` counts a conversation's rows from 0 in
    order of level, turn and id, orphans and rings last. Null conversation ids are one conversation.
    A conversation that holds most rows is ranked by range partitions, not in one task.
    Empty tables give an empty one.
    """
    asked = calls.select("conv_id", "turn", "call_id", F.col("tool").cast("string").alias("tool"), F.col("arguments").cast("string").alias("arguments"), F.col("after").cast("array<string>").alias("after")).withColumn("call_id", F.col("call_id").cast("string"))
    answers = results.select("conv_id", F.col("turn").alias("result_turn"), F.col("call_id").cast("string").alias("call_id"), F.col("content").cast("string").alias("content"))
    first = answers.groupBy("conv_id", "call_id").agg(F.min(F.struct("result_turn", "content")).alias("_r")).select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_b"), "_r.result_turn", "_r.content")
    levels = topological_levels(asked).select(F.col("conv_id").alias("_lc"), F.col("call_id").alias("_lb"), "level", "cyclic")
    firsts = asked.groupBy("conv_id", "call_id").agg(F.min("turn").alias("_first")).select(F.col("conv_id").alias("_fc"), F.col("call_id").alias("_fb"), "_first")
    both = lambda a, b: F.col("conv_id").eqNullSafe(F.col(a)) & F.col("call_id").eqNullSafe(F.col(b))
    linked = asked.join(firsts, both("_fc", "_fb")).join(levels, both("_lc", "_lb"), "left").join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_b")), "left")
    errors = argument_errors(F.col("tool"), F.col("arguments"), schemas)
    linked = linked.withColumn("errors", errors)
    status = (
        F.when(F.col("turn") > F.col("_first"), "repeated").when(F.col("cyclic"), "cyclic").when(F.size("errors") > 0, "invalid").when(F.col("_b").isNull(), "unanswered").otherwise("linked")
    )
    linked = linked.select("conv_id", "call_id", "turn", "result_turn", "level", "tool", status.alias("status"), "errors", "arguments", "content")
    orphans = first.join(firsts, F.col("_c").eqNullSafe(F.col("_fc")) & (F.col("_b") == F.col("_fb")), "left_anti").select(
        F.col("_c").alias("conv_id"), F.col("_b").alias("call_id"), F.lit(None).cast(asked.schema["turn"].dataType).alias("turn"), "result_turn", F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("string").alias("tool"), F.lit("orphan").alias("status"), F.array().cast("array<string>").alias("errors"), F.lit(None).cast("string").alias("arguments"), "content",
    )
    rows = linked.union(orphans)
    null = F.lit("null")
    whole = F.coalesce(canonical(F.col("arguments")), json_string(F.col("arguments")), null)
    record = F.concat(
        F.lit('{"arguments":'), whole, F.lit(',"content":'), F.coalesce(json_string(F.col("content")), null), F.lit(',"id":'), F.coalesce(json_string(F.col("call_id")), null),
        F.lit(',"name":'), F.coalesce(json_string(F.col("tool")), null), F.lit(',"status":"'), F.col("status"), F.lit('"}'),
    )
    rows = rows.withColumn("record", record).drop("arguments", "content")
    order = [F.col("conv_id").asc_nulls_first(), F.col("level").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("result_turn").asc_nulls_last(), F.col("call_id").asc_nulls_first(), F.col("record")]
    placed = materialise(with_prefix(rows, order, name="links"), "placed")
    starts = placed.groupBy("conv_id").agg(F.min("_index").alias("_start")).select(F.col("conv_id").alias("_c"), "_start")
    return placed.join(starts, F.col("conv_id").eqNullSafe(F.col("_c"))).select(
        "conv_id", "call_id", "turn", "result_turn", (F.col("_index") - F.col("_start")).alias("position"), "level", "tool", "status", "errors", "record"
    )


def calls_from_turns(conversations: DataFrame, tool: str = "reply") -> tuple[DataFrame, DataFrame]:
    """Calls and results read out of plain conversations (``conv_id, turn, role, text``).

    Each user turn asks the tool ``tool`` with ``{"text", "turn", "words"}``, after the
    user turn before it; the assistant turn that follows is its result. Rows with a null turn ask and answer nothing.
    """
    ident = lambda turn: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), turn.cast("string"))
    rows = conversations.where(F.col("turn").isNotNull())
    text = F.coalesce(F.col("text"), F.lit(""))
    arguments = F.to_json(F.struct(F.col("turn"), text.alias("text"), F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("words")))
    calls = rows.where("role = 'user'").select("conv_id", "turn", ident(F.col("turn")).alias("call_id"), F.lit(tool).alias("tool"), arguments.alias("arguments"), F.array(ident(F.col("turn") - 2)).alias("after"))
    results = rows.where("role = 'assistant'").select("conv_id", "turn", ident(F.col("turn") - 1).alias("call_id"), F.coalesce(F.col("text"), F.lit("")).alias("content"))
    return calls, results
