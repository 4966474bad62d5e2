"""Chat formatting: tool calls joined with their results, ordered, validated and serialised.

DataFrame functions only. Calls and results are hash-joined by call_id. A call may name one
earlier call in `after`; levels of this forest are found by pointer doubling, so (conv_id,
level, turn) is a topological order, in log2(depth) rounds. Arguments are checked against the
tool's schema. JSON is canonical: keys in order, no white space.

Defined results: of calls (or results) with one id, the least (turn, content) counts; a call without a
result is `unanswered`; a result without a call is `orphan`; a call whose `after` isn't there is a
root with the error `unknown dependency`; calls on a cycle have a null level and the error `cycle`.
Rows without an id are `unidentified`; turns that are no calls (others) have the status `no call` and a message of role and content. Arguments that aren't a JSON object give
the error `not an object`; a tool without a schema `unknown tool`. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

#: A field: name, type as schema_of_variant names it, whether it must be there.
Schema = dict[str, tuple[tuple[str, str, bool], ...]]
REPLY: Schema = {"reply": (("text", "STRING", True), ("turn", "BIGINT", True))}
COLUMNS = ("call_id", "conv_id", "turn", "level", "tool", "status", "valid", "errors", "message")


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level, dangling) of (call_id, after); level is null on and behind a cycle."""
    ids = calls.select(F.col("call_id").alias("up"), F.lit(True).alias("there"))
    rest = calls.where("after is not null")
    found = rest.join(ids, rest["after"] == ids["up"], "left").select("call_id", "up", F.when(F.col("there"), 1).otherwise(0).cast("long").alias("level"), F.col("there").isNull().alias("dangling"))
    # Rows without a call above them never meet a join: they would all have one key
    roots = calls.where("after is null").select("call_id", F.lit(None).cast(calls.schema["after"].dataType).alias("up"), F.lit(0).cast("long").alias("level"), F.lit(False).alias("dangling"))
    state = cut(found.unionByName(roots), "levels")
    open_, rounds = state.where("up is not null").count(), 1
    while open_ and (1 << rounds) <= 2 * open_ + 2:
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        higher = state.where("up is not null").join(above, "up").select("call_id", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"), "dangling")
        state = cut(state.where("up is null").unionByName(higher), "levels")
        rounds += 1
        if not state.where("up is not null").limit(1).count():
            break
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"), "dangling")


def schema_rows(spark: SparkSession, schemas: Schema) -> DataFrame:
    rows = [(tool, [(f, kind, must) for f, kind, must in fields]) for tool, fields in schemas.items()]
    return spark.createDataFrame(rows, "tool string, fields array<struct<field: string, kind: string, must: boolean>>")


def _errors() -> F.Column:
    """Of variant column `args` and the schema's `fields`: an array of messages, in order."""
    types = "transform_values(from_json(arguments, 'map<string,variant>'), (k, v) -> schema_of_variant(v))"
    found = F.expr(
        f"""case when fields is null then array('unknown tool')
        when args is null or not startswith(schema_of_variant(args), 'OBJECT') then array('not an object')
        else array_sort(concat(
          flatten(transform(fields, f -> case
            when not map_contains_key({types}, f.field) then if(f.must, array(concat('missing ', f.field)), array())
            when element_at({types}, f.field) <> f.kind then array(concat(f.field, ' is not ', f.kind))
            else array() end)),
          transform(filter(map_keys({types}), k -> not exists(fields, f -> f.field = k)), k -> concat('unknown ', k)))) end"""
    )
    return found


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schema, others: DataFrame | None = None) -> DataFrame:
    """COLUMNS for calls (call_id, conv_id, turn, tool, arguments, after), results (call_id, conv_id, turn, content) and others (conv_id, turn, role, content), which are neither."""
    own = ("conv_id", "turn", "tool", "arguments", "after")
    one = calls.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "arguments", "tool", "after", "conv_id")).alias("x")).select("call_id", *(F.col(f"x.{c}").alias(c) for c in own))
    answer = results.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "content", "conv_id")).alias("r"))
    both = one.join(answer, "call_id", "full_outer")
    both = both.join(levels(one.select("call_id", "after")), "call_id", "left").join(F.broadcast(schema_rows(calls.sparkSession, schemas)), "tool", "left")
    is_call = F.col("level").isNotNull() | F.col("dangling").isNotNull()
    both = both.withColumn("args", F.try_parse_json("arguments")).withColumn("errors", F.when(is_call, _errors()))
    both = both.withColumn("errors", F.when(is_call, F.concat("errors", F.when(F.col("dangling"), F.array(F.lit("unknown dependency"))).otherwise(F.array().cast("array<string>")), F.when(F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")))))
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit("null"))
    text = lambda c: F.when(F.col(c).isNull(), "null").otherwise(quoted(c))
    message = F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json("args"), text("arguments")), F.lit(',"id":'), text("call_id"), F.lit(',"result":'), text("content"), F.lit(',"tool":'), text("tool"), F.lit("}"))
    linked = both.withColumn("content", F.col("r.content")).select(
        "call_id",
        F.coalesce("conv_id", "r.conv_id").alias("conv_id"),
        F.coalesce("turn", "r.turn").alias("turn"),
        "level",
        "tool",
        F.when(~is_call, "orphan").when(F.col("r").isNull(), "unanswered").otherwise("linked").alias("status"),
        F.when(is_call, F.size("errors") == 0).alias("valid"),
        F.concat_ws("; ", F.coalesce("errors", F.array().cast("array<string>"))).alias("errors"),
        message.alias("message"),
    )
    lost = calls.where("call_id is null").select("conv_id", "turn", "tool").unionByName(results.where("call_id is null").select("conv_id", "turn", F.lit(None).cast("string").alias("tool")))
    none = lambda kind: F.lit(None).cast(kind)
    lost = lost.select(none("string").alias("call_id"), "conv_id", "turn", none("long").alias("level"), "tool", F.lit("unidentified").alias("status"), none("boolean").alias("valid"), F.lit("").alias("errors"), none("string").alias("message"))
    if others is None:
        return linked.unionByName(lost)
    said = F.concat(F.lit('{"content":'), text("content"), F.lit(',"role":'), text("role"), F.lit("}"))
    rest = others.select(none("string").alias("call_id"), "conv_id", "turn", none("long").alias("level"), none("string").alias("tool"), F.lit("no call").alias("status"), none("boolean").alias("valid"), F.lit("").alias("errors"), said.alias("message"))
    return linked.unionByName(lost).unionByName(rest)


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, others) of plain turns: a user turn calls `reply` after the call two turns before; an assistant turn answers the turn before it. Turns of other roles (system, null, other spellings) are others."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    at = lambda back: F.concat_ws("-", F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.col("conv_id").cast("string")), (F.col("turn") - back).cast("string"))
    key = lambda back: F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), at(back))
    user = turns.where("role = 'user'")
    calls = user.select(key(0).alias("call_id"), "conv_id", "turn", F.lit("reply").alias("tool"), F.to_json(F.struct("turn", "text")).alias("arguments"), key(2).alias("after"))
    # Only a call that is there is named; keys are conv_id-turn, so no key is common
    prior = calls.select(F.col("call_id").alias("after"), F.lit(True).alias("there")).where("after is not null").distinct()
    named = calls.where("after is not null").join(prior, "after", "left").withColumn("after", F.when(F.col("there"), F.col("after"))).drop("there")
    calls = calls.where("after is null").unionByName(named)
    results = turns.where("role = 'assistant'").select(key(1).alias("call_id"), "conv_id", "turn", F.col("text").alias("content"))
    others = turns.where("coalesce(role, '') not in ('user', 'assistant')").select("conv_id", "turn", "role", F.col("text").alias("content"))
    return calls, results, others
