"""Tool calls of conversations: link, order, validate and write as canonical JSON.

DataFrame functions only. Calls and results meet in a hash join on their identifier, results first
reduced to one a call. A call's level is 0 if it waits for none and otherwise one more than the
highest of those it waits for, over conversations too; calls on a cycle or behind one get none. So a
call is always above what it waits for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Schema of a tool: parameter -> (JSON type, whether it is required).
Schemas = dict[str, dict[str, tuple[str, bool]]]
_KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


def _errors(schemas: Schemas, name: Column, arguments: Column) -> Column:
    """Array of what is wrong with the arguments, as one expression over all schemas."""
    parsed = F.try_parse_json(arguments)
    out = [F.when(parsed.isNull(), F.lit("not JSON"))]
    out.append(F.when(~F.coalesce(name.isin(list(schemas)), F.lit(False)), F.lit("unknown tool")))
    for tool, params in schemas.items():
        for p, (kind, required) in params.items():
            value = F.try_variant_get(parsed, f"$.{p}", "variant")
            there = value.isNotNull()
            fits = F.lit(False)
            for k in _KINDS[kind]:
                fits = fits | F.schema_of_variant(value).startswith(k)
            problem = F.when(there & ~fits, F.lit(f"{p} is no {kind}"))
            if required:
                problem = problem.when(~there, F.lit(f"{p} is missing"))
            out.append(F.when((name == tool) & parsed.isNotNull(), problem))
        known = F.array(*[F.lit(p) for p in params])
        extra = F.array_except(F.json_object_keys(arguments), known)
        out.append(F.when((name == tool) & parsed.isNotNull() & (F.size(extra) > 0), F.concat(F.lit("unknown: "), F.array_join(F.array_sort(extra), ","))))
    return F.array_compact(F.array(*out))


def _levels(waits: DataFrame) -> DataFrame:
    """(call_id, level) of all calls in ``waits`` (call_id, after): 0 if it waits for none, else one more than the highest it waits for; calls on a cycle or behind one are left out.

    Edges are long: (u, v, w) says that u is w levels above v at least, and a call's floor is what
    settled calls ask of it. In each round edges to settled calls become floors, and edges to a call
    that waits for one other only jump over it. So chains shrink by half in each round; what waits
    for several in turn needs a round a level. A round that settles no call is the last: what is left
    is on cycles or behind them.
    """
    edges = cut(waits.select(F.col("call_id").alias("u"), F.col("after").alias("v"), F.lit(1).cast("long").alias("w")).distinct(), "waits")
    floors = cut(edges.select("u", F.lit(0).cast("long").alias("floor")).distinct(), "floors")
    settled = edges.select(F.col("v").alias("call_id")).distinct().join(floors.select(F.col("u").alias("call_id")), "call_id", "left_anti").withColumn("level", F.lit(0).cast("long"))
    found = new = cut(settled, "levels")
    while not edges.isEmpty():
        rows = cut(edges.join(new.select(F.col("call_id").alias("v"), "level"), "v", "left"), "rows")
        # calls that wait for one other only, which is not settled yet
        one = rows.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.count("level").alias("known"), F.first("v").alias("x"), F.first("w").alias("more")).where("n = 1 and known = 0")
        one = one.join(floors, "u").select(F.col("u").alias("v"), "x", "more", F.col("floor").alias("least"))
        met = cut(rows.join(one, "v", "left"), "met")
        asked = met.select("u", F.when(F.col("level").isNotNull(), F.col("level") + F.col("w")).when(F.col("x").isNotNull(), F.col("least") + F.col("w")).alias("floor")).where("floor is not null")
        floors = cut(floors.unionByName(asked).groupBy("u").agg(F.max("floor").alias("floor")), "floors")
        edges = met.where("level is null").select("u", F.coalesce("x", "v").alias("v"), F.when(F.col("x").isNotNull(), F.col("w") + F.col("more")).otherwise(F.col("w")).alias("w"))
        edges = cut(edges.groupBy("u", "v").agg(F.max("w").alias("w")), "waits")
        new = cut(floors.join(edges.select("u"), "u", "left_anti").select(F.col("u").alias("call_id"), F.col("floor").alias("level")), "levels")
        if new.isEmpty():
            break
        floors = cut(floors.join(edges.select("u"), "u", "left_semi"), "floors")
        found = found.unionByName(new)
    return found


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """(conv_id, turn, call_id, name, copies, linked, level, errors, json) of every call.

    calls: conv_id, turn, call_id, name, arguments (JSON text), after (array of call ids it waits
    for). results: call_id, content. A call with several results takes the smallest content; copies
    counts the calls with its identifier, which wait together for what any of them waits for. A wait
    for an unknown call is an error and orders nothing; level is null on a cycle, behind one, and
    where there is no identifier. json has its keys in order and no spaces; it is null if the
    arguments are not JSON. Null identifiers link with nothing; empty tables give no rows; other
    columns are ignored.
    """
    c = calls.select("conv_id", "turn", "call_id", "name", "arguments", "after")
    one = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("result"))
    same = c.where("call_id is not null").groupBy("call_id").agg(F.count(F.lit(1)).alias("copies"))
    waits = c.where("call_id is not null").select("call_id", F.explode("after").alias("after")).where("after is not null").distinct()
    known = cut(waits.join(same.select(F.col("call_id").alias("after"), F.lit(True).alias("there")), "after", "left"), "known")
    lost = known.where("there is null").groupBy("call_id").agg(F.array_join(F.array_sort(F.collect_set("after")), ",").alias("lost"))
    real = known.where("there").select("call_id", "after")
    levels = _levels(real).withColumn("settled", F.lit(True))
    waiting = real.select("call_id").distinct().withColumn("waiting", F.lit(True))
    rows = c.join(same, "call_id", "left").join(one, "call_id", "left").join(lost, "call_id", "left").join(levels, "call_id", "left").join(waiting, "call_id", "left")
    rows = rows.withColumn("level", F.when(F.col("settled"), F.col("level")).when(F.col("waiting").isNull() & F.col("call_id").isNotNull(), F.lit(0).cast("long")))
    errors = F.array_compact(F.concat(_errors(schemas, F.col("name"), F.col("arguments")), F.array(F.when(F.col("lost").isNotNull(), F.concat(F.lit("waits for unknown: "), F.col("lost"))))))
    parsed = F.try_parse_json("arguments")
    text = F.concat(
        F.lit('{"arguments":'), F.to_json(parsed), F.lit(',"id":'), F.coalesce(quoted("call_id"), F.lit("null")), F.lit(',"name":'), F.coalesce(quoted("name"), F.lit("null")),
        F.lit(',"result":'), F.coalesce(quoted("result"), F.lit("null")), F.lit("}"))
    return rows.select("conv_id", "turn", "call_id", "name", F.coalesce("copies", F.lit(1)).alias("copies"), F.col("result").isNotNull().alias("linked"), "level", errors.alias("errors"), text.alias("json"))


def quoted(column: str) -> Column:
    """A string as JSON; null stays null."""
    return F.when(F.col(column).isNotNull(), F.expr(f"substring(to_json(array(`{column}`)), 2, length(to_json(array(`{column}`))) - 2)"))


RESPOND: Schemas = {"respond": {"chars": ("integer", True), "text": ("string", True)}}


def of_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations, which hold none: an assistant's turn is a call of ``respond`` and the turn after it is its result.

    It waits for the assistant's turn before it. A text whose length is a multiple of 13 waits for the
    next one instead, which may be unknown or wait for it in turn; one whose length is a multiple of 7
    gives that length as a text, which the schema refuses. Turns without text have no arguments.
    """
    key = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    n = F.length("text")
    chars = F.when(n % 7 == 0, F.concat(F.lit('"'), n.cast("string"), F.lit('"'))).otherwise(n.cast("string"))
    arguments = F.when(F.col("text").isNull(), F.lit("{}")).otherwise(F.concat(F.lit('{"chars":'), chars, F.lit(',"text":'), quoted("text"), F.lit("}")))
    after = F.when(F.coalesce(n % 13 == 0, F.lit(False)), F.array(key(F.col("turn") + 2))).when(F.col("turn") >= 3, F.array(key(F.col("turn") - 2)))
    calls = conversations.where("role = 'assistant'").select("conv_id", "turn", F.when(whole, key(F.col("turn"))).alias("call_id"), F.lit("respond").alias("name"), arguments.alias("arguments"), F.when(whole, after).alias("after"))
    results = conversations.where("role <> 'assistant'").where(whole).select(key(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
