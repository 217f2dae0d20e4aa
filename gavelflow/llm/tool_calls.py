"""Chat formatting: linked, ordered, validated tool calls as canonical JSON.

Native DataFrame functions only. Calls and results are joined by identifier. Calls may
name other calls whose results they use; they are ordered by levels: level 0 uses none,
the others come one level after the last that they use. Each round places the calls
whose references are all placed, so rounds are as many as levels. Calls that wait for
each other, or for a call that isn't there, are never placed (level null). Arguments are
parsed as a variant, whose objects hold their keys in order, and checked against the
tool's schema. The JSON has sorted keys and no blanks.

A conversation of any length is rows, never one array, and no step groups by it.

Defined cases: a call without identifier links to nothing and is invalid; of several
results for one call all are counted and the one of the smallest turn is kept (on a tie
the smallest text); repeated calls are kept; arguments that aren't JSON are invalid and
serialised as null; a tool without schema is invalid; null text is a null argument; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.llm.scratch import Scratch


def schema_errors(name: Column, arguments: Column, schemas: dict) -> Column:
    """Array of what is wrong. schemas: {tool: {field: {type, required, least, most}}},
    where least and most bound a number, or the length of a string."""
    kinds = {"integer": "bigint", "string": "string", "number": "double", "boolean": "boolean"}
    checks = [F.when(name.isNull() | ~name.isin(*schemas), F.lit("unknown tool")), F.when(arguments.isNull(), F.lit("arguments are not JSON"))]
    for tool, fields in schemas.items():
        here = (name == tool) & arguments.isNotNull()
        for field, rule in fields.items():
            value = F.try_variant_get(arguments, f"$.{field}", kinds[rule["type"]])
            found = F.schema_of_variant(F.try_variant_get(arguments, f"$.{field}", "variant"))
            missing = found.isNull() | (found == "VOID")
            if rule.get("required"):
                checks.append(F.when(here & missing, F.lit(f"{field} is missing")))
            right = {"integer": found == "BIGINT", "string": found == "STRING", "boolean": found == "BOOLEAN", "number": (found == "BIGINT") | (found == "DOUBLE") | found.startswith("DECIMAL")}
            checks.append(F.when(here & ~missing & ~right[rule["type"]], F.lit(f"{field} is not {rule['type']}")))
            size = F.length(value) if rule["type"] == "string" else value
            for bound, wrong in (("least", lambda s, b: s < b), ("most", lambda s, b: s > b)):
                if bound in rule:
                    checks.append(F.when(here & ~missing & wrong(size, rule[bound]), F.lit(f"{field} is out of bounds")))
    return F.array_distinct(F.array_compact(F.array(*checks)))


def topological_levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """call_id, level of the calls that can be placed. calls: call_id, uses array<string>."""
    ids = calls.filter("call_id IS NOT NULL").groupBy("call_id").agg(F.flatten(F.collect_set(F.coalesce("uses", F.array().cast("array<string>")))).alias("uses"))
    ids = scratch.save(ids, "calls")
    edges = ids.select("call_id", F.explode(F.array_distinct("uses")).alias("used"))
    edges = scratch.save(edges.filter("used IS NOT NULL"), "edges")
    needs = edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("needs"))
    placed = scratch.save(ids.join(needs, "call_id", "left_anti").select("call_id", F.lit(0).alias("level")), "level0")
    k, newest = 0, placed
    while not newest.isEmpty():
        ready = edges.join(placed.select(F.col("call_id").alias("used"), "level"), "used").groupBy("call_id").agg(F.count(F.lit(1)).alias("met"), F.max("level").alias("last"))
        ready = ready.join(needs, "call_id").filter("met = needs").join(placed, "call_id", "left_anti").select("call_id", (F.col("last") + 1).alias("level"))
        k += 1
        newest = scratch.save(ready, f"level{k}")
        placed = placed.unionByName(newest)
    return placed


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """conv_id, turn, call_id, name, level, n_results, result_turn, valid, errors, message.

    calls: conv_id, turn, call_id, name, arguments (JSON text), uses (array of call ids);
    results: call_id, turn, content.
    """
    scratch = Scratch(calls.sparkSession, "tool-calls")
    levels = topological_levels(calls.select("call_id", "uses"), scratch)
    answered = results.filter("call_id IS NOT NULL").groupBy("call_id").agg(
        F.count(F.lit(1)).alias("n_results"), F.min(F.struct("turn", "content")).alias("first")
    )
    parsed = calls.withColumn("parsed", F.try_parse_json("arguments"))
    linked = parsed.join(answered, "call_id", "left").join(levels, "call_id", "left")
    errors = F.array_compact(F.concat(
        F.array(F.when(F.col("call_id").isNull(), F.lit("no identifier")), F.when(F.col("level").isNull(), F.lit("not placed"))),
        schema_errors(F.col("name"), F.col("parsed"), schemas),
    ))
    message = F.to_json(F.struct(
        F.col("parsed").alias("arguments"), F.col("call_id"), F.col("level"), F.col("name"), F.col("first.content").alias("result"), F.col("turn")
    ), {"ignoreNullFields": "false"})
    return linked.select(
        "conv_id", "turn", "call_id", "name", "level",
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.col("first.turn").alias("result_turn"),
        (F.size(errors) == 0).alias("valid"),
        F.array_join(errors, "; ").alias("errors"),
        message.alias("message"),
    )


#: The tools that turns of plain conversations are read as calls of.
TOOLS = ["search", "summarise", "translate"]
SCHEMAS = {
    "search": {"limit": {"type": "integer", "required": True, "least": 0, "most": 150}, "text": {"type": "string", "required": True, "least": 1}},
    "summarise": {"limit": {"type": "integer", "required": True, "least": 20}, "text": {"type": "string", "required": True, "most": 1000}},
    "translate": {"text": {"type": "string", "required": True, "least": 1, "most": 4000}},
}


def calls_of_conversations(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (user turns) and results (assistant turns) of plain conversations.

    A user turn is a call, identified by its conversation and turn, of the tool that its
    length picks; it uses the conversation's opening call. The assistant turn after it is
    its result.
    """
    m = messages.select("conv_id", "turn", "role", F.col("text").alias("said"))
    ident = lambda turn: F.concat_ws(":", "conv_id", turn)
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    opening = m.filter("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("opened"))
    size = F.coalesce(F.length("said"), F.lit(0))
    user = m.filter("role = 'user'").join(opening, "conv_id", "left")
    calls = user.select(
        "conv_id", "turn",
        F.when(known, ident(F.col("turn"))).alias("call_id"),
        F.element_at(F.array(*map(F.lit, TOOLS)), (size % 3 + 1).cast("int")).alias("name"),
        F.to_json(F.struct(F.col("said").alias("text"), (size % 200).alias("limit")), {"ignoreNullFields": "false"}).alias("arguments"),
        F.when(known & (F.col("turn") > F.col("opened")), F.array(ident(F.col("opened")))).otherwise(F.array().cast("array<string>")).alias("uses"),
    )
    results = m.filter("role = 'assistant'").select(F.when(known, ident(F.col("turn") - 1)).alias("call_id"), "turn", F.col("said").alias("content"))
    return calls, results
