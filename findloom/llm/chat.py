"""Chat formatting: linking tool calls with their results.

Calls and results are hash-joined by identifier, calls that consume another
call's result (``after``) are put in topological order, arguments are checked
against the tools' schemas, and each call becomes one canonical JSON line
(sorted keys, no blanks). Built-in expressions only.

Order: a call's depth is its distance from the first call of its chain, found
by pointer doubling, so a chain of n calls takes about log2(n) joins. Calls of
a conversation are ordered by depth, then position, then identifier.

Scale: the first call and the first result of an identifier are found by
partial aggregation, so an identifier repeated in a third of all rows meets in
few rows per task. Every join has one row per identifier on one side and deals
out the rows of hot identifiers on the other (``skew``). Conversations are never
gathered: their order is numbered in ranges.

Defined results:

* an identifier used by several calls belongs to the first of them (position,
  then conversation and arguments); the others stay, with the error ``repeated
  id`` and no result;
* of several results for one identifier the first one (position, then content
  and conversation) is linked and ``n_results`` counts all; the others are rows
  of their own: ``repeated result``;
* a null identifier links with nothing: ``no id``;
* results without a call are rows of their own: ``no call``;
* ``after`` that names no call, or itself, is ``unknown dependency``, and depth
  counts from there; calls on or behind a cycle have depth -1 and ``cycle``;
* arguments that are null or no JSON object are ``bad arguments``; unknown
  tools ``unknown tool``; else ``missing P``, ``type of P``, ``range of P`` and
  ``unknown P`` for parameters P. Null values count as missing;
* empty tables give an empty result; extra columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from .numbering import order_within
from .skew import spread_join

#: JSON types and how the schema of a parsed value names them.
_TYPES = {
    "string": r"^STRING$",
    "integer": r"^BIGINT$|^DECIMAL\(\d+,0\)$",
    "number": r"^BIGINT$|^DOUBLE$|^DECIMAL",
    "boolean": r"^BOOLEAN$",
    "array": r"^ARRAY<",
    "object": r"^OBJECT<",
}


@dataclass(frozen=True)
class Parameter:
    """One parameter of a tool: its JSON type, whether a call must give it, and the range of a number or of a
    string's characters."""

    name: str
    type: str
    required: bool = True
    least: int | None = None
    most: int | None = None

    def outside(self, parsed: Column) -> Column:
        """Whether a value of the right type is out of range."""
        kind = {"string": "string", "integer": "decimal(38,0)", "number": "double"}.get(self.type)
        if kind is None or (self.least is None and self.most is None):
            return F.lit(False)
        value = F.try_variant_get(parsed, f"$['{self.name}']", kind)
        value = F.char_length(value) if kind == "string" else value
        low = F.lit(False) if self.least is None else value < self.least
        high = F.lit(False) if self.most is None else value > self.most
        return F.coalesce(low | high, F.lit(False))


def _complaints(tool: Column, arguments: Column, parsed: Column, tools: dict[str, list[Parameter]]) -> Column:
    none = F.array().cast("array<string>")
    keys = F.coalesce(F.json_object_keys(arguments), none)
    by_tool = F.array(F.lit("unknown tool"))
    for name, parameters in tools.items():
        found = []
        for p in parameters:
            value = F.try_variant_get(parsed, f"$['{p.name}']", "variant")
            kind = F.schema_of_variant(value)
            absent = value.isNull() | F.is_variant_null(value)
            missing = F.when(absent, F.lit(f"missing {p.name}" if p.required else None).cast("string"))
            found.append(
                missing.when(~kind.rlike(_TYPES[p.type]), F.lit(f"type of {p.name}"))
                .when(p.outside(parsed), F.lit(f"range of {p.name}"))
            )
        known = F.array(*(F.lit(p.name) for p in parameters)) if parameters else none
        extra = F.transform(
            F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.lit("unknown "), k)
        )
        by_tool = F.when(tool == name, F.concat(F.array_compact(F.array(*found)) if found else none, extra)).otherwise(by_tool)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT<")
    return F.when(F.coalesce(is_object, F.lit(False)), by_tool).otherwise(F.array(F.lit("bad arguments")))


def _depths(calls: DataFrame) -> DataFrame:
    """``(call_id, depth)`` of ``calls(call_id, after)`` with unique ids; -1 on or behind a cycle."""
    known = calls.select(F.col("call_id").alias("after"), F.lit(True).alias("known"))
    # up: the nearest ancestor not yet passed; steps: how far it is; null when the chain's first call is passed.
    state = stored(
        spread_join(calls, known, ["after"], ["call_id"]).select(
            "call_id",
            F.when(F.col("known") & (F.col("after") != F.col("call_id")), F.col("after")).alias("up"),
            F.when(F.col("known") & (F.col("after") != F.col("call_id")), 1).otherwise(0).cast("long").alias("steps"),
        )
    )
    left = state.where("up is not null").count()
    while left:
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("far"), F.col("steps").alias("more"))
        state = stored(
            spread_join(state, above, ["up"], ["call_id"]).select(
                "call_id", F.col("far").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")
            )
        )
        before, left = left, state.where("up is not null").count()
        if left == before:
            break  # doubling settles part of every unsettled chain, so the rest are cycles
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("steps")).otherwise(-1).alias("depth"))


def _others(rows: DataFrame, first: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of ``first(call_id, first)``'s identifiers beyond the first one of each; rows that agree in all stay as many."""
    many = rows.groupBy(*fields).agg(F.count("*").alias("n"))
    same = F.lit(True)
    for name in fields:
        same = same & F.col(name).eqNullSafe(F.col(f"first.{name}"))
    rest = spread_join(many, first, ["call_id"], fields, "inner").withColumn("n", F.col("n") - F.when(same, 1).otherwise(0))
    # In two steps, so that no array is longer than a thousand or a thousandth of the copies.
    rest = rest.where("n > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1000))))
    size = F.least(F.lit(1000), F.col("n") - F.col("block") * 1000)
    return rest.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), size))).select(*fields)


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: dict[str, list[Parameter]]) -> DataFrame:
    """``(conv_id, position, call_id, tool, depth, order, n_results, valid, errors, line)``.

    ``calls(conv_id, position, call_id, tool, arguments, after)`` and
    ``results(conv_id, position, call_id, content)``; ``arguments`` is JSON
    text and ``after`` the id of the call whose result this one consumes.
    ``order`` numbers a conversation's rows by depth, position and identifier.
    """
    fields = ["conv_id", "position", "call_id", "tool", "arguments", "after"]
    said = ["conv_id", "position", "call_id", "content"]
    calls, results = calls.select(fields), results.select(said)
    first = stored(
        calls.where("call_id is not null").groupBy("call_id").agg(
            F.min(F.struct("position", "conv_id", "arguments", "tool", "after", "call_id")).alias("first"), F.count("*").alias("n_calls")
        ),
        "calls",
    )
    depths = _depths(first.select("call_id", F.col("first.after").alias("after")))
    answers = results.where("call_id is not null").groupBy("call_id").agg(
        F.min(F.struct("position", "content", "conv_id", "call_id")).alias("first"), F.count("*").alias("n_results")
    )
    answered = answers.select("call_id", F.col("first.content").alias("content"), "n_results")
    ids = first.join(depths, "call_id").join(answered, "call_id", "left")
    parents = first.select(F.col("call_id").alias("after"), F.lit(True).alias("parent"))
    heads = ids.select(
        *(F.col(f"first.{name}").alias(name) for name in fields), "depth", F.coalesce("n_results", F.lit(0)).alias("n_results"),
        "content", F.lit(None).cast("string").alias("trouble"),
    )
    others = _others(calls, first.where("n_calls > 1").select("call_id", "first"), fields).withColumn("trouble", F.lit("repeated id"))
    nameless = calls.where("call_id is null").withColumn("trouble", F.lit("no id"))
    alone = others.unionByName(nameless).select(
        *fields, F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_results"),
        F.lit(None).cast("string").alias("content"), "trouble",
    )
    rows = spread_join(heads.unionByName(alone), parents, ["after"], ["call_id", "position"])
    parsed = F.try_parse_json("arguments")
    errors = F.concat(
        F.array_compact(
            F.array(
                F.col("trouble"),
                F.when(F.col("depth") < 0, F.lit("cycle")),
                F.when(
                    F.col("after").isNotNull() & (F.col("parent").isNull() | (F.col("after") == F.col("call_id"))),
                    F.lit("unknown dependency"),
                ),
            )
        ),
        _complaints(F.col("tool"), F.col("arguments"), parsed, tools),
    )
    linked = rows.withColumn("parsed", parsed).withColumn("errors", F.array_join(errors, "; "))
    # Results that no call took: without a call, without an identifier, or behind the first one of theirs.
    known = first.select("call_id", F.lit(True).alias("known"))
    lost = spread_join(results, known, ["call_id"], ["position", "content"]).where("known is null").withColumn(
        "errors", F.when(F.col("call_id").isNull(), "no id; no call").otherwise("no call")
    )
    again = _others(results, answers.join(first.select("call_id"), "call_id", "left_semi").where("n_results > 1").select("call_id", "first"), said)
    orphans = lost.select(*said, "errors").unionByName(again.withColumn("errors", F.lit("repeated result"))).select(
        "conv_id", "position", "call_id", F.lit(None).cast("string").alias("tool"),
        F.lit(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("n_results"), "content",
        F.try_parse_json(F.lit(None).cast("string")).alias("parsed"), "errors",
    )
    out = linked.select(*orphans.columns).unionByName(orphans)
    line = F.to_json(
        F.struct(
            F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), F.col("content").alias("result"), "tool"
        )
    )
    lines = out.select(
        "conv_id", "position", "call_id", "tool", "depth", "n_results", (F.col("errors") == "").alias("valid"), "errors", line.alias("line"),
    )
    ordered = order_within(lines, "conv_id", ["depth", "position", "call_id", "line"], "order")
    return ordered.select("conv_id", "position", "call_id", "tool", "depth", "order", "n_results", "valid", "errors", "line")


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conversations(conv_id, turn, role, text)`` as tool calls and results, one of them for every turn.

    An assistant turn is the result of the call one turn before it. A user turn
    calls ``reply``, a system turn ``configure`` and any other role, or none, a
    tool of its own name, which ``TURN_TOOLS`` does not know; a user's call
    consumes the result of the call two turns before it, if there is one. Turns
    without a conversation or number have no identifier.
    """
    name = lambda turn: F.when(
        F.col("conv_id").isNotNull() & turn.isNotNull(), F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    )
    turn, role = F.col("turn"), F.coalesce("role", F.lit(""))
    asked = turns.where(role != "assistant").select(
        "conv_id", turn.alias("position"), name(turn).alias("call_id"),
        F.when(role == "user", "reply").when(role == "system", "configure").otherwise(role).alias("tool"),
        F.to_json(F.struct(F.col("text").alias("prompt"), turn.alias("turn"))).alias("arguments"),
        F.when((turn >= 2) & (role == "user"), name(turn - 2)).alias("after"),
    )
    answered = turns.where(role == "assistant").select(
        "conv_id", turn.alias("position"), name(turn - 1).alias("call_id"), F.col("text").alias("content")
    )
    return asked, answered


#: The two tools of ``turns_as_calls``: prompts are neither empty nor longer than a page, and only the first turn configures.
TURN_TOOLS = {
    "reply": [Parameter("prompt", "string", least=1, most=2000), Parameter("turn", "integer", least=0)],
    "configure": [Parameter("prompt", "string", least=1, most=2000), Parameter("turn", "integer", least=0, most=0)],
}
