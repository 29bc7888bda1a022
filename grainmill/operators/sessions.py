"""Tool-call sessions as an automaton: what happens to each output of a model, from the state that the outputs before it left."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from ..sources.store import BucketStore, newest
from .conversation import argument_errors, partial_tool_call, tool_call

#: Rounds of a session.
BUDGET = 6
STATE = "struct<rounds:int,last_call:string,last_failed:boolean,warned:boolean,nudged:boolean,over:boolean>"


class Tool(NamedTuple):
    """Names of the arguments that a tool accepts and requires, and whether the user is asked first."""

    accepted: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    confirm: bool = False


def _described(name: Column, tools: dict[str, Tool]) -> Column:
    texts = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    table = F.create_map(*[c for n, t in tools.items() for c in (F.lit(n), F.struct(texts(t.accepted).alias("accepted"), texts(t.required).alias("required"), F.lit(t.confirm).alias("confirm")))])
    return F.when(name.isNotNull(), F.try_element_at(table, name))


def read_outputs(calls: DataFrame, tools: dict[str, Tool], output: str = "output") -> DataFrame:
    """Adds ``event``: what an output asks for, as kind (answer, cut_off, unknown_tool, call), call (name and canonical
    arguments), declined (the user said no to a tool that asks), invalid (names of unexpected and missing arguments) and failed."""
    df = calls.withColumn("_call", tool_call(F.col(output))).withColumn("_tool", _described(F.col("_call.name"), tools))
    kind = F.when(F.col("_call").isNull(), F.when(F.coalesce(partial_tool_call(F.col(output)), F.lit(False)), "cut_off").otherwise("answer")).when(F.col("_tool").isNull(), "unknown_tool").otherwise("call")
    errors = argument_errors(F.coalesce(F.json_object_keys("_call.arguments"), F.array().cast("array<string>")), F.col("_tool.accepted"), F.col("_tool.required"))
    said = lambda name, of: F.when(F.size(of) > 0, F.concat(F.lit(f"{name} argument(s): "), F.array_join(of, ", ")))
    invalid = F.concat_ws("; ", said("unexpected", errors["unknown"]), said("missing required", errors["missing"]))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    event = F.struct(kind.alias("kind"), F.to_json(F.struct(F.col("_call.arguments").alias("args"), F.col("_call.name").alias("name"))).alias("call"), (flag("_tool.confirm") & flag("declined")).alias("declined"),
                     F.when(kind == "call", invalid).otherwise("").alias("invalid"), flag("failed").alias("failed"))
    return df.withColumn("event", event).drop("_call", "_tool")


def _next(state: Column, event: Column, budget: int) -> tuple[Column, Column]:
    """The action on an event and the state after it."""
    kind, call = event["kind"], event["call"]
    again = (kind == "call") & state["last_failed"] & state["last_call"].eqNullSafe(call)
    action = (
        F.when(state["over"], F.lit(None).cast("string"))
        .when(kind == "cut_off", F.when(state["nudged"], "answer").otherwise("nudge"))
        .when(kind != "call", kind)
        .when(again, F.when(state["warned"], "stop").otherwise("warn"))
        .when(event["declined"], "declined").when(event["invalid"] != "", "invalid")
        .when(event["failed"], "failed").otherwise("run"))
    tried = action.isin("declined", "invalid", "failed", "run")
    rounds = state["rounds"] + F.when(state["over"], 0).otherwise(1)
    after = F.struct(
        rounds.alias("rounds"), F.when(tried, call).otherwise(state["last_call"]).alias("last_call"), F.when(tried, action != "run").otherwise(state["last_failed"]).alias("last_failed"),
        (state["warned"] | F.coalesce(action == "warn", F.lit(False))).alias("warned"), (state["nudged"] | F.coalesce(action == "nudge", F.lit(False))).alias("nudged"),
        (state["over"] | action.isin("answer", "unknown_tool", "stop") | (rounds >= budget)).alias("over"))
    return action, after.cast(STATE)


def advance(calls: DataFrame, tools: dict[str, Tool], states: DataFrame | None = None, key: str = "session", order: str = "step", output: str = "output", budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """What becomes of each output of a session, and the states (key, state) after them.

    ``calls`` has key, order, output, declined (the user's answer, where a tool asks) and failed (of the execution; null: it
    went well). Actions: run, failed, declined, invalid (with ``problems``), nudge (a call cut off, for the first time), warn and
    stop (the call that failed last comes again, for the first and the second time), unknown_tool, answer; null after the end of
    a session and beyond its ``budget`` of rounds. ``states`` are those that earlier calls of the same sessions left.

    Only the first ``budget`` calls of a session can have an action: they are found by a window that each task limits before the
    shuffle, so a session of any length brings few rows together. Rows without key or order have no action. (key, order) names a
    call; of several rows with one name the least counts, and all get its action.
    """
    rows = ["output", "declined", "failed"]
    given = calls.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col(output).alias("output"), F.col("declined").cast("boolean"), F.col("failed").cast("boolean"))
    named = given.where(F.col("_key").isNotNull() & F.col("_order").isNotNull()).groupBy("_key", "_order").agg(F.min(F.struct(*rows)).alias("r")).select("_key", "_order", "r.*")
    first = named.withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy("_order"))).where(F.col("_rank") <= budget)
    events = read_outputs(first, tools).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_order", "event"))).alias("events"))  # ``budget`` at most
    fresh = F.struct(F.lit(0).alias("rounds"), F.lit(None).cast("string").alias("last_call"), *[F.lit(False).alias(c) for c in ("last_failed", "warned", "nudged", "over")]).cast(STATE)
    if states is not None:
        events = events.join(states.select(F.col(key).alias("_key"), "state"), "_key", "left")
        start = F.coalesce("state", fresh)
    else:
        start = fresh
    acted = F.array().cast("array<struct<at:" + calls.schema[order].dataType.simpleString() + ",action:string,problems:string>>")

    def step(acc: Column, e: Column) -> Column:
        action, after = _next(acc["state"], e["event"], budget)
        one = F.struct(e["_order"].alias("at"), action.alias("action"), F.when(action == "invalid", e["event"]["invalid"]).alias("problems"))
        return F.struct(after.alias("state"), F.concat(acc["acted"], F.array(one)).alias("acted"))

    folded = cut_lineage(events.select("_key", F.aggregate("events", F.struct(start.alias("state"), acted.alias("acted")), step).alias("f")))
    actions = folded.select("_key", F.explode("f.acted").alias("a")).select("_key", F.col("a.at").alias("_at"), "a.action", "a.problems")
    told = calls.join(actions, (calls[key] == F.col("_key")) & (calls[order] == F.col("_at")), "left").drop("_key", "_at")
    return told, folded.select(F.col("_key").alias(key), F.col("f.state").alias("state"))


def advance_stored(store: BucketStore, calls: DataFrame, tools: dict[str, Tool], batch: int, path: str, **how) -> bool:
    """One batch of calls against the states in a store with rows (session, state): the body of a ``foreachBatch``.

    The calls with their actions go to ``path``/batch=N, then the states are swapped in. A batch that is replayed before the
    states were written gives the same rows again; one that comes again later is passed over. Calls of a session must arrive in
    order over batches.
    """
    now = store.snapshot()
    if now["batch"] is not None and batch <= now["batch"]:
        return False
    told, states = advance(calls, tools, store.read(now), key=store.key[0], **how)
    told.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    changed = states.withColumn("rounds", F.col("state.rounds")).select(store.key[0], "rounds", "state")
    return store.merge(changed, newest(store.key, "rounds"), batch).applied
