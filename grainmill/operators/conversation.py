"""Conversations: trimming, request checks, guards, tool calls, routing and proxies of quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.ranges import round_exact
from ..functions.text import count_hints, strip


def trim_context(messages: DataFrame, key: str = "conv_id", order: str = "turn", most: int = 14) -> DataFrame:
    """The messages that fit: of longer conversations the system ones, the first real request, and the newest after it.

    Messages before that request are lost; at least one message after it stays. Adds ``place``, the new order.

    Counts and the request are found by an aggregation, the newest messages by a window that each task limits to ``most`` rows
    before the shuffle, so a conversation of any length brings few rows together; all its system messages stay.
    """
    system = F.col("role").isin("system", "developer")
    ask = (F.col("role") == "user") & ~F.coalesce(F.col("text").contains("<tool_result>"), F.lit(False))
    own = F.struct(F.col(key).alias("k"))  # never null, and not what the windows are dealt by, so that hot joins can be split
    counts = messages.groupBy(own.alias("_of")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(system).alias("_sys"), F.min(F.when(ask, F.col(order))).alias("_anchor"))
    df = messages.withColumn("_own", own).join(counts, F.col("_own") == F.col("_of")).drop("_own", "_of")
    long, first = F.col("_n") > most, F.coalesce(F.col(order) == F.col("_anchor"), F.lit(False))
    is_system = F.coalesce(system, F.lit(False))
    head = df.where(~long | is_system | first)
    after = ~system & (F.col("_anchor").isNull() | (F.col(order) > F.col("_anchor")))
    newest = df.where(long & after & ~first).withColumn("_back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_back") <= most)
    budget = F.greatest(F.lit(1), most - F.col("_sys") - F.when(F.col("_anchor").isNotNull(), 1).otherwise(0))
    kept = head.union(newest.where(F.col("_back") <= budget).drop("_back"))
    group = F.when(~long, 0).when(system, 0).otherwise(1)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(group, order))).drop("_n", "_sys", "_anchor")


def message_error(index: Column, role: Column, content: Column) -> Column:
    """What is wrong with a message of a request, null if nothing is."""
    at = F.concat(F.lit("messages["), index.cast("string"), F.lit("]"))
    return F.when(~F.coalesce(role.isin("system", "developer", "user", "assistant"), F.lit(False)), F.concat(at, F.lit(".role must be system, user, or assistant"))).when(content.isNull(), F.concat(at, F.lit(".content must be a string")))


def request_parameters(temperature: Column, top_p: Column, max_tokens: Column) -> Column:
    """Struct of error and of the values with defaults and caps."""
    t, p, m = F.coalesce(temperature, F.lit(0.3)), F.coalesce(top_p, F.lit(0.9)), F.coalesce(max_tokens, F.lit(4096))
    error = F.when((t < 0) | (t > 2), "temperature must be between 0 and 2").when((p <= 0) | (p > 1), "top_p must be between 0 and 1").when(m < 1, "max_tokens must be at least 1")
    return F.struct(error.alias("error"), t.alias("temperature"), p.alias("top_p"), F.least(m, F.lit(16384)).alias("max_tokens"))


def attack_reason(text: Column) -> Column:
    """The reason of the first pattern that a request matches, null if none."""
    low = F.lower(text)
    return reduce(lambda a, p: a.when(low.rlike(p[0]), p[1]), R.ATTACKS[1:], F.when(low.rlike(R.ATTACKS[0][0]), R.ATTACKS[0][1]))


_SECRET = "|".join(R.SECRETS)


def scrub_secrets(text: Column) -> Column:
    """Each secret as its first twelve characters in a note. Every pattern is at least that long, so a look-ahead sees them.

    Texts without any, nearly all, are searched once and left as they are.
    """
    return F.when(text.rlike(_SECRET), F.regexp_replace(text, rf"(?=[spgAxeB-])(?=([\s\S]{{1,12}}))(?:{_SECRET})", r"[REDACTED: $1]")).otherwise(text)


def count_secrets(text: Column) -> Column:
    return F.when(text.rlike(_SECRET), F.regexp_count(text, F.lit(_SECRET))).when(text.isNotNull(), 0).cast("long")


def tool_call(text: Column) -> Column:
    """Struct (name, arguments as canonical JSON) between the first tags; null unless well-formed."""
    start, end = F.instr(text, "<tool_call>"), F.instr(text, "</tool_call>")
    payload = F.when((start > 0) & (end > start), strip(F.substring(text, start + 11, end - start - 11)))
    data = F.try_parse_json(payload)
    get = lambda path, kind: F.try_variant_get(data, path, kind)
    is_text = F.schema_of_variant(F.try_variant_get(data, "$.name", "variant")) == "STRING"
    arguments = get("$.arguments", "variant")
    given = F.when(arguments.isNull(), F.lit("{}")).when(F.schema_of_variant(arguments).startswith("OBJECT"), F.to_json(arguments))
    good = is_text & F.schema_of_variant(data).startswith("OBJECT") & given.isNotNull()
    return F.when(good, F.struct(get("$.name", "string").alias("name"), given.alias("arguments")))


def partial_tool_call(text: Column) -> Column:
    """Whether a tool call was opened and not closed after that."""
    start, end = F.instr(text, "<tool_call>"), F.instr(text, "</tool_call>")
    return (start > 0) & (end < start)


def repeated_failing_calls(calls: DataFrame, key: str = "session", order: str = "step") -> DataFrame:
    """Adds ``repeated``: the same call as the one before it, which failed."""
    w = Window.partitionBy(key).orderBy(order)
    same = (F.lag("name").over(w) == F.col("name")) & (F.lag("arguments").over(w) == F.col("arguments"))
    return calls.withColumn("repeated", F.coalesce(same & ~F.lag("ok").over(w), F.lit(False)))


def argument_errors(given: Column, accepted: Column, required: Column) -> Column:
    """Struct of unknown and of missing argument names, each sorted."""
    return F.struct(F.array_sort(F.array_except(given, accepted)).alias("unknown"), F.array_sort(F.array_except(required, given)).alias("missing"))


def _first_best(low: Column, hints: dict[str, tuple[str, ...]], otherwise: str) -> Column:
    counts = {k: count_hints(low, v) for k, v in hints.items()}
    most = F.greatest(*counts.values())
    return reduce(lambda a, kv: a.when(kv[1] == most, kv[0]), counts.items(), F.when(most == 0, otherwise))


def detect_domain(text: Column) -> Column:
    return _first_best(F.lower(F.coalesce(text, F.lit(""))), R.DOMAIN_HINTS, "general")


def detect_category(text: Column) -> Column:
    return _first_best(F.lower(F.coalesce(text, F.lit(""))), R.CATEGORY_HINTS, "general_chat")


def is_code_task(text: Column) -> Column:
    low = F.lower(text)
    return (count_hints(low, R.CODE_MARKERS) >= 2) | low.rlike(R.CODE_STRUCTURE)


def default_score(text: Column) -> Column:
    """A cheap proxy of quality from length and structure, to two decimals; blank texts have -100."""
    plain = strip(text)
    low = F.lower(text)
    words = F.size(F.split(plain, r"[\t-\r\x1c-\x20\x85\xa0]+"))
    score = F.least(words / F.lit(120.0), F.lit(3.0))
    signs = [(text.contains(m), gain) for m, gain in R.GOOD_SIGNS] + [(text.rlike(r"\p{Nd}"), 0.25)]
    for test, gain in (*signs, *[(low.contains(b), -1.5) for b in R.BAD_WORDS], (plain.endswith("?") | plain.endswith("..."), -1.0)):
        score = score + F.when(test, gain).otherwise(0.0)
    return F.when(F.coalesce(F.length(plain), F.lit(0)) == 0, -100.0).otherwise(round_exact(score))


def large_code_block(text: Column, least: int = 3000) -> Column:
    """Struct (lang, code) of the last fenced block of ``least`` characters or more."""
    pattern = r"(?s)```([a-zA-Z0-9_]+)?\s*\n(.*?)```"
    blocks = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("lang"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("code"))
    large = F.filter(blocks, lambda b: F.length(b["code"]) >= least)
    return F.when(F.size(large) > 0, F.element_at(large, -1))


def saved_extension(language: Column) -> Column:
    """The extension under which a block of code is saved."""
    return F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in R.SAVED_AS.items() for x in kv]), lambda k, v: k == language)), F.lit(0)), F.lit("txt"))


def server_event(payload: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))


def server_delta(ident: Column, created: Column, model: Column, text: Column, role: Column, finish: Column) -> Column:
    """An event with a piece of a streamed answer: its role and content where given, and whether the answer ends."""
    filled = lambda c: F.nullif(c, F.lit(""))
    reason = F.when(finish, F.lit('"stop"')).otherwise(F.lit("null"))  # an explicit null, which to_json would leave out
    head = F.to_json(F.struct(ident.alias("id"), F.lit("chat.completion.chunk").alias("object"), created.alias("created"), model.alias("model")))
    delta = F.to_json(F.struct(filled(role).alias("role"), filled(text).alias("content")))
    return F.concat(F.lit("data: "), F.left(head, F.length(head) - 1), F.lit(',"choices":[{"index":0,"delta":'), delta, F.lit(',"finish_reason":'), reason, F.lit("}]}\n\n"))


def trim_result(text: Column, limit: int = 20000) -> Column:
    """The end of a long tool result, marked as trimmed."""
    return F.when(F.length(text) > limit, F.concat(F.lit("[trimmed] ... "), F.right(text, F.lit(limit)))).otherwise(text)


def call_flow(calls: DataFrame, key: str = "session", order: str = "step", budget: int = 6) -> DataFrame:
    """Adds ``action`` to the calls of sessions: run, warn (the call that failed last is repeated, for the first time), stop
    (for the second time), or null for what comes after a stop or beyond the budget of rounds."""
    w = Window.partitionBy(key).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    other = ~(F.lag("name").over(w).eqNullSafe(F.col("name")) & F.lag("arguments").over(w).eqNullSafe(F.col("arguments")))
    df = calls.withColumns({"_place": F.row_number().over(w), "_run": F.sum(other.cast("int")).over(so_far)})
    last = F.last("ok", ignorenulls=True).over(Window.partitionBy(key, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_again", F.coalesce(~last, F.lit(False)) & F.col("name").isNotNull())
    df = df.withColumn("_nth", F.sum(F.col("_again").cast("int")).over(so_far))
    stopped = F.coalesce(F.max(F.when(F.col("_again") & (F.col("_nth") >= 2), 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    action = F.when(stopped | (F.col("_place") > budget), None).when(~F.col("_again"), "run").when(F.col("_nth") == 1, "warn").otherwise("stop")
    return df.withColumn("action", action).drop("_place", "_run", "_again", "_nth")
