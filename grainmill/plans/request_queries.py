"""Queries over chat requests and over events in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import spread
from ..operators import requests as Q
from ..streaming import sessions as E
from . import sql as S
from .curation_queries import table

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return add


#: Bodies that turns of conversations arrive in, right and broken ones; @R and @T stand for the turn's role and text as JSON.
_ONE = '{"messages": [{"role": @R, "content": @T}]'
BODIES = (
    _ONE + "}", _ONE + ', "temperature": 0.1, "top_p": 0.8, "max_tokens": 128, "stream": true, "model": "m-4b"}', _ONE + ', "temperature": " 1.5 ", "top_p": "1", "max_tokens": "12"}', _ONE + ', "max_tokens": 10000000, "stream": "false"}',
    _ONE + ', "max_tokens": null, "max_completion_tokens": 77.9, "model": ""}', _ONE + ', "temperature": null}', _ONE + ', "temperature": "hot", "top_p": 0}', _ONE + ', "temperature": 9, "max_tokens": 0}', _ONE + ', "top_p": 0}', _ONE + ', "max_tokens": 0.9}', _ONE + ', "max_tokens": "3.5"}',
    _ONE + ', "temperature": true, "stream": 0, "model": null}', _ONE + ', "top_p": "nan"}', _ONE + ', "top_p": [1]}', _ONE, '{"messages": [{"role": "developer", "content": @T}, {"role": @R, "content": "go on"}], "stream": []}', '{"messages": [{"role": "system", "content": "be brief"}, {"role": "tool", "content": @T}, 5]}',
    '{"messages": [{"role": @R, "content": @T}, [@T]]}', '{"messages": [{"role": @R, "content": [@T]}]}', '{"messages": [{"content": @T}]}', '{"messages": @T}', '{"messages": []}', '{"prompt": @T}', "[@T]", "@T", "", "null")


def request_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of ``conversations`` as a request of its own, in one of ``BODIES``."""
    quoted = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.expr(f"substr(to_json(struct({c} AS x)), 6, length(to_json(struct({c} AS x))) - 6)"))
    turns = spread(table(spark, d, "conversations")).select("conv_id", "turn", quoted("role").alias("_r"), quoted("text").alias("_t"))
    shape = F.element_at(F.array(*map(F.lit, BODIES)), ((F.col("conv_id") * 7 + F.col("turn")) % len(BODIES) + 1).cast("int"))
    return turns.select("conv_id", "turn", F.replace(F.replace(shape, F.lit("@R"), F.col("_r")), F.lit("@T"), F.col("_t")).alias("body"))


_real = lambda path: f"""CASE json_type(v, '{path}') WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(trim(v ->> '{path}'), '[+-]?[0-9]+([.][0-9]+)?') THEN (v ->> '{path}')::DOUBLE WHEN trim(v ->> '{path}') = 'nan' THEN -1 END
 WHEN 'BOOLEAN' THEN (v ->> '{path}')::BOOLEAN::INT WHEN 'ARRAY' THEN NULL WHEN 'OBJECT' THEN NULL WHEN 'NULL' THEN NULL ELSE (v ->> '{path}')::DOUBLE END"""  # noqa: E731
_whole = lambda path: f"CASE json_type(v, '{path}') WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(trim(v ->> '{path}'), '[0-9]+') THEN (v ->> '{path}')::DOUBLE END ELSE trunc((v ->> '{path}')::DOUBLE) END"
_there = lambda path: f"coalesce(json_type(v, '{path}'), 'NULL') <> 'NULL'"
_holds = lambda path: f"coalesce(CASE json_type(v, '{path}') WHEN 'NULL' THEN false WHEN 'BOOLEAN' THEN (v ->> '{path}')::BOOLEAN WHEN 'VARCHAR' THEN (v ->> '{path}') <> '' WHEN 'ARRAY' THEN json_array_length(v, '{path}') > 0 ELSE (v ->> '{path}')::DOUBLE <> 0 END, false)"
_at = "'messages[' || (i - 1) || ']'"
_BODY = f"""
WITH shapes AS (SELECT unnest([{', '.join(map(S.q, BODIES))}]) AS shape, unnest(range({len(BODIES)})) AS nth),
raw AS (SELECT conv_id, turn, replace(replace(shape, '@R', coalesce(to_json(role)::VARCHAR, 'null')), '@T', coalesce(to_json(text)::VARCHAR, 'null')) AS body FROM conversations JOIN shapes ON nth = (conv_id * 7 + turn) % {len(BODIES)}),
parsed AS (SELECT *, CASE WHEN json_valid(body) THEN body::JSON END AS v FROM raw),
opened AS (SELECT *, CASE WHEN json_type(v, '$.messages') = 'ARRAY' THEN json_extract(v, '$.messages[*]') END AS items, CASE WHEN v IS NOT NULL AND json_exists(v, '$.temperature') THEN {_real('$.temperature')} ELSE 0.3 END AS t, CASE WHEN json_exists(v, '$.top_p') THEN {_real('$.top_p')} ELSE 0.9 END AS p,
 CASE WHEN {_there('$.max_tokens')} THEN {_whole('$.max_tokens')} WHEN {_there('$.max_completion_tokens')} THEN {_whole('$.max_completion_tokens')} ELSE 4096 END AS m FROM parsed),
checked AS (SELECT *, list_filter(list_transform(items, lambda x, i: CASE WHEN json_type(x) <> 'OBJECT' THEN {_at} || ' must be an object'
  WHEN coalesce(json_type(x, '$.role'), '') <> 'VARCHAR' OR (x ->> '$.role') NOT IN ('system', 'developer', 'user', 'assistant') THEN {_at} || '.role must be system, user, or assistant'
  WHEN coalesce(json_type(x, '$.content'), '') <> 'VARCHAR' THEN {_at} || '.content must be a string' END), lambda e: e IS NOT NULL) AS bad FROM opened),
told AS (SELECT *, CASE WHEN body = '' THEN 'empty request body' WHEN v IS NULL THEN 'request body must be valid JSON' WHEN json_type(v) <> 'OBJECT' THEN 'request body must be a JSON object' WHEN coalesce(len(items), 0) = 0 THEN 'messages must be a non-empty list'
 WHEN len(bad) > 0 THEN bad[1] WHEN t IS NULL OR p IS NULL OR m IS NULL THEN 'temperature, top_p and max_tokens must be numbers' WHEN t < 0 OR t > 2 THEN 'temperature must be between 0 and 2' WHEN p <= 0 OR p > 1 THEN 'top_p must be between 0 and 1'
 WHEN m < 1 THEN 'max_tokens must be at least 1' END AS error FROM checked)
SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN CASE WHEN {_holds('$.model')} THEN v ->> '$.model' ELSE 'local' END END AS model, CASE WHEN error IS NULL THEN t END AS temperature, CASE WHEN error IS NULL THEN p END AS top_p,
 CASE WHEN error IS NULL THEN least(m, 16384)::BIGINT END AS max_tokens, CASE WHEN error IS NULL THEN {_holds('$.stream')} END AS stream,
 CASE WHEN error IS NULL THEN array_to_string(list_transform(items, lambda x: replace(x ->> '$.role', 'developer', 'user')), ',') END AS roles, CASE WHEN error IS NULL THEN sha256(array_to_string(list_transform(items, lambda x: x ->> '$.content'), chr(10))) END AS content_sha FROM told"""


@query("chat_requests", _BODY)
def _(spark, d):
    told = Q.parse_requests(request_bodies(spark, d), "local")
    each = lambda field: F.transform("messages", lambda m: m[field])
    return told.select("conv_id", "turn", "error", "model", "temperature", "top_p", F.col("max_tokens").cast("long").alias("max_tokens"), "stream", F.array_join(each("role"), ",").alias("roles"), F.sha2(F.array_join(each("content"), "\n"), 256).alias("content_sha"))


_SESSION = """
WITH marked AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, false)::INT AS opens FROM events WHERE ts IS NOT NULL),
placed AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, min(ts)::VARCHAR AS first_at, max(ts)::VARCHAR AS last_at, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_errors, max(value) AS highest FROM placed GROUP BY user_id, s"""


@query("event_sessions", _SESSION)
def _(spark, d):
    found = E.event_sessions(spread(table(spark, d, "events")))
    return found.select("user_id", F.col("first_ts").cast("string").alias("first_at"), F.col("last_ts").cast("string").alias("last_at"), "n", "n_errors", "highest")


def events_as_runs(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events as tasks, those with an even number, and as results, those with an odd one that say nothing of an error: such a
    result is of a task up to 62 events before it, so that some come too late."""
    tasks = events.where("event_id % 2 = 0").select(F.col("event_id").alias("task"), F.col("ts").alias("started"))
    of = F.col("event_id") - 1 - 2 * (F.floor(F.col("event_id") / 2) * 37 % 32)
    return tasks, events.where("event_id % 2 = 1 and event_type <> 'error'").select(of.alias("task"), F.col("ts").alias("finished"), (F.col("value") > 5).alias("pass"))


_RESULTS = """
WITH t AS (SELECT event_id AS task, ts AS started FROM events WHERE event_id % 2 = 0),
r AS (SELECT event_id - 1 - 2 * (event_id // 2 * 37 % 32) AS task, ts AS finished, value > 5 AS pass FROM events WHERE event_id % 2 = 1 AND event_type <> 'error')
SELECT t.task, finished::VARCHAR AS finished_at, pass FROM t LEFT JOIN r ON t.task = r.task AND finished BETWEEN started AND started + INTERVAL 1 HOUR"""


@query("task_results", _RESULTS)
def _(spark, d):
    found = E.task_results(*events_as_runs(spread(table(spark, d, "events"))))
    return found.select("task", F.col("finished").cast("string").alias("finished_at"), "pass")
