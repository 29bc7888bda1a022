"""Queries that keep something between batches: sessions, stores, labels and indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage, shared_folder, spread
from ..operators import curation as C
from ..operators import sessions as A
from ..operators import text_index as T
from ..sources import store as K
from ..streaming import dedup as D
from . import sql as S
from .curation_queries import cand, table

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def _part(key: str, parts: int = 3) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


#: What a turn's output is made to ask for, by a number from 0 to 9; the turn's own text stands before or after it.
TOOLS = {"read": A.Tool(("path", "limit"), ("path",)), "write": A.Tool(("path", "text"), ("path", "text"), True), "list": A.Tool()}
_ASKS = (
    '<tool_call>{"name": "read", "arguments": {"path": "f1"}}</tool_call>', '<tool_call>{"arguments": {"path": "f1", "limit": 3}, "name": "read"}</tool_call>', '<tool_call>{"name": "read", "arguments": {"path": "f1", "mode": 1}}</tool_call>',
    '<tool_call>{"name": "write", "arguments": {"text": "t", "path": "a"}}</tool_call>', '<tool_call>{"name": "write", "arguments": {"path": "a"}}</tool_call>', '<tool_call>{"name": "read"', '<tool_call>{"name": "dance", "arguments": {}}</tool_call>', "no call",
    '<tool_call>{"name": "list"}</tool_call>', '<tool_call>{"name": "read", "arguments": {"limit": 3, "path": "f1"}}</tool_call>')
_NUMBER = "(conv_id + (turn // 3) * 7) % 10"


def session_calls(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of ``conversations`` as the output of a model in a session of its own conversation."""
    n = ((F.col("conv_id") + F.floor(F.col("turn") / 3) * 7) % 10).cast("int")
    ask = F.element_at(F.array(*map(F.lit, _ASKS)), n + 1)
    output = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), ask)
    return spread(table(spark, d, "conversations")).select(F.col("conv_id").alias("session"), F.col("turn").alias("step"), output.alias("output"), (F.col("conv_id") % 2 == 0).alias("declined"), ((F.col("conv_id") + F.col("turn")) % 3 != 0).alias("failed"))


_asks = " ".join(f"WHEN {i} THEN {S.q(a)}" for i, a in enumerate(_ASKS))
_ACTION = """CASE WHEN s.ended THEN NULL WHEN cut_off THEN CASE WHEN nudged THEN 'answer' ELSE 'nudge' END WHEN name IS NULL THEN 'answer' WHEN name NOT IN ('read', 'write', 'list') THEN 'unknown_tool'
 WHEN last_failed AND last_call = call THEN CASE WHEN warned THEN 'stop' ELSE 'warn' END WHEN name = 'write' AND declined THEN 'declined' WHEN problems <> '' THEN 'invalid' WHEN failed THEN 'failed' ELSE 'run' END"""
_SESSIONS = f"""
WITH RECURSIVE raw AS (SELECT conv_id AS session, turn AS step, coalesce(text, '') || chr(10) || CASE {_NUMBER} {_asks} END AS output, conv_id % 2 = 0 AS declined, (conv_id + turn) % 3 <> 0 AS failed FROM conversations),
opened AS (SELECT *, instr(output, '<tool_call>') AS a, instr(output, '</tool_call>') AS b FROM raw),
parsed AS (SELECT *, a > 0 AND b < a AS cut_off, CASE WHEN a > 0 AND b > a THEN trim(substr(output, a + 11, b - a - 11))::JSON END AS v FROM opened),
args AS (SELECT session, step, v, declined, failed, cut_off, json_extract_string(v, '$.name') AS name, coalesce(list_sort(json_keys(v, '$.arguments')), []) AS given FROM parsed),
checked AS (SELECT *, name || ' ' || coalesce(list_aggregate(list_transform(given, lambda k: k || '=' || json_extract(v, '$.arguments.' || k)::VARCHAR), 'string_agg', ','), '') AS call,
 CASE name WHEN 'read' THEN ['path', 'limit'] WHEN 'write' THEN ['path', 'text'] ELSE [] END AS accepted, CASE name WHEN 'read' THEN ['path'] WHEN 'write' THEN ['path', 'text'] ELSE [] END AS required FROM args),
told AS (SELECT *, list_filter(given, lambda g: NOT list_contains(accepted, g)) AS odd, list_sort(list_filter(required, lambda g: NOT list_contains(given, g))) AS gone FROM checked),
event AS (SELECT session, step, cut_off, name, call, declined, failed, concat_ws('; ', CASE WHEN len(odd) > 0 THEN 'unexpected argument(s): ' || array_to_string(odd, ', ') END,
 CASE WHEN len(gone) > 0 THEN 'missing required argument(s): ' || array_to_string(gone, ', ') END) AS problems, row_number() OVER (PARTITION BY session ORDER BY step) AS place FROM told),
walk AS (SELECT session, 0::BIGINT AS place, NULL::BIGINT AS step, NULL::VARCHAR AS action, NULL::VARCHAR AS why, NULL::VARCHAR AS last_call, false AS last_failed, false AS warned, false AS nudged, false AS ended FROM (SELECT DISTINCT session FROM event)
 UNION ALL SELECT session, place, step, action, CASE WHEN action = 'invalid' THEN problems END, CASE WHEN tried THEN call ELSE last_call END, CASE WHEN tried THEN action <> 'run' ELSE last_failed END, warned OR coalesce(action = 'warn', false), nudged OR coalesce(action = 'nudge', false),
 ended OR coalesce(action IN ('answer', 'unknown_tool', 'stop'), false) OR place >= {A.BUDGET}
 FROM (SELECT *, coalesce(action IN ('declined', 'invalid', 'failed', 'run'), false) AS tried FROM (SELECT e.session, e.place, e.step, e.call, e.problems, s.last_call, s.last_failed, s.warned, s.nudged, s.ended, {_ACTION} AS action FROM walk s JOIN event e ON e.session = s.session AND e.place = s.place + 1)))
SELECT session, step, action, why AS problems FROM walk WHERE place > 0"""


@query("session_actions", _SESSIONS)
def _(spark, d):
    return A.advance(session_calls(spark, d), TOOLS)[0].select("session", "step", "action", "problems")


@query("session_actions_in_batches", _SESSIONS)
def _(spark, d):
    """The same sessions, cut into three batches of turns, with the states in a store between them; the second batch comes twice."""
    calls, folder = session_calls(spark, d), _folder(spark, "sessions")
    store = K.BucketStore(spark, f"{folder}/states", ("session",), 8)
    for batch, (low, high) in enumerate(((0, 2), (2, 3), (2, 3), (3, 1 << 62))):
        A.advance_stored(store, calls.where((F.col("step") >= low) & (F.col("step") < high)), TOOLS, min(batch, 1) if batch < 3 else 2, f"{folder}/told")
    return spark.read.parquet(f"{folder}/told").select("session", "step", "action", "problems")


@query("value_store", "SELECT category AS namespace, key, max(updated_at) AS updated_at, arg_max(value, (updated_at, value)) AS value FROM (SELECT 'lang' AS category, coalesce(lang, '') || ':' || source AS key, n_chars AS updated_at, 'doc ' || doc_id AS value FROM documents) GROUP BY ALL")
def _(spark, d):
    """Documents as saves of values under (language, source), in three batches that arrive out of order, one of them twice."""
    docs = spread(table(spark, d, "documents"))
    saves = docs.select(F.lit("lang").alias("namespace"), F.concat(F.coalesce("lang", F.lit("")), F.lit(":"), "source").alias("key"), F.col("n_chars").alias("updated_at"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("value"), _part("doc_id").alias("part"))
    store = K.value_store(spark, _folder(spark, "values"), 8)
    for batch, part in ((1, 2), (2, 0), (2, 0), (3, 1)):
        K.save_values(store, saves.where(F.col("part") == part), batch)
    return store.read()


_FIRSTS = f"WITH {S.CAND}, {S.HASHED}, firsts AS (SELECT instruction_hash, min(ord) AS first_ord, arg_min(id, ord) AS first_id, arg_min(content_hash, ord) AS first_hash FROM hashed GROUP BY instruction_hash)"


@query("incremental_dedup", f"{_FIRSTS} SELECT ord, id, CASE WHEN ord = first_ord THEN NULL WHEN content_hash = first_hash THEN 'exact' ELSE 'near_instruction' END AS duplicate_type, CASE WHEN ord <> first_ord THEN first_id END AS duplicate_of FROM hashed JOIN firsts USING (instruction_hash)")
def _(spark, d):
    """All candidates in four batches; the smallest ordinals come last, so that rows which were kept become duplicates."""
    rows = cut_lineage(C.with_fingerprints(cand(spark, d)).select("ord", "id", "content_hash", "instruction_hash"))  # texts are read and hashed once
    store = D.label_store(spark, _folder(spark, "labels"), 8)
    for batch in range(4):
        D.add_batch(store, rows.where(3 - _part("ord", 4) == batch), batch)
    return store.read().select("ord", "id", "duplicate_type", "duplicate_of")


def _indexed(spark: SparkSession, files: DataFrame, key: str, with_places: bool) -> K.BucketStore:
    """An index of all files, one in nine of them first with an older text that the update replaces."""
    store = T.index_store(spark, _folder(spark, "grams"), 64)
    T.update_index(store, files.where(_part(key, 9) == 0).withColumn("text", F.lit("the older license version")), 1, key=key, with_places=with_places)
    T.update_index(store, files, 2, key=key, with_places=with_places)
    return store


_TERMS = sorted({"the", "license", "version"})
_REL = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)}" for t in _TERMS)


@query("memory_index_top8", f"SELECT doc_id, ({_REL})::BIGINT AS score, sha256(left(text, 8000)) AS content_sha FROM documents WHERE {_REL} > 0 ORDER BY score DESC, doc_id LIMIT 8")
def _(spark, d):
    docs = spread(table(spark, d, "documents"))
    return T.search_indexed(_indexed(spark, docs, "doc_id", True), docs, "the License version of", key="doc_id").select("doc_id", "score", F.sha2("content", 256).alias("content_sha"))


_PATTERN = r"^(Licensed|Released) .*\b(MIT|Apache)\b"


@query("code_index_search", rf"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents) SELECT 'doc/' || doc_id AS path, line, sha256(line_text) AS line_sha FROM l WHERE regexp_matches(line_text, '{_PATTERN}')")
def _(spark, d):
    files = spread(table(spark, d, "documents")).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text")
    return T.search_indexed_lines(_indexed(spark, files, "path", False), files, _PATTERN).select("path", "line", F.sha2("text", 256).alias("line_sha"))
