"""Sessions, the bucket store, deduplication with retraction and the trigram index, against plain versions."""

import glob
import json
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from grainmill.operators import repository, sessions, text_index
from grainmill.operators.curation import deduplicate, with_fingerprints
from grainmill.plans import stateful_queries as Q
from grainmill.plans.curation_queries import cand, table
from grainmill.sources import store as K
from grainmill.streaming import dedup

CALLS = "session string, step bigint, output string, declined boolean, failed boolean"


def plain_session(events, budget=6):
    """The loop, one output after the other."""
    actions, last, last_failed, warned, nudged = [], None, False, False, False
    for k, (output, declined, failed) in enumerate(events):
        if k >= budget or actions and actions[-1] in (None, "answer", "unknown_tool", "stop"):
            actions.append(None)
            continue
        start, end = output.find("<tool_call>"), output.find("</tool_call>")
        call = None
        if start >= 0 and end > start:
            try:
                call = json.loads(output[start + 11 : end])
            except ValueError:
                call = None
            if not (isinstance(call, dict) and isinstance(call.get("name"), str) and isinstance(call.get("arguments", {}), dict)):
                call = None
        if call is None:
            if start >= 0 and end < start and not nudged:
                nudged = True
                actions.append("nudge")
            else:
                actions.append("answer")
            continue
        tool, given = Q.TOOLS.get(call["name"]), call.get("arguments", {})
        if tool is None:
            actions.append("unknown_tool")
            continue
        key = json.dumps([call["name"], given], sort_keys=True)
        if key == last and last_failed:
            actions.append("stop" if warned else "warn")
            warned = True
            continue
        last = key
        if tool.confirm and declined:
            actions.append("declined")
        elif set(given) - set(tool.accepted) or set(tool.required) - set(given):
            actions.append("invalid")
        else:
            actions.append("failed" if failed else "run")
        last_failed = actions[-1] != "run"
    return actions


def random_sessions(seed, n=60, most=9):
    rng = random.Random(seed)
    pool = [*Q._ASKS, '<tool_call>{"name": 5}</tool_call>', "<tool_call>[1]</tool_call>", "</tool_call> <tool_call>{", ""]
    return {f"s{k}": [(rng.choice(pool[: rng.choice((3, 6, len(pool)))]), rng.random() < 0.5, rng.random() < 0.6) for _ in range(rng.randint(1, most))] for k in range(n)}


@pytest.mark.parametrize("seed", range(2))
def test_actions_of_a_plain_loop(spark, seed):
    held = random_sessions(seed)
    rows = [(s, i, *e) for s, events in held.items() for i, e in enumerate(events)]
    random.Random(seed).shuffle(rows)
    told, states = sessions.advance(spark.createDataFrame(rows, CALLS), Q.TOOLS)
    got = {(r["session"], r["step"]): r["action"] for r in told.collect()}
    want = {(s, i): a for s, events in held.items() for i, a in enumerate(plain_session(events))}
    assert got == want
    assert set(want.values()) == {"run", "failed", "declined", "invalid", "nudge", "warn", "stop", "unknown_tool", "answer", None}
    assert states.count() == len(held)


def test_sessions_in_batches(spark, tmp_path):
    """Any cut of sessions into batches gives the same actions; a batch that comes again changes nothing."""
    held, rng = random_sessions(5, 40), random.Random(9)
    cuts = {s: sorted(rng.randint(0, len(e)) for _ in range(2)) for s, e in held.items()}
    store = K.BucketStore(spark, f"{tmp_path}/states", ("session",), 4)
    for batch in range(3):
        rows = [(s, i, *e) for s, events in held.items() for i, e in enumerate(events) if sum(i >= c for c in cuts[s]) == batch]
        df = spark.createDataFrame(rows, CALLS)
        assert sessions.advance_stored(store, df, Q.TOOLS, batch, f"{tmp_path}/told")
        assert not sessions.advance_stored(store, df, Q.TOOLS, batch, f"{tmp_path}/told")
    got = {(r["session"], r["step"]): r["action"] for r in spark.read.parquet(f"{tmp_path}/told").collect()}
    assert got == {(s, i): a for s, events in held.items() for i, a in enumerate(plain_session(events))}


def test_odd_calls(spark):
    read = Q._ASKS[0]
    rows = [("a", 1, None, None, None), (None, 1, read, None, None), ("b", None, read, None, None), ("c", 1, read, None, None), ("c", 1, read, None, None), ("c", 2, read, None, True)]
    got = sorted((str(r["session"]), str(r["step"]), r["action"]) for r in sessions.advance(spark.createDataFrame(rows, CALLS), Q.TOOLS)[0].collect())
    assert got == sorted([("a", "1", "answer"), ("None", "1", None), ("b", "None", None), ("c", "1", "run"), ("c", "1", "run"), ("c", "2", "failed")])
    assert sessions.advance(spark.createDataFrame([], CALLS), Q.TOOLS)[0].count() == 0


def test_a_long_session_is_cut_before_the_shuffle(spark):
    calls = spark.range(200_000).select(F.lit("hot").alias("session"), F.col("id").alias("step"), F.lit(Q._ASKS[8]).alias("output"), F.lit(False).alias("declined"), F.lit(False).alias("failed"))
    told, _ = sessions.advance(calls, Q.TOOLS)
    assert told.where("action is not null").count() == sessions.BUDGET and told.count() == 200_000


VALUES = "namespace string, key string, updated_at bigint, value string"


def held(store):
    return sorted((tuple(r) for r in store.read().collect()), key=str)


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    store = K.value_store(spark, str(tmp_path), 8)
    assert store.read() is None and K.load_value(store, "a", "b", "none") == "none"
    assert K.save_values(store, spark.createDataFrame([("n", f"k{i}", 1, "old") for i in range(40)], VALUES), 1)
    files = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{tmp_path}/data/**/*.parquet", recursive=True)}
    before = set(store.paths())
    assert K.save_values(store, spark.createDataFrame([("n", "k3", 5, "new"), ("n", "k3", 5, "newer"), ("n", "k3", 2, "zz"), ("n", "k4", 0, "late")], VALUES), 2)
    changed = before - set(store.paths())
    assert 1 <= len(changed) <= 2 and len(store.paths()) == len(before)
    assert {p: os.stat(p).st_mtime_ns for p in files} == files  # readers of the older version are not disturbed
    assert K.load_value(store, "n", "k3") == "newer" and K.load_value(store, "n", "k4") == "old" and K.load_value(store, "n", "x", "-") == "-"
    rows, names = held(store), set(glob.glob(f"{tmp_path}/**", recursive=True))
    assert not K.save_values(store, spark.createDataFrame([("n", "k3", 9, "replayed")], VALUES), 2)
    assert held(store) == rows and set(glob.glob(f"{tmp_path}/**", recursive=True)) == names
    assert store.vacuum() == len(changed) and held(store) == rows and store.vacuum() == 0


def test_store_after_a_failed_merge(spark, tmp_path):
    store = K.value_store(spark, str(tmp_path), 4)
    K.save_values(store, spark.createDataFrame([("n", "a", 1, "x")], VALUES), 1)
    rows = held(store)

    def fails(before, changes):
        return K.both(before, changes).withColumn("value", F.raise_error(F.lit("broken")).cast("string"))

    with pytest.raises(Exception, match="broken"):
        store.merge(spark.createDataFrame([("n", "a", 2, "y")], VALUES), fails, 2)
    assert held(store) == rows
    assert K.save_values(store, spark.createDataFrame([("n", "a", 2, "y"), (None, None, None, None)], VALUES), 2) and held(store) == [("n", "a", 2, "y"), (None, None, None, None)]
    assert K.save_values(store, spark.createDataFrame([], VALUES), 3) and store.snapshot()["batch"] == 3
    store._names = lambda path: [n for n in K.BucketStore._names(store, path) if not n.startswith(f"{3:012d}")]  # a writer that hasn't seen the last commit
    with pytest.raises(RuntimeError, match="another writer"):
        K.save_values(store, spark.createDataFrame([("n", "a", 9, "z")], VALUES), 4)


@pytest.mark.parametrize("seed", range(2))
def test_any_split_gives_the_labels_of_one_run(spark, sf_dir, tmp_path, seed):
    rows = with_fingerprints(cand(spark, sf_dir)).select("ord", "id", "content_hash", "instruction_hash").collect()
    extra = [(10_000 + i, None if i % 2 else f"x{i}", r["content_hash"] if i % 3 else "other", r["instruction_hash"]) for i, r in enumerate(rows[:30])]
    rows = [*map(tuple, rows), *extra, (-1, "first", rows[0]["content_hash"], rows[0]["instruction_hash"])]
    random.Random(seed).shuffle(rows)
    schema = "ord bigint, id string, content_hash string, instruction_hash string"
    store, told = dedup.label_store(spark, str(tmp_path), 4), {}
    for batch in range(3):
        part = spark.createDataFrame(rows[batch::3], schema)
        changed = dedup.add_batch(store, part, batch).collect()
        assert {r["ord"] for r in changed if r["arrived"]} == {r[0] for r in rows[batch::3]}
        for r in changed:
            assert r["arrived"] or told[r["ord"]] == (r["was_type"], r["was_of"])
            told[r["ord"]] = (r["duplicate_type"], r["duplicate_of"])
        assert dedup.add_batch(store, part, batch) is None
    want = {r["ord"]: (r["duplicate_type"], r["duplicate_of"]) for r in deduplicate(spark.createDataFrame(rows, schema)).collect()}
    assert {r["ord"]: (r["duplicate_type"], r["duplicate_of"]) for r in store.read().collect()} == want
    assert told == want  # the changes alone lead to the same labels


def test_a_stream_of_candidates(spark, sf_dir, tmp_path):
    rows = with_fingerprints(cand(spark, sf_dir)).select("ord", "id", "content_hash", "instruction_hash")
    for part in (2, 1, 0):  # the smallest ordinals come last
        rows.where(F.floor(F.col("ord") / 70) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store = dedup.label_store(spark, f"{tmp_path}/labels", 4)
    dedup.follow(stream, store, f"{tmp_path}/checkpoint", f"{tmp_path}/changes").awaitTermination(120)
    want = {r["ord"]: (r["duplicate_type"], r["duplicate_of"]) for r in deduplicate(rows).collect()}
    assert {r["ord"]: (r["duplicate_type"], r["duplicate_of"]) for r in store.read().collect()} == want
    assert store.snapshot()["version"] == 3 and spark.read.parquet(f"{tmp_path}/changes").where("not arrived").count() > 0


PATTERNS = [r"^(Licensed|Released) .*\b(MIT|Apache)\b", r"thandon|reinthe", r"(?:and)+ the [a-z]{3,}tion", r"[A-Z]\w+@", r"e.e", r"Straße|ñol", r"The\b"]


@pytest.fixture(scope="module")
def indexed(spark, sf_dir, tmp_path_factory):
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text").cache()
    store = text_index.index_store(spark, str(tmp_path_factory.mktemp("index")), 4)
    text_index.update_index(store, files, 1, key="path", with_places=True)
    return files, store


@pytest.mark.parametrize("pattern", PATTERNS)
def test_indexed_code_search(spark, indexed, pattern):
    files, store = indexed
    got = sorted(map(tuple, text_index.search_indexed_lines(store, files, pattern).collect()))
    assert got == sorted(map(tuple, repository.search_lines(files, pattern).collect()))
    share = text_index.share_read(store, pattern)
    assert 0 <= share <= 1 and (share == 1) == (text_index.needed_grams(pattern) is None)
    if pattern == PATTERNS[0]:
        assert share < 0.3


@pytest.mark.parametrize("query", ["the License version of", "aaa an THE", "and the and", "zz", "ing tion ed"])
def test_indexed_memory_search(spark, indexed, query):
    files, store = indexed
    files = files.withColumnRenamed("path", "file")
    got = text_index.search_indexed(store, files, query)
    assert list(map(tuple, got.collect())) == (list(map(tuple, repository.search_memory(files, query).collect())) if any(len(t) > 2 for t in query.split()) else [])


def test_ranking_reads_no_texts(spark, indexed):
    _, store = indexed
    plan = text_index.rank_files(store, "the license version")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<file:string,gram:bigint,places:array<int>>" in plan and "text" not in plan.lower().replace("gettext", "")


def test_terms_that_overlap_themselves(spark, tmp_path):
    files = spark.createDataFrame([("a", "aaaaaaa"), ("b", "abababa xx"), ("c", None), ("d", "aa"), ("e", "ÀÉÎ àéî"), ("f", "😀bc😀BC")], "file string, text string")
    store = text_index.index_store(spark, str(tmp_path), 2)
    text_index.update_index(store, files, 1)
    for q in ("aaa", "aba", "abab xx", "àéî", "😀bc", "aa", "aaa aba"):
        want = [tuple(r) for r in repository.search_memory(files, q).select("file", "score").collect()] if any(len(t) > 2 for t in q.split()) else []
        assert [tuple(r) for r in text_index.rank_files(store, q).collect()] == want
    changed = spark.createDataFrame([("a", "nothing"), ("g", "aaa")], "file string, text string")
    text_index.update_index(store, changed, 2, removed=spark.createDataFrame([("b",), ("zz",)], "file string"))
    assert [tuple(r) for r in text_index.rank_files(store, "aaa").collect()] == [("g", 1)]
    assert not text_index.rank_files(store, "aba").collect() and store.read().where("file = 'b'").count() == 0


def test_postings_come_in_sorted_runs_and_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([("b", "zzz abc"), ("a", "abc yyy"), ("c", None), ("d", "abcabc")], "file string, text string")
    rows = [tuple(r) for r in text_index.postings(files.coalesce(1)).collect()]
    assert rows[0] == ("c", None, []) and [r[:2] for r in rows[1:]] == sorted([r[:2] for r in rows[1:]], key=lambda r: (r[1], r[0]))
    assert ("d", text_index.gram_code("abc"), [0, 3]) in rows and ("b", text_index.gram_code("abc"), [4]) in rows
    name, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    before = spark.conf.get(name)
    monkeypatch.setattr("pyspark.sql.DataFrameWriter.parquet", lambda self, path, f=type(files.write).parquet: seen.append((spark.conf.get(name), "Sort" in self._df._jdf.queryExecution().executedPlan().toString())) or f(self, path))
    text_index.update_index(text_index.index_store(spark, str(tmp_path), 4), files, 1)
    assert seen == [("4", False)] and spark.conf.get(name) == before


def test_texts_are_not_shuffled_for_few_candidates(spark, indexed):
    files, store = indexed
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = text_index.search_indexed_lines(store, files, PATTERNS[0])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_grams_that_a_pattern_needs():
    need = text_index.needed_grams
    assert need("abcd") == ["and", "abc", "bcd"] and need("a|bcd") is None and need("abc|bcd") == ["or", "abc", "bcd"]
    assert need(r"(abc)?x") is None and need(r"(?:abc)+") == "abc" and need(r"ab\w+cde") == "cde" and need(r"\Qabc\E") is None and need("[") is None
    assert need("ABC") == "abc" and need("aß") is None and need(r"a\.b") == "a.b"
    for pattern in PATTERNS:
        re.compile(pattern)


def test_batches_read_hashes_and_no_texts(spark, sf_dir, monkeypatch):
    plans, add = [], dedup.add_batch
    monkeypatch.setattr(dedup, "add_batch", lambda store, rows, batch: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or add(store, rows, batch))
    rows = Q.QUERIES["incremental_dedup"](spark, sf_dir)
    assert len(plans) == 4 and not any("parquet" in p or "sha2" in p for p in plans)
    assert rows.count() == table(spark, sf_dir, "documents").count()
