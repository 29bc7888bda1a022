"""Sessions and late results: batches against plain loops, streams replayed from files against batches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from grainmill.operators.curation import fold_rows
from grainmill.plans import request_queries as P
from grainmill.plans.curation_queries import table
from grainmill.streaming import sessions as E

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
START = datetime.datetime(2024, 3, 1)


def plain_sessions(rows, gap):
    found, open_ = [], {}
    for _, ts, user, kind, value, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1]):
        s = open_.get(user)
        if s is None or ts - s[2] > datetime.timedelta(seconds=gap):
            s = open_[user] = [user, ts, ts, 0, 0, None]
            found.append(s)
        s[2], s[3], s[4] = ts, s[3] + 1, s[4] + (kind == "error")
        s[5] = value if s[5] is None else s[5] if value is None else max(s[5], value)
    return sorted(map(tuple, found), key=str)


def random_events(seed, n=800):
    """Steps of exactly the gap, just beyond it, none and long ones; one user has a third of all events, some have no name."""
    rng, rows, ts = random.Random(seed), [], START
    for i in range(n):
        ts += datetime.timedelta(microseconds=rng.choice([0, 1, 600_000_000, 1_800_000_000, 1_800_000_001, 7_000_000_000]) if rng.random() < 0.5 else rng.randint(0, 10**9))
        user = 7 if rng.random() < 0.33 else rng.choice([None, 1, 2, 3])
        rows.append((i, None if rng.random() < 0.02 else ts, user, rng.choice(["error", "view", None]), rng.choice([None, 1.5, 7.0]), ""))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("chunk", [1, 24])
def test_sessions_of_a_plain_loop(spark, seed, chunk):
    rows = random_events(seed)
    got = E.event_sessions(spark.createDataFrame(rows, EVENTS), 1800, chunk).collect()
    assert sorted(map(tuple, got), key=str) == plain_sessions(rows, 1800)
    alone = [(i, START + datetime.timedelta(seconds=1800 * i), 1, "view", None, "") for i in range(100)]  # one session over many chunks
    got = E.event_sessions(spark.createDataFrame(alone, EVENTS), 1800, chunk).collect()
    assert [(r["n"], r["highest"]) for r in got] == [(100, None)]
    assert E.event_sessions(spark.createDataFrame([], EVENTS)).count() == 0


def replayed(spark, folder, rows, schema, parts):
    """A stream of files with the rows in the order given, and two far later rows in each of the last two files."""
    per = -(-len(rows) // parts)
    for k in range(parts + 2):
        held = rows[k * per : (k + 1) * per] if k < parts else [(10**9 + 2 * k + odd, START + datetime.timedelta(days=4000 + k), 10**9, "view", 0.0, "") for odd in (0, 1)]
        spark.createDataFrame(held, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03d}")
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def run(stream, folder):
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()


def late_order(rows, rng, seconds):
    """In order of time, each up to so many seconds late."""
    return sorted(rows, key=lambda r: r[1] + datetime.timedelta(seconds=rng.uniform(0, seconds)))


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [r for r in random_events(5, 400) if r[1] is not None]
    stream = replayed(spark, f"{tmp_path}/in", late_order(rows, random.Random(1), 500), EVENTS, 8)
    run(E.stream_sessions(stream(), 1800, "10 minutes"), str(tmp_path))
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r["user_id"] != 10**9]
    assert sorted(got, key=str) == plain_sessions(rows, 1800)


def test_events_replayed_with_results(spark, sf_dir, tmp_path):
    """``events`` in order, some rows late: the same results as of the batch. What comes after the watermark finds no task."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = [tuple(r) for r in events.collect()]
    want = {tuple(r) for r in E.task_results(*P.events_as_runs(events), 36000).collect()}
    stream = replayed(spark, f"{tmp_path}/in", late_order(rows, random.Random(2), 3000), EVENTS, 6)
    tasks, results = P.events_as_runs(stream())[0], P.events_as_runs(stream())[1]
    run(E.task_results(tasks, results, 36000, "1 hour"), str(tmp_path))
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r["task"] < 10**9}
    assert got == want and any(r[2] is None for r in want) and any(r[2] is not None for r in want)
    tasks, results = P.events_as_runs(events)
    timely = E.task_results(tasks, results, 0)
    assert timely.where("finished is not null and finished <> started").count() == 0 and timely.count() == tasks.count()


def test_a_result_after_the_watermark(spark, tmp_path):
    at = lambda s: START + datetime.timedelta(seconds=s)
    rows = [(0, at(0), 1, "view", 9.0, ""), (2, at(0), 1, "view", 9.0, ""), (100, at(50_000), 1, "view", 1.0, ""), (102, at(90_000), 1, "view", 1.0, ""), (103, at(90_000), 1, "view", 1.0, ""), (999, at(95_000), 1, "view", 1.0, ""), (1, at(10), 1, "view", 9.0, "")]
    as_runs = lambda df: (df.where("event_id % 2 = 0").select(F.col("event_id").alias("task"), F.col("ts").alias("started")), df.where("event_id % 2 = 1").select((F.col("event_id") - 1).alias("task"), F.col("ts").alias("finished"), F.lit(True).alias("pass")))
    batch = {r["task"]: r["pass"] for r in E.task_results(*as_runs(spark.createDataFrame(rows, EVENTS))).collect()}
    assert batch == {0: True, 2: None, 100: None, 102: True}
    stream = replayed(spark, f"{tmp_path}/in", rows, EVENTS, 7)
    run(E.task_results(as_runs(stream())[0], as_runs(stream())[1]), str(tmp_path))
    assert {r["task"]: r["pass"] for r in spark.read.parquet(f"{tmp_path}/out").collect() if r["task"] < 100} == {0: None, 2: None}


def test_hot_pairs_of_folds_are_limited_before_the_shuffle(spark, capsys):
    fold_rows(spark.createDataFrame([(1, "a", "p", "c")], "ord bigint, id string, prompt string, completion string")).explain()
    plan = capsys.readouterr().out
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
