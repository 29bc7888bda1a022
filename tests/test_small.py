"""Rules that had no test of their own: a drop that rounds to zero, capped outputs, the index file, streaming pass rates."""

import json

import pytest
from pyspark.sql import functions as F

from grainmill.functions.text import cap_output
from grainmill.operators import conversation, curation, evaluation, repository, web
from grainmill.plans.evaluation_queries import results
from grainmill.sources import sinks
from grainmill.streaming import ingest


def test_a_drop_that_rounds_to_zero_is_a_drop(spark):
    graded = lambda passed, n: spark.range(n).select(F.lit("view").alias("category"), (F.col("id") < passed).alias("pass"))
    got = evaluation.verdict(evaluation.compare(graded(4000, 10000), graded(3985, 10000))).first()
    assert not got["passed"]
    assert got["reasons"] == "overall pass rate fell or missed the target: -0.15% (required +0.00%); category regressed: view -0% (allowed 0% drop)"
    assert evaluation.verdict(evaluation.compare(graded(5, 10), graded(6, 10))).first()["passed"]


@pytest.mark.parametrize("text, want", [("x" * 9, "x" * 9), ("x" * 10, "x" * 10), ("x" * 11, "x" * 10 + "\n... [output truncated]"), ("", ""), (None, None)])
def test_capped_output(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(cap_output(F.col("t"), 10)).first()[0] == want


def test_index_file(spark, tmp_path):
    files = spark.createDataFrame([("src/a.py", bytearray(b"x = 1\n")), ("README.md", bytearray("é".encode()))], "path string, content binary")
    index = repository.index_files(files)
    sinks.write_index(index, str(tmp_path), "/src", "2000-01-01T00:00:00+00:00")
    assert json.loads((tmp_path / "repository.json").read_text()) == {"generated_at": "2000-01-01T00:00:00+00:00", "root": "/src", "file_count": 2}
    held = [json.loads(line) for part in sorted((tmp_path / "files").glob("part-*")) for line in part.read_text().splitlines()]
    assert held == [r.asDict() for r in index.orderBy("path").collect()]


def test_reasons_stay_apart(spark):
    graded = lambda passed: spark.range(4).select(F.lit("a; b").alias("category"), (F.col("id") < passed).alias("pass"))
    compared = evaluation.compare(graded(4), graded(1))
    decided = evaluation.verdict(compared)
    reasons = json.loads(sinks.gate_json(decided, compared))["reasons"]
    assert len(reasons) == 2 and reasons[1].startswith("category regressed: a; b -75%")
    assert sinks.gate_markdown(decided, compared).endswith(f"- {reasons[0]}\n- {reasons[1]}\n")


def test_streaming_pass_rates(spark, sf_dir, tmp_path):
    """Results replayed as a stream, a part of them late within the watermark, are counted like a batch."""
    rows = results(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.col("ord") * 7)).select("ts", "category", "pass").where("ts < timestamp_seconds(40000)")
    late = F.col("ts").cast("long") % 7200 >= 6900  # these arrive with the next file
    cut = F.floor((F.col("ts").cast("long") + F.when(late, 300).otherwise(0)) / 7200).cast("int")
    for k in range(6):
        rows.where(cut == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = ingest.pass_rates(stream, lateness="2 hours").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination(120)
    got = {(r["window"]["start"], r["category"]): (r["passed"], r["scored"]) for r in spark.table("rates").collect()}
    batch = rows.where("pass is not null").groupBy(F.window("ts", "1 hour").alias("w"), "category").agg(F.count_if("pass").alias("passed"), F.count(F.lit(1)).alias("scored"))
    assert got and got == {(r["w"]["start"], r["category"]): (r["passed"], r["scored"]) for r in batch.collect()}


@pytest.mark.parametrize("href, want", [("a?x=1&amp;y=2", "a?x=1&y=2"), ("caf&eacute;", "café"), ("caf&#233;/&#xE9;", "café/é"), ("&amp;lt;", "&lt;"), ("&quot;&apos;&#39;&lt;&gt;", "\"''<>"), ("&nosuch; & so", "&nosuch; & so"),
                                        ("/l?uddg=https%3A%2F%2Fa.example%2F%C3%A9&amp;r=1", "https://a.example/é"), ("plain+path", "plain+path"), ("", ""), (None, None)])
def test_entities_of_links(spark, href, want):
    assert spark.createDataFrame([(href,)], "h string").select(web.decode_href(F.col("h"))).first()[0] == want
    if href:
        assert spark.createDataFrame([(f'<a href="{href}">t</a>',)], "h string").select(web.links(F.col("h"))).first()[0] == ([("t", want)] if '"' not in href else [])


def test_a_long_conversation_is_trimmed_before_the_shuffle(spark):
    turns = spark.range(100_000).select(F.lit(None).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 5, "system").when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("x").alias("text"))
    short = spark.createDataFrame([(1, 1, None, "a"), (1, 2, "user", None)], "conv_id bigint, turn bigint, role string, text string")
    trimmed = conversation.trim_context(turns.union(short))
    assert "WindowGroupLimit" in trimmed._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["conv_id"] or 0, r["place"], r["turn"]) for r in trimmed.collect())
    assert got == [(0, 1, 5), (0, 2, 0), *[(0, 3 + k, 99_988 + k) for k in range(12)], (1, 1, 1), (1, 2, 2)]


def test_repeated_completions_are_combined_before_the_shuffle(spark):
    rows = spark.range(50_000).select(F.col("id").alias("ord"), F.lit("t").alias("id"), F.lit("p").alias("prompt"), F.when(F.col("id") % 3 == 0, "").otherwise("c").alias("completion"))
    folded = curation.fold_rows(rows)
    assert "WindowGroupLimit" in folded._jdf.queryExecution().executedPlan().toString()
    assert [r["ord"] for r in folded.collect()] == [1]
